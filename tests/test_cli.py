"""The six commands end to end, in this process."""

import json

import pytest

from tributary import cli
from tributary.examples import create


@pytest.fixture(autouse=True)
def one_session(spark, monkeypatch):
    monkeypatch.setattr(cli, "_spark", lambda: spark)


def test_commands(tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    create(tmp_path / "sources")
    at = lambda *args: cli.main([str(a) for a in args])
    assert at("plan", "--sources", "sources", "--input", "legacy.parquet", "--input", "new.parquet", "--out", "plan.json") == 1
    assert "NEEDS_DECISIONS" in capsys.readouterr().out
    assert at("inspect", "plan.json") == 0
    p = json.loads((tmp_path / "plan.json").read_text())
    decide = lambda n: (tmp_path / f"d{n}.json").write_text(json.dumps({"format_version": 1, "plan_digest": p["plan_digest"], "resolutions": [{"conflict_digest": c["conflict_digest"], "action": "archive_only"} for c in p["proposal"]["conflicts"][:n]]}))
    decide(1), decide(2)
    assert at("decide", "plan.json", "--decisions", "d1.json", "--out", "no.json") == 1 and not (tmp_path / "no.json").exists()
    assert at("decide", "plan.json", "--sources", "sources", "--decisions", "d2.json", "--out", "approved.json") == 0
    assert at("inspect", "approved.json") == 0
    assert at("apply", "approved.json", "--sources", "sources", "--out", "result") == 0
    assert at("apply", "approved.json", "--sources", "sources", "--out", "result") == 1
    assert at("origin", "result", "--source-id", 1, "--row", 0) == 0
    out = capsys.readouterr().out
    assert '"cm"' in out and "OUTPUT_HASHES_MATCH" in out
    assert at("origin", "result", "--source-id", 1, "--row", 0, "--sources", "sources") == 0
    assert at("origin", "result", "--source-id", 9, "--row", 0) == 2
    assert at("verify", "approved.json", "--sources", "sources", "--dataset", "result", "--report", "report.json") == 0
    assert json.loads((tmp_path / "report.json").read_text())["status"] == "VERIFIED"
    assert at("verify", "approved.json", "--sources", "nowhere", "--dataset", "result") == 3
    assert at("inspect", "result") == 0 and "HISTORICAL" in capsys.readouterr().out
    assert at("inspect", "missing.json") == 2
    assert at("plan", "--sources", "sources", "--input", "../x", "--out", "x.json") == 2
    assert at("plan", "--sources", "sources", "--input", "legacy.parquet", "--out", "plan.json") == 1


def test_a_wall_clock_limit_stops_jobs(spark):
    from pyspark.sql import functions as F

    from tributary.errors import Refusal
    from tributary.plans.records import Limits

    slow = spark.range(0, 4_000_000_000, 1, 4).select(F.sum(F.xxhash64("id") % 7))
    with pytest.raises(Refusal) as found:
        cli.bounded(spark, Limits(wall_seconds=1), slow.collect)
    assert found.value.status == "LIMIT_EXCEEDED"
