import random
import re

import pytest
from helpers import TABLES, corpus, empty, frame

from tributary.llm import curriculum_mix as m
from tributary.llm.queries import QUERIES


def targets(sizes, weights=(1, 2, 3), repeats=3):
    """Share by weight, cap, share the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > repeats * sizes[s]}
        if not over:
            return out | share
        out |= {s: repeats * sizes[s] for s in over}
        open_ -= over
    return out


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, got):
    """rows: (id, text, source); got has the plan's columns and `source` by id order."""
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size_of(t)
    want = targets(sizes)
    taken = {s: 0 for s in sizes}
    for r in got:
        assert r.taken <= 3 * r.size and abs(r.target - want[r.row.source]) < 1e-6 * max(1, want[r.row.source])
        assert r.size == size_of(r.row.text) and r.source_size == sizes[r.row.source]
        taken[r.row.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-3


def test_plan(spark):
    rows = corpus()
    got = m.plan_mixture(frame(spark, rows), carry=True).collect()
    assert len(got) == len(rows)
    check([(r[0], r[1], r[3]) for r in rows], got)
    for r in got:
        assert len(r.positions) == sum(1 for t in r.taken_by_pass if t) and sorted(r.positions) == list(r.positions)
        assert all(0 <= p <= 1 for p in r.positions)


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.choice([0, 1, 5, 50]), rng.choice(["a", "b", "é", "zz", "Z", "10", "9", None, "hot", "hot", "hot"])) for i in range(200)]
    got = m.plan_mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"), carry=True).collect()
    check(rows, got)


def test_reruns_agree(spark):
    rows = corpus()
    plain = lambda n: sorted([(r.id, r.size, r.taken, tuple(r.positions)) for r in m.plan_mixture(frame(spark, rows, n)).collect()], key=str)
    assert plain(1) == plain(5)


def test_positions_follow_the_schedule(spark):
    """The words a source has used by a time are the integral of its schedule."""
    rows = [(i, "w " * 10, s) for s in ("a", "b", "c") for i in range(2000)]
    knots = ((0.0, 0.0), (0.25, 2.0), (0.5, 0.0), (1.0, 1.0))
    plan = m.plan_mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"), schedules=(knots,), carry=True)
    used = lambda t: sum((min(t, t1) - t0) * (r0 + (r0 + (r1 - r0) * (min(t, t1) - t0) / (t1 - t0))) / 2 for (t0, r0), (t1, r1) in zip(knots, knots[1:]) if t > t0)
    for s in ("a", "b", "c"):
        own = [(p, 10) for r in plan.where(f"row.source = '{s}'").collect() for p in r.positions]
        for t in (0.1, 0.25, 0.4, 0.5, 0.8, 1.0):
            assert abs(sum(n for p, n in own if p <= t) / sum(n for _, n in own) - used(t) / used(1.0)) < 0.01


def test_stream_is_sorted_and_whole(spark):
    rows = corpus()
    docs = frame(spark, rows)
    got = m.mixture(docs)
    assert got.columns == docs.columns
    whole = {(r[0], r[1]) for r in rows}
    assert all((r.doc_id, r.text) in whole for r in got.collect())
    order = [r.position for r in m.by_position(m.plan_mixture(docs)).selectExpr("get(positions, 0) AS position").collect()]
    assert [p for p in order if p is not None] == sorted(p for p in order if p is not None) and None not in order[: sum(p is not None for p in order)]


def test_empty_table_and_single_source(spark):
    assert m.plan_mixture(empty(spark)).count() == 0 and m.mixture(empty(spark)).count() == 0
    one = m.plan_mixture(spark.createDataFrame([(1, "a b", "s"), (2, "c", "s")], "doc_id long, text string, source string")).collect()
    assert {(r.id, r.taken, r.target) for r in one} == {(1, 2, 3.0), (2, 1, 3.0)}


def test_query_on_the_table(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    check([(r.doc_id, r.text, r.source) for r in docs.collect()], m.plan_mixture(docs, carry=True).collect())
    query = QUERIES["op10_curriculum_mix"](spark, TABLES)
    assert not re.search("Python|Pandas|Arrow", query._jdf.queryExecution().executedPlan().toString())
    assert query.count() == docs.count()
