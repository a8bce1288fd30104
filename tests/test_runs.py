"""Sources and parts are written in row order by tasks that sort nothing and hold no source."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tables import TABLES

from tributary.errors import Refusal
from tributary.lifecycle import QUERIES
from tributary.operators.align import align
from tributary.plans.lattice import propose
from tributary.plans.records import Limits, Source
from tributary.queries import _halves
from tributary.sources.parquet import footer, scan, sha256_file
from tributary.sources.parts import write_part
from tributary.sources.runs import Run, grouped, in_order

#: Rows of the files, so unlike that Spark deals their splits out in another order than theirs.
FILES = (10, 3000, 1, 0, 700, 45000, 20)


def sorted_mb(spark, work):
    """What `work` gives, and the most execution memory of a task (sorts, hashes) of its stages, in MB."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList()
    quantiles = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = lambda: {x.stageId(): x.peakExecutionMemory() for x in map(lambda i, s=store.stageList(none, False, False, quantiles, none): s.apply(i), range(store.stageList(none, False, False, quantiles, none).size()))}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    old = set(stages())
    out = work()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    new = {k: v for k, v in stages().items() if k not in old}
    assert new
    return out, max(new.values()) / 1e6


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def tables(root):
    (root / "t.parquet").mkdir()
    keys = iter(range(sum(FILES)))
    for i, n in enumerate(FILES):
        own = [k * 7 % 1000003 for _, k in zip(range(n), keys)]  # not in the order of the key
        pq.write_table(pa.table({"k": pa.array(own, pa.int64()), "v": [f"{k}" for k in own]}), root / "t.parquet" / f"part-{i:02d}.parquet", row_group_size=500)
    return [k * 7 % 1000003 for k in range(sum(FILES))]


def halves(spark, root, n, to):
    (root / to).mkdir()
    return _halves(spark, str(root), "t", ["k", "v"], "k", n, lambda i, t: t, root / to)


def test_sources_in_file_order_without_a_sort(spark, tmp_path, small_splits):
    keys = tables(tmp_path)
    (sources, paths), most = sorted_mb(spark, lambda: halves(spark, tmp_path, 3, "out"))
    assert most == 0
    for i, path in enumerate(paths):
        want = [k for k in keys if k % 3 == i]
        got = pq.read_table(path)
        assert got["k"].to_pylist() == want and got["v"].to_pylist() == [str(k) for k in want]
        assert sources[i].num_rows == len(want)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"t-{i}.parquet" for i in range(3)]  # no runs are left


def test_bytes_do_not_depend_on_splits(spark, tmp_path, small_splits):
    tables(tmp_path)
    first = halves(spark, tmp_path, 2, "a")[0]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
    assert halves(spark, tmp_path, 2, "b")[0] == first


def test_source_without_rows(spark, tmp_path):
    (tmp_path / "t.parquet").mkdir()
    pq.write_table(pa.table({"k": [4, 9], "v": ["a", None]}), tmp_path / "t.parquet" / "p.parquet")
    sources, paths = halves(spark, tmp_path, 5, "out")
    assert [s.num_rows for s in sources] == [0, 0, 0, 0, 2]
    assert pq.read_table(paths[4]).to_pylist() == [{"k": 4, "v": "a"}, {"k": 9, "v": None}]
    assert [f.name for f in sources[0].fields] == ["k", "v"] and sha256_file(paths[0])[1] == sources[0].sha256


def test_row_groups():
    batches = [pa.RecordBatch.from_pydict({"x": list(range(a, b))}) for a, b in ((0, 5), (5, 5), (5, 6), (6, 30), (30, 32))]
    assert [t["x"].to_pylist() for t in grouped(batches, 8)] == [list(range(a, a + 8)) for a in (0, 8, 16, 24)]
    assert [t.num_rows for t in grouped(batches, 10)] == [10, 10, 10, 2] and not list(grouped([], 8))


def test_runs_that_overlap_refuse():
    runs = [Run(0, "b", 0, 9, "p", 0), Run(0, "a", 7, 9, "p", 0), Run(0, "a", 0, 6, "q", 0), Run(1, "a", 3, 8, "r", 0)]
    assert [(r.file, r.first) for r in in_order(runs)[0]] == [("a", 0), ("a", 7), ("b", 0)]
    with pytest.raises(Refusal):
        in_order([*runs, Run(0, "a", 5, 8, "s", 0)])


def part(spark, tmp_path, change=lambda df: df):
    path = tmp_path / "s.parquet"
    pq.write_table(pa.table({"k": range(30000)}), path, row_group_size=500)
    columns, pairs, rows = footer(path)
    source = Source(0, "s.parquet", "0" * 64, 1, rows, columns, pairs)
    proposal = propose((source,))
    df = align(scan(spark, str(path), 0, columns), columns, proposal.fields)
    (out := tmp_path / "out").mkdir()
    done, most = sorted_mb(spark, lambda: write_part(change(df), proposal, 0, out, Limits.cluster()))
    return done, pq.read_table(out / done.filename), [p.name for p in out.iterdir()], most


def test_part_in_row_order_without_a_sort(spark, tmp_path, small_splits):
    done, table, names, most = part(spark, tmp_path)
    assert most == 0 and names == [done.filename]
    assert done.rows == 30000 and table["__pc_row"].to_pylist() == table["k"].to_pylist() == list(range(30000))


def test_part_of_rows_in_another_order(spark, tmp_path, small_splits):
    done, table, names, _ = part(spark, tmp_path, lambda df: df.repartition(3, "k"))
    assert done.rows == 30000 and names == [done.filename]
    assert table["__pc_row"].to_pylist() == table["k"].to_pylist() == list(range(30000))


def test_part_with_a_row_twice_refuses(spark, tmp_path):
    with pytest.raises(Refusal):
        part(spark, tmp_path, lambda df: df.union(df))
    assert not list((tmp_path / "out").iterdir())


def plans_since(spark, before):
    """The number of executions so far, and the plans of those after `before`."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    every = spark._jsparkSession.sharedState().statusStore().executionsList()
    return every.size(), [every.apply(i).physicalPlanDescription() for i in range(before, every.size())]


#: Queries over sources made from a table.
MADE = [
    "dataset_report",
    "origin_lookup",
    "origin_refusals",
    "published_dataset",
    "source_hashes",
    "sources_where_they_are",
    "split_parts",
    "stream_of_files",
    "union_by_name_null_insert",
    "observation_count",
    "struct_union",
    "verify_clean",
    "verify_mutated",
    "widen_signed_unsigned",
    "feasibility_overflow",
    "widen_timestamp_ns",
    "reconcile_rows",
    "signed_zero_nan",
]


@pytest.mark.parametrize("name", MADE)
def test_no_sort_before_a_writing_task(spark, name):
    before, _ = plans_since(spark, 0)
    QUERIES[name](spark, TABLES)
    _, plans = plans_since(spark, before)
    writing = [p for p in plans if "MapInArrow" in p]
    assert writing and not [p for p in writing if "Sort" in p or "Exchange" in p]
