import pyarrow as pa
import pyarrow.parquet as pq

from tributary.plans.lattice import propose
from tributary.plans.records import Source
from tributary.sources.parquet import footer
from tributary.streaming import aligned_stream


def test_new_files_are_aligned(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    pq.write_table(pa.table({"x": pa.array([1, 2], pa.int32())}), inbox / "a.parquet")
    columns, pairs, rows = footer(str(inbox / "a.parquet"))
    have = Source(0, "a.parquet", "0" * 64, 1, rows, columns, pairs)
    pq.write_table(pa.table({"x": pa.array([3], pa.int64()), "y": ["z"]}), tmp_path / "b.parquet")
    other = Source(1, "b.parquet", "0" * 64, 1, 1, *footer(str(tmp_path / "b.parquet"))[:2])
    df = aligned_stream(spark, str(inbox), have, propose((have, other)))
    q = df.writeStream.format("memory").queryName("aligned").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    pq.write_table(pa.table({"x": pa.array([9], pa.int32())}), inbox / "c.parquet")
    q.processAllAvailable()
    q.stop()
    got = sorted((r["x"], r["y"], r["__pc_row"]) for r in spark.table("aligned").collect())
    assert got == [(1, None, 0), (2, None, 1), (9, None, 0)] and dict(df.dtypes)["x"] == "bigint"
