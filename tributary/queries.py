"""The catalogue: every operator over the tables, through plans, alignment and verification.

Sources are made from a table by Spark tasks, which split it by a key in file order and write each
half with exact Arrow types into the shared folder; the contract starts from those files' footers.
Tables are only read through Spark, footers through Spark's stores.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tributary.errors import Refusal
from tributary.examples import create
from tributary.operators.align import converge
from tributary.operators.feasibility import conflicts_frame, operations_frame, plan, proposal_frame, row_counts, violations
from tributary.operators.verify import compare, observations
from tributary.plans.lattice import propose
from tributary.plans.records import Limits, Plan, Proposal, Source
from tributary.plans.types import ROW, SOURCE
from tributary.session import exact
from tributary.sources.parquet import Copy, HadoopFile, clear, footer, inventory, scan, sha256_file
from tributary.sources.runs import RUNS, Run, grouped, in_order, read_runs, write_runs

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _space(spark: SparkSession) -> Path:
    """A folder for the sources of one query: in the shared folder that spark.checkpoint.dir names, a local one where that is unset."""
    exact(spark)
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        return Path(tempfile.mkdtemp(prefix="tributary-query-"))
    at = urlparse(shared)
    if at.scheme not in ("", "file"):
        raise Refusal(f"exact parts are written to a mounted folder, not to {shared}", "UNSUPPORTED")
    root = Path(at.path) / f"tributary-query-{uuid.uuid4().hex}"
    root.mkdir(parents=True)
    return root


def _write_halves(root: str, name: str, runs: dict[int, list[Run]], empty: pa.Table, make):
    """A file for each half that comes in, from its runs one after another."""

    def write(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                draft = f"{root}/.{name}-{i}.{uuid.uuid4().hex}"  # a task that runs again writes another file
                writer = None
                for table in grouped(read_runs(runs[i])) if i in runs else (empty,):
                    out = make(i, table)
                    writer = writer or pq.ParquetWriter(draft, out.schema, version="2.6")
                    writer.write_table(out)
                writer.close()
                os.replace(draft, f"{root}/{name}-{i}.parquet")
                yield pa.RecordBatch.from_pydict({"half": pa.array([i], pa.int32())} | dict(zip(("size", "sha256"), ([x] for x in sha256_file(Path(f"{root}/{name}-{i}.parquet"))))))

    return write


def _halves(spark: SparkSession, sf_dir: str, name: str, columns: list[str], key: str, n: int, make, root: Path) -> tuple[tuple[Source, ...], list[str]]:
    """Sources 0 .. n-1 of the rows with key % n, one task each; make(source, table) gives a table in the source's types.

    The tasks that read the table write runs, and those of the sources join them: no task sorts or holds a source.
    """
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    rows = table.select(*columns, (F.col(key) % n).cast("int").alias("__half"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    folder = root / f".{name}-runs.{uuid.uuid4().hex}"
    folder.mkdir()
    try:
        runs = in_order(Run(*r) for r in rows.mapInArrow(write_runs(str(folder)), RUNS).collect())  # a row a source and stretch of a file
        write = _write_halves(str(root), name, runs, to_arrow_schema(table.select(*columns).schema).empty_table(), make)
        done = {r["half"]: (r["size"], r["sha256"]) for r in spark.range(0, n, 1, n).mapInArrow(write, "half int, size long, sha256 string").collect()}  # a row a file
    finally:
        clear(folder)
    copies = [Copy(f"{name}-{i}.parquet", root / f"{name}-{i}.parquet", *done[i]) for i in range(n)]
    return inventory(copies, Limits.cluster(), spark), [str(c.path) for c in copies]


def _in_place(spark: SparkSession, path: str, name: str) -> Source:
    """A whole table as a source, read where it is; its hash is not needed for a scan."""
    columns, pairs, rows = footer(HadoopFile(spark, path))
    return Source(0, name, "0" * 64, 0, rows, columns, pairs)


def _converged(spark: SparkSession, sources, paths) -> tuple[DataFrame, Proposal]:
    proposal = propose(sources)
    return converge(spark, sources, paths, proposal), proposal


@query("SELECT event_id, user_id, event_type, value, 0 AS __pc_source, event_id AS __pc_row FROM events")
def scan_provenance(spark, sf_dir):
    exact(spark)
    path = f"{sf_dir}/events.parquet"
    source = _in_place(spark, path, "events.parquet")
    return converge(spark, (source,), [path], propose((source,))).select("event_id", "user_id", "event_type", "value", SOURCE, ROW)


@query(
    "SELECT 0 AS __pc_source, o_orderkey, CAST(NULL AS STRING) AS o_orderpriority, o_totalprice FROM orders WHERE o_orderkey % 2 = 0"
    " UNION ALL SELECT 1, o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderkey % 2 = 1"
)
def union_by_name_null_insert(spark, sf_dir):
    make = lambda i, t: t.select(["o_orderkey", "o_totalprice"] + ["o_orderpriority"] * i)
    sources, paths = _halves(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice", "o_orderpriority"], "o_orderkey", 2, make, _space(spark))
    return _converged(spark, sources, paths)[0].select(SOURCE, "o_orderkey", "o_orderpriority", "o_totalprice")


@query("SELECT 0 AS __pc_source, p_partkey, CAST(p_size AS INT) AS x FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 1, p_partkey, p_size FROM part WHERE p_partkey % 2 = 1")
def widen_int(spark, sf_dir):
    make = lambda i, t: pa.table({"p_partkey": t["p_partkey"], "x": t["p_size"].cast([pa.int8(), pa.int32()][i])})
    sources, paths = _halves(spark, sf_dir, "part", ["p_partkey", "p_size"], "p_partkey", 2, make, _space(spark))
    return _converged(spark, sources, paths)[0].select(SOURCE, "p_partkey", "x")


@query(
    "SELECT 0 AS __pc_source, o_orderkey, CAST(o_custkey - 1000 AS DECIMAL(20,0)) AS x FROM orders WHERE o_orderkey % 2 = 0"
    " UNION ALL SELECT 1, o_orderkey, CAST(CAST(18446744073709551615 AS DECIMAL(20,0)) - CAST(o_custkey AS DECIMAL(20,0)) AS DECIMAL(20,0)) FROM orders WHERE o_orderkey % 2 = 1"
)
def widen_signed_unsigned(spark, sf_dir):
    def make(i, t):
        key = np.asarray(t["o_custkey"])
        x = pa.array(key - 1000) if i == 0 else pa.array(np.uint64((1 << 64) - 1) - key.astype(np.uint64))
        return pa.table({"o_orderkey": t["o_orderkey"], "x": x})

    sources, paths = _halves(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"], "o_orderkey", 2, make, _space(spark))
    return _converged(spark, sources, paths)[0].select(SOURCE, "o_orderkey", "x")


@query("SELECT c_custkey, CAST(CAST(c_custkey AS DECIMAL(10,2)) AS DECIMAL(13,5)) AS x FROM customer")
def widen_decimal_scale(spark, sf_dir):
    make = lambda i, t: pa.table({"c_custkey": t["c_custkey"], "x": t["c_custkey"].cast(pa.decimal128(21, 2)).cast([pa.decimal128(10, 2), pa.decimal128(13, 5)][i], safe=True)})
    sources, paths = _halves(spark, sf_dir, "customer", ["c_custkey"], "c_custkey", 2, make, _space(spark))
    return _converged(spark, sources, paths)[0].select("c_custkey", "x")


@query(
    "SELECT 0 AS __pc_source, c_custkey, CAST(c_custkey AS DECIMAL(21,2)) AS x FROM customer WHERE c_custkey % 2 = 0"
    " UNION ALL SELECT 1, c_custkey, CAST(CAST(c_nationkey AS DECIMAL(10,2)) AS DECIMAL(21,2)) FROM customer WHERE c_custkey % 2 = 1"
)
def widen_int_decimal(spark, sf_dir):
    make = lambda i, t: pa.table({"c_custkey": t["c_custkey"], "x": t["c_custkey"].cast(pa.int64()) if i == 0 else t["c_nationkey"].cast(pa.decimal128(12, 2)).cast(pa.decimal128(10, 2))})
    sources, paths = _halves(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"], "c_custkey", 2, make, _space(spark))
    return _converged(spark, sources, paths)[0].select(SOURCE, "c_custkey", "x")


@query("SELECT s_suppkey, CAST(CAST(s_acctbal AS FLOAT) AS DOUBLE) AS x FROM supplier")
def widen_float(spark, sf_dir):
    def make(i, t):
        narrow = t["s_acctbal"].cast(pa.float32(), safe=False)
        return pa.table({"s_suppkey": t["s_suppkey"], "x": narrow if i == 0 else narrow.cast(pa.float64())})

    sources, paths = _halves(spark, sf_dir, "supplier", ["s_suppkey", "s_acctbal"], "s_suppkey", 2, make, _space(spark))
    return _converged(spark, sources, paths)[0].select("s_suppkey", "x")


@query("SELECT event_id, EPOCH_US(ts) * 1000 AS tick_ns FROM events")
def widen_timestamp_ns(spark, sf_dir):
    make = lambda i, t: pa.table({"event_id": t["event_id"], "tick_ns": t["ts"].cast(pa.timestamp(["us", "ns"][i]))})
    sources, paths = _halves(spark, sf_dir, "events", ["event_id", "ts"], "event_id", 2, make, _space(spark))
    return _converged(spark, sources, paths)[0].select("event_id", "tick_ns")


def _payload(i: int, t: pa.Table) -> pa.Table:
    """payload: null where the key is a multiple of 11 in source 0, which lacks the child y."""
    missing = np.asarray(t["o_orderkey"]) % 11 == 0
    x, y = t["o_custkey"].combine_chunks(), t["o_orderstatus"].combine_chunks()
    if i == 0:
        payload = pa.StructArray.from_arrays([x], ["x"], mask=pa.array(missing))
    else:
        payload = pa.StructArray.from_arrays([x, y], ["x", "y"])
    return pa.table({"o_orderkey": t["o_orderkey"], "payload": payload})


@query(
    "SELECT 0 AS __pc_source, o_orderkey, (o_orderkey % 11 = 0) AS p_null, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS p_x, CAST(NULL AS STRING) AS p_y FROM orders WHERE o_orderkey % 2 = 0"
    " UNION ALL SELECT 1, o_orderkey, FALSE, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 1"
)
def struct_union(spark, sf_dir):
    sources, paths = _halves(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"], "o_orderkey", 2, _payload, _space(spark))
    df = _converged(spark, sources, paths)[0]
    return df.select(SOURCE, "o_orderkey", F.col("payload").isNull().alias("p_null"), F.col("payload.x").alias("p_x"), F.col("payload.y").alias("p_y"))


@query("SELECT COUNT(*) AS violations, MIN(o_orderkey) AS first_row FROM orders WHERE o_orderkey * 1000000000000 > 9223372036854775")
def feasibility_overflow(spark, sf_dir):
    root = _space(spark)
    sources, paths = _halves(spark, sf_dir, "orders", ["o_orderkey"], "o_orderkey", 1, lambda i, t: pa.table({"t": pa.array(np.asarray(t["o_orderkey"]) * 10**12).cast(pa.timestamp("us"))}), root)
    other = root / "ns.parquet"
    pq.write_table(pa.table({"t": pa.array([1], pa.int64()).cast(pa.timestamp("ns"))}), other, version="2.6")
    columns, pairs, rows = footer(str(other))
    sources = (*sources, Source(1, other.name, *reversed(sha256_file(other)), rows, columns, pairs))
    found = violations(spark, sources, [*paths, str(other)], propose(sources))
    return found.agg(F.count("*").alias("violations"), F.min(ROW).alias("first_row"))


@query("SELECT CAST(o_orderkey % 3 AS INT) AS __pc_source, COUNT(*) AS n FROM orders GROUP BY 1")
def reconcile_rows(spark, sf_dir):
    sources, paths = _halves(spark, sf_dir, "orders", ["o_orderkey"], "o_orderkey", 3, lambda i, t: t, _space(spark))
    return row_counts(spark, sources, paths).where("n = declared").select(SOURCE, "n")


@query("SELECT MIN(event_id) AS lo, MAX(event_id) AS hi, COUNT(*) AS n, COUNT(DISTINCT event_id) AS d FROM events")
def dense_coordinates(spark, sf_dir):
    exact(spark)
    path = f"{sf_dir}/events.parquet"
    rows = scan(spark, path, 0, _in_place(spark, path, "events.parquet").fields).select(ROW)
    return rows.agg(F.min(ROW).alias("lo"), F.max(ROW).alias("hi"), F.count("*").alias("n"), F.countDistinct(ROW).alias("d"))


@query("SELECT CAST(SUM(2 + CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 2 END) AS BIGINT) AS n_values FROM orders")
def observation_count(spark, sf_dir):
    def make(i, t):
        missing = pa.array(np.asarray(t["o_orderkey"]) % 11 == 0)
        pair = pa.StructArray.from_arrays([t["o_custkey"].combine_chunks(), t["o_orderstatus"].combine_chunks()], ["x", "y"], mask=missing)
        return pa.table({"o_orderkey": t["o_orderkey"], "payload": pair})

    sources, paths = _halves(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"], "o_orderkey", 2, make, _space(spark))
    want = propose(sources).fields
    counts = [scan(spark, p, s.source_id, s.fields).agg(F.sum(observations(None, s.fields, want)).alias("n")) for s, p in zip(sources, paths)]
    return reduce(DataFrame.union, counts).agg(F.sum("n").alias("n_values"))


def _output(df: DataFrame, proposal: Proposal) -> DataFrame:
    """Converged rows under the names that `compare` gives to an output."""
    return df.select(*[F.col(f.name).alias(f"o{i}") for i, f in enumerate(proposal.fields)], SOURCE, ROW)


def _faults(spark, sources, paths, proposal: Proposal, output: DataFrame) -> DataFrame:
    frames = [compare(scan(spark, p, s.source_id, s.fields), s.fields, output.where(F.col(SOURCE) == s.source_id), proposal.fields, s.source_id, key=ROW) for s, p in zip(sources, paths)]
    return reduce(DataFrame.union, frames)


@query("SELECT 2 AS files, COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS mismatches FROM orders")
def verify_clean(spark, sf_dir):
    sources, paths = _halves(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"], "o_orderkey", 2, _payload, _space(spark))
    df, proposal = _converged(spark, sources, paths)
    wrong = _faults(spark, sources, paths, proposal, _output(df, proposal)).agg(F.count("*").alias("mismatches"))
    total = df.agg(F.countDistinct(SOURCE).cast("int").alias("files"), F.count("*").alias("n_rows"))
    return total.withColumn("one", F.lit(1)).join(wrong.withColumn("one", F.lit(1)), "one").drop("one")


@query(
    "SELECT CAST(o_orderkey % 2 AS INT) AS __pc_source, CAST((o_orderkey - o_orderkey % 2) / 2 AS BIGINT) AS __pc_row, '[\"x\"]' AS path, 'logical value differs' AS reason FROM orders WHERE o_orderkey % 997 = 0"
)
def verify_mutated(spark, sf_dir):
    make = lambda i, t: pa.table({"k": t["o_orderkey"], "x": t["o_custkey"].cast([pa.int32(), pa.int64()][i])})
    sources, paths = _halves(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"], "o_orderkey", 2, make, _space(spark))
    df, proposal = _converged(spark, sources, paths)
    bad = df.withColumn("x", F.when(F.col("k") % 997 == 0, F.col("x") + 1).otherwise(F.col("x")))
    return _faults(spark, sources, paths, proposal, _output(bad, proposal)).select(SOURCE, ROW, "path", "reason")


@query("SELECT event_id FROM events WHERE event_id % 500 = 0")
def signed_zero_nan(spark, sf_dir):
    def make(i, t):
        key, x = np.asarray(t["event_id"]), np.asarray(t["value"]).copy()
        x[key % 7 == 0] = np.nan
        x[key % 500 == 0] = -0.0
        return pa.table({"event_id": t["event_id"], "x": x})

    sources, paths = _halves(spark, sf_dir, "events", ["event_id", "value"], "event_id", 1, make, _space(spark))
    df, proposal = _converged(spark, sources, paths)
    plus = df.withColumn("x", F.when(F.col("event_id") % 500 == 0, F.lit(0.0)).otherwise(F.col("x")))
    return _faults(spark, sources, paths, proposal, _output(plus, proposal)).join(df, ROW).select("event_id")


def _example(spark) -> Proposal:
    root = _space(spark) / "sources"
    create(root)
    return plan(spark, root, ["legacy.parquet", "new.parquet"]).proposal


@query(
    "SELECT * FROM (VALUES ('[\"device\"]','decimal128(20,0)',true),('[\"note\"]','string',true),('[\"payload\"]','struct',true),('[\"payload\",\"distance\"]','int64',true),('[\"payload\",\"status\"]','string',true),('[\"tick\"]','timestamp(ns,UTC)',true)) AS t(path, type, nullable)"
)
def schema_proposal(spark, sf_dir):
    return proposal_frame(spark, _example(spark))


@query(
    "SELECT * FROM (VALUES (0,'[\"device\"]','widen'),(0,'[\"note\"]','null_insert'),(0,'[\"payload\"]','struct_union'),(0,'[\"payload\",\"distance\"]','widen'),(0,'[\"payload\",\"status\"]','null_insert'),(0,'[\"tick\"]','identity'),"
    "(1,'[\"device\"]','widen'),(1,'[\"note\"]','identity'),(1,'[\"payload\"]','struct_union'),(1,'[\"payload\",\"distance\"]','identity'),(1,'[\"payload\",\"status\"]','identity'),(1,'[\"tick\"]','identity')) AS t(source_id, path, kind)"
)
def operations(spark, sf_dir):
    return operations_frame(spark, _example(spark))


@query("SELECT * FROM (VALUES ('[]','producer',0,'legacy'),('[]','producer',1,'new'),('[\"payload\",\"distance\"]','unit',0,'m'),('[\"payload\",\"distance\"]','unit',1,'cm')) AS t(path, k, source_id, v)")
def conflicts(spark, sf_dir):
    return conflicts_frame(spark, _example(spark))


def workloads(root: Path) -> dict[str, tuple[list[str], Limits]]:
    """Small sources for each outcome of planning, under `root`; they read none of the tables."""

    def put(name: str, *tables: pa.Table) -> list[str]:
        files = [f"{name}-{i}.parquet" for i in range(len(tables))]
        for file, table in zip(files, tables):
            pq.write_table(table, root / file, version="2.6")
        return files

    def x(values, t, field=None, meta=None) -> pa.Table:
        return pa.table([pa.array(values, t)], schema=pa.schema([pa.field("x", t, metadata=field)], metadata=meta))

    ordinary = put("ordinary", pa.table({"id": [1, 2], "label": ["a", "b"]}), pa.table({"id": [3], "extra": [True]}))
    pq.write_table(pa.table({"x": [[1.0], [2.0, 3.0]]}), root / "list.parquet")
    full = Limits()
    return {
        "ordinary": (ordinary, full),
        "metadata_conflict": (put("metadata", x([1], pa.int32(), {"unit": "m"}, {"producer": "A"}), x([2], pa.int32(), {"unit": "cm"}, {"producer": "B"})), full),
        "integer_float": (put("mixed", x([9007199254740993], pa.int64()), x([0.5], pa.float64())), full),
        "timestamp_overflow": (put("ticks", x([(1 << 63) - 1], pa.timestamp("ms")), x([1], pa.timestamp("ns"))), full),
        "list_column": (["list.parquet"], full),
        "missing_source": (["nowhere.parquet"], full),
        "row_cap": (ordinary, Limits(max_rows=2)),
    }


@query(
    "SELECT * FROM (VALUES ('ordinary','READY_FOR_REVIEW'),('metadata_conflict','NEEDS_DECISIONS'),('integer_float','UNSUPPORTED'),('timestamp_overflow','DATA_INCOMPATIBLE'),('list_column','UNSUPPORTED'),('missing_source','INCOMPLETE'),('row_cap','LIMIT_EXCEEDED')) AS t(workload, status)"
)
def outcomes(spark, sf_dir):
    root = _space(spark)
    plans: dict[str, Plan] = {name: plan(spark, root, files, limits) for name, (files, limits) in workloads(root).items()}
    return spark.createDataFrame([(name, p.status) for name, p in plans.items()], "workload string, status string")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of orders with a missing column and an int/decimal difference, planned, aligned and united."""

    def make(i, t):
        amount = t["o_custkey"] if i == 0 else t["o_custkey"].cast(pa.decimal128(21, 2))
        return t.select(["o_orderkey", "o_orderstatus"][: 2 - i]).append_column("o_amount", amount)

    sources, paths = _halves(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"], "o_orderkey", 2, make, _space(spark))
    return _converged(spark, sources, paths)[0]
