"""Exact top-k search in Hamming space by incremental multi-index hashing.

A code is cut into m segments of about log2(codes) bits, each with its own table from segment
value to codes. In round r a query looks up, in every segment, the values at distance r from its
own, and verifies the codes found there over all bits. After the round every code at a distance of
up to m * r + m - 1 has been seen: one further off than r in all segments differs in m * (r + 1)
bits at least. A query ends as soon as its kth verified distance is within this cover, so the
result is exact.

The tables are dealt by (segment, first bits of the value) to shards of about `entries` codes. A
query goes only to the shards whose first bits are within the radius of its own: the share of
shards that it visits falls as the tables grow. Shards with more codes are salted. A task builds a
shard's table once and streams the queries through it, and gives at most k ids a query. Equal
codes are one entry with their smallest ids, so a vector that a third of all rows share costs one.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.llm.storage import discard, written

SALTS = 64
ROW = "s int, prefix long, salt int, asks int, code binary, ids array<long>"
FOUND = "code binary, neighbor_id long, distance int"
FOUND_ARROW = pa.schema([("code", pa.binary()), ("neighbor_id", pa.int64()), ("distance", pa.int32())])


def sign_codes(vectors: pa.Array, bits: int) -> list[bytes | None]:
    """Bit j of a code is vector[j] > 0; missing, null and NaN elements are 0, null vectors have none."""
    offsets, values = np.asarray(vectors.offsets), np.nan_to_num(np.asarray(vectors.values.cast(pa.float64()).fill_null(0)))
    n = len(vectors)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(n), sizes)
    place = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes)
    flat = np.zeros((n, bits), bool)
    flat[row, place] = values[offsets[0] : offsets[-1]] > 0
    packed = np.packbits(flat, axis=1)
    return [None if missing else packed[i].tobytes() for i, missing in enumerate(np.asarray(vectors.is_null()))]


def _encode(bits: int):
    def encode(batches):
        for batch in batches:
            codes = sign_codes(batch.column("vector"), bits)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(codes, pa.binary())], names=["id", "code"])

    return encode


class Layout:
    """How codes of `bits` bits are cut: m segments of b bits, the first p of which name a shard."""

    def __init__(self, bits: int, codes: int, entries: int):
        self.bits = bits
        wanted = min(max(round(log2(max(codes, 2))), 8), 32, bits)
        self.m = -(-bits // wanted)
        self.b = -(-bits // self.m)
        self.p = min(max(codes - 1, 0) // entries, (1 << self.b) - 1).bit_length()

    def segments(self, codes: list[bytes]) -> np.ndarray:
        """n x m segment values; the last segment may be filled up with zero bits."""
        flat = np.unpackbits(np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1), axis=1)[:, : self.bits]
        flat = np.pad(flat, ((0, 0), (0, self.m * self.b - self.bits))).reshape(len(codes), self.m, self.b)
        return flat.astype(np.int64) @ (1 << np.arange(self.b - 1, -1, -1, dtype=np.int64))

    @property
    def low(self) -> int:
        return self.b - self.p

    def cover(self, radius: int) -> int:
        return radius * self.m + self.m - 1


def flips(bits: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << x for x in c) for c in combinations(range(bits), radius)], np.int64)


def _place(layout: Layout):
    """A row for each segment of a code: its shard."""

    def place(batches):
        for batch in batches:
            codes = batch.column("code").to_pylist()
            prefix = layout.segments(codes) >> layout.low if codes else np.zeros((0, layout.m), np.int64)
            for s in range(layout.m):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), s, np.int32)), pa.array(prefix[:, s]), batch.column("code"), batch.column("ids")], names=["s", "prefix", "code", "ids"])

    return place


def _targets(layout: Layout, radius: int, most: int = 1 << 16):
    """Shards that can hold values at distance `radius` from a query's."""
    near = np.concatenate([flips(layout.p, i) for i in range(max(0, radius - layout.low), min(radius, layout.p) + 1)])

    def targets(batches):
        for batch in batches:
            step = max(1, most // max(len(near), 1))
            for at in range(0, batch.num_rows, step):
                part = batch.column("code").slice(at, step)
                prefix = layout.segments(part.to_pylist()) >> layout.low
                code = part.take(pa.array(np.repeat(np.arange(len(part)), len(near))))
                for s in range(layout.m):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), s, np.int32)), pa.array((prefix[:, s, None] ^ near).ravel()), code], names=["s", "prefix", "code"])

    return targets


class Shard:
    """The table of one shard: codes by their value in segment s."""

    def __init__(self, layout: Layout, s: int, prefix: int, codes: list[bytes], ids: list[list[int]]):
        self.layout, self.s, self.prefix = layout, s, prefix
        segments = layout.segments(codes)
        order = np.argsort(segments[:, s], kind="stable")
        self.segments = segments[order]
        self.value = np.ascontiguousarray(self.segments[:, s])
        self.n_ids = np.array([len(ids[i]) for i in order], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n_ids)])
        self.ids = np.array([x for i in order for x in ids[i]], np.int64)

    def _candidates(self, own: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, entry) pairs whose values are `radius` apart."""
        part = own >> self.layout.low
        rest = radius - np.bitwise_count(part ^ self.prefix).astype(np.int64)
        base = (own & ((1 << self.layout.low) - 1)) | (self.prefix << self.layout.low)
        found = []
        for r in np.unique(rest[(rest >= 0) & (rest <= self.layout.low)]):
            some = np.flatnonzero(rest == r)
            if comb(self.layout.low, int(r)) > len(self.value):  # fewer codes than values: these are compared instead of looked up
                for at in np.array_split(some, max(1, len(some) * len(self.value) >> 20)):
                    q, e = np.nonzero(np.bitwise_count(base[at][:, None] ^ self.value) == r)
                    found.append((at[q], e))
                continue
            flip = flips(self.layout.low, int(r))
            for at in np.array_split(some, max(1, len(some) * len(flip) >> 18)):
                value = (base[at][:, None] ^ flip).ravel()
                lo, n = np.searchsorted(self.value, value, "left"), np.searchsorted(self.value, value, "right")
                n -= lo
                e = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
                found.append((np.repeat(np.repeat(at, len(flip)), n), e))
        return tuple(np.concatenate([f[x] for f in found]) if found else np.zeros(0, np.int64) for x in range(2))

    def nearest(self, queries: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, distance): the k nearest ids of those that the search first meets here at this radius."""
        query, entry = self._candidates(queries[:, self.s], radius)
        each = np.bitwise_count(self.segments[entry] ^ queries[query]).astype(np.int64)
        # a code counts in the segment where it is nearest, the first of equals
        first = (each * self.layout.m + np.arange(self.layout.m)).min(axis=1, initial=1 << 40) == radius * self.layout.m + self.s
        query, entry, distance = query[first], entry[first], each[first].sum(axis=1)
        n = self.n_ids[entry]
        at = np.repeat(self.first[entry] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())) if len(n) else entry
        query, distance, ids = np.repeat(query, n), np.repeat(distance, n), self.ids[at]
        order = np.lexsort((ids, distance, query))
        query, distance, ids = query[order], distance[order], ids[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query, "left")
        best = rank < k
        return query[best], ids[best], distance[best]


def _search(layout: Layout, radius: int, k: int, chunk: int = 512):
    """Rows sorted by shard, entries before queries: builds each shard's table and streams its queries through."""

    def search(batches):
        key, codes, ids, shard = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            where = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("s", "prefix", "salt", "asks")])
            edge = np.concatenate([[0], np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
            for a, b in zip(edge[:-1], edge[1:]):
                here = tuple(where[:3, a].tolist())
                if here != key:
                    key, codes, ids, shard = here, [], [], None
                part = batch.slice(a, b - a)
                if not where[3, a]:
                    codes += part.column("code").to_pylist()
                    ids += part.column("ids").to_pylist()
                    continue
                if not codes:
                    continue
                shard = shard or Shard(layout, here[0], here[1], codes, ids)
                for at in range(0, b - a, chunk):
                    some = part.column("code").slice(at, chunk)
                    query, near, distance = shard.nearest(layout.segments(some.to_pylist()), radius, k)
                    yield pa.RecordBatch.from_arrays([some.take(pa.array(query)), pa.array(near), pa.array(distance.astype(np.int32))], schema=FOUND_ARROW)

    return search


def hamming_top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 100, entries: int = 1 << 17, bits: int | None = None) -> DataFrame:
    """For each row whose id is divisible by `every`: query_id, rank (from 1), neighbor_id, distance.

    All other rows are searched; a row isn't its own neighbour. Equal distances go by id. Rows with
    null ids or null vectors are left out; of rows that repeat an id with the same code one counts,
    and with different codes each is a row. Shorter vectors are filled with zero bits; `bits` (the
    longest vector rounded up to 8 if not given) bounds their length. Fewer than k other rows give
    fewer ranks; an empty table gives an empty result.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("vector")).where("id is not null and vector is not null")
    if bits is None:
        bits = rows.agg(F.max(F.size("vector"))).first()[0] or 1
    bits = -(-max(bits, 1) // 8) * 8
    coded = written(rows.mapInArrow(_encode(bits), "id long, code binary").distinct(), "codes")
    # a query leaves itself out, so one id more than k can be needed of a code
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    few = salted.withColumn("n", F.row_number().over(Window.partitionBy("code", "salt").orderBy("id"))).where(F.col("n") <= k + 1)
    index = written(few.groupBy("code").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids")), "index")
    layout = Layout(bits, index.count(), entries)
    placed = index.mapInArrow(_place(layout), "s int, prefix long, code binary, ids array<long>")
    shards = written(placed.groupBy("s", "prefix").agg(F.ceil(F.count("*") / entries).cast("int").alias("parts")), "shards")
    salt = F.pmod(F.xxhash64("code"), "parts").cast("int")
    placed = written(placed.join(shards, ["s", "prefix"]).select("s", "prefix", salt.alias("salt"), F.lit(0).alias("asks"), "code", "ids"), "tables")
    total = coded.count()
    asked = coded.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "code")
    active = written(asked.select("code").distinct(), "active")
    best = None
    for radius in range(layout.b + 1):
        targets = active.mapInArrow(_targets(layout, radius), "s int, prefix long, code binary").join(shards, ["s", "prefix"])
        targets = targets.select("s", "prefix", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(1).alias("asks"), "code", F.lit(None).cast("array<long>").alias("ids"))
        # only shards that are asked move
        wanted = placed.join(targets.select("s", "prefix").distinct(), ["s", "prefix"], "left_semi")
        dealt = wanted.unionByName(targets).repartition("s", "prefix", "salt").sortWithinPartitions("s", "prefix", "salt", "asks")
        found = dealt.mapInArrow(_search(layout, radius, k + 1), FOUND)
        found = found if best is None else best.unionByName(found)
        rank = F.row_number().over(Window.partitionBy("code").orderBy("distance", "neighbor_id"))
        before, best = best, written(found.withColumn("n", rank).where(F.col("n") <= k + 1).drop("n"), "best")
        discard(before)
        done = best.groupBy("code").agg(F.count("*").alias("n"), F.max("distance").alias("last"))
        done = done.where((F.col("n") >= total) | (F.col("n") > k) & (F.col("last") <= layout.cover(radius)))
        before, active = active, written(active.join(done, "code", "left_anti"), "active")
        discard(before)
        if active.isEmpty():
            break
    each = asked.join(best, "code").where(F.col("neighbor_id") != F.col("query_id"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")
