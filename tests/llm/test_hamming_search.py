import random

import numpy as np
import pytest
from helpers import TABLES

from tributary.llm import hamming_search as h
from tributary.llm.queries import QUERIES, SQL

SCHEMA = "vec_id long, embedding array<float>, code string, label int"


def brute(rows, k, every=100):
    seen = sorted({(i, tuple(x is not None and x > 0 for x in v)) for i, v, *_ in rows if i is not None and v is not None})
    width = max([len(c) for _, c in seen] or [0])
    seen = [(i, c + (False,) * (width - len(c))) for i, c in seen]
    out = set()
    for i, c in seen:
        if i % every == 0:
            near = sorted((sum(a != b for a, b in zip(c, d)), j) for j, d in seen if j != i)[:k]
            out |= {(i, n + 1, j, dist) for n, (dist, j) in enumerate(near)}
    return out


@pytest.mark.parametrize("dim, k, blocks", [(64, 10, 1 << 17), (40, 3, 20), (100, 5, 64)])
def test_against_brute_force(spark, dim, k, blocks):
    rng = random.Random(dim)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(dim)], "c", 1) for i in range(400)]
    hot = rows[200][1]
    rows += [(400 + i, hot, "c", 1) for i in range(200)]  # a vector that many rows share
    rows += [(1000, hot[:-1] + [-hot[-1]], "c", 1), (1100, [], "c", 1), (1200, [None, float("nan"), 1.0], "c", 1), (None, hot, "c", 1), (1300, None, "c", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in h.hamming_top_k(df, k=k, entries=blocks).collect()}
    assert got == brute(rows, k)


def searched(layout, codes, ids, queries, k, every_shard=True):
    """Round by round over all shards, as the operator does: the answers and the last radius of each query."""
    raw = [c.tobytes() for c in codes]
    prefix = layout.segments(raw) >> layout.low
    shards = [h.Shard(layout, s, int(x), [raw[i] for i in np.flatnonzero(prefix[:, s] == x)], [ids[i] for i in np.flatnonzero(prefix[:, s] == x)]) for s in range(layout.m) for x in np.unique(prefix[:, s])]
    out = []
    for q in layout.segments([c.tobytes() for c in queries]):
        best = []
        for radius in range(layout.b + 1):
            for shard in shards:
                _, near, distance = shard.nearest(q[None], radius, k)
                best = sorted(best + list(zip(distance.tolist(), near.tolist())))[:k]
            if len(best) == k and best[-1][0] <= layout.cover(radius):
                break
        out.append((best, radius))
    return out


@pytest.mark.parametrize("entries", [1 << 17, 8])
def test_the_cover_is_proved(entries):
    """Each query ends with its exact nearest ids, on clustered and on random codes, also where shards are few codes."""
    rng = np.random.default_rng(3)
    for trial in range(20):
        size = int(rng.integers(1, 5)) * 2
        codes = rng.integers(0, 256, (int(rng.integers(1, 300)), size)).astype(np.uint8)
        if trial % 2:
            codes = codes[:3][rng.integers(0, min(3, len(codes)), len(codes))] ^ (1 << rng.integers(0, 8, codes.shape)).astype(np.uint8)
        codes = np.unique(codes, axis=0)
        ids = [list(range(10 * i, 10 * i + int(rng.integers(1, 4)))) for i in range(len(codes))]
        queries = np.concatenate([codes[:3], rng.integers(0, 256, (3, size)).astype(np.uint8)])
        k = int(rng.integers(1, 12))
        layout = h.Layout(8 * size, len(codes), entries)
        for query, (best, _) in zip(queries, searched(layout, codes, ids, queries, k)):
            every = np.bitwise_count(codes ^ query).sum(axis=1).astype(int)
            assert best == sorted((int(d), i) for d, own in zip(every, ids) for i in own)[:k]


def test_probing_answers(monkeypatch):
    """On clustered codes queries end at a small radius, by look-ups alone, and few codes are verified."""
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 256, (400, 8)).astype(np.uint8)
    codes = np.unique(np.repeat(centres, 20, axis=0) ^ (1 << rng.integers(0, 8, (8000, 8)) * (rng.random((8000, 8)) < 0.2)).astype(np.uint8), axis=0)
    layout = h.Layout(64, len(codes), 1 << 17)
    seen, probe = [], h.Shard._candidates

    def counted(self, own, radius):
        assert h.comb(layout.low, radius) <= len(self.value), "a scan"
        found = probe(self, own, radius)
        seen.append(len(found[1]))
        return found

    monkeypatch.setattr(h.Shard, "_candidates", counted)
    queries = codes[:: len(codes) // 20]
    for query, (best, radius) in zip(queries, searched(layout, codes, [[i] for i in range(len(codes))], queries, 5)):
        every = np.bitwise_count(codes ^ query).sum(axis=1).astype(int)
        assert [d for d, _ in best] == sorted(every.tolist())[:5] and radius <= 2
    assert sum(seen) < 0.5 * len(queries) * len(codes)


def test_few_rows(spark):
    one = spark.createDataFrame([(0, [1.0], "c", 1)], SCHEMA)
    assert h.hamming_top_k(one).count() == 0
    assert h.hamming_top_k(one.limit(0)).count() == 0


def test_query_against_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{TABLES}/embeddings.parquet'")
    got = sorted(tuple(r) for r in QUERIES["op6_hamming_search"](spark, TABLES).collect())
    assert got == sorted(c.execute(SQL["op6_hamming_search"]).fetchall())
