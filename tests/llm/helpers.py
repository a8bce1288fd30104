"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import types as T

TABLES = "/root/testdata/sf0.001"
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use inside
        T.StructField("key", T.StringType()),
        T.StructField("_block", T.StringType()),
        T.StructField("id", T.LongType()),
    ]
)


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(n)]


def corpus(seed: int = 1) -> list[tuple]:
    """Copies, near copies, shared passages, nulls, empties, one long text, repeated ids and rows."""
    rng = random.Random(seed)
    base = [words(rng, rng.randint(60, 200)) for _ in range(12)]
    passage = words(rng, 70)
    texts: list[str | None] = [" ".join(b) for b in base]
    texts += [texts[0], texts[0], texts[1]]
    for b in base[:6]:
        near = list(b)
        near[rng.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    for b in base[6:10]:
        at = rng.randrange(len(b))
        texts.append(" \n".join(b[:at] + passage + b[at:]))
    texts += [None, "", "   \t\n", "one", "one two", "é à  日本 x", "a" * 3000, " ".join(["same"] * 300), "\x0bnbsp\xa0is no space\x1f", " ".join(words(rng, 6000))]
    rows = [(i, t, "en" if i % 3 else None, ["s1", "s2", None, "s10"][i % 4], len(t or ""), "k", "b", i) for i, t in enumerate(texts)]
    rows += [(None, texts[2], "en", "s1", 1, "k", "b", 1), (3, texts[4], "en", "s1", 1, "k", "b", 1), rows[5], rows[5]]
    return rows


def frame(spark, rows, parts: int = 3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(rows, key: str = "doc_id") -> dict:
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out
