"""Document fingerprints by winnowing, in DataFrame functions only.

Every `k` consecutive words are hashed; of every `window` consecutive hashes the least is
kept, the rightmost of equals, with its position. Two texts that share window + k - 1
consecutive words therefore share a mark, and marks say where.

Hash and position travel in one long: the upper 33 bits are the hash, the lower 31 count
down with the position, so that the least long is the least hash furthest right. A text's
marks are computed in its row, by array functions; nothing is exploded or shuffled for them.

Neighbours: the keys alone (falling id, digest) are sorted over ranges, and one row a range tells
which key is before its first. A document then sends the document before it the part of its text
that the edit takes, and its marks. Texts move one and a half times; nothing about ranges is part
of the plan or passes the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.llm.storage import block_count, written

POSITIONS = (1 << 31) - 1
HASHES = ~POSITIONS


def _with_marks(df: DataFrame, text: str, out: str, k: int, window: int) -> DataFrame:
    """Adds the marks of column `text`: an empty array where the text has no words.

    Words are hashed once. The least of each window comes from minima over 1, 2, 4, ... grams, so
    its cost goes by the logarithm of the window. Each step is a column of its own, or Spark would
    repeat it for each use.
    """
    flat = F.trim(F.regexp_replace(text, r"[\x09-\x0D]+", " "))
    df = df.withColumn("_words", F.transform(F.array_remove(F.split(flat, " "), ""), lambda w: F.xxhash64(w)))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - (k - 1), F.lit(1)))
    gram = lambda i: F.xxhash64(F.slice("_words", i, k)).bitwiseAND(F.lit(HASHES)).bitwiseOR((F.lit(POSITIONS) - i).cast("long"))
    df = df.withColumn("_least", F.transform(starts, gram))
    n, span = F.greatest(F.size("_words") - (k - 1), F.lit(1)), 1
    while span < window:
        step = min(span, window - span)
        # least() passes over the nulls that fill up the shorter side
        df = df.withColumn("_least", F.zip_with("_least", F.slice("_least", 1 + step, n), lambda a, b: F.least(a, b)))
        span += step
    least = F.array_distinct(F.slice("_least", 1, F.greatest(n - (window - 1), F.lit(1))))
    return df.withColumn(out, F.when(F.size("_words") > 0, least).otherwise(F.array().cast("array<bigint>"))).drop("_words", "_least")


def mark_hash(mark: Column) -> Column:
    return mark.bitwiseAND(F.lit(HASHES))


def mark_position(mark: Column) -> Column:
    """Zero-based word that the mark's k-gram starts at."""
    return F.lit(POSITIONS) - 1 - mark.bitwiseAND(F.lit(POSITIONS))


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two arrays of hashes; two empty ones are alike."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, window: int = 16) -> DataFrame:
    """The columns of `docs` with `marks`: array<struct<hash long, position int>> by position.

    Null text is empty, an empty text has no marks; a text of fewer than k words is one gram.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumn("_text", F.coalesce(F.col(names[docs.columns.index(text_col)]).cast("string"), F.lit("")))
    rows = _with_marks(rows, "_text", "_marks", k, window)
    pairs = F.transform("_marks", lambda m: F.struct(mark_hash(m).alias("hash"), mark_position(m).cast("int").alias("position")))
    return rows.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)], pairs.alias("marks"))


def _before(places: DataFrame, key: list[str], row_bytes: int = 64) -> DataFrame:
    """Distinct keys with `before`: key and n of the place before each in their order; the last place is before the first."""
    parts = block_count(row_bytes * places.count())
    ranged = written(places.repartitionByRange(parts, *key).withColumn("part", F.spark_partition_id()), "order")
    place = F.struct(*key, "n")
    # a row a range
    ends = ranged.groupBy("part").agg(F.max(place).alias("tail"))
    every = Window.orderBy("part")
    last = F.last("tail").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = ends.select("part", F.coalesce(F.lag("tail").over(every), last).alias("tail"))
    inside = F.lag(place).over(Window.partitionBy("part").orderBy(*key))
    return ranged.withColumn("before", inside).join(ends, "part").select(*key, F.coalesce("before", "tail").alias("before"))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, window: int = 16) -> DataFrame:
    """Fingerprints of each text, of its edited text, and how like they and the next text's are.

    Documents go by falling id (null last, equal ids by the digest of the text) and the first
    follows the last. The edited text has its last floor(n/2) code points replaced by the first
    as many of the next text, or all if it has fewer. Columns: id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint (marks as numbers, by position, joined by spaces),
    near_edited, near_next. Null text is empty; two texts without words are alike (1.0). Rows that repeat an id are
    documents of their own. An empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    # keys that go up where the order goes down; every digit of the digest is taken from 15
    tie = F.translate(F.md5("text"), "0123456789abcdef", "fedcba9876543210")
    key = ["none", "down", "tie"]
    rows = rows.select(F.col("id").isNull().alias("none"), F.bitwise_not(F.coalesce("id", F.lit(0))).alias("down"), tie.alias("tie"), "text")
    before = _before(rows.select(*key, F.length("text").alias("n")).distinct(), key)
    # one exchange of texts and marks, read twice: as documents, and as those that follow one
    dealt = _with_marks(rows, "text", "marks", k, window).repartition(*key)
    take = F.expr("left(text, cast(before.n div 2 as int))")
    following = dealt.join(before.hint("merge"), key).select(*[F.col(f"before.{c}").alias(c) for c in key], take.alias("next_text"), F.col("marks").alias("next_marks"))
    # rows that repeat id and text follow each other; the last of them has the next document
    alike = Window.partitionBy(*key).orderBy(*key)
    following = following.withColumn("again", F.lag(F.lit(True)).over(alike)).where("again is null").drop("again")
    own = dealt.withColumn("again", F.lag(F.lit(True)).over(alike).isNotNull())
    pairs = own.join(following.hint("merge"), key)
    tail = F.when(F.col("again"), F.expr("left(text, cast(length(text) div 2 as int))")).otherwise(F.col("next_text"))
    edited = F.concat(F.expr("left(text, length(text) - length(text) div 2)"), tail)
    pairs = pairs.select(
        F.when(~F.col("none"), F.bitwise_not("down")).alias("id"), "text", "marks", F.when(F.col("again"), F.col("marks")).otherwise(F.col("next_marks")).alias("next_marks"), edited.alias("edited")
    )
    pairs = _with_marks(pairs, "edited", "edited_marks", k, window)
    for c in ("marks", "next_marks", "edited_marks"):
        pairs = pairs.withColumn(f"{c}_h", F.transform(c, mark_hash))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), " ")
    return pairs.select(
        "id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        joined("marks").alias("fingerprint"),
        joined("edited_marks").alias("edited_fingerprint"),
        likeness("marks_h", "edited_marks_h").alias("near_edited"),
        likeness("marks_h", "next_marks_h").alias("near_next"),
    )
