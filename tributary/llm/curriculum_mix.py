"""Mixing sources to target weights along a curriculum, in DataFrame functions only.

Targets: every source has a weight and shares the words of all sources by weight; a
target stops at `repeats` times the source's own words and the excess is shared
again. With sources by rising cap/weight, the level of the first `i` capped sources is
(total - their caps) / (weights of the rest), and the common level is the largest of
these, so one cumulative window over the source table solves it.

Curriculum: a source's weight over training time is a piecewise-linear schedule. Its
integral, scaled to the source's target, is the cumulative demand for words. Documents
of a source lie one after another on that axis in hashed order, pass after pass, and
the inverse of the cumulative demand (a root of a quadratic in its piece) is the
training position of each pass over a document. Documents are range-sorted by position.

Prefix sums are taken in two levels: inside (source, slot), where a slot is a range of
the hash, and over the slots' sums. The number of slots follows the rows, so a source with
a third of all rows is many even groups at any size; it changes no result, as documents lie
in the order of the hash either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one slot at most, on average, and the least number of slots.
SLOT_ROWS, LEAST_SLOTS = 1 << 18, 1 << 10
#: Rate of use over training time for the weights in turn: early, even, late. Only the shape counts.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))


def _inverse(share: Column, knots) -> Column:
    """The time by which a `share` of the schedule's integral is used."""
    pieces, used = [], 0.0
    for (t0, r0), (t1, r1) in zip(knots, knots[1:]):
        area = (r0 + r1) / 2 * (t1 - t0)
        pieces.append((t0, t1, r0, r1, used, area))
        used += area
    out = None
    for t0, t1, r0, r1, before, area in reversed(pieces):
        y = F.greatest(share * used - F.lit(before), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(r0 * r0) + y * (2 * (r1 - r0) / (t1 - t0)), F.lit(0.0)))
        at = F.least(F.lit(t0) + F.when(y > 0, y * 2 / (root + r0)).otherwise(0.0), F.lit(t1))
        out = at if out is None else F.when(share * used <= before + area, at).otherwise(out)
    return out


def _targets(sums: DataFrame, weights, repeats: int) -> DataFrame:
    """(key, source_size, target, turn) from the words of each (key, slot)."""
    s = sums.groupBy("key").agg(F.sum("words").alias("source_size"))
    everything = Window.partitionBy()
    s = s.withColumn("turn", F.pmod(F.row_number().over(Window.orderBy("key")) - 1, F.lit(len(weights))).cast("int"))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("turn") + 1))
    s = s.withColumn("cap", (F.col("source_size") * repeats).cast("double"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    before = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(everything) - before) / rest)
    s = s.withColumn("level", F.max("level").over(everything))
    return s.select("key", "source_size", "turn", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def plan_mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1, 2, 3), repeats: int = 3, schedules=SCHEDULES, seed: int = 7, carry: bool = False) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, taken_by_pass, positions.

    Sources go by code point of their name, null last, and take `weights` and `schedules` in
    turn. `taken` counts words, repeats included, and adds up per source to its target rounded
    to a whole word; `positions` has the training position in [0, 1] of each pass that is
    used. Null text has no words; a document without words takes none. Null ids and rows that
    repeat an id are documents like others. A single source gets a target of all its words. An
    empty table gives an empty result. With `carry`, all columns of `docs` come along in the
    struct `row`.
    """
    col = lambda name: F.col(f"`{name}`")
    hashed = F.xxhash64(col(id_col).cast("string"), F.lit(seed))
    slot_bits = (max(LEAST_SLOTS, docs.count() // SLOT_ROWS) - 1).bit_length()
    rows = docs.select(
        col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("0"), col(source_col).cast("string")), F.lit("1")).alias("key"),
        F.coalesce(F.regexp_count(col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        hashed.alias("h"),
        F.shiftrightunsigned(hashed, 64 - slot_bits).cast("int").alias("slot"),
        *([F.struct(*[col(c) for c in docs.columns]).alias("row")] if carry else []),
    )
    placed = rows.repartition("key", "slot")
    sums = placed.groupBy("key", "slot").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = sums.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("words")
    slots = slots.join(_targets(sums, weights, repeats), "key")
    inside = Window.partitionBy("key", "slot").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    full = local.join(slots, ["key", "slot"]).withColumn("start", F.col("start") + F.col("ahead"))
    goal = F.least(F.round("target").cast("long"), F.col("source_size") * repeats)
    begins = [F.col("start") + F.col("source_size") * e for e in range(repeats)]
    takes = [F.greatest(F.least(goal - b, F.col("size")), F.lit(0).cast("long")) for b in begins]
    share = [F.least(b / F.greatest(goal, F.lit(1)), F.lit(1.0)) for b in begins]

    def position(x: Column) -> Column:
        out = _inverse(x, schedules[0])
        for i, knots in enumerate(schedules[1:], 1):
            out = F.when(F.pmod("turn", F.lit(len(schedules))) == i, _inverse(x, knots)).otherwise(out)
        return out

    total = takes[0]
    for t in takes[1:]:
        total = total + t
    return full.select(
        "id", "size", "source_size", "target", total.alias("taken"),
        F.array(*takes).alias("taken_by_pass"),
        F.filter(F.array(*[F.when(t > 0, position(x)) for t, x in zip(takes, share)]), lambda p: p.isNotNull()).alias("positions"),
        *(["row", (begins[0] <= goal).alias("reached"), position(share[0]).alias("place")] if carry else []),
    )


def by_position(plan: DataFrame) -> DataFrame:
    """The planned documents, range-sorted by the position of their first use; unused ones last."""
    return plan.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "id")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The training stream: a row of `docs` for each pass over a document, range-sorted by position.

    A pass is given whole if at least half of its words are taken, so a source is off its target
    by half a document at most. Documents without words come once, if their place is within the
    first pass that their source uses. Columns are those of `docs`.
    """
    plan = plan_mixture(docs, id_col, text_col, source_col, carry=True, **options)
    uses = plan.withColumn("use", F.explode(F.transform("taken_by_pass", lambda t, i: F.struct(t.alias("words"), i.alias("pass")))))
    uses = uses.where(((F.col("use.words") > 0) & (F.col("use.words") * 2 >= F.col("size"))) | ((F.col("size") == 0) & (F.col("use.pass") == 0) & F.col("reached")))
    at = F.coalesce(F.get("positions", F.col("use.pass")), F.col("place"))
    ordered = uses.select("row", at.alias("at"), "id").orderBy("at", "id")
    return ordered.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
