"""Near-duplicate classes by ProbMinHash over weighted word shingles.

A shingle is `k` consecutive words (all words of a shorter text), its weight the
number of times it occurs. Likeness is the probability Jaccard of the two weight
vectors, which is plain Jaccard where weights are equal.

1. Signature: each shingle is a Poisson process whose rate is its weight. Arrivals
   fall on random registers, and a register keeps the shingle that arrived first.
   A shingle stops once its next arrival is later than every register of the
   document, so most shingles draw once. Two signatures agree in a register with
   exactly the probability Jaccard.
2. Banding: `band` registers hash to a bucket. Texts that share a bucket and whose signatures
   promise a likeness near the threshold or above are verified exactly on their whole texts,
   in the first bucket that they share. A task holds many buckets, finds the pairs in memory,
   and verifies the likest first: a pair that links found before it have joined is left out,
   so it gives fewer links than it has texts.
3. A bucket of more than `block` texts is not one task's. First all its texts are compared with
   a few hubs, chosen from the whole bucket, in a few rounds: that joins most of a large family
   in rows linear in its size. What is left are texts outside the component that holds most of
   the bucket; these are compared with all others in blocks, majority rows going to the blocks
   of minority rows and not to each other's.
4. Classes are the connected components of verified pairs.

Rounds and blocks set what the comparison costs, never what it finds. Equal texts share one key
from the start and cost one group-by row each. Texts, signatures and links stay distributed; the
driver sees counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.llm import textkit as K
from tributary.llm.storage import block_count, discard, written

#: A pair is promising if its estimate is at most so many standard deviations below the threshold.
SLACK = 4.0
#: Text bytes that count as one text when buckets are cut into blocks.
UNIT = 16 << 10
#: Hubs of a bucket in one round, and rounds.
HUBS, ROUNDS = 8, 2
ROW = "g long, side int, here long, r long, key binary, size int, registers binary, bands array<long>"


def text_key(text_col: str) -> Column:
    """128 bits that stand for a whole text; null is the empty text."""
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")))


def shingles(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, weight) for the distinct shingles of each row, by row and hash."""
    starts, ends, row = K.words(data, offs)
    word = K.span_hash(data, starts, ends, 5)
    inside = K.whole(row, k)
    h = K.window_hash(word, k, 0x9E3779B97F4A7C15)[inside]
    at = row[: len(inside)][inside]
    count = np.bincount(row, minlength=len(offs) - 1)
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        edge = np.concatenate([[0], np.cumsum(count)])
        short = np.zeros(len(few), K.U)
        for j in range(k - 1):
            has = count[few] > j
            short[has] = K.mix(short[has] * K.U(0xD6E8FEB86659FD93) + word[edge[few[has]] + j] + K.U(1))
        h, at = np.concatenate([h, short]), np.concatenate([at, few])
    order = np.lexsort((h, at))
    h, at = h[order], at[order]
    first = np.r_[True, (h[1:] != h[:-1]) | (at[1:] != at[:-1])] if len(h) else np.zeros(0, bool)
    begin = np.flatnonzero(first)
    return at[begin], h[begin], np.diff(np.r_[begin, len(h)]).astype(np.float64)


def signatures(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m registers: the hash of the shingle that arrived first (0 for rows without shingles)."""
    earliest = np.full(n * m, np.inf)
    holder = np.zeros(n * m, K.U)
    latest = np.full(n, np.inf)
    time = np.zeros(len(h))
    turn = 0
    while len(h):
        turn += 1
        draw = K.mix(h + K.U(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        time = time - np.log(((draw >> K.U(11)).astype(np.float64) + 1) * 2.0**-53) / weight
        place = row * m + (K.mix(draw) % K.U(m)).astype(np.int64)
        live = time < latest[row]
        row, h, weight, time, place = row[live], h[live], weight[live], time[live], place[live]
        np.minimum.at(earliest, place, time)
        won = time == earliest[place]
        holder[place[won]] = h[won]
        touched = np.unique(row)
        latest[touched] = earliest.reshape(n, m)[touched].max(axis=1)
        live = time < latest[row]
        row, h, weight, time = row[live], h[live], weight[live], time[live]
    return holder.reshape(n, m)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact likeness of two (sorted distinct hashes, weights): sum over shared i of 1 / sum_j max(x_j/x_i, y_j/y_i)."""
    shared, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    x, y = a[1][ia], b[1][ib]
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    only_x, only_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    # elements of larger x/y than i's count by x, the others by y
    below = np.concatenate([[0.0], np.cumsum(y)])[np.searchsorted(ratio, ratio, "left")]
    above = x.sum() - np.concatenate([[0.0], np.cumsum(x)])[np.searchsorted(ratio, ratio, "left")]
    return float((1.0 / ((above + only_x) / x + (below + only_y) / y)).sum())


def _sign(k: int, m: int, bands_of: int, band: int):
    def sign(batches):
        for batch in batches:
            for part in K.parts(batch, "text"):
                n = part.num_rows
                data, offs = K.text_buffer(part.column("text"))
                row, h, weight = shingles(data, offs, k)
                sig = signatures(row, h, weight, n, m)
                has = np.bincount(row, minlength=n) > 0
                four = (sig & K.U(15)).astype(np.uint8)  # four bits of a register are enough to compare
                bands = np.empty((n, bands_of), np.int64)
                for b in range(bands_of):
                    v = np.full(n, b + 1, K.U)
                    for j in range(band):
                        v = K.mix(v * K.U(0xD6E8FEB86659FD93) + sig[:, b * band + j])
                    bands[:, b] = v.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        part.column("key"),
                        pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * bands_of, pa.array(bands.ravel()), mask=pa.array(~has)),
                        pa.array([x.tobytes() for x in four[:, ::2] << 4 | four[:, 1::2]], pa.binary()),
                        pa.array(np.diff(offs).astype(np.int32)),
                    ],
                    names=["id", "key", "bands", "registers", "size"],
                )

    return sign


class _Rows:
    """Rows of many groups as arrays, group after group."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        g = np.asarray(table["g"])
        order = np.argsort(g, kind="stable")
        self.table = table = table.take(pa.array(order))
        self.g, self.side, self.here, self.r = (np.asarray(table[c]) for c in ("g", "side", "here", "r"))
        n = table.num_rows
        packed = np.frombuffer(b"".join(table["registers"].to_pylist()), np.uint8).reshape(n, -1)
        self.registers = np.concatenate([packed >> 4, packed & 15], axis=1)
        self.bands = np.asarray(table["bands"].combine_chunks().flatten()).reshape(n, -1)

    def promising(self, least: float, most: int = 1 << 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, estimate) of pairs in one group but different components whose estimate is at least `least`.

        Rows of side 2 meet all others, rows of sides 0 and 1 each other; without sides 0 and 1 of hubs
        (here is null there, so 0) a pair counts in the first bucket that both rows share.
        """
        n = len(self.g)
        edge = np.flatnonzero(np.r_[True, self.g[1:] != self.g[:-1]]) if n else np.zeros(0, np.int64)
        end = np.repeat(np.r_[edge[1:], n], np.diff(np.r_[edge, n])) if n else edge
        found = []
        live, step = np.arange(n), 1
        live = live[live + 1 < end]
        while len(live):
            ok = (self.r[live] != self.r[live + step]) & ((self.side[live] == 2) | (self.side[live] != self.side[live + step]))
            some = live[ok]
            for at in range(0, len(some), most):
                i = some[at : at + most]
                j = i + step
                first = (self.bands[i] == self.bands[j]).argmax(axis=1)
                mine = (self.here[i] == 0) | (self.bands[i, first] == self.here[i])
                i, j = i[mine], j[mine]
                agree = (self.registers[i] == self.registers[j]).mean(axis=1)
                like = (agree - 1 / 16) / (1 - 1 / 16)  # four bits agree by chance once in 16
                good = like >= least
                found.append((i[good], j[good], like[good]))
            step += 1
            live = live[live + step < end[live]]
        return tuple(np.concatenate([f[x] for f in found]) if found else np.zeros(0, [np.int64, np.int64, float][x]) for x in range(3))


def _active(least: float):
    """The rows that have a promising partner in their group."""

    def active(table):
        rows = _Rows(table)
        i, j, _ = rows.promising(least)
        used = np.zeros(len(rows.g), bool)
        used[i] = used[j] = True
        return rows.table.filter(pa.array(used)).drop_columns(["shard"])

    return active


def _links(k: int, threshold: float, least: float):
    """Verified links that join components, likest pairs first."""

    def links(table):
        rows = _Rows(table)
        i, j, like = rows.promising(least)
        keys = rows.table["key"].to_pylist()
        where: dict[bytes, int] = {}
        for n, key in enumerate(keys):
            where.setdefault(key, n)
        row, h, weight = shingles(*K.text_buffer(rows.table["text"].take(pa.array(list(where.values())))), k)
        edge = np.searchsorted(row, np.arange(len(where) + 1))
        place = {key: n for n, key in enumerate(where)}
        profile = lambda x: (h[edge[x] : edge[x + 1]], weight[edge[x] : edge[x + 1]])
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        found, told = [], set()
        for n in np.argsort(-like, kind="stable"):
            a, b = top(int(rows.r[i[n]])), top(int(rows.r[j[n]]))
            pair = (keys[i[n]], keys[j[n]])
            if a == b or pair in told:
                continue
            told.add(pair)
            if probability_jaccard(profile(place[pair[0]]), profile(place[pair[1]])) >= threshold:
                parent[a] = b
                found.append(pair)
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    return links


def components(links: DataFrame) -> DataFrame:
    """(key, root) of every key in `links` (a, b); root is the smallest key of its component.

    Every key takes the root that its smallest neighbour takes, then links are contracted to roots
    and repeated ones dropped, until none is left: a round works on what the round before has left,
    so all of them together are linear in the links. Each is written, so plans stay short.
    """
    edges = written(_apart(links), "edges")
    label = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy(F.col("a").alias("key")).agg(F.least(F.first("a"), F.min("b")).alias("up")), "low")
        up = low.select(F.col("key").alias("up"), F.col("up").alias("root"))
        step = written(low.join(up, "up").select("key", "root"), "step")
        one, two = (step.select(F.col("key").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab")
        before = label
        if label is None:
            label = step
        else:
            moved = label.join(one.hint("merge"), label.root == one.a, "left")
            label = written(moved.select("key", F.coalesce("a_root", "root").alias("root")), "label")
        contracted = edges.join(one, "a").join(two, "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
        # a root that has itself moved on stays linked to where it went
        beyond = step.select("root").distinct().join(two, F.col("root") == F.col("b")).select(F.col("root").alias("a"), F.col("b_root").alias("b"))
        left = written(_apart(contracted.union(beyond)), "edges")
        discard(edges, low, before if before is not step else None, step if label is not step else None)
        if left.isEmpty():
            discard(left)
            return label
        edges = left


def _apart(links: DataFrame) -> DataFrame:
    return links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


class _Join:
    """The links between texts of different components that share a bucket."""

    def __init__(self, texts: DataFrame, signed: DataFrame, buckets: DataFrame, k: int, threshold: float, m: int, block: int):
        self.texts, self.signed, self.buckets, self.k, self.threshold, self.block = texts, signed, buckets, k, threshold, block
        self.least = threshold - SLACK * float(np.sqrt(threshold * (1 - threshold) / m))

    def verified(self, rows: DataFrame) -> DataFrame:
        """Links (a, b) within the groups of `rows` (columns of ROW), dealt to tasks by group and by bytes."""
        names = [c.split()[0] for c in ROW.replace("array<long>", "").split(", ")]
        rows_of, rows = rows, rows.select(*names)
        shards = block_count(600 * rows.count())
        shard = lambda n: F.pmod("g", F.lit(n)).cast("int").alias("shard")
        active = written(rows.select(shard(shards), *names).groupBy("shard").applyInArrow(_active(self.least), ROW), "active")
        shards = block_count(active.agg(F.sum("size")).first()[0] or 0)
        full = active.join(self.texts.hint("merge"), "key").select(shard(shards), *names, "text")
        links = written(full.groupBy("shard").applyInArrow(_links(self.k, self.threshold, self.least), "a binary, b binary"), "links")
        discard(rows_of, active)
        return links

    def placed(self, label: DataFrame | None, over: int = 0) -> DataFrame:
        """Rows of buckets of more weight than `over` that hold several components, with the component r and its share `own`.

        Components are joined to texts before these are dealt to their buckets.
        """
        texts = self.buckets.select("key", "weight", F.filter("at", lambda x: x["total"] > over).alias("at")).where(F.size("at") > 0)
        if label is None:
            texts = texts.withColumn("root", F.col("key"))
        else:
            texts = texts.join(label.hint("merge"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        placed = texts.select(F.explode("at.h").alias("h"), "key", "weight", F.xxhash64("root").alias("r"))
        parts = placed.groupBy("h", "r").agg(F.sum("weight").alias("own"))
        mixed = parts.groupBy("h").agg(F.sum("own").alias("all"), F.max(F.struct("own", "r")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
        mixed = mixed.select("h", "all", F.col("most.own").alias("most"), F.col("most.r").alias("major"))
        return placed.join(mixed, "h")

    def by_hubs(self, label: DataFrame | None, turn: int) -> DataFrame | None:
        """Links of all texts in large buckets to hubs of theirs; none where no large bucket holds several components."""
        placed = written(self.placed(label, self.block).join(self.signed, "key"), "crowd")
        if placed.isEmpty():
            return None
        parts = F.ceil(F.col("all") / self.block).cast("int")
        chance = Window.partitionBy("h").orderBy(F.xxhash64("key", F.lit(turn)), "key")
        hubs = placed.select("h", "key").withColumn("n", F.row_number().over(chance)).where(F.col("n") <= HUBS).drop("n")
        columns = ["h", "r", "key", "size", "registers", "bands"]
        hubs = placed.join(hubs, ["h", "key"], "left_semi").select(*columns, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("side"))
        members = placed.select(*columns, F.pmod(F.xxhash64("key"), parts).cast("int").alias("part"), F.lit(1).alias("side"))
        both = hubs.unionByName(members).withColumn("g", F.xxhash64("h", "part")).withColumn("here", F.lit(0).cast("long"))
        return self.verified(written(both, "hubs"))

    def by_blocks(self, label: DataFrame | None) -> DataFrame:
        """All links that are left: small buckets whole, large ones in blocks of the majority and the rest."""
        placed = self.placed(label)
        block = F.lit(self.block)
        majors, minors = F.ceil(F.col("most") / block).cast("int"), F.ceil((F.col("all") - F.col("most")) / block).cast("int")
        kind = lambda n, p, q, side: F.struct(F.lit(n).alias("kind"), p.cast("int").alias("p"), q.cast("int").alias("q"), side.cast("int").alias("side"))
        p, q = F.pmod(F.xxhash64("key"), majors), F.pmod(F.xxhash64("key"), minors)
        to = lambda n: F.sequence(F.lit(0), n - 1)
        zero = F.lit(0)
        among = F.transform(to(minors), lambda x: kind(1, F.least(q.cast("int"), x), F.greatest(q.cast("int"), x), F.when(q == x, 2).when(q < x, 0).otherwise(1)))
        groups = (
            F.when(F.col("all") <= block, F.array(kind(2, zero, zero, F.lit(2))))
            .when(F.col("r") == F.col("major"), F.transform(to(minors), lambda x: kind(0, p, x, F.lit(0))))
            .otherwise(F.concat(F.transform(to(majors), lambda x: kind(0, x, q, F.lit(1))), among))
        )
        rows = placed.select("h", "key", "r", F.explode(groups).alias("at")).join(self.signed, "key")
        rows = rows.select(F.xxhash64("h", "at.kind", "at.p", "at.q").alias("g"), "at.side", F.col("h").alias("here"), "r", "key", "size", "registers", "bands")
        return self.verified(written(rows, "crowd"))


def _joined(links: DataFrame, label: DataFrame | None) -> DataFrame:
    """Components of the links and of those found before, of which a link from each key to its root is left."""
    return components(links if label is None else links.union(label.select(F.col("key").alias("a"), F.col("root").alias("b"))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, m: int = 512, bands: int = 32, band: int = 4, block: int = 512) -> DataFrame:
    """One row per row of `docs`: id, key (of its text), class_id, class_key.

    class_id is the smallest id in the class (null only if all its ids are null), class_key the
    smallest key. Equal texts, empty and null ones included, are one class; a text without words
    is like no other text. Rows that repeat an id are placed by their texts. An empty table gives
    an empty result; other columns of `docs` are not read.

    With 32 bands of 4 registers a pair of likeness 0.8 shares no bucket with probability 5e-8;
    512 registers of 4 bits estimate it to 0.02, and a pair that is promised four times that less
    than the threshold is not verified.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_key(text_col).alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    every = written(rows.mapInArrow(_sign(k, m, bands, band), "id long, key binary, bands array<long>, registers binary, size int"), "signed")
    first = F.first(F.struct("bands", "registers", "size"))
    signed = written(every.where("bands is not null").groupBy("key").agg(first.alias("s")).select("key", "s.bands", "s.registers", "s.size"), "texts")
    weight = F.ceil(F.col("size") / UNIT).cast("long")
    exploded = signed.select("key", weight.alias("weight"), F.explode("bands").alias("h"))
    # a bucket of one text has one hash; the hash is a long, so that this is summed before it moves
    shared = exploded.groupBy("h").agg(F.min(F.xxhash64("key")).alias("lo"), F.max(F.xxhash64("key")).alias("hi"), F.sum("weight").alias("total")).where("lo < hi").select("h", "total")
    shared = exploded.join(shared.hint("shuffle_hash"), "h")
    # a text with its buckets, of which there are `bands` at most
    buckets = written(shared.groupBy("key").agg(F.first("weight").alias("weight"), F.collect_list(F.struct("h", "total")).alias("at")), "buckets")
    several = buckets.select("key")
    # copies are one row of each task before they move; the same join at every size, as a broadcast would only help small inputs
    texts = rows.groupBy("key").agg(F.first("text").alias("text")).join(several.hint("merge"), "key", "left_semi")
    join = _Join(written(texts, "texts"), signed, buckets, k, threshold, m, block)
    label = None
    for turn in range(ROUNDS):
        found = join.by_hubs(label, turn)
        if found is None:
            break
        label = _joined(found, label)
    label = _joined(join.by_blocks(label), label)
    ids = every.groupBy("key").agg(F.min("id").alias("id"))
    lowest = label.join(ids, "key").groupBy("root").agg(F.min("id").alias("class_id"))
    # written, so that the join with a class of many texts can be split
    linked = label.join(written(lowest, "lowest").hint("merge"), "root")
    # a row a text, written for the same reason: a text may have many copies
    classes = ids.join(linked.hint("merge"), "key", "left").select("key", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("root", "key").alias("class_key"))
    return every.select("id", "key").join(written(classes, "classes").hint("merge"), "key").select("id", "key", "class_id", "class_key")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` less near-duplicates: of each class the row with the smallest id stays.

    A null id counts as larger than any other; of several texts with that id the one
    with the smallest key stays, of rows equal in id and text the first in any order.
    """
    classes = near_duplicates(docs, id_col, text_col, **options)
    head = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("key"))
    kept = written(classes.groupBy("class_key").agg(F.min(head).alias("head")).select(F.col("head.id").alias("kept_id"), F.col("head.key").alias("kept_key")), "kept")
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumn("_key", text_key(names[docs.columns.index(text_col)]))
    same = (F.col("_key") == F.col("kept_key")) & F.col(names[docs.columns.index(id_col)]).cast("long").eqNullSafe(F.col("kept_id"))
    rows = rows.join(kept, same, "left_semi")
    once = rows.groupBy("_key", names[docs.columns.index(id_col)]).agg(F.first(F.struct(*names)).alias("row"))
    return once.select(*[F.col(f"row.{n}").alias(c) for n, c in zip(names, docs.columns)])
