"""Toxicity by cumulative-link ordinal regression.

P(grade > j) is the logistic of w.x - theta_j: one weight vector for all thresholds,
and thresholds that rise. Features are sparse: hashed words and word beginnings of a text,
each with the logarithm of its count. The fit sees a bounded sample of labelled documents
and keeps the features that tell its classes apart; scoring is a map over whole texts.
Severity is the expected grade, the sum of P(grade > j).

Labels may be grades. Where they are 0 and 1 only, the sample is halved, a model with one threshold
is fitted to each half, and documents labelled 1 get grades by thirds of the score that the model
of the other half gives them: how far beyond doubt they are to a model that never saw them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm import textkit as K
from tributary.llm.storage import written

#: Word characters are ASCII letters and digits and all bytes of other letters.
BETWEEN = np.array([not (chr(i).isalnum() or i >= 128) if i < 128 else False for i in range(256)])
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
BEGINNINGS = (4, 5, 6)
GRADES = 4


def sparse_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature hash) for each word and each beginning of 4 to 6 bytes, with repeats."""
    data = LOWER[data]
    starts, ends, row = K.words(data, offs, BETWEEN)
    hashes, rows = [K.span_hash(data, starts, ends, 11)], [row]
    for n in BEGINNINGS:
        long = np.flatnonzero(ends - starts > n)
        hashes.append(K.span_hash(data, starts[long], starts[long] + n, 20 + n))
        rows.append(row[long])
    return np.concatenate(rows), np.concatenate(hashes)


def _sample_features(batches):
    for batch in batches:
        for part in K.parts(batch, "text"):
            row, h = sparse_features(*K.text_buffer(part.column("text")))
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])]) if len(row) else np.zeros(0, np.int64)
            edge = np.searchsorted(row[first], np.arange(part.num_rows + 1)).astype(np.int32)
            count = np.diff(np.r_[first, len(row)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("grade"), part.column("half"), pa.ListArray.from_arrays(edge, pa.array(h[first].view(np.int64))), pa.ListArray.from_arrays(edge, pa.array(count))], names=["grade", "half", "features", "counts"])


class OrdinalModel:
    """Selected feature hashes (sorted), their weights, and rising thresholds."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.hashes, self.weights, self.thresholds = hashes, weights, thresholds

    def exceed(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """n x (grades - 1): P(grade > j) of each row."""
        n = len(offs) - 1
        score = np.zeros(n)
        if len(self.hashes):
            row, h = sparse_features(data, offs)
            place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[place] == h
            pair, count = np.unique(row[hit] * len(self.hashes) + place[hit], return_counts=True)
            np.add.at(score, pair // len(self.hashes), self.weights[pair % len(self.hashes)] * np.log1p(count))
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -30, 30)))


def choose(sample: DataFrame, toxic: int, rest: int, least: int = 3, most: int = 1500) -> np.ndarray:
    """The features most associated with toxic rows, by likelihood ratio: at most `most`, sorted.

    Counts are grouped where the sample is; the driver gets the chosen hashes only.
    """
    each = sample.select((F.col("grade") > 0).cast("int").alias("toxic"), F.explode("features").alias("h"))
    each = each.groupBy("h").agg(F.sum("toxic").alias("inside"), F.count("*").alias("n")).where(F.col("inside") >= least)
    outside, expected = F.col("n") - F.col("inside"), F.col("n") * toxic / (toxic + rest)
    gain = 2 * (F.col("inside") * F.log(F.col("inside") / expected) + F.when(outside > 0, outside * F.log(outside / (F.col("n") - expected))).otherwise(0))
    found = each.withColumn("gain", gain).where((F.col("inside") / toxic > 2 * outside / rest) & (F.col("gain") > 10.83))
    rows = found.orderBy(F.desc("gain"), "h").limit(most).select("h").collect()
    return np.sort(np.array([r["h"] for r in rows], np.int64).view(K.U))


def _hits(batch: pa.RecordBatch, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in `hashes`, count) of the features that are among `hashes`."""
    h = np.asarray(batch.column("features").flatten()).view(K.U)
    row = np.repeat(np.arange(batch.num_rows), np.asarray(pc.fill_null(pc.list_value_length(batch.column("features")), 0)))
    if not len(hashes):
        return row[:0], row[:0], row[:0]
    place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    hit = hashes[place] == h
    return row[hit], place[hit], np.asarray(batch.column("counts").flatten())[hit]


def _restrict(hashes: np.ndarray, judges: list[OrdinalModel]):
    """The chosen features of sampled rows, as places in `hashes`, and the score by the judge of the row's half, if any."""

    def restrict(batches):
        for batch in batches:
            score, half = np.zeros(batch.num_rows), np.asarray(batch.column("half"))
            for j, judge in enumerate(judges):
                row, place, count = _hits(batch, judge.hashes)
                own = half[row] == j
                np.add.at(score, row[own], judge.weights[place[own]] * np.log1p(count[own]))
            row, place, count = _hits(batch, hashes)
            edge = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("grade"), pa.ListArray.from_arrays(edge, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(edge, pa.array(count.astype(np.int32))), pa.array(score)],
                names=["grade", "places", "counts", "score"],
            )

    return restrict


class Sparse:
    """A matrix of n rows and d columns as (row, column, value) of what isn't 0."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int, d: int):
        self.row, self.column, self.value, self.shape = row, column, value, (n, d)

    @classmethod
    def of(cls, x: np.ndarray) -> Sparse:
        row, column = np.nonzero(x)
        return cls(row, column, x[row, column].astype(np.float64), *x.shape)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.shape[0])

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * g[self.row], self.shape[1])


def fit_ordinal(x: np.ndarray | Sparse, grade: np.ndarray, grades: int, l2: float = 0.05, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the penalised likelihood by accelerated gradient steps.

    Thresholds are a first one and positive gaps, so they stay ordered.
    """
    x = x if isinstance(x, Sparse) else Sparse.of(x)
    n, d = x.shape
    share = np.array([np.mean(grade > j) for j in range(grades - 1)]).clip(1e-3, 1 - 1e-3)
    theta = np.maximum.accumulate(-np.log(share / (1 - share)) + np.arange(grades - 1) * 1e-3)
    z = np.concatenate([np.zeros(d), [theta[0]], np.log(np.maximum(np.diff(theta), 1e-2))])
    moment, second = np.zeros_like(z), np.zeros_like(z)
    for step in range(1, rounds + 1):
        w, gaps = z[:d], np.exp(z[d + 1 :])
        theta = z[d] + np.concatenate([[0], np.cumsum(gaps)])
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        s = x.times(w)
        upper, lower = 1 / (1 + np.exp(-np.clip(edge[grade + 1] - s, -500, 500))), 1 / (1 + np.exp(-np.clip(edge[grade] - s, -500, 500)))
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        grad_s = (du - dl) / n
        grad_theta = np.array([(dl[grade == j + 1].sum() - du[grade == j].sum()) / n for j in range(grades - 1)])
        grad = np.concatenate([x.transposed_times(grad_s) + l2 * w / n, [grad_theta.sum()], gaps * (grad_theta[::-1].cumsum()[::-1][1:])])
        moment, second = 0.9 * moment + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        z -= 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return z[:d], z[d] + np.concatenate([[0], np.cumsum(np.exp(z[d + 1 :]))])


def fit(sample: DataFrame, grades: int) -> OrdinalModel:
    """Fits on rows of (grade, half, distinct feature hashes, counts); labels 0 and 1 become grades as the module's text says."""
    n = sample.agg(F.count("*").alias("n"), F.count(F.when(F.col("grade") > 0, 1)).alias("toxic"), F.max("grade").alias("top")).first()
    hashes = choose(sample, n["toxic"], n["n"] - n["toxic"]) if n["toxic"] and n["toxic"] < n["n"] else np.zeros(0, K.U)
    if not len(hashes):
        return OrdinalModel(hashes, np.zeros(0), np.arange(grades - 1) + 4.0)
    graded = n["top"] > 1 or grades == 2
    judges = [] if graded else [fit(sample.where(F.col("half") != half), 2) for half in (0, 1)]
    data = sample.mapInArrow(_restrict(hashes, judges), "grade int, places array<int>, counts array<int>, score double").toPandas()
    grade = np.clip(data["grade"].to_numpy(np.int64), 0, grades - 1)
    row = np.repeat(np.arange(len(data)), [len(p) for p in data["places"]])
    flat = lambda name: np.concatenate([np.asarray(v, np.int64) for v in data[name]])
    x = Sparse(row, flat("places"), np.log1p(flat("counts")), len(data), len(hashes))
    if not graded:
        score, toxic = data["score"].to_numpy(), grade > 0
        cuts = np.quantile(score[toxic], np.arange(1, grades - 1) / (grades - 1))
        grade = np.where(toxic, 1 + np.searchsorted(cuts, score, "right"), 0)
    return OrdinalModel(hashes, *fit_ordinal(x, grade, grades))


def _score(model: OrdinalModel, names: list[str]):
    def score(batches):
        for batch in batches:
            for part in K.parts(batch, "text"):
                exceed = model.exceed(*K.text_buffer(part.column("text")))
                flat = pa.ListArray.from_arrays(np.arange(len(exceed) + 1, dtype=np.int32) * exceed.shape[1], pa.array(exceed.ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], flat, pa.array(exceed.sum(axis=1))], names=[*names, "exceed", "severity"])

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", grades: int = GRADES, sample: int = 8192, threshold: float = 0.4) -> DataFrame:
    """One row per document: id, severity (expected grade), grade, exceed (P(grade > j)), toxic.

    `toxic` is P(grade > 0) >= threshold. `sample` bounds the labelled documents that the fit sees:
    those with the smallest hashed ids, of whose features it keeps 1500 at most. Labels above 1 are grades as they are. Labels that are null,
    have a null id or no document are not used; without both kinds nothing is toxic. Null and empty
    texts have no features. Rows that repeat an id are scored one by one. An empty table gives an
    empty result; other columns are not read.
    """
    col = lambda name: F.col(f"`{name}`")
    known = labels.select(col(id_col).cast("long").alias("label_id"), col(label_col).cast("int").alias("grade")).where("label_id is not null and grade is not null")
    known = known.orderBy(F.xxhash64("label_id"), "label_id", "grade").limit(sample)  # bounded: 12 bytes a row
    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    seen = rows.join(F.broadcast(known), F.col("id") == F.col("label_id"))
    seen = seen.select("grade", F.pmod(F.xxhash64("label_id", F.lit("half")), F.lit(2)).cast("int").alias("half"), "text")
    model = fit(written(seen.mapInArrow(_sample_features, "grade int, half int, features array<long>, counts array<int>"), "sample"), grades)
    scored = rows.mapInArrow(_score(model, ["id"]), "id long, exceed array<double>, severity double")
    return scored.select("id", "severity", F.round("severity").cast("int").alias("grade"), "exceed", (F.get("exceed", F.lit(0)) >= threshold).alias("toxic"))
