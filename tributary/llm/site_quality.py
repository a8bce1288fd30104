"""Quality by hierarchical empirical Bayes: document evidence under host and path posteriors.

`documents` has no URLs: there the source stands for the host and the language for the path.

1. A logistic model over byte-class statistics (how often one class of byte follows
   another, repeated words and lines) is fitted to a bounded sample of labelled documents.
   Its log odds less those of the sample's base rate are the evidence of a document: what
   its text says, whatever the prior.
2. Sites: hosts, and paths within hosts, are summed up by grouped aggregation: documents
   and expected good documents. The spread of host means about the global mean gives, by
   the method of moments, how many documents' worth of prior a host gets; likewise paths
   about their hosts. A site's posterior mean is (prior * strength + good) / (strength + n),
   so a site with few documents stays near its parent and a large one speaks for itself.
3. A document's odds are its path's prior odds, without its own share, times its evidence.

Only the fit (at most `sample` rows of 260 numbers) and the global moments (a few numbers)
reach the driver. Scoring is a map over whole texts, sites are partial aggregates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm import textkit as K
from tributary.llm.storage import written

CLASSES = 16
KIND = np.full(256, 15, np.int64)
KIND[128:] = 1
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!", "?", "|", "$%&#*^~=+", "'\"`", "()[]{}<>", "-_/\\@")):
    for _c in _chars:
        KIND[ord(_c)] = _k
FEATURES = CLASSES * CLASSES + 4


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """n x FEATURES: shares of byte-class pairs, mean word length, shares of distinct words and lines, empty."""
    n, size = len(offs) - 1, int(offs[-1])
    out = np.zeros((n, FEATURES), np.float32)
    if size:
        kind = KIND[data[:size]]
        row = np.repeat(np.arange(n), np.diff(offs))
        pair = kind[:-1] * CLASSES + kind[1:]
        same = row[:-1] == row[1:]
        count = np.bincount((row[:-1] * (CLASSES * CLASSES) + pair)[same], minlength=n * CLASSES * CLASSES).reshape(n, -1)
        out[:, : CLASSES * CLASSES] = count / np.maximum(np.diff(offs) - 1, 1)[:, None]
        starts, ends, at = K.words(data, offs)
        words = np.bincount(at, minlength=n)
        out[:, -4] = np.bincount(at, weights=np.minimum(ends - starts, 64), minlength=n) / np.maximum(words, 1) / 64
        out[:, -3] = _distinct(K.span_hash(data, starts, ends, 3), at, n, words)
        line = np.flatnonzero(data[:size] == 10)
        edges = np.union1d(np.r_[0, line + 1], offs[:-1][np.diff(offs) > 0])
        edges = edges[edges < size]
        stops = np.r_[edges[1:], size]
        of = np.searchsorted(offs, edges, "right") - 1
        out[:, -2] = _distinct(K.span_hash(data, edges, stops, 4), of, n, np.bincount(of, minlength=n))
    out[:, -1] = np.diff(offs) == 0
    return out


def _distinct(h: np.ndarray, row: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])] if len(h) else np.zeros(0, bool)
    return np.bincount(row[first], minlength=n) / np.maximum(total, 1)


def _featured(batches):
    for batch in batches:
        for part in K.parts(batch, "text"):
            x = features(*K.text_buffer(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * FEATURES, pa.array(x.ravel()))], names=["label", "x"])


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, rounds: int = 30) -> tuple[np.ndarray, float]:
    """(weights, bias) by Newton's method with ridge on standardised columns."""
    mean, sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.c_[(x - mean) / sd, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    ridge = np.r_[np.full(z.shape[1] - 1, l2 * len(x) / 100), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * w
        step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(ridge), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1] / sd, float(w[-1] - (w[:-1] / sd) @ mean)


def _score(weights: np.ndarray, bias: float, empty: float):
    def score(batches):
        for batch in batches:
            for part in K.parts(batch, "text"):
                x = features(*K.text_buffer(part.column("text")))
                evidence = np.where(x[:, -1] > 0, empty, x @ weights + bias)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in part.schema.names if c != "text"], pa.array(np.clip(evidence, -20, 20))], names=[*[c for c in part.schema.names if c != "text"], "evidence"])

    return score


def _strength(n, s, q, mean: float) -> float:
    """Prior documents of a site from moments over sites: their number, sum of n, and spread of means."""
    if not n or q is None or not 0 < mean < 1:
        return 10.0
    within = mean * (1 - mean)
    between = max(q - within * (n - 1) / max(s, 1), 1e-6 * within)
    return float(min(max(within / between - 1, 1.0), 1e6))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", sample: int = 8192, threshold: float = 0.5, carry: bool = False) -> DataFrame:
    """One row per document: id, evidence, host_quality, path_quality, quality, keep.

    `sample` bounds the labelled documents that the fit sees: those with the smallest hashed
    ids. Labels of documents that don't exist, null labels and null ids are not used; of labels
    that repeat an id, each counts. Without labels of both kinds the evidence is 0 and every
    document with text is kept. Null text is empty; an empty document has the evidence -20 and
    is rejected. Null hosts and paths are sites like others. Rows that repeat an id are scored
    one by one. An empty table gives an empty result. With `carry`, all columns of `docs` come
    along in the struct `row`.
    """
    col = lambda name: F.col(f"`{name}`")
    known = labels.select(col(id_col).cast("long").alias("label_id"), col(label_col).cast("int").alias("label")).where("label_id is not null and label is not null")
    known = known.orderBy(F.xxhash64("label_id"), "label_id", "label").limit(sample)  # bounded: 12 bytes a row
    seen = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text")).join(F.broadcast(known), F.col("id") == F.col("label_id"))
    fitted = seen.select("label", "text").mapInArrow(_featured, "label int, x array<float>").toPandas()
    y = fitted["label"].to_numpy(np.float64)
    weights, bias, base = np.zeros(FEATURES), 0.0, 0.0
    told = 0 < y.sum() < len(y)
    if told:
        weights, bias = fit_logistic(np.stack(fitted["x"].to_numpy()).astype(np.float64), y)
        base = float(np.log(y.mean() / (1 - y.mean())))
    else:
        y = np.full(2, 0.5)
    site = lambda name: F.coalesce(F.concat(F.lit("0"), col(name).cast("string")), F.lit("1"))
    rows = docs.select(col(id_col).alias("id"), site(host_col).alias("host"), site(path_col).alias("path"), col(text_col).cast("string").alias("text"), *([F.struct(*[col(c) for c in docs.columns]).alias("row")] if carry else []))
    schema = T.StructType([f for f in rows.schema if f.name != "text"] + [T.StructField("evidence", T.DoubleType())])
    scored = rows.mapInArrow(_score(weights, bias - base, -20.0), schema)
    scored = written(scored, "evidence")
    prior = float(y.mean())
    scored = scored.withColumn("good", 1 / (1 + F.exp(-(F.col("evidence") + float(np.log(prior / (1 - prior)))))))
    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    g = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("good")).first()
    mean = (g["good"] or 0.0) / g["n"] if g["n"] else prior
    mean = min(max(mean, 1e-3), 1 - 1e-3)
    m = hosts.agg(F.count("*").alias("k"), F.sum("host_n").alias("n"), (F.sum(F.col("host_n") * (F.col("host_good") / F.col("host_n") - mean) ** 2) / F.sum("host_n")).alias("q")).first()
    host_strength = _strength(m["k"], m["n"], m["q"], mean)
    hosts = hosts.withColumn("host_quality", (mean * host_strength + F.col("host_good")) / (host_strength + F.col("host_n")))
    both = paths.join(hosts, "host")
    m = both.agg(F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * (F.col("good") / F.col("n") - F.col("host_quality")) ** 2) / F.sum("n")).alias("q")).first()
    path_strength = _strength(m["k"], m["n"], m["q"], mean)
    both = both.select("host", "path", "host_quality", F.col("n").alias("path_n"), F.col("good").alias("path_good"))
    # a row a site, written so that the documents of a large one can be dealt to several tasks
    out = scored.join(written(both, "sites"), ["host", "path"])
    without = (F.col("host_quality") * path_strength + F.col("path_good") - F.col("good")) / (path_strength + F.col("path_n") - 1)
    without = F.least(F.greatest(without, F.lit(1e-4)), F.lit(1 - 1e-4))
    odds = F.log(without / (1 - without)) + F.col("evidence")
    out = out.withColumn("path_quality", (F.col("host_quality") * path_strength + F.col("path_good")) / (path_strength + F.col("path_n"))).withColumn("quality", 1 / (1 + F.exp(-odds)))
    return out.select("id", "evidence", "host_quality", "path_quality", "quality", (F.col("quality") >= threshold if told else F.col("evidence") > -20).alias("keep"), *(["row"] if carry else []))

