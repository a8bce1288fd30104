import math
import random
import re
from collections import Counter

import numpy as np
from helpers import corpus, empty, frame, words

from tributary.llm import ordinal_toxicity as o
from tributary.llm import textkit as K

LABELS = "doc_id long, toxic int"


def test_ordinal_fit():
    """Weights of the sign and order that made the grades; thresholds rise."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 3))
    score = x @ [1.5, -1.0, 0.0] + rng.logistic(size=3000)
    grade = np.digitize(score, [0.0, 1.0, 2.5])
    w, theta = o.fit_ordinal(x, grade, 4)
    assert np.abs(w - [1.5, -1.0, 0.0]).max() < 0.2 and np.abs(theta - [0.0, 1.0, 2.5]).max() < 0.25


def test_graded_labels(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        n = i % 4
        text = words(rng, 80)
        for _ in range(3 * n):
            text.insert(rng.randrange(len(text)), rng.choice(["vile", "scumbag", "rotten"]))
        rows.append((i, " ".join(text)))
        labels.append((i, n))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r for r in o.toxicity(docs, spark.createDataFrame(labels, LABELS).where("doc_id < 400")).collect()}
    held = [(labels[i][1], got[i]) for i in range(400, 600)]
    assert np.mean([r.toxic == (n > 0) for n, r in held]) > 0.97
    means = [np.mean([r.severity for n, r in held if n == g]) for g in range(4)]
    assert means == sorted(means) and means[3] - means[0] > 1.5
    for r in got.values():
        assert abs(sum(r.exceed) - r.severity) < 1e-9 and list(r.exceed) == sorted(r.exceed, reverse=True)


def one_hash(word: bytes, seed: int) -> int:
    return int(K.span_hash(np.frombuffer(word + bytes(8), np.uint8), np.array([0]), np.array([len(word)]), seed)[0])


def counts(text) -> Counter:
    """Features of a text, word by word."""
    out = Counter()
    for word in re.findall(rb"[A-Za-z0-9\x80-\xff]+", (text or "").encode()):
        word = word.lower() if word.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in word)
        out[one_hash(word, 11)] += 1
        for n in (4, 5, 6):
            if len(word) > n:
                out[one_hash(word[:n], 20 + n)] += 1
    return out


def brute_choice(bags, toxic) -> list[int]:
    """The features of the sample, one by one."""
    inside, outside = sum(toxic), len(toxic) - sum(toxic)
    found = []
    for h in set().union(*bags):
        a, b = sum(t for bag, t in zip(bags, toxic) if h in bag), sum(not t for bag, t in zip(bags, toxic) if h in bag)
        if a < 3 or a / inside <= 2 * b / outside:
            continue
        expected = (a + b) * inside / (inside + outside)
        gain = 2 * (a * math.log(a / expected) + (b * math.log(b / (a + b - expected)) if b else 0))
        if gain > 10.83:
            found.append(h)
    return sorted(found)


def brute_fit(bags, grade, grades):
    chosen = brute_choice(bags, [g > 0 for g in grade])
    x = np.array([[math.log1p(bag[h]) for h in chosen] for bag in bags], np.float32)
    return chosen, *o.fit_ordinal(x, np.array(grade), grades)


def brute_toxicity(rows, labels):
    """Severity of every row by the definition: features, choice, halves, grades, thresholds."""
    bags = {i: counts(t) for i, t in rows}
    ids = [i for i, _ in labels]
    sample, grade = [bags[i] for i in ids], [g for _, g in labels]
    if max(grade) == 1:
        halves = {i: h for i, h in HALVES(ids)}
        score = {}
        for half in (0, 1):
            other = [n for n, i in enumerate(ids) if halves[i] != half]
            chosen, w, _ = brute_fit([sample[n] for n in other], [grade[n] for n in other], 2)
            score |= {i: sum(a * math.log1p(bags[i][h]) for h, a in zip(chosen, w)) for i in ids if halves[i] == half}
        cuts = np.quantile([score[i] for i, g in labels if g], [1 / 3, 2 / 3])
        grade = [g and 1 + int(np.searchsorted(cuts, score[i], "right")) for i, g in labels]
    chosen, w, theta = brute_fit(sample, grade, 4)
    return {i: sum(1 / (1 + math.exp(t - sum(a * math.log1p(bag[h]) for h, a in zip(chosen, w)))) for t in theta) for i, bag in bags.items()}


def HALVES(ids):
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    df = SparkSession.getActiveSession().createDataFrame([(i,) for i in ids], "i long")
    return [tuple(r) for r in df.select("i", F.pmod(F.xxhash64("i", F.lit("half")), F.lit(2)).cast("int")).collect()]


def test_against_the_definition(spark):
    """Whole texts, labels 0 and 1 and graded ones, extra columns with names that clash."""
    rng = random.Random(12)
    bad = ["vile", "scumbag", "Rotten", "écrase", "worthless"]
    vocabulary = words(rng, 60)
    rows = []
    for i in range(160):
        text = rng.choices(vocabulary, k=rng.randint(0, 60)) + rng.choices(bad, k=rng.randint(1, 6)) * (i % 4 == 0)
        rng.shuffle(text)
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(text)))
    rows += [(160, None), (161, ""), (162, "!!! ..."), (163, "vile " * 3000)]
    docs = spark.createDataFrame([(i, t, "g", 1) for i, t in rows], "doc_id long, text string, grade string, half int")
    for grade in (lambda i: int(i % 4 == 0), lambda i: 1 + i % 3 if i % 4 == 0 else 0):
        labels = [(i, grade(i)) for i in range(120)]
        frame_of = spark.createDataFrame([(i, g, "x", 7) for i, g in labels], "doc_id long, toxic int, text string, half int")
        want = brute_toxicity(rows, labels)
        got = {r.id: r.severity for r in o.toxicity(docs, frame_of).collect()}
        assert got.keys() == want.keys()
        assert max(abs(got[i] - want[i]) for i in want) < 0.02, sorted((got[i], want[i]) for i in want)[:5]


def test_awkward_rows(spark):
    rows = corpus()
    got = o.toxicity(frame(spark, rows), spark.createDataFrame([(1, 1), (None, 1), (2, None), (777, 0)], LABELS)).collect()
    assert len(got) == len(rows) and not any(r.toxic for r in got)
    assert o.toxicity(empty(spark), spark.createDataFrame([], LABELS)).count() == 0


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.toxic for r in labels.where("doc_id % 2 = 1").collect()}
    got = {r.id: r.toxic for r in o.toxicity(docs, labels.where("doc_id % 2 = 0")).collect()}
    caught = [got[i] for i, t in known.items() if t]
    left = [not got[i] for i, t in known.items() if not t]
    # some documents were made junk after they were labelled: their words are gone
    assert sum(caught) / len(caught) > 0.92 and sum(left) / len(left) > 0.99
