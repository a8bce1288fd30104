import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import TABLES, corpus, empty, frame, words

from tributary.llm import prob_minhash as p
from tributary.llm import textkit as K


def profile(text):
    return p.shingles(*K.text_buffer(pa.array([text], pa.string())), 5)[1:]


def definition(a, b):
    x, y = (dict(zip(h.tolist(), w.tolist())) for h, w in (a, b))
    both = set(x) | set(y)
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in both) for i in set(x) & set(y))


def classes(texts, threshold=0.8):
    """Component of each text by comparing all pairs; equal texts are one."""
    profiles, root = [profile(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or definition(profiles[i], profiles[j]) >= threshold:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def partition(labels):
    groups = {}
    for i, g in enumerate(labels):
        groups.setdefault(g, []).append(i)
    return sorted(groups.values())


def test_likeness_by_definition():
    rng = random.Random(1)
    for _ in range(40):
        vocabulary = words(rng, 6)
        a, b = (profile(" ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for _ in range(2))
        assert abs(p.probability_jaccard(a, b) - definition(a, b)) < 1e-9


def test_signatures_estimate_the_likeness():
    """Registers agree as often as the probability Jaccard says, also with uneven weights."""
    rng = np.random.default_rng(5)
    h = K.mix(np.arange(1, 61, dtype=K.U))
    x, y = rng.integers(0, 5, 60).astype(float), rng.integers(0, 5, 60).astype(float)
    a, b = (h[x > 0], x[x > 0]), (h[y > 0], y[y > 0])
    order = [np.argsort(k[0]) for k in (a, b)]
    a, b = ((k[0][o], k[1][o]) for k, o in zip((a, b), order))
    m = 1 << 14
    sig = [p.signatures(np.zeros(len(k[0]), np.int64), k[0], k[1], 1, m)[0] for k in (a, b)]
    assert abs((sig[0] == sig[1]).mean() - definition(a, b)) < 0.02


def test_a_row_does_not_depend_on_its_batch():
    texts = ["a b c d e f g", "one", "x y", "", "p q r s t u v w x y z " * 20]
    data, offs = K.text_buffer(pa.array(texts))
    whole = p.signatures(*p.shingles(data, offs, 5), len(texts), 64)
    for i, t in enumerate(texts):
        alone = p.signatures(*p.shingles(*K.text_buffer(pa.array([t])), 5), 1, 64)
        assert (whole[i] == alone[0]).all()


@pytest.mark.parametrize("block", [512, 3])
def test_classes(spark, block):
    rows = corpus()
    got = p.near_duplicates(frame(spark, rows), block=block).collect()
    assert len(got) == len(rows)
    want = {}
    for r, c in zip(rows, classes([r[1] for r in rows])):
        want.setdefault(c, []).append(r[0])
    ids = {c: min([i for i in members if i is not None], default=None) for c, members in want.items()}
    have = sorted([(r.id, r.class_id) for r in got], key=str)
    assert have == sorted([(i, ids[c]) for c, members in want.items() for i in members], key=str)


def test_family_without_its_original(spark):
    """Copies of one text, each with its own changes: unlike each other, but linked through some. A chain too."""
    rng = random.Random(8)
    base = words(rng, 400)
    texts = []
    for _ in range(60):
        t = list(base)
        for at in rng.sample(range(len(t)), rng.randint(1, 12)):
            t[at] = "".join(rng.choices("qrstuv", k=6))
        texts.append(" ".join(t))
    chain = words(rng, 120)
    for i in range(8):
        texts.append(" ".join(chain[4 * i : 4 * i + 80]))
    got = p.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert partition([r.class_id for r in sorted(got, key=lambda r: r.id)]) == partition(classes(texts))


def test_one_of_each(spark):
    rows = corpus()
    got = p.one_of_each(frame(spark, rows))
    assert got.columns == [f for f in frame(spark, rows).columns]
    want = {}
    for r, c in zip(rows, classes([r[1] for r in rows])):
        want.setdefault(c, []).append((r[0] is None, r[0]))
    assert sorted([r.doc_id for r in got.collect()], key=str) == sorted([min(m)[1] for m in want.values()], key=str)


def test_empty_table(spark):
    assert p.near_duplicates(empty(spark)).count() == 0
    assert p.one_of_each(empty(spark)).count() == 0


def test_on_the_table(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.id: r.class_id for r in p.near_duplicates(docs).collect()}
    assert partition([got[i] for i, _ in rows]) == partition(classes([t for _, t in rows]))
