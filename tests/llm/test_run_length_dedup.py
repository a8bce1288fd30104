import hashlib
import random

import numpy as np
import pytest
from helpers import TABLES, corpus, empty, frame

from tributary.llm import run_length_dedup as r
from tributary.llm.queries import QUERIES


def brute(rows, size=400):
    seen = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        for at in range(len(b) - size + 1):
            k = b[at : at + size]
            seen[k] = seen.get(k, 0) + 1
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for at in range(len(b) - size + 1):
            if seen[b[at : at + size]] > 1:
                gone[at : at + size] = True
        gone = gone[: len(b)]
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df, name="c_doc_id"):
    return sorted([(x[name], x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in df.collect()], key=str)


@pytest.mark.parametrize("size, k, most", [(400, 32, 2048), (60, 8, 2048), (60, 60, 2048), (60, 8, 1)])
def test_against_brute_force(spark, size, k, most):
    """most=1 sends every anchor with several snippets through the exact string groups."""
    rows = corpus()
    got = r.run_length_dedup(frame(spark, rows), size=size, k=k, most=most)
    assert rows_of(got) == brute([(x[0], x[1]) for x in rows], size)
    for x in got.collect():
        assert hashlib.sha256(bytes(x.kept)).hexdigest() == x.kept_sha256 and x.c_key == "k"


def test_long_rows_are_cut_with_overlap(spark, monkeypatch):
    rng = random.Random(3)
    piece = "".join(rng.choices("abcd \n", k=5000))
    rows = [(1, piece * 3 + "x" + piece[:777]), (2, "y" * 900 + piece[100:900])]
    monkeypatch.setattr(r._pieces, "__defaults__", (500,))
    got = r.run_length_dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_bytes=False)
    monkeypatch.undo()
    assert rows_of(got) == brute(rows)


def test_index_by_definition():
    rng = random.Random(1)
    for _ in range(200):
        text = []
        base = [rng.choices([1, 2, 3], k=rng.randint(0, 30)) for _ in range(3)]
        for _ in range(rng.randint(0, 6)):
            t = list(rng.choice(base))
            if t and rng.random() < 0.6:
                t[rng.randrange(len(t))] = rng.choice([1, 2, 3])
            text += [*t, 0]
        symbols = np.array(text, np.uint16)
        assert r.suffix_order(symbols).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        index = r.RunLengthIndex(symbols)

        def common(i, j):
            n = 0
            while max(i, j) + n < len(text) and text[i + n] == text[j + n]:
                n += 1
            return n

        want = [max([common(i, j) for j in range(len(text)) if j != i] or [0]) for i in range(len(text))]
        assert index.matching_statistics().tolist() == want


def test_runs_are_few_in_repetitive_text():
    base = np.array(random.Random(2).choices(range(1, 27), k=500), np.uint16)
    text = np.concatenate([np.r_[base, 0] for _ in range(50)]).astype(np.uint16)
    assert len(r.RunLengthIndex(text).run_start) < len(text) / 20


def test_sliding_min():
    rng = np.random.default_rng(1)
    for n, w in ((1, 1), (5, 5), (17, 4), (100, 7)):
        v = rng.integers(0, 50, n).astype(np.uint64)
        assert r.sliding_min(v, w).tolist() == [v[i : i + w].min() for i in range(n - w + 1)]


def test_empty_table(spark):
    assert r.run_length_dedup(empty(spark)).count() == 0


def test_query_on_the_table(spark):
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{TABLES}/documents.parquet").collect()]
    assert rows_of(QUERIES["op9_run_length_dedup"](spark, TABLES), "doc_id") == brute(docs)
