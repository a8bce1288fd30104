import hashlib

import pytest
from helpers import TABLES, corpus, empty, frame

from tributary.llm import substring_dedup as s
from tributary.llm.queries import QUERIES

LAST = float("inf")


def brute(rows, size=50):
    """Multiset of (id, words, removed, sha) by looking at every window."""
    first = {}
    split = [(LAST if r[0] is None else r[0], r[0], (r[1] or "").encode().split()) for r in rows]
    for order, _, w in split:
        for i in range(len(w) - size + 1):
            k = b" ".join(w[i : i + size])
            first[k] = min(first.get(k, LAST), order)
    out = []
    for order, i, w in split:
        gone = [False] * len(w)
        for at in range(len(w) - size + 1):
            if first[b" ".join(w[at : at + size])] < order:
                gone[at : at + size] = [True] * size
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [50, 7])
def test_against_brute_force(spark, size):
    rows = corpus()
    got = s.substring_dedup(frame(spark, rows), size=size).collect()
    assert sorted([(r.c_doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == brute(rows, size)
    for r in got:
        if not r.n_removed:
            assert r.removed_spans == []
        else:
            assert sum(x.words for x in r.removed_spans) == r.n_removed
            assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
    assert {r.c__block for r in got} == {"b"} and {r.c_key for r in got} == {"k"}


def test_unchanged_texts_stay_as_they_are(spark):
    rows = corpus()
    texts = {(r[0], r[1]) for r in rows}
    got = s.substring_dedup(frame(spark, rows)).where("n_removed = 0").collect()
    assert got and all((r.c_doc_id, r.kept_text) in texts for r in got)


def test_empty_table(spark):
    assert s.substring_dedup(empty(spark)).count() == 0


def test_estimates_are_never_below_counts(spark, monkeypatch):
    """A sketch of a few cells sends nearly all windows on; the result stays the same."""
    rows = corpus()
    monkeypatch.setattr(s, "text_bytes", lambda *a: 1)
    got = s.substring_dedup(frame(spark, rows), with_text=False).collect()
    assert sorted([(r.c_doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == brute(rows)


def test_query_on_the_table(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op1_substring_dedup"](spark, TABLES).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == brute([(r.doc_id, r.text) for r in docs])
