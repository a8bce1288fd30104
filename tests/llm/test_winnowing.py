import hashlib
import random
import re

from helpers import TABLES, corpus, empty, frame, words

from tributary.llm import winnowing as w
from tributary.llm.queries import QUERIES


def pieces(text):
    return [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]


def edited_of(rows):
    """(id, text) in falling order with the edited text, nulls last, ties by falling digest."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()), reverse=True)
    for n, (i, t) in enumerate(order):
        following = order[(n + 1) % len(order)][1]
        yield i, t, t[: len(t) - len(t) // 2] + following[: len(t) // 2]


def check(spark, docs, rows):
    got = w.compare_edited(docs).collect()
    assert sorted([(r.id, r.n_chars, r.edited_sha256) for r in got], key=str) == sorted([(i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e in edited_of(rows)], key=str)
    prints = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints.setdefault(r.id, set()).add(r.fingerprint)
    return got


def test_edited_texts(spark):
    rows = corpus()
    got = check(spark, frame(spark, rows), [(r[0], r[1] or "") for r in rows])
    same = {r.id: r.fingerprint for r in got}
    assert same[0] == same[12] == same[13] != same[1]


def test_marks_by_brute_force(spark):
    """Gram hashes from Spark itself; the choice of marks by looking at every window."""
    from pyspark.sql import functions as F

    k, size = 3, 4
    rng = random.Random(5)
    texts = [" ".join(words(rng, n)) for n in (0, 1, 2, 3, 5, 6, 7, 40)] + ["a b a b a b a b a b a b", "x " * 30, None, " \n lead  and\ttrail \x0c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(m.hash, m.position) for m in r.marks] for r in w.fingerprints(docs, k=k, window=size).collect()}
    for i, text in enumerate(texts):
        tokens = pieces(text)
        grams = [tokens[j : j + k] for j in range(max(1, len(tokens) - k + 1))] if tokens else []
        if grams:
            hashes = [r[0] & w.HASHES for r in spark.createDataFrame([(g,) for g in grams], "g array<string>").coalesce(1).select(F.xxhash64(F.transform("g", lambda x: F.xxhash64(x)))).collect()]
        want = []
        for at in range(max(1, len(grams) - size + 1)) if grams else []:
            window = list(enumerate(hashes))[at : at + size]
            best = min(window, key=lambda x: (x[1], -x[0]))
            if (best[1], best[0]) not in want:
                want.append((best[1], best[0]))
        assert got[i] == want, (i, text)


def test_match_guarantee(spark):
    """Texts that share window + k - 1 words share a mark."""
    rng = random.Random(9)
    shared = words(rng, 5 + 16 - 1)
    texts = [" ".join(words(rng, rng.randint(0, 60)) + shared + words(rng, rng.randint(0, 60))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = [{m.hash for m in r.marks} for r in w.fingerprints(docs).collect()]
    assert all(a & b for a in marks for b in marks)


def test_likeness(spark):
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j"), (3, "totally other words here now and then some more"), (4, ""), (5, None)]
    got = {r.id: r for r in w.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2].near_next == 1.0 and got[3].near_next == 0.0 and got[5].near_next == 1.0
    assert got[1].fingerprint == got[2].fingerprint and got[4].fingerprint == ""


def test_one_row_and_none(spark):
    one = w.compare_edited(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert w.compare_edited(empty(spark)).count() == 0


def test_query_on_the_table(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    check(spark, docs, rows)
    plan = QUERIES["op3_winnowing"](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
