"""Each stage against a brute-force version on the stage's own input, and on awkward tables."""

import random
from collections import Counter, defaultdict

import corpus_pipeline as c
import public_tokenizers
from helpers import SCHEMA, TABLES, corpus, words
from pyspark.sql import types as T
from test_best_fit_packing import check as check_packing
from test_prob_minhash import classes
from test_site_quality import slow_quality

from tributary.llm.storage import table, written

COLUMNS = T.StructType(SCHEMA.fields[:5])
LABELS = "doc_id long, quality int, toxic int"


def folder(spark, path, rows, labels, schema=COLUMNS):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return str(path)


def case(seed=5):
    """Good and junk documents, copies, near copies and shared passages, in three sources of which one is hot."""
    rng = random.Random(seed)
    base = [words(rng, rng.randint(70, 160)) for _ in range(40)]
    passage = words(rng, 60)
    texts = [(" ".join(b), 1) for b in base]
    texts += [(" ".join(b[: len(b) // 2] + ["changed"] + b[len(b) // 2 + 1 :]), 1) for b in base[:8]] + [(" ".join(base[0]), 1)] * 3
    texts += [(" ".join(words(rng, 20) + passage + words(rng, 30)), 1) for _ in range(6)]
    texts += [("$$$ !!! ||| 000 " * rng.randint(5, 30), 0) for _ in range(20)]
    texts += [(None, 0), ("", 0)]
    rng.shuffle(texts)
    rows = [(i, t, "en", ["hot", "hot", "a", None][i % 4], len(t or "")) for i, (t, _) in enumerate(texts)]
    return rows, [(i, q, 0) for i, (_, q) in enumerate(texts) if i % 2]


def cut_words(rows, size=50):
    """Texts less the words of windows that start in a document with a smaller id."""
    first = {}
    for i, t in sorted(rows):
        w = (t or "").split()
        for at in range(len(w) - size + 1):
            first.setdefault(tuple(w[at : at + size]), i)
    out = {}
    for i, t in rows:
        w = (t or "").split()
        gone = [False] * len(w)
        for at in range(len(w) - size + 1):
            if first[tuple(w[at : at + size])] < i:
                gone[at : at + size] = [True] * size
        out[i] = " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else t
    return out


def test_stages_by_brute_force(spark, tmp_path):
    rows, labels = case()
    path = folder(spark, tmp_path / "in", rows, labels)
    docs = table(spark, path, "documents")

    good = written(c.keep_good(spark, docs, path), "stage")
    scores = slow_quality([(i, t, lang, source) for i, t, lang, source, _ in rows], [(i, q) for i, q, _ in labels])
    clear = {i: s[0] >= 0.5 for i, s in scores.items() if abs(s[0] - 0.5) > 1e-3}
    kept = {r.doc_id for r in good.collect()}
    assert all((i in kept) == keep for i, keep in clear.items()) and len(clear) == len(rows) and 0 < len(kept) < len(rows)

    left = sorted((r.doc_id, r.text) for r in good.collect())
    once = written(c.drop_near_duplicates(spark, good, path), "stage")
    groups = defaultdict(list)
    for (i, _), g in zip(left, classes([t for _, t in left])):
        groups[g].append(i)
    assert sorted(r.doc_id for r in once.collect()) == sorted(min(g) for g in groups.values())

    left = [(r.doc_id, r.text) for r in once.collect()]
    cut = written(c.cut_repeats(spark, once, path), "stage")
    assert {r.doc_id: r.text for r in cut.collect()} == cut_words(left)
    assert all(r.n_chars == len(r.text or "") for r in cut.collect())

    have = {r.doc_id: r for r in cut.collect()}
    mixed = written(c.mix(spark, cut, path), "stage")
    uses = Counter(r.doc_id for r in mixed.collect())
    size = {i: len((r.text or "").split()) for i, r in have.items()}
    by_source = defaultdict(list)
    for i, r in have.items():
        by_source[r.source].append(i)
    names = sorted([s for s in by_source if s is not None]) + [s for s in by_source if s is None]
    weight = {s: (1, 2, 3)[n % 3] for n, s in enumerate(names)}
    words_of = {s: sum(size[i] for i in by_source[s]) for s in names}
    target, full = {}, set()
    while True:  # the excess of sources at their cap goes to the others by weight
        rest, free = sum(size.values()) - sum(3 * words_of[s] for s in full), [s for s in names if s not in full]
        target = {s: 3 * words_of[s] if s in full else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 3 * words_of[s]}
        if not over:
            break
        full |= over
    longest = max(size.values())
    for s in names:
        assert abs(sum(uses[i] * size[i] for i in by_source[s]) - target[s]) <= longest, s
    assert max(uses.values()) <= 3 and all(tuple(r) == tuple(have[r.doc_id]) for r in mixed.collect())

    from tokenizers import Tokenizer

    texts = [(r.doc_id, r.text) for r in mixed.collect()]
    packed = c.pack_sequences(spark, mixed, path).collect()
    used = check_packing(packed, texts, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    assert used <= -(-sum(r.length for r in packed) // 4096) * 1.02 + 1


def test_awkward_tables(spark, tmp_path):
    """Empty tables, null and repeated rows, columns that operators use inside, no labels."""
    more = T.StructType([*SCHEMA.fields, T.StructField("row", T.StringType()), T.StructField("a.b", T.StringType())])
    rows = [(*r, "x", "y") for r in corpus()]
    for name, some, labels in (("full", rows, [(0, 1, 0), (21, 0, 0), (None, 1, 0), (3, None, None)]), ("unlabelled", rows, []), ("empty", [], []), ("null", [(None,) * 10] * 3, [(1, 1, 1)])):
        path = folder(spark, tmp_path / name, some, labels, more)
        docs = table(spark, path, "documents")
        for stage, step in c.STAGES[:-1]:
            docs = written(step(spark, docs, path), "stage")
            assert docs.columns == more.names, (name, stage)
            got = docs.collect()
            assert len(got) <= 3 * len(some) and all((r["row"], r["a.b"]) == ("x", "y") for r in got) or name == "null", (name, stage)
        assert c.STAGES[-1][1](spark, docs, path).count() >= docs.count()


def test_stages(spark):
    docs = table(spark, TABLES, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in c.STAGES[:-1]:
        docs = written(stage(spark, docs, TABLES), "stage")
        assert docs.columns == columns and docs.dtypes == table(spark, TABLES, "documents").dtypes, name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3]
    packed = c.STAGES[-1][1](spark, docs, TABLES)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert packed.where("piece = 0").count() == docs.count()


def test_good_documents_stay(spark):
    docs, labels = table(spark, TABLES, "documents"), table(spark, TABLES, "labels")
    kept = {r.doc_id for r in c.keep_good(spark, docs, TABLES).collect()}
    known = labels.collect()
    assert all(r.doc_id in kept for r in known if r.quality == 1)
    assert sum(r.doc_id not in kept for r in known if r.quality == 0) >= 0.9 * sum(r.quality == 0 for r in known)


def test_run(spark):
    got = c.run(spark, TABLES)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got.columns)
    assert got.count() > 0
