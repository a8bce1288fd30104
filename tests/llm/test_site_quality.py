import math
from collections import defaultdict

import numpy as np
from helpers import TABLES, corpus, empty, frame

from tributary.llm import site_quality as q
from tributary.llm import textkit as K

LABELS = "doc_id long, quality int"


def test_features_of_rows_do_not_mix():
    import pyarrow as pa

    texts = ["abc def\nabc def", "", None, "ONE!! TWO!!", "x | y | z", "é"]
    whole = q.features(*K.text_buffer(pa.array(texts)))
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], q.features(*K.text_buffer(pa.array([t], pa.string())))[0])


def test_fit_recovers_a_rule():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = (x @ [2, -1, 0, 0, 1] + 0.5 + rng.logistic(size=2000) > 0).astype(float)
    w, b = q.fit_logistic(x, y)
    assert np.abs(w - [2, -1, 0, 0, 1]).max() < 0.35 and abs(b - 0.5) < 0.3


def test_shrinkage(spark):
    """A large bad site speaks for itself; a site of one document stays near the rest."""
    good, bad = "these are plain words in a row and more of them. ", "JUNK!! JUNK!! %%% $$$ ### "
    rows = [(i, good * 3, "p", "fine", 1) for i in range(200)] + [(200 + i, (bad if i % 10 else good) * 3, "p", "poor", 1) for i in range(200)] + [(400, bad * 3, "p", "tiny", 1), (401, good * 3, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], int(r[1].startswith("these"))) for r in rows if r[0] % 2] + [(None, 1), (5, None), (9999, 0)], LABELS)
    got = {r.id: r for r in q.quality(docs, labels).collect()}
    assert len(got) == len(rows)
    assert got[0].host_quality > 0.95 and got[250].host_quality < 0.25
    assert got[250].host_quality < got[400].host_quality < got[0].host_quality
    assert got[0].keep and got[401].keep and not got[201].keep and not got[400].keep


def slow_features(text):
    """The statistics of one text, byte by byte."""
    data = (text or "").encode()
    out = [0.0] * q.FEATURES
    if data:
        kinds = [int(q.KIND[c]) for c in data]
        for a, b in zip(kinds, kinds[1:]):
            out[a * q.CLASSES + b] += 1 / max(len(data) - 1, 1)
        words = data.split()
        if words:
            out[-4], out[-3] = sum(min(len(w), 64) for w in words) / len(words) / 64, len(set(words)) / len(words)
        lines = data.split(b"\n")
        lines = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
        out[-2] = len(set(lines)) / len(lines)
    out[-1] = float(not data)
    return out


def slow_strength(groups, mean):
    """Documents of prior by the method of moments: groups are (documents, mean, mean of the parent)."""
    n = sum(g[0] for g in groups)
    within = mean * (1 - mean)
    spread = sum(g[0] * (g[1] - g[2]) ** 2 for g in groups) / n
    between = max(spread - within * (len(groups) - 1) / n, 1e-6 * within)
    return min(max(within / between - 1, 1.0), 1e6)


def slow_quality(rows, labels):
    """(quality, host_quality, path_quality) of (id, text, path, host) rows by loops over rows and sites."""
    x = {i: np.array(slow_features(t), np.float32).astype(float) for i, t, *_ in rows}
    known = [(i, y) for i, y in labels if i in x and y is not None]
    w, b = q.fit_logistic(np.array([x[i] for i, _ in known]), np.array([float(y) for _, y in known]))
    prior = sum(y for _, y in known) / len(known)
    base = math.log(prior / (1 - prior))
    evidence = {i: min(max(float(x[i] @ w) + b - base, -20), 20) if t else -20.0 for i, t, *_ in rows}
    good = {i: 1 / (1 + math.exp(-(e + base))) for i, e in evidence.items()}
    hosts, paths = defaultdict(list), defaultdict(list)
    for i, _, path, host in rows:
        hosts[host].append(good[i])
        paths[host, path].append(good[i])
    mean = min(max(sum(good.values()) / len(good), 1e-3), 1 - 1e-3)
    strength = slow_strength([(len(v), sum(v) / len(v), mean) for v in hosts.values()], mean)
    host_q = {h: (mean * strength + sum(v)) / (strength + len(v)) for h, v in hosts.items()}
    strength = slow_strength([(len(v), sum(v) / len(v), host_q[h]) for (h, _), v in paths.items()], mean)
    out = {}
    for i, _, path, host in rows:
        v = paths[host, path]
        own = (host_q[host] * strength + sum(v) - good[i]) / (strength + len(v) - 1)
        own = min(max(own, 1e-4), 1 - 1e-4)
        odds = math.log(own / (1 - own)) + evidence[i]
        out[i] = (1 / (1 + math.exp(-odds)), host_q[host], (host_q[host] * strength + sum(v)) / (strength + len(v)))
    return out


def test_against_the_definition(spark):
    """The whole formula by loops: sites of one and of many documents, null sites, empty texts, columns with clashing names."""
    import random

    rng = random.Random(3)
    good, bad = ["plain", "words", "in", "a", "row", "and", "more", "of", "them"], ["JUNK!!", "%%%", "$$$", "x|y", "1234", "junk"]
    rows = []
    for i in range(260):
        site = rng.choice(["a", "a", "a", "b", "c", None]) if i > 5 else f"only{i}"
        poor = rng.random() < {"a": 0.1, "b": 0.8}.get(site, 0.4)
        text = " ".join(rng.choices(bad if poor else good, k=rng.randint(3, 60))) + rng.choice(["", "\n", "\nlast line"])
        rows.append((i, text, rng.choice(["x", "y", None]), site, int(not poor)))
    rows += [(300, None, "x", "a", 0), (301, "", "x", "a", 0)]
    docs = spark.createDataFrame([(i, t, p, h, 1.0, "w") for i, t, p, h, _ in rows], "doc_id long, text string, lang string, source string, evidence double, host string")
    labels = [(r[0], r[4]) for r in rows[:160]]
    table = spark.createDataFrame([(i, y, "t", "s") for i, y in labels], "doc_id long, quality int, text string, source string")
    want = slow_quality([r[:4] for r in rows], labels)
    got = {r.id: (r.quality, r.host_quality, r.path_quality) for r in q.quality(docs, table).collect()}
    assert got.keys() == want.keys()
    assert max(abs(a - b) for i in want for a, b in zip(got[i], want[i])) < 1e-3


def test_awkward_rows(spark):
    rows = corpus()
    got = q.quality(frame(spark, rows), spark.createDataFrame([], LABELS), carry=True).collect()
    assert len(got) == len(rows)
    assert all(r.keep == bool(r.row.text) for r in got)
    assert q.quality(empty(spark), spark.createDataFrame([(1, 1)], LABELS)).count() == 0


def test_held_out_accuracy(spark):
    """Fitted on the labels of half of the documents, judged on the other half."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.id: r for r in q.quality(docs, labels.where("doc_id % 2 = 0")).collect()}
    held = [(known[i] == 1) == got[i].keep for i in known if i % 2]
    assert sum(held) / len(held) > 0.97
    assert all(0 < r.quality < 1 for r in got.values()) and TABLES
