import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import TABLES, corpus, empty, frame

from tributary.llm import best_fit_packing as b
from tributary.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def check(rows, texts, tokenizer, capacity=4096):
    want = Counter()
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            own = np.array(ids[start : start + capacity], "<u4").tobytes()
            want[i, piece, start, len(own) // 4, zlib.crc32(own)] += 1
    assert Counter((r[0], r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_pack(spark, tokenizer):
    rows = corpus()
    got = b.pack(frame(spark, rows), PATH).collect()
    check(got, [(r[0], r[1]) for r in rows], tokenizer)


@pytest.mark.parametrize("capacity", [7, 64])
def test_small_sequences(spark, tokenizer, capacity):
    rows = [(i, "ab " * random.Random(i).randint(0, 30)) for i in range(300)]
    got = b.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH, capacity=capacity).collect()
    check(got, rows, tokenizer, capacity)


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_best_fit_decreasing(seed):
    """As many sequences as best fit over single pieces, by falling length."""
    rng = random.Random(seed)
    capacity = rng.choice([10, 50, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 400))]
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    entries = b.plan(dict(Counter(lengths)), capacity)
    fill, ranks = Counter(), Counter()
    for length, rank, number, first, place in entries:
        assert rank == ranks[length]
        ranks[length] += number
        for s in range(first, first + number):
            assert fill[s] == place
            fill[s] += length
    assert ranks == Counter(lengths) and len(fill) == len(rooms) and max(fill.values()) <= capacity


def test_plan_size_does_not_follow_counts():
    few = {n: 3 for n in range(1, 4097, 7)}
    assert len(b.plan({n: c * 1_000_000 for n, c in few.items()}, 4096)) < 100_000


def test_encoder(tokenizer):
    encode = b.Encoder(PATH, remembered=50)
    assert encode.by_chunk
    texts = ["it's DON'T I'll 'sabc x's", "ΑΣ ΣΑΣ İstanbul ǅ ﬁ", "a\x1cb", "a\x00b \x7f", "a\xa0b c\x85d", "<|endoftext|> x", "é ́x 1234 a1b2 __ _a!? ½", "", "日本語 テスト。", "a​b", "A b, c. D! " * 40, "ABC, <|ENDOFTEXT|>. <|endoftext|>. É. E\u0301, e\u0301A? a.. ?! x's. don't; K\u0301! \u212a."]
    for some in (texts, texts[::-1], texts[:1]):
        assert encoded(encode, some) == whole(tokenizer, some)


def whole(tokenizer, texts):
    return [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def encoded(encode, texts):
    flat, edge = encode(pa.array(texts, pa.string()))
    return [flat[a:b].tolist() for a, b in zip(edge[:-1], edge[1:])]


def test_encoder_over_all_code_points(tokenizer):
    """Each code point within, before and after letters, next to white space, a digit and a sign."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    encode = b.Encoder(PATH)
    for at in range(0, len(points), 1 << 15):
        texts = [" ".join(f"a{c}B {c} \t{c}e 1{c}.{c}" for c in points[i : i + 64]) for i in range(at, min(at + (1 << 15), len(points)), 64)]
        assert encoded(encode, texts) == whole(tokenizer, texts)


def test_encoder_over_control_characters_and_random_texts(tokenizer):
    rng = random.Random(6)
    some = [chr(c) for c in [*range(0x80), 0x85, 0xA0, 0x300, 0x301, 0x327, 0x1100, 0x1161, 0x11A8, 0x2000, 0x2001, 0x2028, 0x3000, 0xC5, 0x130, 0x3A3, 0xFB01, 0xD7, 0xF7, 0xDF, 0xE9, 0xC9, 0xFF]]
    texts = ["".join(rng.choices(some, k=rng.randint(0, 60))) for _ in range(3000)]
    assert encoded(b.Encoder(PATH, remembered=300), texts) == whole(tokenizer, texts)


def test_other_vocabularies_take_texts_whole():
    other = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    texts = ["a  b\n c", "", " x\x00"]
    encode = b.Encoder(other)
    assert not encode.by_chunk and encoded(encode, texts) == whole(Tokenizer.from_file(other), texts)


def test_empty_table(spark):
    assert b.pack(empty(spark), PATH).count() == 0


def test_query_on_the_table(spark, tokenizer):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()]
    got = QUERIES["op4_best_fit_packing"](spark, TABLES).collect()
    assert check(got, texts, tokenizer) <= -(-sum(r.length for r in got) // 4096) * 1.02 + 1
