"""Best-fit packing of token sequences, planned over a histogram of lengths.

1. Texts become token counts and checksums; only documents longer than a sequence are
   cut, into full pieces and a rest.
2. The plan sees counts per length, at most `capacity` numbers whatever the input. It
   goes by falling length and always fills the open sequences with the least room that
   still takes the length; sequences filled alike are one entry with a count.
3. Pieces take planned places by their rank within their length. Ranks are two-level:
   counts per (length, salt), then a row number inside. A length that a third of all
   pieces share is as many groups as there are salts.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.llm import textkit as K
from tributary.llm.storage import written

SALTS = 1024
#: The split that `parts_at_space` knows.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = "id long, piece int, start long, length long, ids_crc32 long"


LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
SIGN = np.zeros(256, bool)
SIGN[[ord(c) for c in ".,;:!?"]] = True


def parts_at_space(shape: dict) -> bool:
    """Whether no piece of a vocabulary holds white space or depends on what is beyond it.

    True for NFC, folding of white space and of case, and a split that keeps contractions, runs of
    letters, single numbers and runs of other signs, where added tokens have neither white space nor
    one of SIGN. NFC joins neither ASCII white space nor ASCII signs with their neighbours.
    """
    steps = (shape["normalizer"] or {}).get("normalizers", [])
    splits = (shape["pre_tokenizer"] or {}).get("pretokenizers", [])
    if [n["type"] for n in steps] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in splits] != ["Split", "ByteLevel"]:
        return False
    whole = shape["truncation"] is None and shape["padding"] is None and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"[\s.,;:!?]", t["content"]) for t in shape["added_tokens"])
    return whole and steps[1]["pattern"] == {"Regex": r"\s+"} and splits[0]["invert"] and splits[0]["behavior"] == "Removed" and splits[0]["pattern"].get("Regex") == WORDS and not splits[1]["add_prefix_space"]


def letter_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes are of letters from A to Z or of Latin-1: letters in every Unicode version, and never composed anew."""
    out = LETTER[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = second[(data[second] != 0x97) & (data[second] != 0xB7)]  # the signs of multiplication and division
    out[second] = out[second - 1] = True
    return out


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct value, the number of each value among them)."""
    part, values = pd.factorize(h)
    first = np.empty(len(values), np.int64)
    first[part] = np.arange(len(h))
    return first, part


class Encoder:
    """Ids of whole texts by the tokenizer itself.

    Vocabularies that `parts_at_space` knows give a text the ids of its chunks between ASCII white
    space in turn. There the ids of a chunk that ends in a letter of `letter_bytes` and one of SIGN
    are those of both parts, and a part of such letters alone is one piece, with the ids of its lower
    case. So the tokenizer encodes each distinct part once, while its ids are remembered, many parts
    of letters as one text: their ends are told by the mark at the end of a piece. Texts of any other
    vocabulary go through it whole.
    """

    def __init__(self, path: str, remembered: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered = remembered
        # the ids of parts; when full, the last generation is still asked
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        shape = json.loads(self.tokenizer.to_str())
        self.by_chunk = parts_at_space(shape)
        mark, vocabulary = shape["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        if mark:
            self.last[[i for token, i in vocabulary.items() if token.endswith(mark)]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, parts: list[bytes], texts: int = 16, words: int = 128) -> list[bytes]:
        """Remembers the ids of parts of one piece each; gives those whose ends can't be told."""
        left = []
        for at in range(0, len(parts), texts * words):
            groups = [parts[i : i + words] for i in range(at, min(at + texts * words, len(parts)), words)]
            for group, e in zip(groups, self.tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                stops = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
                if len(stops) != len(group):
                    left += group
                    continue
                raw = ids.tobytes()
                self.known.update(zip(group, [raw[a:b] for a, b in zip([0, *stops], stops)]))
        return left

    def _ids(self, parts: list[bytes], letters: list[bool]) -> list[bytes]:
        """The ids of distinct parts, as little-endian unsigned 32-bit bytes; `letters`: parts of one piece."""
        missing = [(p, one) for p, one in zip(parts, letters) if p not in self.known]
        if len(self.known) + len(missing) > self.remembered:
            self.before, self.known, missing = self.known, {}, list(zip(parts, letters))
        alone, together = [], []
        for p, one in missing:
            ids = self.before.get(p)
            if ids is None:
                (together if one else alone).append(p)
            else:
                self.known[p] = ids
        alone += self._together(together)
        for at in range(0, len(alone), 4096):
            some = alone[at : at + 4096]
            self.known.update(zip(some, self._encode([p.decode() for p in some])))
        return [self.known[p] for p in parts]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first place of each text and the end); null texts are empty."""
        if not self.by_chunk:
            found = self._encode([t or "" for t in texts.to_pylist()])
            return np.frombuffer(b"".join(found), "<u4"), np.concatenate([[0], np.cumsum([len(f) // 4 for f in found], dtype=np.int64)])
        data, offs = K.text_buffer(texts)
        starts, ends, row = K.words(data, offs)
        letter = letter_bytes(data)
        cut = (ends - starts > 1) & SIGN[data[ends - 1]] & letter[ends - 2]
        pieces = 1 + cut.astype(np.int64)
        last = np.cumsum(pieces) - 1
        starts, ends, row = np.repeat(starts, pieces), np.repeat(ends, pieces), np.repeat(row, pieces)
        sign = last[cut]
        starts[sign] = ends[sign] - 1
        ends[sign - 1] -= 1
        # parts of letters alone, in lower case from A to Z
        total = np.concatenate([np.zeros(1, np.int32), np.cumsum(letter, dtype=np.int32)])
        plain = total[ends] - total[starts] == ends - starts
        step = np.zeros(len(data) + 1, np.int8)
        step[starts[plain]] += 1
        step[ends[plain]] -= 1
        data[(np.cumsum(step[:-1], dtype=np.int8) > 0) & LETTER[data]] |= 0x20
        h, check = (K.span_hash(data, starts, ends, seed) for seed in (5, 77))
        first, part = _distinct(h)
        if not (check == check[first][part]).all():  # parts are equal if 128 bits are
            _, first, part = np.unique(np.stack([h, check]), axis=1, return_index=True, return_inverse=True)
        raw = data.tobytes()
        ids = self._ids([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], plain[first].tolist())
        size = np.array([len(x) // 4 for x in ids], np.int64)
        begin = np.cumsum(size) - size
        pool = np.frombuffer(b"".join(ids), "<u4")
        n = size[part]
        place = np.cumsum(n)
        flat = pool[np.repeat(begin[part] - (place - n), n) + np.arange(int(place[-1]) if len(place) else 0)]
        return flat, np.concatenate([[0], np.cumsum(np.bincount(row, weights=n, minlength=len(offs) - 1).astype(np.int64))])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks that a Python worker runs."""
    return Encoder(path)


def _pieces(path: str, end: int, capacity: int):
    def cut(batches):
        encode = encoder(path)
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            for part in K.parts(batch, "text", 4 << 20):
                flat, edge = encode(part.column("text"))
                raw, edge, rows = flat.astype("<u4").tobytes(), (4 * edge).tolist(), []
                for i, a, b in zip(part.column("id").to_pylist(), edge[:-1], edge[1:]):
                    ids = raw[a:b] + tail
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + capacity)]
                        rows.append((i, piece, start, len(own) // 4, zlib.crc32(own)))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kinds[j]) for j in range(5)], names=["id", "piece", "start", "length", "ids_crc32"])

    return cut


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number, first sequence, place) entries: rank first + i goes to sequence first + i.

    `histogram` has the number of pieces of each length from 1 to `capacity`.
    """
    out: list[tuple[int, int, int, int, int]] = []
    open_: dict[int, list[tuple[int, int]]] = {}  # room left -> [(first sequence, number of them)]
    rooms: list[int] = []
    sequences = 0

    def leave(room: int, first: int, n: int) -> None:
        if room:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
                used = min(n, left)
                out.append((length, rank, used, first, capacity - room))
                leave(room - length, first, used)
                if used < n:
                    leave(room, first + used, n - used)
                rank, left = rank + used, left - used
                continue
            each = capacity // length
            full, rest = divmod(left, each)
            for number, items in ((full, each), (1 if rest else 0, rest)):
                if number:
                    for j in range(items):
                        out.append((length, rank, number, sequences, j * length))
                        rank += number
                    leave(capacity - items * length, sequences, number)
                    sequences += number
            left = 0
    return out


def _place(entries):
    """Places for rows with a length and a rank; entries of a length are by rank."""
    e = np.array(sorted(entries), np.int64).reshape(-1, 5)
    bound = np.searchsorted(e[:, 0], np.arange(int(e[:, 0].max(initial=0)) + 2))

    def place(batches):
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            entry = np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            edge = np.r_[0, np.flatnonzero(np.diff(length[order])) + 1, len(order)] if len(order) else np.zeros(1, np.int64)
            for a, b in zip(edge[:-1], edge[1:]):
                own = order[a:b]
                lo, hi = bound[length[own[0]]], bound[length[own[0]] + 1]
                entry[own] = lo + np.searchsorted(e[lo:hi, 1], rank[own], "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")], pa.array(e[entry, 3] + rank - e[entry, 1]), pa.array(e[entry, 4])],
                names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return place


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end: int = 1) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document ends with the token `end`, so null and empty texts are pieces of length 1.
    Null ids and rows that repeat an id are packed like any other. An empty table gives an empty
    result; other columns are not read. The tokenizer file must be at `tokenizer_path` on every
    machine.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    pieces = written(rows.mapInArrow(_pieces(tokenizer_path, end, capacity), PIECES).withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(SALTS)).cast("int")), "pieces")
    counts = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")
    ranked = pieces.withColumn("at", F.row_number().over(inside) - 1).join(ahead, ["length", "salt"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("at") + F.col("ahead")).alias("rank"))
    return ranked.mapInArrow(_place(plan(histogram, capacity)), PIECES + ", sequence_id long, offset long")
