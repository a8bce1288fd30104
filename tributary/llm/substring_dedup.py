"""Substring dedup with a Count-min prefilter.

A window is `size` consecutive words of one document. Every word covered by a
window that also starts in a document with a smaller id is removed.

1. Each block of documents builds a sparse Count-min sketch of its window hashes
   (two rows of cells, counters that stop at 2) and sends each cell range to the
   shard that owns it. Shards add the counters of all blocks: an estimate is never
   below the true count. Each block gets back those of its cells that reached 2.
2. A window is estimated repeated if its cell reached 2 in both rows. Blocks send
   only these windows, as 128-bit hashes with the block's smallest id, to exact
   groups; a group answers each block with the smallest id of all documents.
3. Each block marks words and cuts.

Blocks are hashed by document id, and a block sends a window once however often it
has it, so neither a hot source nor thousands of copies meet in one task. Cells,
windows and ids travel as packed arrays; all steps are shuffles by block or shard,
and the text exchange is the same in all three, so Spark runs it once.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm import textkit as K
from tributary.llm.storage import block_count, text_bytes

ROWS = 2
LAST = np.iinfo(np.int64).max
MESSAGE = "to int, about int, part int, width int, payload binary"
MESSAGE_ARROW = pa.schema([("to", pa.int32()), ("about", pa.int32()), ("part", pa.int32()), ("width", pa.int32()), ("payload", pa.binary())])
EXACT = np.dtype([("hi", "<u8"), ("lo", "<u8"), ("least", "<i8")])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(MESSAGE_ARROW)], schema=MESSAGE_ARROW)


class _Windows:
    """Window hashes of a block; `row` is the table row and `at` the first word of each."""

    def __init__(self, table: pa.Table, size: int):
        self.data, offs = K.text_buffer(table["_text"])
        starts, ends, self.word_row = K.words(self.data, offs)
        inside = K.whole(self.word_row, size)
        self.at = np.flatnonzero(inside)
        self.row = self.word_row[self.at]
        self.hi = K.window_hash(K.span_hash(self.data, starts, ends, 1), size, 0x9E3779B97F4A7C15)[inside]
        self.lo = K.window_hash(K.span_hash(self.data, starts, ends, 2), size, 0xD6E8FEB86659FD93)[inside]
        ids = table["_id"].combine_chunks()
        self.ids = np.where(np.asarray(ids.is_null()), LAST, np.asarray(ids.fill_null(0)).astype(np.int64))

    def cells(self, bits: int) -> list[np.ndarray]:
        return [(x >> K.U(64 - bits)).astype(np.int64) for x in (self.hi, self.lo)]


def _sketch(size: int, bits: int, shard_bits: int):
    def build(key, table):
        block, out = key[0].as_py(), []
        for part, cells in enumerate(_Windows(table, size).cells(bits)):
            cells = np.sort(cells)
            if not len(cells):
                continue
            # a counter stops at 2, so the third and later entries of a cell are not sent
            cells = cells[np.r_[True, True, cells[2:] != cells[:-2]][: len(cells)]]
            shard = cells >> (bits - shard_bits)
            cut = np.flatnonzero(np.diff(shard)) + 1
            for piece in np.split(cells, cut):
                to = int(piece[0] >> (bits - shard_bits))
                out.append((to, block, part, *K.deltas(piece - (to << (bits - shard_bits)))))
        return _table(out)

    return build


def _merge(bits: int, shard_bits: int):
    def add(key, table):
        shard, out = key[0].as_py(), []
        messages = list(zip(*(table[c].to_pylist() for c in ("about", "part", "width", "payload"))))
        for part in range(ROWS):
            mine = [(b, K.undeltas(w, p)) for b, q, w, p in messages if q == part]
            seen = np.zeros(1 << (bits - shard_bits), np.uint8)
            for _, cells in mine:
                again = np.r_[False, cells[1:] == cells[:-1]]
                seen[cells[~again]] += seen[cells[~again]] < 2
                seen[cells[again]] = 2
            for block, cells in mine:
                hit = np.unique(cells[seen[cells] > 1])
                if len(hit):
                    out.append((block, shard, part, *K.deltas(hit)))
        return _table(out)

    return add


def _candidates(size: int, bits: int, shard_bits: int):
    def send(key, docs, hits):
        out = []
        if docs.num_rows == 0 or hits.num_rows == 0:
            return _table(out)
        win = _Windows(docs, size)
        maybe = np.ones(len(win.hi), bool)
        order = np.argsort(np.asarray(hits["about"]), kind="stable")
        about, part, width, payload = (hits[c].to_pylist() for c in ("about", "part", "width", "payload"))
        for p, cells in enumerate(win.cells(bits)):
            known = [K.undeltas(width[i], payload[i]) + (about[i] << (bits - shard_bits)) for i in order if part[i] == p]
            known = np.concatenate(known) if known else np.zeros(0, np.int64)
            if not len(known):
                return _table(out)
            maybe &= known[np.minimum(np.searchsorted(known, cells), len(known) - 1)] == cells
        hi, lo, ids = win.hi[maybe], win.lo[maybe], win.ids[win.row[maybe]]
        if not len(hi):
            return _table(out)
        order = np.lexsort((ids, lo, hi))
        hi, lo, ids = hi[order], lo[order], ids[order]
        first = np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]
        begin = np.flatnonzero(first)
        end = np.r_[begin[1:], len(hi)] - 1
        rec = np.empty(len(begin), EXACT)
        rec["hi"], rec["lo"], rec["least"] = hi[begin], lo[begin], ids[begin]
        several = ids[end] > ids[begin]
        shard = (rec["hi"] >> K.U(64 - shard_bits)).astype(np.int64)
        cut = np.r_[0, np.flatnonzero(np.diff(shard)) + 1, len(rec)]
        block = key[0].as_py()
        for a, b in zip(cut[:-1], cut[1:]):
            out.append((int(shard[a]), block, int(b - a), 0, rec[a:b].tobytes() + np.packbits(several[a:b]).tobytes()))
        return _table(out)

    return send


def _exact(key, table):
    """The smallest id of each window over all blocks, told to the blocks it changes something for."""
    shard, out = key[0].as_py(), []
    blocks, sizes, payloads = (table[c].to_pylist() for c in ("about", "part", "payload"))
    recs = [np.frombuffer(p, EXACT, count=n) for n, p in zip(sizes, payloads)]
    several = [np.unpackbits(np.frombuffer(p, np.uint8, offset=n * EXACT.itemsize), count=n).astype(bool) for n, p in zip(sizes, payloads)]
    every = np.concatenate(recs)
    order = np.lexsort((every["least"], every["lo"], every["hi"]))
    s = every[order]
    first = np.r_[True, (s["hi"][1:] != s["hi"][:-1]) | (s["lo"][1:] != s["lo"][:-1])]
    least = np.empty(len(s), np.int64)
    least[order] = s["least"][np.flatnonzero(first)[np.cumsum(first) - 1]]
    at = 0
    for block, rec, multi in zip(blocks, recs, several):
        mine = least[at : at + len(rec)]
        at += len(rec)
        told = (mine < rec["least"]) | multi
        if told.any():
            answer = rec[told].copy()
            answer["least"] = mine[told]
            out.append((block, shard, int(told.sum()), 0, answer.tobytes()))
    return _table(out)


def _cut(size: int, out_schema: pa.Schema, with_text: bool):
    def cut(key, docs, answers):
        win = _Windows(docs, size)
        known = [np.frombuffer(p, EXACT) for _, p in sorted(zip(answers["about"].to_pylist(), answers["payload"].to_pylist()))]
        gone = np.zeros(len(win.word_row), bool)
        if known and len(win.hi):
            known = np.concatenate(known)
            place = np.searchsorted(known["hi"], win.hi)
            doomed = np.zeros(len(win.hi), bool)
            live = np.flatnonzero(place < len(known))
            while len(live):  # equal upper halves are next to each other; one step is the rule
                same = known["hi"][place[live]] == win.hi[live]
                live = live[same]
                rec = known[place[live]]
                doomed[live] |= (rec["lo"] == win.lo[live]) & (rec["least"] < win.ids[win.row[live]])
                place[live] += 1
                live = live[place[live] < len(known)]
            gone = K.cover(win.at[doomed], size, len(win.word_row))
        n = docs.num_rows
        count = np.bincount(win.word_row, minlength=n)
        lost = np.bincount(win.word_row[gone], minlength=n)
        edge = np.concatenate([[0], np.cumsum(count)])
        texts, shas, spans = [], [], []
        for i, text in enumerate(docs["_text"].to_pylist()):
            parts = (text or "").encode().split()
            mask = ~gone[edge[i] : edge[i + 1]]
            kept = b" ".join(parts if not lost[i] else compress(parts, mask.tolist()))
            shas.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                texts.append(kept.decode() if lost[i] else text)
                step = np.diff(np.r_[False, ~mask, False].astype(np.int8))
                spans.append([{"first": int(a), "words": int(b - a)} for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))])
        cols = {f.name: docs[f.name] for f in out_schema if f.name in docs.column_names}
        cols |= {"n_words": count.astype(np.int64), "n_removed": lost.astype(np.int64), "kept_sha256": shas}
        if with_text:
            cols |= {"kept_text": texts, "removed_spans": spans}
        return pa.Table.from_arrays([x if isinstance(x := cols[f.name], pa.ChunkedArray) and x.type == f.type else (x.cast(f.type) if isinstance(x, pa.ChunkedArray) else pa.array(x, f.type)) for f in out_schema], schema=out_schema)

    return cut


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50, with_text: bool = True, block_bytes: int = 8 << 20) -> DataFrame:
    """All columns of `docs` (prefixed `c_`) with n_words, n_removed, kept_sha256 and,
    with_text, kept_text and removed_spans.

    kept_text is the text itself where nothing is removed (null stays null), else the
    kept words joined by one space. Null text has no words. A null id counts as larger
    than any other, and equal ids are not smaller than each other: rows that repeat an
    id don't remove each other's windows. Texts shorter than a window lose nothing. An
    empty table gives an empty result. Other columns pass through whatever their names.

    A block sends at most one message to each shard, and there are as many shards as blocks: from
    some 10 TB of text on a message would hold less than a cell, and 64 MB of text a block (a task
    then takes about 1 GB) keep messages at a dozen cells up to 100 TB.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    total = text_bytes(docs, f"`{text_col}`")
    blocks = block_count(total, block_bytes)
    shard_bits = blocks.bit_length() - 1
    bits = min(56, max(shard_bits + 12, max(total, 1).bit_length()))
    # text_col may be any string-like column; ids are longs
    kept = [c for c in (docs.columns if with_text else [id_col]) if c != text_col]
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.octet_length(F.col(f"`{text_col}`"))), F.lit(blocks)).cast("int").alias("_block"),
        F.col(f"`{id_col}`").cast("long").alias("_id"),
        F.col(f"`{text_col}`").cast("string").alias("_text"),
        *[F.col(f"`{c}`").alias(f"_p{i}") for i, c in enumerate(kept)],  # Arrow groups take plain names only
    )
    by_block = rows.groupBy("_block")
    sketches = by_block.applyInArrow(_sketch(size, bits, shard_bits), MESSAGE)
    repeated = sketches.groupBy("to").applyInArrow(_merge(bits, shard_bits), MESSAGE)
    sent = by_block.cogroup(repeated.groupBy("to")).applyInArrow(_candidates(size, bits, shard_bits), MESSAGE)
    answers = sent.groupBy("to").applyInArrow(_exact, MESSAGE)
    fields = [f for f in rows.schema if f.name.startswith("_p")]
    more = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    if with_text:
        more += [T.StructField("kept_text", T.StringType()), T.StructField("removed_spans", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("words", T.IntegerType())])))]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields] + more)
    cut = by_block.cogroup(answers.groupBy("to")).applyInArrow(_cut(size, to_arrow_schema(schema), with_text), schema)
    return cut.toDF(*[f"c_{c}" for c in kept], *[f.name for f in more])
