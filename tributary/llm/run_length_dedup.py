"""Suffix-array dedup with a run-length index.

Removes every byte covered by a string of `size` bytes that also starts anywhere else,
in the same document too.

1. Sieve. In each string of `size` bytes the k-gram of least hash, the rightmost of
   equals, is its anchor. Strings in a row with one anchor make a snippet (the bytes they
   cover), so every string lies in exactly one snippet, and equal strings have equal
   anchors. Blocks count snippets by (anchor, 128-bit text hash). Anchors that occur once
   can't repeat and are done; snippets that occur twice as a whole repeat in all their
   strings. What is left are distinct snippets that share an anchor.
2. Run-length index. Those are dealt by anchor to shards. A shard sorts the suffixes of its
   snippets, keeps the Burrows-Wheeler transform as runs and the suffix-array samples of
   both ends of each run, and drops the rest. The longest match of a position with its
   neighbour in suffix order is irreducible only at a run's end: there it is found by
   comparing that sample with the next run's, everywhere else it is one less than at the
   position before. So the matching statistics of the whole shard stream from one
   comparison per run, few in repetitive text. Positions with `size` or more are marked.
3. An anchor with more than `most` distinct snippets would be a shard of its own size
   whatever the number of machines. Its strings are grouped exactly by 128-bit hash
   instead, spread over all shards.
4. Blocks cut.

Texts move once, by hashed document id; the exchange is shared by all three passes over
them. Snippets, hashes and marks travel packed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm import textkit as K
from tributary.llm.storage import block_count, text_bytes, written

R1, R2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
BYTE1 = K.mix(np.arange(256, dtype=K.U) + K.U(0x1234567))
BYTE2 = K.mix(np.arange(256, dtype=K.U) + K.U(0xABCDEF01))
SEGMENT = "anchor long, s1 long, s2 long, block int, n long"
PACKED = "to int, about int, kind int, payload binary"
PACKED_ARROW = pa.schema([("to", pa.int32()), ("about", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
SNIPPET = np.dtype([("s1", "<u8"), ("s2", "<u8"), ("size", "<i4"), ("look", "<i4")])
WINDOW = np.dtype([("w1", "<u8"), ("w2", "<u8"), ("s1", "<u8"), ("s2", "<u8"), ("at", "<i4"), ("look", "<i4")])
RANGE = np.dtype([("s1", "<u8"), ("s2", "<u8"), ("first", "<i4"), ("n", "<i4")])


def _packed(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(PACKED_ARROW)], schema=PACKED_ARROW)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, from running minima of blocks of w both ways."""
    n = len(v) - w + 1
    rows = -(-len(v) // w)
    full = np.full(rows * w, np.iinfo(v.dtype).max, v.dtype)
    full[: len(v)] = v
    full = full.reshape(rows, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


class _Piece:
    """Snippets of some rows' bytes: [lo, hi] are the first and last string starts of each, in `data`."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, size: int, k: int):
        n = int(offs[-1])
        self.data, self.size, self.k = data, size, k
        self.lo = self.hi = np.zeros(0, np.int64)
        starts = np.concatenate([np.arange(a, b - size + 1) for a, b in zip(offs[:-1], offs[1:]) if b - a >= size] or [np.zeros(0, np.int64)])
        if not len(starts):
            return
        self.back1 = K.powers(pow(R1, -1, 1 << 64), n + 1)
        self.sum1 = np.concatenate([np.zeros(1, K.U), np.cumsum(BYTE1[data[:n]] * K.powers(R1, n), dtype=K.U)])
        gram = K.mix((self.sum1[k:] - self.sum1[:-k]) * self.back1[: n - k + 1])
        low = (1 << 24) - 1
        order = (gram & K.U(~low & (1 << 64) - 1)) | (K.U(low) - np.arange(len(gram), dtype=K.U))
        at = low - (sliding_min(order, size - k + 1)[starts] & K.U(low)).astype(np.int64)
        new = np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]
        first = np.flatnonzero(new)
        # one anchor can serve strings of two rows only if it lies in both: it never does
        self.lo, self.hi = starts[first], starts[np.r_[first[1:], len(starts)] - 1]
        self.anchor = gram[at[first]]
        self.back2 = K.powers(pow(R2, -1, 1 << 64), n + 1)
        self.sum2 = np.concatenate([np.zeros(1, K.U), np.cumsum(BYTE2[data[:n]] * K.powers(R2, n), dtype=K.U)])
        self.s1, self.s2 = self.spans(self.lo, self.hi + size)

    def spans(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = (b - a).astype(K.U)
        return K.mix((self.sum1[b] - self.sum1[a]) * self.back1[a] + size), K.mix((self.sum2[b] - self.sum2[a]) * self.back2[a] + size)


def _pieces(table: pa.Table, size: int, k: int, most: int = 1 << 20):
    """(start in the block's bytes, _Piece) over the block; a row longer than `most` is cut with overlap."""
    data, offs = K.text_buffer(table["_text"])
    row = 0
    while row < len(offs) - 1:
        to = max(row + 1, int(np.searchsorted(offs, offs[row] + most, "right")) - 1)
        a, b = int(offs[row]), int(offs[to])
        if b - a > 2 * most:
            for c in range(a, max(b - size + 1, a + 1), most):
                d = min(c + most + size - 1, b)
                yield c, _Piece(data[c:d], np.array([0, d - c]), size, k)
        elif b > a:
            yield a, _Piece(data[a:b], offs[row : to + 1] - a, size, k)
        row = to


def _sieve(size: int, k: int):
    def sieve(key, table):
        found = [(p.anchor, p.s1, p.s2) for _, p in _pieces(table, size, k) if len(p.lo)]
        anchor, s1, s2 = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, K.U) for i in range(3))
        order = np.lexsort((s2, s1))
        anchor, s1, s2 = anchor[order], s1[order], s2[order]
        first = np.flatnonzero(np.r_[True, (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])]) if len(s1) else np.zeros(0, np.int64)
        n = np.diff(np.r_[first, len(s1)])
        return pa.table({"anchor": anchor[first].view(np.int64), "s1": s1[first].view(np.int64), "s2": s2[first].view(np.int64), "block": np.full(len(first), key[0].as_py(), np.int32), "n": n.astype(np.int64)})

    return sieve


def _lookup(s1: np.ndarray, s2: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of snippet, index of key) for all equal (s1, s2) and (k1, k2)."""
    order = np.argsort(s1)
    lo, hi = np.searchsorted(s1[order], k1, "left"), np.searchsorted(s1[order], k1, "right")
    n = hi - lo
    key = np.repeat(np.arange(len(k1)), n)
    snippet = order[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())] if len(key) else np.zeros(0, np.int64)
    same = s2[snippet] == k2[key]
    return snippet[same], key[same]


def _fetch(size: int, k: int, shards: int):
    """The texts (or string hashes, where `kind` is 1) of the snippets that a block is asked for."""

    def fetch(key, docs, asked):
        out, block = [], key[0].as_py()
        if not asked.num_rows or not docs.num_rows:
            return _packed(out)
        a1, a2, look, kind = (np.asarray(asked[c]) for c in ("s1", "s2", "look", "kind"))
        a1, a2 = a1.view(K.U), a2.view(K.U)
        done = np.zeros(len(a1), bool)
        texts: dict[int, list] = {}
        strings = []
        for _, p in _pieces(docs, size, k):
            at, which = _lookup(p.s1, p.s2, a1, a2) if len(p.lo) else (np.zeros(0, np.int64),) * 2
            fresh = ~done[which]
            at, which = at[fresh], which[fresh]
            which, keep = np.unique(which, return_index=True)
            at = at[keep]
            done[which] = True
            shard = (p.anchor[at] % K.U(shards)).astype(np.int64)
            for i, w, s in zip(at, which, shard):
                lo, hi = p.lo[i], p.hi[i] + 1
                if kind[w]:
                    starts = np.arange(lo, hi)
                    rec = np.empty(len(starts), WINDOW)
                    rec["w1"], rec["w2"] = p.spans(starts, starts + size)
                    rec["s1"], rec["s2"], rec["at"], rec["look"] = p.s1[i], p.s2[i], starts - lo, look[w]
                    strings.append(rec)
                else:
                    texts.setdefault(int(s), []).append((p.s1[i], p.s2[i], look[w], p.data[lo : hi - 1 + size].tobytes()))
        for s, items in texts.items():
            head = np.array([(a, b, len(t), f) for a, b, f, t in items], SNIPPET)
            out.append((s, block, 0, np.int32(len(items)).tobytes() + head.tobytes() + b"".join(t for *_, t in items)))
        if strings:
            rec = np.concatenate(strings)
            shard = (rec["w1"] % K.U(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            rec, shard = rec[order], shard[order]
            cut = np.r_[0, np.flatnonzero(np.diff(shard)) + 1, len(rec)]
            out += [(int(shard[a]), block, 1, rec[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:])]
        return _packed(out)

    return fetch


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; seven 9-bit symbols to start with.

    A round sorts only the suffixes that aren't alone in their group yet. A suffix's rank is the
    place where its group starts, so ranks of the others stay as they are.
    """
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.int64) + 1, np.zeros(7, np.int64)])  # 0 is after the end, before every symbol
    key = np.zeros(n, np.int64)
    for i in range(7):
        key = (key << 9) | padded[i : i + n]
    order = np.argsort(key)  # equal keys are told apart later, so the sort needn't be stable
    key = key[order]
    starts = np.ones(n, bool)
    starts[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0)) + 1
    depth = 7
    while True:
        at = np.flatnonzero(~(starts & np.append(starts[1:], True)))
        if not len(at):
            return order
        some = order[at]
        beyond = some + depth
        key = rank[some] * (n + 1) + np.where(beyond < n, rank[np.minimum(beyond, n - 1)], 0)
        sub = np.argsort(key)
        some, key = some[sub], key[sub]
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        order[at], starts[at] = some, fresh
        rank[some] = np.maximum.accumulate(np.where(fresh, at, 0)) + 1
        depth *= 2


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform with the suffix-array samples of its run ends.

    `symbols` are bytes + 1 with 0 after each text.
    """

    def __init__(self, symbols: np.ndarray):
        order = suffix_order(symbols)
        before = np.where(order > 0, symbols[order - 1].astype(np.int32), -1)
        head = np.flatnonzero(np.r_[True, before[1:] != before[:-1]]) if len(order) else np.zeros(0, np.int64)
        self.symbols = symbols
        self.run_symbol = before[head]
        self.run_start = head
        self.first = order[head]
        self.last = order[np.r_[head[1:], len(order)] - 1] if len(head) else head

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at each a and b."""
        padded = np.concatenate([self.symbols.astype(np.uint16), np.full(4, 600, np.uint16)])
        four = np.ndarray((len(padded) - 3,), "<u8", padded, strides=(2,))
        n = len(self.symbols)
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            inside = np.maximum(x, y) < n
            live, x, y = live[inside], x[inside], y[inside]
            differ = four[x] ^ four[y]
            same = np.full(len(live), 4)
            for i in (3, 2, 1, 0):
                same[(differ >> np.uint64(16 * i)) & np.uint64(0xFFFF) != 0] = i
            out[live] += same
            live = live[same == 4]
        return np.minimum(out, n - np.maximum(a, b)) if len(a) else out

    def matching_statistics(self) -> np.ndarray:
        """Longest match of the suffix at each position with any other suffix, from one comparison per run."""
        best = np.zeros(len(self.symbols), np.int64)
        if len(best) < 2:
            return best
        at = np.arange(len(best))
        common = self._common(self.first[1:], self.last[:-1])
        for sample, length, open_end in ((self.first[1:], common, self.first[0]), (self.last[:-1], common, self.last[-1])):
            # the value is exact at samples and falls by one from position to position elsewhere
            reach = np.full(len(best), -1, np.int64)
            reach[sample] = sample + length
            reach[open_end] = open_end
            known = np.maximum.accumulate(np.where(reach >= 0, at, -1))
            best = np.maximum(best, np.where(known >= 0, reach[known] - at, 0))
        return best


def _mark(size: int):
    def mark(key, table):
        shard, found = key[0].as_py(), {}
        heads, parts, owners = [], [], []
        strings, string_owner = [], []
        for block, kind, payload in sorted(zip(table["about"].to_pylist(), table["kind"].to_pylist(), table["payload"].to_pylist())):
            if kind == 1:
                rec = np.frombuffer(payload, WINDOW)
                strings.append(rec)
                string_owner.append(np.full(len(rec), block))
                continue
            n = int(np.frombuffer(payload, "<i4", 1)[0])
            head = np.frombuffer(payload, SNIPPET, n, 4)
            heads.append(head)
            owners.append(np.full(n, block))
            at = 4 + n * SNIPPET.itemsize
            for length in head["size"]:
                parts += [np.frombuffer(payload, np.uint8, length, at).astype(np.uint16) + np.uint16(1), np.zeros(1, np.uint16)]
                at += length
        if heads:
            head, owner = np.concatenate(heads), np.concatenate(owners)
            symbols = np.concatenate(parts)
            long = RunLengthIndex(symbols).matching_statistics() >= size
            start = np.concatenate([[0], np.cumsum(head["size"].astype(np.int64) + 1)])
            for i in np.flatnonzero(head["look"]):
                here = long[start[i] : start[i] + head["size"][i] - size + 1]
                step = np.diff(np.r_[False, here, False].astype(np.int8))
                for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1)):
                    found.setdefault(int(owner[i]), []).append((head["s1"][i], head["s2"][i], a, b - a))
        if strings:
            rec, owner = np.concatenate(strings), np.concatenate(string_owner)
            order = np.lexsort((rec["w2"], rec["w1"]))
            rec, owner = rec[order], owner[order]
            same = (rec["w1"][1:] == rec["w1"][:-1]) & (rec["w2"][1:] == rec["w2"][:-1])
            twice = (np.r_[False, same] | np.r_[same, False]) & (rec["look"] != 0)
            rec, owner = rec[twice], owner[twice]
            order = np.argsort(owner, kind="stable")
            rec, owner = rec[order], owner[order]
            cut = np.r_[0, np.flatnonzero(np.diff(owner)) + 1, len(owner)]
            for a, b in zip(cut[:-1], cut[1:]):
                if b > a:
                    found.setdefault(int(owner[a]), []).extend((r["s1"], r["s2"], r["at"], 1) for r in rec[a:b])
        return _packed([(b, shard, 2, np.array(x, RANGE).tobytes()) for b, x in found.items()])

    return mark


def _cut(size: int, k: int, out_schema: pa.Schema, with_bytes: bool):
    def cut(key, docs, marks):
        data, offs = K.text_buffer(docs["_text"])
        gone = np.zeros(int(offs[-1]), bool)
        kinds = np.asarray(marks["kind"])
        all1, all2 = (np.asarray(marks[c].fill_null(0))[kinds == 3].view(K.U) for c in ("s1", "s2"))
        some = [np.frombuffer(p, RANGE) for p in marks["payload"].to_pylist() if p]
        some = np.concatenate(some) if some else np.zeros(0, RANGE)
        if len(all1) or len(some):
            for base, p in _pieces(docs, size, k):
                if not len(p.lo):
                    continue
                which, _ = _lookup(p.s1, p.s2, all1, all2)
                edge = np.zeros(len(p.data) + size + 1, np.int64)
                np.add.at(edge, p.lo[which], 1)
                np.add.at(edge, p.hi[which] + size, -1)
                which, rec = _lookup(p.s1, p.s2, some["s1"], some["s2"])
                first = p.lo[which] + some["first"][rec]
                np.add.at(edge, first, 1)
                np.add.at(edge, first + some["n"][rec] - 1 + size, -1)
                hit = np.cumsum(edge)[: len(p.data)] > 0
                hit = hit[: len(gone) - base]
                gone[base : base + len(hit)] |= hit
        total = np.concatenate([[0], np.cumsum(gone)])
        rises = gone.copy()
        rises[1:] &= ~gone[:-1]
        edge = offs[:-1][np.diff(offs) > 0]
        rises[edge] = gone[edge]
        begun = np.concatenate([[0], np.cumsum(rises)])
        kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offs[:-1], offs[1:])]
        cols = {f.name: docs[f.name] for f in out_schema if f.name in docs.column_names}
        cols |= {"n_bytes": np.diff(offs), "n_removed": total[offs[1:]] - total[offs[:-1]], "n_spans": begun[offs[1:]] - begun[offs[:-1]], "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]}
        if with_bytes:
            cols["kept"] = kept
        return pa.Table.from_arrays([x.cast(f.type) if isinstance(x := cols[f.name], pa.ChunkedArray) else pa.array(x, f.type) for f in out_schema], schema=out_schema)

    return cut


def run_length_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 400, k: int = 32, most: int = 2048, with_bytes: bool = True, block_bytes: int = 8 << 20) -> DataFrame:
    """All columns of `docs` but the text (prefixed `c_`) with n_bytes, n_removed, n_spans, kept_sha256
    and, with_bytes, kept: the bytes that remain, which may cut a character.

    Null text is empty; texts shorter than `size` lose nothing. Ids only place rows: null and
    repeated ids are rows like others, and equal rows remove each other. An empty table gives an
    empty result. Larger blocks (`block_bytes` of text) make fewer messages, for 10 TB and more.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    blocks = block_count(text_bytes(docs, f"`{text_col}`"), block_bytes)
    shards = 4 * blocks
    col = lambda name: F.col(f"`{name}`")
    kept = [c for c in (docs.columns if with_bytes else [id_col]) if c != text_col]
    rows = docs.select(
        F.pmod(F.xxhash64(col(id_col), F.octet_length(col(text_col))), F.lit(blocks)).cast("int").alias("_block"),
        col(text_col).cast("string").alias("_text"),
        *[col(c).alias(f"_p{i}") for i, c in enumerate(kept)],  # Arrow groups take plain names only
    )
    by_block = rows.groupBy("_block")
    segments = written(by_block.applyInArrow(_sieve(size, k), SEGMENT), "snippets")
    kinds = segments.groupBy("anchor", "s1", "s2").agg(F.sum("n").alias("n"), F.min("block").alias("block"))
    anchors = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).where("total > 1")
    repeated = written(kinds.join(anchors, "anchor").select("s1", "s2", "n", "block", "kinds"), "repeated")
    asked = repeated.where("kinds > 1").select("block", "s1", "s2", (F.col("n") == 1).cast("int").alias("look"), (F.col("kinds") > most).cast("int").alias("kind"))
    sent = by_block.cogroup(asked.groupBy("block")).applyInArrow(_fetch(size, k, shards), PACKED)
    ranges = sent.groupBy("to").applyInArrow(_mark(size), PACKED)
    whole = segments.select("block", "s1", "s2").join(repeated.where("n > 1").select("s1", "s2"), ["s1", "s2"])
    marks = whole.select("block", "s1", "s2", F.lit(3).alias("kind"), F.lit(None).cast("binary").alias("payload")).unionByName(ranges.select(F.col("to").alias("block"), F.lit(None).cast("long").alias("s1"), F.lit(None).cast("long").alias("s2"), "kind", "payload"))
    fields = [f for f in rows.schema if f.name.startswith("_p")]
    more = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())] + ([T.StructField("kept", T.BinaryType())] if with_bytes else [])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields] + more)
    cut = by_block.cogroup(marks.groupBy("block")).applyInArrow(_cut(size, k, to_arrow_schema(schema), with_bytes), schema)
    return cut.toDF(*[f"c_{c}" for c in kept], *[f.name for f in more])
