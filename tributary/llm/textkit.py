"""Vectorised text kernels over Arrow columns: words, 64-bit hashes, window hashes.

Texts stay one UTF-8 byte buffer with offsets; nothing here loops over rows.
Words are maximal runs without the bytes 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
KEEP = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply), applied in place."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with 8 zero bytes after them, int64 offsets); null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.cast(pa.large_string()).combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(8, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64, count=n + 1, offset=column.offset * 8)
    size = int(offs[-1] - offs[0])
    out = np.zeros(size + 8, np.uint8)
    if size:
        out[:size] = np.frombuffer(data, np.uint8, count=size, offset=int(offs[0]))
    return out, offs - offs[0]


def words(data: np.ndarray, offs: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word; a word never crosses a row. `between` tells which bytes part words."""
    n = int(offs[-1])
    solid = ~between[data[:n]]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:]
    inner = offs[1:-1]
    inner = inner[(inner < n) & (inner > 0)]
    begin[inner] = solid[inner]
    stop[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(offs, starts, "right") - 1


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes a step for the spans still open."""
    lens = ends - starts
    eight = np.ndarray((max(len(data) - 7, 1),), "<u8", data, strides=(1,))
    h = mix(lens.astype(U) + U(seed))
    open_ = np.arange(len(starts))
    at = starts.copy()
    left = lens.copy()
    while len(open_):
        h[open_] = mix((h[open_] ^ (eight[at] & KEEP[np.minimum(left, 8)])) * U(0x9E3779B97F4A7C15) + U(seed))
        more = left > 8
        open_, at, left = open_[more], at[more] + 8, left[more] - 8
    return h


def powers(r: int, n: int) -> np.ndarray:
    out = np.full(n, r, dtype=U)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=U)


def window_hash(h: np.ndarray, size: int, r: int) -> np.ndarray:
    """Hash of each run of `size` consecutive values; r odd. Runs may cross rows: see `whole`."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.concatenate([np.zeros(1, U), np.cumsum(h * powers(r, len(h)), dtype=U)])
    out = (total[size:] - total[:-size]) * powers(pow(r, -1, 1 << 64), n)
    return mix(out)


def whole(row: np.ndarray, size: int) -> np.ndarray:
    """Which runs of `size` words stay within one row."""
    return row[: len(row) - size + 1] == row[size - 1 :] if len(row) >= size else np.zeros(0, bool)


def cover(first: np.ndarray, size: int, n: int) -> np.ndarray:
    """Bool over n places: covered by [f, f + size) of some f in `first`."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, np.minimum(first + size, n), -1)
    return np.cumsum(edge[:-1]) > 0


def deltas(cells: np.ndarray) -> tuple[int, bytes]:
    """Sorted non-negative ints as (bytes of a step, steps)."""
    step = np.diff(cells, prepend=0)
    width = 2 if step.max(initial=0) < 1 << 16 else 4 if step.max(initial=0) < 1 << 32 else 8
    return width, step.astype(f"<u{width}").tobytes()


def undeltas(width: int, payload: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(payload, f"<u{width}").astype(np.int64))


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns freed memory to the machine: Python workers live on between tasks, next to others that need it."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def parts(batch: pa.RecordBatch, column: str, most: int = 2 << 20):
    """Slices of a batch with about `most` text bytes, one row at least."""
    size = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64))])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    give_back()
