"""Rows dealt to sources in file order, without a sort.

A task that reads a table gets stretches of its files in row order, so what it deals to a source is
in order already. Each stretch is written as an Arrow stream (a run) to a file per task and source;
the task of a source reads its runs in the order of file and row and holds one row group at a time,
however large the table is.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from tributary.errors import Refusal

#: Rows of a row group: a fixed number, so that a source's bytes don't depend on how the table was split.
GROUP_ROWS = 1 << 15


class Run(NamedTuple):
    """Rows `first` to `last` of a file that belong to a source, as a stream at `start` of `path`."""

    half: int
    file: str
    first: int
    last: int
    path: str
    start: int


RUNS = "half int, file string, first long, last long, path string, start long"


def write_runs(folder: str):
    """Batches with __half, __file and __at become files in `folder`, a row for each run."""

    def write(batches):
        options = pa.ipc.IpcWriteOptions(compression="lz4")
        files: dict[int, tuple[str, pa.OSFile]] = {}
        streams: dict[int, tuple[Run, pa.ipc.RecordBatchStreamWriter]] = {}
        done: list[Run] = []
        before = None

        def close() -> None:
            for run, stream in streams.values():
                stream.close()
                done.append(run)
            streams.clear()

        def put(name: str, halves: np.ndarray, at: np.ndarray, rows: pa.RecordBatch) -> None:
            order = np.argsort(halves, kind="stable")
            halves, at, rows = halves[order], at[order], rows.take(pa.array(order))
            starts = np.flatnonzero(np.diff(halves, prepend=halves[0] - 1))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(halves)]):
                half = int(halves[a])
                if half not in files:
                    path = f"{folder}/{half}-{uuid.uuid4().hex}"  # a task that runs again writes another file
                    files[half] = path, pa.OSFile(path, "wb")
                path, file = files[half]
                if half not in streams:
                    streams[half] = Run(half, name, int(at[a]), int(at[b - 1]), path, file.tell()), pa.ipc.new_stream(file, rows.schema, options=options)
                run, stream = streams[half]
                stream.write_batch(rows.slice(a, b - a))
                streams[half] = run._replace(last=int(at[b - 1])), stream

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.drop_columns(["__half", "__file", "__at"])
            names, halves, at = batch.column("__file").dictionary_encode(), np.asarray(batch.column("__half")), np.asarray(batch.column("__at"))
            which = np.asarray(names.indices)
            breaks = np.flatnonzero((np.diff(which) != 0) | (np.diff(at) <= 0)) + 1
            for a, b in zip([0, *breaks.tolist()], [*breaks.tolist(), len(at)]):
                name = names.dictionary[int(which[a])].as_py()
                if before is not None and (before[0] != name or before[1] >= at[a]):
                    close()
                put(name, halves[a:b], at[a:b], rows.slice(a, b - a))
                before = name, at[b - 1]
        close()
        for _, file in files.values():
            file.close()
        if done:
            yield pa.RecordBatch.from_pydict({f: [getattr(run, f) for run in done] for f in Run._fields}, pa.schema([("half", pa.int32()), ("file", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("path", pa.string()), ("start", pa.int64())]))

    return write


def in_order(runs: Iterable[Run]) -> dict[int, list[Run]]:
    """The runs of each source by file and row; runs that overlap can't be put in order."""
    out: dict[int, list[Run]] = {}
    for run in sorted(runs, key=lambda r: (r.half, r.file, r.first)):
        own = out.setdefault(run.half, [])
        if own and own[-1].file == run.file and own[-1].last >= run.first:
            raise Refusal(f"{run.file} is not read in row order", "ERROR")
        own.append(run)
    return out


def read_runs(runs: list[Run]) -> Iterator[pa.RecordBatch]:
    for run in runs:
        with pa.OSFile(run.path) as file:
            file.seek(run.start)
            with pa.ipc.open_stream(file) as stream:
                yield from stream


def grouped(batches: Iterable[pa.RecordBatch], rows: int = GROUP_ROWS) -> Iterator[pa.Table]:
    """Tables of `rows` rows, the last of what is left."""
    held, n = [], 0
    for batch in batches:
        while n + batch.num_rows >= rows:
            yield pa.Table.from_batches([*held, batch.slice(0, rows - n)]).combine_chunks()
            batch, held, n = batch.slice(rows - n), [], 0
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
