"""Publication that never overwrites: a finished file or directory takes its name in one rename."""

from __future__ import annotations

import ctypes
import errno
import os
import tempfile
from pathlib import Path

from tributary.errors import Conflicted, LimitExceeded, Refusal, Unsupported
from tributary.plans.documents import canonical
from tributary.plans.records import Limits
from tributary.sources.parquet import checked_directory

#: Linux: rename relative to the working directory, and only to a free name.
AT_FDCWD, RENAME_NOREPLACE = -100, 1


def rename_noreplace(old: Path, new: Path) -> None:
    try:
        call = ctypes.CDLL(None, use_errno=True).renameat2
    except (OSError, AttributeError):
        raise Unsupported("this platform has no rename that refuses to replace") from None
    if call(AT_FDCWD, os.fsencode(old), AT_FDCWD, os.fsencode(new), RENAME_NOREPLACE):
        code = ctypes.get_errno()
        if code in (errno.EEXIST, errno.ENOTEMPTY):
            raise Conflicted(f"{new} exists; nothing was changed")
        if code in (errno.EINVAL, errno.ENOSYS, errno.EXDEV):
            raise Unsupported(f"no rename without replacement here: {os.strerror(code)}")
        raise OSError(code, os.strerror(code), str(new))


def probe_noreplace(parent: Path) -> None:
    """Shows on this file system that taken names are refused, for files and for directories."""
    with tempfile.TemporaryDirectory(prefix=".tributary-probe-", dir=parent) as name:
        for make in (lambda p: p.touch(), lambda p: p.mkdir()):
            a, b = Path(name, "a"), Path(name, "b")
            make(a), make(b)
            try:
                rename_noreplace(a, b)
            except Conflicted:
                pass
            else:
                raise Unsupported("a rename replaced its target here")
            b.rmdir() if b.is_dir() else b.unlink()
            rename_noreplace(a, b)
            b.rmdir() if b.is_dir() else b.unlink()


def free_name(destination: Path, protected: list[Path]) -> Path:
    """The destination, absolute, if it is free and neither in nor around a protected path."""
    plain = Path(os.path.abspath(destination))
    for p in protected:
        real = Path(os.path.realpath(p))
        if plain == real or plain in real.parents or real in plain.parents:
            raise Conflicted(f"{destination} overlaps {p}")
    out = checked_directory(Path(destination).absolute().parent) / Path(destination).name
    if os.path.lexists(out):
        raise Conflicted(f"{out} exists; nothing was changed")
    return out


def publish_document(value: dict, destination: Path, protected: list[Path], limits: Limits | None = None) -> None:
    raw = canonical(value)
    if len(raw) > (limits or Limits()).max_plan_bytes:
        raise LimitExceeded("the document is too large")
    target = free_name(destination, protected)
    probe_noreplace(target.parent)
    handle, name = tempfile.mkstemp(prefix=".tributary-", dir=target.parent)
    try:
        with os.fdopen(handle, "wb") as file:
            file.write(raw)
            file.flush()
            os.fsync(file.fileno())
        rename_noreplace(Path(name), target)
    finally:
        Path(name).unlink(missing_ok=True)


def publish_directory(staging: Path, destination: Path, protected: list[Path]) -> None:
    target = free_name(destination, [*protected, staging])
    if os.stat(staging).st_dev != os.stat(target.parent).st_dev:
        raise Refusal("a dataset is published on the file system it was staged on", "UNSUPPORTED")
    probe_noreplace(target.parent)
    rename_noreplace(staging, target)
