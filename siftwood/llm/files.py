"""Files that executors write and read in the shared folder: temporary names, then a rename."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    system, path = _at(uri)
    system.create_dir(path, recursive=True)


def commit(uri: str, data: bytes) -> None:
    """Write a file under a temporary name beside its place and move it there.

    A repeated or speculative attempt writes the same bytes to the same place, so whichever move
    comes last leaves a whole file.
    """
    system, path = _at(uri)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(temporary, compression=None) as out:
        out.write(data)
    system.move(temporary, path)


def read(uri: str) -> bytes:
    system, path = _at(uri)
    with system.open_input_stream(path, compression=None) as f:
        return f.read()


def read_range(uri: str, start: int, size: int) -> bytes:
    system, path = _at(uri)
    with system.open_input_file(path) as f:
        f.seek(start)
        return f.read(size)


def readers(n: int) -> int:
    """Tasks for reading n files: one a file, up to a number that any driver schedules easily."""
    return max(1, min(n, 20_000))
