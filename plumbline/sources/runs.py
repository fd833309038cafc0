"""Lists that need not fit into memory: rows sorted in runs of bounded length, written to files and merged.

A row is a list of strings and integers.  A file has a JSON list of rows in each of its lines.
"""

from __future__ import annotations

import io
import json
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from heapq import merge
from itertools import batched, chain

import pyarrow.fs as pafs

#: Rows of a run, rows of a line, files that are merged at once.
RUN, LINE, WAYS = 50_000, 500, 64


def write_run(fs: pafs.FileSystem, path: str, rows: Iterable[list]) -> str:
    with fs.open_output_stream(path) as f:
        for part in batched(rows, LINE):
            f.write(json.dumps(part).encode() + b"\n")
    return path


def read_run(fs: pafs.FileSystem, path: str) -> Iterator[list]:
    with io.TextIOWrapper(fs.open_input_stream(path), "ascii", newline="\n") as f:
        for line in f:
            yield from json.loads(line)


def merged(fs: pafs.FileSystem, paths: list[str], scratch: str) -> Iterator[list]:
    """The rows of sorted files in order, by way of files of scratch where there are more than WAYS; these are the caller's to delete."""
    while len(paths) > WAYS:
        paths = [write_run(fs, f"{scratch}/{uuid.uuid4().hex}", merge(*(read_run(fs, p) for p in part))) for part in batched(paths, WAYS)]
    return merge(*(read_run(fs, p) for p in paths))


def arranged(rows: Iterable[list]) -> Iterator[list]:
    """Rows in order, more than RUN of them by way of files on the local disk."""
    parts = batched(rows, RUN)
    first = sorted(next(parts, ()))
    if len(first) < RUN:
        yield from first
        return
    fs = pafs.LocalFileSystem()
    with tempfile.TemporaryDirectory(prefix="plumbline-") as scratch:
        yield from merged(fs, [write_run(fs, f"{scratch}/{i}", part) for i, part in enumerate(chain([first], map(sorted, parts)))], scratch)
