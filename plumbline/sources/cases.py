"""Files of cases as a data source of Spark: `spark.read.format(name)` and `df.write.format(name)`.

A format belongs to a problem and its layouts; `register` makes it known to a session by name.

Reading plans tasks from the sizes of the files: small files share a task, up to `task_bytes`.  A file is
parsed strictly, whole, by the task that has it; one file of many cases is for `sections.read_sections`.
Writing takes rendered rows (gen, call, idx, input, answer), a file or two for each.  A task writes under
names of its own attempt and lists them in files beside them, whose names are its commit message.  When all tasks have
ended, the driver gives the files their names and lists them in `_cases`; if the job fails it deletes them.  So lost executors
and repeated tasks leave nothing that a reader sees.

The driver never holds all names: it merges the tasks' sorted lists, looks for names that meet before it moves a file, and moves
files a block at a time.  For reading, a listing is sorted through its disk, and a task's names travel compressed.
Only local folders are listed entry by entry; of other file systems, the entries of one folder are held at once.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import batched
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from plumbline.errors import ConfigurationError, ReadError
from plumbline.plans.problem import Problem
from plumbline.session import ship
from plumbline.sources import runs
from plumbline.sources.layout import Layout, checked, parse, rendered

TASK_BYTES, TASK_FILES = 32_000_000, 2000
#: Threads that move files, and files of a block.
MOVES, BLOCK = 16, 8000
#: Rows of a batch that is read, and bytes of its texts.
BATCH_ROWS, BATCH_BYTES = 1000, 4_000_000


@dataclass
class Files(InputPartition):
    """Names below the path, compressed; an empty one is the path itself."""

    names: bytes

    @classmethod
    def of(cls, names: list[str]) -> Files:
        return cls(zlib.compress(json.dumps(names).encode()))

    def listed(self) -> list[str]:
        return json.loads(zlib.decompress(self.names))


@dataclass
class Written(WriterCommitMessage):
    """Names of the sorted lists (name, temporary name) of a task's files."""

    lists: list[str]


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """A URI's file system and path; a path without a scheme is local."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.rstrip("/") or path)


def entries(fs: pafs.FileSystem, folder: str) -> Iterator[pafs.FileInfo]:
    if not isinstance(fs, pafs.LocalFileSystem):
        yield from fs.get_file_info(pafs.FileSelector(folder))
        return
    with os.scandir(folder) as found:
        for part in batched((x.path for x in found), runs.LINE):
            yield from fs.get_file_info(list(part))


def listed(fs: pafs.FileSystem, top: str) -> Iterator[tuple[str, int]]:
    """(name below top, size) of all files below top."""
    opened = [("", entries(fs, top))]
    while opened:
        below, rest = opened[-1]
        for x in rest:
            if x.type == pafs.FileType.Directory:
                opened.append((f"{below}{x.base_name}/", entries(fs, x.path)))
                break
            if x.type == pafs.FileType.File:
                yield below + x.base_name, x.size
        else:
            opened.pop()


def packed(files: Iterable[tuple[str, int]], most_bytes: int, most_files: int = TASK_FILES, kept: Callable[[list[str]], Any] = list) -> list:
    """Files in order of their names, in runs of at most most_bytes (or one file), each as kept makes it."""
    out, names, size = [], [], 0
    for name, n in runs.arranged(files):
        if names and (size + n > most_bytes or len(names) == most_files):
            out.append(kept(names))
            names, size = [], 0
        names.append(name)
        size += n
    return [*out, kept(names)] if names else out


class CaseReader(DataSourceReader):
    def __init__(self, problem: Problem, layout: Layout, options: dict, schema: T.StructType):
        self.problem, self.layout, self.options, self.schema = problem, layout, options, schema

    def partitions(self) -> list[Files]:
        fs, top = located(self.options["path"])
        end = self.options.get("suffix", ".in")
        info = fs.get_file_info(top)
        found = [("", info.size)] if info.type == pafs.FileType.File else listed(fs, top)
        files = (x for x in found if (path := x[0] or top).endswith(end) and not path.rpartition("/")[2].startswith(("_", ".")))
        return packed(files, int(self.options.get("task_bytes", TASK_BYTES)), kept=Files.of)

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fs, top = located(self.options["path"])
        kinds, names = to_arrow_schema(self.schema), self.schema.names
        strict, cases = self.options.get("strict", "true").lower() == "true", int(self.options.get("cases", 1))
        batch = lambda rows: pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=kinds)
        rows, size = [], 0
        for below in partition.listed() if partition is not None else ():  # Spark gives None where there is no file
            with fs.open_input_stream(f"{top}/{below}" if below else top) as f:
                text = f.read().decode()
            name = below or top.rpartition("/")[2]
            try:
                rows += [{"file": name, "case": i + 1, **r} for i, r in enumerate(parse(text, self.problem, self.layout, cases))]
            except ReadError as e:
                if strict:
                    raise
                rows.append({"file": name, "case": 0, "error": str(e)})
            size += len(text)
            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)


class CaseWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.options = options

    def write(self, iterator: Iterator) -> Written:
        fs, top = located(self.options["path"])
        pattern, attempt, done, lists, made = self.options.get("pattern", "{gen}_{call}_{idx}"), uuid.uuid4().hex, [], [], set()
        fs.create_dir(top, recursive=True)

        def note() -> None:
            lists.append(f"_cases-{attempt}-{len(lists)}")
            runs.write_run(fs, f"{top}/{lists[-1]}", sorted(done))
            done.clear()

        for row in iterator:
            stem = pattern.format(**row.asDict())
            folder = stem.rpartition("/")[0]
            if folder and folder not in made:
                fs.create_dir(f"{top}/{folder}", recursive=True)
                made.add(folder)
            for end, text in ((".in", row["input"]), (".ans", row["answer"])):
                if text is not None:
                    with fs.open_output_stream(f"{top}/{stem}{end}.{attempt}") as f:
                        f.write(text.encode())
                    done.append((stem + end, f"{stem}{end}.{attempt}"))
            if len(done) >= runs.RUN:
                note()
        if done:
            note()
        return Written(lists)

    def commit(self, messages: list) -> None:
        fs, top = located(self.options["path"])
        scratch = f"{top}/_cases-{uuid.uuid4().hex}"
        lists = [f"{top}/{x}" for m in messages if m is not None for x in m.lists]

        def apart() -> Iterator[list]:
            last = None
            for row in runs.merged(fs, lists, scratch):
                if row[0] == last:  # Spark then aborts
                    raise ConfigurationError("two cases have one file name: the pattern must name all that tells cases apart")
                last = row[0]
                yield row

        def move(rows: tuple) -> None:
            for name, written in rows:
                fs.move(f"{top}/{written}", f"{top}/{name}")

        fs.create_dir(scratch, recursive=True)
        try:
            moves = runs.write_run(fs, f"{scratch}/moves", apart())
            with ThreadPoolExecutor(MOVES) as pool:
                for block in batched(runs.read_run(fs, moves), BLOCK):
                    list(pool.map(move, batched(block, -(-len(block) // MOVES))))
            with fs.open_output_stream(f"{top}/_cases") as f:
                for block in batched(runs.read_run(fs, moves), BLOCK):
                    f.write("".join(f"{name}\n" for name, _ in block).encode())
        finally:
            fs.delete_dir(scratch)
        for path in lists:
            fs.delete_file(path)

    def abort(self, messages: list) -> None:
        fs, top = located(self.options["path"])
        for path in (f"{top}/{x}" for m in messages if m is not None for x in m.lists):
            for _, name in runs.read_run(fs, path):
                if fs.get_file_info(f"{top}/{name}").type == pafs.FileType.File:
                    fs.delete_file(f"{top}/{name}")
            fs.delete_file(path)


class CaseFormat(DataSource):
    """Subclasses, made by `register`, have a problem, the types of its variables (which only a session can parse) and a name."""

    problem: Problem
    kinds: dict[str, T.DataType]
    title: str

    @classmethod
    def name(cls) -> str:
        return cls.title

    def layout(self) -> Layout:
        out = self.problem.output if self.options.get("which", "input") == "output" else self.problem.input
        if out is None:
            raise ConfigurationError("the problem has no such layout")
        return out

    def schema(self) -> T.StructType:
        out = T.StructType().add("file", "string").add("case", "long")
        for n in self.layout().names():
            out = out.add(n, self.kinds[n])
        return out.add("error", "string")

    def reader(self, schema: T.StructType) -> CaseReader:
        return CaseReader(self.problem, self.layout(), dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> CaseWriter:
        if not {"input", "answer"} <= set(schema.names):
            raise ConfigurationError("rows to write are those of `rendered`: names, input and answer")
        return CaseWriter(dict(self.options))


def register(spark: SparkSession, problem: Problem, name: str = "cases") -> str:
    """Makes a problem's files known to the session as the format `name`; its layouts are the problem's."""
    ship(spark)
    used = {n for x in (problem.input, problem.output) if x is not None for n in x.names()}
    kinds = {n: T.DataType.fromDDL(problem.variables[n].dtype) for n in used}
    spark.dataSource.register(type("Cases", (CaseFormat,), {"problem": problem, "kinds": kinds, "title": name, "__module__": __name__}))
    return name


def save(problem: Problem, cases: DataFrame, path: str, name: str = "cases", pattern: str = "{gen}_{call}_{idx}") -> None:
    """Writes a file for each case, and one for its answer where all output values are set."""
    rendered(problem, cases).write.format(register(cases.sparkSession, problem, name)).option("pattern", pattern).mode("append").save(path)


def load(spark: SparkSession, problem: Problem, path: str, name: str = "cases", strict: bool = True, style: str = "only_set_variables", **options) -> DataFrame:
    """(file, case, variables, error) of the files in path, validated as `layout.read_cases` does."""
    reader = spark.read.format(register(spark, problem, name)).options(strict=str(strict).lower(), **{k: str(v) for k, v in options.items()})
    rows = reader.load(path)
    return checked(problem, rows, [c for c in rows.columns if c not in ("file", "case", "error")], strict, style)
