"""One large file of cases, read by many tasks.

Where a case begins is only known when the counts of all cases before it are: a chain through the
whole file.  It is cut as follows.

1. Lines are numbered: rows of a file's blocks are counted, and a block's first line is the sum of the
   blocks before it.
2. Lines fall into chunks.  A task follows, from every line of its chunk, where a case that began there
   would lead: from the last line to the first, each line looks at one that is done.  So
   each line knows its exit, the first line after the chunk that a case (or part of one) begins at.
3. Exits are the only lines at which a later chunk can be entered.  Hops from chunk to chunk are joined with
   themselves, so that after k rounds they pass 2^k chunks and 2^k true entries are known.
4. Each chunk walks from its one true entry and labels its lines with case, part of the layout and place in it.
   Lines and sections are then split and cast by built-in functions.

Layouts: a part of a case is some lines followed by sections whose counts read integers of these lines.  Values are
integers, reals and strings, one array in a line, and arrays or graphs in sections.  Others are read
by `layout.read_cases`, a file in one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.errors import ConfigurationError, PlumblineError
from plumbline.functions.expr import HIGH, LOW, Expression
from plumbline.operators.graphs import shared_folder
from plumbline.operators.specs import Array, Graph, Integer, Real, Spec, String
from plumbline.plans.problem import Problem
from plumbline.session import ship
from plumbline.sources.layout import _INTEGER, Layout, Line, Literal, Multiline, cell_value, checked

CHUNK_LINES = 1 << 16


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value, n_lines, whole): lines numbered from 0, how many the file has, and whether the last ends with a newline."""
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("bytes"), "value")
    raw = raw.withColumn("id", F.monotonically_increasing_id())
    blocks = raw.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.sum(F.octet_length("value").cast("long") + 1).alias("seen"), F.max("bytes").alias("bytes"))
    each = Window.partitionBy("file")
    before = F.coalesce(F.sum("n").over(each.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", "first", before.alias("before"), F.sum("n").over(each).alias("n_lines"), (F.sum("seen").over(each) == F.max("bytes").over(each)).alias("whole"))
    out = raw.drop("bytes").join(blocks, ["file", "block"])
    return out.select("file", (F.col("id") - F.col("first") + F.col("before")).alias("line"), "value", "n_lines", "whole")


@dataclass(frozen=True)
class Phase:
    """Lines, and the sections whose counts they hold; first is the place of its first part in the layout's body."""

    first: int
    lines: tuple[Line, ...]
    sections: tuple[Multiline, ...]
    #: (line, cell) of each variable that a count reads.
    places: tuple[tuple[str, int, int], ...]

    def counts(self, values: list[str]) -> list[int] | None:
        """Lines of each section, from the phase's lines; None where they do not say."""
        known = {}
        for name, line, cell in self.places:
            cells = values[line].split(" ")
            if cell >= len(cells) or not _INTEGER.match(cells[cell]) or not LOW <= int(cells[cell]) <= HIGH:
                return None
            known[name] = int(cells[cell])
        try:
            out = [Expression(s.count).value(known) for s in self.sections]
        except PlumblineError:
            return None
        return out if all(n >= 0 for n in out) else None


def phases_of(problem: Problem, layout: Layout) -> list[Phase]:
    out: list[list] = []
    for i, part in enumerate(layout.body):
        if isinstance(part, Line):
            if not out or out[-1][2]:
                out.append([i, [], []])
            out[-1][1].append(part)
        else:
            if not out:
                out.append([i, [], []])
            out[-1][2].append(part)
    made = []
    for first, lines, sections in out:
        names = sorted({n for s in sections for n in Expression(s.count).names})
        places = []
        for name in names:
            at = [(i, j) for i, line in enumerate(lines) for j, t in enumerate(line.tokens) if t == name and all(isinstance(x, Literal) or not isinstance(problem.variables[x], Array) for x in line.tokens[:j])]
            if not at or not isinstance(problem.variables[name], Integer):
                raise ConfigurationError(f"the count {name} must be an integer on a line right before its section")
            places.append((name, *at[0]))
        made.append(Phase(first, tuple(lines), tuple(sections), tuple(places)))
    return made


STEP = "file string, line long, phase int, to_line long, to_phase int, cases long, last_line long, last_phase int, counts array<long>"


def _steps(phases: list[Phase], chunk_lines: int):
    """Of a chunk: every line and phase with its exit, the cases that begin from it on, the last part that begins, and the counts there."""
    names = [x.split()[0] for x in STEP.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        file, chunk = (k.as_py() for k in key)
        lines = dict(zip(table.column("line").to_pylist(), table.column("value").to_pylist(), strict=True))
        end = table.column("end")[0].as_py()
        stop = min((chunk + 1) * chunk_lines, end)
        done: dict[tuple[int, int], tuple] = {}
        rows = []
        for at in range(stop - 1, -1, -1):
            if at < chunk * chunk_lines or at not in lines:
                break
            for k, phase in enumerate(phases):
                n = len(phase.lines)
                counts = phase.counts([lines[at + i] for i in range(n)]) if at + n <= end and all(at + i in lines for i in range(n)) else None
                # A part without lines and counts of nothing would stay where it is.
                after = None if counts is None else (at + n + sum(counts), (k + 1) % len(phases))
                if after is None or (after[0] == at and after[1] <= k):
                    done[at, k] = (None, None, int(k == 0), at, k)
                elif after[0] >= stop or after[0] == at:
                    done[at, k] = (*after, int(k == 0), at, k)
                else:
                    to, to_phase, cases, last, last_phase = done[after]
                    done[at, k] = (to, to_phase, cases + (k == 0), last, last_phase)
                rows.append((file, at, k, *done[at, k], counts))
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def _kept(df: DataFrame, what: str) -> DataFrame:
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _entries(steps: DataFrame, start: DataFrame) -> DataFrame:
    """(file, line, phase, before): the places where the chain from start enters a chunk, and how many cases began before."""
    key = ["file", "line", "phase"]
    exits = steps.where("to_line is not null").select("file", F.col("to_line").alias("line"), F.col("to_phase").alias("phase")).unionByName(start.select(key)).distinct()
    hops = _kept(steps.join(exits, key, "left_semi").where("to_line is not null").select(*key, "to_line", "to_phase", F.col("cases").alias("n")), "hops")
    reached = _kept(start.select(*key, F.lit(0).cast("long").alias("before")), "entries")
    while True:
        more = reached.join(hops, key).select("file", F.col("to_line").alias("line"), F.col("to_phase").alias("phase"), (F.col("before") + F.col("n")).alias("before"))
        more = _kept(more, "entries")
        if more.isEmpty():
            return reached
        reached = _kept(reached.unionByName(more), "entries")
        then = hops.select("file", F.col("line").alias("to_line"), F.col("phase").alias("to_phase"), F.col("to_line").alias("x"), F.col("to_phase").alias("y"), F.col("n").alias("m"))
        hops = _kept(hops.join(then, ["file", "to_line", "to_phase"]).select(*key, F.col("x").alias("to_line"), F.col("y").alias("to_phase"), (F.col("n") + F.col("m")).alias("n")), "hops")


LABELLED = "file string, case long, part int, idx long, line long, value string"


def _label(phases: list[Phase]):
    """Of a chunk and its entry: each line with its case, its part of the layout and its place there; a line that no case has is of case 0."""

    def run(key: tuple, table: pa.Table, entry: pa.Table) -> pa.Table:
        file, chunk = key[0].as_py(), key[1].as_py()
        lines = dict(zip(table.column("line").to_pylist(), table.column("value").to_pylist(), strict=True))
        own = sorted(a for a, c in zip(table.column("line").to_pylist(), table.column("own").to_pylist(), strict=True) if c == chunk)
        out: list[tuple] = []
        begun = entry.to_pylist()[0] if entry.num_rows else None

        def put(at: int, start: int, k: int, case: int, counts: list[int]) -> None:
            phase, off = phases[k], at - start
            if off < len(phase.lines):
                out.append((case, phase.first + off, 0, at))
                return
            off -= len(phase.lines)
            for j, n in enumerate(counts):
                if off < n:
                    out.append((case, phase.first + len(phase.lines) + j, off, at))
                    return
                off -= n

        if own and begun:
            first, end = own[0], own[-1] + 1
            at, k, case = begun["line"], begun["phase"], begun["before"]
            if begun["last_line"] is not None:  # the part in which the chunk begins
                size = len(phases[begun["last_phase"]].lines) + sum(begun["counts"] or [])
                for i in range(first, min(end, begun["last_line"] + size)):
                    put(i, begun["last_line"], begun["last_phase"], case, begun["counts"])
            while at is not None and at < end:
                phase = phases[k]
                n = len(phase.lines)
                counts = phase.counts([lines[at + i] for i in range(n)]) if all(at + i in lines for i in range(n)) else None
                case += k == 0
                if counts is None:
                    out.append((case, -1, 0, at))
                    break
                for i in range(at, min(end, at + n + sum(counts))):
                    put(i, at, k, case, counts)
                if not n + sum(counts) and k + 1 == len(phases):
                    break
                at, k = at + n + sum(counts), (k + 1) % len(phases)
        columns = zip(*out, strict=True) if out else [[]] * 4
        case, part, idx, line = (list(c) for c in columns)
        return pa.table(
            [pa.array([file] * len(case), pa.string()), pa.array(case, pa.int64()), pa.array(part, pa.int32()), pa.array(idx, pa.int64()), pa.array(line, pa.int64()), pa.array([lines[i] for i in line], pa.string())],
            names=[x.split()[0] for x in LABELLED.split(", ")],
        )

    return run


def labelled(lines: DataFrame, phases: list[Phase], skip: int, rest: int, chunk_lines: int) -> tuple[DataFrame, DataFrame]:
    """The body's lines as LABELLED, and for each file (file, cases, at, n_lines): how many cases begin, and where the chain ends."""
    halo = max(len(p.lines) for p in phases)
    body = lines.where((F.col("line") >= skip) & (F.col("line") < F.col("n_lines") - rest)).select("file", "line", "value", (F.col("n_lines") - rest).alias("end"))
    own = F.shiftright("line", chunk_lines.bit_length() - 1)
    # The first lines of a chunk are also at hand in the one before, for parts that span the border.
    chunks = F.array_distinct(F.array(own, F.greatest(F.shiftright(F.col("line") - (halo - 1), chunk_lines.bit_length() - 1), F.lit(0).cast("long"))))
    body = _kept(body.select("*", own.alias("own"), F.explode(chunks).alias("chunk")), "lines")
    steps = _kept(body.groupBy("file", "chunk").applyInArrow(_steps(phases, chunk_lines), STEP), "steps")
    start = lines.groupBy("file").agg(F.max("n_lines").alias("n_lines")).select("file", F.lit(skip).cast("long").alias("line"), F.lit(0).alias("phase"), "n_lines")
    start = _kept(start, "start")
    entries = _kept(_entries(steps, start).join(start.select("file", (F.col("n_lines") - rest).alias("end")), "file"), "entries")
    known = entries.where("line < end").join(steps, ["file", "line", "phase"])
    known = _kept(known.select("file", own.alias("chunk"), "line", "phase", "before", "to_line", "to_phase", "last_line", "last_phase", (F.col("before") + F.col("cases")).alias("total")), "known")
    # What a chunk begins in: the last part that began in an earlier one.
    there = known.select("file", "chunk", F.col("last_line").alias("l"), F.col("last_phase").alias("p"), F.col("total").alias("t"))
    every = body.select("file", F.col("own").alias("chunk")).distinct().join(there, ["file", "chunk"], "left")
    earlier = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    every = every.select("file", "chunk", *(F.last(c, ignorenulls=True).over(earlier).alias(n) for c, n in (("l", "last_line"), ("p", "last_phase"), ("t", "so_far"))))
    counts = steps.select("file", F.col("line").alias("last_line"), F.col("phase").alias("last_phase"), "counts")
    every = every.join(counts, ["file", "last_line", "last_phase"], "left").join(known.select("file", "chunk", "line", "phase", "before"), ["file", "chunk"], "left")
    every = _kept(every.withColumn("before", F.coalesce("before", "so_far", F.lit(0))), "chunks")
    made = body.groupBy("file", "chunk").cogroup(every.groupBy("file", "chunk")).applyInArrow(_label(phases), LABELLED)
    tail = known.groupBy("file").agg(F.max("total").alias("cases"), F.max_by("to_line", "line").alias("at"), F.max_by("to_phase", "line").alias("phase"), F.max_by("last_line", "line").alias("last"))
    return made, start.select("file", "n_lines").join(tail, "file", "left")


def _scalar(spec: Spec) -> bool:
    return isinstance(spec, (Integer, Real, String))


def _line_value(problem: Problem, line: Line, text: Column) -> tuple[Column, dict[str, Column]]:
    """Whether a line fits, and its variables."""
    cells = F.split(text, " ", -1)
    arrays = [i for i, t in enumerate(line.tokens) if not isinstance(t, Literal) and not _scalar(problem.variables[t])]
    if len(arrays) > 1 or any(not isinstance(problem.variables[line.tokens[i]], Array) or not _scalar(problem.variables[line.tokens[i]].element) or problem.variables[line.tokens[i]].separator != " " for i in arrays):
        raise ConfigurationError("a line holds single values and one array of such, separated by blanks")
    n = len(line.tokens)
    good = F.size(cells) >= n - 1 if arrays else F.size(cells) == n
    # An empty array leaves no cell; a line of its own is then empty, and others lack its blank.
    out = {}
    for i, t in enumerate(line.tokens):
        if arrays and i == arrays[0]:
            fits, made = _cells(problem.variables[t].element)
            mine = F.slice(cells, i + 1, F.greatest(F.size(cells) - (n - 1), F.lit(0)))
            mine = F.when((F.lit(n) == 1) & (text == ""), F.slice(cells, 1, 0)).otherwise(mine)
            good, out[t] = good & F.forall(mine, fits), F.transform(mine, made)
            continue
        cell = F.try_element_at(cells, F.lit(i + 1) if not arrays or i < arrays[0] else F.lit(i - n))
        if isinstance(t, Literal):
            good = good & (cell == t.text)
        else:
            fits, out[t] = cell_value(problem.variables[t], cell)
            good = good & fits
    return F.coalesce(good, F.lit(False)), out


def _cells(spec: Spec, at: int | None = None):
    """Two functions of a cell, or of a line with the cell at a place: whether it fits, and its value."""
    cell = lambda v: v if at is None else F.try_element_at(F.split(v, " ", -1), F.lit(at + 1))
    return (lambda v: cell_value(spec, cell(v))[0]), (lambda v: cell_value(spec, cell(v))[1])


def _edge(made: list, base: int):
    """A line's edge, from the functions that give its ends and its label."""
    return lambda v: F.struct((made[0](v) - base).alias("u"), (made[1](v) - base).alias("v"), *(f(v).alias("label") for f in made[2:]))


def _section_value(problem: Problem, section: Multiline, rows: Column) -> tuple[Column, dict[str, Column]]:
    """Whether a section's lines fit, and its variables, from its lines in order."""
    specs, width = [], 0
    for t in section.tokens:
        spec = problem.variables[t]
        if isinstance(spec, Graph) and spec.node_label is None and (spec.edge_label is None or _scalar(spec.edge_label)):
            size = 3 if spec.edge_label else 2
        elif isinstance(spec, Array) and _scalar(spec.element):
            size = 1
        else:
            raise ConfigurationError("sections hold arrays of single values and graphs")
        specs.append((t, spec, width))
        width += size
    tests, out = [], {}
    for t, spec, at in specs:
        if isinstance(spec, Array):
            fits, made = _cells(spec.element, at)
            tests.append(fits)
            out[t] = F.transform(rows, made)
        else:
            ends = [_cells(Integer(), at + j) for j in range(2)]
            label = [_cells(spec.edge_label, at + 2)] if spec.edge_label else []
            tests += [fits for fits, _ in ends + label]
            out[t] = F.transform(rows, _edge([made for _, made in ends + label], int(spec.one_based)))
    good = F.forall(rows, lambda v: reduce(lambda a, b: a & b, (f(v) for f in tests), F.size(F.split(v, " ", -1)) == width))
    return F.coalesce(good, F.lit(False)), out


def read_sections(spark: SparkSession, path: str, problem: Problem, layout: Layout, cases: int | None = None, strict: bool = True, style: str = "only_set_variables", chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """(file, case, variables, error) of all cases in the files of path, whatever a file's size.

    cases is how many a file must have, if it does not say so itself; None takes all that it has.  Values are validated as by
    `layout.read_cases`, whose rows these are.  With strict=False a case that does not fit has its error and no values, and a
    file whose cases do not add up has a row of case 0; else either stops the job.
    """
    if layout.flexible:
        raise ConfigurationError("flexible layouts are not made of lines")
    if chunk_lines & (chunk_lines - 1):
        raise ConfigurationError("chunk_lines must be a power of two")
    phases, names = phases_of(problem, layout), layout.names()
    lines = numbered_lines(ship(spark), path)
    skip, rest = len(layout.header) + layout.counted, len(layout.footer)
    made, files = labelled(lines, phases, skip, rest, chunk_lines)
    made = _kept(made, "labelled")

    value: dict[str, Column] = {}
    good, aggs = [F.lit(True)], [F.max(F.col("part") == -1).alias("stuck"), F.min("line").alias("line")]
    for i, part in enumerate(layout.body):
        mine = F.when(F.col("part") == i, F.col("value")) if isinstance(part, Line) else F.when(F.col("part") == i, F.struct("idx", "value"))
        aggs.append((F.max(mine) if isinstance(part, Line) else F.array_sort(F.collect_list(mine))).alias(f"p{i}"))
    rows = made.groupBy("file", "case").agg(*aggs)
    for i, part in enumerate(layout.body):
        if isinstance(part, Line):
            fits, got = _line_value(problem, part, F.col(f"p{i}"))
        else:
            fits, got = _section_value(problem, part, F.transform(f"p{i}", lambda x: x["value"]))
        good.append(fits)
        value.update(got)
    for n in names:
        if isinstance(problem.variables[n], Graph):
            count = problem.variables[n]._counts()[0]
            known = count.unique()
            nodes = F.lit(known).cast("long") if known is not None else _known_count(count, value)
            value[n] = F.struct(nodes.alias("num_nodes"), value[n].alias("edges"))
    fits = ~F.col("stuck") & reduce(lambda a, b: a & b, good)
    # Written, as the optimizer would else put the casts of all cells into each check of their values.
    rows = _kept(rows.select("file", "case", "line", fits.alias("fits"), *(value[n].cast(problem.variables[n].dtype).alias(n) for n in names)), "parsed")
    bad = F.concat(F.lit("the case that begins in line "), (F.col("line") + 1).cast("string"), F.lit(" does not follow its layout"))
    rows = rows.select("file", "case", *(F.when(F.col("fits"), F.col(f"`{n}`")).alias(n) for n in names), F.when(~F.col("fits"), bad).alias("error"))
    rows = checked(problem, rows, names, False, style)
    rows = rows.unionByName(_whole(lines, files, layout, cases).select("file", F.lit(0).cast("long").alias("case"), *(F.lit(None).cast(problem.variables[n].dtype).alias(n) for n in names), "error"))
    if not strict:
        return rows
    return rows.where(F.when(F.col("error").isNull(), True).otherwise(F.raise_error(F.col("error")).cast("boolean")))


def _known_count(count: Integer, value: dict[str, Column]) -> Column:
    """A number of nodes that is one of the case's values."""
    from plumbline.operators import constraints as C

    options = [o for c in count.find(C.OneOf) for o in c.options if isinstance(o, Expression) and len(c.options) == 1]
    if not options:
        raise ConfigurationError("a graph's number of nodes must be known before it is read")
    return options[0].column(value)


def _whole(lines: DataFrame, files: DataFrame, layout: Layout, cases: int | None) -> DataFrame:
    """(file, error) of files whose lines do not add up."""
    skip, rest = len(layout.header) + layout.counted, len(layout.footer)
    fixed = [(F.lit(i).cast("long"), " ".join(t.text for t in p.tokens)) for i, p in enumerate(layout.header)]
    fixed += [(F.col("n_lines") - rest + i, " ".join(t.text for t in p.tokens)) for i, p in enumerate(layout.footer)]
    off = reduce(lambda a, b: a | b, ((F.col("line") == at) & (F.col("value") != text) for at, text in fixed), F.lit(False))
    says = F.when(F.col("line") == len(layout.header), F.col("value")) if layout.counted else F.lit(None).cast("string")
    each = lines.groupBy("file").agg(F.max(off).alias("off"), F.max("whole").alias("whole"), F.max(says).alias("says"))
    number = F.when(F.col("says").rlike(r"\A(0|[1-9][0-9]*)\z"), F.col("says").try_cast("bigint")) if layout.counted else F.lit(cases).cast("long")
    both = each.join(files, "file").withColumn("cases", F.coalesce("cases", F.lit(0).cast("long"))).withColumn("number", number)
    end = F.col("n_lines") - rest
    stuck = F.concat(F.lit("the lines of the cases do not end where the file's do; the last part that could be read begins in line "), (F.coalesce("last", F.lit(skip - 1).cast("long")) + 1).cast("string"))
    error = (
        F.when(~F.col("whole"), "expected a newline at the end of the file")
        .when(F.col("off") | (end < skip), "the header or footer does not follow its layout")
        .when(F.lit(layout.counted) & F.col("number").isNull(), "expected the number of cases")
        .when((end > skip) & ~((F.col("at") == end) & (F.col("phase") == 0)).eqNullSafe(F.lit(True)), stuck)
        .when(F.col("number").isNotNull() & (F.col("number") != F.col("cases")), F.concat(F.lit("expected "), F.col("number").cast("string"), F.lit(" cases, but got "), F.col("cases").cast("string")))
    )
    return both.select("file", error.alias("error")).where("error is not null")
