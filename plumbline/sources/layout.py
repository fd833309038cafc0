"""Line-oriented text: layouts, a strict reader and a writer.

Writing is built-in expressions: each case becomes one string column.  Reading takes the
single-line layouts through native splitting and checked casts; layouts with sections whose
length depends on values read before are parsed file by file inside executors.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.errors import ConfigurationError, ReadError, WriteError
from plumbline.functions.expr import LOW, HIGH, Expression
from plumbline.operators import constraints as C
from plumbline.operators.specs import Array, Graph, Integer, Nothing, Real, Spec, String, Tuple, Variant
from plumbline.plans.problem import Problem

INTEGER = r"\A(0|-?[1-9][0-9]*)\z"
_INTEGER, _LOOSE = re.compile(r"(0|-?[1-9][0-9]*)\Z"), re.compile(r"[+-]?\d+\Z")


@dataclass(frozen=True)
class Literal:
    text: str


@dataclass(frozen=True)
class Line:
    tokens: tuple

    def __init__(self, *tokens):
        object.__setattr__(self, "tokens", tokens)


@dataclass(frozen=True)
class Multiline:
    """count lines, the variables' elements side by side."""

    count: str
    tokens: tuple

    def __init__(self, count: str, *tokens):
        object.__setattr__(self, "count", str(count))
        object.__setattr__(self, "tokens", tokens)


@dataclass(frozen=True)
class Layout:
    body: tuple
    header: tuple = ()
    footer: tuple = ()
    counted: bool = False
    flexible: bool = False
    options: dict = field(default_factory=dict)

    def __post_init__(self):
        for part in (*self.header, *self.footer):
            if any(not isinstance(t, Literal) for t in part.tokens):
                raise ConfigurationError("headers and footers hold literals only")

    def names(self) -> tuple[str, ...]:
        """Variables printed or used as line counts."""
        out = set()
        for part in self.body:
            out |= {t for t in part.tokens if isinstance(t, str)}
            if isinstance(part, Multiline):
                out |= set(Expression(part.count).names)
        return tuple(sorted(out))


# Writing


def real_text(value: Column, digits: int) -> Column:
    """The exact binary value, rounded half to even, as the C library prints it."""

    @F.pandas_udf("string")
    def show(v):
        return v.map(lambda x: None if x != x else format(x, f".{digits}f"))

    return show(value)


def real_depth(spec: Spec) -> int:
    """Arrays around a real; 0 for any other spec."""
    if isinstance(spec, Array):
        inner = 1 if isinstance(spec.element, Real) else real_depth(spec.element)
        return inner + (not isinstance(spec.element, Real)) * (inner > 0)
    return 0


def real_items(spec: Array, value: Column) -> Column:
    """The texts of an array's items, where these are reals or arrays of reals: a Python function takes whole arrays, as none can stand inside an array's function."""

    def text(s: Spec, x) -> str:
        return format(x, f".{s.format.digits}f") if isinstance(s, Real) else s.separator.join(text(s.element, y) for y in x)

    @F.pandas_udf("array<string>")
    def show(v):
        return v.map(lambda xs: None if xs is None else [text(spec.element, x) for x in xs])

    return show(value)


def text_of(spec: Spec, value: Column) -> Column:
    """One value as text; arrays and tuples are joined by their separators."""
    if isinstance(spec, Real):
        return real_text(value, spec.format.digits)
    if real_depth(spec):
        return F.array_join(real_items(spec, value), spec.separator)
    if isinstance(spec, Array):
        return F.array_join(F.transform(value, lambda x: text_of(spec.element, x)), spec.separator)
    if isinstance(spec, Variant):
        out = F.lit(None).cast("string")
        for i, p in enumerate(spec.parts):
            shown = F.lit(spec.tags[i]) if isinstance(p, Nothing) else F.concat_ws(spec.separator, F.lit(spec.tags[i]), text_of(p, value[f"_{i}"]))
            out = F.when(value["tag"] == i, shown).otherwise(out)
        return out
    if isinstance(spec, Tuple):
        return F.concat_ws(spec.separator, *(text_of(p, value[f"_{i}"]) for i, p in enumerate(spec.parts)))
    return value.cast("string")


def pieces_of(spec: Spec, value: Column) -> Column:
    """The lines that a value gives to a multiline section."""
    if isinstance(spec, Graph):
        base = 1 if spec.one_based else 0
        cells = lambda e: [(e["u"] + base).cast("string"), (e["v"] + base).cast("string"), *([text_of(spec.edge_label, e["label"])] if spec.edge_label else [])]
        return F.transform(value["edges"], lambda e: F.concat_ws(" ", *cells(e)))
    if not isinstance(spec, Array):
        raise ConfigurationError("only arrays and graphs fill several lines")
    if real_depth(spec):
        return real_items(spec, value)
    return F.transform(value, lambda x: text_of(spec.element, x))


def case_text(problem: Problem, layout: Layout) -> Column:
    """A case as text, each line ended by a newline."""
    out = []
    for part in layout.body:
        if isinstance(part, Line):
            shown = [F.lit(t.text) if isinstance(t, Literal) else text_of(problem.variables[t], F.col(f"`{t}`")) for t in part.tokens]
            out += [F.concat_ws(" ", *shown), F.lit("\n")]
        else:
            n = Expression(part.count).column()
            zipped = F.arrays_zip(*(pieces_of(problem.variables[t], F.col(f"`{t}`")).alias(f"_{i}") for i, t in enumerate(part.tokens)))
            lines = F.transform(zipped, lambda z: F.concat(F.concat_ws(" ", *(z[f"_{i}"] for i in range(len(part.tokens)))), F.lit("\n")))  # noqa: B023
            ok = F.size(lines) == n
            out.append(F.when(ok, F.array_join(lines, "")).otherwise(F.raise_error(F.lit("a value has not as many lines as its section"))))
    return F.concat(*out)


def render(problem: Problem, layout: Layout, cases: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text) of each case; unset values are errors."""
    unset = [F.col(f"`{n}`").isNull() for n in layout.names()]
    text = case_text(problem, layout)
    for n, bad in zip(layout.names(), unset, strict=True):
        text = F.when(bad, F.raise_error(F.lit(f"{n} has no value"))).otherwise(text)
    return cases.select(*keys, text.alias("text"))


def _once(parts: tuple) -> str:
    return "".join(" ".join(t.text for t in p.tokens) + "\n" for p in parts)


def rendered(problem: Problem, cases: DataFrame) -> DataFrame:
    """(gen, call, idx as far as cases have them, input, answer): texts of whole files; answer is null where an output value is unset."""
    keys = [c for c in ("gen", "call", "idx") if c in cases.columns]
    parts = [F.lit(_once(problem.input.header)), F.lit("1\n" if problem.input.counted else ""), case_text(problem, problem.input), F.lit(_once(problem.input.footer))]
    answer = F.lit(None).cast("string")
    if problem.output is not None and problem.output.names():
        complete = F.lit(True)
        for n in problem.output.names():
            complete = complete & (F.col(f"`{n}`").isNotNull() if n in cases.columns else F.lit(False))
        if all(n in cases.columns for n in problem.output.names()):
            answer = F.when(complete, F.concat(F.lit(_once(problem.output.header)), case_text(problem, problem.output), F.lit(_once(problem.output.footer))))
    return cases.select(*keys, F.concat(*parts).alias("input"), answer.alias("answer"))


def write_cases(problem: Problem, cases: DataFrame, folder: str, pattern: str = "{gen}_{call}_{idx}") -> DataFrame:
    """Writes a file for each case, .in and, where all output values are set, .ans; returns the names (file).

    Files are written by the tasks that hold the cases, once, each attempt through a temporary name of
    its own; folder must be seen by all executors.  The names are kept beside them, in _names.
    """
    rows = rendered(problem, cases)
    keys = [c for c in rows.columns if c not in ("input", "answer")]

    def put(batches: Iterator) -> Iterator:
        import pyarrow.fs as pafs

        fs, top = pafs.FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        for frame in batches:
            names, attempt = [], uuid.uuid4().hex
            for row in frame.itertuples(index=False):
                stem = pattern.format(**{k: getattr(row, k) for k in keys})
                for end, text in ((".in", row.input), (".ans", row.answer)):
                    if isinstance(text, str):
                        if "/" in stem:
                            fs.create_dir(f"{top}/{stem.rpartition('/')[0]}", recursive=True)
                        with fs.open_output_stream(f"{top}/{stem}{end}.{attempt}") as f:
                            f.write(text.encode())
                        fs.move(f"{top}/{stem}{end}.{attempt}", f"{top}/{stem}{end}")
                        names.append(stem + end)
            import pandas as pd

            yield pd.DataFrame({"file": names})

    rows.mapInPandas(put, "file string").write.mode("overwrite").parquet(f"{folder}/_names")
    return cases.sparkSession.read.schema("file string").parquet(f"{folder}/_names")


# Reading


class Cursor:
    """A text with a place; errors say line, token and column."""

    def __init__(self, text: str, flexible: bool = False):
        self.text, self.at, self.flexible = text, 0, flexible
        self.line, self.token, self.line_start = 1, 1, 0

    def fail(self, why: str, at: int | None = None):
        at = self.at if at is None else at
        begin = max(self.line_start, at - 30)
        end = self.text.find("\n", at)
        part = self.text[begin : min(at + 30, len(self.text) if end < 0 else end)]
        raise ReadError(why, self.line, self.token, at - self.line_start + 1, f"{part}\n{' ' * (at - begin)}^")

    def _step(self) -> None:
        if self.text[self.at] == "\n":
            self.line, self.token, self.line_start = self.line + 1, 1, self.at + 1
        self.at += 1

    def peek(self) -> str | None:
        """The token that starts here, without taking it; None at white space and at the end."""
        end = self.at
        while end < len(self.text) and not self.text[end].isspace():
            end += 1
        return self.text[self.at : end] or None

    def word(self) -> str:
        while self.flexible and self.at < len(self.text) and self.text[self.at].isspace():
            self._step()
        start = self.at
        while self.at < len(self.text) and not self.text[self.at].isspace():
            self.at += 1
        if start == self.at:
            self.fail("expected a token, but got " + ("the end of the file" if self.at == len(self.text) else "white space"))
        self.token += 1
        return self.text[start : self.at]

    def integer(self) -> int:
        word = self.word()
        good = _LOOSE.match(word) if self.flexible else _INTEGER.match(word)
        if not good or self.flexible and word[0] == "+" and len(word) <= 2 or not LOW <= int(word) <= HIGH:
            self.fail(f"expected an integer, but got {word}", self.at - len(word))
        return int(word)

    def real(self, digits: int) -> float:
        word = self.word()
        strict = re.match(rf"-?(0|[1-9]\d*)\.\d{{{digits}}}\Z", word) and not re.match(r"-0\.0*\Z", word)
        loose = re.match(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\Z", word)
        if not (loose if self.flexible else strict):
            self.fail(f"expected a real number with {digits} digits, but got {word}", self.at - len(word))
        return float(word)

    def blank(self, c: str) -> None:
        if self.flexible:
            return
        if self.text[self.at : self.at + 1] != c:
            self.fail("expected " + {" ": "a space", "\n": "a newline", "\t": "a tab"}.get(c, repr(c)))
        self._step()

    def end(self) -> None:
        while self.flexible and self.at < len(self.text) and self.text[self.at].isspace():
            self._step()
        if self.at < len(self.text):
            self.fail("expected the end of the file")


def read_value(cursor: Cursor, spec: Spec, known: dict):
    if isinstance(spec, Integer):
        return cursor.integer()
    if isinstance(spec, Real):
        return cursor.real(spec.format.digits)
    if isinstance(spec, String):
        return cursor.word()
    if isinstance(spec, Array):
        n = spec.length().unique(known) if spec.length() else None
        if n is None and (only := spec.unique(known)) is not None:
            n = len(only)
        if n is None:
            raise ConfigurationError("an array's length must be known before it is read")
        return [read_value(cursor, spec.element, known) for i in range(n) if not i or cursor.blank(spec.separator) is None]
    if isinstance(spec, Variant):
        tag = cursor.word()
        if tag not in spec.tags:
            cursor.fail(f"unknown tag {tag}", cursor.at - len(tag))
        i = spec.tags.index(tag)
        out = {"tag": i} | {f"_{j}": None for j in range(len(spec.parts))}
        if not isinstance(spec.parts[i], Nothing):
            cursor.blank(spec.separator)
            out[f"_{i}"] = read_value(cursor, spec.parts[i], known)
        return out
    if isinstance(spec, Tuple):
        return {f"_{i}": read_value(cursor, p, known) for i, p in enumerate(spec.parts) if not i or cursor.blank(spec.separator) is None}
    raise ConfigurationError(f"{type(spec).__name__} cannot be read from a line")


def read_row(cursor: Cursor, problem: Problem, layout: Layout) -> dict:
    row: dict = {}
    for part in layout.body:
        if isinstance(part, Line):
            for i, t in enumerate(part.tokens):
                if i:
                    cursor.blank(" ")
                if isinstance(t, Literal):
                    if (got := cursor.word()) != t.text:
                        cursor.fail(f"expected {t.text}, but got {got}", cursor.at - len(got))
                else:
                    row[t] = read_value(cursor, problem.variables[t], row)
            cursor.blank("\n")
            continue
        n = Expression(part.count).value(row)
        if n < 0:
            raise ConfigurationError("a section has a negative number of lines")
        made: dict = {t: [] for t in part.tokens}
        sizes = {t: problem.variables[t]._counts()[0].unique(row) for t in part.tokens if isinstance(problem.variables[t], Graph)}
        if None in sizes.values():
            raise ConfigurationError("a graph's number of nodes must be known before it is read")
        for _ in range(n):
            for i, t in enumerate(part.tokens):
                if i:
                    cursor.blank(" ")
                spec = problem.variables[t]
                if isinstance(spec, Graph):
                    base = 1 if spec.one_based else 0

                    def node() -> int:
                        at = cursor.integer() - base
                        if not 0 <= at < sizes[t]:
                            cursor.fail(f"node {at + base} is not one of {base} ... {sizes[t] - 1 + base}")
                        return at

                    u = node()
                    cursor.blank(" ")
                    edge = {"u": u, "v": node()}
                    if spec.edge_label:
                        cursor.blank(" ")
                        edge["label"] = read_value(cursor, spec.edge_label, row)
                    made[t].append(edge)
                else:
                    made[t].append(read_value(cursor, spec.element, row))
            cursor.blank("\n")
        for t, items in made.items():
            spec = problem.variables[t]
            if isinstance(spec, Graph):
                items = {"num_nodes": sizes[t], "edges": items}
            row[t] = items
    return row


def parse(text: str, problem: Problem, layout: Layout, cases: int = 1) -> list[dict]:
    """All cases of one text, to its end."""
    cursor, out = Cursor(text, layout.flexible), []

    def fixed(parts: tuple) -> None:
        for part in parts:
            for i, t in enumerate(part.tokens):
                if i:
                    cursor.blank(" ")
                if (got := cursor.word()) != t.text:
                    cursor.fail(f"expected {t.text}, but got {got}", cursor.at - len(got))
            cursor.blank("\n")

    fixed(layout.header)
    if layout.counted:
        cases = cursor.integer()
        if cases < 0:
            cursor.fail("a negative number of cases")
        cursor.blank("\n")
    for _ in range(cases):
        out.append(read_row(cursor, problem, layout))
    fixed(layout.footer)
    cursor.end()
    return out


def read_cases(spark: SparkSession, path: str, problem: Problem, layout: Layout, cases: int = 1, strict: bool = True, style: str = "only_set_variables") -> DataFrame:
    """(file, case, variables, error): a row for each case, files in parallel.

    Values are validated by the problem's constraints, in the given style.  With strict=False a file
    that does not follow the layout gives one row with its error, and an invalid case keeps its
    values beside its error; else either stops the job.
    """
    names = layout.names()
    kinds = ", ".join(f"`{n}` {problem.variables[n].dtype}" for n in names)
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for frame in batches:
            rows = []
            for name, text in frame.itertuples(index=False):
                try:
                    got = [(name, i + 1, *(r.get(n) for n in names), None) for i, r in enumerate(parse(text, problem, layout, cases))]
                except ReadError as e:
                    if strict:
                        raise
                    got = [(name, 0, *(None for _ in names), str(e))]
                rows += got
            yield pd.DataFrame(rows, columns=["file", "case", *names, "error"])

    rows = texts.mapInPandas(run, f"file string, case long, {kinds}, error string")
    return checked(problem, rows, names, strict, style)


def checked(problem: Problem, rows: DataFrame, names: Sequence[str], strict: bool, style: str) -> DataFrame:
    """rows (case, names, error) with the error of the first constraint that a case breaks; raised if strict."""
    checks = problem.checks(names, style)
    if not checks:
        return rows
    first = rows.withColumn("__bad", F.when(F.col("error").isNull(), F.coalesce(*checks)))
    why = problem.message(F.col("case"), F.col("__bad"))
    if strict:
        return first.where(F.when(why.isNull(), True).otherwise(F.raise_error(why).cast("boolean"))).select(rows.columns)
    return first.withColumn("error", F.coalesce("error", why)).select(rows.columns)


def cell_value(spec: Spec, cell: Column) -> tuple[Column, Column]:
    """Whether a cell is a value of the spec, by the tests of the strict reader (CAST alone takes signs, blanks and leading zeros), and the value."""
    if isinstance(spec, Integer):
        return cell.rlike(INTEGER) & cell.try_cast("bigint").isNotNull(), F.when(cell.rlike(INTEGER), cell.try_cast("bigint"))
    if isinstance(spec, Real):
        form = rf"\A-?(0|[1-9][0-9]*)\.[0-9]{{{spec.format.digits}}}\z"
        return cell.rlike(form) & ~cell.rlike(r"\A-0\.0*\z"), F.when(cell.rlike(form), cell.try_cast("double"))
    if isinstance(spec, String):
        return cell != "", cell
    raise ConfigurationError("only integers, reals and strings stand in native lines")


def read_lines(lines: DataFrame, problem: Problem, names: list[str]) -> DataFrame:
    """(value) rows of one line each -> the variables, natively; an error column where a line does not fit."""
    cells = F.split(F.col("value"), " ", -1)
    good, out = F.size(cells) == len(names), []
    for i, n in enumerate(names):
        fits, value = cell_value(problem.variables[n], F.try_element_at(cells, F.lit(i + 1)))
        good = good & F.coalesce(fits, F.lit(False))
        out.append(value.alias(n))
    others = [c for c in lines.columns if c not in names]
    rows = lines.select(*others, good.alias("__good"), *out)
    return rows.select(*others, *(F.when(F.col("__good"), F.col(f"`{n}`")).alias(n) for n in names), F.when(~F.col("__good"), F.lit("line does not follow its layout")).alias("error"))


def schema_of(problem: Problem, names: tuple[str, ...]) -> T.StructType:
    out = T.StructType()
    for n in names:
        out = out.add(n, T.DataType.fromDDL(problem.variables[n].dtype))
    return out


__all__ = ["Layout", "Line", "Literal", "Multiline", "parse", "read_cases", "read_lines", "render", "write_cases", "case_text", "text_of", "C", "WriteError"]
