"""A problem: named variables and layouts, and the plans made from them.

Declaring is driver work on a few specs.  Everything on rows is one lazy plan: validation
is a projection, generation a chain of projections over spark.range in the order that the
variables depend on each other, with bounded rejection inside the row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.errors import ConfigurationError, ValidationError, VariableNotFound
from plumbline.functions.printer import shown
from plumbline.operators import constraints as C
from plumbline.operators.specs import Spec

STYLES = ("none", "only_set_variables", "only_set_values", "all_variables", "everything")
VIOLATIONS = "variable", "path", "constraint", "value", "expected", "details"


@dataclass(frozen=True)
class Problem:
    variables: dict[str, Spec]
    title: str = ""
    seed: str | None = None
    input: object | None = None
    output: object | None = None
    extra: dict = field(default_factory=dict)

    def order(self) -> list[str]:
        """Variables so that each comes after those it reads; ties by name.  Cycles and unknown names are errors."""
        waits = {n: set(s.names) for n, s in self.variables.items()}
        for name, reads in waits.items():
            for r in reads - set(waits):
                raise VariableNotFound(f"{name} reads {r}, which is not declared")
        out: list[str] = []
        while waits:
            ready = sorted(n for n, reads in waits.items() if not reads)
            if not ready:
                raise ConfigurationError("cycle among " + ", ".join(sorted(waits)))
            out.append(ready[0])
            del waits[ready[0]]
            for reads in waits.values():
                reads.discard(ready[0])
        return out

    def needed(self, names: Sequence[str]) -> list[str]:
        """names and all that they read, in order."""
        want, more = set(names), list(names)
        while more:
            for r in self.variables[more.pop()].names:
                if r not in want:
                    want.add(r)
                    more.append(r)
        return [n for n in self.order() if n in want]

    def merged(self, other: dict[str, Spec]) -> "Problem":
        """Local constraints on top of the global ones."""
        both = dict(self.variables)
        for n, s in other.items():
            both[n] = both[n].merged(s) if n in both else s
        return Problem(both, self.title, self.seed, self.input, self.output, self.extra)

    # Validation

    def checks(self, columns: Sequence[str], style: str = "only_set_variables") -> list[Column]:
        """For each variable in play, a struct (variable, path, ...) of its first violation, or NULL.

        Variables are the columns of their names, or those that the scope has for them.
        """
        with C.plainly():
            return self._checks(columns, style)

    def _checks(self, columns: Sequence[str], style: str) -> list[Column]:
        if style not in STYLES:
            raise ConfigurationError(f"unknown style {style}")
        out = []
        lacks = lambda n, why: F.struct(F.lit(n).alias("variable"), *(F.lit(why if k == "expected" else "").alias(k) for k in VIOLATIONS[1:]))
        if style == "none":
            return out
        for n in sorted(self.variables):
            if n not in columns:
                if style in ("all_variables", "everything"):
                    out.append(lacks(n, "a value"))
                continue
            value = _column(n)
            v = self.variables[n].violation(value)
            full = F.when(v.isNotNull(), F.struct(F.lit(n).alias("variable"), *(v[k].alias(k) for k in VIOLATIONS[1:])))
            missing = lacks(n, "a value") if style in ("all_variables", "everything") else F.lit(None)
            out.append(F.when(value.isNull(), missing).otherwise(full))
        if style in ("only_set_values", "everything"):
            for n in sorted(set(columns) - set(self.variables) - set(self.extra.get("keys", ()))):
                out.append(F.when(_column(n).isNotNull(), lacks(n, "no variable of this name")))
        return out

    @staticmethod
    def message(case: Column, bad: Column) -> Column:
        """What is wrong with a case, from its first violation; NULL if there is none."""
        text = F.concat(F.lit("Case "), case.cast("string"), F.lit(" invalid: `"), bad["variable"], F.lit("` "), bad["path"], F.lit(" is "), F.coalesce(bad["value"], F.lit("unset")), F.lit(", expected "), bad["expected"], F.lit(" "), bad["details"])
        return F.when(bad.isNotNull(), F.rtrim(text))

    def violations(self, df: DataFrame, keys: Sequence[str], style: str = "only_set_variables") -> DataFrame:
        """One row for each row and variable that is broken: keys, variable, path, constraint, value, expected, details."""
        safe, own = _safe(df)
        with C.scope(own):
            checks = self.checks([c for c in df.columns if c not in keys], style)
        given = [own[k].alias(f"k{i}") for i, k in enumerate(keys)]
        if not checks:
            return safe.where("false").select(*(own[k].alias(k) for k in keys), *(F.lit("").alias(k) for k in VIOLATIONS))
        found = safe.select(*given, F.explode(F.array_compact(F.array(*checks))).alias("v"))
        return found.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), *(F.col("v").getField(k).alias(k) for k in VIOLATIONS))

    def summary(self, df: DataFrame, style: str = "only_set_variables") -> DataFrame:
        """Broken rows of each variable and constraint; partial counts are combined before the shuffle."""
        return self.violations(df, [], style).groupBy("variable", "constraint").agg(F.count("*").alias("violations"))

    def valid(self, df: DataFrame) -> DataFrame:
        """The rows that break nothing, as a filter of plain predicates."""
        here = [n for n in sorted(self.variables) if n in df.columns]
        safe, own = _safe(df)
        with C.scope(own), C.plainly():
            tests = [own[n].isNull() | reduce(lambda a, b: a & b, (c.holds(own[n]) for c in self.variables[n].constraints), F.lit(True)) for n in here]
        return safe.where(reduce(lambda a, b: a & b, tests, F.lit(True))).toDF(*df.columns)

    def require_valid(self, df: DataFrame, keys: Sequence[str], style: str = "only_set_variables") -> DataFrame:
        """df, or a ValidationError with the first bad row in key order, or if there is no row."""
        if df.isEmpty():
            raise ValidationError("there are no cases")
        safe, own = _safe(df)
        whole = F.struct(*(own[c].alias(c) for c in df.columns)).alias("__all")
        own = safe.select(*(own[c].alias(c) for c in df.columns), whole)
        bad = self.violations(own, [*keys, "__all"], style).orderBy(*keys, "variable").limit(1).collect()
        if bad:
            row = bad[0].asDict()
            all_ = row["__all"].asDict()
            whole = f" in {shown(all_[row['variable']])}" if row["path"] and row["variable"] in all_ else ""
            raise ValidationError(f"Case {', '.join(str(row[k]) for k in keys)} invalid: `{row['variable']}` {row['path']} is {row['value']}, expected {row['expected']} {row['details']}".rstrip() + whole)
        return df

    # Generation

    def generate(
        self, spark: SparkSession, calls: int = 1, generator: str = "random", local: dict[str, Spec] | None = None, names: Sequence[str] | None = None,
        fixed: dict[str, Column] | None = None, seed: str | None = None, most_attempts: int = 1000, most_cases: int = 100, partitions: int | None = None,
        over: DataFrame | None = None,
    ) -> DataFrame:
        """calls rows (gen, call, idx, variables) that satisfy all constraints; every row is checked at the end.

        over is a table with a column `call`, of different integers, to make a row for each of its rows; those of its other
        columns that are variables are values that are known, and where one is NULL it is drawn.
        Columns have the variables' names, which may differ by case alone.

        A value is a function of seed, generator, call, variable and attempt: the same on any
        number of partitions.  Values that the generator cannot aim at (custom predicates, several
        remainders, patterns with a length) are drawn again inside the row, up to most_attempts
        times.  Where a variable has no value for those that it reads, as in an empty range, it and all
        that it is tied to by reading are drawn again, up to most_cases times; a row for which nothing
        fits raises an error.
        """
        base = self.seed if seed is None else seed
        if base is None:
            raise ConfigurationError("a problem needs a seed to generate")
        own = self.merged(local or {})
        order, fixed = own.needed(names or sorted(own.variables)), fixed or {}
        known: dict[str, Column] = {}
        if over is None:
            rows = spark.range(0, calls, 1, partitions).select(F.lit(generator).alias("gen"), F.col("id").alias("call"), F.lit(1).alias("idx"))
        else:
            safe, mine = _safe(over)
            given = {n: mine[n].cast(own.variables[n].dtype).alias(f"__given{i}") for i, n in enumerate(order) if n in over.columns}
            rows = safe.select(F.lit(generator).alias("gen"), mine["call"].cast("long").alias("call"), F.lit(1).alias("idx"), *given.values())
            known = {n: F.col(f"__given{i}") for i, n in enumerate(order) if n in given}
        # Columns by place where names clash, as Spark does not tell them by case.
        plain = len({n.lower() for n in order} | {"gen", "call", "idx"}) == len(order) + 3
        at = {n: n if plain else f"v{i}" for i, n in enumerate(order)}
        columns = {n: F.col(f"`{c}`") for n, c in at.items()}

        def made(n: str, case: Column | None = None) -> Column:
            if n in known:
                return F.coalesce(known[n], drawn(n, case))
            return fixed[n] if n in fixed else drawn(n, case)

        def drawn(n: str, case: Column | None) -> Column:
            spec = own.variables[n]
            keys = F.lit(base), F.col("gen"), F.col("call"), F.lit(n)
            if (unique := spec.unique()) is not None:
                return C.literal(unique).cast(spec.dtype)
            if spec.aims():
                return spec.generate(*keys, F.lit(0) if case is None else case)
            return spec.retried(lambda a: spec.generate(*keys, *([] if case is None else [case]), a), most_attempts)

        with C.scope(columns), C.plainly():
            for n in order:
                rows = rows.withColumn(at[n], made(n))
                rows = rows.withColumn(at[n], F.when(own.variables[n].holds(columns[n]), columns[n]))
        for group in own._tied(order):
            whole = reduce(lambda a, b: a & b, (columns[n].isNotNull() for n in group))
            kind = "struct<" + ",".join(f"v{i}:{own.variables[n].dtype}" for i, n in enumerate(group)) + ">"
            step = lambda found, t: F.coalesce(found, own._case(group, lambda n: made(n, F.concat(F.lit("case "), t.cast("string"))), kind))  # noqa: B023, E731
            again = F.aggregate(F.sequence(F.lit(1), F.lit(most_cases)), F.lit(None).cast(kind), step)
            rows = rows.withColumn("__case", F.when(whole, F.struct(*(columns[n] for n in group)).cast(kind)).otherwise(again))
            rows = rows.withColumns({at[n]: F.col("__case").getField(f"v{i}") for i, n in enumerate(group)}).drop("__case")
        error = lambda n: F.raise_error(F.lit(f"no value for {n}: {own.variables[n]}")).cast(own.variables[n].dtype)
        return rows.select("gen", "call", "idx", *(F.coalesce(columns[n], error(n)).alias(n) for n in order))

    def _tied(self, order: list[str]) -> list[list[str]]:
        """Variables of order that read one another, directly or through others, in groups of two at least."""
        group = {n: {n} for n in order}
        for n in order:
            for r in self.variables[n].names:
                both = group[n] | group[r]
                group.update(dict.fromkeys(both, both))
        return [[n for n in order if n in g] for g in {id(g): g for g in group.values()}.values() if len(g) > 1]

    def _case(self, order: list[str], made: Callable[[str], Column], kind: str) -> Column:
        """All variables of one row as a struct, each drawn with those before it in scope; NULL if one has no value."""

        def after(known: dict[str, Column]) -> Column:
            if len(known) == len(order):
                return F.struct(*(known[n].alias(f"v{i}") for i, n in enumerate(order))).cast(kind)
            n = order[len(known)]
            with C.scope(known):
                value = made(n)

            def bound(v: Column) -> Column:
                with C.scope(known):
                    good = self.variables[n].holds(v)
                return F.when(v.isNotNull() & good, after({**known, n: v}))

            return F.element_at(F.transform(F.array(value), bound), 1)

        return after({})

    def edge_case_product(self, spark: SparkSession, names: Sequence[str] | None = None, seed: str | None = None) -> DataFrame:
        """Every combination of the variables' edge cases: a cross product of short literal lists, never of data.

        A variable without edge cases has one value.  Values that read others come after them; a
        combination for which a variable has no value has NULL there.
        """
        base = seed or self.seed or ""
        order, out = self.needed(names or sorted(self.variables)), None
        cases = {n: self.variables[n].edge_cases() or [self.variables[n]] for n in order}
        for i, n in enumerate(order):
            part = spark.range(len(cases[n])).select(F.col("id").alias(f"__{i}"))
            out = part if out is None else out.crossJoin(part)
        for i, n in enumerate(order):
            which, value = F.col(f"__{i}"), F.lit(None).cast(self.variables[n].dtype)
            for j, spec in enumerate(cases[n]):
                unique = spec.unique()
                one = C.literal(unique).cast(self.variables[n].dtype) if unique is not None else spec.sound(F.lit(base), F.lit("edge"), F.lit(n), F.lit(j))
                value = F.when(which == j, one).otherwise(value)
            out = out.withColumn(n, value)
            out = out.withColumn(n, F.when(self.variables[n].holds(F.col(f"`{n}`")), F.col(f"`{n}`")))
        return out.select(*(F.col(f"`{n}`") for n in (names or sorted(self.variables))))


def _column(n: str) -> Column:
    return C.ROW[n] if n in C.ROW else F.col(f"`{n}`")


def _safe(df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """df with columns named by their places, and the column of each of its names: names may differ by case alone, or hold dots."""
    safe = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return safe, {n: F.col(f"c{i}") for i, n in enumerate(df.columns)}


def merge_outputs(inputs: DataFrame, outputs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both by key; where both have a column, the input's value wins if it is set.  A key that one side lacks is an error."""
    shared = [c for c in outputs.columns if c in inputs.columns and c not in keys]
    renamed = outputs.select(*(F.col(f"`{k}`").alias(f"__key_{k}") for k in keys), F.lit(True).alias("__out"), *(F.col(f"`{c}`").alias(f"__{c}" if c in shared else c) for c in outputs.columns if c not in keys))
    same = reduce(lambda a, b: a & b, (F.col(f"`{k}`").eqNullSafe(F.col(f"`__key_{k}`")) for k in keys))
    both = inputs.withColumn("__in", F.lit(True)).join(renamed, same, "full_outer")
    lacks = F.raise_error(F.concat(F.lit("inputs and outputs differ: no "), F.when(F.col("__in").isNull(), "input").otherwise("output"), F.lit(" for key "), F.concat_ws(", ", *(F.coalesce(F.col(f"`{k}`").cast("string"), F.col(f"`__key_{k}`").cast("string")) for k in keys))))
    both = both.where(F.when(F.col("__in") & F.col("__out"), True).otherwise(lacks.cast("boolean")))
    cols = [F.coalesce(F.col(f"`{c}`"), F.col(f"`__{c}`")).alias(c) if c in shared else F.col(f"`{c}`") for c in inputs.columns]
    return both.select(*cols, *(F.col(f"`{c}`") for c in outputs.columns if c not in inputs.columns))


def analyze(problem: Problem, cases: DataFrame, *functions: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """Each analysis gets the cases as a DataFrame, in order of registration."""
    return [f(cases) for f in functions]


def validate_output(problem: Problem, inputs: DataFrame, outputs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Violations of the outputs with the inputs' values in scope."""
    return problem.violations(merge_outputs(inputs, outputs, keys), keys)
