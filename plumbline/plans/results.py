"""Violations counted beside the action that uses the rows: no scan of their own."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from plumbline.operators import constraints as C
from plumbline.plans.problem import Problem, _safe


@dataclass
class ValidationResults:
    """What an action saw; asked before it has run, it waits."""

    variables: list[str]
    observation: Observation

    @property
    def cases(self) -> int:
        return self.observation.get["cases"]

    def counts(self) -> dict[str, int]:
        """Bad cases of each variable that has any."""
        got = self.observation.get
        return {n: got[f"bad{i}"] for i, n in enumerate(self.variables) if got[f"bad{i}"]}

    def valid(self) -> bool:
        return not self.counts()

    def first(self) -> dict[str, str]:
        """Of each variable that has bad cases, the message of that with the least key."""
        got = self.observation.get
        return {n: got[f"first{i}"]["why"] for i, n in enumerate(self.variables) if got[f"first{i}"]}

    def frame(self, spark) -> DataFrame:
        """(variable, cases, violations, first): a row for each variable."""
        counts, first = self.counts(), self.first()
        return spark.createDataFrame([(n, self.cases, counts.get(n, 0), first.get(n)) for n in self.variables], "variable string, cases long, violations long, first string")


def watched(problem: Problem, df: DataFrame, keys: Sequence[str], style: str = "only_set_variables") -> tuple[DataFrame, ValidationResults]:
    """df, and what its first action will have seen.

    The metrics are partial aggregates that ride on the tasks of that action, such as a write: rows are read once, and one
    row comes to the driver.  keys name a case in messages, joined by commas.
    """
    safe, own = _safe(df)
    here = [n for n in sorted(problem.variables) if n in df.columns]
    with C.scope(own):
        checks = problem.checks([c for c in df.columns if c not in keys], style)
    marked = safe.select("*", F.array_compact(F.array(*checks)).alias("bad")) if checks else safe.withColumn("bad", F.expr("cast(array() as array<struct<variable:string>>)"))
    case = F.concat_ws(", ", *(own[k].cast("string") for k in keys))
    metrics = [F.count(F.lit(1)).alias("cases")]
    for i, n in enumerate(here):
        mine = F.try_element_at(F.filter(F.col("bad"), _of(n)), F.lit(1))
        metrics.append(F.count(F.when(mine.isNotNull(), 1)).alias(f"bad{i}"))
        metrics.append(F.min(F.when(mine.isNotNull(), F.struct(*(own[k].alias(f"k{j}") for j, k in enumerate(keys)), Problem.message(case, mine).alias("why")))).alias(f"first{i}"))
    seen = Observation()
    return marked.observe(seen, *metrics).drop("bad").toDF(*df.columns), ValidationResults(here, seen)


def _of(name: str):
    return lambda v: v["variable"] == name
