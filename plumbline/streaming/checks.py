"""Constraints on streams.  An addition: row-local checks run unchanged on unbounded inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.problem import Problem


def violations(problem: Problem, stream: DataFrame, keys: list[str]) -> DataFrame:
    """Stateless: the same projection as for tables."""
    return problem.violations(stream, keys)


def windowed(problem: Problem, stream: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Violations for each window of event time, variable and constraint; state of windows older than `late` is dropped."""
    found = problem.violations(stream.withWatermark(time, late), [time])
    return found.groupBy(F.window(time, width), "variable", "constraint").agg(F.count("*").alias("violations"))
