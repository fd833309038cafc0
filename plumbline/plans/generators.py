"""Generators: functions that set some variables of a case; the problem draws the others.

A generator gets `Draws` and returns the cases of one call, each a dict of columns by variable.
Its values, too, are functions of seed, generator, call and name, so that calls are rows of
one lazy plan and need no order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.errors import ConfigurationError, VariableNotFound
from plumbline.functions import draw
from plumbline.operators import constraints as C
from plumbline.operators.specs import Spec
from plumbline.plans.problem import Problem


@dataclass
class Draws:
    """What a generator may ask for in a call."""

    problem: Problem
    seed: str
    args: dict[str, str] = field(default_factory=dict)
    asked: int = 0

    def keys(self) -> tuple[Column, ...]:
        """New coordinates for each question."""
        self.asked += 1
        return F.lit(self.seed), F.col("gen"), F.col("call"), F.lit(f"question {self.asked}")

    def integer(self, low: int | Column, high: int | Column) -> Column:
        low, high = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (low, high))
        return draw.integer(low, high, *self.keys())

    def element(self, options: Sequence) -> Column:
        return draw.element(F.array(*map(C.literal, options)), *self.keys())

    def shuffled(self, items: Column) -> Column:
        return draw.shuffled(items, *self.keys())

    def random(self, spec: Spec) -> Column:
        """A value of a spec of the generator's own."""
        return spec.sound(*self.keys())

    def value(self, name: str, *more: C.Constraint) -> Column:
        """A value of a variable, with more constraints."""
        if name not in self.problem.variables:
            raise VariableNotFound(name)
        return self.random(self.problem.variables[name].also(*more))

    def least(self, name: str, *more: C.Constraint) -> Column:
        return self.value(name, C.SizeCategory("min"), *more)

    def greatest(self, name: str, *more: C.Constraint) -> Column:
        return self.value(name, C.SizeCategory("max"), *more)

    def arg(self, name: str, kind: type = str, low=None, high=None):
        """An argument of the call as str, int or float; within low and high, if given."""
        if name not in self.args:
            raise ConfigurationError(f"the generator needs the argument {name}")
        try:
            out = kind(self.args[name])
        except ValueError as e:
            raise ConfigurationError(f"argument {name}: {self.args[name]!r} is no {kind.__name__}") from e
        if low is not None and out < low or high is not None and out > high:
            raise ConfigurationError(f"argument {name}: {out} is not between {low} and {high}")
        return out


@dataclass(frozen=True)
class Generator:
    """make(draws) gives the cases of one call; calls of them are made, with args as given."""

    name: str
    make: Callable[[Draws], dict | list[dict]]
    calls: int = 1
    args: dict[str, str] = field(default_factory=dict)
    seed: str | None = None
    local: dict[str, Spec] = field(default_factory=dict)


def run(spark: SparkSession, problem: Problem, generators: Sequence[Generator], partitions: int | None = None) -> DataFrame:
    """(gen, call, idx, variables): the cases of all generators; what a generator sets is checked like what is drawn."""
    if not generators:
        raise ConfigurationError("there is no generator")
    if len({g.name for g in generators}) < len(generators):
        raise ConfigurationError("generators need different names")
    out = []
    for g in generators:
        base = problem.seed if g.seed is None else g.seed
        if base is None:
            raise ConfigurationError("a problem needs a seed to generate")
        own = problem.merged(g.local)
        made = g.make(Draws(own, base, dict(g.args)))
        for i, case in enumerate([made] if isinstance(made, dict) else made):
            for name in case:
                if name not in own.variables:
                    raise VariableNotFound(name)
            fixed = {n: v if isinstance(v, Column) else C.literal(v) for n, v in case.items()}
            rows = problem.generate(spark, g.calls, g.name, g.local, fixed=fixed, seed=base if i == 0 else f"{base}|case {i + 1}", partitions=partitions)
            out.append(rows.withColumn("idx", F.lit(i + 1)))
    if not out:
        raise ConfigurationError("the generators made no case")
    return reduce(DataFrame.unionByName, out)
