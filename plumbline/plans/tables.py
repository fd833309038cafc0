"""Checks and analyses in Python as table functions of SQL: `SELECT * FROM name(TABLE(cases))`.

A function of one's own sees Arrow batches of its table, in the tasks that hold the rows: there is no shuffle unless the query asks
for one, and a task holds one batch at a time.  What built-in expressions can say belongs in constraints instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udtf
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.errors import ConfigurationError, VariableNotFound
from plumbline.plans.problem import Problem
from plumbline.session import ship

FOUND = "variable string, value string, expected string"


def _table_function(spark: SparkSession, name: str, schema: T.StructType, run: Callable[[pa.RecordBatch], pa.Table]) -> str:
    kinds = to_arrow_schema(schema)

    class Batches:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            made = run(batch)
            if set(made.column_names) != set(kinds.names):
                raise ConfigurationError(f"{name} gave the columns {made.column_names}, not {kinds.names}")
            yield pa.table([made[n].cast(kinds.field(n).type) for n in kinds.names], schema=kinds)

    spark.udtf.register(name, arrow_udtf(Batches, returnType=schema))
    return name


def register_check(spark: SparkSession, problem: Problem, name: str, variable: str, check: Callable[..., pa.Array], reads: Sequence[str] = (), keys: str = "", expected: str = "") -> str:
    """Makes `name(TABLE(...))` known: the rows whose value of `variable` breaks check, as (keys, variable, value, expected).

    check gets the variable's values and those of `reads` as Arrow arrays, and gives a boolean for each row; rows without a value are
    not judged, and those for which it gives null break it.  keys are the columns, with their types, that tell rows apart.
    """
    for n in (variable, *reads):
        if n not in problem.variables:
            raise VariableNotFound(f"{name} reads {n}, which is not declared")
    ship(spark)
    own = T.StructType.fromDDL(keys) if keys else T.StructType()
    schema = T.StructType([*own.fields, *T.StructType.fromDDL(FOUND).fields])
    if len({f.name.lower() for f in schema}) < len(schema):
        raise ConfigurationError("keys have the names of what is found")
    key_names, title = own.names, expected or name

    def run(batch: pa.RecordBatch) -> pa.Table:
        import pyarrow.compute as pc

        rows = pa.table(batch)
        lacking = [n for n in (variable, *reads, *key_names) if n not in rows.column_names]
        if lacking:
            raise ConfigurationError(f"{name} needs the columns {lacking}")
        flat = rows.combine_chunks()
        good = check(*(_array(flat[n]) for n in (variable, *reads)))
        if len(good) != rows.num_rows:
            raise ConfigurationError(f"{name} judged {len(good)} of {rows.num_rows} rows")
        bad = pc.and_(pc.is_valid(_array(flat[variable])), pc.invert(pc.fill_null(good, False)))
        rows = flat.filter(bad)
        n = rows.num_rows
        # Kinds without a cast to text are shown as Python shows them.
        value = _array(rows[variable])
        shown = pa.array([str(v) for v in value.to_pylist()], pa.string()) if pa.types.is_nested(value.type) else value.cast(pa.string())
        return pa.table([*(rows[k] for k in key_names), pa.array([variable] * n, pa.string()), shown, pa.array([title] * n, pa.string())], names=schema.names)

    return _table_function(spark, name, schema, run)


def register_analysis(spark: SparkSession, name: str, schema: str, partial: Callable[[pa.Table], pa.Table]) -> str:
    """Makes `name(TABLE(...))` known: what partial finds in each Arrow batch of the cases, as rows of schema.

    Rows are partial results, to be put together by SQL's aggregates (`SELECT k, sum(n) FROM name(TABLE(cases)) GROUP BY k`): so they
    are combined before the shuffle, and no task holds more than a batch.
    """
    return _table_function(ship(spark), name, T.StructType.fromDDL(schema), lambda batch: partial(pa.table(batch)))


def _array(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
