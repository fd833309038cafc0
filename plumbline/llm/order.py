"""Totals along an order, and joins with hot keys, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm.text import stored

#: A key with more than 1 / HOT of all rows is hot; so there are fewer than HOT of them.
HOT = 256


def running(df: DataFrame, group: str, order: list[Column], sums: list[str], what: str) -> DataFrame:
    """df with ord (a row's number in its group, from 0) and run_<s> for each of sums: totals of the group up to the row, itself included.

    Rows are sorted by range, so that a group may span partitions; rows that are equal in
    everything may, too.  Each partition counts on its own, and a group that began in an earlier
    one gets that one's totals: a partition has one such group at most, its first, so the table
    of carried totals has no more rows than there are partitions and is broadcast.  The group
    and the columns of sums (long) must not be null.
    """
    names = ["ord", *(f"run_{s}" for s in sums)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, [0] * len(names)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = batch.column(group)
            new = np.ones(n, dtype=bool)
            new[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
            same = last is not None and key[0].as_py() == last
            start = np.flatnonzero(new)
            of = np.cumsum(new) - 1
            made = []
            for i, values in enumerate([np.ones(n, dtype=np.int64), *(batch.column(s).to_numpy(zero_copy_only=False) for s in sums)]):
                total = np.cumsum(values)
                before = (total[start] - values[start])[of]
                total = total - before
                if same:
                    total[of == 0] += held[i]
                held[i] = int(total[-1])
                made.append(total)
            last = key[n - 1].as_py()
            made[0] = made[0] - 1
            held[0] = int(made[0][-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), *(pa.array(x, pa.int64()) for x in made)], names=[*batch.schema.names, "part", *names])

    schema = StructType([*df.schema.fields]).add("part", "integer")
    for name in names:
        schema = schema.add(name, "long")
    keys = [F.col(group), *order, F.col("__row")]
    rows = df.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__row")
    rows = stored(rows.mapInArrow(run, schema), what)
    ends = rows.groupBy(group, "part").agg(*(F.max(F.struct("ord", c))[c].alias(c) for c in names[1:]), (F.max("ord") + 1).alias("ord"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(group, "part", *(F.sum(c).over(earlier).alias(f"__{c}") for c in names)).where("__ord is not null")
    both = rows.join(F.broadcast(carry), [group, "part"], "left")
    return both.select(*df.columns, *((F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in names))


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", n: str = "n") -> DataFrame:
    """left with right's columns; right has one row for each key, and in n how many of left's rows have it.

    Hot keys, fewer than HOT by their definition, are joined by broadcast, so that no task
    gets all of one; the others by Spark's choice.  left is read twice: it should be stored.
    """
    most = right.agg(F.sum(n).alias("__all"))
    judged = right.crossJoin(F.broadcast(most)).withColumn("__hot", F.col(n) * HOT > F.col("__all")).drop("__all", n)
    hot = judged.where("__hot")
    cold = judged.where("not __hot").drop("__hot")
    first = left.join(F.broadcast(hot), on, "left")
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how)
    return first.where("__hot").drop("__hot").unionByName(rest)
