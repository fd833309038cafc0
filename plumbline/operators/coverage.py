"""Covering arrays: few rows in which every t columns show every combination of their values."""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.errors import ConfigurationError
from plumbline.functions.draw import draw
from plumbline.operators.graphs import shared_folder


def covering_array(dims: list[int], strength: int) -> list[tuple[int, ...]]:
    """Greedy: each row takes, column by column, the value that covers most combinations still open.

    A small driver plan over option numbers (at most 62 columns); its rows then become a DataFrame.
    """
    if not 1 <= strength <= len(dims) or len(dims) > 62 or min(dims) < 1:
        raise ConfigurationError("a strength of 1 to the number of columns, and at most 62 columns")
    if strength == len(dims):
        return list(product(*map(range, dims)))
    todo = {(s, v) for s in combinations(range(len(dims)), strength) for v in product(*(range(dims[i]) for i in s))}
    rows = []
    while todo:
        cols, values = min(todo)
        row: dict[int, int] = dict(zip(cols, values, strict=True))
        for i in range(len(dims)):
            if i not in row:
                have = sorted(row)
                gain = lambda x: sum((s, tuple((row | {i: x})[j] for j in s)) in todo for c in combinations(have, strength - 1) for s in [tuple(sorted((*c, i)))])  # noqa: B023, E731
                row[i] = max(range(dims[i]), key=lambda x: (gain(x), -x))  # noqa: B023
        made = tuple(row[i] for i in range(len(dims)))
        rows.append(made)
        todo -= {(s, tuple(made[j] for j in s)) for s in combinations(range(len(dims)), strength)}
    return rows


def covering_frame(spark: SparkSession, options: dict[str, list], strength: int) -> DataFrame:
    names = sorted(options)
    rows = covering_array([len(options[n]) for n in names], strength)
    return spark.createDataFrame([tuple(options[n][x] for n, x in zip(names, r, strict=True)) for r in rows], names)


def covering_table(spark: SparkSession, options: DataFrame, strength: int, seed: str = "covering", candidates: int = 4096) -> DataFrame:
    """A covering array made by Spark, for options (name, value) of which each name has some: a column of values for each name, by name.

    What no row covers yet is a table of column sets and values.  A round takes some of these, all when there are few, and fills
    the other columns by draws: these are the candidates.  An open combination goes to the candidate that covers most of them, of those
    that have it; candidates that get at least half of what they cover become rows.  The best one gets all, so each round
    adds rows; rows are fewer than combinations.  Only the names and the numbers of their options come to the driver.
    Null is a value like others, equal values are one, and options without a name are left out.
    """
    if [c.lower() for c in options.columns] != ["name", "value"]:
        raise ConfigurationError("options are rows of name and value")
    folder = shared_folder(spark, "covering")
    ranked = options.where("name is not null").distinct().withColumn("x", F.row_number().over(Window.partitionBy("name").orderBy("value")) - 1)
    ranked.write.parquet(f"{folder}/options")
    ranked = spark.read.parquet(f"{folder}/options")
    sizes = {r["name"]: r["n"] for r in ranked.groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(sizes)
    dims = [sizes[n] for n in names]
    if not 1 <= strength <= len(dims):
        raise ConfigurationError("a strength of 1 to the number of columns")
    radix = F.array(*map(F.lit, dims))
    one = spark.range(1).select(F.expr("cast(array() as array<int>)").alias("cols"), F.expr("cast(array() as array<int>)").alias("vals"))
    for j in range(strength):
        one = one.withColumn("c", F.explode(_later(len(dims), strength, j)))
        one = one.withColumn("x", F.explode(F.sequence(F.lit(0), F.get(radix, F.col("c")) - 1)))
        one = one.select(F.concat("cols", F.array("c")).alias("cols"), F.concat("vals", F.array("x")).alias("vals"))
    one.write.parquet(f"{folder}/open0")
    spark.range(0).select(F.lit(None).cast("array<int>").alias("r")).write.parquet(f"{folder}/rows/round=0")
    step = 0
    while (left := (todo := spark.read.parquet(f"{folder}/open{step}")).count()) > 0:
        step += 1
        some = todo if left <= candidates else todo.where(draw(seed, step, F.array_join("cols", ","), F.array_join("vals", ",")) < int(2**60 * candidates / left))
        fill = lambda i: draw(seed, step, F.array_join("cols", ","), F.array_join("vals", ","), i) % F.get(radix, i)  # noqa: B023, E731
        whole = F.transform(F.sequence(F.lit(0), F.lit(len(dims) - 1)), lambda i: F.coalesce(F.get("vals", F.array_position("cols", i).cast("int") - 1), fill(i)).cast("int"))  # noqa: B023
        hits = _covered(some.select(whole.alias("r")).distinct(), len(dims), strength).join(todo, ["cols", "vals"], "left_semi")
        hits.write.parquet(f"{folder}/hits{step}")
        hits = spark.read.parquet(f"{folder}/hits{step}")
        scored = hits.join(hits.groupBy("r").agg(F.count(F.lit(1)).alias("n")), "r")
        won = scored.groupBy("cols", "vals").agg(F.max(F.struct("n", "r")).alias("best")).groupBy("best").agg(F.count(F.lit(1)).alias("got"))
        won.where(F.col("got") * 2 >= F.col("best.n")).select("best.r").write.parquet(f"{folder}/rows/round={step}")
        new = hits.join(spark.read.parquet(f"{folder}/rows/round={step}"), "r", "left_semi").select("cols", "vals").distinct()
        todo.join(new, ["cols", "vals"], "left_anti").write.parquet(f"{folder}/open{step}")
    rows = spark.read.parquet(f"{folder}/rows").select("r")
    # Numbers become values by joins with the options of a column.
    out = rows.select(*(F.get("r", F.lit(i)).alias(f"x{i}") for i in range(len(dims))))
    for i, n in enumerate(names):
        out = out.join(ranked.where(F.col("name") == n).select(F.col("x").alias(f"x{i}"), F.col("value").alias(f"v{i}")), f"x{i}")
    return out.select(*(F.col(f"v{i}").alias(n) for i, n in enumerate(names)))


def _later(columns: int, strength: int, j: int):
    """The columns that may be the j-th of a set, after those that `cols` has."""
    return F.sequence(F.coalesce(F.element_at("cols", -1) + 1, F.lit(0)) if j else F.lit(0), F.lit(columns - strength + j))


def _covered(rows: DataFrame, columns: int, strength: int) -> DataFrame:
    """(r, cols, vals): all that rows r cover."""
    out = rows.withColumn("cols", F.expr("cast(array() as array<int>)"))
    for j in range(strength):
        out = out.withColumn("c", F.explode(_later(columns, strength, j))).select("r", F.concat("cols", F.array("c")).alias("cols"))
    return out.withColumn("vals", F.transform("cols", lambda c: F.get("r", c)))


def uncovered(df: DataFrame, options: dict[str, list], strength: int) -> DataFrame:
    """(columns, seen, wanted) of sets of columns with a combination that no row has: one aggregation for all sets."""
    names = sorted(options)
    sets = list(combinations(names, strength))
    combos = F.explode(F.array(*(F.struct(F.lit(",".join(s)).alias("columns"), F.concat_ws("|", *(F.col(c).cast("string") for c in s)).alias("v")) for s in sets))).alias("s")
    seen = df.select(combos).groupBy("s.columns").agg(F.count_distinct("s.v").alias("seen"))
    wanted = df.sparkSession.createDataFrame([(",".join(s), _product(len(options[c]) for c in s)) for s in sets], "columns string, wanted long")
    return wanted.join(seen, "columns", "left").where("coalesce(seen, 0) < wanted").select("columns", "seen", "wanted")


def _product(sizes) -> int:
    out = 1
    for n in sizes:
        out *= n
    return out
