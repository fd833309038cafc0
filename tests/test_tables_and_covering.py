"""Table functions in SQL, and covering arrays made by Spark, against plain loops."""

from itertools import combinations, product

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from plumbline.errors import ConfigurationError, VariableNotFound
from plumbline.operators.coverage import covering_table, uncovered
from plumbline.operators.specs import Array, Integer, String
from plumbline.plans.problem import Problem
from plumbline.plans.tables import register_analysis, register_check

P = Problem({"A": Array(Integer()), "N": Integer(), "S": String()})


def options_of(spark, options):
    return spark.createDataFrame([(n, v) for n, values in options.items() for v in values], "name string, value string")


@pytest.mark.parametrize("strength", [1, 2, 3])
def test_every_combination_is_in_some_row(spark, strength):
    options = {"b": ["x", "y", "z"], "a": ["0", "1"], "c": ["p", "q"], "d": ["u", "v", "w"]}
    # Options that repeat are one; a round takes few candidates, so that there are several rounds.
    df = covering_table(spark, options_of(spark, options).unionByName(options_of(spark, {"a": ["0", "0"]})), strength, candidates=5)
    rows = [r.asDict() for r in df.collect()]
    assert df.columns == sorted(options)
    for names in combinations(sorted(options), strength):
        assert {tuple(r[n] for n in names) for r in rows} == set(product(*(options[n] for n in names)))
    assert uncovered(df, options, strength).count() == 0
    assert len(rows) <= sum(1 for s in combinations(options.values(), strength) for _ in product(*s))


def test_options_may_be_null_and_must_be_enough(spark):
    rows = covering_table(spark, spark.createDataFrame([("a", None), ("a", "1"), ("b", None), (None, "left out")], "name string, value string"), 2).collect()
    assert sorted(map(tuple, rows), key=str) == [("1", None), (None, None)]
    with pytest.raises(ConfigurationError):
        covering_table(spark, options_of(spark, {"a": ["1"]}), 2)
    with pytest.raises(ConfigurationError):
        covering_table(spark, options_of(spark, {}), 1)
    with pytest.raises(ConfigurationError):
        covering_table(spark, options_of(spark, {"a": ["1"]}).withColumnRenamed("name", "other"), 1)


def test_the_same_seed_makes_the_same_rows(spark):
    options = options_of(spark, {"a": list("0123"), "b": list("012"), "c": list("01")})
    one, two = (sorted(map(tuple, covering_table(spark, df, 2, seed="k").collect())) for df in (options, options.repartition(7)))
    assert one == two


def test_checks_in_sql(spark):
    register_check(spark, P, "not_less", "N", lambda n, s: pc.less(n, pc.utf8_length(s)), reads=["S"], keys="k bigint, `odd name` string", expected="less than the length of S")
    rows = [(1, "a", 2, "xyz"), (2, "b", 3, "xyz"), (3, None, None, "x"), (4, "", 5, None), (4, "", 5, None)]
    cases = spark.createDataFrame(rows, "k long, `odd name` string, N long, S string").repartition(3)
    got = spark.sql("select * from not_less(table({c})) order by k", c=cases).collect()
    # Rows without a value are not judged; a check that gives null is broken; repeated rows are each reported.
    assert [tuple(r) for r in got] == [(2, "b", "N", "3", "less than the length of S")] + 2 * [(4, "", "N", "5", "less than the length of S")]
    assert spark.sql("select * from not_less(table({c}))", c=cases.where("k > 9")).count() == 0


def test_checks_of_arrays_show_their_values(spark):
    register_check(spark, P, "long_arrays", "A", lambda a: pc.less(pc.list_value_length(a), 2), keys="k int")
    cases = spark.createDataFrame([(1, [1, 2]), (2, [3]), (3, None)], "k int, A array<long>")
    assert [tuple(r) for r in spark.sql("select * from long_arrays(table({c}))", c=cases).collect()] == [(1, "A", "[1, 2]", "long_arrays")]


def test_checks_that_cannot_be(spark):
    with pytest.raises(VariableNotFound):
        register_check(spark, P, "c", "M", lambda m: m)
    with pytest.raises(ConfigurationError):
        register_check(spark, P, "c", "N", lambda n: n, keys="Value int")
    register_check(spark, P, "short", "N", lambda n: pa.array([True]), keys="k long")
    with pytest.raises(Exception, match="judged 1 of 2 rows"):
        spark.sql("select * from short(table({c}))", c=spark.createDataFrame([(1, 1), (2, 2)], "k long, N long").coalesce(1)).collect()
    with pytest.raises(Exception, match="needs the columns"):
        spark.sql("select * from short(table({c}))", c=spark.createDataFrame([(1,)], "k long")).collect()


def test_analyses_in_sql(spark):
    register_analysis(spark, "spread_of", "g bigint, low bigint, high bigint, n bigint", lambda t: t.group_by("g").aggregate([("N", "min"), ("N", "max"), ("N", "count")]).rename_columns(["g", "low", "high", "n"]))
    cases = spark.range(0, 1000, 1, 5).selectExpr("if(id % 3 = 2, null, id % 3) as g", "id as N")
    found = spark.sql("select g, min(low), max(high), sum(n) from spread_of(table({c})) group by g", c=cases).collect()
    assert sorted(map(tuple, found), key=str) == [(0, 0, 999, 334), (1, 1, 997, 333), (None, 2, 998, 333)]
    register_analysis(spark, "other_names", "a bigint", lambda t: t)
    with pytest.raises(Exception, match="gave the columns"):
        spark.sql("select * from other_names(table({c}))", c=cases).collect()
