"""Keyed permutations, disjoint sets, graphs in rows, names, known values and sizes."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.functions import draw
from plumbline.operators import constraints as C
from plumbline.operators import disjoint
from plumbline.operators.specs import Array, Graph, Integer, Real, String, Variant
from plumbline.plans.problem import Problem


@pytest.mark.parametrize("n", [1, 2, 3, 7, 66, 1001])
def test_permutations_reach_every_value_once(spark, n):
    got = [r[0] for r in spark.range(n).select(draw.permuted(F.lit(n).cast("long"), F.col("id"), "k")).collect()]
    assert sorted(got) == list(range(n)) and (n < 50 or got != sorted(got))


def test_few_values_of_a_large_range_differ(spark):
    one = spark.range(5).select(draw.distinct_integers(F.lit(10**12), F.lit(30), F.lit(-7), F.col("id")).alias("x"))
    rows = [r["x"] for r in one.collect()]
    assert all(len(set(x)) == 30 and min(x) >= -7 and max(x) < 10**12 - 7 for x in rows) and len({tuple(x) for x in rows}) == 5
    assert spark.range(1).select(draw.distinct_integers(F.lit(3).cast("long"), F.lit(4), F.lit(0).cast("long"), "k")).first()[0] is None


def test_pairs_have_numbers(spark):
    some = spark.range(3000).union(spark.createDataFrame([(x,) for x in (1 << 60, (1 << 61) - 1, 4503599627370497)], "id long"))
    bad = some.select("id", draw.pair(F.col("id")).alias("e")).where((draw.pair_number(F.col("e.u"), F.col("e.v")) != F.col("id")) | (F.col("e.u") >= F.col("e.v")) | (F.col("e.u") < 0))
    assert bad.count() == 0


def test_dense_graphs_in_linear_time(spark):
    p = Problem({"G": Graph(C.NumNodes(300), C.NumEdges(44_000), C.SimpleGraph(), C.Connected())}, seed="s")
    began = time.time()
    rows = p.generate(spark, 2, partitions=2).collect()
    assert time.time() - began < 60  # 143 s for four when every pair was listed and compared
    for r in rows:
        pairs = {(min(e["u"], e["v"]), max(e["u"], e["v"])) for e in r["G"]["edges"]}
        assert len(pairs) == 44_000 and all(0 <= a < b < 300 for a, b in pairs)


def test_disjoint_sets_equal_a_walk():
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        n = rng.randint(0, 8)
        rows.append((n, [rng.randint(-1, n) for _ in range(rng.randint(0, 12))], [rng.randint(-1, n) for _ in range(12)]))
    rows = [(n, u, v[: len(u)]) for n, u, v in rows] + [(None, [], []), (3, None, [])]
    got = disjoint.connected(pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] if r[1] is not None else None for r in rows], pa.list_(pa.int64()))).to_pylist()
    for (n, u, v), g in zip(rows, got, strict=True):
        if n is None or u is None:
            assert g is None
            continue
        seen, todo = set(), [0] if n else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [b if a == x else a for a, b in zip(u, v, strict=True) if x in (a, b) and 0 <= a < n and 0 <= b < n]
        assert g == (n > 0 and len(seen) == n)
    path = np.arange(100_000)
    began = time.time()
    assert (disjoint.roots(100_001, path, path + 1) == 0).all() and time.time() - began < 5


def test_connected_as_a_column_and_inside_arrays(spark):
    kind = "struct<num_nodes:bigint,edges:array<struct<u:bigint,v:bigint>>>"
    graphs = [(3, [(0, 1), (1, 2)]), (3, [(0, 1)]), (1, []), (0, []), (4, [(0, 1), (2, 3), (3, 1)])]
    frame = spark.createDataFrame([(i, g, [g]) for i, g in enumerate(graphs)], f"k int, G {kind}, A array<{kind}>")
    assert {r["k"] for r in Problem({"G": Graph(C.Connected())}).violations(frame, ["k"]).collect()} == {1, 3}
    assert {r["k"] for r in Problem({"A": Array(Graph(C.Connected()))}).violations(frame, ["k"]).collect()} == {1, 3}
    assert Problem({"G": Graph(C.Connected())}).valid(frame).count() == 3


def test_parallel_edges_and_repeats_are_named(spark):
    frame = spark.createDataFrame([(1, (3, [(0, 1), (1, 2), (2, 1), (1, 0)]))], "k int, G struct<num_nodes:bigint,edges:array<struct<u:bigint,v:bigint>>>")
    assert Problem({"G": Graph(C.NoParallelEdges())}).violations(frame, ["k"]).first()["details"] == "indices 1 and 2"
    many = spark.range(1).select(F.lit(1).alias("k"), F.concat(F.sequence(F.lit(1), F.lit(40_000)), F.array(F.lit(39_999), F.lit(5))).cast("array<bigint>").alias("A"))
    assert Problem({"A": Array(Integer(), C.DistinctElements())}).violations(many, ["k"]).first()["path"] == "indices 39998 and 40000"


def test_names_may_differ_by_case_alone(spark):
    p = Problem({"N": Integer(C.Between(1, 3)), "n": Integer(C.Between(4, 5)), "m": Integer(C.Between("N", "n"))}, seed="s")
    out = p.generate(spark, 40)
    assert out.columns[3:] == ["N", "n", "m"] and p.violations(out, ["call"]).count() == 0 and p.valid(out).count() == 40
    rows = [tuple(r)[3:] for r in out.collect()]
    assert all(1 <= a <= 3 and 4 <= b <= 5 and a <= c <= b for a, b, c in rows) and len(set(rows)) > 6
    bad = spark.createDataFrame([(1, 2, 2, 2), (2, 9, 4, 4)], "k int, N long, n long, m long")
    assert [(r["k"], r["variable"]) for r in p.violations(bad, ["k"]).orderBy("k", "variable").collect()] == [(1, "n"), (2, "N"), (2, "m")]


def test_known_values_stay_and_unset_ones_are_drawn(spark):
    p = Problem({"N": Integer(C.Between(1, 9)), "X": Integer(C.Between("N", "2 * N"))}, seed="s")
    over = spark.range(30).select((F.col("id") * 3).alias("call"), F.when(F.col("id") % 2 == 0, F.col("id") % 9 + 1).alias("N"), F.lit(7).alias("other"))
    rows = p.generate(spark, over=over).collect()
    assert [r["call"] for r in sorted(rows)] == [3 * i for i in range(30)]
    assert all(r["N"] == r["call"] // 3 % 9 + 1 for r in rows if r["call"] % 2 == 0) and all(r["N"] <= r["X"] <= 2 * r["N"] for r in rows)
    with pytest.raises(Exception, match="no value for N"):
        p.generate(spark, over=spark.createDataFrame([(1, 50)], "call long, N long")).collect()


def test_sizes_are_wishes(spark):
    p = Problem({"X": Integer(C.Between(1, 10**6), C.SizeCategory("tiny"), C.Mod(500, 1000)), "Y": Integer(C.Between(1, 10**6), C.SizeCategory("small"), C.Mod(3, 7))}, seed="s")
    rows = p.generate(spark, 60).collect()
    assert all(r["X"] % 1000 == 500 and 3 <= r["Y"] <= 300 and r["Y"] % 7 == 3 for r in rows) and len({r["X"] for r in rows}) > 30


def test_options_of_tagged_unions(spark):
    p = Problem({"V": Variant(Integer(), String(), C.OneOf([(0, 1, None), (1, None, "x")]), tags=("a", "b"))}, seed="s")
    out = p.generate(spark, 30).cache()
    assert {tuple(r["V"]) for r in out.collect()} == {(0, 1, None), (1, None, "x")} and p.violations(out, ["call"]).count() == 0
    other = spark.createDataFrame([(1, (0, 2, None)), (2, (1, None, "x"))], f"k int, V {p.variables['V'].dtype}")
    assert [r["k"] for r in p.violations(other, ["k"]).collect()] == [1]


def test_reals_between_meeting_bounds_are_known(spark):
    assert Real(C.Between("N", "N")).unique({"N": 3}) == 3.0 and Real(C.Between(2, 2)).unique() == 2.0 and Real(C.Between(1, 2)).unique() is None


def test_entry_without_the_corpus_packages(monkeypatch):
    import builtins
    import sys

    import __spark_entry__ as entry

    real = builtins.__import__

    def broken(name, *args, **kw):
        if name == "plumbline.llm" or name.startswith("xxhash"):
            raise ImportError(name)
        return real(name, *args, **kw)

    for name in [x for x in sys.modules if x.startswith("plumbline.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", broken)
    assert set(entry.queries()) >= {"gen_graph", "read_case_files"} and not any(q.startswith("op") for q in entry.queries())


def test_labels_are_numbered_by_first_sight(spark):
    from plumbline.operators import graphs

    rng = random.Random(2)
    rows = [(g, i, rng.choice("pqrstu"), rng.choice("pqrstu"), i * 3) for g in range(3) for i in range(25)]
    edges = spark.createDataFrame(rows, "graph long, at long, a string, b string, label long").repartition(6)
    out, nodes = graphs.by_first_sight(edges, ["at"])
    seen: dict = {}
    for g, _, a, b, _ in rows:
        for x in (a, b):
            seen.setdefault(g, {}).setdefault(x, len(seen[g]))
    assert {(r["graph"], r["label"]): r["node"] for r in nodes.collect()} == {(g, x): i for g, s in seen.items() for x, i in s.items()}
    assert sorted((r["graph"], r["at"], r["u"], r["v"], r["label"]) for r in out.collect()) == sorted((g, i, seen[g][a], seen[g][b], x) for g, i, a, b, x in rows)
    back = graphs.with_labels(out, nodes)
    assert sorted(map(tuple, back.select("graph", "at", "a", "b", "label").collect())) == sorted(rows)
    with pytest.raises(Exception, match="no label for node 99"):
        graphs.with_labels(out.withColumn("u", F.lit(99).cast("long")), nodes).collect()


def test_labelled_matrices_round_trip(spark):
    from plumbline.operators import graphs

    edges = [(1, 0, 1, "-5"), (1, 2, 1, "7"), (1, 2, 2, "x"), (2, 0, 0, "9")]
    nodes = spark.createDataFrame([(1, i) for i in range(3)] + [(2, 0), (3, 0), (3, 1)], "graph long, node long")
    frame = spark.createDataFrame(edges, "graph long, u long, v long, label string")
    lines = graphs.labelled_matrix(nodes, frame, "0")
    assert {(r["graph"], r["node"]): r["line"] for r in lines.collect()} == {(1, 0): "0 -5 0", (1, 1): "-5 0 7", (1, 2): "0 7 x", (2, 0): "9", (3, 0): "0 0", (3, 1): "0 0"}
    assert sorted(map(tuple, graphs.from_labelled_matrix(lines, "0").collect())) == sorted((g, min(u, v), max(u, v), x) for g, u, v, x in edges)
    for bad, why in (((1, 1, 0, "3"), "parallel"), ((1, 0, 2, "a b"), "cannot hold"), ((1, 0, 2, "0"), "cannot hold")):
        with pytest.raises(Exception, match=why):
            graphs.labelled_matrix(nodes, frame.union(spark.createDataFrame([bad], frame.schema)), "0").collect()
    for wrong, why in (([(1, 0, "0 1"), (1, 1, "2 0")], "symmetric"), ([(1, 0, "0 1"), (1, 1, "1")], "square")):
        with pytest.raises(Exception, match=why):
            graphs.from_labelled_matrix(spark.createDataFrame(wrong, "graph long, node long, line string"), "0").collect()


def test_results_are_counted_beside_a_write(spark, tmp_path):
    from plumbline.plans.results import watched

    p = Problem({"N": Integer(C.Between(1, 5)), "n": Integer(C.AtLeast("N")), "S": String(C.Alphabet("ab"))})
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).alias("N"), (F.col("id") % 10).alias("n"), F.lit("ab").alias("S")).repartition(5)
    rows, seen = watched(p, df, ["k"])
    rows.toDF("k", "x", "y", "S").write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100 == seen.cases
    assert seen.counts() == {"N": sum(i % 7 in (0, 6) for i in range(100)), "n": sum(i % 10 < i % 7 for i in range(100))} and not seen.valid()
    assert seen.first()["N"].startswith("Case 0 invalid: `N`") and seen.first()["n"].startswith("Case 10 invalid: `n`")
    rows, seen = watched(p, df.where("false"), ["k"])
    assert rows.count() == 0 and seen.valid() and seen.cases == 0 and seen.first() == {}


def test_graphs_that_are_known_and_arrays_of_one_value(spark):
    assert Graph(C.NumNodes(3), C.NumEdges(0)).unique() == {"num_nodes": 3, "edges": []}
    assert Graph(C.NumNodes("N"), C.NumEdges(2)).unique({"N": 1}) == {"num_nodes": 1, "edges": [{"u": 0, "v": 0}] * 2}
    assert Graph(C.NumNodes(1), C.NumEdges(2), C.NoParallelEdges()).unique() is None and Graph(C.NumNodes(2), C.NumEdges(2)).unique() is None
    p = Problem({"G": Graph(C.NumNodes(3), C.NumEdges(0)), "H": Graph(C.NumNodes(1), C.NumEdges(2))}, seed="s")
    row = p.generate(spark, 1).first()
    assert row["G"].asDict(True) == {"num_nodes": 3, "edges": []} and row["H"].asDict(True) == {"num_nodes": 1, "edges": [{"u": 0, "v": 0}] * 2}
    from plumbline.sources import layout as L

    fixed = Problem({"A": Array(Integer(), C.Exactly([1, 2]))})
    assert L.parse("1 2\n", fixed, L.Layout((L.Line("A"),))) == [{"A": [1, 2]}]


def test_values_of_own_types_are_shown_by_hooks(monkeypatch):
    from datetime import date

    from plumbline.functions import printer

    monkeypatch.setitem(printer.HOOKS, date, lambda d, width: f"day {d.toordinal()}"[:width])
    assert printer.shown([date(1, 1, 2), 5]) == "[day 2, 5]" and printer.shown(date(1, 1, 2), 4) == "day "


def test_formats_are_merged_where_they_are_set():
    a, b = Array(Integer(), separator=","), Array(Integer(C.AtLeast(2)))
    assert a.merged(b).separator == "," and b.merged(a).separator == "," and b.merged(b).separator == " "
    assert Real(digits=3).merged(Real()).format.digits == 6 and Graph(one_based=True).merged(Graph()).one_based and Graph().merged(Graph(one_based=True)).one_based
