"""Expressions, patterns, constraints, generation, layouts and graphs, away from the registered queries."""

from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from plumbline.errors import ConfigurationError, ExpressionEvaluationError, ExpressionParseError, ImpossibleToSatisfy, PatternParseError, ReadError, ValidationError
from plumbline.functions.expr import Expression
from plumbline.functions.pattern import Pattern
from plumbline.functions.real import Real as Exact
from plumbline.operators import constraints as C
from plumbline.operators import coverage, graphs
from plumbline.operators.specs import Array, Graph, Integer, Nothing, Real, String, Tuple, Variant
from plumbline.functions.printer import shown
from plumbline.plans import generators
from plumbline.plans.problem import Problem, merge_outputs
from plumbline.sources import layout as L

GOOD = {
    "-1 ^ 2": -1, "4 ^ 3 ^ 2": 262144, "-7 / 2": -3, "-7 % 2": -1, "7 - -3": 10, "2 * (3 + 4)": 14, "min(5)": 5, "max(1, 9, 3)": 9, "abs(-4)": 4, "x * y + 1": 22,
    "(-1) ^ 120000000000000001": -1, "9223372036854775807": 2**63 - 1, "3 ^ 39": 3**39, " x ": 3,
}


def test_expressions_on_driver_and_in_columns(spark):
    row = spark.range(1).select(F.lit(3).cast("long").alias("x"), F.lit(7).cast("long").alias("y"))
    got = row.select(*(Expression(e).column().alias(f"c{i}") for i, e in enumerate(GOOD))).first()
    assert list(got) == list(GOOD.values()) == [Expression(e).value({"x": 3, "y": 7}) for e in GOOD]


@pytest.mark.parametrize("text", ["", "()", "1 +", "* 2", "x--", "1 2", "min()", "abs(1, 2)", "f(1)", "(1, 2)", "9223372036854775808", "3 $ 4", "--3"])
def test_expressions_that_cannot_be_read(text):
    with pytest.raises(ExpressionParseError):
        Expression(text)


@pytest.mark.parametrize("text", ["1 / 0", "1 % 0", "0 ^ 0", "2 ^ -1", "2 ^ 63", "9223372036854775807 + 1"])
def test_expressions_that_fail(text):
    with pytest.raises(ExpressionEvaluationError):
        Expression(text).value()


PATTERNS = [
    ("a*", "aaaa", True), ("a*a", "aaaa", False), ("b{2,3}b", "bbb", False), ("(day|daylight)", "daylight", False), ("[a-c]+x", "abcx", True), ("[^a]", "b", True), ("[^a]", "a", False),
    ("[a-]{2}", "a-", True), ("a?b", "b", True), ("(ab|cd)e", "cde", True), ("a b", "ab", True), ("a\\ b", "a b", True), ("[0-9]{2,}", "1", False), ("a", "a\n", False), ("x{,2}", "", True),
]


def test_patterns(spark):
    rows = spark.range(1).select(*(Pattern(p).matches(F.lit(s)).alias(f"c{i}") for i, (p, s, _) in enumerate(PATTERNS))).first()
    assert list(rows) == [ok for *_, ok in PATTERNS]
    for bad in ("", "[", "[]", "(a", "a)", "(a)*", "[aa]", "[z-a]", "a{", "a\\n", "|a", "*"):
        with pytest.raises(PatternParseError):
            Pattern(bad)


def test_exact_bounds():
    assert Exact("0.1").at_least() == 0.1 and Exact("0.07").at_most() < 0.07 and Exact("-1.5").ceiling() == -1 and str(Exact(4, 8)) == "1/2" and Exact("1e2").floor() == 100


def test_first_violation_and_path(spark):
    spec = Array(Integer(C.Between(1, 9)), C.Length(C.AtMost(3)), C.DistinctElements(), C.Sorted())
    df = spark.createDataFrame([([1, 2, 3],), ([1, 12, 3],), ([1, 2, 2],), ([3, 1],), ([1, 2, 3, 4],), ([],)], "A array<bigint>")
    got = [(r["v"] and (r["v"]["path"], r["v"]["constraint"], r["v"]["details"])) for r in df.select(spec.violation(F.col("A")).alias("v")).collect()]
    assert got == [None, ("index 1", "Between", ""), ("indices 1 and 2", "DistinctElements", ""), ("indices 0 and 1", "Sorted", ""), ("length", "AtMost", ""), None]


def test_contradictions_are_found_when_declared():
    for make in (lambda: C.Between(5, 1), lambda: Integer(C.OneOf([1, 2])).also(C.OneOf([3])), lambda: C.SizeCategory("min").merged(C.SizeCategory("max"))):
        with pytest.raises(ImpossibleToSatisfy):
            make()
    with pytest.raises(ConfigurationError):
        Problem({"x": Integer(C.AtLeast("y")), "y": Integer(C.AtLeast("x"))}).order()


def test_generated_rows_are_valid_and_do_not_depend_on_partitions(spark):
    p = Problem({
        "N": Integer(C.Between(1, 6)), "X": Integer(C.Between("N", "3 * N"), C.Mod(1, 2)), "R": Real(C.Between(0, Exact(1, 2))), "S": String(C.SimplePattern("[a-c]{1,4}x"), C.Length(C.AtLeast(3))),
        "D": String(C.Alphabet("LowerCase"), C.Length("N"), C.DistinctCharacters()), "A": Array(Integer(C.Between(1, 12)), C.Length("N"), C.DistinctElements(), C.Sorted(descending=True)),
        "T": Tuple(Integer(C.Between(0, 3)), String(C.OneOf(["p", "q"]))), "V": Variant(Nothing(), Integer(C.Between(5, 6)), tags=("none", "int")),
        "G": Graph(C.NumNodes(C.Between(2, 6)), C.NumEdges(C.Between(0, 9)), C.Connected(), C.SimpleGraph()), "E": Integer(C.Between(0, 999), C.Custom("third", lambda x: x % 7 == 3)),
    }, seed="s")
    one, two = p.generate(spark, 120, partitions=1), p.generate(spark, 120, partitions=5)
    assert p.violations(one, ["gen", "call", "idx"]).count() == 0
    text = lambda df: sorted(str(r) for r in df.collect())
    assert text(one) == text(two) and one.count() == 120
    assert one.select("N").distinct().count() == 6 and one.where("V.tag = 0").count() > 10


def test_strict_mode_names_the_first_bad_case(spark):
    p = Problem({"N": Integer(C.Between(1, 10))})
    with pytest.raises(ValidationError, match="Case 2 "):
        p.require_valid(spark.createDataFrame([(1, 5), (2, 123), (3, 0)], "case long, N long"), ["case"])


def test_edge_cases_and_coverage(spark):
    assert set(Integer(C.Between(-5, 300)).edge_values()) >= {-5, 300, 0, 1, -1, 127, 128, 129, 256, -4, 299, 17} and all(-5 <= x <= 300 for x in Integer(C.Between(-5, 300)).edge_values())
    for dims, t, n in (([3, 3, 3], 3, 27), ([2, 3, 4, 2], 4, 48), ([3, 3, 3, 3], 2, None), ([3, 4, 1, 2], 2, None)):
        rows = coverage.covering_array(dims, t)
        assert n is None or len(rows) == n
        for cols in combinations(range(len(dims)), t):
            assert {tuple(r[c] for c in cols) for r in rows} == set(product(*(range(dims[c]) for c in cols)))
    options = {"a": [1, 2], "b": ["x", "y"], "c": [0, 1, 2]}
    full = coverage.covering_frame(spark, options, 2)
    assert coverage.uncovered(full, options, 2).count() == 0 and coverage.uncovered(full.limit(1), options, 2).count() == 3
    assert Problem({"a": Integer(C.Between(1, 2)), "b": Integer(C.Between(3, 4))}).edge_case_product(spark).count() == 4


PROBES = {
    "one of and bounds": Integer(C.OneOf([3, 40, 5, 77]), C.AtMost(9)),
    "one of and length": String(C.OneOf(["a", "bcd", "efghi"]), C.Length(C.Between(2, 3))),
    "sorted by a key": Array(Integer(C.Between(-20, 20)), C.Length(6), C.Sorted(key=F.abs)),
    "custom elements": Array(Integer(C.Between(0, 99), C.Custom("even", lambda x: x % 2 == 0)), C.Length(5)),
    "pattern and length in a tuple": Tuple(String(C.SimplePattern("[a-c]{1,6}"), C.Length(4)), Integer(C.Between(1, 2))),
    "distinct of many": Array(Integer(C.Between(1, 10**12)), C.Length(20), C.DistinctElements()),
    "distinct of as many": Array(Integer(C.Between(1, 5000)), C.Length(5000), C.DistinctElements()),
    "whole range": Integer(C.Between(-(2**63 - 1), 2**63 - 1)),
    "no bound": Integer(),
    "half bound": Integer(C.AtLeast(2**62)),
    "multiple of a wide range": Integer(C.Between(-(2**63 - 1), 2**63 - 1), C.Mod(5, 7)),
    "exact edges": Graph(C.NumNodes(5), C.NumEdges(4), C.SimpleGraph()),
    "connected in as many edges as needed": Graph(C.NumNodes(C.Between(2, 9)), C.NumEdges(C.Between(0, 8)), C.Connected()),
    "one node without loops": Graph(C.NumNodes(1), C.NumEdges(C.Between(0, 5)), C.Loopless()),
    "sparse": Graph(C.NumNodes(2000), C.NumEdges(30), C.SimpleGraph()),
}


@pytest.mark.parametrize("name", PROBES)
def test_generated_values_satisfy_their_constraints(spark, name):
    p = Problem({"X": PROBES[name]}, seed="probe")
    out = p.generate(spark, 40, partitions=2).cache()
    assert p.violations(out, ["call"]).count() == 0 and out.where("X is not null").count() == 40


def test_wide_draws_reach_both_ends(spark):
    out = Problem({"X": Integer()}, seed="w").generate(spark, 400).select(F.min("X"), F.max("X"), F.sum((F.col("X") % 2 == 0).cast("int"))).first()
    assert out[0] < -(2**62) and out[1] > 2**62 and 150 < out[2] < 250


def test_impossible_values_are_errors_and_rows_are_drawn_again(spark):
    p = Problem({"N": Integer(C.Between(1, 10)), "X": Integer(C.Between(8, "N")), "A": Array(Integer(C.Between(1, "X")), C.Length("N"), C.Sorted())}, seed="r")
    out = p.generate(spark, 60).cache()
    assert p.violations(out, ["call"]).count() == 0 and {r["N"] for r in out.select("N").collect()} == {8, 9, 10}
    for bad in (Integer(C.OneOf([1, 2]), C.AtLeast(5)), Graph(C.NumNodes(5), C.NumEdges(C.AtMost(2)), C.Connected()), Array(Integer(C.Between(1, 3)), C.Length(4), C.DistinctElements())):
        with pytest.raises(Exception, match="no value for X"):
            Problem({"X": bad}, seed="r").generate(spark, 3).collect()


def test_unique_values_follow_known_ones():
    assert Integer(C.Exactly("N + 1")).unique({"N": 4}) == 5 and Integer(C.Exactly("N")).unique() is None
    assert Array(Integer(), C.Length("2 * N")).length().unique({"N": 3}) == 6
    assert Integer(C.OneOf(["N", 7]), C.OneOf([7, 9])).unique({"N": 2}) == 7


def test_edge_case_product_of_all_kinds(spark):
    p = Problem({"N": Integer(C.Between(1, 3)), "S": String(C.Alphabet("ab"), C.Length(C.Between(1, 2))), "A": Array(Integer(C.Between(5, 6)), C.Length(C.Between(0, 3))), "R": Real(C.Between(0, 1))}, seed="e")
    out = p.edge_case_product(spark).cache()
    assert out.count() == 3 * 2 * 4 and out.select("N", F.length("S"), F.size("A")).distinct().count() == 24
    assert p.violations(out, ["N"]).count() == 0 and out.where("S is null or A is null or R is null").count() == 0


def test_merge_needs_the_same_cases(spark):
    left, right = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "case long, N long"), spark.createDataFrame([(1, 50), (2, 60)], "case long, X long")
    with pytest.raises(Exception, match="no output for key 3"):
        merge_outputs(left, right, ["case"]).collect()
    assert sorted(map(tuple, merge_outputs(left.where("case < 3"), right, ["case"]).collect())) == [(1, 5, 50), (2, 6, 60)]
    with pytest.raises(ValidationError, match="no cases"):
        Problem({"N": Integer()}).require_valid(left.where("false"), ["case"])


def test_graphs_as_edge_tables(spark):
    nodes = spark.createDataFrame([(g, n) for g in (0, 1) for n in range(6)], "graph long, node long")
    edges = spark.createDataFrame([(0, i, i + 1) for i in range(5)] + [(1, 0, 1), (1, 1, 0), (1, 2, 2), (1, 4, 5)], "graph long, u long, v long")
    got = {r["graph"]: (r["n_components"], r["connected"]) for r in graphs.connected(nodes, edges).collect()}
    assert got == {0: (1, True), 1: (4, False)}
    assert [tuple(r) for r in graphs.shape(edges).orderBy("graph").collect()] == [(0, 5, 0, 0, True), (1, 4, 1, 1, False)]


def test_matrices_round_trip(spark):
    nodes = spark.createDataFrame([(g, n) for g in (0, 1) for n in range(4)], "graph long, node long")
    edges = [(0, 0, 1), (0, 0, 1), (0, 2, 2), (0, 1, 3)]
    lines = graphs.matrix(nodes, spark.createDataFrame(edges, "graph long, u long, v long"))
    assert [r["line"] for r in lines.where("graph = 0").orderBy("node").collect()] == ["0 2 0 0", "2 0 0 1", "0 0 1 0", "0 1 0 0"]
    assert sorted(map(tuple, graphs.from_matrix(lines).collect())) == sorted(edges)
    assert graphs.from_matrix(lines.where("false")).count() == 0
    for bad in (["0 1", "0 0"], ["0", "0"], ["0 -1", "-1 0"], ["0 1 0", "1 0 0"], ["0  1", "1 0"], ["0 x", "x 0"], [None, "0 0"], ["0 1"]):
        frame = spark.createDataFrame([(7, i, t) for i, t in enumerate(bad)], "graph long, node long, line string")
        with pytest.raises(Exception, match="matrix|count"):
            graphs.from_matrix(frame).collect()


LAYOUT = L.Layout((L.Line("K"), L.Multiline("K + 1", "P", "Q")), header=(L.Line(L.Literal("top"), L.Literal("line")),), footer=(L.Line(L.Literal("bottom")),), counted=True)
CASES = Problem({"K": Integer(C.Between(0, 8)), "P": Array(Integer(), C.Length("K + 1")), "Q": Array(Integer(C.AtMost(900)), C.Length("K + 1"))}, input=LAYOUT, seed="s")


def test_layouts_round_trip(spark, tmp_path):
    text = "top line\n2\n1\n-4 70\n15 8\n0\n600 0\nbottom\n"
    assert L.parse(text, CASES, LAYOUT) == [{"K": 1, "P": [-4, 15], "Q": [70, 8]}, {"K": 0, "P": [600], "Q": [0]}]
    for bad in (text + "x", text.replace("-4 70", "-4  70"), text.replace("2\n1", "3\n1"), text.replace("70", "+70"), text.replace("15", "015"), text[:-4]):
        with pytest.raises(ReadError):
            L.parse(bad, CASES, LAYOUT)
    (tmp_path / "a.in").write_text(text)
    (tmp_path / "b.in").write_text("top line\nx\n")
    (tmp_path / "c.in").write_text(text.replace("600 0", "600 901"))
    rows = L.read_cases(spark, str(tmp_path), CASES, LAYOUT, strict=False).orderBy("file", "case").collect()
    assert [(r["case"], r["K"], r["error"] is None) for r in rows] == [(1, 1, True), (2, 0, True), (0, None, False), (1, 1, True), (2, 0, False)]
    assert "Case 2 invalid: `Q` index 0 is 901" in rows[-1]["error"]
    with pytest.raises(Exception, match="Case 2 invalid"):
        L.read_cases(spark, str(tmp_path / "c.in"), CASES, LAYOUT).collect()
    df = spark.createDataFrame([("g", 0, 1, 1, [1, 2], [3, 4])], "gen string, call long, idx long, K long, P array<bigint>, Q array<bigint>")
    assert [r["file"] for r in L.write_cases(CASES, df, f"file://{tmp_path}/out").collect()] == ["g_0_1.in"]
    assert (tmp_path / "out/g_0_1.in").read_text() == "top line\n1\n1\n1 3\n2 4\nbottom\n"


def test_sizes_that_were_read_before(spark):
    p = Problem({"N": Integer(C.Between(1, 9)), "A": Array(Integer(), C.Length("N")), "M": Integer(), "G": Graph(C.NumNodes("N"), C.NumEdges("M"))})
    layout = L.Layout((L.Line("N", "M"), L.Line("A"), L.Multiline("M", "G")))
    assert L.parse("3 2\n5 6 7\n0 1\n2 2\n", p, layout) == [{"N": 3, "M": 2, "A": [5, 6, 7], "G": {"num_nodes": 3, "edges": [{"u": 0, "v": 1}, {"u": 2, "v": 2}]}}]
    cursor = L.Cursor("ab c")
    assert (cursor.peek(), cursor.word(), cursor.peek()) == ("ab", "ab", None)


def test_arrays_of_reals_are_written(spark):
    p = Problem({"R": Array(Real(digits=2)), "S": Array(Array(Real(digits=1)))})
    df = spark.createDataFrame([(1, [0.125, -2.0], [[0.25, 1.0], [3.14]])], "k long, R array<double>, S array<array<double>>")
    assert L.render(p, L.Layout((L.Line("R"), L.Multiline("2", "S"))), df, ["k"]).first()["text"] == "0.12 -2.00\n0.2 1.0\n3.1\n"


def test_generators_with_arguments(spark):
    p = Problem({"N": Integer(C.Between(3, 50)), "A": Array(Integer(C.Between(1, 9)), C.Length("N"))}, seed="g")

    def ends(d):
        return [{"N": d.least("N")}, {"N": d.greatest("N")}, {"N": d.value("N", C.AtMost(d.arg("top", int, low=1)))}]

    out = generators.run(spark, p, [generators.Generator("ends", ends, 4, {"top": "5"}), generators.Generator("plain", lambda d: {"A": d.shuffled(F.array(*map(F.lit, range(1, 8))).cast("array<bigint>")), "N": 7}, 2)]).cache()
    assert p.violations(out, ["gen", "call", "idx"]).count() == 0 and out.count() == 14
    assert {r["N"] for r in out.where("gen = 'ends' and idx = 1").collect()} == {3} and {r["N"] for r in out.where("gen = 'ends' and idx = 2").collect()} == {50}
    assert {r["N"] for r in out.where("gen = 'ends' and idx = 3").collect()} <= {3, 4, 5} and sorted(out.where("gen = 'plain'").first()["A"]) == list(range(1, 8))
    for bad in ({}, {"top": "x"}, {"top": "0"}):
        with pytest.raises(ConfigurationError):
            generators.run(spark, p, [generators.Generator("ends", ends, 1, bad)])
    with pytest.raises(Exception, match="no value for N"):
        generators.run(spark, p, [generators.Generator("bad", lambda d: {"N": 99})]).collect()


def test_values_are_shown_in_short():
    assert shown([1, 2, 3]) == "[1, 2, 3]" and shown(None) == "unset" and shown("a\nb") == "`a[ASCII 10]b`"
    assert len(shown("x" * 500)) < 110 and shown(list(range(1000))).endswith("more)]") and len(shown(list(range(1000)))) < 130
    assert shown({"tag": 1, "_0": None, "_1": 5}) == "(alternative 1) 5" and shown({"_0": 1, "_1": "q"}) == "<1, `q`>"
    assert shown({"num_nodes": 2, "edges": [{"u": 0, "v": 1}]}) == "Graph(n=2, m=1, edges=[0-1])"


def test_codecs(spark):
    v = Variant(Integer(), String(), Nothing(), tags=("int", "str", "none"))
    p = Problem({"V": v, "R": Real(digits=1), "T": Tuple(Integer(), String())})
    layout = L.Layout((L.Line("V"), L.Line("R", "T")))
    assert L.parse("str two\n0.5 3 x\n", p, layout)[0] == {"V": {"tag": 1, "_0": None, "_1": "two", "_2": None}, "R": 0.5, "T": {"_0": 3, "_1": "x"}}
    df = spark.createDataFrame([(1, (0, 22, None, None), 0.25, (3, "x")), (2, (2, None, None, None), 0.35, (4, "y"))], f"k long, V {v.dtype}, R double, T struct<_0:bigint,_1:string>")
    assert [r["text"] for r in L.render(p, layout, df, ["k"]).orderBy("k").collect()] == ["int 22\n0.2 3 x\n", "none\n0.3 4 y\n"]


def test_streams_use_the_same_checks(spark, tmp_path):
    from plumbline.streaming import checks

    spark.createDataFrame([(1, 5), (2, 50)], "k long, N long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, N long").parquet(str(tmp_path / "in"))
    query = checks.violations(Problem({"N": Integer(C.AtMost(9))}), stream, ["k"]).writeStream.format("memory").queryName("bad").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r["k"] for r in spark.table("bad").collect()] == [2]
