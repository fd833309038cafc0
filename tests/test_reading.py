"""Sections of large files, case files as a data source, and what the strict reader refuses."""

import pickle
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from plumbline.errors import ConfigurationError, ReadError
from plumbline.operators import constraints as C
from plumbline.operators.specs import Array, Graph, Integer, Real, String
from plumbline.plans.problem import Problem
from plumbline.sources import cases as S
from plumbline.sources import layout as L
from plumbline.sources import runs, sections

FULL = L.Layout(
    (L.Line("N", "M"), L.Line(L.Literal("row"), "A", "R"), L.Multiline("N", "B", "D"), L.Multiline("M", "G"), L.Line("K"), L.Multiline("K + 1", "E")),
    header=(L.Line(L.Literal("begin"), L.Literal("of")),), footer=(L.Line(L.Literal("end")),), counted=True,
)
PROBLEM = Problem({
    "N": Integer(C.Between(1, 8)), "M": Integer(C.AtLeast(0)), "A": Array(Integer(), C.Length("2")), "R": Real(digits=1), "B": Array(Integer(), C.Length("N")), "D": Array(String(), C.Length("N")),
    "G": Graph(C.NumNodes("N"), C.NumEdges("M"), edge_label=Integer()), "K": Integer(), "E": Array(Integer(), C.Length("K + 1")),
}, input=FULL)


def text_of_cases(n: int, seed: int = 3) -> str:
    rng, out = random.Random(seed), []
    for _ in range(n):
        nodes, m, k = rng.randint(1, 8), rng.randint(0, 4), rng.randint(0, 5)
        out.append(f"{nodes} {m}\nrow {rng.randint(0, 9)} -4 {rng.randint(0, 9)}.5\n")
        out += [f"{rng.randint(0, 30)} s{i}\n" for i in range(nodes)]
        out += [f"{rng.randrange(nodes)} {rng.randrange(nodes)} {i}\n" for i in range(m)]
        out += [f"{k}\n", *(f"{rng.randint(0, 9)}\n" for _ in range(k + 1))]
    return f"begin of\n{n}\n" + "".join(out) + "end\n"


def plain(row) -> dict:
    return {k: v for k, v in row.asDict(True).items() if k in PROBLEM.variables}


@pytest.mark.parametrize("chunk_lines", [4, 1 << 16])
def test_sections_equal_the_strict_reader(spark, tmp_path, chunk_lines):
    for i, n in enumerate((25, 0, 1)):
        (tmp_path / f"{i}.in").write_text(text_of_cases(n, i))
    got = sections.read_sections(spark, str(tmp_path), PROBLEM, FULL, chunk_lines=chunk_lines).orderBy("file", "case").collect()
    want = [r for i, n in enumerate((25, 0, 1)) for r in L.parse(text_of_cases(n, i), PROBLEM, FULL)]
    assert [plain(r) for r in got] == want and [r["case"] for r in got] == [*range(1, 26), 1]


def test_sections_report_what_does_not_fit(spark, tmp_path):
    text = text_of_cases(6)
    bad = {
        "newline": text[:-1], "header": text.replace("begin", "start"), "footer": text + "more\n", "count": text.replace("\n6\n", "\n7\n", 1), "cell": text.replace("row 5", "row  5", 1) if "row 5" in text else text.replace("row ", "row  ", 1),
        "literal": text.replace("\nrow", "\nraw", 1), "section": text.replace(" s0\n", " s0 x\n", 1), "start": "begin of\n6\nx 1\nend\n", "empty": "", "number": text.replace("\n6\n", "\n06\n", 1),
    }
    for name, t in bad.items():
        (tmp_path / f"{name}.in").write_text(t)
        with pytest.raises(ReadError):
            L.parse(t, PROBLEM, FULL)
    (tmp_path / "good.in").write_text(text)
    got = sections.read_sections(spark, str(tmp_path), PROBLEM, FULL, strict=False, chunk_lines=8)
    failed = {r["file"].rpartition("/")[2].removesuffix(".in") for r in got.where("error is not null").select("file").distinct().collect()}
    assert failed == set(bad) - {"empty"}  # a file of no bytes has no line that could be wrong
    with pytest.raises(Exception, match="expected 7 cases"):
        sections.read_sections(spark, str(tmp_path / "count.in"), PROBLEM, FULL).collect()
    with pytest.raises(ConfigurationError):
        sections.phases_of(PROBLEM, L.Layout((L.Multiline("N", "B"), L.Line("N"))))


def test_a_section_may_span_chunks(spark, tmp_path):
    p = Problem({"N": Integer(), "B": Array(Integer(), C.Length("N"))})
    layout = L.Layout((L.Line("N"), L.Multiline("N", "B")))
    sizes = [0, 700, 1, 0, 3000, 2]
    (tmp_path / "a.in").write_text("".join(f"{n}\n" + "5\n" * n for n in sizes))
    got = sections.read_sections(spark, str(tmp_path / "a.in"), p, layout, chunk_lines=64).orderBy("case").collect()
    assert [(r["N"], len(r["B"])) for r in got] == [(n, n) for n in sizes]


def test_graphs_with_other_nodes_are_errors(spark, tmp_path):
    p = Problem({"N": Integer(), "G": Graph(C.NumNodes("N"), C.NumEdges(C.AtLeast(0)))}, input=L.Layout((L.Line("N"), L.Multiline("1", "G"))))
    for edge in ("9 1", "0 -4", "3 0"):
        with pytest.raises(ReadError, match="is not one of 0 ... 2"):
            L.parse(f"3\n{edge}\n", p, p.input)
        (tmp_path / "a.in").write_text(f"3\n{edge}\n")
        row = sections.read_sections(spark, str(tmp_path / "a.in"), p, p.input, strict=False).first()
        assert "edge 0" in row["error"]
    frame = spark.createDataFrame([(1, (3, [(0, 2)])), (2, (3, [(0, 2), (3, 1)])), (3, (3, []))], "k long, G struct<num_nodes:bigint,edges:array<struct<u:bigint,v:bigint>>>")
    free = Problem({"G": Graph()})
    assert [(r["k"], r["constraint"], r["path"], r["value"]) for r in free.violations(frame, ["k"]).collect()] == [(2, "EdgeNodes", "edge 1", "3 1")]
    assert free.valid(frame).count() == 2


LAYOUT = L.Layout((L.Line("N"), L.Multiline("N", "B")), counted=True)
FILES = Problem({"N": Integer(C.Between(0, 5)), "B": Array(Integer(), C.Length("N")), "X": Integer()}, input=LAYOUT, output=L.Layout((L.Line("X"),)))


def test_case_files_are_a_data_source(spark, tmp_path):
    rows = [("g", i, i % 3, [i] * (i % 3), i * 7 if i % 2 else None) for i in range(40)]
    frame = spark.createDataFrame(rows, "gen string, call long, N long, B array<bigint>, X long").repartition(4)
    S.save(FILES, frame, f"file://{tmp_path}/out", "numbers", "{gen}/{call}")
    listed = (tmp_path / "out/_cases").read_text().split()
    assert len(listed) == 60 and all((tmp_path / "out" / x).exists() for x in listed) and (tmp_path / "out/g/4.in").read_text() == "1\n1\n4\n"
    got = S.load(spark, FILES, f"{tmp_path}/out", "numbers", task_bytes=40)
    assert got.rdd.getNumPartitions() > 4
    assert sorted((r["file"], r["case"], r["N"], r["B"], r["error"]) for r in got.collect()) == sorted((f"g/{i}.in", 1, n, b, None) for _, i, n, b, _ in rows)
    answers = spark.read.format("numbers").options(suffix=".ans", which="output").load(f"{tmp_path}/out")
    assert {r["X"] for r in answers.collect()} == {i * 7 for i in range(1, 40, 2)}
    (tmp_path / "out/g/bad.in").write_text("1\n6\nx\n")
    (tmp_path / "out/g/far.in").write_text("1\n6\n" + "1\n" * 6)
    errors = {r["file"]: r["error"] for r in S.load(spark, FILES, f"{tmp_path}/out", "numbers", strict=False).where("error is not null").collect()}
    assert set(errors) == {"g/bad.in", "g/far.in"} and "Case 1 invalid: `N`" in errors["g/far.in"]
    with pytest.raises(Exception, match="expected an integer"):
        S.load(spark, FILES, f"{tmp_path}/out/g/bad.in", "numbers").collect()


def test_names_that_meet_and_tasks_that_fail_leave_no_file(spark, tmp_path):
    frame = spark.createDataFrame([("g", i, 1, [i]) for i in range(6)], "gen string, call long, N long, B array<bigint>").repartition(3)
    with pytest.raises(Exception, match="one file name"):
        S.save(FILES, frame, f"file://{tmp_path}/same", "numbers", "{gen}")
    broken = frame.withColumn("B", F.when(F.col("call") == 5, F.array().cast("array<bigint>")).otherwise(F.col("B")))
    with pytest.raises(Exception, match="as many lines"):
        S.save(FILES, broken, f"file://{tmp_path}/broken", "numbers", "{call}")
    left = [x for top in ("same", "broken") for x in (tmp_path / top).rglob("*") if (tmp_path / top).exists() and x.suffix in (".in", ".ans")]
    assert left == []


def test_files_are_packed_in_order():
    files = [("c", 5), ("a", 50), ("b", 1), ("d", 1), ("e", 90)]
    assert S.packed(files, 20) == [["a"], ["b", "c", "d"], ["e"]] and S.packed([], 5) == [] and S.packed(files, 1000, 2) == [["a", "b"], ["c", "d"], ["e"]]


def names_of(partitions: list) -> list[str]:
    return [x for p in partitions for x in p.listed()]


def test_the_driver_holds_few_names(tmp_path, monkeypatch):
    """Messages and partitions of many files are small; lists are merged in several passes."""
    monkeypatch.setattr(runs, "RUN", 100)
    monkeypatch.setattr(runs, "WAYS", 3)
    top, n = tmp_path / "out", 4000
    writer = S.CaseWriter({"path": f"file://{top}", "pattern": "{gen}/{call}"})
    order = random.Random(5).sample(range(n), n)
    sent = [writer.write(Row(gen="g", call=i, input=f"1\n{i}\n", answer=None) for i in order[k::4]) for k in range(4)]
    assert sum(len(pickle.dumps(m)) for m in sent) < n
    writer.commit([*sent, None])
    want = sorted(f"g/{i}.in" for i in range(n))
    assert (top / "_cases").read_text().split() == want == sorted(str(x.relative_to(top)) for x in top.rglob("*") if x.is_file() and x.name != "_cases")
    assert all((top / f"g/{i}.in").read_text() == f"1\n{i}\n" for i in range(n)) and {x.name for x in top.iterdir()} == {"_cases", "g"}
    planned = S.CaseReader(FILES, LAYOUT, {"path": f"{top}/", "task_bytes": "5000"}, None).partitions()
    assert names_of(planned) == want and len(planned) > 4
    whole = S.CaseReader(FILES, LAYOUT, {"path": f"file://{top}"}, None).partitions()
    assert len(whole) == 2 and sum(len(pickle.dumps(x)) for x in whole) < 5 * n


def test_names_that_meet_across_tasks_are_found_before_a_file_moves(tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "RUN", 4)
    monkeypatch.setattr(runs, "WAYS", 2)
    writer = S.CaseWriter({"path": f"file://{tmp_path}/out", "pattern": "{call}"})
    sent = [writer.write(Row(call=i, input="x\n", answer="y\n") for i in part) for part in (range(20), range(40, 60), [70, 71, 7])]
    with pytest.raises(ConfigurationError, match="one file name"):
        writer.commit(sent)
    writer.abort([*sent, None])
    assert list((tmp_path / "out").iterdir()) == []


def test_a_folder_without_files_has_no_rows(spark, tmp_path):
    assert S.load(spark, FILES, str(tmp_path), "numbers").collect() == []
    (tmp_path / "b").mkdir()
    (tmp_path / "b/_x.in").write_text("1\n0\n")
    (tmp_path / "b/c.in").write_text("1\n0\n")
    assert [(r["file"], r["N"], r["B"]) for r in S.load(spark, FILES, f"{tmp_path}/", "numbers").collect()] == [("b/c.in", 0, [])]
