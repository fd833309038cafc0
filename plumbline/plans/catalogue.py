"""The registered queries: each applies an operator to whole tables, with its DuckDB SQL beside it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import draw
from plumbline.functions.expr import Expression
from plumbline.functions.real import Real as Exact
from plumbline.operators import graphs
from plumbline.operators.constraints import (
    Alphabet, AtLeast, AtMost, Between, Connected, Custom, DistinctCharacters, DistinctElements, Element, Elements, Exactly, Length, Mod, NumEdges, NumNodes, OneOf, SimpleGraph, SimplePattern, SizeCategory, Sorted, literal,
)
from plumbline.operators.coverage import covering_array, covering_table
from plumbline.operators.specs import Array, Graph, Integer, Real, String, Tuple, Variant, size_range
from plumbline.plans.problem import Problem, merge_outputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A scan's rows over all cores, where its files are cut into fewer tasks: for drawing, which costs far more in a row than the shuffle of its key."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def counts(problem: Problem, df: DataFrame) -> DataFrame:
    return problem.summary(df)


def count_sql(source: str, tests: list[tuple[str, str, str]]) -> str:
    """Violations by variable and constraint; the first broken constraint of a variable counts."""
    parts = [f"select '{v}' as variable, '{c}' as constraint, count(*) as violations from {source} where {bad} having count(*) > 0" for v, c, bad in tests]
    return " union all ".join(parts)


NUMERIC = {
    "l_quantity": Real(Between(2, 49)),
    "l_discount": Real(Between(0, Exact(9, 100))),
    "l_tax": Real(AtMost(Exact("0.065"))),
    "l_linenumber": Integer(AtLeast(2)),
}


@register(count_sql("lineitem", [
    ("l_quantity", "Between", "not (l_quantity between 2 and 49)"), ("l_discount", "Between", "not (l_discount between 0 and 0.09)"),
    ("l_tax", "AtMost", "l_tax > 0.065"), ("l_linenumber", "AtLeast", "l_linenumber < 2"),
]))
def validate_numeric_bounds(spark, sf_dir):
    return counts(Problem(NUMERIC), table(spark, sf_dir, "lineitem").select(*NUMERIC))


@register(count_sql("orders", [("o_orderstatus", "OneOf", "o_orderstatus not in ('F', 'O')"), ("o_orderpriority", "OneOf", "o_orderpriority not in ('1-URGENT', '2-HIGH')")]))
def validate_one_of(spark, sf_dir):
    p = Problem({"o_orderstatus": String(OneOf(["F", "O"])), "o_orderpriority": String(OneOf(["1-URGENT", "2-HIGH"]))})
    return counts(p, table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority"))


@register(count_sql("orders", [("o_orderkey", "Mod", "((o_orderkey % 7) + 7) % 7 <> 3"), ("o_custkey", "Mod", "o_custkey % (o_orderkey % 5 + 2) <> 1")]))
def validate_mod(spark, sf_dir):
    p = Problem({"o_orderkey": Integer(Mod(3, 7)), "o_custkey": Integer(Mod(1, "o_orderkey % 5 + 2"))})
    return counts(p, table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))


@register("""select p_partkey, 'p_size' as variable, 'Between' as "constraint", cast(p_size as varchar) as value from part
where not (p_size between p_partkey % 10 + 1 and least(p_partkey % 50 + 1, 45))""")
def validate_dependent_bounds(spark, sf_dir):
    p = Problem({"p_size": Integer(Between("p_partkey % 10 + 1", "min(p_partkey % 50 + 1, 45)"))})
    return p.violations(table(spark, sf_dir, "part").select("p_partkey", "p_size"), ["p_partkey"]).select("p_partkey", "variable", "constraint", "value")


@register("""select l_orderkey, l_linenumber, l_quantity >= 10 and l_quantity <= 40 and l_linenumber in (1, 3, 5) as ok from lineitem
where l_quantity >= 10 and l_quantity <= 40 and l_linenumber in (1, 3, 5)""")
def filter_valid(spark, sf_dir):
    p = Problem({"l_quantity": Real(Between(10, 40)), "l_linenumber": Integer(OneOf([1, 3, 5]))})
    return p.valid(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")).select("l_orderkey", "l_linenumber", F.lit(True).alias("ok"))


EXPRESSIONS = {
    "arith": ("3 * l_partkey - (l_suppkey + 7) * -2", "3 * l_partkey - (l_suppkey + 7) * -2"),
    "divided": ("(l_suppkey - l_partkey) / 7", "(l_suppkey - l_partkey) // 7"),
    "rest": ("(l_suppkey - l_partkey) % 7", "(l_suppkey - l_partkey) % 7"),
    "powered": ("(l_linenumber - 4) ^ 3 + 2 ^ l_linenumber", "(l_linenumber - 4) * (l_linenumber - 4) * (l_linenumber - 4) + (1::bigint << l_linenumber)"),
    "signed": ("-l_linenumber ^ 2", "-(l_linenumber::bigint * l_linenumber)"),
    "least": ("min(l_partkey, l_suppkey * 20, 500)", "least(l_partkey, l_suppkey * 20, 500)"),
    "most": ("max(abs(l_suppkey - l_partkey), l_linenumber)", "greatest(abs(l_suppkey - l_partkey), l_linenumber)"),
}


@register("select l_orderkey, l_linenumber, " + ", ".join(f"cast({s} as bigint) as {n}" for n, (_, s) in EXPRESSIONS.items()) + " from lineitem")
def expressions(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.select("l_orderkey", "l_linenumber", *(Expression(e).column().alias(n) for n, (e, _) in EXPRESSIONS.items()))


@register("""select l_orderkey, l_linenumber, 'l_quantity' as variable, case when l_quantity < 5 then 'AtLeast' else 'AtMost' end as "constraint" from lineitem where l_quantity < 5 or l_quantity > 45
union all select l_orderkey, l_linenumber, 'l_suppkey', 'Mod' from lineitem where l_suppkey % 3 <> 1""")
def violations_long(spark, sf_dir):
    p = Problem({"l_quantity": Real(AtLeast(5), AtMost(45)), "l_suppkey": Integer(Mod(1, 3))})
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey")
    return p.violations(df, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "variable", "constraint")


_STYLED = "select d.doc_id, quality, toxic, n_chars from documents d left join labels l on d.doc_id = l.doc_id"


@register(f"""with d as ({_STYLED}), v as (
  select 'only_set_variables' as style, 'quality' as variable from d where quality = 0
  union all select 'all_variables', 'quality' from d where quality is null or quality = 0
  union all select 'all_variables', 'source_rank' from d
  union all select 'only_set_values', 'quality' from d where quality = 0
  union all select 'only_set_values', 'n_chars' from d union all select 'only_set_values', 'toxic' from d where toxic is not null
  union all select 'everything', 'quality' from d where quality is null or quality = 0
  union all select 'everything', 'source_rank' from d union all select 'everything', 'n_chars' from d union all select 'everything', 'toxic' from d where toxic is not null)
select style, variable, count(*) as n from v group by 1, 2""")
def validation_styles(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "n_chars", "quality", "toxic")
    p = Problem({"quality": Integer(Exactly(1)), "source_rank": Integer(AtLeast(0))})
    out = None
    for style in ("none", "only_set_variables", "only_set_values", "all_variables", "everything"):
        part = p.violations(docs, ["doc_id"], style).select(F.lit(style).alias("style"), "variable")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("style", "variable").agg(F.count("*").alias("n"))


@register("""select 'text' as variable, 'Between' as "constraint", doc_id from documents where not (length(text) between 200 and n_chars)
union all select 'lang', 'Alphabet', doc_id from documents where translate(lang, 'defr', '') <> ''""")
def string_rules(spark, sf_dir):
    p = Problem({"text": String(Length(Between(200, "n_chars"))), "lang": String(Alphabet("defr"))})
    return p.violations(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text", "lang"), ["doc_id"]).select("variable", "constraint", "doc_id")


@register("select p_partkey, cast(len(list_distinct(string_split(p_brand, ''))) = length(p_brand) as boolean) as distinct_chars, translate(p_name, 'abcdefghijklmnopqrstuvwxyz ', '') = '' as plain from part")
def string_characters(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    distinct, plain = DistinctCharacters(), Alphabet("abcdefghijklmnopqrstuvwxyz ")
    return df.select("p_partkey", distinct.holds(F.col("p_brand")).alias("distinct_chars"), plain.holds(F.col("p_name")).alias("plain"))


PATTERNS = {"c_name": ("Customer#[0-9]{8}[1-9]", "Customer#[0-9]{8}[1-9]"), "c_mktsegment": ("[A-Z]{1,8}", "[A-Z]{1,8}")}


@register(" union all ".join(f"select c_custkey, '{c}' as variable from customer where not regexp_full_match({c}, '{r}')" for c, (_, r) in PATTERNS.items()))
def pattern_match(spark, sf_dir):
    p = Problem({c: String(SimplePattern(t)) for c, (t, _) in PATTERNS.items()})
    return p.violations(table(spark, sf_dir, "customer").select("c_custkey", *PATTERNS), ["c_custkey"]).select("c_custkey", "variable")


@register("select p_partkey, regexp_full_match(p_brand, 'Brand#[0-9]{' || (p_size % 2 + 1)::varchar || '}') as fits from part")
def pattern_row_bounds(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", SimplePattern("Brand#[0-9]{p_size % 2 + 1}").holds(F.col("p_brand")).alias("fits"))


@register("""select vec_id, len(embedding) between 10 and 64 as length_ok, len(list_filter(embedding, lambda x: not (x between -0.25 and 0.25))) = 0 as elements_ok,
len(list_distinct(embedding)) = len(embedding) as distinct_ok, list_sort(embedding) = embedding as sorted_ok from embeddings""")
def array_rules(spark, sf_dir):
    a = F.col("embedding")
    spec = Real(Between(Exact(-1, 4), Exact(1, 4)))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", Array(Real(), Length(Between(10, 64))).holds(a).alias("length_ok"), Elements(spec).holds(a.cast("array<double>")).alias("elements_ok"),
        DistinctElements().holds(a).alias("distinct_ok"), Sorted().holds(a).alias("sorted_ok"),
    )


@register("""with a as (select l_orderkey, list(l_linenumber::bigint order by l_linenumber) as lines, list(l_suppkey order by l_linenumber, l_suppkey) as supps from lineitem group by 1)
select l_orderkey, coalesce(list_position(list_transform(lines, lambda x: x > 5), true), 0) - 1 as first_bad, list_sort(supps) = supps as sorted_ok from a""")
def array_first_violation(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey")))
    df = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(rows.alias("r"))
    df = df.select("l_orderkey", F.transform("r", lambda x: x["l_linenumber"].cast("long")).alias("lines"), F.transform("r", lambda x: x["l_suppkey"]).alias("supps"))
    path = Array(Integer(AtMost(5))).violation(F.col("lines"))["path"]
    first = F.coalesce(F.regexp_extract(path, "index ([0-9]+)", 1).cast("long"), F.lit(-1).cast("long"))
    return df.select("l_orderkey", first.alias("first_bad"), Sorted().holds(F.col("supps")).alias("sorted_ok"))


@register("""select o_orderkey, not (o_custkey <= 700) as custkey_bad, not (o_orderstatus in ('F', 'O')) as status_bad from orders where not (o_custkey <= 700 and o_orderstatus in ('F', 'O'))""")
def tuple_elements(spark, sf_dir):
    t = Tuple(Integer(AtMost(700)), String(OneOf(["F", "O"])))
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.col("o_custkey").alias("_0"), F.col("o_orderstatus").alias("_1")).alias("t"))
    bad = df.where(~t.holds(F.col("t")))
    return bad.select("o_orderkey", (~Integer(AtMost(700)).holds(F.col("t._0"))).alias("custkey_bad"), (~String(OneOf(["F", "O"])).holds(F.col("t._1"))).alias("status_bad"))


@register("""select event_id, event_type = 'click' as tagged from events where (event_type = 'click' and user_id % 2 <> 0) or (event_type <> 'click' and props like '%5%')""")
def variant_elements(spark, sf_dir):
    v = Variant(Integer(Mod(0, 2)), String(Alphabet("{}\"k: 012346789")), tags=("user", "props"))
    tag = F.when(F.col("event_type") == "click", 0).otherwise(1)
    value = F.struct(tag.alias("tag"), F.when(tag == 0, F.col("user_id")).alias("_0"), F.when(tag == 1, F.col("props")).alias("_1"))
    df = table(spark, sf_dir, "events").select("event_id", value.alias("v"))
    return df.where(~v.holds(F.col("v"))).select("event_id", (F.col("v.tag") == 0).alias("tagged"))


_EDGES = "select l_orderkey % 100 as graph, l_partkey % 40 as u, l_suppkey % 40 as v from lineitem"


def _edges(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("graph"), (F.col("l_partkey") % 40).alias("u"), (F.col("l_suppkey") % 40).alias("v"))


@register(f"""with p as (select graph, least(u, v) as a, greatest(u, v) as b, count(*) as n from ({_EDGES}) group by 1, 2, 3)
select graph, sum(n)::bigint as n_edges, sum(case when a = b then n else 0 end)::bigint as n_loops, sum(n - 1)::bigint as n_parallel,
sum(case when a = b then n else 0 end) = 0 and sum(n - 1) = 0 as simple from p group by 1""")
def graph_shape(spark, sf_dir):
    return graphs.shape(_edges(spark, sf_dir))


@register(f"select graph, least(u, v) as a, greatest(u, v) as b, count(*) as n from ({_EDGES}) group by 1, 2, 3 having count(*) > 1")
def graph_parallel(spark, sf_dir):
    return graphs.parallel(_edges(spark, sf_dir))


@register(f"with e as ({_EDGES}) select graph, node, count(*) as degree from (select graph, u as node from e union all select graph, v from e where u <> v) group by 1, 2")
def graph_degree(spark, sf_dir):
    return graphs.degrees(_edges(spark, sf_dir))


@register("""with recursive e as (select distinct s_nationkey % 5 as graph, s_suppkey as u, s_suppkey // 3 * 3 + 1 as v from supplier),
n as (select graph, u as node from e union select graph, v from e), b as (select graph, u, v from e union select graph, v, u from e),
r as (select graph, node, node as top from n union select r.graph, b.v, r.top from r join b on b.graph = r.graph and b.u = r.node)
select graph, node, min(top) as component from r group by 1, 2""")
def graph_components(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    e = s.select((F.col("s_nationkey") % 5).cast("int").alias("graph"), F.col("s_suppkey").alias("u"), (Expression("s_suppkey / 3 * 3 + 1").column()).alias("v")).distinct()
    nodes = e.select("graph", F.col("u").alias("node")).unionByName(e.select("graph", F.col("v").alias("node"))).distinct()
    return graphs.components(nodes, e).select("graph", "node", "component")


@register("""with e as (select l_orderkey as graph, l_linenumber % 4 as u, l_suppkey % 4 as v from lineitem),
b as (select graph, u, v from e union all select graph, v, u from e where u <> v), n as (select distinct graph, u as node from b),
k as (select graph, u, v, count(*) as k from b group by all),
c as (select n.graph, n.node, o.node as other, coalesce(k, 0) as k from n join n o on n.graph = o.graph left join k on k.graph = n.graph and k.u = n.node and k.v = o.node)
select graph, node, string_agg(k::varchar, ' ' order by other) as line from c group by 1, 2""")
def write_matrix(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("graph"), (F.col("l_linenumber") % 4).cast("long").alias("u"), (F.col("l_suppkey") % 4).alias("v"))
    nodes = e.select("graph", F.col("u").alias("node")).unionByName(e.select("graph", F.col("v").alias("node"))).distinct()
    return graphs.matrix(nodes, e)


@register("select l_orderkey, string_agg(l_linenumber || ' ' || l_partkey || chr(10), '' order by l_linenumber, l_partkey) as text from lineitem group by 1")
def write_multiline(spark, sf_dir):
    from plumbline.sources.layout import Layout, Multiline, render

    rows = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("long").alias("a"), F.col("l_partkey").alias("b"))))
    df = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(rows.alias("r"))
    df = df.select("l_orderkey", F.size("r").cast("long").alias("N"), F.transform("r", lambda x: x["a"]).alias("A"), F.transform("r", lambda x: x["b"]).alias("B"))
    p = Problem({"N": Integer(), "A": Array(Integer(), Length("N")), "B": Array(Integer(), Length("N"))})
    return render(p, Layout((Multiline("N", "A", "B"),)), df, ["l_orderkey"])


@register("select c_custkey, c_name || ' ' || c_nationkey || ' end' || chr(10) as text from customer")
def write_line(spark, sf_dir):
    from plumbline.sources.layout import Layout, Line, Literal, render

    p = Problem({"c_name": String(), "c_nationkey": Integer()})
    return render(p, Layout((Line("c_name", "c_nationkey", Literal("end")),)), table(spark, sf_dir, "customer"), ["c_custkey"])


@register("""select c_nationkey, count(*) as N, string_agg(c_custkey::varchar, ' ' order by c_custkey) as A, string_agg((c_custkey % 7)::varchar, ' ' order by c_custkey) as B from customer group by 1""")
def read_sections(spark, sf_dir):
    """A file for each nation, written and read back: a count, a line of as many values, as many lines."""
    from plumbline.sources.layout import Layout, Line, Multiline, read_cases, write_cases

    layout = Layout((Line("N"), Line("A"), Multiline("N", "B")), header=())
    p = Problem({"N": Integer(AtLeast(1)), "A": Array(Integer(AtLeast(0)), Length("N"), Sorted()), "B": Array(Integer(Between(0, 6)), Length("N"))}, input=layout)
    keys = F.array_sort(F.collect_list("c_custkey"))
    cases = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("call")).agg(keys.alias("A"))
    cases = cases.select("call", F.size("A").cast("long").alias("N"), "A", F.transform("A", lambda x: x % 7).alias("B"))
    folder = graphs.shared_folder(spark, "sections")
    write_cases(p, cases, folder, "{call}")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    got = read_cases(spark, f"{folder}/*.in", p, layout)
    return got.select(F.regexp_extract("file", r"([0-9]+)\.in$", 1).cast("int").alias("c_nationkey"), "N", text("A"), text("B"))


@register("""with l as (select o_orderkey, case when o_orderkey % 5 = 0 then '0' || o_custkey when o_orderkey % 7 = 0 then o_custkey || '  ' else o_custkey || ' ' || o_orderstatus end as value from orders)
select o_orderkey, case when o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 then split_part(value, ' ', 1)::bigint end as N,
case when o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 then split_part(value, ' ', 2) end as S, o_orderkey % 5 = 0 or o_orderkey % 7 = 0 as failed from l""")
def read_lines(spark, sf_dir):
    from plumbline.sources.layout import read_lines as read

    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    line = F.when(k % 5 == 0, F.concat(F.lit("0"), c)).when(k % 7 == 0, F.concat(c, F.lit("  "))).otherwise(F.concat_ws(" ", c, "o_orderstatus"))
    df = table(spark, sf_dir, "orders").select("o_orderkey", line.alias("value"))
    return read(df, Problem({"N": Integer(), "S": String()}), ["N", "S"]).select("o_orderkey", "N", "S", F.col("error").isNotNull().alias("failed"))


# Generation: draws are hashes, so that SQL gives the same values.

SEED = "plumb"


def _keys(name: str, call: str = "o_orderkey", attempt: str = "0") -> str:
    return f"'{SEED}|random|' || {call} || '|{name}|{attempt}'"


def _draw_sql(key: str) -> str:
    return f"('0x' || substr(md5({key}), 1, 15))::bigint"


def generated(spark: SparkSession, sf_dir: str, variables: dict, given: dict | None = None) -> DataFrame:
    """One case for each order, keyed by it: values follow the key and what is given alone; NULL where none fits."""
    given = given or {}
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", *(c.alias(n) for n, c in given.items())), "o_orderkey")
    orders = orders.select("o_orderkey", F.lit("random").alias("gen"), F.col("o_orderkey").alias("call"), *given)
    p = Problem(variables, seed=SEED)
    for n in p.order():
        spec, keys = p.variables[n], (F.lit(SEED), F.col("gen"), F.col("call"), F.lit(n))
        if n not in given:
            orders = orders.withColumn(n, spec.generate(*keys, F.lit(0)) if spec.aims() else spec.sound(*keys))
    return orders.drop("gen", "call")


@register(f"select o_orderkey, 10 + {_draw_sql(_keys('A'))} % 91 as A, 3 + 7 * ({_draw_sql(_keys('B'))} % 142) as B from orders")
def gen_integers(spark, sf_dir):
    return generated(spark, sf_dir, {"A": Integer(Between(10, 100)), "B": Integer(Between(1, 994), Mod(3, 7))})


@register(f"with n as (select o_orderkey, 1 + {_draw_sql(_keys('N'))} % 20 as N from orders) select o_orderkey, N, N + {_draw_sql(_keys('X'))} % (2 * N + 1) as X from n")
def gen_dependent(spark, sf_dir):
    return generated(spark, sf_dir, {"X": Integer(Between("N", "3 * N")), "N": Integer(Between(1, 20))})


@register(f"select o_orderkey, round(-1 + ({_draw_sql(_keys('R'))} >> 7)::double / 9007199254740992.0 * 3, 9) as R from orders")
def gen_real(spark, sf_dir):
    return generated(spark, sf_dir, {"R": Real(Between(-1, 2))}).withColumn("R", F.round("R", 9))


def _list_sql(n: str, item: str) -> str:
    return f"list_transform(range({n}), lambda i: {item})"


@register(f"""with n as (select o_orderkey, {_draw_sql(_keys('S') + " || '|length'")} % 6 as n from orders)
select o_orderkey, array_to_string({_list_sql('n', "substr('abcxyz', 1 + " + _draw_sql(_keys('S') + " || '|' || i") + " % 6, 1)")}, '') as S from n""")
def gen_string(spark, sf_dir):
    return generated(spark, sf_dir, {"S": String(Alphabet("abcxyz"), Length(Between(0, 5)))})


@register(f"""with n as (select o_orderkey, 1 + {_draw_sql(_keys('A') + " || '|length'")} % 8 as n from orders)
select o_orderkey, array_to_string(list_sort({_list_sql('n', "-50 + " + _draw_sql(_keys('A') + " || '|elem|' || i") + " % 101")}), ' ') as A from n""")
def gen_array_sorted(spark, sf_dir):
    out = generated(spark, sf_dir, {"A": Array(Integer(Between(-50, 50)), Length(Between(1, 8)), Sorted())})
    return out.withColumn("A", F.array_join(F.transform("A", lambda x: x.cast("string")), " "))


@register(f"""select o_orderkey, {_draw_sql(_keys('T') + " || '|<0>'")} % 10 as a, ['x', 'y', 'z'][1 + {_draw_sql(_keys('T') + " || '|<1>'")} % 3] as b,
({_draw_sql(_keys('V') + " || '|tag'")} % 2)::int as tag, case when {_draw_sql(_keys('V') + " || '|tag'")} % 2 = 0 then 5 + {_draw_sql(_keys('V') + " || '|<0>'")} % 5 end as v from orders""")
def gen_tuple_variant(spark, sf_dir):
    out = generated(spark, sf_dir, {"T": Tuple(Integer(Between(0, 9)), String(OneOf(["x", "y", "z"]))), "V": Variant(Integer(Between(5, 9)), String(OneOf(["q"])), tags=("n", "s"))})
    return out.select("o_orderkey", F.col("T._0").alias("a"), F.col("T._1").alias("b"), F.col("V.tag").alias("tag"), F.col("V._0").alias("v"))


@register(f"""select o_orderkey, [3, 40, 5][1 + {_draw_sql(_keys('A'))} % 3] as A, case when n = 0 then null else fits[1 + {_draw_sql(_keys('B'))} % n] end as B
from (select *, len(fits) as n from (select *, list_filter([2, 9, 4, 30], lambda x: x <= o_custkey % 40) as fits from orders))""")
def gen_one_of_bounded(spark, sf_dir):
    return generated(spark, sf_dir, {"A": Integer(OneOf([3, 40, 5, 77]), AtMost(60)), "B": Integer(OneOf([2, 9, 4, 30]), AtMost("M")), "M": Integer()}, {"M": F.col("o_custkey") % 40}).drop("M")


@register(f"""with t as (select o_orderkey, list_filter(list_transform(range(200), lambda a: {_draw_sql(_keys('E', attempt="' || a || '"))} % 1000), lambda x: x % 7 = 3) as fits from orders) select o_orderkey, fits[1] as E from t""")
def gen_retry(spark, sf_dir):
    return generated(spark, sf_dir, {"E": Integer(Between(0, 999), Custom("third of seven", lambda x: x % 7 == 3))})


@register(f"""with p as (select o_orderkey, u, v, {_draw_sql(_keys('G') + " || '|edges|' || i")} as d, i from orders, (values (0, 0, 1), (1, 0, 2), (2, 1, 2), (3, 0, 3), (4, 1, 3), (5, 2, 3), (6, 0, 4), (7, 1, 4), (8, 2, 4), (9, 3, 4)) t(i, u, v)),
r as (select *, row_number() over (partition by o_orderkey order by d, i) as n from p)
select o_orderkey, 5::bigint as nodes, string_agg(u || '-' || v, ' ' order by n) as edges from r where n <= 4 group by 1""")
def gen_graph(spark, sf_dir):
    out = generated(spark, sf_dir, {"G": Graph(NumNodes(5), NumEdges(4), SimpleGraph())})
    edges = F.array_join(F.transform("G.edges", lambda e: F.concat_ws("-", e["u"].cast("string"), e["v"].cast("string"))), " ")
    return out.select("o_orderkey", F.col("G.num_nodes").alias("nodes"), edges.alias("edges"))


@register(f"""with i as (select o_orderkey, unnest(range(o_orderkey % 7)) as i from orders)
select o_orderkey, i + 1 as child, {_draw_sql("'" + SEED + "|' || o_orderkey || '|' || i")} % (i + 1) as parent from i""")
def gen_tree(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(draw.numbered(F.col("o_orderkey") % 7)).alias("i"))
    return df.select("o_orderkey", (F.col("i") + 1).alias("child"), (draw.draw(SEED, F.col("o_orderkey"), F.col("i")) % (F.col("i") + 1)).alias("parent"))


@register(f"""with i as (select o_orderkey, unnest(range(6)) as i from orders)
select o_orderkey, string_agg(i::varchar, ' ' order by {_draw_sql("'" + SEED + "|' || o_orderkey || '|' || i")}, i) as p from i group by 1""")
def gen_permutation(spark, sf_dir):
    p = draw.permutation(F.lit(6).cast("long"), F.lit(0).cast("long"), SEED, F.col("o_orderkey"))
    return spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", F.array_join(F.transform(p, lambda x: x.cast("string")), " ").alias("p"))


@register(f"""with t as (select o_orderkey, 1 + {_draw_sql(_keys('N'))} % 10 as N0 from orders),
u as (select *, case when N0 >= 8 then 8 + {_draw_sql(_keys('X'))} % greatest(N0 - 7, 1) end as X0 from t),
v as (select o_orderkey, N0, X0, list_transform(range(1, 101), lambda a: 1 + {_draw_sql(_keys('N', attempt="case ' || a || '"))} % 10) as Ns from u),
w as (select *, coalesce(list_position(list_transform(Ns, lambda x: x >= 8), true), 0) as a from v)
select o_orderkey as "call", coalesce(case when X0 is not null then N0 end, Ns[a]) as N, coalesce(X0, 8 + {_draw_sql("'" + SEED + "|random|' || o_orderkey || '|X|case ' || a")} % greatest(Ns[a] - 7, 1)) as X from w""")
def generate_tied(spark, sf_dir):
    """Variables that read one another, drawn again together where the second has no value: one case for each order, by Problem.generate."""
    p = Problem({"N": Integer(Between(1, 10)), "X": Integer(Between(8, "N"))}, seed=SEED)
    return p.generate(spark, over=spread(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call")), "call")).select("call", "N", "X")


@register(f"""select o_orderkey as "call", o_custkey % 50 + 1 as N, coalesce(case when o_orderkey % 3 <> 0 then (o_custkey % 50 + 1) * 2 end, o_custkey % 50 + 1 + {_draw_sql(_keys('X'))} % (2 * (o_custkey % 50 + 1) + 1)) as X from orders""")
def generate_missing(spark, sf_dir):
    """Known values stay, and unset ones are drawn with them in scope."""
    p = Problem({"N": Integer(Between(1, 50)), "X": Integer(Between("N", "3 * N"))}, seed=SEED)
    n = F.col("o_custkey") % 50 + 1
    over = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call"), n.alias("N"), F.when(F.col("o_orderkey") % 3 != 0, n * 2).alias("X"))
    return p.generate(spark, over=spread(over, "call")).select("call", "N", "X")


@register(f"""select o_orderkey as "call", 500 + 1000 * ({_draw_sql(_keys('W'))} % 1000) as W, 3 + 7 * ({_draw_sql(_keys('Y'))} % 43) as Y from orders""")
def gen_sized_mod(spark, sf_dir):
    """Sizes with a remainder: tiny of a million holds no 500 (mod 1000), so the whole range is drawn from; small holds 3 (mod 7)."""
    p = Problem({"W": Integer(Between(1, 10**6), SizeCategory("tiny"), Mod(500, 1000)), "Y": Integer(Between(1, 10**6), SizeCategory("small"), Mod(3, 7))}, seed=SEED)
    return p.generate(spark, over=spread(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call")), "call")).select("call", "W", "Y")


def _feistel_sql(x: str, n: str, a: str, b: str, key: str) -> str:
    """One pass of the keyed permutation over a * b places."""
    l, r = f"({x}) // {b}", f"({x}) % {b}"  # noqa: E741
    for i in range(draw.ROUNDS):
        if i % 2:
            r = f"(({r}) + {_draw_sql(key + f" || '|round|{i}|' || ({l})")} % {b}) % {b}"
        else:
            l = f"(({l}) + {_draw_sql(key + f" || '|round|{i}|' || ({r})")} % {a}) % {a}"  # noqa: E741
    return f"({l}) * {b} + ({r})"


_PLACES = _keys("D") + " || '|elem'"


@register(f"""with n as (select o_orderkey, 1000 + o_custkey as n from orders), s as (select *, ceil(sqrt(n))::bigint as a from n), t as (select *, (n + a - 1) // a as b from s),
w as (select o_orderkey, n, a, b, i, i as x, 0 as t from t, unnest(range(6)) as z(i)), 
p1 as (select *, {_feistel_sql('x', 'n', 'a', 'b', _PLACES)} as y1 from w), p2 as (select *, case when y1 < n then y1 else {_feistel_sql('y1', 'n', 'a', 'b', _PLACES)} end as y2 from p1),
p3 as (select *, case when y2 < n then y2 else {_feistel_sql('y2', 'n', 'a', 'b', _PLACES)} end as y3 from p2), p4 as (select *, case when y3 < n then y3 else {_feistel_sql('y3', 'n', 'a', 'b', _PLACES)} end as y4 from p3)
select o_orderkey as "call", string_agg((1 + y4)::varchar, ' ' order by i) as D from p4 group by 1""")
def gen_distinct(spark, sf_dir):
    """Six different values of 1 ... 1000 + M for each order, as places of a keyed permutation."""
    p = Problem({"D": Array(Integer(Between(1, "M + 1000")), Length(6), DistinctElements()), "M": Integer()}, seed=SEED)
    over = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call"), F.col("o_custkey").alias("M"))
    return p.generate(spark, over=spread(over, "call")).select("call", F.array_join(F.transform("D", lambda x: x.cast("string")), " ").alias("D"))


@register("""with recursive e as (select l_orderkey as graph, l_linenumber % 6 as u, l_suppkey % 6 as v from lineitem), b as (select graph, u, v from e union all select graph, v, u from e),
r as (select distinct graph, 0 as node from e union select r.graph, b.v from r join b on b.graph = r.graph and b.u = r.node)
select graph as l_orderkey, case when count(*) = 6 then 'connected' else 'not' end as shape from r group by 1""")
def graph_connected_rows(spark, sf_dir):
    """Graphs of six nodes held in rows, one for each order: connected or not, by disjoint sets over Arrow lists."""
    ends = F.struct((F.col("l_linenumber") % 6).cast("long").alias("u"), (F.col("l_suppkey") % 6).alias("v"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.struct(F.lit(6).cast("long").alias("num_nodes"), F.collect_list(ends).alias("edges")).alias("G"))
    bad = Problem({"G": Graph(Connected())}).violations(rows, ["l_orderkey"]).select("l_orderkey", F.lit("not").alias("shape"))
    good = rows.select("l_orderkey").join(bad, "l_orderkey", "left_anti").select("l_orderkey", F.lit("connected").alias("shape"))
    return good.unionByName(bad)


_LABELLED = "select l_orderkey % 50 as graph, 'P' || l_partkey % 30 as a, 'S' || l_suppkey % 20 as b, l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem"


@register(f"""with e as ({_LABELLED}), s as (select graph, a as label, l_orderkey, l_linenumber, l_partkey, l_suppkey, 0 as side from e union all select graph, b, l_orderkey, l_linenumber, l_partkey, l_suppkey, 1 from e),
f as (select graph, label, min((l_orderkey, l_linenumber, l_partkey, l_suppkey, side)) as first from s group by 1, 2),
n as (select graph, label, row_number() over (partition by graph order by first, label) - 1 as node from f)
select e.graph, x.node as u, y.node as v, count(*) as n from e join n x on x.graph = e.graph and x.label = a join n y on y.graph = e.graph and y.label = b group by all""")
def read_labelled_edges(spark, sf_dir):
    """Edges between labels, whose nodes are numbered in the order in which the labels are first seen."""
    df = table(spark, sf_dir, "lineitem")
    label = lambda t, c, m: F.concat(F.lit(t), (F.col(c) % m).cast("string"))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    edges = df.select((F.col("l_orderkey") % 50).alias("graph"), label("P", "l_partkey", 30).alias("a"), label("S", "l_suppkey", 20).alias("b"), *order)
    return graphs.by_first_sight(edges, order)[0].groupBy("graph", "u", "v").agg(F.count("*").alias("n"))


@register("""with e as (select l_orderkey as graph, l_partkey % 5 as u, l_suppkey % 5 as v, max(l_quantity)::bigint as label from lineitem where l_partkey % 5 <= l_suppkey % 5 group by 1, 2, 3),
b as (select graph, u, v, label from e union all select graph, v, u, label from e where u <> v), n as (select distinct graph, u as node from b)
select n.graph, n.node, string_agg(coalesce(label::varchar, '-'), ' ' order by o.node) as line from n join n o on o.graph = n.graph left join b on b.graph = n.graph and b.u = n.node and b.v = o.node group by 1, 2""")
def write_labelled_matrix(spark, sf_dir):
    """The largest quantity of each pair of parts and suppliers of an order, as a matrix for each order."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("graph"), (F.col("l_partkey") % 5).alias("u"), (F.col("l_suppkey") % 5).alias("v"), "l_quantity").where("u <= v")
    e = e.groupBy("graph", "u", "v").agg(F.max("l_quantity").cast("long").alias("label"))
    nodes = e.select("graph", F.col("u").alias("node")).unionByName(e.select("graph", F.col("v").alias("node"))).distinct()
    return graphs.labelled_matrix(nodes, e)


_BADLY = [("l_linenumber", "l_linenumber < 2", "at least 2"), ("l_quantity", "l_quantity > 49", "at most 49"), ("l_suppkey", "l_suppkey < 0", "at least 0")]


@register(" union all ".join(f"""select '{v}' as variable, count(*) as cases, count(*) filter ({bad}) as violations,
'Case ' || min((l_orderkey, l_linenumber, l_partkey)) filter ({bad})[1] || ', ' || min((l_orderkey, l_linenumber, l_partkey)) filter ({bad})[2] || ', ' || min((l_orderkey, l_linenumber, l_partkey)) filter ({bad})[3] as first from lineitem""" for v, bad, _ in _BADLY))
def validation_results(spark, sf_dir):
    """Bad rows of lineitem, counted while it is written: the first of each variable, by key, is named."""
    from plumbline.plans.results import watched

    p = Problem({"l_quantity": Real(AtMost(49)), "l_linenumber": Integer(AtLeast(2)), "l_suppkey": Integer(AtLeast(0))})
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    # A key that is checked is a column of its own.
    df = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k0"), F.col("l_linenumber").alias("k1"), F.col("l_partkey").alias("k2"), *p.variables)
    rows, seen = watched(p, df, [f"k{i}" for i in range(len(keys))])
    rows.write.parquet(graphs.shared_folder(spark, "watched"))
    return seen.frame(spark).withColumn("first", F.regexp_extract("first", "^(Case [-0-9]+, [-0-9]+, [-0-9]+)", 1)).withColumn("first", F.when(F.col("first") != "", F.col("first")))


_GRAPHS = """with e as (select l_orderkey as k, l_linenumber % 5 as u, l_suppkey % 7 as v from lineitem),
g as (select k, count(*) as m, string_agg(u || '-' || v, ' ' order by u, v) as edges, max(greatest(u, v)) as most from e group by 1)"""


@register(f"""{_GRAPHS} select k as K, m as M, case when most < 6 then edges end as edges, most >= 6 as failed from g""")
def read_graphs(spark, sf_dir):
    """Edge lists of all orders as sections of large files, read by many tasks; graphs with a node outside 0 ... 5 are errors."""
    from plumbline.sources.layout import Layout, Line, Multiline, render
    from plumbline.sources.sections import read_sections as read

    layout = Layout((Line("K", "M"), Multiline("M", "G")))
    p = Problem({"K": Integer(), "M": Integer(AtLeast(0)), "G": Graph(NumNodes(6), NumEdges("M"))}, input=layout)
    ends = F.struct((F.col("l_linenumber") % 5).cast("long").alias("u"), (F.col("l_suppkey") % 7).alias("v"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("K")).agg(F.array_sort(F.collect_list(ends)).alias("edges"))
    cases = rows.select("K", F.size("edges").cast("long").alias("M"), F.struct(F.lit(6).cast("long").alias("num_nodes"), "edges").alias("G"))
    folder = graphs.shared_folder(spark, "graphs")
    render(p, layout, cases, ["K"]).select(F.rtrim(F.col("text"), F.lit("\n"))).write.text(folder)
    got = read(spark, folder, p, layout, strict=False).where("case > 0")
    edges = F.array_join(F.transform("G.edges", lambda e: F.concat_ws("-", e["u"].cast("string"), e["v"].cast("string"))), " ")
    failed = F.col("error").isNotNull()
    return got.select("K", "M", F.when(~failed, edges).alias("edges"), failed.alias("failed"))


@register("""with c as (select o_custkey, count(*) as N, string_agg(o_orderkey::varchar, ' ' order by o_orderkey) as A, string_agg((o_orderkey % 9)::varchar, ' ' order by o_orderkey) as B from orders group by 1)
select o_custkey, N, A, B, N > 12 as failed from c""")
def read_case_files(spark, sf_dir):
    """A file for each customer with orders, written and read through the data source; more than 12 orders break a bound."""
    from plumbline.sources.cases import load, save
    from plumbline.sources.layout import Layout, Line, Multiline

    layout = Layout((Line("N"), Line("A"), Multiline("N", "B")))
    p = Problem({"N": Integer(Between(1, 12)), "A": Array(Integer(AtLeast(0)), Length("N"), Sorted()), "B": Array(Integer(Between(0, 8)), Length("N"))}, input=layout)
    cases = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("call")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("A"))
    cases = cases.select("call", F.size("A").cast("long").alias("N"), "A", F.transform("A", lambda x: x % 9).alias("B"))
    folder = graphs.shared_folder(spark, "cases")
    save(p, cases, folder, "customer_cases", "{call}")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    got = load(spark, p, folder, "customer_cases", strict=False)
    return got.select(F.regexp_extract("file", r"([0-9]+)\.in$", 1).cast("long").alias("o_custkey"), "N", text("A"), text("B"), F.col("error").isNotNull().alias("failed"))


@register("""select o_orderkey, 'K' as variable, o_orderkey::varchar as value, 'a check digit' as expected from orders where (o_orderkey // 10 % 10 * 3 + o_orderkey // 100 % 10 * 7 + o_orderkey // 1000 % 10 * 9) % 10 <> o_orderkey % 10""")
def sql_violations(spark, sf_dir):
    """Order numbers whose last digit does not check the three before it: a check in Python, asked for in SQL."""
    from plumbline.plans.tables import register_check

    def good(k):
        x = k.to_numpy(zero_copy_only=False)
        return pa.array((x // 10 % 10 * 3 + x // 100 % 10 * 7 + x // 1000 % 10 * 9) % 10 == x % 10)

    register_check(spark, Problem({"K": Integer()}), "bad_digits", "K", good, keys="o_orderkey bigint", expected="a check digit")
    orders = table(spark, sf_dir, "orders").where("o_orderkey is not null").select("o_orderkey", F.col("o_orderkey").alias("K"))
    return spark.sql("select * from bad_digits(table({orders}))", orders=orders)


@register("""select floor(l_extendedprice / pow(10, floor(log10(l_extendedprice))))::bigint as digit, count(*) as n, sum(l_quantity)::bigint as quantity from lineitem where l_extendedprice >= 1 group by 1""")
def sql_analysis(spark, sf_dir):
    """First digits of prices: an analysis in Python of each batch, put together by SQL."""
    from plumbline.plans.tables import register_analysis

    def digits(t):
        x = t["l_extendedprice"].to_numpy()
        t = t.append_column("digit", pa.array(np.floor(x / 10.0 ** np.floor(np.log10(x))).astype(np.int64)))
        return t.group_by("digit").aggregate([("digit", "count"), ("l_quantity", "sum")]).rename_columns(["digit", "n", "quantity"])

    register_analysis(spark, "first_digits", "digit bigint, n bigint, quantity double", digits)
    lines = table(spark, sf_dir, "lineitem").where("l_extendedprice >= 1").select("l_extendedprice", "l_quantity")
    return spark.sql("select digit, sum(n) as n, cast(sum(quantity) as bigint) as quantity from first_digits(table({lines})) group by digit", lines=lines)


_OPTIONS = {"brand": ("part", "p_brand"), "priority": ("orders", "o_orderpriority"), "size": ("part", "p_size"), "status": ("orders", "o_orderstatus")}


@register("with o as (" + " union all ".join(f"select '{n}' as name, count(distinct {c}) as n from {t}" for n, (t, c) in _OPTIONS.items()) + """)
select a.name || ',' || b.name as columns, a.n * b.n as seen, 0::bigint as missing from o as a join o as b on a.name < b.name""")
def covering_pairs(spark, sf_dir):
    """A covering array of the values that columns of two tables have: how many pairs its rows show, and how many they lack."""
    parts = (table(spark, sf_dir, t).where(F.col(c).isNotNull()).select(F.lit(n).alias("name"), F.col(c).cast("string").alias("value")) for n, (t, c) in _OPTIONS.items())
    options = reduce(DataFrame.unionByName, parts).distinct()
    rows = covering_table(spark, options, 2)
    pairs = F.explode(F.array(*(F.struct(F.lit(f"{a},{b}").alias("columns"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in combinations(sorted(_OPTIONS), 2)))).alias("p")
    seen = rows.select(pairs).select("p.*").distinct().groupBy("columns", "a", "b").agg(F.count(F.lit(1)).alias("seen"))
    n = options.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    both = seen.join(n.select(F.col("name").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("name").alias("b"), F.col("n").alias("nb")), "b")
    return both.select("columns", "seen", (F.col("na") * F.col("nb") - F.col("seen")).alias("missing"))


_SMALL = "case when n <= 100 then floor(sqrt(n))::bigint when n <= 300 then 30 when n <= 5000 then 100 when n <= 5000000 then 300 else 2000 end"
_MEDIUM = f"case when n <= 100 then least(greatest(n // 2, {_SMALL}), n) when n <= 300 then 100 when n <= 5000 then 500 when n <= 5000000 then 5000 else 1000000 end"


@register(f"""with t as (select p_partkey, p_partkey as n from part), s as (select *, {_SMALL} as small, {_MEDIUM} as medium from t)
select p_partkey, 1::bigint as small_low, small::bigint as small_high, small::bigint as medium_low, medium::bigint as medium_high, medium::bigint as large_low, n as large_high,
case when n <= 10 then medium else n // 10 * 9 end::bigint as huge_low from s""")
def size_category_ranges(spark, sf_dir):
    one, n = F.lit(1).cast("long"), F.col("p_partkey")
    r = {s: size_range(one, n, s) for s in ("small", "medium", "large", "huge")}
    return table(spark, sf_dir, "part").select(
        "p_partkey", r["small"][0].alias("small_low"), r["small"][1].alias("small_high"), r["medium"][0].alias("medium_low"), r["medium"][1].alias("medium_high"),
        r["large"][0].alias("large_low"), r["large"][1].alias("large_high"), r["huge"][0].alias("huge_low"),
    )


@register("""select n.n_nationkey, s.s_suppkey, e from nation n join supplier s on s.s_nationkey = n.n_nationkey, unnest([1, 40, 2, 39, 20, 5, 6, 7]) as t(e)""")
def edge_cases(spark, sf_dir):
    values = [x for x in Integer(Between(1, 40)).edge_values()]
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return table(spark, sf_dir, "nation").select("n_nationkey").join(s, "n_nationkey").select("n_nationkey", "s_suppkey", F.explode(F.array(*map(F.lit, values))).alias("e"))


@register("""select p_partkey, a, b from part, unnest([0, 1, 2]) as x(a), unnest([0, 1]) as y(b)""")
def covering_full(spark, sf_dir):
    rows = F.array(*(literal(r) for r in covering_array([3, 2], 2)))
    out = table(spark, sf_dir, "part").select("p_partkey", F.explode(rows).alias("r"))
    return out.select("p_partkey", F.col("r._0").cast("int").alias("a"), F.col("r._1").cast("int").alias("b"))


@register("select p_partkey, p_size between 10 and 30 and p_size in (12, 20, 28) as both from part")
def merge_constraints(spark, sf_dir):
    a, b = Integer(AtLeast(10), OneOf([5, 12, 20, 28])), Integer(AtMost(30), OneOf([12, 20, 28, 35]))
    return table(spark, sf_dir, "part").select("p_partkey", a.merged(b).holds(F.col("p_size")).alias("both"))


@register("""with o as (select o_orderkey, case when o_orderkey % 3 = 0 then null else o_custkey end as c, o_orderstatus as s from orders), x as (select o_orderkey, o_custkey + 1 as c, o_orderpriority as p from orders)
select o.o_orderkey, coalesce(o.c, x.c) as c, s, p from o join x on o.o_orderkey = x.o_orderkey""")
def merge_outputs_input_wins(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    left = df.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("c"), F.col("o_orderstatus").alias("s"))
    right = df.select("o_orderkey", (F.col("o_custkey") + 1).alias("c"), F.col("o_orderpriority").alias("p"))
    return merge_outputs(left, right, ["o_orderkey"])


@register("""select l_returnflag, l_linestatus, count(*) as cases, min(l_quantity)::bigint as low, max(l_quantity)::bigint as high, sum(l_quantity)::bigint as total, count(distinct l_suppkey) as suppliers from lineitem group by 1, 2""")
def analyze_stats(spark, sf_dir):
    from plumbline.plans.problem import analyze

    def by_flag(cases: DataFrame) -> DataFrame:
        q: Column = F.col("l_quantity")
        return cases.groupBy("l_returnflag", "l_linestatus").agg(
            F.count("*").alias("cases"), F.min(q).cast("long").alias("low"), F.max(q).cast("long").alias("high"), F.sum(q).cast("long").alias("total"), F.count_distinct("l_suppkey").alias("suppliers"),
        )

    return analyze(Problem(NUMERIC), table(spark, sf_dir, "lineitem"), by_flag)[0]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
