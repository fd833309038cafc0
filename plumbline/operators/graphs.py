"""Graphs as edge tables (graph, u, v): predicates for graphs of any size, by aggregation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.errors import ConfigurationError


def loops(edges: DataFrame) -> DataFrame:
    return edges.where("u = v")


def parallel(edges: DataFrame) -> DataFrame:
    """(graph, a, b, n): unordered pairs that occur more than once."""
    return edges.groupBy("graph", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.count("*").alias("n")).where("n > 1")


def adjacency(edges: DataFrame) -> DataFrame:
    """(graph, node, other): both directions, loops once."""
    ends = F.when(F.col("u") == F.col("v"), F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")))).otherwise(
        F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other")))
    )
    return edges.select("graph", F.explode(ends).alias("e")).select("graph", "e.node", "e.other")


def degrees(edges: DataFrame) -> DataFrame:
    return adjacency(edges).groupBy("graph", "node").agg(F.count("*").alias("degree"))


def shape(edges: DataFrame) -> DataFrame:
    """Per graph: n_edges, n_loops, n_parallel, simple."""
    pairs = edges.groupBy("graph", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.count("*").alias("n"))
    out = pairs.groupBy("graph").agg(
        F.sum("n").alias("n_edges"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("n_loops"), F.sum(F.col("n") - 1).alias("n_parallel")
    )
    return out.withColumn("simple", (F.col("n_loops") == 0) & (F.col("n_parallel") == 0))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; unset in local mode, a temporary one.  A cluster without it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ConfigurationError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path in that folder."""
    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, node, component): the least node that is reachable.

    Least labels over neighbours, then the label of the label; the lineage is cut in
    each round by checkpoint() in spark.checkpoint.dir.
    """
    near = adjacency(edges)
    labels = nodes.select("graph", "node", F.col("node").alias("component"))
    spark = nodes.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    while True:
        sent = near.join(labels.withColumnRenamed("node", "other"), ["graph", "other"]).groupBy("graph", "node").agg(F.min("component").alias("least"))
        new = labels.join(sent, ["graph", "node"], "left").select("graph", "node", F.col("component").alias("was"), F.least("component", F.coalesce("least", "component")).alias("component"))
        up = new.select("graph", F.col("node").alias("component"), F.col("component").alias("up"))
        new = new.join(up, ["graph", "component"]).select("graph", "node", "was", F.least("component", "up").alias("component")).checkpoint()
        labels = new.select("graph", "node", "component")
        if new.where("component <> was").isEmpty():
            return labels


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, n_nodes, n_components, connected)."""
    found = components(nodes, edges).groupBy("graph").agg(F.count("*").alias("n_nodes"), F.count_distinct("component").alias("n_components"))
    return found.withColumn("connected", F.col("n_components") == 1)


def matrix(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, node, line): rows of the adjacency matrix of edge counts, blank-separated."""
    counts = adjacency(edges).groupBy("graph", "node", "other").agg(F.count("*").alias("n"))
    all_nodes = nodes.select("graph", F.col("node").alias("other"))
    cells = nodes.join(all_nodes, "graph").join(counts, ["graph", "node", "other"], "left").select("graph", "node", "other", F.coalesce("n", F.lit(0)).alias("n"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("other", "n"))), lambda c: c["n"].cast("string")), " ")
    return cells.groupBy("graph", "node").agg(line.alias("line"))


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows (with a group that is not null and orders that differ in it) with rank, from 0, in their group.

    Rows are sorted by range, so that a group may span partitions; each partition counts on its own, and adds what
    earlier partitions have of the group.  No partition of the join that follows has more rows than one of the ranges.
    """
    spark = rows.sparkSession
    path = shared_folder(spark, "ranked")
    spread = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    spread = spread.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    spread.write.parquet(path)
    kept = spark.read.schema(spread.schema).parquet(path)
    ends = kept.groupBy(group, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    both = kept.join(ends.drop("__n"), [group, "__part"])
    return both.select(*rows.columns, (F.col("__at") - F.col("__first") + F.col("__before")).alias("rank"))


def by_first_sight(edges: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """edges (graph, a, b, order columns, ...) between labels -> (edges with u and v for a and b, nodes (graph, node, label)).

    Nodes are numbered by where their labels are first seen: rows follow the order columns, and a comes before b.
    """
    side = lambda c, i: F.struct(F.col(c).alias("label"), F.struct(*order, F.lit(i).alias("side")).alias("first"))
    seen = edges.select("graph", F.explode(F.array(side("a", 0), side("b", 1))).alias("s")).groupBy("graph", F.col("s.label").alias("label")).agg(F.min("s.first").alias("first"))
    nodes = ranked(seen, "graph", ["first", "label"]).select("graph", F.col("rank").alias("node"), "label")
    out = edges.join(nodes.select("graph", F.col("label").alias("a"), F.col("node").alias("u")), ["graph", "a"]).join(nodes.select("graph", F.col("label").alias("b"), F.col("node").alias("v")), ["graph", "b"])
    return out.select("graph", "u", "v", *(c for c in edges.columns if c not in ("graph", "a", "b"))), nodes


def with_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph, a, b, ...): edges between the labels of their nodes; a node that has none is an error."""
    label = lambda c, n: nodes.select("graph", F.col("node").alias(c), F.col("label").alias(n))
    out = edges.join(label("u", "a"), ["graph", "u"], "left").join(label("v", "b"), ["graph", "v"], "left")
    known = lambda n, c: F.coalesce(F.col(n), F.raise_error(F.concat(F.lit("no label for node "), F.col(c).cast("string"))).cast("string")).alias(n)
    return out.select("graph", known("a", "u"), known("b", "v"), *(c for c in edges.columns if c not in ("graph", "u", "v")))


def labelled_matrix(nodes: DataFrame, edges: DataFrame, none: str = "-") -> DataFrame:
    """(graph, node, line): rows of the adjacency matrix of edge labels, blank-separated, `none` where there is no edge.

    Two edges between the same nodes have one cell, and a label that is `none` or holds a blank cannot be told: errors.
    """
    fail = lambda why: F.raise_error(F.lit(why)).cast("string")
    label = F.col("label").cast("string")
    pairs = edges.groupBy("graph", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.count("*").alias("n"), F.min(label).alias("label"))
    shown = F.when(F.col("n") > 1, fail("parallel edges with labels")).when(F.coalesce((F.col("label") == none) | F.col("label").rlike(r"\s|\A\z"), F.lit(True)), fail("a label that a cell cannot hold")).otherwise(F.col("label"))
    cells = adjacency_labels(pairs.withColumn("label", shown))
    all_nodes = nodes.select("graph", F.col("node").alias("other"))
    full = nodes.select("graph", "node").join(all_nodes, "graph").join(cells, ["graph", "node", "other"], "left")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("other", F.coalesce("label", F.lit(none)).alias("label")))), lambda c: c["label"]), " ")
    return full.groupBy("graph", "node").agg(line.alias("line"))


def adjacency_labels(edges: DataFrame) -> DataFrame:
    """(graph, node, other, label): both directions, loops once."""
    one = lambda a, b: F.struct(F.col(a).alias("node"), F.col(b).alias("other"))
    ends = F.when(F.col("u") == F.col("v"), F.array(one("u", "v"))).otherwise(F.array(one("u", "v"), one("v", "u")))
    return edges.select("graph", F.explode(ends).alias("e"), "label").select("graph", "e.node", "e.other", "label")


def from_labelled_matrix(lines: DataFrame, none: str = "-") -> DataFrame:
    """(graph, node, line) rows of edge labels -> (graph, u, v, label) with u <= v; not square or not symmetric is an error."""
    cells = _cells(lines)
    fail = lambda why: F.raise_error(F.lit(why)).cast("string")
    cell = F.when(F.col("bad"), fail("the matrix is not square")).when(F.col("cell") == "", fail("a cell is empty")).otherwise(F.col("cell"))
    pairs = cells.select("graph", "u", "v", cell.alias("cell")).groupBy("graph", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("cell").alias("label"), F.max("cell").alias("other"))
    same = F.when(F.col("label") == F.col("other"), F.col("label")).otherwise(fail("the matrix is not symmetric"))
    return pairs.select("graph", "u", "v", same.alias("label")).where(F.col("label") != none)


def _cells(lines: DataFrame) -> DataFrame:
    """(graph, u, v, cell, bad) of matrices by their lines; bad is true where one is not square."""
    rows = lines.select("graph", "node", F.split(F.coalesce("line", F.lit("")), " ", -1).alias("cells"))
    sizes = rows.groupBy("graph").agg(F.count("*").alias("n"), F.count_distinct("node").alias("nodes"), F.min("node").alias("low"), F.max("node").alias("high"), F.min(F.size("cells")).alias("least"), F.max(F.size("cells")).alias("most"))
    square = (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("nodes") == F.col("n")) & (F.col("least") == F.col("n")) & (F.col("most") == F.col("n"))
    bad = sizes.where(~F.coalesce(square, F.lit(False))).select(F.col("graph").alias("g"), F.lit(True).alias("bad"))
    cells = rows.join(bad, F.col("graph").eqNullSafe(F.col("g")), "left").select("graph", F.col("node").alias("u"), "bad", F.posexplode("cells").alias("v", "cell"))
    return cells.select("graph", "u", F.col("v").cast("long").alias("v"), "cell", "bad")


def from_matrix(lines: DataFrame) -> DataFrame:
    """(graph, node, line) rows of edge counts, nodes 0 to n - 1 -> (graph, u, v) with u <= v, one row for each edge.

    A matrix that is not square, not symmetric or holds anything but counts raises an error.
    """
    fail = lambda why: F.raise_error(F.lit(why)).cast("int")
    count = F.when(F.col("bad"), fail("the matrix is not square")).when(F.col("cell").rlike(r"\A(0|[1-9][0-9]{0,8})\z"), F.col("cell").try_cast("int")).otherwise(fail("a cell is not a count"))
    cells = _cells(lines).select("graph", "u", "v", count.alias("n"))
    pairs = cells.groupBy("graph", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("n").alias("n"), F.max("n").alias("other"))
    same = F.when(F.col("n") == F.col("other"), F.col("n")).otherwise(fail("the matrix is not symmetric"))
    return pairs.select("graph", "u", "v", F.explode(F.array_repeat(F.lit(0), same)).alias("_")).drop("_")
