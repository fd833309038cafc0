"""URL rules by host-suffix and path-prefix expressions and hashed lookup.

Each URL gives one expression for each shape the rules have (labels of the host, characters
of the path): its host's last labels and its path's first characters.  Expressions
meet rules by an equi-join on the first four bytes of their SHA-256, the full digest
confirms, and the longest rule wins (then allow before block, then the larger text).

Scale: only (host, path) pairs that differ are expanded, once each, so that a host with a third of
all rows costs no more than its different paths; the winner of each pair joins back to the
rows.  The rules' shapes are an array of pairs, whatever their number; digests of rules are broadcast only
where rules hold at most `broadcast_bytes`.

Defined results: a null URL, or one without "://", has an empty host and path and no rule; a
host with empty labels is split at its dots as it is; rules with null parts are no rules;
repeated rows each get the same verdict; other columns are kept.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_BYTES = 8_000_000


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rows (verdict, host, path) from ("block", "example.com/a/") pairs."""
    rows = [(v, r.partition("/")[0].translate(str.maketrans(UPPER, LOWER)), "/" + r.partition("/")[2] if "/" in r else "") for v, r in rules]
    return spark.createDataFrame(rows, "verdict string, host string, path string")


def labels_of(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """pages with host, path, rule and verdict."""
    rules = rules.where("verdict is not null and host is not null and path is not null").select("verdict", "host", "path").distinct()
    name = F.concat("host", "path")
    rules = rules.withColumns({"rule": name, "digest": F.sha2(F.concat("host", F.lit("\n"), "path"), 256)}).withColumn("short", F.substring("digest", 1, 8))
    size = rules.agg(F.coalesce(F.sum(2 * F.octet_length("rule") + 120), F.lit(0))).first()[0]
    shapes = [tuple(r) for r in rules.select(labels_of(F.col("host")), F.length("path")).distinct().collect()]
    known = rules.select("short", F.col("digest").alias("full"), "rule", F.col("verdict").alias("said"))
    if size <= broadcast_bytes:
        known = F.broadcast(known)
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parts = pages.select(*own, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not shapes:
        return parts.select("*", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    # One expression for each shape that fits: enough labels, and a path of that length at least.
    table = F.from_json(F.lit(json.dumps([{"n": n, "k": k} for n, k in sorted(shapes)])), "array<struct<n:int,k:int>>")
    fits = F.filter(table, lambda s: (labels_of(F.col("host")) >= s["n"]) & (F.length("path") >= s["k"]))
    made = F.transform(fits, lambda s: F.concat(F.call_function("substring_index", "host", F.lit("."), -s["n"]), F.lit("\n"), F.substring(F.col("path"), F.lit(1), s["k"])))
    different = parts.where("host <> ''").select("host", "path").distinct()
    asked = different.select("host", "path", F.explode(made).alias("e")).withColumn("digest", F.sha2("e", 256)).withColumn("short", F.substring("digest", 1, 8))
    met = asked.join(known, "short").where("digest = full")
    rank = F.struct(F.length("rule"), (F.col("said") == "allow").cast("int"), F.col("rule"), F.col("said"))
    won = met.groupBy("host", "path").agg(F.max(rank).alias("w")).select("host", "path", F.col("w.rule").alias("rule"), F.col("w.said").alias("said"))
    out = parts.join(won, ["host", "path"], "left")
    return out.select(*own, "host", "path", "rule", F.coalesce("said", F.lit(otherwise)).alias("verdict"))
