"""Prefix trie of conversations, rolled up over subtrees by centroid decomposition.

A node is a sequence of turns that conversations start with.  It is named by 128 bits of running
totals of its turns' digests, each drawn with the turn's place; so a conversation's
nodes are prefix sums, which `order.running` takes over partitions, however long it is.
Two different prefixes of the same name have a probability of 2^-128 for each pair.

Rollup.  Every node weighs as much as it has members.  The weight under a node is then known from its members
alone: the turns that they have from it on.  A component's centroid is its deepest node with
more than half of the component's weight below it; the nodes with more than half are
those on the way from the centroid to the component's top.  The centroid's subtree in the component is
added up, the total is added to the nodes of that way, and the component falls apart into the subtrees of
the centroid's children and the rest above.  No part has more than half of the weight, so that a node is
met at most log2(weight) times, whatever the depth.  Components are split by joins and
partial aggregations until they weigh at most `small`; those are split by the same steps
within a task.  Whether a node lies below a centroid is read off the conversation that is its smallest
member: its turn of the depth below the centroid's says which child leads to the node.

Defined results: turns are ordered by turn (null first), then role and text; rows that repeat are turns of their own;
null roles and texts are empty; rows with a null conv_id are of no conversation; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.order import running, spread_join
from plumbline.llm.text import stored

HEADS, SMALL, CHUNK = 9, 4096, 20_000
LANES = ["l0", "l1", "l2", "l3"]
_MASK = 0xFFFFFFFF


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (c, q, size, l0 ... l3, rest) of the rebuilt conversations, and (c, n) of all conversations with their numbers of turns.

    Conversation c has the first h turns of c - c % 5, then its own after its first h, with h = crc32(c) % 9.  q counts from 0;
    rest is how many turns there are from this one on.
    """
    empty = F.lit("")
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    own = running(turns, "c", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], [], "turns").drop("turn")
    sizes = stored(own.groupBy("c").agg(F.count("*").alias("n")), "sizes")
    h = F.pmod(F.crc32(F.col("c").cast("string")), F.lit(HEADS))
    convs = sizes.select("c", "n", h.alias("h"), (F.col("c") - F.col("c") % 5).alias("b"))
    convs = convs.join(sizes.select(F.col("c").alias("b"), F.col("n").alias("bn")), "b", "left")
    convs = stored(convs.select("c", "n", "h", "b", F.least("h", F.coalesce("bn", F.lit(0))).alias("head")).withColumn("size", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    heads = own.where(F.col("ord") < HEADS).toDF("b", "role", "text", "q")
    first = convs.join(heads, "b").where("q < head").select("c", "role", "text", "q", "size")
    later = spread_join(own, convs.select("c", "h", "head", F.col("size"), "n"), ["c"]).where("ord >= h").select("c", "role", "text", (F.col("ord") - F.col("h") + F.col("head")).alias("q"), "size")
    rows = first.unionByName(later)
    mark = F.md5(F.concat(F.col("q").cast("string"), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    lane = [F.conv(F.substring(mark, 8 * i + 1, 8), 16, 10).cast("long").alias(x) for i, x in enumerate(LANES)]
    rows = rows.select("c", "q", F.octet_length("text").cast("long").alias("bytes"), *lane, (F.col("size") - F.col("q")).alias("rest"))
    return rows, convs.select("c", F.col("size").alias("n"))


def _name(totals: list[Column], names: tuple[str, str]) -> list[Column]:
    """Two longs that hold four totals modulo 2^32."""
    low = [t.bitwiseAND(F.lit(_MASK).cast("long")) for t in totals]
    return [F.shiftleft(low[2 * i], 32).bitwiseOR(low[2 * i + 1]).alias(names[i]) for i in range(2)]


def prefixes(rows: DataFrame) -> DataFrame:
    """(c, depth, hi, lo, up_hi, up_lo, bytes, rest): the node that a conversation's first `depth` turns lead to, and the one over it."""
    sums = running(rows, "c", [F.col("q")], LANES, "prefixes")
    total = [F.col(f"run_{x}") for x in LANES]
    before = [F.col(f"run_{x}") - F.col(x) for x in LANES]
    return stored(sums.select("c", (F.col("q") + 1).alias("depth"), *_name(total, ("hi", "lo")), *_name(before, ("up_hi", "up_lo")), "bytes", "rest"), "paths")


def ends(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """(hi, lo, ends_sha256) of the nodes where conversations end: of their ids, ascending, comma-joined.

    Ids are sorted by range and joined in pieces; one task then digests a node's pieces one after the other, as a digest asks,
    and holds one of them.
    """
    last = paths.where("rest = 1").select("hi", "lo", "c").unionByName(convs.where("n = 0").select(F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"), "c"))
    numbered = running(last.withColumn("node", F.concat_ws(" ", "hi", "lo")), "node", [F.col("c")], [], "ends")
    piece = F.floor(F.col("ord") / CHUNK).alias("piece")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",")
    pieces = numbered.groupBy("hi", "lo", piece).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for batch in batches:
            for hi, lo, text in zip(*(batch.column(c).to_pylist() for c in ("hi", "lo", "ids")), strict=True):
                if (hi, lo) != node:
                    if state:
                        out.append((*node, state.hexdigest()))
                    node, state = (hi, lo), hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield _batch(out, ["hi", "lo", "ends_sha256"], [pa.int64(), pa.int64(), pa.string()])
            out = []
        if state:
            yield _batch([(*node, state.hexdigest())], ["hi", "lo", "ends_sha256"], [pa.int64(), pa.int64(), pa.string()])

    return pieces.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "piece").mapInArrow(run, "hi long, lo long, ends_sha256 string")


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def nodes_of(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """(hi, lo, up_hi, up_lo, depth, conv_id, n_convs, bytes, weight, n_children) of every node; the root's parent is null."""
    none = F.lit(None).cast("long")
    inner = paths.groupBy("hi", "lo").agg(
        F.min("up_hi").alias("up_hi"), F.min("up_lo").alias("up_lo"), F.min("depth").alias("depth"), F.min("c").alias("conv_id"), F.count("*").alias("n_convs"),
        F.min("bytes").alias("bytes"), F.sum("rest").alias("weight"),
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("n") + 1).alias("weight")).where("n_convs > 0")
    root = root.select(zero.alias("hi"), zero.alias("lo"), none.alias("up_hi"), none.alias("up_lo"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("bytes"), "weight")
    nodes = stored(inner.unionByName(root), "nodes")
    children = nodes.where("up_hi is not null").groupBy(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(F.count("*").alias("n_children"))
    return stored(nodes.join(children, ["hi", "lo"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")


STATE = ["hi", "lo", "up_hi", "up_lo", "depth", "conv_id", "weight", "a", "b", "add_a", "add_b", "k_hi", "k_lo"]


def rollup(nodes: DataFrame, paths: DataFrame, small: int = SMALL) -> DataFrame:
    """(hi, lo, a, b): the sums of a and b (long) over each node's subtree, itself included."""
    zero = F.lit(0).cast("long")
    live = stored(nodes.select("hi", "lo", "up_hi", "up_lo", "depth", "conv_id", "weight", "a", "b", zero.alias("add_a"), zero.alias("add_b"), zero.alias("k_hi"), zero.alias("k_lo")), "live")
    child = paths.select(F.col("c").alias("conv_id"), F.col("depth").alias("at"), F.col("hi").alias("to_hi"), F.col("lo").alias("to_lo"), F.col("up_hi").alias("from_hi"), F.col("up_lo").alias("from_lo"))
    key, little, done = ["k_hi", "k_lo"], [], []
    while True:
        sizes = stored(live.groupBy(*key).agg(F.max("weight").alias("whole"), F.count("*").alias("n")), "sizes")
        tagged = stored(spread_join(live, sizes, key), "sized")
        little.append(tagged.where(F.col("whole") <= small).select(STATE))
        large = tagged.where(F.col("whole") > small)
        heavy = 2 * F.col("weight") > F.col("whole")
        centre = large.where(heavy).groupBy(*key).agg(F.max(F.struct("depth", "hi", "lo", "weight")).alias("m"), F.max("whole").alias("whole"))
        centre = centre.select(*key, F.col("m.depth").alias("c_depth"), F.col("m.hi").alias("c_hi"), F.col("m.lo").alias("c_lo"), F.col("m.weight").alias("c_weight"))
        centre = stored(centre.join(sizes.select(*key, "n"), key), "centroids")
        if centre.isEmpty():
            break
        split = stored(spread_join(large.select(*STATE, heavy.alias("heavy")), centre, key), "split")
        # Of nodes deeper than the centroid: where their conversation goes one turn below its depth.
        asked = split.where("depth > c_depth").groupBy("conv_id", *key).agg(F.count("*").alias("n"), F.first("c_depth").alias("c_depth"), F.first("c_hi").alias("c_hi"), F.first("c_lo").alias("c_lo"))
        led = asked.withColumn("at", F.col("c_depth") + 1).join(child, ["conv_id", "at"])
        led = stored(led.where("from_hi = c_hi and from_lo = c_lo").select("conv_id", *key, "to_hi", "to_lo", "n"), "led")
        deeper = spread_join(split.where("depth > c_depth"), led, ["conv_id", *key], "left")
        same = split.where("depth <= c_depth").select("*", F.lit(None).cast("long").alias("to_hi"), F.lit(None).cast("long").alias("to_lo"))
        moved = stored(deeper.unionByName(same), "moved")
        centroid = (F.col("hi") == F.col("c_hi")) & (F.col("lo") == F.col("c_lo"))
        way = F.col("heavy") & (F.col("depth") < F.col("c_depth"))
        total = moved.where(centroid | F.col("to_hi").isNotNull()).groupBy(*key).agg(F.sum("a").alias("sum_a"), F.sum("b").alias("sum_b"))
        total = total.join(moved.where(centroid | way).groupBy(*key).agg(F.count("*").alias("n")), key)
        summed = stored(spread_join(moved.where(centroid | way), stored(total, "totals"), key), "summed")
        done.append(summed.where(centroid).select("hi", "lo", (F.col("add_a") + F.col("sum_a")).alias("a"), (F.col("add_b") + F.col("sum_b")).alias("b")))
        over = summed.where(~centroid).withColumns({"add_a": F.col("add_a") + F.col("sum_a"), "add_b": F.col("add_b") + F.col("sum_b"), "weight": F.col("weight") - F.col("c_weight")})
        rest = moved.where(~centroid & ~way).withColumns({"k_hi": F.coalesce("to_hi", "k_hi"), "k_lo": F.coalesce("to_lo", "k_lo")})
        live = stored(over.select(STATE).unionByName(rest.select(STATE)), "live")
    parts = little[0]
    for more in little[1:]:
        parts = parts.unionByName(more)
    out = parts.repartition(*key).sortWithinPartitions(*key, "depth").mapInArrow(_small, "hi long, lo long, a long, b long")
    for more in done:
        out = out.unionByName(more)
    return out


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components, one after the other, each with its top first."""
    names, kinds = ["hi", "lo", "a", "b"], [pa.int64()] * 4
    last, held, out = None, [], []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in STATE), strict=True):
            if row[-2:] != last:
                out += decomposed(held)
                last, held = row[-2:], []
            held.append(row)
        if out:
            yield _batch(out, names, kinds)
            out = []
    if held:
        yield _batch(decomposed(held), names, kinds)


def decomposed(rows: list[tuple]) -> list[tuple]:
    """(hi, lo, a, b) of a component's nodes, split at centroids.  rows are as STATE says, parents before children."""
    at = {(r[0], r[1]): i for i, r in enumerate(rows)}
    parent = [at.get((r[2], r[3]), -1) for r in rows]
    below: list[list[int]] = [[] for _ in rows]
    for i, p in enumerate(parent):
        if p >= 0:
            below[p].append(i)
    weight = [r[6] for r in rows]
    add = [[r[9], r[10]] for r in rows]
    cut = [False] * len(rows)
    out, tops = [], [0] if rows else []
    while tops:
        top = c = tops.pop()
        whole, deeper = weight[top], True
        while deeper:
            deeper = False
            for i in below[c]:
                if not cut[i] and 2 * weight[i] > whole:
                    c, deeper = i, True
                    break
        members, a, b = [c], 0, 0
        for i in members:
            a, b = a + rows[i][7], b + rows[i][8]
            members += [j for j in below[i] if not cut[j]]
        out.append((rows[c][0], rows[c][1], add[c][0] + a, add[c][1] + b))
        v = c
        while v != top:
            v = parent[v]
            add[v][0] += a
            add[v][1] += b
            weight[v] -= weight[c]
        tops += [i for i in below[c] if not cut[i]]
        for i in below[c]:
            cut[i] = True
        cut[c] = True
        if c != top:
            tops.append(top)
    return out


def prefix_trie(conversations: DataFrame, small: int = SMALL) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> a row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = rebuilt(conversations)
    paths = prefixes(turns)
    nodes = nodes_of(paths, convs)
    leaf = (F.col("n_children") == 0).cast("long")
    sums = rollup(nodes.withColumns({"a": leaf, "b": (F.col("n_convs") - 1) * F.col("bytes")}), paths, small)
    parents = nodes.where("n_children > 0").select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    below = spread_join(nodes.where("up_hi is not null"), parents, ["up_hi", "up_lo"])
    top = nodes.where("up_hi is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    every = below.unionByName(top).join(sums, ["hi", "lo"]).join(ends(paths, convs), ["hi", "lo"], "left")
    return every.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("a").alias("n_leaves"), F.col("b").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def brute_force(rows: list[tuple]) -> list[tuple]:
    """The nodes of (conv_id, turn, role, text) rows by a table of all prefixes; for tests."""
    turns: dict[int, list] = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r[2], r[3]) for r in sorted(x)] for c, x in turns.items()}
    members: dict[tuple, list[int]] = {}
    full = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(own.get(c - c % 5, [])[:h] + x[h:])
        for d in range(len(full[c]) + 1):
            members.setdefault(full[c][:d], []).append(c)
    kids: dict[tuple, int] = {}
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    sums = {p: [0, 0] for p in members}
    for p, cs in members.items():
        for d in range(len(p) + 1):
            sums[p[:d]][0] += p not in kids
            sums[p[:d]][1] += (len(cs) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, cs in members.items():
        last = ",".join(map(str, sorted(c for c in cs if len(full[c]) == len(p))))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids.get(p, 0), sums[p][0], sums[p][1], hashlib.sha256(last.encode()).hexdigest()))
    return out


