"""Merkle manifest of a dataset: digests swept forward in time, proofs swept back.

A leaf is the digest of a row.  Leaves of a group (a language) are numbered in order; every two
consecutive nodes become one, until one is left, the group's subroot; subroots become the
root in the same way.  Nodes are labelled level by level, so that a parent's label is larger than
its children's.

Time-forward processing: nodes are met in the order of their labels.  A node takes the digests
that its children sent from a priority queue ordered by label, and sends its own to its
parent.  Then a sweep back over falling labels: a node that has its proof suffix (its siblings on
the way from it to the root) sends each child the sibling, followed by its own suffix.

The queue is external.  Within a block of 2^BAND consecutive nodes of a level it is a heap of one
task, never larger than the block; messages to later blocks are rows of a stored table, sorted
to their block by a shuffle.  A band of BAND levels is thus one pass, each pass reads 2^-BAND of the
rows of the last, and a group of any size is cut into equal blocks.  Positions are numbered over
range partitions, without a window over a group.

Defined results: a null field is `-`; null groups are one group, before all others; null ids
come first; rows with equal ids follow their digests; repeated rows are leaves of their own;
an empty table has no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm.order import running
from plumbline.llm.text import stored

BAND = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """Of a row: each field as `-` if null, else its bytes in UTF-8, `:`, its value."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in texts)), 256)


class Block:
    """Consecutive nodes of one level, and the levels over them."""

    def __init__(self, leaves: list[str], levels: int):
        sizes = [len(leaves)]
        for _ in range(levels):
            sizes.append(-(-sizes[-1] // 2))
        self.first = [0]  # the label of each level's first node
        for n in sizes:
            self.first.append(self.first[-1] + n)
        self.levels, self.digests = levels, [*leaves, *[""] * (self.first[-1] - len(leaves))]
        self.children: list[list[int]] = [[] for _ in self.digests]
        self._forward()

    def _forward(self) -> None:
        n = self.first[1]
        queue = [(self.first[1] + i // 2, i) for i in range(n)] if self.levels else []
        level = 1
        while queue:
            label = queue[0][0]
            while queue and queue[0][0] == label:
                self.children[label].append(heapq.heappop(queue)[1])
            self.digests[label] = digest([self.digests[c] for c in self.children[label]])
            while label >= self.first[level + 1]:
                level += 1
            if level < self.levels:
                heapq.heappush(queue, (self.first[level + 1] + (label - self.first[level]) // 2, label))

    @property
    def root(self) -> str:
        return self.digests[-1]

    def suffixes(self, above: str) -> list[str]:
        """Each leaf's proof: a step of a level is L or R with the sibling's digest on that side, or N."""
        out = [""] * self.first[1]
        queue = [(-(len(self.digests) - 1), above)]
        while queue:
            label, suffix = heapq.heappop(queue)
            mine = self.children[-label]
            if not mine:
                out[-label] = suffix
            for i, c in enumerate(mine):
                step = "N" if len(mine) == 1 else f"{'L' if i else 'R'}{self.digests[mine[1 - i]]}"
                heapq.heappush(queue, (-c, step + suffix))
        return out


def steps(suffix: str) -> list[tuple[str, str]]:
    """(side, digest) of a proof; the digest of N is empty."""
    out, at = [], 0
    while at < len(suffix):
        size = 0 if suffix[at] == "N" else 64
        out.append((suffix[at], suffix[at + 1 : at + 1 + size]))
        at += 1 + size
    return out


def folded(leaf: str, suffix: str) -> str:
    """The root that a leaf and its proof lead to."""
    for side, sibling in steps(suffix):
        leaf = digest([sibling, leaf] if side == "L" else [leaf, sibling])
    return leaf


def _block(table: pa.Table, block: int, band: int) -> tuple[list[int], Block]:
    """A block's rows in order of position, and its levels: all of the band, or for a group's only block as many as it has."""
    place = table.column("pos").to_pylist()
    order = sorted(range(len(place)), key=place.__getitem__)
    digests = table.column("digest").to_pylist()
    levels = band if block else (len(order) - 1).bit_length()
    return order, Block([digests[i] for i in order], levels)


def climb(nodes: DataFrame, band: int = BAND) -> list[DataFrame]:
    """nodes (g, pos, digest) -> the nodes of each band's first level, the last with one node for each group."""
    bands = [nodes]

    def up(key: tuple, table: pa.Table) -> pa.Table:
        _, block = _block(table, key[1].as_py(), band)
        return pa.table({"g": pa.array([key[0].as_py()], pa.string()), "pos": pa.array([key[1].as_py()], pa.int64()), "digest": [block.root]})

    while True:
        rows = bands[-1].select("g", "pos", "digest", F.shiftright("pos", band).alias("block"))
        top = stored(rows.groupBy("g", "block").applyInArrow(up, "g string, pos long, digest string"), "band")
        bands.append(top)
        if top.where("pos > 0").isEmpty():
            return bands


def descend(bands: list[DataFrame], suffix: DataFrame, band: int = BAND) -> DataFrame:
    """The first band's rows with suffix, from those of the last (g, suffix and columns that a group's rows share)."""
    shared = [c for c in suffix.columns if c not in ("g", "suffix")]
    below = suffix.withColumn("pos", F.lit(0).cast("long"))
    for nodes in reversed(bands[:-1]):
        schema = [*nodes.schema.fields, *(below.schema[c] for c in (*shared, "suffix"))]
        left = nodes.withColumn("block", F.shiftright("pos", band)).groupBy("g", "block")
        out = left.cogroup(below.groupBy("g", "pos")).applyInArrow(_proofs(schema, shared, band), _ddl(schema))
        below = stored(out, "suffixes") if nodes is not bands[0] else out
    return below


def _proofs(schema: list, shared: list[str], band: int):
    """A block's rows with their suffixes, from the block's row of the band over it."""
    kinds = [to_arrow_type(f.dataType) for f in schema]
    names = [f.name for f in schema]
    own = names[: len(names) - len(shared) - 1]

    def down(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
        order, block = _block(table, key[1].as_py(), band)
        mine = [""] * len(order)
        for i, s in zip(order, block.suffixes(above.column("suffix")[0].as_py()), strict=True):
            mine[i] = s
        columns = [*(table.column(c) for c in own), *(pa.array([above.column(c)[0].as_py()] * len(order), pa.string()) for c in shared), pa.array(mine, pa.string())]
        return pa.table([c.cast(k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return down


def _ddl(fields) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)


def tree(rows: DataFrame, band: int = BAND) -> DataFrame:
    """rows (g, id, digest, ...) with pos, subroot, root and suffix (the proof, from the row to the root)."""
    leaves = running(rows, "g", [F.col("id").asc_nulls_first(), F.col("digest")], [], "leaves").withColumnRenamed("ord", "pos")
    bands = climb(leaves, band)
    subroots = bands[-1].select(F.lit("").alias("g"), F.col("g").alias("id"), "digest")
    over = climb(running(subroots, "g", [F.col("id")], [], "subroots").withColumnRenamed("ord", "pos"), band)
    root = over[-1].select(F.lit("").alias("g"), F.lit("").alias("suffix"), F.col("digest").alias("root"))
    tops = descend(over, root, band).select(F.col("id").alias("g"), "suffix", F.col("digest").alias("subroot"), "root")
    return descend(bands, stored(tops, "tops"), band)


def manifest(docs: DataFrame, tampered: Column | None = None, band: int = BAND) -> DataFrame:
    """docs -> doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where `tampered` holds, the row that is verified has one more in n_chars than that which was digested.
    """
    names = {c: F.col(f"`{c}`") for c in FIELDS}
    other = F.lit(None).cast("string")
    if tampered is not None:
        other = F.when(tampered, leaf_digest([names[c] + 1 if c == "n_chars" else names[c] for c in FIELDS]))
    group = F.coalesce(F.concat(F.lit("v"), F.col("lang")), F.lit(""))
    leaves = docs.select(group.alias("g"), F.col("doc_id").alias("id"), leaf_digest([*names.values()]).alias("digest"), other.alias("other"))
    return proved(tree(stored(leaves, "digests"), band))


def proved(rows: DataFrame) -> DataFrame:
    """What `tree` gives, folded: the row's own digest, or that in `other`, led to a root along its proof."""
    kind = rows.schema["id"].dataType

    def run(batches):
        for batch in batches:
            digests, others, suffixes, roots = (batch.column(c).to_pylist() for c in ("digest", "other", "suffix", "root"))
            proof = [digest([d for _, d in steps(s)]) for s in suffixes]
            fold = [folded(o or d, s) for d, o, s in zip(digests, others, suffixes, strict=True)]
            good = [f == r for f, r in zip(fold, roots, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("digest"), batch.column("subroot"), batch.column("root"), pa.array(proof), pa.array(fold), pa.array(good)],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )

    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def brute_force(rows: list[dict], tampered=lambda row: False) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), level by level; for tests."""
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: digest([show(r[c]) for c in FIELDS])

    def levels(nodes: list[str]) -> list[list[str]]:
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest(out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
        return out

    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in langs:
        mine = sorted((r for r in rows if r["lang"] == g), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[g] = mine, levels([leaf(r) for r in mine])
    top = levels([trees[g][1][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        mine, own = trees[g]
        for i, r in enumerate(mine):
            proof, cur, at = [], leaf({**r, "n_chars": None if r["n_chars"] is None else r["n_chars"] + 1}) if tampered(r) else own[0][i], i
            for nodes, start in ((own, i), (top, k)):
                at = start
                for low, _ in pairwise(nodes):
                    sibling = low[at ^ 1 : (at ^ 1) + 1]
                    proof += sibling
                    cur = digest([*sibling, cur] if at % 2 else [cur, *sibling])
                    at //= 2
            out.append((r["doc_id"], own[0][i], own[-1][0], top[-1][0], digest(proof), cur, cur == top[-1][0]))
    return out
