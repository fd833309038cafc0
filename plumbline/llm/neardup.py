"""Near duplicates by circulant MinHash, banding, and exact Jaccard on whole shingle sets.

A text is the set of its runs of five words.  Circulant MinHash draws all coordinates of a
signature from two permutations: the first scatters a shingle to a place s on a circle, the
second is read at s, s + 1, ..., s + K - 1; so the K values of a shingle are one slice of
the table, and a signature is the least over the slices.  The first permutation is a hash of
the shingle modulo the circle's size, so that two shingles may share a place.  40 bands of 5
coordinates miss a pair at a similarity of 0.75 with a probability of 2e-5, at 0.85 of 1e-10.

Scale.  Equal sets share one node and so one row in a bucket; no group is expanded into its
pairs.  A bucket's leader is the member that meets the most others in all its buckets, which in
a group of copies is the text they were made from.  All members are compared with their
leader.  Buckets with one leader then form one family, and a family whose members all are in
one component is done.  In the others, more members lead, sixteen times as many each round,
those without a link first, and leave the family when they have met its members.  Pairs that
are decided are not compared: nodes in one component already, nodes A and B with
|d(A, L) - d(B, L)| > 1/4 for the family's leader L (the triangle inequality of the Jaccard
distance d), and pairs whose sketches (a bit of each of 2048 further coordinates) differ by
more than a pair at the threshold does with a probability of 3e-6, well below that of the
bands.  Rounds end when no family is open, so that no pair in a bucket stays undecided.

Nodes are 64-bit hashes of sets; a second 64-bit hash must agree for rows to share a group.

Defined results: a text with fewer words is one shingle; null, empty and blank texts have no
shingles, are linked with nothing and are kept.  Rows are told apart by doc_id and text, so
that rows with equal doc_id are judged by their own texts.  Rows with a null doc_id belong to a group and
may connect it, but are not its smallest id; of a group with null ids alone one row is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.text import WordHashes, batches_of, blank_words, kept, mix, ngram_hashes, signed, stored, utf8

SHINGLE, BANDS, ROWS, PLACES, SKETCH = 5, 40, 5, 1 << 20, 32
#: Leaders of a family in its first round, and how many times as many in the next.
LEADERS, MORE = 16, 16


def shingles(words: list[bytes], hashes: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of words, sorted."""
    return np.unique(ngram_hashes(hashes(words), width))


def second_permutation(places: int, coordinates: int) -> np.ndarray:
    """Of the circle, with its start repeated so that every slice is contiguous."""
    table = np.random.Generator(np.random.PCG64(20240607)).permutation(places).astype(np.int32)
    return np.concatenate((table, table[: coordinates - 1]))


def signatures(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS, places: int = PLACES) -> np.ndarray:
    """For each set that is not empty, a row of bands * rows coordinates."""
    k = bands * rows
    memory = kept("near duplicates", dict)
    if ("table", places, k) not in memory:
        memory["table", places, k] = np.lib.stride_tricks.sliding_window_view(second_permutation(places, k), k)
    table = memory["table", places, k]
    out = np.empty((len(sets), k), dtype=np.int32)
    for i, s in enumerate(sets):
        at = (s >> np.uint64(40)).astype(np.int64) % places  # the first permutation: the hash's high bits
        low = None
        for j in range(0, len(at), 2048):
            part = table[at[j : j + 2048]].min(axis=0)
            low = part if low is None else np.minimum(low, part)
        out[i] = low
    return out


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band, different bands apart."""
    n, k = signature.shape
    parts = signature.reshape(n, k // rows, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(k // rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (n, k // rows)).copy()
        for j in range(rows):
            key = (key ^ parts[:, :, j]) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
    return signed(key)


def _node(s: np.ndarray, seed: int = 7) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed) - (1 << 63)


def row_key() -> Column:
    """Tells rows apart by doc_id and text: each `-` if null, else its length, `:` and itself."""
    parts = [F.col("doc_id").cast("string"), F.col("text")]
    return F.unhex(F.md5(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in parts))))


def _sets(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    words = kept("near duplicates", dict).setdefault("words", WordHashes())
    return [shingles(blank_words(t.lower() if t else t), words, width) for t in utf8(batch.column("text"))]


def signed_sets(docs: DataFrame, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text) -> (row, doc_id, n_shingles, node, mark, keys); node and mark, the set's hashes, are null for empty sets."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, 4_000_000):
                sets = _sets(batch, width)
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(signatures(full, bands, rows), rows) if full else ())
                node, mark = ([_node(s, seed) if len(s) else None for s in sets] for seed in (7, 8))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row"), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.int64()), pa.array(mark, pa.int64()),
                        pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ], names=["row", "doc_id", "n_shingles", "node", "mark", "keys"],
                )

    return docs.select(row_key().alias("row"), "doc_id", "text").mapInArrow(run, f"row binary, doc_id {kind}, n_shingles long, node long, mark long, keys array<long>")


def sketch(items: np.ndarray, longs: int = SKETCH) -> list[int]:
    """One bit of each of 64 * longs further coordinates: differing bits of two sketches estimate (1 - J) / 2."""
    low = signatures([mix(items + np.uint64(0x5E7C4))], 1, 64 * longs)[0]
    return np.packbits((low & 1).astype(np.uint8)).view(np.int64).tolist()


BITS = [f"s{i}" for i in range(SKETCH)]


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(node, mark, items, s0, s1, ...): the whole sets of the wanted (row, node) pairs, hashed again from the texts, and their sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, 2_000_000):
                good = [(n, _node(s, 8), signed(s), sketch(s)) for n, s in zip(batch.column("node").to_pylist(), _sets(batch, width), strict=True) if len(s) and _node(s) == n]
                bits = np.array([b for *_, b in good], dtype=np.int64).reshape(len(good), SKETCH)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([n for n, *_ in good], pa.int64()), pa.array([m for _, m, *_ in good], pa.int64()), pa.array([s for _, _, s, _ in good], pa.list_(pa.int64())),
                        *(pa.array(bits[:, i]) for i in range(SKETCH)),
                    ], names=["node", "mark", "items", *BITS],
                )

    # Rows that repeat doc_id and text lie together after the join, and one of them is enough.
    texts = docs.select(row_key().alias("row"), "text").join(wanted, "row").dropDuplicates(["row"]).select("node", "text")
    return texts.mapInArrow(run, f"node long, mark long, items array<long>, {', '.join(f'{b} long' for b in BITS)}")


def most_bits(percent: int, bits: int) -> int:
    """Differing bits that a pair at the threshold exceeds with a probability of 3e-6: 4.5 standard deviations."""
    p = (1 - percent / 100) / 2
    return int(bits * p + 4.5 * (bits * p * (1 - p)) ** 0.5)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with d, the Jaccard distance of the whole sets, and linked."""
    x = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = pairs.join(x, "a").join(y, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    either = F.size("x") + F.size("y") - F.col("common")
    return both.select("a", "b", (1 - F.col("common") / either).alias("d"), (100 * F.col("common") >= percent * either).alias("linked"))


def _led(nodes: DataFrame) -> DataFrame:
    """(a, b) from nodes (node, keys): each node and the leaders of its buckets, different pairs."""
    inside = nodes.select("node", F.explode("keys").alias("bucket"))
    shared = inside.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(inside.join(shared, "bucket").select("bucket", "node", "n"), "members")
    meets = members.groupBy("node").agg(F.sum("n").alias("meets"))
    leaders = members.join(meets, "node").groupBy("bucket").agg(F.max(F.struct("meets", "node"))["node"].alias("leader"))
    return members.join(leaders, "bucket").where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()


def _open(rows: DataFrame) -> DataFrame:
    """Rows (family, node, c, ...) of families with more than one component."""
    mixed = rows.groupBy("family").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("family")
    return rows.join(mixed, "family")


def links(docs: DataFrame, sig: DataFrame, percent: int = 75, width: int = SHINGLE) -> DataFrame:
    """(node, mark, component): the nodes of each group of linked nodes with the group's smallest; all links are confirmed on whole sets."""
    known = sig.where("node is not null").groupBy("node").agg(F.min(F.struct("mark", "row", "keys")).alias("m")).select("node", "m.row", "m.keys")
    pairs = stored(_led(known), "pairs")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = stored(shingle_sets(docs, known.select("row", "node").join(asked, "node"), width), "sets")
    judged = stored(confirmed(pairs, sets, percent), "judged")
    label = components(judged.where("linked").select("a", "b"))
    # Of the pairs that led, those that share a leader make its family.
    rows = judged.select(F.col("b").alias("family"), F.col("a").alias("node"), "d").join(label, "node", "left")
    rows = rows.select("family", "node", "d", F.coalesce("component", "node").alias("c"), F.col("component").isNotNull().alias("tied"))
    active = stored(_open(rows).join(sets.select("node", *BITS), "node"), "active")
    margin, k = 1 - percent / 100 + 1e-9, LEADERS
    differ = reduce(lambda a, b: a + b, (F.bit_count(F.col(c).bitwiseXOR(F.col(f"leader_{c}"))) for c in BITS))
    near = (F.abs(F.col("d") - F.col("leader_d")) <= margin) & (differ <= most_bits(percent, 64 * SKETCH))
    while not active.isEmpty():
        leaders = _leaders(active, k)
        asked = active.join(leaders, "family").where((F.col("c") != F.col("leader_c")) & near)
        asked = asked.select(F.least("node", "leader_node").alias("a"), F.greatest("node", "leader_node").alias("b")).distinct()
        found = stored(confirmed(asked, sets, percent), "judged").where("linked")
        # Leaders have met every open pair of theirs in the family.
        left = active.join(leaders.select("family", F.col("leader_node").alias("node")), ["family", "node"], "left_anti")
        if not found.isEmpty():
            ids = label.select("node", F.col("component"))
            ends = found.join(ids.toDF("a", "x"), "a", "left").join(ids.toDF("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
            step = components(ends).toDF("c", "to")
            label = stored(_composed(label, step), "label")
            left = left.join(step, "c", "left").withColumns({"tied": F.col("tied") | F.col("to").isNotNull(), "c": F.coalesce("to", "c")})
        active, k = stored(_open(left).select(active.columns), "active"), MORE * k
    return label.join(sets.select("node", "mark"), "node")


def _leaders(active: DataFrame, k: int) -> DataFrame:
    """k nodes of each family, those without a link first; Spark keeps the first k of each before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("family").orderBy("tied", F.xxhash64("node"), "node"))
    first = active.withColumn("rank", rank).where(F.col("rank") <= k)
    return first.select("family", *(F.col(c).alias(f"leader_{c}") for c in ("node", "c", "d", *BITS)))


def _composed(label: DataFrame, step: DataFrame) -> DataFrame:
    """label (node, component) followed by step (c, to), whose c are components or nodes without one."""
    further = label.join(step, label.component == step.c, "left").select("node", F.coalesce("to", "component").alias("component"))
    fresh = step.select(F.col("c").alias("node"), F.col("to").alias("component")).join(label, "node", "left_anti")
    return further.unionByName(fresh)


def _groups(docs: DataFrame, percent: int, width: int, bands: int, rows: int) -> DataFrame:
    """A row of docs each: row, doc_id, n_shingles, and the group's first: the row with its smallest doc_id, nulls last."""
    sig = stored(signed_sets(docs, width, bands, rows), "signatures")
    top = links(docs, sig, percent, width)
    ids = sig.select("row", "doc_id", "n_shingles", "node", "mark").join(top, ["node", "mark"], "left")
    ids = ids.select("row", "doc_id", "n_shingles", F.coalesce("component", "node").alias("top"), F.when(F.col("component").isNull(), F.col("mark")).alias("own"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first")
    least = ids.where("top is not null").groupBy(F.col("top").alias("t"), F.col("own").alias("o")).agg(first)
    return ids.join(least, (F.col("top") == F.col("t")) & F.col("own").eqNullSafe(F.col("o")), "left").select("row", "doc_id", "n_shingles", "first")


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    out = _groups(docs, percent, width, bands, rows)
    component = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    stays = F.when(F.col("first").isNull(), True).when(F.col("first.last"), F.col("row") == F.col("first.row")).otherwise(F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), stays.alias("kept"))


def deduplicate(docs: DataFrame, percent: int = 75, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs without near duplicates: one row of each group stays, that with its smallest doc_id.

    Rows that repeat both doc_id and text are one document, and the one whose other columns are least as JSON stays.
    """
    out = _groups(docs, percent, width, bands, rows)
    stay = out.where(F.col("first").isNull() | (F.col("row") == F.col("first.row"))).select(F.col("row").alias("key")).distinct()
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rank = F.to_json(F.struct(*rest)) if rest else F.lit("")
    wide = docs.select(row_key().alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("all"), rank.alias("rank"))
    return wide.join(stay, "key", "left_semi").groupBy("key").agg(F.min_by("all", "rank").alias("all")).select([F.col("all").getField(c).alias(c) for c in docs.columns])
