"""Token-id shards compressed by Re-Pair grammars.

Texts are encoded, a shard is cut after about `shard_ids` ids of consecutive documents, and
Re-Pair replaces frequent id pairs by nonterminals in rounds, all frequent pairs at a time,
until no pair occurs `least_count` times.  A shard's row has the rules, the expansion length
of every rule, the final symbols, the documents' id counts, and the number of ids before it in its partition: any range of ids is
decoded from the symbols and lengths alone, without the rest.

Scale: one shuffle orders texts by id; each partition writes its shards as it goes.  Files
are rows of Parquet, written and committed by Spark, so that a lost executor's shards are
written again.  Ids before a shard come from the counts of the partitions (one row each).

Defined results: a null text is empty and has the end id alone; rows with equal doc_id stay
separate, in the order of their texts' hashes; a null doc_id comes first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text import batches_of, shared_path
from plumbline.llm.tokens import encoder, ragged

SHARD_IDS, LEAST_COUNT = 1 << 20, 8


def _slots(codes: np.ndarray) -> np.ndarray:
    """A hash of 20 bits."""
    return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).view(np.int64)


def compress(ids: np.ndarray, first_free: int, least_count: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, pairs): nonterminal first_free + i stands for pairs[i], a pair of earlier symbols.

    A round replaces all pairs that occur least_count times, from the left where occurrences
    overlap; a pair of which no two occurrences could be replaced makes no rule.
    """
    seq, rules, made = ids.astype(np.int64), [np.zeros((0, 2), dtype=np.int64)], 0
    near = np.arange(max(len(seq) - 1, 0))
    while len(near):
        some = seq[near] << 32 | seq[near + 1]
        slots = _slots(some)
        if len(some) > 1 << 16:
            # Counts of hashes tell most rare pairs apart before the sort.
            often = (np.bincount(slots, minlength=1 << 20) >= least_count)[slots]
            near, some, slots = near[often], some[often], slots[often]
        kinds, counts = np.unique(some, return_counts=True)
        kinds = kinds[counts >= least_count]
        if not len(kinds):
            break
        rule = _places(some, slots, kinds)
        same = kinds[rule] == some
        at, rule = near[same], rule[same]
        # Pairs at places in a row overlap: every second is taken, from the left.
        order = np.arange(len(at), dtype=np.int32)
        begin = np.maximum.accumulate(np.where(np.concatenate(([True], at[1:] != at[:-1] + 1)), order, np.int32(0)))
        taken = (order - begin) & 1 == 0
        used = np.bincount(rule[taken], minlength=len(kinds)) > 1
        if not used.any():
            break
        taken &= used[rule]
        left, at, rule = at[~taken], at[taken], (np.cumsum(used) - 1)[rule[taken]]
        seq[at] = first_free + made + rule
        stay, fresh, held = np.ones(len(seq), dtype=bool), np.zeros(len(seq), dtype=bool), np.zeros(len(seq), dtype=bool)
        stay[at + 1], fresh[at], held[left] = False, True, True
        seq, fresh, held, kinds = seq[stay], fresh[stay], held[stay], kinds[used]
        rules.append(np.column_stack((kinds >> 32, kinds & 0xFFFFFFFF)))
        made += len(kinds)
        # A pair that was rare stays rare: next are those with a new symbol, and what is left of this round's.
        near = np.flatnonzero(fresh[:-1] | fresh[1:] | held[:-1])
    return seq, np.concatenate(rules)


def _places(some: np.ndarray, slots: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The place in kinds (sorted) of each of some that is among them, and any place of the others; slots are some's hashes."""
    table, own = np.zeros(1 << 20, dtype=np.int32), _slots(kinds)
    table[own] = np.arange(len(kinds), dtype=np.int32)
    out = table[slots]
    lost = own[table[own] != np.arange(len(kinds))]
    if len(lost):
        clash = np.zeros(1 << 20, dtype=bool)
        clash[lost] = True
        again = np.flatnonzero(clash[slots])
        out[again] = np.minimum(np.searchsorted(kinds, some[again]), len(kinds) - 1)
    return out


def lengths_of(pairs: np.ndarray, first_free: int) -> np.ndarray:
    """Ids that each rule expands to; a rule's parts are ids or earlier rules."""
    out: list[int] = []
    for a, b in pairs.tolist():
        out.append((out[a - first_free] if a >= first_free else 1) + (out[b - first_free] if b >= first_free else 1))
    return np.array(out, dtype=np.int64)


def expand(symbols: np.ndarray, pairs: np.ndarray, first_free: int) -> np.ndarray:
    """The ids of symbols: the rules that occur are expanded once each, and copied."""
    seq = symbols.astype(np.int64)
    rule = seq >= first_free
    if not rule.any():
        return seq.astype(np.int32)
    kinds, which = np.unique(seq[rule], return_inverse=True)
    table, owner = kinds, np.arange(len(kinds))
    while (deep := table >= first_free).any():
        twice = 1 + deep
        at = np.cumsum(twice) - twice
        both, owner = pairs[table[deep] - first_free], np.repeat(owner, twice)
        out = np.empty(len(owner), dtype=np.int64)
        out[at[~deep]] = table[~deep]
        out[at[deep]], out[at[deep] + 1] = both[:, 0], both[:, 1]
        table = out
    each = np.bincount(owner, minlength=len(kinds))
    sizes, starts = np.ones(len(seq), dtype=np.int64), np.arange(len(seq)) + len(table)
    sizes[rule], starts[rule] = each[which], (np.cumsum(each) - each)[which]
    return np.concatenate((table, seq)).astype(np.int32)[ragged(starts, sizes)]


def pack(ids: np.ndarray, first_free: int, **settings) -> dict:
    symbols, pairs = compress(ids, first_free, **settings)
    wide = np.uint16 if first_free + len(pairs) <= 1 << 16 else np.uint32
    return {
        "first_free": first_free, "width": int(np.dtype(wide).itemsize), "symbols": symbols.astype(wide).tobytes(),
        "rules": pairs.astype(wide).tobytes(), "expansions": lengths_of(pairs, first_free).astype("<u4").tobytes(),
    }


def unpack(row: dict, start: int = 0, count: int | None = None) -> np.ndarray:
    """Ids start ... start + count - 1 of a shard; only the symbols that cover them are expanded."""
    wide, free = np.dtype(f"<u{row['width']}"), row["first_free"]
    symbols, pairs = np.frombuffer(row["symbols"], wide), np.frombuffer(row["rules"], wide).reshape(-1, 2)
    if start == 0 and count is None:
        return expand(symbols, pairs, free)
    sizes, s = np.frombuffer(row["expansions"], "<u4").astype(np.int64), symbols.astype(np.int64)
    each = np.ones(len(s), dtype=np.int64)
    each[s >= free] = sizes[s[s >= free] - free]
    ends = np.cumsum(each)
    count = int(ends[-1]) - start if count is None and len(ends) else count or 0
    a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, start + count, side="left") + 1
    before = int(ends[a - 1]) if a else 0
    return expand(s[a:b], pairs, free)[start - before : start - before + count]


SHARD = "part int, skip long, docs array<{id}>, sizes array<int>, first_free int, width int, symbols binary, rules binary, expansions binary"


def encode(docs: DataFrame, path: str, shard_ids: int = SHARD_IDS, tokenizer: str = "byte_bpe_50k.json", folder: str | None = None, **settings) -> str:
    """Writes docs (doc_id, text) as shards in ascending doc_id order to path."""
    kind = docs.schema["doc_id"].dataType
    ordered = docs.select("doc_id", "text").repartitionByRange(_partitions(docs), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, skip = encoder(tokenizer, folder), TaskContext.get().partitionId(), 0
        free, held, ids, sizes, total = len(coder.id_bytes), [], [], [], 0

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            row = {"part": part, "skip": skip, "docs": held, "sizes": np.concatenate(sizes).tolist(), **pack(flat, free, **settings)}
            return pa.RecordBatch.from_pylist([row], schema=layout)

        for whole in batches:
            for batch in batches_of(whole, 4_000_000):
                flat, n = coder.encode(batch.column("text"))
                held, total = held + batch.column("doc_id").to_pylist(), total + len(flat)
                ids.append(flat)
                sizes.append(n)
                if total >= shard_ids:
                    yield flush()
                    skip, held, ids, sizes, total = skip + total, [], [], [], 0
        if held:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_type

    layout = pa.schema([
        ("part", pa.int32()), ("skip", pa.int64()), ("docs", pa.list_(to_arrow_type(kind))), ("sizes", pa.list_(pa.int32())), ("first_free", pa.int32()),
        ("width", pa.int32()), ("symbols", pa.binary()), ("rules", pa.binary()), ("expansions", pa.binary()),
    ])
    ordered.mapInArrow(run, SHARD.format(id=kind.simpleString())).write.parquet(path)
    return path


def _partitions(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def decode(spark, path: str) -> DataFrame:
    """Per document, in the order written: doc_id, start, n_tokens, ids_crc32; read from the shards alone."""
    shards = spark.read.parquet(path)
    count = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    # One row a partition of the writer, whatever its size.
    by_part = shards.select("part", count.alias("n")).groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    before = dict(zip((r["part"] for r in by_part), np.cumsum([0, *(r["n"] for r in by_part)]).tolist(), strict=False))
    kind = shards.schema["docs"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, sizes = unpack(row), np.array(row["sizes"], dtype=np.int64)
                ends, raw = np.cumsum(sizes), ids.astype("<u4")
                begins = ends - sizes
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["docs"], batch.schema.field("docs").type.value_type), pa.array(begins + before[row["part"]] + row["skip"]),
                        pa.array(sizes), pa.array([zlib.crc32(raw[a:b]) for a, b in zip(begins, ends, strict=True)], pa.int64()),
                    ], names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return shards.mapInArrow(run, f"doc_id {kind.simpleString()}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, **settings) -> DataFrame:
    spark = docs.sparkSession
    return decode(spark, encode(docs, shared_path(spark, "shards"), **settings))


__all__ = ["compress", "expand", "unpack", "pack", "encode", "decode", "round_trip", "ragged"]
