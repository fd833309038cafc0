"""Hierarchical packing into sequences of several context sizes.

A document's ids are cut into as many full windows of the largest size as it has; its rest goes
to the list of the tier of the least size that holds it.  While more than `buffer_ids` ids are
held, the tier with the most of them makes a window from its own list, longest rest first; the
gap is filled with the longest rest that fits, which shorter tiers have, and where none fits
with the start of the shortest.  At the end of a partition each tier packs what its list has
left; what no full window takes is one padded window of the lowest tier.

Step groups hold the same number of ids: the sequences of a tier are numbered over all
partitions and dealt to groups of `step_ids` ids; only the last group of a tier may hold fewer.

Scale: each partition of the input packs its own documents in one pass, with a buffer of at most
`buffer_ids` ids, and a task that is run again gives the same sequences.  Pieces (no texts) are
stored once; the numbers of earlier sequences are sums over a row for each partition and tier.
At most one window a partition is padded.

Defined results: a null text is empty and has the end id alone; every row is packed by itself,
equal ids or not; a null doc_id stays null.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.text import batches_of, stored
from plumbline.llm.tokens import encoder

TIERS, BUFFER_IDS, STEP_IDS = (1024, 512, 256, 128), 1 << 20, 1 << 16
#: Of the encoder's memory and of the texts encoded at once: a worker packs beside all that earlier operators left in its executor.
PIECES, SLICE_BYTES = 300_000, 1_000_000


class Packer:
    """Of rests (size, order, document, start), a list a tier; sequences are lists of (document, start, length)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, buffer_ids: int = BUFFER_IDS):
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.buffer_ids = max(buffer_ids, self.tiers[0])
        self.rests: dict[int, list[tuple[int, int, int, int]]] = {t: [] for t in self.tiers}
        self.held, self.total, self.order = dict.fromkeys(self.tiers, 0), 0, 0

    def add(self, document: int, size: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        top, start = self.tiers[0], 0
        while size - start >= top:
            yield top, [(document, start, top)]
            start += top
        if size > start:
            self._keep(document, start, size - start)
        while self.total > self.buffer_ids:
            yield self._window(max(self.tiers, key=self.held.__getitem__))

    def _keep(self, document: int, start: int, size: int) -> None:
        tier = min(t for t in self.tiers if t >= size)
        insort(self.rests[tier], (size, self.order, document, start))
        self.order, self.total = self.order + 1, self.total + size
        self.held[tier] += size

    def _take(self, gap: int) -> tuple[int, int, int, int]:
        """The longest rest of at most gap ids, or else the shortest of all."""
        fits = [t for t in self.tiers if t < gap]
        for tier in [min(t for t in self.tiers if t >= gap), *fits]:
            at = bisect_left(self.rests[tier], (gap + 1,)) - 1
            if at >= 0:
                break
        else:
            tier, at = min(t for t in self.tiers if self.rests[t]), 0
        rest = self.rests[tier].pop(at)
        self.held[tier] -= rest[0]
        self.total -= rest[0]
        return rest

    def _window(self, room: int) -> tuple[int, list[tuple[int, int, int]]]:
        """A full window: the longest rest, then the longest that fit the gap, then the start of the shortest."""
        out, gap = [], room
        while gap:
            size, _, document, start = self._take(gap)
            used = min(size, gap)
            out.append((document, start, used))
            gap -= used
            if size > used:
                self._keep(document, start + used, size - used)
        return room, out

    def finish(self) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        for tier in self.tiers:
            while self.rests[tier] and self.total >= tier:
                yield self._window(tier)
        for tier in self.tiers:  # rests of a tier that had not enough for its last window
            while self.total >= tier:
                yield self._window(tier)
        if self.total:
            yield self.tiers[-1], [(d, s, n) for t in self.tiers for n, _, d, s in self.rests[t]]
            self.__init__(self.tiers, self.buffer_ids)


OUT = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def pack(docs: DataFrame, tiers: tuple[int, ...] = TIERS, buffer_ids: int = BUFFER_IDS, step_ids: int = STEP_IDS, tokenizer: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    types = [to_arrow_type(kind), *[pa.int64()] * 6, pa.int32(), pa.int64()]
    names = [x.split(" ")[0] for x in OUT.format(id="x").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer, base = encoder(tokenizer, folder, PIECES), Packer(tiers, buffer_ids), TaskContext.get().partitionId() << 36
        known: dict[int, list] = {}  # number: id, ids from `first` on, first, ids not yet packed, ids of the document
        rows: list[tuple] = []
        made, dealt, n = 0, dict.fromkeys(packer.tiers, 0), 0

        def place(sequences) -> None:
            nonlocal made
            for tier, pieces in sequences:
                at = 0
                for number, start, length in pieces:
                    doc = known[number]
                    part = doc[1][start - doc[2] : start - doc[2] + length]
                    rows.append((doc[0], start, length, zlib.crc32(part), doc[4], base + made, at, tier, dealt[tier]))
                    at += length
                    doc[3] -= length
                    if not doc[3]:
                        del known[number]
                dealt[tier] += 1
                made += 1

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
            rows.clear()
            return out

        for whole in batches:
            for batch in batches_of(whole, SLICE_BYTES):
                flat, sizes = coder.encode(batch.column("text"))
                flat, end = flat.astype("<u4"), 0
                for doc_id, size in zip(batch.column("doc_id").to_pylist(), sizes.tolist(), strict=True):
                    known[n] = [doc_id, flat[end : end + size], 0, size, size]
                    place(packer.add(n, size))
                    end += size
                    if n in known:  # what waits for its window is the document's end, and only that is held
                        left = known[n][3]
                        known[n][1:3] = flat[end - left : end].copy(), size - left
                    n += 1
                if rows:
                    yield flush()
        place(packer.finish())
        if rows:
            yield flush()

    packed = stored(docs.select("doc_id", "text").mapInArrow(run, OUT.format(id=kind.simpleString())), "packed")
    return _grouped(packed, tiers, step_ids)


def _grouped(packed: DataFrame, tiers: tuple[int, ...], step_ids: int) -> DataFrame:
    """packed with step_group, there a sequence's number in its partition and tier, as a group of all partitions."""
    packed = packed.withColumn("part", F.shiftright("sequence_id", 36))
    each = packed.groupBy("part", "tier").agg((F.max("step_group") + 1).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = each.select("part", "tier", F.coalesce(earlier, F.lit(0)).alias("before"))
    order = sorted(tiers, reverse=True)
    place = F.element_at(F.create_map(*[F.lit(x) for i, t in enumerate(order) for x in (t, i)]), F.col("tier"))
    most = F.element_at(F.create_map(*[F.lit(x) for t in order for x in (t, max(1, step_ids // t))]), F.col("tier"))
    group = F.floor((F.col("before") + F.col("step_group")) / most).cast("long") * len(order) + place
    return packed.join(F.broadcast(before), ["part", "tier"]).withColumn("step_group", group).select([x.split(" ")[0] for x in OUT.split(", ")])
