"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every run of words of every item.  The words of a text stream through
it; at each word it knows the longest run that ends there and occurs in an item.  A run of
at least `window` words, or a whole item that is shorter, is a hit.

Scale: the items are read in blocks of bounded size, one automaton each, sent to the
executors as a broadcast of at most about `block_bytes` (or one item).  Texts are scanned
where they lie, without a shuffle.  With more than one block, texts are scanned once for windows of any
item, by a Bloom filter of bounded size, and the automata scan those that may be hit, a different text once;
their hits are joined to the documents by key.

Defined results: null or empty texts have no words and no hits; null items and items without
words have no windows; equal items are listed under each of their ids, a null id as "null";
repeated rows give repeated results; other columns are not touched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.order import spread_join
from plumbline.llm.repeats import run_hashes
from plumbline.llm.text import WordHashes, alnum_words, kept, mix, stored, utf8

BLOCK_BYTES, FILTER_BYTES, PIECE = 1_000_000, 1 << 26, 1 << 16
SCAN = {"n_words": T.LongType(), "hits": T.ArrayType(T.IntegerType()), "items": T.ArrayType(T.StringType())}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class SuffixAutomaton:
    """Of the word sequences of (id, words) items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            state = 0
            for w in words:
                state = self._extend(state, w)
        self._name_hits(items)

    def _state(self, length: int, follow: dict[bytes, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, w: bytes) -> int:
        """The state of p's longest run followed by w, which exists: on its own if it was not yet."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, w: bytes) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new

    def _name_hits(self, items: list[tuple[str, list[bytes]]]) -> None:
        """For states: the items with a window that ends a run there, and whole short items that do."""
        n, window = len(self.length), self.window
        #: The state with the run of exactly `window` words that ends each state's runs; -1 without.
        self.base = [-1] * n
        for v in sorted(range(n), key=self.length.__getitem__):
            if self.length[v] >= window:
                up = self.link[v]
                self.base[v] = self.base[up] if up >= 0 and self.length[up] >= window else v
        self.long_items: dict[int, set[str]] = {}
        own: dict[int, dict[int, set[str]]] = {}
        for name, words in items:
            v = 0
            for i, w in enumerate(words):
                v = self.next[v][w]
                if i + 1 >= window:
                    self.long_items.setdefault(self.base[v], set()).add(name)
            if 0 < len(words) < window:
                own.setdefault(v, {}).setdefault(len(words), set()).add(name)
        #: Whole short items among the runs that end in a state, longest first.
        self.short: list[list[tuple[int, set[str]]] | None] = [None] * n
        for v in sorted(range(1, n), key=self.length.__getitem__):
            mine = sorted(own.get(v, {}).items(), reverse=True)
            above = self.short[self.link[v]] if self.link[v] > 0 else None
            self.short[v] = (mine + (above or [])) or None

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans [start, end) of words in order of their ends, and the items hit."""
        follow, link, length, short, window = self.next, self.link, self.length, self.short, self.window
        v = run = 0
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        root = follow[0]
        for i, w in enumerate(words):
            to = follow[v].get(w)
            if to is None:
                if not v:
                    continue
                v = link[v]
                while v and w not in follow[v]:
                    v = link[v]
                run = length[v]
                to = (follow[v] if v else root).get(w)
                if to is None:
                    v = run = 0
                    continue
            v = to
            run += 1
            if run >= window:
                spans.append((i + 1 - run, i + 1))
                found |= self.long_items[self.base[v]]
            if short[v] is not None:
                for k, names in short[v]:
                    if k <= run:
                        spans.append((i + 1 - k, i + 1))
                        found |= names
        return spans, found


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _automaton(block, window: int) -> SuffixAutomaton:
    """Built once for each block in a Python worker; the last one is kept."""
    return kept(f"automaton {block.id} {window}", lambda: SuffixAutomaton([(n, alnum_words(t)) for n, t in block.value], window))


class Block:
    """A broadcast with a key of its own."""

    def __init__(self, spark, rows: list[tuple[str, bytes]]):
        self.shared = spark.sparkContext.broadcast(rows)
        self.id = hashlib.sha256(repr(rows).encode()).hexdigest()

    @property
    def value(self):
        return self.shared.value


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[Block]:
    """Items (item_id, text) in broadcasts of about block_bytes; the number follows a count of their size."""
    spark = items.sparkSession
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text").where("text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    out = []
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        out.append(Block(spark, sorted((r[0], r[1].encode()) for r in part.toLocalIterator())))
    return out


def _scanned(docs: DataFrame, block: Block, window: int, only_hits: bool) -> DataFrame:
    """Adds SCAN's columns to (doc_id, text): hits is start, end, start, end ... of words."""
    schema = T.StructType([*docs.schema.fields, *(T.StructField(name, kind) for name, kind in SCAN.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(block, window)
        for batch in batches:
            n_words, hits, items = [], [], []
            for text in utf8(batch.column("text")):
                words = alnum_words(text)
                spans, found = automaton.scan(words)
                n_words.append(len(words))
                hits.append([x for s in united(spans) for x in s])
                items.append(sorted(found))
            out = pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                names=[*batch.schema.names, "n_words", "hits", "items"],
            )
            if only_hits:
                out = out.filter(pa.array([bool(x) for x in hits], pa.bool_()))
            yield out

    return docs.mapInArrow(run, schema)


class Windows:
    """A Bloom filter of the items' windows: texts that pass it may be hit, others cannot."""

    def __init__(self, bits: np.ndarray, lengths: list[int]):
        self.bits, self.lengths = bits, lengths

    def meets(self, words: np.ndarray) -> bool:
        return any(self._set(run_hashes(words, k)).any() for k in self.lengths)

    def _set(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), dtype=bool)
        for at in bloom_places(h, 8 * len(self.bits)):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def bloom_places(h: np.ndarray, m: int) -> list[np.ndarray]:
    return [(part % np.uint64(m)).astype(np.int64) for part in (h, mix(h), mix(h ^ np.uint64(0x5BD1E995)))]


def item_windows(items: DataFrame, window: int, total_bytes: int, filter_bytes: int = FILTER_BYTES) -> Windows:
    """Made by Spark, a piece for each run of bits: two bits a byte of the items, and filter_bytes at most; more windows let more texts pass."""
    m = min(filter_bytes, max(PIECE, -(-(total_bytes // 4) // PIECE) * PIECE))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(21)
        for batch in batches:
            for text in utf8(batch.column("text")):
                words = hashes(alnum_words(text))
                k = min(window, len(words))
                if k:
                    at = np.unique(np.concatenate(bloom_places(run_hashes(words, k), 8 * m)))
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.int32()), pa.array(at)], names=["k", "at"])

    spots = stored(items.select("text").mapInArrow(places, "k int, at long").distinct(), "windows")
    lengths = sorted(r[0] for r in spots.select("k").distinct().collect())

    def piece(key: tuple, table: pa.Table) -> pa.Table:
        bits = np.zeros(8 * PIECE, dtype=np.uint8)
        bits[table.column("at").to_numpy() - key[0].as_py() * 8 * PIECE] = 1
        return pa.table({"n": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    bits = np.zeros(m, dtype=np.uint8)
    for n, got in spots.withColumn("n", F.floor(F.col("at") / (8 * PIECE))).groupBy("n").applyInArrow(piece, "n long, bits binary").toLocalIterator():
        bits[n * PIECE : (n + 1) * PIECE] = np.frombuffer(got, dtype=np.uint8)
    return Windows(bits, lengths)


def _sieved(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """Adds n_words and maybe, false where no window of any item is in the text, to rows with a text."""
    total = items.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    sent = docs.sparkSession.sparkContext.broadcast(item_windows(items, window, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, windows = WordHashes(21), sent.value
        for batch in batches:
            words = [alnum_words(t) for t in utf8(batch.column("text"))]
            maybe = [bool(w) and windows.meets(hashes(w)) for w in words]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(w) for w in words], pa.int64()), pa.array(maybe, pa.bool_())], names=[*batch.schema.names, "n_words", "maybe"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("maybe", T.BooleanType())]))


def same_text() -> list:
    """Columns k and size, equal for equal texts."""
    return [F.unhex(F.md5("text")).alias("k"), F.octet_length("text").alias("size")]


def scan(docs: DataFrame, items: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text) with n_words, hits (word spans) and items (ids of items hit).

    With several blocks, the few texts that may be hit are kept in a table, and the automata scan that.
    """
    docs = docs.select("doc_id", "text")
    blocks = item_blocks(items, block_bytes)
    if len(blocks) == 1:
        return _scanned(docs, blocks[0], window, False)
    sieved = _sieved(docs, items, window)
    maybe = stored(sieved.where("maybe").select("doc_id", "text", "n_words", *same_text()), "maybe")
    texts = stored(maybe.groupBy("k", "size").agg(F.first("text").alias("text"), F.count("*").alias("n")), "texts")
    # Hits depend on the text alone: equal texts share them, one row a text and block.
    found = reduce(DataFrame.unionByName, (_scanned(texts, block, window, True).select("k", "size", "n", "hits", "items") for block in blocks))
    found = found.groupBy("k", "size").agg(F.first("n").alias("n"), F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hit = spread_join(maybe, stored(found, "hits"), ["k", "size"], "left")
    none = [F.expr("cast(array() as array<int>)").alias("hits"), F.expr("cast(array() as array<string>)").alias("items")]
    rest = sieved.where("not maybe").select("doc_id", "text", "n_words", *none)
    return rest.unionByName(hit.select("doc_id", "text", "n_words", *(F.coalesce(F.col(c), F.expr(f"cast(array() as array<{k}>)")).alias(c) for c, k in (("hits", "int"), ("items", "string")))))


def digest(scanned: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""

    @F.pandas_udf("long")
    def n_hit(hits):
        return hits.map(lambda h: sum(b - a for a, b in united([*zip(h[::2].tolist(), h[1::2].tolist(), strict=True)])))

    return scanned.withColumn("n_hit", n_hit("hits")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, most_coverage: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the hit spans; documents with more than most_coverage of their words hit go.

    A document is judged once, by the hits of all items on its text as it came.  Spans are
    removed again until none is left, as their neighbours may form a new hit; with more than
    one block the hits of all blocks are united before each removal, and only texts that
    changed are scanned again.
    n_chars follows the text.  Documents without a hit come out as they went in.
    """
    blocks = item_blocks(items, block_bytes)
    if len(blocks) == 1:
        return _removed(docs, blocks[0], window, most_coverage)
    # One row for each text that may be hit, with its key, and how many rows have it.
    texts = _sieved(docs.select("text").where("text is not null"), items, window).where("maybe").select(*same_text(), "text")
    now = stored(texts.groupBy("k", "size").agg(F.first("text").alias("text"), F.count("*").alias("n")), "texts")
    copies = now.select("k", "size", "n")
    limit, done = most_coverage, None
    while True:
        found = reduce(DataFrame.unionByName, (_scanned(now, block, window, True) for block in blocks))
        # Equal texts share their hits; a text that is hit comes once from each block.
        found = found.select("k", "size", "text", "n_words", "hits")
        hit = found.groupBy("k", "size").agg(F.first("text").alias("text"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"))
        cut = stored(_cut_rows(hit, limit), "cut")
        if cut.isEmpty():
            break
        if done is None:
            done = cut
        else:
            later = cut.select("k", "size", F.col("new").alias("later"))
            done = stored(done.join(later, ["k", "size"], "left").select("k", "size", F.coalesce("later", "new").alias("new")), "done")
        now, limit = cut.where("new is not null").select("k", "size", F.col("new").alias("text")), None  # a text is in it once
    if done is None:
        return docs
    # The columns of docs travel in one struct, so that no name of theirs meets one of these.
    rows = docs.select(*same_text(), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    changed = stored(done.join(copies, ["k", "size"]).withColumn("hit", F.lit(True)), "changed")
    rows = spread_join(rows, changed, ["k", "size"], "left").where("hit is null or new is not null")
    old = lambda c: F.col("row").getField(c)
    made = {"text": F.coalesce("new", old("text"))}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("hit"), F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(old("n_chars"))
    return rows.select([made.get(c, old(c)).alias(c) for c in docs.columns])


def _cut_rows(hit: DataFrame, most_coverage: float | None) -> DataFrame:
    """(k, size, new): texts without their hits; null if more than most_coverage of the words are hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for text, n, h in zip(*(batch.column(c).to_pylist() for c in ("text", "n_words", "hits")), strict=True):
                spans = united([*zip(h[::2], h[1::2], strict=True)])
                gone = most_coverage is not None and sum(b - a for a, b in spans) > most_coverage * n
                new.append(None if gone else _cut(text, spans))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("size"), pa.array(new, pa.string())], names=["k", "size", "new"])

    return hit.mapInArrow(run, "k binary, size int, new string")


def _removed(docs: DataFrame, block: Block, window: int, most_coverage: float) -> DataFrame:
    at_text, at_chars = (docs.columns.index(c) if c in docs.columns else None for c in ("text", "n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(block, window)
        for batch in batches:
            keep, texts = [], utf8(batch.column("text"))
            for i, text in enumerate(texts):
                words = alnum_words(text)
                spans, _ = automaton.scan(words)
                keep.append(not spans or sum(b - a for a, b in united(spans)) <= most_coverage * len(words))
                while spans and keep[-1]:
                    text = _cut(text.decode(), united(spans)).encode()
                    spans, _ = automaton.scan(alnum_words(text))
                texts[i] = text
            new = [None if t is None else t.decode() for t in texts]
            columns = list(batch.columns)
            if at_chars is not None:
                old, was = columns[at_chars].to_pylist(), columns[at_text].to_pylist()
                columns[at_chars] = pa.array([c if a == b else len(b) for c, a, b in zip(old, was, new, strict=True)], columns[at_chars].type)
            columns[at_text] = pa.array(new, columns[at_text].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    places = [m.span() for m in _WORD.finditer(text)]
    at, out = 0, []
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def brute_force(text: str | None, items: list[tuple[str, str | None]], window: int = 10) -> tuple[int, int, set[str]]:
    """n_words, n_hit and items by comparing every window; for tests."""
    words = alnum_words(text.encode()) if text else []
    hit, found = np.zeros(len(words), dtype=bool), set()
    for name, item in items:
        run = alnum_words(item.encode()) if item else []
        k = min(window, len(run))
        for i in range(len(run) - k + 1 if k else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == run[i : i + k]:
                    hit[j : j + k] = True
                    found.add(name)
    return len(words), int(hit.sum()), found
