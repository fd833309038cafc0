"""Repeated runs of words by level-wise doubling: what repeats at one length is extended to twice that.

A run of `window` words repeats only if the two runs of half as many words that make it up do.
Lengths are halved down to `least`; at the first, runs are counted, and each later level
hashes and counts only the runs whose halves both repeat, until the window's length is
reached or nothing survives.  `longest` goes on doubling from there.  `least` is not small, as
most short runs of a large corpus repeat and would prune nothing: 35 words are 18 doubled.

First level.  Of all runs of the first length only those are sent that have the least hash among
the runs inside some window (all of them, if several have it).  Equal windows have their
least runs at the same places, so a window can repeat only if the least run inside it does.

Scale.  Equal texts are judged once: texts are grouped by MD5, with a partial aggregation,
and written once, bucketed by that key, so that the visits of the texts that follow move no text.
Runs travel as (key, place, 64-bit hash), packed for each range of hashes and each four
megabytes of text.  A run that occurs twice in such a piece is known to repeat at once: one of its
hashes is sent to tell the others, so a passage of all documents sends one row from each piece.
The number of ranges follows the size of the texts.

Exactness.  Levels draw their hashes anew, and a run must repeat at each of them: at 10^13 runs
one is taken for another with a probability of 10^-6 at a level and of 10^-12 at two.

Defined results: null, empty and blank texts have no words; a text shorter than the window keeps
all; rows that repeat a text, ids equal or not, repeat each of its windows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.order import HOT
from plumbline.llm.text import WordHashes, batches_of, blank_words, kept, mix, shared_path, stored, utf8

WINDOW, LEAST, RANGE_BYTES, PIECE_BYTES = 35, 16, 64_000_000, 4_000_000
RUNS = "bucket int, keys binary, counts binary, places binary, hashes binary"
FOUND = "key binary, places binary, hashes binary"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def lengths(window: int = WINDOW, least: int = LEAST) -> list[int]:
    """window and its halves, rounded up, down to least; in growing order."""
    out = [window]
    while out[0] > 1 and -(-out[0] // 2) >= least:
        out.insert(0, -(-out[0] // 2))
    return out


def joined(a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Hashes of runs of `length` words from the hashes of their halves."""
    with np.errstate(over="ignore"):
        return mix(a * _ODD + b + np.uint64(length))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Of all runs of `length` words, by doubling."""
    out, k = words, 1
    while k < length:
        step = min(k, length - k)
        if len(out) <= step:
            return out[:0]
        out, k = joined(out[:-step], out[step:], k + step), k + step
    return out


def least_in(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    out, k = h, 1
    while k < width:
        step = min(k, width - k)
        out, k = np.minimum(out[:-step], out[step:]), k + step
    return out


def seeds(h: np.ndarray, width: int) -> np.ndarray:
    """Places of the hashes that are the least of some `width` neighbours."""
    if len(h) < width:
        return np.empty(0, dtype=np.int64)
    low = least_in(h, width)
    # A place is taken if it equals the least of one of the windows that hold it: the largest of those leasts.
    edge = np.zeros(width - 1, dtype=h.dtype)
    most = np.concatenate((edge, low, edge))
    k = 1
    while k < width:
        step = min(k, width - k)
        most, k = np.maximum(most[:-step], most[step:]), k + step
    return np.flatnonzero(most == h)


def pack(keys: list[bytes], texts: np.ndarray, places: np.ndarray, hashes: np.ndarray, buckets: int) -> pa.RecordBatch:
    """RUNS of one piece: of hashes that occur once in it, all; of others one in their range, and the places, as known, by text.

    Known places are in rows with a negative range, -1 - range, which follows the text's key.
    """
    order = np.argsort(hashes, kind="stable")
    same = np.zeros(len(order) + 1, dtype=bool)
    same[1:-1] = hashes[order][1:] == hashes[order][:-1]
    again = np.zeros(len(order), dtype=bool)
    again[order] = same[:-1] | same[1:]
    tell = order[same[1:] & ~same[:-1]]  # the first of each repeated hash
    rows: list[tuple] = []

    def put(at: np.ndarray, bucket: np.ndarray) -> None:
        by = np.argsort(bucket, kind="stable")
        at, bucket = at[by], bucket[by]
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(bucket)) + 1):
            if len(part):
                t = texts[at[part]]
                first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
                counts = np.diff(np.concatenate((first, [len(t)]))).astype("<u4")
                rows.append((int(bucket[part[0]]), b"".join(keys[i] for i in t[first]), counts.tobytes(), places[at[part]].astype("<u4").tobytes(), hashes[at[part]].astype("<u8").tobytes()))

    spot = (hashes % np.uint64(buckets)).astype(np.int64)
    once = np.flatnonzero(~again)
    put(once, spot[once])
    known = np.flatnonzero(again)
    home = np.array([int.from_bytes(k[:4], "little") % buckets for k in keys], dtype=np.int64)
    put(known, -1 - home[texts[known]])
    for b in np.unique(spot[tell]):
        rows.append((int(b), b"", b"", b"", np.repeat(hashes[tell[spot[tell] == b]], 2).astype("<u8").tobytes()))
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), *[pa.binary()] * 4], strict=True)], names=["bucket", "keys", "counts", "places", "hashes"])


def repeated(runs: DataFrame, hashes: bool) -> DataFrame:
    """RUNS -> FOUND: the places of each text whose runs repeat, a row for each text and range, with their hashes if asked."""

    def judge(table: pa.Table) -> pa.Table:
        known = np.array(table.column("bucket").to_pylist()) < 0
        get = lambda c, t: [np.frombuffer(x, t) for x in table.column(c).to_pylist()]
        h, p, n = get("hashes", "<u8"), get("places", "<u4"), get("counts", "<u4")
        flat = np.concatenate([x for x, k in zip(h, known, strict=True) if not k] or [np.empty(0, "<u8")])
        _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
        twice, end, out = count[at] > 1, 0, []
        for i, blob in enumerate(table.column("keys").to_pylist()):
            size = len(h[i])
            hit = None
            if not known[i]:
                hit, end = twice[end : end + size], end + size
            start = 0
            for j, m in enumerate(n[i].tolist()):
                part = slice(start, start + m)
                mine, own, start = p[i][part], h[i][part], start + m
                if hit is not None:
                    mine, own = mine[hit[part]], own[hit[part]]
                if len(mine):
                    out.append((blob[16 * j : 16 * j + 16], mine.tobytes(), own.tobytes() if hashes else b""))
        columns = zip(*out, strict=True) if out else [[]] * 3
        return pa.table([pa.array(c, pa.binary()) for c in columns], names=["key", "places", "hashes"])

    home = F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket"))
    return runs.groupBy(home).applyInArrow(judge, FOUND)


def gathered(found: DataFrame) -> DataFrame:
    """A row for each text: lists of its places and hashes."""
    return found.groupBy("key").agg(F.collect_list("places").alias("places"), F.collect_list("hashes").alias("hashes"))


def _places(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<u4").astype(np.int64)


def _words(memory_of: str, text: bytes | None, seed: int) -> np.ndarray:
    return kept(memory_of, dict).setdefault(seed, WordHashes(seed))(blank_words(text))


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    yield from batches_of(batch, PIECE_BYTES)


def _visit(texts: DataFrame, make, buckets: int) -> DataFrame:
    """RUNS of texts: make(row of a piece as dict) -> places and hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _pieces(whole):
                keys = batch.column("key").to_pylist()
                rest = {c: batch.column(c).to_pylist() for c in batch.schema.names if c not in ("key", "text")}
                made = [make(t, {c: v[i] for c, v in rest.items()}) for i, t in enumerate(utf8(batch.column("text")))]
                sizes = [len(p) for p, _ in made]
                if sum(sizes):
                    yield pack(keys, np.repeat(np.arange(len(keys)), sizes), np.concatenate([p for p, _ in made]), np.concatenate([h for _, h in made]), buckets)

    return texts.mapInArrow(run, RUNS)


def _extend(found: DataFrame, half: int, length: int, buckets: int) -> DataFrame:
    """RUNS of `length` words whose halves, of `half` words, both repeat: from places and hashes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                keys, texts, places, hashes = batch.column("key").to_pylist(), [], [], []
                for i, (p, h) in enumerate(zip(batch.column("places").to_pylist(), batch.column("hashes").to_pylist(), strict=True)):
                    place = _places(p)
                    order = np.argsort(place)
                    place, own = place[order], np.frombuffer(b"".join(h), "<u8")[order]
                    other = np.searchsorted(place, place + (length - half))
                    fits = other < len(place)
                    fits[fits] = place[other[fits]] == place[fits] + (length - half)
                    texts.append(np.full(int(fits.sum()), i))
                    places.append(place[fits])
                    hashes.append(joined(own[fits], own[other[fits]], length))
                texts = np.concatenate(texts)
                if len(texts):
                    yield pack(keys, texts, np.concatenate(places), np.concatenate(hashes), buckets)

    return found.mapInArrow(run, RUNS)


def text_key() -> Column:
    return F.unhex(F.md5("text"))


class Texts:
    """Different texts (key, text, copies), written once and bucketed by key; how many ranges of hashes they need."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        each = docs.where("text is not null").select(text_key().alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
        name = f"texts_{uuid.uuid4().hex}"
        each.write.option("path", shared_path(spark, "texts")).option("compression", "zstd").bucketBy(n, "key").saveAsTable(name)
        self.table = spark.table(name)
        size = self.table.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
        self.buckets = max(8, -(-size // RANGE_BYTES))


def repeats(texts: Texts, window: int = WINDOW, least: int = LEAST, hashes: bool = False) -> DataFrame:
    """(key, places, hashes): the places of each text's windows that start anywhere else, but for copies of the text."""
    first, *more = lengths(window, least)
    top = more[0] if more else first

    def start(text: bytes | None, _: dict):
        h = run_hashes(_words("repeats", text, first), first)
        at = seeds(h, window - first + 1)
        return at, h[at]

    found = gathered(repeated(_visit(texts.table.select("key", "text"), start, texts.buckets), hashes=False))
    if not more:
        return found

    def second(text: bytes | None, row: dict):
        # Windows that hold a repeated seed; runs of this level that lie in one of them.
        h = run_hashes(_words("repeats", text, top), top)
        size, n = len(h), len(h) + top - window
        mark = np.zeros(size + 1, dtype=np.int32)
        place = _places(row["places"])
        np.add.at(mark, np.clip(place - (window - first), 0, max(n, 0)), 1)
        np.add.at(mark, np.clip(place + 1, 0, max(n, 0)), -1)
        held = np.cumsum(mark[:-1])[: max(n, 0)] > 0
        at = np.flatnonzero(held)
        if top < window:
            wide = np.zeros(size + 1, dtype=np.int32)
            np.add.at(wide, at, 1)
            np.add.at(wide, at + (window - top) + 1, -1)
            at = np.flatnonzero(np.cumsum(wide[:-1]) > 0)
        return at, h[at]

    visit = _visit(texts.table.select("key", "text").join(found.select("key", "places"), "key"), second, texts.buckets)
    found = gathered(repeated(visit, hashes=top < window or hashes))
    for half, length in zip(more, more[1:], strict=False):
        found = gathered(repeated(_extend(found, half, length, texts.buckets), hashes=length < window or hashes))
    return found


def longest(docs: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """(key, words): for each text with a repeated window, the longest of window, 2 * window, 4 * window ... at which one of its runs repeats.

    Copies of the text itself do not count.  Each level extends what the last one left, and the
    last is the one that nothing survives.
    """
    texts, size = Texts(docs), window
    found = stored(repeats(texts, window, least, hashes=True), "level")
    out = found.select("key", F.lit(size).alias("words"))
    while not found.isEmpty():
        found, size = stored(gathered(repeated(_extend(found, size, 2 * size, texts.buckets), hashes=True)), "level"), 2 * size
        out = out.unionByName(found.select("key", F.lit(size).alias("words")))
    return out.groupBy("key").agg(F.max("words").alias("words"))


def _judged(texts: Texts, found: DataFrame, window: int, text: bool) -> DataFrame:
    """(key, copies, n_words, n_removed, kept_sha256[, left]) of each text."""
    kinds = "key binary, copies long, n_words long, n_removed long, kept_sha256 string" + (", left string" if text else "")
    names = [x.split()[0] for x in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, copies, blobs in zip(utf8(batch.column("text")), batch.column("copies").to_pylist(), batch.column("places").to_pylist(), strict=True):
                words = blank_words(t)
                n = len(words)
                if n >= window and copies > 1:
                    left = []
                elif blobs:
                    at, mark = _places(blobs), np.zeros(n + 1, dtype=np.int32)
                    np.add.at(mark, at, 1)
                    np.add.at(mark, at + window, -1)
                    left = [words[i] for i in np.flatnonzero(np.cumsum(mark[:-1]) == 0)]
                else:
                    left = words
                kept_text = b" ".join(left)
                rows.append((n, n - len(left), hashlib.sha256(kept_text).hexdigest(), *([kept_text.decode()] if text else [])))
            columns = zip(*rows, strict=True) if rows else [[]] * (len(names) - 2)
            kinds_of = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("copies"), *(pa.array(c, k) for c, k in zip(columns, kinds_of, strict=False))], names=names)

    both = texts.table.join(found.select("key", "places"), "key", "left").select("key", "text", "copies", "places")
    return both.mapInArrow(run, kinds)


def _copied(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """rows (key, ...) with what is judged of their text.  Texts with more than 1 / HOT of all copies are fewer than HOT: broadcast."""
    judged = stored(judged, "judged")
    every = judged.agg(F.sum("copies").alias("__all"))
    hot = judged.crossJoin(F.broadcast(every)).where(F.col("copies") * HOT > F.col("__all")).drop("__all", "copies")
    few = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    first = rows.join(few, "key", "left").where("__hot").drop("__hot")
    rest = rows.join(F.broadcast(hot.select("key")), "key", "left_anti").join(judged.drop("copies"), "key", "left")
    return first.unionByName(rest)


def judge(docs: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, kept_sha256."""
    texts = Texts(docs)
    rows = docs.select("doc_id", text_key().alias("key"))
    out = _copied(rows, _judged(texts, repeats(texts, window, least), window, text=False))
    none = hashlib.sha256(b"").hexdigest()
    return out.select("doc_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", F.lit(none)).alias("kept_sha256"))


def without_repeats(docs: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """docs with repeated windows taken out of text, and n_chars following it; words that stay are joined by one space, texts without a repeat are not changed."""
    texts = Texts(docs)
    gone = _judged(texts, repeats(texts, window, least), window, text=True).where("n_removed > 0").select("key", "copies", F.col("left").alias("__left"))
    rows = docs.select(text_key().alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("all"))
    out = _copied(rows, gone)
    made = {"text": F.coalesce("__left", "all.text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("__left").isNotNull(), F.length("__left").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("all.n_chars"))
    return out.select([made.get(c, F.col("all").getField(c)).alias(c) for c in docs.columns])


def brute_force(texts: list[str | None], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """n_words, n_removed, kept_sha256 by a table of all windows; for tests."""
    words = [blank_words(t.encode()) if t else [] for t in texts]
    seen: dict[tuple, int] = {}
    for w in words:
        for i in range(len(w) - window + 1):
            run = tuple(w[i : i + window])
            seen[run] = seen.get(run, 0) + 1
    out = []
    for w in words:
        hit = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                hit[i : i + window] = [True] * window
        left = b" ".join(x for x, h in zip(w, hit, strict=True) if not h)
        out.append((len(w), sum(hit), hashlib.sha256(left).hexdigest()))
    return out
