"""Shared helpers of the corpus operators: words as bytes, Arrow plumbing, shared storage.

Texts travel as UTF-8 bytes.  Every byte of a non-ASCII character is >= 0x80, so a
class that contains all non-ASCII characters can be split with byte operations alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.graphs import shared_folder

#: A-Z to a-z, and every ASCII byte that is no letter and no digit to a blank.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters; none for null."""
    return text.translate(ALNUM).split() if text else []


def blank_words(text: bytes | None) -> list[bytes]:
    """Runs without ASCII white space (0x20, 0x09-0x0D); none for null."""
    return text.split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share."""
    return shared_folder(spark, what)


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read back: cuts the lineage."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, most_bytes: int, seed: int, balanced: bool = False) -> DataFrame:
    """(doc_id, text, y) of about `rows` documents with a quality of 0 or 1 and about `most_bytes` of text at most.

    Rows are chosen by hash of the id, at one rate for all or, balanced, at a rate for each quality, that follows
    from counts and bytes of all labelled rows.  A document with several labels has the largest.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    sized = docs.select("doc_id", F.octet_length("text").cast("long").alias("size")).join(known, "doc_id")
    kinds = sized.groupBy(F.col("y") if balanced else F.lit(0).alias("y")).agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).collect()
    share, parts = F.lit(0.0), 2 if balanced else 1
    for r in kinds:
        rate = min(1.0, rows / parts / r["n"], most_bytes / parts / max(r["bytes"], 1))
        share = F.when(F.col("y") == r["y"], rate).otherwise(share) if balanced else F.lit(rate)
    part = sized.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30)).select("doc_id", "y").distinct()
    # About `rows` narrow rows, as only labels of documents are among them: the broadcast is bounded whatever the size of labels.
    return docs.select("doc_id", "text").join(F.broadcast(part), "doc_id").select("doc_id", "text", "y")


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_KEPT: dict = {}


def kept(name: str, make: Callable):
    """What a Python worker remembers between tasks: of one operator at a time, so that the next one starts with free memory."""
    if name not in _KEPT:
        _KEPT.clear()
        pa.default_memory_pool().release_unused()
        _KEPT[name] = make()
    return _KEPT[name]


class WordHashes:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, seed: int = 0, most: int = 250_000):
        self.seed, self.most, self.known = seed, most, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, seed, digest = self.known, self.seed, xxhash.xxh3_64_intdigest
        if len(known) > self.most:
            known.clear()
        out = []
        add = out.append
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = digest(w, seed)
            add(h)
        return np.array(out, dtype=np.uint64)


def ngram_hashes(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all windows of n word hashes; a shorter sequence is one window, none stay none."""
    if not len(h):
        return h
    n = min(n, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, (seed * 0x9E3779B97F4A7C15 + n) & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        for i in range(n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def batches_of(batch: pa.RecordBatch, most_bytes: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts together stay under most_bytes, or hold one row."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    if len(sizes) > start:
        yield batch.slice(start)
