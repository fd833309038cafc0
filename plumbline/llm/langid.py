"""Language by n-gram filters: one bit-sliced Bloom filter for all languages.

A filter has m slots, and a slot one bit for each language.  Every n-gram that a language's
sample has `least` times sets the language's bit in k slots; the AND of an n-gram's k slots is
the set of all languages that contain it.  A text's n-grams are looked up together, each
language's bits are counted, the count expected from false positives alone is taken off, and
the largest rest, in whole n-grams, wins.

The filter is learnt from counts over a bounded sample of labelled rows (about `language_rows`
of each language, by hash; all rows of a language with fewer) and is a broadcast of fixed size
(m bytes a group of eight languages; beyond `filter_bytes`, m is smaller, and more is taken off for false positives).
It is made by Spark, a piece for each run of slots, and read by the driver in one job.

Defined results: null texts and texts without a letter are `und` with score 0; a text none of
whose n-grams is known gets the most frequent language with score 1 / languages; ties go to
the language with more labelled rows, then to the first by name.  The score is the winner's part
of all languages' counts.  Rows without a language teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm.text import mix, utf8

SLOTS, PROBES, ORDERS, LANGUAGE_ROWS, LEAST = 1 << 22, 2, (3, 5), 5_000, 3
LANGUAGE_BYTES, FILTER_BYTES, PIECE = 40_000_000, 1 << 26, 1 << 16
#: Which of a byte's bits are set.
_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)
_LETTER = regex.compile(r"\p{L}")
#: Letters lower-cased, all that separates words to a blank; UTF-8 tails stay.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def grams(text: bytes, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """Hashes of all runs of bytes of the given lengths within lower-cased, blank-framed words."""
    plain = b" " + b" ".join(text.translate(_PLAIN).split()) + b" "
    b = np.frombuffer(plain, dtype=np.uint8).astype(np.uint64)
    out = []
    for n in orders:
        if len(b) < n:
            continue
        code = np.full(len(b) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            code = (code << np.uint64(8)) | b[i : len(b) - n + 1 + i]
        out.append(mix(code))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def slots(codes: np.ndarray, m: int, k: int) -> list[np.ndarray]:
    """k places of each hash: steps of one odd half from the other."""
    a, b = codes & np.uint64(0xFFFFFFFF), (codes >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(i) * b) % np.uint64(m)).astype(np.int64) for i in range(k)]


class Filter:
    """Of languages, the most frequent first."""

    def __init__(self, languages: list[str], m: int = SLOTS, k: int = PROBES):
        self.languages, self.m, self.k = languages, m, k
        self.bits = np.zeros((max(1, -(-len(languages) // 8)), m), dtype=np.uint8)
        self.false = np.zeros(len(languages))

    def add(self, language: int, codes: np.ndarray) -> None:
        for at in slots(codes, self.m, self.k):
            self.bits[language // 8, at] |= np.uint8(1 << language % 8)

    def close(self) -> "Filter":
        """Each language's rate of false positives: the share of its slots that are set, to the power k."""
        for i in range(len(self.languages)):
            self.false[i] = np.mean(self.bits[i // 8] >> (i % 8) & 1) ** self.k
        return self

    def counts(self, codes: np.ndarray) -> np.ndarray:
        """N-grams found for each language, less the expected false ones."""
        at, out = slots(codes, self.m, self.k), np.zeros(len(self.languages))
        for group in range(len(self.bits)):
            found = self.bits[group][at[0]]
            for more in at[1:]:
                found = found & self.bits[group][more]
            n = min(8, len(self.languages) - 8 * group)
            out[8 * group : 8 * group + n] = (np.bincount(found, minlength=256) @ _BITS)[:n]
        return np.maximum(0, (out - self.false * len(codes)) / (1 - self.false))

    def predict(self, text: bytes | None) -> tuple[str, float]:
        if not text or not self.languages or not _LETTER.search(text.decode()):
            return "und", 0.0
        got = np.rint(self.counts(grams(text)))
        if not got.sum():
            return self.languages[0], 1 / len(self.languages)
        best = int(np.argmax(got))
        return self.languages[best], float(got[best] / got.sum())


def fit(docs: DataFrame, language_rows: int = LANGUAGE_ROWS, least: int = LEAST, m: int = SLOTS, k: int = PROBES, language_bytes: int = LANGUAGE_BYTES, filter_bytes: int = FILTER_BYTES) -> Filter:
    """From docs (doc_id, text, lang): the n-grams that each language's sample, of about language_rows and at most about language_bytes, has `least` times."""
    rows = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).collect()
    sizes = {r["lang"]: r["n"] for r in found}
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    out = Filter(languages, min(m, max(PIECE, filter_bytes // max(1, -(-len(languages) // 8)))), k)
    if not languages:
        return out.close()
    most = {r["lang"]: int((1 << 30) * min(1.0, language_rows / r["n"], language_bytes / max(1, r["bytes"]))) for r in found}
    of = lambda values: F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("lang"))
    below = of(most)
    rows = rows.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1 << 30)) < below)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text")), strict=True):
                own = sums.setdefault(lang, [np.zeros(0, np.uint64), np.zeros(0, np.int64), []])
                own[2].append(grams(text))
                if sum(map(len, own[2])) > 2_000_000:
                    _merge(own)
        for lang, own in sums.items():
            _merge(own)
            for at in range(0, len(own[0]), 50_000):
                codes, n = own[0][at : at + 50_000], own[1][at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    each = rows.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    each = each.where(F.col("n") >= least).select(of({x: i for i, x in enumerate(languages)}).alias("language"), "code")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            language = np.tile(batch.column("language").to_numpy(), k)
            at = np.concatenate(slots(batch.column("code").to_numpy().view(np.uint64), out.m, k)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((language // 8).astype(np.int32)), pa.array(at), pa.array((1 << language % 8).astype(np.int32))], names=["part", "slot", "bits"])

    set_bits = each.mapInArrow(place, "part int, slot long, bits int").groupBy("part", "slot").agg(F.bit_or("bits").alias("bits"))

    def piece(key: tuple, table: pa.Table) -> pa.Table:
        part, n = (x.as_py() for x in key)
        bits = np.zeros(PIECE, dtype=np.uint8)
        bits[table.column("slot").to_numpy() - n * PIECE] = table.column("bits").to_numpy()
        return pa.table({"part": pa.array([part], pa.int32()), "n": pa.array([n], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})

    pieces = set_bits.withColumn("n", F.floor(F.col("slot") / PIECE)).groupBy("part", "n").applyInArrow(piece, "part int, n long, bits binary")
    for part, n, bits in pieces.toLocalIterator():  # at most filter_bytes, or m for eight languages
        own = out.bits[part, n * PIECE : (n + 1) * PIECE]
        own[:] = np.frombuffer(bits, dtype=np.uint8)[: len(own)]
    return out.close()


def _merge(own: list) -> None:
    codes, n = np.unique(np.concatenate(own[2]) if own[2] else np.zeros(0, np.uint64), return_counts=True)
    both = np.concatenate((own[0], codes))
    own[0], at = np.unique(both, return_inverse=True)
    own[1], own[2] = np.bincount(at, np.concatenate((own[1], n)), len(own[0])).astype(np.int64), []


def identify(docs: DataFrame, model: Filter) -> DataFrame:
    """docs with lang_pred and score; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            got = [model.predict(t) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double"))
