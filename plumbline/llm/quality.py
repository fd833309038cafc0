"""Quality score: logistic regression on hashed word n-grams, trained by FTRL-proximal.

Features of a text are its words, word pairs, and triples of word shapes, hashed to
2^BITS places, with the square root of the relative frequency as value; a text is scored by
the sparse dot product with the weights.  The model is fitted on a bounded sample of
labelled rows (by hash of the id; about `sample_rows` with `sample_bytes` of text at most, which one task learns from); every row is scored, in place, with
the weights (4 bytes * 2^BITS) as a broadcast.

Defined results: null and empty texts have the bias alone and get a score from it; rows
without a label (null quality) teach nothing; without any label all scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text import kept, labelled_sample, mix, utf8

BITS, SAMPLE_ROWS, SAMPLE_BYTES, PASSES = 18, 8_000, 40_000_000, 3
#: Signs that are words of their own.
SIGNS = b"#*$%&|<>!?=+~^@{}[]\\"
_SPLIT = [(bytes([c]), b" " + bytes([c]) + b" ") for c in SIGNS]


def _shape(w: bytes) -> int:
    c = w[0]
    if len(w) == 1 and c in SIGNS:
        return 8 + SIGNS.index(c)
    core = w.rstrip(b".,;:)\"'")
    if not core:
        return 1
    text = core.decode(errors="replace")
    if any(x.isdigit() for x in text):
        return 2
    if text.isupper():
        return 3 if len(text) > 1 else 4
    end = w[-1:] in (b".", b",")
    return (5 if text[:1].isupper() else 6) + (20 + 20 * (w[-1:] == b".")) * end


class Words:
    """Hash and shape of each word, remembered up to a bound."""

    def __init__(self, most: int = 200_000):
        self.most, self.place, self.hash, self.shape = most, {}, [], []

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.place) > self.most:
            self.place, self.hash, self.shape = {}, [], []
        place, h, s = self.place, self.hash, self.shape
        hashes, shapes = [], []
        for w in words:
            i = place.get(w)
            if i is None:
                i = place[w] = len(h)
                h.append(xxhash.xxh3_64_intdigest(w, 11))
                s.append(_shape(w))
            hashes.append(h[i])
            shapes.append(s[i])
        return np.array(hashes, dtype=np.uint64), np.array(shapes, dtype=np.uint64)


def features(text: bytes | None, words: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text; place 0 is the bias."""
    for sign, apart in _SPLIT if text else ():
        if sign in text:
            text = text.replace(sign, apart)
    tokens = text.split() if text else []
    if not tokens:
        return np.zeros(1, np.int64), np.ones(1)
    h, s = words(tokens)
    again = np.concatenate(([False], h[1:] == h[:-1]))  # a word said again at once is one word to all texts
    h, s = np.where(again, np.uint64(7), h), np.where(again, np.uint64(99), s)
    with np.errstate(over="ignore"):
        kinds = [(0.5, mix(h + np.uint64(1)))]
        if len(h) > 1:
            kinds.append((0.5, mix(h[1:] * np.uint64(3) + h[:-1] * np.uint64(0x9E3779B97F4A7C15))))
        kinds.append((1, mix(s + np.uint64(0x51ED27))))
        if len(h) > 2:
            kinds.append((1, mix((s[2:] * np.uint64(1009) + s[1:-1]) * np.uint64(1009) + s[:-2] + np.uint64(0xABCDEF))))
    places, values = [np.zeros(1, np.int64)], [np.ones(1)]
    for weight, kind in kinds:
        at, n = np.unique((kind >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
        places.append(np.maximum(at, 1))
        values.append(weight * np.sqrt(n / n.sum()))
    return np.concatenate(places), np.concatenate(values)


class FTRL:
    """Follow-the-regularised-leader-proximal, a coordinate with its own rate."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (sigmoid(w @ x) - y) * x
        rate = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        np.add.at(self.z, at, g - rate * w)
        np.add.at(self.n, at, g * g)


def sigmoid(v: float | np.ndarray) -> float | np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, passes: int = PASSES, bits: int = BITS) -> np.ndarray:
    """Weights, from docs (doc_id, text) and labels (doc_id, quality); the same sample gives the same weights."""
    texts = labelled_sample(docs, labels, sample_rows, sample_bytes, 5)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept("quality", Words)
        for batch in batches:
            got = [features(t, words, bits) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("y"), pa.array([a.astype(np.int32) for a, _ in got], pa.list_(pa.int32())),
                    pa.array([x.astype(np.float32) for _, x in got], pa.list_(pa.float32())),
                ], names=["doc_id", "y", "at", "x"],
            )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("quality", Words)  # what an earlier operator left goes before the sample comes
        rows = [(a.values.to_numpy(), x.values.to_numpy(), y.as_py()) for b in batches for a, x, y in zip(b.column("at"), b.column("x"), b.column("y"), strict=True)]
        model = FTRL(1 << bits)
        rng = np.random.Generator(np.random.PCG64(1))
        for _ in range(passes):
            for i in rng.permutation(len(rows)):
                at, x, y = rows[i]
                model.learn(at.astype(np.int64), x.astype(np.float64), y)
        w = model.weights()
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at].astype(np.float32))], names=["at", "w"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = texts.mapInArrow(numbers, f"doc_id {kind}, y int, at array<int>, x array<float>")
    found = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").mapInArrow(train, "at int, w float").toArrow()
    out = np.zeros(1 << bits, dtype=np.float32)
    out[found.column("at").to_numpy()] = found.column("w").to_numpy()
    return out


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """docs with a last column score; a column of that name is replaced."""
    docs = docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, w = kept("quality", Words), sent.value
        for batch in batches:
            scores = [float(sigmoid(w[at] @ x)) for at, x in (features(t, words, bits) for t in utf8(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, _with(docs, "score", "double"))


def _with(docs: DataFrame, name: str, kind: str):
    from pyspark.sql.types import StructType

    return StructType([*docs.schema.fields]).add(name, kind)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, **settings) -> DataFrame:
    """docs whose score is at least `least`."""
    weights = fit(docs, labels, **settings)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    out = score(docs.select("text", whole), weights).where(F.col("score") >= least)
    return out.select([F.col("row").getField(c).alias(c) for c in docs.columns])
