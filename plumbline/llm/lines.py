"""Quality rules by line labels: a linear-chain conditional random field over a text's lines.

Each line with a word gets binary features (signs, capitals, repetition, length, digits,
ends); the field has weights for (label, feature) and (label, next label), fitted by
stochastic gradient on a bounded sample of documents whose quality is known.  Lines of bad
documents are boilerplate; lines of good ones are content, but for those that repeat an
earlier line.  Every second good document is learnt with a run of lines of a bad one
put in at a random place, so that the field learns where labels change.  Viterbi decoding marks each line as content or
boilerplate; a text is kept if the content lines hold at least `least_share` of its words.

Base figures are counted beside it on whole texts.  Defined results: null and empty texts
have zero everywhere, fail the base rule and are not kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm.text import WordHashes, kept, labelled_sample, ngram_hashes, utf8

SAMPLE_ROWS, SAMPLE_BYTES, PASSES, LEAST_SHARE = 4_000, 20_000_000, 4, 0.5
SIGNS = b"#*$%&|<>"
#: Blanks and the tails of UTF-8 characters: without them, a byte is a character of a word.
_NOT_COUNTED = bytes([32, *range(9, 14), *range(0x80, 0xC0)])
_DIGITS, _UPPER, _ENDS = b"0123456789", bytes(range(65, 91)), (b".", b"!", b"?", b":", b'"')
N_FEATURES, SEEN = 16, 12


def line_features(line: bytes, n: int, words: list[bytes], seen: bool) -> list[int]:
    """The features that hold for a line of n words."""
    size = len(line)
    signs = size - len(line.translate(None, SIGNS))
    upper, digits = size - len(line.translate(None, _UPPER)), size - len(line.translate(None, _DIGITS))
    out = [0]
    if signs:
        out.append(1)
    if 10 * signs >= n:
        out.append(2)
    if 2 * signs >= n:
        out.append(3)
    if 3 * upper > size:
        out.append(4)
    if 5 * digits > size:
        out.append(5)
    if line.count(b"!") * 4 > n:
        out.append(6)
    if n < 4:
        out.append(7)
    elif n > 30:
        out.append(8)
    different = len(set(words))
    if n >= 6 and 2 * different <= n:
        out.append(9)
    if n >= 6 and 4 * different <= n:
        out.append(10)
    if sum(a == b for a, b in zip(words, words[1:], strict=False)) * 4 > n:
        out.append(11)
    if seen:
        out.append(SEEN)
    if line.endswith(_ENDS):
        out.append(13)
    if b"|" in line:
        out.append(14)
    if size > 25 * n:
        out.append(15)
    return out


def describe(text: bytes | None) -> tuple[list[list[int]], list[int], int]:
    """Features and words of each line with a word, and how many lines equal an earlier one."""
    found, sizes, seen, again = [], [], set(), 0
    for line in (text or b"").split(b"\n"):
        words = line.split()
        if words:
            line_seen = line in seen
            again += line_seen
            seen.add(line)
            found.append(line_features(line.strip(), len(words), words, line_seen))
            sizes.append(len(words))
    return found, sizes, again


class Field:
    """Two labels, 0 boilerplate and 1 content; scores are content against boilerplate."""

    def __init__(self, state: np.ndarray | None = None, step: np.ndarray | None = None):
        self.state = np.zeros((2, N_FEATURES)) if state is None else state
        self.step = np.zeros((2, 2)) if step is None else step

    def emissions(self, lines: list[list[int]]) -> np.ndarray:
        return np.array([self.state[:, f].sum(axis=1) for f in lines])

    def viterbi(self, lines: list[list[int]]) -> list[int]:
        """The labels with the largest score; ties go to content."""
        if not lines:
            return []
        s0, s1 = self.state.tolist()
        (t00, t01), (t10, t11) = self.step.tolist()
        back, a0, a1 = [], 0.0, 0.0
        for i, f in enumerate(lines):
            e0, e1 = sum(s0[j] for j in f), sum(s1[j] for j in f)
            if i:
                stay0, stay1 = a0 + t00 > a1 + t10, a0 + t01 > a1 + t11
                back.append((0 if stay0 else 1, 0 if stay1 else 1))
                a0, a1 = (a0 + t00 if stay0 else a1 + t10) + e0, (a0 + t01 if stay1 else a1 + t11) + e1
            else:
                a0, a1 = e0, e1
        out = [0 if a0 > a1 else 1]
        for b in reversed(back):
            out.append(b[out[-1]])
        return out[::-1]

    def learn(self, lines: list[list[int]], labels: list[int], rate: float) -> None:
        """A gradient step on the log likelihood of one text's labels: observed less expected counts."""
        e = self.emissions(lines)
        n = len(e)
        fore, after = np.empty((n, 2)), np.zeros((n, 2))
        fore[0] = e[0]
        for i in range(1, n):
            fore[i] = e[i] + np.logaddexp.reduce(fore[i - 1][:, None] + self.step, axis=0)
        for i in range(n - 2, -1, -1):
            after[i] = np.logaddexp.reduce(self.step + e[i + 1] + after[i + 1], axis=1)
        z = np.logaddexp.reduce(fore[-1])
        p = np.exp(fore + after - z)
        change = np.zeros((2, 2))
        for i in range(1, n):
            change -= np.exp(fore[i - 1][:, None] + self.step + e[i] + after[i] - z)
            change[labels[i - 1], labels[i]] += 1
        rate /= n
        for i, (f, y) in enumerate(zip(lines, labels, strict=True)):
            self.state[:, f] -= rate * p[i][:, None]
            self.state[y, f] += rate
        self.step += rate * change


def line_labels(lines: list[list[int]], y: int) -> list[int]:
    """Of a document of quality y: all lines of a bad one are boilerplate, and repeated ones of a good one."""
    return [int(y and SEEN not in f) for f in lines]


def mixed(good: list[list[int]], bad: list[list[int]], rng: np.random.Generator) -> tuple[list[list[int]], list[int]]:
    """A good text with a run of lines of a bad one, and its labels."""
    at, first = int(rng.integers(len(good) + 1)), int(rng.integers(len(bad)))
    run = bad[first : first + 1 + int(rng.integers(max(1, len(good))))]
    own = line_labels(good, 1)
    return [*good[:at], *run, *good[at:]], [*own[:at], *[0] * len(run), *own[at:]]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, passes: int = PASSES) -> Field:
    """From docs (doc_id, text) and labels (doc_id, quality), about as many documents of either quality.

    One task learns from about `sample_rows` documents with `sample_bytes` of text at most.  Without any, all weights are 0 and every line is content.
    """
    texts = labelled_sample(docs, labels, sample_rows, sample_bytes, 9, balanced=True)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(describe(t)[0], y) for b in batches for t, y in zip(utf8(b.column("text")), b.column("y").to_pylist(), strict=True)]
        field, rng, k = Field(), np.random.Generator(np.random.PCG64(2)), 0
        rows = [x for x in rows if x[0]]
        bad = [lines for lines, y in rows if not y]
        for _ in range(passes):
            for i in rng.permutation(len(rows)):
                k += 1
                lines, y = rows[i]
                if y and bad and rng.random() < 0.5:
                    lines, labels = mixed(lines, bad[int(rng.integers(len(bad)))], rng)
                else:
                    labels = line_labels(lines, y)
                field.learn(lines, labels, 0.5 / (1 + k / 4000))
        yield pa.RecordBatch.from_arrays([pa.array([[*field.state.ravel(), *field.step.ravel()]], pa.list_(pa.float64()))], names=["w"])

    rows = texts.select("doc_id", "text", "y").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    made = rows.select("text", "y").mapInArrow(train, "w array<double>").first()
    if made is None:  # a table without rows has no partition, and no task that learns
        return Field()
    w = np.array(made[0])
    return Field(w[: 2 * N_FEATURES].reshape(2, -1), w[2 * N_FEATURES :].reshape(2, 2))


def repeated_words(h: np.ndarray) -> int:
    """Words that lie in a run of three words which occurs twice or more."""
    if len(h) < 4:
        return 0
    runs = ngram_hashes(h, 3)
    order = np.argsort(runs)
    same = runs[order][1:] == runs[order][:-1]
    twice = np.zeros(len(runs), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(h), dtype=bool)
    for i in range(3):
        hit[i : i + len(runs)] |= twice
    return int(hit.sum())


def judge(docs: DataFrame, field: Field, least_share: float = LEAST_SHARE) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept; columns of these names are replaced."""
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    state, step = field.state, field.step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, hashes = Field(state, step), kept("lines", WordHashes)
        for batch in batches:
            counts, shares = [], []
            for text in utf8(batch.column("text")):
                text = text or b""
                h = hashes(text.split())
                lines, sizes, again = describe(text)
                content = sum(n for n, y in zip(sizes, field.viterbi(lines), strict=True) if y)
                shares.append(content / len(h) if len(h) else 0.0)
                counts.append((len(h), len(text.translate(None, _NOT_COUNTED)), len(text) - len(text.translate(None, SIGNS)), again, repeated_words(h)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array([c[i] for c in counts], pa.int64()) for i in range(5)), pa.array(shares, pa.float64())], names=[*batch.schema.names, *names, "content_share"]
            )

    schema = StructType([*docs.schema.fields])
    for name in names:
        schema = schema.add(name, "long")
    out = docs.mapInArrow(run, schema.add("content_share", "double"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("content_share") >= least_share))


def base_brute_force(text: str | None) -> tuple[int, int, int, int, int]:
    """The five base figures, word by word; for tests."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {k for k, n in Counter(runs).items() if n > 1}
    hit = {i + j for i, r in enumerate(runs) if r in twice for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)
