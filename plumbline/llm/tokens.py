"""Token ids of whole texts by a public tokenizer file.

A file whose pre-tokenizer is the byte-level one with its pattern cuts a text where the kind of its
characters changes.  For texts of Latin letters, ASCII digits, marks and white space these places
follow from the bytes alone, so they are found for a whole batch at once; each different run
is encoded by the library's model and remembered, the more often used ones longest, and the ids of a text are its runs' ids in order:
the same ids as from one call with the whole text.  A stretch between blanks that holds anything else
(apostrophes, control characters, other scripts) is encoded by the library as it stands and
remembered, too.  Texts for which these boundaries might not hold (other white space
before a blank, a special token spelt out), and all texts of other files, are encoded whole.
"""

from __future__ import annotations

import json
import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from plumbline.llm.text import kept


#: Runs that an encoder remembers: some 200 MB.
PIECES = 1_200_000


def encoder(name: str = "byte_bpe_50k.json", folder: str | None = None, most_pieces: int = PIECES) -> "Encoder":
    """The encoder of a file, whose memory of pieces lasts over a Python worker's tasks."""

    def make() -> Encoder:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if folder is not None:
            return Encoder(os.path.join(folder, name), most_pieces)
        import public_tokenizers

        return Encoder(public_tokenizers.path(name), most_pieces)

    return kept(f"tokens {folder} {name} {most_pieces}", make)


#: A byte's kind: all from FEED on are white space; what is ODD, or in an odd stretch, is left to the library.
ODD, LETTER, DIGIT, MARK, FEED, BLANK = range(6)
KINDS = np.full(256, ODD, dtype=np.uint8)
KINDS[33:127] = MARK
KINDS[ord("'")] = ODD  # may begin a contraction
KINDS[48:58] = DIGIT
# Of U+00C0 to U+017F all but U+00D7 and U+00F7 are letters; a lead byte's kind counts, not those of the bytes after it.
KINDS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = LETTER
KINDS[9:14], KINDS[32] = FEED, BLANK

#: The character that stands for a byte in the vocabulary.
_SHOWN = np.zeros(256, dtype=bool)
_SHOWN[33:127] = _SHOWN[161:173] = _SHOWN[174:] = True
BYTE_CHARS = np.arange(256, dtype="<u4")
BYTE_CHARS[~_SHOWN] = 256 + np.arange((~_SHOWN).sum())


def runs_of(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs begin in the texts raw[bounds[i] : bounds[i + 1]], and which of them are odd stretches."""
    size = len(raw)
    kinds = KINDS[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    kinds[lead[(raw[lead + 1] == 0x97) | (raw[lead + 1] == 0xB7)]] = ODD
    first = np.zeros(size + 1, dtype=bool)
    first[bounds] = first[size] = True
    white, blank = kinds >= FEED, kinds == BLANK
    after = np.zeros(size, dtype=bool)  # the byte before is white space of the same text
    after[1:] = white[:-1]
    after &= ~first[:-1]
    # Of white space before anything else, the last character stands apart; a blank joins what follows.
    last = np.ones(size, dtype=bool)
    last[:-1] = ~white[1:]
    last &= ~first[1:]
    cut = first[:-1] | white & (~after | last)
    cut[1:] |= ~white[1:] & (kinds[1:] != kinds[:-1]) & ~blank[:-1]
    odd = np.flatnonzero(kinds == ODD)
    if not len(odd):
        begins = np.flatnonzero(cut)
        return begins, np.zeros(len(begins), dtype=bool)
    stretch = first[:-1] | blank & ~after
    edges = np.append(np.flatnonzero(stretch), size)
    bad = np.unique(np.searchsorted(edges, odd, side="right")) - 1
    turns = np.zeros(size + 1, dtype=np.int8)
    turns[edges[bad]] += 1
    turns[edges[bad + 1]] -= 1
    inside = np.cumsum(turns[:-1], dtype=np.int8) > 0
    begins = np.flatnonzero(cut & ~inside | stretch)
    return begins, inside[begins]


class Encoder:
    def __init__(self, path: str, most_pieces: int = PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(str(path))
        made = json.loads(self.tokenizer.to_str())
        cutter = made["pre_tokenizer"] or {}
        bare = made["model"]["type"] == "BPE" and not any(made[k] for k in ("normalizer", "truncation", "padding"))
        self.by_runs = bare and cutter.get("type") == "ByteLevel" and cutter["use_regex"] and not cutter["add_prefix_space"]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.id_bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for piece, i in vocabulary.items():
            self.id_bytes[i] = len(piece)  # a character of the vocabulary stands for a byte
        self.most_pieces = most_pieces
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 20, dtype=np.int32)
        self.used = self.pieces = 0
        self.starts, self.sizes, self.uses = np.zeros(1 << 18, dtype=np.int64), np.zeros(1 << 18, dtype=np.int32), np.zeros(1 << 18, dtype=np.int32)

    def _forget(self) -> None:
        """Keep runs that more than one batch had, those of the most batches, up to half of the bound; forget all others."""
        uses = self.uses[: self.pieces]
        stay = np.flatnonzero(uses > 1)
        if len(stay) > self.most_pieces // 2:
            stay = np.sort(stay[np.argsort(-uses[stay], kind="stable")[: self.most_pieces // 2]])
        keys = [key for key, i in self.place.items() if i >= 0]  # in order of their numbers
        keys, sizes, uses = [keys[i] for i in stay.tolist()], self.sizes[stay].astype(np.int64), uses[stay] // 2
        ids = self.flat[ragged(self.starts[stay], sizes)]
        self._clear()
        self._store(keys, ids, sizes)
        self.uses[: len(uses)] = uses

    def _store(self, keys: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember the ids of new runs, which stand in ids one after another."""
        n, k = self.pieces, len(keys)
        while n + k > len(self.starts):
            self.starts, self.sizes, self.uses = (np.resize(x, 2 * len(x)) for x in (self.starts, self.sizes, self.uses))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[n : n + k], self.sizes[n : n + k] = self.used + np.cumsum(sizes) - sizes, sizes
        self.uses[n : n + k] = 0
        self.used += len(ids)
        self.pieces += k
        self.place.update(zip(keys, range(n, n + k), strict=True))

    def _learn_runs(self, runs: list[bytes]) -> None:
        """Encode new runs, none of which the pre-tokenizer would cut, by the model alone."""
        ends = np.cumsum([len(r) for r in runs]).tolist()
        text = BYTE_CHARS[np.frombuffer(b"".join(runs), np.uint8)].tobytes().decode("utf-32-le")
        model, ids, sizes, begin = self.tokenizer.model.tokenize, [], [], 0
        for end in ends:
            got = [t.id for t in model(text[begin:end])]
            ids += got
            sizes.append(len(got))
            begin = end
        self._store(runs, np.array(ids, dtype=np.int32), np.array(sizes, dtype=np.int64))

    def _learn_stretches(self, stretches: list[bytes]) -> None:
        """Encode new odd stretches: those from a blank on many together, their ids split by their byte lengths."""
        inner, alone = [], []
        for key in stretches:
            w = key.decode()
            if w[-1].isspace() and w[-1] not in " \t\n\v\f\r":
                self.place[key] = -1  # what follows may be white space, too
            elif w[0] != " " or w[-1].isspace():
                alone.append((key, w))  # a text's first or last
            else:
                inner.append((key, w))
        groups = [inner[i : i + 2000] for i in range(0, len(inner), 2000)] + [[x] for x in alone]
        for at in range(0, len(groups), 64):
            part = groups[at : at + 64]
            for group, got in zip(part, self.tokenizer.encode_batch_fast(["".join(w for _, w in g) for g in part], add_special_tokens=False), strict=True):
                ids = np.array(got.ids, dtype=np.int32)
                ends = np.searchsorted(np.cumsum(self.id_bytes[ids]), np.cumsum([len(key) for key, _ in group]), side="left") + 1
                self._store([key for key, _ in group], ids, np.diff(ends, prepend=0))

    def encode(self, texts: pa.Array, end: int | None = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and each text's number of ids; end is appended to each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = np.full(len(texts), not self.by_runs)
        for token in self.special:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        known = texts if not whole.any() else pc.if_else(pa.array(whole), "", texts)
        flat, n_ids, unsure = self._encode_runs(known)
        whole |= unsure
        if whole.any():
            slow = np.flatnonzero(whole)
            got = [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(texts.take(pa.array(slow)).to_pylist(), add_special_tokens=False)]
            parts = np.split(flat, np.cumsum(n_ids)[:-1])
            for i, ids in zip(slow.tolist(), got, strict=True):
                parts[i], n_ids[i] = ids, len(ids)
            flat = np.concatenate(parts)
        if end is not None:
            out = np.full(len(flat) + len(n_ids), end, dtype=np.int32)
            out[np.arange(len(flat)) + np.repeat(np.arange(len(n_ids)), n_ids)] = flat
            flat, n_ids = out, n_ids + 1
        return flat, n_ids

    def _known(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word, and which words are new."""
        at = np.fromiter(map(self.place.get, words, repeat(-2)), dtype=np.int64, count=len(words))
        return at, np.flatnonzero(at == -2)

    def _encode_runs(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, each text's number of ids, and which texts the runs do not tell them of."""
        count, none = len(texts), np.zeros(len(texts), dtype=bool)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + count + 1] if count else np.zeros(1, np.int64)
        if offsets[-1] == offsets[0]:
            return np.zeros(0, np.int32), np.zeros(count, np.int64), none
        raw, bounds = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
        begins, odd = runs_of(raw, bounds)
        runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(np.append(begins, len(raw))), pa.py_buffer(raw)])
        coded = runs.dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False)
        at, new = self._known(words)
        if len(self.place) + len(new) > self.most_pieces:
            self._forget()
            at, new = self._known(words)
        place = self.place
        if len(new):
            strange = np.zeros(len(words), dtype=bool)
            strange[codes[odd]] = True
            self._learn_runs([words[i] for i in new[~strange[new]].tolist()])
            self._learn_stretches([words[i] for i in new[strange[new]].tolist()])
            at[new] = [place[words[i]] for i in new.tolist()]
        self.uses[at[at >= 0]] += 1  # words are different, and so are their numbers
        at = at[codes]
        sizes = np.where(at < 0, 0, self.sizes[at]).astype(np.int64)
        flat = self.flat[ragged(self.starts[at], sizes)]
        edges = np.searchsorted(begins, bounds)
        n_ids = np.diff(np.concatenate(([0], np.cumsum(sizes)))[edges])
        unsure = np.diff(np.concatenate(([0], np.cumsum(at < 0)))[edges]) > 0
        return flat, n_ids, unsure


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices starts[i] ... starts[i] + sizes[i] - 1, for each i in order."""
    total = int(sizes.sum())
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else starts, sizes)
