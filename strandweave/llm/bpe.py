"""Byte-level BPE over whole corpora, merged in batches with numpy.

A task splits its texts into words, keeps the distinct new ones and merges all of these at once: the
symbols of many words lie in one flat array, and each round looks up every adjacent pair by binary search
over the sorted pair keys and merges, in each word, its pair of lowest rank.  Words met before are taken
from the task's table of encoded words.  A word of many bytes has many rounds; it keeps its pairs sorted by rank,
so that a round touches only what it merges.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed value: the pattern that splits text into words for this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words that a task keeps encoded before it begins anew.
WORDS = 1 << 20
#: Words of more bytes are merged by themselves.
LONG = 1 << 10
#: Rank of a pair that is never merged.
NONE = np.iinfo(np.int64).max


def default_path() -> str:
    """The file of ``byte_bpe_50k`` where the public vocabularies are installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files write bytes: printable ones as themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The vocabulary as arrays: ids of the 256 bytes, sorted pair keys, and each pair's rank and result."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte = np.zeros(256, np.int64)
        for letter, b in byte_letters().items():
            self.byte[b] = vocab[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of ids of each."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if not long:
            return self._encode(words)
        ids, size = self._encode([w if len(w) <= LONG else b"" for w in words])
        at = np.cumsum(size)
        out, done = [], 0
        for i in long:
            one = self._encode_long(words[i])
            out += [ids[done : at[i]], one]
            done, size[i] = at[i], len(one)
        return np.concatenate([*out, ids[done:]]), size

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each pair stands among the sorted keys, and its rank (NONE if it is no pair of the vocabulary)."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, np.where(self.keys[at] == key, self.rank[at], NONE)

    def _encode_long(self, word: bytes) -> np.ndarray:
        """Ids of one word; its pairs lie in heaps of positions by rank, and merged symbols are unlinked."""
        sym = self.byte[np.frombuffer(word, np.uint8)]
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        made, rank = np.full(n, -1), np.full(n, NONE)  # of the pair that begins here
        waiting: dict[int, list[np.ndarray]] = {}
        order: list[int] = []

        def put(i: np.ndarray) -> None:
            """Ranks the pairs that begin at ``i`` anew."""
            made[i], rank[i] = self._ranked(sym[i], sym[after[i]])
            i = i[rank[i] < NONE]
            i = i[np.argsort(rank[i], kind="stable")]
            ranks, first = np.unique(rank[i], return_index=True)
            for r, some in zip(ranks.tolist(), np.split(i, first[1:]), strict=True) if len(i) else ():
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(order, r)
                waiting[r].append(some)

        put(np.arange(n - 1))
        while order:
            r = heapq.heappop(order)
            i = np.unique(np.concatenate(waiting.pop(r)))
            i = i[rank[i] == r]
            if not len(i):
                continue
            run = np.append(True, after[i[:-1]] != i[1:])  # of pairs that overlap (a a a), every other one
            i = i[(np.arange(len(i)) - np.maximum.accumulate(np.where(run, np.arange(len(i)), 0))) % 2 == 0]
            gone = after[i]
            sym[i], rank[gone], after[i] = self.made[made[i]], NONE, after[gone]
            sym[gone] = -1
            inner = after[i] < n
            before[after[i][inner]] = i[inner]
            rank[i[~inner]] = NONE
            put(np.unique(np.concatenate([i[inner], before[i][before[i] >= 0]])))
        return sym[sym >= 0]

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        sym = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(n), sizes)
        done_sym, done_word = [], []
        while len(sym):
            rank = self._ranked(sym[:-1], sym[1:])[1]
            rank = np.append(np.where(word[:-1] == word[1:], rank, NONE), NONE)
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(start, len(sym)))
            low = np.repeat(np.minimum.reduceat(rank, start), size)
            ready = low == NONE
            if ready.any():
                done_sym.append(sym[ready])
                done_word.append(word[ready])
            hit = (rank == low) & ~ready
            i = np.flatnonzero(hit)
            if len(i):  # of pairs that overlap (a a a), every other one
                run = np.append(True, np.diff(i) != 1)
                i = i[(np.arange(len(i)) - np.maximum.accumulate(np.where(run, np.arange(len(i)), 0))) % 2 == 0]
                sym[i] = self.made[self._ranked(sym[i], sym[i + 1])[0]]
                ready[i + 1] = True
            sym, word = sym[~ready], word[~ready]
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=n)


class Encoder:
    """Encodes columns of texts and keeps the words it has met."""

    def __init__(self, merges: Merges, pattern: str = PATTERN):
        self.merges, self.split = merges, regex.compile(pattern).findall
        self.reset()

    def reset(self) -> None:
        self.code: dict[str, int] = {}
        self.ids, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all words of all texts, one after the other, and the number of words of each text."""
        if len(self.code) > WORDS:
            self.reset()
        split = [self.split(t) if t else () for t in texts]
        count = np.fromiter(map(len, split), np.int64, len(split))
        flat = list(chain.from_iterable(split))
        new = list(set(flat).difference(self.code))
        if new:
            ids, size = self.merges.encode([w.encode("utf-8", "surrogatepass") for w in new])
            self.code.update(zip(new, range(len(self.code), len(self.code) + len(new)), strict=True))
            first = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.start, self.size = np.concatenate([self.start, first]), np.concatenate([self.size, size])
        return np.fromiter(map(self.code.__getitem__, flat), np.int64, len(flat)), count

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        code, count = self.words(texts)
        return np.diff(np.concatenate([[0], np.cumsum(self.size[code])])[np.concatenate([[0], np.cumsum(count)])])

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text; none for an empty text or a null."""
        code, count = self.words(texts)
        size = self.size[code]
        ends = np.cumsum(size)
        off = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])]
        ids = self.ids[np.repeat(self.start[code] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))


#: Characters of text that a task encodes at a time.
CHARS = 1 << 22


def _slices(b: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about CHARS bytes of text, so that long texts don't add up in memory."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(size) // CHARS
    cut = [0, *(np.flatnonzero(np.diff(piece)) + 1), b.num_rows]
    for i, j in zip(cut, cut[1:], strict=False):
        if j > i:
            yield b.slice(i, j - i)


def token_ids(df: DataFrame, key: str, text: str, path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """``(key, ids)``: the ids of every text, without special tokens.

    An empty text and a null one have the empty list; strings that look like special tokens are ordinary
    text; texts of any length are encoded whole; repeated rows are kept; only the two named columns are
    read.  The vocabulary file is read once and broadcast; its size is fixed.
    """
    merges = df.sparkSession.sparkContext.broadcast(Merges(path or default_path()))
    rows = df.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(merges.value, pattern)
        for b in batches:
            for x in _slices(b, 1):
                yield pa.RecordBatch.from_arrays([x.column(0), enc.encode(x.column(1).to_pylist())], names=[key, "ids"])

    return rows.mapInArrow(run, T.StructType([rows.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def token_sizes(df: DataFrame, key: str, text: str, path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """``(key, tokens)``: the number of ids that :func:`token_ids` gives; 0 for empty and null texts."""
    merges = df.sparkSession.sparkContext.broadcast(Merges(path or default_path()))
    rows = df.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(merges.value, pattern)
        for b in batches:
            for x in _slices(b, 1):
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array(enc.lengths(x.column(1).to_pylist()), pa.int64())], names=[key, "tokens"])

    return rows.mapInArrow(run, T.StructType([rows.schema[key], T.StructField("tokens", T.LongType())]))
