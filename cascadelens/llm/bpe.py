"""Problem 8: encoding of all documents with a public byte-level BPE vocabulary, in numpy.

The distinct words of a batch are put into matrices by length, one word a row and one byte a column,
padded on the right. Each round every row merges its leftmost pair of least rank; ranks of pairs are
looked up in an open-addressing hash table, and only the two pairs beside a merge are looked up anew.
Rows without a pair left are taken out of the matrix.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cascadelens.session import spread

#: Where the vocabulary lies on every machine; it is a parameter of each operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text into words before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of more bytes are merged with a heap, whose work grows as n log n and not as n squared.
LONG = 512
#: Words remembered between the batches of a task.
REMEMBERED = 200_000
_NONE = np.int64(1 << 40)


class Vocabulary:
    """Ranks of a byte-level BPE vocabulary and the hash table of its mergeable pairs."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.words = regex.compile(PATTERN)
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        keys = (np.array(left, dtype=np.int64) << 20) | np.array(right, dtype=np.int64)
        self.bits = max(4, int(np.ceil(np.log2(len(keys) + 1))) + 2)
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, dtype=np.int64)
        todo, values = keys, np.array(rank, dtype=np.int64)
        slot = self._slot(todo)
        while len(todo):
            # of the keys that want the same free slot one gets it; the others go on to the next slot
            free = self.keys[slot] == -1
            winners = np.flatnonzero(free)[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[winners]], self.ranks[slot[winners]] = todo[winners], values[winners]
            rest = np.ones(len(todo), dtype=bool)
            rest[winners] = False
            todo, values, slot = todo[rest], values[rest], (slot[rest] + 1) & self.mask
        self.known: dict[str, np.ndarray] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a value above all ranks; ids below 0 have no pairs."""
        keys = (left << 20) | right
        keys = np.where((left < 0) | (right < 0), -2, keys)
        out = np.full(keys.shape, _NONE, dtype=np.int64)
        flat, result = keys.ravel(), out.ravel()
        at = np.arange(flat.size)
        slot = self._slot(flat)
        while at.size:
            held = self.keys[slot]
            hit = held == flat[at]
            result[at[hit]] = self.ranks[slot[hit]]
            go = ~hit & (held != -1)
            at, slot = at[go], (slot[go] + 1) & self.mask
        return result.reshape(keys.shape)

    def merge_rows(self, rows: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of a padded matrix of byte ids (-1 on the right)."""
        out: list[np.ndarray] = [None] * len(rows)
        index = np.arange(len(rows))
        ids = rows.copy()
        if ids.shape[1] < 2:
            return [r[r >= 0] for r in ids]
        ranks = self.rank_of(ids[:, :-1], ids[:, 1:])
        columns = np.arange(ids.shape[1])
        while len(index):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(index)), at]
            done = best >= _NONE
            if done.any():
                for i in np.flatnonzero(done):
                    row = ids[i]
                    out[index[i]] = row[row >= 0]
                index, ids, ranks, at, best = index[~done], ids[~done], ranks[~done], at[~done], best[~done]
                if not len(index):
                    break
                # columns that no row uses any more
                width = max(2, int((ids >= 0).sum(1).max()))
                ids, ranks, columns = ids[:, :width], ranks[:, : width - 1], columns[:width]
            line = np.arange(len(index))
            # everything right of the merged pair moves one column to the left
            moved = np.concatenate([ids[:, 1:], np.full((len(index), 1), -1, dtype=np.int64)], axis=1)
            ids = np.where(columns[None, :] > at[:, None], moved, ids)
            ids[line, at] = best
            moved = np.concatenate([ranks[:, 1:], np.full((len(index), 1), _NONE, dtype=np.int64)], axis=1)
            ranks = np.where(columns[None, :-1] > at[:, None], moved, ranks)
            last = ranks.shape[1] - 1
            has_next = at <= last
            here = np.minimum(at, last)
            after = ids[line, np.minimum(here + 1, ids.shape[1] - 1)]
            ranks[line, here] = np.where(has_next, self.rank_of(ids[line, here], after), ranks[line, here])
            prior = np.maximum(at - 1, 0)
            ranks[line, prior] = np.where(at > 0, self.rank_of(ids[line, prior], ids[line, at]), ranks[line, prior])
        return out

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word, with a heap of pairs over a linked list."""
        ids = self.of_byte[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        arrays = np.array(ids, dtype=np.int64)
        ranks = self.rank_of(arrays[:-1], arrays[1:]).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r < _NONE]
        heapq.heapify(heap)
        one = lambda a, b: int(self.rank_of(np.array([a], dtype=np.int64), np.array([b], dtype=np.int64))[0])
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                x = one(r, ids[after[i]])
                if x < _NONE:
                    heapq.heappush(heap, (x, i, r, ids[after[i]]))
            if before[i] >= 0:
                x = one(ids[before[i]], r)
                if x < _NONE:
                    heapq.heappush(heap, (x, before[i], ids[before[i]], r))
        return np.array([x for x in ids if x >= 0], dtype=np.int64)

    def encode_words(self, words: list[str]) -> None:
        """Make all `words` known."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            raw = word.encode("utf-8", "surrogatepass")
            if len(raw) > LONG:
                self.known[word] = self.merge_long(raw).astype(np.int32)
            else:
                by_width.setdefault(1 << max(0, len(raw) - 1).bit_length(), []).append((word, raw))
        for width, group in by_width.items():
            # matrices of at most about a million cells
            step = max(1, (1 << 20) // width)
            for k in range(0, len(group), step):
                part = group[k : k + step]
                sizes = np.array([len(raw) for _, raw in part])
                rows = np.full((len(part), width), -1, dtype=np.int64)
                rows[np.arange(width)[None, :] < sizes[:, None]] = self.of_byte[np.frombuffer(b"".join(raw for _, raw in part), dtype=np.uint8)]
                for (word, _), ids in zip(part, self.merge_rows(rows), strict=True):
                    self.known[word] = ids.astype(np.int32)

    def encode(self, texts: list[str | None]) -> list[list[np.ndarray]]:
        """The ids of each text, in pieces; none for null and empty texts."""
        split = [self.words.findall(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = {w for line in split for w in line if w not in self.known}
        self.encode_words(sorted(new))
        return [[self.known[w] for w in line] for line in split]


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at `path`, loaded once a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def token_ids(df: DataFrame, doc_id: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """doc_id, ids (array of int) without special tokens; an empty array for null and empty texts."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            lines = vocab.encode(batch.column(1).to_pylist())
            sizes = np.fromiter((sum(map(len, line)) for line in lines), dtype=np.int64, count=len(lines))
            flat = [piece for line in lines for piece in line]
            values = np.concatenate(flat) if flat else np.zeros(0, dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], type=pa.int32()), pa.array(values, type=pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[doc_id, "ids"])

    kind = df.schema[doc_id].dataType.simpleString()
    return spread(df.select(doc_id, text)).mapInArrow(encode, f"`{doc_id}` {kind}, ids array<int>")


def token_counts(df: DataFrame, text: str, keep: list[str], path: str = VOCABULARY) -> DataFrame:
    """The columns `keep` and n_tokens (0 for null and empty texts); ids don't leave Python."""
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            sizes = [sum(map(len, line)) for line in vocab.encode(batch.column(len(keep)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, type=pa.int64())], names=[*keep, "n_tokens"])

    return spread(df.select(*keep, F.col(text))).mapInArrow(count, f"{fields}, n_tokens bigint")
