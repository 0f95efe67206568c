"""Encoding of a corpus with a public byte-level BPE vocabulary.

Words (the pieces of the vocabulary's pattern) are merged with a contiguous rank array: per word the part
boundaries and, beside each boundary, the rank of the merge across it; the least rank is scanned for, its
boundary deleted and the ranks of the neighbours refreshed, until no merge is left. The words of a batch
that a task has not met before go through this together, one matrix row per word; very long words, for
which scanning would be quadratic, keep their ranks in a heap instead. Spark spreads the documents; a task
keeps the ids of the words it has met in a table of bounded size.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same pattern where all characters are ASCII, for the faster engine, whose own \s has \x1c to \x1f too.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""
SHORT = 48  # bytes; longer words use the heap
KEPT = 300_000  # words, and lines, whose ids a task keeps
NONE = np.int32(2**31 - 1)


class Merges:
    """Ranks of a vocabulary file, as a hash table from pairs of adjacent parts to the merged part."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.whole = ranks
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.pairs = dict(zip(zip(left, right), merged))
        self._table(np.array(left, np.int64) << 17 | np.array(right, np.int64), np.array(merged, np.int32))

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear probing, filled in rounds."""
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        at, left = self._spot(keys), np.arange(len(keys))
        self.probes = 1
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]  # of several for one place the last stays
            placed = self.keys[at] == keys[left]
            self.values[at[placed]] = values[left[placed]]
            at, left = (at[~placed] + 1) & ((1 << self.bits) - 1), left[~placed]
            self.probes += bool(len(left))

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of parts; NONE where there is no such part. -1 is no part."""
        keys = left.astype(np.int64) << 17 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        at = self._spot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], NONE)
        open_ = np.flatnonzero((seen != keys) & (seen != -1) & (keys >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (seen != -1)]
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as 32-bit integers, by contiguous rank arrays; words of like length share a matrix."""
        out: list = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for longest in (2, 4, 6, 8, 12, 16, 24, 32, SHORT):
            rows = np.flatnonzero((sizes <= longest) & (sizes > 0))
            sizes[rows] = 0
            for some in np.array_split(rows, max(1, len(rows) * longest // 2_000_000)):
                if len(some):
                    self._matrix([words[i] for i in some], longest, out, some)
        for i in np.flatnonzero(sizes):
            out[i] = np.array(self.encode_long(words[i]), np.int32).tobytes()
        return out

    def _matrix(self, words: list[bytes], width: int, out: list, at: np.ndarray) -> None:
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        size = np.fromiter(map(len, words), np.int64, len(words))
        place = np.arange(width)
        parts = np.where(place < size[:, None], self.byte_ids[flat], -1)
        ranks = np.full((len(words), width), NONE, np.int32)
        ranks[:, :-1] = self.rank(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(words), width - 1)
        own = np.arange(len(words))
        while len(own):
            least = ranks.argmin(1)
            row = np.arange(len(own))
            best = ranks[row, least]
            ended = best == NONE
            if ended.any():
                flat, starts = parts[ended].astype(np.int32).tobytes(), range(0, 4 * width * int(ended.sum()), 4 * width)
                for i, first, k in zip(at[own[ended]].tolist(), starts, size[ended].tolist()):
                    out[i] = flat[first : first + 4 * k]
                go = ~ended
                parts, ranks, size, own, least, best = parts[go], ranks[go], size[go], own[go], least[go], best[go]
                row = np.arange(len(own))
                if not len(own):
                    return
            # delete the boundary after `least`: everything behind it moves one place forward
            parts[row, least] = best
            shift = np.minimum(place + (place > least[:, None]), width - 1)
            parts = np.take_along_axis(parts, shift, 1)
            ranks = np.take_along_axis(ranks, np.minimum(place + (place > least[:, None]), width - 1), 1)
            parts[:, -1], ranks[:, -1] = -1, NONE
            size = size - 1
            after = np.minimum(least + 1, width - 1)
            ranks[row, least] = self.rank(parts[row, least], np.where(after > least, parts[row, after], -1))
            before = np.flatnonzero(least > 0)
            ranks[before, least[before] - 1] = self.rank(parts[before, least[before] - 1], parts[before, least[before]])

    def encode_long(self, word: bytes) -> list[int]:
        """The same merges in the same order with a heap of ranks and linked parts: n log n."""
        parts = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := pairs.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := pairs.get((r, parts[k]))) is not None:
                    heapq.heappush(heap, (x, i, r, parts[k]))
            h = before[i]
            if h >= 0 and (x := pairs.get((parts[h], r))) is not None:
                heapq.heappush(heap, (x, h, parts[h], r))
        return [p for p in parts if p >= 0]


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    """The table of a vocabulary file, once per Python worker."""
    return Merges(path)


def line_pieces(text: str) -> list[str]:
    """The text cut before line ends that follow a visible character: no word of the pattern spans such a
    place, so the pieces are encoded one by one and repeated lines only once."""
    end = "\r\n" if "\r\n" in text else "\n"
    first, *rest = text.split(end)
    pieces, piece = [], first
    for line in rest:
        if piece and not piece[-1].isspace():
            pieces.append(piece)
            piece = end + line
        else:
            piece += end + line
    pieces.append(piece)
    return pieces


class Encoder:
    """Word and line tables of one task; ids are held as 32-bit integers in bytes."""

    def __init__(self, path: str, kept: int = KEPT) -> None:
        self.merges, self.kept = merges(path), kept
        self.ascii_words, self.all_words = re.compile(ASCII_PATTERN).findall, regex.compile(PATTERN).findall
        self.of_word: dict[str, bytes] = {}
        self.of_line: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [line_pieces(t) if t else [] for t in texts]
        if len(self.of_line) > self.kept:
            self.of_line.clear()
        if len(self.of_word) > self.kept:
            self.of_word.clear()
        lines = list(set(chain.from_iterable(cut)).difference(self.of_line))
        split = [self.ascii_words(x) if x.isascii() else self.all_words(x) for x in lines]
        new = list(set(chain.from_iterable(split)).difference(self.of_word))
        if new:
            self.of_word.update(zip(new, self.merges.encode_words([w.encode("utf-8", "replace") for w in new])))
        word, line = self.of_word.__getitem__, self.of_line.__getitem__
        self.of_line.update(zip(lines, [b"".join(map(word, words)) for words in split]))
        return [b"".join(map(line, pieces)) for pieces in cut]


def _batches(batch: pa.RecordBatch, characters: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cuts of a batch with at most so many characters, one row at least."""
    texts = batch.column("text").to_pylist()
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > characters:
            yield batch.slice(start, i - start), texts[start:i]
            start, size = i, 0
        size += n
    if start < len(texts):
        yield batch.slice(start), texts[start:]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): one row per document, the ids of its whole text without special tokens.

    docs: doc_id, text; other columns are ignored. Empty and null texts give an empty list; null doc_ids
    and repeated rows are kept as they are; an empty table gives an empty result. No shuffle: the work is
    spread as the documents are read, and a text is never cut.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for own, texts in _batches(batch):
                ids = encoder.encode(texts)
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), values)], names=["doc_id", "ids"]
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id {kind}, ids array<int>")


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens): the length of each document in tokens, 0 for empty and null texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for own, texts in _batches(batch):
                counts = [len(x) // 4 for x in encoder.encode(texts)]
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id {kind}, n_tokens long")
