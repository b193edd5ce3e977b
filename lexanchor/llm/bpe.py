"""Byte-level BPE over a whole corpus with the rank file of a public tokenizer.

Pre-tokens of a batch are made distinct and encoded together: they are bucketed by length
into padded numpy matrices, and in each round every row merges its leftmost pair of minimum
rank, found by a hashed pair lookup; rows are compacted after each merge and leave the
matrix when no pair is left. Results of frequent pre-tokens are kept per worker.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NONE = np.int32(2**31 - 1)
#: Pre-tokens of more bytes than this are merged one by one with a heap, not in a matrix.
MATRIX_BYTES = 96
BLOCK_CHARS = 1_000_000
KEPT_WORDS = 200_000


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of their merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 3))))
        size = 1 << self.bits
        self.mask = size - 1
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, NONE, np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == -1
            _, first = np.unique(slot[todo[free]], return_index=True)
            put = todo[free][first]
            self.keys[slot[put]] = keys[put]
            self.values[slot[put]] = merged[put]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge's id, which is its rank, or NONE; negative ids (padding) never merge."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        out = np.full(left.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left[todo].astype(np.int64) << 32) | right[todo].astype(np.int64)
        slot = self._slot(keys)
        while len(todo):
            found = self.keys[slot]
            hit = found == keys
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (found != -1)
            todo, keys, slot = todo[on], keys[on], (slot[on] + 1) & self.mask
        return out.reshape(shape)


class Encoder:
    def __init__(self, rank_file: str):
        with open(rank_file, "rb") as file:
            self.vocabulary = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        triples = [
            (self.vocabulary[token[:k]], self.vocabulary[token[k:]], rank)
            for token, rank in self.vocabulary.items()
            for k in range(1, len(token))
            if token[:k] in self.vocabulary and token[k:] in self.vocabulary
        ]
        columns = np.array(triples, np.int64).reshape(-1, 3)
        self.pairs = PairTable(columns[:, 0], columns[:, 1], columns[:, 2].astype(np.int32))
        self.merges = {(a, b): r for a, b, r in triples}
        self.byte_ids = np.array([self.vocabulary[bytes([b])] for b in range(256)], np.int32)
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, np.ndarray] = {}

    def _merge_matrix(self, words: list[bytes]) -> list[np.ndarray]:
        """All words of one length bucket together."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
        lengths = np.array([len(w) for w in words])
        ids = np.full((len(words), int(lengths.max())), -1, np.int32)
        flat = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        ids[np.arange(ids.shape[1])[None, :] < lengths[:, None]] = flat
        rows = np.arange(len(words))
        ranks = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            best = ranks.min(axis=1) if ranks.shape[1] else np.full(len(rows), NONE)
            done = best == NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[rows[k]] = ids[k, : lengths[k]].copy()
                on = ~done
                rows, ids, ranks, lengths, best = rows[on], ids[on], ranks[on], lengths[on], best[on]
                if not len(rows):
                    break
            at = ranks.argmin(axis=1)  # the leftmost of equal ranks
            line = np.arange(len(rows))
            ids[line, at] = best
            shift = np.arange(ids.shape[1] - 1)[None, :]
            ids = np.take_along_axis(ids, shift + (shift > at[:, None]), axis=1)
            lengths = lengths - 1
            if ranks.shape[1] > 1:
                shift = np.arange(ranks.shape[1] - 1)[None, :]
                ranks = np.take_along_axis(ranks, shift + (shift >= at[:, None]), axis=1)
                for beside in (at - 1, at):
                    inside = (beside >= 0) & (beside < ranks.shape[1])
                    r, c = line[inside], beside[inside]
                    ranks[r, c] = self.pairs.ranks(ids[r, c], ids[r, c + 1])
            else:
                ranks = ranks[:, :0]
            width = int(lengths.max())
            ids, ranks = ids[:, :width], ranks[:, : max(0, width - 1)]
        return out

    def _merge_long(self, word: bytes) -> np.ndarray:
        """One very long word: the same merges in the same order, by a heap over a linked list."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.merges.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = following[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            following[i] = k = following[j]
            if k < n:
                previous[k] = i
                if (r := self.merges.get((rank, ids[k]))) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            h = previous[i]
            if h >= 0 and (r := self.merges.get((ids[h], rank))) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_words(self, words: list[str]) -> None:
        """Put the ids of new pre-tokens into ``known``."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            code = word.encode("utf-8", "replace")
            whole = self.vocabulary.get(code)
            if whole is not None:
                self.known[word] = np.array([whole], np.int32)
            elif len(code) > MATRIX_BYTES:
                self.known[word] = self._merge_long(code)
            else:
                buckets.setdefault((len(code) + 3) // 4, []).append((word, code))
        for entries in buckets.values():
            for (word, _), ids in zip(entries, self._merge_matrix([code for _, code in entries]), strict=True):
                self.known[word] = ids

    def encode_batch(self, texts: list[str]) -> pa.ListArray:
        """Ids of each text; an empty text has none."""
        split = [self.pattern.findall(text) for text in texts]
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        new = {w for words in split for w in words if w not in self.known}
        if new:
            self.encode_words(list(new))
        parts = [self.known[w] for words in split for w in words]
        counts = np.fromiter((len(p) for p in parts), np.int64, len(parts))
        words_per_text = np.fromiter((len(w) for w in split), np.int64, len(split))
        total = np.concatenate(([0], np.cumsum(counts)))
        ends = total[np.concatenate(([0], np.cumsum(words_per_text)))]
        flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


@lru_cache(maxsize=2)
def load_encoder(rank_file: str) -> Encoder:
    return Encoder(rank_file)


def encode_corpus(df: DataFrame, id_col: str, text_col: str, tokenizers_dir: str = DEFAULT_TOKENIZERS, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """Columns ``(doc_id, ids)``: one row per input row, in which nulls and empty texts have the empty list.

    Repeated rows are encoded each; texts of any length are encoded whole; no special tokens
    are added and their strings are ordinary text; other columns are ignored.
    """
    rank_file = os.path.join(tokenizers_dir, f"{vocabulary}.tiktoken")
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(rank_file)
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop]) <= BLOCK_CHARS):
                    size += len(texts[stop])
                    stop += 1
                ids = encoder.encode_batch(texts[start:stop])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), ids], names=["doc_id", "ids"])
                start = stop

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {id_type}, ids array<int>")
