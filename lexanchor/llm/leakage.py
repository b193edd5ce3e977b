"""Held-out passages in a corpus: pigeonhole seeds verified by Myers' bit-parallel distance.

A span of ``span`` item words with at most ``budget`` words changed, added or dropped falls
into ``budget + 1`` pieces of which one stands in the document unchanged. The pieces of all
spans of an item are its word n-grams of length ``span // (budget + 1)``, so their exact hits
find every span within the budget. A hit is kept only if enough words agree on diagonals near
it, which no true span fails, and is then verified by the distance of the span itself.

The rules together say "18 words of the item, about one in ten of them changed": 18 words
with one edit, or 20 words with two edits, so that 18 of them stand; 28 words with three and
36 with four. Forty words with up to five edits hold 20 words with two.

Items of up to ``MOST_CHARS`` characters, which their sum is checked for, are indexed and
broadcast, and the documents are read once. Beyond that, pieces are joined by their hashes: the
documents emit only pieces that a bit table of fixed size knows from the items, every piece
carries the words around it, and each hit is verified by itself, so that no group of a stock
phrase is ever gathered. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexanchor.llm.words import words
from lexanchor.session import spread

#: Pairs of a span in words and the edits allowed in it.
RULES = ((18, 1), (20, 2), (28, 3), (36, 4))
#: Characters of items up to which their index is broadcast.
MOST_CHARS = 8_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words of documents, and hits, that a task handles at once.
BLOCK_WORDS, BLOCK_HITS = 200_000, 500_000
#: Bits of the table that tells which pieces items have: 16 MB.
TABLE_BITS = 27


def myers(pattern: np.ndarray, text: np.ndarray) -> int:
    """Least edit distance of the pattern to any substring of the text (words as symbols)."""
    masks: dict[int, int] = {}
    for k, symbol in enumerate(pattern.tolist()):
        masks[symbol] = masks.get(symbol, 0) | (1 << k)
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = m
    for symbol in text.tolist():
        eq = masks.get(symbol, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        hp = minus | (~(xh | plus) & full)
        hm = plus & xh
        if hp & high:
            score += 1
        elif hm & high:
            score -= 1
        hp = (hp << 1) & full  # the pattern may begin anywhere in the text
        hm = (hm << 1) & full
        plus = hm | (~(xv | hp) & full)
        minus = hp & xv
        best = min(best, score)
    return best


class Vocabulary(dict):
    """Word ids from 1; a word of no item is 0."""

    def __missing__(self, word: str) -> int:
        return 0


@dataclass
class ItemIndex:
    """Word ids of all items in one array, and the sorted hashes of their pieces."""

    vocabulary: dict[str, int]
    item_ids: np.ndarray
    symbols: np.ndarray
    starts: np.ndarray
    piece: int
    hashes: np.ndarray
    piece_at: np.ndarray
    piece_item: np.ndarray


def _rolling(symbols: np.ndarray, width: int) -> np.ndarray:
    n = len(symbols) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    wide = symbols.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = (out ^ (wide[k : k + n] * np.uint64(0xFF51AFD7ED558CCD))) * _BASE
            out ^= out >> np.uint64(29)
    return out


def build_index(items: list[tuple[int, list[str]]], rules: tuple = RULES) -> ItemIndex:
    piece = min(span // (budget + 1) for span, budget in rules)
    least = min(span for span, _ in rules)
    vocabulary = Vocabulary()
    ids, arrays = [], []
    for item_id, found in items:
        if len(found) >= least:
            ids.append(item_id)
            arrays.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in found], np.int32))
    starts = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int64)
    symbols = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    hashes, at, owner = [], [], []
    for k, array in enumerate(arrays):
        h = _rolling(array, piece)
        hashes.append(h)
        at.append(starts[k] + np.arange(len(h)))
        owner.append(np.full(len(h), k))
    if arrays:
        h, a, o = np.concatenate(hashes), np.concatenate(at), np.concatenate(owner)
        order = np.argsort(h, kind="stable")
        h, a, o = h[order], a[order], o[order]
    else:
        h, a, o = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return ItemIndex(vocabulary, np.array(ids), symbols, starts, piece, h, a, o)


def _window(values: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, fill: int) -> np.ndarray:
    inside = (at >= low) & (at < high)
    return np.where(inside, values[np.clip(at, 0, max(0, len(values) - 1))], fill)


def _verify(index: ItemIndex, symbols: np.ndarray, doc_start: np.ndarray, hits: tuple, span: int, budget: int, found: set) -> None:
    """Add the (text, item) pairs of which a hit lies in a span within the budget."""
    back = span - index.piece
    width = span + back
    columns = np.arange(-back, width - back)[None, :]
    for begin in range(0, len(hits[0]), 20_000):
        p, q, item, doc = (x[begin : begin + 20_000] for x in hits)
        item_low, item_high = index.starts[item][:, None], index.starts[item + 1][:, None]
        doc_low, doc_high = doc_start[doc][:, None], doc_start[doc + 1][:, None]
        mine = _window(index.symbols, q[:, None] + columns, item_low, item_high, -1)
        agree = np.zeros(mine.shape, bool)
        for shift in range(-budget, budget + 1):
            agree |= mine == _window(symbols, p[:, None] + columns + shift, doc_low, doc_high, -2)
        total = np.concatenate((np.zeros((len(p), 1), np.int32), np.cumsum(agree, axis=1, dtype=np.int32)), axis=1)
        first = q[:, None] + columns[:, : back + 1]
        good = (first >= item_low) & (first + span <= item_high) & (total[:, span:] - total[:, : back + 1] >= span - budget)
        for k in np.flatnonzero(good.any(axis=1)):
            key = (int(doc[k]), int(item[k]))
            if key in found:
                continue
            for s in np.flatnonzero(good[k]) - back:
                begin_doc = max(doc_low[k, 0], p[k] + s - budget)
                end_doc = min(doc_high[k, 0], p[k] + s + span + budget)
                if myers(index.symbols[q[k] + s : q[k] + s + span], symbols[begin_doc:end_doc]) <= budget:
                    found.add(key)
                    break


def leaks(index: ItemIndex, texts: list[list[str]], rules: tuple = RULES) -> list[tuple[int, int]]:
    """(text ordinal, item ordinal) of every leak in a block of texts."""
    if not len(index.hashes):
        return []
    lengths = np.array([len(t) for t in texts], np.int64)
    doc_start = np.concatenate(([0], np.cumsum(lengths)))
    symbols = np.fromiter(map(index.vocabulary.__getitem__, chain.from_iterable(texts)), np.int32, int(doc_start[-1]))
    h = _rolling(symbols, index.piece)
    if not len(h):
        return []
    low = np.searchsorted(index.hashes, h, "left")
    high = np.searchsorted(index.hashes, h, "right")
    at = np.flatnonzero(high > low)
    doc_of = np.repeat(np.arange(len(texts)), lengths)
    at = at[(doc_of[at] == doc_of[at + index.piece - 1])]
    if not len(at):
        return []
    count = (high - low)[at]
    ends = np.cumsum(count)
    found: set[tuple[int, int]] = set()
    for begin in range(0, int(ends[-1]), BLOCK_HITS):  # a phrase of many items is expanded bit by bit
        nth = np.arange(begin, min(begin + BLOCK_HITS, int(ends[-1])))
        k = np.searchsorted(ends, nth, "right")
        p = at[k]
        entry = low[p] + nth - (ends - count)[k]
        hits = (p, index.piece_at[entry], index.piece_item[entry], doc_of[p])
        for span, budget in rules:
            _verify(index, symbols, doc_start, hits, span, budget, found)
    return sorted(found)


class WordHashes(dict):
    """64-bit hashes of words, which need no common vocabulary."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace")) >> 1
        return code


def reach(rules: tuple) -> tuple[int, int, int]:
    """Length of a piece and the words that a hit's verification needs before and after its first word."""
    piece = min(span // (budget + 1) for span, budget in rules)
    back = max(span - piece + budget for span, budget in rules)
    return piece, back, max(span + budget for span, budget in rules)


def _surrounded(symbols: np.ndarray, at: np.ndarray, back: int, ahead: int) -> list[np.ndarray]:
    return [symbols[max(0, p - back) : p + ahead] for p in at.tolist()]


def _pieces(rules: tuple, least: int, table=None):
    """``(key, hash, back, around)`` of every piece of a text of at least ``least`` words; with a table only of pieces it knows."""
    piece, back, ahead = reach(rules)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = WordHashes()
        bits = None if table is None else table.value
        for pdf in batches:
            for key, text in zip(pdf["key"], pdf["text"], strict=True):
                found = words(text)
                if len(found) < least:
                    continue
                symbols = np.fromiter(map(codes.__getitem__, found), np.int64, len(found))
                h = _rolling(symbols, piece)
                at = np.arange(len(h))
                if bits is not None:
                    slot = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
                    at = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                for begin in range(0, len(at), 5000):
                    own = at[begin : begin + 5000]
                    yield pd.DataFrame({"key": [key] * len(own), "hash": h[own].view(np.int64), "before": np.minimum(own, back), "around": _surrounded(symbols, own, back, ahead)})

    return run


def _verify_hits(rules: tuple):
    """Hits with the words around them, each verified by itself."""
    piece = reach(rules)[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mine, theirs = pdf["item_around"].to_list(), pdf["around"].to_list()
            n = np.arange(len(pdf))
            starts = np.concatenate(([0], np.cumsum([len(x) for x in mine]))).astype(np.int64)
            doc_start = np.concatenate(([0], np.cumsum([len(x) for x in theirs]))).astype(np.int64)
            empty = np.empty(0, np.uint64)
            symbols = np.concatenate([np.asarray(x, np.int64) for x in mine] or [empty])
            index = ItemIndex({}, n, symbols, starts, piece, empty, empty, empty)
            found: set[tuple[int, int]] = set()
            hits = (doc_start[:-1] + pdf["before"].to_numpy(), starts[:-1] + pdf["item_before"].to_numpy(), n, n)
            for span, budget in rules:
                _verify(index, np.concatenate([np.asarray(x, np.int64) for x in theirs] or [empty]), doc_start, hits, span, budget, found)
            at = sorted(k for k, _ in found)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[at], "item_id": pdf["item_id"].to_numpy()[at]})

    return run


def _joined_leaks(texts: DataFrame, held: DataFrame, schema: str, rules: tuple) -> DataFrame:
    """The distributed way: pieces of items and documents joined by hash."""
    spark = texts.sparkSession
    id_type, item_type = texts.schema["doc_id"].dataType.simpleString(), held.schema["item_id"].dataType.simpleString()
    least = min(span for span, _ in rules)
    kept = held.where("item_id is not null").select(F.col("item_id").alias("key"), F.col("item_text").alias("text"))
    pieces = kept.mapInPandas(_pieces(rules, least), f"key {item_type}, hash long, before int, around array<long>")
    byte = F.shiftrightunsigned("hash", 64 - TABLE_BITS)
    known = pieces.select(byte.alias("slot")).groupBy(F.shiftright("slot", 3).alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), F.pmod("slot", F.lit(8)).cast("int"))).alias("bits")
    ).toPandas()  # at most 2^24 rows however many items there are
    table = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    table[known["at"].to_numpy(np.int64)] = known["bits"].to_numpy(np.int64).astype(np.uint8)
    found = texts.select(F.col("doc_id").alias("key"), F.col("doc_text").alias("text")).mapInPandas(
        _pieces(rules, 1, spark.sparkContext.broadcast(table)), f"key {id_type}, hash long, before int, around array<long>"
    )
    own = pieces.select("hash", F.col("key").alias("item_id"), F.col("before").alias("item_before"), F.col("around").alias("item_around"))
    hits = found.withColumnRenamed("key", "doc_id").join(own, "hash").select("doc_id", "item_id", "before", "item_before", "around", "item_around")
    return spread(hits).mapInPandas(_verify_hits(rules), schema).distinct()


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rules: tuple = RULES,
    most_chars: int = MOST_CHARS,
) -> DataFrame:
    """Distinct ``(doc_id, item_id)``: the document holds a span of the item within a rule's budget.

    Null and empty texts leak nothing, nor does an item shorter than the least span; repeated
    rows count once; texts of any length are searched whole; two empty tables give no rows;
    other columns are ignored. Items of more than ``most_chars`` characters in all aren't
    broadcast but joined, so their number isn't bounded.
    """
    spark = documents.sparkSession
    id_type = documents.schema[id_col].dataType.simpleString()
    item_type = items.schema[item_col].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}"
    held = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("item_text")).where("item_text is not null").distinct()
    size = held.agg(F.sum(F.length("item_text"))).first()[0] or 0
    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("doc_text")).where(F.length("doc_text") > 0)

    if size > most_chars:
        return _joined_leaks(texts, held, schema, rules)
    rows = sorted((r[0], words(r[1])) for r in held.collect() if r[0] is not None)
    shared = spark.sparkContext.broadcast(build_index(rows, rules))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for pdf in batches:
            keys = pdf["doc_id"].to_numpy()
            pending, size, first = [], 0, 0
            for k, text in enumerate(pdf["doc_text"]):
                pending.append(words(text))
                size += len(pending[-1])
                if size > BLOCK_WORDS or k == len(keys) - 1:
                    hits = leaks(index, pending, rules)
                    if hits:
                        yield pd.DataFrame({"doc_id": [keys[first + d] for d, _ in hits], "item_id": [index.item_ids[i] for _, i in hits]})
                    pending, size, first = [], 0, k + 1

    return texts.mapInPandas(run, schema).distinct()
