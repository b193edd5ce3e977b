"""Free-entered values mapped to the closest entry of a canonical list.

Values are made distinct and normalised; candidates come from an inverted index of character
n-grams (bigrams, trigrams and bigrams with a gap), scored by weighted cosine. The best entry is
accepted above a threshold and a margin over the next one, if its most telling word stands in the
value within some edits; low cosines also need the whole entry to stand in it. Weights are inverse
frequencies over all distinct values of a background.

A list of up to ``MOST_ENTRIES``, which is checked, is indexed and broadcast. A longer one is
joined by n-gram: of each vector only the rarest n-grams are joined, those without which the rest
couldn't reach the least cosine by itself, and candidates are scored in full. Both ways give the
same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexanchor.llm.garble import undo_utf8
from lexanchor.llm.lookalike import LOOKS, canonical, public_looks
from lexanchor.llm.words import fold
from lexanchor.session import cut_lineage, spread

GRAM_BITS = 18
#: Least cosine, least margin over the next entry, and most edits of the entry's most telling word by its length.
TIERS = ((0.5, 0.03, 0.45), (0.3, 0.15, 0.25), (0.3, 0.22, 0.35))
#: The same where the whole entry must stand in the value too, within so many edits by its length.
LOW_TIER, EDITS = (0.2, 0.03, 0.25), 0.27
#: Entries below it are none.
FLOOR = 0.2
#: There the value may be so much longer than the entry, not counting words that so many of all values have.
LONGER, GENERIC = 1.5, 0.002
#: Entries of a list that is broadcast.
MOST_ENTRIES = 20_000
_WORD = re.compile(r"[^\W_]+")


def normalise(text: str | None, looks: dict[str, str] = LOOKS) -> str:
    """Folded words of a value with wrong decodings and look-alikes undone."""
    return " ".join(_WORD.findall(fold(canonical(undo_utf8(text), looks)))) if text else ""


class GramCodes(dict):
    """Hashed n-grams; each is hashed once."""

    def __missing__(self, gram: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        code = self[gram] = crc32(gram.encode("utf-8", "replace")) >> (32 - GRAM_BITS)
        return code


_CODES = GramCodes()


def grams(key: str) -> list[str]:
    """Bigrams, trigrams and gapped bigrams of a normalised value without its spaces."""
    s = f" {key.replace(' ', '')} "
    return (
        [s[i : i + 3] for i in range(len(s) - 2)]
        + [s[i : i + 2] for i in range(len(s) - 1)]
        + [s[i] + "_" + s[i + 2] for i in range(len(s) - 2)]
    )


def gram_counts(key: str) -> tuple[np.ndarray, np.ndarray]:
    found = grams(key)
    return np.unique(np.fromiter(map(_CODES.__getitem__, found), np.int64, len(found)), return_counts=True)


def vector(key: str, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a value and their weights, of length one together."""
    at, n = gram_counts(key)
    w = np.sqrt(n) * weights[at]
    norm = float(np.sqrt((w * w).sum()))
    return at, w / norm if norm else w


def cosine(key: str, entry: str, weights: np.ndarray) -> float:
    a, x = vector(key, weights)
    b, y = vector(entry, weights)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return round(float((x[i] * y[j]).sum()), 9)


def edits_within(entry: str, value: str) -> int:
    """Least edits, a swap of neighbours counting one, between the entry and any part of the value."""
    before, last = [0] * (len(value) + 1), [0] * (len(value) + 1)
    for j, c in enumerate(entry, 1):
        row = [j] + [0] * len(value)
        for i, d in enumerate(value, 1):
            best = last[i - 1] + (c != d)
            if last[i] + 1 < best:
                best = last[i] + 1
            if row[i - 1] + 1 < best:
                best = row[i - 1] + 1
            if j > 1 and i > 1 and c == value[i - 2] and entry[j - 2] == d and before[i - 2] + 1 < best:
                best = before[i - 2] + 1
            row[i] = best
        before, last = last, row
    return min(last)


def accepts(key: str, entry: str, telling: str, best: float, second: float, generic: frozenset[str]) -> bool:
    """Whether the best entry of a value is meant, given its cosine and that of the next one."""
    rules = [edits for least, margin, edits in (*TIERS, LOW_TIER) if best >= least and best - second >= margin]
    if not rules:
        return False
    squeezed = key.replace(" ", "")
    word = edits_within(telling, squeezed) / max(1, len(telling))
    if any(best >= least and best - second >= margin and word <= edits for least, margin, edits in TIERS):
        return True
    whole = entry.replace(" ", "")
    if best < LOW_TIER[0] or best - second < LOW_TIER[1] or word > LOW_TIER[2] or sum(len(w) for w in key.split() if w not in generic) > LONGER * len(whole):
        return False
    return edits_within(whole, squeezed) / max(1, len(whole)) <= EDITS


class ListIndex:
    """Inverted index of a canonical list ``(id, kind, key, telling)``, sorted by id."""

    def __init__(self, entries: list[tuple[str, str, str, str]], weights: np.ndarray):
        self.ids = [e[0] for e in entries]
        self.keys = [e[2] for e in entries]
        self.telling = [e[3] for e in entries]
        # entries of one id follow each other and aren't rivals of each other
        self.first = np.searchsorted(np.array(self.ids, object), np.array(self.ids, object), "left") if entries else np.empty(0, np.int64)
        self.last = np.searchsorted(np.array(self.ids, object), np.array(self.ids, object), "right") if entries else np.empty(0, np.int64)
        kinds = np.array([e[1] for e in entries], object)
        self.of_kind = {kind: kinds == kind for kind in set(kinds.tolist())}
        self.weights = weights
        owner, code, value = [], [], []
        for k, key in enumerate(self.keys):
            at, w = vector(key, weights)
            owner.append(np.full(len(at), k, np.int32))
            code.append(at)
            value.append(w)
        codes = np.concatenate(code) if code else np.empty(0, np.int64)
        order = np.argsort(codes, kind="stable")
        self.owner = np.concatenate(owner)[order] if owner else np.empty(0, np.int32)
        self.value = np.concatenate(value)[order] if value else np.empty(0)
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=1 << GRAM_BITS)))).astype(np.int64)

    def best(self, key: str, kind: str) -> tuple[int, float, float]:
        """The entry of the greatest cosine, the first of equal ones, that cosine and the next of another id; -1 if none reaches FLOOR."""
        if not key or not self.ids or (kind and kind not in self.of_kind):
            return -1, 0.0, 0.0
        at, w = vector(key, self.weights)
        low, high = self.starts[at], self.starts[at + 1]
        count = high - low
        total = int(count.sum())
        if not total:
            return -1, 0.0, 0.0
        where = np.repeat(low - np.cumsum(count) + count, count) + np.arange(total)
        scores = np.bincount(self.owner[where], self.value[where] * np.repeat(w, count), minlength=len(self.ids)).round(9)
        if kind:
            scores[~self.of_kind[kind]] = 0.0
        first = int(scores.argmax())
        top = float(scores[first])
        scores[self.first[first] : self.last[first]] = 0.0
        second = float(scores.max())
        return (first, top, second if second >= FLOOR else 0.0) if top >= FLOOR else (-1, 0.0, 0.0)

    def link(self, key: str, kind: str, generic: frozenset[str]) -> str:
        k, top, second = self.best(key, kind)
        return self.ids[k] if k >= 0 and accepts(key, self.keys[k], self.telling[k], top, second, generic) else ""


def rarest_grams(key: str, weights: np.ndarray) -> np.ndarray:
    """N-grams, rarest first, without those that couldn't give a cosine of FLOOR by themselves."""
    at, w = vector(key, weights)
    order = np.lexsort((at, -weights[at]))
    left = np.sqrt(np.cumsum((w[order] ** 2)[::-1])[::-1])
    return at[order][left >= FLOOR - 1e-9]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct values that have each hashed n-gram; their number is bounded by the alphabet, so the table has a fixed size."""
    total = np.zeros(1 << GRAM_BITS, np.int64)
    for pdf in batches:
        for start in range(0, len(pdf), 2000):
            found = [gram_counts(key)[0] for key in pdf["key"].iloc[start : start + 2000] if key]
            if found:
                total += np.bincount(np.concatenate(found), minlength=len(total))
    at = np.flatnonzero(total)
    yield pd.DataFrame({"bucket": at, "n": total[at]})


def _keyed(looks: dict[str, str], source: str, schema: str) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(key=[normalise(v, looks) for v in pdf[source]])

    return lambda df: df.mapInPandas(run, f"{schema}, key string")


def _telling_words(listed: DataFrame, words: DataFrame) -> DataFrame:
    """``(id, kind, key, telling)``: of each entry the word that is rarest for its length, of those longer than three letters."""
    own = F.split("key", " ")
    long = F.filter(own, lambda w: F.length(w) > 3)
    spelt = listed.select("id", "kind", "key", F.explode(F.when(F.size(long) > 0, long).otherwise(F.array("key"))).alias("word"))
    rarity = (F.coalesce("n", F.lit(0)) + 1) / F.greatest(F.length("word"), F.lit(1))
    best = spelt.join(words, "word", "left").groupBy("id", "kind", "key").agg(F.min(F.struct(rarity.alias("r"), "word")).alias("b"))
    return best.select("id", "kind", "key", F.col("b.word").alias("telling"))


def _joined(keys: DataFrame, entries: DataFrame, weights, generic: frozenset[str]) -> DataFrame:
    """The way for long lists: ``(key, kind, ref_id)`` of accepted keys by a join of n-grams."""

    def prefixes(column: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [rarest_grams(key, weights.value) if key else np.empty(0, np.int64) for key in pdf["key"]]
            at = np.repeat(np.arange(len(pdf)), [len(f) for f in found])
            if len(at):
                yield pd.DataFrame({"gram": np.concatenate(found), column: pdf[column].to_numpy()[at], "kind": pdf["kind"].to_numpy()[at]})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cos = np.array([cosine(key, entry, weights.value) for key, entry in zip(pdf["key"], pdf["entry"], strict=True)], float)
            yield pdf.assign(cosine=cos)[cos >= FLOOR]

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            columns = (pdf[c] for c in ("key", "entry", "telling", "cosine", "second"))
            yield pdf[[accepts(*row, generic) for row in zip(*columns, strict=True)]][["key", "kind", "ref_id"]]

    mine = keys.where("key <> ''").mapInPandas(partial(prefixes, "key"), "gram long, key string, kind string")
    theirs = entries.mapInPandas(partial(prefixes, "id"), "gram long, id string, kind string").withColumnRenamed("kind", "entry_kind")
    met = mine.join(theirs, "gram").where("kind = '' or kind = entry_kind").select("key", "kind", "id", "entry_kind").distinct()
    known = entries.select("id", F.col("kind").alias("entry_kind"), F.col("key").alias("entry"), "telling")
    scored = met.join(known, ["id", "entry_kind"]).select("key", "kind", "id", "entry", "telling")
    scored = cut_lineage(scored.mapInPandas(score, "key string, kind string, id string, entry string, telling string, cosine double"))
    first = scored.groupBy("key", "kind").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "id", "entry", "telling")).alias("b"))
    first = first.select("key", "kind", F.col("b.id").alias("ref_id"), "b.entry", "b.telling", (-F.col("b.c")).alias("cosine"))
    rivals = scored.select("key", "kind", "id", F.col("cosine").alias("rival")).join(first.select("key", "kind", "ref_id"), ["key", "kind"])
    rivals = rivals.where("id <> ref_id").groupBy("key", "kind").agg(F.max("rival").alias("second"))
    decided = first.join(rivals, ["key", "kind"], "left").withColumn("second", F.coalesce("second", F.lit(0.0)))
    return decided.mapInPandas(choose, "key string, kind string, ref_id string")


def link_values(
    values: DataFrame,
    entries: DataFrame,
    entry_id: str = "ref_id",
    entry_name: str = "ref_name",
    entry_kind: str = "kind",
    most_entries: int = MOST_ENTRIES,
    background: DataFrame | None = None,
) -> DataFrame:
    """``(tbl, row_id, ref_id)`` of every row of ``values(tbl, row_id, value, kind)``; '' where none is meant.

    ``kind`` restricts the entries; '' or null allows all. Null, empty and wordless values get
    ''; repeated rows come out once; a hot value is matched once and joined back; an empty list
    gives '' throughout. Entries that are null aren't matched; other columns are ignored.
    ``background(value)`` is what frequencies are counted over, by default the values.
    """
    spark = values.sparkSession
    looks = public_looks(spark)
    rows = values.select("tbl", "row_id", F.coalesce("value", F.lit("")).alias("value"), F.coalesce("kind", F.lit("")).alias("kind")).distinct()
    distinct = cut_lineage(_keyed(looks, "value", "value string, kind string")(spread(rows.select("value", "kind").distinct())))
    keys = spread(distinct.select("key", "kind").distinct())
    listed = entries.select(
        F.col(entry_id).cast("string").alias("id"), F.col(entry_name).alias("name"), F.coalesce(entry_kind, F.lit("")).alias("kind")
    ).where("id is not null and name is not null")
    seen = spread((rows if background is None else background).select("value").where(F.length("value") > 0).distinct())
    seen = cut_lineage(_keyed(looks, "value", "value string")(seen).select("key"))
    listed = _keyed(looks, "name", "id string, name string, kind string")(listed.distinct()).select("id", "kind", "key").where("key <> ''").distinct()
    entry_count, seen_count = listed.count(), seen.count()
    total = seen_count + entry_count
    counted = seen.mapInPandas(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.ones(1 << GRAM_BITS)
    frequency[counted["bucket"].to_numpy(np.int64)] += counted["n"].to_numpy(np.float64)
    weights = np.log(1.0 + total / frequency)
    words = seen.select(F.explode(F.array_distinct(F.split("key", " "))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    # so many words at most can each be in a part of GENERIC of all values: 500 times the words of a value
    generic = frozenset(r[0] for r in words.where(F.col("n") >= GENERIC * total).select("word").collect())
    listed = _telling_words(listed, words)
    if entry_count > most_entries:
        linked = _joined(keys, cut_lineage(listed), spark.sparkContext.broadcast(weights), generic)
    else:
        index = spark.sparkContext.broadcast(ListIndex(sorted(tuple(r) for r in listed.select("id", "kind", "key", "telling").collect()), weights))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                ids = [index.value.link(key, kind, generic) for key, kind in zip(pdf["key"], pdf["kind"], strict=True)]
                out = pdf.assign(ref_id=ids)
                yield out[out["ref_id"] != ""]

        linked = keys.mapInPandas(run, "key string, kind string, ref_id string")
    chosen = distinct.join(linked, ["key", "kind"]).select("value", "kind", "ref_id")
    return rows.join(chosen, ["value", "kind"], "left").select("tbl", "row_id", F.coalesce("ref_id", F.lit("")).alias("ref_id")).distinct()
