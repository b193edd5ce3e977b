"""Reading level of each document: regularised ordinal regression calibrated to graded texts.

Features: lexical diversity, rarity of words, connectives, a proxy of clause depth (connectives,
commas and brackets of a sentence, on average and at most), and lengths of words and sentences.
Texts are split into words once; what rarity needs is kept as word codes beside the other features.
Rarity is the share of a word in all documents, down to a least share that bounds the table and
keeps the feature the same at any size. The proportional-odds model is fitted on the rated
documents, of which at most a documented number is used, with the penalty that does best on a
held-out fifth of them, and applied to every document that has a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexanchor.llm.words import strip_marks
from lexanchor.session import cut_lineage

#: The least share of all words that is told from lesser ones: 2^20 words at most have it.
LEAST_SHARE = 2.0**-20
#: Rated documents that the model is fitted on, a documented bound; they are drawn by hash.
MOST_RATED = 20_000
BANDS = 4
PENALTIES = (0.1, 0.5, 2.0, 8.0)
#: Documents whose features are computed at once.
SLICE = 400

# Connectives of French, English and Spanish, without accents.
CONNECTIVES = frozenset(
    """ainsi alors bien car cependant comme donc lorsque lesquels laquelle lequel mais neanmoins nonobstant or parce pendant
    puis puisque quand quoique quoiqu sans selon si tandis toutefois afin although albeit and as because before but
    considering despite however if nevertheless notwithstanding once since so subject than though thus unless until
    whereas which while whose aunque como cuando mientras pero porque pues segun sino despues antes dont telle
    quel qui que qu that who""".split()
)

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_DIGIT = re.compile(r"\d")
_SENTENCE = re.compile(r"[.!?;:…]+(?:\s|$)|[\r\n]+|(?:^|\s)[-*•]\s")
NAMES = (
    "word_length", "long_words", "longer_words", "sentence_length", "sentence_median", "sentence_max", "short_sentences", "long_sentences",
    "diversity", "connectives", "commas", "depth", "deepest", "digits", "word_median", "rarity", "rarity_high",
)


class WordCodes(dict):
    """Twice a word's 32-bit code, plus one for a connective; a word is looked at once."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        plain = strip_marks(word.casefold())
        joins = plain in CONNECTIVES or plain.replace("’", "'").partition("'")[0] in CONNECTIVES
        code = self[word] = crc32(plain.encode("utf-8", "replace")) * 2 + joins
        return code


def _quantile(values: np.ndarray, sizes: np.ndarray, q: float) -> np.ndarray:
    """The quantile of each group of values that follow each other; groups aren't empty."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    ordered = values[np.lexsort((values, owner))]
    starts = np.cumsum(sizes) - sizes
    at = q * (sizes - 1)
    low = np.floor(at).astype(np.int64)
    high = np.minimum(low + 1, sizes - 1)
    return ordered[starts + low] + (at - low) * (ordered[starts + high] - ordered[starts + low])


def _mean(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values.astype(np.float64), np.cumsum(sizes) - sizes) / sizes


def features(texts: list[str], kept: WordCodes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ordinals of the texts that have a word, their features but rarity, word codes of all of them, words of each)."""
    at, sentences, commas, sizes, words, digits = [], [], [], [], [], []
    for k, text in enumerate(texts):
        n = 0
        for part in _SENTENCE.split(text):
            found = _WORD.findall(part)
            if found:
                words += found
                sizes.append(len(found))
                commas.append(part.count(",") + part.count("("))
                n += 1
        if n:
            at.append(k)
            sentences.append(n)
            digits.append(len(_DIGIT.findall(text)) / len(text))
    if not at:
        return np.empty(0, np.int64), np.empty((0, len(NAMES) - 2)), np.empty(0, np.int64), np.empty(0, np.int64)
    sentences, sizes, commas = np.array(sentences), np.array(sizes), np.array(commas)
    totals = np.add.reduceat(sizes, np.cumsum(sentences) - sentences)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.fromiter(map(kept.__getitem__, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(at)), totals)
    order = np.lexsort((codes, owner))
    new = np.concatenate(([True], (codes[order][1:] != codes[order][:-1]) | (owner[order][1:] != owner[order][:-1])))
    distinct = np.bincount(owner[order][new], minlength=len(at))
    joined = np.add.reduceat(codes & 1, np.cumsum(sizes) - sizes)
    clauses = commas + joined
    first = np.cumsum(sentences) - sentences
    x = np.stack(
        [
            _mean(lengths, totals), _mean(lengths >= 8, totals), _mean(lengths >= 12, totals), np.log(_mean(sizes, sentences)),
            np.log(_quantile(sizes, sentences, 0.5)), np.log(np.maximum.reduceat(sizes, first)), _mean(sizes <= 9, sentences), _mean(sizes >= 28, sentences),
            np.log(distinct / np.sqrt(totals)), np.add.reduceat(joined, first) / totals, np.add.reduceat(commas, first) / totals,
            np.log1p(_mean(clauses, sentences)), np.log1p(np.maximum.reduceat(clauses, first)), np.array(digits), _quantile(lengths, totals, 0.5),
        ],
        axis=1,
    )
    return np.array(at), x, codes >> 1, totals


@dataclass
class WordShares:
    """Shares of the words that are common enough, by sorted code."""

    codes: np.ndarray
    shares: np.ndarray

    def rarity(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.full(len(codes), -np.log(LEAST_SHARE))
        k = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return -np.log(np.where(self.codes[k] == codes, self.shares[k], LEAST_SHARE))


@dataclass
class OrdinalModel:
    """Proportional odds: P(band <= k) = sigmoid(threshold_k - score), over standardised features and their squares."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    @staticmethod
    def _expand(z: np.ndarray) -> np.ndarray:
        z = np.clip(z, -4, 4)
        return np.concatenate([z, z * z - 1, np.maximum(z, 0)], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self._expand((x - self.mean) / self.scale) @ self.weights

    def bands(self, x: np.ndarray) -> np.ndarray:
        """The likeliest band of each row."""
        below = 1 / (1 + np.exp(-(self.thresholds[None, :] - self.scores(x)[:, None])))
        edges = np.concatenate([np.zeros((len(x), 1)), below, np.ones((len(x), 1))], axis=1)
        return np.diff(edges, axis=1).argmax(axis=1) + 1


def fit_ordinal(x: np.ndarray, y: np.ndarray, bands: int = BANDS, penalty: float = 0.5, rounds: int = 400) -> OrdinalModel:
    """Penalised maximum likelihood by gradient steps with momentum and step control."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    model = OrdinalModel(mean, scale, np.zeros(0), np.zeros(0))
    z = model._expand((x - mean) / scale)
    n, d = z.shape
    share = np.clip(np.cumsum(np.bincount(y - 1, minlength=bands))[:-1] / n, 0.01, 0.99)
    first = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(first), 0.05))
    theta = np.concatenate([np.zeros(d), first[:1], gaps])

    def cut(theta):
        return np.concatenate([theta[d : d + 1], theta[d] + np.cumsum(np.exp(theta[d + 1 :]))])

    def loss(theta):
        w, t = theta[:d], cut(theta)
        s = z @ w
        upper = np.where(y < bands, t[np.minimum(y - 1, bands - 2)] - s, 60.0)
        lower = np.where(y > 1, t[np.maximum(y - 2, 0)] - s, -60.0)
        pu, pl = 1 / (1 + np.exp(-upper)), 1 / (1 + np.exp(-lower))
        p = np.maximum(pu - pl, 1e-12)
        du, dl = pu * (1 - pu) / p, pl * (1 - pl) / p
        grad_s = (du - dl) / n
        grad_t = np.zeros(bands - 1)
        np.add.at(grad_t, np.minimum(y - 1, bands - 2), np.where(y < bands, -du / n, 0))
        np.add.at(grad_t, np.maximum(y - 2, 0), np.where(y > 1, dl / n, 0))
        grad = np.concatenate([z.T @ grad_s + penalty * w / n, [grad_t.sum()], np.zeros(bands - 2)])
        for k in range(bands - 2):
            grad[d + 1 + k] = grad_t[k + 1 :].sum() * np.exp(theta[d + 1 + k])
        return -np.log(p).mean() + penalty * (w @ w) / (2 * n), grad

    # limited-memory quasi-Newton
    value, grad = loss(theta)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, alphas = grad.copy(), []
        for s, g, rho in reversed(steps):
            a = rho * (s @ q)
            alphas.append(a)
            q -= a * g
        if steps:
            s, g, _ = steps[-1]
            q *= (s @ g) / (g @ g)
        for (s, g, rho), a in zip(steps, reversed(alphas), strict=True):
            q += s * (a - rho * (g @ q))
        size = 1.0
        while size > 1e-8:
            new = theta - size * q
            new_value, new_grad = loss(new)
            if new_value <= value - 1e-4 * size * (grad @ q):
                break
            size /= 2
        else:
            break
        s, g = new - theta, new_grad - grad
        if s @ g > 1e-12:
            steps = [*steps[-9:], (s, g, 1 / (s @ g))]
        done = value - new_value < 1e-9
        theta, value, grad = new, new_value, new_grad
        if done:
            break
    model.weights, model.thresholds = theta[:d], cut(theta)
    return model


def validated_fit(x: np.ndarray, y: np.ndarray) -> OrdinalModel:
    """The model of all rated documents with the penalty that is right most often on a fifth of them held out."""
    held = np.arange(len(y)) % 5 == 4
    if held.sum() < 20:
        return fit_ordinal(x, y)
    right = [(fit_ordinal(x[~held], y[~held], penalty=p).bands(x[held]) == y[held]).mean() for p in PENALTIES]
    return fit_ordinal(x, y, penalty=PENALTIES[int(np.argmax(right))])


def split_texts(source: DataFrame) -> DataFrame:
    """``(doc_id, x, codes)`` of every ``source(doc_id, text)`` with a word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = WordCodes()
        for pdf in batches:
            for start in range(0, len(pdf), SLICE):
                part = pdf.iloc[start : start + SLICE]
                at, x, codes, totals = features(part["text"].to_list(), kept)
                if len(at):
                    parts = np.split(codes.astype(np.uint32).view(np.int32), np.cumsum(totals)[:-1])
                    yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[at], "x": list(x), "codes": parts})

    return source.mapInPandas(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, x array<double>, codes array<int>")


def word_shares(documents: DataFrame, least: float = LEAST_SHARE) -> WordShares:
    """Shares of all words of ``documents(codes)`` that are at least ``least``, of which there are 1 / least at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                codes, n = np.unique(np.concatenate(pdf["codes"].to_list()), return_counts=True)
                yield pd.DataFrame({"code": codes, "n": n})

    counted = documents.select("codes").mapInPandas(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    total = documents.select(F.sum(F.size("codes"))).first()[0] or 1
    rows = counted.where(F.col("n") >= least * total).toPandas()
    codes, shares = rows["code"].to_numpy(np.int32), rows["n"].to_numpy(np.float64) / total
    order = np.argsort(codes)
    return WordShares(codes[order], shares[order])


def whole_features(pdf: pd.DataFrame, shares: WordShares) -> np.ndarray:
    """The features of a batch with rarity added."""
    sizes = pdf["codes"].map(len).to_numpy()
    rarity = shares.rarity(np.concatenate(pdf["codes"].to_list()).astype(np.int32))
    return np.column_stack([np.stack(pdf["x"].to_list()), _mean(rarity, sizes), _quantile(rarity, sizes, 0.75)])


def reading_levels(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rated: int = MOST_RATED
) -> DataFrame:
    """``(doc_id, band)`` of every document with at least one word (a run of letters).

    Null, empty and wordless texts get no row; repeated document rows come out once; ratings
    that are null or out of range are ignored and several of one document averaged; without
    any rating there is nothing to calibrate to, and no document gets a band. Texts are read
    whole; other columns are ignored.
    """
    spark = documents.sparkSession
    id_type = documents.schema[id_col].dataType.simpleString()
    source = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    known = cut_lineage(split_texts(source))  # read three times below, split once
    shares = spark.sparkContext.broadcast(word_shares(known))
    rated = (
        labels.where(F.col("band").between(1, BANDS))
        .select(F.col(id_col).alias("doc_id"), "rater", "band")
        .distinct()
        .groupBy("doc_id")
        .agg(F.avg("band").alias("level"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most_rated)
    )

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"level": pdf["level"], "x": list(whole_features(pdf, shares.value))})

    graded = known.join(F.broadcast(rated), "doc_id").mapInPandas(whole, "level double, x array<double>").orderBy("level", "x").toPandas()
    if not len(graded):
        return spark.createDataFrame([], f"doc_id {id_type}, band long")
    level = np.floor(graded["level"].to_numpy(np.float64) + 0.5).astype(np.int64)
    model = spark.sparkContext.broadcast(validated_fit(np.stack(graded["x"].to_numpy()), level))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "band": model.value.bands(whole_features(pdf, shares.value))})

    return known.mapInPandas(run, f"doc_id {id_type}, band long").distinct()
