import random

import numpy as np

from lexanchor.llm import reading as R
from tests.conftest import rows

EASY = "Il boit. La mer est bleue. Le chat dort. On rit."
HARD = "Nonobstant l'hétérogénéité méthodologique inhérente aux dispositifs considérés, l'appréciation probabiliste demeure subordonnée aux approximations, laquelle présuppose une stationnarité."
MIDDLE = "Les habitants du village attendent les résultats depuis trois jours parce que la fièvre ne baisse pas."


def test_ordinal_model_recovers_thresholds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 3))
    score = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=1500) * 0.3
    y = 1 + (score > -1.5) + (score > 0) + (score > 1.5)
    model = R.fit_ordinal(x[:1000], y[:1000])
    assert (model.bands(x[1000:]) == y[1000:]).mean() > 0.8
    assert (np.diff(model.thresholds) > 0).all()


def test_wordless_documents_only(spark):
    df = spark.createDataFrame([("a", "12"), ("b", "?!")], "doc_id string, text string")
    assert rows(R.reading_levels(df, spark.createDataFrame([("a", "r", 1)], "doc_id string, rater string, band int"))) == []


def test_query_form(spark):
    rng = random.Random(0)
    docs, labels = [], []
    for k in range(120):
        band = k % 3 + 1
        text = " ".join(rng.choice([EASY, MIDDLE, HARD][band - 1 : band]) for _ in range(rng.randrange(2, 6)))
        docs.append((k, text, "x"))
        if k % 2:
            labels += [(k, "r1", band), (k, "r1", band), (k, "r2", None)] + ([(k, "r3", 9)] if k % 5 == 0 else [])
    docs += [(900, None, "x"), (901, "", "x"), (902, "12 — §", "x"), (903, "mot", "x"), (0, docs[0][1], "x"), (904, "mot " * 30000, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, band string")
    lab = spark.createDataFrame(labels, "doc_id long, rater string, band int")
    got = dict(rows(R.reading_levels(df, lab)))
    assert set(got) == set(range(120)) | {903, 904} and set(got.values()) <= {1, 2, 3, 4}
    assert np.mean([got[k] == k % 3 + 1 for k in range(0, 120, 2)]) > 0.95  # documents without a rating
    assert rows(R.reading_levels(df, lab.limit(0))) == [] == rows(R.reading_levels(df.limit(0), lab))


def test_features_of_a_batch_equal_those_of_single_texts():
    texts = [EASY, "12", HARD + " " + MIDDLE, "", MIDDLE, "mot"]
    at, x, codes, totals = R.features(texts, R.WordCodes())
    assert at.tolist() == [0, 2, 4, 5] and totals.sum() == len(codes)
    start = 0
    for k, row, n in zip(at, x, totals, strict=True):
        one = R.features([texts[k]], R.WordCodes())
        assert np.allclose(one[1][0], row) and (one[2] == codes[start : start + n]).all()
        start += n
    values, sizes = np.array([3.0, 1, 2, 9, 4, 4, 7]), np.array([3, 1, 3])
    assert np.allclose(R._quantile(values, sizes, 0.75), [np.quantile(p, 0.75) for p in (values[:3], values[3:4], values[4:])])


def test_rare_words_share_one_floor(spark):
    words = spark.createDataFrame([([1] * 6 + [2] * 3 + [3],), ([1, 1],)], "codes array<int>")
    shares = R.word_shares(words, least=0.2)
    assert shares.codes.tolist() == [1, 2] and np.allclose(shares.shares, [8 / 12, 3 / 12])
    assert np.allclose(shares.rarity(np.array([3, 1], np.int32)), [-np.log(R.LEAST_SHARE), -np.log(8 / 12)])
