import pytest
from pyspark.sql import functions as F

from lexanchor.functions.geo import haversine_km
from lexanchor.operators import documents as D
from lexanchor.operators import rerank as R
from lexanchor.operators import vocabulary as V
from tests.conftest import rows

ENTS = "doc_idx long, ent_idx int, text string, label string, id_kb string, source string"


def test_acronyms(spark):
    texts = spark.createDataFrame(
        [(1, "Les Entérobactéries résistantes ( erc ) et SG."), (2, "syphilis congénitale (SG), Lyon (LY)"), (3, "a+b c (AB)"), (4, None)], "doc_idx long, text string"
    )
    ents = spark.createDataFrame(
        [
            (1, 0, "Entérobactéries résistantes", "PATHOGEN", "D1", "MeSH"), (1, 1, "ERC", "PATHOGEN", "", ""), (1, 2, "SG", "PATHOGEN", "", ""),
            (2, 0, "syphilis congénitale", "INF_DISEASE", "D2", "MeSH"), (2, 1, " SG ", "INF_DISEASE", "", None), (2, 2, "SG", "PATHOGEN", "", ""),
            (2, 3, "Lyon", "LOCATION", "9", "GeoNames"), (2, 4, "LY", "LOCATION", "", ""), (3, 0, "a+b c", "PATHOGEN", "D3", "MeSH"), (3, 1, "AB", "PATHOGEN", "", ""),
            (3, 2, "AB", "PATHOGEN", "D9", "MeSH"), (4, 0, "x y", "PATHOGEN", "D4", "MeSH"), (4, 1, "XY", "PATHOGEN", "", ""), (5, 1, None, "PATHOGEN", "", ""),
        ],
        ENTS,
    )
    found = rows(D.propagate_acronyms(ents, texts).select("doc_idx", "ent_idx", "id_kb"))
    assert found == [(1, 1, "D1"), (2, 1, "D2"), (2, 4, "9"), (3, 1, "D3")]


def test_nesting_keeps_order(spark):
    ents = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 10, "z"), (2, 0, "b")], "doc_idx long, ent_idx int, text string")
    assert {r.doc_idx: [e.text for e in r.entities] for r in D.nest(ents).collect()} == {1: ["a", "c", "z"], 2: ["b"]}


CASES = [
    (("1", "GeoNames"), []), (("D000001", "MeSH"), []), (("D000001 & D000002 : C000003", "MeSH"), []), (("", ""), []), (("D1", "MeSH"), ["H9"]), (("x1", "GeoNames"), ["H8"]),
    (("1", "geonames"), ["H7"]), (("1", ""), ["H10"]), (("", "MeSH"), ["H11"]), ((None, "MeSH"), ["H6"]), (("1", None), ["H6"]),
]


def test_violations(spark):
    base = ("t", "LOCATION", "[0]", "[1]")
    data = [(1, k, *base, *base, i, s) for k, ((i, s), _) in enumerate(CASES)]
    data.append((2, 0, *base, "u", "LOCATION", "[0]", None, "", ""))
    schema = "doc_idx long, ent_idx int, text string, label string, start_pos string, end_pos string, pred_text string, pred_label string, pred_start_pos string, pred_end_pos string, pred_id string, pred_source string"
    found = {}
    for r in D.violations(spark.createDataFrame(data, schema)).collect():
        found.setdefault((r.doc_idx, r.ent_idx), []).append(r.rule)
    assert {k: v for k, v in found.items() if k[0] == 1} == {(1, k): want for k, (_, want) in enumerate(CASES) if want}
    assert sorted(found[2, 0]) == ["H5_end_pos", "H5_text"]


def test_metrics_reproduce_the_published_check(spark):
    pairs = [("D1", "MeSH", "D1", "MeSH")] * 433 + [("D1", "MeSH", "D2", "MeSH")] * 35 + [("D1", "MeSH", "", "")] * 2 + [("", "", "", "")] * 21
    df = spark.createDataFrame(pairs, "gold_id string, gold_source string, pred_id string, pred_source string")
    got = {r.kb: (r.n_gold, r.n_pred, r.n_correct, r.precision, r.recall, r.f1) for r in D.linking_metrics(df).collect()}
    assert got["all"] == got["MeSH"] == (470, 468, 433, 92.52, 92.13, 92.32)
    empty = {r.kb: r.f1 for r in D.linking_metrics(df.limit(0)).collect()}
    assert empty in ({}, {"all": None})


def test_haversine(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 180.0), (10.0, 10.0, 10.0, 10.0), (float("nan"), 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    km = [r[0] for r in df.select(haversine_km(*[F.col(c) for c in "abcd"])).collect()]
    assert km[0] == pytest.approx(20015.0868, abs=1e-3) and km[1] == 0 and km[2] == km[3] == float("inf")


VOC = "array<struct<ui string, name string, preferred boolean, terms array<string>>>"


def vocabulary(spark):
    d = [
        ("D1", "n", [("M1", "n", True, ["Fever", "α-toxin"]), ("M2", "n", False, ["Cold"])]), ("D2", "n", [("M3", "n", True, ["cold"])]), ("D3", "n", [("M4", "n", False, ["Fièvre", None, ""])]),
    ]
    s = [("C1", "n", [("M5", "n", True, ["cold", "strain x"])], ["D9"]), ("C2", "n", [("M6", "n", True, ["strain y"])], []), ("C3", "n", None, None)]
    return V.term_index(spark.createDataFrame(d, f"dui string, name string, concepts {VOC}"), spark.createDataFrame(s, f"sui string, name string, concepts {VOC}, mapped_to array<string>"))


def test_vocabulary_link(spark):
    index = vocabulary(spark)
    m = spark.createDataFrame([("FEVER",), ("Cold",), ("strain X",), ("strain y",), ("α-toxin",), ("alpha-toxin",), ("Fièvre",), ("fievre",), ("?",)], "mention string")
    assert {r.mention: (r.stage, r.id) for r in V.link_terms(m, index).collect()} == {
        "FEVER": (0, "D1"), "Cold": (0, "D2"), "strain X": (0, "D9 : C1"), "strain y": (0, "C2"), "α-toxin": (0, "D1"), "Fièvre": (0, "D3"),
    }
    twin = V.twin_index(index.where("type = 'descriptor'").select(F.col("ui").alias("id"), F.col("key").alias("term"), "ord"))
    assert ("fievre", "D3") in rows(twin.select("key", "id"))


def test_compatible_pick(spark):
    df = spark.createDataFrame([("m", "PATHOGEN", "D1", 0, ["c"]), ("m", "PATHOGEN", "D2", 1, ["b"]), ("n", "X", "D3", 1, []), ("n", "X", "D4", 0, None)], "mention string, label string, id string, ord int, cats array<string>")
    df = df.withColumn("compat", V.compatible(F.col("cats"), F.col("label")))
    assert rows(V.pick_compatible(df, ["mention"])) == [("m", "D2", 2), ("n", "D4", 2)]


@pytest.mark.parametrize(
    ("reply", "status", "chosen"),
    [("answer: 1", "chosen", "b"), ("answer: -1", "abstain", ""), ("answer: 7", "none", "f"), ("no idea", "none", "f"), (None, "none", "f")],
)
def test_rerank_states(spark, reply, status, chosen):
    def model(text, n):
        if reply is None:
            raise TimeoutError
        return reply

    q = spark.createDataFrame([("k", "p", 2, ["a", "b"], "f")], "key string, prompt string, n int, ids array<string>, fallback string")
    config = R.RerankConfig(enabled=True, allow_abstain=True)
    assert rows(R.rerank(q, model, config, ["key"])) == [("k", status, chosen)]
    assert rows(R.rerank(q, model, R.RerankConfig(), ["key"])) == [("k", "none", "f")]


def test_several_calls_a_question(spark):
    said = {"p": ["1", "0", "0"], "q": ["x", "", "1"]}
    q = spark.createDataFrame([("k", "p", 2, ["a", "b"], "f"), ("l", "q", 2, ["c", "d"], "f")], "key string, prompt string, n int, ids array<string>, fallback string")
    count: dict = {}

    def model(text, n):
        count[text] = count.get(text, -1) + 1
        return said[text][count[text]]

    assert rows(R.rerank(q.coalesce(1), model, R.RerankConfig(enabled=True, votes=3), ["key"])) == [("k", "chosen", "a"), ("l", "chosen", "d")]


def test_votes(spark):
    votes = [("k", 0, "chosen", 1), ("k", 1, "chosen", 0), ("k", 2, "chosen", 0), ("t", 0, "chosen", 5), ("t", 1, "chosen", 4), ("x", 0, "none", None)]
    df = spark.createDataFrame(votes, "key string, vote int, status string, index int")
    assert rows(R.vote(df, ["key"])) == [("k", "chosen", 0), ("t", "chosen", 5)]


def test_language_of_prompts(spark):
    df = spark.createDataFrame([("m", "c" * 600, "[0] x")], "m string, c string, l string")
    for language in ("en", "fr"):
        text = df.select(R.prompt(F.col("m"), F.col("c"), F.col("l"), R.RerankConfig(language=language, allow_abstain=True))).first()[0]
        assert text.count("c" * 500) == 1 and "c" * 501 not in text and "[0] x" in text and "-1" in text
