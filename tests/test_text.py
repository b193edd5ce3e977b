import unicodedata

import pytest
from pyspark.sql import functions as F

from lexanchor.functions import text as T


def value(spark, column, **fields):
    names = list(fields)
    df = spark.createDataFrame([tuple(fields.values())], ", ".join(f"{n} {'int' if isinstance(fields[n], int) else 'string'}" for n in names))
    return df.select(column.alias("v")).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Sierra Leone\\n\\n", "sierra leone"), ("a\\tb", "a b"), ("L’Île  de Ré ", "l'île de ré"), ("“X”", '"x"'), ("é", "é"),
        ("Grande-Comore", "grande-comore"), ("", ""), ("\r\n", ""), ("a​b", "a​b"), ("a\x1cb", "a b"), (None, None),
    ],
)
def test_normalize(spark, text, want):
    assert value(spark, T.normalize("t"), t=text) == want


@pytest.mark.parametrize("text", ["Éléphant", "œuf ø", "ﬁn ²", "ＡＢ", "á", "plain", "", "ñ ç ü"])
def test_remove_accents_is_nfkd(spark, text):
    want = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    assert value(spark, T.remove_accents("t"), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("α-amanitine", "alpha-amanitine"), ("µ μ", "mu mu"), ("ς σ ϕ φ", "sigma sigma phi phi"), ("none", "none"), ("", ""), ("β-γ", "beta-gamma")])
def test_greek(spark, text, want):
    assert value(spark, T.transliterate_greek("t"), t=text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("la région de paris", "paris"), ("état du para", "para"), ("l'île d'yeu", "yeu"), ("rue de paris", "de paris"), ("paris", "paris"),
        ("les îles de la ville de x", "x"), ("province chinoise du hebei", "hebei"), ("lalande", "lalande"),
    ],
)
def test_strip_prefix(spark, text, want):
    assert value(spark, T.strip_prefix("t"), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("région nouvelle-aquitaine", "nouvelle-aquitaine"), ("région de paris", "région de paris"), ("commune d'x", "commune d'x"), ("rue x", "rue x"), ("état x", "x")])
def test_bare_admin(spark, text, want):
    assert value(spark, T.strip_bare_admin("t"), t=text) == want


def test_tails_and_context(spark):
    assert value(spark, T.tails("t"), t="a b c d") == ["d", "c d", "b c d"]
    assert value(spark, T.tails("t"), t="a b") == []
    assert value(spark, T.context("t", "s", "e", 2), t="0123456789", s=3, e=5) == "123456"
    assert value(spark, T.context("t", "s", "e", 200), t="0123456789", s=3, e=5) == "0123456789"


@pytest.mark.parametrize(("reply", "lead", "last", "abstain"), [("2 because", 2, 2, 2), ("answer: -1", None, 1, -1), ("<think>3</think> so 4", None, 4, 4), ("none", None, None, None), ("", None, None, None), ("99999999999", None, None, None)])
def test_replies(spark, reply, lead, last, abstain):
    assert [value(spark, f("t"), t=reply) for f in (T.leading_int, T.last_int, T.abstain_int)] == [lead, last, abstain]


@pytest.mark.parametrize(
    ("text", "label", "want"),
    [
        ("quartier nord", "LOCATION", True), ("Zone côtière", "LOCATION", True), ("bassin versant", "LOCATION", True), ("zones", "LOCATION", False),
        ("Fort-de-France", "LOCATION", False), ("venin de x", "BIO_TOXIN", True), ("envenimation", "BIO_TOXIN", False), ("venin", "PATHOGEN", False), ("", "LOCATION", False), (None, None, False),
    ],
)
def test_nil(spark, text, label, want):
    assert value(spark, T.likely_nil("t", "l"), t=text, l=label) == want


@pytest.mark.parametrize(("text", "want"), [("souche O104:H4", True), ("E. coli EHEC", True), ("souches diverses", False), ("H5N1", True), ("rien", False)])
def test_strain(spark, text, want):
    assert value(spark, F.col("t").rlike(T.STRAIN), t=text) == want


@pytest.mark.parametrize(("id_kb", "want"), [("D000123", True), ("D000123 & C000123", True), ("D000123 : C000123 | C000124", True), ("D12", False), ("x", False), ("D000123 :", False), ("D000123\n", False)])
def test_mesh_grammar(spark, id_kb, want):
    assert value(spark, F.col("t").rlike(T.MESH_ID), t=id_kb) == want


def test_artifacts(spark):
    names = {n for n, f in T.ARTIFACTS.items() if value(spark, f(F.col("t")), t="a\\nb &amp; c d  e –fG.")}
    assert names == set(T.ARTIFACTS) - {"control_char"}
    assert not [n for n, f in T.ARTIFACTS.items() if value(spark, f(F.col("t")), t="Île-de-France")]


@pytest.mark.parametrize(
    ("name", "yes", "no"),
    [
        ("control_char", [chr(c) for c in range(32)], ["\x7f", " ", "a"]),
        ("nbsp_or_zerowidth", [" ", " ", "​", "﻿", "‎", "‏"], ["‌", "‍", " ", " "]),
        ("long_dash", ["‐", "‒", "–", "—", "―"], ["-", "‑", "−"]),
        ("literal_escape", ["\\n", "\\r", "\\t", "\\f"], ["\\b", "n", "\n"]),
        ("html_entity", ["&amp;", "&#39;"], ["&amp", "& ;", "&#x27;"]),
    ],
)
def test_characters_of_each_check(spark, name, yes, no):
    rows_ = [(f"a{c}b", True) for c in yes] + [(f"a{c}b", False) for c in no]
    df = spark.createDataFrame(rows_, "text string, want boolean")
    assert [r[0] for r in df.where(T.ARTIFACTS[name](F.col("text")) != F.col("want")).collect()] == []


def test_signs_of_a_wrong_decoding(spark):
    yes = ["Ã©", "Ã¨", "Ãª", "Ã b", "Ã§", "Â°", "Â«", "Â»", "â\x80\x99"]
    df = spark.createDataFrame([(f"x{t}", True) for t in yes] + [(t, False) for t in ("Ã", "Âge", "â€™", "été", None)], "text string, want boolean")
    assert df.where(T.looks_garbled("text") != F.col("want")).count() == 0


def test_marked_spans(spark):
    df = spark.createDataFrame([("ab<c> d", "[0, 5]", "[2, 99]"), ("ab", "1", "2"), ("ab", None, "1"), ("ab", "[0,1]", "[2]")], "text string, s string, e string")
    found = df.select(T.highlight("text", T.spans("s", "e")).alias("h")).collect()
    assert [r.h for r in found] == ["<mark>ab</mark>&lt;c&gt;<mark> d</mark><mark></mark>", "a<mark>b</mark>", None, "<mark>ab</mark>"]
