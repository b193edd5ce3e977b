import pytest

from lexanchor.llm import lookalike as K
from tests.conftest import rows

CASES = [
    "\uff29\uff4c\uff45", "ca\u200bs", "Sa\u00adint", "NO\u00a0BREAK", "a\u2009b", "Port-Quulzar\u0430\u0441", "Dauzu\u03bfux", "C\u00e9l\u217d\u00e9rdru",
    "\ufb02\u00eejelata", "h\u00e9p\u0251tite", "\u0397aut", "Port-Suse\u0300anche", "\ufeffcas", "id\u2060em",
]
ORDINARY = [
    "Île-de-France", "São Paulo", "α-darvegaine", "TGFβ", "фишагагу", "πεφιξω", "中国", "l’hôpital", "haut–stôr", "« x »", "a  b", "dÃ©cÃ¨s", "\u00c3\u00a0 la", "b├¬ta", "S√£o", "CemchГ©elle", "",
    "µg", "n° 4 ± 1 §",
]


def case_by_table(text, looks=K.LOOKS):
    return K.is_case(text, {t for t in K.suspects(K.mask_garbled(text), looks) if K.by_table(t, looks)}, looks)


@pytest.mark.parametrize("text", CASES)
def test_cases(text, spark):
    assert case_by_table(text) and case_by_table(text, K.public_looks(spark))


@pytest.mark.parametrize("text", ORDINARY)
def test_ordinary(text, spark):
    assert not case_by_table(text) and not case_by_table(text, K.public_looks(spark))


def test_public_table(spark):
    looks = K.public_looks(spark)
    assert len(looks) > 500 and looks["Ꭺ"] == "A" and looks["ꓓ"] == "D" and looks["һ"] == "h"
    assert not any(ord(c) < 0x180 and c != "ı" for c in looks)
    assert looks.readings("Ӏ") >= {"l", "I", "1"} and looks.readings("é") == set()
    assert case_by_table("Ꭺbc", looks) and not case_by_table("Ꭺbc")


def test_trie_costs():
    trie = K.Trie()
    for token, n in (("Quulzarac", 5), ("quulzarac", 2), ("fièvre", 9), ("fievre", 1), ("flijelata", 1)):
        trie.add(token, n)
    assert trie.best("Quulzarас") == ("Quulzarac", 0.0, 2)
    assert trie.best("fiè​vrе") == ("fièvre", 0.0, 2)
    assert trie.best("ﬂijelata") == ("flijelata", 0.0, 1)
    assert trie.best("FIÈVRЕ").spelling == "fièvre"
    assert trie.best("fièvre").looked == 0
    assert trie.best("zzz") is None and trie.best("fièvrex") is None


def test_no_case_at_all(spark):
    df = spark.createDataFrame([("entities", "a", "фишагагу"), ("entities", "b", "α-darvegaine")], "tbl string, row_id string, value string")
    assert rows(K.lookalike_rows(df)) == []


def test_rows(spark):
    values = ["Port Quulzarac", "Port Quulzarас", "саѕ", "cas", "соус", "Ｐｏｒｔ", None, "", "α-x"] + ["autre"] * 50 + ["autrе"] * 20
    data = [("entities", k, v, 1) for k, v in enumerate(values)] + [("entities", 1, values[1], 1)]
    df = spark.createDataFrame(data, "tbl string, row_id long, value string, canonical int")
    got = {(r.row_id): r.canonical for r in K.lookalike_rows(df).collect()}
    assert {k: v for k, v in got.items() if k < 59} == {1: "Port Quulzarac", 2: "cas", 5: "Port"}
    assert {v for k, v in got.items() if k >= 59} == {"autre"} and len(got) == 23
    assert rows(K.lookalike_rows(df.limit(0))) == []


def test_the_trie_decides(spark):
    """Tokens that only the vocabulary tells from ordinary ones, and characters of which it chooses the reading."""
    values = ["coco ici", "сосо", "сосу", "Ibis", "Ӏbis", "lilas", "ӏilas", "Ꭺnnexe", "Annexe", "TGFβ", "TGFB"]
    data = [("entities", k, v) for k, v in enumerate(values)]
    df = spark.createDataFrame(data, "tbl string, row_id long, value string")
    found = {r.row_id: r.canonical for r in K.lookalike_rows(df).collect()}
    assert found == {1: "coco", 4: "Ibis", 6: "lilas", 7: "Annexe"}
    tokens = K.canonical_tokens(df.selectExpr("value", "1L as n"), K.public_looks(spark))
    assert {r.token for r in tokens.collect() if r.matched and r.odd_one} == {"сосо", "Ӏbis", "ӏilas", "Ꭺnnexe"}


def test_without_the_trie_cases_are_lost():
    trie = K.Trie()
    trie.add("coco", 1)
    assert K.by_match("сосо", trie.best("сосо")) and not K.by_table("сосо")
    trie.add("Soyé", 1)
    assert trie.best("соуе") is None and not K.by_match("ѕоуе", trie.best("ѕоуе"))  # a word of its own script
