import random
import re

import pytest

from lexanchor.llm import garble as G
from tests.conftest import rows

WORDS = "été à la fièvre hémorragique près de l'hôpital São Île décès signalés au août reçu modérées § ° ± µg âgées où naïf Noël maladie toxine α-chaumine".split()


@pytest.fixture(scope="module")
def clean():
    rng = random.Random(0)
    return [" ".join(rng.choice(WORDS) for _ in range(30)) for _ in range(300)]


@pytest.fixture(scope="module")
def model(spark, clean):
    return G.fit(spark.createDataFrame([(t,) for t in clean], "text string"), held_out=8)


@pytest.mark.parametrize(("read", "written"), [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp850", "utf-8"), ("mac_roman", "utf-8"), ("cp437", "utf-8"), ("cp1251", "utf-8"), ("cp1252", "cp850"), ("latin-1", "mac_roman")])
def test_round_trip(model, read, written):
    for word in ("fièvre", "hémorragique", "décès", "près"):
        assert model.restore(G._garble(word, read, written)) == word


def test_twice_and_lower_case(model):
    once = G._garble("décès", "cp1252", "utf-8")
    assert model.restore(G._garble(once, "cp1252", "utf-8")) == "décès"
    assert model.restore(once.lower()) == "décès"


def test_clean_words_stay(model, clean):
    assert not [w for w in set(" ".join(clean).split()) if model.restore(w) != w]
    assert G.undo_utf8("« modérées » été 21 °C ± 1") == "« modérées » été 21 °C ± 1"


def test_rows(spark, model):
    data = [(1, "dÃ©cÃ¨s signalés", "x"), (2, "décès", "x"), (3, "d�c�s", "x"), (4, None, "x"), (5, "", "x"), (6, "plain", "x"), (1, "dÃ©cÃ¨s signalés", "x"), (7, "décès " * 5000 + "prÃ¨s", "x")]
    df = spark.createDataFrame(data, "doc_idx long, text string, restored string")
    got = rows(G.restore_rows(df, model, "doc_idx", "text"))
    assert got[:2] == [(1, "décès signalés"), (3, "d�c�s")] and got[2][0] == 7 and got[2][1].endswith("près") and len(got) == 3
    assert rows(G.restore_rows(df.limit(0), model, "doc_idx", "text")) == []


def test_no_case_at_all(spark, model):
    df = spark.createDataFrame([("a", "décès"), ("b", "été"), ("c", "plain")], "mention_id string, text string")
    assert rows(G.restore_rows(df, model, "mention_id", "text")) == []


def test_fit_on_nothing(spark):
    assert G.fit(spark.createDataFrame([("dÃ©cÃ¨s",), ("",), (None,)], "text string").repartition(4)).restore("été") == "été"
    assert G.fit(spark.createDataFrame([], "text string")).restore("été") == "été"


def test_pattern_keeps_whatever_can_change(model):
    pattern = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), model.pattern()).replace(r"\z", r"\Z"))
    changed = 0
    for word in WORDS:
        for read in G.READ_AS:
            for written in ("utf-8", "cp850", "cp1252", "mac_roman"):
                bad = G._garble(word, read, written)
                for form in (bad, bad and bad.lower(), bad and bad.upper(), bad and "\u200b".join(bad), bad and bad.rstrip("\xa0")):
                    if form and model.restore(form) != form:
                        changed += 1
                        assert pattern.search("x " + form + " y") and pattern.search(form)
    assert changed > 150
    assert not pattern.search("fièvre hémorragique à la maladie")


def test_margin_on_held_out_words(model):
    errors, trials = G.margin_errors(model, ["fièvre", "hémorragique", "âgées", "plain", "dÃ©cÃ¨s"])
    assert trials >= 6 and len(errors) == len(G.MARGINS)
    import numpy as np

    assert G.choose_margin(np.array([5, 0, 0, 3]), 10) == 3.0
