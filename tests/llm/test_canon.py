import random

import numpy as np

from lexanchor.llm import canon as K
from tests.conftest import rows

NAMES = ["Port-Quulzarac", "Haut-Dolgramy", "São Canrîelle", "maladie de Bijêlbo", "venin de moquélrou", "Saint-Ratebourg-sur-Lounpil", "noflêvîsose", "Zoquouères", "Tennîsmaia baitenoides", "Cènroigny-en-Nôci"]


def spoil(rng, text):
    i = rng.randrange(1, len(text) - 2)
    kind = rng.randrange(3)
    return text[:i] + text[i + 1 :] if kind == 0 else text[:i] + text[i] + text[i:] if kind == 1 else text[:i] + text[i + 1] + text[i] + text[i + 2 :]


def test_edits():
    assert K.edits_within("abc", "xxabcxx") == 0
    assert K.edits_within("abcd", "xxabdcx") == 1
    assert K.edits_within("abc", "") == 3


def test_links_and_blocks(spark):
    rng = random.Random(2)
    refs = spark.createDataFrame([(f"R{k}", n, "place" if k % 2 else "medical", "x") for k, n in enumerate(NAMES)] + [(None, "x", "place", "x"), ("R99", None, "place", "x")], "ref_id string, ref_name string, kind string, value string")
    data, want = [], {}
    for k in range(200):
        at = rng.randrange(len(NAMES))
        text = rng.choice(["", "environs de ", "cas de "]) + spoil(rng, NAMES[at]) + rng.choice(["", " (?)", "*", "."])
        data.append(("entities", k, text.upper() if k % 5 == 0 else text, None))
        want[k] = f"R{at}"
    for k, text in enumerate(["autre", "non renseigné", "Flumbrouzistagne", "", None, "???"], 1000):
        data.append(("entities", k, text, ""))
        want[k] = ""
    data += [("entities", 2000, NAMES[1], "medical"), ("place_names", 2000, NAMES[1], "place"), data[0]]
    df = spark.createDataFrame(data, "tbl string, row_id long, value string, kind string")
    both = []
    for most in (20_000, 3):  # broadcast, and joined by n-gram
        got = {(r.tbl, r.row_id): r.ref_id for r in K.link_values(df, refs, most_entries=most).collect()}
        both.append(got)
        assert len(got) == len(want) + 2
        assert got["place_names", 2000] == "R1" and got["entities", 2000] == ""  # the kind restricts the list
        wrong = [k for k, v in want.items() if got["entities", k] != v]
        assert len(wrong) <= 4 and not [k for k in wrong if k >= 1000 and got["entities", k]]
    assert both[0] == both[1]
    assert {r.ref_id for r in K.link_values(df, refs.limit(0)).collect()} == {""}
    assert rows(K.link_values(df.limit(0), refs)) == []


def test_every_entry_counts():
    """No cap on candidates: the best and the next entry are those of a scan of the whole list."""
    rng = random.Random(4)
    names = sorted({"".join(rng.choice(["mo", "ra", "ti", "lu", "be"]) for _ in range(5)) for _ in range(400)})
    weights = np.log(1 + 500 / (1 + np.random.default_rng(0).integers(0, 50, 1 << K.GRAM_BITS)))
    index = K.ListIndex([(f"R{k:03}", "", n, n) for k, n in enumerate(names)], weights)
    for _ in range(60):
        key = spoil(rng, rng.choice(names))
        every = sorted(((-K.cosine(key, n, weights), f"R{k:03}") for k, n in enumerate(names)))
        k, top, second = index.best(key, "")
        assert (index.ids[k], top) == (every[0][1], -every[0][0])
        assert second == (-every[1][0] if -every[1][0] >= K.FLOOR else 0.0)
        taken = set(K.rarest_grams(key, weights).tolist())
        assert all(taken & set(K.rarest_grams(n, weights).tolist()) for n in names if K.cosine(key, n, weights) >= K.FLOOR)


def test_margin_is_needed():
    assert not K.accepts("moratilu", "moratilu", "moratilu", 0.9, 0.88, frozenset())
    assert not K.accepts("moratilu", "moratilu", "moratilu", 0.25, 0.23, frozenset())
    assert K.accepts("moratilu", "moratilu", "moratilu", 0.25, 0.2, frozenset())


def test_several_names_of_one_id(spark):
    refs = spark.createDataFrame([("R1", "Port-Quulzarac", "place"), ("R1", "Quulzarac-le-Port", "place"), ("R2", "Haut-Dolgramy", "place")], "ref_id string, ref_name string, kind string")
    df = spark.createDataFrame([("entities", 1, "Port Quulzarac", "place"), ("entities", 2, "Dolgramy haut", None)], "tbl string, row_id long, value string, kind string")
    for most in (20_000, 1):
        assert rows(K.link_values(df, refs, most_entries=most)) == [("entities", 1, "R1"), ("entities", 2, "R2")]
