import random

import pytest
from pyspark.sql import functions as F

from lexanchor.operators import cascade as C
from lexanchor.operators import places as P
from tests.conftest import rows

LOCATIONS = [  # id, name, ascii, country, class, code, population, lat, lon
    ("1", "Aix", "Aix", "FR", "P", "PPL", 100, 10.0, 10.0), ("2", "Aix", "Aix", "FR", "A", "ADM4", 95, 10.01, 10.0), ("3", "Aix", "Aix", "FR", "A", "ADM1", 50, 40.0, 10.0),
    ("4", "Bor", "Bor", "RS", "P", "PPL", 10, 1.0, 1.0), ("5", "Cité", "Cite", "FR", "P", "PPLC", 5, 2.0, 2.0), ("6", "Cité", "Cite", "FR", "P", "PPL", 50, 2.001, 2.0),
    ("7", "Dor", "Dor", "DO", "A", "PCLI", 1, 3.0, 3.0), ("8", "Dor", "Dor", "XX", "P", "PPL", 99, 3.0, 3.0), ("9", "Eve", "Eve", "FR", "R", "RD", 0, 4.0, 4.0),
    ("10", "Far Off", "Far Off", "FR", "P", "PPL", 0, None, None), ("11", "Far Off", "Far Off", "FR", "A", "ADM3", 7, None, None), ("12", "Gem", "Gem", "FR", "A", "ADM3", 5, 5.0, 5.0),
    ("13", "Gem", "Gem", "FR", "P", "PPL", 0, 6.0, 6.0), ("14", "Hua", "Hua", "FR", "P", "PPL", 0, 5.0, 5.0), ("15", "Hua", "Hua", "FR", "P", "PPL", 0, 7.0, 7.0),
]
NAMES = [("grande comore", "4", ""), ("eve-lyn", "9", ""), ("nil", None, "")]


def kb(spark):
    schema = "geonameid string, name string, asciiname string, country_code string, feature_class string, feature_code string, population long, latitude double, longitude double"
    locations = spark.createDataFrame(LOCATIONS, schema)
    return locations.unionByName(locations.limit(3)), spark.createDataFrame(NAMES, "name_lower string, geonameid string, lang string")


@pytest.fixture(scope="module")
def link(spark):
    locations, names = kb(spark)
    n, p = P.name_dimension(locations, names), P.place_dimension(locations)

    def run(*mentions, **settings):
        df = spark.createDataFrame([(m,) for m in mentions], "mention string")
        return {r.mention: (r.stage, r.geonameid) for r in P.link_places(df, n, p, **settings).collect()}

    return run


def test_stages_and_choices(link):
    found = link(
        "Aix", "AIX ", "région de Aix", "la ville de Bor", "Cite", "cîté", "Dor", "grande-comore", "commune Bor", "au nord de Bor", "eve", "eve lyn", "Gem", "Hua", "Far Off", "nothing", "", None
    )
    assert found["Aix"] == (C.EXACT, "2")  # the municipality has nearly the same population as the town
    assert found["AIX "] == (C.EXACT, "2")
    assert found["région de Aix"] == (C.STRIPPED, "2")  # asked for a unit: the most populous one
    assert found["la ville de Bor"] == (C.STRIPPED, "4")
    assert found["Cite"] == (C.EXACT, "5") and found["cîté"] == (C.PLAIN, "5")  # the seat of the same place
    assert found["Dor"] == (C.EXACT, "7")  # a country goes first
    assert found["grande-comore"] == (C.HYPHEN, "4")
    assert found["commune Bor"] == (C.BARE, "4")
    assert found["au nord de Bor"] == (C.TAIL, "4")
    assert found["eve"] == (C.EXACT, "9")  # roads are kept by the first stages
    assert "eve lyn" not in found  # but not by the fallbacks
    assert found["Gem"] == (C.EXACT, "12")
    assert found["Hua"] == (C.EXACT, "14")  # nobody lives there: the first in order
    assert found["Far Off"] == (C.EXACT, "11")
    assert "nothing" not in found and "" not in found


def test_fallbacks_only_add_links(link):
    mentions = ["Aix", "commune Bor", "grande-comore", "région de Aix", "x"]
    off, on = link(*mentions, fallbacks=False), link(*mentions)
    assert off.items() <= on.items() and set(on) - set(off) == {"commune Bor", "grande-comore"}


def test_ranking_does_not_depend_on_row_order(spark):
    rng = random.Random(5)
    results = set()
    for _ in range(3):
        data = LOCATIONS[:]
        rng.shuffle(data)
        schema = "geonameid string, name string, asciiname string, country_code string, feature_class string, feature_code string, population long, latitude double, longitude double"
        locations = spark.createDataFrame(data, schema).repartition(3)
        n, p = P.name_dimension(locations, spark.createDataFrame(NAMES, "name_lower string, geonameid string, lang string")), P.place_dimension(locations)
        df = spark.createDataFrame([("Aix",), ("Cité",), ("Dor",), ("Hua",), ("Gem",)], "mention string")
        results.add(tuple(rows(P.link_places(df, n, p).select("mention", "geonameid"))))
    assert len(results) == 1


def test_pool_keeps_kept_codes_beyond_its_size(spark):
    data = [(f"{k:03d}", "Z", "Z", "FR", "P", "PPL", 1000 - k, 1.0, 1.0) for k in range(80)] + [("900", "Z", "Z", "FR", "A", "ADM2", 0, 1.0, 1.0)]
    schema = "geonameid string, name string, asciiname string, country_code string, feature_class string, feature_code string, population long, latitude double, longitude double"
    locations = spark.createDataFrame(data, schema)
    names = P.name_dimension(locations, spark.createDataFrame([], "name_lower string, geonameid string, lang string"))
    pool = P.candidate_pool(spark.createDataFrame([("z",)], "key string"), names, P.place_dimension(locations))
    assert pool.count() == P.POOL_SIZE + 1 and pool.orderBy("pool_rank").first().geonameid == "900"


def test_mode_breaks_ties_by_first_seen(spark):
    df = spark.createDataFrame([("k", "b", 1), ("k", "a", 2), ("k", "a", 3), ("k", "b", 4), ("k", "", 0), ("k", None, 0), ("m", "", 9)], "k string, v string, pos int")
    assert rows(C.mode_by(df, ["k"], "v", "pos")) == [("k", "b", 2)]


def test_first_hit(spark):
    m = spark.createDataFrame([("a", "p"), ("b", "q"), ("c", None)], "x string, y string")
    d1 = spark.createDataFrame([("a", ""), ("b", "B")], "x string, v string")
    d2 = spark.createDataFrame([("p", "P"), ("q", "Q")], "y string, v string")
    out = C.by_first_hit(m, [(["x"], d1, "v"), (["y"], d2, "v")], "id")
    assert rows(out.select("x", F.coalesce("id", F.lit("-")))) == [("a", "P"), ("b", "B"), ("c", "-")]


def test_pool_without_windows_equals_the_numbered_one(spark):
    rng = random.Random(7)
    codes = ["PPL", "ADM4", "ADM3", "PPLC", "PPLA", "ADM1", "PCLI", "STM", None]
    data = []
    for k in range(900):
        key = "hot" if k % 3 == 0 else f"k{rng.randrange(40)}"  # one key holds a third of the rows
        at = rng.choice([(1.0, 1.0), (1.01, 1.0), (50.0, 3.0), (None, None)])
        data.append((key, rng.random() < 0.5 if key != "hot" else True, f"{k:04d}", rng.choice(["A, x", "A", "B", None]), rng.choice(["FR", None]), "P", rng.choice(codes[:5] if key == "k1" else codes), rng.choice([0, 0, 5, 95, 100, None]), *at))
    schema = "key string, wants_admin boolean, geonameid string, name string, country_code string, feature_class string, feature_code string, population long, latitude double, longitude double"
    found = spark.createDataFrame(data, schema).repartition(4)
    by = ["key", "wants_admin"]
    assert P.pool_rows(found, by, 4).count() == P.rank_pool(found, by).count()
    assert rows(P.choose_place(P.pool_rows(found, by, 4), by)) == rows(P.choose_place(P.rank_pool(found, by), by))
