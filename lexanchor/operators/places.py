"""Place linking: candidate pools, deterministic disambiguation, and reconciliation of one place's records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexanchor.functions import text as T
from lexanchor.functions.geo import haversine_km, population_ratio
from lexanchor.operators import cascade as C
from lexanchor.session import cut_lineage

# Feature codes that are always kept, of countries, of administrative units, of seats.
KEPT_CODES = ("PCLI", "PCLD", "PCLF", "ADM1", "ADM2", "RGN", "PPLC", "PPLA", "PPLA2", "PPLA3")
COUNTRY_CODES = ("PCLI", "PCLD", "PCLF")
ADMIN_CODES = ("ADM1", "ADM2", "ADM3", "ADM4", "RGN")
SEAT_CODES = ("PPLC", "PPLA", "PPLA2")
POOL_SIZE, SAME_PLACE_KM, SAME_POPULATION = 50, 5.0, 0.80
PLACE_COLUMNS = ["geonameid", "name", "country_code", "feature_class", "feature_code", "population", "latitude", "longitude"]


def place_dimension(locations: DataFrame) -> DataFrame:
    """One row per id; of several the one with the least attributes in a fixed order."""
    rest = [c for c in PLACE_COLUMNS if c != "geonameid"]
    return (
        locations.where("geonameid is not null")
        .groupBy("geonameid")
        .agg(F.min(F.struct(*[F.col(c) for c in rest])).alias("p"))
        .select("geonameid", *[F.col(f"p.{c}").alias(c) for c in rest])
    )


def name_dimension(locations: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct ``(key, geonameid)`` of names, plain names and aliases."""
    own = locations.select("geonameid", F.explode(F.array("name", "asciiname")).alias("key"))
    key = F.lower(F.trim("key"))
    return (
        own.unionByName(names.select("geonameid", F.col("name_lower").alias("key")))
        .select("geonameid", key.alias("key"))
        .where("geonameid is not null and key is not null and key <> ''")
        .distinct()
    )


def alias_bag(locations: DataFrame, names: DataFrame) -> DataFrame:
    """E1 with E2 added: ``(geonameid, key)`` of each place's own names, each once a place, and of every alias row as it is.

    An alias that repeats a place's own name or another alias stays; only rows that were
    delivered again, with the same ``name_id``, count once.
    """
    own = F.array_distinct(F.transform(F.array_compact(F.array("name", "asciiname")), lambda x: F.lower(F.trim(x))))
    places = locations.select("geonameid", "name", "asciiname").distinct().select("geonameid", F.explode(own).alias("key")).distinct()
    aliases = names.select("name_id", "geonameid", F.lower(F.trim("name_lower")).alias("key")).distinct().drop("name_id")
    return places.unionByName(aliases).where("geonameid is not null and key is not null and key <> ''")


def candidate_pool(keys: DataFrame, names: DataFrame, places: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Candidates of each key; all of the kept codes, then the most populous up to the pool's size.

    ``pool_rank`` gives a total order: kept codes first, population, then the id.
    """
    return rank_pool(keys.join(names, "key").join(places, "geonameid"), by or ["key"])


def rank_pool(found: DataFrame, by: list[str], salts: int = 64) -> DataFrame:
    """R1 of candidates that are joined already.

    Salted parts of a group are cut to the pool's size first, so that no task sees a whole one;
    what is beyond that size in its part is so in the group.
    """
    order = [F.col("population").desc_nulls_last(), F.col("geonameid")]
    found = found.withColumns({"kept": F.coalesce(F.col("feature_code").isin(*KEPT_CODES), F.lit(False)), "_salt": F.pmod(F.xxhash64("geonameid"), F.lit(salts))})
    parts = C.ranked(found, [*by, "_salt"], order, "_r").where(F.col("kept") | (F.col("_r") <= POOL_SIZE)).drop("_r", "_salt")
    w = Window.partitionBy(*by)
    return (
        parts.withColumn("_all", F.row_number().over(w.orderBy(*order)))
        .where(F.col("kept") | (F.col("_all") <= POOL_SIZE))
        .withColumn("pool_rank", F.row_number().over(w.orderBy(F.col("kept").desc(), *order)))
        .withColumn("pool_order", F.col("pool_rank"))
        .drop("_all")
    )


def pool_rows(found: DataFrame, by: list[str], salts: int = 64) -> DataFrame:
    """R1 without numbering the pool: the same rows with ``pool_order``, which sorts as ``pool_rank`` does.

    No task sees a whole group: kept codes pass without a window, and the most populous are
    found within salted parts of the group first.
    """
    found = found.withColumn("kept", F.coalesce(F.col("feature_code").isin(*KEPT_CODES), F.lit(False)))
    order = [F.col("population").desc_nulls_last(), F.col("geonameid")]
    parts = found.withColumn("_salt", F.pmod(F.xxhash64("geonameid"), F.lit(salts)))
    top = C.ranked(parts, [*by, "_salt"], order, "_r").where(F.col("_r") <= POOL_SIZE).drop("_r", "_salt")
    top = C.ranked(top, by, order, "_r").where((F.col("_r") <= POOL_SIZE) & ~F.col("kept")).drop("_r")
    people = F.col("population")
    key = F.struct((~F.col("kept")).alias("k"), people.isNull().alias("u"), (-F.coalesce(people, F.lit(0))).alias("p"), F.col("geonameid").alias("id"))
    return found.where("kept").unionByName(top).withColumn("pool_order", key)


def heuristic_order(wants: str = "wants_admin") -> list:
    """R3 as one total order: country, wanted unit, inhabited and no ADM3, inhabited, the rest; then the pool's order."""
    code, people = F.col("feature_code"), F.coalesce("population", F.lit(0))
    tier = (
        F.when(code.isin(*COUNTRY_CODES), 0)
        .when(F.col(wants) & code.isin(*ADMIN_CODES), 1)
        .when((people > 0) & (F.coalesce(code, F.lit("")) != "ADM3"), 2)
        .when(people > 0, 3)
        .otherwise(4)
    )
    return [tier, F.when(tier < 4, -people).otherwise(0), F.col("pool_rank")]


def choose_place(pool: DataFrame, by: list[str], picked: str | None = None) -> DataFrame:
    """The chosen id per group of a pool with ``wants_admin`` and ``pool_order``, and the id before reconciliation.

    The id in the column ``picked``, if one is named, is put before the heuristic's choice.

    Two aggregations that combine before the shuffle, with the first choice joined back between
    them; no window holds a group.
    """
    tier, size = heuristic_order()[:2]
    if picked:
        tier = F.when(F.col("geonameid") == F.col(picked), -1).otherwise(tier)
    first = pool.groupBy(*by).agg(
        F.count("*").alias("n"), F.max("wants_admin").alias("wants"),
        F.min(F.struct(tier.alias("t"), size.alias("s"), "pool_order", F.struct(*PLACE_COLUMNS).alias("c"))).alias("m"),
    ).select(*by, "n", "wants", "m.c")
    here = F.col("c.latitude").isNotNull() & F.col("c.longitude").isNotNull()
    near = F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & (
        haversine_km(F.col("c.latitude"), F.col("c.longitude"), F.col("latitude"), F.col("longitude")) < SAME_PLACE_KM
    )
    namesake = F.col("country_code").eqNullSafe(F.col("c.country_code")) & T.head_token("name").eqNullSafe(T.head_token("c.name"))
    both = pool.join(first.select(*by, "c"), by)
    same = both.where(F.when(here, near).otherwise(namesake))

    def best(condition):
        people = F.coalesce("population", F.lit(0))
        return F.min(F.when(condition, F.struct((-people).alias("p"), "pool_order", F.col("geonameid").alias("id"))))

    code = F.col("feature_code")
    found = same.groupBy(*by).agg(
        F.count("*").alias("n_same"), best(code.isin(*ADMIN_CODES)).alias("admin"), best(code.isin(*SEAT_CODES)).alias("seat"), best(code == "ADM4").alias("adm4")
    )
    grouped = first.join(found, by, "left")
    twin = (F.col("c.feature_code") == "PPL") & (population_ratio(-F.col("adm4.p"), F.col("c.population")) > SAME_POPULATION)
    own = F.col("c.geonameid")
    final = (
        F.when((F.col("n") == 1) | (F.coalesce("n_same", F.lit(0)) <= 1), own)
        .when(F.col("wants"), F.coalesce("admin.id", own))
        .when(F.col("seat").isNotNull(), F.col("seat.id"))
        .when(F.col("adm4").isNotNull() & twin, F.col("adm4.id"))
        .otherwise(own)
    )
    return grouped.select(*by, own.alias("first_choice"), final.alias("geonameid"), F.col("n").alias("n_candidates"))


#: Columns by which mentions share a pool.
POOL_BY = ["key", "wants_admin", "guarded"]


def place_pools(mentions: DataFrame, names: DataFrame, places: DataFrame, fallbacks: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(mention, stage, key, wants_admin, guarded)`` of every mention that some stage finds, and the pools by the last three.

    Pools are ranked once per key and not per mention. The fallback stages skip roads and buildings.
    """
    mentions = mentions.select("mention").where("mention is not null").distinct()
    keys = cut_lineage(C.place_keys(mentions, fallbacks))
    # the dimensions are cut to the mentions' keys before they meet each other
    hits = names.join(keys.select("key").distinct(), "key", "left_semi")
    candidates = cut_lineage(hits.join(places, "geonameid"))  # read three times below
    solid = ~F.coalesce(F.col("feature_class").isin("R", "S"), F.lit(False))
    known = candidates.groupBy("key").agg(F.max(solid).alias("solid"))
    hit = keys.join(known, "key").where((F.col("stage") < C.BARE) | F.col("solid"))
    first = hit.groupBy("mention").agg(F.min(F.struct("stage", "key")).alias("s")).select("mention", "s.stage", "s.key")
    first = first.withColumns({"wants_admin": T.wants_admin("mention"), "guarded": F.col("stage") >= C.BARE})
    pool = pool_rows(first.select(*POOL_BY).distinct().join(candidates, "key"), POOL_BY)
    return first, cut_lineage(pool.where(~F.col("guarded") | solid))  # read twice by the choice


def link_places(mentions: DataFrame, names: DataFrame, places: DataFrame, fallbacks: bool = True) -> DataFrame:
    """``(mention, stage, key, geonameid)`` of every distinct mention that some stage finds; mentions are linked once each."""
    first, pool = place_pools(mentions, names, places, fallbacks)
    return first.join(choose_place(pool, POOL_BY), POOL_BY).select("mention", "stage", "key", "first_choice", "geonameid", "n_candidates")
