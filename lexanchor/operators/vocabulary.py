"""Medical vocabulary: term indexes, staged lookup and deterministic picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexanchor.functions import text as T
from lexanchor.operators import cascade as C


def index_key(term: Column) -> Column:
    """The English index's key: trimmed, lower, composed, straight quotes."""
    return F.translate(T.nfc(F.lower(F.trim(term))), T.CURLY_SINGLE + T.CURLY_DOUBLE, "''\"\"")


def _terms(df: DataFrame, ui: str, kind: str) -> DataFrame:
    rows = df.where(F.col(ui).isNotNull()).groupBy(ui).agg(F.min(F.struct(*[c for c in df.columns if c != ui])).alias("r"))
    mapped = F.col("r.mapped_to") if "mapped_to" in df.columns else F.array().cast("array<string>")
    concept = rows.select(F.col(ui).alias("ui"), mapped.alias("mapped_to"), F.posexplode("r.concepts").alias("concept_pos", "c"))
    return concept.select(
        "ui", "mapped_to", "concept_pos", F.col("c.ui").alias("cui"), F.coalesce("c.preferred", F.lit(False)).alias("preferred"),
        F.posexplode("c.terms").alias("term_pos", "term"), F.lit(kind).alias("type"),
    )


def term_index(descriptors: DataFrame, supplementals: DataFrame) -> DataFrame:
    """One row per (concept, term); ``ord`` orders entries of a key, descriptors before supplementals."""
    rows = _terms(descriptors, "dui", "descriptor").unionByName(_terms(supplementals, "sui", "supplemental"))
    rows = rows.withColumn("key", index_key(F.col("term"))).where("key <> ''")
    first = F.when(F.col("type") == "descriptor", 0).otherwise(1)
    return rows.select(
        "key", "type", "ui", "cui", "preferred", "mapped_to", F.struct(first.alias("t"), "ui", "concept_pos", "term_pos").alias("ord")
    )


def concept_map(descriptors: DataFrame, order: str) -> DataFrame:
    """The descriptor of each concept; of several the one that comes last in the given order of records."""
    rows = descriptors.where("dui is not null").select("dui", F.col(order).alias("_order"), F.posexplode("concepts.ui").alias("pos", "cui"))
    return rows.where("cui is not null").groupBy("cui").agg(F.max_by("dui", F.struct("_order", "pos")).alias("dui"))


def twin_index(terms: DataFrame) -> DataFrame:
    """Two keys per term, normal and unaccented, with the distinct ids of each key in first-seen order."""
    norm = T.normalize("term")
    both = terms.select("id", "ord", norm.alias("n")).select(
        "id", "ord", F.explode(F.array_distinct(F.array(F.col("n"), T.remove_accents("n")))).alias("key")
    )
    return both.where("key <> ''").groupBy("key", "id").agg(F.min("ord").alias("ord"))


def bilingual_names(records: DataFrame) -> DataFrame:
    """``(id, fr, en, synonyms, synonyms_en, cats)``: of the first three and two synonyms those that aren't empty."""

    def first(name: str, n: int) -> Column:
        listed = F.slice(F.coalesce(name, F.array().cast("array<string>")), 1, n)
        return F.filter(listed, lambda x: x.isNotNull() & (x != ""))

    blank = F.lit("")
    return records.select(
        "id", F.coalesce("trx", blank).alias("fr"), F.coalesce("eng", blank).alias("en"), first("xtr_cs", 3).alias("synonyms"), first("xtr_en", 2).alias("synonyms_en"),
        F.coalesce("cat", F.array().cast("array<string>")).alias("cats"),
    )


def spoken_names(named: DataFrame) -> DataFrame:
    """``(id, ord, name)`` of E8 for prompts and the strain rule: both names, then the synonyms, none twice."""
    every = F.array_distinct(F.filter(F.concat(F.array("fr", "en"), "synonyms", "synonyms_en"), lambda x: x != ""))
    return named.select("id", F.posexplode(every).alias("ord", "name"))


def term_stages(mentions: DataFrame) -> DataFrame:
    """The four keys of distinct mentions: normal, unaccented, Greek by name, and both."""
    norm = mentions.select("mention", T.normalize("mention").alias("norm"))
    norm = norm.withColumn("plain", T.remove_accents("norm"))
    stages = [(0, F.col("norm")), (1, F.col("plain")), (2, T.transliterate_greek("norm")), (3, T.transliterate_greek("plain"))]
    return C.staged_keys(norm, stages, ["mention"])


def pick_entry(entries: DataFrame) -> DataFrame:
    """Per key the id: descriptors first, preferred first, then order; a supplemental as "mapped : id"."""
    rank = F.struct(
        F.when(F.col("type") == "descriptor", 0).otherwise(1).alias("t"),
        F.when((F.col("type") == "descriptor") & ~F.col("preferred"), 1).otherwise(0).alias("p"),
        F.col("ord"), F.col("type"), F.col("ui"), F.col("mapped_to"),
    )
    best = entries.groupBy("key").agg(F.min(rank).alias("b"))
    mapped = F.try_element_at("b.mapped_to", F.lit(1))
    return best.select(
        "key",
        F.when((F.col("b.type") == "supplemental") & (F.coalesce(mapped, F.lit("")) != ""), F.concat(mapped, F.lit(" : "), "b.ui"))
        .otherwise(F.col("b.ui"))
        .alias("id"),
    )


# Labels that a category letter is compatible with.
COMPATIBLE = {
    "c": ("INF_DISEASE", "NON_INF_DISEASE", "DIS_REF_TO_PATH", "PATH_REF_TO_DIS"),
    "b": ("PATHOGEN", "PATH_REF_TO_DIS", "DIS_REF_TO_PATH"),
    "d": ("BIO_TOXIN", "PATHOGEN"),
}


def compatible(cats: Column, label: Column) -> Column:
    """Whether any category of the id suits the label."""
    tests = [F.array_contains(cats, c) & label.isin(*labels) for c, labels in COMPATIBLE.items()]
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return F.coalesce(out, F.lit(False))


def pick_compatible(candidates: DataFrame, by: list[str]) -> DataFrame:
    """The only id, else the first compatible one in order, else the first; needs ``id, ord, compat``."""
    rank = F.struct(F.when(F.col("compat"), 0).otherwise(1).alias("c"), "ord", "id")
    return candidates.groupBy(*by).agg(F.min(rank).alias("b"), F.countDistinct("id").alias("n")).select(*by, F.col("b.id").alias("id"), "n")


def link_terms(mentions: DataFrame, entries: DataFrame) -> DataFrame:
    """C4 without language model: ``(mention, stage, key, id)`` of distinct mentions by the staged index."""
    keys = term_stages(mentions.select("mention").where("mention is not null").distinct())
    first = C.first_stage(keys, entries.select("key").distinct(), ["mention"])
    wanted = first.select("key").distinct()
    return first.join(pick_entry(entries.join(wanted, "key", "left_semi")), "key").select("mention", "stage", "key", "id")
