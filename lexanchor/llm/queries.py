"""Queries of the training-text problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexanchor.llm.bpe import encode_corpus
from lexanchor.llm.canon import link_values
from lexanchor.llm.garble import fit, restore_rows
from lexanchor.llm.leakage import find_leaks
from lexanchor.llm.lookalike import lookalike_rows
from lexanchor.llm.overlap import cross_split_overlaps, held_coverage, record_pairs
from lexanchor.llm.reading import reading_levels
from lexanchor.plans.registry import Registry
from lexanchor.session import table

REGISTRY = Registry()


@REGISTRY.add("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = cross_split_overlaps(table(spark, sf_dir, "corpus"))
    pairs = record_pairs(members, links)
    return pairs.select(
        F.least("train_doc", "held_doc").alias("doc_idx_a"), F.greatest("train_doc", "held_doc").alias("doc_idx_b")
    ).distinct()


@REGISTRY.add("p1_coverage")
def p1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and source: held-out records that stand in training, and how much of them is covered."""
    corpus = table(spark, sf_dir, "corpus")
    members, links = cross_split_overlaps(corpus)
    held = held_coverage(members, links)
    places = corpus.where("split in ('dev', 'test')").select("doc_idx", "split", "source").distinct()
    return (
        places.join(held, places["doc_idx"] == held["held_doc"], "left")
        .groupBy("split", "source")
        .agg(
            F.countDistinct("doc_idx").alias("records"),
            F.countDistinct("held_doc").alias("overlapping"),
            F.round(F.avg("cover"), 4).alias("mean_coverage"),
            F.coalesce(F.sum("partners"), F.lit(0)).alias("partners"),
        )
    )


def _mentions_and_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = table(spark, sf_dir, "entities").select(
        F.lit("entities").alias("tbl"), F.col("mention_id").alias("row_id"), F.col("text").alias("value")
    )
    aliases = table(spark, sf_dir, "place_names").select(
        F.lit("place_names").alias("tbl"), F.col("name_id").alias("row_id"), F.col("name_lower").alias("value")
    )
    return mentions.unionByName(aliases)


@REGISTRY.add("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("label").isNull(), "").when(F.col("label") == "LOCATION", "place").otherwise("medical")
    mentions = table(spark, sf_dir, "entities").where("id_kb is null").select(
        F.lit("entities").alias("tbl"), F.col("mention_id").alias("row_id"), F.col("text").alias("value"), kind.alias("kind")
    )
    aliases = table(spark, sf_dir, "place_names").where("geonameid is null").select(
        F.lit("place_names").alias("tbl"), F.col("name_id").alias("row_id"), F.col("name_lower").alias("value"), F.lit("place").alias("kind")
    )
    background = _mentions_and_aliases(spark, sf_dir).select("value")
    return link_values(mentions.unionByName(aliases), table(spark, sf_dir, "refnames"), background=background)


@REGISTRY.add("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_rows(_mentions_and_aliases(spark, sf_dir)).select("tbl", "row_id").distinct()


@REGISTRY.add("p5_canonical")
def p5_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases of p5_found with their one consistent form."""
    return lookalike_rows(_mentions_and_aliases(spark, sf_dir))


def _restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, entities = table(spark, sf_dir, "corpus"), table(spark, sf_dir, "entities")
    model = fit(corpus.select("text").unionByName(entities.select("text")))
    return (
        restore_rows(corpus, model, "doc_idx", "text")
        .select(F.lit("corpus").alias("tbl"), "row_id", "restored")
        .unionByName(restore_rows(entities, model, "mention_id", "text").select(F.lit("entities").alias("tbl"), "row_id", "restored"))
    )


@REGISTRY.add("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _restored(spark, sf_dir).select("tbl", "row_id").distinct()


@REGISTRY.add("p6_restored")
def p6_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases of p6_found with their text restored as far as possible."""
    return _restored(spark, sf_dir)


@REGISTRY.add("p8_ids")
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


@REGISTRY.add("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@REGISTRY.add("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_labels"))
