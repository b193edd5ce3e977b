"""Ordered fallback lookups: all keys of a mention in one join, of which the first stage that hits wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexanchor.functions import text as T


def staged_keys(mentions: DataFrame, stages: list[tuple[int, Column]], by: list[str]) -> DataFrame:
    """One row per mention, stage and key; nulls and blanks give none, a key counts in its first stage only."""
    pairs = F.array(*[F.struct(F.lit(stage).alias("stage"), key.alias("key")) for stage, key in stages])
    return (
        mentions.select(*by, F.explode(pairs).alias("s"))
        .select(*by, "s.stage", "s.key")
        .where("key is not null and key <> ''")
        .groupBy(*by, "key")
        .agg(F.min("stage").alias("stage"))
    )


def first_stage(keys: DataFrame, dim_keys: DataFrame, by: list[str]) -> DataFrame:
    """The key of the first stage that ``dim_keys(key)`` holds, for each mention; ``dim_keys`` is distinct.

    Only keys meet the dimension, by a semi join, so that hot keys multiply nothing.
    """
    hit = keys.join(dim_keys.select("key"), "key", "left_semi")
    best = hit.groupBy(*by).agg(F.min(F.struct("stage", "key")).alias("s"))
    return best.select(*by, "s.stage", "s.key")


# The stages of the place cascade.
EXACT, STRIPPED, PLAIN, STRIPPED_PLAIN, TAIL, BARE, HYPHEN, CACHE = 1, 2, 3, 4, 10, 100, 110, 120


def place_keys(mentions: DataFrame, fallbacks: bool = True) -> DataFrame:
    """The keys of distinct mentions ``(mention)`` in the order of the place cascade."""
    norm = mentions.select("mention", T.normalize("mention").alias("norm"))
    norm = norm.withColumns({"plain": T.remove_accents("norm"), "stripped": T.strip_prefix("norm")})
    norm = norm.withColumn("stripped_plain", T.remove_accents("stripped"))
    stages = [
        (EXACT, F.col("norm")), (STRIPPED, F.col("stripped")), (PLAIN, F.col("plain")), (STRIPPED_PLAIN, F.col("stripped_plain")),
    ]
    if fallbacks:
        bare = T.strip_bare_admin("norm")
        changed = F.when(bare != F.col("norm"), bare)
        stages += [(BARE, changed), (BARE + 1, T.remove_accents(changed))]
        for k, form in enumerate((T.hyphen_to_space("norm"), T.hyphen_to_space("plain"))):
            stages.append((HYPHEN + k, F.when((form != F.col("norm")) & (form != F.col("plain")), form)))
    keys = staged_keys(norm, stages, ["mention"])
    ends = norm.select("mention", F.posexplode(T.tails("norm")).alias("pos", "key")).select(
        "mention", "key", (F.col("pos") + TAIL).alias("stage")
    )
    return keys.unionByName(ends).groupBy("mention", "key").agg(F.min("stage").alias("stage"))


def by_first_hit(mentions: DataFrame, lookups: list[tuple[list[str], DataFrame, str]], out: str) -> DataFrame:
    """Left equi-joins in order, of which the first non-empty value wins.

    ``lookups`` are (join columns, dimension, value column); dimensions have one row per key.
    """
    values = []
    for k, (on, dim, value) in enumerate(lookups):
        mentions = mentions.join(dim.select(*on, F.col(value).alias(f"_v{k}")), on, "left")
        values.append(F.nullif(F.col(f"_v{k}"), F.lit("")))
    return mentions.withColumn(out, F.coalesce(*values)).drop(*[f"_v{k}" for k in range(len(lookups))])


def mode_by(df: DataFrame, by: list[str], value: str, position: str) -> DataFrame:
    """A1: the commonest non-empty value per group; a tie goes to the one seen first, then to the lesser."""
    counted = (
        df.where((F.col(value).isNotNull()) & (F.col(value) != ""))
        .groupBy(*by, value)
        .agg(F.count("*").alias("n"), F.min(position).alias("first"))
    )
    best = counted.groupBy(*by).agg(F.min(F.struct(-F.col("n"), "first", value, "n")).alias("b"))
    return best.select(*by, F.col(f"b.{value}").alias(value), F.col("b.n").alias("n"))


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
