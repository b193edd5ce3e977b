"""Document-level passes: acronyms, nesting, validation of predictions, metrics and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexanchor.functions import text as T

SOURCES = ("GeoNames", "MeSH", "")


def defines(text: Column, expansion: Column, acronym: Column) -> Column:
    """Whether the text has "expansion (acronym)", whatever the case."""

    def quoted(x: Column) -> Column:
        return F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))

    pattern = F.concat(F.lit("(?iu)"), quoted(expansion), F.lit(r"\s*\(\s*"), quoted(acronym), F.lit(r"\s*\)"))
    return F.rlike(text, pattern)


def propagate_acronyms(entities: DataFrame, texts: DataFrame) -> DataFrame:
    """Unlinked acronyms take the id of a linked, longer mention of the same label that the document defines them by.

    ``entities(doc_idx, ent_idx, text, label, id_kb, source)``; the first such mention in order
    wins, and what was propagated doesn't propagate again. The document's text is joined only
    to the few candidate pairs.
    """
    linked = entities.where("source <> ''").select(
        "doc_idx", "label", F.col("ent_idx").alias("from_idx"), F.col("text").alias("expansion"), F.col("id_kb").alias("new_id"), F.col("source").alias("new_source")
    )
    open_ = entities.where((F.coalesce("source", F.lit("")) == "") & T.is_acronym("text")).select(
        "doc_idx", "label", "ent_idx", F.trim("text").alias("acronym")
    )
    pairs = open_.join(linked, ["doc_idx", "label"]).where(F.length("expansion") > F.length("acronym"))
    hit = pairs.join(texts.select("doc_idx", F.col("text").alias("doc_text")), "doc_idx").where(
        defines(F.col("doc_text"), F.col("expansion"), F.col("acronym"))
    )
    return (
        hit.groupBy("doc_idx", "ent_idx")
        .agg(F.min(F.struct("from_idx", "new_id", "new_source")).alias("b"))
        .select("doc_idx", "ent_idx", F.col("b.new_id").alias("id_kb"), F.col("b.new_source").alias("source"), F.col("b.from_idx").alias("from_idx"))
    )


def nest(entities: DataFrame) -> DataFrame:
    """Entities of each document as one array in their order."""
    fields = [c for c in entities.columns if c not in ("doc_idx",)]
    return entities.groupBy("doc_idx").agg(F.array_sort(F.collect_list(F.struct("ent_idx", *[c for c in fields if c != "ent_idx"]))).alias("entities"))


def violations(pairs: DataFrame) -> DataFrame:
    """V5 to V10 of joined gold and predicted entities: one row per violated rule.

    Needs gold ``text, label, start_pos, end_pos`` and the same with prefix ``pred_``, and
    ``pred_id``, ``pred_source``. A later rule isn't tested where an earlier one ends the row.
    """
    changed = [F.when(~F.col(c).eqNullSafe(F.col(f"pred_{c}")), F.lit(f"H5_{c}")) for c in ("text", "label", "start_pos", "end_pos")]
    missing = F.col("pred_id").isNull() | F.col("pred_source").isNull()
    bad_source = ~missing & ~F.col("pred_source").isin(*SOURCES)
    usable = ~missing & ~bad_source
    empty_source, empty_id = F.col("pred_source") == "", F.col("pred_id") == ""
    nil_mismatch = usable & (empty_source != empty_id)
    tested = usable & ~nil_mismatch
    rules = [
        *changed,
        F.when(missing, F.lit("H6")),
        F.when(bad_source, F.lit("H7")),
        F.when(nil_mismatch & empty_source, F.lit("H10")),
        F.when(nil_mismatch & empty_id, F.lit("H11")),
        F.when(tested & (F.col("pred_source") == "GeoNames") & ~F.col("pred_id").rlike(T.GEO_ID), F.lit("H8")),
        F.when(tested & (F.col("pred_source") == "MeSH") & ~F.col("pred_id").rlike(T.MESH_ID), F.lit("H9")),
    ]
    return pairs.select("doc_idx", "ent_idx", F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def compared(corpus: DataFrame, predicted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V3, V4: ``(doc_idx, ent_idx, rule)`` of documents that differ, and the pairs of mentions of the others.

    Both have ``(doc_idx, text, entities)``. A document whose mentions differ in number isn't
    looked into; a missing text counts as empty, missing mentions as none.
    """
    g = corpus.select("doc_idx", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("entities", F.array()).alias("g"))
    p = predicted.select("doc_idx", F.coalesce("text", F.lit("")).alias("pred"), F.coalesce("entities", F.array()).alias("p"))
    both = g.join(p, "doc_idx")
    uneven = F.size("g") != F.size("p")
    rules = F.array_compact(F.array(F.when(F.col("text") != F.col("pred"), "H3"), F.when(uneven, "H4")))
    wrong = both.select("doc_idx", F.lit(None).cast("int").alias("ent_idx"), F.explode(rules).alias("rule"))
    flat = both.where(~uneven).select("doc_idx", F.posexplode(F.arrays_zip("g", "p")).alias("ent_idx", "e"))
    names = {"text": "text", "label": "label", "start": "start_pos", "end": "end_pos"}
    pairs = flat.select(
        "doc_idx", "ent_idx", *[F.col(f"e.g.{k}").alias(v) for k, v in names.items()], *[F.col(f"e.p.{k}").alias(f"pred_{v}") for k, v in names.items()],
        F.col("e.p.id_kb").alias("pred_id"), F.col("e.p.source").alias("pred_source"),
    )
    return wrong, pairs


def _tested() -> Column:
    """Whether the report counts a row, which no rule ended before its id's format was looked at."""
    sane = F.col("pred_id").isNotNull() & F.col("pred_source").isNotNull() & F.col("pred_source").isin(*SOURCES)
    return F.coalesce(sane & ((F.col("pred_source") == "") == (F.col("pred_id") == "")), F.lit(False))


def validation_summary(pairs: DataFrame) -> DataFrame:
    """Counts of tested rows by knowledge base, their share without a link, whether it's odd, and texts that look garbled."""
    complete = F.col("pred_id").isNotNull() & F.col("pred_source").isNotNull()

    def tested(source: str) -> Column:
        return F.count_if(_tested() & (F.col("pred_source") == source))

    counts = pairs.agg(
        F.count_if(_tested()).alias("n"), tested("GeoNames").alias("n_geo"), tested("MeSH").alias("n_mesh"), tested("").alias("n_nil"),
        F.count_if(complete & T.looks_garbled("pred_text")).alias("n_mojibake"),
    )
    rate = F.try_divide(100.0 * F.col("n_nil"), "n")
    return counts.select("n", "n_geo", "n_mesh", "n_nil", F.round(rate, 3).alias("nil_rate"), ((rate < 0.5) | (rate > 15)).alias("warn"), "n_mojibake")


def unknown_ids(pairs: DataFrame, places: DataFrame, descriptors: DataFrame, supplementals: DataFrame) -> DataFrame:
    """``pairs`` with ``rule`` and ``id`` for every well-formed predicted id that the knowledge base (each an ``id`` column) lacks.

    S1 are place ids; S2 descriptors left of the colon and supplementals right of it, of which
    only ids beginning with D there and with C here are looked up.
    """
    tested = pairs.where(_tested())
    geo = tested.where((F.col("pred_source") == "GeoNames") & F.col("pred_id").rlike(T.GEO_ID)).select("*", F.lit("S1").alias("rule"), F.col("pred_id").alias("id"))
    mesh = tested.where((F.col("pred_source") == "MeSH") & F.col("pred_id").rlike(T.MESH_ID))
    left = mesh.select("*", F.lit("S2").alias("rule"), F.explode(T.descriptor_ids(F.trim("pred_id"))).alias("id")).withColumn("id", F.trim("id")).where("id like 'D%'")
    right = mesh.select("*", F.lit("S2").alias("rule"), F.explode(T.supplemental_ids(F.trim("pred_id"))).alias("id")).withColumn("id", F.trim("id")).where("id like 'C%'")
    out = None
    for rows, known in ((geo, places), (left, descriptors), (right, supplementals)):
        lost = rows.join(known.where("id is not null").select("id").distinct(), "id", "left_anti")
        out = lost if out is None else out.unionByName(lost)
    return out


def partial_credit(gold: Column, predicted: Column) -> Column:
    """1 for the same id; with the same descriptors the share of the gold's supplementals that are predicted, null if it has none; else 0."""
    same = F.array_sort(F.array_distinct(T.descriptor_ids(gold))) == F.array_sort(F.array_distinct(T.descriptor_ids(predicted)))
    wanted = F.array_distinct(T.supplemental_ids(gold))
    share = F.try_divide(F.size(F.array_intersect(wanted, T.supplemental_ids(predicted))), F.size(wanted))
    return F.when(gold == predicted, F.lit(1.0)).when(same, share).otherwise(F.lit(0.0))


def linking_metrics(pairs: DataFrame) -> DataFrame:
    """Counts, precision, recall, F1, entity, strict, partial and concept accuracy and the ranking score, over all and by knowledge base.

    Accuracies are those of gold links; an undefined one is null. The ranking score is the mean
    of partial accuracy and F1.
    """
    gold, predicted = F.col("gold_id") != "", F.col("pred_id") != ""
    right = gold & (F.col("gold_id") == F.col("pred_id"))
    credit = F.when(gold, partial_credit(F.col("gold_id"), F.col("pred_id")))
    refined = F.array_sort(F.array_distinct(T.supplemental_ids("gold_id")))
    concepts = F.when(gold & (F.size(refined) > 0), (refined == F.array_sort(F.array_distinct(T.supplemental_ids("pred_id")))).cast("double"))
    none, zero = F.lit(None).cast("double"), F.lit(0).cast("long")
    # a row counts for the gold's knowledge base as gold and for the prediction's as predicted
    base = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("gold_source").alias("kb"), gold.cast("long").alias("g"), zero.alias("p"), right.cast("long").alias("c"), credit.alias("credit"), concepts.alias("concepts")),
                F.struct(F.col("pred_source").alias("kb"), zero.alias("g"), predicted.cast("long").alias("p"), zero.alias("c"), none.alias("credit"), none.alias("concepts")),
            )
        ).alias("r")
    ).select("r.*").where("kb <> ''")
    total = base.rollup("kb").agg(
        F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred"), F.sum("c").alias("n_correct"), F.avg("credit").alias("credit"), F.avg("concepts").alias("concepts")
    )
    recall = F.try_divide(100.0 * F.col("n_correct"), "n_gold")
    f1 = F.try_divide(200.0 * F.col("n_correct"), F.col("n_gold") + F.col("n_pred"))
    return total.select(
        F.coalesce("kb", F.lit("all")).alias("kb"), "n_gold", "n_pred", "n_correct",
        F.round(F.try_divide(100.0 * F.col("n_correct"), "n_pred"), 2).alias("precision"), F.round(recall, 2).alias("recall"), F.round(f1, 2).alias("f1"),
        F.round(recall, 2).alias("entity_accuracy"), F.round(recall, 2).alias("strict_accuracy"), F.round(100.0 * F.col("credit"), 2).alias("partial_accuracy"),
        F.round(100.0 * F.col("concepts"), 2).alias("concept_accuracy"), F.round((100.0 * F.col("credit") + f1) / 2, 2).alias("ranking"),
    )


def error_class(gold: Column, predicted: Column) -> Column:
    """Null for a correct pair."""
    return (
        F.when(gold == predicted, F.lit(None).cast("string"))
        .when((gold != "") & (predicted == ""), "MISSED")
        .when((gold == "") & (predicted != ""), "SPURIOUS")
        .when((gold != "") & (predicted != ""), "WRONG_ID")
        .otherwise("OTHER")
    )
