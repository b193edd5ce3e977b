"""Queries of memory, dictionaries, document passes, validation, metrics, audits and reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexanchor.functions import text as T
from lexanchor.operators import cascade as C
from lexanchor.operators import documents as D
from lexanchor.operators import places as P
from lexanchor.operators import rerank as R
from lexanchor.operators import vocabulary as V
from lexanchor.plans import fragments as S
from lexanchor.plans import link_queries as L
from lexanchor.plans.registry import Registry
from lexanchor.plans.text_queries import LATEST, latest_texts, mentions
from lexanchor.session import table

REGISTRY = Registry()
_N = S.normalize("text")

# --- memory and dictionaries

MEMORY = f"""memory AS (SELECT key, label, id_kb, n FROM (SELECT *, row_number() OVER (PARTITION BY key, label ORDER BY n DESC, first, id_kb) AS r FROM (
  SELECT {_N} AS key, label, id_kb, count(*) AS n, min(mention_id) AS first FROM (SELECT DISTINCT * FROM entities)
  WHERE id_kb IS NOT NULL AND id_kb <> '' AND text IS NOT NULL GROUP BY 1, 2, 3)) WHERE r = 1)"""


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mentions(spark, sf_dir).where("text is not null").select(T.normalize("text").alias("key"), "label", "id_kb", "mention_id")
    return C.mode_by(rows, ["key", "label"], "id_kb", "mention_id")


@REGISTRY.add("a1_mode", f"WITH {MEMORY} SELECT key, label, id_kb, n FROM memory")
def a1_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory(spark, sf_dir)


@REGISTRY.add(
    "j5_memory",
    f"WITH {MEMORY}, m AS (SELECT DISTINCT mention_id, {_N} AS key, label FROM entities WHERE id_kb IS NULL AND text IS NOT NULL) SELECT mention_id, id_kb FROM m LEFT JOIN memory USING (key, label)",
)
def j5_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the linked mentions say of the unlinked ones."""
    open_ = mentions(spark, sf_dir).where("id_kb is null and text is not null").select("mention_id", T.normalize("text").alias("key"), "label")
    return open_.join(memory(spark, sf_dir).select("key", "label", "id_kb"), ["key", "label"], "left").select("mention_id", "id_kb")


DICT = f"""d AS (SELECT key, min(ref_id) AS id FROM (SELECT {S.normalize('ref_name')} AS key, ref_id FROM refnames) GROUP BY key),
  o AS (SELECT key, min(ref_id) AS oid FROM (SELECT {S.normalize('ref_name')} AS key, ref_id FROM refnames WHERE kind = 'medical') GROUP BY key)"""


def _dictionary(spark: SparkSession, sf_dir: str, where: str, value: str) -> DataFrame:
    rows = table(spark, sf_dir, "refnames").where(where).select(T.normalize("ref_name").alias("key"), "ref_id")
    return rows.groupBy("key").agg(F.min("ref_id").alias(value))


@REGISTRY.add(
    "j4_dictionary",
    f"""WITH {DICT}, m AS (SELECT DISTINCT mention_id, label, {_N} AS norm FROM entities WHERE text IS NOT NULL), mm AS (SELECT *, {S.remove_accents("norm")} AS plain FROM m)
    SELECT mention_id, coalesce(CASE WHEN label = 'PATHOGEN' THEN coalesce(o1.oid, o2.oid) END, d1.id, d2.id) AS id FROM mm
      LEFT JOIN o o1 ON o1.key = norm LEFT JOIN o o2 ON o2.key = plain LEFT JOIN d d1 ON d1.key = norm LEFT JOIN d d2 ON d2.key = plain""",
)
def j4_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides by label, then the dictionary, each by the normal and the unaccented form."""
    m = mentions(spark, sf_dir).where("text is not null").select("mention_id", "label", T.normalize("text").alias("norm"))
    m = m.distinct().withColumn("plain", T.remove_accents("norm"))
    o = _dictionary(spark, sf_dir, "kind = 'medical'", "id").withColumn("label", F.lit("PATHOGEN"))
    d = _dictionary(spark, sf_dir, "true", "id")
    lookups = [
        (["norm", "label"], o.withColumnRenamed("key", "norm"), "id"), (["plain", "label"], o.withColumnRenamed("key", "plain"), "id"),
        (["norm"], d.withColumnRenamed("key", "norm"), "id"), (["plain"], d.withColumnRenamed("key", "plain"), "id"),
    ]
    return C.by_first_hit(m, lookups, "id").select("mention_id", "id")


AMB = f"""amb AS (SELECT {_N} AS key, label, list(DISTINCT id_kb ORDER BY id_kb) AS ids FROM entities WHERE regexp_matches(id_kb, '^[DC]?\\d{{6,12}}$') AND text IS NOT NULL
  GROUP BY 1, 2 HAVING count(DISTINCT id_kb) >= 2)"""


@REGISTRY.add(
    "j8_ambiguous",
    f"""WITH {AMB}, m AS (SELECT DISTINCT text, label, {_N} AS norm FROM entities WHERE text IS NOT NULL), mm AS (SELECT *, {S.remove_accents("norm")} AS plain FROM m)
    SELECT text, label, array_to_string(coalesce(a.ids, b.ids), ' ') AS ids FROM mm LEFT JOIN amb a ON a.key = norm AND a.label IS NOT DISTINCT FROM mm.label
      LEFT JOIN amb b ON b.key = plain AND b.label IS NOT DISTINCT FROM mm.label WHERE coalesce(a.ids, b.ids) IS NOT NULL""".replace("text, label, array", "text, mm.label, array"),
)
def j8_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id list of an ambiguous mention and label, by the normal, else the unaccented form."""
    rows = mentions(spark, sf_dir).where("text is not null")
    amb = rows.where(F.col("id_kb").rlike(r"^[DC]?\d{6,12}\z")).groupBy(T.normalize("text").alias("key"), "label").agg(F.sort_array(F.collect_set("id_kb")).alias("ids")).where(F.size("ids") >= 2)
    m = rows.select("text", "label", T.normalize("text").alias("norm")).distinct().withColumn("plain", T.remove_accents("norm")).alias("m")
    a = amb.select(F.col("key").alias("a_key"), F.col("label").alias("a_label"), F.col("ids").alias("a_ids"))
    b = amb.select(F.col("key").alias("b_key"), F.col("label").alias("b_label"), F.col("ids").alias("b_ids"))
    out = m.join(a, (F.col("a_key") == F.col("m.norm")) & F.col("a_label").eqNullSafe(F.col("m.label")), "left")
    out = out.join(b, (F.col("b_key") == F.col("m.plain")) & F.col("b_label").eqNullSafe(F.col("m.label")), "left")
    ids = F.coalesce("a_ids", "b_ids")
    return out.where(ids.isNotNull()).select("text", "m.label", F.array_join(ids, " ").alias("ids"))


ALIASES = """places1 AS (SELECT lower(asciiname) AS adj, min(geonameid) AS id FROM locations WHERE geonameid IS NOT NULL AND asciiname IS NOT NULL AND feature_code = 'PPLA' GROUP BY 1)"""
_PER = "concat(CASE mention_id % 3 WHEN 0 THEN 'Territoire ' WHEN 1 THEN 'le continent ' ELSE '' END, text)"


@REGISTRY.add(
    "c3_periphrase",
    f"""WITH {ALIASES}, m AS (SELECT DISTINCT mention_id, {S.normalize(_PER)} AS norm FROM entities WHERE label = 'LOCATION' AND text IS NOT NULL),
    k AS (SELECT mention_id, nullif(regexp_extract(norm, '^(?:territoire|(?:le )?continent) ([\\p{{L}}\\p{{N}}\\p{{M}}_-]+)$', 1), '') AS adj FROM m)
    SELECT mention_id, id FROM k LEFT JOIN places1 ON places1.adj = {S.remove_accents('k.adj')}""",
)
def c3_periphrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3: "territoire X" and "(le) continent X" by a map of unaccented adjectives; bare adjectives stay unresolved."""
    k = F.col("mention_id") % 3
    text = F.concat(F.when(k == 0, "Territoire ").when(k == 1, "le continent ").otherwise(""), "text")
    m = mentions(spark, sf_dir).where("label = 'LOCATION' and text is not null").select("mention_id", T.normalize(text).alias("norm")).distinct()
    adjective = F.nullif(F.regexp_extract("norm", r"^(?:territoire|(?:le )?continent) ([\p{L}\p{N}\p{M}_-]+)$", 1), F.lit(""))
    places = table(spark, sf_dir, "locations").where("geonameid is not null and asciiname is not null and feature_code = 'PPLA'")
    known = places.groupBy(F.lower("asciiname").alias("adj")).agg(F.min("geonameid").alias("id"))
    return m.select("mention_id", T.remove_accents(adjective).alias("adj")).join(known, "adj", "left").select("mention_id", "id")


# --- whole linking and document passes

LINK = f"""{L.LINKED}, {L.TERMS}, {L._MED}, {L.PICK}, {L.TSTAGES.replace('@KEYS@', 'entries')}, {MEMORY}, tl AS (SELECT mention, id FROM t2 JOIN picked USING (key)),
  ents AS (SELECT DISTINCT mention_id, doc_idx, ent_idx, text, label, id_kb, source, {_N} AS norm,
    {"coalesce((label = 'LOCATION' AND regexp_matches(text, '^(?:quartier|zone|bassins?|ceinture)(?:$|[^" + chr(92) + "p{L}" + chr(92) + "p{N}_" + chr(92) + "p{M}])', 'i')) OR (label = 'BIO_TOXIN' AND regexp_matches(text, '(?:^|[^" + chr(92) + "p{L}" + chr(92) + "p{N}_" + chr(92) + "p{M}])(?:venom|venin)(?:$|[^" + chr(92) + "p{L}" + chr(92) + "p{N}_" + chr(92) + "p{M}])', 'i')), false)"} AS nil FROM entities WHERE text IS NOT NULL),
  res AS (SELECT e.*, m.id_kb AS mem, l.geonameid AS geo, t.id AS med_id FROM ents e LEFT JOIN memory m ON m.key = e.norm AND m.label = e.label
    LEFT JOIN linked l ON l.mention = e.text AND e.label = 'LOCATION' LEFT JOIN tl t ON t.mention = e.text AND {S.isin('e.label', T.MEDICAL_LABELS)}),
  final AS (SELECT mention_id, doc_idx, ent_idx, text, label, id_kb AS gold_id, source AS gold_source,
    CASE WHEN mem IS NOT NULL THEN 'memory' WHEN nil THEN 'nil' WHEN geo IS NOT NULL THEN 'place' WHEN med_id IS NOT NULL THEN 'term' ELSE 'none' END AS decision,
    CASE WHEN mem IS NOT NULL THEN mem WHEN nil THEN '' ELSE coalesce(geo, med_id, '') END AS pred_id FROM res)"""


def linked_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory, then the lexical filter, then the linker of the label; with the deciding stage."""
    ents = mentions(spark, sf_dir).where("text is not null").select("mention_id", "doc_idx", "ent_idx", "text", "label", "id_kb", "source", T.normalize("text").alias("key")).distinct()
    mem = memory(spark, sf_dir).select("key", "label", F.col("id_kb").alias("mem"))
    geo = P.link_places(L.place_mentions(spark, sf_dir), L.names(spark, sf_dir), L.places(spark, sf_dir))
    med = V.link_terms(L.medical_mentions(spark, sf_dir), L.entries(spark, sf_dir))
    both = geo.select(F.col("mention").alias("text"), F.lit(True).alias("is_place"), F.col("geonameid").alias("found")).unionByName(
        med.select(F.col("mention").alias("text"), F.lit(False).alias("is_place"), F.col("id").alias("found"))
    )
    is_place = F.when(F.col("label") == "LOCATION", True).when(F.col("label").isin(*T.MEDICAL_LABELS), False)
    joined = ents.withColumn("is_place", is_place).join(mem, ["key", "label"], "left").join(both, ["text", "is_place"], "left")
    nil = T.likely_nil("text", "label")
    decision = F.when(F.col("mem").isNotNull(), "memory").when(nil, "nil").when(F.col("found").isNull(), "none").when(F.col("is_place"), "place").otherwise("term")
    predicted = F.when(F.col("mem").isNotNull(), F.col("mem")).when(nil, "").otherwise(F.coalesce("found", F.lit("")))
    return joined.select(
        "mention_id", "doc_idx", "ent_idx", "text", "label", F.col("id_kb").alias("gold_id"), F.col("source").alias("gold_source"),
        decision.alias("decision"), predicted.alias("pred_id"),
    )


@REGISTRY.add("c1_link", f"{LINK} SELECT mention_id, decision, pred_id FROM final")
def c1_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_entities(spark, sf_dir).select("mention_id", "decision", "pred_id")


SOURCE = "CASE WHEN pred_id = '' THEN '' WHEN label = 'LOCATION' THEN 'GeoNames' ELSE 'MeSH' END"
SCORED = f"""scored AS (SELECT mention_id, coalesce(gold_id, '') AS gold_id, coalesce(gold_source, '') AS gold_source, pred_id, {SOURCE} AS pred_source FROM final)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("pred_id") == "", "").when(F.col("label") == "LOCATION", "GeoNames").otherwise("MeSH")
    return linked_entities(spark, sf_dir).select(
        "mention_id", F.coalesce("gold_id", F.lit("")).alias("gold_id"), F.coalesce("gold_source", F.lit("")).alias("gold_source"), "pred_id", source.alias("pred_source")
    )


def _ids(x: str, part: int, sign: str) -> str:
    return rf"list_sort(list_distinct(list_filter(regexp_split_to_array(split_part({x}, ':', {part}), '\s*{sign}\s*'), lambda t: trim(t) <> '')))"


_SUPP = _ids("gold_id", 2, r"\|")
METRICS = f"""b AS (SELECT gold_source AS kb, (gold_id <> '')::INT AS g, 0 AS p, (gold_id <> '' AND gold_id = pred_id)::INT AS c,
      CASE WHEN gold_id = '' THEN NULL WHEN gold_id = pred_id THEN 1.0::DOUBLE WHEN {_ids('gold_id', 1, '&')} = {_ids('pred_id', 1, '&')}
        THEN len(list_intersect({_SUPP}, {_ids('pred_id', 2, chr(92) + '|')}))::DOUBLE / nullif(len({_SUPP}), 0) ELSE 0.0::DOUBLE END AS credit,
      CASE WHEN gold_id <> '' AND len({_SUPP}) > 0 THEN ({_SUPP} = {_ids('pred_id', 2, chr(92) + '|')})::INT::DOUBLE END AS concepts FROM scored WHERE gold_source <> ''
    UNION ALL SELECT pred_source, 0, (pred_id <> '')::INT, 0, NULL, NULL FROM scored WHERE pred_source <> ''),
  m AS (SELECT coalesce(kb, 'all') AS kb, sum(g)::BIGINT AS n_gold, sum(p)::BIGINT AS n_pred, sum(c)::BIGINT AS n_correct, 100.0::DOUBLE * sum(c) / nullif(sum(p), 0) AS pr,
    100.0::DOUBLE * sum(c) / nullif(sum(g), 0) AS re, 200.0::DOUBLE * sum(c) / nullif(sum(g) + sum(p), 0) AS f, 100.0 * avg(credit) AS pa, 100.0 * avg(concepts) AS ca FROM b GROUP BY ROLLUP(kb))"""


@REGISTRY.add(
    "a5_metrics",
    f"""{LINK}, {SCORED}, {METRICS} SELECT kb, n_gold, n_pred, n_correct, round(pr, 2) AS precision, round(re, 2) AS recall, round(f, 2) AS f1, round(re, 2) AS entity_accuracy,
      round(re, 2) AS strict_accuracy, round(pa, 2) AS partial_accuracy, round(ca, 2) AS concept_accuracy, round((pa + f) / 2, 2) AS ranking FROM m""",
)
def a5_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.linking_metrics(scored(spark, sf_dir))


@REGISTRY.add("a6_ranking", f"{LINK}, {SCORED}, {METRICS} SELECT round((pa + f) / 2, 2) AS ranking FROM m WHERE kb = 'all'")
def a6_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of partial accuracy and F1 over all."""
    return D.linking_metrics(scored(spark, sf_dir)).where("kb = 'all'").select("ranking")


@REGISTRY.add(
    "c10_errors",
    f"""{LINK}, {SCORED} SELECT mention_id, CASE WHEN gold_id <> '' AND pred_id = '' THEN 'MISSED' WHEN gold_id = '' AND pred_id <> '' THEN 'SPURIOUS' ELSE 'WRONG_ID' END AS error FROM scored WHERE gold_id <> pred_id""",
)
def c10_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select("mention_id", D.error_class(F.col("gold_id"), F.col("pred_id")).alias("error"))
    return rows.where("error is not null")


@REGISTRY.add(
    "a10_error_counts",
    f"""{LINK}, {SCORED} SELECT CASE WHEN gold_id <> '' AND pred_id = '' THEN 'MISSED' WHEN gold_id = '' AND pred_id <> '' THEN 'SPURIOUS' ELSE 'WRONG_ID' END AS error, count(*) AS n FROM scored WHERE gold_id <> pred_id GROUP BY 1""",
)
def a10_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c10_errors(spark, sf_dir).groupBy("error").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "error")


ACR_TEXT = "(SELECT doc_idx, string_agg(concat(text, ' (', acr, ')'), '. ' ORDER BY ent_idx) AS text FROM acr GROUP BY doc_idx)"
ACR = """acr AS (SELECT doc_idx, ent_idx, text, label, id_kb, source, upper(regexp_replace(strip_accents(left(text, 3)), '[^A-Za-z]', 'X', 'g')) AS acr FROM (
    SELECT DISTINCT doc_idx, ent_idx, text, label, id_kb, source FROM entities) WHERE source IN ('GeoNames', 'MeSH') AND id_kb <> '' AND length(text) >= 3 AND regexp_matches(text, '^[A-Za-zÀ-ÿ]{3}'))"""


@REGISTRY.add(
    "j10_acronyms",
    f"""WITH {ACR}, docs AS {ACR_TEXT}, o AS (SELECT DISTINCT doc_idx, ent_idx + 1000 AS ent_idx, acr, label FROM acr),
    p AS (SELECT o.doc_idx, o.ent_idx, a.ent_idx AS from_idx, a.id_kb, a.source, a.text AS expansion, o.acr FROM o JOIN acr a USING (doc_idx, label) WHERE length(a.text) > length(o.acr)),
    h AS (SELECT p.*, row_number() OVER (PARTITION BY p.doc_idx, p.ent_idx ORDER BY from_idx, p.id_kb, p.source) AS r FROM p JOIN docs USING (doc_idx)
      WHERE regexp_matches(docs.text, concat('(?i)', regexp_escape(expansion), '\\s*\\(\\s*', regexp_escape(p.acr), '\\s*\\)')))
    SELECT doc_idx, CAST(ent_idx AS INT) AS ent_idx, id_kb, source FROM h WHERE r = 1""",
)
def j10_acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10 on documents in which every linked mention is followed by an acronym, unlinked mentions of which are added."""
    ents = mentions(spark, sf_dir).select("doc_idx", "ent_idx", "text", "label", "id_kb", "source").distinct()
    ents = ents.where("source in ('GeoNames', 'MeSH') and id_kb <> '' and length(text) >= 3").where(F.col("text").rlike("^[A-Za-zÀ-ÿ]{3}"))
    acronym = F.upper(F.regexp_replace(T.remove_accents(F.substring("text", 1, 3)), "[^A-Za-z]", "X"))
    ents = ents.withColumn("acr", acronym)
    line = F.struct("ent_idx", F.concat("text", F.lit(" ("), "acr", F.lit(")")).alias("t"))
    texts = ents.groupBy("doc_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), ". ").alias("text"))
    open_ = ents.select("doc_idx", (F.col("ent_idx") + 1000).alias("ent_idx"), F.col("acr").alias("text"), "label", F.lit("").alias("id_kb"), F.lit("").alias("source")).distinct()
    return D.propagate_acronyms(ents.drop("acr").unionByName(open_), texts).select("doc_idx", "ent_idx", "id_kb", "source")


@REGISTRY.add(
    "c6_documents",
    """SELECT doc_idx, string_agg(concat(ent_idx, '=', coalesce(text, ''), '>', coalesce(id_kb, '')), ' ~ ' ORDER BY ent_idx, coalesce(text, ''), coalesce(id_kb, '')) AS entities, count(*) AS n_entities
    FROM (SELECT DISTINCT doc_idx, ent_idx, text, id_kb FROM entities) GROUP BY doc_idx""",
)
def c6_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions nested under their documents in their order."""
    rows = mentions(spark, sf_dir).select("doc_idx", "ent_idx", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("id_kb", F.lit("")).alias("id_kb")).distinct()
    nested = D.nest(rows)
    parts = F.transform("entities", lambda e: F.concat(e["ent_idx"].cast("string"), F.lit("="), e["text"], F.lit(">"), e["id_kb"]))
    return nested.select("doc_idx", F.array_join(parts, " ~ ").alias("entities"), F.size("entities").cast("long").alias("n_entities"))


# --- validation

FAULTY = """faulty AS (SELECT DISTINCT doc_idx, ent_idx, mention_id, text, label, start_pos, end_pos, CASE WHEN mention_id % 7 = 0 THEN concat(text, ' ') ELSE text END AS pred_text, label AS pred_label,
  CASE WHEN mention_id % 11 = 0 THEN '[0]' ELSE start_pos END AS pred_start_pos, end_pos AS pred_end_pos,
  CASE WHEN mention_id % 13 = 0 THEN NULL WHEN mention_id % 17 = 0 THEN '' ELSE id_kb END AS pred_id, CASE WHEN mention_id % 19 = 0 THEN 'mesh' ELSE source END AS pred_source FROM entities)"""
_OK = "pred_id IS NOT NULL AND pred_source IS NOT NULL AND pred_source IN ('GeoNames', 'MeSH', '')"
_TESTED = f"{_OK} AND (pred_source = '') = (pred_id = '')"
VIOLATIONS = f"""viol AS (SELECT doc_idx, ent_idx, mention_id, 'H5_text' AS rule FROM faulty WHERE text IS DISTINCT FROM pred_text
  UNION ALL SELECT doc_idx, ent_idx, mention_id, 'H5_start_pos' FROM faulty WHERE start_pos IS DISTINCT FROM pred_start_pos
  UNION ALL SELECT doc_idx, ent_idx, mention_id, 'H6' FROM faulty WHERE pred_id IS NULL OR pred_source IS NULL
  UNION ALL SELECT doc_idx, ent_idx, mention_id, 'H7' FROM faulty WHERE pred_id IS NOT NULL AND pred_source IS NOT NULL AND pred_source NOT IN ('GeoNames', 'MeSH', '')
  UNION ALL SELECT doc_idx, ent_idx, mention_id, 'H10' FROM faulty WHERE {_OK} AND pred_source = '' AND pred_id <> ''
  UNION ALL SELECT doc_idx, ent_idx, mention_id, 'H11' FROM faulty WHERE {_OK} AND pred_source <> '' AND pred_id = ''
  UNION ALL SELECT doc_idx, ent_idx, mention_id, 'H8' FROM faulty WHERE {_TESTED} AND pred_source = 'GeoNames' AND NOT regexp_matches(pred_id, '^\\d{{1,12}}$')
  UNION ALL SELECT doc_idx, ent_idx, mention_id, 'H9' FROM faulty WHERE {_TESTED} AND pred_source = 'MeSH' AND NOT regexp_matches(pred_id, '^[DC]\\d{{6,9}}(?:\\s*&\\s*[DC]\\d{{6,9}})*(?:\\s*:\\s*C\\d{{6,9}}(?:\\s*\\|\\s*C\\d{{6,9}})*)?$'))"""


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions beside predictions with faults put in by rule."""
    m = F.col("mention_id")
    return mentions(spark, sf_dir).select(
        "doc_idx", "ent_idx", "mention_id", "text", "label", "start_pos", "end_pos",
        F.when(m % 7 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")).alias("pred_text"), F.col("label").alias("pred_label"),
        F.when(m % 11 == 0, "[0]").otherwise(F.col("start_pos")).alias("pred_start_pos"), F.col("end_pos").alias("pred_end_pos"),
        F.when(m % 13 == 0, F.lit(None)).when(m % 17 == 0, "").otherwise(F.col("id_kb")).alias("pred_id"),
        F.when(m % 19 == 0, "mesh").otherwise(F.col("source")).alias("pred_source"),
    ).distinct()


@REGISTRY.add("j11_validate", f"WITH {FAULTY}, {VIOLATIONS} SELECT doc_idx, ent_idx, rule FROM viol")
def j11_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.violations(faulty(spark, sf_dir))


_ROWS = "rws AS (SELECT *, row_number() OVER (PARTITION BY doc_idx ORDER BY ent_idx, mention_id) - 1 AS pos FROM faulty JOIN latest_ids USING (doc_idx)), even AS (SELECT * FROM rws WHERE doc_idx % 10 <> 0)"
_EVEN = VIOLATIONS.replace("FROM faulty", "FROM even").replace("doc_idx, ent_idx, mention_id,", "doc_idx, pos,")


@REGISTRY.add(
    "v4_compared",
    f"""WITH {LATEST}, latest_ids AS (SELECT doc_idx FROM latest WHERE text IS NOT NULL), {FAULTY}, {_ROWS}, {_EVEN}
    SELECT doc_idx, CAST(NULL AS INT) AS ent_idx, 'H3' AS rule FROM latest WHERE text IS NOT NULL AND doc_idx % 9 = 0
    UNION ALL SELECT doc_idx, NULL, 'H4' FROM latest WHERE text IS NOT NULL AND doc_idx % 10 = 0 AND doc_idx IN (SELECT doc_idx FROM rws)
    UNION ALL SELECT doc_idx, CAST(pos AS INT), rule FROM viol""",
)
def v4_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents beside predictions of them, joined by position; every ninth text is changed, and every tenth document lacks its last mention."""
    docs = latest_texts(spark, sf_dir).where("text is not null")
    rows = faulty(spark, sf_dir)

    def nested(prefix: str, ids: tuple[str, str]) -> DataFrame:
        e = F.struct(F.col(f"{prefix}text").alias("text"), F.col(f"{prefix}label").alias("label"), F.col(f"{prefix}start_pos").alias("start"), F.col(f"{prefix}end_pos").alias("end"), F.col(ids[0]).alias("id_kb"), F.col(ids[1]).alias("source"))
        return rows.groupBy("doc_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("ent_idx", "mention_id", e.alias("e")))), lambda x: x["e"]).alias("entities"))

    gold = docs.join(nested("", ("pred_id", "pred_source")), "doc_idx", "left")
    predicted = docs.join(nested("pred_", ("pred_id", "pred_source")), "doc_idx", "left").withColumns(
        {
            "text": F.when(F.col("doc_idx") % 9 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")),
            "entities": F.when((F.col("doc_idx") % 10 == 0) & (F.size("entities") > 0), F.slice("entities", F.lit(1), F.size("entities") - 1)).otherwise(F.col("entities")),
        }
    )
    wrong, pairs = D.compared(gold, predicted)
    return wrong.unionByName(D.violations(pairs))


@REGISTRY.add("v14_report", f"WITH {FAULTY}, {VIOLATIONS} SELECT rule, count(*) AS n FROM viol GROUP BY rule")
def v14_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.violations(faulty(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("n"))


_IDS = "list_filter(list_transform(regexp_split_to_array(split_part(trim(pred_id), ':', {part}), '\\s*{sign}\\s*'), lambda t: trim(t)), lambda t: starts_with(t, '{first}'))"
_MESH_SQL = r"regexp_matches(pred_id, '^[DC]\d{6,9}(?:\s*&\s*[DC]\d{6,9})*(?:\s*:\s*C\d{6,9}(?:\s*\|\s*C\d{6,9})*)?$')"


@REGISTRY.add(
    "v11_unknown_ids",
    f"""WITH {FAULTY}, ok AS (SELECT DISTINCT mention_id, pred_id, pred_source FROM faulty WHERE {_TESTED}),
    t AS (SELECT mention_id, 'S1' AS rule, pred_id AS id FROM ok WHERE pred_source = 'GeoNames' AND regexp_matches(pred_id, '^\\d{{1,12}}$') AND pred_id NOT IN (SELECT geonameid FROM locations WHERE geonameid IS NOT NULL)
      UNION ALL SELECT mention_id, 'S2', id FROM (SELECT mention_id, unnest({_IDS.format(part=1, sign='&', first='D')}) AS id FROM ok WHERE pred_source = 'MeSH' AND {_MESH_SQL}) WHERE id NOT IN (SELECT dui FROM descriptors WHERE dui IS NOT NULL)
      UNION ALL SELECT mention_id, 'S2', id FROM (SELECT mention_id, unnest({_IDS.format(part=2, sign=chr(92) + '|', first='C')}) AS id FROM ok WHERE pred_source = 'MeSH' AND {_MESH_SQL}) WHERE id NOT IN (SELECT sui FROM supplementals WHERE sui IS NOT NULL))
    SELECT DISTINCT mention_id, rule, id FROM t""",
)
def v11_unknown_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Well-formed predicted ids that no knowledge base has."""
    places = table(spark, sf_dir, "locations").select(F.col("geonameid").alias("id"))
    descriptors = table(spark, sf_dir, "descriptors").select(F.col("dui").alias("id"))
    supplementals = table(spark, sf_dir, "supplementals").select(F.col("sui").alias("id"))
    return D.unknown_ids(faulty(spark, sf_dir), places, descriptors, supplementals).select("mention_id", "rule", "id").distinct()


@REGISTRY.add(
    "v12_nil_rate",
    f"""WITH {FAULTY}, t AS (SELECT count(*) AS n, count(*) FILTER (pred_source = 'GeoNames') AS n_geo, count(*) FILTER (pred_source = 'MeSH') AS n_mesh, count(*) FILTER (pred_source = '') AS n_nil FROM faulty WHERE {_TESTED})
    SELECT n, n_geo, n_mesh, n_nil, round(100.0::DOUBLE * n_nil / n, 3) AS nil_rate, n_nil < 0.005 * n OR n_nil > 0.15 * n AS warn,
      (SELECT count(*) FROM faulty WHERE pred_id IS NOT NULL AND pred_source IS NOT NULL AND ({" OR ".join(f"contains(pred_text, {hint})" for hint in ("'Ã©'", "'Ã¨'", "'Ãª'", "'Ã '", "'Ã§'", "'Â°'", "'Â«'", "'Â»'", "concat('â', chr(128), chr(153))"))})) AS n_mojibake FROM t""",
)
def v12_nil_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, M3, V12, V13."""
    return D.validation_summary(faulty(spark, sf_dir))


@REGISTRY.add(
    "v2_documents",
    f"""WITH {LATEST}, e AS (SELECT doc_idx, count(*) AS n FROM (SELECT DISTINCT doc_idx, ent_idx FROM entities) GROUP BY doc_idx)
    SELECT count(*) AS n_docs, count(e.n) AS n_with_entities, (SELECT count(*) FROM e WHERE doc_idx NOT IN (SELECT doc_idx FROM latest)) AS n_orphans FROM latest LEFT JOIN e USING (doc_idx)""",
)
def v2_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2 to V4: documents, those with mentions, and mentions of no document."""
    docs = latest_texts(spark, sf_dir).select("doc_idx", F.lit(1).alias("d"))
    ents = mentions(spark, sf_dir).select("doc_idx").distinct().withColumn("e", F.lit(1))
    joined = docs.join(ents, "doc_idx", "full")
    return joined.agg(F.count("d").alias("n_docs"), F.count_if(F.col("d").isNotNull() & F.col("e").isNotNull()).alias("n_with_entities"), F.count_if(F.col("d").isNull()).alias("n_orphans"))


# --- audits and experiments

PAIRS = f"flagged AS (SELECT DISTINCT {S.normalize('ref_name')} AS key, ref_id AS id FROM refnames WHERE kind = 'medical')"


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for the set of flagged pairs: the medical names and their ids."""
    rows = table(spark, sf_dir, "refnames").where("kind = 'medical'")
    return rows.select(T.normalize("ref_name").alias("key"), F.col("ref_id").alias("id_kb")).distinct()


@REGISTRY.add(
    "j13_revert",
    f"""WITH {PAIRS}, m AS (SELECT DISTINCT mention_id, {_N} AS key, id_kb, source FROM entities WHERE text IS NOT NULL)
    SELECT mention_id, CASE WHEN f.id IS NOT NULL THEN '' ELSE id_kb END AS id_kb, CASE WHEN f.id IS NOT NULL THEN '' ELSE source END AS source, f.id IS NOT NULL AS reverted
    FROM m LEFT JOIN flagged f ON f.key = m.key AND f.id = m.id_kb""",
)
def j13_revert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged pairs of mention and id are reverted to no link."""
    flagged = _flagged(spark, sf_dir).withColumn("f", F.lit(True))
    m = mentions(spark, sf_dir).where("text is not null").select("mention_id", T.normalize("text").alias("key"), "id_kb", "source").distinct()
    hit = F.col("f").isNotNull()
    return m.join(flagged, ["key", "id_kb"], "left").select(
        "mention_id", F.when(hit, "").otherwise(F.col("id_kb")).alias("id_kb"), F.when(hit, "").otherwise(F.col("source")).alias("source"), hit.alias("reverted")
    )


@REGISTRY.add(
    "a11_revert_counts",
    f"""WITH {PAIRS}, m AS (SELECT DISTINCT mention_id, text, {_N} AS key, id_kb FROM entities WHERE text IS NOT NULL) SELECT m.text, m.id_kb, count(*) AS n FROM m JOIN flagged f ON f.key = m.key AND f.id = m.id_kb GROUP BY 1, 2""",
)
def a11_revert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reverted = j13_revert(spark, sf_dir).where("reverted").select("mention_id")
    rows = mentions(spark, sf_dir).select("mention_id", "text", "id_kb").distinct().join(reverted.distinct(), "mention_id", "left_semi")
    return rows.where("text is not null").join(_flagged(spark, sf_dir).select("id_kb").distinct(), "id_kb", "left_semi").groupBy("text", "id_kb").agg(F.count("*").alias("n"))


SPLITS = f"""sp AS (SELECT DISTINCT doc_idx, split FROM corpus), k AS (SELECT DISTINCT {_N} AS key, split FROM entities JOIN sp USING (doc_idx) WHERE text IS NOT NULL)"""


def split_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    sp = table(spark, sf_dir, "corpus").select("doc_idx", "split").distinct()
    return mentions(spark, sf_dir).where("text is not null").select("doc_idx", T.normalize("text").alias("key")).join(sp, "doc_idx").select("key", "split").distinct()


@REGISTRY.add("u3_provenance", f"WITH {SPLITS} SELECT DISTINCT key FROM k WHERE split = 'test' AND key NOT IN (SELECT key FROM k WHERE split = 'train')")
def u3_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of the test split that training doesn't have."""
    keys = split_keys(spark, sf_dir)
    return keys.where("split = 'test'").select("key").distinct().join(keys.where("split = 'train'").select(F.col("key").alias("k")), F.col("key") == F.col("k"), "left_anti")


@REGISTRY.add(
    "a12_buckets",
    f"""WITH {SPLITS}, d AS (SELECT DISTINCT kind, {S.normalize('ref_name')} AS key FROM refnames), t AS (SELECT kind, d.key, d.key IN (SELECT key FROM k WHERE split = 'train') AS tr, d.key IN (SELECT key FROM k WHERE split = 'test') AS te FROM d)
    SELECT kind, CASE WHEN tr AND te THEN 'both' WHEN tr THEN 'train-only' WHEN te THEN 'test-only' ELSE 'neither' END AS bucket, count(*) AS n FROM t GROUP BY 1, 2""",
)
def a12_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the keys of each dictionary occur."""
    seen = split_keys(spark, sf_dir).groupBy("key").agg(F.max(F.col("split") == "train").alias("tr"), F.max(F.col("split") == "test").alias("te"))
    d = table(spark, sf_dir, "refnames").select("kind", T.normalize("ref_name").alias("key")).distinct()
    tr, te = F.coalesce("tr", F.lit(False)), F.coalesce("te", F.lit(False))
    bucket = F.when(tr & te, "both").when(tr, "train-only").when(te, "test-only").otherwise("neither")
    return d.join(seen, "key", "left").groupBy("kind", bucket.alias("bucket")).agg(F.count("*").alias("n"))


RUNS = "runs AS (SELECT event_id % 1000 AS ent, (event_id * 7919) % 5 AS run, CASE WHEN (event_id * 31) % 10 < 7 THEN 'A' ELSE event_type END AS pred, value, event_id FROM events)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for repeated runs: events dealt to entities and runs by rule."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        (e % 1000).alias("ent"), ((e * 7919) % 5).alias("run"), F.when((e * 31) % 10 < 7, "A").otherwise(F.col("event_type")).alias("pred"), "value", "event_id"
    )


@REGISTRY.add(
    "a7_stability",
    f"WITH {RUNS}, d AS (SELECT ent, count(DISTINCT pred) AS k FROM runs GROUP BY ent) SELECT count(*) AS n, count(*) FILTER (k > 1) AS n_unstable, round(count(*) FILTER (k > 1)::DOUBLE / count(*), 4) AS share FROM d",
)
def a7_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities on which the runs disagree."""
    d = runs(spark, sf_dir).groupBy("ent").agg(F.countDistinct("pred").alias("k"))
    n, bad = F.count("*"), F.count_if(F.col("k") > 1)
    return d.agg(n.alias("n"), bad.alias("n_unstable"), F.round(bad / n, 4).alias("share"))


@REGISTRY.add(
    "a8_vote",
    f"WITH {RUNS}, c AS (SELECT ent, pred, count(*) AS n, min(event_id) AS first FROM runs GROUP BY ent, pred) SELECT ent, pred, n FROM (SELECT *, row_number() OVER (PARTITION BY ent ORDER BY n DESC, first, pred) AS r FROM c) WHERE r = 1",
)
def a8_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.mode_by(runs(spark, sf_dir), ["ent"], "pred", "event_id")


@REGISTRY.add(
    "a13_sweep",
    f"WITH {RUNS} SELECT run, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high, round(max(value) - min(value), 4) AS spread FROM runs GROUP BY run",
)
def a13_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return runs(spark, sf_dir).groupBy("run").agg(F.round(F.avg(v), 4).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.max(v) - F.min(v), 4).alias("spread"))


# --- prompts and reranking

_CODE = "CASE feature_code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.CODE_NAMES.items()) + " ELSE coalesce(feature_code, '') END"
_PEOPLE = "CASE WHEN coalesce(population, 0) > 0 THEN format('{:,}', population) ELSE 'unknown' END"
LINES = f"""lines AS (SELECT key, wants_admin, count(*) AS n, list(geonameid ORDER BY pool_rank) AS ids, string_agg(concat('[', pool_rank - 1, '] ', coalesce(name, ''), ' — ', {_CODE}, ', ', coalesce(country_code, ''), ', ', {_PEOPLE}), chr(10) ORDER BY pool_rank) AS lines
  FROM pool WHERE pool_rank <= 5 GROUP BY key, wants_admin)"""


@REGISTRY.add("l1_prompt", f"{L.BASE}, {L.POOL}, {LINES} SELECT key, wants_admin, lines FROM lines")
def l1_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.place_lines(L.exact_pool(spark, sf_dir), ["key", "wants_admin"], 5).select("key", "wants_admin", "lines")


def length_model(text: str, n: int) -> str:
    """A stub that answers by the prompt's length, so that SQL can say the same."""
    k = len(text) % (n + 2)
    return "-1" if k == n else "none of them" if k == n + 1 else f"answer: {k}"


@REGISTRY.add(
    "l3_rerank_stub",
    f"""{L.BASE}, {L.POOL}, {LINES}, {L.CHOOSE}, q AS (SELECT key, wants_admin, n, ids, geonameid AS fallback,
      length(concat('Mention: ', key, chr(10), 'Context: ', chr(10), 'Candidates:', chr(10), lines, chr(10), 'Reply with the number of the right candidate only, or -1 if none is right.')) % (n + 2) AS k FROM lines JOIN chosen USING (key, wants_admin) WHERE n >= 2)
    SELECT key, wants_admin, CASE WHEN k < n THEN 'chosen' WHEN k = n THEN 'abstain' ELSE 'none' END AS status, CASE WHEN k < n THEN ids[CAST(k AS INT) + 1] WHEN k = n THEN '' ELSE fallback END AS id FROM q""",
)
def l3_rerank_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["key", "wants_admin"]
    config = R.RerankConfig(enabled=True, max_candidates=5, allow_abstain=True)
    pool = L.exact_pool(spark, sf_dir)
    chosen = P.choose_place(pool, by).select(*by, F.col("geonameid").alias("fallback"))
    lists = R.place_lines(pool, by, config.max_candidates).withColumn("n", F.size("ids")).where("n >= 2").join(chosen, by)
    questions = lists.select(*by, R.prompt(F.col("key"), F.lit(""), F.col("lines"), config).alias("prompt"), "n", "ids", "fallback")
    return R.rerank(questions, length_model, config, by)


_U4 = f"nil AS (SELECT DISTINCT {_N} AS key FROM entities WHERE id_kb = '' AND text IS NOT NULL UNION SELECT {S.normalize('name_lower')} FROM place_names WHERE geonameid IS NULL AND name_lower IS NOT NULL)"


@REGISTRY.add(
    "u5_cache_merge",
    f"""WITH {_U4}, cache AS (SELECT DISTINCT {S.normalize('ref_name')} AS key FROM refnames WHERE kind = 'place')
    SELECT key, 'cached' AS state FROM cache UNION ALL SELECT key, 'new' FROM nil WHERE key <> '' AND key NOT IN (SELECT key FROM cache)""",
)
def u5_cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct unlinked mentions of two tables merged into a frozen cache, in which existing keys win."""
    nil = mentions(spark, sf_dir).where("id_kb = '' and text is not null").select(T.normalize("text").alias("key"))
    free = table(spark, sf_dir, "place_names").where("geonameid is null and name_lower is not null").select(T.normalize("name_lower").alias("key"))
    cache = table(spark, sf_dir, "refnames").where("kind = 'place'").select(T.normalize("ref_name").alias("key")).distinct()
    new = nil.unionByName(free).where("key <> ''").distinct().join(cache, "key", "left_anti")
    return cache.withColumn("state", F.lit("cached")).unionByName(new.withColumn("state", F.lit("new")))
