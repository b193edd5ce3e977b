"""Queries of the scalar functions, predicates and quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexanchor.functions import text as T
from lexanchor.functions.geo import haversine_km
from lexanchor.plans import fragments as S
from lexanchor.plans.registry import Registry
from lexanchor.session import table

REGISTRY = Registry()


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entities").select("mention_id", "doc_idx", "ent_idx", "text", "label", "start_pos", "end_pos", "id_kb", "source").distinct()


def decorated(text: str = "text") -> F.Column:
    """Mentions with the prefixes that the rules strip, by mention."""
    heads = ["", "la région de ", "commune ", "l'île d'"]
    k = F.col("mention_id") % 4
    out = F.concat(F.lit(heads[3]), F.col(text))
    for i in (2, 1, 0):
        out = F.when(k == i, F.concat(F.lit(heads[i]), F.col(text))).otherwise(out)
    return out


DECORATED = "concat(CASE mention_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'la région de ' WHEN 2 THEN 'commune ' ELSE 'l''île d''' END, text)"
FROM_MENTIONS = "FROM (SELECT DISTINCT mention_id, text, label FROM entities WHERE text IS NOT NULL)"


def _scalar(name: str, column, sql: str, out: str = "value") -> None:
    """A query that applies one function to every distinct mention."""

    @REGISTRY.add(name, f"SELECT DISTINCT mention_id, {sql} AS {out} {FROM_MENTIONS}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "entities").select("mention_id", "text", "label").where("text is not null").distinct()
        return rows.select("mention_id", column().alias(out)).distinct()


_scalar("t1_normalize", lambda: T.normalize("text"), S.normalize("text"))
_scalar("t2_unaccent", lambda: T.remove_accents(T.normalize("text")), S.remove_accents(S.normalize("text")))
_scalar("t3_greek", lambda: T.transliterate_greek(T.normalize("text")), S.transliterate_greek(S.normalize("text")))
_scalar("t4_strip_prefix", lambda: T.strip_prefix(T.normalize(decorated())), S.strip_prefix(S.normalize(DECORATED)))
_scalar("t5_bare_admin", lambda: T.strip_bare_admin(T.normalize(decorated())), S.strip_bare_admin(S.normalize(DECORATED)))
_scalar("t6_hyphen", lambda: T.hyphen_to_space(T.normalize("text")), f"translate({S.normalize('text')}, '-', ' ')")
_scalar("t7_tails", lambda: F.array_join(T.tails(T.normalize("text")), "|"), f"array_to_string({S.tails(S.normalize('text'))}, '|')")
_scalar("pred1_nil", lambda: T.likely_nil("text", "label"), r"coalesce((label = 'LOCATION' AND regexp_matches(text, '^(?:quartier|zone|bassins?|ceinture)(?:$|[^\p{L}\p{N}_\p{M}])', 'i')) OR (label = 'BIO_TOXIN' AND regexp_matches(text, '(?:^|[^\p{L}\p{N}_\p{M}])(?:venom|venin)(?:$|[^\p{L}\p{N}_\p{M}])', 'i')), false)")
_scalar("pred3_acronym", lambda: T.is_acronym("text"), "regexp_matches(trim(text), '^[A-ZÉÈÀ0-9]{2,6}$')")
_scalar("pred4_wants_admin", lambda: T.wants_admin(decorated()), S.wants_admin(DECORATED))

LATEST = "latest AS (SELECT doc_idx, text FROM (SELECT doc_idx, text, row_number() OVER (PARTITION BY doc_idx ORDER BY ingested_at DESC NULLS LAST, text NULLS LAST) AS r FROM corpus) WHERE r = 1)"


def latest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of the last delivery of each document."""
    rows = table(spark, sf_dir, "corpus").select("doc_idx", "text", "ingested_at")
    order = F.struct(F.col("ingested_at").isNull(), -F.unix_micros(F.col("ingested_at").cast("timestamp")), F.col("text").isNull(), "text")
    return rows.groupBy("doc_idx").agg(F.min_by("text", order).alias("text"))


@REGISTRY.add(
    "t8_context",
    f"""WITH {LATEST}, spans AS (SELECT DISTINCT mention_id, doc_idx, {S.first_int('start_pos')} AS s, {S.first_int('end_pos')} AS e FROM entities)
    SELECT DISTINCT mention_id, substring(text, greatest(s - 200, 0) + 1, greatest(e + 200 - greatest(s - 200, 0), 0)) AS context
    FROM spans JOIN latest USING (doc_idx) WHERE s IS NOT NULL AND e IS NOT NULL AND text IS NOT NULL""",
)
def t8_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "entities").select("mention_id", "doc_idx", T.first_span("start_pos").alias("s"), T.first_span("end_pos").alias("e")).distinct()
    joined = spans.where("s is not null and e is not null").join(latest_texts(spark, sf_dir).where("text is not null"), "doc_idx")
    return joined.select("mention_id", T.context("text", "s", "e").alias("context")).distinct()


REPLY = "concat(CASE mention_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'answer: -' WHEN 2 THEN '<think>7 then 9</think> so ' WHEN 3 THEN 'Answer: ' ELSE 'none ' END, CASE WHEN mention_id % 5 = 4 THEN '' ELSE CAST(ent_idx AS VARCHAR) END)"


@REGISTRY.add(
    "t12_parse_reply",
    f"""SELECT DISTINCT mention_id, TRY_CAST(regexp_extract(r, '^(\\d+)', 1) AS INT) AS leading_int,
      TRY_CAST(list_last(regexp_extract_all(regexp_replace(r, '(?is)<think>.*?</think>', '', 'g'), '\\d+')) AS INT) AS last_int,
      TRY_CAST(coalesce(nullif(regexp_extract(r, '(?i)answer:\\s*(-?\\d+)', 1), ''), list_last(regexp_extract_all(r, '-?\\d+'))) AS INT) AS abstain_int
    FROM (SELECT mention_id, {REPLY} AS r FROM entities)""",
)
def t12_parse_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("mention_id") % 5
    head = F.when(k == 0, "").when(k == 1, "answer: -").when(k == 2, "<think>7 then 9</think> so ").when(k == 3, "Answer: ").otherwise("none ")
    reply = F.concat(head, F.when(k == 4, "").otherwise(F.col("ent_idx").cast("string")))
    rows = table(spark, sf_dir, "entities").select("mention_id", reply.alias("r"))
    return rows.select("mention_id", T.leading_int("r").alias("leading_int"), T.last_int("r").alias("last_int"), T.abstain_int("r").alias("abstain_int")).distinct()


@REGISTRY.add(
    "t16_mesh_id",
    r"""SELECT DISTINCT mention_id, regexp_matches(id_kb, '^[DC]\d{6,9}(?:\s*&\s*[DC]\d{6,9})*(?:\s*:\s*C\d{6,9}(?:\s*\|\s*C\d{6,9})*)?$') AS is_mesh,
      regexp_matches(id_kb, '^\d{1,12}$') AS is_place,
      array_to_string(list_filter(regexp_split_to_array(split_part(id_kb, ':', 1), '\s*&\s*'), lambda x: trim(x) <> ''), '+') AS descriptors,
      array_to_string(list_filter(regexp_split_to_array(split_part(id_kb, ':', 2), '\s*\|\s*'), lambda x: trim(x) <> ''), '+') AS supplementals
    FROM entities WHERE id_kb IS NOT NULL""",
)
def t16_mesh_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "entities").where("id_kb is not null")
    return rows.select(
        "mention_id", F.col("id_kb").rlike(T.MESH_ID).alias("is_mesh"), F.col("id_kb").rlike(T.GEO_ID).alias("is_place"),
        F.array_join(T.descriptor_ids("id_kb"), "+").alias("descriptors"), F.array_join(T.supplemental_ids("id_kb"), "+").alias("supplementals"),
    ).distinct()


@REGISTRY.add(
    "t18_urls",
    """SELECT DISTINCT mention_id, CASE source WHEN 'GeoNames' THEN concat('https://www.geonames.org/', id_kb)
      WHEN 'MeSH' THEN array_to_string(list_transform(regexp_extract_all(id_kb, '[DC]\\d{6,9}'), lambda x: concat('https://meshb.nlm.nih.gov/record/ui?ui=', x)), ' ') END AS urls
    FROM entities WHERE source IN ('GeoNames', 'MeSH') AND id_kb IS NOT NULL""",
)
def t18_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "entities").where("source in ('GeoNames', 'MeSH') and id_kb is not null")
    ids = F.transform(F.regexp_extract_all("id_kb", F.lit(r"[DC]\d{6,9}"), F.lit(0)), lambda x: F.concat(F.lit("https://meshb.nlm.nih.gov/record/ui?ui="), x))
    urls = F.when(F.col("source") == "GeoNames", F.concat(F.lit("https://www.geonames.org/"), "id_kb")).otherwise(F.array_join(ids, " "))
    return rows.select("mention_id", urls.alias("urls")).distinct()


@REGISTRY.add(
    "m1_haversine",
    f"""WITH {S.PLACES}, p AS (SELECT * FROM places WHERE name IS NOT NULL AND isfinite(latitude) AND isfinite(longitude)),
    h AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY population DESC NULLS LAST, geonameid) AS r FROM p)
    SELECT p.geonameid, h.geonameid AS hub, round({S.haversine('h.latitude', 'h.longitude', 'p.latitude', 'p.longitude')}, 3) AS km FROM p JOIN h USING (name) WHERE h.r = 1 AND p.geonameid <> h.geonameid""",
)
def m1_haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: how far each place is from the most populous of its name; homonyms meet that one only."""
    from lexanchor.functions.geo import finite
    from lexanchor.operators.places import place_dimension

    p = place_dimension(table(spark, sf_dir, "locations")).where("name is not null").where(finite(F.col("latitude")) & finite(F.col("longitude")))
    people = F.struct(F.col("population").isNull().alias("u"), (-F.coalesce("population", F.lit(0))).alias("p"), "geonameid", "latitude", "longitude")
    hubs = p.groupBy("name").agg(F.min(people).alias("h"), F.count("*").alias("n")).where("n > 1").select("name", "h")
    km = haversine_km(F.col("h.latitude"), F.col("h.longitude"), F.col("latitude"), F.col("longitude"))
    both = p.join(hubs, "name").where(F.col("geonameid") != F.col("h.geonameid"))
    return both.select("geonameid", F.col("h.geonameid").alias("hub"), F.round(km, 3).alias("km"))


STRAIN_SQL = r"(?:^|[^\p{L}\p{N}_\p{M}])(?:souche|s[eé]rotype|strain|ehec|epec|stec|ehe|o1\d{2,3}|o\d{1,2}[:\-]?h\d+|h\d+n\d+)(?:$|[^\p{L}\p{N}_\p{M}])"


@REGISTRY.add("pred7_strain", f"WITH {LATEST} SELECT doc_idx, coalesce(regexp_matches(text, '{STRAIN_SQL}', 'i'), false) AS has_strain FROM latest")
def pred7_strain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_texts(spark, sf_dir).select("doc_idx", F.coalesce(F.col("text").rlike(T.STRAIN), F.lit(False)).alias("has_strain"))


ARTIFACT_SQL = {
    "literal_escape": r"regexp_matches(text, '\\[nrtf]')",
    "html_entity": r"regexp_matches(text, '&(?:[a-zA-Z]+|#\d+);')",
    "control_char": r"regexp_matches(text, '[\x00-\x1f]')",
    "nbsp_or_zerowidth": r"regexp_matches(text, '[\x{00A0}\x{202F}\x{200B}\x{FEFF}\x{200E}\x{200F}]')",
    "double_space": "contains(text, '  ')",
    "long_dash": r"regexp_matches(text, '[\x{2010}\x{2012}\x{2013}\x{2014}\x{2015}]')",
    "edge_punct": r"regexp_matches(text, '^[^\p{L}\p{N}]|[^\p{L}\p{N}]$')",
    "case_glue": r"regexp_matches(text, '\p{Ll}\p{Lu}')",
}
FLAGS_SQL = f"SELECT DISTINCT text, {', '.join(f'{v} AS {k}' for k, v in ARTIFACT_SQL.items())} FROM entities WHERE text IS NOT NULL"
LONG_SQL = " UNION ALL ".join(f"SELECT '{k}' AS artifact, text FROM f WHERE {k}" for k in ARTIFACT_SQL)


def artifact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8 as one row per distinct text and artifact."""
    texts = table(spark, sf_dir, "entities").select("text").where("text is not null").distinct()
    flags = F.array_compact(F.array(*[F.when(test(F.col("text")), F.lit(name)) for name, test in T.ARTIFACTS.items()]))
    return texts.select("text", F.explode(flags).alias("artifact"))


@REGISTRY.add("pred8_artifacts", FLAGS_SQL)
def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "entities").select("text").where("text is not null").distinct()
    return texts.select("text", *[test(F.col("text")).alias(name) for name, test in T.ARTIFACTS.items()])


@REGISTRY.add("a2_artifact_report", f"WITH f AS ({FLAGS_SQL}) {LONG_SQL}")
def a2_artifact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifact_rows(spark, sf_dir).select("artifact", "text")


@REGISTRY.add(
    "a3_high_signal",
    f"""WITH f AS ({FLAGS_SQL}), l AS ({LONG_SQL}), r AS (SELECT artifact, text, row_number() OVER (PARTITION BY artifact ORDER BY text) AS k FROM l)
    SELECT artifact, count(*) AS n_texts, string_agg(text, ' | ' ORDER BY text) FILTER (k <= 3) AS examples FROM r
    WHERE artifact IN ('literal_escape', 'html_entity', 'control_char', 'nbsp_or_zerowidth') GROUP BY artifact""",
)
def a3_high_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: the count of each high-signal artifact and its first three texts, which is the report's feature."""
    from lexanchor.operators.cascade import ranked

    rows = artifact_rows(spark, sf_dir).where(F.col("artifact").isin(*T.HIGH_SIGNAL))
    first = ranked(rows, ["artifact"], [F.col("text")]).where("rank <= 3").groupBy("artifact").agg(F.array_join(F.array_sort(F.collect_list("text")), " | ").alias("examples"))
    return rows.groupBy("artifact").agg(F.count("*").alias("n_texts")).join(first, "artifact")
