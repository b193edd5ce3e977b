"""Queries of audits over both knowledge bases, of reranking in the linker, and of the error viewer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexanchor.functions import text as T
from lexanchor.operators import cascade as C
from lexanchor.operators import rerank as R
from lexanchor.plans import document_queries as Q
from lexanchor.plans import fragments as S
from lexanchor.plans import link_queries as L
from lexanchor.plans.linker import EntityLinker, KnowledgeBase, LinkerConfig
from lexanchor.plans.registry import Registry
from lexanchor.plans.text_queries import LATEST, STRAIN_SQL, latest_texts, mentions
from lexanchor.session import cut_lineage, table

REGISTRY = Registry()
_N = S.normalize("text")
_MEDICAL = S.isin("label", T.MEDICAL_LABELS)


def medical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, name)`` of descriptors and supplementals, one row each."""
    both = table(spark, sf_dir, "descriptors").select(F.col("dui").alias("id"), "name").unionByName(table(spark, sf_dir, "supplementals").select(F.col("sui").alias("id"), "name"))
    return both.where("id is not null").groupBy("id").agg(F.min("name").alias("name"))


NAMES = "mnames AS (SELECT id, min(name) AS name FROM (SELECT dui AS id, name FROM descriptors UNION ALL SELECT sui, name FROM supplementals) WHERE id IS NOT NULL GROUP BY id)"

# --- audits


@REGISTRY.add(
    "e9_coverage",
    rf"""WITH {S.PLACES}, {S.NAMES}, {L.TERMS}, {NAMES},
    g AS (SELECT 'GeoNames' AS kb, id_kb AS id, {_N} AS key FROM entities WHERE source = 'GeoNames' AND regexp_matches(id_kb, '^\d{{1,12}}$')
      UNION ALL SELECT 'MeSH', unnest(regexp_extract_all(id_kb, '[DC]\d{{6,9}}')), {_N} FROM entities WHERE source = 'MeSH'),
    i AS (SELECT DISTINCT kb, id, CASE WHEN kb = 'GeoNames' THEN id IN (SELECT geonameid FROM places) ELSE id IN (SELECT id FROM mnames) END AS known FROM g),
    k AS (SELECT DISTINCT kb, key, CASE WHEN kb = 'GeoNames' THEN key IN (SELECT key FROM names) ELSE key IN (SELECT key FROM entries) END AS found FROM g WHERE key IS NOT NULL),
    m AS (SELECT kb, id, row_number() OVER (PARTITION BY kb ORDER BY id) AS r FROM i WHERE NOT known)
    SELECT kb, n_ids, n_known, n_names, n_found, coalesce(misses, '') AS misses FROM (SELECT kb, count(*) AS n_ids, count(*) FILTER (known) AS n_known FROM i GROUP BY kb)
      JOIN (SELECT kb, count(*) AS n_names, count(*) FILTER (found) AS n_found FROM k GROUP BY kb) USING (kb)
      LEFT JOIN (SELECT kb, string_agg(id, ' ' ORDER BY id) AS misses FROM m WHERE r <= 5 GROUP BY kb) USING (kb)""",
)
def e9_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and names of linked mentions that each knowledge base has, and the first five ids that it lacks."""
    rows = table(spark, sf_dir, "entities").select("id_kb", "source", T.normalize("text").alias("key"))
    geo = rows.where("source = 'GeoNames'").where(F.col("id_kb").rlike(T.GEO_ID)).select(F.col("source").alias("kb"), F.col("id_kb").alias("id"), "key")
    mesh = rows.where("source = 'MeSH'").select(F.col("source").alias("kb"), F.explode(F.regexp_extract_all("id_kb", F.lit(r"[DC]\d{6,9}"), F.lit(0))).alias("id"), "key")
    both = geo.unionByName(mesh)
    known = L.places(spark, sf_dir).select(F.lit("GeoNames").alias("kb"), F.col("geonameid").alias("id")).unionByName(medical_names(spark, sf_dir).select(F.lit("MeSH").alias("kb"), "id"))
    keys = L.names(spark, sf_dir).select(F.lit("GeoNames").alias("kb"), "key").unionByName(L.entries(spark, sf_dir).select(F.lit("MeSH").alias("kb"), "key")).distinct()
    ids = both.select("kb", "id").distinct().join(known.withColumn("k", F.lit(1)), ["kb", "id"], "left")
    named = both.where("key is not null").select("kb", "key").distinct().join(keys.withColumn("f", F.lit(1)), ["kb", "key"], "left")
    first = C.ranked(ids.where("k is null"), ["kb"], [F.col("id")], "r").where("r <= 5").groupBy("kb").agg(F.array_join(F.array_sort(F.collect_list("id")), " ").alias("misses"))
    out = ids.groupBy("kb").agg(F.count("*").alias("n_ids"), F.count("k").alias("n_known")).join(named.groupBy("kb").agg(F.count("*").alias("n_names"), F.count("f").alias("n_found")), "kb")
    return out.join(first, "kb", "left").select("kb", "n_ids", "n_known", "n_names", "n_found", F.coalesce("misses", F.lit("")).alias("misses"))


@REGISTRY.add(
    "a9_ambiguity",
    f"""WITH {S.PLACES}, {S.NAMES}, {L.TERMS}, m AS (SELECT DISTINCT {_N} AS key, label = 'LOCATION' AS geo, CASE WHEN id_kb = '' THEN 'NIL' WHEN label = 'LOCATION' THEN 'GeoNames' ELSE 'MeSH' END AS kb
      FROM entities WHERE text IS NOT NULL AND id_kb IS NOT NULL AND (label = 'LOCATION' OR {_MEDICAL})),
    s AS (SELECT key, true AS geo, count(*) AS n FROM names GROUP BY key UNION ALL SELECT key, false, count(DISTINCT ui) FROM entries GROUP BY key),
    c AS (SELECT kb, coalesce(n, 0) AS n FROM m LEFT JOIN s USING (key, geo))
    SELECT kb, CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' ELSE '>20' END AS bucket, count(*) AS n_mentions FROM c GROUP BY 1, 2""",
)
def a9_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked mentions by knowledge base, and unlinked ones, by the number of their candidates."""
    rows = table(spark, sf_dir, "entities").where("text is not null and id_kb is not null").where((F.col("label") == "LOCATION") | F.col("label").isin(*T.MEDICAL_LABELS))
    geo = F.col("label") == "LOCATION"
    kb = F.when(F.col("id_kb") == "", "NIL").when(geo, "GeoNames").otherwise("MeSH")
    asked = rows.select(T.normalize("text").alias("key"), geo.alias("geo"), kb.alias("kb")).distinct()
    sizes = L.names(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n")).withColumn("geo", F.lit(True))
    sizes = sizes.unionByName(L.entries(spark, sf_dir).groupBy("key").agg(F.countDistinct("ui").alias("n")).withColumn("geo", F.lit(False)))
    n = F.coalesce("n", F.lit(0))
    bucket = F.when(n == 0, "0").when(n == 1, "1").when(n <= 5, "2-5").when(n <= 20, "6-20").otherwise(">20")
    return asked.join(sizes, ["key", "geo"], "left").groupBy("kb", bucket.alias("bucket")).agg(F.count("*").alias("n_mentions"))


_PLACE_LABEL = "concat(coalesce(p.name, ''), ' [', coalesce(p.feature_class, ''), '.', coalesce(p.feature_code, ''), '] cc=', coalesce(p.country_code, ''))"


@REGISTRY.add(
    "x9_id_labels",
    rf"""WITH {S.PLACES}, {NAMES}, t AS (
      SELECT DISTINCT id_kb, unnest(CASE WHEN source = 'GeoNames' THEN [id_kb] ELSE regexp_extract_all(id_kb, '[DC]\d+') END) AS id, source FROM entities WHERE source IN ('GeoNames', 'MeSH') AND id_kb <> '')
    SELECT DISTINCT id_kb, t.id, CASE WHEN p.geonameid IS NOT NULL THEN {_PLACE_LABEL} WHEN n.id IS NOT NULL THEN coalesce(n.name, '(no name)') ELSE 'NOT FOUND' END AS label
    FROM t LEFT JOIN places p ON p.geonameid = t.id AND source = 'GeoNames' LEFT JOIN mnames n ON n.id = t.id AND source = 'MeSH'""",
)
def x9_id_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each id of a link stands for, or that no knowledge base has it."""
    rows = table(spark, sf_dir, "entities").where("source in ('GeoNames', 'MeSH') and id_kb <> ''").select("id_kb", "source").distinct()
    ids = F.when(F.col("source") == "GeoNames", F.array("id_kb")).otherwise(F.regexp_extract_all("id_kb", F.lit(r"[DC]\d+"), F.lit(0)))
    rows = rows.select("id_kb", "source", F.explode(ids).alias("id")).distinct()
    none = F.lit("")
    place = F.concat(F.coalesce("name", none), F.lit(" ["), F.coalesce("feature_class", none), F.lit("."), F.coalesce("feature_code", none), F.lit("] cc="), F.coalesce("country_code", none))
    labels = L.places(spark, sf_dir).select(F.lit("GeoNames").alias("source"), F.col("geonameid").alias("id"), place.alias("label"))
    labels = labels.unionByName(medical_names(spark, sf_dir).select(F.lit("MeSH").alias("source"), "id", F.coalesce("name", F.lit("(no name)")).alias("label")))
    return rows.join(labels, ["source", "id"], "left").select("id_kb", "id", F.coalesce("label", F.lit("NOT FOUND")).alias("label")).distinct()


@REGISTRY.add(
    "u6_pairs",
    f"""WITH lit AS (SELECT {S.normalize('ref_name')} AS key, ref_id AS id FROM refnames),
    cache AS (SELECT {S.normalize('name_lower')} AS key, geonameid AS id FROM place_names WHERE geonameid IS NOT NULL AND name_lower IS NOT NULL)
    SELECT key, id FROM lit UNION SELECT key, id FROM cache""",
)
def u6_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal pairs of name and id with the exploded lists of a cache, as one set."""
    literal = table(spark, sf_dir, "refnames").select(T.normalize("ref_name").alias("key"), F.col("ref_id").alias("id"))
    rows = table(spark, sf_dir, "place_names").where("geonameid is not null and name_lower is not null")
    cache = rows.groupBy(T.normalize("name_lower").alias("key")).agg(F.collect_set("geonameid").alias("ids")).select("key", F.explode("ids").alias("id"))
    return literal.unionByName(cache).distinct()


# --- reranking


def term_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, ord, name)``: the name of each medical id, then up to three terms of its preferred concept."""
    preferred = F.try_element_at(F.filter("concepts", lambda c: F.coalesce(c["preferred"], F.lit(False))), F.lit(1))
    both = table(spark, sf_dir, "descriptors").select(F.col("dui").alias("id"), "name", preferred["terms"].alias("terms"))
    both = both.unionByName(table(spark, sf_dir, "supplementals").select(F.col("sui").alias("id"), "name", preferred["terms"].alias("terms")))
    one = both.where("id is not null").groupBy("id").agg(F.min(F.struct("name", "terms")).alias("r")).select("id", "r.*")
    kept = F.filter(F.slice(F.coalesce("terms", F.array().cast("array<string>")), 1, 3), lambda x: x.isNotNull() & (x != ""))
    return one.select("id", F.posexplode(F.concat(F.array(F.coalesce("name", F.lit(""))), kept)).alias("ord", "name"))


_PREFERRED = "list_filter(concepts, lambda c: coalesce(c.preferred, false))[1].terms"
TERM_NAMES = f"""tn AS (SELECT id, list_concat([coalesce(r.name, '')], list_filter(coalesce(r.terms, [])[1:3], lambda x: x IS NOT NULL AND x <> '')) AS names FROM (
  SELECT id, (list(r ORDER BY r NULLS FIRST))[1] AS r FROM (SELECT dui AS id, {{'name': name, 'terms': {_PREFERRED}}} AS r FROM descriptors UNION ALL SELECT sui, {{'name': name, 'terms': {_PREFERRED}}} FROM supplementals)
  WHERE id IS NOT NULL GROUP BY id))"""


@REGISTRY.add(
    "l2_prompt",
    f"""WITH {L.TERMS}, {TERM_NAMES}, c AS (SELECT key, ui, row_number() OVER (PARTITION BY key ORDER BY ui) AS r FROM (SELECT DISTINCT key, ui FROM entries))
    SELECT key, string_agg(concat('[', r - 1, '] ', ui, ' — ', array_to_string(names, ' | ')), chr(10) ORDER BY r) AS lines FROM c JOIN tn ON tn.id = c.ui WHERE r <= 10 GROUP BY key""",
)
def l2_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: the first ten ids of each term as numbered lines with their names and synonyms."""
    candidates = C.ranked(L.entries(spark, sf_dir).select("key", F.col("ui").alias("id")).distinct(), ["key"], [F.col("id")], "rank")
    return R.term_lines(candidates, term_names(spark, sf_dir), ["key"], 10).select("key", "lines")


def _case(names: dict[str, str]) -> str:
    return "CASE feature_code " + " ".join(f"WHEN {S.quote(k)} THEN {S.quote(v)}" for k, v in names.items()) + " ELSE feature_code END"


@REGISTRY.add(
    "t19_code_names",
    f"SELECT DISTINCT feature_code, {_case(R.CODE_NAMES)} AS en, {_case({**R.CODE_NAMES, **R.CODE_NAMES_FR})} AS fr FROM locations WHERE feature_code IS NOT NULL",
)
def t19_code_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the feature codes in both languages."""
    code = F.col("feature_code")
    return table(spark, sf_dir, "locations").where("feature_code is not null").select("feature_code", R.code_name(code).alias("en"), R.code_name(code, "fr").alias("fr")).distinct()


_MENTION = "concat(key, CASE WHEN wants_admin THEN ' (admin)' ELSE '' END)"


@REGISTRY.add(
    "c5_disambiguate",
    f"""{L.BASE}, {L.POOL}, {Q.LINES}, q AS (SELECT key, wants_admin, n, ids, length(concat('Mention: ', {_MENTION}, chr(10), 'Context: ', chr(10), 'Candidates:', chr(10), lines, chr(10),
      'Reply with the number of the right candidate only, or -1 if none is right.')) % (n + 2) AS k FROM lines WHERE n >= 2),
    picked AS (SELECT pool.*, CASE WHEN k < q.n THEN q.ids[CAST(k AS INT) + 1] END AS picked, coalesce(k = q.n, false) AS abstains FROM pool LEFT JOIN q USING (key, wants_admin)),
    {L.choose_sql('picked', 'key, wants_admin', f"CASE WHEN geonameid = picked THEN -1 ELSE {L._TIER} END")},
    ab AS (SELECT key, wants_admin, bool_or(abstains) AS abstains FROM picked GROUP BY key, wants_admin)
    SELECT key, wants_admin, CASE WHEN abstains THEN '' ELSE geonameid END AS id FROM chosen JOIN ab USING (key, wants_admin)""",
)
def c5_disambiguate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5 by the linker itself: a model chooses of two or more candidates, its choice is reconciled, abstaining gives no link, no usable reply the heuristic's."""
    by = ["key", "wants_admin"]
    config = LinkerConfig(rerank=R.RerankConfig(enabled=True, max_candidates=5, allow_abstain=True))
    kb = KnowledgeBase(L.places(spark, sf_dir), L.names(spark, sf_dir), L.entries(spark, sf_dir))
    pool = cut_lineage(L.exact_pool(spark, sf_dir))
    asked = pool.select(F.concat("key", F.when(F.col("wants_admin"), " (admin)").otherwise("")).alias("mention"), *by).distinct()
    chosen = EntityLinker(kb, config, Q.length_model, rules=False)._choose(asked, pool, by, asked.select("mention", F.lit("").alias("context")))
    return asked.join(chosen, "mention").select(*by, "id")


_STRAIN_NAME = "concat(coalesce(name, ''), CASE WHEN CAST(right(id, 1) AS INT) % 3 = 0 THEN ' O104:H4' ELSE '' END)"


@REGISTRY.add(
    "c7_strain",
    f"""WITH {L.TERMS}, {NAMES}, {LATEST}, ctx AS (SELECT DISTINCT mention_id, substring(l.text, greatest(s - 200, 0) + 1, greatest(e + 200 - greatest(s - 200, 0), 0)) AS context FROM (
        SELECT mention_id, doc_idx, {S.first_int('start_pos')} AS s, {S.first_int('end_pos')} AS e FROM entities WHERE {_MEDICAL}) JOIN latest l USING (doc_idx) WHERE s IS NOT NULL AND e IS NOT NULL AND l.text IS NOT NULL),
    m AS (SELECT DISTINCT mention_id, {_N} AS key FROM entities WHERE {_MEDICAL} AND text IS NOT NULL),
    c0 AS (SELECT DISTINCT mention_id, ui, list_filter(list_transform(coalesce(mapped_to, []), lambda x: trim(x, '*')), lambda x: x IS NOT NULL AND x <> '') AS more FROM m JOIN entries USING (key)),
    c1 AS (SELECT mention_id, ui, unnest(list_prepend(ui, more)) AS id, generate_subscripts(list_prepend(ui, more), 1) AS pos FROM c0),
    c2 AS (SELECT mention_id, id, row_number() OVER (PARTITION BY mention_id ORDER BY min({{'u': ui, 'p': pos}}), id) AS rank FROM c1 GROUP BY mention_id, id),
    c3 AS (SELECT *, max(rank) OVER (PARTITION BY mention_id) AS n FROM c2),
    h AS (SELECT mention_id, id, row_number() OVER (PARTITION BY mention_id ORDER BY rank) AS r FROM c3 JOIN ctx USING (mention_id) JOIN mnames USING (id)
      WHERE n >= 2 AND regexp_matches(context, '{STRAIN_SQL}', 'i') AND regexp_matches(lower({_STRAIN_NAME}), 'o104|o157|ehec|stec'))
    SELECT mention_id, id FROM h WHERE r = 1""",
)
def c7_strain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7 over the candidates of each medical mention, a supplemental and what it's mapped to, and the text around it.

    The tables name no strains, so names of every third id get one; candidates and contexts are the tables' own.
    """
    rows = mentions(spark, sf_dir).where(F.col("label").isin(*T.MEDICAL_LABELS))
    at = rows.select("mention_id", "doc_idx", T.first_span("start_pos").alias("s"), T.first_span("end_pos").alias("e")).distinct().where("s is not null and e is not null")
    contexts = at.join(latest_texts(spark, sf_dir).where("text is not null"), "doc_idx").select("mention_id", T.context("text", "s", "e").alias("context")).distinct()
    stars = F.transform(F.coalesce("mapped_to", F.array().cast("array<string>")), lambda x: F.regexp_replace(x, r"^\*+|\*+$", ""))
    every = F.concat(F.array("ui"), F.filter(stars, lambda x: x.isNotNull() & (x != "")))
    keys = rows.where("text is not null").select("mention_id", T.normalize("text").alias("key")).distinct()
    found = keys.join(L.entries(spark, sf_dir), "key").select("mention_id", "ui", F.posexplode(every).alias("pos", "id"))
    listed = found.groupBy("mention_id", "id").agg(F.min(F.struct("ui", "pos")).alias("ord"))
    ranked = C.ranked(listed, ["mention_id"], [F.col("ord"), F.col("id")], "rank").join(contexts, "mention_id")
    strain = F.when(F.right("id", F.lit(1)).cast("int") % 3 == 0, " O104:H4").otherwise("")
    named = medical_names(spark, sf_dir).select("id", F.lit(0).alias("ord"), F.concat(F.coalesce("name", F.lit("")), strain).alias("name"))
    return R.strain_choice(ranked, named, ["mention_id"])


# --- the error viewer


@REGISTRY.add(
    "t17_highlight",
    rf"""WITH {LATEST}, z AS (SELECT doc_idx, regexp_extract_all(start_pos, '\d+') AS ss, regexp_extract_all(end_pos, '\d+') AS es FROM entities WHERE start_pos IS NOT NULL AND end_pos IS NOT NULL),
    y AS (SELECT doc_idx, ss, es, unnest(range(1, least(len(ss), len(es)) + 1)) AS k FROM z),
    d AS (SELECT doc_idx, text, list(DISTINCT {{'s': CAST(ss[k] AS INT), 'e': CAST(es[k] AS INT)}}) AS xs FROM latest JOIN y USING (doc_idx) WHERE text IS NOT NULL GROUP BY doc_idx, text),
    c AS (SELECT *, list_sort(list_distinct(list_concat([0, length(text)::INT], list_transform(xs, lambda x: x.s), list_transform(xs, lambda x: x.e)))) AS cuts FROM d),
    u AS (SELECT doc_idx, text, xs, cuts, unnest(range(1, len(cuts))) AS i FROM c),
    v AS (SELECT doc_idx, i, len(cuts) AS n_cuts, len(list_filter(xs, lambda x: x.s <= cuts[i] AND cuts[i + 1] <= x.e)) > 0 AS inside,
      replace(replace(replace(replace(replace(substring(text, cuts[i] + 1, cuts[i + 1] - cuts[i]), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS chunk FROM u)
    SELECT doc_idx, CAST(any_value(n_cuts) AS INT) AS n_cuts, string_agg(CASE WHEN inside THEN concat('<mark>', chunk, '</mark>') ELSE chunk END, '' ORDER BY i) AS html FROM v GROUP BY doc_idx""",
)
def t17_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as HTML with its mentions marked."""
    found = mentions(spark, sf_dir).select("doc_idx", F.explode(T.spans("start_pos", "end_pos")).alias("x")).groupBy("doc_idx").agg(F.collect_set("x").alias("xs"))
    docs = latest_texts(spark, sf_dir).where("text is not null").join(found, "doc_idx")
    return docs.select("doc_idx", F.size(T.cut_points("text", "xs")).alias("n_cuts"), T.highlight("text", "xs").alias("html"))
