"""The whole linker as a library: knowledge base, configuration, linking of mentions and of documents."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexanchor.functions import text as T
from lexanchor.operators import cascade as C
from lexanchor.operators import documents as D
from lexanchor.operators import places as P
from lexanchor.operators import rerank as R
from lexanchor.operators import vocabulary as V
from lexanchor.session import cut_lineage, exists

#: Small maps that a user may supply, with their columns.
MAPS = {
    "aliases": "key string, id string",  # fixed names of places
    "adjectives": "key string, id string",  # "territoire X", X without accents
    "continents": "key string, id string",  # "(le) continent X", X without accents
    "overrides": "key string, label string, id string",
    "manual": "key string, id string",
    "exonyms": "key string, ord int, id string",
    "memory": "key string, label string, id_kb string",
    "ambiguous": "key string, label string, ord int, id string",  # lists that only a model decides
    "term_names": "id string, ord int, name string",  # names and synonyms for prompts and the strain rule
}


@dataclass(frozen=True)
class LinkerConfig:
    """``test_informed`` keeps flagged rows of the maps, which are dropped by default."""

    use_memory: bool = True
    fallbacks: bool = True
    test_informed: bool = False
    context_window: int = 200
    rerank: R.RerankConfig = field(default_factory=R.RerankConfig)


@dataclass
class KnowledgeBase:
    """Dimensions as DataFrames; maps that are missing count as empty."""

    places: DataFrame
    names: DataFrame
    entries: DataFrame
    bilingual: DataFrame | None = None  # key, id, ord, cats
    maps: dict[str, DataFrame] = field(default_factory=dict)

    def map(self, name: str, config: LinkerConfig) -> DataFrame:
        found = self.maps.get(name)
        if found is None:
            return self.places.sparkSession.createDataFrame([], MAPS[name])
        if "flag" in found.columns and not config.test_informed:
            found = found.where("flag is null or not flag")
        return found.drop("flag")

    def write(self, folder: str) -> None:
        self.places.write.mode("overwrite").parquet(f"{folder}/places")
        self.names.write.mode("overwrite").parquet(f"{folder}/names")
        self.entries.write.mode("overwrite").parquet(f"{folder}/entries")
        if self.bilingual is not None:
            self.bilingual.write.mode("overwrite").parquet(f"{folder}/bilingual")
        for name, df in self.maps.items():
            df.write.mode("overwrite").parquet(f"{folder}/map_{name}")

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> KnowledgeBase:
        def have(name: str) -> bool:
            return exists(spark, f"{folder}/{name}")

        maps = {m: spark.read.parquet(f"{folder}/map_{m}") for m in MAPS if have(f"map_{m}")}
        other = spark.read.parquet(f"{folder}/bilingual") if have("bilingual") else None
        return cls(*(spark.read.parquet(f"{folder}/{n}") for n in ("places", "names", "entries")), other, maps)


def periphrases(mentions: DataFrame, aliases: DataFrame, adjectives: DataFrame, continents: DataFrame) -> DataFrame:
    """``(mention, id)`` by alias, "territoire X" and "(le) continent X"; bare adjectives stay unresolved."""
    norm = mentions.select("mention", T.normalize("mention").alias("norm")).withColumn("plain", T.remove_accents("norm"))
    country = F.nullif(F.regexp_extract("norm", r"^territoire ([\p{L}\p{N}\p{M}_-]+)\z", 1), F.lit(""))
    continent = F.nullif(F.regexp_extract("norm", r"^(?:le )?continent ([\p{L}\p{N}\p{M}_-]+)\z", 1), F.lit(""))
    norm = norm.withColumns({"adjective": T.remove_accents(country), "region": T.remove_accents(continent)})
    plain = adjectives.select(T.remove_accents("key").alias("adjective"), "id").groupBy("adjective").agg(F.min("id").alias("id"))
    lookups = [
        (["norm"], aliases.withColumnRenamed("key", "norm"), "id"), (["plain"], aliases.withColumnRenamed("key", "plain"), "id"),
        (["adjective"], plain, "id"), (["region"], continents.withColumnRenamed("key", "region"), "id"),
    ]
    return C.by_first_hit(norm, lookups, "id").where("id is not null").select("mention", "id")


def asked_rows(mentions: DataFrame, by: list[str]) -> DataFrame:
    """Distinct mentions in their contexts; a missing context is empty."""
    context = F.col("context") if "context" in mentions.columns else F.lit(None).cast("string")
    return mentions.select(*by, F.coalesce(context, F.lit("")).alias("context")).where("mention is not null").distinct()


def exonym_pool(mentions: DataFrame, exonyms: DataFrame, places: DataFrame) -> DataFrame:
    """J3, last stage of C2: candidates of a frozen map in its order, reloaded from the places, without roads and buildings."""
    keyed = mentions.select("mention", T.normalize("mention").alias("key"), T.wants_admin("mention").alias("wants_admin"))
    pool = keyed.join(exonyms.select("key", "ord", F.col("id").alias("geonameid")), "key").join(places, "geonameid")
    pool = pool.where("coalesce(feature_class, '') not in ('R', 'S')")
    return pool.withColumn("pool_order", F.struct("ord", "geonameid"))


def by_exonym(mentions: DataFrame, exonyms: DataFrame, places: DataFrame) -> DataFrame:
    return P.choose_place(exonym_pool(mentions, exonyms, places), ["mention"]).select("mention", "geonameid")


def with_context(flat: DataFrame, corpus: DataFrame, window: int) -> DataFrame:
    """Mentions with ``context``: their text and so many characters before and after its first span."""
    start, end = (F.regexp_extract(F.col(c).cast("string"), r"\d+", 0).try_cast("int") for c in ("start", "end"))  # a number or a list of them
    begin, end = F.greatest(start - window, F.lit(0)), end + window
    texts = corpus.select("doc_idx", F.col("text").alias("_text"))
    return flat.join(texts, "doc_idx", "left").withColumn("context", F.col("_text").substr(begin + 1, end - begin)).drop("_text")


class EntityLinker:
    """Memory, lexical filter, then the linker of the label; ``model`` is only called if reranking is enabled.

    Reranking then decides between two or more candidates per mention and context (C5, C4, C7),
    where neither memory nor the filter has spoken; a missing context counts as empty.
    """

    def __init__(self, kb: KnowledgeBase, config: LinkerConfig | None = None, model: R.Model | None = None, rules: bool = True):
        self.kb, self.config, self.model = kb, config or LinkerConfig(), model
        self.rules = rules  # whether prompts say how to choose
        if self.config.rerank.enabled and model is None:
            raise ValueError("reranking is enabled, but there is no model")

    def _choose(self, first: DataFrame, pool: DataFrame, by: list[str], asked: DataFrame) -> DataFrame:
        """``(mention, context, id)``: the model's choice is reconciled, abstaining gives "", the heuristic's stands without a reply."""
        config = self.config.rerank
        numbered = C.ranked(pool, by, [F.col("pool_order")], "pool_rank")
        lists = R.place_lines(numbered, by, config.max_candidates, config.language).join(numbered.where("pool_rank = 2").select(*by), by, "left_semi")
        mine = asked.join(first.select("mention", *by), "mention")
        questions = mine.join(lists, by).select(
            "mention", "context", R.prompt(F.col("mention"), F.col("context"), F.col("lines"), config, "place" if self.rules else "").alias("prompt"),
            F.size("ids").alias("n"), "ids", F.lit(None).cast("string").alias("fallback"),
        )
        replies = cut_lineage(R.rerank(questions, self.model, config, ["mention", "context"]).withColumnRenamed("id", "picked"))
        mine = mine.join(replies, ["mention", "context"], "left")
        picks = mine.where("status = 'chosen'").select(*by, "picked").distinct()
        reconciled = P.choose_place(pool.join(picks, by), [*by, "picked"], "picked").select(*by, "picked", F.col("geonameid").alias("_model"))
        plain = P.choose_place(pool, by).select(*by, F.col("geonameid").alias("_plain"))
        out = mine.join(plain, by).join(reconciled, [*by, "picked"], "left")
        return out.select("mention", "context", F.when(F.col("status") == "abstain", "").otherwise(F.coalesce("_model", "_plain")).alias("id"))

    def _rerank_places(self, asked: DataFrame) -> DataFrame:
        """``(mention, context, id)`` of distinct place mentions in their contexts by all stages of C2."""
        kb, config = self.kb, self.config
        mentions = asked.select("mention").distinct()
        known = periphrases(mentions, *(kb.map(m, config) for m in ("aliases", "adjectives", "continents")))
        rest = mentions.join(known, "mention", "left_anti")
        first, pool = P.place_pools(rest, kb.names, kb.places, config.fallbacks)
        out = asked.join(known, "mention").select("mention", "context", "id").unionByName(self._choose(first, pool, P.POOL_BY, asked))
        if config.test_informed and "exonyms" in kb.maps:
            last = exonym_pool(rest.join(first, "mention", "left_anti"), kb.map("exonyms", config), kb.places)
            out = out.unionByName(self._choose(last.select("mention").distinct(), last, ["mention"], asked))
        return out

    def _ask_terms(self, candidates: DataFrame) -> DataFrame:
        """``(mention, label, context, id)`` that the strain rule, else the model, chooses of ``candidates(mention, label, context, ord, id)``."""
        by = ["mention", "label", "context"]
        config = replace(self.config.rerank, allow_abstain=False)  # terms have no abstention
        names = self.kb.map("term_names", self.config)
        listed = C.ranked(candidates.groupBy(*by, "id").agg(F.min("ord").alias("ord")), by, [F.col("ord"), F.col("id")], "rank")
        forced = R.strain_choice(listed, names, by)
        lists = R.term_lines(listed.join(forced, by, "left_anti"), names, by, config.max_candidates, self.kb.bilingual, config.language)
        questions = lists.select(
            *by, R.prompt(F.col("mention"), F.col("context"), F.col("lines"), config, "term" if self.rules else "").alias("prompt"),
            F.size("ids").alias("n"), "ids", F.lit(None).cast("string").alias("fallback"),
        )
        chosen = R.rerank(questions, self.model, config, by).where("status = 'chosen'").select(*by, "id")
        return cut_lineage(forced.unionByName(chosen))

    def _rerank_terms(self, asked: DataFrame) -> DataFrame:
        """C4 with the model: ``(mention, label, context, id)``: ambiguous lists first, then it overrides the pick of several bilingual ids."""
        by, kb, config = ["mention", "label", "context"], self.kb, self.config
        plain = self._term_choices(asked.select("mention", "label").distinct())
        out = asked.join(plain, ["mention", "label"], "left")
        norm = asked.withColumn("norm", T.normalize("mention")).withColumn("plain", T.remove_accents("norm"))
        lists = kb.map("ambiguous", config).select("key", "label", "ord", "id")
        by_norm = norm.join(lists.withColumnRenamed("key", "norm"), ["norm", "label"])
        by_plain = norm.join(by_norm.select(*by).distinct(), by, "left_anti").join(lists.withColumnRenamed("key", "plain"), ["plain", "label"])
        decided = self._ask_terms(by_norm.select(*by, "ord", "id").unionByName(by_plain.select(*by, "ord", "id")))
        out = out.join(decided.withColumnRenamed("id", "_ambiguous"), by, "left")
        chosen = [F.col("_ambiguous"), F.col("by_map"), F.col("bilingual"), F.col("english")]
        if kb.bilingual is not None:
            open_ = out.where("_ambiguous is null and by_map is null").select(*by)
            hit = C.first_stage(V.term_stages(open_.select("mention").distinct()), kb.bilingual.select("key").distinct(), ["mention"])
            found = hit.join(kb.bilingual, "key").select("mention", "ord", "id")
            several = found.groupBy("mention").agg(F.countDistinct("id").alias("n")).where("n >= 2").select("mention")
            decided = self._ask_terms(open_.join(found.join(several, "mention", "left_semi"), "mention"))
            out = out.join(decided.withColumnRenamed("id", "_model"), by, "left")
            chosen.insert(2, F.col("_model"))
        return out.select(*by, F.coalesce(*chosen).alias("id")).where("id is not null")

    def link_places(self, mentions: DataFrame) -> DataFrame:
        """``(mention, id)`` of distinct place mentions by all stages of C2; with reranking ``(mention, context, id)``, id "" where the model abstains."""
        kb, config = self.kb, self.config
        if config.rerank.enabled:
            return self._rerank_places(asked_rows(mentions, ["mention"]))
        mentions = mentions.select("mention").where("mention is not null").distinct()
        known = periphrases(mentions, *(kb.map(m, config) for m in ("aliases", "adjectives", "continents")))
        rest = mentions.join(known, "mention", "left_anti")
        linked = P.link_places(rest, kb.names, kb.places, config.fallbacks).select("mention", F.col("geonameid").alias("id"))
        out = known.unionByName(linked)
        if config.test_informed and "exonyms" in kb.maps:
            last = by_exonym(rest.join(linked, "mention", "left_anti"), kb.map("exonyms", config), kb.places)
            out = out.unionByName(last.select("mention", F.col("geonameid").alias("id")))
        return out

    def link_terms(self, mentions: DataFrame) -> DataFrame:
        """C4: ``(mention, label, id)``: overrides, manual map, bilingual terms, English index; with reranking a context each."""
        if self.config.rerank.enabled:
            return self._rerank_terms(asked_rows(mentions, ["mention", "label"]))
        found = self._term_choices(mentions)
        return found.select("mention", "label", F.coalesce("by_map", "bilingual", "english").alias("id")).where("id is not null")

    def _term_choices(self, mentions: DataFrame) -> DataFrame:
        """``(mention, label, by_map, bilingual, english)``: what each stage of C4 finds without a model."""
        kb, config = self.kb, self.config
        pairs = mentions.select("mention", "label").where("mention is not null").distinct()
        norm = pairs.withColumn("norm", T.normalize("mention")).withColumn("plain", T.remove_accents("norm"))
        overrides, manual = kb.map("overrides", config), kb.map("manual", config)
        by_map = [
            (["norm", "label"], overrides.withColumnRenamed("key", "norm"), "id"), (["plain", "label"], overrides.withColumnRenamed("key", "plain"), "id"),
            (["norm"], manual.withColumnRenamed("key", "norm"), "id"), (["plain"], manual.withColumnRenamed("key", "plain"), "id"),
        ]
        first = C.by_first_hit(norm, by_map, "by_map").select("mention", "label", "by_map")
        english = V.link_terms(pairs, kb.entries).select("mention", F.col("id").alias("english"))
        out = first.join(english, "mention", "left")
        if kb.bilingual is not None:
            keys = kb.bilingual.select("key").distinct()
            hit = C.first_stage(V.term_stages(pairs.select("mention").distinct()), keys, ["mention"])
            found = pairs.join(hit, "mention").join(kb.bilingual, "key").withColumn("compat", V.compatible(F.col("cats"), F.col("label")))
            picked = V.pick_compatible(found, ["mention", "label"]).select("mention", "label", F.col("id").alias("bilingual"))
            out = out.join(picked, ["mention", "label"], "left")
        else:
            out = out.withColumn("bilingual", F.lit(None).cast("string"))
        return out.select("mention", "label", "by_map", "bilingual", "english")

    def link(self, entities: DataFrame) -> DataFrame:
        """``entities(text, label, ...)`` with ``id_kb``, ``source`` and ``decision`` put for what they had; no link is ('', '').

        With reranking a column ``context`` has the text around each mention.
        """
        config = self.config
        nil = T.likely_nil("text", "label")
        rows = entities.drop("id_kb", "source", "decision").withColumn("_key", T.normalize("text"))
        by, open_ = ["text", "label"], rows
        if config.rerank.enabled:  # the model isn't asked about what memory or the filter decides
            by = [*by, "_context"]
            rows = rows.withColumn("_context", F.coalesce(F.col("context") if "context" in rows.columns else F.lit(None).cast("string"), F.lit("")))
            open_ = rows.where(~F.coalesce(nil, F.lit(False)))
            if config.use_memory:
                open_ = open_.join(self.kb.map("memory", config).where("id_kb is not null").select(F.col("key").alias("_key"), "label"), ["_key", "label"], "left_anti")
            open_ = open_.select("text", "label", F.col("_context").alias("context"))
        labels = open_.select(F.col("text").alias("mention"), "label", *(["context"] if config.rerank.enabled else [])).distinct()
        geo = self.link_places(labels.where("label = 'LOCATION'")).withColumn("label", F.lit("LOCATION"))
        med = self.link_terms(labels.where(F.col("label").isin(*T.MEDICAL_LABELS)))
        found = geo.unionByName(med.select(*geo.columns)).withColumnsRenamed({"mention": "text", "context": "_context"})
        rows = rows.join(found, by, "left")
        remembered = F.lit(None).cast("string")
        if config.use_memory:
            memory = self.kb.map("memory", config).select(F.col("key").alias("_key"), "label", F.col("id_kb").alias("_memory"))
            rows = rows.join(memory, ["_key", "label"], "left")
            remembered = F.col("_memory")
        id_kb = F.when(remembered.isNotNull(), remembered).when(nil, "").otherwise(F.coalesce("id", F.lit("")))
        decision = F.when(remembered.isNotNull(), "memory").when(nil, "nil").when(F.coalesce("id", F.lit("")) == "", "none").when(F.col("label") == "LOCATION", "place").otherwise("term")
        source = F.when(id_kb == "", "").when(F.col("label") == "LOCATION", "GeoNames").otherwise("MeSH")
        return rows.withColumns({"id_kb": id_kb, "source": source, "decision": decision}).drop("_key", "_memory", "_context", "id")

    def link_entity(self, text: str, label: str, context: str | None = None) -> tuple[str, str]:
        """Id and source of one mention; ('', '') for none."""
        one = self.kb.places.sparkSession.createDataFrame([(text, label, context)], "text string, label string, context string")
        row = self.link(one).first()
        return row["id_kb"], row["source"]

    def process_documents(self, corpus: DataFrame) -> DataFrame:
        """Documents ``(doc_idx, text, entities)`` with every mention linked, acronyms propagated, order kept."""
        flat = corpus.select("doc_idx", F.posexplode("entities").alias("ent_idx", "e")).select("doc_idx", "ent_idx", "e.*")
        if self.config.rerank.enabled:
            linked = self.link(with_context(flat, corpus, self.config.context_window)).drop("context")
        else:
            linked = self.link(flat)
        new = D.propagate_acronyms(linked.select("doc_idx", "ent_idx", "text", "label", "id_kb", "source"), corpus.select("doc_idx", "text"))
        new = new.select("doc_idx", "ent_idx", F.col("id_kb").alias("_id"), F.col("source").alias("_source"))
        out = linked.join(new, ["doc_idx", "ent_idx"], "left").withColumns(
            {"id_kb": F.coalesce("_id", "id_kb"), "source": F.coalesce("_source", "source")}
        )
        fields = [c for c in flat.columns if c not in ("doc_idx", "ent_idx", "id_kb", "source")]
        nested = D.nest(out.select("doc_idx", "ent_idx", *fields, "id_kb", "source"))
        bare = F.transform("entities", lambda e: F.struct(*[e[f].alias(f) for f in (*fields, "id_kb", "source")]))
        return corpus.drop("entities").join(nested.select("doc_idx", bare.alias("entities")), "doc_idx", "left")
