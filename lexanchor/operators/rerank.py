"""Closed-list reranking: prompts, an injected model, parsing of replies, votes.

A reranker may only choose an index of the list it is given. Its result has three states:
``chosen`` with an id, ``abstain`` (no candidate is right, which means no link), and ``none``
(no usable reply, on which the deterministic choice stands).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexanchor.functions import text as T

#: A model: the prompt and the number of candidates to the reply.
Model = Callable[[str, int], str]

# Names of feature codes in prompts.
CODE_NAMES = {
    "PCLI": "country", "PCLD": "dependent territory", "PCLF": "freely associated state", "PPLC": "capital city",
    "PPLA": "administrative seat", "PPLA2": "sub-prefecture", "PPLA3": "regional seat", "PPLA4": "local seat",
    "ADM1": "state/region", "ADM2": "department/province", "ADM3": "district", "ADM4": "municipality",
    "PPL": "populated place", "PPLX": "neighborhood", "RGN": "geographic region", "STM": "river", "MTS": "mountains",
    "MT": "mountain", "PPLL": "populated locality", "FRM": "farm", "RSTN": "railway station",
}


CODE_NAMES_FR = {
    "PCLI": "pays", "PCLD": "territoire dépendant", "PCLF": "État librement associé", "PPLC": "capitale",
    "PPLA": "siège administratif", "PPLA2": "siège admin. niveau 2", "PPLA3": "siège admin. niveau 3",
    "PPLA4": "siège admin. niveau 4", "PPL": "localité", "PPLX": "quartier / partie de ville", "ADM1": "région / état",
    "ADM2": "département / comté", "ADM3": "arrondissement", "ADM4": "commune", "RGN": "région", "ISL": "île",
    "ISLS": "îles", "LK": "lac", "STM": "rivière", "MTS": "montagnes", "MT": "montagne", "PPLL": "lieu peuplé",
    "FRM": "exploitation agricole", "RSTN": "gare ferroviaire",
}
# Names of the vocabulary's categories in prompts.
CATEGORY_NAMES = {
    "en": {
        "a": "Anatomy", "b": "Organisms", "c": "Diseases", "d": "Chemicals and Drugs", "e": "Techniques and Equipment",
        "f": "Psychiatry and Psychology", "g": "Biological Sciences", "h": "Physical Sciences", "i": "Anthropology",
        "j": "Technology and Food", "k": "Humanities", "l": "Information Science", "m": "Persons", "n": "Health Care",
        "v": "Publication Type", "z": "Geography",
    },
    "fr": {
        "a": "Anatomie", "b": "Organismes", "c": "Maladies", "d": "Substances chimiques et médicaments",
        "e": "Techniques et équipements", "f": "Psychiatrie et psychologie", "g": "Sciences biologiques",
        "h": "Sciences physiques", "i": "Anthropologie, éducation, sociologie", "j": "Technologie, industrie, agriculture",
        "k": "Sciences humaines", "l": "Information", "m": "Personnes", "n": "Soins de santé",
        "v": "Caractéristiques de publication", "z": "Localisations géographiques",
    },
}
#: What a model is told about choosing, by kind of mention and language.
RULES = {
    ("place", "en"): "\nThe country or region that the context speaks of decides; population only between candidates that fit it. A well-known city goes before the division around it; of a French town that is listed both as a populated place and as a municipality, take the municipality unless the context says otherwise.",
    ("place", "fr"): "\nLe pays ou la région dont parle le contexte décide ; la population ne départage que les candidats qui y conviennent. Une ville connue passe avant la division qui l'entoure ; d'une localité française présente aussi comme commune, prends la commune sauf indication contraire.",
    ("term", "en"): "\nIf the context names a strain or serotype, take the candidate of that strain; if it names an organ or site, the candidate of that site; otherwise the general one.",
    ("term", "fr"): "\nSi le contexte nomme une souche ou un sérotype, prends le candidat de cette souche ; s'il nomme un organe ou un site, celui de ce site ; sinon le candidat général.",
}


@dataclass(frozen=True)
class RerankConfig:
    """Settings of the call; nothing is called while ``enabled`` is false."""

    enabled: bool = False
    language: str = "en"
    max_candidates: int = 10
    context_chars: int = 500
    allow_abstain: bool = False
    reasoning: bool = False
    votes: int = 1


def _named(key: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.coalesce(key, F.lit(""))), key, F.lit(""))


def code_name(code: Column, language: str = "en") -> Column:
    """A code without a name stands for itself; in French one without a French name has the English one."""
    return _named(code, CODE_NAMES if language == "en" else {**CODE_NAMES, **CODE_NAMES_FR})


def category_names(cats: Column, language: str = "en") -> Column:
    """Names of category letters, joined."""
    return F.array_join(F.transform(cats, lambda c: _named(c, CATEGORY_NAMES[language])), ", ")


def people(population: Column, language: str = "en") -> Column:
    """With thousands separators, "unknown" where there are none."""
    return F.when(F.coalesce(population, F.lit(0)) > 0, F.format_number(population, 0)).otherwise("unknown" if language == "en" else "inconnue")


def place_lines(pool: DataFrame, by: list[str], k: int, language: str = "en") -> DataFrame:
    """The first k candidates of each pool as numbered lines, with their ids in the same order."""
    line = F.concat_ws("", F.col("name"), F.lit(" — "), code_name(F.col("feature_code"), language), F.lit(", "), F.coalesce("country_code", F.lit("")), F.lit(", "), people(F.col("population"), language))
    first = pool.where(F.col("pool_rank") <= k).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pool_rank", "geonameid", line.alias("line")))).alias("c"))
    lines = F.array_join(F.transform("c", lambda c, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), c["line"])), "\n")
    return first.select(*by, lines.alias("lines"), F.transform("c", lambda c: c["geonameid"]).alias("ids"))


def term_lines(candidates: DataFrame, names: DataFrame, by: list[str], k: int, categories: DataFrame | None = None, language: str = "en") -> DataFrame:
    """L2: the first k candidates ``(rank, id)`` of each group as numbered lines with names ``(id, ord, name)`` and categories ``(id, cats)``, and their ids."""
    spoken = names.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("names"))
    parts = F.coalesce(F.transform("names", lambda x: x["name"]), F.array().cast("array<string>"))
    first = candidates.where(F.col("rank") <= k).join(spoken, "id", "left")
    if categories is not None:
        own = categories.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cats")))).alias("cats"))
        first = first.join(own, "id", "left")
        word = "category: " if language == "en" else "catégorie : "
        parts = F.when(F.size("cats") > 0, F.array_append(parts, F.concat(F.lit(word), category_names(F.col("cats"), language)))).otherwise(parts)
    line = F.concat_ws(" — ", "id", F.nullif(F.array_join(parts, " | "), F.lit("")))
    first = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "id", line.alias("line")))).alias("c"))
    lines = F.array_join(F.transform("c", lambda c, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), c["line"])), "\n")
    return first.select(*by, lines.alias("lines"), F.transform("c", lambda c: c["id"]).alias("ids"))


def strain_choice(candidates: DataFrame, names: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and the first of two or more candidates ``(context, rank, id)`` that is named after a strain, if the context marks one."""
    marked = candidates.where(F.col("context").rlike(T.STRAIN))
    several = marked.where("rank = 2").select(*by)
    strains = names.where(F.lower("name").rlike("o104|o157|ehec|stec")).select("id").distinct()
    first = marked.join(several, by, "left_semi").join(strains, "id", "left_semi").groupBy(*by).agg(F.min(F.struct("rank", "id")).alias("b"))
    return first.select(*by, F.col("b.id").alias("id"))


def prompt(mention: Column, context: Column, lines: Column, config: RerankConfig, kind: str = "") -> Column:
    """The question in the configured language, with the bounded context, the closed list and the rules of a kind of mention."""
    if config.language == "fr":
        head, ctx, ask = "Mention : ", "\nContexte : ", "\nCandidats :\n"
        tail = "\nRéponds par le seul numéro du bon candidat"
        none = ", ou -1 si aucun ne convient." if config.allow_abstain else "."
    else:
        head, ctx, ask = "Mention: ", "\nContext: ", "\nCandidates:\n"
        tail = "\nReply with the number of the right candidate only"
        none = ", or -1 if none is right." if config.allow_abstain else "."
    tail = RULES.get((kind, config.language), "") + tail
    return F.concat(F.lit(head), mention, F.lit(ctx), F.substring(F.coalesce(context, F.lit("")), 1, config.context_chars), F.lit(ask), lines, F.lit(tail + none))


def ask(questions: DataFrame, model: Model, config: RerankConfig) -> DataFrame:
    """L3: adds ``reply``; a failing call gives null. The model is called in the tasks, batch by batch."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in questions.schema.fields)}, vote int, reply string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for vote in range(config.votes):
                replies = []
                for text, n in zip(pdf["prompt"], pdf["n"], strict=True):
                    try:
                        replies.append(model(text, int(n)))
                    except Exception:
                        replies.append(None)
                yield pdf.assign(vote=vote, reply=replies)

    return questions.mapInPandas(run, schema)


def parse(reply: Column, n: Column, config: RerankConfig) -> Column:
    """(status, index) of a reply; an index out of range is no reply."""
    index = T.last_int(reply) if config.reasoning else T.abstain_int(reply) if config.allow_abstain else T.leading_int(reply)
    inside = (index >= 0) & (index < n)
    status = F.when(F.lit(config.allow_abstain) & (index == -1), "abstain").when(inside, "chosen").otherwise("none")
    return F.struct(status.alias("status"), F.when(inside, index).alias("index"))


def vote(parsed: DataFrame, by: list[str]) -> DataFrame:
    """The commonest parsed reply; a tie goes to the first vote; unusable replies don't count."""
    valid = parsed.where("status <> 'none'").groupBy(*by, "status", "index").agg(F.count("*").alias("n"), F.min("vote").alias("first"))
    return valid.groupBy(*by).agg(F.min(F.struct(-F.col("n"), "first", "status", "index")).alias("b")).select(*by, "b.status", "b.index")


def rerank(questions: DataFrame, model: Model, config: RerankConfig, by: list[str]) -> DataFrame:
    """``by``, status and id per question with ``prompt, n, ids, fallback``; the fallback stands where no reply is usable."""
    if not config.enabled:
        return questions.select(*by, F.lit("none").alias("status"), F.col("fallback").alias("id"))
    replies = ask(questions.select(*by, "prompt", "n"), model, config)
    parsed = replies.withColumn("r", parse(F.col("reply"), F.col("n"), config)).select(*by, "vote", "r.status", "r.index")
    joined = questions.select(*by, "ids", "fallback").join(vote(parsed, by), by, "left")
    status = F.coalesce("status", F.lit("none"))
    chosen = F.when(status == "chosen", F.get("ids", F.col("index"))).when(status == "abstain", "").otherwise(F.col("fallback"))
    return joined.select(*by, status.alias("status"), chosen.alias("id"))
