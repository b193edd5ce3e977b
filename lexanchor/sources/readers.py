"""Readers of raw dumps, vocabularies and corpora, each with an explicit schema."""

from __future__ import annotations

import json
import re
import shutil
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexanchor.functions import text as T
from lexanchor.session import exists

PLACES = "geonameid string, name string, asciiname string, alternates string, country_code string, feature_class string, feature_code string, population long, admin1 string, latitude double, longitude double"


def extract_member(archive: str, member: str, folder: str) -> str:
    """Stream one member of a ZIP into a folder that all executors share, unless it's there already."""
    target = Path(folder) / Path(member).name
    if not target.exists() or not target.stat().st_size:
        target.parent.mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(archive) as file, file.open(member) as source, target.open("wb") as out:
            shutil.copyfileobj(source, out, 1 << 20)
    return str(target)


def _fields(spark: SparkSession, path: str, least: int) -> DataFrame:
    line = F.regexp_replace("value", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return spark.read.text(path).select(F.split(line, "\t").alias("f")).where(F.size("f") >= least)


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """The place dump, tab-separated; lines of fewer than 19 fields are skipped."""
    f = F.col("f")
    return _fields(spark, path, 19).select(
        f[0].alias("geonameid"), f[1].alias("name"), f[2].alias("asciiname"), f[3].alias("alternates"), f[8].alias("country_code"),
        f[6].alias("feature_class"), f[7].alias("feature_code"), F.coalesce(f[14].try_cast("long"), F.lit(0)).alias("population"),
        f[10].alias("admin1"), f[4].try_cast("double").alias("latitude"), f[5].try_cast("double").alias("longitude"),
    )


def place_aliases(places: DataFrame) -> DataFrame:
    """Name, plain name and alternates of each place, lower, without blanks and repeats."""
    every = F.concat(F.array("name", "asciiname"), F.split(F.coalesce("alternates", F.lit("")), ","))
    keys = F.array_distinct(F.filter(F.transform(every, lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != "")))
    return places.select(F.explode(keys).alias("name_lower"), "geonameid", F.lit("").alias("lang"))


def read_alternate_names(spark: SparkSession, path: str, lang: str = "fr") -> DataFrame:
    """Names in one language; lines of fewer than four fields and blank names are skipped."""
    f = F.col("f")
    rows = _fields(spark, path, 4).where(f[2] == lang)
    return rows.select(F.lower(F.trim(f[3])).alias("name_lower"), f[1].alias("geonameid"), f[2].alias("lang")).where("name_lower <> ''")


_CONCEPTS = (
    "ConceptList struct<Concept:array<struct<_PreferredConceptYN:string,ConceptUI:string,ConceptName:struct<String:string>,"
    "TermList:struct<Term:array<struct<String:string>>>>>>"
)


def _concepts() -> F.Column:
    def one(c):
        terms = F.filter(F.transform(c["TermList"]["Term"], lambda t: t["String"]), lambda s: s.isNotNull() & (s != ""))
        return F.struct(
            c["ConceptUI"].alias("ui"), c["ConceptName"]["String"].alias("name"), (c["_PreferredConceptYN"] == "Y").alias("preferred"), terms.alias("terms")
        )

    return F.transform("ConceptList.Concept", one)


def read_descriptors(spark: SparkSession, path: str) -> DataFrame:
    """S3: descriptor records of the vocabulary's XML, split by Spark at the record's tag."""
    schema = f"DescriptorUI string, DescriptorName struct<String:string>, {_CONCEPTS}"
    rows = spark.read.format("xml").option("rowTag", "DescriptorRecord").schema(schema).load(path)
    return rows.where("DescriptorUI is not null").select(F.col("DescriptorUI").alias("dui"), F.col("DescriptorName.String").alias("name"), _concepts().alias("concepts"))


def read_supplementals(spark: SparkSession, path: str) -> DataFrame:
    """Supplemental records; the stars of mapped headings are stripped and blanks dropped."""
    mapped = "HeadingMappedToList struct<HeadingMappedTo:array<struct<DescriptorReferredTo:struct<DescriptorUI:string>>>>"
    schema = f"SupplementalRecordUI string, SupplementalRecordName struct<String:string>, {mapped}, {_CONCEPTS}"
    rows = spark.read.format("xml").option("rowTag", "SupplementalRecord").schema(schema).load(path)
    ids = F.transform("HeadingMappedToList.HeadingMappedTo", lambda h: F.regexp_replace(h["DescriptorReferredTo"]["DescriptorUI"], r"^\*+|\*+$", ""))
    return rows.where("SupplementalRecordUI is not null").select(
        F.col("SupplementalRecordUI").alias("sui"), F.col("SupplementalRecordName.String").alias("name"), _concepts().alias("concepts"),
        F.coalesce(F.filter(ids, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>")).alias("mapped_to"),
    )


BILINGUAL = "db string, id string, trx string, eng string, xtr_cs array<string>, xtr_en array<string>, heading array<string>, cat array<string>, active boolean"


def read_bilingual(spark: SparkSession, path: str) -> DataFrame:
    """Bilingual records of the main vocabulary's descriptors."""
    return spark.read.schema(BILINGUAL).option("multiLine", True).json(path).where("db = 'mesh' and id like 'D%'")


def bilingual_terms(records: DataFrame) -> DataFrame:
    """Every searchable term of each record, in order."""

    def listed(name: str) -> F.Column:
        return F.coalesce(F.col(name), F.array().cast("array<string>"))

    every = F.concat(F.array("trx", "eng"), listed("xtr_cs"), listed("xtr_en"), listed("heading"))
    return records.select("id", F.posexplode(every).alias("ord", "term")).where("term is not null and term <> ''")


MENTION = "struct<text:string,label:string,start:string,end:string,id_kb:string,source:string>"


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The documents of JSON array files, each with its text as it stands; what can't be read is the last, broken one."""
    read = json.JSONDecoder().raw_decode
    for pdf in batches:
        for file, whole in zip(pdf["file"], pdf["value"], strict=True):
            at, found = whole.index("[") + 1, []
            while True:
                at = _GAP.match(whole, at).end()
                if whole[at : at + 1] == "]" and not whole[at + 1 :].strip():
                    break
                try:
                    _, end = read(whole, at)
                    found.append(whole[at:end])
                    at = _GAP.match(whole, end).end()
                    if whole[at : at + 1] == ",":
                        at += 1
                        if whole[at:].lstrip()[:1] != "]":
                            continue
                    elif whole[at : at + 1] == "]" and not whole[at + 1 :].strip():
                        break
                except ValueError:
                    pass
                found.append("[" + whole[at : at + 200])
                break
            for start in range(0, len(found), 500):
                yield pd.DataFrame({"file": file, "start": 0, "raw": found[start : start + 500]})


_GAP = re.compile(r"[ \t\r\n]*")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Documents ``(doc_idx, raw, text, entities)`` in their order, ``raw`` being the document as it stands, unknown keys included.

    Files with one document a line are read in parallel; a file that is a JSON array is cut into
    its documents by one task. Spans are numbers or lists, kept as their JSON. A document that
    isn't JSON has null text and entities.
    """
    lines = spark.read.text(path)
    first = lines.where("trim(value) <> ''").head(1)
    if first and first[0][0].lstrip()[:1] == "[":
        whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
        rows = whole.where("trim(value) <> ''").mapInPandas(_documents, "file string, start long, raw string")
    else:
        rows = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("raw")).where("trim(raw) <> ''")
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    # files and their blocks are counted, so that documents are numbered without one task that sees all
    blocks = rows.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("_at").alias("least")).orderBy("file", "start").collect()
    offsets, total = [], 0
    for r in blocks:
        offsets.append((r["file"], r["start"], total - r["least"]))
        total += r["n"]
    known = spark.createDataFrame(offsets, "file string, start long, offset long")
    numbered = rows.join(F.broadcast(known), ["file", "start"]).select((F.col("_at") + F.col("offset")).alias("doc_idx"), "raw")
    doc = F.from_json("raw", "struct<text:string,entities:array<string>>")
    mentions = F.transform("d.entities", lambda e: F.from_json(e, MENTION))
    return numbered.withColumn("d", doc).select("doc_idx", "raw", F.col("d.text").alias("text"), mentions.alias("entities"))


def corpus_entities(corpus: DataFrame) -> DataFrame:
    """D3: one row per mention in document order, with the first start and end as numbers."""
    flat = corpus.select("doc_idx", F.posexplode("entities").alias("ent_idx", "e"))
    return flat.select(
        "doc_idx", "ent_idx", "e.text", "e.label", T.first_span("e.start").alias("start_pos"), T.first_span("e.end").alias("end_pos"), "e.id_kb", "e.source"
    )


def read_exonyms(spark: SparkSession, path: str, enabled: bool = False) -> DataFrame:
    """A frozen map from mention to ranked ids; empty unless enabled and present."""
    empty = spark.createDataFrame([], "key string, ord int, id string")
    if not enabled or not exists(spark, path):
        return empty
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return whole.select(F.explode("m").alias("key", "ids")).select("key", F.posexplode("ids").alias("ord", "id"))
