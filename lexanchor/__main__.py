"""Command line: build-kb, predict, evaluate, validate, scan."""

from __future__ import annotations

import argparse
import importlib
import os
import sys

from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lexanchor")
    verbs = out.add_subparsers(dest="verb", required=True)
    build = verbs.add_parser("build-kb", help="place dump, alternate names and vocabulary to parquet dimensions")
    for name in ("places", "alternates", "descriptors", "supplementals", "out"):
        build.add_argument(name)
    build.add_argument("--bilingual")
    build.add_argument("--train", help="corpus that the memory is counted on")
    predict = verbs.add_parser("predict", help="link the mentions of a corpus")
    predict.add_argument("corpus")
    predict.add_argument("out", help="a JSON array where the name ends in .json, else a folder of JSON lines")
    evaluate = verbs.add_parser("evaluate", help="link a gold corpus and score it")
    evaluate.add_argument("corpus")
    for verb in (predict, evaluate):
        verb.add_argument("--kb", required=True)
        verb.add_argument("--no-memory", action="store_true")
        verb.add_argument("--llm-reranker", action="store_true", help="let the model decide between candidates")
        verb.add_argument("--llm-lang", choices=("en", "fr"), default="en")
        verb.add_argument("--llm-model", default=os.environ.get("LEXANCHOR_MODEL"), help="module:function that answers a prompt")
        verb.add_argument("--test-informed", action="store_true", default=os.environ.get("LEXANCHOR_TEST_INFORMED") == "1", help="keep flagged rows of the maps")
    validate = verbs.add_parser("validate", help="check predictions against the input; exit code 1 if a rule is violated")
    validate.add_argument("corpus")
    validate.add_argument("predictions")
    validate.add_argument("--kb", help="knowledge base for warnings on unknown ids")
    scan = verbs.add_parser("scan", help="artifacts of the mentions")
    scan.add_argument("corpus")
    return out


#: Lines of a report that are printed of a kind.
SHOWN = 40


def validate(spark, corpus_path: str, predictions_path: str, folder: str | None = None) -> int:
    """The report of predictions against their input; 1 if they break a rule, 0 with or without warnings."""
    from pyspark.errors import PySparkException

    from lexanchor.operators import documents as D
    from lexanchor.plans.linker import KnowledgeBase
    from lexanchor.sources import readers

    try:
        predicted = readers.read_corpus(spark, predictions_path)
        text = F.call_function("is_valid_utf8", "raw")
        state = predicted.agg(F.count("*").alias("n"), F.count_if(~text).alias("bytes"), F.count_if(F.try_parse_json("raw").isNull()).alias("json")).first()
    except PySparkException as error:
        print(f"H1 FATAL: predictions can't be read: {str(error).splitlines()[0]}")
        return 1
    if state["bytes"] or state["json"]:
        print(f"H1 FATAL: predictions are not valid {'UTF-8' if state['bytes'] else 'JSON'}")
        return 1
    corpus = readers.read_corpus(spark, corpus_path)
    wanted = corpus.count()
    if state["n"] != wanted:
        print(f"H2: {state['n']} documents predicted vs {wanted} expected")
        return 1
    wrong, pairs = D.compared(corpus, predicted)
    errors = wrong.unionByName(D.violations(pairs))
    summary = D.validation_summary(pairs).first()
    print(f"Documents predicted: {state['n']}\nTotal entities: {summary['n']}\n  GeoNames linked: {summary['n_geo']}\n  MeSH linked: {summary['n_mesh']}\n  NIL: {summary['n_nil']}")
    if summary["n"]:
        print(f"  NIL rate: {summary['nil_rate']:.2f} %")
    n = errors.count()
    if n:
        print(f"Blocking errors: {n}")
        for row in errors.orderBy("doc_idx", "ent_idx", "rule").limit(SHOWN).collect():
            print(f"  {row['rule']} doc{row['doc_idx']}" + ("" if row["ent_idx"] is None else f".ent{row['ent_idx']}"))
        return 1
    if folder:
        kb = KnowledgeBase.read(spark, folder)
        known = kb.entries.select(F.col("ui").alias("id"))
        unknown = D.unknown_ids(pairs, kb.places.select(F.col("geonameid").alias("id")), known, known)
        print(f"Unknown ids: {unknown.count()}")
        for row in unknown.orderBy("doc_idx", "ent_idx", "id").limit(SHOWN).collect():
            print(f"  {row['rule']} doc{row['doc_idx']}.ent{row['ent_idx']}: {row['id']}")
    if summary["warn"]:
        print(f"S3: NIL rate is {summary['nil_rate']:.2f} %, suspicious")
    if summary["n_mojibake"]:
        print(f"S4: {summary['n_mojibake']} texts look wrongly decoded")
    print("OK")
    return 0


def _linker(spark, args):
    """The linker of the command's options; the model is a function that its name is given of."""
    from lexanchor.operators.rerank import RerankConfig
    from lexanchor.plans.linker import EntityLinker, KnowledgeBase, LinkerConfig

    model = None
    if args.llm_reranker:
        if not args.llm_model:
            raise SystemExit("--llm-reranker needs --llm-model or LEXANCHOR_MODEL")
        module, _, name = args.llm_model.partition(":")
        model = getattr(importlib.import_module(module), name)
    config = LinkerConfig(use_memory=not args.no_memory, test_informed=args.test_informed, rerank=RerankConfig(enabled=args.llm_reranker, language=args.llm_lang))
    return EntityLinker(KnowledgeBase.read(spark, args.kb), config, model)


def main(argv: list[str] | None = None) -> int:
    from lexanchor.functions import text as T
    from lexanchor.operators import cascade as C
    from lexanchor.operators import documents as D
    from lexanchor.operators import places as P
    from lexanchor.operators import vocabulary as V
    from lexanchor.plans.linker import KnowledgeBase, with_context
    from lexanchor.session import build_session, cut_lineage, ship_package
    from lexanchor.sources import readers, writers

    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or build_session()
    ship_package(spark)
    if args.verb == "build-kb":
        places = readers.read_places(spark, args.places)
        aliases = readers.place_aliases(places).unionByName(readers.read_alternate_names(spark, args.alternates))
        names = aliases.select("geonameid", F.col("name_lower").alias("key")).distinct()
        entries = V.term_index(readers.read_descriptors(spark, args.descriptors), readers.read_supplementals(spark, args.supplementals))
        bilingual, maps = None, {}
        if args.bilingual:
            records = readers.read_bilingual(spark, args.bilingual)
            named = V.bilingual_names(records)
            bilingual = V.twin_index(readers.bilingual_terms(records)).join(named.select("id", "cats"), "id")
            maps["term_names"] = V.spoken_names(named)
        if args.train:
            rows = readers.corpus_entities(readers.read_corpus(spark, args.train)).where("text is not null")
            rows = rows.select(T.normalize("text").alias("key"), "label", "id_kb", F.struct("doc_idx", "ent_idx").alias("at"))
            maps["memory"] = C.mode_by(rows, ["key", "label"], "id_kb", "at").select("key", "label", "id_kb")
        KnowledgeBase(P.place_dimension(places), names, entries, bilingual, maps).write(args.out)
        return 0
    if args.verb == "validate":
        return validate(spark, args.corpus, args.predictions, args.kb)
    corpus = readers.read_corpus(spark, args.corpus)
    entities = readers.corpus_entities(corpus)
    flags = F.array_compact(F.array(*[F.when(test(F.col("text")), F.lit(name)) for name, test in T.ARTIFACTS.items()]))
    artifacts = entities.select("text", F.explode(flags).alias("artifact")).distinct()
    if args.verb == "scan":
        for row in artifacts.groupBy("artifact").count().orderBy("artifact").collect():
            print(f"{'!' if row[0] in T.HIGH_SIGNAL else ' '} {row[0]}: {row[1]}")
            for example in artifacts.where(F.col("artifact") == row[0]).orderBy("text").limit(10).collect():
                print(f"      {example['text']!r}")
        return 0
    linker = _linker(spark, args)
    if args.verb == "predict":
        for row in artifacts.where(F.col("artifact").isin(*T.HIGH_SIGNAL)).groupBy("artifact").count().orderBy("artifact").collect():
            print(f"warning: {row[0]} in {row[1]} mentions")
        linked = cut_lineage(linker.process_documents(corpus))
        if args.out.endswith(".json"):
            parts = args.out + ".parts"
            writers.write_predictions(linked, parts)
            writers.merge_predictions(spark, parts, args.out)
            writers.remove(spark, parts)
        else:
            writers.write_predictions(linked, args.out)
        found = linked.select(F.explode("entities").alias("e")).agg(F.count("*").alias("n"), F.count_if(F.col("e.source") != "").alias("linked")).first()
        print(f"{found['n']} entities, {found['linked']} linked, {found['n'] - found['linked']} NIL")
        return 0
    gold = entities.withColumnsRenamed({"id_kb": "gold_id", "source": "gold_source"})
    if linker.config.rerank.enabled:
        gold = with_context(gold.withColumnsRenamed({"start_pos": "start", "end_pos": "end"}), corpus, linker.config.context_window)
    linked, blank = linker.link(gold), F.lit("")
    D.linking_metrics(
        linked.select(F.coalesce("gold_id", blank).alias("gold_id"), F.coalesce("gold_source", blank).alias("gold_source"), F.col("id_kb").alias("pred_id"), F.col("source").alias("pred_source"))
    ).orderBy("kb").show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
