import json

import pytest

from lexanchor.__main__ import main
from lexanchor.operators.places import name_dimension, place_dimension
from lexanchor.operators.rerank import RerankConfig
from lexanchor.plans.linker import EntityLinker, KnowledgeBase, LinkerConfig
from lexanchor.sources.readers import read_corpus
from tests.conftest import rows
from tests.test_documents import vocabulary
from tests.test_places import kb as place_kb


def knowledge(spark):
    locations, names = place_kb(spark)
    make = spark.createDataFrame
    return KnowledgeBase(
        place_dimension(locations), name_dimension(locations, names), vocabulary(spark),
        make([("grippe", "D7", 0, ["b"]), ("grippe", "D8", 1, ["c"]), ("rage", "D9", 0, ["c"])], "key string, id string, ord int, cats array<string>"),
        {
            "aliases": make([("hexagone", "100")], "key string, id string"), "adjectives": make([("français", "101")], "key string, id string"),
            "continents": make([("africain", "102")], "key string, id string"), "overrides": make([("rage", "PATHOGEN", "D99")], "key string, label string, id string"),
            "manual": make([("peste", "D50", None), ("secret", "D51", True)], "key string, id string, flag boolean"),
            "exonyms": make([("cathay", 0, "9"), ("cathay", 1, "4")], "key string, ord int, id string"),
            "memory": make([("quartier nord", "LOCATION", "77")], "key string, label string, id_kb string"),
        },
    )


TEXTS = [
    ("Hexagone", "LOCATION"), ("territoire francais", "LOCATION"), ("le continent africain", "LOCATION"), ("français", "LOCATION"), ("Aix", "LOCATION"), ("quartier nord", "LOCATION"),
    ("quartier sud", "LOCATION"), ("Cathay", "LOCATION"), ("rage", "PATHOGEN"), ("rage", "INF_DISEASE"), ("Peste", "INF_DISEASE"), ("secret", "INF_DISEASE"), ("grippe", "INF_DISEASE"),
    ("grippe", "PATHOGEN"), ("Fever", "INF_DISEASE"), ("venin x", "BIO_TOXIN"), ("Aix", "OTHER"), (None, "LOCATION"),
]


def link(spark, config=None):
    df = spark.createDataFrame(TEXTS, "text string, label string")
    return {(r.text, r.label): (r.id_kb, r.decision) for r in EntityLinker(knowledge(spark), config).link(df).collect()}


def test_whole_cascade(spark):
    got = link(spark)
    assert len(got) == len(TEXTS)
    want = {
        ("Hexagone", "LOCATION"): "100", ("territoire francais", "LOCATION"): "101", ("le continent africain", "LOCATION"): "102", ("français", "LOCATION"): "", ("Aix", "LOCATION"): "2",
        ("quartier nord", "LOCATION"): "77", ("quartier sud", "LOCATION"): "", ("Cathay", "LOCATION"): "", ("rage", "PATHOGEN"): "D99", ("rage", "INF_DISEASE"): "D9",
        ("Peste", "INF_DISEASE"): "D50", ("secret", "INF_DISEASE"): "", ("grippe", "INF_DISEASE"): "D8", ("grippe", "PATHOGEN"): "D7", ("Fever", "INF_DISEASE"): "D1",
        ("venin x", "BIO_TOXIN"): "", ("Aix", "OTHER"): "", (None, "LOCATION"): "",
    }
    assert {k: v[0] for k, v in got.items()} == want
    assert got["quartier nord", "LOCATION"][1] == "memory" and got["quartier sud", "LOCATION"][1] == "nil"


def test_one_mention(spark):
    linker = EntityLinker(knowledge(spark))
    assert linker.link_entity("Hexagone", "LOCATION") == ("100", "GeoNames") and linker.link_entity("zz", "LOCATION") == ("", "")


def test_switches(spark):
    got = link(spark, LinkerConfig(use_memory=False, test_informed=True))
    assert got["quartier nord", "LOCATION"] == ("", "nil")  # without memory the filter speaks
    assert got["secret", "INF_DISEASE"][0] == "D51" and got["Cathay", "LOCATION"][0] == "4"  # roads are skipped


def test_documents_and_command_line(spark, tmp_path):
    docs = [
        {"text": "Fever (FE) à Aix", "entities": [{"text": "Fever", "label": "INF_DISEASE", "start": [0], "end": [5]}, {"text": "FE", "label": "INF_DISEASE", "start": [7], "end": [9]}, {"text": "Aix", "label": "LOCATION", "start": 13, "end": 16}]},
        {"text": "rien", "entities": []},
    ]
    source = tmp_path / "c.json"
    source.write_text(json.dumps(docs))
    linker = EntityLinker(knowledge(spark))
    got = linker.process_documents(read_corpus(spark, str(source)))
    assert {r.doc_idx: [(e.text, e.id_kb, e.source) for e in r.entities or []] for r in got.collect()} == {
        0: [("Fever", "D1", "MeSH"), ("FE", "D1", "MeSH"), ("Aix", "2", "GeoNames")], 1: [],
    }
    folder = str(tmp_path / "kb")
    knowledge(spark).write(folder)
    predicted = str(tmp_path / "p.json")
    assert main(["predict", str(source), predicted, "--kb", folder]) == 0
    assert not (tmp_path / "p.json.parts").exists()
    written = json.loads((tmp_path / "p.json").read_text())
    assert [{k: v for k, v in e.items() if k not in ("id_kb", "source")} for d in written for e in d["entities"]] == [e for d in docs for e in d["entities"]]
    assert main(["predict", str(source), str(tmp_path / "lines"), "--kb", folder]) == 0
    assert main(["validate", predicted, str(tmp_path / "lines")]) == 1  # ids too short, as below
    assert main(["validate", str(source), predicted]) == 1  # the fixture's ids are too short for the grammar
    (tmp_path / "p.json").write_text((tmp_path / "p.json").read_text().replace('"D1"', '"D000001"'))
    assert main(["validate", str(source), predicted]) == 0
    broken = json.loads((tmp_path / "p.json").read_text())
    broken[0]["entities"][0]["id_kb"] = "x"
    (tmp_path / "b.json").write_text(json.dumps(broken))
    assert main(["validate", str(source), str(tmp_path / "b.json")]) == 1
    assert main(["evaluate", predicted, "--kb", folder]) == 0
    assert main(["scan", str(source)]) == 0
    assert rows(KnowledgeBase.read(spark, folder).map("aliases", LinkerConfig())) == [("hexagone", "100")]


def reranker(text, n):
    """Chooses by what the prompt's context says; fails elsewhere."""
    context = text.split("Context: ")[1].split("\nCandidates")[0]
    assert context, "no context"
    return "-1" if "aucun" in context else context.split("numéro ")[1][0]


def test_reranking(spark):
    base = knowledge(spark)
    base.maps |= {
        "ambiguous": spark.createDataFrame([("peste", "INF_DISEASE", 0, "D60"), ("peste", "INF_DISEASE", 1, "D61")], "key string, label string, ord int, id string"),
        "term_names": spark.createDataFrame([("D8", 0, "Escherichia coli O104"), ("D7", 0, "Grippe")], "id string, ord int, name string"),
    }
    config = LinkerConfig(rerank=RerankConfig(enabled=True, allow_abstain=True))
    asked = [
        ("Aix", "LOCATION", "numéro 0"), ("Aix", "LOCATION", "numéro 2"), ("Aix", "LOCATION", "aucun"), ("Aix", "LOCATION", None), ("Aix", "LOCATION", "numéro 9"), ("Bor", "LOCATION", "aucun"),
        ("quartier nord", "LOCATION", "aucun"), ("grippe", "INF_DISEASE", "numéro 0"), ("grippe", "INF_DISEASE", None), ("grippe", "PATHOGEN", "souche O104:H4, numéro 0"), ("rage", "INF_DISEASE", "numéro 0"),
        ("Peste", "INF_DISEASE", "numéro 1"), ("Peste", "INF_DISEASE", None),
    ]
    got = EntityLinker(base, config, reranker).link(spark.createDataFrame(asked, "text string, label string, context string"))
    assert {(r.text, r.label, r.context): r.id_kb for r in got.collect()} == dict(zip(asked, ["3", "2", "", "2", "2", "4", "77", "D7", "D8", "D8", "D9", "D61", "D50"], strict=True))
    with pytest.raises(ValueError):
        EntityLinker(base, config)


def answer(text, n):
    return "0"


def test_command_line_with_a_model_and_memory(spark, tmp_path, capsys):
    folder = str(tmp_path / "kb")
    knowledge(spark).write(folder)
    source = tmp_path / "c.json"
    source.write_text(json.dumps([{"text": "Aix et Aix", "entities": [{"text": "Aix", "label": "LOCATION", "start": [0], "end": [3], "id_kb": "2", "source": "GeoNames"}]}]))
    with pytest.raises(SystemExit):
        main(["predict", str(source), str(tmp_path / "p.json"), "--kb", folder, "--llm-reranker"])
    model = ["--llm-reranker", "--llm-lang", "fr", "--llm-model", "tests.test_linker:answer"]
    assert main(["predict", str(source), str(tmp_path / "p.json"), "--kb", folder, *model]) == 0
    assert "1 entities, 1 linked, 0 NIL" in capsys.readouterr().out
    assert main(["evaluate", str(source), "--kb", folder, "--no-memory", *model]) == 0


def test_reranking_of_documents_uses_the_window(spark, tmp_path):
    source = tmp_path / "c.json"
    source.write_text(json.dumps([{"text": "aucun ...... Aix, numéro 0", "entities": [{"text": "Aix", "label": "LOCATION", "start": 13, "end": 16}]}]))
    linker = EntityLinker(knowledge(spark), LinkerConfig(context_window=12, rerank=RerankConfig(enabled=True, allow_abstain=True)), reranker)
    assert [e.id_kb for r in linker.process_documents(read_corpus(spark, str(source))).collect() for e in r.entities] == ["3"]
