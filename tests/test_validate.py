import json

import pytest

from lexanchor.__main__ import main
from lexanchor.sources.readers import read_corpus
from tests.conftest import rows
from tests.test_linker import knowledge

GOLD = [
    {"text": "Fièvre à Aix", "meta": {"k": [1, 2.50]}, "entities": [{"text": "Fièvre", "label": "INF_DISEASE", "start": [0], "end": [6], "x": 1}, {"text": "Aix", "label": "LOCATION", "start": [9, 20], "end": [12, 23]}]},
    {"text": "rien", "entities": []},
]
GOOD = [
    {**GOLD[0], "entities": [{**GOLD[0]["entities"][0], "id_kb": "D000001", "source": "MeSH"}, {**GOLD[0]["entities"][1], "id_kb": "123", "source": "GeoNames"}]},
    GOLD[1],
]


def put(ent, **values):
    def change(docs):
        docs[0]["entities"][ent].update(values)

    return change


def drop(key):
    return lambda docs: docs[0]["entities"][0].pop(key)


def run(tmp_path, docs, lines=False):
    (tmp_path / "g.json").write_text(json.dumps(GOLD), encoding="utf-8")
    text = docs if isinstance(docs, (str, bytes)) else "\n".join(map(json.dumps, docs)) if lines else json.dumps(docs, ensure_ascii=False, indent=2)
    (tmp_path / "p.json").write_bytes(text if isinstance(text, bytes) else text.encode())
    return main(["validate", str(tmp_path / "g.json"), str(tmp_path / "p.json")])


@pytest.mark.parametrize("values", [{}, {"id_kb": "D000001 & D0000022"}, {"id_kb": "D000001 : C000001"}, {"id_kb": "D000001 & D000002 : C000001 | C000002"}, {"id_kb": "", "source": ""}])
def test_accepted(spark, tmp_path, values):
    docs = json.loads(json.dumps(GOOD))
    put(0, **values)(docs)
    assert run(tmp_path, docs, lines=bool(values)) == 0


@pytest.mark.parametrize(
    "change",
    [
        lambda d: d.append({"text": "more", "entities": []}), lambda d: d.pop(), lambda d: d[1].update(text="Rien"), lambda d: d[1]["entities"].append({"text": "r", "id_kb": "", "source": ""}),
        lambda d: d[0]["entities"].pop(), put(1, start=[9, 99]), put(1, start=9), put(0, end=[7]), put(0, text="fièvre"), put(0, label="PATHOGEN"), put(1, source="geonames"), put(1, id_kb="12a"),
        put(0, id_kb="M000001"), put(0, id_kb="D000001 : D000002"), put(0, source=""), put(0, id_kb=""), drop("id_kb"), drop("source"), drop("label"),
    ],
)
def test_refused(spark, tmp_path, change):
    docs = json.loads(json.dumps(GOOD))
    change(docs)
    assert run(tmp_path, docs) == 1


@pytest.mark.parametrize("text", ["[{", json.dumps(GOOD)[:-1], json.dumps(GOOD) + "x", "nonsense", "{}", "[]", "", json.dumps(GOOD).replace(", ", "; ", 1), b'[{"text": "\xff\xfe"}, {"text": "rien"}]'])
def test_unreadable(spark, tmp_path, text):
    assert run(tmp_path, text) == 1


def test_report(spark, tmp_path, capsys):
    knowledge(spark).write(str(tmp_path / "kb"))
    docs = json.loads(json.dumps(GOOD))
    assert run(tmp_path, docs) == 0
    assert "Total entities: 2" in capsys.readouterr().out
    assert main(["validate", str(tmp_path / "g.json"), str(tmp_path / "p.json"), "--kb", str(tmp_path / "kb")]) == 0
    out = capsys.readouterr().out
    assert "S1 doc0.ent1: 123" in out and "S2 doc0.ent0: D000001" in out and "S3" in out
    with pytest.raises(SystemExit) as ended:
        main(["validate", "one"])
    assert ended.value.code == 2


def test_documents_keep_their_order_and_keys(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    for part in range(3):
        (folder / f"part-{part}.json").write_text("".join(json.dumps({"text": f"{part}-{k}", "z": 1, "a": [k]}) + "\n\n" for k in range(40 - 15 * part)))
    got = rows(read_corpus(spark, str(folder)).select("doc_idx", "text", "raw"))
    assert [g[0] for g in got] == list(range(75)) and [g[1] for g in got] == [f"{p}-{k}" for p in range(3) for k in range(40 - 15 * p)]
    assert got[1][2] == '{"text": "0-1", "z": 1, "a": [1]}'
    (tmp_path / "a.json").write_text(json.dumps([{"text": str(k), "n": 1.50} for k in range(1200)]))
    assert [r[0] for r in rows(read_corpus(spark, str(tmp_path / "a.json")).selectExpr("doc_idx", "text", "int(text) = doc_idx as same").where("same"))] == list(range(1200))
