import json
from xml.etree import ElementTree

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexanchor.operators.nested import (
    SOURCE_SHAPE, Triples, batch_triples, json_events, json_triples, linked_terms, nested_tables, payload_record_triples, payload_terms, payload_triples, pivot,
    repeated_paths, table_record_triples, table_terms,
)
from tests.conftest import rows

XML = """<?xml version="1.0"?>
<DescriptorRecordSet><DescriptorRecord DescriptorClass="1"><DescriptorUI>D1</DescriptorUI><ConceptList>
<Concept PreferredConceptYN="Y"><ConceptUI>M1</ConceptUI><TermList><Term><TermUI>T1</TermUI><String>a &amp; b</String></Term>
<Term><TermUI>T2</TermUI><String> </String></Term><Term>bare</Term><Term><TermUI>T3</TermUI></Term><Term><String><![CDATA[c <d>]]></String></Term></TermList></Concept>
<Concept><TermList><Term><String>x</String></Term></TermList></Concept></ConceptList></DescriptorRecord>
<SupplementalRecord><SupplementalRecordUI>C1</SupplementalRecordUI><ConceptList><Concept><ConceptUI>M9</ConceptUI><TermList><Term><String>y</String></Term></TermList></Concept></ConceptList></SupplementalRecord></DescriptorRecordSet>"""
WANT = [("C1", 0, "M9", 0, "y"), ("D1", 0, "M1", 0, "a & b"), ("D1", 0, "M1", 2, "bare"), ("D1", 0, "M1", 4, "c <d>"), ("D1", 1, "", 0, "x")]
JSON = json.dumps(
    {
        "DescriptorRecordSet": {
            "DescriptorRecord": {
                "DescriptorUI": "D1",
                "ConceptList": {
                    "Concept": [
                        {"ConceptUI": "M1", "TermList": {"Term": [{"String": "a & b"}, {"String": " "}, "bare", {"TermUI": "T3"}, {"String": "c <d>"}]}},
                        {"TermList": {"Term": {"String": "x"}}},
                    ]
                },
            },
            "SupplementalRecord": [{"SupplementalRecordUI": "C1", "ConceptList": {"Concept": {"ConceptUI": "M9", "TermList": {"Term": {"String": "y"}}}}}],
        }
    }
)


@pytest.mark.parametrize(("payload", "fmt"), [(XML, "xml"), (JSON, "json"), (XML, None), (JSON, " JSON ")])
def test_terms_of_a_payload(payload, fmt):
    found = linked_terms(Triples.of(payload_triples(payload, fmt, SOURCE_SHAPE.roots)), SOURCE_SHAPE)
    assert sorted(found.itertuples(index=False, name=None)) == WANT


@pytest.mark.parametrize("payload", [XML[:-30], JSON[:-5], "", None, "<a>", "[1", "nonsense", JSON + "x", '{"a": NaN}', "[" * 100_000])
@pytest.mark.parametrize("fmt", ["xml", "json", None])
def test_malformed_payloads_give_nothing(payload, fmt):
    assert payload_triples(payload, fmt, SOURCE_SHAPE.roots) == []


def test_triples_of_xml_equal_a_tree_walk():
    found = [(p, v) for _, p, _, v in payload_triples(XML, "xml", SOURCE_SHAPE.roots) if not p[-1].startswith("@")]
    want = []
    for record in ElementTree.fromstring(XML):

        def walk(node, path):
            for child in node:
                walk(child, (*path, child.tag))
            if path:
                want.append((path, (node.text or "") + "".join(c.tail or "" for c in node)))

        walk(record, ())
    assert sorted(found) == sorted(want)


def test_payload_query(spark):
    df = spark.createDataFrame([(1, "xml", XML, "t"), (2, "json", JSON, "t"), (3, "xml", XML[:-9], "t"), (4, None, None, "t")], "rec_no long, fmt string, payload string, term string")
    assert rows(payload_terms(df, "fmt", "payload")) == WANT
    assert rows(payload_terms(df.limit(0), "fmt", "payload")) == []
    assert payload_record_triples(df, "rec_no", "fmt", "payload").where("path = 'ConceptList/Concept/TermList/Term/String' and record_key = '1'").count() == 5


def test_typed_tables(spark):
    schema = "dui string, term string, concepts array<struct<ui string, name string, preferred boolean, terms array<string>>>"
    concepts = [("M1", "n", True, ["a", None, " ", "b"]), None, (None, None, None, ["c"]), ("M2", "n", False, None), ("M3", "n", False, [])]
    df = spark.createDataFrame([("D1", "x", concepts), ("D1", "x", concepts), ("D2", None, None), (None, None, [("M4", "n", True, ["d"])]), ("D3", "", [])], schema)
    assert rows(table_terms(df, "dui")) == [("", 0, "M4", 0, "d"), ("D1", 0, "M1", 0, "a"), ("D1", 0, "M1", 3, "b"), ("D1", 2, "", 0, "c")]
    assert rows(table_terms(df.limit(0), "dui")) == []


VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=3), x, max_size=4), max_leaves=25)


def rebuilt(events):
    """A value of events, scalars other than texts as written."""
    stack, key, out = [], None, None

    def put(value):
        nonlocal out
        if not stack:
            out = value
        elif isinstance(stack[-1][0], list):
            stack[-1][0].append(value)
        else:
            stack[-1][0][stack[-1][1]] = value

    for kind, text in events:
        if kind in "{[":
            value = {} if kind == "{" else []
            put(value)
            stack.append([value, None])
        elif kind in "}]":
            stack.pop()
        elif kind == "key":
            stack[-1][1] = text
        else:
            put(text)
    return out


def plain(value):
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    return value if isinstance(value, str) else "" if value is None else json.dumps(value)


@settings(max_examples=200, deadline=None)
@given(VALUES, st.booleans(), st.sampled_from([None, 1]))
def test_json_is_read_as_the_library_reads_it(value, ascii_only, indent):
    text = json.dumps(value, ensure_ascii=ascii_only, indent=indent)
    assert rebuilt(json_events(text)) == plain(value)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='{}[]:,"\\\\au0013.eE-+ tn\\n', max_size=12))
def test_json_refuses_what_the_library_refuses(text):
    try:
        json.loads(text, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
        good = True
    except ValueError:
        good = False
    try:
        list(json_events(text))
        assert good
    except ValueError:
        assert not good


def test_lists_in_json():
    text = '{"DescriptorRecord": [{"a": [1, [2, 3], {"b": "x"}], "a": "y", "c": []}, {"a": {"b": null}}], "other": {"a": 1}}'
    assert json_triples(text, SOURCE_SHAPE.roots) == [
        (0, ("a",), (0,), "1"), (0, ("a",), (1,), ""), (0, ("a", "item"), (1, 0), "2"), (0, ("a", "item"), (1, 1), "3"), (0, ("a",), (2,), ""),
        (0, ("a", "b"), (2, 0), "x"), (0, ("a",), (3,), "y"), (1, ("a",), (0,), ""), (1, ("a", "b"), (0, 0), ""),
    ]


def test_groups_of_any_shape():
    t = Triples.of(json_triples('{"DescriptorRecord": {"id": "r", "x": [{"n": "1", "y": ["p", "q"]}, {"y": "s", "z": {"w": "v"}}]}}', SOURCE_SHAPE.roots))
    repeated = repeated_paths(t)
    assert repeated == [("x",), ("x", "y")]
    groups = pivot(t, repeated)
    assert groups[()].column(("id",)).tolist() == ["r"]
    assert groups[("x",)].keys.tolist() == [[0, 0], [0, 1]] and groups[("x",)].column(("n",)).tolist() == ["1", ""] and groups[("x",)].column(("z", "w")).tolist() == ["", "v"]
    assert groups[("x", "y")].keys.tolist() == [[0, 0, 0], [0, 0, 1], [0, 1, 0]] and groups[("x",)].rows_of(groups[("x", "y")]).tolist() == [0, 0, 1]


def test_typed_columns_of_any_type():
    rows_ = [{"k": 1, "a": [[{"s": "x"}, None], []], "b": {"c": True, "d": None}}, {"k": None, "a": None, "b": None}]
    schema = pa.schema([("k", pa.int32()), ("a", pa.list_(pa.list_(pa.struct([("s", pa.string())])))), ("b", pa.struct([("c", pa.bool_()), ("d", pa.float64())]))])
    t = batch_triples(pa.RecordBatch.from_pylist(rows_, schema=schema))
    found = sorted((r, t.paths[p], tuple(x for x in o if x >= 0), v) for r, p, o, v in zip(t.record.tolist(), t.path.tolist(), t.ordinals.tolist(), t.value.tolist(), strict=True))
    assert found == [(0, ("a", "item"), (0, 0), ""), (0, ("a", "item", "s"), (0, 0, 0), "x"), (0, ("b",), (0,), ""), (0, ("b", "c"), (0, 0), "true"), (0, ("k",), (0,), "1")]


def test_linked_tables(spark):
    df = spark.createDataFrame([(1, "xml", XML), (2, "json", JSON)], "rec_no long, fmt string, payload string")
    tables = nested_tables(payload_record_triples(df, "rec_no", "fmt", "payload"), SOURCE_SHAPE.repeated)
    assert set(tables) == {"", "ConceptList/Concept", "ConceptList/Concept/TermList/Term"}
    concepts = rows(tables["ConceptList/Concept"].where("record_key = '1'").select("record_no", "key", "parent", "ConceptUI", "`@PreferredConceptYN`"))
    assert concepts == [(0, [0, 0], [], "M1", "Y"), (0, [0, 1], [], None, None), (1, [0, 0], [], "M9", None)]
    terms = rows(tables["ConceptList/Concept/TermList/Term"].where("record_key = '2' and record_no = 0").select("key", "parent", "value", "String"))
    assert [t[0] for t in terms] == [[0, 0, 0, k] for k in range(5)] + [[0, 1, 0, 0]] and terms[2][2] == "bare" and terms[5][1:] == ([0, 1], "", "x")
    typed = spark.createDataFrame([("D1", [("M1", ["a", None, "b"])])], "dui string, concepts array<struct<ui string, terms array<string>>>")
    triples = rows(table_record_triples(typed, "dui").select("record_key", "path", "ordinals", "value"))
    assert triples == [("D1", "concepts", [0], ""), ("D1", "concepts/terms", [0, 0], "a"), ("D1", "concepts/terms", [0, 2], "b"), ("D1", "concepts/ui", [0, 0], "M1"), ("D1", "ui", [0], "D1")]
    assert nested_tables(payload_record_triples(df.limit(0), "rec_no", "fmt", "payload")) == {}
