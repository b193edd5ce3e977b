import json
import zipfile

from lexanchor.operators import vocabulary as V
from lexanchor.sources import readers as R
from lexanchor.sources import remote
from lexanchor.sources import writers as W
from tests.conftest import rows


def line(gid, name, alternates="", lat="1.5", lon="2.5", code="PPL", pop="10", n=19):
    f = [gid, name, name.lower(), alternates, lat, lon, "P", code, "FR", "", "11", "", "", "", pop, "", "", "Europe/Paris", "2020-01-01"]
    return "\t".join(f[:n])


def test_places_from_zip(spark, tmp_path):
    archive = tmp_path / "all.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("all.txt", "\n".join([line("1", "Aix", "Aix,aix ,Aquae"), line("2", "Bor", pop="", lat="", lon=""), line("3", "short", n=12), ""]))
    path = R.extract_member(str(archive), "all.txt", str(tmp_path / "out"))
    places = R.read_places(spark, path)
    assert [(r.geonameid, r.population, r.latitude) for r in places.orderBy("geonameid").collect()] == [("1", 10, 1.5), ("2", 0, None)]
    assert rows(R.place_aliases(places).select("geonameid", "name_lower")) == [("1", "aix"), ("1", "aquae"), ("2", "bor")]


def test_alternate_names(spark, tmp_path):
    path = tmp_path / "alt.txt"
    path.write_text("9\t1\tfr\tAix-la-Chapelle\n9\t1\ten\tAachen\n9\t1\tfr\n9\t2\tfr\t \tx\n")
    assert rows(R.read_alternate_names(spark, str(path)).select("geonameid", "name_lower")) == [("1", "aix-la-chapelle")]


def test_vocabulary_xml(spark, tmp_path):
    term = "<TermList><Term><String>{}</String></Term><Term><String></String></Term></TermList>"
    one = f"<DescriptorRecord><DescriptorUI>D1</DescriptorUI><DescriptorName><String>a</String></DescriptorName><ConceptList><Concept PreferredConceptYN='Y'><ConceptUI>M1</ConceptUI>{term.format('t')}</Concept></ConceptList></DescriptorRecord>"
    two = one.replace("D1", "D2").replace("</ConceptList>", f"<Concept PreferredConceptYN='N'><ConceptUI>M2</ConceptUI>{term.format('u')}</Concept></ConceptList>")
    path = tmp_path / "d.xml"
    path.write_text(f"<DescriptorRecordSet>{one}{two}</DescriptorRecordSet>")
    found = R.read_descriptors(spark, str(path)).orderBy("dui").collect()
    assert [(r.dui, [(c.ui, c.preferred, c.terms) for c in r.concepts]) for r in found] == [("D1", [("M1", True, ["t"])]), ("D2", [("M1", True, ["t"]), ("M2", False, ["u"])])]
    supp = tmp_path / "s.xml"
    mapped = "<HeadingMappedToList><HeadingMappedTo><DescriptorReferredTo><DescriptorUI>*D1</DescriptorUI></DescriptorReferredTo></HeadingMappedTo></HeadingMappedToList>"
    supp.write_text(f"<S><SupplementalRecord><SupplementalRecordUI>C1</SupplementalRecordUI>{mapped}</SupplementalRecord><SupplementalRecord><SupplementalRecordUI>C2</SupplementalRecordUI></SupplementalRecord></S>")
    assert rows(R.read_supplementals(spark, str(supp)).select("sui", "mapped_to")) == [("C1", ["D1"]), ("C2", [])]


def test_bilingual(spark, tmp_path):
    path = tmp_path / "b.json"
    path.write_text(json.dumps([{"db": "mesh", "id": "D1", "trx": "rage", "eng": "Rabies", "xtr_cs": ["la rage", ""], "heading": [None]}, {"db": "x", "id": "D2"}, {"db": "mesh", "id": "Q3"}]))
    assert rows(R.bilingual_terms(R.read_bilingual(spark, str(path))).select("id", "ord", "term")) == [("D1", 0, "rage"), ("D1", 1, "Rabies"), ("D1", 2, "la rage")]


def test_bilingual_names(spark, tmp_path):
    path = tmp_path / "b.json"
    path.write_text(json.dumps([{"db": "mesh", "id": "D1", "trx": "rage", "eng": "Rabies", "xtr_cs": ["la rage", "", "lyssa", "late"], "xtr_en": ["", "Lyssa", "late"], "cat": ["c"]}, {"db": "mesh", "id": "D2", "eng": "x"}]))
    named = V.bilingual_names(R.read_bilingual(spark, str(path)))
    assert rows(named) == [("D1", "rage", "Rabies", ["la rage", "lyssa"], ["Lyssa"], ["c"]), ("D2", "", "x", [], [], [])]
    assert rows(V.spoken_names(named)) == [("D1", k, n) for k, n in enumerate(["rage", "Rabies", "la rage", "lyssa", "Lyssa"])] + [("D2", 0, "x")]


def test_corpus_round_trip(spark, tmp_path):
    docs = [
        {"text": "Été à Aix", "entities": [{"text": "Aix", "label": "LOCATION", "start": [6], "end": [9], "id_kb": "1", "source": "GeoNames"}]},
        {"text": "x", "entities": [{"text": "x", "label": "PATHOGEN", "start": 0, "end": 1}]},
        {"text": "none", "entities": []},
    ]
    path = tmp_path / "c.json"
    path.write_text(json.dumps(docs))
    corpus = R.read_corpus(spark, str(path))
    ents = R.corpus_entities(corpus)
    assert rows(ents.select("doc_idx", "ent_idx", "start_pos", "end_pos", "id_kb")) == [(0, 0, 6, 9, "1"), (1, 0, 0, 1, None)]
    W.write_predictions(corpus, str(tmp_path / "out"))
    assert W.merge_predictions(spark, str(tmp_path / "out"), str(tmp_path / "all.json")) == 3
    back = json.loads((tmp_path / "all.json").read_text())
    assert [d["text"] for d in back] == ["Été à Aix", "x", "none"] and "Été" in (tmp_path / "all.json").read_text()


def test_exonyms_and_dimension(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text(json.dumps({"rd congo": ["203312", "1"]}))
    assert rows(R.read_exonyms(spark, str(path), True)) == [("rd congo", 0, "203312"), ("rd congo", 1, "1")]
    assert rows(R.read_exonyms(spark, str(path))) == [] == rows(R.read_exonyms(spark, str(tmp_path / "no"), True))
    df = spark.createDataFrame([("1", "b", 2), ("1", "a", 1), ("2", "c", 3)], "id string, v string, pos int")
    W.write_dimension(W.first_wins(df, "id", "pos"), str(tmp_path / "dim"), "id", 2)
    assert rows(spark.read.parquet(str(tmp_path / "dim"))) == [("1", "a"), ("2", "c")]


def test_downloads_and_searches_are_injected(spark, tmp_path):
    import io

    opened = []

    def fetch(address):
        opened.append(address)
        return io.BytesIO(b"x" * 10)

    there = tmp_path / "there.zip"
    there.write_text("old")
    sources = [("http://a", str(tmp_path / "new" / "a.zip")), ("http://b", str(there))]
    assert remote.download(sources, fetch) == [sources[0][1]] and opened == ["http://a"]
    assert remote.download(sources, fetch) == [] and there.read_text() == "old"
    places = spark.createDataFrame([(str(k), "R" if k == 2 else "P") for k in range(9)], "geonameid string, feature_class string")
    found = {"rd congo": ["Q1", "Q2", "Q3", "Q4"], "none": []}

    def search(key):
        return found[key]  # fails for other keys

    def claims(ids):
        return {"Q1": ["3", "2", "3"], "Q2": ["99", "1"], "Q3": ["5", "6", "7", "8"], "Q4": ["4"]}

    asked = spark.createDataFrame([("rd congo",), ("none",), ("fails",), (None,), ("rd congo",)], "key string")
    assert rows(remote.searched_exonyms(asked, places, search, claims)) == [("rd congo", k, i) for k, i in enumerate(["3", "1", "5", "6", "7"])]


def test_report_page(spark, tmp_path):
    df = spark.createDataFrame([("MISSED", "a <b>", "x <mark>y</mark>"), ("MISSED", None, ""), ("OTHER", "c", "")], "error string, mention string, html string")
    path = tmp_path / "r.html"
    assert W.write_report(df.orderBy("error", "mention"), str(path), "Errors & more", "error", ("html",)) == 3
    page = path.read_text()
    assert "MISSED: 2, OTHER: 1" in page and "a &lt;b&gt;" in page and "x <mark>y</mark>" in page and "Errors &amp; more" in page
    assert W.write_report(df, str(path), "t", "error", (), 1) == 1
