import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexanchor.operators.packed import _clean, _scan_row, explode_packed, split_packed
from tests.conftest import rows

CASES = [
    ("D1;D2", ["D1", "D2"]),
    ("D1 & D2 : C3 | C4", ["D1", "D2", "C3", "C4"]),
    ('["a", "b"]', ["a", "b"]),
    ("{1,2,3}", ["1", "2", "3"]),
    ("(D1)(D2)", ["D1", "D2"]),
    ("A et B and C", ["A", "B", "C"]),
    ('x, "a, b"; c', ["x", "a, b", "c"]),
    ('"dit ""X / Y"", ancien";Z', ['dit "X / Y", ancien', "Z"]),
    ("'L; M'|N", ["L; M", "N"]),
    ("Val-d'Or; L'Île", ["Val-d'Or", "L'Île"]),
    ("D1,,D2;", ["D1", "D2"]),
    ("D1\nD2\tD3", ["D1", "D2", "D3"]),
    ("D1 ,", ["D1"]),
    ('"one, value"', ["one, value"]),
    ("", []),
    (None, []),
    ("  ", []),
    ('"open; b', ['"open', "b"]),
    ("a (b) c; d", ["a (b) c", "d"]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_cases(text, want):
    assert split_packed(pa.array([text], pa.string())).to_pylist() == [want]


def test_batch_and_slices_equal_single_rows():
    texts = [t for t, _ in CASES] * 3
    array = pa.array(texts, pa.string())
    assert split_packed(array).to_pylist() == [w for _, w in CASES] * 3
    assert split_packed(array.slice(5, 9)).to_pylist() == ([w for _, w in CASES] * 3)[5:14]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab1é ,;|\"'[]()-", max_size=14), max_size=8))
def test_vectorised_scan_equals_state_machine_without_quotes_and_brackets(texts):
    plain = [t.translate(str.maketrans("", "", "\"'[]()")) for t in texts]
    want = [[v for v in _clean(pa.array(_scan_row(t), pa.string())).to_pylist() if v] for t in plain]
    assert split_packed(pa.array(plain, pa.string())).to_pylist() == want
    assert len(split_packed(pa.array(texts, pa.string()))) == len(texts)  # never breaks


def test_query_form(spark):
    data = [(1, "a;b", "x"), (1, "a;b", "x"), (2, "single", "x"), (3, None, "x"), (4, ";;", "x"), (5, "v;" * 5000 + "w", "x")]
    df = spark.createDataFrame(data, "mention_id long, id_kb string, pos string")
    got = rows(explode_packed(df, "mention_id", "id_kb"))
    assert got[:2] == [(1, 0, "a"), (1, 1, "b")] and len(got) == 2 + 5001 and got[-1] == (5, 5000, "w")
    assert rows(explode_packed(df.limit(0), "mention_id", "id_kb")) == []
