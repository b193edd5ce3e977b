import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
FAST = ["t1_normalize", "t4_strip_prefix", "link_places", "link_terms", "c1_link", "j10_acronyms", "j11_validate", "a5_metrics", "l3_rerank_stub", "p2_found", "p2_regions", "p3_found", "j2_cascade", "r4_postprocess"]


@pytest.fixture(scope="module")
def duck():
    import os

    if not os.path.isdir(SF):
        pytest.skip("the driver's tables aren't here")
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def canon(v):
    return "NULL" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", FAST)
def test_oracles(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(canon, r)) for r in df.select(*columns).collect())
    rel = duck.execute(entry.oracle_sql()[name])
    order = [[d[0] for d in rel.description].index(c) for c in columns]
    assert got == sorted(tuple(canon(r[i]) for i in order) for r in rel.fetchall())


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.FLAGSHIP in entry.queries()


def test_entry_has_rows(spark, duck):
    assert entry.entry(spark).count() > 0
