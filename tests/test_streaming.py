import datetime as dt

from lexanchor.operators.places import name_dimension, place_dimension
from lexanchor.streaming.documents import deliveries, link_stream, run_to_table
from tests.conftest import rows
from tests.test_places import LOCATIONS, NAMES, kb


def test_linked_stream(spark, tmp_path):
    locations, names = kb(spark)
    spark.createDataFrame([(1, "Aix"), (2, "région de Bor"), (3, "nowhere")], "mention_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("mention_id long, text string").parquet(str(tmp_path / "in"))
    link_stream(stream, name_dimension(locations, names), place_dimension(locations), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    found = rows(spark.read.parquet(str(tmp_path / "out")).select("mention_id", "geonameid"))
    assert [f[0] for f in found] == [1, 2, 3] and found[2][1] is None and found[0][1] is not None
    assert LOCATIONS and NAMES


def test_weekly_deliveries_drop_repeats(spark, tmp_path):
    day = dt.datetime(2025, 1, 1)
    data = [(k, "s", day + dt.timedelta(days=k % 20)) for k in range(40)] + [(3, "s", day + dt.timedelta(days=3))]
    schema = "doc_idx long, source string, published_at timestamp"
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run_to_table(deliveries(stream), "weekly", str(tmp_path / "cp"), "complete").awaitTermination()
    assert sum(r.n_docs for r in spark.table("weekly").collect()) == 40
