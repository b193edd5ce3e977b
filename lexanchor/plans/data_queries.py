"""Queries of the general data-processing problems: nearby places, packed fields, nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexanchor.operators.nested import SOURCE_SHAPE, nested_tables, payload_record_triples, table_record_triples, vocabulary_terms
from lexanchor.operators.packed import explode_packed
from lexanchor.operators.spatial import containing_regions, radius_pairs
from lexanchor.plans.registry import Registry
from lexanchor.session import table

REGISTRY = Registry()
RADIUS_KM = 5.0


@REGISTRY.add(
    "p2_found",
    """
    WITH pts AS (
      SELECT DISTINCT geonameid, latitude AS lat, longitude AS lon FROM locations
      WHERE geonameid IS NOT NULL AND isfinite(latitude) AND isfinite(longitude) AND abs(latitude) <= 90
        AND abs(longitude) <= 180 AND NOT (latitude = 0 AND longitude = 0)),
    near AS (
      SELECT a.geonameid AS geonameid_a, b.geonameid AS geonameid_b,
        pow(sin(radians(b.lat - a.lat) / 2), 2)
          + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h
      FROM pts a JOIN pts b ON a.geonameid < b.geonameid AND b.lat BETWEEN a.lat - 0.05 AND a.lat + 0.05)
    SELECT DISTINCT geonameid_a, geonameid_b FROM near
    WHERE 6371.0 * 2 * atan2(sqrt(least(1.0, h)), sqrt(greatest(0.0, 1 - h))) < 5.0
    """,
)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = radius_pairs(table(spark, sf_dir, "locations"), "geonameid", "latitude", "longitude", RADIUS_KM)
    return pairs.select(F.col("a").alias("geonameid_a"), F.col("b").alias("geonameid_b"))


HALF_SIDE = 0.25


@REGISTRY.add(
    "p2_regions",
    f"""
    WITH pts AS (
      SELECT DISTINCT geonameid, feature_code, latitude AS lat, longitude AS lon FROM locations
      WHERE geonameid IS NOT NULL AND isfinite(latitude) AND isfinite(longitude) AND abs(latitude) <= 90
        AND abs(longitude) <= 180 AND NOT (latitude = 0 AND longitude = 0))
    SELECT DISTINCT p.geonameid, r.geonameid AS region FROM pts r JOIN pts p
      ON p.lat BETWEEN r.lat - {HALF_SIDE} AND r.lat + {HALF_SIDE} AND p.lon BETWEEN r.lon - {HALF_SIDE} AND r.lon + {HALF_SIDE}
    WHERE r.feature_code IN ('PPLC', 'PPLA')
    """,
)
def p2_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions that contain each place: a square around every capital and seat."""
    places = table(spark, sf_dir, "locations")
    seats = places.where("feature_code in ('PPLC', 'PPLA') and geonameid is not null and abs(latitude) <= 90 and abs(longitude) <= 180")
    seats = seats.where("not (latitude = 0 and longitude = 0)")
    south, north = F.col("latitude") - HALF_SIDE, F.col("latitude") + HALF_SIDE
    west, east = F.col("longitude") - HALF_SIDE, F.col("longitude") + HALF_SIDE
    squares = seats.select(F.col("geonameid").alias("region"), F.array(south, south, north, north).alias("lats"), F.array(west, east, east, west).alias("lons"))
    found = containing_regions(places, "geonameid", "latitude", "longitude", squares)
    return found.withColumnRenamed("id", "geonameid")


@REGISTRY.add(
    "p3_found",
    r"""
    WITH src AS (
      SELECT DISTINCT mention_id, id_kb FROM entities WHERE id_kb IS NOT NULL),
    raw AS (
      SELECT mention_id, list_filter(list_transform(
          regexp_extract_all(regexp_replace(id_kb, ' (et|and|ou|or) ', ' ; ', 'g'),
            '"(?:[^"]|"")*"|''[^'']*''|[^,;|/&:+\n\r\t\[\](){}"'']+'), lambda x: trim(x)), lambda x: x <> '') AS parts
      FROM src),
    clean AS (
      SELECT mention_id, list_filter(list_transform(parts, lambda x: trim(CASE
          WHEN length(x) > 1 AND x[1] = '"' AND x[-1] = '"' THEN replace(x[2:-2], '""', '"')
          WHEN length(x) > 1 AND x[1] = '''' AND x[-1] = '''' THEN x[2:-2]
          ELSE x END)), lambda x: x <> '') AS parts
      FROM raw)
    SELECT DISTINCT mention_id, CAST(i - 1 AS BIGINT) AS pos, parts[i] AS item
    FROM (SELECT mention_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM clean WHERE len(parts) >= 2)
    """,
)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = explode_packed(table(spark, sf_dir, "entities"), "mention_id", "id_kb")
    return rows.withColumnRenamed("key", "mention_id")


@REGISTRY.add("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary_terms(
        table(spark, sf_dir, "descriptors"), table(spark, sf_dir, "supplementals"), table(spark, sf_dir, "mesh_records")
    )


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (
        ("mesh_records", payload_record_triples(table(spark, sf_dir, "mesh_records"), "rec_no", "fmt", "payload")),
        ("descriptors", table_record_triples(table(spark, sf_dir, "descriptors"), "dui")),
        ("supplementals", table_record_triples(table(spark, sf_dir, "supplementals"), "sui")),
    )
    out = None
    for name, part in parts:
        part = part.select(F.lit(name).alias("tbl"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@REGISTRY.add("p7_triples")
def p7_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path-value-ordinal triple of the three tables."""
    return _triples(spark, sf_dir)


@REGISTRY.add("p7_concepts")
def p7_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linked table of concepts of the source records, with the key of each and of its record."""
    tables = nested_tables(payload_record_triples(table(spark, sf_dir, "mesh_records"), "rec_no", "fmt", "payload"), SOURCE_SHAPE.repeated)
    return tables["/".join(SOURCE_SHAPE.repeated[0])]
