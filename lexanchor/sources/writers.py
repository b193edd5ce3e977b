"""Sinks: dimensions as parquet, predictions as JSON."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in the given order."""
    rest = [c for c in df.columns if c not in (key, order)]
    best = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(order, F.to_json(F.struct(*rest)))).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def write_dimension(df: DataFrame, path: str, sort_by: str | None = None, files: int | None = None) -> None:
    """A dimension as parquet; ranges of the join key in each file let scans skip row groups."""
    if sort_by:
        df = (df.repartitionByRange(files, sort_by) if files else df.repartitionByRange(sort_by)).sortWithinPartitions(sort_by)
    df.write.mode("overwrite").parquet(path)


def _span(value: str | None):
    """A span as it stood: a number or a list."""
    try:
        return json.loads(value) if value else value
    except ValueError:
        return value


def _rendered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc in pdf["doc"]:
            found = [dict(e.asDict() if hasattr(e, "asDict") else e) for e in (doc["entities"] if doc["entities"] is not None else [])]
            raw = json.loads(doc["raw"]) if doc["raw"] else {"text": doc["text"]}
            own = raw.get("entities") or []
            if len(own) != len(found):
                own = [{k: _span(v) if k in ("start", "end") else v for k, v in e.items() if k in ("text", "label", "start", "end")} for e in found]
            raw["entities"] = [{**e, "id_kb": n["id_kb"] or "", "source": n["source"] or ""} for e, n in zip(own, found, strict=True)]
            out.append(json.dumps(raw, ensure_ascii=False))
        yield pd.DataFrame({"value": out})


def write_predictions(documents: DataFrame, folder: str) -> None:
    """One JSON object a line in document order; ranges of documents go to successive files.

    Documents and mentions keep all keys that they came with; of mentions, id and source are put.
    """
    raw = F.col("raw") if "raw" in documents.columns else F.lit(None).cast("string")
    rows = documents.repartitionByRange("doc_idx").sortWithinPartitions("doc_idx").select(F.struct(raw.alias("raw"), "text", "entities").alias("doc"))
    rows.mapInPandas(_rendered, "value string").write.mode("overwrite").text(folder)


def _opened(spark: SparkSession, path: str):
    """A writer of UTF-8 text to a file on whatever file system the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    system.setWriteChecksum(False)  # the file may be edited by hand
    out = spark._jvm.java.io.OutputStreamWriter(system.create(target, True), "UTF-8")
    system.setWriteChecksum(True)
    return out


def merge_predictions(spark: SparkSession, folder: str, path: str) -> int:
    """The lines of a folder as one JSON array file, indented, streamed document by document; returns their number."""
    out = _opened(spark, path)
    lines = spark.read.text(folder).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    n = 0
    out.write("[")
    for row in lines.orderBy("file", "at").toLocalIterator():
        text = json.dumps(json.loads(row["value"]), ensure_ascii=False, indent=2)
        out.write((",\n" if n else "\n") + "\n".join("  " + x for x in text.split("\n")))
        n += 1
    out.write("\n]\n" if n else "]\n")
    out.close()
    return n


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


PAGE = """<!doctype html><html lang="en"><meta charset="utf-8"><title>{title}</title>
<style>body{{font-family:sans-serif}}mark{{background:#fd6}}td,th{{text-align:left;vertical-align:top;padding:4px}}</style>
<h1>{title}</h1><p>{counts}</p><p>Filter: <input oninput="for(const r of document.querySelectorAll('tbody tr'))r.hidden=!r.textContent.toLowerCase().includes(this.value.toLowerCase())"></p>
<table><thead><tr>{head}</tr></thead><tbody>
{rows}
</tbody></table></html>
"""


def write_report(rows: DataFrame, path: str, title: str, count_by: str, ready: tuple[str, ...] = (), most: int = 5000) -> int:
    """A standalone page of at most ``most`` rows in their order, with counts and a filter; columns of ``ready`` are HTML already."""
    counts = ", ".join(f"{html.escape(str(r[0]))}: {r[1]}" for r in rows.groupBy(count_by).count().orderBy(F.col("count").desc(), count_by).collect())
    lines = []
    for row in rows.limit(most).collect():
        cells = zip(rows.columns, ("" if v is None else str(v) for v in row), strict=True)
        lines.append("<tr>" + "".join(f"<td>{v if c in ready else html.escape(v)}</td>" for c, v in cells) + "</tr>")
    out = _opened(rows.sparkSession, path)
    out.write(PAGE.format(title=html.escape(title), counts=counts, head="".join(f"<th>{html.escape(c)}</th>" for c in rows.columns), rows="\n".join(lines)))
    out.close()
    return len(lines)
