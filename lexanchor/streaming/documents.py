"""Documents as a stream: linked in micro-batches, and counted in event-time windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexanchor.operators.places import link_places


def link_stream(mentions: DataFrame, names: DataFrame, places: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Place mentions of a stream linked batch by batch; each batch overwrites its own folder, so a retry repeats nothing.

    The ranking windows of the linker aren't allowed on a stream, but are within a batch.
    """

    def link(batch: DataFrame, number: int) -> None:
        linked = link_places(batch.select(F.col("text").alias("mention")), names, places)
        keyed = batch.join(linked.withColumnRenamed("mention", "text"), "text", "left")
        keyed.select("mention_id", "text", "stage", "geonameid").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return mentions.writeStream.foreachBatch(link).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deliveries(corpus: DataFrame, lateness: str = "60 days", width: str = "7 days") -> DataFrame:
    """Documents per source and window of publication; deliveries later than the watermark are dropped."""
    return (
        corpus.withWatermark("published_at", lateness)
        .dropDuplicatesWithinWatermark(["doc_idx"])
        .groupBy(F.window("published_at", width), "source")
        .agg(F.count("*").alias("n_docs"))
        .select(F.col("window.start").alias("week"), "source", "n_docs")
    )


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run what is available into an in-memory table, for checks."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
