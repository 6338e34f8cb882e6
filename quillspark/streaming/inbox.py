"""Structured Streaming: notes as they arrive, and activity in windows with late data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.tables import shared_folder, table

#: Records may come this much later than the newest one.
LATENESS = "10 minutes"


def windowed_activity(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events and their value per window and type; state is dropped behind the watermark."""
    seen = events.withWatermark("ts", LATENESS)
    return seen.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def first_deliveries(notes: DataFrame) -> DataFrame:
    """Notes of a stream, each at its first delivery; what is delivered again within the watermark is dropped."""
    return notes.withWatermark("received_at", "30 days").dropDuplicatesWithinWatermark(["note_id"])


def run_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what is there into Parquet files under ``folder``; what a watermark has closed is written, state behind
    it is dropped, and the driver sees none of it."""
    out = f"{folder}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")


def stream_activity(spark, sf_dir: str) -> DataFrame:
    """The events table read as a stream, counted per hour and type."""
    batch = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events.parquet" if _is_folder(spark, f"{sf_dir}/events.parquet") else f"{sf_dir}/events.parque[t]")
    # windows that the watermark has not closed when the input ends are those of the last hours: they are counted as a batch
    closed = run_to_end(windowed_activity(stream.withColumn("ts", F.col("ts").cast("timestamp"))), shared_folder(spark))
    last = closed.agg(F.max("w.end")).scalar()
    rest = batch.withColumn("ts", F.col("ts").cast("timestamp")).filter(last.isNull() | (F.col("ts") >= last))
    done = closed.unionByName(windowed_activity(rest))
    return done.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


def _is_folder(spark, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


QUERIES = {"stream_activity": stream_activity}
SQL = {
    "stream_activity": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
