"""Structured Streaming: event-time windows, count-based features, and resumable upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, per_trigger: int = 8) -> DataFrame:
    """Files of a Parquet table (a folder or one file) as an unbounded stream."""
    glob = f"{path[:-1]}[{path[-1]}]"  # a pattern may name one file, a plain path only a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(glob)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, sum and extremes of each type and window of event time; state older than the watermark is dropped."""
    by = [F.window("ts", width).alias("w"), "event_type"]
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    agg = timed.withWatermark("ts", late).groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("most"), F.min("value").alias("least")
    )
    return agg.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total", "most", "least")


def run_available(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Processes all there is, batch by batch, with a checkpoint; the table of the last state.

    A run that was stopped goes on from the checkpoint.  In mode ``complete`` every batch
    replaces the table; in ``append`` the watermark decides when a window is final.
    """
    spark = stream.sparkSession
    out = f"{folder}/table"

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(store).start().awaitTermination()
    return spark.read.parquet(out)


def upsert(batch: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of ``batch`` in place of those of equal key."""
    return table.join(batch.select(key), key, "left_anti").unionByName(batch)
