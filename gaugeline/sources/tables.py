"""Sources: driver tables bound to series, model errors, messages and trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str, by: str = "event_type") -> DataFrame:
    """``series_id, pos, ts, value``: events of one type or user, in time order; places come from ranges, so one type is many tasks."""
    rows = table(spark, sf_dir, "events").select(F.col(by).alias("series_id"), "ts", "event_id", "value")
    return numbered(rows, "ts", "event_id", by=("series_id",), name="pos").select("series_id", "pos", "ts", "value")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series: the sum of order prices of each date."""
    orders = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day"))
    sums = orders.agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return numbered(sums, "day", name="pos").select(F.lit("orders").alias("series_id"), "pos", "day", "value")


def keyed_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Last row of each key by ``order``; negative keys are skipped."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.where(F.col(key) >= 0).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def model_errors(spark: SparkSession, sf_dir: str, season: int = 7) -> DataFrame:
    """Long table ``sample, model, mse, mae`` of four forecasters on user series.

    Each user's last eight events are forecast from the ones before: last value,
    seasonal repeat, mean and drift.
    """
    s = series(spark, sf_dir, "user_id")
    n = Window.partitionBy("series_id")
    cut = s.withColumn("n", F.count("*").over(n)).where("n > 16")
    past = cut.where("pos < n - 8")
    stats = past.groupBy("series_id").agg(
        F.max_by("value", "pos").alias("last"), F.min_by("value", "pos").alias("first"), F.avg("value").alias("mean"),
        F.count("*").alias("m"),
    )
    future = cut.where("pos >= n - 8").withColumn("h", F.col("pos") - (F.col("n") - 8))
    tail = past.select("series_id", F.col("pos").alias("back"), F.col("value").alias("seasonal"))
    rows = (
        future.join(stats, "series_id")
        .withColumn("back", F.col("m") - season + F.col("h") % season)
        .join(tail, ["series_id", "back"])
        .withColumn("drift", F.col("last") + (F.col("last") - F.col("first")) / (F.col("m") - 1) * (F.col("h") + 1))
    )
    long = rows.select(
        F.col("series_id").alias("sample"), "value",
        F.explode(F.create_map(
            F.lit("naive"), "last", F.lit("seasonal"), "seasonal", F.lit("mean"), "mean", F.lit("drift"), "drift",
        )).alias("model", "yhat"),
    )
    d = F.col("yhat") - F.col("value")
    return long.groupBy("sample", "model").agg(
        F.round(F.avg(d * d), 8).alias("mse"), F.round(F.avg(F.abs(d)), 8).alias("mae")
    )
