"""Places in a total order, and exact quantiles, without a window in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once: a checkpoint where the cluster names a folder, the block store elsewhere (tests)."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint() if folder else df.persist()


def numbered(rows: DataFrame, *order: Column | str, by: tuple[str, ...] = (), name: str = "place") -> DataFrame:
    """``rows`` with their zero-based place in a total order, within equal ``by``.

    Rows are dealt by range and sorted; a place is the count of rows in the ranges
    before, plus the place in the own range.  Only counts, one a range and group, are
    gathered.  ``order`` should be total, so that reruns agree.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*map(F.col, by), *(F.col(o) if isinstance(o, str) else o for o in order)]
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()  # its low 33 bits count a range's rows
    dealt = kept(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_at", at.bitwiseAND(F.lit(2**33 - 1))))
    counts = dealt.groupBy("_range", *by).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", *by, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    on = F.col("d._range") == F.col("s._range")
    for k in by:
        on &= F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}"))
    joined = dealt.alias("d").join(starts.alias("s"), on)
    place = F.col("s._before") + F.col("d._at") - F.col("s._first")
    return joined.select(*(F.col(f"d.{c}") for c in rows.columns), place.alias(name))


def quantiles(rows: DataFrame, value: str, qs: tuple[float, ...], by: tuple[str, ...] = (), nearest: bool = False) -> DataFrame:
    """``by, q0, q1, ...``: exact quantiles of the finite values, linear between neighbours or by nearest rank.

    Values are placed by range, so no task buffers a group.
    """
    finite = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).alias("_v"))
    ranked = numbered(finite, "_v", by=by, name="_p")
    sizes = finite.groupBy(*by).agg(F.count("*").alias("_n"))
    j = ranked.join(sizes, list(by)) if by else ranked.crossJoin(F.broadcast(sizes))  # without groups one row
    out = []
    for i, q in enumerate(qs):
        spot = F.greatest(F.ceil(F.col("_n") * q) - 1, F.lit(0)) if nearest else (F.col("_n") - 1) * F.lit(float(q))
        low, high = F.floor(spot), F.ceil(spot)
        at = lambda p: F.max(F.when(F.col("_p") == p, F.col("_v")))
        share = F.max(spot - low)
        out.append((at(low) + (at(high) - at(low)) * share if not nearest else at(low)).alias(f"q{i}"))  # equal neighbours give their value exactly
    wanted = F.lit(False)
    for q in qs:
        spot = F.greatest(F.ceil(F.col("_n") * q) - 1, F.lit(0)) if nearest else (F.col("_n") - 1) * F.lit(float(q))
        wanted |= F.col("_p").isin(F.floor(spot), F.ceil(spot))
    return j.where(wanted).groupBy(*by).agg(*out)
