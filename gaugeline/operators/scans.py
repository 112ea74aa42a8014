"""Scans along series and trajectories that many tasks share: state is carried from bucket to bucket.

A series is cut into buckets of positions.  Windows run inside a bucket, on its own
rows and a halo of neighbours; what lies before a bucket reaches it as one row of
carried state.  So a series of any length is many tasks, and what one task sees of a
whole series is a row a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a bucket.
BUCKET = 4096


def bucketed(rows: DataFrame, back: int = 0, ahead: int = 0, bucket: int = BUCKET) -> DataFrame:
    """``rows`` (series_id, pos, ...) with ``bucket``, and ``own``: false for copies that only are neighbours.

    A row reaches every bucket in which some row looks up to ``back`` places back or ``ahead`` places ahead at it.
    """
    place = lambda p: F.floor(p / F.lit(bucket)).cast("long")
    first, last = F.greatest(place(F.col("pos") - ahead), F.lit(0)), place(F.col("pos") + back)
    out = rows.withColumn("bucket", F.explode(F.sequence(first, last)) if back or ahead else place(F.col("pos")))
    return out.withColumn("own", F.col("bucket") == place(F.col("pos")))


def inside() -> Window:
    return Window.partitionBy("series_id", "bucket").orderBy("pos")


def carried(rows: DataFrame, state: dict[str, Column], scan: dict[str, Column]) -> DataFrame:
    """``rows`` with what the buckets before theirs hand on.

    ``state`` are aggregates of one bucket; ``scan`` are aggregates of the states of all
    buckets before (null in the first one).
    """
    before = Window.partitionBy("series_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    states = rows.groupBy("series_id", "bucket").agg(*(c.alias(k) for k, c in state.items()))  # a row a bucket
    handed = states.select("series_id", "bucket", *(c.over(before).alias(k) for k, c in scan.items()))
    return rows.join(handed, ["series_id", "bucket"])


def running_total(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` up to each row, over bucketed rows without halo."""
    summed = carried(rows, {"_sum": F.sum(value)}, {"_before": F.sum("_sum")})
    here = F.sum(value).over(inside().rowsBetween(Window.unboundedPreceding, 0))
    return summed.withColumn(name, F.coalesce("_before", F.lit(0)) + here).drop("_before")


def last_known(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the last ``value`` that isn't null before each row, over bucketed rows without halo."""
    latest = F.max_by(value, F.when(value.isNotNull(), F.col("pos")))
    handed = carried(rows, {"_latest": latest}, {"_before": F.last("_latest", ignorenulls=True)})
    here = F.last(value, ignorenulls=True).over(inside().rowsBetween(Window.unboundedPreceding, -1))
    return handed.withColumn(name, F.coalesce(here, "_before")).drop("_before")


#: Maps of one level that are composed in one row, and levels below the top one.
MAPS, LEVELS = 256, 2


def affine_suffix(rows: DataFrame, a: str, b: str, name: str, width: int = MAPS, levels: int = LEVELS) -> DataFrame:
    """Adds ``name``: y(p) = b(p) + a(p) * y(p + 1) along ``series_id, pos`` (dense from 0), 0 after the end.

    Affine maps compose associatively.  Buckets of ``width`` maps are folded from their
    ends and composed to one map each; these are scanned likewise, ``levels`` times, and at
    the top in one row a series.  Then values go back down.  Work is linear in the steps, and no
    row holds more than ``width`` maps below the top, which holds steps / width ** levels.
    """
    return _suffix(rows, a, b, name, width, levels)


def _folded(maps: Column, start: Column) -> Column:
    """Values y of each map (in order) from the value that stands after the last one."""
    first = F.array().cast("array<double>")
    state = F.struct(start.cast("double").alias("y"), first.alias("all"))

    def step(s: Column, m: Column) -> Column:
        y = m["b"] + m["a"] * s["y"]
        return F.struct(y.alias("y"), F.array_append(s["all"], y).alias("all"))

    return F.reverse(F.aggregate(F.reverse(maps), state, step)["all"])


def _suffix(rows: DataFrame, a: str, b: str, name: str, width: int, levels: int) -> DataFrame:
    placed = rows.withColumn("_bucket", F.floor(F.col("pos") / width).cast("long") if levels else F.lit(0).cast("long"))
    maps = F.array_sort(F.collect_list(F.struct("pos", F.col(a).alias("a"), F.col(b).alias("b")))).alias("maps")
    groups = placed.select("series_id", "_bucket", "pos", a, b).groupBy("series_id", "_bucket").agg(maps)
    if levels:
        one = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
        whole = F.aggregate(
            F.reverse("maps"), one, lambda s, m: F.struct((m["a"] * s["a"]).alias("a"), (m["b"] + m["a"] * s["b"]).alias("b"))
        )
        composed = groups.select("series_id", F.col("_bucket").alias("pos"), whole.alias("m")).select("series_id", "pos", "m.a", "m.b")
        above = _suffix(composed, "a", "b", "_y", width, levels - 1)
        after = above.select("series_id", (F.col("pos") - 1).alias("_bucket"), "_y")  # what follows the bucket before
        groups = groups.join(after, ["series_id", "_bucket"], "left")
        start = F.coalesce("_y", F.lit(0.0))
    else:
        start = F.lit(0.0)
    zipped = F.arrays_zip(F.transform("maps", lambda m: m["pos"]).alias("pos"), _folded(F.col("maps"), start).alias("y"))
    values = groups.select("series_id", F.explode(zipped).alias("z")).select("series_id", "z.pos", F.col("z.y").alias(name))
    return rows.join(values, ["series_id", "pos"])
