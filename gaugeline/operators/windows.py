"""Count-based windows and sequence operators on ``series_id, pos, value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.scores import ratio
from . import kernels
from .ordering import kept, numbered, quantiles
from .scans import BUCKET, bucketed, inside, last_known, running_total


def along(*more: str):
    return Window.partitionBy("series_id", *more).orderBy("pos")


def build_windows(series: DataFrame, history: int, horizon: int) -> DataFrame:
    """Every full window: history and future arrays; none crosses a series' end."""
    past = along().rowsBetween(-(history - 1), 0)
    ahead = along().rowsBetween(1, horizon)
    rows = series.select(
        "series_id", (F.col("pos") - history + 1).alias("start"),
        F.collect_list("value").over(past).alias("history"), F.collect_list("value").over(ahead).alias("future"),
    )
    return rows.where((F.size("history") == history) & (F.size("future") == horizon))


def spread(series: DataFrame, reach: int, bucket: int) -> DataFrame:
    """Rows with the buckets of ``bucket`` positions that need them: the own one, and the one
    before for rows within ``reach`` of a bucket's start.  One series needn't be one task."""
    own = F.floor(F.col("pos") / bucket).cast("long")
    first = F.greatest(F.floor((F.col("pos") - reach) / bucket).cast("long"), F.lit(0))
    return series.withColumn("bucket", F.explode(F.sequence(first, own)))


def build_windows_bucketed(series: DataFrame, history: int, horizon: int, bucket: int = 512) -> DataFrame:
    """The same windows for series of any length, in groups of ``bucket`` positions."""
    past, ahead = along("bucket").rowsBetween(-(history - 1), 0), along("bucket").rowsBetween(1, horizon)
    rows = spread(series, history + horizon - 1, bucket).select(
        "series_id", "bucket", (F.col("pos") - history + 1).alias("start"),
        F.collect_list("value").over(past).alias("history"), F.collect_list("value").over(ahead).alias("future"),
    )
    full = (F.size("history") == history) & (F.size("future") == horizon)
    return rows.where(full & (F.floor(F.col("start") / bucket) == F.col("bucket"))).drop("bucket")


def split_windows(series: DataFrame, history: int, horizon: int, sizes: dict[str, int], bucket: int = 512) -> DataFrame:
    """Windows of consecutive splits of each series, named with their sizes in rows; none crosses a split."""
    edge, split = 0, None
    start = F.lit(None)
    for name, size in sizes.items():
        inside = (F.col("pos") >= edge) & (F.col("pos") < edge + size)
        split = F.when(inside, name) if split is None else split.when(inside, name)
        start = F.when(inside, edge).otherwise(start)
        edge += size
    parts = series.withColumn("split", split).withColumn("edge", start).where("split is not null")
    parts = parts.withColumns({"series_id": F.struct("series_id", "split", "edge"), "pos": F.col("pos") - F.col("edge")})
    w = build_windows_bucketed(parts, history, horizon, bucket)
    return w.select("series_id.series_id", "series_id.split", (F.col("start") + F.col("series_id.edge")).alias("start"), "history", "future")


def at(xs: str, i: Column) -> Column:
    """Element of an array column by a zero-based position."""
    return F.element_at(xs, (i + 1).cast("int"))


def pattern(a: Column, b: Column, c: Column) -> Column:
    """Number of the order (by stable sort) of three values."""
    return (
        F.when((a <= b) & (b <= c), 0).when((a <= c) & (c < b), 1).when((b < a) & (a <= c), 2)
        .when((b <= c) & (c < a), 3).when((c < a) & (a <= b), 4).otherwise(5)
    )


def entropy_of(counts: list[Column]) -> Column:
    """Order-3 permutation entropy from the counts of the six orders, over ln 6, clipped to [0, 1]; 0 without any."""
    n = sum(counts[1:], counts[0]).cast("double")
    terms = [c / n * F.log(c / n + 1e-12) for c in counts]
    share = -sum(terms[1:], terms[0]) / F.log(F.lit(6.0))
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def with_quality_measures(rows: DataFrame, xs: str) -> DataFrame:
    """Adds the largest share of 25 equal bins, the share near the extremes, a constant flag and the share of missing or infinite values.

    What every element is compared with (extremes, margin) is a column of the stage before,
    so no lambda computes it again for each element.
    """
    finite = F.filter(F.col(xs), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.withColumn("_ok", finite)
    rows = rows.withColumns({"_low": F.array_min("_ok"), "_high": F.array_max("_ok"), "_n": F.size("_ok").cast("double")})
    low, high, n = F.col("_low"), F.col("_high"), F.col("_n")
    rows = rows.withColumns({"_margin": F.greatest((high - low) * 0.01, F.lit(1e-3)), "_width": high - low, "_lost": F.size(xs) - F.size("_ok")})
    bins = F.array_sort(F.transform("_ok", lambda x: F.least(F.floor((x - low) / F.col("_width") * 25), F.lit(24)).cast("int")))
    start = F.struct(F.lit(-1).alias("bin"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def longest(s: Column, b: Column) -> Column:
        run = F.when(s["bin"] == b, s["run"] + 1).otherwise(1)
        return F.struct(b.alias("bin"), run.alias("run"), F.greatest(s["most"], run).alias("most"))

    near = F.size(F.filter("_ok", lambda x: (x <= F.col("_floor")) | (x >= F.col("_ceiling"))))
    rows = rows.withColumns({"_floor": low + F.col("_margin"), "_ceiling": high - F.col("_margin"), "_deviation": arrays.deviation(F.col("_ok"))})
    return rows.withColumns({
        "bin_share": F.when(F.col("_lost") > 0, 0.0).when(high == low, 1.0).otherwise(F.aggregate(bins, start, longest)["most"] / n),
        "saturation": F.when(n == 0, 0.0).otherwise(near / n),
        "constant": F.coalesce(F.col("_deviation") < 1e-3, F.lit(True)),
        "dropout": F.col("_lost") / F.size(xs),
    }).drop("_ok", "_low", "_high", "_n", "_margin", "_width", "_lost", "_floor", "_ceiling", "_deviation")


def quality_issue(bin_share: Column, saturation: Column, constant: Column, dropout: Column) -> Column:
    return (bin_share >= 0.25) | (saturation >= 0.08) | constant | (dropout > 0)


def banded(value: Column, low: Column, high: Column) -> Column:
    """low, medium or high by two cuts; unknown without a finite value, medium without cuts."""
    unknown = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return (
        F.when(unknown, "unknown").when(low.isNull() | high.isNull(), "medium")
        .when(value <= low, "low").when(value <= high, "medium").otherwise("high")
    )


def stage(error_band: Column, entropy_band: Column) -> Column:
    return (
        F.when((error_band == "unknown") & (entropy_band == "unknown"), "unknown")
        .when(entropy_band == "high", "hard")
        .when((error_band == "low") & (entropy_band == "low"), "easy")
        .when((error_band != "unknown") & (entropy_band != "unknown"), "medium").otherwise("unknown")
    )


def measured_windows(series: DataFrame, history: int, horizon: int, bucket: int = 512) -> DataFrame:
    """``series_id, start``, entropy, naive error and quality measures of every full window, in buckets.

    The order of each three neighbours is found once a row; a window only counts them.
    """
    w = along("bucket")
    rows = spread(series, history + horizon - 1, bucket)
    x = F.col("value")
    rows = rows.withColumn("kind", pattern(x, F.lead("value", 1).over(w), F.lead("value", 2).over(w)))
    past, ahead, triples = (w.rowsBetween(a, b) for a, b in ((-(history - 1), 0), (1, horizon), (-(history - 1), -2)))
    rows = rows.select(
        "series_id", "bucket", (F.col("pos") - history + 1).alias("start"), x.alias("last"),
        F.collect_list("value").over(past).alias("history"), F.collect_list("value").over(ahead).alias("future"),
        *(F.sum((F.col("kind") == k).cast("int")).over(triples).alias(f"kind{k}") for k in range(6)),
    )
    full = (F.size("history") == history) & (F.size("future") == horizon)
    rows = rows.where(full & (F.floor(F.col("start") / bucket) == F.col("bucket")))
    last = F.col("last")
    rows = rows.select(
        "series_id", "start", F.round(entropy_of([F.col(f"kind{k}") for k in range(6)]), 6).alias("entropy"),
        F.round(F.aggregate("future", F.lit(0.0), lambda acc, y: acc + (y - last) * (y - last)) / horizon, 8).alias("error"), "history",
    )
    return with_quality_measures(rows, "history").drop("history")


def tertiles(rows: DataFrame, by: str, *columns: str) -> DataFrame:
    """Cuts at a third and two thirds of each column's finite values, as ``c_1`` and ``c_2``."""
    cuts = rows.select(by).distinct()
    for c in columns:
        q = quantiles(rows, c, (1 / 3, 2 / 3), (by,)).select(by, F.col("q0").alias(f"{c}_1"), F.col("q1").alias(f"{c}_2"))
        cuts = cuts.join(q, by, "left")
    return cuts


def curriculum(series: DataFrame, history: int = 24, horizon: int = 8) -> DataFrame:
    """Windows with entropy, naive error, their tertile bands and the difficulty stage."""
    w = kept(measured_windows(series, history, horizon))
    w = w.join(tertiles(w, "series_id", "error", "entropy"), "series_id")
    bands = {c: banded(F.col(c), F.col(f"{c}_1"), F.col(f"{c}_2")) for c in ("error", "entropy")}
    w = w.withColumns({f"{c}_band": b for c, b in bands.items()})
    flag = quality_issue(F.col("bin_share"), F.col("saturation"), F.col("constant"), F.col("dropout"))
    return w.withColumn("stage", stage(F.col("error_band"), F.col("entropy_band"))).withColumn("quality_issue", flag)


def features(series: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row of features for each series; a series of any length is many tasks.

    Medians and quantiles come from ranges of values, neighbours from buckets of positions
    with a halo of 24 places, the running sum from state carried between buckets.
    """
    s = kept(series.select("series_id", F.col("pos").cast("long").alias("pos"), "value"))
    q = quantiles(s, "value", (0.025, 0.25, 0.5, 0.75, 0.975), ("series_id",))
    base = s.groupBy("series_id").agg(
        F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n_points"),
        F.stddev_pop("value").alias("sd"), F.min_by("value", "pos").alias("start"), F.max_by("value", "pos").alias("end"),
    )
    base = kept(base.join(q.withColumnRenamed("q2", "median"), "series_id"))
    away = s.join(base.select("series_id", "median"), "series_id").select("series_id", "pos", F.abs(F.col("value") - F.col("median")).alias("away"), (F.col("value") - F.col("median")).alias("value"))
    mad = quantiles(away, "away", (0.5,), ("series_id",)).select("series_id", F.col("q0").alias("mad"))
    sums = running_total(bucketed(away, bucket=bucket), "value", "cusum").groupBy("series_id").agg(F.max(F.abs("cusum")).alias("cusum_max"))

    w = inside()
    steps = bucketed(s, back=24, bucket=bucket).select(
        "series_id", "value", "own", (F.col("value") - F.lag("value").over(w)).alias("d1"),
        (F.col("value") - 2 * F.lag("value", 1).over(w) + F.lag("value", 2).over(w)).alias("d2"),
        F.lag("value", 1).over(w).alias("back1"), F.lag("value", 24).over(w).alias("back24"),
    ).where("own")
    steps = steps.join(base.select("series_id", "mean", "low", "high"), "series_id")
    dev = F.col("value") - F.col("mean")
    margin = F.greatest((F.col("high") - F.col("low")) * 0.01, F.lit(1e-3))
    near = (F.col("value") <= F.col("low") + margin) | (F.col("value") >= F.col("high") - margin)
    found = steps.groupBy("series_id").agg(
        ratio(F.sum(dev * (F.col("back1") - F.col("mean"))), F.sum(dev * dev)).alias("acf1"),
        F.coalesce(ratio(F.sum(dev * (F.col("back24") - F.col("mean"))), F.sum(dev * dev)), F.lit(0.0)).alias("acf24"),
        F.max(F.abs("d1")).alias("max_slope"), F.max(F.abs("d2")).alias("max_second_diff"),
        F.avg(near.cast("double")).alias("saturation"), F.avg(F.abs("d1")).alias("mean_abs_step"),
        F.regr_slope("value", "back1").alias("ar1_slope"), F.regr_intercept("value", "back1").alias("ar1_intercept"),
    )
    r = lambda c, name: F.round(c, 5).alias(name)
    plain = ("median", "mad", "acf1", "acf24", "cusum_max", "max_slope", "max_second_diff", "saturation", "sd", "start", "end", "mean_abs_step", "ar1_slope", "ar1_intercept")
    return base.join(found, "series_id").join(mad, "series_id").join(sums, "series_id").select(
        "series_id", "n_points", *(r(c, c) for c in plain),
        r(ratio(F.col("q4") - F.col("q0"), F.col("q3") - F.col("q1")), "quantile_kurtosis"), r(F.col("end") - F.col("start"), "net_change"),
    )


def turning_points(series: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Points not below, or not above, two neighbours on either side.

    Before the first point stand the third and the second, after the last one the last
    but one and the last itself; series of fewer than five points have none.
    """
    w = inside()
    back = lambda k: F.lag("value", k).over(w)
    ahead = lambda k: F.lead("value", k).over(w)
    s = bucketed(series, 2, 2, bucket).withColumns({
        # left of place 0: places 2 and 1; of place 1: places 1 and 0
        "l2": F.when(F.col("pos") == 0, ahead(2)).when(F.col("pos") == 1, F.col("value")).otherwise(back(2)),
        "l1": F.when(F.col("pos") == 0, ahead(1)).otherwise(back(1)),
        # right of the last place: the one before and itself; of the last but one: the last and itself
        "r1": F.coalesce(ahead(1), back(1)),
        "r2": F.when(ahead(2).isNotNull(), ahead(2)).otherwise(F.col("value")),
    }).where("own").drop("own", "bucket")
    x, others = F.col("value"), [F.col(c) for c in ("l2", "l1", "r1", "r2")]
    every = lambda test: test(others[0]) & test(others[1]) & test(others[2]) & test(others[3])
    s = s.withColumn("peak", every(lambda o: x >= o)).withColumn("valley", every(lambda o: x <= o))
    long_enough = series.groupBy("series_id").agg(F.count("*").alias("n")).where("n >= 5").select("series_id")
    return s.join(long_enough, "series_id", "left_semi").drop("l2", "l1", "r1", "r2")


def longest_monotone_run(series: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Longest run of steps in one direction over the points; a still step extends a run.

    The last direction and the number of runs before are carried from bucket to bucket.
    """
    steps = bucketed(series, back=1, bucket=bucket).withColumn("s", F.signum(F.col("value") - F.lag("value").over(inside())))
    steps = steps.where("own and s is not null").drop("own")
    steps = last_known(steps, F.when(F.col("s") != 0, F.col("s")), "prev")
    breaks = F.when((F.col("s") == 0) | (F.col("s") == F.coalesce("prev", F.lit(0.0))), 0).otherwise(1)
    runs = running_total(steps.withColumn("break", breaks), "break", "run")
    sizes = runs.groupBy("series_id", "run").agg(F.count("*").alias("steps"))
    longest = sizes.groupBy("series_id").agg(F.max("steps").alias("longest"))
    return longest.join(series.groupBy("series_id").agg(F.count("*").alias("n")), "series_id").select(
        "series_id", "longest", F.round(F.col("longest") / F.col("n"), 6).alias("monotone_share")
    )


def moving_average(series: DataFrame, kernel: int, bucket: int = BUCKET) -> DataFrame:
    """Trend by a centred mean with replicated ends, and what is left (season)."""
    half = kernel // 2
    ends = series.groupBy("series_id").agg(F.min_by("value", "pos").alias("_first"), F.max_by("value", "pos").alias("_last"), F.count("*").alias("_n"))
    near = bucketed(series, half, half, bucket).withColumn("_sum", F.sum("value").over(inside().rowsBetween(-half, half))).where("own")
    before = F.greatest(F.lit(half) - F.col("pos"), F.lit(0))
    after = F.greatest(F.col("pos") + half - (F.col("_n") - 1), F.lit(0))
    trend = (F.col("_sum") + before * F.col("_first") + after * F.col("_last")) / kernel
    out = near.join(ends, "series_id").withColumn("trend", trend).withColumn("season", F.col("value") - F.col("trend"))
    return out.select(*series.columns, "trend", "season")


def residual_features(series: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Residuals of a first-order autoregression of each series: mean, largest, share beyond two deviations, lag-1
    correlation, and the share of the largest tenth (all 0 for up to three points).

    Fits are aggregates, neighbours come from buckets, and the largest tenth from places by range.
    """
    w = inside()
    r = bucketed(series.select("series_id", F.col("pos").cast("long").alias("pos"), "value"), back=1, bucket=bucket)
    r = r.withColumn("back", F.lag("value").over(w)).where("own and back is not null").drop("own", "bucket")
    fit = r.groupBy("series_id").agg(
        F.coalesce(F.regr_slope("value", "back"), F.lit(0.0)).alias("slope"), F.avg("value").alias("my"), F.avg("back").alias("mx"), F.count("*").alias("n")
    )
    e = r.join(fit, "series_id").select("series_id", "pos", "n", (F.col("value") - F.col("my") - F.col("slope") * (F.col("back") - F.col("mx"))).alias("e"))
    e = kept(e)
    base = e.groupBy("series_id").agg(F.avg("e").alias("mean"), F.stddev_pop("e").alias("sd"))
    near = bucketed(e, back=1, bucket=bucket).withColumn("before", F.lag("e").over(w)).where("own").drop("own", "bucket")
    j = near.join(base, "series_id")
    at = numbered(e.withColumn("size", F.abs("e")).select("series_id", "pos", "size", "n"), "size", "pos", by=("series_id",))
    top = at.groupBy("series_id").agg(F.sum(F.when(F.col("place") >= F.floor(0.9 * F.col("n")), F.col("size"))).alias("top"), F.sum("size").alias("all"))
    dev = F.col("e") - F.col("mean")
    found = j.groupBy("series_id").agg(
        F.first("mean").alias("residual_mean"), F.max(F.abs("e")).alias("residual_max"), F.avg((F.abs("e") > 2 * (F.col("sd") + 1e-8)).cast("double")).alias("residual_exceed"),
        ratio(F.sum(dev * (F.col("before") - F.col("mean"))), F.sum(dev * dev)).alias("residual_acf1"), F.first("n").alias("n"),
    )
    out = found.join(top, "series_id").withColumn("residual_concentration", F.col("top") / (F.col("all") + 1e-8))
    names = ("residual_mean", "residual_max", "residual_exceed", "residual_acf1", "residual_concentration")
    return out.select("series_id", *(F.when(F.col("n") > 2, F.coalesce(c, F.lit(0.0))).otherwise(0.0).alias(c) for c in names))


#: Points of one search for change points (made a multiple of ten, so that windows search one grid of places).
SEARCHED = 520


def change_points(series: DataFrame, width: int = SEARCHED) -> DataFrame:
    """``series_id, pos``: where a new segment starts, found in windows of ``width`` points.

    Windows start every half width; each is searched alone (its kernel is ``width`` squared and
    no more) and owns the breaks of its middle half, the first one those before, the last one those
    after.  So at a seam the window decides in which a break has a quarter width on both sides.  A
    series of up to ``width`` points is one window, searched whole.
    """
    half = max(width // 10, 1) * kernels.JUMP
    width = 2 * half
    n = series.groupBy("series_id").agg(F.count("*").alias("n"))
    r = series.select("series_id", F.col("pos").cast("long").alias("pos"), "value").join(n, "series_id")
    last = F.greatest(F.ceil((F.col("n") - width) / F.lit(half)), F.lit(0)).cast("long")  # windows from 0 to this one
    own = F.floor(F.col("pos") / half).cast("long")
    r = r.withColumn("last", last).withColumn("w", F.explode(F.sequence(F.greatest(own - 1, F.lit(0).cast("long")), F.least(own, "last"))))
    cells = F.array_sort(F.collect_list(F.struct("pos", "value")))  # width points at most
    w = r.groupBy("series_id", "w", "last").agg(cells.alias("cells"))
    found = w.select("series_id", "w", "last", F.explode(kernels.break_places(F.transform("cells", lambda c: c["value"]))).alias("at"))
    quarter = width // 4
    mine = ((F.col("at") >= quarter) | (F.col("w") == 0)) & ((F.col("at") < half + quarter) | (F.col("w") == F.col("last")))
    return found.where(mine).select("series_id", (F.col("w") * half + F.col("at")).alias("pos"))


def change_summary(series: DataFrame, width: int = SEARCHED, most: int = 5, bucket: int = BUCKET) -> DataFrame:
    """``series_id, changepoint_count`` (``most`` at most) and ``changepoint_score``: the largest step between means of neighbouring segments."""
    cuts = kept(change_points(series, width))
    marked = series.select("series_id", F.col("pos").cast("long").alias("pos"), "value").join(cuts.withColumn("cut", F.lit(1)), ["series_id", "pos"], "left")
    rows = running_total(bucketed(marked.withColumn("cut", F.coalesce("cut", F.lit(0))), bucket=bucket).drop("own"), "cut", "segment")
    means = rows.groupBy("series_id", "segment").agg(F.avg("value").alias("mean"))  # a row a segment
    jump = F.abs(F.col("mean") - F.lag("mean").over(Window.partitionBy("series_id").orderBy("segment")))
    return means.withColumn("jump", jump).groupBy("series_id").agg(
        F.least(F.count("*") - 1, F.lit(most)).cast("double").alias("changepoint_count"), F.coalesce(F.max("jump"), F.lit(0.0)).alias("changepoint_score")
    )


#: Where stamps are made from nothing: 2000-01-01, in microseconds.
ANCHOR = 946684800000000


def repaired_stamps(rows: DataFrame, stamp: str, step: int) -> DataFrame:
    """Adds ``at_us``, a full set of stamps (microseconds) for ``series_id, pos``.

    All stamps valid: as they are.  None: from the anchor by ``step``.  Several: from the
    first valid one by the most frequent positive gap of valid neighbours (the first seen of
    equals).  One: from it by ``step``.
    """
    valid = rows.where(F.col(stamp).isNotNull()).select("series_id", "pos", F.col(stamp).alias("_t"))
    gaps = valid.select("series_id", "pos", (F.lead("_t").over(along()) - F.col("_t")).alias("_gap")).where("_gap > 0")
    counted = gaps.groupBy("series_id", "_gap").agg(F.count("*").alias("_c"), F.min("pos").alias("_p"))
    gap = counted.groupBy("series_id").agg(F.min(F.struct((-F.col("_c")).alias("c"), "_p", "_gap"))["_gap"].alias("_gap"))
    known = rows.groupBy("series_id").agg(
        F.count(stamp).alias("_c"), F.count("*").alias("_n"), F.min(F.when(F.col(stamp).isNotNull(), F.struct("pos", F.col(stamp).alias("t")))).alias("_f")
    )
    j = rows.join(known, "series_id").join(gap, "series_id", "left")
    from_first = F.col("_f.t") + (F.col("pos") - F.col("_f.pos")) * F.when(F.col("_c") > 1, F.coalesce("_gap", F.lit(step))).otherwise(F.lit(step))
    at_us = F.when(F.col("_c") == F.col("_n"), F.col(stamp)).when(F.col("_c") == 0, F.lit(ANCHOR) + F.col("pos") * step).otherwise(from_first)
    return j.select(*rows.columns, at_us.alias("at_us"))
