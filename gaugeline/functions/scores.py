"""Score algebra: forecast rewards, penalties, confusion metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays, text

# Weights of the reward's components.
ERROR_WEIGHT, SEASON_WEIGHT, TREND_WEIGHT, TURN_WEIGHT, LENGTH_WEIGHT = 0.6, 0.0125, 0.0375, 0.025, 0.1


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """``a / b``, and ``otherwise`` where b is zero."""
    return F.when(b == 0, otherwise).otherwise(a / F.nullif(b, F.lit(0).cast("double")))


def norm_mse_score(mse: Column) -> Column:
    """0.6 at no error, falling with the root of the normalised error."""
    return ERROR_WEIGHT / (1 + F.sqrt(mse))


def length_score(predicted: Column, expected: Column) -> Column:
    return F.when((expected > 0) & (predicted == expected), LENGTH_WEIGHT).otherwise(0.0)


def length_penalty(predicted: Column, expected: Column) -> Column:
    """Tiers by the gap in points, and up to 0.05 for running over; 0 where nothing is expected."""
    gap = F.abs(predicted - expected)
    tier = (
        F.when(gap == 0, 0.0).when(gap == 1, 0.03).when(gap == 2, 0.05).when(gap <= 5, 0.08)
        .when(gap <= 20, 0.12).when(gap <= 100, 0.18).otherwise(0.24)
    )
    over = F.when(predicted > expected, F.least(ratio(predicted - expected, expected.cast("double")), F.lit(1.0)) * 0.05)
    return F.when(expected <= 0, 0.0).otherwise(tier + F.coalesce(over, F.lit(0.0)))


def recovery_penalty(reason: Column, predicted: Column, expected: Column) -> Column:
    """What a recovered answer loses, by why the strict protocol refused it."""
    r = F.trim(F.coalesce(reason, F.lit("")))
    shape = F.when((expected > 0) & (predicted > 0), F.greatest(F.lit(0.06), length_penalty(predicted, expected))).otherwise(0.06)
    return (
        F.when(r == "", 0.0).when(r == "missing_answer_close_tag", 0.03)
        .when(r.isin("missing_think_block", "missing_think_open_tag", "missing_think_close_tag"), 0.05)
        .when(r.isin("missing_answer_block", "missing_answer_open_tag", "extra_text_outside_tags"), 0.06)
        .when(r.startswith("invalid_answer_shape"), shape).otherwise(0.05)
    )


def season_trend_score(p: Column, t: Column) -> Column:
    """Closeness of season and trend of the normalised values; 0 below five common points."""
    part = lambda f, a, b, weight: weight / (1 + F.log1p(arrays.mse(f(a), f(b))))

    def score(v: Column) -> Column:
        a, b = v["a"], v["b"]
        return part(arrays.season, a, b, SEASON_WEIGHT) + part(arrays.trend, a, b, TREND_WEIGHT)

    scaled = lambda a, b: F.struct(arrays.scaled_by(a, b).alias("a"), arrays.scaled_by(b, b).alias("b"))
    both = arrays.with_both(p, t, lambda a, b: arrays.let(scaled(a, b), score))
    return F.when(F.least(F.size(p), F.size(t)) >= 5, both * F.least(F.size(p) / F.size(t), F.lit(1.0))).otherwise(0.0)


def turning_point_score(p: Column, t: Column, tolerance: int = 2) -> Column:
    """Share of the truth's peaks and valleys that the forecast's come near to."""

    def side(a: Column, b: Column, low: bool) -> Column:
        hits = lambda truth: arrays.greedy_hits(arrays.turning_points(a, low), truth, tolerance)
        share = lambda truth: F.when(F.size(truth) > 0, hits(truth) / F.size(truth) * TURN_WEIGHT).otherwise(0.0)
        return arrays.let(arrays.turning_points(b, low), share)

    both = arrays.with_both(p, t, lambda a, b: side(a, b, False) + side(a, b, True))
    return F.when(F.least(F.size(p), F.size(t)) >= 5, both * F.least(F.size(p) / F.size(t), F.lit(1.0))).otherwise(0.0)


def with_reward(df: DataFrame, solution: str, truth: str, allow_recovery: bool) -> DataFrame:
    """Adds the composite reward of a solution text against an array of true values, and its components.

    The answer is first clamped to the expected number of stamped lines; an answer that
    neither protocol accepts scores -1.
    """
    return _rewarded(_clamped(df, solution, truth), truth, allow_recovery)


def _clamped(df: DataFrame, solution: str, truth: str) -> DataFrame:
    """What both protocols score alike: the number of values expected, the clamped text and its number of values."""
    size = F.size(truth)
    df = df.withColumn("expected", size).withColumn("clamp", text.clamp(solution, F.col("expected")))
    df = df.withColumn("scored", F.when(size > 0, F.col("clamp.text")).otherwise(F.col(solution)))
    return df.withColumn("raw_len", F.size(text.forecast_values("scored")))


def _rewarded(df: DataFrame, truth: str, allow_recovery: bool) -> DataFrame:
    """``with_reward`` of a clamped text."""
    df = text.protocol(df, "scored", "expected", allow_recovery)
    df = df.withColumn("pred", F.coalesce(text.forecast_values("answer"), F.array().cast("array<double>")))
    df = df.withColumn("pred_len", F.size("pred"))
    p, t, n, e = F.col("pred"), F.col(truth), F.col("pred_len"), F.col("expected")
    recovered = F.col("mode").startswith("recovered_")
    over = F.col("clamp.applied") & (e > 0) & (F.col("clamp.raw_lines") > e)
    df = df.withColumns({
        "orig_mse": arrays.mse(p, t), "norm_mse": arrays.norm_mse(p, t), "length": length_score(n, e),
        "season_trend": season_trend_score(p, t), "turns": turning_point_score(p, t),
        "length_loss": F.when((e > 0) & (n != e), length_penalty(n, e)).otherwise(0.0),
        "overrun_loss": F.when(over, length_penalty(F.col("clamp.raw_lines"), e)).otherwise(0.0),
        "recovery_loss": F.when(recovered, recovery_penalty(F.col("reason"), F.col("raw_len"), e)).otherwise(0.0),
    })
    error = F.coalesce(norm_mse_score(F.col("norm_mse")), F.lit(0.0))
    gains = F.col("length") + error + F.col("turns") + F.col("season_trend")
    losses = F.col("length_loss") + F.col("overrun_loss") + F.col("recovery_loss")
    return df.withColumn("score", F.when(F.col("answer").isNull(), -1.0).otherwise(gains - losses))


def with_compared_rewards(df: DataFrame, solution: str, truth: str) -> DataFrame:
    """Adds the rewards of both protocols side by side: strict and recovered score, gap, modes and reasons, and line counts."""
    names = {"score": "score", "mode": "parse_mode"}
    clamped = _clamped(df, solution, truth)
    told = ("strict_score", "strict_parse_mode", "reject_reason")
    strict = _rewarded(clamped, truth, False)
    strict = strict.select(*clamped.columns, *(F.col(c).alias(n) for c, n in zip(("score", "mode", "reason"), told)))
    both = _rewarded(strict, truth, True)
    lines = text.line_counts(F.col("scored"))[0]
    return both.select(
        *df.columns, *told, *(F.col(c).alias(f"recovered_{n}") for c, n in names.items()), (F.col("score") - F.col("strict_score")).alias("recovery_gap"),
        F.col("clamp.applied").alias("clamped"), F.col("overrun_loss").alias("raw_overrun_penalty"), lines.alias("answer_line_count"),
        F.col("expected").alias("expected_answer_line_count"), ((F.col("expected") > 0) & (lines >= F.col("expected"))).alias("wrote_expected_rows_before_stop"),
    )


def confusion(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """Counts, precision, recall and F1; null where a denominator is zero."""
    n = lambda c: F.count(F.when(c, 1))
    c = rows.agg(
        n(predicted & actual).alias("tp"), n(predicted & ~actual).alias("fp"),
        n(~predicted & actual).alias("fn"), n(~predicted & ~actual).alias("tn"),
    )
    share = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.withColumns({
        "precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn),
    })
