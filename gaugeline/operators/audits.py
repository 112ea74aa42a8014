"""Summaries of evaluated rows: protocol, probes, gates, validation, timing, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import ratio


def count_if(c: Column) -> Column:
    return F.count(F.when(c, 1))


def rate(c: Column, among: Column | None = None) -> Column:
    """Share of rows with ``c``, null where there are none; ``among`` restricts them."""
    value = F.coalesce(c, F.lit(False)).cast("double")
    return F.avg(value if among is None else F.when(among, value))


def finite(c: Column) -> Column:
    """The value where it is a finite number, null elsewhere."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def nan_max(c: Column) -> Column:
    return F.max(F.when(~F.isnan(c), c))


def nan_min(c: Column) -> Column:
    return F.min(F.when(~F.isnan(c), c))


def protocol_summary(rows: DataFrame, required: Column, reason: Column) -> DataFrame:
    """Checked, skipped, valid and invalid rows, and the share of valid ones (0 of none)."""
    ok = required & (reason == "ok")
    s = rows.agg(
        count_if(required).alias("checked"), count_if(~required).alias("skipped"), count_if(ok).alias("valid"), count_if(required & ~ok).alias("invalid")
    )
    return s.withColumn("valid_ratio", F.round(ratio(F.col("valid").cast("double"), F.col("checked").cast("double")), 6))


def first_invalid(rows: DataFrame, required: Column, reason: Column, order: str, n: int = 5) -> DataFrame:
    """The first ``n`` checked rows with another reason than ok."""
    return rows.where(required & (reason != "ok")).orderBy(order).limit(n)


def gate(rows: DataFrame, tests: dict[str, Column], threshold: float) -> DataFrame:
    """Count, rate of each test, and whether all reach the threshold (never without rows)."""
    s = rows.agg(F.count("*").alias("n"), *(F.round(rate(c), 6).alias(k) for k, c in tests.items()))
    return s.withColumn("passed", (F.col("n") > 0) & F.coalesce(F.least(*tests) >= threshold, F.lit(False)))


def validation_row(rows: DataFrame, by: str) -> DataFrame:
    """One wide row a group: masked means, rates and percentiles of a validation run.

    ``rows``: score, has_answer, has_close, pred_len, expected_len, reject_reason,
    workflow, orig_mse, orig_mae, norm_mse, calls, default_model, model, best_model.
    """
    accepted = F.col("has_answer") & F.col("has_close") & (F.col("pred_len") == F.col("expected_len")) & (F.coalesce("reject_reason", F.lit("")) == "")
    errors = finite(F.col("orig_mse")).isNotNull() & finite(F.col("orig_mae")).isNotNull()
    r = rows.withColumn("_acc", accepted).withColumn("_ok", accepted & (F.lower(F.coalesce("workflow", F.lit(""))) != "rejected") & errors)
    score, ok = finite(F.col("score")), F.col("_ok")
    lens = F.col("pred_len") - F.col("expected_len")
    out = {
        "n": F.count("*"), "score_mean": F.avg(score), "score_max": F.max(score), "score_min": F.min(score), "score_sd": F.stddev_pop(score),
        "accept_ratio": rate(F.col("_acc")), "success_ratio": rate(ok), "success_count": count_if(ok),
        "answer_tag_ratio": rate(F.col("has_answer")), "answer_close_ratio": rate(F.col("has_close")),
        "exact_length_ratio": rate(lens == 0), "under_length_ratio": rate(lens < 0), "over_length_ratio": rate(lens > 0), "length_gap_mean": F.avg(F.abs(lens).cast("double")),
        "rejected_ratio": rate(F.lower(F.coalesce("workflow", F.lit(""))) == "rejected"), "hard_failure_ratio": rate(score <= -0.99),
        "orig_mse_mean": F.avg(F.when(ok, F.col("orig_mse"))), "orig_mse_max": F.max(F.when(ok, F.col("orig_mse"))), "orig_mae_mean": F.avg(F.when(ok, F.col("orig_mae"))),
        "norm_mse_mean": F.avg(F.when(ok, F.col("norm_mse"))), "calls_mean": F.avg("calls"), "one_call_ratio": rate(F.col("calls") == 1),
        "default_ratio": rate(F.col("model") == F.col("default_model")), "best_ratio": rate(F.col("model") == F.col("best_model")),
        "models": F.count_distinct("model"), "reject_reasons": F.count_distinct(F.when(F.coalesce("reject_reason", F.lit("")) != "", F.col("reject_reason"))),
    }
    whole = {"n", "success_count", "models", "reject_reasons"}
    return r.groupBy(by).agg(*((c if k in whole else F.round(c, 6)).alias(k) for k, c in out.items()))


def per_token(times: DataFrame, prompt: str, response: str) -> DataFrame:
    """``section, seconds`` with milliseconds a token: responses alone for gen, all tokens for the others."""
    tokens = F.when(F.col("section") == "gen", F.col(response)).otherwise(F.col(prompt) + F.col(response))
    return times.withColumn("ms_per_token", F.round(ratio(F.col("seconds") * 1000, tokens.cast("double")), 6))


def expected_extremes(rows: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """Expected best and worst of ``n`` draws with replacement of each group's values.

    What resampling estimates, computed exactly: the k-th of m values is the largest of n
    draws with probability (k / m)^n - ((k - 1) / m)^n.
    """
    w = Window.partitionBy(group)
    r = rows.select(group, value).withColumns({"_m": F.count("*").over(w), "_k": F.row_number().over(w.orderBy(value))})
    k, m = F.col("_k").cast("double"), F.col("_m")
    power = lambda x: F.pow(x, F.lit(float(n)))
    best = power(k / m) - power((k - 1) / m)
    worst = power((m - k + 1) / m) - power((m - k) / m)
    return r.groupBy(group).agg(F.round(F.sum(best * F.col(value)), 5).alias("best"), F.round(F.sum(worst * F.col(value)), 5).alias("worst"))


def binary_audit(rows: DataFrame, score: Column, actual: Column, threshold: float = 0.5) -> DataFrame:
    """AUC by ranks (ties count half), F1 and balanced accuracy at a threshold."""
    r = rows.select(score.alias("s"), actual.alias("y"))
    by_score = r.groupBy("s").agg(count_if(F.col("y")).alias("p"), count_if(~F.col("y")).alias("q"))
    below = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)  # one row a distinct score
    w = by_score.withColumn("_q", F.coalesce(F.sum("q").over(below), F.lit(0)))
    auc = w.agg(F.sum(F.col("p") * (F.col("_q") + F.col("q") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    said = F.col("s") >= threshold
    c = r.agg(count_if(said & F.col("y")).alias("tp"), count_if(said & ~F.col("y")).alias("fp"), count_if(~said & F.col("y")).alias("fn"), count_if(~said & ~F.col("y")).alias("tn"))
    share = lambda a, b: ratio(a.cast("double"), b.cast("double"))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    return auc.crossJoin(c).select(  # one row each
        F.round(share(F.col("u"), F.col("p") * F.col("q")), 6).alias("auc"), F.round(share(2 * tp, 2 * tp + fp + fn), 6).alias("f1"),
        F.round((share(tp, tp + fn) + share(tn, tn + fp)) / 2, 6).alias("balanced_accuracy"),
    )


def metric_names(rows: DataFrame) -> DataFrame:
    """Adds the full name of each (source, var, metric): val-core for mean, maj and best of the core variable at its largest N."""
    n = F.regexp_extract("metric", r"@(\d+)", 1).try_cast("int")
    by = Window.partitionBy("source")
    r = rows.withColumn("_n", n).withColumn("_most", F.max("_n").over(Window.partitionBy("source", "var")))
    r = r.withColumn("_core", F.when(F.max((F.col("var") == "acc").cast("int")).over(by) == 1, "acc").otherwise("reward"))
    core = (F.col("var") == F.col("_core")) & F.col("metric").rlike("^(mean|maj|best)") & (F.col("_n") == F.col("_most"))
    name = F.concat_ws("/", F.when(core, "val-core").otherwise("val-aux"), "source", "var", "metric")
    return r.withColumn("name", name).drop("_n", "_most", "_core")


def max_share(rows: DataFrame, column: str) -> DataFrame:
    """Largest share of one value among all rows."""
    n = rows.groupBy(column).agg(F.count("*").alias("n"))
    return n.agg(F.round(F.max("n") / F.sum("n"), 6).alias("max_share"))


def routing_summary(rows: DataFrame) -> DataFrame:
    """One row over routing results: requested, teacher, heuristic, best, second, tier, regret, gold and predicted overrides.

    ``rows``: requested, teacher, heuristic, best, second, tier, regret, delta, gold_override, predicted_override.
    """
    exact, top2 = F.col("requested") == F.col("best"), F.col("requested").isin(F.col("best"), F.col("second"))
    sure, gold, said = F.col("tier").isin("mid", "high"), F.col("gold_override"), F.col("predicted_override")
    share = lambda c, among=None: F.coalesce(rate(c, among), F.lit(0.0))
    s = rows.agg(
        F.count("*").alias("n"), share(F.col("requested") == F.col("teacher")).alias("teacher_rate"), share(F.col("requested") == F.col("heuristic")).alias("heuristic_rate"),
        share(exact).alias("exact_rate"), share(top2).alias("top2_rate"), count_if(sure).alias("sure"), share(exact, sure).alias("sure_exact_rate"),
        F.avg("regret").alias("mean_regret"), F.avg(F.when(sure, F.col("regret"))).alias("sure_mean_regret"), F.avg("delta").alias("mean_delta"),
        F.count_distinct("requested").alias("coverage"), count_if(gold & said).alias("tp"), count_if(~gold & said).alias("fp"), count_if(gold & ~said).alias("fn"),
        count_if(~gold & ~said).alias("tn"), share(exact, gold).alias("override_exact_rate"), share(said).alias("override_share"),
    )
    tp, fp, fn, tn = (F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn"))
    f1 = lambda hit, a, b: ratio(2 * hit, 2 * hit + a + b)
    s = s.withColumns({
        "override_precision": ratio(tp, tp + fp), "override_recall": ratio(tp, tp + fn), "override_f1": f1(tp, fp, fn),
        "macro_f1": (f1(tp, fp, fn) + f1(tn, fn, fp)) / 2,
    })
    whole = {"n", "sure", "coverage", "tp", "fp", "fn", "tn"}
    rounded = s.select(*(F.col(c) if c in whole else F.round(c, 6).alias(c) for c in s.columns))
    return rounded.crossJoin(max_share(rows, "requested"))  # one row each


def two_level_timing(steps: DataFrame, trajectory: str, step: str, seconds: str) -> DataFrame:
    """Least, mean and largest time of a step and of a trajectory, and which were the slowest (the first of equals)."""
    first = lambda c, *by: F.min(F.struct((-F.col(c)).alias("t"), *by))
    by_step = steps.agg(
        F.min(seconds).alias("step_min"), F.avg(seconds).alias("step_mean"), F.max(seconds).alias("step_max"), first(seconds, trajectory, step).alias("_s")
    )
    whole = steps.groupBy(trajectory).agg(F.sum(seconds).alias("total"))
    by_whole = whole.agg(F.min("total").alias("whole_min"), F.avg("total").alias("whole_mean"), F.max("total").alias("whole_max"), first("total", trajectory).alias("_w"))
    both = by_step.crossJoin(by_whole)  # one row each
    return both.select(
        "step_min", F.round("step_mean", 6).alias("step_mean"), "step_max", F.col(f"_s.{trajectory}").alias("slowest_step_of"), F.col(f"_s.{step}").alias("slowest_step"),
        "whole_min", F.round("whole_mean", 6).alias("whole_mean"), "whole_max", F.col(f"_w.{trajectory}").alias("slowest"),
    )
