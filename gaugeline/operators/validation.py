"""The wide row of a validation run: masked means, ratios, exact percentiles and distributions, one row a group.

Masks are columns of one stage and every aggregate of them is part of one grouping.  The
percentiles of all (mask, column) pairs are exact and come from ranges of values of one long
table; distributions from one count of (field, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy
from .audits import finite, rate
from .ordering import kept, quantiles

# The columns of the row that are plain means of finite values, by the column they are of.
MEANS = {
    "trainer_seq_score_mean": "trainer_seq_score", "selected_forecast_orig_mse_mean": "selected_forecast_orig_mse",
    "final_vs_selected_mse_mean": "final_vs_selected_mse", "refinement_delta_orig_mse_mean": "refinement_delta_orig_mse",
    "analysis_coverage_ratio_mean": "analysis_coverage_ratio", "strict_score_mean": "strict_score", "recovered_score_mean": "recovered_score",
    "recovery_gap_mean": "recovery_gap", "raw_overrun_penalty_mean": "raw_overrun_penalty", "answer_line_count_mean": "answer_line_count",
    "turn3_horizon_clamp_discarded_lines_mean": "turn3_horizon_clamp_discarded_lines",
    "turn3_horizon_clamp_valid_prefix_lines_mean": "turn3_horizon_clamp_valid_prefix_lines",
    "turn3_horizon_clamp_raw_answer_lines_mean": "turn3_horizon_clamp_raw_answer_lines", "think_token_len_mean": "think_token_len",
    "answer_token_len_mean": "answer_token_len", "feature_tool_count_mean": "feature_tool_count",
    "required_feature_tool_count_mean": "required_feature_tool_count", "missing_required_feature_tool_count_mean": "missing_required_feature_tool_count",
    "prediction_call_count_mean": "prediction_call_count", "raw_tool_call_block_count_mean": "raw_tool_call_block_count",
    "response_token_len_mean": "response_token_len",
}
# Ratios of a flag over all rows.
FLAGS = {
    "prediction_model_defaulted_ratio": "prediction_model_defaulted", "selected_forecast_exact_copy_ratio": "selected_forecast_exact_copy",
    "refinement_improved_ratio": "refinement_improved", "refinement_degraded_ratio": "refinement_degraded",
    "turn3_horizon_clamped_ratio": "turn3_horizon_clamped", "wrote_expected_rows_before_stop_ratio": "wrote_expected_rows_before_stop",
}
# Distributions, the field they count, and how many values they show (None: all, by value).
DISTRIBUTIONS = {
    "debug_bucket_distribution": ("debug_bucket", None), "debug_reason_distribution": ("debug_reason", None),
    "selected_model_distribution": ("selected_model", None), "format_failure_reason_distribution": ("format_failure_reason", 8),
    "final_answer_reject_reason_distribution": ("final_answer_reject_reason", 8), "generation_stop_reason_distribution": ("generation_stop_reason", 6),
    "generation_finish_reason_distribution": ("generation_finish_reason", 6), "turn3_horizon_clamp_reason_distribution": ("turn3_horizon_clamp_reason", 6),
    "workflow_status_distribution": ("workflow_status", None), "turn_stage_distribution": ("turn_stage", None), "run_name_distribution": ("run_name", None),
    "invalid_tool_call_name_distribution": ("invalid_tool_call_name_sequence", 8), "refinement_decision_distribution": ("refinement_decision_name", None),
}
#: Fields that hold several values, joined by arrows.
SEQUENCES = {"invalid_tool_call_name_sequence"}


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def masked(rows: DataFrame) -> DataFrame:
    """``rows`` with the masks and differences of the row, each computed once."""
    number = lambda c: finite(F.col(c).cast("double"))
    either = lambda prefix: _text("format_failure_reason").startswith(prefix) | _text("final_answer_reject_reason").startswith(prefix)
    pred, expected = number("pred_len"), number("expected_len")
    d = policy.diagnosis(F.struct(
        F.coalesce(number("score"), F.col("trainer_seq_score")).alias("score"), F.col("workflow_status").alias("status"), F.col("workflow_violation_reason").alias("message"),
        F.col("format_failure_reason").alias("format_reason"), F.col("final_answer_reject_reason").alias("reject_reason"), F.col("prediction_tool_error").alias("tool_error"),
        F.col("prediction_call_count").alias("calls"), F.col("illegal_turn3_tool_call_count").alias("illegal_calls"), F.col("missing_required_feature_tool_count").alias("missing"),
        F.col("refinement_degraded").alias("degraded"), F.col("prediction_model_defaulted").alias("defaulted"),
    ))
    no = lambda c: F.coalesce(c, F.lit(False))
    r = rows.withColumn("_d", d).withColumns({
        "debug_bucket": F.col("_d.bucket"), "debug_reason": F.col("_d.reason"),
        "_accepted": no(F.col("has_answer_tag") & F.col("has_answer_close") & (pred == expected) & (_text("final_answer_reject_reason") == "")),
        "_rejected": _text("workflow_status") == "rejected", "_shape": either("invalid_answer_shape"),
        "_regret_selected": number("selected_forecast_orig_mse") - number("reference_teacher_error"), "_regret_final": number("orig_mse") - number("reference_teacher_error"),
    }).drop("_d")
    return r.withColumns({
        "_ok": F.col("_accepted") & ~F.col("_rejected") & number("orig_mse").isNotNull() & number("orig_mae").isNotNull(),
        "_length": no(pred != expected) | F.col("_shape") | either("length_mismatch"),
    })


def validation_columns(rows: DataFrame, by: str) -> DataFrame:
    """All columns of the validation row for each value of ``by``; ratios of no rows and means of no values are null.

    Distributions read ``value=count,...``: all values in their order, or the most frequent ones.
    """
    r = kept(masked(rows))
    number = lambda c: finite(F.col(c).cast("double"))
    above = lambda c, n: number(c).isNotNull() & (F.floor(number(c)) > n)
    model, best, ok = F.lower(F.trim(_text("selected_model"))), F.lower(F.trim(_text("offline_best_model"))), F.col("_ok")
    score = number("score")
    out = {
        "validation_reward_mean": F.avg(score), "validation_reward_min": F.min(score), "validation_reward_max": F.max(score),
        "reward_negative_one_ratio": rate(score <= -0.99), "final_answer_accept_ratio": rate(F.col("_accepted")), "success_ratio": rate(ok),
        "format_failure_ratio": rate(F.col("debug_bucket") == "format_failure"), "workflow_rejected_ratio": rate(F.col("_rejected")),
        "tool_error_ratio": rate(F.col("debug_bucket") == "tool_error"),
        "prediction_call_not_once_ratio": rate(number("prediction_call_count").isNotNull() & (F.floor(number("prediction_call_count")) != 1)),
        "missing_required_feature_tool_ratio": rate(above("missing_required_feature_tool_count", 0)),
        "invalid_tool_call_name_ratio": rate(above("invalid_tool_call_name_count", 0)), "tool_call_json_decode_error_ratio": rate(above("tool_call_json_decode_error_count", 0)),
        "illegal_turn3_tool_call_ratio": F.avg((number("illegal_turn3_tool_call_count") > 0).cast("double")),
        "pred_len_94_95_ratio": rate(F.col("pred_len").isin(94, 95)), "length_mismatch_ratio": rate(F.col("_length")),
        "selected_model_offline_best_agreement_ratio": F.avg(F.when((model != "") & (best != ""), (model == best).cast("double"))),
        "selected_vs_reference_teacher_orig_mse_regret_mean": F.avg("_regret_selected"), "final_vs_reference_teacher_orig_mse_regret_mean": F.avg("_regret_final"),
        **{f"{c}_mean": F.avg(F.when(ok, number(c))) for c in ("orig_mse", "orig_mae", "norm_mse", "norm_mae")},
        **{k: F.avg(number(c)) for k, c in MEANS.items()}, **{k: rate(F.col(c)) for k, c in FLAGS.items()},
        **{f"{m}_share": F.avg((F.coalesce("selected_model", F.lit("unknown")) == m).cast("double")) for m in ("patchtst", "itransformer", "arima", "chronos2")},
        "unknown_model_share": rate(F.coalesce("selected_model", F.lit("unknown")) == "unknown"),
    }
    counts = {
        "total_samples": F.count("*"), "missing_answer_close_tag_count": F.count(F.when(_text("format_failure_reason").startswith("missing_answer_close_tag"), 1)),
        "invalid_answer_shape_count": F.count(F.when(F.col("_shape"), 1)), "was_clipped_count": F.count(F.when(F.col("was_clipped"), 1)),
        "prediction_tool_error_count": F.count(F.when(_text("prediction_tool_error") != "", 1)),
    }
    one_name = F.when(F.count_distinct(F.nullif(_text("run_name"), F.lit(""))) == 1, F.max("run_name")).otherwise("")
    wide = r.groupBy(by).agg(*(c.alias(k) for k, c in counts.items()), *(F.round(c, 6).alias(k) for k, c in out.items()), one_name.alias("run_name"))
    return wide.join(_percentiles(r, by), by, "left").join(_distributions(r, by), by, "left")


def _percentiles(r: DataFrame, by: str) -> DataFrame:
    pairs = {"orig_mse": F.when(F.col("_ok"), F.col("orig_mse")), "selected_vs_reference_teacher_orig_mse_regret": F.col("_regret_selected"), "response_token_len": F.col("response_token_len").cast("double")}
    long = r.select(by, F.explode(F.array(*(F.struct(F.lit(k).alias("name"), finite(c).alias("v")) for k, c in pairs.items()))).alias("m")).select(by, "m.name", "m.v")
    q = quantiles(long, "v", (0.5, 0.9), (by, "name"))
    at = lambda name, c: F.round(F.max(F.when(F.col("name") == name, F.col(c))), 6)
    return q.groupBy(by).agg(
        *(at(k, c).alias(f"{k}_{p}") for k in pairs for c, p in (("q0", "p50"), ("q1", "p90")) if (k, p) != ("response_token_len", "p50"))
    )


def _distributions(r: DataFrame, by: str) -> DataFrame:
    whole = lambda c: F.array(F.coalesce(F.col(c).cast("string"), F.lit("unknown" if c == "selected_model" else "")))
    parts = lambda c: F.filter(F.transform(F.split(_text(c), "->"), lambda v: F.trim(v)), lambda v: v != "none")
    fields = {f for f, _ in DISTRIBUTIONS.values()}
    named = lambda f: F.transform(parts(f) if f in SEQUENCES else whole(f), lambda v: F.struct(F.lit(f).alias("field"), v.alias("value")))
    values = F.flatten(F.array(*map(named, sorted(fields))))
    counts = r.select(by, F.explode(values).alias("x")).select(by, "x.*").where("value <> ''").groupBy(by, "field", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(by, "field").orderBy(F.desc("n"), "value"))
    shown = {f: n for f, n in DISTRIBUTIONS.values()}
    limit = F.create_map(*(F.lit(x) for f, n in shown.items() for x in (f, n or 2**31 - 1)))
    top = counts.withColumn("place", place).where(F.col("place") <= limit[F.col("field")])
    top = top.withColumn("order", F.when(F.col("field").isin(*(f for f, n in shown.items() if n)), F.col("place")).otherwise(0))
    entry = F.struct("order", "value", F.concat_ws("=", "value", F.col("n").cast("string")).alias("text"))
    texts = top.groupBy(by, "field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"]), ",").alias("text"))
    return texts.groupBy(by).agg(*(F.coalesce(F.max(F.when(F.col("field") == f, F.col("text"))), F.lit("")).alias(k) for k, (f, _) in DISTRIBUTIONS.items()))
