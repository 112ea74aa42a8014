"""Registered queries of filters, lookups, summaries, selections and rebalancing on records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import policy
from ..operators import audits, learners, validation
from ..operators import selection as sel
from ..operators.ordering import kept
from ..sources.tables import model_errors, series, table
from .queries import DEFAULT, ERRORS, MODELS, ROUTES, STEPS, TRIAGE, USERS, query, routes, steps, triaged

# --- filters ------------------------------------------------------------------------------------


@query("SELECT conv_id, turn FROM conversations WHERE lower(trim(role)) IN ('assistant')")
def f1_stage_mode(spark, d):
    return sel.in_stages(table(spark, d, "conversations"), "role", ["assistant"]).select("conv_id", "turn")


_TIER = "CASE WHEN turn % 4 = 0 THEN 'low' WHEN turn % 4 = 1 THEN ' Mid' WHEN turn % 4 = 2 THEN 'high' END"


@query(f"""WITH r AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 2 = 0 THEN 'heuristic' ELSE 'teacher' END AS src, {_TIER} AS tier FROM conversations)
SELECT conv_id, turn FROM r WHERE NOT (role = 'assistant' AND src = 'heuristic' AND CASE lower(trim(coalesce(tier, 'low'))) WHEN 'high' THEN 2 WHEN 'mid' THEN 1 ELSE 0 END < 1)""")
def f3_confidence_filter(spark, d):
    c = table(spark, d, "conversations").withColumns({
        "src": F.when(F.col("conv_id") % 2 == 0, "heuristic").otherwise("teacher"), "tier": F.expr(_TIER), "stage": F.when(F.col("role") == "assistant", "routing").otherwise(F.col("role")),
    })
    return sel.confident(c, "stage", "src", "tier", "mid").select("conv_id", "turn")


@query("""SELECT event_id, CASE WHEN event_id % 6 IN (1, 3) THEN 'arima' ELSE 'patchtst' END AS model FROM events WHERE event_id % 6 < 4 AND event_id % 5 > 1""")
def f4_f5_finite_supported(spark, d):
    e = F.col("event_id")
    v = F.when(e % 5 == 0, float("nan")).when(e % 5 == 1, float("-inf")).otherwise(F.col("value"))
    name = F.when(e % 6 == 0, " PatchTST ").when(e % 6 == 1, "ARIMA").when(e % 6 == 2, "patchtst").when(e % 6 == 3, "arima").when(e % 6 == 4, "other")
    r = table(spark, d, "events").select("event_id", v.alias("v"), policy.supported(name).alias("model"))
    return r.where(audits.finite(F.col("v")).isNotNull() & F.col("model").isNotNull()).select("event_id", "model")


@query("SELECT conv_id, turn, CASE WHEN role <> 'assistant' THEN 'skipped' WHEN length(text) % 3 = 0 THEN 'invalid' ELSE 'checked' END AS part FROM conversations")
def f6_valid_split(spark, d):
    return sel.parts(table(spark, d, "conversations"), F.col("role") == "assistant", F.length("text") % 3 != 0).select("conv_id", "turn", "part")


@query(f"""WITH {TRIAGE} SELECT count(*) FILTER (bucket <> 'ambiguous') AS decided, count(*) FILTER (bucket = 'keep' AND best <> 'mean' AND improvement_rel >= threshold) AS contradictory FROM tr""")
def f7_f9_decided(spark, d):
    t = triaged(spark, d)
    contrary = (F.col("bucket") == "keep") & (F.col("best") != DEFAULT) & (F.col("improvement_rel") >= F.col("threshold"))
    return t.agg(audits.count_if(F.col("bucket") != "ambiguous").alias("decided"), audits.count_if(contrary).alias("contradictory"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity > 40 AND l_returnflag = 'A')")
def f8_pad_mask(spark, d):
    padded = (F.col("l_quantity") > 40) & (F.col("l_returnflag") == "A")
    return table(spark, d, "lineitem").where(~padded).select("l_orderkey", "l_linenumber")


# --- lookups --------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def j3_strict_lookup(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return sel.strict_lookup(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), o, "l_orderkey")


@query("SELECT c_custkey, CASE WHEN n_nationkey IS NULL THEN c_name ELSE n_name END AS c_name, n_regionkey FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey")
def j8_annotate(spark, d):
    n = table(spark, d, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("c_name"), "n_regionkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_name")
    return sel.annotated(c, n, "c_nationkey").select("c_custkey", "c_name", "n_regionkey")


@query(f"""WITH {STEPS}, l AS (SELECT grp, trajectory, arg_max(reward, step) AS last FROM t GROUP BY ALL), g AS (SELECT grp, avg(last) AS mean FROM l GROUP BY 1)
SELECT trajectory, step, round(last - mean, 6) AS centred FROM t JOIN l USING (grp, trajectory) JOIN g USING (grp)""")
def j12_w12_back_map(spark, d):
    s = steps(spark, d)
    last = s.groupBy("grp", "trajectory").agg(F.max_by("reward", "step").alias("last"))
    mean = last.groupBy("grp").agg(F.avg("last").alias("mean"))
    return s.join(last, ["grp", "trajectory"]).join(mean, "grp").select("trajectory", "step", F.round(F.col("last") - F.col("mean"), 6).alias("centred"))


@query("""SELECT conv_id, pos, a, b FROM (SELECT conv_id, unnest(range(least(x, y))) AS pos, x, y FROM (SELECT conv_id, count(*) FILTER (role = 'user') AS x, count(*) FILTER (role <> 'user') AS y FROM conversations GROUP BY 1)) z
 JOIN (SELECT conv_id AS c1, text AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p1 FROM conversations WHERE role = 'user') u ON c1 = conv_id AND p1 = pos
 JOIN (SELECT conv_id AS c2, text AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p2 FROM conversations WHERE role <> 'user') v ON c2 = conv_id AND p2 = pos""")
def j11_zip(spark, d):
    text_of = lambda rows: F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["text"])
    user = F.when(F.col("role") == "user", F.struct("turn", "text"))
    other = F.when(F.col("role") != "user", F.struct("turn", "text"))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(text_of(user).alias("a"), text_of(other).alias("b"))
    n = F.least(F.size("a"), F.size("b"))
    z = c.select("conv_id", F.posexplode(F.slice(F.arrays_zip("a", "b"), F.lit(1), n)).alias("pos", "z"))
    return z.select("conv_id", F.col("pos").cast("long"), "z.a", "z.b")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30)")
def j13_selected_ids(spark, d):
    top = table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(30).select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(top, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


# --- summaries ---------------------------------------------------------------------------------------


@query("SELECT count(DISTINCT conv_id) AS sources FROM conversations")
def a3_distinct_sources(spark, d):
    return table(spark, d, "conversations").agg(F.count_distinct("conv_id").alias("sources"))


@query("""WITH p AS (SELECT coalesce(l.role, 'none') AS a, coalesce(r.role, 'none') AS b FROM conversations l LEFT JOIN conversations r ON l.conv_id = r.conv_id AND r.turn = l.turn + 2)
SELECT count(*) AS compared, round(avg((lower(trim(a)) = lower(trim(b)))::INT), 6) AS agreement FROM p WHERE trim(a) <> '' AND trim(b) <> ''""")
def a5_agreement_with_missing(spark, d):
    later = F.lead("role", 2).over(Window.partitionBy("conv_id").orderBy("turn"))
    return sel.agreement(table(spark, d, "conversations").select("role", later.alias("later")), "role", "later")


_REASON = "CASE WHEN length(text) % 3 = 0 THEN 'missing_think_block' WHEN length(text) % 3 = 1 THEN 'ok' ELSE 'missing_answer_block' END"


@query(f"""WITH r AS (SELECT *, {_REASON} AS why FROM conversations) SELECT count(*) FILTER (role = 'assistant') AS checked, count(*) FILTER (role <> 'assistant') AS skipped, count(*) FILTER (role = 'assistant' AND why = 'ok') AS valid,
 count(*) FILTER (role = 'assistant' AND why <> 'ok') AS invalid, round(count(*) FILTER (role = 'assistant' AND why = 'ok') / count(*) FILTER (role = 'assistant'), 6) AS valid_ratio FROM r""")
def a6_protocol_summary(spark, d):
    return audits.protocol_summary(table(spark, d, "conversations"), F.col("role") == "assistant", F.expr(_REASON))


@query(f"SELECT conv_id * 100 + turn AS row_index, {_REASON} AS reason FROM conversations WHERE role = 'assistant' AND {_REASON} <> 'ok' ORDER BY 1 LIMIT 5")
def a6_invalid_examples(spark, d):
    c = table(spark, d, "conversations").withColumn("row_index", F.col("conv_id") * 100 + F.col("turn"))
    return audits.first_invalid(c, F.col("role") == "assistant", F.expr(_REASON), "row_index").select("row_index", F.expr(_REASON).alias("reason"))


@query(f"WITH {TRIAGE} SELECT bucket, best, count(*) AS n, round(avg(default_error - best_error), 5) AS mean_regret, round(avg(default_in_top2::INT), 6) AS in_top2 FROM tr GROUP BY ALL")
def a11_a12_selection_metadata(spark, d):
    return triaged(spark, d).groupBy("bucket", "best").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("default_error") - F.col("best_error")), 5).alias("mean_regret"),
        F.round(F.avg(F.col("default_in_top2").cast("int")), 6).alias("in_top2"),
    )


@query("""WITH r AS (SELECT *, quality + 2 * toxic AS kind, doc_id % 3 = 0 AS copied, doc_id % 5 = 0 AS changed, doc_id % 7 > 0 AS strict FROM labels)
SELECT count(*) AS n, round(avg(strict::INT), 6) AS strict_rate, count(*) FILTER (kind = 1) AS refine, round(avg(copied::INT) FILTER (kind = 1), 6) AS refine_copy_rate, count(*) FILTER (kind = 0) AS keep, round(avg(changed::INT) FILTER (kind = 0), 6) AS keep_changed_rate FROM r""")
def a14_refinement_probe(spark, d):
    r = table(spark, d, "labels").withColumn("kind", F.col("quality") + 2 * F.col("toxic"))
    i, refine, keep = F.col("doc_id"), F.col("kind") == 1, F.col("kind") == 0
    return r.agg(
        F.count("*").alias("n"), F.round(audits.rate(i % 7 > 0), 6).alias("strict_rate"), audits.count_if(refine).alias("refine"),
        F.round(audits.rate(i % 3 == 0, refine), 6).alias("refine_copy_rate"), audits.count_if(keep).alias("keep"), F.round(audits.rate(i % 5 == 0, keep), 6).alias("keep_changed_rate"),
    )


@query(f"""WITH {ROUTES}, bc AS (SELECT best, count(*) AS n FROM routes GROUP BY 1) SELECT count(*) AS n, round(avg((best = 'drift')::INT), 6) AS exact_rate, round(avg(default_in_top2::INT), 6) AS top2_rate, round(avg(best_error - default_error), 4) AS final_vs_default,
 round(avg(best_error - default_error) FILTER (improvement_rel >= 0.15), 4) AS risky_final_vs_default, (SELECT round(max(n) / sum(n), 6) FROM bc) AS max_share FROM routes""")
def a15_final_select(spark, d):
    r = kept(routes(spark, d))
    gap = F.col("best_error") - F.col("default_error")
    s = r.agg(
        F.count("*").alias("n"), F.round(audits.rate(F.col("best") == "drift"), 6).alias("exact_rate"), F.round(audits.rate(F.col("default_in_top2")), 6).alias("top2_rate"),
        F.round(F.avg(gap), 4).alias("final_vs_default"), F.round(F.avg(F.when(F.col("improvement_rel") >= 0.15, gap)), 4).alias("risky_final_vs_default"),
    )
    return s.crossJoin(audits.max_share(r, "best"))  # one row each


@query("""WITH r AS (SELECT count(*) AS n, round(avg((length(text) % 10 > 0)::INT), 6) AS strict, round(avg((length(text) % 20 > 0)::INT), 6) AS closed, round(avg((length(text) % 4 > 0)::INT), 6) AS lines FROM conversations)
SELECT n, strict, closed, lines, n > 0 AND least(strict, closed, lines) >= 0.8 AS passed, (n * lines + 40) / (n + 40.0) >= 0.8 AND (n * strict + 40) / (n + 40.0) >= 0.8 AND (n * closed + 40) / (n + 40.0) >= 0.8 AS can_pass FROM r""")
def a16_gate(spark, d):
    n = F.length("text")
    g = audits.gate(table(spark, d, "conversations"), {"strict": n % 10 > 0, "closed": n % 20 > 0, "lines": n % 4 > 0}, 0.8)
    done = [F.col("n") * F.col(k) for k in ("strict", "closed", "lines")]
    return g.withColumn("can_pass", policy.can_still_pass(done, F.col("n"), F.col("n") + 40, 0.8))


_VAL = """v AS (SELECT event_type, CASE WHEN event_id % 9 = 0 THEN -1.0 WHEN event_id % 10 = 0 THEN NULL ELSE value / 500 END AS score, event_id % 8 > 0 AS has_answer, event_id % 12 > 0 AS has_close, 3 + (event_id % 3 = 0)::INT - (event_id % 5 = 0)::INT AS pred_len, 3 AS expected_len,
 CASE WHEN event_id % 11 = 0 THEN 'missing_answer_block' WHEN event_id % 13 = 0 THEN 'empty' ELSE '' END AS reject_reason, CASE WHEN event_id % 15 = 0 THEN 'Rejected' ELSE 'ok' END AS workflow, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS orig_mse, value / 2 AS orig_mae, value / 100 AS norm_mse,
 event_id % 3 AS calls, 'a' AS default_model, CASE event_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS model, CASE event_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS best_model FROM events),
w AS (SELECT *, has_answer AND has_close AND pred_len = expected_len AND reject_reason = '' AS acc FROM v), x AS (SELECT *, acc AND lower(workflow) <> 'rejected' AND orig_mse IS NOT NULL AS ok FROM w)"""


@query(f"""WITH {_VAL} SELECT event_type, count(*) AS n, round(avg(score), 6) AS score_mean, round(max(score), 6) AS score_max, round(min(score), 6) AS score_min, round(stddev_pop(score), 6) AS score_sd, round(avg(acc::INT), 6) AS accept_ratio, round(avg(ok::INT), 6) AS success_ratio, count(*) FILTER (ok) AS success_count,
 round(avg(has_answer::INT), 6) AS answer_tag_ratio, round(avg(has_close::INT), 6) AS answer_close_ratio, round(avg((pred_len = 3)::INT), 6) AS exact_length_ratio, round(avg((pred_len < 3)::INT), 6) AS under_length_ratio, round(avg((pred_len > 3)::INT), 6) AS over_length_ratio, round(avg(abs(pred_len - 3)), 6) AS length_gap_mean,
 round(avg((lower(workflow) = 'rejected')::INT), 6) AS rejected_ratio, round(avg(coalesce(score <= -0.99, false)::INT), 6) AS hard_failure_ratio, round(avg(orig_mse) FILTER (ok), 6) AS orig_mse_mean, round(max(orig_mse) FILTER (ok), 6) AS orig_mse_max, round(avg(orig_mae) FILTER (ok), 6) AS orig_mae_mean, round(avg(norm_mse) FILTER (ok), 6) AS norm_mse_mean,
 round(avg(calls), 6) AS calls_mean, round(avg((calls = 1)::INT), 6) AS one_call_ratio, round(avg((model = 'a')::INT), 6) AS default_ratio, round(avg((model = best_model)::INT), 6) AS best_ratio, count(DISTINCT model) AS models, count(DISTINCT nullif(reject_reason, '')) AS reject_reasons FROM x GROUP BY 1""")
def a17_validation_row(spark, d):
    e, v = F.col("event_id"), F.col("value")
    return audits.validation_row(_validation(spark, d, e, v), "event_type")


def _validation(spark, d, e, v):
    return table(spark, d, "events").select(
        "event_type", F.when(e % 9 == 0, -1.0).when(e % 10 == 0, float("nan")).otherwise(v / 500).alias("score"), (e % 8 > 0).alias("has_answer"), (e % 12 > 0).alias("has_close"),
        (3 + (e % 3 == 0).cast("int") - (e % 5 == 0).cast("int")).alias("pred_len"), F.lit(3).alias("expected_len"),
        F.when(e % 11 == 0, "missing_answer_block").when(e % 13 == 0, "empty").otherwise("").alias("reject_reason"), F.when(e % 15 == 0, "Rejected").otherwise("ok").alias("workflow"),
        F.when(e % 17 == 0, float("inf")).otherwise(v).alias("orig_mse"), (v / 2).alias("orig_mae"), (v / 100).alias("norm_mse"), (e % 3).alias("calls"), F.lit("a").alias("default_model"),
        F.when(e % 4 == 0, "a").when(e % 4 == 1, "b").otherwise("c").alias("model"), F.when(e % 2 == 0, "a").otherwise("b").alias("best_model"),
    )


#: Every column that a validation row reads, in the words that both engines share.
_READ = {
    "score": "CASE WHEN event_id % 9 = 0 THEN -1.0D WHEN event_id % 10 <> 0 THEN value / 500 END", "trainer_seq_score": "CASE WHEN event_id % 7 <> 0 THEN value / 400 END",
    "pred_len": "CASE event_id % 6 WHEN 0 THEN 94 WHEN 1 THEN 95 WHEN 2 THEN NULL ELSE 96 END", "expected_len": "96", "orig_mse": "CASE WHEN event_id % 17 <> 0 THEN value END", "orig_mae": "value / 2",
    "norm_mse": "CASE WHEN event_id % 5 <> 0 THEN value / 100 END", "norm_mae": "value / 200", "has_answer_tag": "event_id % 8 > 0", "has_answer_close": "event_id % 12 > 0", "was_clipped": "event_id % 21 = 0",
    "format_failure_reason": "CASE event_id % 11 WHEN 0 THEN 'missing_answer_close_tag' WHEN 1 THEN 'length_mismatch:2!=3' WHEN 2 THEN 'invalid_answer_shape:lines=2' WHEN 3 THEN 'ok' ELSE '' END",
    "final_answer_reject_reason": "CASE event_id % 13 WHEN 0 THEN 'missing_answer_block' WHEN 1 THEN 'invalid_answer_shape:x' WHEN 2 THEN 'length_mismatch' WHEN 3 THEN NULL ELSE '' END",
    "workflow_status": "CASE WHEN event_id % 15 = 0 THEN 'rejected' WHEN event_id % 15 = 1 THEN '' ELSE 'accepted' END", "workflow_violation_reason": "CASE WHEN event_id % 2 = 0 THEN 'no Diagnostic turn' END",
    "prediction_tool_error": "CASE WHEN event_id % 19 = 0 THEN 'boom' ELSE '' END", "prediction_call_count": "CASE WHEN event_id % 14 <> 0 THEN CAST(event_id % 3 AS DOUBLE) END",
    "illegal_turn3_tool_call_count": "CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 2 AS DOUBLE) END", "missing_required_feature_tool_count": "CAST(event_id % 3 AS DOUBLE)",
    "selected_forecast_exact_copy": "event_id % 6 = 1", "refinement_improved": "event_id % 5 = 1", "refinement_degraded": "event_id % 7 = 1", "prediction_model_defaulted": "event_id % 23 = 0",
    "invalid_tool_call_name_count": "CAST(event_id % 2 AS DOUBLE)", "tool_call_json_decode_error_count": "CASE WHEN event_id % 3 = 0 THEN 2.0D END", "invalid_tool_call_name_sequence": "CASE event_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'a->b' WHEN 2 THEN ' b ->c->' END",
    "selected_model": "CASE event_id % 5 WHEN 0 THEN 'arima' WHEN 1 THEN 'patchtst' WHEN 2 THEN 'chronos2' WHEN 3 THEN 'itransformer' END", "offline_best_model": "CASE event_id % 4 WHEN 0 THEN ' ARIMA' WHEN 1 THEN 'patchtst' ELSE '' END",
    "selected_forecast_orig_mse": "CASE WHEN event_id % 6 <> 0 THEN value * 2 END", "reference_teacher_error": "CASE WHEN event_id % 5 <> 0 THEN value / 3 END", "final_vs_selected_mse": "value / 7", "refinement_delta_orig_mse": "CASE WHEN event_id % 3 > 0 THEN value - 50 END",
    "analysis_coverage_ratio": "CAST(event_id % 4 AS DOUBLE) / 4", "strict_score": "value / 600", "recovered_score": "value / 550", "recovery_gap": "CASE WHEN event_id % 2 = 0 THEN value / 900 END", "raw_overrun_penalty": "CAST(event_id % 3 AS DOUBLE) / 10",
    "answer_line_count": "CAST(90 + event_id % 9 AS DOUBLE)", "turn3_horizon_clamped": "event_id % 9 = 4", "turn3_horizon_clamp_discarded_lines": "CASE WHEN event_id % 9 = 4 THEN 3.0D END", "turn3_horizon_clamp_valid_prefix_lines": "CAST(event_id % 97 AS DOUBLE)",
    "turn3_horizon_clamp_raw_answer_lines": "CAST(event_id % 101 AS DOUBLE)", "turn3_horizon_clamp_reason": "CASE WHEN event_id % 9 = 4 THEN 'too_long' WHEN event_id % 9 = 5 THEN '' END", "think_token_len": "CAST(event_id % 300 AS DOUBLE)", "answer_token_len": "CAST(event_id % 900 AS DOUBLE)",
    "wrote_expected_rows_before_stop": "event_id % 3 = 2", "feature_tool_count": "CAST(event_id % 6 AS DOUBLE)", "required_feature_tool_count": "CAST(event_id % 4 AS DOUBLE)", "raw_tool_call_block_count": "CAST(event_id % 3 AS DOUBLE)",
    "response_token_len": "CAST(event_id * 7 % 1000 AS DOUBLE)", "run_name": "CASE WHEN event_type = 'click' THEN 'one' WHEN event_id % 2 = 0 THEN 'two' ELSE 'three' END", "generation_stop_reason": "CASE event_id % 3 WHEN 0 THEN 'eos' WHEN 1 THEN 'length' ELSE '' END",
    "generation_finish_reason": "CASE event_id % 3 WHEN 0 THEN 'stop' END", "turn_stage": "CASE event_id % 3 WHEN 0 THEN 'routing' WHEN 1 THEN 'refinement' ELSE '' END", "refinement_decision_name": "CASE event_id % 2 WHEN 0 THEN 'keep_baseline' END",
}
_PLAIN = {  # means of finite values, by the column they are of
    "trainer_seq_score": "", "selected_forecast_orig_mse": "", "final_vs_selected_mse": "", "refinement_delta_orig_mse": "", "analysis_coverage_ratio": "", "strict_score": "", "recovered_score": "", "recovery_gap": "", "raw_overrun_penalty": "",
    "answer_line_count": "", "turn3_horizon_clamp_discarded_lines": "", "turn3_horizon_clamp_valid_prefix_lines": "", "turn3_horizon_clamp_raw_answer_lines": "", "think_token_len": "", "answer_token_len": "", "feature_tool_count": "", "required_feature_tool_count": "",
    "missing_required_feature_tool_count": "", "prediction_call_count": "", "raw_tool_call_block_count": "", "response_token_len": "", "orig_mse": " FILTER (ok)", "orig_mae": " FILTER (ok)", "norm_mse": " FILTER (ok)", "norm_mae": " FILTER (ok)",
}
_SHARE = {  # shares of all rows
    "reward_negative_one_ratio": "coalesce(score <= -0.99, false)", "final_answer_accept_ratio": "acc", "success_ratio": "ok", "format_failure_ratio": "bucket = 'format_failure'", "workflow_rejected_ratio": "workflow_status = 'rejected'", "tool_error_ratio": "bucket = 'tool_error'",
    "prediction_call_not_once_ratio": "coalesce(prediction_call_count <> 1, false)", "missing_required_feature_tool_ratio": "missing_required_feature_tool_count > 0", "invalid_tool_call_name_ratio": "invalid_tool_call_name_count > 0",
    "tool_call_json_decode_error_ratio": "coalesce(tool_call_json_decode_error_count > 0, false)", "pred_len_94_95_ratio": "coalesce(pred_len IN (94, 95), false)",
    "length_mismatch_ratio": "coalesce(pred_len <> expected_len, false) OR starts_with(ff, 'invalid_answer_shape') OR starts_with(rr, 'invalid_answer_shape') OR starts_with(ff, 'length_mismatch') OR starts_with(rr, 'length_mismatch')",
    "patchtst_share": "m = 'patchtst'", "itransformer_share": "m = 'itransformer'", "arima_share": "m = 'arima'", "chronos2_share": "m = 'chronos2'", "unknown_model_share": "m = 'unknown'",
    **{f"{c}_ratio": c for c in ("prediction_model_defaulted", "selected_forecast_exact_copy", "refinement_improved", "refinement_degraded", "turn3_horizon_clamped", "wrote_expected_rows_before_stop")},
}
_LISTS = {  # distributions: the field and how many of its values
    "debug_bucket_distribution": ("bucket", 0), "debug_reason_distribution": ("reason", 0), "selected_model_distribution": ("m", 0), "format_failure_reason_distribution": ("ff", 8), "final_answer_reject_reason_distribution": ("rr", 8),
    "generation_stop_reason_distribution": ("generation_stop_reason", 6), "generation_finish_reason_distribution": ("generation_finish_reason", 6), "turn3_horizon_clamp_reason_distribution": ("turn3_horizon_clamp_reason", 6), "workflow_status_distribution": ("workflow_status", 0),
    "turn_stage_distribution": ("turn_stage", 0), "run_name_distribution": ("run_name", 0), "invalid_tool_call_name_distribution": ("unnest(string_split(coalesce(invalid_tool_call_name_sequence, ''), '->'))", 8), "refinement_decision_distribution": ("refinement_decision_name", 0),
}


def _list_sql(field: str, n: int) -> str:
    counts = f"SELECT event_type, trim(v) AS v, count(*) AS c FROM (SELECT event_type, {field} AS v FROM x) WHERE v IS NOT NULL AND trim(v) NOT IN ('', 'none') GROUP BY event_type, trim(v)"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY c DESC, v) AS k FROM ({counts})"
    return f"(SELECT event_type, string_agg(v || '=' || c, ',' ORDER BY {'k' if n else 'v'}) AS t FROM ({ranked}) WHERE k <= {n or 'k'} GROUP BY event_type)"


@query("WITH r AS (SELECT event_type, " + ", ".join(f"{v.replace('.0D', '.0::DOUBLE')} AS {k}" for k, v in _READ.items()) + """ FROM events), w AS (SELECT *, coalesce(format_failure_reason, '') AS ff, coalesce(final_answer_reject_reason, '') AS rr, coalesce(selected_model, 'unknown') AS m, coalesce(score, trainer_seq_score) AS sc,
 CASE WHEN coalesce(final_answer_reject_reason, '') <> '' THEN final_answer_reject_reason WHEN format_failure_reason <> 'ok' THEN format_failure_reason ELSE '' END AS why FROM r),
b AS (SELECT *, CASE WHEN prediction_tool_error <> '' THEN 'tool_error' WHEN workflow_status = 'rejected' THEN 'workflow_violation' WHEN why <> '' THEN 'format_failure' WHEN sc <= -0.99 THEN 'hard_failure' WHEN refinement_degraded THEN 'quality_regression' WHEN prediction_model_defaulted OR missing_required_feature_tool_count > 0 THEN 'policy_gap' ELSE 'ok' END AS bucket,
 CASE WHEN prediction_tool_error <> '' THEN 'prediction_tool_error' WHEN workflow_status = 'rejected' THEN CASE WHEN illegal_turn3_tool_call_count > 0 THEN 'illegal_refinement_tool_call' WHEN prediction_call_count <> 1 THEN 'prediction_call_count_invalid' WHEN missing_required_feature_tool_count > 0 OR lower(workflow_violation_reason) LIKE '%diagnostic%' THEN 'missing_required_diagnostics' ELSE 'workflow_rejected' END
 WHEN why <> '' THEN CASE WHEN why LIKE 'invalid_answer_shape%' THEN 'invalid_answer_shape' WHEN why LIKE 'length_mismatch%' THEN 'length_mismatch' ELSE why END WHEN sc <= -0.99 THEN 'negative_one_reward' WHEN refinement_degraded THEN 'refinement_degraded' WHEN prediction_model_defaulted THEN 'prediction_model_defaulted' WHEN missing_required_feature_tool_count > 0 THEN 'missing_required_diagnostics' ELSE 'ok' END AS reason,
 coalesce(has_answer_tag AND has_answer_close AND pred_len = expected_len AND rr = '', false) AS acc, selected_forecast_orig_mse - reference_teacher_error AS rs, orig_mse - reference_teacher_error AS rf FROM w), x AS (SELECT *, acc AND workflow_status <> 'rejected' AND orig_mse IS NOT NULL AND orig_mae IS NOT NULL AS ok FROM b),
g AS (SELECT event_type, count(*) AS total_samples, count(*) FILTER (starts_with(ff, 'missing_answer_close_tag')) AS missing_answer_close_tag_count, count(*) FILTER (starts_with(ff, 'invalid_answer_shape') OR starts_with(rr, 'invalid_answer_shape')) AS invalid_answer_shape_count, count(*) FILTER (was_clipped) AS was_clipped_count, count(*) FILTER (prediction_tool_error <> '') AS prediction_tool_error_count,
 round(avg(score), 6) AS validation_reward_mean, round(min(score), 6) AS validation_reward_min, round(max(score), 6) AS validation_reward_max, round(avg((illegal_turn3_tool_call_count > 0)::INT), 6) AS illegal_turn3_tool_call_ratio,
 round(avg((m = lower(trim(offline_best_model)))::INT) FILTER (selected_model IS NOT NULL AND trim(offline_best_model) <> ''), 6) AS selected_model_offline_best_agreement_ratio, round(avg(rs), 6) AS selected_vs_reference_teacher_orig_mse_regret_mean, round(avg(rf), 6) AS final_vs_reference_teacher_orig_mse_regret_mean,
 round(quantile_cont(orig_mse, 0.5) FILTER (ok), 6) AS orig_mse_p50, round(quantile_cont(orig_mse, 0.9) FILTER (ok), 6) AS orig_mse_p90, round(quantile_cont(rs, 0.5), 6) AS selected_vs_reference_teacher_orig_mse_regret_p50, round(quantile_cont(rs, 0.9), 6) AS selected_vs_reference_teacher_orig_mse_regret_p90, round(quantile_cont(response_token_len, 0.9), 6) AS response_token_len_p90,
 CASE WHEN count(DISTINCT run_name) = 1 THEN max(run_name) ELSE '' END AS run_name, """ + ", ".join(f"round(avg({c}){f}, 6) AS {c}_mean" for c, f in _PLAIN.items()) + ", " + ", ".join(f"round(avg(({c})::INT), 6) AS {k}" for k, c in _SHARE.items())
       + " FROM x GROUP BY 1) SELECT g.*, " + ", ".join(f"coalesce({k}_.t, '') AS {k}" for k in _LISTS) + " FROM g " + " ".join(f"LEFT JOIN {_list_sql(*v)} {k}_ USING (event_type)" for k, v in _LISTS.items()))
def a17_validation_columns(spark, d):
    rows = table(spark, d, "events").select("event_type", *(F.expr(v).alias(k) for k, v in _READ.items()))
    return validation.validation_columns(rows, "event_type")


@query(f"""WITH {_VAL}, s AS (SELECT event_type, round(avg(score), 6) AS score_mean, round(avg(orig_mse) FILTER (ok AND event_type <> 'click'), 6) AS orig_mse_mean FROM x GROUP BY 1) SELECT event_type, name, val AS value FROM (UNPIVOT s ON score_mean, orig_mse_mean INTO NAME name VALUE val)""")
def a18_compact_summary(spark, d):
    s = audits.validation_row(_validation(spark, d, F.col("event_id"), F.col("value")), "event_type")
    s = s.withColumn("orig_mse_mean", F.when(F.col("event_type") == "click", float("nan")).otherwise(F.col("orig_mse_mean")))
    long = s.unpivot("event_type", ["score_mean", "orig_mse_mean"], "name", "value")
    return long.where(audits.finite(F.col("value")).isNotNull())


@query("""SELECT conv_id, s AS section, round(secs * 1000 / CASE WHEN s = 'gen' THEN r ELSE p + r END, 6) AS ms_per_token, round((p + r) / (secs * 4), 6) AS tokens_per_second FROM (SELECT conv_id, sum(length(text)) FILTER (role = 'user') AS p, sum(length(text)) FILTER (role <> 'user') AS r, count(*)::DOUBLE AS secs FROM conversations GROUP BY 1),
 (VALUES ('gen'), ('adv')) v(s) WHERE r > 0""")
def a20_per_token(spark, d):
    n = F.length("text").cast("long")
    t = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.sum(F.when(F.col("role") == "user", n)).alias("p"), F.sum(F.when(F.col("role") != "user", n)).alias("r"), F.count("*").cast("double").alias("seconds")
    )
    t = t.where("r > 0").withColumn("section", F.explode(F.array(F.lit("gen"), F.lit("adv"))))
    speed = F.round((F.col("p") + F.col("r")) / (F.col("seconds") * 4), 6)
    return audits.per_token(t, "p", "r").select("conv_id", "section", "ms_per_token", speed.alias("tokens_per_second"))


@query("""WITH e AS (SELECT event_type, value, count(*) OVER (PARTITION BY event_type) AS m, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k FROM events)
SELECT event_type, round(sum(value * ((k / m) ** 4 - ((k - 1) / m) ** 4)), 5) AS best, round(sum(value * (((m - k + 1) / m) ** 4 - ((m - k) / m) ** 4)), 5) AS worst FROM e GROUP BY 1""")
def a23_best_of_n(spark, d):
    return audits.expected_extremes(table(spark, d, "events"), "event_type", "value", 4)


@query("""WITH r AS (SELECT (doc_id % 10) / 10.0 AS s, quality = 1 AS y FROM labels), c AS (SELECT count(*) FILTER (s >= 0.5 AND y) AS tp, count(*) FILTER (s >= 0.5 AND NOT y) AS fp, count(*) FILTER (s < 0.5 AND y) AS fn, count(*) FILTER (s < 0.5 AND NOT y) AS tn FROM r)
SELECT (SELECT round(avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END), 6) FROM r a, r b WHERE a.y AND NOT b.y) AS auc, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy FROM c""")
def a25_binary_audit(spark, d):
    return audits.binary_audit(table(spark, d, "labels"), F.col("doc_id") % 10 / 10.0, F.col("quality") == 1)


def labelled_texts(spark, d):
    """Labelled documents with the features of their texts and a split by id."""
    split = F.when(F.col("doc_id") % 5 < 3, "train").when(F.col("doc_id") % 5 == 3, "val").otherwise("test")
    docs = table(spark, d, "documents").select("doc_id", *(c.alias(k) for k, c in learners.text_features(F.col("text")).items()))
    return table(spark, d, "labels").join(docs, "doc_id").withColumn("split", split)


@query()
def a25_trained_audit(spark, d):
    features = list(learners.text_features(F.lit("")))
    return learners.trained_audit(labelled_texts(spark, d), features, "quality", "split", "train", learners.models())


@query("""SELECT split, count(*) AS n, round(avg(words), 6) AS words, round(avg(word_length), 6) AS word_length, round(avg(digits), 6) AS digits, round(avg(marks), 6) AS marks, round(avg(distinct_words), 6) AS distinct_words FROM (
 SELECT CASE WHEN doc_id % 5 < 3 THEN 'train' WHEN doc_id % 5 = 3 THEN 'val' ELSE 'test' END AS split, ln(1 + len(w)) AS words, length(text) / len(w) AS word_length, len(regexp_extract_all(text, '[0-9]')) / length(text) AS digits,
 len(regexp_extract_all(text, '[#*$%&|<>]')) / length(text) AS marks, len(list_distinct(list_transform(w, lambda x: lower(x)))) / len(w) AS distinct_words FROM (SELECT doc_id, text, regexp_extract_all(text, '[^ \t\n\x0b\f\r]+') AS w FROM documents JOIN labels USING (doc_id))) GROUP BY 1""")
def a25_text_features(spark, d):
    rows = labelled_texts(spark, d)
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return rows.groupBy("split").agg(F.count("*").alias("n"), *map(mean, ("words", "word_length", "digits", "marks", "distinct_words")))


@query("SELECT event_type, max(value) FILTER (event_id % 3 > 0) AS most, min(value) FILTER (event_id % 3 > 0) AS least FROM events GROUP BY 1")
def a26_nan_safe(spark, d):
    v = F.when(F.col("event_id") % 3 == 0, float("nan")).otherwise(F.col("value"))
    return table(spark, d, "events").groupBy("event_type").agg(audits.nan_max(v).alias("most"), audits.nan_min(v).alias("least"))


_METRIC = "CASE event_id % 3 WHEN 0 THEN 'mean@' WHEN 1 THEN 'best@' ELSE 'std@' END || CASE WHEN event_id % 2 = 0 THEN '4' ELSE '8' END || CASE WHEN event_id % 5 = 0 THEN '/mean' ELSE '' END"
_VAR = "CASE WHEN event_type = 'click' OR user_id % 2 = 0 THEN 'reward' ELSE 'acc' END"


@query(f"""WITH m AS (SELECT DISTINCT event_type AS source, {_VAR} AS var, {_METRIC} AS metric FROM events), n AS (SELECT *, regexp_extract(metric, '@([0-9]+)', 1)::INT AS k FROM m), c AS (SELECT *, max(k) OVER (PARTITION BY source, var) AS most, max((var = 'acc')::INT) OVER (PARTITION BY source) AS has FROM n)
SELECT metric, CASE WHEN var = CASE WHEN has = 1 THEN 'acc' ELSE 'reward' END AND metric NOT LIKE 'std%' AND k = most THEN 'val-core' ELSE 'val-aux' END || '/' || source || '/' || var || '/' || metric AS name FROM c""")
def a27_metric_names(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("source"), F.expr(_VAR).alias("var"), F.expr(_METRIC).alias("metric")).distinct()
    return audits.metric_names(rows).select("metric", "name")


# --- ranks and windows -----------------------------------------------------------------------------------


@query(f"WITH {ERRORS} SELECT sample, model, row_number() OVER (PARTITION BY sample ORDER BY round(1000 / (1 + mae), 0) DESC, list_position(['naive', 'seasonal', 'mean', 'drift'], model)) AS rank FROM errors")
def w3_rank_by_score(spark, d):
    e = model_errors(spark, d).withColumn("score", F.round(1000 / (1 + F.col("mae")), 0))
    return sel.rank_by_score(e, MODELS).select("sample", "model", F.col("rank").cast("long"))


@query(f"""WITH {ERRORS}, k AS (SELECT *, CASE WHEN sample % 3 = 0 OR model = 'naive' THEN NULL ELSE mse END AS e, -mae AS score FROM errors)
SELECT sample, coalesce(arg_min(model, (e, model)) FILTER (e IS NOT NULL), arg_min(model, (-score, list_position(['naive', 'seasonal', 'mean', 'drift'], model)))) AS teacher FROM k GROUP BY 1""")
def w4_reference_teacher(spark, d):
    e = model_errors(spark, d).withColumns({
        "error": F.when((F.col("sample") % 3 == 0) | (F.col("model") == "naive"), float("nan")).otherwise(F.col("mse")), "score": -F.col("mae"),
    })
    return sel.reference_teacher(e, "error", "score", MODELS)


@query("""WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT c_custkey, c_mktsegment FROM r WHERE k <= least(n, greatest(greatest(1, ceil(40 / 4.0)), ceil(n * 0.3)))""")
def w7_top_pool(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return sel.top_pool(c, "c_mktsegment", "c_acctbal", "c_custkey", 40, 4, 0.3).select("c_custkey", "c_mktsegment")


VISIBLE = f"""{USERS}, n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM s), h AS (SELECT series_id, list(value ORDER BY pos) AS v FROM n WHERE pos < n - 8 AND pos >= n - 32 GROUP BY 1), f AS (SELECT series_id, list(value ORDER BY pos) AS y FROM n WHERE pos >= n - 8 GROUP BY 1),
c AS (SELECT series_id, v, k AS cand, list_transform(y, lambda q: q * (k + 1) / 2) AS x FROM h JOIN f USING (series_id), (VALUES (0), (1), (2)) t(k)),
g AS (SELECT series_id, cand, abs(x[1] - v[-1]) AS level, abs(list_avg(x) - list_avg(v)) AS mean, abs((x[-1] - x[1]) - (v[-1] - v[1])) AS trend, abs(list_avg(list_transform(range(1, len(x)), lambda i: abs(x[i + 1] - x[i]))) - list_avg(list_transform(range(1, len(v)), lambda i: abs(v[i + 1] - v[i])))) AS step,
 abs(list_stddev_pop(x) - list_stddev_pop(v)) AS volatility FROM c)"""


@query(f"""WITH {VISIBLE} SELECT series_id, g.cand, round(d.level - g.level, 6) AS level_gain, round(d.mean - g.mean, 6) AS mean_gain, round(d.trend - g.trend, 6) AS trend_gain, round(d.step - g.step, 6) AS step_gain, round(d.volatility - g.volatility, 6) AS volatility_gain
 FROM g JOIN g d USING (series_id) WHERE d.cand = CASE WHEN series_id % 2 = 0 THEN 1 ELSE 0 END""")
def w15_visible_gains(spark, d):
    n = F.count("*").over(Window.partitionBy("series_id"))
    s = series(spark, d, "user_id").withColumn("n", n)
    cells = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", "value")))), lambda p: p["value"])
    w = s.groupBy("series_id").agg(cells((F.col("pos") < F.col("n") - 8) & (F.col("pos") >= F.col("n") - 32)).alias("v"), cells(F.col("pos") >= F.col("n") - 8).alias("y"))
    c = w.withColumn("cand", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("x", F.transform("y", lambda q: q * (F.col("cand") + 1) / 2))
    default = F.when(F.col("series_id") % 2 == 0, 1).otherwise(9)  # no candidate 9: the first stands in
    g = sel.visible_gains(c.withColumn("default_id", default), "series_id", "cand", "default_id", "x", "v")
    return g.select("series_id", F.col("cand").cast("long"), *(F.round(f"{k}_gain", 6).alias(f"{k}_gain") for k in sel.GAPS))


@query("SELECT event_id, coalesce(list_position(CASE event_id % 3 WHEN 0 THEN ['a', 'b'] WHEN 1 THEN ['b', 'a'] ELSE ['b'] END, 'a'), 0) - 1 AS gold_rank FROM events")
def w16_gold_rank(spark, d):
    kind = F.col("event_id") % 3
    shown = F.when(kind == 0, F.array(F.lit("a"), F.lit("b"))).when(kind == 1, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("b")))
    return table(spark, d, "events").select("event_id", (F.array_position(shown, F.lit("a")) - 1).alias("gold_rank"))


# --- selection ---------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS place, count(*) OVER () AS n FROM customer), w AS (SELECT DISTINCT round_even(i * (n - 1) / 16.0, 0)::INT AS place FROM range(17) r(i), (SELECT any_value(n) AS n FROM o)),
f AS (SELECT place, row_number() OVER (ORDER BY place) AS k FROM o WHERE place NOT IN (SELECT place FROM w)) SELECT c_custkey FROM o WHERE place IN (SELECT place FROM w) OR place IN (SELECT place FROM f WHERE k <= 17 - (SELECT count(*) FROM w))""")
def k1_evenly_spaced_filled(spark, d):
    return sel.evenly_spaced_filled(table(spark, d, "customer").select("c_custkey"), "c_custkey", 17).select("c_custkey")


_BUCKETS = """, {0} AS (SELECT *, row_number() OVER (PARTITION BY {1} ORDER BY c_custkey) - 1 AS p, count(*) OVER (PARTITION BY {1}) AS n FROM {2}),
{0}w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {1}, CASE WHEN n <= {3} THEN p ELSE ((p + 1) * {3} - 1) // n END ORDER BY c_acctbal DESC, c_custkey) AS rn FROM {0} WHERE {3} > 0) WHERE rn = 1)"""


@query("WITH c AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer), m AS (SELECT count(DISTINCT c_mktsegment) AS k FROM c)" + _BUCKETS.format("a", "c_mktsegment", "c", "(SELECT 23 // k FROM m)")
       + ", rest AS (SELECT * FROM c WHERE c_custkey NOT IN (SELECT c_custkey FROM aw)), left_ AS (SELECT 23 - count(*) AS k FROM aw)" + _BUCKETS.format("b", "1", "rest", "(SELECT k FROM left_)")
       + " SELECT c_custkey, c_mktsegment FROM aw UNION ALL SELECT c_custkey, c_mktsegment FROM bw")
def k5_model_balanced(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return sel.balanced_selection(c, "c_custkey", "c_acctbal", "c_mktsegment", 23).select("c_custkey", "c_mktsegment")


@query("WITH c AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer), q1 AS (SELECT * FROM c WHERE c_acctbal < 0)" + _BUCKETS.format("a", "1", "q1", "4") + ", aa AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM aw), t1 AS (SELECT * FROM c WHERE c_custkey NOT IN (SELECT c_custkey FROM aa)), m AS (SELECT count(DISTINCT c_mktsegment) AS k FROM t1)"
       + _BUCKETS.format("b", "c_mktsegment", "t1", "(SELECT (20 - (SELECT count(*) FROM aa)) // k FROM m)") + ", r2 AS (SELECT * FROM t1 WHERE c_custkey NOT IN (SELECT c_custkey FROM bw)), l2 AS (SELECT 20 - (SELECT count(*) FROM aa) - (SELECT count(*) FROM bw) AS k)"
       + _BUCKETS.format("z", "1", "r2", "(SELECT k FROM l2)") + " SELECT c_custkey FROM aa UNION ALL SELECT c_custkey FROM bw UNION ALL SELECT c_custkey FROM zw")
def k6_quota_curation(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return sel.quota_selection(c, "c_custkey", "c_acctbal", "c_mktsegment", 20, [(F.col("c_acctbal") < 0, 0.2)]).select("c_custkey")


_KEEPS = TRIAGE + """, kp AS (SELECT *, row_number() OVER (ORDER BY best <> 'mean', improvement_rel, sample) - 1 AS place, count(*) OVER () AS n FROM tr WHERE bucket = 'keep')"""
_HALVES = _KEEPS + """, nk AS (SELECT least(count(*) FILTER (bucket = 'keep'), greatest(1, 6)) AS k, count(*) FILTER (bucket = 'override') AS o FROM tr), no AS (SELECT k, least(o, greatest(1, 12 - k)) AS o FROM nk),
kk AS (SELECT sample FROM kp, no WHERE n <= k OR (k = 1 AND place = n // 2) OR (k > 1 AND place IN (SELECT round_even(i * (n - 1) / greatest(k - 1, 1)::DOUBLE, 0)::INT FROM range(0, 12) r(i) WHERE i < k))),
om AS (SELECT s, row_number() OVER (ORDER BY j) - 1 AS j FROM (VALUES ('naive', 0), ('seasonal', 1), ('drift', 3)) v(s, j) WHERE s IN (SELECT best FROM tr WHERE bucket = 'override')), oq AS (SELECT s, j, greatest(1, o // (SELECT count(*) FROM om)) AS each, o FROM om, no),
oz AS (SELECT *, each + CASE WHEN j < greatest(0, o - each * (SELECT count(*) FROM om)) THEN 1 ELSE 0 END AS quota FROM oq), orr AS (SELECT tr.sample, tr.improvement_rel, j, quota, o, row_number() OVER (PARTITION BY best ORDER BY improvement_rel DESC, sample DESC) AS k FROM tr JOIN oz ON s = best WHERE bucket = 'override'),
oo AS (SELECT sample FROM (SELECT *, row_number() OVER (ORDER BY (k > quota), CASE WHEN k <= quota THEN j ELSE 0 END, CASE WHEN k <= quota THEN k ELSE 0 END, improvement_rel DESC, sample DESC) AS w FROM orr) WHERE w <= o),
both_ AS (SELECT sample FROM kk UNION ALL SELECT sample FROM oo), lf AS (SELECT sample, row_number() OVER (ORDER BY sample) AS w FROM tr WHERE bucket <> 'ambiguous' AND sample NOT IN (SELECT sample FROM both_))"""


@query(f"WITH {_KEEPS} SELECT sample FROM kp WHERE n <= 4 OR place IN (SELECT round_even(i * (n - 1) / 3.0, 0)::INT FROM range(4) r(i))")
def k8_keep_selection(spark, d):
    return sel.keep_selection(triaged(spark, d).where("bucket = 'keep'"), DEFAULT, 4).select("sample")


@query(f"WITH {_HALVES} SELECT sample, 'eval' AS view FROM both_ UNION ALL SELECT sample, 'train' FROM both_ UNION ALL SELECT sample, 'train' FROM lf WHERE w <= 12 - (SELECT count(*) FROM both_) UNION ALL SELECT sample, 'natural' FROM tr WHERE bucket <> 'ambiguous' AND sample NOT IN (SELECT sample FROM both_)")
def k9_k10_split_views(spark, d):
    t = kept(triaged(spark, d))
    balanced = kept(sel.half_and_half(t, DEFAULT, MODELS, 12, fill=False).select("sample"))
    train = sel.half_and_half(t, DEFAULT, MODELS, 12, fill=True).select("sample", F.lit("train").alias("view"))
    natural = t.where("bucket <> 'ambiguous'").join(balanced, "sample", "left_anti").select("sample", F.lit("natural").alias("view"))
    return balanced.withColumn("view", F.lit("eval")).unionByName(train).unionByName(natural)


@query(f"WITH {ERRORS} SELECT sample, arg_min(model, (mae, mse, model)) AS best, arg_min(model, (mse, model)) FILTER (model <> 'mean') AS alternative FROM errors GROUP BY 1")
def k12_k13_best_candidates(spark, d):
    e = model_errors(spark, d)
    return e.groupBy("sample").agg(
        F.min(F.struct("mae", "mse", "model"))["model"].alias("best"),
        F.min(F.when(F.col("model") != DEFAULT, F.struct("mse", "model")))["model"].alias("alternative"),
    )


@query("""WITH a AS (SELECT event_id, 'slow' AS category FROM events WHERE event_type = 'error' ORDER BY value DESC, event_id LIMIT 2), b0 AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS u FROM events WHERE value > 100 AND event_id NOT IN (SELECT event_id FROM a)),
b AS (SELECT event_id, 'varied' AS category FROM b0 ORDER BY u > 1, value, event_id LIMIT 6), c AS (SELECT event_id, 'rest' AS category FROM events WHERE event_id NOT IN (SELECT event_id FROM a UNION ALL SELECT event_id FROM b) ORDER BY event_id LIMIT 2) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def k15_sample_picker(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    picks = [
        ("slow", F.col("event_type") == "error", [F.desc("value")], 2, None), ("varied", F.col("value") > 100, [F.asc("value")], 6, "event_type"),
        ("rest", F.lit(True), [], 2, None),
    ]
    return sel.by_category(e, picks, "event_id").select("event_id", "category")


@query("""WITH o AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS place, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT c_custkey, c_mktsegment FROM o WHERE n <= 5 OR place IN (round_even(0, 0), round_even((n - 1) / 4.0, 0), round_even(2 * (n - 1) / 4.0, 0), round_even(3 * (n - 1) / 4.0, 0), n - 1)""")
def k16_stratified(spark, d):
    return sel.spread_per_group(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 5).select("c_custkey", "c_mktsegment")


@query("""WITH h AS (SELECT c_custkey, c_mktsegment, sha256('17:' || c_custkey) AS h FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY h) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM h), m AS (SELECT *, max(n) OVER () AS mx FROM r)
SELECT c_custkey, mx // n + CASE WHEN k <= mx % n THEN 1 ELSE 0 END AS times FROM m""")
def k17_oversample(spark, d):
    r = sel.oversampled(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey")
    return r.groupBy("c_custkey").agg(F.count("*").alias("times"))


@query("SELECT c_custkey FROM customer ORDER BY sha256('17:' || c_custkey), c_custkey LIMIT 25")
def k18_shuffled_head(spark, d):
    return sel.shuffled_head(table(spark, d, "customer").select("c_custkey"), "c_custkey", 25)


# --- rebalancing ------------------------------------------------------------------------------------------------


#: Kinds of the customers: a segment of local edits, one of other rows, keeps; {0} is the share, {1} the least balance of no priority.
_KINDS = """k AS (SELECT c_custkey, c_acctbal < {1} AS first, CASE c_mktsegment WHEN 'BUILDING' THEN 'local_refine' WHEN 'MACHINERY' THEN 'other' ELSE 'validated_keep' END AS kind FROM customer),
t AS (SELECT greatest(floor(count(*) FILTER (kind = 'local_refine') * (1.0::DOUBLE - {0}::DOUBLE) / {0}::DOUBLE) - count(*) FILTER (kind = 'other'), 0)::INT AS t, count(*) FILTER (kind = 'validated_keep') AS n FROM k),
p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i FROM k WHERE kind = 'validated_keep' AND first), m AS (SELECT t, greatest(t - (SELECT count(*) FROM p), 0) AS r, n FROM t),
o AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS place, count(*) OVER () AS n FROM k WHERE kind = 'validated_keep' AND NOT first)
SELECT c_custkey FROM k WHERE kind <> 'validated_keep' UNION ALL SELECT c_custkey FROM k, t WHERE kind = 'validated_keep' AND n <= t UNION ALL SELECT c_custkey FROM p, m WHERE n > t AND i <= t
UNION ALL SELECT c_custkey FROM o, m WHERE m.n > t AND r > 0 AND (o.n <= r OR place IN (SELECT CASE WHEN r = 1 THEN 0 ELSE floor(i * (o.n - 1) / (r - 1)) END FROM range(100000) g(i) WHERE i < r))"""


def _kinds(spark, d):
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "local_refine").when(F.col("c_mktsegment") == "MACHINERY", "other").otherwise("validated_keep")
    return table(spark, d, "customer").select("c_custkey", "c_acctbal", kind.alias("kind"))


@query("WITH " + _KINDS.format(0.3, 0))
def b3_downsample_keeps(spark, d):
    return sel.kept_by_ratio(_kinds(spark, d), "kind", "c_custkey", F.col("c_acctbal") < 0, 0.3).select("c_custkey")


@query("WITH " + _KINDS.format(0.4, 6000))
def b3_more_priority_than_room(spark, d):
    return sel.kept_by_ratio(_kinds(spark, d), "kind", "c_custkey", F.col("c_acctbal") < 6000, 0.4).select("c_custkey")


#: The refinement rows alone count; rows of other stages all stay.
_TURNS = """q AS (SELECT conv_id * 1000 + turn AS row_id, role = 'assistant' AS own, CASE length(text) % 4 WHEN 0 THEN 'local_refine' ELSE 'validated_keep' END AS kind, length(text) % 8 = 1 AS first FROM conversations), k AS (SELECT * FROM q WHERE own),
t AS (SELECT floor(count(*) FILTER (kind = 'local_refine') * (1.0::DOUBLE - 0.4::DOUBLE) / 0.4::DOUBLE)::INT AS t, count(*) FILTER (kind = 'validated_keep') AS n, count(*) AS a FROM k), p AS (SELECT row_id, row_number() OVER (ORDER BY row_id) AS i FROM k WHERE kind = 'validated_keep' AND first), m AS (SELECT *, greatest(t - (SELECT count(*) FROM p), 0) AS r FROM t),
o AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS place, count(*) OVER () AS n FROM k WHERE kind = 'validated_keep' AND NOT first)"""


@query(f"WITH {_TURNS} SELECT row_id FROM q WHERE NOT own OR kind = 'local_refine' UNION ALL SELECT row_id FROM p, m WHERE n > t AND t < a AND i <= t UNION ALL SELECT row_id FROM k, m WHERE kind = 'validated_keep' AND NOT (n > t AND t < a) UNION ALL SELECT row_id FROM o, m WHERE m.n > t AND t < a AND r > 0 AND (o.n <= r OR place IN (SELECT CASE WHEN r = 1 THEN 0 ELSE floor(i * (o.n - 1) / (r - 1)) END FROM range(100000) g(i) WHERE i < r))")
def b4_downsample_refinement(spark, d):
    size = F.length("text")
    q = table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), (F.col("role") == "assistant").alias("own"),
        F.when(size % 4 == 0, "local_refine").otherwise("validated_keep").alias("kind"), (size % 8 == 1).alias("first"),
    )
    return sel.kept_by_ratio(q.where("own"), "kind", "row_id", F.col("first"), 0.4).unionByName(q.where("not own")).select("row_id")


@query("SELECT conv_id, turn, 1 + CASE WHEN role = 'assistant' AND turn > 3 THEN 2 ELSE 0 END + CASE WHEN role = 'assistant' AND length(text) % 2 = 0 THEN 1 ELSE 0 END AS times FROM conversations")
def b6_repeats(spark, d):
    own = F.col("role") == "assistant"
    r = sel.repeated_where(table(spark, d, "conversations"), own & (F.col("turn") > 3), 3)
    r = sel.repeated_where(r, own & (F.length("text") % 2 == 0) & (F.col("copy") == 0), 2).drop("copy")
    return r.groupBy("conv_id", "turn").agg(F.count("*").alias("times"))


@query("SELECT role, count(*) AS n FROM (SELECT role FROM conversations UNION ALL SELECT role FROM conversations WHERE turn > 2) GROUP BY 1")
def b8_bag_union(spark, d):
    c = table(spark, d, "conversations").select("role", "turn")
    return c.unionByName(c.where("turn > 2")).groupBy("role").agg(F.count("*").alias("n"))


@query("SELECT event_id, 1 + (event_id % 3 > 0)::INT AS kept FROM events")
def b10_candidate_dedupe(spark, d):
    v = F.col("value")
    twin = F.struct(F.lit("a").alias("ops"), F.array(v + F.when(F.col("event_id") % 3 == 0, 1e-9).otherwise(1.0)).alias("values"))
    c = F.array(F.struct(F.lit("a").alias("ops"), F.array(v).alias("values")), twin)
    return table(spark, d, "events").select("event_id", F.size(sel.distinct_candidates(c)).cast("long").alias("kept"))


@query("SELECT conv_id, turn, unnest(range(1 + turn % 3)) AS copy FROM conversations")
def b12_step_counts(spark, d):
    c = sel.copies(table(spark, d, "conversations").select("conv_id", "turn"), 1 + F.col("turn") % 3)
    return c.select("conv_id", "turn", F.col("copy").cast("long"))


@query(f"""WITH {TRIAGE}, q AS (SELECT *, CASE sample % 4 WHEN 0 THEN 'naive' WHEN 1 THEN best WHEN 2 THEN second ELSE 'mean' END AS req, CASE sample % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'mid' ELSE 'low' END AS tier, bucket = 'override' AS gold, sample % 2 = 0 AS said FROM tr),
conf AS (SELECT count(*) FILTER (gold AND said) AS tp, count(*) FILTER (NOT gold AND said) AS fp, count(*) FILTER (gold AND NOT said) AS fn, count(*) FILTER (NOT gold AND NOT said) AS tn FROM q), shares AS (SELECT req, count(*) AS n FROM q GROUP BY 1)
SELECT count(*) AS n, round(avg((req = best)::INT), 6) AS teacher_rate, round(avg((req = 'drift')::INT), 6) AS heuristic_rate, round(avg((req = best)::INT), 6) AS exact_rate, round(avg((req IN (best, second))::INT), 6) AS top2_rate, count(*) FILTER (tier <> 'low') AS sure, round(avg((req = best)::INT) FILTER (tier <> 'low'), 6) AS sure_exact_rate,
 round(avg(improvement), 6) AS mean_regret, round(avg(improvement) FILTER (tier <> 'low'), 6) AS sure_mean_regret, round(avg(improvement_rel), 6) AS mean_delta, count(DISTINCT req) AS coverage, any_value(tp) AS tp, any_value(fp) AS fp, any_value(fn) AS fn, any_value(tn) AS tn,
 round(coalesce(avg((req = best)::INT) FILTER (gold), 0), 6) AS override_exact_rate, round(avg(said::INT), 6) AS override_share, round(coalesce(any_value(tp / nullif(tp + fp, 0)), 0), 6) AS override_precision, round(coalesce(any_value(tp / nullif(tp + fn, 0)), 0), 6) AS override_recall,
 round(coalesce(any_value(2 * tp / nullif(2 * tp + fp + fn, 0)), 0), 6) AS override_f1, round((coalesce(any_value(2 * tp / nullif(2 * tp + fp + fn, 0)), 0) + coalesce(any_value(2 * tn / nullif(2 * tn + fp + fn, 0)), 0)) / 2, 6) AS macro_f1, (SELECT round(max(n) / sum(n), 6) FROM shares) AS max_share FROM q, conf""")
def a13_routing_probe(spark, d):
    s = F.col("sample")
    t = triaged(spark, d).select(
        F.when(s % 4 == 0, "naive").when(s % 4 == 1, F.col("best")).when(s % 4 == 2, F.col("second")).otherwise("mean").alias("requested"), F.col("best").alias("teacher"),
        F.lit("drift").alias("heuristic"), "best", "second", F.when(s % 3 == 0, "high").when(s % 3 == 1, "mid").otherwise("low").alias("tier"),
        F.col("improvement").alias("regret"), F.col("improvement_rel").alias("delta"), (F.col("bucket") == "override").alias("gold_override"), (s % 2 == 0).alias("predicted_override"),
    )
    return audits.routing_summary(kept(t))


@query("""WITH w AS (SELECT conv_id, sum(length(text)) AS t FROM conversations GROUP BY 1), s AS (SELECT min(length(text)) AS a, round(avg(length(text)), 6) AS b, max(length(text)) AS c FROM conversations), f AS (SELECT conv_id, turn FROM conversations ORDER BY length(text) DESC, conv_id, turn LIMIT 1)
SELECT any_value(a) AS step_min, any_value(b) AS step_mean, any_value(c) AS step_max, (SELECT conv_id FROM f) AS slowest_step_of, (SELECT turn FROM f) AS slowest_step, min(t)::BIGINT AS whole_min, round(avg(t), 6) AS whole_mean, max(t)::BIGINT AS whole_max, (SELECT conv_id FROM w ORDER BY t DESC, conv_id LIMIT 1) AS slowest FROM w, s""")
def a21_two_level_timing(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("seconds"))
    return audits.two_level_timing(c, "conv_id", "turn", "seconds")


@query("SELECT o_orderkey, o_custkey, c_name AS o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING'")
def j4_right_wins(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("o_orderpriority"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return sel.annotated(o.join(c.select("o_custkey"), "o_custkey", "left_semi"), c, "o_custkey").select("o_orderkey", "o_custkey", "o_orderpriority")


_K11 = _HALVES.replace("least(o, greatest(1, 12 - k)) AS o FROM nk", "least(o, greatest((SELECT count(DISTINCT best) FROM tr WHERE bucket = 'override'), round_even(12 * 0.3, 0)::INT)) AS o FROM nk").replace(
    "WHERE n <= k OR (k = 1 AND place = n // 2) OR (k > 1 AND place IN (SELECT round_even(i * (n - 1) / greatest(k - 1, 1)::DOUBLE, 0)::INT FROM range(0, 12) r(i) WHERE i < k))",
    "WHERE n <= 12 - o OR (12 - o > 1 AND place IN (SELECT round_even(i * (n - 1) / greatest(11 - o, 1)::DOUBLE, 0)::INT FROM range(0, 12) r(i) WHERE i < 12 - o))",
).replace("WHERE bucket <> 'ambiguous' AND sample NOT IN (SELECT sample FROM both_)", "WHERE sample NOT IN (SELECT sample FROM both_)")


@query(f"WITH {_K11} SELECT sample FROM both_ UNION ALL SELECT sample FROM lf WHERE w <= 12 - (SELECT count(*) FROM both_)")
def k11_keep_share(spark, d):
    return sel.keep_share_selection(kept(triaged(spark, d)), DEFAULT, MODELS, 12, 0.7).select("sample")
