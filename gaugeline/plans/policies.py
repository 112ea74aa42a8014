"""Registered queries of the decision rules, over features made from the events' numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy
from ..operators import trajectories
from ..operators.ordering import kept, numbered
from ..sources.tables import table
from .queries import query

# Features in the words that both engines share.
FEATURES = {
    "acf1": "(80 + event_id % 20) / 100.0D", "acf_seasonal": "event_id % 13 / 100.0D", "cusum": "CAST(event_id % 140 AS DOUBLE)", "changepoints": "CAST(event_id % 5 AS DOUBLE)",
    "peaks": "CAST(user_id % 9 AS DOUBLE)", "spacing_cv": "event_id * 3 % 50 / 100.0D", "monotone": "event_id % 21 / 100.0D", "exceed": "event_id * 7 % 12 / 100.0D",
    "saturation": "event_id * 11 % 9 / 100.0D", "quantization": "event_id * 13 % 26 / 100.0D", "segments": "CAST(event_id % 6 AS DOUBLE)",
}
DOMINANT = "CASE event_id % 4 WHEN 0 THEN 'rise' WHEN 1 THEN 'flat' WHEN 2 THEN 'oscillation' ELSE 'fall' END"
F_SQL = "f AS (SELECT event_id, user_id, " + ", ".join(f"{v.replace('0D', '0::DOUBLE')} AS {k}" for k, v in FEATURES.items()) + f", {DOMINANT} AS dominant FROM events)"
SCORES = F_SQL + """, sc AS (SELECT *, 0.10 + CASE WHEN acf1 >= 0.92 THEN 1.5 WHEN acf1 >= 0.88 THEN 0.75 ELSE 0 END + CASE WHEN changepoints <= 1 THEN 0.75 ELSE 0 END + CASE WHEN exceed <= 0.05 THEN 0.5 ELSE 0 END AS arima,
 0.15 + CASE WHEN peaks BETWEEN 2 AND 5 THEN 1 ELSE 0 END + CASE WHEN spacing_cv <= 0.30 THEN 0.75 ELSE 0 END + CASE WHEN acf_seasonal >= 0.05 THEN 0.5 ELSE 0 END AS patchtst,
 CASE WHEN changepoints >= 2 THEN 1.25 ELSE 0 END + CASE WHEN cusum >= 70 THEN 0.75 ELSE 0 END + CASE WHEN monotone >= 0.10 THEN 0.5 ELSE 0 END AS itransformer,
 -0.5 + CASE WHEN exceed >= 0.08 THEN 0.75 ELSE 0 END + CASE WHEN saturation >= 0.08 OR quantization >= 0.24 THEN 0.5 ELSE 0 END + CASE WHEN peaks >= 6 AND spacing_cv >= 0.35 THEN 0.5 ELSE 0 END AS chronos2 FROM f),
lg AS (SELECT event_id, m.model, m.o, CASE m.o WHEN 0 THEN arima WHEN 1 THEN patchtst WHEN 2 THEN itransformer ELSE chronos2 END::DOUBLE AS score FROM sc, (VALUES ('arima', 0), ('patchtst', 1), ('itransformer', 2), ('chronos2', 3)) m(model, o)),
tp AS (SELECT event_id, arg_min(model, (-score * 100 + o)) AS top FROM (SELECT event_id, model, o / 1000.0 AS o, round(score, 4) AS score FROM lg) GROUP BY 1),
pr AS (SELECT sc.*, CASE WHEN saturation >= 0.08 OR quantization >= 0.24 OR (exceed >= 0.085 AND peaks >= 6 AND spacing_cv >= 0.40) THEN 'chronos2' WHEN acf1 >= 0.93 AND changepoints <= 1 AND exceed <= 0.05 AND peaks <= 4 THEN 'arima'
 WHEN changepoints >= 3 AND (cusum >= 70 OR monotone >= 0.10) THEN 'itransformer' WHEN peaks BETWEEN 2 AND 5 AND spacing_cv <= 0.30 THEN 'patchtst' ELSE top END AS primary_model FROM sc JOIN tp USING (event_id))"""
PLAN = SCORES + """, ru AS (SELECT pr.event_id, arg_min(lg.model, -round(lg.score, 4) * 100 + lg.o / 1000.0) AS runner_up FROM pr JOIN lg ON lg.event_id = pr.event_id AND lg.model <> primary_model GROUP BY 1),
gp AS (SELECT pr.*, runner_up, round(a.score - b.score, 6) AS gap FROM pr JOIN ru USING (event_id) JOIN lg a ON a.event_id = pr.event_id AND a.model = primary_model JOIN lg b ON b.event_id = pr.event_id AND b.model = runner_up),
tl AS (SELECT *, list_filter(['extract_basic_statistics', 'extract_within_channel_dynamics', CASE WHEN primary_model IN ('arima', 'chronos2') OR (gap <= 0.75 AND runner_up IN ('arima', 'chronos2')) THEN 'extract_forecast_residuals' END,
 CASE WHEN primary_model = 'chronos2' OR (gap <= 0.75 AND runner_up = 'chronos2') OR quantization >= 0.24 OR saturation >= 0.08 THEN 'extract_data_quality' END,
 CASE WHEN primary_model IN ('patchtst', 'itransformer') OR (gap <= 0.75 AND runner_up IN ('patchtst', 'itransformer')) OR segments >= 4 OR dominant <> 'flat' THEN 'extract_event_summary' END], lambda t: t IS NOT NULL) AS tools FROM gp)"""


def features(spark, d):
    e = table(spark, d, "events")
    f = F.struct(*(F.expr(v).alias(k) for k, v in FEATURES.items()), F.expr(DOMINANT).alias("dominant"))
    return e.select("event_id", "user_id", f.alias("f"))


@query(f"WITH {SCORES} SELECT event_id, round(arima, 6) AS arima, round(patchtst, 6) AS patchtst, round(itransformer, 6) AS itransformer, round(chronos2, 6) AS chronos2, primary_model FROM pr")
def c8_c9_model_scores(spark, d):
    s = features(spark, d).withColumn("s", policy.model_scores(F.col("f")))
    return s.select("event_id", *(F.round(f"s.{m}", 6).alias(m) for m in policy.MODELS), policy.primary_model(F.col("f"), F.col("s")).alias("primary_model"))


#: Tools whose features show, by event; null: all.
_SHOWN = "CASE event_id % 6 WHEN 0 THEN array('extract_basic_statistics') WHEN 1 THEN array('extract_within_channel_dynamics', 'extract_forecast_residuals') WHEN 2 THEN array('extract_data_quality') WHEN 3 THEN array('x') WHEN 4 THEN array('extract_basic_statistics', 'extract_within_channel_dynamics', 'extract_forecast_residuals') END"
_MASKED = F_SQL + f""", sh AS (SELECT *, {_SHOWN.replace("array(", "[").replace(")", "]")} AS t FROM (SELECT f.* FROM f)), vis AS (SELECT *, t IS NULL OR list_contains(t, 'extract_basic_statistics') AS vb, t IS NULL OR list_contains(t, 'extract_within_channel_dynamics') AS vw, t IS NULL OR list_contains(t, 'extract_forecast_residuals') AS vr, t IS NULL OR list_contains(t, 'extract_data_quality') AS vq FROM sh),
ms AS (SELECT *, 0.10 + CASE WHEN NOT vb THEN 0 WHEN acf1 >= 0.92 THEN 1.5 WHEN acf1 >= 0.88 THEN 0.75 ELSE 0 END + CASE WHEN vw AND changepoints <= 1 THEN 0.75 ELSE 0 END + CASE WHEN vr AND exceed <= 0.05 THEN 0.5 ELSE 0 END AS arima,
 0.15 + CASE WHEN vw AND peaks BETWEEN 2 AND 5 THEN 1 ELSE 0 END + CASE WHEN vw AND spacing_cv <= 0.30 THEN 0.75 ELSE 0 END + CASE WHEN vb AND acf_seasonal >= 0.05 THEN 0.5 ELSE 0 END AS patchtst,
 CASE WHEN vw AND changepoints >= 2 THEN 1.25 ELSE 0 END + CASE WHEN vb AND cusum >= 70 THEN 0.75 ELSE 0 END + CASE WHEN vw AND monotone >= 0.10 THEN 0.5 ELSE 0 END AS itransformer,
 -0.5 + CASE WHEN vr AND exceed >= 0.08 THEN 0.75 ELSE 0 END + CASE WHEN vq AND (saturation >= 0.08 OR quantization >= 0.24) THEN 0.5 ELSE 0 END + CASE WHEN vw AND peaks >= 6 AND spacing_cv >= 0.35 THEN 0.5 ELSE 0 END AS chronos2 FROM vis)"""


@query(f"""WITH {_MASKED} SELECT event_id, round(arima, 6) AS arima, round(patchtst, 6) AS patchtst, round(itransformer, 6) AS itransformer, round(chronos2, 6) AS chronos2,
 CASE WHEN (vq AND (saturation >= 0.08 OR quantization >= 0.24)) OR (vr AND vw AND exceed >= 0.085 AND peaks >= 6 AND spacing_cv >= 0.40) THEN 'chronos2' WHEN vb AND vw AND vr AND acf1 >= 0.93 AND changepoints <= 1 AND exceed <= 0.05 AND peaks <= 4 THEN 'arima'
 WHEN vw AND changepoints >= 3 AND ((vb AND cusum >= 70) OR monotone >= 0.10) THEN 'itransformer' WHEN vw AND peaks BETWEEN 2 AND 5 AND spacing_cv <= 0.30 THEN 'patchtst'
 ELSE CASE greatest(round(arima, 4), round(patchtst, 4), round(itransformer, 4), round(chronos2, 4)) WHEN round(arima, 4) THEN 'arima' WHEN round(patchtst, 4) THEN 'patchtst' WHEN round(itransformer, 4) THEN 'itransformer' ELSE 'chronos2' END END AS primary_model FROM ms""")
def c8_c9_masked_scores(spark, d):
    m = features(spark, d).withColumn("m", policy.masked_features(F.col("f"), F.expr(_SHOWN)))
    s = m.withColumn("s", policy.model_scores(F.col("m")))
    return s.select("event_id", *(F.round(f"s.{k}", 6).alias(k) for k in policy.MODELS), policy.primary_model(F.col("m"), F.col("s")).alias("primary_model"))


@query(f"""WITH {PLAN}, ev AS (SELECT *, list_filter([CASE WHEN acf1 >= 0.88 THEN 'strong short-lag autocorrelation' END, CASE WHEN acf_seasonal >= 0.05 OR (peaks BETWEEN 2 AND 5 AND spacing_cv <= 0.30) THEN 'repeatable local seasonality' END, CASE WHEN changepoints >= 2 OR cusum >= 70 THEN 'structural drift' END,
 CASE WHEN exceed >= 0.08 THEN 'irregular residual excursions' END, CASE WHEN saturation >= 0.08 OR quantization >= 0.24 THEN 'possible data-quality stress' END, CASE WHEN dominant <> 'flat' THEN dominant || '-dominant event structure' END], lambda e: e IS NOT NULL) AS e FROM tl)
SELECT event_id, CASE WHEN len(e) = 0 THEN 'The window mixes stable and shifting behavior.' ELSE 'The window shows ' || array_to_string(e[:3], ', ') || '.' END || ' ' ||
 CASE WHEN gap <= 0.75 THEN 'I need a broader diagnostic pass to separate the competing temporal explanations before routing.' ELSE 'I will gather the minimum evidence needed to establish a confident routing state.' END || ' I will inspect ' ||
 array_to_string(list_transform(tools, lambda t: CASE t WHEN 'extract_basic_statistics' THEN 'baseline autocorrelation and seasonal strength' WHEN 'extract_within_channel_dynamics' THEN 'local peaks, changepoints, and slope persistence' WHEN 'extract_forecast_residuals' THEN 'linear predictability and residual stress'
  WHEN 'extract_data_quality' THEN 'quantization, saturation, and corruption signals' ELSE 'segment-level rise, fall, and oscillation patterns' END), ', ') || '.' AS rationale FROM ev""")
def c10_rationale(spark, d):
    p = features(spark, d).withColumn("p", policy.plan(F.col("f")))
    return p.select("event_id", policy.rationale(F.col("f"), F.col("p")).alias("rationale"))


@query(f"WITH {PLAN} SELECT event_id, primary_model, runner_up, gap, array_to_string(tools, ',') AS tools, array_to_string(list_transform(range(0, (len(tools) + 1) // 2), lambda i: array_to_string(tools[2 * i + 1:2 * i + 2], '+')), ' ') AS batches FROM tl")
def c10_c11_diagnostic_plan(spark, d):
    p = features(spark, d).withColumn("p", policy.plan(F.col("f")))
    groups = F.array_join(F.transform(policy.batches(F.col("p.tools"), 2), lambda b: F.array_join(b, "+")), " ")
    return p.select("event_id", F.col("p.primary").alias("primary_model"), "p.runner_up", F.round("p.gap", 6).alias("gap"), F.array_join("p.tools", ",").alias("tools"), groups.alias("batches"))


@query(f"""WITH {PLAN} SELECT event_id, CASE WHEN primary_model <> CASE WHEN event_id % 3 = 0 THEN 'arima' ELSE primary_model END THEN 'low' WHEN gap >= 0.25 AND event_id % 50 / 1000.0 >= 0.03 THEN 'high' WHEN gap >= 0.15 AND event_id % 50 / 1000.0 >= 0.01 THEN 'mid' ELSE 'low' END AS tier FROM tl""")
def c14_confidence_tier(spark, d):
    p = features(spark, d).withColumn("p", policy.plan(F.col("f")))
    own = F.col("p.primary")
    teacher = F.when(F.col("event_id") % 3 == 0, " ARIMA").otherwise(own)
    tier = policy.confidence_tier(own, teacher, F.round("p.gap", 6), F.col("event_id") % 50 / 1000.0)
    return p.select("event_id", tier.alias("tier"))


_R = {
    "score": "CASE event_id % 5 WHEN 0 THEN -1.0D WHEN 1 THEN NULL ELSE 0.4D END", "status": "CASE WHEN event_id % 7 = 0 THEN ' Rejected' ELSE 'ok' END",
    "message": "CASE event_id % 4 WHEN 0 THEN 'must not copy input' WHEN 1 THEN 'No Diagnostic turn' ELSE '' END", "format_reason": "CASE event_id % 11 WHEN 0 THEN 'missing_think_open_tag' WHEN 1 THEN 'length_mismatch:2!=3' WHEN 2 THEN 'odd' ELSE 'ok' END",
    "reject_reason": "CASE event_id % 13 WHEN 0 THEN 'missing_answer_block' WHEN 1 THEN 'invalid_answer_shape:lines=2,expected=3' ELSE '' END", "tool_error": "CASE WHEN event_id % 17 = 0 THEN 'boom' ELSE ' ' END",
    "calls": "CAST(user_id % 3 AS BIGINT)", "illegal_calls": "CAST(user_id % 2 AS BIGINT)", "missing": "CAST(event_id % 2 AS BIGINT)", "degraded": "event_id % 3 = 0", "defaulted": "event_id % 19 = 0",
}


@query("WITH r AS (SELECT event_id, " + ", ".join(f"{v.replace('0D', '0::DOUBLE').replace('4D', '4::DOUBLE')} AS {k}" for k, v in _R.items()) + """ FROM events), w AS (SELECT *, CASE WHEN reject_reason <> '' THEN reject_reason WHEN format_reason <> 'ok' THEN format_reason ELSE '' END AS why FROM r)
SELECT event_id, CASE WHEN trim(tool_error) <> '' THEN 'tool_error' WHEN lower(trim(status)) = 'rejected' THEN 'workflow_violation' WHEN why <> '' THEN 'format_failure' WHEN score <= -0.99 THEN 'hard_failure' WHEN degraded THEN 'quality_regression' WHEN defaulted OR missing > 0 THEN 'policy_gap' ELSE 'ok' END AS bucket,
 CASE WHEN trim(tool_error) <> '' THEN 'prediction_tool_error' WHEN lower(trim(status)) = 'rejected' THEN CASE WHEN message LIKE '%copy input%' THEN 'copied_input' WHEN illegal_calls > 0 THEN 'illegal_refinement_tool_call' WHEN calls <> 1 THEN 'prediction_call_count_invalid' WHEN missing > 0 OR lower(message) LIKE '%diagnostic%' THEN 'missing_required_diagnostics' ELSE 'workflow_rejected' END
 WHEN why <> '' THEN CASE WHEN why LIKE 'missing_answer_block%' THEN 'missing_answer_block' WHEN why LIKE 'missing_think%' THEN 'missing_think_block' WHEN why LIKE 'invalid%' THEN 'invalid_answer_shape' WHEN why LIKE 'length%' THEN 'length_mismatch' ELSE why END
 WHEN score <= -0.99 THEN 'negative_one_reward' WHEN degraded THEN 'refinement_degraded' WHEN defaulted THEN 'prediction_model_defaulted' WHEN missing > 0 THEN 'missing_required_diagnostics' ELSE 'ok' END AS reason,
 CASE WHEN trim(tool_error) <> '' THEN 100 WHEN lower(trim(status)) = 'rejected' THEN 95 WHEN why <> '' THEN 85 WHEN score <= -0.99 THEN 80 WHEN degraded THEN 60 WHEN defaulted OR missing > 0 THEN 30 ELSE 0 END::INT AS severity FROM w""")
def c15_diagnosis(spark, d):
    r = F.struct(*(F.expr(v).alias(k) for k, v in _R.items()))
    return table(spark, d, "events").select("event_id", policy.diagnosis(r).alias("d")).select("event_id", "d.*")


#: Tools that ran and that were asked for, by event.
_RAN = "CASE event_id % 4 WHEN 0 THEN array() WHEN 1 THEN array('extract_basic_statistics') WHEN 2 THEN array('extract_event_summary', 'extract_basic_statistics') ELSE array('extract_data_quality') END"
_ASKED = "CASE event_id % 3 WHEN 0 THEN array() WHEN 1 THEN array('extract_event_summary', 'extract_basic_statistics') ELSE array('x', ' ') END"
_LISTS = f"l AS (SELECT event_id, user_id, {_RAN.replace('array()', '[]').replace('array(', '[').replace(')', ']')} AS ran, {_ASKED.replace('array()', '[]').replace('array(', '[').replace(')', ']')} AS asked FROM events)"


@query(f"""WITH {_LISTS}, n AS (SELECT *, list_filter(asked, lambda t: trim(t) <> '') AS a FROM l), k AS (SELECT *, CASE WHEN len(a) = 0 THEN ran WHEN list_contains(a, 'x') THEN a ELSE ['extract_basic_statistics', 'extract_event_summary'] END AS names FROM n),
c AS (SELECT *, len(list_filter(names, lambda t: list_contains(ran, t))) AS hit FROM k)
SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'refinement' WHEN len(names) > 0 AND hit < len(names) THEN 'diagnostic' WHEN len(names) > 0 OR len(ran) > 0 THEN 'routing' ELSE 'diagnostic' END AS stage,
 round(CASE WHEN len(names) = 0 THEN CASE WHEN len(ran) > 0 THEN 1.0 ELSE 0.0 END ELSE hit / len(names) END, 6) AS coverage, greatest(CASE WHEN event_id % 6 = 0 THEN event_id % 4 ELSE greatest(event_id % 9, user_id % 4 + 2) END, 1) AS budget FROM c""")
def c16_c18_c33_turn_state(spark, d):
    ran, asked = (F.expr(v.replace("array()", "cast(array() as array<string>)")) for v in (_RAN, _ASKED))
    e, u = F.col("event_id"), F.col("user_id")
    budget = policy.step_budget(F.when(e % 6 == 0, e % 4), e % 9, u % 4)
    return table(spark, d, "events").select(
        "event_id", policy.turn_stage(u % 5 == 0, ran, asked).alias("stage"), F.round(policy.coverage(ran, asked), 6).alias("coverage"), budget.alias("budget")
    )


@query("""SELECT event_id, event_id % 2 > 0 AND event_id % 3 > 0 AND user_id % 3 = 1 AND event_id % 5 <> 0 AND user_id % 7 = 0 AND event_id % 11 > 0 AS valid,
 CASE WHEN event_id % 2 = 0 THEN -0.5 WHEN event_id % 3 = 0 THEN -0.5 WHEN user_id % 3 <> 1 THEN -0.5 WHEN event_id % 5 = 0 THEN -0.5 WHEN user_id % 7 > 0 THEN -0.5 WHEN event_id % 11 = 0 THEN -1.0 ELSE 0 END AS penalty,
 CASE WHEN event_id % 2 = 0 THEN 1 WHEN event_id % 3 = 0 THEN 2 WHEN user_id % 3 <> 1 THEN 3 WHEN event_id % 5 = 0 THEN 3 WHEN user_id % 7 > 0 THEN 4 WHEN event_id % 11 = 0 THEN 5 ELSE 0 END::INT AS "check" FROM events""")
def c17_workflow(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    r = F.struct(
        (e % 2 > 0).alias("diagnosed"), (e % 3 > 0).alias("predicted"), (u % 3).alias("calls"), F.when(e % 5 == 0, "diagnostic").otherwise(" Routing").alias("stage"),
        (u % 7).alias("illegal_calls"), (e % 11 == 0).alias("copied"),
    )
    return table(spark, d, "events").select("event_id", policy.workflow(r).alias("w")).select("event_id", "w.*")


_LABELS = "CASE event_id % 6 WHEN 0 THEN ' Keep_Default ' WHEN 1 THEN 'override_to_ARIMA' WHEN 2 THEN 'override_to_nobody' WHEN 3 THEN 'override_to_patchtst' WHEN 4 THEN 'other' END"


@query(f"""WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'patchtst' WHEN 1 THEN ' PatchTST' WHEN 2 THEN 'itransformer' ELSE 'x' END AS dflt, {_LABELS} AS label, CASE event_id % 5 WHEN 0 THEN 'override' WHEN 1 THEN 'keep_default' ELSE '' END AS dec, CASE WHEN event_id % 7 = 0 THEN 'chronos2' END AS ov FROM events),
n AS (SELECT *, CASE WHEN dflt = 'x' THEN NULL ELSE lower(trim(dflt)) END AS d, CASE lower(trim(label)) WHEN 'keep_default' THEN 'keep_default' WHEN 'override_to_arima' THEN 'override_to_arima' WHEN 'override_to_patchtst' THEN 'override_to_patchtst' ELSE '' END AS v FROM r),
t AS (SELECT *, coalesce(ov, nullif(regexp_extract(v, '^override_to_(.*)$', 1), '')) AS tg FROM n)
SELECT event_id, v AS label, CASE WHEN d IS NULL OR v = '' THEN NULL WHEN v = 'keep_default' THEN d WHEN dec IN ('', 'override') AND tg <> d THEN tg END AS model, CASE WHEN event_id % 3 = 0 THEN event_id::DOUBLE WHEN event_id % 3 = 1 THEN 0.5 END AS reference_error FROM t""")
def c21_c22_route_resolution(spark, d):
    e = F.col("event_id")
    default = F.when(e % 4 == 0, "patchtst").when(e % 4 == 1, " PatchTST").when(e % 4 == 2, "itransformer").otherwise("x")
    decision = F.when(e % 5 == 0, "override").when(e % 5 == 1, "keep_default").otherwise("")
    route = policy.resolved_route(default, F.expr(_LABELS), decision, F.when(e % 7 == 0, "chronos2"))
    error = policy.first_finite(F.when(e % 3 == 0, e.cast("string")).otherwise("nan"), F.lit("x"), F.when(e % 3 == 1, "0.5"))
    return table(spark, d, "events").select("event_id", policy.route_label(F.expr(_LABELS)).alias("label"), route["model"].alias("model"), error.alias("reference_error"))


@query(f"""WITH {_LISTS}, x AS (SELECT event_id, unnest(CASE event_id % 3 WHEN 0 THEN ['isolated_spike_smoothing', 'local_level_adjust'] WHEN 1 THEN ['local_slope_adjust'] ELSE [] END) AS edit, event_id % 2 = 0 AS res, event_id % 5 = 0 AS dyn FROM l)
SELECT event_id, edit, coalesce(nullif(concat_ws('|', CASE WHEN res THEN CASE edit WHEN 'isolated_spike_smoothing' THEN 'residual_spike_signal' WHEN 'local_level_adjust' THEN 'residual_level_shift' ELSE 'residual_drift_signal' END END,
 CASE WHEN dyn AND edit = 'isolated_spike_smoothing' THEN 'irregular_local_spike' WHEN dyn AND edit = 'local_slope_adjust' THEN 'local_slope_shift' END), ''), 'none') AS signals FROM x""")
def c26_support_signals(spark, d):
    e = F.col("event_id")
    tools = F.array_compact(F.array(F.when(e % 2 == 0, 'extract_forecast_residuals'), F.when(e % 5 == 0, 'extract_within_channel_dynamics')))
    edits = F.when(e % 3 == 0, F.array(F.lit("isolated_spike_smoothing"), F.lit("local_level_adjust"))).when(e % 3 == 1, F.array(F.lit("local_slope_adjust"))).otherwise(F.array().cast("array<string>"))
    s = table(spark, d, "events").select("event_id", F.explode(policy.support_signals(tools, edits)).alias("s"))
    return s.select("event_id", "s.edit", F.array_join("s.signals", "|").alias("signals"))


@query("""WITH q AS (SELECT event_id, event_id % 60 + 1 AS total, event_id % 13 AS want, value FROM events), d AS (SELECT event_id, i, abs(i - greatest(1, least(want, total))) AS gap FROM q, range(1, 61) r(i) WHERE i <= total AND total % i = 0)
SELECT q.event_id, any_value(k.i) AS divisor, round(any_value(value) + 0.25 * greatest(any_value(value) - 100, 0), 6) AS quality FROM q JOIN (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY gap, i DESC) AS n FROM d) k ON k.event_id = q.event_id AND k.n = 1 GROUP BY 1""")
def c28_c29_scores(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select(
        "event_id", policy.batch_divisor(e % 60 + 1, e % 13).alias("divisor"), F.round(policy.quality_score(F.col("value"), F.col("value") - 100), 6).alias("quality")
    )


#: Calls of the users' events, ten to a trajectory and two to a turn, in the words that both engines share.
_CALLS = {
    "name": "CASE event_id * 7 % 11 WHEN 0 THEN 'extract_basic_statistics' WHEN 1 THEN 'extract_within_channel_dynamics' WHEN 2 THEN 'extract_forecast_residuals' WHEN 3 THEN 'extract_data_quality' WHEN 4 THEN 'extract_event_summary' WHEN 5 THEN 'predict_time_series' WHEN 6 THEN 'sum_up' ELSE 'route_time_series' END",
    "decision": "CASE event_id % 4 WHEN 0 THEN 'keep_default' WHEN 1 THEN ' Override' WHEN 2 THEN 'override' END",
    "model": "CASE event_id % 5 WHEN 0 THEN 'ARIMA ' WHEN 1 THEN 'chronos2' WHEN 2 THEN 'nobody' WHEN 3 THEN '' END",
    "works": "event_id % 3 = 0", "stage": "CASE event_id % 13 WHEN 0 THEN ' Routing' WHEN 1 THEN 'diagnostic' WHEN 2 THEN '' END",
}
_REQUIRED = "CASE user_id % 4 WHEN 1 THEN array('extract_basic_statistics') WHEN 2 THEN array('extract_event_summary', 'extract_data_quality', ' ') WHEN 3 THEN CASE WHEN user_id % 8 = 3 THEN array('x') ELSE array(' ') END END"
BUDGET, STEPS_SET = 2, 5
_TOOL_LIST = "['extract_basic_statistics', 'extract_within_channel_dynamics', 'extract_forecast_residuals', 'extract_data_quality', 'extract_event_summary']"
#: The same rules as a loop over calls: one step a call, each verdict changing the state that the next one meets.
FOLD = f"""RECURSIVE e0 AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p FROM events),
e1 AS (SELECT user_id * 1000 + p // 10 AS tid, p % 10 AS pos, p % 10 // 2 AS turn, {", ".join(f"{v} AS {k}" for k, v in _CALLS.items())}, {_REQUIRED.replace("array(", "[").replace(")", "]")} AS req FROM e0),
e2 AS (SELECT *, lower(trim(coalesce(stage, ''))) AS given, lower(trim(coalesce(decision, ''))) AS dec, CASE WHEN trim(coalesce(model, '')) = '' THEN '__missing__' ELSE lower(trim(model)) END AS mdl, name IN ('predict_time_series', 'route_time_series') AS rt, list_contains({_TOOL_LIST}, name) AS kn,
 list_filter(coalesce(req, []::VARCHAR[]), lambda t: trim(t) <> '') AS ask FROM e1),
e AS (SELECT *, CASE WHEN len(list_intersect(ask, {_TOOL_LIST})) > 0 THEN list_filter({_TOOL_LIST}, lambda t: list_contains(ask, t)) ELSE ask END AS need FROM e2),
z AS (SELECT tid, -1 AS pos, -1 AS turn, '' AS by_rule, '' AS stg, NULL::VARCHAR AS refused, []::VARCHAR[] AS seq, 0 AS tries, false AS hit, 0 AS illegal, '' AS asked, '' AS err, 0 AS step, '' AS pst FROM e WHERE pos = 0
 UNION ALL SELECT tid, pos, turn, by_rule, stg, v, CASE WHEN v IS NULL AND NOT rt THEN list_append(seq, name) ELSE seq END, tries + (v IS NULL AND rt)::INT, hit OR (v IS NULL AND rt AND works), illegal + (hit)::INT,
  CASE WHEN v IN ('invalid_decision') THEN '' WHEN rt AND (v IS NULL OR v IN ('invalid_model', 'retry_budget_spent')) THEN want ELSE asked END,
  CASE WHEN v IN ('invalid_decision', 'invalid_model') THEN v WHEN rt AND v IS NULL THEN CASE WHEN works THEN '' ELSE 'prediction_failed' END ELSE err END,
  CASE WHEN v IS NULL AND rt AND works THEN turn + 1 ELSE step END, CASE WHEN v IS NULL AND rt AND works THEN stg ELSE pst END
  FROM (SELECT *, CASE WHEN hit THEN 'call_after_prediction' WHEN rt THEN CASE WHEN stg = 'diagnostic' THEN 'routing_in_diagnostic_turn' WHEN len(seq) = 0 THEN 'no_completed_diagnostic_tool' WHEN name = 'route_time_series' AND dec NOT IN ('keep_default', 'override') THEN 'invalid_decision'
    WHEN want NOT IN ('arima', 'patchtst', 'itransformer', 'chronos2') THEN 'invalid_model' WHEN tries >= {BUDGET} THEN 'retry_budget_spent' END
    WHEN stg = 'routing' THEN 'feature_tool_in_routing_turn' WHEN list_contains(seq, name) THEN 'duplicate_feature_tool' WHEN NOT kn THEN 'unknown_tool' END AS v
   FROM (SELECT *, CASE WHEN given <> '' THEN given ELSE by_rule END AS stg, CASE WHEN name = 'predict_time_series' OR dec = 'override' THEN mdl WHEN dec = 'keep_default' THEN 'patchtst' ELSE '' END AS want
    FROM (SELECT z.tid, e.pos, e.turn, CASE WHEN e.turn = z.turn THEN z.by_rule WHEN hit THEN 'refinement' WHEN len(need) = 0 THEN CASE WHEN len(seq) > 0 THEN 'routing' ELSE 'diagnostic' END WHEN len(list_filter(need, lambda t: NOT list_contains(seq, t))) > 0 THEN 'diagnostic' ELSE 'routing' END AS by_rule,
     given, name, dec, mdl, rt, kn, works, seq, tries, hit, illegal, asked, err, step, pst FROM z JOIN e ON e.tid = z.tid AND e.pos = z.pos + 1))))"""


def tool_calls(spark, d):
    """Calls and required tools of the users' events."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    n = numbered(e, "ts", "event_id", by=("user_id",), name="p")
    part, p = F.floor(F.col("p") / 10), F.col("p") % 10
    calls = n.select(
        (F.col("user_id") * 1000 + part).alias("series_id"), "user_id", p.alias("pos"), F.floor(p / 2).cast("long").alias("turn"), *(F.expr(v).alias(k) for k, v in _CALLS.items())
    )
    calls = kept(calls)
    required = calls.groupBy("series_id").agg(F.first("user_id").alias("user_id")).select("series_id", F.expr(_REQUIRED).alias("required"))
    return calls.drop("user_id"), required


@query(f"WITH {FOLD} SELECT tid AS series_id, pos, stg AS stage, refused, tries AS attempts FROM z WHERE pos >= 0")
def c32_tool_gate(spark, d):
    calls, required = tool_calls(spark, d)
    return trajectories.gated(calls, required, BUDGET, "patchtst").select("series_id", "pos", "stage", "refused", "attempts")


@query(f"""WITH {FOLD}, f AS (SELECT z.*, e.name, e.need, ask, list_filter({_TOOL_LIST}, lambda t: list_contains(seq, t)) AS ex FROM z JOIN e USING (tid, pos)),
l AS (SELECT tid, turn, arg_max({{'a': tries, 'h': hit, 'i': illegal, 'q': asked, 'r': err, 's': step, 't': pst, 'u': seq, 'x': ex, 'n': CASE WHEN len(ask) = 0 THEN ex ELSE need END}}, pos) AS s, arg_min(stg, pos) AS stage, string_agg(name, '->' ORDER BY pos) AS calls, count(*) AS c, count(refused) AS rc FROM f GROUP BY 1, 2),
m AS (SELECT *, len(list_filter(s.n, lambda t: NOT list_contains(s.x, t))) AS miss FROM l)
SELECT tid AS series_id, turn, stage AS turn_stage, calls AS tool_call_sequence, c AS tool_call_count, rc AS refused_calls, s.a AS attempts, s.h::INT AS prediction_calls, s.i AS illegal_calls, s.q AS requested_model, s.r AS tool_error, s.s AS prediction_step, s.t AS prediction_stage,
 CASE WHEN len(s.u) = 0 THEN 'none' ELSE array_to_string(s.u, '->') END AS feature_tool_signature, len(s.u) AS feature_tool_count, CASE WHEN len(s.n) = 0 THEN 'none' ELSE array_to_string(s.n, '->') END AS required_signature, len(s.n) AS required_count, miss AS missing,
 CASE WHEN len(s.x) = 0 THEN 'none' ELSE array_to_string(s.x, '|') END AS analysis_signature, round(CASE WHEN len(s.n) = 0 THEN 0.0 ELSE (len(s.n) - miss) / len(s.n) END, 6) AS coverage, {max(STEPS_SET, BUDGET + 2)} AS step_budget,
 CASE WHEN s.r <> '' THEN 'tool_error' WHEN miss > 0 THEN 'policy_gap' ELSE 'ok' END AS debug_bucket, CASE WHEN s.r <> '' THEN 'prediction_tool_error' WHEN miss > 0 THEN 'missing_required_diagnostics' ELSE 'ok' END AS debug_reason, CASE WHEN s.r <> '' THEN 100 WHEN miss > 0 THEN 30 ELSE 0 END AS debug_severity FROM m""")
def c30_turn_log(spark, d):
    calls, required = tool_calls(spark, d)
    return trajectories.turn_log(calls, required, BUDGET, "patchtst", STEPS_SET).withColumn("coverage", F.round("coverage", 6))


@query("""SELECT event_id, array_to_string(list_transform(list_sort([{'a': -(event_id % 5), 'b': event_id % 3, 'c': 'level'}, {'a': -(event_id % 4), 'b': event_id % 2, 'c': 'mean'}, {'a': -(user_id % 3), 'b': 1, 'c': 'trend'}, {'a': -2, 'b': 2, 'c': 'step'}])[:2], lambda s: s.c), ',') AS shown FROM events""")
def k20_top_gains(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    gains = F.array(*(
        F.struct(F.lit(n).alias("name"), g.cast("long").alias("gain"), b.cast("long").alias("gap"))
        for n, g, b in (("level", e % 5, e % 3), ("mean", e % 4, e % 2), ("trend", u % 3, F.lit(1)), ("step", F.lit(2), F.lit(2)))
    ))
    return table(spark, d, "events").select("event_id", F.array_join(policy.top_gains(gains), ",").alias("shown"))
