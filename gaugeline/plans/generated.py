"""Registered queries of renderers, generators, sources, streams and SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy, render, udfs
from ..operators import forecasts, generators
from ..operators import windows as win
from ..sources import files
from ..sources.tables import series, table
from ..streaming import features as streams
from ..streaming import state
from .policies import F_SQL, PLAN, features
from .queries import CURRICULUM, TYPES, USERS, query
from .rewards import EDITS, N, PAIRS, pairs, r

# --- renderers ---------------------------------------------------------------------------------------


def _blocks(spark, d, size):
    """Whole user series, ``size`` rows to a block."""
    s = series(spark, d, "user_id").withColumn("date", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return s.withColumn("key", F.struct("series_id", F.floor(F.col("pos") / size).alias("block")))


@query(f"""WITH {USERS}, l AS (SELECT series_id, string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S') || ' a=' || printf('%.4f', value) || ' OT=' || printf('%.4f', value / 2), chr(10) ORDER BY pos) AS h, pos // 4 AS block FROM s GROUP BY series_id, pos // 4)
SELECT series_id, block, '[Task] Multivariate time-series forecasting.' || chr(10) || 'Target Column: OT' || chr(10) || 'Observed Covariates: a' || chr(10) || 'Lookback Window: 4' || chr(10) || 'Forecast Horizon: 2' || chr(10) || 'Requirements:' || chr(10) || '1) Look.' || chr(10) || '2) Say.' || chr(10) || 'Historical Data:' || chr(10) || h AS prompt FROM l""")
def t27_prompt(spark, d):
    s = _blocks(spark, d, 4).withColumns({"a": F.col("value"), "OT": F.col("value") / 2})
    h = render.named_rows(s, "key", "pos", "date", ["a", "OT"])
    p = render.task_prompt("Multivariate time-series forecasting.", F.lit("OT"), F.array(F.lit("a")), F.lit(4), F.lit(2), ["Look.", "Say."], F.col("text"))
    return h.select("key.series_id", "key.block", p.alias("prompt"))


@query(f"""WITH {USERS} SELECT series_id, string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || printf('%.4f', value), chr(10) ORDER BY pos) AS truth, pos // 5 AS block FROM s GROUP BY series_id, pos // 5""")
def t28_truth(spark, d):
    return render.value_rows(_blocks(spark, d, 5), "key", "pos", "date", "value", "truth").select("key.series_id", "key.block", "truth")


_WRITTEN = "list_transform(x, lambda v: printf('%.4f', v))"
WRITTEN = f"{PAIRS}, f AS (SELECT series_id, start, x, {_WRITTEN} AS t FROM w)"


def written(spark, d):
    return pairs(spark, d).withColumn("t", render.fixed(F.col("x"))).withColumn("s", render.summary_numbers(F.col("x")))


@query(f"""WITH {WRITTEN} SELECT series_id, start, array_to_string(list_transform(range(1, {N + 1}), lambda i: strftime(CASE WHEN start % 2 = 0 THEN TIMESTAMP '2000-01-01' ELSE TIMESTAMP '2024-02-28 20:00:00' END + to_hours(i::INT), '%Y-%m-%d %H:%M:%S') || ' ' || t[i]), chr(10)) AS forecast,
 array_to_string(t[:3], ', ') || ' ... ' || array_to_string(t[-3:], ', ') AS preview, 'Model: m' || chr(10) || 'Start Timestamp: s' || chr(10) || 'Frequency Hours: 1' || chr(10) || 'Forecast Values:' || chr(10) || array_to_string(t, chr(10)) AS compact FROM f""")
def t29_t30_t34_forecast_texts(spark, d):
    anchor = F.when(F.col("start") % 2 == 1, F.lit("2024-02-28 20:00:00").cast("timestamp"))
    return written(spark, d).select(
        "series_id", "start", render.forecast_text(F.col("t"), anchor).alias("forecast"), render.preview(F.col("t")).alias("preview"),
        render.compact(F.lit("m"), F.lit("s"), F.col("t")).alias("compact"),
    )


@query(f"""WITH {WRITTEN}, q AS (SELECT *, round(list_avg(x), 2) AS m FROM f) SELECT series_id, start, 'Head Values: ' || array_to_string(t[:6], ', ') AS head, 'min=' || printf('%.4f', list_min(x)) || ', max=' || printf('%.4f', list_max(x)) || ', net_change=' || printf('%.4f', x[{N}] - x[1]) AS middle FROM q""")
def t30_selection_preview(spark, d):
    p = render.selection_preview(F.lit("m"), F.size("x"), F.col("s"), F.col("t"))
    shown = written(spark, d).withColumn("p", p)
    return shown.select("series_id", "start", F.regexp_extract("p", "(Head Values: .*)", 1).alias("head"), F.regexp_extract("p", "(min=.*), mean_abs_step", 1).alias("middle"))


@query("""WITH q AS (SELECT event_id, value, event_id % 3 AS k FROM events) SELECT event_id, '### Routing Evidence Card' || chr(10) || 'observed_tools=[' || CASE k WHEN 0 THEN 'none' ELSE 'extract_basic_statistics' END || ']' || chr(10) || 'tool_fields:' || CASE k WHEN 0 THEN '' ELSE chr(10) || '- extract_basic_statistics: acf1=' || CASE WHEN value >= 100 THEN printf('%.1f', value) ELSE printf('%.4f', value) END || ', cusum_max=0.5000' END
 || chr(10) || 'missing_tool_groups=[' || CASE k WHEN 0 THEN 'extract_basic_statistics, extract_data_quality' ELSE 'extract_data_quality' END || ']' AS card FROM q""")
def t31_evidence_card(spark, d):
    ran = F.when(F.col("event_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("extract_basic_statistics")))
    groups = {"extract_basic_statistics": [("acf1", 0), ("cusum_max", 1)], "extract_data_quality": [("saturation_ratio", 1)]}
    e = table(spark, d, "events").withColumn("n", render.evidence_numbers(F.array("value", F.lit(0.5))))
    return e.select("event_id", render.evidence_card(ran, groups, F.col("n")).alias("card"))


_RAN = "CASE event_id % 5 WHEN 0 THEN array('extract_basic_statistics') WHEN 1 THEN array('extract_event_summary', 'extract_data_quality') WHEN 2 THEN cast(array() as array<string>) WHEN 3 THEN array('extract_within_channel_dynamics', 'extract_forecast_residuals') ELSE array('extract_basic_statistics', 'extract_within_channel_dynamics', 'extract_forecast_residuals', 'extract_data_quality', 'extract_event_summary') END"
_RAN_SQL = _RAN.replace("cast(array() as array<string>)", "[]::VARCHAR[]").replace("array(", "[").replace("')", "']")
_NUM = lambda c: f"CASE WHEN abs({c}) >= 100 THEN printf('%.1f', {c}) ELSE printf('%.4f', {c}) END"


def _card_sql(tool: str) -> str:
    fields = " || ', ' || ".join(f"'{n}=' || " + (f if f == "dominant" else _NUM(f)) for n, f in render.CARD_FIELDS[tool])
    return f"CASE WHEN list_contains(ran, '{tool}') THEN chr(10) || '- {tool}: ' || {fields} ELSE '' END"


@query(f"""WITH {F_SQL}, q AS (SELECT *, {_RAN_SQL} AS ran FROM f) SELECT event_id, '### Routing Evidence Card' || chr(10) || 'observed_tools=[' || CASE WHEN len(ran) = 0 THEN 'none' ELSE array_to_string(ran, ', ') END || ']' || chr(10) || 'tool_fields:' || {" || ".join(map(_card_sql, render.CARD_FIELDS))}
 || chr(10) || 'missing_tool_groups=[' || coalesce(nullif(array_to_string(list_filter({list(render.CARD_FIELDS)}, lambda t: NOT list_contains(ran, t)), ', '), ''), 'none') || ']' AS card FROM q""")
def t31_routing_card(spark, d):
    return features(spark, d).select("event_id", render.routing_card(F.col("f"), F.expr(_RAN)).alias("card"))


_SAID = {"local_level_adjust": "shift the level", "local_slope_adjust": "turn the slope"}


@query(f"""WITH q AS (SELECT event_id, event_type, {_RAN_SQL} AS ran, event_id % 2 = 0 AS may FROM events) SELECT event_id, '### Refinement Evidence Card' || CASE WHEN event_id % 7 = 0 THEN '' ELSE chr(10) || 'selected_model=' || event_type END || chr(10) || 'observed_tools=[' || CASE WHEN len(ran) = 0 THEN 'none' ELSE array_to_string(ran, ', ') END || ']'
 || chr(10) || 'keep_support=[' || CASE WHEN may THEN 'stable' ELSE 'none' END || ']' || chr(10) || 'support_signals=[' || CASE WHEN event_id % 3 = 0 THEN 'drift, shift' ELSE 'evidence_consistent' END || ']' || chr(10) ||
 CASE event_id % 3 WHEN 0 THEN 'edit_support:' || chr(10) || '- local_level_adjust=shift the level; support=[shift]' || chr(10) || '- isolated_spike_smoothing=isolated spike smoothing; support=[none]' WHEN 1 THEN 'edit_support:' || chr(10) || '- local_slope_adjust=turn the slope; support=[drift, shift]' ELSE 'candidate_adjustments=[none]' END
 || chr(10) || 'decision_options=[' || array_to_string(list_concat(CASE event_id % 3 WHEN 0 THEN ['local_level_adjust', 'isolated_spike_smoothing'] WHEN 1 THEN ['local_slope_adjust'] ELSE []::VARCHAR[] END, CASE WHEN may THEN ['keep_baseline'] ELSE []::VARCHAR[] END), ', ') || ']' || chr(10) || 'keep_baseline_allowed=' || CASE WHEN may THEN 'yes' ELSE 'no' END AS card FROM q""")
def t31_refinement_card(spark, d):
    e, none = F.col("event_id"), F.array().cast("array<string>")
    edit = lambda name, *s: F.struct(F.lit(name).alias("edit"), (F.array(*map(F.lit, s)) if s else none).alias("signals"))
    edits = (
        F.when(e % 3 == 0, F.array(edit("local_level_adjust", "shift"), edit("isolated_spike_smoothing"))).when(e % 3 == 1, F.array(edit("local_slope_adjust", "drift", "shift")))
        .otherwise(F.array().cast("array<struct<edit:string,signals:array<string>>>"))
    )
    card = render.refinement_card(
        F.when(e % 7 != 0, F.col("event_type")), F.expr(_RAN), F.when(e % 2 == 0, F.array(F.lit("stable"))).otherwise(none),
        F.when(e % 3 == 0, F.array(F.lit("drift"), F.lit("shift"))).otherwise(none), edits, e % 2 == 0, _SAID,
    )
    return table(spark, d, "events").select("event_id", card.alias("card"))


@query("SELECT event_id, 'Data Quality:' || chr(10) || '  Quantization Score: ' || printf('%.4f', value) || chr(10) || '  Saturation Ratio: 0.2500' || chr(10) || '  Constant Channel Ratio: 0.0000' || chr(10) || '  Dropout Ratio: ' || printf('%.4f', value / 3) AS shown FROM events")
def t32_feature_text(spark, d):
    e = table(spark, d, "events").withColumn("n", render.fixed(F.array("value", F.lit(0.25), F.lit(0.0), F.col("value") / 3)))
    return e.select("event_id", render.feature_text("Data Quality", F.col("n")).alias("shown"))


#: Features of each tool's text, by event, in the words that both engines share; the lists follow the labels.
_TOLD = {
    "Basic Statistics": ("value", "value / 2", "NULL", "0.125", "event_id % 7 / 16.0", "value / 8", "value * 3", "1.5"),
    "Within-Channel Dynamics": ("event_id % 6", "value / 3", "value", "value * 2", "0.25", "event_id % 9", "value / 16", "0.5"),
    "Forecast Residuals": ("-value / 100", "value", "event_id % 10 / 10.0", "0.75", "value / 1000"),
    "Data Quality": ("event_id % 4 / 4.0", "0.0625", "0", "value / 5"),
    "Event Summary": ("event_id % 8", "event_id % 5", "1", "2", "event_id % 3"),
}


def _told_sql(title: str) -> str:
    lines = []
    for name, value in zip(render.LABELS[title], _TOLD[title]):
        lines.append(f"'  {name}: ' || printf('%.{1 if name in render.COUNTS else 4}f', coalesce(({value})::DOUBLE, 0))")
    if title == "Event Summary":
        lines.append("'  Dominant Pattern: ' || CASE event_id % 4 WHEN 0 THEN 'rise' WHEN 1 THEN 'fall' WHEN 2 THEN 'flat' ELSE 'oscillation' END")
    return f"SELECT event_id, '{title}' AS title, '{title}:' || chr(10) || " + " || chr(10) || ".join(lines) + " AS shown FROM events"


@query(" UNION ALL ".join(map(_told_sql, _TOLD)))
def t32_tool_texts(spark, d):
    out = None
    for title, values in _TOLD.items():
        pattern = F.col("event_id") % 4 if title == "Event Summary" else None
        told = render.tool_text(title, F.array(*(F.expr(v).cast("double") for v in values)), pattern)
        rows = table(spark, d, "events").select("event_id", F.lit(title).alias("title"), told.alias("shown"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""SELECT event_id, '<think>' || chr(10) || 'I keep ' || event_type || chr(10) || '</think>' || chr(10) || '<answer>' || chr(10) || CASE WHEN event_id % 2 = 0 THEN 'decision=' || CASE WHEN event_id % 3 = 0 THEN 'keep_baseline' ELSE 'local_level_adjust' END ELSE '1.0' END || chr(10) || '</answer>' AS answer,
 '### Task' || chr(10) || event_type || CASE WHEN event_id % 2 = 0 THEN '' ELSE chr(10) || chr(10) || '### Evidence' || chr(10) || 'e' END AS prompt FROM events""")
def t38_t39_prompts_and_targets(spark, d):
    e, said = F.col("event_id"), F.concat(F.lit("I keep "), "event_type")
    choice = F.when(e % 3 == 0, " ").otherwise("local_level_adjust")
    answer = F.when(e % 2 == 0, render.target_answer(said, choice, F.lit("1.0"), True)).otherwise(render.target_answer(said, choice, F.lit("1.0"), False))
    prompt = render.section_prompt([("Task", F.col("event_type")), ("Evidence", F.when(e % 2 == 0, "").otherwise("e"))])
    return table(spark, d, "events").select("event_id", answer.alias("answer"), prompt.alias("prompt"))


# --- generators --------------------------------------------------------------------------------------------


@query(f"""WITH {PLAN}, n AS (SELECT event_id, tools, (len(tools) + 1) // 2 AS b FROM tl), x AS (SELECT event_id, b + 2 AS turn_count, i AS stage_order, CASE WHEN i < b THEN 'diagnostic' WHEN i = b THEN 'routing' ELSE 'refinement' END AS stage, CASE WHEN i < b THEN i ELSE -1 END AS batch, CASE WHEN i < b THEN array_to_string(tools[2 * i + 1:2 * i + 2], ',') ELSE '' END AS tools FROM n, range(0, 9) r(i) WHERE i < b + 2)
SELECT * FROM x""")
def g1_w18_stage_rows(spark, d):
    p = features(spark, d).select("event_id", policy.plan(F.col("f"))["tools"].alias("own"))
    rows = generators.stage_rows(p, F.col("own"), 2)
    return rows.select("event_id", F.col("turn_count").cast("long"), F.col("stage_order").cast("long"), "stage", F.col("batch").cast("long"), F.array_join("tools", ",").alias("tools"))


@query(f"""WITH {PLAN}, n AS (SELECT event_id, tools, (len(tools) + 1) // 2 AS b FROM tl) SELECT event_id, 'all' AS mode, b + 2 AS turn_count, i AS stage_order, CASE WHEN i < b THEN 'diagnostic' WHEN i = b THEN 'routing' ELSE 'final_select' END AS stage FROM n, range(0, 9) r(i) WHERE i < b + 2 UNION ALL SELECT event_id, 'final', 1, 0, 'final_select' FROM n""")
def g2_bank_rows(spark, d):
    p = features(spark, d).select("event_id", policy.plan(F.col("f"))["tools"].alias("own"))
    made = [generators.bank_rows(p, F.col("own"), 2, only).select("event_id", F.lit(m).alias("mode"), F.col("turn_count").cast("long"), F.col("stage_order").cast("long"), "stage") for m, only in (("all", False), ("final", True))]
    return made[0].unionByName(made[1])


@query(f"""WITH {EDITS}, c AS (SELECT series_id, start, x, hist, sp, level, slope FROM k2) SELECT series_id, start, 'patchtst__keep' AS candidate_id, 'default' AS path, round(x[{N}], 6) AS last FROM c UNION ALL SELECT series_id, start, 'naive__keep', 'alternative', round(hist[{N}], 6) FROM c
 UNION ALL SELECT series_id, start, 'patchtst__local_level_adjust', 'default', round(x[{N}] + level, 6) FROM c WHERE level IS NOT NULL UNION ALL SELECT series_id, start, 'patchtst__local_slope_adjust', 'default', round(x[{N}] + 11 * slope, 6) FROM c WHERE slope IS NOT NULL
 UNION ALL SELECT series_id, start, 'patchtst__isolated_spike_smoothing', 'default', round(x[{N}], 6) FROM c WHERE len(sp) > 0""")
def g3_g4_candidates(spark, d):
    w = pairs(spark, d).select("series_id", "start", F.create_map(F.lit("patchtst"), F.col("y"), F.lit("naive"), F.array_repeat(F.element_at("x", -1), N)).alias("f"), F.col("x").alias("h"), F.lit("patchtst").alias("dflt"))
    c = generators.candidates(w, "f", "h", "dflt")
    return c.select("series_id", "start", "candidate_id", "path", r(F.element_at("values", -1)).alias("last"))


@query("SELECT event_id, 'b' || event_id AS kept, CASE WHEN event_id % 2 = 0 THEN 'e' END AS edited, 1 + (event_id % 2 = 0)::INT AS n FROM events")
def g5_decision_texts(spark, d):
    edit = F.struct(F.lit("local_level_adjust").alias("op"), F.lit("e").alias("text"))
    edits = F.when(F.col("event_id") % 2 == 0, F.array(edit)).otherwise(F.array().cast("array<struct<op:string,text:string>>"))
    m = generators.decision_texts(F.concat(F.lit("b"), F.col("event_id").cast("string")), edits)
    e = table(spark, d, "events").select("event_id", m.alias("m"))
    return e.select("event_id", F.col("m")["keep_baseline"].alias("kept"), F.try_element_at("m", F.lit("local_level_adjust")).alias("edited"), F.size("m").cast("long").alias("n"))


@query(f"""WITH {PAIRS}, b AS (SELECT series_id, start, x, y, list_transform(range(1, {N + 1}), lambda i: CASE WHEN i > {N} - 2 THEN 0.5 * (x[i] + y[i]) ELSE x[i] END) AS e1, list_transform(range(1, {N + 1}), lambda i: CASE WHEN i > {N} - 3 THEN 0.3 * x[i] + 0.7 * y[i] ELSE x[i] END) AS e2 FROM w),
m AS (SELECT *, list_avg(list_transform(range(1, {N + 1}), lambda i: (x[i] - y[i]) ** 2)) AS m0, list_avg(list_transform(range(1, {N + 1}), lambda i: (e1[i] - y[i]) ** 2)) AS m1, list_avg(list_transform(range(1, {N + 1}), lambda i: (e2[i] - y[i]) ** 2)) AS m2,
 list_avg(list_transform(range(1, {N + 1}), lambda i: abs(x[i] - y[i]))) AS a0, list_avg(list_transform(range(1, {N + 1}), lambda i: abs(e1[i] - y[i]))) AS a1, list_avg(list_transform(range(1, {N + 1}), lambda i: abs(e2[i] - y[i]))) AS a2 FROM b),
o AS (SELECT *, (m0 - m1 > greatest(1e-6, 0.005 * m0) OR a0 - a1 > greatest(1e-6, 0.005 * a0)) AND m0 - m1 > 1e-8 AS ok1, (m0 - m2 > greatest(1e-6, 0.005 * m0) OR a0 - a2 > greatest(1e-6, 0.005 * a0)) AND m0 - m2 > 1e-8 AS ok2 FROM m)
SELECT series_id, start, CASE WHEN ok1 AND ok2 THEN CASE WHEN m1 - m2 > 1e-8 THEN 'second' ELSE 'first' END WHEN ok1 THEN 'first' WHEN ok2 THEN 'second' ELSE 'keep_baseline' END AS target FROM o""")
def g6_target_builder(spark, d):
    mix = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    w = pairs(spark, d).withColumn("z", F.zip_with("x", "y", mix))
    edit = lambda name, k, q: F.struct(F.lit(name).alias("op"), F.transform("z", lambda v, i: F.when(i >= N - k, (1 - q) * v["a"] + q * v["b"]).otherwise(v["a"])).alias("values"))
    w = w.withColumn("edits", F.array(edit("first", 2, 0.5), edit("second", 3, 0.7)))
    best = generators.best_edit(F.col("x"), F.col("edits"), F.col("y"))
    return w.select("series_id", "start", F.coalesce(best["op"], F.lit("keep_baseline")).alias("target"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'extract_basic_statistics=v' || user_id ELSE 'extract_basic_statistics=v' || user_id || '|extract_event_summary=w' END AS results FROM events")
def g8_tool_results(spark, d):
    k = F.col("event_id") % 3
    ran = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit(policy.TOOLS[0]))).otherwise(F.array(F.lit(policy.TOOLS[4]), F.lit(policy.TOOLS[0])))
    made = generators.tool_results(ran, {policy.TOOLS[0]: F.concat(F.lit("v"), F.col("user_id").cast("string")), policy.TOOLS[4]: F.lit("w")})
    return table(spark, d, "events").select("event_id", F.array_join(F.transform(made, lambda t: F.concat(t["tool"], F.lit("="), t["text"])), "|").alias("results"))


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN CASE conv_id % 3 WHEN 0 THEN 'diagnostic_missing_tool_call' WHEN 1 THEN 'diagnostic_duplicate_tool_call|diagnostic_unexpected_tool_call:b,b' ELSE '' END WHEN 1 THEN CASE conv_id % 3 WHEN 0 THEN 'routing_tool_calls=' WHEN 1 THEN 'routing_tool_calls=b,b' ELSE 'routing_tool_calls=a' END
 ELSE CASE WHEN conv_id % 2 = 0 THEN 'refinement_protocol_reject:missing_think_block|' ELSE '' END || 'refinement_answer_lines=2' END AS issues FROM conversations""")
def g9_inspection(spark, d):
    c, t = F.col("conv_id"), F.col("turn") % 3
    stage = F.when(t == 0, "diagnostic").when(t == 1, "routing").otherwise("refinement")
    calls = F.when(c % 3 == 0, F.array().cast("array<string>")).when(c % 3 == 1, F.array(F.lit("b"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    found = generators.issues(stage, calls, F.array(F.lit("a")), F.when(c % 2 == 0, "missing_think_block"), F.lit(2), F.lit(3))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(found, "|").alias("issues"))


@query("SELECT user_id AS series_id, 'history of ' || count(*) || ' points' AS error FROM events GROUP BY 1 HAVING count(*) <> 60")
def g10_annotation_errors(spark, d):
    x = series(spark, d, "user_id").groupBy("series_id").agg(F.collect_list("value").alias("x"))
    return forecasts.predict(x, "x", ["naive"], 4, lookback=60).where("error is not null").select("series_id", "error")


@query("SELECT event_id, k, v FROM (SELECT event_id, 'a' AS k, value AS v FROM events UNION ALL SELECT event_id, 'b', value / 2 FROM events)")
def g7_score_map(spark, d):
    m = F.from_json(F.to_json(F.create_map(F.lit("a"), F.struct(F.col("value").alias("mse")), F.lit("b"), F.struct((F.col("value") / 2).alias("mse")))), "map<string,struct<mse:double>>")
    return table(spark, d, "events").select("event_id", F.explode(m).alias("k", "s")).select("event_id", "k", F.col("s.mse").alias("v"))


# --- sources and sinks ------------------------------------------------------------------------------------------


@query("WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1) SELECT row_number() OVER (ORDER BY day) - 1 AS pos, CAST(day AS VARCHAR) AS date, value AS target FROM o ORDER BY day LIMIT 100")
def s1_s2_csv_head(spark, d):
    daily = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.round(F.sum("o_totalprice"), 2).alias("target"))
    path = files.scratch(spark, "csv")
    daily.write.csv(path, header=True)
    rows = files.read_csv(spark, path, "date date, target double", ("date", "target"))
    return files.first_rows(rows, "date", 100, ["date", "target"]).select("pos", F.col("date").cast("string"), "target")


@query("SELECT CASE WHEN event_id % 3 = 0 THEN user_id ELSE event_type_no END AS _key, max(event_id) AS event_id FROM (SELECT *, CASE event_type WHEN 'click' THEN 1000 WHEN 'view' THEN 1001 ELSE -1 END AS event_type_no FROM events) WHERE CASE WHEN event_id % 3 = 0 THEN user_id ELSE event_type_no END >= 0 GROUP BY 1")
def s3_s4_jsonl_keyed(spark, d):
    kind = F.when(F.col("event_type") == "click", 1000).when(F.col("event_type") == "view", 1001).otherwise(-1)
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("sample_index"), kind.alias("index"))
    path = files.scratch(spark, "jsonl")
    files.write_jsonl(rows.repartitionByRange(4, "event_id").sortWithinPartitions("event_id"), path)  # files in the order of their names
    back = files.read_lines(spark, path, "event_id long, sample_index long, index long")
    return files.keyed(back, "sample_index", "index").select("_key", "event_id")


@query("SELECT coalesce(k, line) AS _key, arg_max(event_id, line) AS event_id FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 7 END AS k, row_number() OVER (ORDER BY event_id) - 1 AS line FROM events) GROUP BY 1")
def s5_jsonl_positional(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, 7).alias("index"))
    path = files.scratch(spark, "jsonl")
    files.write_jsonl(rows.repartitionByRange(4, "event_id").sortWithinPartitions("event_id"), path)  # files in the order of their names
    back = files.read_lines(spark, path, "event_id long, index long")
    return files.keyed(back, "index", default_to_line=True).select("_key", "event_id")


@query("SELECT conv_id, turn FROM conversations WHERE lower(role) = 'user'")
def s6_s8_stage_scan(spark, d):
    path = files.scratch(spark, "parquet")
    c = table(spark, d, "conversations")
    files.write_checked(c, path, c.where("conv_id is null"))
    return files.read_stage(spark, path, "USER", "role").select("conv_id", "turn")


@query("SELECT 'appended' AS what, 2 * count(*) AS n FROM region UNION ALL SELECT 'written', count(*) FROM region UNION ALL SELECT 'step 1', count(*) FROM region UNION ALL SELECT 'step 2', count(*) FROM region")
def s7_s10_s11_sinks(spark, d):
    rows, log, dump = table(spark, d, "region"), files.scratch(spark, "log"), files.scratch(spark, "dump")
    n = files.write_jsonl(rows, log)
    files.write_jsonl(rows, log, "append")
    files.write_generations(rows.withColumn("step", F.explode(F.array(F.lit(1), F.lit(2)))), dump)
    appended = files.read_jsonl(spark, log, "r_regionkey long").agg(F.lit("appended").alias("what"), F.count("*").alias("n"))
    steps = spark.read.json(dump).groupBy("step").agg(F.count("*").alias("n")).select(F.concat(F.lit("step "), F.col("step").cast("string")).alias("what"), "n")
    return appended.unionByName(spark.createDataFrame([("written", n)], "what string, n long")).unionByName(steps)


@query(CURRICULUM + "SELECT phase, count(*) AS windows FROM staged, (VALUES ('stage1'), ('stage12'), ('stage123'), ('full')) p(phase) WHERE phase = 'full' OR stage = 'easy' OR (phase IN ('stage12', 'stage123') AND stage = 'medium') OR (phase = 'stage123' AND stage = 'hard') GROUP BY 1")
def s14_s15_phases(spark, d):
    w = win.curriculum(series(spark, d)).select("stage")
    out = None
    for phase in files.parse_phases(" Stage1,stage12,,STAGE123,full,stage1"):
        n = files.phase_rows(w, phase, True, "stage").agg(F.lit(phase).alias("phase"), F.count("*").alias("windows"))
        out = n if out is None else out.unionByName(n)
    return out


@query("SELECT 'c_mktsegment=' || c_mktsegment AS folder, sha256(string_agg(c_name || chr(10), '' ORDER BY c_custkey)) AS sha256, sum(length(c_name) + 1)::BIGINT AS length FROM customer GROUP BY c_mktsegment")
def s18_digests(spark, d):
    path = files.scratch(spark, "text")
    c = table(spark, d, "customer").repartition("c_mktsegment").sortWithinPartitions("c_mktsegment", "c_custkey")
    c.select("c_mktsegment", "c_name").write.partitionBy("c_mktsegment").text(path)
    return files.digests(spark, f"{path}/*/*.txt").select("folder", "sha256", "length")


#: Metadata of the line items as a table of several channels, and what its contract asks.
_CHANNELS = ("l_discount", "l_extendedprice", "l_quantity", "l_tax")


@query("""SELECT * FROM (SELECT 'rows' AS field, count(*)::VARCHAR AS value FROM lineitem UNION ALL SELECT 'target_column', 'l_quantity' UNION ALL SELECT 'model_input_width', count(*)::VARCHAR FROM (DESCRIBE lineitem) WHERE column_type = 'DOUBLE'
 UNION ALL SELECT 'observed_covariates', string_agg(column_name, ',' ORDER BY column_name) FROM (DESCRIBE lineitem) WHERE column_type = 'DOUBLE' AND column_name <> 'l_quantity'
 UNION ALL SELECT 'refused', 'dataset_kind,pipeline_stage,observed_feature_columns,model_input_width')""")
def s9_s12_s13_metadata(spark, d):
    """Metadata of a table written, read back and held against its contracts; and which broken payloads they refuse."""
    rows, path = table(spark, d, "lineitem"), files.scratch(spark, "metadata")
    found = sorted(f.name for f in rows.schema if f.dataType.simpleString() == "double")
    payload = {
        "dataset_kind": "rl_jsonl", "pipeline_stage": "curated", "historical_data_protocol": "timestamped_named_rows", "target_column": "l_quantity",
        "observed_feature_columns": found, "observed_covariates": [c for c in found if c != "l_quantity"], "model_input_width": len(found), "rows": rows.count(),
    }
    files.write_metadata(spark, payload, path)

    def held(p: dict) -> dict:
        files.check_metadata(p, {"rl_jsonl"}, {"curated", "raw"})
        return files.check_multivariate(p, list(_CHANNELS), "l_quantity", "timestamped_named_rows")

    back, refused = held(files.read_metadata(spark, path)), []
    for field, value in (("dataset_kind", "x"), ("pipeline_stage", "x"), ("observed_feature_columns", found[::-1]), ("model_input_width", 1)):
        try:
            held({**back, field: value})
        except ValueError:
            refused.append(field)
    shown = {**{k: back[k] for k in ("rows", "target_column", "model_input_width")}, "observed_covariates": ",".join(back["observed_covariates"]), "refused": ",".join(refused)}
    return spark.createDataFrame([(k, str(v)) for k, v in shown.items()], "field string, value string")


# --- streams and SQL functions -------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS most, min(value) AS least FROM events GROUP BY ALL")
def stream_event_windows(spark, d):
    path = f"{d}/events.parquet"
    events = streams.read_events(spark, path, spark.read.parquet(path).schema)
    return streams.run_available(streams.windowed(events), files.scratch(spark, "stream"))


def _arriving(spark, rows, order, pieces, name):
    """A folder of ``rows`` in several files."""
    path = files.scratch(spark, name)
    rows.repartitionByRange(pieces, order).write.parquet(path)
    return path


@query(f"""WITH {TYPES}, w AS (SELECT series_id, pos - 23 AS start, sum(value) OVER h AS hs, count(*) OVER h AS hn, sum(value) OVER f AS fs, count(*) OVER f AS fn, first_value(value) OVER h AS first_value FROM s
 WINDOW h AS (PARTITION BY series_id ORDER BY pos ROWS 23 PRECEDING), f AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING))
SELECT series_id, start, round(hs, 3) AS history_sum, round(fs, 3) AS future_sum, first_value FROM w WHERE hn = 24 AND fn = 8""")
def stream_count_windows(spark, d):
    """W1 as a stream: rows arrive in four spans of time, every run goes on from the checkpoint, and one stops between a batch's writing and its commit."""
    e = table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    edges = [float("-inf"), *e.select(F.unix_micros("ts").alias("us")).approxQuantile("us", [0.25, 0.5, 0.75], 0.01), float("inf")]
    end = e.agg((F.max("ts") + F.expr("INTERVAL 2 HOURS")).alias("ts")).select(F.lit(None).cast("string").alias("event_type"), "ts", F.lit(-1).cast("long").alias("event_id"), F.lit(0.0).alias("value"))
    path, out = files.scratch(spark, "arriving"), files.scratch(spark, "windows")
    log = state.BatchLog(f"{out}/table")
    us = F.unix_micros("ts")
    spans = [e.where((us >= low) & (us < high)) for low, high in zip(edges, edges[1:])]
    for i, rows in enumerate([*spans, end]):  # after the last row one of a later time lets the watermark pass them all
        rows.write.mode("append").parquet(path)
        for stop in (True, False) if i == 2 else (False,):
            arriving = spark.readStream.schema(e.schema).parquet(path)
            state.run(state.count_windows(arriving, "event_type", 24, 8, "1 hour"), f"{out}/checkpoint", log.store, 0 if stop else None)
    w = log.read(spark, state.WINDOWS)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 3)
    return w.select("series_id", "start", total("history").alias("history_sum"), total("future").alias("future_sum"), win.at("history", F.lit(0)).alias("first_value"))


@query("""SELECT coalesce(b.k, a.k) AS k, coalesce(b.v, a.v) AS v FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_acctbal > 0) a
FULL JOIN (SELECT c_custkey AS k, -c_acctbal AS v FROM customer WHERE c_mktsegment = 'BUILDING') b ON a.k = b.k""")
def j7_stream_upsert(spark, d):
    """J7 as a stream: what is there, then overriding rows in several batches, one of them stored twice, and a compaction between."""
    c, schema = table(spark, d, "customer"), "k long, v double, seq long"
    old = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(0).cast("long").alias("seq"))
    new = c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"), (-F.col("c_acctbal")).alias("v"), F.lit(1).cast("long").alias("seq"))
    path, out = _arriving(spark, new, "k", 3, "overriding"), files.scratch(spark, "upserts")
    log = state.UpsertLog(f"{out}/table", "k", "seq")
    log.store(old, -1)
    for stop in (1, None):
        arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        state.run(arriving, f"{out}/checkpoint", log.store, stop)
        log.compact(spark, schema)
    return log.current(spark, schema).select("k", "v")


@query("SELECT c_custkey AS k, c_acctbal > 0 AS reused FROM customer")
def j6_stream_resume(spark, d):
    """J6 as a resumed run: keys that a stored batch has are reused, the others are still to do."""
    c, schema = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(0).cast("long").alias("seq")), "k long, v double, seq long"
    log = state.UpsertLog(f"{files.scratch(spark, 'resumed')}/table", "k", "seq")
    log.store(c.where("v > 0"), 0)
    pending = log.pending(spark, c, schema)
    return pending.select("k", F.lit(False).alias("reused")).unionByName(c.join(pending.select("k"), "k", "left_anti").select("k", F.lit(True).alias("reused")))


@query(f"""WITH {TYPES}, l AS (SELECT series_id, arg_max(value, pos) AS v FROM s GROUP BY 1), g AS (SELECT series_id, max(value) - min(value) AS spread FROM s GROUP BY 1) SELECT series_id, step, v AS value, round(spread, 6) AS spread FROM l JOIN g USING (series_id), range(1, 4) r(step)""")
def udf_registry(spark, d):
    udfs.register(spark)
    series(spark, d).createOrReplaceTempView("gl_series")
    return spark.sql("""WITH x AS (SELECT series_id, transform(array_sort(collect_list(struct(pos, value))), p -> p.value) AS h FROM gl_series GROUP BY series_id), g AS (SELECT series_id, gl_spread(value) AS spread FROM gl_series GROUP BY series_id)
        SELECT x.series_id, CAST(f.step AS BIGINT) AS step, f.value, round(spread, 6) AS spread FROM x JOIN g USING (series_id), LATERAL gl_forecast(x.h, 'naive', 3) f""")
