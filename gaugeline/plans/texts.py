"""Registered queries of the text codecs, over texts made from the events' numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import table
from .queries import query

# Input texts, in the words that both engines share.
A, B, C = "CAST(user_id AS STRING)", "CAST(event_id % 1000 AS STRING)", "CAST(event_id * 7 % 100 AS STRING)"
_T = lambda i, v: f"'2017-05-02 0{i}:00:00 ' || {v}"
_N = " || chr(10) || "
_TRIPLE = f"{A} || '.5'{_N}{B}{_N}{C} || '.25'"
_STAMPED = _N.join(_T(i, v) for i, v in enumerate((f"{A} || '.5'", B, f"{C} || '.25'")))
SOLUTION = f"""CASE event_id % 20
 WHEN 0 THEN '<think>ok</think><answer>' || {_STAMPED} || '</answer>'
 WHEN 1 THEN '<think>t</think>' || chr(10) || '<answer>' || chr(10) || ' ' || {_TRIPLE} || chr(10) || '</answer>' || chr(10)
 WHEN 2 THEN '<answer>' || {_TRIPLE} || '</answer>'
 WHEN 3 THEN '<think>x</think><answer>' || {_TRIPLE}
 WHEN 4 THEN {_TRIPLE}{_N}{A}
 WHEN 5 THEN '<think>x</think><answer>' || {_T(0, A)}{_N}{B}{_N}{C} || '</answer>'
 WHEN 6 THEN '<think>x</think><answer>' || {A}{_N}{B} || '</answer>'
 WHEN 7 THEN '<think>x</think> extra <answer>' || {_TRIPLE} || '</answer>'
 WHEN 8 THEN '<think>x<answer>' || {A} || '</answer>'
 WHEN 9 THEN 'x</think><answer>' || {_TRIPLE} || '</answer>'
 WHEN 10 THEN '<think>t</think> <answer> </answer>'
 WHEN 11 THEN '<tool_call>{{}}</tool_call> ' || {A}
 WHEN 12 THEN '<think>x</think>' || {C} || '</answer>'
 WHEN 13 THEN '<think> y </think><answer>' || {_STAMPED}{_N}{_T(3, C)}{_N}{_T(4, C)} || '</answer>'
 WHEN 14 THEN '<think>x</think><answer>row 1: ' || {A}{_N}'| 1 | ' || {B} || ' |'{_N}'2017-05-02 25:00:00 5'{_N}'foo</answer>'
 WHEN 15 THEN '<think>why</think><answer>decision=keep_baseline</answer>'
 WHEN 16 THEN '<think></think><answer>isolated_spike_smoothing</answer> tail'
 WHEN 17 THEN '<think>n</think><answer>Decision= bad</answer>'
 WHEN 18 THEN '<answer>candidate_id=c1</answer>'
 ELSE '<think>q</think><answer>candidate_id=c2</answer><answer>c2</answer>' END"""
HISTORY = f"""CASE event_id % 7
 WHEN 0 THEN '[Task] short run' || chr(10) || 'Target Column: OT ' || chr(10) || 'lookback window:  ' || {A} || ' ' || chr(10) || 'Forecast Horizon: x' || chr(10) || 'historical data:' || chr(10)
  || '2016-08-29 11:00:00 HUFL=15.0 HULL=' || {B} || ' OT=' || {A} || '.25' || chr(10) || '2016-08-29 12:00:00 OT=1 HUFL=2 OT=' || {C}
 WHEN 1 THEN 'A multivariate prompt' || chr(10) || 'Forecast Horizon: 96' || chr(10) || 'Historical Data: ' || {A} || chr(10) || '2016-08-29 11:00:00 ' || {C} || '.5' || chr(10) || 'no number here' || chr(10) || 'last ' || {B}
 WHEN 2 THEN 'single-variable' || chr(10) || 'Target Column:' || chr(10) || 'Historical Data:' || chr(10) || 'target=' || {A} || ' b=2' || chr(10) || 'b=' || {C}
 WHEN 3 THEN 'time-series forecasting of' || chr(10) || ' Lookback Window: 7' || chr(10) || {A}{_N}'-' || {B} || '.75'
 WHEN 4 THEN chr(10) || '  ' || chr(10) || 'Target Column: b' || chr(10) || 'Historical Data:' || chr(10) || 'a=-1.5 b=' || {A} || chr(10) || 'a = ' || {C} || chr(10) || '1e5' || chr(10) || '+4'
 WHEN 5 THEN ''
 ELSE 'plain ' || {A} END"""


def texts(spark, d, **made: str):
    e = table(spark, d, "events")
    return e.select("event_id", *(F.expr(sql).alias(name) for name, sql in made.items()))


def source(**made: str) -> str:
    return "t AS (SELECT event_id, " + ", ".join(f"{sql} AS {name}" for name, sql in made.items()) + " FROM events)"


# Macro-like pieces of the SQL texts; {} is the text.
TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
LINES = "list_filter(list_transform(regexp_split_to_array({}, '\\r\\n|\\r|\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
NUM = r"regexp_full_match({}, '-?\d+(?:\.\d+)?')"
STAMPED = r"(regexp_full_match({0}, '\d{{4}}-\d{{2}}-\d{{2}}\s+\d{{2}}:\d{{2}}:\d{{2}}\s+-?\d+(?:\.\d+)?') AND try_strptime(regexp_extract({0}, '^(\S+\s+\S+)', 1), '%Y-%m-%d %H:%M:%S') IS NOT NULL)"
FORMAT = (
    "CASE WHEN len({0}) = 0 THEN 'empty' WHEN len(list_filter({0}, lambda x: " + NUM.format("x") + ")) = len({0}) THEN 'numeric_only' WHEN len(list_filter({0}, lambda x: "
    + STAMPED.format("x").replace("{", "{{").replace("}", "}}") + ")) = len({0}) THEN 'timestamp_value' WHEN len(list_filter({0}, lambda x: " + NUM.format("x")
    + ")) > 0 AND len(list_filter({0}, lambda x: " + STAMPED.format("x").replace("{", "{{").replace("}", "}}") + ")) > 0 THEN 'mixed' ELSE 'invalid' END"
)
FIRST = r"CASE WHEN regexp_matches({0}, '(?s)<answer>(.*?)</answer>') THEN regexp_replace(regexp_extract({0}, '(?s)<answer>(.*?)</answer>', 1), '^\s+|\s+$', '', 'g') ELSE {0} END"
VALUES = (
    r"list_filter(list_transform(list_filter(list_transform(string_split({}, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT (regexp_matches(x, '^\d{{4}}-\d{{2}}-\d{{2}}\s+\d{{2}}:\d{{2}}:\d{{2}}\s+') AND NOT "
    + STAMPED.format("x").replace("{", "{{").replace("}", "}}")
    + r")), lambda x: coalesce(try_cast(regexp_extract(x, '\|\s*\d+\s*\|\s*(-?\d+\.?\d*)\s*\|', 1) AS DOUBLE), try_cast(regexp_extract(x, '(-?\d+\.?\d*)$', 1) AS DOUBLE))), lambda v: v IS NOT NULL)"
)
#: Step by step: the strict protocol of a solution for three values.
STRICT = source(s=SOLUTION) + f""", p AS (SELECT *, regexp_extract(s, '(?s)^\\s*<think>(.*?)</think>\\s*<answer>(.*?)</answer>\\s*$', 2) AS body0,
 regexp_matches(s, '(?s)^\\s*<think>(.*?)</think>\\s*<answer>(.*?)</answer>\\s*$') AS whole FROM t),
q AS (SELECT *, {TRIM.format("body0")} AS body FROM p), r AS (SELECT *, {LINES.format("body")} AS ls, {VALUES.format(FIRST.format("body"))} AS vs FROM q),
u AS (SELECT *, {FORMAT.format("ls")} AS kind FROM r),
st AS (SELECT *, CASE WHEN contains(s, '<think>') AND NOT contains(s, '</think>') THEN 'missing_think_close_tag' WHEN contains(s, '</think>') AND NOT contains(s, '<think>') THEN 'missing_think_open_tag'
 WHEN contains(s, '<answer>') AND NOT contains(s, '</answer>') THEN 'missing_answer_close_tag' WHEN contains(s, '</answer>') AND NOT contains(s, '<answer>') THEN 'missing_answer_open_tag'
 WHEN NOT contains(s, '<answer>') THEN 'missing_answer_block' WHEN NOT contains(s, '<think>') THEN 'missing_think_block' WHEN NOT whole THEN 'extra_text_outside_tags'
 WHEN len(ls) = 0 THEN 'empty_answer_block' WHEN len(ls) <> 3 THEN 'invalid_answer_shape:lines=' || len(ls) || ',expected=3' WHEN len(vs) <> 3 THEN 'invalid_answer_shape:values=' || len(vs) || ',expected=3'
 WHEN kind = 'mixed' THEN 'invalid_answer_shape:mixed_line_formats' WHEN kind NOT IN ('numeric_only', 'timestamp_value') THEN 'invalid_answer_shape:invalid_forecast_line' END AS reason FROM u)"""
#: Recovery: the answer block, closed or not, then a plain forecast block.
RECOVER = STRICT + f""", blk AS (SELECT *, {TRIM.format("CASE WHEN regexp_matches(s, '(?s)<answer>(.*?)</answer>') THEN regexp_extract(s, '(?s)<answer>(.*?)</answer>', 1) WHEN contains(s, '<answer>') THEN regexp_extract(s, '(?s)^.*?<answer>(.*)$', 1) ELSE '' END")} AS block,
 {LINES.format("replace(replace(replace(s, '<|im_end|>', chr(10)), '<answer>', chr(10)), '</answer>', chr(10))")} AS cl,
 {LINES.format("replace(replace(replace(replace(replace(s, '<|im_end|>', chr(10)), '<think>', chr(10)), '</think>', chr(10)), '<answer>', chr(10)), '</answer>', chr(10))")} AS al FROM st),
fl AS (SELECT *, list_transform(cl, lambda x: {STAMPED.format("x")} OR regexp_full_match(x, '-?\\d+\\.?\\d*')) AS ok FROM blk),
f0 AS (SELECT *, coalesce(list_position(ok, true), 0) AS b FROM fl), f1 AS (SELECT *, CASE WHEN b = 0 THEN [] ELSE cl[b:] END AS rest, CASE WHEN b = 0 THEN [] ELSE ok[b:] END AS rok FROM f0),
f2 AS (SELECT *, CASE WHEN coalesce(list_position(rok, false), 0) = 0 THEN rest ELSE rest[:list_position(rok, false) - 1] END AS fb FROM f1),
f3 AS (SELECT *, len(fb) > 0 AND al = fb AS is_plain, CASE WHEN len(fb) > 0 AND al = fb AND array_to_string(fb, chr(10)) <> block THEN array_to_string(fb, chr(10)) ELSE '' END AS plain FROM f2),
f4 AS (SELECT *, {LINES.format("block")} AS bl, {VALUES.format(FIRST.format("block"))} AS bv, {LINES.format("plain")} AS pl, {VALUES.format(FIRST.format("plain"))} AS pv FROM f3),
f5 AS (SELECT *, block <> '' AND ((len(bl) >= 3 AND {FORMAT.format("bl")} = 'timestamp_value') OR len(bv) >= 3) AS b_ok, len(bl) >= 3 AND {FORMAT.format("bl")} = 'timestamp_value' AS b_line,
 plain <> '' AND ((len(pl) >= 3 AND {FORMAT.format("pl")} = 'timestamp_value') OR len(pv) >= 3) AS p_ok, len(pl) >= 3 AND {FORMAT.format("pl")} = 'timestamp_value' AS p_line FROM f4),
rec AS (SELECT *, CASE WHEN contains(s, '<tool_call>') OR contains(s, '</tool_call>') THEN NULL WHEN b_ok THEN 'answer_block' WHEN p_ok THEN 'plain_forecast_block' END AS src FROM f5),
modes AS (SELECT *, CASE WHEN reason IS NULL THEN 'strict_protocol' ELSE coalesce('recovered_' || reason || '_' || src, 'rejected_' || reason) END AS mode,
 CASE WHEN src = 'answer_block' THEN CASE WHEN b_line THEN array_to_string(bl[:3], chr(10)) ELSE array_to_string(list_transform(bv[:3], lambda v: printf('%.4f', v)), chr(10)) END
  WHEN src = 'plain_forecast_block' THEN CASE WHEN p_line THEN array_to_string(pl[:3], chr(10)) ELSE array_to_string(list_transform(pv[:3], lambda v: printf('%.4f', v)), chr(10)) END END AS again FROM rec)"""


def three():
    return F.lit(3)


@query(f"WITH {STRICT} SELECT event_id, reason, CASE WHEN reason IS NULL THEN body END AS answer FROM st")
def t13_strict_protocol(spark, d):
    reason = text.strict_reason("s", three())
    return texts(spark, d, s=SOLUTION).select("event_id", reason.alias("reason"), F.when(reason.isNull(), text.strict_answer("s")).alias("answer"))


@query(f"WITH {STRICT} SELECT event_id, kind AS format, ls AS lines, vs AS forecast, len(ls) = 3 AND len(vs) = 3 AND kind IN ('numeric_only', 'timestamp_value') AS good FROM u")
def t10_t12_shape(spark, d):
    body = text.strict_answer("s")
    return texts(spark, d, s=SOLUTION).select(
        "event_id", text.line_format(text.lines(body)).alias("format"), text.lines(body).alias("lines"),
        text.forecast_values(body).alias("forecast"), text.good_shape(body, three()).alias("good"),
    )


@query(f"WITH {RECOVER} SELECT event_id, mode, reason, CASE WHEN reason IS NULL THEN body ELSE again END AS answer FROM modes")
def t14_t15_protocol(spark, d):
    t = texts(spark, d, s=SOLUTION).withColumn("expected", three())
    return text.protocol(t, "s", "expected", True).select("event_id", "mode", "reason", "answer")


@query(f"WITH {RECOVER} SELECT event_id, array_to_string(fb, chr(10)) AS block, is_plain FROM f3")
def t17_t18_forecast_block(spark, d):
    return texts(spark, d, s=SOLUTION).select(
        "event_id", F.array_join(text.forecast_block("s"), "\n").alias("block"), text.is_plain_block("s").alias("is_plain")
    )


CLAMP = source(s=SOLUTION) + f""", c0 AS (SELECT *, regexp_matches(s, '(?s)^\\s*<think>(.*?)</think>\\s*<answer>(.*)$') AS pre, {TRIM.format("regexp_extract(s, '(?s)^\\s*<think>(.*?)</think>\\s*<answer>(.*)$', 1)")} AS think,
 regexp_extract(s, '(?s)^\\s*<think>(.*?)</think>\\s*<answer>(.*)$', 2) AS tl FROM t), c1 AS (SELECT *, {LINES.format("split_part(tl, '</answer>', 1)")} AS raw,
 CASE WHEN contains(tl, '</answer>') THEN {TRIM.format("regexp_extract(tl, '(?s)^.*?</answer>(.*)$', 1)")} ELSE '' END AS rest FROM c0),
c2 AS (SELECT *, list_transform(raw, lambda x: {STAMPED.format("x")}) AS ok FROM c1), c3 AS (SELECT *, CASE WHEN coalesce(list_position(ok, false), 0) = 0 THEN len(raw) ELSE list_position(ok, false) - 1 END AS valid FROM c2),
cl AS (SELECT *, CASE WHEN contains(s, '<tool_call>') OR contains(s, '</tool_call>') THEN 'tool_call_payload' WHEN NOT pre THEN 'missing_think_answer_prefix' WHEN rest NOT IN ('', '<|im_end|>') THEN 'unexpected_trailing_text'
 WHEN valid < 3 THEN 'insufficient_valid_timestamp_prefix' WHEN valid = 3 AND len(raw) = 3 AND contains(s, '</answer>') AND ends_with({TRIM.format("s")}, '</answer>') THEN 'already_exact' ELSE 'truncate_after_expected_timestamp_rows' END AS why FROM c3),
cz AS (SELECT *, why LIKE 'trunc%' AS applied, CASE WHEN why LIKE 'trunc%' OR why LIKE 'already%' OR why LIKE 'insuff%' THEN len(raw) ELSE 0 END AS raw_lines, CASE WHEN why LIKE 'trunc%' OR why LIKE 'already%' OR why LIKE 'insuff%' THEN valid ELSE 0 END AS valid_lines,
 CASE WHEN why LIKE 'trunc%' THEN valid - 3 ELSE 0 END AS discarded, CASE WHEN why LIKE 'trunc%' THEN '<think>' || think || '</think>' || chr(10) || chr(10) || '<answer>' || chr(10) || array_to_string(raw[:3], chr(10)) || chr(10) || '</answer>' ELSE s END AS clamped FROM cl)"""


@query(f"WITH {CLAMP} SELECT event_id, applied, why AS reason, raw_lines, valid_lines, discarded, clamped AS text FROM cz")
def t16_horizon_clamp(spark, d):
    return texts(spark, d, s=SOLUTION).select("event_id", text.clamp("s", three()).alias("c")).select("event_id", "c.*")


@query(f"""WITH {source(s=SOLUTION)}, l AS (SELECT *, {LINES.format("s")} AS ls FROM t) SELECT event_id, len(list_filter(ls, lambda x: {NUM.format("x")})) AS numeric_lines, len(list_filter(ls, lambda x: NOT {NUM.format("x")})) AS other_lines,
 {FORMAT.format("ls")} AS format, CASE WHEN contains(s, '</answer>') THEN {TRIM.format("regexp_extract(s, '(?s)^.*?</answer>(.*)$', 1)")} ELSE '' END AS trailing,
 array_to_string(string_split(regexp_replace(s, '\\n$', ''), chr(10))[-2:], '|') AS tail,
 CASE WHEN contains(s, '<answer>') THEN {TRIM.format("split_part(split_part(s, '<answer>', -1), '</answer>', 1)")} ELSE '' END AS region FROM l""")
def t9_t11_t19_lines(spark, d):
    numeric, other = text.line_counts(F.col("s"))
    return texts(spark, d, s=SOLUTION).select(
        "event_id", numeric.cast("long").alias("numeric_lines"), other.cast("long").alias("other_lines"), text.line_format(text.lines(F.col("s"))).alias("format"),
        text.after_close("s").alias("trailing"), F.array_join(text.tail_lines(F.col("s"), 2), "|").alias("tail"), text.last_region("s").alias("region"),
    )


def _choice_sql(key: str, what: str, bad: str, mode: str, allowed: str) -> str:
    return source(s=SOLUTION) + f""", l AS (SELECT *, CASE WHEN contains(s, '<answer>') THEN {LINES.format("split_part(split_part(s, '<answer>', -1), '</answer>', 1)")} ELSE [] END AS ls FROM t),
 k AS (SELECT *, CASE WHEN lower(ls[1]) LIKE '{key}=%' THEN {TRIM.format("ls[1][strpos(ls[1], '=') + 1:]")} ELSE ls[1] END AS pick FROM l),
 ch AS (SELECT *, CASE WHEN NOT regexp_matches(s, '(?s)<think>(.*?)</think>') THEN 'missing_think_block' WHEN NOT regexp_matches(s, '(?s)<answer>(.*?)</answer>') THEN 'missing_answer_block'
 WHEN len(ls) <> 1 THEN 'invalid_{what}_shape' WHEN pick NOT IN ({allowed}) THEN 'invalid_{what}_{bad}' END AS why, {TRIM.format("regexp_extract(s, '(?s)<think>(.*?)</think>', 1)")} AS th FROM k),
 cc AS (SELECT *, CASE WHEN why IS NULL THEN pick END AS choice, CASE WHEN why IS NULL THEN '{mode}' ELSE 'rejected_' || why END AS mode, CASE WHEN regexp_matches(s, '(?s)<think>(.*?)</think>') THEN th END AS think FROM ch)"""


DECISION = _choice_sql("decision", "decision", "name", "refinement_decision_protocol", "'keep_baseline', 'isolated_spike_smoothing'")


def decisions():
    return F.array(F.lit("keep_baseline"), F.lit("isolated_spike_smoothing"))


@query(f"WITH {DECISION} SELECT event_id, think, choice, mode, why AS reason FROM cc")
def t20_decision(spark, d):
    return texts(spark, d, s=SOLUTION).select("event_id", text.decision("s", decisions()).alias("c")).select("event_id", "c.*")


@query(f"WITH {_choice_sql('candidate_id', 'candidate', 'id', 'candidate_selection_protocol', chr(39) + 'c1' + chr(39) + ', ' + chr(39) + 'c2' + chr(39))} SELECT event_id, think, choice, mode, why AS reason FROM cc")
def t21_candidate(spark, d):
    allowed = F.array(F.lit("c1"), F.lit("c2"))
    return texts(spark, d, s=SOLUTION).select("event_id", text.candidate("s", allowed).alias("c")).select("event_id", "c.*")


@query(f"""WITH {DECISION} SELECT event_id, CASE WHEN why IS NULL AND choice = 'keep_baseline' THEN '<think>' || chr(10) || CASE WHEN think = '' THEN 'I choose ' || choice || ' from the refinement evidence.' ELSE think END || chr(10) || '</think>' || chr(10)
 || '<answer>' || chr(10) || '1.0' || chr(10) || '</answer>' END AS answer, CASE WHEN why IS NULL AND choice <> 'keep_baseline' THEN 'missing_decision_prediction' ELSE why END AS reason FROM cc""")
def t22_materialized(spark, d):
    forecasts = F.create_map(F.lit("keep_baseline"), F.lit(" 1.0\n"), F.lit("isolated_spike_smoothing"), F.lit(" "))
    chosen = text.decision("s", decisions())
    m = text.materialized(chosen, forecasts, "I choose {} from the refinement evidence.")
    return texts(spark, d, s=SOLUTION).select("event_id", m.alias("m")).select("event_id", "m.*")


@query(f"""WITH {STRICT}, {DECISION.replace("t AS (", "t2 AS (", 1).replace("FROM t)", "FROM t2)")} SELECT event_id, CASE WHEN why = 'missing_answer_block' THEN CASE WHEN reason IS NULL THEN 'strict_protocol' ELSE 'rejected_' || reason END ELSE mode END AS mode
 FROM cc JOIN (SELECT event_id, reason FROM st) USING (event_id)""")
def c31_final_acceptance(spark, d):
    return texts(spark, d, s=SOLUTION).select("event_id", text.final_acceptance("s", decisions(), three()).alias("mode"))


SPEC = source(s=HISTORY) + f""", g AS (SELECT event_id, s AS whole, {TRIM.format("s")} AS s FROM t),
h AS (SELECT *, {TRIM.format("CASE WHEN regexp_matches(s, '(?im)^Historical Data:[ \\t]*$') THEN regexp_extract(s, '(?is)^(?:.*?\\n)??Historical Data:[ \\t]*(?:\\n(.*))?$', 1) WHEN regexp_matches(s, '(?im)^Historical Data:[ \\t]*(.+)$') THEN regexp_extract(s, '(?is)^(?:.*?\\n)??Historical Data:[ \\t]*(.+)$', 1) ELSE s END")} AS history FROM g)"""


@query(f"""WITH {SPEC} SELECT event_id, nullif({TRIM.format("regexp_extract(s, '(?im)^Target Column[ \\t]*:[ \\t]*(.+?)[ \\t]*$', 1)")}, '') AS target, try_cast(regexp_extract(s, '(?im)^lookback window[ \\t]*:[ \\t]*(\\d+)[ \\t]*$', 1) AS BIGINT) AS lookback,
 try_cast(regexp_extract(s, '(?im)^forecast horizon[ \\t]*:[ \\t]*(\\d+)[ \\t]*$', 1) AS BIGINT) AS horizon, history, CASE WHEN regexp_matches(s, '(?im)^\\[Task\\]\\s*(.+?)\\s*$') THEN regexp_extract(s, '(?im)^\\[Task\\]\\s*(.+?)\\s*$', 1)
 WHEN regexp_matches(s, '(?i)multivariate') THEN 'multivariate time-series forecasting' WHEN regexp_matches(s, '(?i)single-variable') THEN 'single-variable time-series forecasting' WHEN regexp_matches(s, '(?i)time-series forecasting') THEN 'time-series forecasting' END AS task FROM h""")
def t1_t4_task_spec(spark, d):
    t = texts(spark, d, s=HISTORY)
    c = text.strip(F.col("s"))
    return t.select(
        "event_id", text.text_field(c, "Target Column").alias("target"), text.int_field(c, "Lookback Window").alias("lookback"),
        text.int_field(c, "Forecast Horizon").alias("horizon"), text.history_block("s").alias("history"), text.task_type("s").alias("task"),
    )


_BODY = r"regexp_extract(line, '^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})(?:\s+|$)(.*)$', 2)"
_HEAD = r"regexp_matches(line, '^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})(?:\s+|$)(.*)$')"
_NV = r"'([A-Za-z_][A-Za-z0-9_\-]*)\s*=\s*(-?\d+(?:\.\d+)?)'"
LINE = SPEC + f""", tg AS (SELECT *, nullif({TRIM.format("regexp_extract(s, '(?im)^Target Column[ \\t]*:[ \\t]*(.+?)[ \\t]*$', 1)")}, '') AS target FROM h),
ln AS (SELECT event_id, target, unnest({LINES.format("history")}) AS line, generate_subscripts({LINES.format("history")}, 1) AS i FROM tg),
b AS (SELECT *, CASE WHEN {_HEAD} THEN regexp_extract(line, '^(\\S+\\s+\\S+)', 1) END AS stamp, {TRIM.format(f"CASE WHEN {_HEAD} THEN {_BODY} ELSE line END")} AS body FROM ln),
nv AS (SELECT *, regexp_extract_all(body, {_NV}, 1) AS ks, list_transform(regexp_extract_all(body, {_NV}, 2), lambda v: v::DOUBLE) AS xs FROM b),
wt AS (SELECT *, CASE WHEN len(ks) = 0 THEN try_cast(regexp_extract(body, '(-?\\d+(?:\\.\\d+)?)$', 1) AS DOUBLE) ELSE coalesce(
 list_filter(xs, lambda x, j: ks[j] = target)[-1], list_filter(xs, lambda x, j: ks[j] = 'target')[-1], list_filter(xs, lambda x, j: ks[j] = 'OT')[-1], list_filter(xs, lambda x, j: ks[j] = ks[1])[-1]) END AS value FROM nv)"""


@query(f"WITH {LINE} SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY i) - 1 AS pos, stamp, value, CASE WHEN len(ks) = 0 THEN coalesce(target, 'target') ELSE array_to_string(list_filter(ks, lambda k, j: list_position(ks, k) = j), ',') END AS names FROM wt WHERE value IS NOT NULL")
def t5_t7_line_parser(spark, d):
    target = text.text_field(text.strip(F.col("s")), "Target Column")
    r = texts(spark, d, s=HISTORY).select("event_id", F.posexplode(text.records("s", target)).alias("pos", "r"))
    return r.select("event_id", F.col("pos").cast("long"), "r.stamp", "r.value", F.array_join("r.names", ",").alias("names"))


CALLS = f"""CASE event_id % 6 WHEN 0 THEN 'x <tool_call>' || chr(10) || '{{"name": "a", "arguments": {{"k": ' || {A} || '}}}}</tool_call> y' WHEN 1 THEN '<tool_call>bad</tool_call><tool_call>{{"name": "b"}}</tool_call>'
 WHEN 2 THEN 'none' WHEN 3 THEN '<tool_call>{{"k": 1}}</tool_call><tool_call> </tool_call>' WHEN 4 THEN '<tool_call>{{"name": "c", "arguments": 5}}</tool_call><tool_call>{{"name": "a", "arguments": [1]}}</tool_call> z'
 ELSE '<tool_call>{{"name": "a"}}</tool_call><tool_call>{{"name": "b", "arguments": {{}}}}</tool_call><tool_call>{{"name": "a"}}</tool_call>' END"""


@query(f"""WITH {source(s=CALLS)}, e AS (SELECT event_id, s, regexp_extract_all(s, '(?s)<tool_call>(.*?)</tool_call>', 1) AS bs FROM t), b AS (SELECT event_id, i, {TRIM.format("bs[i]")} AS p FROM e, range(1, 9) r(i) WHERE i <= len(bs)),
k AS (SELECT *, CASE WHEN json_valid(p) AND json_type(p) = 'OBJECT' THEN p END AS j FROM b), n AS (SELECT *, coalesce(json_extract_string(j, '$.name'), '') AS name, json_type(j, '$.arguments') AS ty FROM k),
s1 AS (SELECT *, CASE WHEN j IS NULL THEN 'bad_json' WHEN name = '' THEN 'no_name' WHEN name NOT IN ('a', 'b') THEN 'bad_name' WHEN ty IS NOT NULL AND ty <> 'OBJECT' AND ty <> 'NULL' THEN 'bad_arguments' ELSE 'call' END AS st FROM n),
s2 AS (SELECT *, coalesce(sum((st = 'call')::INT) OVER (PARTITION BY event_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s1)
SELECT t.event_id, {TRIM.format("regexp_replace(any_value(s), '(?s)<tool_call>.*?</tool_call>', '', 'g')")} AS content, count(st) AS blocks, count(*) FILTER (st = 'bad_json') AS bad_json, count(*) FILTER (st = 'no_name') AS no_name, count(*) FILTER (st = 'bad_name') AS bad_name,
 count(*) FILTER (st = 'bad_arguments') AS bad_arguments, count(*) FILTER (st = 'call') AS calls, coalesce(string_agg(name, '->' ORDER BY i) FILTER (st IN ('bad_name', 'bad_arguments', 'call')), '') AS names,
 coalesce(string_agg(name, '->' ORDER BY i) FILTER (st IN ('bad_name', 'bad_arguments')), '') AS bad_names FROM t LEFT JOIN (SELECT * FROM s2 WHERE before < 2) USING (event_id) GROUP BY t.event_id""")
def t23_tool_calls(spark, d):
    c = text.tool_calls("s", F.array(F.lit("a"), F.lit("b")), max_calls=2)
    return texts(spark, d, s=CALLS).select("event_id", c.alias("c")).select("event_id", "c.*")


@query("SELECT conv_id, turn, CASE WHEN len(string_split(trim(text), chr(10))) > 0 AND len(list_filter(string_split(trim(text), chr(10)), lambda x: trim(x) <> '')) > 2 THEN '... (' || (len(list_filter(string_split(trim(text), chr(10)), lambda x: trim(x) <> '')) - 2) || ' earlier rows omitted) ...' || chr(10) || array_to_string(list_filter(string_split(trim(text), chr(10)), lambda x: trim(x) <> '')[-2:], chr(10)) ELSE text END AS shown FROM conversations")
def t33_truncate_history(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.truncated_history("text", 2).alias("shown"))


@query("""SELECT event_id, lower(trim(props)) IN ('1', 'true', 'yes', 'y') AS as_bool, CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN event_id::DOUBLE END AS as_number, CASE WHEN event_id % 2 = 0 THEN 'none' ELSE event_type || '->' || user_id END AS path,
 substr(sha256('7:train:' || event_id), 1, 16) AS place FROM events""")
def t26_t35_t37_scalars(spark, d):
    kind = F.col("event_id") % 3
    raw = F.when(kind == 0, F.col("value").cast("string")).when(kind == 1, F.concat(F.lit(" "), F.col("event_id").cast("string"))).otherwise("inf")
    items = F.when(F.col("event_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array("event_type", F.col("user_id").cast("string")))
    return table(spark, d, "events").select(
        "event_id", text.lenient_bool(F.col("props")).alias("as_bool"), text.lenient_double(raw).alias("as_number"),
        text.signature(items, "->").alias("path"), text.shuffle_key(7, F.lit("train"), F.col("event_id")).alias("place"),
    )


@query("""SELECT conv_id, sha1(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY turn)) AS digest, '<tool_call>' || chr(10) || '{"name": "look", "arguments": {"conv":' || conv_id || '}}' || chr(10) || '</tool_call>' AS call FROM conversations GROUP BY conv_id""")
def t36_t40_messages(spark, d):
    m = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(m.alias("m"))
    arguments = F.to_json(F.struct(F.col("conv_id").alias("conv")))
    return c.select("conv_id", text.messages_hash(F.col("m")).alias("digest"), text.tool_message(F.lit("look"), arguments).alias("call"))


@query(f"""WITH {DECISION} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 2 = 1 WHEN event_id % 3 = 1 THEN event_id % 5 = 0 ELSE true END AS required,
 CASE WHEN choice IS NOT NULL THEN 'valid' WHEN mode LIKE '%name' THEN 'bad_name' ELSE why END AS verdict FROM cc""")
def t25_turn3_rows(spark, d):
    e = F.col("event_id")
    flag = F.when(e % 3 == 0, F.when(e % 2 == 1, "yes").otherwise("no"))
    stage = F.when(e % 3 == 1, F.when(e % 5 == 0, " Refinement").otherwise("routing")).otherwise("")
    required = F.coalesce(F.when(flag.isNotNull(), text.lenient_bool(flag)), F.when(text.strip(stage) != "", F.lower(text.strip(stage)) == "refinement"), F.lit(True))
    c = text.decision("s", decisions())
    verdict = F.when(c["choice"].isNotNull(), "valid").when(c["mode"].endswith("name"), "bad_name").otherwise(c["reason"])
    return texts(spark, d, s=SOLUTION).select("event_id", required.alias("required"), verdict.alias("verdict"))
