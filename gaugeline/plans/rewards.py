"""Registered queries of forecast scoring: smoothing, turning points, repetition, edits, rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, scores
from ..operators import windows as win
from ..sources.tables import series
from .queries import USERS, query
from .texts import A, B, C, RECOVER, SOLUTION, texts

N = 12
#: Windows of N points as a forecast x, and the N points after them as the truth y.
PAIRS = f"""{USERS}, w0 AS (SELECT series_id, pos - {N - 1} AS start, list(value) OVER h AS x, list(value) OVER f AS y FROM s WINDOW h AS (PARTITION BY series_id ORDER BY pos ROWS {N - 1} PRECEDING),
 f AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {N} FOLLOWING)), w AS (SELECT * FROM w0 WHERE len(x) = {N} AND len(y) = {N})"""


def pairs(spark, d):
    w = win.build_windows_bucketed(series(spark, d, "user_id"), N, N)
    return w.select("series_id", F.col("start").cast("long"), F.col("history").alias("x"), F.col("future").alias("y"))


def r(c, n=6):
    return F.round(c, n)


_MA = lambda v: f"list_transform(range(1, {N + 1}), lambda i: ({' + '.join(f'{v}[greatest(least(i + {k}, {N}), 1)]' for k in range(-3, 4))}) / 7)"
_MSE = lambda a, b: f"list_avg(list_transform(range(1, {N + 1}), lambda i: ({a}[i] - {b}[i]) ** 2))"


@query(f"""WITH {PAIRS}, z AS (SELECT series_id, start, list_transform(x, lambda v: (v - list_avg(y)) / greatest(list_stddev_pop(y), 1e-8)) AS x, list_transform(y, lambda v: (v - list_avg(y)) / greatest(list_stddev_pop(y), 1e-8)) AS y FROM w),
t AS (SELECT *, {_MA("x")} AS tx, {_MA("y")} AS ty FROM z), q AS (SELECT *, list_transform(range(1, {N + 1}), lambda i: x[i] - tx[i]) AS sx, list_transform(range(1, {N + 1}), lambda i: y[i] - ty[i]) AS sy FROM t)
SELECT series_id, start, round(tx[1], 6) AS first_trend, round(sy[{N}], 6) AS last_season, round(0.0125 / (1 + ln(1 + {_MSE("sx", "sy")})) + 0.0375 / (1 + ln(1 + {_MSE("tx", "ty")})), 6) AS score FROM q""")
def m20_c4_season_trend(spark, d):
    x, y = F.col("x"), F.col("y")
    a, b = arrays.scaled_by(x, y), arrays.scaled_by(y, y)
    return pairs(spark, d).select(
        "series_id", "start", r(F.get(arrays.trend(a), F.lit(0))).alias("first_trend"), r(F.element_at(arrays.season(b), -1)).alias("last_season"),
        r(scores.season_trend_score(x, y)).alias("score"),
    )


def _turns(v: str, op: str) -> str:
    y = f"list_concat(list_concat([{v}[3], {v}[2]], {v}), [{v}[-2], {v}[-1]])"
    return f"list_filter(range(0, {N}), lambda i: " + " AND ".join(f"({y})[i + 3] {op} ({y})[i + {3 + k}]" for k in (-2, -1, 1, 2)) + ")"


@query(f"""WITH RECURSIVE {PAIRS}, t AS (SELECT series_id, start, {_turns("x", ">=")} AS p1, {_turns("y", ">=")} AS g1, {_turns("x", "<=")} AS p2, {_turns("y", "<=")} AS g2 FROM w),
l AS (SELECT series_id, start, 1 AS side, p1 AS p, g1 AS g FROM t UNION ALL SELECT series_id, start, 2, p2, g2 FROM t),
g AS (SELECT series_id, start, side, p, g AS free, 0 AS k, 0 AS hits, len(g) AS m FROM l
 UNION ALL SELECT series_id, start, side, p, CASE WHEN c IS NULL THEN free ELSE list_filter(free, lambda f: f <> c) END, k + 1, hits + (c IS NOT NULL)::INT, m FROM (SELECT *, list_filter(free, lambda f: abs(f - p[k + 1]) <= 2)[1] AS c FROM g WHERE k < len(p))),
h AS (SELECT series_id, start, side, hits, m FROM g WHERE k = len(p))
SELECT series_id, start, max(hits) FILTER (side = 1) AS peak_hits, max(hits) FILTER (side = 2) AS valley_hits, round(sum(CASE WHEN m > 0 THEN hits / m * 0.025 ELSE 0 END), 6) AS score FROM h GROUP BY ALL""")
def c5_m22_turning_score(spark, d):
    x, y = F.col("x"), F.col("y")
    hits = lambda low: arrays.greedy_hits(arrays.turning_points(x, low), arrays.turning_points(y, low)).cast("long")
    return pairs(spark, d).select(
        "series_id", "start", hits(False).alias("peak_hits"), hits(True).alias("valley_hits"), r(scores.turning_point_score(x, y)).alias("score")
    )


@query(f"""WITH {PAIRS}, v AS (SELECT series_id, start, list_transform(x, lambda q: floor(q / 180)) AS x FROM w), p AS (SELECT *, i AS period, 12 // i AS whole FROM v, range(1, 9) r(i) WHERE 12 // i >= 2),
e AS (SELECT *, list_transform(range(1, whole), lambda j: x[13 - period + 0:] = x[13 - period - j * period:12 - j * period]) AS same FROM p),
n AS (SELECT *, CASE WHEN coalesce(list_position(same, false), 0) = 0 THEN whole ELSE list_position(same, false) END AS repeats FROM e),
b AS (SELECT *, row_number() OVER (PARTITION BY series_id, start ORDER BY repeats * period DESC, period) AS k FROM n WHERE repeats >= 2),
run AS (SELECT series_id, start, coalesce(list_position(list_transform(list_reverse(x), lambda q: q = x[-1]), false) - 1, 12) AS tail_run FROM v)
SELECT series_id, start, coalesce(repeats, 0) AS repeats, coalesce(period, 0) AS period, CASE WHEN tail_run < 0 THEN 12 ELSE tail_run END AS tail_run FROM run LEFT JOIN (SELECT * FROM b WHERE k = 1) USING (series_id, start)""")
def m23_m24_repetition(spark, d):
    coarse = F.transform("x", lambda v: F.floor(v / 180).cast("double"))
    w = pairs(spark, d).withColumn("c", coarse)
    best = arrays.suffix_repetition(F.col("c"))
    return w.select("series_id", "start", best["repeats"].cast("long").alias("repeats"), best["period"].cast("long").alias("period"), arrays.tail_run(F.col("c")).alias("tail_run"))


@query(f"""WITH {PAIRS}, g AS (SELECT *, list_transform(range(1, {N + 1}), lambda i: abs(x[i] - y[i])) AS e FROM w), f AS (SELECT *, list_filter(range(0, {N}), lambda i: e[i + 1] > 150) AS m, list_filter(e, lambda v: v > 150) AS big FROM g)
SELECT series_id, start, len(m) AS changed, m[1] AS first, m[-1] AS last, CASE WHEN len(m) = 0 THEN 0 ELSE m[-1] - m[1] + 1 END AS span, round(coalesce(list_avg(big), 0), 6) AS mean_abs, round(coalesce(list_max(big), 0), 6) AS max_abs,
 round({_MSE("x", "y")}, 6) AS mse, round(list_avg(e), 6) AS mae, round({_MSE("x", "y")} / greatest(list_stddev_pop(y), 1e-8) ** 2, 6) AS norm_mse, round(list_avg(e) / greatest(list_stddev_pop(y), 1e-8), 6) AS norm_mae FROM f""")
def m27_m28_m29_errors(spark, d):
    x, y = F.col("x"), F.col("y")
    w = pairs(spark, d).select("series_id", "start", arrays.delta_summary(x, y, 150.0).alias("d"), *(
        r(f(x, y)).alias(k) for k, f in (("mse", arrays.mse), ("mae", arrays.mae), ("norm_mse", arrays.norm_mse), ("norm_mae", arrays.norm_mae))
    ))
    return w.select("series_id", "start", "d.changed", "d.first", "d.last", "d.span", r(F.col("d.mean_abs")).alias("mean_abs"), r(F.col("d.max_abs")).alias("max_abs"), "mse", "mae", "norm_mse", "norm_mae")


_DIFF = lambda v: f"list_transform(range(1, {N}), lambda i: {v}[i + 1] - {v}[i])"
_MAD = lambda v: f"list_median(list_transform({v}, lambda u: abs(u - list_median({v}))))"
EDITS = PAIRS + f""", k0 AS (SELECT series_id, start, y AS x, x AS hist, greatest({_MAD(_DIFF("y"))}, 1e-6) AS dm, {_MAD("x")} AS hm, greatest({_MAD(_DIFF("x"))}, 1e-6) AS hd FROM w),
k1 AS (SELECT *, list_filter(range(2, {N}), lambda i: abs(x[i] - x[i-1]) > greatest(3 * dm, 1e-4) AND abs(x[i+1] - x[i]) > greatest(3 * dm, 1e-4) AND (x[i] - x[i-1]) * (x[i+1] - x[i]) < 0) AS sp,
 list_avg(hist) - list_avg(x) AS lg, (hist[{N}] - hist[1]) / 11 - (x[{N}] - x[1]) / 11 AS sg FROM k0),
k2 AS (SELECT *, CASE WHEN abs(lg) > greatest(1.5 * greatest(hm, 1e-4), 1e-4) THEN 0.5 * lg END AS level, CASE WHEN abs(sg) > greatest(2 * greatest(hd, 1e-4), 1e-4) THEN 0.5 * sg END AS slope FROM k1)"""


@query(f"""WITH RECURSIVE {EDITS}, sm AS (SELECT series_id, start, x, sp, 1 AS i, [x[1]] AS done FROM k2 UNION ALL SELECT series_id, start, x, sp, i + 1, list_append(done, CASE WHEN list_contains(sp, i + 1) THEN 0.5 * (done[-1] + x[i + 2]) ELSE x[i + 1] END) FROM sm WHERE i < {N}),
fin AS (SELECT series_id, start, done FROM sm WHERE i = {N})
SELECT k2.series_id, k2.start, len(sp) AS spikes, round(list_sum(done), 8) AS smoothed_sum, round(level, 6) AS level_gap, round(slope, 6) AS slope_gap, round(x[{N}] + coalesce(level, 0), 6) AS level_last, round(x[{N}] + 11 * coalesce(slope, 0), 6) AS slope_last,
 (len(sp) > 0)::INT + (level IS NOT NULL)::INT + (slope IS NOT NULL)::INT AS edits, round(dm, 6) AS diff_mad FROM k2 JOIN fin USING (series_id, start)""")
def m2_m32_m33_g4_local_edits(spark, d):
    x, h = F.col("y"), F.col("x")
    last = lambda v: r(F.element_at(v, -1))
    return pairs(spark, d).select(
        "series_id", "start", F.size(arrays.spikes(x)).cast("long").alias("spikes"), r(arrays.total(arrays.smoothed(x)), 8).alias("smoothed_sum"),
        r(arrays.level_gap(x, h)).alias("level_gap"), r(arrays.slope_gap(x, h)).alias("slope_gap"), last(arrays.level_adjusted(x, h)).alias("level_last"),
        last(arrays.slope_adjusted(x, h)).alias("slope_last"), F.size(arrays.local_edits(x, h)).cast("long").alias("edits"), r(arrays.diff_mad(x)).alias("diff_mad"),
    )


@query(f"""WITH {EDITS}, m AS (SELECT series_id, start, ['arima', 'itransformer', 'patchtst'][start % 3 + 1] AS model, len(sp) > 0 AS a, level IS NOT NULL AS b, slope IS NOT NULL AS c FROM k2)
SELECT series_id, start, model, coalesce(array_to_string(list_filter([CASE WHEN a AND model <> 'itransformer' THEN 'isolated_spike_smoothing' END, CASE WHEN b AND model = 'patchtst' THEN 'local_level_adjust' END, CASE WHEN c THEN 'local_slope_adjust' END], lambda v: v IS NOT NULL), '|'), '') AS ops FROM m""")
def c27_edit_gating(spark, d):
    model = F.element_at(F.array(F.lit("arima"), F.lit("itransformer"), F.lit("patchtst")), (F.col("start") % 3 + 1).cast("int"))
    e = arrays.edits_for(arrays.local_edits(F.col("y"), F.col("x")), F.col("model"))
    return pairs(spark, d).withColumn("model", model).select("series_id", "start", "model", F.array_join(F.transform(e, lambda v: v["op"]), "|").alias("ops"))


@query(f"""WITH {PAIRS}, e AS (SELECT series_id, start, x AS base, y AS truth, list_transform(range(1, {N + 1}), lambda i: CASE WHEN i > {N} - 1 - start % 6 THEN 0.5 * (x[i] + y[i]) ELSE x[i] END) AS ed, 1 + start % 6 AS changed FROM w),
g AS (SELECT *, {_MSE("base", "truth")} AS m0, {_MSE("ed", "truth")} AS m1, list_avg(list_transform(range(1, {N + 1}), lambda i: abs(base[i] - truth[i]))) AS a0, list_avg(list_transform(range(1, {N + 1}), lambda i: abs(ed[i] - truth[i]))) AS a1 FROM e)
SELECT series_id, start, changed <= least(24, greatest(4, {N} // 4)) AND changed <= least(32, greatest(8, {N} // 3)) AND (m0 - m1 > greatest(1e-6, 0.005 * m0) OR a0 - a1 > greatest(1e-6, 0.005 * a0)) AND m0 - m1 > 1e-8 AS meaningful FROM g""")
def c20_meaningful_edit(spark, d):
    n = (F.col("start") % 6).cast("int")
    edited = F.zip_with("x", "y", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    edited = F.transform(edited, lambda v, i: F.when(i >= F.lit(N - 1) - n, 0.5 * (v["a"] + v["b"])).otherwise(v["a"]))
    w = pairs(spark, d).withColumn("e", edited)
    return w.select("series_id", "start", arrays.meaningful(F.col("x"), F.col("e"), F.col("y")).alias("meaningful"))


@query("""WITH q AS (SELECT event_id, (event_id % 7)::INT AS p, (event_id % 5)::INT AS e, CASE event_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'missing_answer_close_tag' WHEN 2 THEN 'missing_think_block' WHEN 3 THEN 'missing_answer_block' WHEN 4 THEN 'invalid_answer_shape:lines=2,expected=3' WHEN 5 THEN 'extra_text_outside_tags' WHEN 6 THEN 'x' END AS why FROM events),
l AS (SELECT *, CASE WHEN e = 0 THEN 0.0 ELSE CASE abs(p - e) WHEN 0 THEN 0.0 WHEN 1 THEN 0.03 WHEN 2 THEN 0.05 ELSE CASE WHEN abs(p - e) <= 5 THEN 0.08 ELSE 0.12 END END + CASE WHEN p > e THEN least((p - e) / e, 1.0) * 0.05 ELSE 0 END END AS pen FROM q)
SELECT event_id, CASE WHEN e > 0 AND p = e THEN 0.1 ELSE 0.0 END AS length, round(pen, 6) AS penalty, round(CASE WHEN coalesce(why, '') = '' THEN 0.0 WHEN why = 'missing_answer_close_tag' THEN 0.03 WHEN why = 'missing_think_block' THEN 0.05 WHEN why IN ('missing_answer_block', 'extra_text_outside_tags') THEN 0.06
 WHEN why LIKE 'invalid%' THEN CASE WHEN e > 0 AND p > 0 THEN greatest(0.06, pen) ELSE 0.06 END ELSE 0.05 END, 6) AS recovery FROM l""")
def c2_c3_penalties(spark, d):
    from ..sources.tables import table

    e = F.col("event_id")
    names = ("", "missing_answer_close_tag", "missing_think_block", "missing_answer_block", "invalid_answer_shape:lines=2,expected=3", "extra_text_outside_tags", "x")
    why = F.when(e % 8 == 0, names[0])
    for i, name in enumerate(names[1:], 1):
        why = why.when(e % 8 == i, name)
    p, n = (e % 7).cast("int"), (e % 5).cast("int")
    return table(spark, d, "events").select(
        "event_id", scores.length_score(p, n).alias("length"), r(scores.length_penalty(p, n)).alias("penalty"), r(scores.recovery_penalty(why, p, n)).alias("recovery")
    )


TRUTH = f"[CAST({A} || '.5' AS DOUBLE) + event_id % 3, CAST({B} AS DOUBLE), CAST({C} || '.25' AS DOUBLE)]"
#: The reward of three-point answers: neither season and trend nor turning points count below five.
REWARD = RECOVER.replace(f"{SOLUTION} AS s FROM events", f"{SOLUTION} AS s0, {TRUTH} AS truth FROM events", 1).replace(" FROM events), p AS", " FROM events), p AS", 1)


def _clamped(sql: str) -> str:
    """``RECOVER`` over clamped texts: of case 13 only the first three stamped lines stand."""
    head, rest = sql.split(", p AS (", 1)
    cut = ", t AS (SELECT *, CASE WHEN event_id % 20 = 13 THEN '<think>y</think>' || chr(10) || chr(10) || '<answer>' || chr(10) || array_to_string(string_split(regexp_extract(s0, '<answer>((?s).*)</answer>', 1), chr(10))[:3], chr(10)) || chr(10) || '</answer>' ELSE s0 END AS s, event_id % 20 = 13 AS clamped FROM t0)"
    return head.replace("t AS (SELECT event_id", "t0 AS (SELECT event_id", 1) + cut + ", p AS (" + rest


def _values(sql: str) -> str:
    from .texts import FIRST, VALUES

    return VALUES.format(FIRST.format(sql))


@query(f"""WITH {_clamped(REWARD)}, an AS (SELECT *, CASE WHEN reason IS NULL THEN body ELSE again END AS answer FROM modes),
v AS (SELECT *, coalesce({_values("answer")}, []) AS pv3, len({_values("s")}) AS raw_len FROM an), qm AS (SELECT *, list_avg(list_transform(range(1, 4), lambda i: (pv3[i] - truth[i]) ** 2)) AS m FROM v),
z AS (SELECT *, 0.1 AS len_s, 0.6 / (1 + sqrt(m / greatest(list_stddev_pop(truth), 1e-8) ** 2)) AS err, CASE WHEN clamped THEN 0.05 + 2 / 3.0 * 0.05 ELSE 0 END AS over_loss,
 CASE WHEN mode NOT LIKE 'recovered%' THEN 0.0 WHEN reason = 'missing_answer_close_tag' THEN 0.03 WHEN reason LIKE 'missing_think%' THEN 0.05 WHEN reason IN ('missing_answer_block', 'missing_answer_open_tag', 'extra_text_outside_tags') THEN 0.06
 WHEN reason LIKE 'invalid%' THEN CASE WHEN raw_len > 0 THEN greatest(0.06, CASE abs(raw_len - 3) WHEN 0 THEN 0 WHEN 1 THEN 0.03 WHEN 2 THEN 0.05 ELSE 0.08 END + CASE WHEN raw_len > 3 THEN least((raw_len - 3) / 3.0, 1) * 0.05 ELSE 0 END) ELSE 0.06 END ELSE 0.05 END AS rec FROM qm)
SELECT event_id, mode, clamped, round(CASE WHEN answer IS NULL THEN -1 ELSE len_s + err - over_loss - rec END, 6) AS score, CASE WHEN answer IS NOT NULL THEN round(m, 4) END AS orig_mse FROM z""")
def c6_c7_reward(spark, d):
    t = texts(spark, d, s=SOLUTION, truth=TRUTH.replace("[", "array(").replace("]", ")"))
    s = scores.with_reward(t, "s", "truth", True)
    return s.select("event_id", "mode", F.col("clamp.applied").alias("clamped"), r(F.col("score")).alias("score"), r(F.col("orig_mse"), 4).alias("orig_mse"))


@query(f"""WITH {_clamped(REWARD)}, an AS (SELECT *, CASE WHEN reason IS NULL THEN body ELSE again END AS answer FROM modes),
v AS (SELECT *, coalesce({_values("answer")}, []) AS pv3, len({_values("s")}) AS raw_len FROM an), qm AS (SELECT *, list_avg(list_transform(range(1, 4), lambda i: (pv3[i] - truth[i]) ** 2)) AS m FROM v),
z AS (SELECT *, 0.1 + 0.6 / (1 + sqrt(m / greatest(list_stddev_pop(truth), 1e-8) ** 2)) AS gain, CASE WHEN clamped THEN 0.05 + 2 / 3.0 * 0.05 ELSE 0 END AS over_loss,
 CASE WHEN mode NOT LIKE 'recovered%' THEN 0.0 WHEN reason = 'missing_answer_close_tag' THEN 0.03 WHEN reason LIKE 'missing_think%' THEN 0.05 WHEN reason IN ('missing_answer_block', 'missing_answer_open_tag', 'extra_text_outside_tags') THEN 0.06
 WHEN reason LIKE 'invalid%' THEN CASE WHEN raw_len > 0 THEN greatest(0.06, CASE abs(raw_len - 3) WHEN 0 THEN 0 WHEN 1 THEN 0.03 WHEN 2 THEN 0.05 ELSE 0.08 END + CASE WHEN raw_len > 3 THEN least((raw_len - 3) / 3.0, 1) * 0.05 ELSE 0 END) ELSE 0.06 END ELSE 0.05 END AS rec FROM qm),
w AS (SELECT *, CASE WHEN reason IS NULL THEN gain - over_loss ELSE -1 END AS strict, CASE WHEN answer IS NULL THEN -1 ELSE gain - over_loss - rec END AS recovered FROM z)
SELECT event_id, round(strict, 6) AS strict_score, round(recovered, 6) AS recovered_score, round(recovered - strict, 6) AS recovery_gap, CASE WHEN reason IS NULL THEN 'strict_protocol' ELSE 'rejected_' || reason END AS strict_parse_mode, mode AS recovered_parse_mode, reason AS reject_reason, clamped, round(over_loss, 6) AS raw_overrun_penalty FROM w""")
def c7_compared_rewards(spark, d):
    t = texts(spark, d, s=SOLUTION, truth=TRUTH.replace("[", "array(").replace("]", ")"))
    c = scores.with_compared_rewards(t, "s", "truth")
    shown = ("strict_parse_mode", "recovered_parse_mode", "reject_reason", "clamped")
    return c.select("event_id", *(r(F.col(k)).alias(k) for k in ("strict_score", "recovered_score", "recovery_gap", "raw_overrun_penalty")), *shown)
