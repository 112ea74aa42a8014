"""Registered queries on the driver tables, each beside an independent SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import selection as sel
from ..operators import windows as win
from ..operators.ordering import kept, quantiles
from ..sources.tables import daily, keyed_last, model_errors, series, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}

_BY = "row_number() OVER (PARTITION BY {0} ORDER BY ts, event_id) - 1"
TYPES = f"s AS (SELECT event_type AS series_id, {_BY.format('event_type')} AS pos, ts, value FROM events)"
USERS = f"s AS (SELECT user_id AS series_id, {_BY.format('user_id')} AS pos, ts, value FROM events)"
ERRORS = f"""{USERS}, cut AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM s),
c AS (SELECT * FROM cut WHERE n > 16), past AS (SELECT * FROM c WHERE pos < n - 8),
st AS (SELECT series_id, arg_max(value, pos) AS lst, arg_min(value, pos) AS fst, avg(value) AS mean, count(*) AS m FROM past GROUP BY 1),
f AS (SELECT c.series_id, c.value, pos - (n - 8) AS h FROM c WHERE pos >= n - 8),
w AS (SELECT f.*, lst, mean, p.value AS seasonal, lst + (lst - fst) / (m - 1) * (h + 1) AS drift
  FROM f JOIN st USING (series_id) JOIN past p ON p.series_id = f.series_id AND p.pos = m - 7 + h % 7),
l AS (SELECT series_id AS sample, value, 'naive' AS model, lst AS y FROM w UNION ALL SELECT series_id, value, 'seasonal', seasonal FROM w
  UNION ALL SELECT series_id, value, 'mean', mean FROM w UNION ALL SELECT series_id, value, 'drift', drift FROM w),
errors AS (SELECT sample, model, round(avg((y - value) * (y - value)), 8) AS mse, round(avg(abs(y - value)), 8) AS mae FROM l GROUP BY 1, 2)"""
ROUTES = ERRORS + """, rk AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY mse, model) AS rank FROM errors),
r0 AS (SELECT sample, max(model) FILTER (rank = 1) AS best, max(mse) FILTER (rank = 1) AS best_error, max(model) FILTER (rank = 2) AS second,
  max(mse) FILTER (rank = 2) AS second_error, max(mse) FILTER (model = 'mean') AS default_error, bool_or(rank <= 2) FILTER (model = 'mean') AS default_in_top2
  FROM rk GROUP BY 1),
routes AS (SELECT *, round(default_error - best_error, 7) AS improvement, round(CASE WHEN default_error = 0 THEN 0.0 ELSE (default_error - best_error) / default_error END, 6) AS improvement_rel,
  round(CASE WHEN second_error = 0 THEN 0.0 ELSE (second_error - best_error) / second_error END, 6) AS margin_rel FROM r0)"""
STEPS = """t AS (SELECT conv_id % 40 AS grp, conv_id AS trajectory, turn AS step, (length(text) % 97)::DOUBLE / 97 AS reward,
  (length(text) % 13)::DOUBLE / 13 AS value FROM conversations)"""
DEFAULT = "mean"
MODELS = ["naive", "seasonal", "mean", "drift"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def steps(spark: SparkSession, d: str) -> DataFrame:
    """Trajectory steps: conversations as trajectories, turns as steps."""
    size = F.length("text")
    return table(spark, d, "conversations").select(
        (F.col("conv_id") % 40).alias("grp"), F.col("conv_id").alias("trajectory"), F.col("turn").alias("step"),
        ((size % 97).cast("double") / 97).alias("reward"), ((size % 13).cast("double") / 13).alias("value"),
    )


def routes(spark: SparkSession, d: str) -> DataFrame:
    return sel.route_info(model_errors(spark, d), DEFAULT)


# --- sources, windows, bands ---------------------------------------------------------------


@query(f"""WITH {TYPES}, w AS (SELECT series_id, pos - 23 AS start, sum(value) OVER h AS hs, count(*) OVER h AS hn, sum(value) OVER f AS fs,
  count(*) OVER f AS fn, first_value(value) OVER h AS first_value FROM s WINDOW h AS (PARTITION BY series_id ORDER BY pos ROWS 23 PRECEDING),
  f AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING))
SELECT series_id, start, round(hs, 3) AS history_sum, round(fs, 3) AS future_sum, first_value FROM w WHERE hn = 24 AND fn = 8""")
def w1_sliding_windows(spark, d):
    w = win.build_windows_bucketed(series(spark, d), 24, 8)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 3)
    return w.select("series_id", F.col("start").cast("long"), total("history").alias("history_sum"), total("future").alias("future_sum"), win.at("history", F.lit(0)).alias("first_value"))


@query(f"""WITH {TYPES}, k AS (SELECT *, CASE WHEN pos < 300 THEN 'train' WHEN pos < 360 THEN 'val' WHEN pos < 460 THEN 'test' END AS split FROM s WHERE pos < 460),
w AS (SELECT series_id, split, pos - 23 AS start, sum(value) OVER h AS hs, count(*) OVER h AS hn, sum(value) OVER f AS fs, count(*) OVER f AS fn FROM k
 WINDOW h AS (PARTITION BY series_id, split ORDER BY pos ROWS 23 PRECEDING), f AS (PARTITION BY series_id, split ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING))
SELECT series_id, split, start, round(hs, 3) AS history_sum, round(fs, 3) AS future_sum FROM w WHERE hn = 24 AND fn = 8""")
def w1_split_windows(spark, d):
    w = win.split_windows(series(spark, d), 24, 8, {"train": 300, "val": 60, "test": 100}, 128)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 3)
    return w.select("series_id", "split", F.col("start").cast("long"), total("history").alias("history_sum"), total("future").alias("future_sum"))


CURRICULUM = f"""WITH {TYPES}, g AS (SELECT series_id, pos - 23 AS start, list(value) OVER h AS x, list(value) OVER f AS y FROM s
  WINDOW h AS (PARTITION BY series_id ORDER BY pos ROWS 23 PRECEDING), f AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING)),
w AS (SELECT * FROM g WHERE len(x) = 24 AND len(y) = 8),
k AS (SELECT series_id, start, CASE WHEN x[i] <= x[i+1] AND x[i+1] <= x[i+2] THEN 0 WHEN x[i] <= x[i+2] AND x[i+2] < x[i+1] THEN 1
  WHEN x[i+1] < x[i] AND x[i] <= x[i+2] THEN 2 WHEN x[i+1] <= x[i+2] AND x[i+2] < x[i] THEN 3 WHEN x[i+2] < x[i] AND x[i] <= x[i+1] THEN 4 ELSE 5 END AS p
  FROM w, range(1, 23) r(i)),
kc AS (SELECT series_id, start, p, count(*)::DOUBLE / 22 AS q FROM k GROUP BY ALL),
e AS (SELECT series_id, start, round(greatest(0, least(1, -sum(q * ln(q + 1e-12)) / ln(6))), 6) AS entropy FROM kc GROUP BY ALL),
m AS (SELECT series_id, start, round(list_sum(list_transform(y, lambda v: (v - x[24]) * (v - x[24]))) / 8, 8) AS error,
  list_min(x) AS lo, list_max(x) AS hi, x FROM w),
b AS (SELECT series_id, start, least(floor((v - lo) / (hi - lo) * 25), 24) AS bin, count(*) AS c FROM (SELECT *, unnest(x) AS v FROM m) GROUP BY ALL),
bs AS (SELECT series_id, start, max(c) / 24.0 AS bin_share FROM b GROUP BY ALL),
a AS (SELECT m.series_id, m.start, entropy, error, CASE WHEN hi = lo THEN 1.0 ELSE bin_share END AS bin_share,
  len(list_filter(x, lambda v: v <= lo + greatest((hi - lo) * 0.01, 1e-3) OR v >= hi - greatest((hi - lo) * 0.01, 1e-3))) / 24.0 AS sat, list_stddev_pop(x) < 1e-3 AS cons
  FROM m JOIN e USING (series_id, start) JOIN bs USING (series_id, start)),
t AS (SELECT series_id, quantile_cont(error, 1/3.0) AS e1, quantile_cont(error, 2/3.0) AS e2, quantile_cont(entropy, 1/3.0) AS p1, quantile_cont(entropy, 2/3.0) AS p2 FROM a GROUP BY 1),
bands AS (SELECT a.*, CASE WHEN error <= e1 THEN 'low' WHEN error <= e2 THEN 'medium' ELSE 'high' END AS error_band,
  CASE WHEN entropy <= p1 THEN 'low' WHEN entropy <= p2 THEN 'medium' ELSE 'high' END AS entropy_band, bin_share >= 0.25 OR sat >= 0.08 OR cons AS quality_issue FROM a JOIN t USING (series_id)),
staged AS (SELECT *, CASE WHEN entropy_band = 'high' THEN 'hard' WHEN error_band = 'low' AND entropy_band = 'low' THEN 'easy' ELSE 'medium' END AS stage FROM bands)
"""


@query(CURRICULUM + "SELECT series_id, start, entropy, error, error_band, entropy_band, stage, quality_issue FROM staged")
def m18_curriculum_bands(spark, d):
    w = win.curriculum(series(spark, d))
    return w.select("series_id", F.col("start").cast("long"), "entropy", "error", "error_band", "entropy_band", "stage", "quality_issue")


@query(CURRICULUM + "SELECT series_id, stage, count(*) AS windows, sum(quality_issue::INT)::BIGINT AS issues, count(*) FILTER (stage IN ('easy', 'medium')) AS in_easy_medium FROM staged GROUP BY ALL")
def a1_stage_distribution(spark, d):
    w = win.curriculum(series(spark, d))
    return w.groupBy("series_id", "stage").agg(
        F.count("*").alias("windows"), F.sum(F.col("quality_issue").cast("long")).alias("issues"),
        F.count(F.when(F.col("stage").isin("easy", "medium"), 1)).alias("in_easy_medium"),
    )


@query(f"""WITH {USERS}, a AS (SELECT *, median(value) OVER e AS med, avg(value) OVER e AS mean, min(value) OVER e AS lo, max(value) OVER e AS hi,
  value - lag(value) OVER w AS d1, value - 2 * lag(value) OVER w + lag(value, 2) OVER w AS d2, lag(value) OVER w AS b1, lag(value, 24) OVER w AS b24
  FROM s WINDOW w AS (PARTITION BY series_id ORDER BY pos), e AS (PARTITION BY series_id)),
c AS (SELECT *, sum(value - med) OVER (PARTITION BY series_id ORDER BY pos) AS cusum, greatest((hi - lo) * 0.01, 1e-3) AS mg FROM a)
SELECT series_id, count(*) AS n_points, round(any_value(med), 5) AS median, round(median(abs(value - med)), 5) AS mad,
 round(sum((value - mean) * (b1 - mean)) / sum((value - mean) * (value - mean)), 5) AS acf1,
 round(coalesce(sum((value - mean) * (b24 - mean)) / sum((value - mean) * (value - mean)), 0), 5) AS acf24, round(max(abs(cusum)), 5) AS cusum_max,
 round((quantile_cont(value, 0.975) - quantile_cont(value, 0.025)) / (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)), 5) AS quantile_kurtosis,
 round(max(abs(d1)), 5) AS max_slope, round(max(abs(d2)), 5) AS max_second_diff,
 round(avg((value <= lo + mg OR value >= hi - mg)::INT), 5) AS saturation, round(stddev_pop(value), 5) AS sd,
 round(arg_min(value, pos), 5) AS start, round(arg_max(value, pos), 5) AS "end", round(arg_max(value, pos) - arg_min(value, pos), 5) AS net_change, round(avg(abs(d1)), 5) AS mean_abs_step,
 round(regr_slope(value, b1), 5) AS ar1_slope, round(regr_intercept(value, b1), 5) AS ar1_intercept FROM c GROUP BY series_id""")
def m1_m15_series_features(spark, d):
    return win.features(series(spark, d, "user_id"))


@query(f"""WITH {USERS}, d AS (SELECT *, sign(value - lag(value) OVER (PARTITION BY series_id ORDER BY pos)) AS g FROM s), e AS (SELECT * FROM d WHERE g IS NOT NULL),
p AS (SELECT *, coalesce(last_value(CASE WHEN g <> 0 THEN g END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM e),
r AS (SELECT *, sum(CASE WHEN g = 0 OR g = prev THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY pos) AS run FROM p),
z AS (SELECT series_id, run, count(*) AS c FROM r GROUP BY ALL), n AS (SELECT series_id, count(*) AS n FROM s GROUP BY 1)
SELECT series_id, max(c) AS longest, round(max(c) / any_value(n), 6) AS monotone_share FROM z JOIN n USING (series_id) GROUP BY series_id""")
def m10_longest_monotone_run(spark, d):
    return win.longest_monotone_run(series(spark, d, "user_id"))


@query(f"""WITH {USERS}, e AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n, first_value(value) OVER w AS f, last_value(value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l,
 sum(value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS sm FROM s WINDOW w AS (PARTITION BY series_id ORDER BY pos))
SELECT series_id, pos, round((sm + greatest(3 - pos, 0) * f + greatest(pos + 3 - (n - 1), 0) * l) / 7, 4) AS trend,
 round(value - (sm + greatest(3 - pos, 0) * f + greatest(pos + 3 - (n - 1), 0) * l) / 7, 4) AS season FROM e""")
def m20_moving_average(spark, d):
    m = win.moving_average(series(spark, d, "user_id"), 7)
    return m.select("series_id", F.col("pos").cast("long"), F.round("trend", 4).alias("trend"), F.round("season", 4).alias("season"))


@query(f"""WITH {USERS}, a AS (SELECT series_id, list(value ORDER BY pos) AS x FROM s GROUP BY 1 HAVING count(*) >= 5), w AS (SELECT series_id, list_concat(list_concat([x[3], x[2]], x), [x[-2], x[-1]]) AS y, len(x) AS n FROM a),
p AS (SELECT series_id, y, i FROM w, range(3, 100) r(i) WHERE i <= n + 2)
SELECT series_id, count(*) FILTER (y[i] >= y[i-2] AND y[i] >= y[i-1] AND y[i] >= y[i+1] AND y[i] >= y[i+2]) AS peaks, count(*) FILTER (y[i] <= y[i-2] AND y[i] <= y[i-1] AND y[i] <= y[i+1] AND y[i] <= y[i+2]) AS valleys FROM p GROUP BY 1""")
def m21_turning_points(spark, d):
    t = win.turning_points(series(spark, d, "user_id"))
    return t.groupBy("series_id").agg(F.count(F.when(F.col("peak"), 1)).alias("peaks"), F.count(F.when(F.col("valley"), 1)).alias("valleys"))


@query("""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1)
SELECT row_number() OVER (ORDER BY day) - 1 AS pos, CAST(day AS VARCHAR) AS day, value FROM o""")
def s1_daily_series(spark, d):
    return daily(spark, d).select(F.col("pos").cast("long"), F.col("day").cast("string"), F.col("value"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders WHERE o_custkey >= 0) WHERE n = 1""")
def s4_keyed_last_wins(spark, d):
    return keyed_last(table(spark, d, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query(f"""WITH {USERS}, g AS (SELECT series_id, pos, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY series_id ORDER BY pos) AS gap FROM s),
c AS (SELECT series_id, gap, count(*) AS c, min(pos) AS p FROM g WHERE gap > 0 GROUP BY ALL)
SELECT series_id, gap AS frequency_us, c AS times FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY c DESC, p) AS n FROM c) WHERE n = 1""")
def d1_infer_frequency(spark, d):
    s = series(spark, d, "user_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = micros - F.lag(micros).over(win.along())
    g = s.select("series_id", "pos", gap.alias("gap")).where("gap > 0").groupBy("series_id", "gap").agg(F.count("*").alias("times"), F.min("pos").alias("first"))
    first = Window.partitionBy("series_id").orderBy(F.desc("times"), "first")
    return g.withColumn("n", F.row_number().over(first)).where("n = 1").select("series_id", F.col("gap").alias("frequency_us"), "times")


# --- forecasters, errors, ranks, routing ------------------------------------------------------


@query(f"WITH {ERRORS} SELECT *, round(0.6 / (1 + sqrt(mse / 10000)), 6) AS score FROM errors")
def p3_forecast_errors(spark, d):
    return model_errors(spark, d).withColumn("score", F.round(scores.norm_mse_score(F.col("mse") / 10000), 6))


@query(f"WITH {ERRORS} SELECT *, row_number() OVER (PARTITION BY sample ORDER BY mse, model) AS rank FROM errors")
def w2_rank_models(spark, d):
    return sel.rank_models(model_errors(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {ROUTES} SELECT * FROM routes")
def c23_route_info(spark, d):
    return routes(spark, d)


THRESHOLDS = ROUTES + """, md(best) AS (VALUES ('naive'), ('seasonal'), ('drift')), th AS (SELECT md.best, round(greatest(coalesce(quantile_cont(improvement_rel, 0.8) FILTER (improvement_rel > 0), 0.0), 0.35), 6) AS threshold FROM md LEFT JOIN routes USING (best) GROUP BY 1)"""
TRIAGE = THRESHOLDS + """, tr AS (SELECT routes.*, coalesce(threshold, 1.0) AS threshold, CASE WHEN best = 'mean' OR improvement_rel <= 0.05 THEN 'keep'
 WHEN improvement_rel >= coalesce(threshold, 1.0) AND (margin_rel >= 0.08 OR NOT default_in_top2) THEN 'override' ELSE 'ambiguous' END AS bucket FROM routes LEFT JOIN th USING (best))"""


@query(f"WITH {THRESHOLDS} SELECT * FROM th")
def a10_override_thresholds(spark, d):
    return sel.override_thresholds(routes(spark, d), MODELS, DEFAULT)


def triaged(spark, d):
    r = kept(routes(spark, d))
    return sel.triage(r, sel.override_thresholds(r, MODELS, DEFAULT), DEFAULT)


@query(f"""WITH {TRIAGE} SELECT sample, best, bucket, CASE bucket WHEN 'keep' THEN 'keep_default' WHEN 'override' THEN 'override_to_' || best ELSE '' END AS label,
 CASE bucket WHEN 'keep' THEN CASE WHEN best = 'mean' THEN 'high' ELSE 'mid' END WHEN 'override' THEN 'high' ELSE '' END AS confidence FROM tr""")
def c24_triage(spark, d):
    return triaged(spark, d).select("sample", "best", "bucket", "label", "confidence")


@query(f"WITH {TRIAGE} SELECT bucket, count(*) AS n, round(avg(improvement_rel), 5) AS mean_improvement, count(DISTINCT best) AS models FROM tr GROUP BY 1")
def a11_triage_summary(spark, d):
    return triaged(spark, d).groupBy("bucket").agg(
        F.count("*").alias("n"), F.round(F.avg("improvement_rel"), 5).alias("mean_improvement"), F.count_distinct("best").alias("models")
    )


@query(f"""WITH {ERRORS}, b AS (SELECT *, mse - min(mse) OVER (PARTITION BY sample) AS regret FROM errors)
SELECT model, round(avg(mse), 2) AS mean_mse, round(avg(regret), 2) AS mean_regret, quantile_disc(regret, 0.9) AS p90, quantile_disc(regret, 0.95) AS p95 FROM b GROUP BY 1""")
def a7_expert_summary(spark, d):
    e = kept(model_errors(spark, d).withColumn("regret", F.col("mse") - F.min("mse").over(Window.partitionBy("sample"))))
    q = quantiles(e, "regret", (0.9, 0.95), ("model",), nearest=True)
    means = e.groupBy("model").agg(F.round(F.avg("mse"), 2).alias("mean_mse"), F.round(F.avg("regret"), 2).alias("mean_regret"))
    return means.join(q, "model").select("model", "mean_mse", "mean_regret", F.col("q0").alias("p90"), F.col("q1").alias("p95"))


@query(f"""WITH {ROUTES} SELECT sample, round(CASE WHEN default_error = 0 THEN 0.0 ELSE (default_error - best_error) / default_error END, 6) AS risk_value,
 CASE WHEN default_error <> 0 AND (default_error - best_error) / default_error >= 0.15 THEN 'risky' ELSE 'safe' END AS risk_label FROM routes""")
def c25_risk_label(spark, d):
    risk = scores.ratio(F.col("default_error") - F.col("best_error"), F.col("default_error"))
    return routes(spark, d).select("sample", F.round(risk, 6).alias("risk_value"), F.when(risk >= 0.15, "risky").otherwise("safe").alias("risk_label"))


# --- joins -----------------------------------------------------------------------------------


@query("""SELECT o_orderkey, c_name, coalesce(c_acctbal, -1.0) AS bal FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c ON o_custkey = c_custkey""")
def j1_left_lookup(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name", F.coalesce("c_acctbal", F.lit(-1.0)).alias("bal"))


@query("SELECT count(*) AS customers, round(avg((c_custkey IN (SELECT o_custkey FROM orders))::INT), 6) AS coverage FROM customer")
def j2_coverage(spark, d):
    keys = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("hit")).distinct()
    return table(spark, d, "customer").join(keys, "c_custkey", "left").agg(
        F.count("*").alias("customers"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("coverage")
    )


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS done FROM customer")
def j6_resume_split(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    done = c.join(o, "c_custkey", "left_semi").select("c_custkey", F.lit(True).alias("done"))
    return done.unionByName(c.join(o, "c_custkey", "left_anti").select("c_custkey", F.lit(False).alias("done")))


@query("""SELECT coalesce(b.k, a.k) AS k, coalesce(b.v, a.v) AS v FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_acctbal > 0) a
FULL JOIN (SELECT c_custkey AS k, -c_acctbal AS v FROM customer WHERE c_mktsegment = 'BUILDING') b ON a.k = b.k""")
def j7_upsert(spark, d):
    c = table(spark, d, "customer")
    old = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"), (-F.col("c_acctbal")).alias("w"))
    return old.join(new, "k", "full").select("k", F.coalesce("w", "v").alias("v"))


# --- aggregations ------------------------------------------------------------------------------


@query("SELECT coalesce(nullif(lang, 'en'), '__missing__') AS value, count(*) AS n FROM documents GROUP BY 1")
def a1_value_distribution(spark, d):
    lang = F.coalesce(F.nullif("lang", F.lit("en")), F.lit("__missing__"))
    return table(spark, d, "documents").groupBy(lang.alias("value")).agg(F.count("*").alias("n"))


@query("SELECT source AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def a2_top_distribution(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(5)


@query("SELECT role, count(*) AS n, count(DISTINCT conv_id) AS sources FROM conversations GROUP BY 1")
def a4_coverage_by_stage(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("sources"))


@query("""WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS fp,
 count(*) FILTER (quality = 1 AND toxic = 1) AS fn, count(*) FILTER (quality = 0 AND toxic = 1) AS tn FROM labels)
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def a13_confusion(spark, d):
    return scores.confusion(table(spark, d, "labels"), F.col("toxic") == 0, F.col("quality") == 1)


@query("""WITH u AS (SELECT event_type, user_id, avg(value) FILTER (NOT isnan(value)) AS m, CASE WHEN count(*) FILTER (NOT isnan(value)) > 1 THEN stddev_samp(value) FILTER (NOT isnan(value)) ELSE 0 END AS s, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, round(avg(m), 4) AS mean_at_n, round(avg(s), 4) AS std_at_n, max(n) AS n FROM u GROUP BY 1""")
def a22_mean_std_at_n(spark, d):
    u = table(spark, d, "events").groupBy("event_type", "user_id").agg(
        F.avg(F.when(~F.isnan("value"), F.col("value"))).alias("m"),
        F.coalesce(F.stddev_samp(F.when(~F.isnan("value"), F.col("value"))), F.lit(0.0)).alias("s"), F.count("*").alias("n"),
    )
    return u.groupBy("event_type").agg(F.round(F.avg("m"), 4).alias("mean_at_n"), F.round(F.avg("s"), 4).alias("std_at_n"), F.max("n").alias("n"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f, arg_min(value, event_id) AS v FROM events GROUP BY ALL)
SELECT user_id, event_type AS majority, n AS votes, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k FROM c) WHERE k = 1""")
def a24_majority_vote(spark, d):
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("votes"), F.min("event_id").alias("f"), F.min_by("value", "event_id").alias("value"))
    w = Window.partitionBy("user_id").orderBy(F.desc("votes"), "f")
    return c.withColumn("k", F.row_number().over(w)).where("k = 1").select("user_id", F.col("event_type").alias("majority"), "votes", "value")


@query("""SELECT l_returnflag, round(avg(l_quantity), 4) AS mean, max(l_quantity) AS most, min(l_quantity) AS least, round(avg((l_discount >= 0.1)::INT), 6) AS clip_ratio, round(avg((l_tax = 0)::INT), 6) AS aborted_ratio,
 round(1 - var_samp(l_extendedprice - l_quantity * 1000) / (var_samp(l_extendedprice) + 1e-5), 5) AS explained FROM lineitem GROUP BY 1""")
def a19_batch_metrics(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.avg("l_quantity"), 4).alias("mean"), F.max("l_quantity").alias("most"), F.min("l_quantity").alias("least"),
        F.round(F.avg((F.col("l_discount") >= 0.1).cast("int")), 6).alias("clip_ratio"), F.round(F.avg((F.col("l_tax") == 0).cast("int")), 6).alias("aborted_ratio"),
        F.round(1 - F.var_samp(F.col("l_extendedprice") - F.col("l_quantity") * 1000) / (F.var_samp("l_extendedprice") + 1e-5), 5).alias("explained"),
    )


# --- selection and rebalancing -------------------------------------------------------------------


@query("""WITH o AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS place, count(*) OVER () AS n FROM customer)
SELECT c_custkey, place FROM o WHERE place IN (SELECT round_even(i * (n - 1) / 16, 0)::INT FROM range(17) r(i), (SELECT any_value(n) AS n FROM o))""")
def k2_evenly_spaced(spark, d):
    r = sel.evenly_spaced(table(spark, d, "customer").select("c_custkey"), "c_custkey", 17)
    return r.select("c_custkey", F.col("place").cast("long"))


@query("""WITH o AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS place, count(*) OVER () AS n FROM customer)
SELECT c_custkey, place FROM o WHERE place IN (SELECT floor(i * (n - 1) / 16)::INT FROM range(17) r(i), (SELECT any_value(n) AS n FROM o))""")
def k3_evenly_spaced_floor(spark, d):
    r = sel.evenly_spaced(table(spark, d, "customer").select("c_custkey"), "c_custkey", 17, "floor")
    return r.select("c_custkey", F.col("place").cast("long"))


@query("""WITH o AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 AS place, count(*) OVER () AS n FROM customer),
b AS (SELECT o.*, i AS bucket FROM o JOIN range(20) r(i) ON place >= floor(i * n / 20) AND place < floor((i + 1) * n / 20))
SELECT c_custkey, c_acctbal, bucket FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY c_acctbal DESC, c_custkey) AS k FROM b) WHERE k = 1""")
def k4_bucket_best(spark, d):
    return sel.bucket_best(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", "c_acctbal", 20).withColumn("bucket", F.col("bucket").cast("long"))


SEGMENTS = ["MACHINERY", "AUTOMOBILE", "BUILDING", "HOUSEHOLD", "FURNITURE", "NONE"]
BALANCED = """WITH m AS (SELECT s, row_number() OVER (ORDER BY i) - 1 AS j FROM (SELECT unnest(['MACHINERY', 'AUTOMOBILE', 'BUILDING', 'HOUSEHOLD', 'FURNITURE', 'NONE']) AS s, generate_subscripts([1, 2, 3, 4, 5, 6], 1) AS i) WHERE s IN (SELECT c_mktsegment FROM customer)),
q AS (SELECT s, j, greatest(1, {0} // (SELECT count(*) FROM m)) + CASE WHEN j < greatest(0, {0} - greatest(1, {0} // (SELECT count(*) FROM m)) * (SELECT count(*) FROM m)) THEN 1 ELSE 0 END AS quota FROM m),
r AS (SELECT c_custkey, c_mktsegment, c_acctbal, j, quota, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey DESC) AS k FROM customer JOIN q ON s = c_mktsegment),
z AS (SELECT *, row_number() OVER (ORDER BY (k > quota), CASE WHEN k <= quota THEN j ELSE 0 END, CASE WHEN k <= quota THEN k ELSE 0 END, c_acctbal DESC, c_custkey DESC) AS o FROM r)
SELECT c_custkey, c_mktsegment, c_acctbal FROM z WHERE o <= {0}"""


@query(BALANCED.format(23))
def k7_balanced_quota(spark, d):
    return sel.quota(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_mktsegment", "c_acctbal", "c_custkey", 23, SEGMENTS)


@query(BALANCED.format(3))
def k7_fewer_than_groups(spark, d):
    return sel.quota(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_mktsegment", "c_acctbal", "c_custkey", 3, SEGMENTS)


@query("""WITH o AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS place, count(*) OVER () AS n FROM customer) SELECT c_custkey FROM o WHERE place = n // 2""")
def k2_one_row(spark, d):
    return sel.evenly_spaced(table(spark, d, "customer").select("c_custkey"), "c_custkey", 1).select("c_custkey")


@query("""SELECT c_custkey, c_mktsegment, k AS rn FROM (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer
 WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey)) WHERE k <= greatest(1, ceil(n * 0.35))""")
def w6_top_fraction(spark, d):
    r = sel.top_fraction(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_mktsegment", "c_acctbal", "c_custkey", 0.35)
    return r.select("c_custkey", "c_mktsegment", F.col("rn").cast("long"))


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents),
m AS (SELECT *, max(n) OVER () AS mx FROM r) SELECT doc_id, lang, i AS copy FROM m, LATERAL (SELECT unnest(range(mx // n + CASE WHEN k <= mx % n THEN 1 ELSE 0 END)) AS i)""")
def b7_class_balance(spark, d):
    return sel.balance_classes(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id").withColumn("copy", F.col("copy").cast("long"))


@query("SELECT conv_id, turn, role, i AS copy FROM conversations, LATERAL (SELECT unnest(range(CASE role WHEN 'user' THEN 2 WHEN 'assistant' THEN 3 ELSE 1 END)) AS i)")
def b5_stage_repeat(spark, d):
    times = F.when(F.col("role") == "user", 2).when(F.col("role") == "assistant", 3).otherwise(1)
    return sel.copies(table(spark, d, "conversations").select("conv_id", "turn", "role"), times).withColumn("copy", F.col("copy").cast("long"))


# --- trajectories ---------------------------------------------------------------------------------


@query(f"""WITH {STEPS}, l AS (SELECT grp, trajectory, arg_max(reward, step) AS reward FROM t GROUP BY ALL),
g AS (SELECT *, count(*) OVER w AS c, avg(reward) OVER w AS m, stddev_samp(reward) OVER w AS s FROM l WINDOW w AS (PARTITION BY grp))
SELECT grp, trajectory, reward, round(CASE WHEN c > 1 THEN (reward - m) / (s + 1e-6) ELSE reward / (1 + 1e-6) END, 5) AS advantage FROM g""")
def w14_group_advantages(spark, d):
    return sel.group_advantages(steps(spark, d))


@query(f"""WITH RECURSIVE {STEPS}, e AS (SELECT *, reward + 0.9 * coalesce(lead(value) OVER w, 0) - value AS delta, row_number() OVER (PARTITION BY trajectory ORDER BY step DESC) AS k
 FROM t WINDOW w AS (PARTITION BY trajectory ORDER BY step)),
g AS (SELECT trajectory, step, k, delta AS adv FROM e WHERE k = 1 UNION ALL SELECT e.trajectory, e.step, e.k, e.delta + 0.9 * 0.8 * g.adv FROM g JOIN e ON e.trajectory = g.trajectory AND e.k = g.k + 1)
SELECT trajectory, step, round(adv, 6) AS advantage FROM g""")
def w13_gae(spark, d):
    return sel.gae(steps(spark, d))


@query("SELECT conv_id, arg_max(text, turn) FILTER (role = 'assistant' AND trim(text) <> '') AS content FROM conversations GROUP BY 1")
def t24_last_assistant(spark, d):
    keep = (F.col("role") == "assistant") & (F.trim("text") != "")
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by(F.when(keep, F.col("text")), F.when(keep, F.col("turn"))).alias("content"))


# --- text codecs ------------------------------------------------------------------------------------

@query("SELECT event_id, props, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def g7_json_map(spark, d):
    m = F.from_json("props", "map<string,bigint>")
    return table(spark, d, "events").select("event_id", "props", F.try_element_at(m, F.lit("k")).alias("k"))
