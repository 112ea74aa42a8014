"""Registered queries of series features, time stamps and forecasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, text
from ..operators import arima, audits, forecasts, kernels
from ..operators import windows as win
from ..sources.tables import series, table
from .queries import TYPES, USERS, query
from .rewards import N, PAIRS, pairs, r

XS = f"{USERS}, a AS (SELECT series_id, list(value ORDER BY pos) AS x FROM s GROUP BY 1)"


def whole(spark, d):
    """One array a user: all values in order."""
    s = series(spark, d, "user_id").groupBy("series_id")
    return s.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda p: p["value"]).alias("x"))


@query(f"""WITH {PAIRS}, p AS (SELECT series_id, start, k, list_sum(list_transform(range(1, {N + 1}), lambda i: x[i] * cos(2 * pi() * k * (i - 1) / {N}))) AS re, list_sum(list_transform(range(1, {N + 1}), lambda i: x[i] * sin(2 * pi() * k * (i - 1) / {N}))) AS im FROM w, range({N // 2}) t(k)),
q AS (SELECT series_id, start, k, re * re + im * im AS pw FROM p), z AS (SELECT *, pw / sum(pw) OVER (PARTITION BY series_id, start) AS sh FROM q) SELECT series_id, start, round(arg_max(k, pw) / {N}, 6) AS peak_freq, round(-sum(sh * log2(sh)), 5) AS spec_entropy FROM z GROUP BY ALL""")
def m4_spectrum(spark, d):
    w = pairs(spark, d).select("series_id", "start", kernels.spectrum(F.col("x")).alias("s"))
    return w.select("series_id", "start", r(F.col("s.peak_freq")).alias("peak_freq"), r(F.col("s.spec_entropy"), 5).alias("spec_entropy"))


@query(f"SELECT series_id, 1.0 AS pca_var_ratio, 0.0 AS mean_abs_corr FROM ({'SELECT DISTINCT user_id AS series_id FROM events'})")
def m7_one_channel(spark, d):
    return series(spark, d, "user_id").select("series_id").distinct().select("series_id", F.lit(1.0).alias("pca_var_ratio"), F.lit(0.0).alias("mean_abs_corr"))


#: The penalised optimum by its definition: sums of the kernel over blocks of five points, then every last cut of every end.
CUTS = f"""RECURSIVE {USERS}, a AS (SELECT series_id, list(value ORDER BY pos) AS x, count(*) AS n FROM s GROUP BY 1 HAVING count(*) >= 10), v AS (SELECT series_id, n, unnest(x) AS y, generate_subscripts(x, 1) - 1 AS i FROM a),
p AS (SELECT l.series_id, l.n, l.i, r.i AS j, (l.y - r.y) ** 2 AS d FROM v l JOIN v r USING (series_id)), md AS (SELECT series_id, CASE WHEN median(d) FILTER (i < j) > 0 THEN 1 / median(d) FILTER (i < j) ELSE 1.0 END AS g FROM p GROUP BY 1),
k AS (SELECT series_id, i // 5 AS u, j // 5 AS w, sum(exp(-least(greatest(g * d, 0.01), 100))) AS t, sum(exp(-least(greatest(g * d, 0.01), 100))) FILTER (i = j) AS dg FROM p JOIN md USING (series_id) GROUP BY ALL),
e AS (SELECT series_id, n, unnest(range(0, (n + 4) // 5 + 1)) AS b FROM a), c AS (SELECT l.series_id, l.n, l.b AS f, r.b AS e, least(r.b * 5, l.n) - l.b * 5 AS m FROM e l JOIN e r ON l.series_id = r.series_id AND l.b < r.b),
ct AS (SELECT c.series_id, c.n, f, e, m, sum(dg) - sum(t) / any_value(m) AS cost FROM c JOIN k ON k.series_id = c.series_id AND u >= f AND u < e AND w >= f AND w < e GROUP BY c.series_id, c.n, f, e, m),
cl AS (SELECT series_id, n, e, list(CASE WHEN m >= 2 THEN cost END ORDER BY f) AS costs FROM ct GROUP BY ALL),
z AS (SELECT series_id, 0 AS e, [0.0::DOUBLE] AS best, [0] AS prev FROM a UNION ALL SELECT z.series_id, cl.e, list_append(best, list_min(o)), list_append(prev, list_position(o, list_min(o)) - 1) FROM (SELECT z.series_id, z.best, z.prev, cl.e, list_transform(range(1, cl.e + 1), lambda q: best[q] + costs[q] + 5) AS o FROM z JOIN cl ON cl.series_id = z.series_id AND cl.e = z.e + 1) z JOIN cl ON cl.series_id = z.series_id AND cl.e = z.e),
fin AS (SELECT z.series_id, z.prev, z.e FROM z JOIN (SELECT series_id, max(e) AS e FROM z GROUP BY 1) USING (series_id, e)), bk AS (SELECT series_id, prev, e AS pl FROM fin UNION ALL SELECT series_id, prev, prev[pl + 1] FROM bk WHERE pl > 0),
cp AS (SELECT series_id, pl * 5 AS pos FROM bk WHERE pl > 0 AND pl < (SELECT e FROM fin WHERE fin.series_id = bk.series_id))"""


@query(f"""WITH {CUTS}, sg AS (SELECT s.series_id, s.pos, s.value, (SELECT count(*) FROM cp WHERE cp.series_id = s.series_id AND cp.pos <= s.pos) AS g FROM s), me AS (SELECT series_id, g, avg(value) AS m FROM sg GROUP BY ALL),
j AS (SELECT *, abs(m - lag(m) OVER (PARTITION BY series_id ORDER BY g)) AS jump FROM me) SELECT series_id, least(count(*) - 1, 5)::DOUBLE AS changepoint_count, round(coalesce(max(jump), 0), 6) AS changepoint_score FROM j GROUP BY 1""")
def m8_change_points(spark, d):
    return win.change_summary(series(spark, d, "user_id")).withColumn("changepoint_score", F.round("changepoint_score", 6))


@query()
def m11_peaks(spark, d):
    return whole(spark, d).select("series_id", kernels.peak_shape(F.col("x")).alias("p")).select("series_id", "p.*")


@query(f"""WITH {USERS}, l AS (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY pos) AS b FROM s), m AS (SELECT series_id, regr_slope(value, b) AS sl, regr_intercept(value, b) AS ic FROM l GROUP BY 1), e AS (SELECT series_id, pos, value - ic - sl * b AS e FROM l JOIN m USING (series_id) WHERE b IS NOT NULL),
f AS (SELECT *, avg(e) OVER (PARTITION BY series_id) AS me, stddev_pop(e) OVER (PARTITION BY series_id) AS sd, lag(e) OVER (PARTITION BY series_id ORDER BY pos) AS pe, row_number() OVER (PARTITION BY series_id ORDER BY abs(e)) - 1 AS k, count(*) OVER (PARTITION BY series_id) AS n FROM e)
SELECT series_id, 0.0 AS residual_mean, round(max(abs(e)), 4) AS residual_max, round(avg((abs(e) > 2 * (sd + 1e-8))::INT), 6) AS residual_exceed, round(sum((e - me) * (pe - me)) / sum((e - me) * (e - me)), 5) AS residual_acf1, round(sum(abs(e)) FILTER (k >= floor(0.9 * n)) / (sum(abs(e)) + 1e-8), 5) AS residual_concentration FROM f GROUP BY 1""")
def m12_residuals(spark, d):
    e = win.residual_features(series(spark, d, "user_id"))
    return e.select("series_id", *(r(F.col(c), n).alias(c) for c, n in (("residual_mean", 6), ("residual_max", 4), ("residual_exceed", 6), ("residual_acf1", 5), ("residual_concentration", 5))))


@query(f"""WITH {PAIRS}, d AS (SELECT series_id, start, x, list_transform(range(1, {N}), lambda i: x[i + 1] - x[i]) AS dd FROM w), t AS (SELECT *, 1.5 * list_stddev_pop(dd) + 1e-6 AS th, 0.05 * list_stddev_pop(x) + 1e-6 AS sl FROM d),
c AS (SELECT *, list_concat(list_concat([0], list_filter(range(1, {N - 1}), lambda i: abs(dd[i + 1] - dd[i]) > th)), [{N - 1}]) AS cuts FROM t),
g AS (SELECT *, list_transform(range(1, least(len(cuts), 9)), lambda i: x[cuts[i] + 1:cuts[i + 1] + 1]) AS ps FROM c), p AS (SELECT *, CASE WHEN len(ps) < 3 THEN [x[1:{N // 3}], x[{N // 3 + 1}:{2 * (N // 3)}], x[{2 * (N // 3) + 1}:]] ELSE ps END AS parts FROM g),
k AS (SELECT *, list_transform(list_filter(parts, lambda q: len(q) >= 2), lambda q: CASE WHEN q[-1] - q[1] > sl THEN 0 WHEN q[-1] - q[1] < -sl THEN 1 WHEN list_stddev_pop(q) > 2 * sl THEN 3 ELSE 2 END) AS kinds FROM p),
n AS (SELECT series_id, start, len(parts) AS segments, len(list_filter(kinds, lambda v: v = 0)) AS rise, len(list_filter(kinds, lambda v: v = 1)) AS fall, len(list_filter(kinds, lambda v: v = 2)) AS flat, len(list_filter(kinds, lambda v: v = 3)) AS oscillation FROM k)
SELECT *, list_position([rise, fall, flat, oscillation], greatest(rise, fall, flat, oscillation)) - 1 AS dominant FROM n""")
def m16_event_segments(spark, d):
    w = pairs(spark, d).select("series_id", "start", kernels.events(F.col("x")).alias("e")).select("series_id", "start", "e.*")
    return w.select("series_id", "start", *(F.col(c).cast("long") for c in ("segments", "rise", "fall", "flat", "oscillation", "dominant")))


@query("SELECT user_id AS series_id, round(sum(CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE value END), 4) AS total, count(*) FILTER (event_id % 4 > 1) AS finite FROM events GROUP BY 1")
def m17_sanitized(spark, d):
    v = F.when(F.col("event_id") % 4 == 0, float("nan")).when(F.col("event_id") % 4 == 1, float("inf")).otherwise(F.col("value"))
    x = table(spark, d, "events").select(F.col("user_id").alias("series_id"), audits.finite(v).alias("v"))
    return x.groupBy("series_id").agg(F.round(F.sum(F.coalesce("v", F.lit(0.0))), 4).alias("total"), F.count("v").alias("finite"))


# --- time stamps --------------------------------------------------------------------------------------------


STAMPS = f"""{USERS}, k AS (SELECT series_id, pos, CASE WHEN series_id % 4 = 0 OR (series_id % 4 = 1 AND pos % 3 = 1) OR (series_id % 4 = 2 AND pos = 5) THEN epoch_us(date_trunc('hour', ts)) + pos * 60000000 END AS t FROM s)"""


@query(f"""WITH {STAMPS}, v AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY pos) AS i, lead(t) OVER (PARTITION BY series_id ORDER BY pos) - t AS gap FROM k WHERE t IS NOT NULL), fq AS (SELECT series_id, gap FROM (SELECT series_id, gap, row_number() OVER (PARTITION BY series_id ORDER BY count(*) DESC, min(pos)) AS n FROM v WHERE gap > 0 GROUP BY series_id, gap) WHERE n = 1),
g AS (SELECT series_id, count(t) AS c, count(*) AS n, min(pos) FILTER (t IS NOT NULL) AS p0, arg_min(t, pos) FILTER (t IS NOT NULL) AS t0 FROM k GROUP BY 1)
SELECT series_id, pos, CASE WHEN c = n THEN t WHEN c = 0 THEN 946684800000000 + pos * 3600000000 WHEN c > 1 THEN t0 + (pos - p0) * coalesce(gap, 3600000000) ELSE t0 + (pos - p0) * 3600000000 END AS at_us FROM k JOIN g USING (series_id) LEFT JOIN fq USING (series_id)""")
def d2_repaired_stamps(spark, d):
    s = series(spark, d, "user_id")
    i, p = F.col("series_id") % 4, F.col("pos")
    t = F.unix_micros(F.date_trunc("hour", F.col("ts").cast("timestamp"))) + p * 60000000
    k = s.select("series_id", p.cast("long").alias("pos"), F.when((i == 0) | ((i == 1) & (p % 3 == 1)) | ((i == 2) & (p == 5)), t).alias("t"))
    return win.repaired_stamps(k, "t", 3600 * 10**6).select("series_id", "pos", "at_us")


@query("""WITH q AS (SELECT event_id, '2024-' || lpad((event_id % 14)::VARCHAR, 2, '0') || '-' || lpad((event_id % 33)::VARCHAR, 2, '0') || CASE WHEN event_id % 2 = 0 THEN '  ' ELSE ' ' END || lpad((user_id % 26)::VARCHAR, 2, '0') || ':00:00' AS s FROM events)
SELECT event_id, try_strptime(regexp_replace(s, '\\s+', ' '), '%Y-%m-%d %H:%M:%S') IS NOT NULL AS valid FROM q""")
def d4_valid_stamps(spark, d):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    gap = F.when(F.col("event_id") % 2 == 0, "  ").otherwise(" ")
    s = F.concat(F.lit("2024-"), two(F.col("event_id") % 14), F.lit("-"), two(F.col("event_id") % 33), gap, two(F.col("user_id") % 26), F.lit(":00:00"))
    return table(spark, d, "events").select("event_id", text.valid_stamp(s).alias("valid"))


@query(f"WITH {STAMPS} SELECT series_id, arg_max({{'t': t}}, pos).t AS last_us FROM k GROUP BY 1")
def d5_last_stamp(spark, d):
    s = series(spark, d, "user_id")
    i, p = F.col("series_id") % 4, F.col("pos")
    t = F.unix_micros(F.date_trunc("hour", F.col("ts").cast("timestamp"))) + p * 60000000
    k = s.select("series_id", "pos", F.when((i == 0) | ((i == 1) & (p % 3 == 1)) | ((i == 2) & (p == 5)), t).alias("t"))
    return k.groupBy("series_id").agg(F.max_by(F.struct("t"), "pos")["t"].alias("last_us"))


# --- forecasters -----------------------------------------------------------------------------------------------


@query(f"""WITH {PAIRS}, m AS (SELECT series_id, start, y, 'naive' AS model, list_transform(range(1, {N + 1}), lambda i: x[{N}]) AS p FROM w UNION ALL SELECT series_id, start, y, 'mean', list_transform(range(1, {N + 1}), lambda i: list_avg(x)) FROM w
 UNION ALL SELECT series_id, start, y, 'drift', list_transform(range(1, {N + 1}), lambda i: x[{N}] + (x[{N}] - x[1]) / {N - 1} * i) FROM w UNION ALL SELECT series_id, start, y, 'nobody', NULL FROM w)
SELECT series_id, start, model, CASE WHEN p IS NOT NULL THEN round(sqrt(list_avg(list_transform(range(1, {N + 1}), lambda i: (p[i] - y[i]) ** 2))), 6) END AS rmse, CASE WHEN p IS NULL THEN 'unknown model nobody' END AS error FROM m""")
def p1_p7_p8_scored_forecasts(spark, d):
    f = forecasts.predict(pairs(spark, d), "x", ["naive", "mean", "drift", "nobody"], N, N)
    return forecasts.scored(f, "forecast", "y").select("series_id", "start", "model", F.round(F.sqrt("mse"), 6).alias("rmse"), "error")


@query()
def p2_autoregression(spark, d):
    f = forecasts.predict(whole(spark, d), "x", ["autoregression"], 8)
    return f.select("series_id", F.size("forecast").alias("n"), F.round(arrays.mean(F.col("forecast")), 4).alias("mean"))


def _eliminated(source: str, name: str, keys: str, regressors: list[str], target: str) -> str:
    """SQL of one regression from sums ``a_b`` in ``source``: weights ``w_*`` and ``rss``, by elimination one regressor at a time."""
    cell = lambda a, b: f"{a}_{b}" if _ORDER.index(a) <= _ORDER.index(b) else f"{b}_{a}"
    columns, out = [*regressors, target], []
    out.append(f"{name}0 AS (SELECT {keys}, {target}_{target} AS tt, " + ", ".join(f"{cell(r, c)} AS m_{r}_{c}" for r in regressors for c in columns) + ", " + ", ".join(f"{cell(r, target)} AS b_{r}" for r in regressors) + f" FROM {source})")
    for i, p in enumerate(regressors):
        cells = []
        for r in regressors:
            for c in columns:
                new = f"m_{p}_{c} / nullif(m_{p}_{p}, 0)" if r == p else f"m_{r}_{c} - m_{r}_{p} * m_{p}_{c} / nullif(m_{p}_{p}, 0)"
                cells.append(f"{new} AS m_{r}_{c}")
        out.append(f"{name}{i + 1} AS (SELECT {keys}, tt, {', '.join(cells)}, {', '.join(f'b_{r}' for r in regressors)} FROM {name}{i})")
    rss = " - ".join(["tt", *(f"m_{r}_{target} * b_{r}" for r in regressors)])
    out.append(f"{name} AS (SELECT {keys}, {', '.join(f'm_{r}_{target} AS w_{r}' for r in regressors)}, {rss} AS rss FROM {name}{len(regressors)})")
    return ", ".join(out)


_LAGGED = [f"y{k}" for k in range(1, 6)]
_ORDER = ["one", *_LAGGED, *(f"e{k}" for k in range(1, 6)), "y0", "bf", "lv", "st"]
_TRIED = ((1, 1), (2, 1), (1, 2), (2, 2), (3, 1), (1, 3), (0, 1), (1, 0), (5, 0), (0, 5))


def _sums_sql(names: list[str], table: str) -> str:
    of = lambda n: "1.0::DOUBLE" if n == "one" else n
    ordered = sorted(names, key=_ORDER.index)
    sums = ", ".join(f"sum({of(a)} * {of(b)}) AS {a}_{b}" for i, a in enumerate(ordered) for b in ordered[i:])
    return f"SELECT series_id, count(*) AS m, {sums} FROM {table} WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in names if n != "one") + " GROUP BY 1"


_W = "PARTITION BY series_id ORDER BY pos"
ORDERS = f"""{TYPES}, sz AS (SELECT series_id, count(*) AS n, stddev_pop(value) AS sd FROM s GROUP BY 1), df AS (SELECT series_id, lag(value) OVER w AS lv, lag(value) OVER w - lag(value, 2) OVER w AS bf, value - lag(value) OVER w AS st FROM s WINDOW w AS ({_W})),
du AS ({_sums_sql(["one", "bf", "lv", "st"], "df")}), {_eliminated("du", "dr", "series_id, m, lv_lv, one_one, one_bf, one_lv, bf_bf, bf_lv", ["one", "bf", "lv"], "st")},
dv AS (SELECT series_id, m, w_lv, rss, (lv_lv - one_lv ** 2 / one_one) - (bf_lv - one_bf * one_lv / one_one) ** 2 / (bf_bf - one_bf ** 2 / one_one) AS vv FROM dr), dd AS (SELECT sz.*, CASE WHEN w_lv / sqrt(rss / (m - 3) / vv) < -2.86 THEN 0 ELSE 1 END AS d, w_lv / sqrt(rss / (m - 3) / vv) AS t FROM sz LEFT JOIN dv USING (series_id)),
yy AS (SELECT series_id, d, pos - d AS pos, CASE WHEN d = 0 THEN value ELSE value - p END AS y0 FROM (SELECT *, lag(value) OVER ({_W}) AS p FROM s) JOIN dd USING (series_id) WHERE n >= 12 AND sd >= 1e-6 AND (d = 0 OR p IS NOT NULL)),
yl AS (SELECT *, {", ".join(f"lag(y0, {k}) OVER w AS y{k}" for k in range(1, 6))} FROM yy WINDOW w AS ({_W})), ls AS ({_sums_sql(["one", *_LAGGED, "y0"], "yl")}), {_eliminated("ls", "lr", "series_id", ["one", *_LAGGED], "y0")},
er AS (SELECT yl.*, y0 - w_one - {" - ".join(f"w_{c} * {c}" for c in _LAGGED)} AS e0 FROM yl JOIN lr USING (series_id)), el AS (SELECT *, {", ".join(f"lag(e0, {k}) OVER w AS e{k}" for k in range(1, 6))} FROM er WINDOW w AS ({_W})), es AS ({_sums_sql([c for c in _ORDER if c not in ("bf", "lv", "st")], "el")}),
{", ".join(_eliminated("es", f"o{i}_", "series_id, m", ["one", *(f"y{k}" for k in range(1, p + 1)), *(f"e{k}" for k in range(1, q + 1))], "y0") for i, (p, q) in enumerate(_TRIED))},
al AS ({" UNION ALL ".join(f"SELECT series_id, {i} AS i, {p} AS p, {q} AS q, m * ln(rss / m) + {2 * (p + q + 1)} AS aic FROM o{i}_ WHERE rss > 0" for i, (p, q) in enumerate(_TRIED))}), bs AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY aic, i) = 1)"""


@query(f"WITH {ORDERS} SELECT series_id, n, round(t, 4) AS t_value, d FROM dd")
def p2_unit_root(spark, d):
    return arima.differencing(series(spark, d)).select("series_id", "n", F.round("t_value", 4).alias("t_value"), "d")


@query(f"WITH {ORDERS} SELECT series_id, d, p, q, round(aic, 3) AS aic FROM bs JOIN dd USING (series_id)")
def p2_order_choice(spark, d):
    return arima.choose(series(spark, d)).select("series_id", "d", "p", "q", F.round("aic", 3).alias("aic"))


@query(f"WITH {ORDERS} SELECT series_id, 'arima' AS method, d, p, q, 8 AS n FROM bs JOIN dd USING (series_id)")
def p2_arima_forecast(spark, d):
    f = arima.forecast(series(spark, d), 8)
    return f.select("series_id", "method", "d", "p", "q", F.size(F.filter("forecast", lambda v: ~F.isnan(v))).alias("n"))


@query("""SELECT event_id, coalesce(list_position(n, q), list_position(n, 'OT'), len(n)) - 1 AS target FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN ['a', 'OT', 'b'] WHEN 1 THEN ['a', 'b'] ELSE ['b', 'c', 'OT'] END AS n, CASE event_id % 2 WHEN 0 THEN 'b' END AS q FROM events)""")
def p6_target_index(spark, d):
    e = F.col("event_id")
    names = F.when(e % 3 == 0, F.array(*map(F.lit, ["a", "OT", "b"]))).when(e % 3 == 1, F.array(*map(F.lit, ["a", "b"]))).otherwise(F.array(*map(F.lit, ["b", "c", "OT"])))
    return table(spark, d, "events").select("event_id", forecasts.target_index(names, F.when(e % 2 == 0, "b")).alias("target"))


@query(f"""WITH {PAIRS} SELECT series_id, start, round(CASE start % 3 WHEN 0 THEN x[1] WHEN 1 THEN y[1] ELSE -1 END, 6) AS first, round(CASE WHEN start % 4 = 0 THEN NULL ELSE x[start % 4] END, 6) AS fitted_last FROM w""")
def p10_m35_fallbacks(spark, d):
    k = F.col("start") % 3
    chosen = forecasts.first_valid(N, F.when(k == 0, F.col("x")).otherwise(F.slice("x", 1, 3)), F.when(k == 1, F.col("y")), F.array_repeat(F.lit(-1.0), N))
    fit = forecasts.fitted(F.slice("x", F.lit(1), (F.col("start") % 4).cast("int")), N)
    return pairs(spark, d).select("series_id", "start", r(F.get(chosen, F.lit(0))).alias("first"), r(F.element_at(fit, -1)).alias("fitted_last"))


@query(f"""WITH {PAIRS}, e AS (SELECT series_id, start, x, y, list_transform(range(1, {N + 1}), lambda i: (x[i] + y[i]) / 2) AS f FROM w), m AS (SELECT *, list_avg(list_transform(range(1, {N + 1}), lambda i: (x[i] - y[i]) ** 2)) AS a, list_avg(list_transform(range(1, {N + 1}), lambda i: (f[i] - y[i]) ** 2)) AS b,
 list_avg(list_transform(range(1, {N + 1}), lambda i: abs(x[i] - y[i]))) AS c, list_avg(list_transform(range(1, {N + 1}), lambda i: abs(f[i] - y[i]))) AS d2, list_max(list_transform(range(1, {N + 1}), lambda i: abs(x[i] - f[i]))) AS g FROM e)
SELECT series_id, start, round(a, 6) AS selected_mse, round(b, 6) AS final_mse, round(c - d2, 6) AS mae_gain, b > a AS degraded, b < a AS improved, g <= 1e-8 AS copied FROM m""")
def c19_refinement(spark, d):
    w = pairs(spark, d).withColumn("f", F.zip_with("x", "y", lambda a, b: (a + b) / 2))
    return forecasts.refinement(w, "x", "f", "y").select("series_id", "start", r(F.col("selected_mse")).alias("selected_mse"), r(F.col("final_mse")).alias("final_mse"),
                                                         r(F.col("mae_gain")).alias("mae_gain"), "degraded", "improved", "copied")
