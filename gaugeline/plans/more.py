"""Further registered queries: lookups, audits, sequence, rule and codec operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays, scores
from ..operators import selection as sel
from ..operators import windows as win
from ..operators.ordering import kept, numbered, quantiles
from ..sources.tables import model_errors, series, table
from .queries import CURRICULUM, ERRORS, ROUTES, STEPS, TYPES, USERS, query, routes, steps


def count_if(c):
    return F.count(F.when(c, 1))


# --- joins and audits ------------------------------------------------------------------------


@query("""SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'HOUSEHOLD'""")
def j4_inner_lookup(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment <> 'HOUSEHOLD'")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")


@query("""SELECT (SELECT count(*) FROM orders SEMI JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'HOUSEHOLD') c ON o_custkey = c_custkey) AS matched,
 (SELECT count(*) FROM orders ANTI JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'HOUSEHOLD') c ON o_custkey = c_custkey) AS missed""")
def j5_match_and_miss_counts(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment <> 'HOUSEHOLD'").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("hit"))
    j = table(spark, d, "orders").join(c, "o_custkey", "left")
    return j.agg(count_if(F.col("hit").isNotNull()).alias("matched"), count_if(F.col("hit").isNull()).alias("missed"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def j9_exclude_selected(spark, d):
    done = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@query("""WITH t(f, limit_) AS (VALUES ('A', 0.05), ('N', 0.04)) SELECT l_returnflag, count(*) FILTER (l_discount >= coalesce(limit_, 1.0)) AS over, count(*) AS n
 FROM lineitem LEFT JOIN t ON l_returnflag = f GROUP BY 1""")
def j10_threshold_lookup(spark, d):
    t = spark.createDataFrame([("A", 0.05), ("N", 0.04)], "l_returnflag string, bound double")  # two rows: a bounded broadcast
    j = table(spark, d, "lineitem").join(F.broadcast(t), "l_returnflag", "left")
    return j.groupBy("l_returnflag").agg(count_if(F.col("l_discount") >= F.coalesce("bound", F.lit(1.0))).alias("over"), F.count("*").alias("n"))


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type IN ('error', 'purchase')), b AS (SELECT DISTINCT user_id FROM events WHERE event_type NOT IN ('error', 'purchase'))
SELECT (SELECT count(*) FROM a) AS left_ids, (SELECT count(*) FROM b) AS right_ids, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS overlap""")
def j14_split_overlap(spark, d):
    left = F.col("event_type").isin("error", "purchase")
    sides = table(spark, d, "events").groupBy("user_id").agg(F.max(left).alias("a"), F.max(~left).alias("b"))
    return sides.agg(count_if(F.col("a")).alias("left_ids"), count_if(F.col("b")).alias("right_ids"), count_if(F.col("a") & F.col("b")).alias("overlap"))


@query(f"""WITH {USERS}, p AS (SELECT * FROM s WHERE series_id % 2 = 0), q AS (SELECT series_id - 1 AS series_id, pos, value FROM s WHERE series_id % 2 = 1)
SELECT p.series_id, count(*) AS n, round(avg((p.value - q.value) ** 2), 5) AS mse, round(avg(abs(p.value - q.value)), 5) AS mae,
 round(avg((p.value - q.value) ** 2) / greatest(stddev_pop(q.value), 1e-8) ** 2, 5) AS norm_mse, count(*) FILTER (abs(p.value - q.value) > 1e-8) AS changed,
 max(abs(p.value - q.value)) <= 1e-8 AS copied FROM p JOIN q USING (series_id, pos) GROUP BY 1""")
def m27_m30_positional_errors(spark, d):
    s = series(spark, d, "user_id")
    q = s.where("series_id % 2 = 1").select((F.col("series_id") - 1).alias("series_id"), "pos", F.col("value").alias("truth"))
    diff = F.col("value") - F.col("truth")
    mse, sd = F.avg(diff * diff), F.greatest(F.stddev_pop("truth"), F.lit(1e-8))
    return s.where("series_id % 2 = 0").join(q, ["series_id", "pos"]).groupBy("series_id").agg(
        F.count("*").alias("n"), F.round(mse, 5).alias("mse"), F.round(F.avg(F.abs(diff)), 5).alias("mae"),
        F.round(mse / (sd * sd), 5).alias("norm_mse"), count_if(F.abs(diff) > 1e-8).alias("changed"),
        (F.max(F.abs(diff)) <= 1e-8).alias("copied"),
    )


# --- aggregates --------------------------------------------------------------------------------


@query(f"""WITH {ERRORS}, g AS (SELECT *, mse - min(mse) OVER (PARTITION BY sample) AS regret FROM errors), m AS (SELECT model, round(avg(mse), 6) AS a, round(avg(regret), 6) AS b, quantile_disc(regret, 0.9) AS c FROM g GROUP BY 1)
SELECT model AS default_expert FROM m ORDER BY a, b, c, model LIMIT 1""")
def a8_default_expert(spark, d):
    e = kept(model_errors(spark, d).withColumn("regret", F.col("mse") - F.min("mse").over(Window.partitionBy("sample"))))
    m = e.groupBy("model").agg(F.round(F.avg("mse"), 6).alias("a"), F.round(F.avg("regret"), 6).alias("b"))
    m = m.join(quantiles(e, "regret", (0.9,), ("model",), nearest=True), "model")
    return m.orderBy("a", "b", "q0", "model").limit(1).select(F.col("model").alias("default_expert"))


@query("SELECT event_type, round(quantile_cont(value, 1/3.0), 6) AS low, round(quantile_cont(value, 2/3.0), 6) AS high, max(value) AS most, min(value) AS least FROM events GROUP BY 1")
def a9_tertiles(spark, d):
    e = table(spark, d, "events")
    finite = F.when(~F.isnan("value"), F.col("value"))
    ends = e.groupBy("event_type").agg(F.max(finite).alias("most"), F.min(finite).alias("least"))
    q = quantiles(e, "value", (1 / 3, 2 / 3), ("event_type",))
    return ends.join(q, "event_type").select("event_type", F.round("q0", 6).alias("low"), F.round("q1", 6).alias("high"), "most", "least")


@query("""SELECT conv_id, count(*) AS steps, min(length(text)) AS fastest, round(avg(length(text)), 5) AS mean, max(length(text)) AS slowest,
 arg_max(turn, length(text) * 1000 - turn) AS slowest_step, sum(length(text))::BIGINT AS total FROM conversations GROUP BY 1""")
def a21_trajectory_timing(spark, d):
    n = F.length("text").cast("long")
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("steps"), F.min(n).alias("fastest"), F.round(F.avg(n), 5).alias("mean"), F.max(n).alias("slowest"),
        F.max_by("turn", n * 1000 - F.col("turn")).alias("slowest_step"), F.sum(n).alias("total"),
    )


# --- sequence operators ---------------------------------------------------------------------------


@query(f"WITH {STEPS} SELECT grp, trajectory, step, reward FROM (SELECT *, max(step) OVER (PARTITION BY trajectory) AS m FROM t) WHERE step = m")
def w10_terminal_step(spark, d):
    w = Window.partitionBy("trajectory")
    return steps(spark, d).withColumn("m", F.max("step").over(w)).where("step = m").select("grp", "trajectory", "step", "reward")


@query(f"""WITH {USERS}, k AS (SELECT series_id, pos, (value > 100)::INT AS g FROM s), b AS (SELECT *, CASE WHEN g = lag(g) OVER w THEN 0 ELSE 1 END AS brk FROM k WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
r AS (SELECT *, sum(brk) OVER (PARTITION BY series_id ORDER BY pos) AS run FROM b) SELECT series_id, pos, g, row_number() OVER (PARTITION BY series_id, run ORDER BY pos) - 1 AS rollout FROM r""")
def w11_rollout_number(spark, d):
    k = series(spark, d, "user_id").select("series_id", F.col("pos").cast("long"), (F.col("value") > 100).cast("int").alias("g"))
    w = win.along()
    b = k.withColumn("brk", F.when(F.col("g") == F.lag("g").over(w), 0).otherwise(1))
    r = b.withColumn("run", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.row_number().over(Window.partitionBy("series_id", "run").orderBy("pos")) - 1
    return r.select("series_id", "pos", "g", n.cast("long").alias("rollout"))


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, CASE role WHEN 'user' THEN 0 ELSE 1 END, turn) - 1 AS new_index, count(*) OVER (PARTITION BY conv_id) AS turn_count FROM conversations")
def w17_reindex(spark, d):
    order = F.when(F.col("role") == "user", 0).otherwise(1)
    rows = table(spark, d, "conversations").select("conv_id", "turn", order.alias("_o"), F.count("*").over(Window.partitionBy("conv_id")).alias("turn_count"))
    return numbered(rows, "conv_id", "_o", "turn", name="new_index").select("conv_id", "turn", "new_index", "turn_count")


@query(f"""WITH {ROUTES}, r AS (SELECT sample, best, row_number() OVER (PARTITION BY best ORDER BY margin_rel DESC, sample) AS k, count(*) OVER (PARTITION BY best) AS n FROM routes)
SELECT sample, best, CASE WHEN k <= ceil(n / 2.0) THEN 'high' ELSE 'mid' END AS tier FROM r""")
def w5_rank_tiers(spark, d):
    w = Window.partitionBy("best")
    r = routes(spark, d).withColumn("k", F.row_number().over(w.orderBy(F.desc("margin_rel"), "sample"))).withColumn("n", F.count("*").over(w))
    return r.select("sample", "best", F.when(F.col("k") <= F.ceil(F.col("n") / 2), "high").otherwise("mid").alias("tier"))


@query(f"""WITH {USERS}, a AS (SELECT *, 1.5 * stddev_pop(d) OVER (PARTITION BY series_id) + 1e-6 AS th FROM (SELECT *, value - lag(value) OVER (PARTITION BY series_id ORDER BY pos) AS d FROM s))
SELECT series_id, count(*) FILTER (abs(d - pd) > th) AS breaks FROM (SELECT *, lag(d) OVER (PARTITION BY series_id ORDER BY pos) AS pd FROM a) GROUP BY 1""")
def m16_event_breaks(spark, d):
    w, every = win.along(), Window.partitionBy("series_id")
    s = series(spark, d, "user_id").withColumn("d", F.col("value") - F.lag("value").over(w))
    s = s.withColumn("bound", 1.5 * F.stddev_pop("d").over(every) + 1e-6).withColumn("before", F.lag("d").over(w))
    return s.groupBy("series_id").agg(count_if(F.abs(F.col("d") - F.col("before")) > F.col("bound")).alias("breaks"))


@query(f"""WITH {USERS}, a AS (SELECT *, value - lag(value) OVER w AS dl, value - lead(value) OVER w AS dr FROM s WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
m AS (SELECT series_id, median(dl) AS md FROM a GROUP BY 1), v AS (SELECT series_id, greatest(3 * median(abs(dl - md)), 1e-4) AS th FROM a JOIN m USING (series_id) GROUP BY 1)
SELECT series_id, pos FROM a JOIN v USING (series_id) WHERE abs(dl) > th AND abs(dr) > th AND dl * dr > 0""")
def m32_spikes(spark, d):
    w, every = win.along(), Window.partitionBy("series_id")
    s = series(spark, d, "user_id").withColumn("dl", F.col("value") - F.lag("value").over(w)).withColumn("dr", F.col("value") - F.lead("value").over(w))
    s = s.withColumn("md", F.median("dl").over(every)).withColumn("mad", F.median(F.abs(F.col("dl") - F.col("md"))).over(every))
    bound = F.greatest(3 * F.col("mad"), F.lit(1e-4))
    return s.where((F.abs("dl") > bound) & (F.abs("dr") > bound) & (F.col("dl") * F.col("dr") > 0)).select("series_id", F.col("pos").cast("long"))


@query(f"""WITH {USERS} SELECT series_id, pos, round((value - avg(value) OVER w) / sqrt(var_pop(value) OVER w + 1e-5), 5) AS scaled FROM s WINDOW w AS (PARTITION BY series_id)""")
def m34_normalise(spark, d):
    w = Window.partitionBy("series_id")
    z = (F.col("value") - F.avg("value").over(w)) / F.sqrt(F.var_pop("value").over(w) + 1e-5)
    return series(spark, d, "user_id").select("series_id", F.col("pos").cast("long"), F.round(z, 5).alias("scaled"))


@query(f"""WITH {USERS}, n AS (SELECT series_id, list(value ORDER BY pos) AS x FROM s GROUP BY 1) SELECT series_id, i AS pos, x[least(i + 1, len(x))] AS value FROM n, range(70) r(i)""")
def m35_fit_to_horizon(spark, d):
    s = series(spark, d, "user_id").groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("x"))
    i = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(69)), lambda k: F.element_at("x", F.least(k + 1, F.size("x")))["value"]))
    return s.select("series_id", i.alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH {USERS} SELECT series_id, round(count(DISTINCT round(value, 6)) / count(*), 6) AS unique_ratio,
 CASE WHEN arg_max(value, pos) - arg_min(value, pos) > 1e-6 THEN 'up' WHEN arg_max(value, pos) - arg_min(value, pos) < -1e-6 THEN 'down' ELSE 'flat' END AS direction FROM s GROUP BY 1""")
def m31_unique_ratio_direction(spark, d):
    net = F.max_by("value", "pos") - F.min_by("value", "pos")
    return series(spark, d, "user_id").groupBy("series_id").agg(
        F.round(F.count_distinct(F.round("value", 6)) / F.count("*"), 6).alias("unique_ratio"), arrays.direction(net).alias("direction")
    )


# --- filters, stages, rules -------------------------------------------------------------------------


@query(CURRICULUM + """SELECT phase, count(*) AS windows FROM staged, (VALUES ('easy'), ('easy_medium'), ('all')) p(phase)
 WHERE phase = 'all' OR stage = 'easy' OR (phase = 'easy_medium' AND stage = 'medium') GROUP BY 1""")
def f2_curriculum_slices(spark, d):
    s = F.col("stage")
    phases = F.when(s == "easy", F.array(F.lit("easy"), F.lit("easy_medium"), F.lit("all"))).when(s == "medium", F.array(F.lit("easy_medium"), F.lit("all"))).otherwise(F.array(F.lit("all")))
    return win.curriculum(series(spark, d)).select(F.explode(phases).alias("phase")).groupBy("phase").agg(F.count("*").alias("windows"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN g = 0 THEN 0.0 WHEN g = 1 THEN 0.03 WHEN g = 2 THEN 0.05 WHEN g <= 5 THEN 0.08 WHEN g <= 20 THEN 0.12 WHEN g <= 100 THEN 0.18 ELSE 0.24 END
 + CASE WHEN p > e THEN least((p - e) / e, 1.0) * 0.05 ELSE 0.0 END AS penalty FROM (SELECT *, l_quantity AS p, 24.0::DOUBLE AS e, abs(l_quantity - 24) AS g FROM lineitem)""")
def c2_length_penalty(spark, d):
    p = scores.length_penalty(F.col("l_quantity"), F.lit(24.0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", p.alias("penalty"))


# --- selection, rebalancing, generators -----------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 2")
def k14_top2_membership(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("k", F.row_number().over(w)).where("k <= 2").select("o_custkey", "o_orderkey")


@query("""WITH a AS (SELECT o_custkey, o_orderkey, o_orderstatus, bool_or(o_orderstatus = 'P') OVER (PARTITION BY o_custkey) AS has, max(o_orderkey) OVER (PARTITION BY o_custkey) AS m FROM orders)
SELECT o_custkey, o_orderkey FROM a WHERE CASE WHEN has THEN o_orderstatus = 'P' ELSE o_orderkey = m END""")
def b1_source_frame(spark, d):
    w = Window.partitionBy("o_custkey")
    a = table(spark, d, "orders").withColumn("has", F.bool_or(F.col("o_orderstatus") == "P").over(w)).withColumn("m", F.max("o_orderkey").over(w))
    return a.where(F.when(F.col("has"), F.col("o_orderstatus") == "P").otherwise(F.col("o_orderkey") == F.col("m"))).select("o_custkey", "o_orderkey")


@query("""WITH n AS (SELECT count(*) FILTER (role <> 'assistant') AS o, count(*) FILTER (role = 'assistant') AS a FROM conversations), e AS (SELECT greatest(ceil(0.7 * o / (1 - 0.7))::BIGINT - a, 0) AS extra, a FROM n),
g AS (SELECT conv_id, count(*) AS k FROM conversations WHERE role = 'assistant' GROUP BY 1), b AS (SELECT *, coalesce(sum(k) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
m AS (SELECT conv_id, 1 + extra // a + CASE WHEN before < extra % a THEN 1 ELSE 0 END AS times FROM b, e)
SELECT conv_id, turn, role, count(*) AS copies FROM (SELECT c.conv_id, turn, role, unnest(range(CASE WHEN role = 'assistant' THEN times ELSE 1 END)) FROM conversations c LEFT JOIN m USING (conv_id)) GROUP BY ALL""")
def b2_oversample_sources(spark, d):
    r = sel.repeated_to_ratio(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "role", "assistant", 0.7)
    return r.groupBy("conv_id", "turn", "role").agg(F.count("*").alias("copies"))


@query("""SELECT user_id, list_distinct_ordered AS kinds, array_to_string(list_distinct_ordered, '->') AS signature, len(list_filter(['click', 'view', 'error'], lambda x: NOT list_contains(list_distinct_ordered, x))) AS missing FROM (
 SELECT user_id, list(event_type ORDER BY f) AS list_distinct_ordered FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL) GROUP BY 1)""")
def b9_b11_ordered_dedupe(spark, d):
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    e = first.groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("kinds")
    )
    need = F.array(F.lit("click"), F.lit("view"), F.lit("error"))
    return e.select("user_id", "kinds", F.array_join("kinds", "->").alias("signature"), F.size(F.array_except(need, "kinds")).cast("long").alias("missing"))


# --- text ---------------------------------------------------------------------------------------------


@query(f"""WITH {TYPES}, g AS (SELECT series_id, max(pos) AS n, arg_max(epoch_us(ts), pos) AS t1, arg_max(epoch_us(ts), pos) FILTER (pos < m) AS t0 FROM (SELECT *, max(pos) OVER (PARTITION BY series_id) AS m FROM s) GROUP BY 1)
SELECT series_id, i AS step, t1 + (t1 - t0) * (i + 1) AS at_us FROM g, range(8) r(i)""")
def d3_future_timestamps(spark, d):
    s = series(spark, d).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    g = s.groupBy("series_id").agg(F.slice(F.array_sort(F.collect_list("us")), -2, 2).alias("t"))
    i = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("step")
    t0, t1 = F.element_at("t", 1), F.element_at("t", 2)
    return g.select("series_id", "t", i).select("series_id", F.col("step").cast("long"), (t1 + (t1 - t0) * (F.col("step") + 1)).alias("at_us"))
