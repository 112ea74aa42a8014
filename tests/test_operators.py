"""Every registered query against its SQL, and hand-computed cases."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeline import registry
from gaugeline.functions import arrays, policy, scores, text
from gaugeline.operators import arima, forecasts, kernels, learners, ordering, scans, selection, trajectories, windows
from gaugeline.sources import files
from gaugeline.streaming import state

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    """A value as lists, rounded numbers, strings and None, whatever frame it comes from."""
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def normal(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(([plain(v) for v in row] for row in frame.itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    mine = registry.QUERIES[name](spark, SF).toPandas()
    theirs = duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert normal(mine) == normal(theirs)


#: Kernels that SQL doesn't express; they are tested below.
NO_SQL = {"m11_peaks", "p2_autoregression", "a25_trained_audit"}


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL) | NO_SQL


def series(spark, values):
    return spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], "series_id string, pos long, value double")


def test_window_count(spark):
    assert windows.build_windows(series(spark, range(210)), 96, 96).count() == 19


def test_bucketed_windows_are_the_same(spark):
    s = series(spark, range(100))
    key = lambda w: sorted((r["start"], tuple(r["history"]), tuple(r["future"])) for r in w.collect())
    assert key(windows.build_windows(s, 5, 3)) == key(windows.build_windows_bucketed(s, 5, 3, 16))


def test_even_spacing_rounds_half_to_even(spark):
    rows = spark.createDataFrame([(i,) for i in range(10)], "i long")
    assert sorted(r["i"] for r in selection.evenly_spaced(rows, "i", 4).collect()) == [0, 3, 6, 9]


def test_bucket_best(spark):
    rows = spark.createDataFrame([(0, 0.4), (1, 0.7), (2, 0.5), (3, 0.9)], "i long, s double")
    assert sorted(r["i"] for r in selection.bucket_best(rows, "i", "s", 2).collect()) == [1, 3]


def test_group_advantages(spark):
    rows = spark.createDataFrame([(1, 1, 0, 9.0), (1, 1, 1, 1.0), (1, 2, 0, 3.0), (2, 3, 0, 5.0)], "grp long, trajectory long, step long, reward double")
    got = {r["trajectory"]: r["advantage"] for r in selection.group_advantages(rows).collect()}
    assert got[1] == pytest.approx(-0.70711, abs=1e-4) and got[2] == pytest.approx(0.70711, abs=1e-4)


def test_scores(spark):
    got = spark.range(1).select(scores.norm_mse_score(windows.F.lit(1.0)).alias("a"), scores.norm_mse_score(windows.F.lit(100.0)).alias("b")).first()
    assert got["a"] == pytest.approx(0.3) and got["b"] == pytest.approx(0.6 / 11)


# --- values from the rules' own examples -------------------------------------------------------------


def one(spark, **columns):
    """The values of column expressions over one row."""
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def numbers(*values):
    return F.array(*(F.lit(float(v)) for v in values))


def test_bands_and_stages(spark):
    pairs = {("low", "low"): "easy", ("medium", "low"): "medium", ("high", "medium"): "medium", ("low", "high"): "hard", ("high", "high"): "hard", ("unknown", "unknown"): "unknown"}
    rows = spark.createDataFrame([(*k, v) for k, v in pairs.items()], "a string, b string, want string")
    assert all(r[0] == r[1] for r in rows.select(windows.stage(F.col("a"), F.col("b")), "want").collect())
    nan, null, cut = F.lit(float("nan")), F.lit(None).cast("double"), F.lit(1.0)
    got = one(spark, a=windows.banded(nan, cut, cut), b=windows.banded(cut, null, null), c=windows.banded(cut, cut, cut), d=windows.banded(F.lit(2.0), cut, cut))
    assert tuple(got) == ("unknown", "medium", "low", "high")


def test_constant_series_have_features(spark):
    got = windows.features(series(spark, [5.0] * 30)).first()
    assert got["acf1"] == 0 and got["quantile_kurtosis"] == 0 and got["n_points"] == 30


def test_turning_points_look_at_two_neighbours(spark):
    xs = [0, 3, 2, 5, 1, 4, 0]
    got = windows.turning_points(series(spark, xs)).where("peak").collect()
    assert [r["pos"] for r in got] == [3]
    assert one(spark, p=arrays.turning_points(numbers(*xs), False))["p"] == [3]
    assert windows.turning_points(series(spark, xs[:4])).count() == 0


def route(spark, rows):
    return spark.createDataFrame(rows, "sample long, model string, mse double, mae double")


def test_routes_without_errors(spark):
    got = selection.route_info(route(spark, [(1, "a", 0.0, 0.0), (1, "mean", 0.0, 0.0), (2, "a", 1.0, 1.0), (2, "mean", 4.0, 1.0)]), "mean")
    got = {r["sample"]: r for r in got.collect()}
    assert got[1]["improvement_rel"] == 0 and got[1]["margin_rel"] == 0
    assert got[2]["improvement_rel"] == 0.75 and got[2]["margin_rel"] == 0.75  # over the second error


def test_thresholds_and_triage(spark):
    gains = [("patchtst", 0.7), ("patchtst", 0.6), ("patchtst", 0.5), ("arima", 0.1), ("arima", 0.2), ("chronos2", 0.45), ("arima", -0.5)]
    rows = spark.createDataFrame(gains, "best string, improvement_rel double")
    got = selection.override_thresholds(rows, ["patchtst", "arima", "chronos2", "other", "itransformer"], "itransformer")
    assert {r[0]: r[1] for r in got.collect()} == {"patchtst": 0.66, "arima": 0.35, "chronos2": 0.45, "other": 0.35}
    routes = spark.createDataFrame([("arima", 0.42, 0.12, False), ("patchtst", 0.18, 0.10, True)], "best string, improvement_rel double, margin_rel double, default_in_top2 boolean")
    labels = {r["best"]: (r["bucket"], r["label"]) for r in selection.triage(routes, got, "itransformer").collect()}
    assert labels == {"arima": ("override", "override_to_arima"), "patchtst": ("ambiguous", "")}


def test_even_spacing_of_one_few_and_none(spark):
    rows = spark.createDataFrame([(i,) for i in range(9)], "i long")
    took = lambda df: sorted(r["i"] for r in df.collect())
    assert took(selection.evenly_spaced(rows, "i", 1)) == [4] and took(selection.evenly_spaced(rows, "i", 1, single="first")) == [0]
    assert took(selection.evenly_spaced(rows, "i", 20)) == list(range(9)) and took(selection.evenly_spaced(rows, "i", 0)) == []
    assert took(selection.evenly_spaced_filled(rows, "i", 1)) == [0] and len(took(selection.evenly_spaced_filled(rows, "i", 8))) == 8
    assert took(selection.evenly_spaced(rows.limit(0), "i", 4)) == []


def test_quota_covers_every_model(spark):
    rows = spark.createDataFrame([(i, "abcd"[i % 4], float(i)) for i in range(8)], "i long, m string, s double")
    assert {r["m"] for r in selection.quota(rows, "m", "s", "i", 4, ["a", "b", "c", "d"]).collect()} == set("abcd")
    assert {r["m"] for r in selection.balanced_selection(rows, "i", "s", "m", 4).collect()} == set("abcd")


def test_places_and_quantiles(spark):
    values = np.random.default_rng(0).standard_normal(500).round(1)
    rows = spark.createDataFrame([(int(i), "ab"[i % 2], float(v)) for i, v in enumerate(values)], "i long, g string, v double").repartition(7)
    got = ordering.numbered(rows, "v", "i").collect()
    assert sorted(r["place"] for r in got) == list(range(500))
    ordered = sorted(got, key=lambda r: r["place"])
    assert [(r["v"], r["i"]) for r in ordered] == sorted((r["v"], r["i"]) for r in got)
    q = {r["g"]: (r["q0"], r["q1"]) for r in ordering.quantiles(rows, "v", (0.1, 0.5), ("g",)).collect()}
    for k, g in enumerate("ab"):
        assert q[g] == pytest.approx(tuple(np.quantile(values[k::2], (0.1, 0.5))))


TRUTH = [12.345, 12.678, 13.001]
ANSWER = "12.3450\n12.6780\n13.0010"


@pytest.mark.parametrize("solution,recovery,score,reason", [
    (f"<think>a</think><answer>{ANSWER}</answer>", False, 0.7, None),
    (f"<answer>{ANSWER}</answer>", True, 0.65, "missing_think_block"),
    (f"<answer>{ANSWER}</answer>", False, -1.0, "missing_think_block"),
    (f"<think>a</think><answer>{ANSWER}", True, 0.67, "missing_answer_close_tag"),
    (f"<answer>{ANSWER}\n14.0</answer>", True, 0.65, "missing_think_block"),
    ("<think>a</think><answer>2017-05-02 00:00:00 12.3450\n12.6780\n13.0010</answer>", False, -1.0, "invalid_answer_shape:mixed_line_formats"),
    ("plain", True, -1.0, "missing_answer_block"), (None, True, -1.0, "empty_solution"),
])
def test_rewards(spark, solution, recovery, score, reason):
    rows = spark.createDataFrame([(solution, TRUTH)], "s string, t array<double>")
    got = scores.with_reward(rows, "s", "t", recovery).first()
    assert got["score"] == pytest.approx(score) and got["reason"] == reason


def test_stamped_rows_score_as_values_do(spark):
    lines = "\n".join(f"2017-05-02 0{i}:00:00 {v:.4f}" for i, v in enumerate(TRUTH))
    rows = spark.createDataFrame([(f"<think>a</think><answer>{lines}</answer>", TRUTH)], "s string, t array<double>")
    assert scores.with_reward(rows, "s", "t", False).first()["score"] == pytest.approx(0.7)


def test_penalties_without_an_expected_length(spark):
    got = one(spark, a=scores.length_penalty(F.lit(3), F.lit(0)), b=scores.length_penalty(F.lit(6), F.lit(3)), c=scores.length_score(F.lit(0), F.lit(0)))
    assert got["a"] == 0 and got["b"] == pytest.approx(0.13) and got["c"] == 0


def test_reasons_look_at_tags_first(spark):
    rows = spark.createDataFrame([("plain",), ("<think>x",), ("x</answer>",), ("<think>a</think> b <answer>1</answer>",)], "s string")
    got = [r[0] for r in rows.select(text.strict_reason("s", F.lit(1))).collect()]
    assert got == ["missing_answer_block", "missing_think_close_tag", "missing_answer_open_tag", "extra_text_outside_tags"]


def test_prompt_records(spark):
    prompt = ("[Task] x\nTarget Column: OT\nHistorical Data:\n2016-08-29 11:00:00 HUFL=15.0000 HULL=12.5000 OT=25.8170\n"
              "2016-08-29 12:00:00 HUFL=16.0 HULL=12.0 OT=27.7870\n2016-08-29 13:00:00 HUFL=17.0 HULL=11.5 OT=28.4200")
    rows = spark.createDataFrame([(prompt,)], "s string").select(text.records("s", F.lit("OT")).alias("r")).first()["r"]
    assert [r["value"] for r in rows] == [25.817, 27.787, 28.42] and rows[0]["names"] == ["HUFL", "HULL", "OT"]


def test_advantages_and_spanning_trajectories(spark):
    rewards = [.10, .25, .30, .55, .60, .80, .95, 1.20]
    rows = spark.createDataFrame([(1, t, s, r if s == 2 else 7.0 + s) for t, r in enumerate(rewards) for s in range(3)], "grp long, trajectory long, step long, reward double")
    got = {r["trajectory"]: r["advantage"] for r in selection.group_advantages(rows).collect()}
    sd = np.std(rewards, ddof=1)
    assert [got[t] for t in range(8)] == pytest.approx([(r - np.mean(rewards)) / sd for r in rewards], abs=1e-4)
    both = rows.union(spark.createDataFrame([(2, 3, 5, 1.0)], rows.schema))
    assert [r[0] for r in selection.spanning_trajectories(both).collect()] == [3]


def test_visible_gains_against_the_default(spark):
    rows = spark.createDataFrame([(1, c, 0, [float(i + c) for i in range(4)], [0.0, 1.0, 2.0, 3.0]) for c in (0, 1)], "s long, c long, d long, x array<double>, v array<double>")
    got = {r["c"]: r for r in selection.visible_gains(rows, "s", "c", "d", "x", "v").collect()}
    assert got[0]["level_gain"] == 0 and got[1]["level_gain"] == 1.0 and got[1]["mean_gain"] == -1.0


def test_strict_lookups_refuse_a_miss(spark):
    rows, found = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "a")], "k long, v string")
    assert selection.strict_lookup(rows.where("k = 1"), found, "k").collect()[0]["v"] == "a"
    with pytest.raises(Exception, match="no k 2"):
        selection.strict_lookup(rows, found, "k").collect()


# --- kernels --------------------------------------------------------------------------------------------


def test_peaks_by_their_definition():
    rng = np.random.default_rng(4)
    for _ in range(60):
        x = rng.integers(0, 6, 40).astype(float)
        places, widths = kernels.peaks(x, 2.0)
        want, i = [], 1
        for i in range(1, 39):
            j = i
            while j < 39 and x[j + 1] == x[i]:
                j += 1
            if x[i - 1] < x[i] and j < 39 and x[j + 1] < x[i]:
                sides = []
                for step in (-1, 1):
                    k, low = i, x[i]
                    while 0 <= k < 40 and x[k] <= x[i]:
                        low, k = min(low, x[k]), k + step
                    sides.append(low)
                if x[i] - max(sides) >= 2.0:
                    want.append((i + j) // 2)
        assert places.tolist() == want and (widths > 0).all()


def test_change_points_of_a_step(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.1, 40), rng.normal(5, 0.1, 40)])
    assert kernels.breakpoints(x) == [40, 80] and kernels._change_points(x)[1] == pytest.approx(5, abs=0.2)
    assert kernels._change_points(x[:9]) == (0.0, 0.0)
    got = spark.createDataFrame([(x.tolist(),), ([],), (None,)], "x array<double>").select(kernels.change_points(F.col("x")).alias("c")).collect()
    assert [r["c"]["changepoint_count"] for r in got] == [1.0, 0.0, 0.0]


def test_change_points_are_the_optimum():
    x = np.random.default_rng(7).standard_normal(30).cumsum()
    d = (x[:, None] - x[None, :]) ** 2
    gram = np.exp(-np.clip(d / np.median(d[np.triu_indices(30, 1)]), 1e-2, 1e2))
    cost = lambda a, b: np.trace(gram[a:b, a:b]) - gram[a:b, a:b].sum() / (b - a)
    best = {0: (0.0, [])}
    for end in (5, 10, 15, 20, 25, 30):
        best[end] = min((v + cost(a, end) + 1.0, ends + [end]) for a, (v, ends) in best.items())
    assert kernels.breakpoints(x, 1.0) == best[30][1]


def test_autoregression_follows_a_line_and_a_wave():
    assert kernels.autoregression(np.arange(40.0), 3) == pytest.approx([40, 41, 42])
    wave = np.sin(np.arange(80) / 3)
    assert kernels.autoregression(wave, 5) == pytest.approx(np.sin(np.arange(80, 85) / 3), abs=1e-6)
    assert kernels.autoregression(np.ones(50), 2).tolist() == [1, 1]


def test_forecast_errors_stay_with_their_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0])], "i long, x array<double>")
    got = forecasts.predict(rows, "x", ["naive", "nobody"], 2, lookback=2)
    ok = got.where("forecast is not null").collect()
    assert [(r["i"], r["model"], r["forecast"]) for r in ok] == [(1, "naive", [2.0, 2.0])] and got.count() == 6
    assert forecasts.over_budget(got, "error", 0.5) and not forecasts.over_budget(got, "error", 0.9)


def test_batch_divisors(spark):
    got = one(spark, a=policy.batch_divisor(F.lit(12), F.lit(5)), b=policy.batch_divisor(F.lit(7), F.lit(3)), c=policy.batch_divisor(F.lit(10), F.lit(99)))
    assert tuple(got) == (6, 1, 10)  # of 4 and 6, as near, the larger one


# --- sources ------------------------------------------------------------------------------------------------


def test_upsert(spark):
    from gaugeline.streaming import features

    old, new = (spark.createDataFrame(r, "k long, v string") for r in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert sorted(map(tuple, features.upsert(new, old, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_contracts(spark, tmp_path):
    with pytest.raises(ValueError):
        files.parse_phases("stage1, nope")
    assert files.parse_phases(None) == [] and files.parse_phases(" Stage1,,stage1,FULL") == ["stage1", "full"]
    rows = spark.createDataFrame([("easy",), ("hard",), ("unknown",)], "curriculum_stage string")
    assert files.phase_rows(rows, "stage1", True).count() == 1 and files.phase_rows(rows, "full", True).count() == 3
    with pytest.raises(ValueError):
        files.phase_rows(rows, None, True)
    payload = {"dataset_kind": "k", "pipeline_stage": "s", "observed_feature_columns": ["a", "OT"], "observed_covariates": ["a"], "target_column": "OT", "model_input_width": 2, "historical_data_protocol": "p"}
    files.write_metadata(spark, payload, f"{tmp_path}/m")
    back = files.read_metadata(spark, f"{tmp_path}/m/*.txt")
    assert files.check_metadata(back, {"k"}, {"s"}) == payload and files.check_multivariate(back, ["a", "OT"], "OT", "p") == payload
    for kinds, stages in (({"x"}, None), ({"k"}, {"x"})):
        with pytest.raises(ValueError):
            files.check_metadata(back, kinds, stages)
    with pytest.raises(ValueError, match="model_input_width"):
        files.check_multivariate(back | {"model_input_width": 3}, ["a", "OT"], "OT", "p")


def test_sinks_refuse_bad_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1,), (2,)], "i long")
    with pytest.raises(ValueError):
        files.write_checked(rows, f"{tmp_path}/p", rows.where("i > 1"))
    assert files.write_jsonl(rows, f"{tmp_path}/j") == 2 and files.read_jsonl(spark, f"{tmp_path}/j", "i long").count() == 2
    rows.write.csv(f"{tmp_path}/c", header=True)
    with pytest.raises(ValueError, match="missing"):
        files.read_csv(spark, f"{tmp_path}/c", "i long", ("date",))
    with pytest.raises(ValueError):
        files.first_rows(rows, "i", 5, ["i"])
    with pytest.raises(ValueError):
        files.read_stage(spark, _parquet(rows.selectExpr("'x' AS turn_stage"), tmp_path), "y")


def _parquet(rows, folder):
    rows.write.parquet(f"{folder}/s")
    return f"{folder}/s"


# --- scans, orders, gates ------------------------------------------------------------------------------------


def test_scans_in_small_buckets_are_the_same(spark):
    rng = np.random.default_rng(2)
    x = {k: np.round(rng.normal(size=n), 1) for k, n in (("a", 203), ("b", 5), ("c", 1))}
    rows = spark.createDataFrame([(k, i, float(v)) for k, xs in x.items() for i, v in enumerate(xs)], "series_id string, pos long, value double")
    for f in (windows.features, windows.longest_monotone_run, windows.turning_points):
        assert normal(f(rows, bucket=7).toPandas()) == normal(f(rows).toPandas())
    assert normal(windows.moving_average(rows, 7, bucket=5).toPandas()) == normal(windows.moving_average(rows, 7).toPandas())
    steps = np.sign(np.diff(x["a"]))
    longest, run, before = 0, 0, 0.0
    for s in steps:
        run = run + 1 if s == 0 or s == before else 1
        before = s or before
        longest = max(longest, run)
    got = windows.longest_monotone_run(rows, bucket=3).where("series_id = 'a'").first()
    assert got["longest"] == longest


def test_affine_scan_equals_the_loop(spark):
    rng = np.random.default_rng(4)
    a, b = rng.uniform(-1, 1, 700), rng.normal(size=700)
    rows = spark.createDataFrame([("t", i, float(p), float(q)) for i, (p, q) in enumerate(zip(a, b))] + [("u", 0, 0.5, 2.0)], "series_id string, pos long, a double, b double")
    got = {(r["series_id"], r["pos"]): r["y"] for r in scans.affine_suffix(rows, "a", "b", "y", width=8, levels=2).collect()}
    y = 0.0
    for i in range(699, -1, -1):
        y = b[i] + a[i] * y
        assert abs(got["t", i] - y) < 1e-9
    assert got["u", 0] == 2.0 and len(got) == 701


def test_long_trajectory_is_scanned_in_linear_work(spark):
    n = 1_000_000
    steps = spark.range(n).select(F.lit(1).alias("trajectory"), F.col("id").alias("step"), F.lit(1.0).alias("reward"), F.lit(0.0).alias("value"))
    got = selection.gae(steps, 0.9, 0.8).where(F.col("step").isin(0, n - 1)).collect()
    assert {r["step"]: r["advantage"] for r in got} == {0: round(1 / (1 - 0.72), 6), n - 1: 1.0}


def test_downsampling_keeps_the_first_priority_rows(spark):
    rows = spark.createDataFrame([(i, "local_refine" if i < 3 else "other" if i < 5 else "validated_keep", i % 2 == 0) for i in range(40)], "k long, kind string, first boolean")
    keeps = lambda share: sorted(r["k"] for r in selection.kept_by_ratio(rows, "kind", "k", F.col("first"), share).collect() if r["k"] >= 5)
    assert keeps(0.3) == [6, 8, 10, 12]  # floor of 3 * 0.7 / 0.3, which is just under 7, less 2
    assert len(keeps(0.1)) == 25 and set(range(6, 40, 2)) <= set(keeps(0.1))
    assert keeps(0.9) == [] and keeps(0.01) == list(range(5, 40))


def test_orders_and_forecasts(spark):
    rng = np.random.default_rng(8)
    x = [0.0, 0.0]
    for e in rng.normal(size=3000):
        x.append(0.6 * x[-1] - 0.3 * x[-2] + e)
    walk = np.cumsum(rng.normal(size=500))
    data = {"ar": x, "walk": walk, "still": [3.0] * 50, "short": [1.0, 2.0, 5.0]}
    rows = spark.createDataFrame([(k, i, float(v)) for k, xs in data.items() for i, v in enumerate(xs)], "series_id string, pos long, value double")
    d = {r["series_id"]: r["d"] for r in arima.differencing(rows).collect()}
    assert d["ar"] == 0 and d["walk"] == 1
    chosen = {r["series_id"]: r for r in arima.choose(rows).collect()}
    assert set(chosen) == {"ar", "walk"}
    w = chosen["ar"]["w"]
    psi = {(2, 0): w[1:3]}.get((chosen["ar"]["p"], chosen["ar"]["q"]))
    assert psi is None or abs(psi[0] - 0.6) < 0.1
    f = {r["series_id"]: r for r in arima.forecast(rows, 4).collect()}
    assert f["still"]["forecast"] == [3.0] * 4 and f["short"]["forecast"] == [5.0] * 4 and f["short"]["method"] == "naive"
    one = 0.6 * x[-1] - 0.3 * x[-2]
    assert abs(f["ar"]["forecast"][0] - one) < 0.4 and abs(f["walk"]["forecast"][0] - walk[-1]) < 1.0 and f["ar"]["method"] == "arima"


def test_refused_calls_cost_nothing(spark):
    call = lambda p, t, n, m=None, w=True, dec="override": ("x", p, t, n, dec, m, w, None)
    calls = [
        call(0, 0, "route_time_series", "arima"), call(1, 0, "extract_data_quality"), call(2, 1, "extract_data_quality"), call(3, 1, "predict_time_series", "nobody"),
        call(4, 1, "route_time_series", "arima", dec="?"), call(5, 2, "route_time_series", "arima", False), call(6, 2, "route_time_series", "arima", False),
        call(7, 3, "route_time_series", "arima"), call(8, 3, "extract_event_summary"),
    ]
    df = spark.createDataFrame(calls, "series_id string, pos long, turn long, name string, decision string, model string, works boolean, stage string")
    none = spark.createDataFrame([], "series_id string, required array<string>")
    got = [(r["refused"], r["attempts"]) for r in trajectories.gated(df, none, 2, "patchtst").orderBy("pos").collect()]
    assert got == [
        ("routing_in_diagnostic_turn", 0), (None, 0), ("feature_tool_in_routing_turn", 0), ("invalid_model", 0), ("invalid_decision", 0), (None, 1), (None, 2),
        ("retry_budget_spent", 2), ("feature_tool_in_routing_turn", 2),
    ]
    more = [(r["refused"], r["attempts"]) for r in trajectories.gated(df, none, 5, "patchtst").orderBy("pos").collect()]
    assert more[7:] == [(None, 3), ("call_after_prediction", 3)]


def test_upsert_log_survives_replay_and_compaction(spark, tmp_path):
    from gaugeline.streaming import state

    frame = lambda rows: spark.createDataFrame(rows, "k long, v string, seq long")
    log, schema = state.UpsertLog(str(tmp_path / "t"), "k", "seq"), "k long, v string, seq long"
    rows = lambda: sorted((r["k"], r["v"]) for r in log.current(spark, schema).collect())
    log.store(frame([(1, "a", 0), (2, "b", 0)]), 0)
    log.store(frame([(2, "c", 2), (2, "x", 1), (3, "d", 0)]), 1)
    log.store(frame([(3, "e", 0)]), 2)
    want = [(1, "a"), (2, "c"), (3, "e")]
    assert rows() == want
    log.compact(spark, schema)
    assert rows() == want
    log.store(frame([(3, "e", 0)]), 2)  # stored again
    log.compact(spark, schema)
    assert rows() == want and [r["k"] for r in log.pending(spark, frame([(3, "", 0), (9, "", 0)]), schema).collect()] == [9]


def test_trained_audit_against_a_plain_fit(spark):
    from gaugeline.plans.records import labelled_texts

    features = ["size", "words", "word_length", "digits", "marks", "distinct_words"]
    rows = labelled_texts(spark, "/root/testdata/sf0.01")
    got = learners.trained_audit(rows, features, "quality", "split", "train", learners.models(trees=10, rounds=5)).toPandas()
    data = rows.toPandas()
    x = data[features].to_numpy(float)
    train, test = (data["split"] == "train").to_numpy(), (data["split"] == "test").to_numpy()
    x = np.where(np.isnan(x), np.nanmedian(x[train], 0), x)
    x = np.c_[np.ones(len(x)), (x - x[train].mean(0)) / x[train].std(0, ddof=1)]
    y = data["quality"].to_numpy(float)
    w = np.where(y == 1, 1 / y[train].sum(), 1 / (1 - y[train]).sum())
    beta = np.zeros(x.shape[1])
    for _ in range(300):  # plain Newton steps on the weighted likelihood
        p = 1 / (1 + np.exp(-np.clip(x[train] @ beta, -30, 30)))
        h = (x[train] * (w[train] * p * (1 - p))[:, None]).T @ x[train] + 1e-9 * np.eye(len(beta))
        beta += 0.5 * np.linalg.solve(h, x[train].T @ (w[train] * (y[train] - p)))
    s, t = x[test] @ beta, y[test]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[t == 1] for b in s[t == 0]])
    mine = got[(got["model"] == "logistic_regression") & (got["split"] == "test")].iloc[0]
    assert abs(mine["auc"] - auc) < 0.02 and mine["n"] == test.sum() and mine["positives"] == t.sum()
    assert len(got) == 6 and (got[got["split"] == "test"]["auc"] > 0.6).all()


def test_change_points_across_windows(spark):
    rng = np.random.default_rng(6)
    level = np.repeat([0.0, 8.0, -6.0, 4.0], [300, 255, 245, 400])
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(level + rng.normal(size=1200) * 0.1)] + [("b", i, 1.0) for i in range(9)], "series_id string, pos long, value double")
    found = {(r["series_id"], r["pos"]) for r in windows.change_points(rows, 120).collect()}
    assert found == {("a", 300), ("a", 555), ("a", 800)}
    got = {r["series_id"]: (r["changepoint_count"], r["changepoint_score"]) for r in windows.change_summary(rows, 120, bucket=100).collect()}
    assert got["a"][0] == 3 and abs(got["a"][1] - 14) < 0.1 and got["b"] == (0, 0)
    whole = kernels.breakpoints(np.array([r["value"] for r in rows.where("series_id = 'a' and pos < 400").orderBy("pos").collect()]))
    one = {r["pos"] for r in windows.change_points(rows.where("series_id = 'a' and pos < 400")).collect()}
    assert one == set(whole[:-1])


def test_quantiles_between_equal_neighbours(spark):
    """Between equal neighbours stands their value itself, not one a last bit below, or ties at a cut change their band."""
    values = [round(0.9 + i * 0.000707, 6) for i in range(60)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values) for _ in range(3 + i % 6)], "g int, v double")
    q = ordering.quantiles(rows, "v", (1 / 3, 2 / 3), ("g",)).collect()
    assert len(q) == 60 and all(r["q0"] == r["q1"] == values[r["g"]] for r in q)


def named_times(df, made, name: str) -> int:
    """How often the plan of a column names a function: a lambda's body is computed anew wherever its column is named."""
    return df.select(made.alias("x"))._jdf.queryExecution().analyzed().toString().lower().count(f"{name}(")


def test_tool_calls_are_read_once(spark):
    df = spark.createDataFrame([("<tool_call>{\"name\": \"a\"}</tool_call>",)], "s string")
    assert named_times(df, text.tool_calls("s", F.array(F.lit("a")), 2), "json_object_keys") == 1


def test_history_lines_are_split_once(spark):
    df = spark.createDataFrame([("Historical Data:\na=1",)], "s string")
    made = text.records("s", text.text_field("s", "Target Column"))
    assert named_times(df, made, "regexp_extract_all") == 2 and named_times(df, made, "split") == 1


def test_plans_rank_models_once(spark):
    f = F.struct(*(F.lit(0.5).alias(k) for k in ("acf1", "acf_seasonal", "cusum", "changepoints", "peaks", "spacing_cv", "monotone", "exceed", "quantization", "saturation", "segments")), F.lit("flat").alias("dominant"))
    assert named_times(spark.range(1), policy.plan(f), "array_sort") == 2  # the best model, and its rival


def test_clamped_lines_are_judged_once(spark):
    df = spark.createDataFrame([("<think>x</think><answer>1</answer>",)], "s string")
    assert named_times(df, text.clamp("s", F.lit(3)), "split") == 1
    assert named_times(df, text.plain_block("s"), "split") == 2  # lines of the block, lines of the text


class _Value:
    """A value state in memory."""

    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class _Map(dict):
    """A map state in memory."""

    containsKey, getValue, removeKey = dict.__contains__, dict.__getitem__, dict.__delitem__

    def updateValue(self, key, value):
        self[key] = value


class _Handle:
    def __init__(self):
        self.maps = []

    def getValueState(self, *_):
        return _Value()

    def getMapState(self, *_):
        self.maps.append(_Map())
        return self.maps[-1]

    def registerTimer(self, ms):
        self.timer = ms


class _Timers:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_count_windows_hold_a_piece_and_a_frame(spark):
    """Waiting rows are kept by spans of time and windows leave in frames of bounded size, in order, late rows included."""
    n, minute = 20_000, 60_000_000
    order = np.random.default_rng(5).permutation(n)
    rows = pd.DataFrame({"us": order * minute, "id": order, "value": order.astype(float)})
    handle, of = _Handle(), state.CountWindows(24, 8)
    of.init(handle)
    list(of.handleInputRows(("a",), iter([rows[:9000], rows[9000:]]), None))
    assert max(len(v[0]) for v in handle.maps[0].values()) <= 60  # one hour
    frames = list(of.handleExpiredTimer(("a",), _Timers(12_345 * 60_000 + 1), None))
    assert max(map(len, frames)) <= state.FRAME and sum(len(v[0]) for v in handle.maps[0].values()) == n - 12_346
    frames += list(of.handleExpiredTimer(("a",), _Timers(n * 60_000), None))
    made = pd.concat(frames)
    assert made["start"].tolist() == list(range(n - 31)) and not handle.maps[0]
    assert made["history"].str[0].tolist() == list(range(n - 31)) and made["future"].str[-1].tolist() == list(range(31, n))
