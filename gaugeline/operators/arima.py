"""ARIMA order choice and forecasts from per-series sums of lag products.

Nothing holds a series: neighbours come from buckets of positions, and what a fit reads is a
row of sums a series, which tasks add up before they are merged.

1. Differencing by a unit-root test: the t value of x(t-1) in the regression of the step on it
   and on the step before; a series without a root at 5 % stays as it is.
2. A long autoregression gives residuals (Hannan-Rissanen); lags of values and residuals give one
   table of sums, from which every order's regression is solved.
3. The order of least AIC counts, the earlier one of equals; then autoregression, then the last value
   stand in where nothing could be solved.

Defined results: series of fewer than 12 points, or of a deviation under 1e-6, repeat their last value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .ordering import kept
from .scans import BUCKET, bucketed, inside

# Orders (p, q) in the order in which they are tried.
ORDERS = ((1, 1), (2, 1), (1, 2), (2, 2), (3, 1), (1, 3), (0, 1), (1, 0), (5, 0), (0, 5))
#: Lags of the long autoregression and of the table of sums.
LAGS = 5
#: 5 % point of the unit-root test's t value (with a constant), and least points and deviation of a fit.
CRITICAL, LEAST_POINTS, LEAST_DEVIATION = -2.86, 12, 1e-6


def _sums(rows: DataFrame, names: list[str]) -> DataFrame:
    """``series_id, m`` and the sums ``a_b`` of the products of each two columns (``one`` is 1)."""
    full = rows.dropna(subset=[n for n in names if n != "one"])
    col = lambda n: F.lit(1.0) if n == "one" else F.col(n)
    products = [F.sum(col(a) * col(b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    return full.groupBy("series_id").agg(F.count("*").alias("m"), *products)


def lagged(rows: DataFrame, value: str, prefix: str, lags: int = LAGS, bucket: int = BUCKET) -> DataFrame:
    """``rows`` with ``prefix1`` to the number of ``lags``: earlier values of ``value``, null where there are none."""
    near = bucketed(rows, back=lags, bucket=bucket)
    columns = [F.lag(value, k).over(inside()).alias(f"{prefix}{k}") for k in range(1, lags + 1)]
    return near.select("*", *columns).where("own").drop("own", "bucket")


def differencing(series: DataFrame) -> DataFrame:
    """``series_id, n, sd, t_value, d`` of each series (series_id, pos, value)."""
    size = series.groupBy("series_id").agg(F.count("*").alias("n"), F.stddev_pop("value").alias("sd"))
    x = lagged(series.select("series_id", "pos", "value"), "value", "x", 2)
    x = x.select("series_id", F.col("x1").alias("level"), (F.col("x1") - F.col("x2")).alias("before"), (F.col("value") - F.col("x1")).alias("step"))
    s = _sums(x, ["one", "before", "level", "step"])
    for pivot, rest in (("one", ["before", "level", "step"]), ("before", ["level", "step"])):  # what the earlier regressors leave
        s = s.withColumns({
            f"{a}_{b}": F.col(f"{a}_{b}") - F.col(f"{pivot}_{a}") * F.col(f"{pivot}_{b}") / F.nullif(F.col(f"{pivot}_{pivot}"), F.lit(0.0))
            for i, a in enumerate(rest) for b in rest[i:]
        })
    slope = F.col("level_step") / F.nullif("level_level", F.lit(0.0))
    left = F.col("step_step") - slope * F.col("level_step")
    t = slope / F.sqrt(F.nullif(left / F.nullif(F.col("m") - 3, F.lit(0)) / F.col("level_level"), F.lit(0.0)))
    return size.join(s.select("series_id", t.alias("t_value")), "series_id", "left").withColumn("d", F.when(F.col("t_value") < CRITICAL, 0).otherwise(1))


def solve(sums: dict[str, float], regressors: list[str], target: str) -> tuple[np.ndarray, float] | None:
    """Weights and sum of squared residuals of one regression, from its sums; None where it has no solution."""
    value = lambda a, b: sums[f"{a}_{b}"] if f"{a}_{b}" in sums else sums[f"{b}_{a}"]
    a = np.array([[value(p, q) for q in regressors] for p in regressors])
    b = np.array([value(p, target) for p in regressors])
    try:
        w = np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return None
    rss = value(target, target) - float(w @ b)
    return (w, rss) if np.isfinite(w).all() and np.isfinite(rss) and rss > 0 else None


def _regressors(p: int, q: int) -> list[str]:
    return ["one", *(f"y{k}" for k in range(1, p + 1)), *(f"e{k}" for k in range(1, q + 1))]


def _per_row(rows: DataFrame, make, schema: str) -> DataFrame:
    """One output row a series from its row of sums."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([make(r) for r in batch.to_pylist()], schema=kinds)

    return rows.mapInArrow(run, schema)


def _kind(rows: DataFrame) -> str:
    return rows.schema["series_id"].dataType.simpleString()


def _long_weights(row: dict) -> dict:
    found = solve(row, _regressors(LAGS, 0), "y0")
    return {"series_id": row["series_id"], "w": None if found is None else found[0].tolist()}


def _choice(row: dict) -> dict:
    best = None
    for p, q in ORDERS:
        found = solve(row, _regressors(p, q), "y0")
        if found:
            aic = row["m"] * float(np.log(found[1] / row["m"])) + 2 * (p + q + 1)
            if best is None or aic < best["aic"]:
                best = {"p": p, "q": q, "aic": aic, "w": found[0].tolist()}
    return {"series_id": row["series_id"], **(best or {"p": None, "q": None, "aic": None, "w": None})}


def residual_rows(series: DataFrame, tested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the differenced series with lags of values and residuals, and the long autoregression's weights."""
    step = lagged(series.select("series_id", "pos", "value"), "value", "x", 1)
    y = step.join(tested.where((F.col("n") >= LEAST_POINTS) & (F.col("sd") >= LEAST_DEVIATION)).select("series_id", "d"), "series_id")
    y = y.withColumn("y0", F.when(F.col("d") == 0, F.col("value")).otherwise(F.col("value") - F.col("x1"))).where("y0 is not null")
    y = kept(lagged(y.select("series_id", (F.col("pos") - F.col("d")).alias("pos"), "y0"), "y0", "y"))
    long = _per_row(_sums(y, ["one", *(f"y{k}" for k in range(1, LAGS + 1)), "y0"]), _long_weights, f"series_id {_kind(y)}, w array<double>")
    long = kept(long)
    said = F.col("w")[0]
    for k in range(1, LAGS + 1):
        said = said + F.col("w")[k] * F.col(f"y{k}")
    e = y.join(long, "series_id").withColumn("e0", F.col("y0") - said).drop("w")
    return lagged(e, "e0", "e"), long


def choose(series: DataFrame) -> DataFrame:
    """``series_id, d, p, q, aic, w`` of each series that can be fitted (w: constant, value lags, residual lags)."""
    tested = kept(differencing(series))
    rows, _ = residual_rows(series, tested)
    names = ["one", *(f"y{k}" for k in range(1, LAGS + 1)), *(f"e{k}" for k in range(1, LAGS + 1)), "y0"]
    chosen = _per_row(_sums(rows, names), _choice, f"series_id {_kind(series)}, p int, q int, aic double, w array<double>")
    return chosen.join(tested.select("series_id", "d"), "series_id").select("series_id", "d", "p", "q", "aic", "w")


def _continued(row: dict, horizon: int) -> dict:
    out, method = None, "naive"
    y, e, last = row["ys"] or [], row["es"] or [], row["last"]
    w, p, q = row["w"], row["p"], row["q"]
    if w is None and row["long"] is not None:
        w, p, q = row["long"], LAGS, 0
    if w is not None and len(y) >= p and len(e) >= q:
        y, e, made = list(y), list(e), []
        for _ in range(horizon):
            v = w[0] + sum(w[k] * y[-k] for k in range(1, p + 1)) + sum(w[p + k] * e[-k] for k in range(1, q + 1))
            y.append(v)
            e.append(0.0)
            made.append(v)
        made = np.array(made) if row["d"] == 0 else last + np.cumsum(made)
        if np.isfinite(made).all():
            out, method = made.tolist(), "arima" if row["w"] is not None else "autoregression"
    return {"series_id": row["series_id"], "method": method, "d": row["d"], "p": p, "q": q, "forecast": out or [last] * horizon}


def forecast(series: DataFrame, horizon: int) -> DataFrame:
    """``series_id, method, d, p, q, forecast``: the chosen order's forecast, or what stands in for it."""
    tested = kept(differencing(series))
    rows, long = residual_rows(series, tested)
    rows = kept(rows)
    names = ["one", *(f"y{k}" for k in range(1, LAGS + 1)), *(f"e{k}" for k in range(1, LAGS + 1)), "y0"]
    chosen = _per_row(_sums(rows, names), _choice, f"series_id {_kind(series)}, p int, q int, aic double, w array<double>")
    # the last values and residuals of each series, few and in order
    end = rows.groupBy("series_id").agg(F.max("pos").alias("top"))
    tail = rows.join(end, "series_id").where(F.col("pos") > F.col("top") - LAGS).groupBy("series_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "y0"))), lambda p: p["y0"]).alias("ys"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("e0").isNotNull(), F.struct("pos", "e0")))), lambda p: p["e0"]).alias("es"),
    )
    last = series.groupBy("series_id").agg(F.max_by("value", "pos").alias("last"))
    whole = (
        last.join(tested.select("series_id", "d"), "series_id").join(tail, "series_id", "left").join(chosen, "series_id", "left")
        .join(long.withColumnRenamed("w", "long"), "series_id", "left")
    )
    schema = f"series_id {_kind(series)}, method string, d int, p int, q int, forecast array<double>"
    return _per_row(whole, lambda r: _continued(r, horizon), schema)
