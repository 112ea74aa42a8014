"""Forecasters on arrays of history, dispatched by name, with errors kept beside their rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import arrays
from . import kernels

#: Forecasters by name: a history and a horizon give that many values.
FORECASTERS = {
    "naive": lambda x, h: np.full(h, x[-1]),
    "mean": lambda x, h: np.full(h, x.mean()),
    "drift": lambda x, h: x[-1] + (x[-1] - x[0]) / max(len(x) - 1, 1) * np.arange(1, h + 1),
    "seasonal": lambda x, h: np.resize(x[-7:], h) if len(x) >= 7 else np.full(h, x[-1]),
    "autoregression": kernels.autoregression,
}


def predict(rows: DataFrame, history: str, models: list[str], horizon: int, lookback: int | None = None) -> DataFrame:
    """Each row once per model, with ``forecast`` or, where it failed, ``error``.

    A history of another length than ``lookback`` (if given), an empty one and an unknown
    model are errors of their row and model, not of the run.
    """
    added = StructType.fromDDL("model string, forecast array<double>, error string")
    schema = StructType([*rows.schema.fields, *added.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for model in models:
                out = frame.copy()
                made = [_attempt(model, h, horizon, lookback) for h in frame[history]]
                out["model"], out["forecast"], out["error"] = model, [m[0] for m in made], [m[1] for m in made]
                yield out

    return rows.mapInPandas(run, schema)


def _attempt(model: str, history, horizon: int, lookback: int | None):
    try:
        if model not in FORECASTERS:
            raise ValueError(f"unknown model {model}")
        x = np.asarray(history if history is not None else [], float)
        if not len(x) or lookback is not None and len(x) != lookback:
            raise ValueError(f"history of {len(x)} points")
        return FORECASTERS[model](x, horizon).tolist(), None
    except Exception as error:  # kept beside its row
        return None, str(error)


def scored(rows: DataFrame, forecast: str, truth: str) -> DataFrame:
    """Adds mse, mae and normalised mse of every forecast; null where there is none."""
    p, t = F.col(forecast), F.col(truth)
    return rows.withColumns({"mse": arrays.mse(p, t), "mae": arrays.mae(p, t), "norm_mse": arrays.norm_mse(p, t)})


def fitted(forecast: Column, horizon: int) -> Column:
    """The forecast cut to the horizon, or its last value repeated up to it; null for none."""
    last = F.element_at(forecast, -1)
    grown = F.concat(forecast, F.array_repeat(last, F.greatest(F.lit(horizon) - F.size(forecast), F.lit(0))))
    return F.when(F.size(forecast) > 0, F.slice(grown, 1, horizon))


def first_valid(horizon: int, *forecasts: Column) -> Column:
    """The first forecast of full length, in the order of preference."""
    return F.coalesce(*(F.when(F.size(f) == horizon, f) for f in forecasts))


def target_index(names: Column, requested: Column) -> Column:
    """Zero-based place of the target column: the requested one, else OT, else the last."""
    place = lambda name: F.nullif(F.array_position(names, name), F.lit(0).cast("long"))
    return F.coalesce(F.when(requested.isNotNull(), place(F.coalesce(requested, F.lit("")))), place(F.lit("OT")), F.size(names).cast("long")) - 1


def over_budget(rows: DataFrame, column: str, share: float) -> bool:
    """Whether more than ``share`` of the rows carry an error."""
    n = rows.agg(F.count(column).alias("bad"), F.count("*").alias("n")).first()
    return n["bad"] > share * n["n"]


def refinement(rows: DataFrame, selected: str, final: str, truth: str, tolerance: float = 1e-8) -> DataFrame:
    """Errors of the selected and the final forecast, what the second gains, and whether it is a copy."""
    p, q, t = F.col(selected), F.col(final), F.col(truth)
    out = rows.withColumns({
        "selected_mse": arrays.mse(p, t), "final_mse": arrays.mse(q, t), "mae_gain": arrays.mae(p, t) - arrays.mae(q, t),
        "copied": arrays.delta_summary(p, q, tolerance)["changed"] == 0,
    })
    return out.withColumns({"degraded": F.col("final_mse") > F.col("selected_mse"), "improved": F.col("final_mse") < F.col("selected_mse")})
