"""Functions for SQL text: scalar, aggregate and table functions under one prefix.

``register(spark)`` makes them known to a session; further reducers and forecasters
are added through ``REDUCERS`` and ``forecasts.FORECASTERS``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators import forecasts
from . import render

#: Reducers of a group's values, for grouped aggregation by name.
REDUCERS = {
    "median_gap": lambda v: float(np.median(np.abs(np.diff(v)))) if len(v) > 1 else 0.0,
    "spread": lambda v: float(v.max() - v.min()),
}


def reducer(name: str):
    """A grouped-aggregate function of a registered reducer."""
    reduce = REDUCERS[name]

    @F.pandas_udf(DoubleType())
    def run(values: pd.Series) -> float:
        return reduce(values.to_numpy(float))

    return run


class Forecast:
    """Table function: (history, model, horizon) to rows (step, value)."""

    def eval(self, history, model, horizon):
        values = forecasts.FORECASTERS[model](np.asarray(history, float), horizon)
        yield from ((i + 1, float(v)) for i, v in enumerate(values))


def register(spark: SparkSession, prefix: str = "gl_") -> None:
    spark.udf.register(f"{prefix}fixed", render.fixed)
    for name in REDUCERS:
        spark.udf.register(f"{prefix}{name}", reducer(name))
    spark.udtf.register(f"{prefix}forecast", F.udtf(Forecast, returnType="step int, value double"))
