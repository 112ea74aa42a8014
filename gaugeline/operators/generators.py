"""Rows made from a row: stages of a trajectory, forecast candidates, targets, inspections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, policy

ROW = "struct<stage:string,batch:int,tools:array<string>>"


def stage_rows(samples: DataFrame, tools: Column, per_batch: int, last: str = "refinement") -> DataFrame:
    """A diagnostic row for each batch of tools, then routing, then the last stage.

    Adds stage, batch (-1 outside diagnostics), tools, stage_order and turn_count.
    """
    def row(stage: Column, batch: Column, own: Column) -> Column:
        return F.struct(stage.alias("stage"), batch.cast("int").alias("batch"), own.alias("tools"))

    none = F.array().cast("array<string>")
    made = F.transform(policy.batches(tools, per_batch), lambda b, i: row(F.lit("diagnostic"), i, b))
    rest = F.array(row(F.lit("routing"), F.lit(-1), none), row(F.lit(last), F.lit(-1), none))
    r = samples.withColumn("_rows", F.concat(made, rest)).withColumn("turn_count", F.size("_rows"))
    r = r.select("*", F.posexplode("_rows").alias("stage_order", "_row"))
    return r.select(*samples.columns, "turn_count", "stage_order", "_row.stage", "_row.batch", "_row.tools")


def bank_rows(samples: DataFrame, tools: Column, per_batch: int, final_only: bool) -> DataFrame:
    """Stage rows of a candidate bank: the final choice alone, or all stages before it."""
    if not final_only:
        return stage_rows(samples, tools, per_batch, "final_select")
    row = {"turn_count": F.lit(1), "stage_order": F.lit(0), "stage": F.lit("final_select"), "batch": F.lit(-1), "tools": F.array().cast("array<string>")}
    return samples.withColumns(row)  # one a sample, whatever its tools


def candidates(samples: DataFrame, forecasts: str, history: str, default: str) -> DataFrame:
    """A baseline candidate for each model's forecast (``forecasts``: map of arrays), and the default's local edits."""
    entries = F.map_entries(forecasts)
    base = F.transform(entries, lambda e: F.struct(
        F.concat(e["key"], F.lit("__keep")).alias("candidate_id"), e["key"].alias("model"),
        F.when(e["key"] == F.col(default), "default").otherwise("alternative").alias("path"), F.lit("baseline").alias("kind"), e["value"].alias("values"),
    ))
    own = F.try_element_at(F.col(forecasts), F.col(default))
    edits = F.transform(arrays.edits_for(arrays.local_edits(own, F.col(history)), F.col(default)), lambda e: F.struct(
        F.concat(F.col(default), F.lit("__"), e["op"]).alias("candidate_id"), F.col(default).alias("model"), F.lit("default").alias("path"), F.lit("refine").alias("kind"), e["values"].alias("values"),
    ))
    keys = [c for c in samples.columns if c not in (forecasts, history)]
    staged = samples.withColumn("_base", base).withColumn("_edits", edits)
    return staged.select(*keys, F.explode(F.concat("_base", "_edits")).alias("_c")).select(*keys, "_c.*")


def decision_texts(base: Column, edits: Column) -> Column:
    """Map from decision to written forecast: the baseline, then each edit (array of struct(op, text))."""
    keep = F.struct(F.lit("keep_baseline").alias("op"), base.alias("text"))
    return F.map_from_entries(F.concat(F.array(keep), edits))


def best_edit(base: Column, edits: Column, truth: Column) -> Column:
    """The first meaningful edit (struct(op, values)) that beats all before it by more than 1e-8; null without one."""
    good = F.filter(edits, lambda e: arrays.meaningful(base, e["values"], truth))
    scored = F.transform(good, lambda e: F.struct(arrays.mse(e["values"], truth).alias("mse"), e["op"].alias("op"), e["values"].alias("values")))

    def pick(s: Column) -> Column:
        first = F.get(s, F.lit(0))
        return F.aggregate(s, first, lambda b, c: F.when(b["mse"] - c["mse"] > 1e-8, c).otherwise(b))

    return arrays.let(scored, pick)


def tool_results(tools: Column, texts: dict[str, Column]) -> Column:
    """Array of struct(tool, text) of the tools that ran, in the registry's order."""
    made = [F.when(F.array_contains(tools, t), F.struct(F.lit(t).alias("tool"), texts[t].alias("text"))) for t in policy.TOOLS if t in texts]
    return F.array_compact(F.array(*made))


def issues(stage: Column, calls: Column, exposed: Column, reason: Column, lines: Column, horizon: Column, route: str = "predict_time_series") -> Column:
    """What is wrong with a stage row, as an array of texts."""
    unknown = F.filter(calls, lambda c: ~F.array_contains(exposed, c))
    found = [
        F.when((stage == "diagnostic") & (F.size(calls) == 0), "diagnostic_missing_tool_call"),
        F.when((stage == "diagnostic") & (F.size(F.array_distinct(calls)) < F.size(calls)), "diagnostic_duplicate_tool_call"),
        F.when((stage == "diagnostic") & (F.size(unknown) > 0), F.concat(F.lit("diagnostic_unexpected_tool_call:"), F.array_join(unknown, ","))),
        F.when((stage == "routing") & (calls != F.array(F.lit(route))), F.concat(F.lit("routing_tool_calls="), F.array_join(calls, ","))),
        F.when((stage == "refinement") & reason.isNotNull(), F.concat(F.lit("refinement_protocol_reject:"), reason)),
        F.when((stage == "refinement") & (lines != horizon), F.concat(F.lit("refinement_answer_lines="), lines.cast("string"))),
    ]
    return F.array_compact(F.array(*found))
