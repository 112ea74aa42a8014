"""Texts of prompts, truths, forecasts, evidence and answers.

Numbers are written with four places as C and Python do; ``fixed`` formats a whole
array in one Arrow batch, and the text around it is put together by the engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import arrays


@F.pandas_udf(ArrayType(StringType()))
def fixed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Every number of an array with four places."""
    for values in batches:
        yield values.map(lambda v: None if v is None else [f"{float(x):.4f}" for x in v])


@F.pandas_udf(ArrayType(StringType()))
def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Every number of an array with one place."""
    for values in batches:
        yield values.map(lambda v: None if v is None else [f"{float(x):.1f}" for x in v])


@F.pandas_udf(ArrayType(StringType()))
def evidence_numbers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Numbers with one place from 100 on, with four below."""
    one = lambda x: f"{x:.1f}" if abs(x) >= 100 else f"{x:.4f}"
    for values in batches:
        yield values.map(lambda v: None if v is None else [one(float(x)) for x in v])


def joined(*parts: Column | str) -> Column:
    """Lines, missing ones left out."""
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def named_rows(rows: DataFrame, by: str, pos: str, date: str, columns: list[str], name: str = "text") -> DataFrame:
    """``by, text``: one line a row, ``date a=1.0000 b=2.0000``, in the order of ``pos``."""
    cells = F.zip_with(F.array(*map(F.lit, columns)), F.col("_f"), lambda n, v: F.concat(n, F.lit("="), v))
    return _lines(rows.withColumn("_f", fixed(F.array(*columns))), by, pos, F.concat_ws(" ", date, F.array_join(cells, " ")), name)


def value_rows(rows: DataFrame, by: str, pos: str, date: str, value: str, name: str = "text") -> DataFrame:
    """``by, text``: one line a row, ``date 1.0000``."""
    return _lines(rows.withColumn("_f", fixed(F.array(value))), by, pos, F.concat_ws(" ", date, F.get("_f", F.lit(0))), name)


def _lines(rows: DataFrame, by: str, pos: str, line: Column, name: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), line.alias("l"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(ordered, lambda x: x["l"]), "\n").alias(name))


def task_prompt(task: str, target: Column, covariates: Column, lookback: Column, horizon: Column, requirements: list[str], history: Column) -> Column:
    """A task's header lines, numbered requirements and history."""
    numbered = [f"{i}) {r}" for i, r in enumerate(requirements, 1)]
    return joined(
        f"[Task] {task}", F.concat(F.lit("Target Column: "), target), F.concat(F.lit("Observed Covariates: "), F.array_join(covariates, ", ")),
        F.concat(F.lit("Lookback Window: "), lookback.cast("string")), F.concat(F.lit("Forecast Horizon: "), horizon.cast("string")),
        "Requirements:", *numbered, "Historical Data:", history,
    )


def stamps(anchor: Column, n: Column, step_seconds: int = 3600) -> Column:
    """``n`` stamps after an anchor (2000-01-01 without one), as text."""
    start = F.coalesce(F.unix_timestamp(anchor), F.lit(946684800))
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.from_unixtime(start + i * step_seconds, "yyyy-MM-dd HH:mm:ss"))


def forecast_text(numbers: Column, anchor: Column, step_seconds: int = 3600) -> Column:
    """Stamped lines of a forecast from its written numbers."""
    return F.array_join(F.zip_with(stamps(anchor, F.size(numbers), step_seconds), numbers, lambda t, v: F.concat(t, F.lit(" "), v)), "\n")


def compact(model: Column, start: Column, numbers: Column, hours: int = 1) -> Column:
    """Header lines and one number a line."""
    return joined(
        F.concat(F.lit("Model: "), model), F.concat(F.lit("Start Timestamp: "), start), f"Frequency Hours: {hours}", "Forecast Values:", F.array_join(numbers, "\n")
    )


def preview(numbers: Column, size: int = 3) -> Column:
    """The first and the last numbers; all of them where they are few."""
    head = F.array_join(F.slice(numbers, 1, size), ", ")
    tail = arrays.let(numbers, lambda v: F.array_join(F.slice(v, F.greatest(F.size(v) - size + 1, F.lit(1)), F.lit(size)), ", "))
    return F.when(F.size(numbers) <= size, head).otherwise(F.concat(head, F.lit(" ... "), tail))


#: Names of the summary's numbers, in their order.
SUMMARY = ("mean", "std", "min", "max", "net_change", "mean_abs_step")


@F.pandas_udf(ArrayType(StringType()))
def summary_numbers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The numbers of ``SUMMARY`` of an array that isn't empty, with four places."""

    def of(values) -> list[str] | None:
        if values is None or not len(values):
            return None
        x = np.asarray(values, float)
        step = np.abs(np.diff(x)).mean() if len(x) > 1 else 0.0
        return [f"{v:.4f}" for v in (x.mean(), x.std(), x.min(), x.max(), x[-1] - x[0], step)]

    for values in batches:
        yield values.map(of)


def selection_preview(model: Column, count: Column, summary: Column, numbers: Column, hours: int = 1, size: int = 6) -> Column:
    """A candidate's summary with its head and tail; ``summary`` holds the written ``SUMMARY``."""
    said = F.array_join(F.zip_with(F.array(*map(F.lit, SUMMARY)), summary, lambda n, v: F.concat(n, F.lit("="), v)), ", ")
    tail = arrays.let(numbers, lambda v: F.array_join(F.slice(v, F.greatest(F.size(v) - size + 1, F.lit(1)), F.lit(size)), ", "))
    return joined(
        F.concat(F.lit("Model: "), model), f"Frequency Hours: {hours}", F.concat(F.lit("Count: "), count.cast("string")), F.concat(F.lit("Summary: "), said),
        F.concat(F.lit("Head Values: "), F.array_join(F.slice(numbers, 1, size), ", ")), F.concat(F.lit("Tail Values: "), tail),
    )


def shorter(compacted: Column, whole: Column) -> Column:
    """The compact text where it saves room."""
    return F.when(F.length(compacted) < F.length(whole), compacted).otherwise(whole)


def evidence_card(tools: Column, groups: dict[str, list[tuple[str, int]]], numbers: Column) -> Column:
    """What each tool that ran has found; ``groups`` names tools, their fields and each field's place in ``numbers``."""
    none = lambda a: F.when(F.size(a) > 0, F.array_join(a, ", ")).otherwise("none")
    lines = []
    for tool, fields in groups.items():
        values = F.concat_ws(", ", *(F.concat(F.lit(f"{n}="), F.get(numbers, F.lit(i))) for n, i in fields))
        lines.append(F.when(F.array_contains(tools, tool), F.concat(F.lit(f"- {tool}: "), values)))
    missing = F.filter(F.array(*map(F.lit, groups)), lambda t: ~F.array_contains(tools, t))
    return joined(
        "### Routing Evidence Card", F.concat(F.lit("observed_tools=["), none(tools), F.lit("]")), "tool_fields:", *lines,
        F.concat(F.lit("missing_tool_groups=["), none(missing), F.lit("]")),
    )


# The fields of the routing card by tool, as (label, feature).
CARD_FIELDS = {
    "extract_basic_statistics": (("acf1", "acf1"), ("acf_seasonal", "acf_seasonal"), ("cusum_max", "cusum")),
    "extract_within_channel_dynamics": (
        ("changepoints", "changepoints"), ("peak_count", "peaks"), ("peak_spacing_cv", "spacing_cv"), ("monotone_duration", "monotone"),
    ),
    "extract_forecast_residuals": (("residual_exceed_ratio", "exceed"),),
    "extract_data_quality": (("quantization_score", "quantization"), ("saturation_ratio", "saturation")),
    "extract_event_summary": (("dominant_pattern", "dominant"),),
}


def routing_card(features: Column, ran: Column) -> Column:
    """The evidence card of all tool groups from a struct of features; ``ran`` are the tools that have shown theirs."""
    numeric = [f for fields in CARD_FIELDS.values() for _, f in fields if f != "dominant"]
    written = F.concat(evidence_numbers(F.array(*(features[f] for f in numeric))), F.array(features["dominant"]))
    place = {f: i for i, f in enumerate([*numeric, "dominant"])}
    return evidence_card(ran, {t: [(n, place[f]) for n, f in fields] for t, fields in CARD_FIELDS.items()}, written)


def refinement_card(model: Column, tools: Column, keep: Column, signals: Column, edits: Column, may_keep: Column, said: dict[str, str]) -> Column:
    """What speaks for the forecast as it is and for each edit (array of struct(edit, signals)), and what may be decided.

    ``said`` describes edits; others read as their names.
    """
    listed = lambda c, none: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(none)
    words = F.create_map(*(F.lit(x) for pair in said.items() for x in pair))
    line = lambda e: F.concat(
        F.lit("- "), e["edit"], F.lit("="), F.coalesce(F.try_element_at(words, e["edit"]), F.replace(e["edit"], F.lit("_"), F.lit(" "))),
        F.lit("; support=["), listed(e["signals"], "none"), F.lit("]"),
    )
    options = F.concat(F.transform(edits, lambda e: e["edit"]), F.when(may_keep, F.array(F.lit("keep_baseline"))).otherwise(F.array().cast("array<string>")))
    support = F.when(F.size(edits) > 0, F.concat(F.lit("edit_support:\n"), F.array_join(F.transform(edits, line), "\n"))).otherwise("candidate_adjustments=[none]")
    return joined(
        "### Refinement Evidence Card", F.when(F.coalesce(model, F.lit("")) != "", F.concat(F.lit("selected_model="), model)),
        F.concat(F.lit("observed_tools=["), listed(tools, "none"), F.lit("]")), F.concat(F.lit("keep_support=["), listed(keep, "none"), F.lit("]")),
        F.concat(F.lit("support_signals=["), listed(signals, "evidence_consistent"), F.lit("]")), support,
        F.concat(F.lit("decision_options=["), F.array_join(options, ", "), F.lit("]")), F.concat(F.lit("keep_baseline_allowed="), F.when(may_keep, "yes").otherwise("no")),
    )


# Titles and labels of the feature texts.
LABELS = {
    "Basic Statistics": ("Median", "MAD", "ACF(1)", "ACF(seasonal)", "Peak Frequency", "Spectral Entropy", "CUSUM Max", "Quantile Kurtosis"),
    "Forecast Residuals": ("Residual Mean", "Residual Max", "Exceed Ratio", "ACF(1)", "Concentration"),
    "Data Quality": ("Quantization Score", "Saturation Ratio", "Constant Channel Ratio", "Dropout Ratio"),
    "Within-Channel Dynamics": (
        "Changepoint Count", "Changepoint Score", "Max Slope", "Max Second Diff", "Monotone Duration", "Peak Count", "Peak Max Width", "Peak Spacing CV",
    ),
    "Event Summary": ("Segment Count", "Rise Events", "Fall Events", "Flat Events", "Oscillation Events"),
}


#: Labels whose number has one place; all others have four.
COUNTS = {"Changepoint Count", "Peak Count", "Segment Count", "Rise Events", "Fall Events", "Flat Events", "Oscillation Events"}
PATTERNS = ("rise", "fall", "flat", "oscillation")


def feature_text(title: str, numbers: Column) -> Column:
    """A titled list of labelled numbers (already written)."""
    lines = F.zip_with(F.array(*map(F.lit, LABELS[title])), numbers, lambda n, v: F.concat(F.lit("  "), n, F.lit(": "), v))
    return joined(f"{title}:", F.array_join(lines, "\n"))


def tool_text(title: str, values: Column, pattern: Column | None = None) -> Column:
    """A tool's features in words: counts with one place, others with four, and the leading pattern's name where one is given.

    ``values`` has the title's features in order, nulls counting as 0.
    """
    whole = F.transform(values, lambda v: F.coalesce(v, F.lit(0.0)))
    names = LABELS[title]
    short = [i for i, n in enumerate(names) if n in COUNTS]
    both = F.arrays_zip(fixed(whole).alias("four"), counts(whole).alias("one"))
    written = F.transform(both, lambda v, i: F.when(i.isin(*short) if short else F.lit(False), v["one"]).otherwise(v["four"]))
    text = feature_text(title, written)
    if pattern is None:
        return text
    name = F.get(F.array(*map(F.lit, PATTERNS)), F.coalesce(pattern, F.lit(0)).cast("int"))
    return joined(text, F.concat(F.lit("  Dominant Pattern: "), name))


def target_answer(reflection: Column, decision: Column, forecast: Column, by_decision: bool) -> Column:
    """The assistant's last turn: a decision line or the whole forecast."""
    keep = F.coalesce(F.nullif(F.trim(F.coalesce(decision, F.lit(""))), F.lit("")), F.lit("keep_baseline"))
    body = F.concat(F.lit("decision="), keep) if by_decision else forecast
    return F.concat(F.lit("<think>\n"), reflection, F.lit("\n</think>\n<answer>\n"), body, F.lit("\n</answer>"))


def section_prompt(sections: list[tuple[str, Column]]) -> Column:
    """A prompt of titled sections; empty ones are left out."""
    return F.concat_ws("\n\n", *(F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.concat(F.lit(f"### {t}\n"), c)) for t, c in sections))
