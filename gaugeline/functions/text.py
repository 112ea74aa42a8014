"""Text codecs: task headers, history lines, tagged answers and decisions, as column expressions.

Every function takes and returns columns, so parsing stays in whole-stage code
generation; only ``fixed4`` (exact ``%.4f`` text) passes through an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .arrays import let

# Patterns of the formats read.
NUMBER = r"-?\d+(?:\.\d+)?"
STAMP = r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}"
NAMED = r"([A-Za-z_][A-Za-z0-9_\-]*)\s*=\s*(-?\d+(?:\.\d+)?)"
LOOSE = r"-?\d+\.?\d*"
THINK, ANSWER = r"<think>(.*?)</think>", r"<answer>(.*?)</answer>"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without a match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def has(c: Column, tag: str) -> Column:
    return c.contains(tag)


def lines(c: Column) -> Column:
    """Trimmed lines that aren't empty."""
    return F.filter(F.transform(F.split(c, r"\r\n|\r|\n"), strip), lambda x: x != "")


# --- task headers and history (T1-T7) ---------------------------------------------------------


def int_field(s: Column | str, name: str) -> Column:
    """Whole number of a header line ``name: 12``, in any case; null otherwise."""
    return F.regexp_extract(column(s), rf"(?im)^{name}[ \t]*:[ \t]*(\d+)[ \t]*$", 1).try_cast("long")


def text_field(s: Column | str, name: str) -> Column:
    return blank_to_null(strip(F.regexp_extract(column(s), rf"(?im)^{name}[ \t]*:[ \t]*(.+?)[ \t]*$", 1)))


def history_block(s: Column | str) -> Column:
    """What follows the marker on its own line, else the inline marker, else the whole text; trimmed."""
    own = r"(?is)^(?:.*?\n)??Historical Data:[ \t]*(?:\n(.*))?$"
    inline = r"(?is)^(?:.*?\n)??Historical Data:[ \t]*([^\n].*)$"
    return let(strip(column(s)), lambda c: strip(
        F.when(c.rlike(own), F.regexp_extract(c, own, 1)).when(c.rlike(inline), F.regexp_extract(c, inline, 1)).otherwise(c)
    ))


def task_type(s: Column | str) -> Column:
    """The ``[Task]`` line, else what the prompt's wording implies, else null."""
    c = strip(column(s))
    line = r"(?im)^\[Task\]\s*(.+?)\s*$"
    return (
        F.when(c.rlike(line), strip(F.regexp_extract(c, line, 1)))
        .when(c.rlike("(?i)multivariate"), "multivariate time-series forecasting")
        .when(c.rlike("(?i)single-variable"), "single-variable time-series forecasting")
        .when(c.rlike("(?i)time-series forecasting"), "time-series forecasting")
    )


def parse_line(line: Column, target: Column) -> Column:
    """``struct(stamp, value, names, numbers)`` of one history line; ``value`` null: the line is skipped.

    Named values win over a plain number, which wins over a number at the end.  Of
    several values of one name the last counts; its first place keeps the order.
    """
    stamped = rf"^({STAMP})(?:\s+|$)(.*)$"
    body = strip(F.when(line.rlike(stamped), F.regexp_extract(line, stamped, 2)).otherwise(line))

    def split(body: Column) -> Column:
        names, numbers = F.regexp_extract_all(body, F.lit(NAMED), F.lit(1)), F.regexp_extract_all(body, F.lit(NAMED), F.lit(2))
        scalar = F.regexp_extract(body, rf"({NUMBER})$", 1).try_cast("double")
        return F.struct(found(line, stamped).alias("stamp"), names.alias("names"), numbers.alias("numbers"), scalar.alias("scalar"))

    return let(let(body, split), lambda v: _valued(v, target))


def _valued(v: Column, target: Column) -> Column:
    """``parse_line`` of a line split into stamp, names, their numbers and the number at its end."""
    names, scalar = v["names"], v["scalar"]
    pairs = F.arrays_zip(names.alias("name"), v["numbers"].alias("number"))
    distinct = F.array_distinct(names)

    def last(name: Column) -> Column:
        return F.element_at(F.filter(pairs, lambda p: p["name"] == name), -1)["number"].cast("double")

    def pick(name: Column) -> Column:
        return F.when(F.array_contains(names, name), last(name))

    chosen = F.coalesce(
        F.when(target.isNotNull(), pick(F.coalesce(target, F.lit("")))), pick(F.lit("target")), pick(F.lit("OT")),
        last(F.get(names, F.lit(0))),
    )
    named = F.size(names) > 0
    fallback = F.array(F.coalesce(target, F.lit("target")))
    return F.struct(
        v["stamp"].alias("stamp"), F.when(named, chosen).otherwise(scalar).alias("value"),
        F.when(named, distinct).otherwise(fallback).alias("names"),
        F.when(named, F.transform(distinct, last)).otherwise(F.array(scalar)).alias("numbers"),
    )


def records(s: Column | str, target: Column) -> Column:
    """Parsed lines of a prompt's history, in order, skipped lines left out."""
    return let(target, lambda t: F.filter(F.transform(lines(history_block(s)), lambda x: parse_line(x, t)), lambda r: r["value"].isNotNull()))


# --- forecast lines (T8-T12, T17-T19, D4) ---------------------------------------------------------


def valid_stamp(c: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(strip(c), r"\s+", " "), F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull()


def is_number(line: Column) -> Column:
    return line.rlike(rf"^{NUMBER}$")


def is_stamped(line: Column) -> Column:
    shape = rf"^({STAMP})\s+{NUMBER}$"
    return line.rlike(shape) & valid_stamp(F.regexp_extract(line, shape, 1))


def line_format(parts: Column) -> Column:
    some_number, some_stamped = F.exists(parts, is_number), F.exists(parts, is_stamped)
    return (
        F.when(F.size(parts) == 0, "empty").when(F.forall(parts, is_number), "numeric_only")
        .when(F.forall(parts, is_stamped), "timestamp_value").when(some_number & some_stamped, "mixed").otherwise("invalid")
    )


def first_answer(s: Column | str) -> Column:
    c = column(s)
    return F.when(c.rlike(f"(?s){ANSWER}"), strip(F.regexp_extract(c, f"(?s){ANSWER}", 1))).otherwise(c)


def last_region(s: Column | str) -> Column:
    """From the last opening tag to the next close or the end, trimmed; empty without a tag."""
    c = column(s)
    tail = F.substring_index(F.substring_index(c, "<answer>", -1), "</answer>", 1)
    return F.when(has(c, "<answer>"), strip(tail)).otherwise("")


def forecast_values(s: Column | str) -> Column:
    """Numbers of an answer's lines: table cell or trailing number; lines with a bad time stamp don't count."""
    table = rf"\|\s*\d+\s*\|\s*({LOOSE})\s*\|"

    def value(line: Column) -> Column:
        bad = line.rlike(rf"^{STAMP}\s+") & ~is_stamped(line)
        plain = F.regexp_extract(line, rf"({LOOSE})$", 1)
        cell = F.regexp_extract(line, table, 1)
        return F.when(bad, F.lit(None)).otherwise(F.coalesce(cell.try_cast("double"), plain.try_cast("double")))

    rows = F.filter(F.transform(F.split(first_answer(s), "\n"), strip), lambda x: x != "")
    return F.filter(F.transform(rows, value), lambda v: v.isNotNull())


def good_shape(answer: Column, expected: Column) -> Column:
    parts = lines(answer)
    return (
        (F.size(parts) == expected) & (F.size(forecast_values(answer)) == expected)
        & line_format(parts).isin("numeric_only", "timestamp_value")
    )


def shape_reason(answer: Column, expected: Column) -> Column:
    parts = lines(answer)
    return _shape_reason(F.size(parts), F.size(forecast_values(answer)), line_format(parts), expected)


def _shape_reason(n: Column, m: Column, kind: Column, expected: Column) -> Column:
    """The reason from the counts of lines and values and the lines' format."""
    e = expected.cast("string")
    wrong = lambda what, k: F.concat(F.lit(f"invalid_answer_shape:{what}="), k.cast("string"), F.lit(",expected="), e)
    return (
        F.when(n == 0, "empty_answer_block").when(n != expected, wrong("lines", n)).when(m != expected, wrong("values", m))
        .when(kind == "mixed", "invalid_answer_shape:mixed_line_formats")
        .when(~kind.isin("numeric_only", "timestamp_value"), "invalid_answer_shape:invalid_forecast_line")
        .otherwise("invalid_answer_shape:unknown")
    )


def _without(c: Column, *tags: str) -> Column:
    for tag in tags:
        c = F.replace(c, F.lit(tag), F.lit("\n"))
    return strip(c)


def forecast_block(s: Column | str) -> Column:
    """First run of forecast lines, prose before it skipped; empty lines don't end it.  Empty: none."""
    parts = lines(_without(column(s), "<|im_end|>", "<answer>", "</answer>"))
    marked = F.transform(parts, lambda x: F.struct(x.alias("line"), (is_stamped(x) | x.rlike(rf"^{LOOSE}$")).alias("good")))
    place = lambda v, good: F.array_position(F.transform(v, lambda m: m["good"]), F.lit(good)).cast("int")
    rest = let(marked, lambda v: let(place(v, True), lambda n: F.when(n > 0, F.slice(v, n, F.size(v))).otherwise(F.slice(v, 1, 0))))
    run = let(rest, lambda v: let(place(v, False), lambda n: F.when(n > 0, F.slice(v, F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(v)))
    return F.transform(run, lambda m: m["line"])


def plain_block(s: Column | str) -> Column:
    """The forecast block of a text that is nothing else; null: it has none, or more."""
    c = column(s)
    text = _without(c, "<|im_end|>", "<think>", "</think>", "<answer>", "</answer>")
    return let(forecast_block(c), lambda block: F.when((F.size(block) > 0) & (lines(text) == block), block))


def is_plain_block(s: Column | str) -> Column:
    return plain_block(s).isNotNull()


def line_counts(s: Column) -> tuple[Column, Column]:
    """Number lines and other lines."""
    parts = lines(s)
    numeric = F.size(F.filter(parts, is_number))
    return numeric, F.size(parts) - numeric


def tail_lines(s: Column, n: int) -> Column:
    rows = F.split(F.regexp_replace(s, r"\n$", ""), "\n")
    return F.slice(rows, F.greatest(F.size(rows) - n + 1, F.lit(1)), F.lit(n))


def after_close(s: Column | str) -> Column:
    c = column(s)
    return F.when(has(c, "</answer>"), strip(F.regexp_extract(c, r"(?s)^.*?</answer>(.*)$", 1))).otherwise("")


# --- answer protocol (T13-T16) ---------------------------------------------------------------------


def strict_reason(s: Column | str, expected: Column) -> Column:
    """Why a text isn't think block, answer block and nothing else; null where it is."""
    body = strict_answer(s)
    return _strict_reason(column(s), good_shape(body, expected), shape_reason(body, expected))


def _strict_reason(c: Column, good: Column, why: Column) -> Column:
    """The reason of a text whose answer block has a good shape, or not and ``why``."""
    think, no_think, answer, no_answer = (has(c, t) for t in ("<think>", "</think>", "<answer>", "</answer>"))
    return (
        F.when(c.isNull(), "empty_solution")
        .when(think & ~no_think, "missing_think_close_tag").when(no_think & ~think, "missing_think_open_tag")
        .when(answer & ~no_answer, "missing_answer_close_tag").when(no_answer & ~answer, "missing_answer_open_tag")
        .when(~answer & ~no_answer, "missing_answer_block").when(~think & ~no_think, "missing_think_block")
        .when(~c.rlike(rf"(?s)^\s*{THINK}\s*{ANSWER}\s*$"), "extra_text_outside_tags").when(~good, why)
    )


def strict_answer(s: Column | str) -> Column:
    """The answer block of a text that ``strict_reason`` accepts."""
    return strip(F.regexp_extract(column(s), rf"(?s)^\s*{THINK}\s*{ANSWER}\s*$", 2))


@F.pandas_udf(StringType())
def fixed4(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Values of an array in ``%.4f``, one a line (exact: the engine's own rounds decimal text)."""
    for values in batches:
        yield values.map(lambda v: None if v is None else "\n".join(f"{float(x):.4f}" for x in v))


def answer_block(c: Column) -> Column:
    """Text of the answer block, closed or not, trimmed; empty without one."""
    closed = rf"(?s){ANSWER}"
    return strip(
        F.when(c.rlike(closed), F.regexp_extract(c, closed, 1))
        .when(has(c, "<answer>"), F.regexp_extract(c, r"(?s)^.*?<answer>(.*)$", 1)).otherwise("")
    )


def protocol(df: DataFrame, s: str, expected: str, allow_recovery: bool) -> DataFrame:
    """Adds ``mode`` (strict_protocol, recovered_..., rejected_...), the strict ``reason`` and the ``answer``.

    Recovery takes the answer block, closed or not, or a plain forecast block: leading
    time-stamped lines as they stand, else the first values as ``%.4f``.  Texts with tool
    calls don't recover.  Intermediate columns are staged, so none is computed twice.
    """
    c, n = F.col(s), F.greatest(F.col(expected).cast("int"), F.lit(1))
    df = df.withColumn("_strict", strict_answer(c))
    df = df.withColumns({"_parts": lines("_strict"), "_m": F.size(forecast_values("_strict"))})
    df = df.withColumns({"_n": F.size("_parts"), "_kind": line_format(F.col("_parts"))})
    good = (F.col("_n") == F.col(expected)) & (F.col("_m") == F.col(expected)) & F.col("_kind").isin("numeric_only", "timestamp_value")
    why = _shape_reason(F.col("_n"), F.col("_m"), F.col("_kind"), F.col(expected))
    df = df.withColumn("reason", _strict_reason(c, good, why)).drop("_parts", "_n", "_m", "_kind")
    mode = F.when(F.col("reason").isNull(), "strict_protocol").otherwise(F.concat(F.lit("rejected_"), "reason"))
    if not allow_recovery:
        return df.withColumns({"mode": mode, "answer": F.when(F.col("reason").isNull(), F.col("_strict"))}).drop("_strict")
    df = df.withColumns({"_block": answer_block(c), "_plain": F.coalesce(F.array_join(plain_block(c), "\n"), F.lit(""))})
    df = df.withColumn("_plain", F.when(F.col("_plain") == F.col("_block"), "").otherwise(F.col("_plain")))
    df = df.withColumns({f"{k}_{part}": f(F.col(k)) for k in ("_block", "_plain") for part, f in (("lines", lines), ("values", forecast_values))})
    df = df.withColumns({f"{k}_stamped": line_format(F.col(f"{k}_lines")) == "timestamp_value" for k in ("_block", "_plain")})

    def attempt(k: str, name: str) -> Column:
        by_line = F.col(f"{k}_stamped") & (F.size(f"{k}_lines") >= F.col(expected))
        by_value = F.size(f"{k}_values") >= F.col(expected)
        return F.when((F.col(k) != "") & (by_line | by_value), F.struct(
            F.lit(name).alias("source"), F.when(by_line, F.array_join(F.slice(f"{k}_lines", F.lit(1), n), "\n")).alias("stamped"),
            F.slice(f"{k}_values", F.lit(1), n).alias("values"),
        ))

    tool = has(c, "<tool_call>") | has(c, "</tool_call>")
    taken = F.coalesce(attempt("_block", "answer_block"), attempt("_plain", "plain_forecast_block"))
    df = df.withColumn("_taken", F.when(F.col("reason").isNotNull() & ~tool & (F.col(expected) > 0), taken))
    again = F.concat(F.lit("recovered_"), "reason", F.lit("_"), "_taken.source")
    rendered = F.coalesce(F.col("_taken.stamped"), fixed4(F.col("_taken.values")))
    df = df.withColumns({
        "mode": F.when(F.col("reason").isNull(), mode).otherwise(F.coalesce(again, mode)),
        "answer": F.when(F.col("reason").isNull(), F.col("_strict")).otherwise(rendered),
    })
    return df.drop("_strict", "_taken", *(f"{k}{part}" for k in ("_block", "_plain") for part in ("", "_lines", "_values", "_stamped")))


def clamp(s: Column | str, expected: Column) -> Column:
    """``struct(applied, reason, raw_lines, valid_lines, discarded, text)``: the answer cut to ``expected`` stamped lines."""
    c = column(s)
    shape = rf"(?s)^\s*{THINK}\s*<answer>(.*)$"

    def split(tail: Column) -> Column:
        trailing = F.when(has(tail, "</answer>"), strip(F.regexp_extract(tail, r"(?s)^.*?</answer>(.*)$", 1))).otherwise("")
        return F.struct(trailing.alias("trailing"), lines(F.substring_index(tail, "</answer>", 1)).alias("raw"))

    def counted(v: Column) -> Column:
        stop = F.array_position(F.transform(v["raw"], is_stamped), F.lit(False)).cast("int")
        valid = let(stop, lambda n: F.when(n > 0, n - 1).otherwise(F.size(v["raw"])))
        return F.struct(v["trailing"].alias("trailing"), v["raw"].alias("raw"), valid.alias("valid"))

    def judged(v: Column) -> Column:
        exact = (v["valid"] == expected) & (F.size(v["raw"]) == expected) & has(c, "</answer>") & strip(c).endswith("</answer>")
        reason = (
            F.when(c.isNull(), "empty_solution").when(expected <= 0, "non_positive_expected_len")
            .when(has(c, "<tool_call>") | has(c, "</tool_call>"), "tool_call_payload")
            .when(~c.rlike(shape), "missing_think_answer_prefix").when(~v["trailing"].isin("", "<|im_end|>"), "unexpected_trailing_text")
            .when(v["valid"] < expected, "insufficient_valid_timestamp_prefix").when(exact, "already_exact")
            .otherwise("truncate_after_expected_timestamp_rows")
        )
        return F.struct(v["raw"].alias("raw"), v["valid"].alias("valid"), reason.alias("reason"))

    def result(v: Column) -> Column:
        applied = v["reason"] == "truncate_after_expected_timestamp_rows"
        counts = v["reason"].isin("insufficient_valid_timestamp_prefix", "already_exact") | applied
        kept = F.array_join(F.slice(v["raw"], F.lit(1), F.greatest(expected.cast("int"), F.lit(1))), "\n")
        rebuilt = F.concat(
            F.lit("<think>"), strip(F.regexp_extract(c, shape, 1)), F.lit("</think>\n\n<answer>\n"), kept, F.lit("\n</answer>")
        )
        return F.struct(
            applied.alias("applied"), v["reason"].alias("reason"), F.when(counts, F.size(v["raw"])).otherwise(0).cast("long").alias("raw_lines"),
            F.when(counts, v["valid"]).otherwise(0).cast("long").alias("valid_lines"),
            F.when(applied, v["valid"] - expected).otherwise(0).cast("long").alias("discarded"),
            F.when(applied, rebuilt).otherwise(c).alias("text"),
        )

    out = F.regexp_extract(c, shape, 2)
    for step in (split, counted, judged, result):
        out = let(out, step)
    return out


# --- decisions and candidates (T20-T22, T25, C31) -----------------------------------------------------


def choice(s: Column | str, key: str, what: str, bad: str, mode: str, allowed: Column) -> Column:
    """``struct(think, choice, mode, reason)`` of a one-line answer, ``key=`` in front or not, out of ``allowed``."""
    c = F.coalesce(column(s), F.lit(""))
    parts = lines(last_region(c))
    line = F.get(parts, F.lit(0))
    picked = F.when(F.lower(line).startswith(f"{key}="), strip(F.regexp_extract(line, r"(?s)^[^=]*=(.*)$", 1))).otherwise(line)
    reason = (
        F.when(~c.rlike(f"(?s){THINK}"), "missing_think_block").when(~c.rlike(f"(?s){ANSWER}"), "missing_answer_block")
        .when(F.size(parts) != 1, f"invalid_{what}_shape").when(~F.array_contains(allowed, picked), f"invalid_{what}_{bad}")
    )
    think = F.when(c.rlike(f"(?s){THINK}"), strip(F.regexp_extract(c, f"(?s){THINK}", 1)))
    return F.struct(
        think.alias("think"), F.when(reason.isNull(), picked).alias("choice"),
        F.when(reason.isNull(), mode).otherwise(F.concat(F.lit("rejected_"), reason)).alias("mode"), reason.alias("reason"),
    )


def decision(s: Column | str, allowed: Column) -> Column:
    return choice(s, "decision", "decision", "name", "refinement_decision_protocol", allowed)


def candidate(s: Column | str, allowed: Column) -> Column:
    return choice(s, "candidate_id", "candidate", "id", "candidate_selection_protocol", allowed)


def materialized(chosen: Column, texts: Column, default_think: str) -> Column:
    """``struct(answer, reason)``: the chosen forecast in think and answer tags; ``default_think`` holds ``{}``."""
    text = strip(F.coalesce(F.try_element_at(texts, chosen["choice"]), F.lit("")))
    before, after = default_think.split("{}")
    think = F.coalesce(blank_to_null(chosen["think"]), F.concat(F.lit(before), chosen["choice"], F.lit(after)))
    answer = F.concat(F.lit("<think>\n"), think, F.lit("\n</think>\n<answer>\n"), text, F.lit("\n</answer>"))
    reason = F.coalesce(chosen["reason"], F.when(text == "", "missing_decision_prediction"))
    return F.struct(F.when(reason.isNull(), answer).alias("answer"), reason.alias("reason"))


def final_acceptance(s: Column | str, allowed: Column, expected: Column) -> Column:
    """Decision protocol first; the full-forecast protocol only where no answer block was found."""
    d, reason = decision(s, allowed), strict_reason(s, expected)
    full = F.when(reason.isNull(), "strict_protocol").otherwise(F.concat(F.lit("rejected_"), reason))
    return F.when(d["reason"] == "missing_answer_block", full).otherwise(d["mode"])


# --- tool calls (T23, T40) and messages (T24, T36) ----------------------------------------------------

TOOL_CALL = r"(?s)<tool_call>(.*?)</tool_call>"


def tool_calls(s: Column | str, allowed: Column, max_calls: int | None = None) -> Column:
    """``struct(content, blocks, bad_json, no_name, bad_name, bad_arguments, calls, names, bad_names)``.

    Blocks after the one that fills ``max_calls`` aren't looked at.
    """
    c = F.coalesce(column(s), F.lit(""))

    def judged(v: Column) -> Column:
        valid = F.try_parse_json(v["payload"]).isNotNull()
        dict_like = v["arguments"].isNull() | strip(v["arguments"]).startswith("{")
        state = (
            F.when(~valid | v["keys"].isNull(), "bad_json").when(v["name"] == "", "no_name")
            .when((F.size(allowed) > 0) & ~F.array_contains(allowed, v["name"]), "bad_name")
            .when(~dict_like, "bad_arguments").otherwise("call")
        )
        return F.struct(state.alias("state"), v["name"].alias("name"))

    def read(payload: Column) -> Column:
        return F.struct(
            payload.alias("payload"), F.json_object_keys(F.when(payload.rlike(r"(?s)^\{.*\}$"), payload)).alias("keys"),
            strip(F.coalesce(F.get_json_object(payload, "$.name"), F.lit(""))).alias("name"), F.get_json_object(payload, "$.arguments").alias("arguments"),
        )

    def looked_at(every: Column) -> Column:
        if max_calls is None:
            return every
        places = F.filter(F.transform(every, lambda b, i: F.when(b["state"] == "call", i + 1)), lambda i: i.isNotNull())
        last = F.get(places, F.lit(max(max_calls, 1) - 1))
        return F.slice(every, F.lit(1), F.coalesce(last.cast("int"), F.greatest(F.size(every), F.lit(1))))

    def summary(every: Column) -> Column:
        count = lambda state: F.size(F.filter(every, lambda b: b["state"] == state)).cast("long").alias
        names = lambda *states: F.array_join(F.transform(F.filter(every, lambda b: b["state"].isin(*states)), lambda b: b["name"]), "->")
        return F.struct(
            strip(F.regexp_replace(c, TOOL_CALL, "")).alias("content"), F.size(every).cast("long").alias("blocks"),
            count("bad_json")("bad_json"), count("no_name")("no_name"), count("bad_name")("bad_name"),
            count("bad_arguments")("bad_arguments"), count("call")("calls"),
            names("bad_name", "bad_arguments", "call").alias("names"), names("bad_name", "bad_arguments").alias("bad_names"),
        )

    # Each step's array is bound once: a lambda's body is computed anew wherever its column is named.
    every = F.regexp_extract_all(c, F.lit(TOOL_CALL), F.lit(1))
    for step in (strip, read, judged):
        every = F.transform(every, step)
    return let(let(every, looked_at), summary)


def tool_message(name: Column, arguments: Column) -> Column:
    """An assistant's tool call as text; ``arguments`` is JSON."""
    return F.concat(F.lit('<tool_call>\n{"name": "'), name, F.lit('", "arguments": '), arguments, F.lit("}\n</tool_call>"))


def messages_hash(messages: Column) -> Column:
    """SHA-1 over role and content of an array of messages, length-prefixed so that no two lists share a text."""
    part = lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)
    none = lambda x: F.coalesce(x, F.lit(""))
    return F.sha1(F.array_join(F.transform(messages, lambda m: F.concat(part(none(m["role"])), part(none(m["content"])))), ""))


# --- coercion, signatures, truncation (T26, T33, T35, T37) -----------------------------------------------


def lenient_bool(c: Column, truthy: tuple[str, ...] = ("1", "true", "yes", "y")) -> Column:
    return F.coalesce(F.lower(strip(c.cast("string"))).isin(*truthy), F.lit(False))


def lenient_double(c: Column) -> Column:
    """A finite number or null."""
    v = strip(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def signature(items: Column, separator: str) -> Column:
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, "none").otherwise(F.array_join(items, separator))


def truncated_history(s: Column | str, keep: int) -> Column:
    """The last ``keep`` lines under a note of how many are left out; the text itself where none are."""
    c = column(s)
    parts = F.filter(F.split(strip(c), "\n"), lambda x: strip(x) != "")
    n = F.size(parts)
    rest = F.array_join(F.slice(parts, F.greatest(n - keep + 1, F.lit(1)), F.lit(keep)), "\n")
    note = F.concat(F.lit("... ("), (n - keep).cast("string"), F.lit(" earlier rows omitted) ...\n"), rest)
    return F.when(n > keep, note).otherwise(c)


def shuffle_key(seed: int, *parts: Column) -> Column:
    """A place in a deterministic shuffle: the first 16 hex digits of a SHA-256."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)), 256), 1, 16)
