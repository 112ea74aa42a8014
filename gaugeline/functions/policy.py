"""Decision rules over feature, workflow and routing columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

# Models and tools in their order, and the tools each model's route asks for.
MODELS = ("arima", "patchtst", "itransformer", "chronos2")
TOOLS = (
    "extract_basic_statistics", "extract_within_channel_dynamics", "extract_forecast_residuals",
    "extract_data_quality", "extract_event_summary",
)
NEEDS = {
    "arima": ("extract_basic_statistics", "extract_within_channel_dynamics", "extract_forecast_residuals"),
    "patchtst": ("extract_basic_statistics", "extract_within_channel_dynamics", "extract_event_summary"),
    "itransformer": ("extract_basic_statistics", "extract_within_channel_dynamics", "extract_event_summary"),
    "chronos2": ("extract_basic_statistics", "extract_within_channel_dynamics", "extract_forecast_residuals", "extract_data_quality"),
}
KEEP = "keep_default"


def points(*rules: tuple[Column, float]) -> Column:
    out = F.lit(0.0)
    for condition, value in rules:
        out = out + F.when(condition, value).otherwise(0.0)
    return out


# The tool that shows each feature.
SHOWN_BY = {
    "acf1": "extract_basic_statistics", "acf_seasonal": "extract_basic_statistics", "cusum": "extract_basic_statistics",
    "changepoints": "extract_within_channel_dynamics", "peaks": "extract_within_channel_dynamics", "spacing_cv": "extract_within_channel_dynamics",
    "monotone": "extract_within_channel_dynamics", "exceed": "extract_forecast_residuals", "quantization": "extract_data_quality",
    "saturation": "extract_data_quality",
}


def masked_features(f: Column, visible: Column) -> Column:
    """``f`` with null in place of what no tool in ``visible`` shows (all of it shows where ``visible`` is null)."""
    shows = lambda name: visible.isNull() | F.array_contains(visible, SHOWN_BY[name])
    return F.struct(*(F.when(shows(name), f[name]).alias(name) for name in SHOWN_BY))


def _stressed(f: Column) -> Column:
    return F.coalesce(f["saturation"] >= 0.08, F.lit(False)) | F.coalesce(f["quantization"] >= 0.24, F.lit(False))


def model_scores(f: Column) -> Column:
    """``struct`` of a score for each model from a struct of features; a feature that isn't there (null) scores nothing."""
    return F.struct(
        (0.10 + points((f["acf1"] >= 0.92, 1.5), ((f["acf1"] < 0.92) & (f["acf1"] >= 0.88), 0.75), (f["changepoints"] <= 1, 0.75), (f["exceed"] <= 0.05, 0.5))).alias("arima"),
        (0.15 + points((f["peaks"].between(2, 5), 1.0), (f["spacing_cv"] <= 0.30, 0.75), (f["acf_seasonal"] >= 0.05, 0.5))).alias("patchtst"),
        points((f["changepoints"] >= 2, 1.25), (f["cusum"] >= 70, 0.75), (f["monotone"] >= 0.10, 0.5)).alias("itransformer"),
        (-0.50 + points((f["exceed"] >= 0.08, 0.75), (_stressed(f), 0.5), ((f["peaks"] >= 6) & (f["spacing_cv"] >= 0.35), 0.5))).alias("chronos2"),
    )


def ranked(scores: Column) -> Column:
    """Models by score, best first, ties in their order: array of struct(loss, place, model)."""
    return F.array_sort(F.array(*(
        F.struct((-scores[m]).alias("loss"), F.lit(i).alias("place"), F.lit(m).alias("model")) for i, m in enumerate(MODELS)
    )))


def primary_model(f: Column, scores: Column) -> Column:
    """The first rule that applies, else the best score; a rule over a feature that isn't there (null) doesn't apply."""
    wild = (f["exceed"] >= 0.085) & (f["peaks"] >= 6) & (f["spacing_cv"] >= 0.40)
    return (
        F.when(_stressed(f) | F.coalesce(wild, F.lit(False)), "chronos2")
        .when((f["acf1"] >= 0.93) & (f["changepoints"] <= 1) & (f["exceed"] <= 0.05) & (f["peaks"] <= 4), "arima")
        .when((f["changepoints"] >= 3) & ((f["cusum"] >= 70) | (f["monotone"] >= 0.10)), "itransformer")
        .when(f["peaks"].between(2, 5) & (f["spacing_cv"] <= 0.30), "patchtst").otherwise(ranked(scores)[0]["model"])
    )


def plan(f: Column) -> Column:
    """``struct(primary, runner_up, gap, tools)``: the model, its rival, and the tools that tell them apart."""
    stressed = _stressed(f)
    eventful = (f["segments"] >= 4) | f["dominant"].isin("rise", "fall", "oscillation")

    def rivalled(p: Column) -> Column:
        rival = F.filter(ranked(p["scores"]), lambda r: r["model"] != p["primary"])[0]
        own = F.coalesce(*(F.when(p["primary"] == m, p["scores"][m]) for m in MODELS))
        return F.struct(p["primary"].alias("primary"), own.alias("own"), rival.alias("rival"))

    def compared(p: Column) -> Column:
        return F.struct(p["primary"].alias("primary"), p["rival"]["model"].alias("runner_up"), (p["own"] + p["rival"]["loss"]).alias("gap"))

    def of(p: Column) -> Column:
        def needed(tool: str) -> Column:
            asks = lambda model: model.isin(*(m for m in MODELS if tool in NEEDS[m]))
            extra = {"extract_basic_statistics": F.lit(True), "extract_data_quality": stressed, "extract_event_summary": eventful}
            return asks(p["primary"]) | ((p["gap"] <= 0.75) & asks(p["runner_up"])) | extra.get(tool, F.lit(False))

        tools = F.array_compact(F.array(*(F.when(needed(t), F.lit(t)) for t in TOOLS)))
        return F.struct(p["primary"].alias("primary"), p["runner_up"].alias("runner_up"), p["gap"].alias("gap"), tools.alias("tools"))

    # Every step is bound: the ranking of the models is found once a row.
    p = let(model_scores(f), lambda s: F.struct(s.alias("scores"), primary_model(f, s).alias("primary")))
    for step in (rivalled, compared, of):
        p = let(p, step)
    return p


# What a plan says of its features, its decision and its tools.
EVIDENCE = (
    "strong short-lag autocorrelation", "repeatable local seasonality", "structural drift", "irregular residual excursions", "possible data-quality stress",
)
FOCUS = {
    "extract_basic_statistics": "baseline autocorrelation and seasonal strength", "extract_within_channel_dynamics": "local peaks, changepoints, and slope persistence",
    "extract_forecast_residuals": "linear predictability and residual stress", "extract_data_quality": "quantization, saturation, and corruption signals",
    "extract_event_summary": "segment-level rise, fall, and oscillation patterns",
}
MIXED = "The window mixes stable and shifting behavior."
BROADER = "I need a broader diagnostic pass to separate the competing temporal explanations before routing."
MINIMUM = "I will gather the minimum evidence needed to establish a confident routing state."


def rationale(f: Column, p: Column) -> Column:
    """The plan's reason in words: up to three pieces of evidence, how sure it is, and what its tools look at.

    ``p`` is a ``plan`` of the features ``f``.
    """
    seasonal = (f["acf_seasonal"] >= 0.05) | (f["peaks"].between(2, 5) & (f["spacing_cv"] <= 0.30))
    tests = (f["acf1"] >= 0.88, seasonal, (f["changepoints"] >= 2) | (f["cusum"] >= 70), f["exceed"] >= 0.08, _stressed(f))
    pattern = F.when(f["dominant"].isin("rise", "fall", "oscillation"), F.concat(f["dominant"], F.lit("-dominant event structure")))
    found = F.array_compact(F.array(*(F.when(t, F.lit(e)) for t, e in zip(tests, EVIDENCE)), pattern))
    opener = let(found, lambda e: F.when(F.size(e) == 0, MIXED).otherwise(F.concat(F.lit("The window shows "), F.array_join(F.slice(e, 1, 3), ", "), F.lit("."))))
    focus = F.create_map(*(F.lit(x) for pair in FOCUS.items() for x in pair))
    looks = F.array_join(F.transform(p["tools"], lambda t: F.coalesce(F.try_element_at(focus, t), F.replace(t, F.lit("_"), F.lit(" ")))), ", ")
    return F.concat_ws(" ", opener, F.when((p["gap"] <= 0.75) & (p["runner_up"] != p["primary"]), BROADER).otherwise(MINIMUM), F.concat(F.lit("I will inspect "), looks, F.lit(".")))


def batches(tools: Column, size: int) -> Column:
    """Known tools in their order, in groups of ``size``; the basic one where none is known."""
    known = let(tools, lambda own: F.filter(F.array(*map(F.lit, TOOLS)), lambda t: F.array_contains(own, t)))
    own = let(known, lambda v: F.when(F.size(v) == 0, F.array(F.lit(TOOLS[0]))).otherwise(v))
    size = max(1, size)
    return let(own, lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size)), lambda i: F.slice(v, (i * size + 1).cast("int"), F.lit(size))))


def confidence_tier(chosen: Column, teacher: Column, gap: Column, margin: Column) -> Column:
    """high, mid or low; low wherever rule and teacher disagree."""
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    g, m = F.coalesce(gap, F.lit(0.0)), F.coalesce(margin, F.lit(0.0))
    return (
        F.when(clean(chosen) != clean(teacher), "low").when((g >= 0.25) & (m >= 0.03), "high")
        .when((g >= 0.15) & (m >= 0.01), "mid").otherwise("low")
    )


def diagnosis(r: Column) -> Column:
    """``struct(bucket, reason, severity)`` of one answer; the order of the cases is the rule.

    ``r``: score, status, message, format_reason, reject_reason, tool_error, calls,
    illegal_calls, missing, degraded, defaulted.
    """
    clean = lambda c: F.trim(F.coalesce(r[c], F.lit("")))
    message, number = F.lower(clean("message")), lambda c, n: F.coalesce(r[c], F.lit(n))
    why = F.when(clean("reject_reason") != "", clean("reject_reason")).when(clean("format_reason") != "ok", clean("format_reason")).otherwise("")
    workflow = (
        F.when(message.contains("copy input") | message.contains("future timestamps"), "copied_input")
        .when(number("illegal_calls", 0) > 0, "illegal_refinement_tool_call")
        .when((number("calls", -1) >= 0) & (number("calls", -1) != 1), "prediction_call_count_invalid")
        .when((number("missing", 0) > 0) | message.contains("diagnostic"), "missing_required_diagnostics").otherwise("workflow_rejected")
    )
    named = why
    for prefix, name in (
        ("empty_solution", "empty_solution"), ("length_mismatch", "length_mismatch"), ("invalid_answer_shape", "invalid_answer_shape"),
        ("extra_text_outside_tags", "extra_text_outside_tags"), ("missing_think", "missing_think_block"),
        ("missing_answer_block", "missing_answer_block"), ("missing_answer_close_tag", "missing_answer_close_tag"),
    ):
        named = F.when(why.startswith(prefix), name).otherwise(named)
    case = lambda bucket, reason, severity: F.struct(
        F.lit(bucket).alias("bucket"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), F.lit(severity).alias("severity")
    )
    finite = r["score"].isNotNull() & ~F.isnan(r["score"]) & (F.abs(r["score"]) != float("inf"))
    return (
        F.when(clean("tool_error") != "", case("tool_error", "prediction_tool_error", 100))
        .when(F.lower(clean("status")) == "rejected", case("workflow_violation", workflow, 95))
        .when(why != "", case("format_failure", named, 85))
        .when(finite & (r["score"] <= -0.99), case("hard_failure", "negative_one_reward", 80))
        .when(F.coalesce(r["degraded"], F.lit(False)), case("quality_regression", "refinement_degraded", 60))
        .when(F.coalesce(r["defaulted"], F.lit(False)), case("policy_gap", "prediction_model_defaulted", 30))
        .when(number("missing", 0) > 0, case("policy_gap", "missing_required_diagnostics", 30)).otherwise(case("ok", "ok", 0))
    )


def required_tools(required: Column, executed: Column) -> Column:
    """Required tools, known ones in their order; what ran where nothing is required."""
    asked = F.filter(required, lambda t: F.trim(t) != "")
    known = F.filter(F.array(*map(F.lit, TOOLS)), lambda t: F.array_contains(asked, t))
    return F.when(F.size(asked) == 0, executed).when(F.size(known) > 0, known).otherwise(asked)


def turn_stage(predicted: Column, executed: Column, required: Column) -> Column:
    names = required_tools(required, executed)
    missing = F.exists(names, lambda t: ~F.array_contains(executed, t))
    return (
        F.when(predicted, "refinement").when((F.size(names) > 0) & missing, "diagnostic")
        .when((F.size(names) > 0) | (F.size(executed) > 0), "routing").otherwise("diagnostic")
    )


def coverage(executed: Column, required: Column) -> Column:
    names = required_tools(required, executed)
    hit = F.size(F.filter(names, lambda t: F.array_contains(executed, t)))
    return F.when(F.size(names) == 0, F.when(F.size(executed) > 0, 1.0).otherwise(0.0)).otherwise(hit / F.greatest(F.size(names), F.lit(1)))


def workflow(r: Column) -> Column:
    """``struct(valid, penalty, check)``: the first of five checks that fails (0: none).

    ``r``: diagnosed, predicted, calls, stage, illegal_calls, copied.
    """
    fail = lambda penalty, check: F.struct(F.lit(False).alias("valid"), F.lit(penalty).alias("penalty"), F.lit(check).alias("check"))
    return (
        F.when(~r["diagnosed"], fail(-0.5, 1)).when(~r["predicted"], fail(-0.5, 2)).when(r["calls"] != 1, fail(-0.5, 3))
        .when(F.lower(F.trim(F.coalesce(r["stage"], F.lit("")))) != "routing", fail(-0.5, 3))
        .when(r["illegal_calls"] > 0, fail(-0.5, 4)).when(r["copied"], fail(-1.0, 5))
        .otherwise(F.struct(F.lit(True).alias("valid"), F.lit(0.0).alias("penalty"), F.lit(0).alias("check")))
    )


def supported(model: Column) -> Column:
    """The normalised name of a known model, else null."""
    m = F.lower(F.trim(model))
    return F.when(m.isin(*MODELS), m)


def route_label(label: Column) -> Column:
    """A known label, normalised; empty otherwise."""
    v = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    target = supported(F.regexp_extract(v, r"^override_to_(.*)$", 1))
    return F.when(v == KEEP, KEEP).when(target.isNotNull(), F.concat(F.lit("override_to_"), target)).otherwise("")


def resolved_route(default: Column, label: Column, decision: Column, override: Column) -> Column:
    """``struct(decision, override, model)`` that a route stands for, null where it contradicts itself."""
    d, v = supported(default), route_label(label)
    chosen = F.lower(F.trim(F.coalesce(decision, F.lit(""))))
    target = F.coalesce(supported(override), supported(F.regexp_extract(v, r"^override_to_(.*)$", 1)))
    keep = F.struct(F.lit(KEEP).alias("decision"), F.lit("").alias("override"), d.alias("model"))
    switch = F.struct(F.lit("override").alias("decision"), target.alias("override"), target.alias("model"))
    return (
        F.when(d.isNull() | (v == ""), F.lit(None)).when(v == KEEP, keep)
        .when(chosen.isin("", "override") & target.isNotNull() & (target != d), switch)
    )


def first_finite(*columns: Column) -> Column:
    """The first value that is a finite number."""
    ok = lambda c: F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c)
    return F.coalesce(*(ok(c.try_cast("double")) for c in columns))


def support_signals(tools: Column, edits: Column) -> Column:
    """Array of ``struct(edit, signals)``: what speaks for each edit, given the tools that ran."""
    residuals, dynamics = (F.array_contains(tools, t) for t in ("extract_forecast_residuals", "extract_within_channel_dynamics"))
    said = {
        "isolated_spike_smoothing": ((residuals, "residual_spike_signal"), (dynamics, "irregular_local_spike")),
        "local_level_adjust": ((residuals, "residual_level_shift"),),
        "local_slope_adjust": ((residuals, "residual_drift_signal"), (dynamics, "local_slope_shift")),
    }

    def of(edit: Column) -> Column:
        out = F.array(F.lit("none"))
        for name, rules in said.items():
            found = F.array_compact(F.array(*(F.when(c, F.lit(s)) for c, s in rules)))
            out = F.when(edit == name, F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("none")))).otherwise(out)
        return F.struct(edit.alias("edit"), out.alias("signals"))

    return F.transform(F.array_distinct(edits), of)


def quality_score(best: Column, margin: Column) -> Column:
    return best + 0.25 * F.greatest(margin, F.lit(0.0))


def step_budget(absolute: Column, configured: Column, attempts: Column) -> Column:
    found = F.greatest(F.coalesce(configured, F.lit(0)), attempts + 2, F.lit(1))
    return F.when(absolute.isNotNull(), F.greatest(absolute, F.lit(1))).otherwise(found)


def batch_divisor(total: Column, target: Column) -> Column:
    """The divisor of ``total`` nearest to ``target``, the larger one of two as near."""
    t = F.greatest(F.lit(1), F.least(target, total))
    n = total.cast("long")
    small = F.filter(F.sequence(F.lit(1).cast("long"), F.floor(F.sqrt(n)).cast("long")), lambda d: n % d == 0)  # each with its counterpart
    every = F.flatten(F.transform(small, lambda d: F.array(d, F.call_function("div", n, d))))
    return let(t, lambda want: F.array_sort(F.transform(every, lambda d: F.struct(F.abs(d - want).alias("gap"), (-d).alias("size"))))[0]["size"] * -1)


def can_still_pass(successes: list[Column], seen: Column, total: Column, threshold: float) -> Column:
    left = F.greatest(total - seen, F.lit(0))
    return F.least(*((s + left) / F.greatest(total, F.lit(1)) for s in successes)) >= threshold


def top_gains(gains: Column, n: int = 2) -> Column:
    """Names of the largest gains over the default, smaller own gap first among equals.

    ``gains``: array of struct(name, gain, gap).
    """
    order = F.array_sort(F.transform(gains, lambda g: F.struct((-g["gain"]).alias("a"), g["gap"].alias("b"), g["name"].alias("c"))))
    return F.transform(F.slice(order, 1, n), lambda g: g["c"])
