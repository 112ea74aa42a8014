"""Tool calls along trajectories: which are refused, what state they leave, one log row a turn.

The rules read like a loop over calls whose verdicts change the state that later calls
meet (a refused call spends no budget and marks no tool as done).  Every part of that state is
the first or the count of calls that meet conditions known before it, so it comes from group
aggregates and running totals instead: no task folds a trajectory from its start, and
one of any length is many tasks (``scans``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy
from .scans import bucketed, carried, inside, running_total

# The tools that ask for a forecast, and the stages' names.
ROUTERS = ("predict_time_series", "route_time_series")
DIAGNOSTIC, ROUTING, REFINEMENT = "diagnostic", "routing", "refinement"


def _clean(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def gated(calls: DataFrame, required: DataFrame, budget: int, default: str) -> DataFrame:
    """``calls`` with stage, ``refused`` (null if allowed) and the state after each call.

    ``calls``: series_id, pos (dense from 0), turn, name, decision, model, works (whether the
    forecast succeeds), stage (blank: by the rule).  ``required``: series_id, required (tools).

    The stage of a turn is that of its start: refinement once a forecast succeeded; else
    diagnostic until all required tools ran (any tool where none is required); then routing.
    Refused are: all calls after a forecast; forecasts in a diagnostic turn or without a
    completed diagnostic tool, with an unknown decision or model, or beyond ``budget`` attempts;
    diagnostic tools in a routing turn, twice, or unknown.
    """
    r = calls.withColumns({
        "_given": _clean(F.col("stage")), "_routes": F.col("name").isin(*ROUTERS), "_known": F.col("name").isin(*policy.TOOLS),
    }).drop("stage")
    r = r.join(_ready(r, required), "series_id", "left")
    by_rule = F.when(F.col("turn") > F.col("_ready"), ROUTING).otherwise(DIAGNOSTIC)
    r = r.withColumn("stage", F.when(F.col("_given") != "", F.col("_given")).otherwise(by_rule))

    done = r.where(F.col("_known") & (F.col("stage") != ROUTING)).groupBy("series_id", "name").agg(F.min("pos").alias("at"))
    done = done.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("_done"))  # a tool once
    r = r.join(done, "series_id", "left")
    before = lambda test: F.coalesce(F.exists("_done", lambda t: (t["at"] < F.col("pos")) & test(t)), F.lit(False))
    route, decision = F.col("name") == "route_time_series", _clean(F.col("decision"))
    named = F.when(_clean(F.col("model")) == "", "__missing__").otherwise(_clean(F.col("model")))
    r = r.withColumns({
        "_again": before(lambda t: t["name"] == F.col("name")), "_analysed": before(lambda t: F.lit(True)),
        "_odd": route & ~decision.isin("keep_default", "override"),
        "_asked": F.when(~route | (decision == "override"), named).when(decision == "keep_default", default).otherwise(""),
    })
    r = r.withColumn("_reaches", F.col("_routes") & (F.col("stage") != DIAGNOSTIC) & F.col("_analysed"))
    r = r.withColumn("_valid", F.col("_reaches") & ~F.col("_odd") & F.col("_asked").isin(*policy.MODELS))
    r = running_total(bucketed(r.withColumn("_one", F.col("_valid").cast("int"))).drop("own"), "_one", "_tries")
    r = r.withColumn("_attempt", F.col("_valid") & (F.col("_tries") <= budget))

    hit = F.when(F.col("_attempt") & F.col("works"), F.struct("pos", "turn", "_tries", "stage"))
    r = r.join(r.groupBy("series_id").agg(F.min(hit).alias("_hit")), "series_id")
    after, upto = F.coalesce(F.col("pos") > F.col("_hit.pos"), F.lit(False)), F.coalesce(F.col("_hit.pos") <= F.col("pos"), F.lit(False))
    refinement = (F.col("_given") == "") & F.coalesce(F.col("_hit.turn") < F.col("turn"), F.lit(False))
    refused = (
        F.when(after, "call_after_prediction")
        .when(F.col("_routes") & (F.col("stage") == DIAGNOSTIC), "routing_in_diagnostic_turn")
        .when(F.col("_routes") & ~F.col("_analysed"), "no_completed_diagnostic_tool")
        .when(F.col("_routes") & F.col("_odd"), "invalid_decision").when(F.col("_routes") & ~F.col("_valid"), "invalid_model")
        .when(F.col("_routes") & ~F.col("_attempt"), "retry_budget_spent")
        .when(~F.col("_routes") & (F.col("stage") == ROUTING), "feature_tool_in_routing_turn")
        .when(F.col("_again"), "duplicate_feature_tool").when(~F.col("_routes") & ~F.col("_known"), "unknown_tool")
    )
    # what the last call that got so far has set
    error = (
        F.when(F.col("_odd"), "invalid_decision").when(~F.col("_valid"), "invalid_model")
        .when(F.col("_attempt"), F.when(F.col("works"), "").otherwise("prediction_failed"))
    )
    own = F.col("_reaches") & ~after
    r = r.withColumns({"_set": F.when(own, F.struct(F.col("_asked").alias("asked"))), "_error": F.when(own, error)})
    r = _last_set(r)
    tries = F.when(after, F.col("_hit._tries")).otherwise(F.col("_tries"))
    sequence = F.transform(F.filter("_done", lambda t: t["at"] <= F.least("pos", F.coalesce("_hit.pos", "pos"))), lambda t: t["name"])
    return r.withColumns({
        "stage": F.when(refinement, REFINEMENT).otherwise(F.col("stage")), "refused": refused,
        "attempts": F.least(tries, F.lit(budget)).cast("long"), "prediction_calls": upto.cast("long"),
        "illegal_calls": F.when(after, F.col("pos") - F.col("_hit.pos")).otherwise(F.lit(0)).cast("long"),
        "requested_model": F.coalesce("_asked_last", F.lit("")), "tool_error": F.coalesce("_error_last", F.lit("")),
        "prediction_step": F.when(upto, F.col("_hit.turn") + 1).otherwise(F.lit(0)).cast("long"),
        "prediction_stage": F.when(upto, F.col("_hit.stage")).otherwise(F.lit("")),
        "sequence": F.coalesce(sequence, F.array().cast("array<string>")),
    }).select(*calls.columns, "refused", "attempts", "prediction_calls", "illegal_calls", "requested_model", "tool_error", "prediction_step", "prediction_stage", "sequence")


def _ready(r: DataFrame, required: DataFrame) -> DataFrame:
    """``series_id, _ready``: the turn after which nothing required is missing (null: never).

    A required tool is done by its first call that no given routing stage refuses: until all are done no turn is a routing one by the rule.
    """
    firsts = r.where(F.col("_known") & (F.col("_given") != ROUTING)).groupBy("series_id", "name").agg(F.min("turn").alias("turn"))
    seen = firsts.groupBy("series_id").agg(F.collect_list(F.struct("name", "turn")).alias("_seen"))  # a tool once
    j = seen.join(required, "series_id", "left")
    asked = F.filter(F.coalesce("required", F.array().cast("array<string>")), lambda t: F.trim(t) != "")
    known = F.filter(F.array(*map(F.lit, policy.TOOLS)), lambda t: F.array_contains(asked, t))
    j = j.withColumn("_names", F.when(F.size(known) > 0, known).otherwise(asked))
    turns = lambda keep: F.transform(F.filter("_seen", keep), lambda f: f["turn"])
    hits = turns(lambda f: F.array_contains("_names", f["name"]))
    ready = F.when(F.size("_names") == 0, F.array_min(turns(lambda f: F.lit(True)))).when(F.size(hits) == F.size("_names"), F.array_max(hits))
    return j.select("series_id", ready.alias("_ready"))


def _last_set(r: DataFrame) -> DataFrame:
    """Adds the model and the error that stand after each call: the last ones that it or a call before it has set."""
    latest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("pos")))
    handed = carried(
        r, {"_s": latest("_set"), "_e": latest("_error")},
        {"_s0": F.last("_s", ignorenulls=True), "_e0": F.last("_e", ignorenulls=True)},
    )
    w = inside().rowsBetween(Window.unboundedPreceding, 0)
    here = lambda c: F.last(c, ignorenulls=True).over(w)
    return handed.withColumns({"_asked_last": F.coalesce(here("_set"), "_s0")["asked"], "_error_last": F.coalesce(here("_error"), "_e0")})


def turn_log(calls: DataFrame, required: DataFrame, budget: int, default: str, configured_steps: int = 0) -> DataFrame:
    """One row a turn: its calls, and the tracking fields as they stand after its last call.

    ``trajectory`` fields: attempts, successful forecasts, illegal calls, requested model, tool error,
    step and stage of the forecast; tools run in order, required and missing ones, signatures, coverage,
    step budget; and the diagnosis that follows from them.
    """
    g = gated(calls, required, budget, default)
    last = F.max_by(F.struct(*(c for c in g.columns if c not in ("series_id", "turn", "name", "pos"))), "pos").alias("s")
    names = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name", "refused"))), lambda c: c["name"])  # a turn's calls
    turns = g.groupBy("series_id", "turn").agg(
        last, names.alias("names"), F.min_by("stage", "pos").alias("turn_stage"), F.count("refused").alias("refused_calls")
    )
    t = turns.join(required, "series_id", "left")
    executed = F.filter(F.array(*map(F.lit, policy.TOOLS)), lambda x: F.array_contains("s.sequence", x))
    t = t.withColumn("executed", executed)
    t = t.withColumn("wanted", policy.required_tools(F.coalesce("required", F.array().cast("array<string>")), F.col("executed")))
    t = t.withColumn("missing", F.size(F.filter("wanted", lambda x: ~F.array_contains("executed", x))).cast("long"))
    joined = lambda c, sep: F.when(F.size(c) == 0, "none").otherwise(F.array_join(c, sep))
    d = policy.diagnosis(F.struct(
        F.lit(None).cast("double").alias("score"), F.lit("").alias("status"), F.lit("").alias("message"), F.lit("ok").alias("format_reason"),
        F.lit("").alias("reject_reason"), F.col("s.tool_error").alias("tool_error"), F.col("s.prediction_calls").alias("calls"),
        F.col("s.illegal_calls").alias("illegal_calls"), "missing", F.lit(False).alias("degraded"), F.lit(False).alias("defaulted"),
    ))
    return t.withColumn("d", d).select(
        "series_id", "turn", "turn_stage", joined("names", "->").alias("tool_call_sequence"), F.size("names").cast("long").alias("tool_call_count"), "refused_calls",
        *(F.col(f"s.{c}") for c in ("attempts", "prediction_calls", "illegal_calls", "requested_model", "tool_error", "prediction_step", "prediction_stage")),
        joined("s.sequence", "->").alias("feature_tool_signature"), F.size("s.sequence").cast("long").alias("feature_tool_count"),
        joined("wanted", "->").alias("required_signature"), F.size("wanted").cast("long").alias("required_count"), "missing",
        joined("executed", "|").alias("analysis_signature"), policy.coverage(F.col("executed"), F.coalesce("required", F.array().cast("array<string>"))).alias("coverage"),
        policy.step_budget(F.lit(None).cast("int"), F.lit(configured_steps), F.lit(budget)).cast("long").alias("step_budget"),
        F.col("d.bucket").alias("debug_bucket"), F.col("d.reason").alias("debug_reason"), F.col("d.severity").cast("long").alias("debug_severity"),
    )
