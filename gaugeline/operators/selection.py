"""Ranking, even spacing, buckets, quotas, rebalancing and trajectory algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.scores import ratio
from .ordering import kept, numbered, quantiles
from .scans import affine_suffix


def rank_models(errors: DataFrame) -> DataFrame:
    """Models of each sample by (mse, name), with margin to the second and the default."""
    w = Window.partitionBy("sample").orderBy("mse", "model")
    return errors.withColumn("rank", F.row_number().over(w))


def route_info(errors: DataFrame, default: str) -> DataFrame:
    """One row a sample: best, second, margins and improvement over the default model."""
    r = rank_models(errors)
    pick = lambda cond, c: F.max(F.when(cond, F.col(c)))
    one, two, own = F.col("rank") == 1, F.col("rank") == 2, F.col("model") == default
    out = r.groupBy("sample").agg(
        pick(one, "model").alias("best"), pick(one, "mse").alias("best_error"),
        pick(two, "model").alias("second"), pick(two, "mse").alias("second_error"),
        pick(own, "mse").alias("default_error"), F.max(F.when(own, F.col("rank") <= 2)).alias("default_in_top2"),
    )
    gain = F.col("default_error") - F.col("best_error")
    margin = F.col("second_error") - F.col("best_error")
    return out.withColumns({
        "improvement": F.round(gain, 7), "improvement_rel": F.round(ratio(gain, F.col("default_error")), 6),
        "margin_rel": F.round(ratio(margin, F.col("second_error")), 6),
    })


def override_thresholds(
    routes: DataFrame, models: list[str], default: str, q: float = 0.8, floor: float = 0.35
) -> DataFrame:
    """Of each model but the default: the q-quantile of its positive relative improvements, at least ``floor``.

    Fit it on the training split only; models that never win get the floor.
    """
    spark = routes.sparkSession
    named = spark.createDataFrame([(m,) for m in models if m != default], "best string")
    gains = routes.where((F.col("best") != default) & (F.col("improvement_rel") > 0))
    found = quantiles(gains, "improvement_rel", (q,), ("best",))
    return named.join(found, "best", "left").select(
        "best", F.round(F.greatest(F.coalesce("q0", F.lit(0.0)), F.lit(floor)), 6).alias("threshold")
    )


def triage(routes: DataFrame, thresholds: DataFrame, default: str, keep: float = 0.05, margin: float = 0.08) -> DataFrame:
    """keep / override / ambiguous, with confidence."""
    r = routes.join(thresholds, "best", "left").withColumn("threshold", F.coalesce("threshold", F.lit(1.0)))
    keeps = (F.col("best") == default) | (F.col("improvement_rel") <= keep)
    overrides = (F.col("improvement_rel") >= F.col("threshold")) & (
        (F.col("margin_rel") >= margin) | ~F.col("default_in_top2")
    )
    return r.withColumn(
        "bucket", F.when(keeps, "keep").when(overrides, "override").otherwise("ambiguous")
    ).withColumn(
        "label",
        F.when(F.col("bucket") == "keep", "keep_default")
        .when(F.col("bucket") == "override", F.concat(F.lit("override_to_"), "best")).otherwise(""),
    ).withColumn("confidence", F.when(F.col("bucket") == "keep", F.when(F.col("best") == default, "high").otherwise("mid")).when(F.col("bucket") == "override", "high").otherwise(""))


def evenly_spaced(rows: DataFrame, order: str, k: int, rule: str = "half_even", single: str = "middle") -> DataFrame:
    """``k`` rows at places i * (n - 1) / (k - 1) of the order, rounded half to even, or floored.

    All rows where there are no more than ``k``; of one, the middle or the first one; none for ``k`` < 1.
    """
    return _at_places(numbered(rows, order), k, rule, single, fill=False)


def evenly_spaced_filled(rows: DataFrame, order: str, k: int) -> DataFrame:
    """Exactly ``k`` rows: even places, and where two fall together the first rows not yet taken; one: the first."""
    return _at_places(numbered(rows, order), k, "half_even", "first", fill=True)


def even_places(k: int, n: Column, rule: str = "half_even", single: str = "middle") -> Column:
    """Zero-based places of ``k`` evenly spaced of ``n`` rows, as an array."""
    if k <= 0:
        return F.array().cast("array<long>")
    if k == 1:
        return F.array((F.floor(n / 2) if single == "middle" else F.lit(0)).cast("long"))
    spot = lambda i: i * (n - 1) / F.lit(k - 1)
    turn = F.bround if rule == "half_even" else F.floor
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: turn(spot(i)).cast("long")))


def _at_places(placed: DataFrame, k: int, rule: str, single: str, fill: bool) -> DataFrame:
    n = placed.agg(F.count("*").alias("_n"))
    wanted = n.select("_n", even_places(k, F.col("_n"), rule, single).alias("_wanted"))
    if fill:
        spare = F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(max(2 * k, 1)).cast("long")), "_wanted")
        wanted = wanted.withColumn("_wanted", F.concat("_wanted", F.slice(spare, F.lit(1), F.lit(k) - F.size("_wanted"))))
    joined = placed.crossJoin(F.broadcast(wanted))  # one row of k places
    take = (F.col("_n") <= k) if k > 0 else F.lit(fill)
    return joined.where(take | F.array_contains("_wanted", F.col("place"))).drop("_n", "_wanted")


def bucket_best(rows: DataFrame, order: str, score: str | list, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Best row (earliest of equals) of each of ``k`` contiguous buckets of the order, within equal ``by``.

    Bucket b holds places floor(b n / k) to floor((b + 1) n / k); with no more rows than
    ``k`` every row is its own.  ``score`` may be several columns, compared in turn.
    """
    scores = [score] if isinstance(score, str) else score
    r = numbered(rows, order, by=by)
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    r = r.join(sizes, list(by)) if by else r.crossJoin(F.broadcast(sizes))  # without groups one row
    bucket = F.floor(((F.col("place") + 1) * k - 1) / F.col("_n"))
    r = r.withColumn("bucket", F.when(F.col("_n") <= k, F.col("place")).otherwise(bucket))
    w = Window.partitionBy(*by, "bucket").orderBy(*map(F.desc, scores), order)
    return r.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_n", "place")


def balanced_selection(rows: DataFrame, order: str, score: str | list, model: str, total: int) -> DataFrame:
    """``total`` rows: as many bucket winners of each model as divide evenly, then of the rest, then by score.

    Expects few models; ``order`` identifies a row.
    """
    names = [r[0] for r in rows.select(model).distinct().orderBy(model).limit(total + 1).collect()]
    each = total // len(names) if 0 < len(names) <= total else 0
    columns = rows.columns
    if rows.count() <= total:
        return rows
    taken = bucket_best(rows, order, score, each, (model,)).select(*columns) if each and len(names) > 1 else rows.limit(0)
    taken = kept(taken)
    missing = total - taken.count()
    if missing <= 0:
        return taken
    rest = rows.join(taken.select(order), order, "left_anti")
    return taken.unionByName(bucket_best(rest, order, score, missing).select(*columns))


def quota_selection(
    rows: DataFrame, order: str, score: str | list, model: str, total: int, quotas: list[tuple[Column, float]]
) -> DataFrame:
    """``total`` rows: for each (condition, share) up to ceil(share * total) rows that meet it, then a balanced fill.

    The first quota is spread over the order alone, later ones over the models as well.
    """
    taken = rows.limit(0)
    for i, (condition, share) in enumerate(quotas):
        pool = rows.where(condition).join(taken.select(order), order, "left_anti")
        want = min(int(-(-share * total // 1)), total - taken.count())
        if want > 0:
            pick = pool if pool.count() <= want else None
            if pick is None:
                pick = bucket_best(pool, order, score, want).select(*rows.columns) if i == 0 else balanced_selection(pool, order, score, model, want)
            taken = kept(taken.unionByName(pick.select(*rows.columns)))
    rest = rows.join(taken.select(order), order, "left_anti")
    want = total - taken.count()
    return taken.unionByName(balanced_selection(rest, order, score, model, want).select(*rows.columns)) if want > 0 else taken


def quota(rows: DataFrame, group: str, best: str, key: str, total: int, groups: list[str]) -> DataFrame:
    """``total`` rows by rank in their group: an equal quota of one at least, the remainder to the
    first of the present ``groups`` in their order, then the best of all leftovers."""
    spark = rows.sparkSession
    present = {r[0] for r in rows.select(group).distinct().limit(len(groups) + 1).collect()}
    present = [g for g in groups if g in present]
    if total <= 0 or not present:
        return rows.limit(0)
    each = max(1, total // len(present))
    extra = max(0, total - each * len(present))
    shares = [(g, i, each + (i < extra)) for i, g in enumerate(present)]
    q = spark.createDataFrame(shares, "_group string, _model int, _quota int")  # a row a group
    w = Window.partitionBy(group).orderBy(F.desc(best), F.desc(key))
    r = rows.withColumn("_rn", F.row_number().over(w)).join(F.broadcast(q), F.col(group) == F.col("_group"))
    first = r.where("_rn <= _quota")
    first = first.orderBy("_model", "_rn").limit(total) if each * len(present) > total else first
    fill = r.where("_rn > _quota").orderBy(F.desc(best), F.desc(key), "_rn").limit(max(0, total - min(total, first.count())))
    return first.unionByName(fill).drop("_rn", "_group", "_model", "_quota")


def keep_selection(rows: DataFrame, default: str, k: int) -> DataFrame:
    """``k`` keeps, evenly spaced in the order default-best first, then improvement, then index."""
    order = F.struct((F.col("best") != default).alias("o1"), F.col("improvement_rel").alias("o2"), F.col("sample").alias("o3"))
    return evenly_spaced(rows.withColumn("_order", order), "_order", k).drop("_order", "place")


def half_and_half(labelled: DataFrame, default: str, models: list[str], total: int, fill: bool) -> DataFrame:
    """Up to half keeps, the rest overrides balanced over models; ``fill`` takes leftovers by index."""
    keeps, overrides = (labelled.where(F.col("bucket") == b) for b in ("keep", "override"))
    n_keep = min(keeps.count(), max(1, total // 2))
    n_over = min(overrides.count(), max(1, total - n_keep))
    chosen = keep_selection(keeps, default, n_keep).unionByName(
        quota(overrides, "best", "improvement_rel", "sample", n_over, [m for m in models if m != default])
    )
    if fill:
        chosen = kept(chosen)
        missing = total - chosen.count()
        if missing > 0:
            rest = labelled.where(F.col("bucket") != "ambiguous").join(chosen.select("sample"), "sample", "left_anti")
            chosen = chosen.unionByName(rest.orderBy("sample").limit(missing))
    return chosen


def repeated_to_ratio(rows: DataFrame, source: str, stage: str, wanted: str, share: float) -> DataFrame:
    """Copies of whole source groups of one stage, in turn, until that stage holds ``share`` of all rows.

    Adds ``copy``; every source with the stage is repeated as a whole, the first ones once more.
    """
    own = rows.where(F.col(stage) == wanted)
    n = rows.agg(F.count(F.when(F.col(stage) == wanted, 1)).alias("a"), F.count("*").alias("n")).first()
    target = int(-(-share * (n["n"] - n["a"]) // (1 - share)))
    groups = own.groupBy(source).agg(F.count("*").alias("_rows"))
    placed = numbered(groups, source, name="_place")
    before = placed.select("_place", "_rows")
    sums = running_sum(before, "_place", "_rows", "_before")
    total = max(n["a"], 1)
    rounds, rest = divmod(max(0, target - n["a"]), total)
    placed = placed.join(sums.select("_place", "_before"), "_place")
    times = F.lit(1 + rounds) + F.when(F.col("_before") < rest, 1).otherwise(0)
    repeated = own.join(placed.select(source, times.alias("_times")), source)
    others = rows.where(F.col(stage) != wanted).withColumn("copy", F.lit(0))
    return copies(repeated, F.col("_times")).drop("_times").unionByName(others.select(*rows.columns, "copy"))


def running_sum(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the rows before each, by blocks of the dense ``order`` (places from 0)."""
    block = rows.withColumn("_block", F.floor(F.col(order) / 65536))
    sums = block.groupBy("_block").agg(F.sum(value).alias("_sum"))  # a row for 65,536 places
    base = sums.select("_block", F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return block.join(base, "_block").withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("_block", "_base")


def kept_by_ratio(rows: DataFrame, kind: str, key: str, priority: Column, share: float) -> DataFrame:
    """``rows`` without the keeps that stand in the way of a ``share`` of local edits.

    Keeps may number floor(local * (1 - share) / share) less the rows of other kinds.  Of
    the keeps by ``key``, those of ``priority`` come first (the first ones if they are too many); the
    rest is an even, floored spread of the others.  Nothing changes where a kind is
    missing, the share is met, or the keeps are few enough.
    """
    n = rows.agg(*(F.count(F.when(F.col(kind) == k, 1)).alias(k) for k in ("local_refine", "validated_keep")), F.count("*").alias("all")).first()
    local, keeps = n["local_refine"], n["validated_keep"]
    if share <= 0 or not local or not keeps or local / n["all"] >= share:
        return rows
    target = max(int(local * (1.0 - share) / share) - (n["all"] - local - keeps), 0)
    if keeps <= target:
        return rows
    own = F.coalesce(F.col(kind) == "validated_keep", F.lit(False))
    return rows.where(~own).unionByName(downsampled(rows.where(own), key, priority, target))


def downsampled(rows: DataFrame, key: str, priority: Column, target: int) -> DataFrame:
    """``target`` rows: the first ones of ``priority`` by key, then of the others an even, floored spread (all if fewer)."""
    priority = F.coalesce(priority, F.lit(False))
    first, rest = rows.where(priority), rows.where(~priority)
    n = first.count()
    if n >= target:
        return first.orderBy(key).limit(max(target, 0))
    return first.unionByName(evenly_spaced(rest, key, target - n, "floor", "first").drop("place"))


def oversampled(rows: DataFrame, group: str, key: str, seed: int = 17) -> DataFrame:
    """Every class up to the largest; which rows repeat goes by a hash of their key."""
    return balance_classes(rows.withColumn("_h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)), group, "_h").drop("_h")


def shuffled_head(rows: DataFrame, key: str, n: int, seed: int = 17) -> DataFrame:
    """``n`` rows that come first by a hash of seed and key, the same in every run."""
    return rows.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), key).limit(n)


def by_category(rows: DataFrame, categories: list[tuple], key: str) -> DataFrame:
    """Rows picked category by category, none twice; adds ``category``.

    A category is (name, condition, order, limit, varied): where ``varied`` names a column,
    the first row of each of its values comes before the others.
    """
    chosen = None
    for name, condition, order, limit, varied in categories:
        pool = rows.where(condition)
        if chosen is not None:
            pool = pool.join(chosen.select(key), key, "left_anti")
        if varied:
            first = F.row_number().over(Window.partitionBy(varied).orderBy(*order, key))
            pool = pool.withColumn("_later", first > 1)
            order = ["_later", *order]
        pick = pool.orderBy(*order, key).limit(limit).select(*rows.columns, F.lit(name).alias("category"))
        chosen = kept(pick if chosen is None else chosen.unionByName(pick))
    return chosen


def spread_per_group(rows: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """Evenly spaced ``k`` rows of each group (the middle one for one)."""
    placed = numbered(rows, key, by=(group,))
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    r = placed.join(sizes, group).where((F.col("_n") <= k) | F.array_contains(even_places(k, F.col("_n")), F.col("place")))
    return r.drop("_n")


def top_fraction(rows: DataFrame, group: str, best: str, key: str, share: float) -> DataFrame:
    w = Window.partitionBy(group)
    r = rows.withColumn("rn", F.row_number().over(w.orderBy(F.desc(best), key))).withColumn("n", F.count("*").over(w))
    return r.where(F.col("rn") <= F.greatest(F.lit(1), F.ceil(F.col("n") * share))).drop("n")


def copies(rows: DataFrame, n: Column) -> DataFrame:
    """Each row ``n`` times; ``copy`` counts from 0."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), n.cast("int")))).withColumn("copy", F.col("copy") - 1)


def balance_classes(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Every class up to the largest: full repeats, and one more of the first rows."""
    r = numbered(rows, key, by=(group,), name="_at")
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    most = sizes.agg(F.max("_n").alias("_most"))  # one row
    r = r.join(sizes, group).crossJoin(F.broadcast(most))
    times = F.floor(F.col("_most") / F.col("_n")) + F.when(F.col("_at") < F.col("_most") % F.col("_n"), 1).otherwise(0)
    return copies(r, times).drop("_at", "_n", "_most")


def group_advantages(steps: DataFrame) -> DataFrame:
    """Terminal reward of every trajectory, standardised in its group (sample deviation)."""
    last = steps.groupBy("grp", "trajectory").agg(F.max_by("reward", "step").alias("reward"))
    w = Window.partitionBy("grp")
    sd = F.when(F.count("*").over(w) > 1, F.stddev_samp("reward").over(w)).otherwise(F.lit(1.0))
    mean = F.when(F.count("*").over(w) > 1, F.avg("reward").over(w)).otherwise(F.lit(0.0))
    return last.withColumn("advantage", F.round((F.col("reward") - mean) / (sd + 1e-6), 5))


def gae(steps: DataFrame, gamma: float = 0.9, lam: float = 0.8) -> DataFrame:
    """Generalised advantage of every step: adv(t) = delta(t) + gamma * lam * adv(t + 1), as a scan of affine maps.

    ``trajectory, step, reward, value``.  A trajectory of any length is many tasks; work is linear in its steps.
    """
    rows = numbered(steps, "step", by=("trajectory",), name="pos").withColumnRenamed("trajectory", "series_id")
    following = rows.select("series_id", (F.col("pos") - 1).alias("pos"), F.col("value").alias("_next"))
    rows = rows.join(following, ["series_id", "pos"], "left")
    delta = F.col("reward") + gamma * F.coalesce("_next", F.lit(0.0)) - F.col("value")
    maps = rows.select("series_id", "pos", "step", F.lit(gamma * lam).alias("a"), delta.alias("b"))
    return affine_suffix(maps, "a", "b", "y").select(F.col("series_id").alias("trajectory"), "step", F.round("y", 6).alias("advantage"))


def spanning_trajectories(steps: DataFrame) -> DataFrame:
    """Trajectories that stand in more than one group: group statistics would be wrong for them."""
    return steps.groupBy("trajectory").agg(F.min("grp").alias("a"), F.max("grp").alias("b")).where("a <> b").select("trajectory")


# --- filters and lookups ------------------------------------------------------------------------------


def in_stages(rows: DataFrame, stage: str, allowed: list[str]) -> DataFrame:
    """Rows of some stages, whatever their case and surrounding space."""
    return rows.where(F.lower(F.trim(F.coalesce(F.col(stage), F.lit("")))).isin(*allowed))


def confident(rows: DataFrame, stage: str, source: str, tier: str, least: str) -> DataFrame:
    """Drops only routing rows of heuristic origin whose tier ranks below ``least``."""
    clean = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    rank = F.when(clean(tier) == "high", 2).when(clean(tier) == "mid", 1).otherwise(0)
    low = rank < {"low": 0, "mid": 1, "high": 2}[least]
    return rows.where(~((clean(stage) == "routing") & (clean(source) == "heuristic") & low))


def parts(rows: DataFrame, required: Column, valid: Column) -> DataFrame:
    """Adds ``part``: skipped where not required, else checked or invalid."""
    return rows.withColumn("part", F.when(~required, "skipped").when(valid, "checked").otherwise("invalid"))


def strict_lookup(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Inner lookup in which a miss is an error, raised by the job that reads the row."""
    hit = found.withColumn("_hit", F.lit(True))
    joined = rows.join(hit, key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return joined.where(F.when(F.col("_hit").isNull(), missing.cast("boolean")).otherwise(True)).drop("_hit")


def annotated(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``found`` where it has the key; on a clash of names the found value wins."""
    other = [c for c in found.columns if c != key]
    f = found.select(key, *(F.col(c).alias(f"_{c}") for c in other), F.lit(True).alias("_hit"))
    j = rows.join(f, key, "left")
    own = [F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in other else F.col(c) for c in rows.columns]
    return j.select(*own, *(F.col(f"_{c}").alias(c) for c in other if c not in rows.columns))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rows compared and the share that agrees, case and space apart; blanks don't count, missing ones read ``none``."""
    clean = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("none"))))
    both = rows.select(clean(a).alias("_a"), clean(b).alias("_b")).where("_a <> '' and _b <> ''")
    return both.agg(F.count("*").alias("compared"), F.round(F.avg((F.col("_a") == F.col("_b")).cast("int")), 6).alias("agreement"))


# --- ranks, candidates, repeats ------------------------------------------------------------------------


def rank_by_score(rows: DataFrame, models: list[str]) -> DataFrame:
    """Rank of each sample's models by score, best first; ties keep the order of ``models``."""
    place = F.array_position(F.array(*map(F.lit, models)), F.col("model"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("sample").orderBy(F.desc("score"), place)))


def reference_teacher(rows: DataFrame, error: str, score: str, models: list[str]) -> DataFrame:
    """The model of least finite error (name decides ties), else of the best score (order of ``models``)."""
    e = F.col(error)
    ok = e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))
    place = F.array_position(F.array(*map(F.lit, models)), F.col("model"))
    return rows.groupBy("sample").agg(F.coalesce(
        F.min(F.when(ok, F.struct(e.alias("e"), "model")))["model"],
        F.min(F.struct((-F.col(score)).alias("s"), place.alias("p"), "model"))["model"],
    ).alias("teacher"))


def top_pool(rows: DataFrame, group: str, best: str, key: str, total: int, groups: int, share: float) -> DataFrame:
    """Of each group the best: an even part of ``total`` or a share of the group, whichever is more."""
    w = Window.partitionBy(group)
    r = rows.withColumn("_rn", F.row_number().over(w.orderBy(F.desc(best), key))).withColumn("_n", F.count("*").over(w))
    wanted = F.least(F.col("_n"), F.greatest(F.lit(max(1, -(-total // groups))), F.ceil(F.col("_n") * share)))
    return r.where(F.col("_rn") <= wanted).drop("_rn", "_n")


GAPS = ("level", "mean", "trend", "step", "volatility")


def visible_gains(rows: DataFrame, sample: str, candidate: str, default: str, forecast: str, recent: str) -> DataFrame:
    """Five gaps of each candidate to the recent history, and its gains over the default candidate's.

    Where a sample lacks its default the first candidate stands in.
    """
    r = rows.withColumns({"_x": arrays.stats(F.col(forecast)), "_v": arrays.stats(F.col(recent))})
    x, v = (lambda k: F.col(f"_x.{k}")), (lambda k: F.col(f"_v.{k}"))
    gaps = {
        "level": F.abs(x("start") - v("end")), "mean": F.abs(x("mean") - v("mean")), "trend": F.abs(x("net") - v("net")),
        "step": F.abs(x("step") - v("step")), "volatility": F.abs(x("sd") - v("sd")),
    }
    r = r.withColumns({f"{k}_gap": c for k, c in gaps.items()})
    r = r.withColumn("_match", arrays.direction(F.col("_x.net")) == arrays.direction(F.col("_v.net")))
    w = Window.partitionBy(sample)
    order = F.struct((F.col(candidate) != F.col(default)).alias("other"), F.col(candidate).alias("id"))
    base = lambda c: F.min_by(c, order).over(w)
    out = {f"{k}_gain": base(F.col(f"{k}_gap")) - F.col(f"{k}_gap") for k in GAPS}
    out["direction_gain"] = F.col("_match").cast("int") - base(F.col("_match").cast("int"))
    return r.withColumns(out).drop("_x", "_v", "_match")


def repeated_where(rows: DataFrame, condition: Column, times: int) -> DataFrame:
    """Rows with the condition ``times`` times, others once; ``copy`` counts from 0."""
    n = F.when(F.coalesce(condition, F.lit(False)), times).otherwise(1)
    kept_columns = [c for c in rows.columns if c != "copy"]
    return copies(rows.withColumn("_times", n).select(*kept_columns, "_times"), F.col("_times")).drop("_times")


def distinct_candidates(candidates: Column) -> Column:
    """Candidates (ops, values) without those equal to an earlier one in ops and values to six places."""
    rounded = F.transform(candidates, lambda c: F.struct(c["ops"].alias("o"), F.transform(c["values"], lambda v: F.round(v, 6)).alias("v")))
    return arrays.let(rounded, lambda r: F.filter(candidates, lambda c, i: F.array_position(r, F.element_at(r, i + 1)) == i + 1))


def keep_share_selection(labelled: DataFrame, default: str, models: list[str], total: int, keep_share: float) -> DataFrame:
    """``total`` rows of which ``keep_share`` are keeps, with one override of each class at least; leftovers by index fill up."""
    keeps, overrides = (labelled.where(F.col("bucket") == b) for b in ("keep", "override"))
    n = overrides.agg(F.count("*").alias("n"), F.count_distinct("best").alias("k")).first()
    wanted = min(n["n"], max(n["k"], round(total * max(0.0, 1.0 - keep_share))))
    chosen = quota(overrides, "best", "improvement_rel", "sample", wanted, [m for m in models if m != default])
    chosen = kept(chosen.unionByName(keep_selection(keeps, default, max(total - wanted, 0))))
    missing = total - chosen.count()
    if missing > 0:
        rest = labelled.join(chosen.select("sample"), "sample", "left_anti")
        chosen = chosen.unionByName(rest.orderBy("sample").limit(missing))
    return chosen
