"""Math over ``array<double>`` columns: statistics, smoothing, turning points, repetition, edits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(c: Column, f) -> Column:
    """``f`` of a column that is computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def at(xs: Column, i: Column) -> Column:
    """Element by a zero-based position."""
    return F.element_at(xs, (i + 1).cast("int"))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def mean(xs: Column) -> Column:
    return let(xs, lambda v: F.when(F.size(v) > 0, total(v) / F.size(v)).otherwise(0.0))


def deviation(xs: Column) -> Column:
    """Population standard deviation."""
    return let(xs, lambda v: let(mean(v), lambda m: F.sqrt(mean(F.transform(v, lambda x: (x - m) * (x - m))))))


def median(xs: Column) -> Column:
    def middle(s: Column) -> Column:
        n = F.size(s)
        return F.when(n > 0, (at(s, F.floor((n - 1) / 2)) + at(s, F.floor(n / 2))) / 2).otherwise(0.0)

    return let(F.array_sort(xs), middle)


def mad(xs: Column) -> Column:
    return let(xs, lambda v: let(median(v), lambda m: median(F.transform(v, lambda x: F.abs(x - m)))))


def diffs(xs: Column) -> Column:
    rest = lambda v: F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0)))
    return let(xs, lambda v: F.transform(rest(v), lambda x, i: x - at(v, i)))


def diff_mad(xs: Column) -> Column:
    """MAD of the steps, 1e-6 at least."""
    return F.greatest(mad(diffs(xs)), F.lit(1e-6))


def sanitized(xs: Column) -> Column:
    """NaN, infinite and missing values as 0."""
    return F.transform(xs, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))


def finite(xs: Column) -> Column:
    return F.filter(xs, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def head(xs: Column, n: Column) -> Column:
    return F.slice(xs, F.lit(1), F.greatest(n.cast("int"), F.lit(0)))


def tail(xs: Column, n: Column) -> Column:
    k = lambda v: F.greatest(F.least(n.cast("int"), F.size(v)), F.lit(0))
    return let(xs, lambda v: F.slice(v, F.size(v) - k(v) + 1, k(v)))


def with_both(p: Column, t: Column, f) -> Column:
    """``f(p, t)`` of two arrays cut to the shorter one's length, each computed once; null where that is 0."""
    n = lambda v: F.least(F.size(v["p"]), F.size(v["t"]))
    cut = lambda v: F.struct(head(v["p"], n(v)).alias("p"), head(v["t"], n(v)).alias("t"))
    pair = let(F.struct(p.alias("p"), t.alias("t")), cut)
    return let(pair, lambda v: F.when(F.size(v["p"]) > 0, f(v["p"], v["t"])))


def mse(p: Column, t: Column) -> Column:
    """Over the common length; null without one."""
    return with_both(p, t, lambda a, b: mean(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def mae(p: Column, t: Column) -> Column:
    return with_both(p, t, lambda a, b: mean(F.zip_with(a, b, lambda x, y: F.abs(x - y))))


def scaled_by(xs: Column, truth: Column) -> Column:
    """Centred and scaled by the truth's mean and deviation (1e-8 at least)."""
    scale = F.struct(mean(truth).alias("m"), F.greatest(deviation(truth), F.lit(1e-8)).alias("s"))
    return let(scale, lambda k: F.transform(xs, lambda x: (x - k["m"]) / k["s"]))


def norm_mse(p: Column, t: Column) -> Column:
    scale = lambda b: F.greatest(deviation(b), F.lit(1e-8))
    return with_both(p, t, lambda a, b: mse(a, b) / F.pow(scale(b), F.lit(2.0)))


def norm_mae(p: Column, t: Column) -> Column:
    return with_both(p, t, lambda a, b: mae(a, b) / F.greatest(deviation(b), F.lit(1e-8)))


def kernel(n: Column) -> Column:
    """Odd width of the moving average for ``n`` points: half of them, 3 to 25."""
    k = F.greatest(F.least(F.lit(25), F.floor(n / 2)), F.lit(3))
    return (k + (k + 1) % 2).cast("int")


def trend(xs: Column) -> Column:
    """Centred moving average with repeated ends."""

    def smooth(v: Column) -> Column:
        n, k = F.size(v), kernel(F.size(v))
        half = F.floor(k / 2).cast("int")
        one = lambda i: F.aggregate(
            F.sequence(i - half, i + half), F.lit(0.0), lambda a, j: a + at(v, F.greatest(F.least(j, n - 1), F.lit(0)))
        ) / k
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<double>"))

    return let(xs, smooth)


def season(xs: Column) -> Column:
    return let(xs, lambda v: F.zip_with(v, trend(v), lambda x, t: x - t))


def turning_points(xs: Column, low: bool) -> Column:
    """Zero-based places not below (or not above) two neighbours on either side.

    Before the first point stand the third and the second, after the last one the last
    but one and the last; fewer than five points have none.
    """

    def turns(wide: Column):
        def test(i: Column) -> Column:
            x, others = at(wide, i + 2), [at(wide, i + k) for k in (0, 1, 3, 4)]
            each = [(x <= o) if low else (x >= o) for o in others]
            return each[0] & each[1] & each[2] & each[3]

        return test

    def find(v: Column) -> Column:
        n = F.size(v)
        wide = F.concat(F.array(at(v, F.lit(2)), at(v, F.lit(1))), v, F.array(at(v, n - 2), at(v, n - 1)))
        found = let(wide, lambda w: F.filter(F.sequence(F.lit(0), n - 1), turns(w)))
        return F.when(n >= 5, found).otherwise(F.array().cast("array<int>"))

    return let(xs, find)


def greedy_hits(points: Column, truth: Column, tolerance: int = 2) -> Column:
    """Points within ``tolerance`` of the first truth point that no earlier point took."""
    start = F.struct(F.lit(0).alias("hits"), truth.alias("free"))

    def step(state: Column, p: Column) -> Column:
        near = F.filter(state["free"], lambda t: F.abs(t - p) <= tolerance)
        taken = F.get(near, F.lit(0))
        return F.struct(
            (state["hits"] + F.when(taken.isNull(), 0).otherwise(1)).alias("hits"),
            F.when(taken.isNull(), state["free"]).otherwise(F.array_remove(state["free"], taken)).alias("free"),
        )

    return F.aggregate(points, start, step)["hits"]


def suffix_repetition(xs: Column, max_period: int = 8, min_repeats: int = 2, atol: float = 1e-8) -> Column:
    """``struct(repeats, period)`` of the suffix that repeats over the most points; 0, 0 without one."""

    def repeats(v: Column, p: int) -> Column:
        n = F.size(v)
        whole = F.floor(n / p).cast("int")
        equal = lambda j: F.forall(F.sequence(F.lit(1), F.lit(p)), lambda i: F.abs(at(v, n - i) - at(v, n - i - j * p)) <= atol)
        same = F.transform(F.sequence(F.lit(1), F.greatest(whole - 1, F.lit(1))), lambda j: F.when(j < whole, equal(j)).otherwise(False))
        count = let(F.array_position(same, F.lit(False)), lambda stop: F.when(stop == 0, whole).otherwise(stop.cast("int")))
        return F.when(whole >= min_repeats, count).otherwise(0)

    def best(v: Column) -> Column:
        found = F.array(*(F.struct(repeats(v, p).alias("repeats"), F.lit(p).alias("period")) for p in range(1, max_period + 1)))
        better = lambda b, c: (c["repeats"] >= min_repeats) & (c["repeats"] * c["period"] > b["repeats"] * F.greatest(b["period"], F.lit(1)))
        start = F.struct(F.lit(0).alias("repeats"), F.lit(0).alias("period"))
        return F.aggregate(found, start, lambda b, c: F.when(better(b, c), c).otherwise(b))

    return let(xs, best)


def tail_run(xs: Column, atol: float = 0.0) -> Column:
    """Points at the end that equal the last one."""

    def run(v: Column) -> Column:
        back = F.transform(F.reverse(v), lambda x: F.abs(x - F.element_at(v, -1)) <= atol)
        return let(F.array_position(back, F.lit(False)), lambda stop: F.when(stop == 0, F.size(v)).otherwise(stop - 1))

    return F.when(F.size(xs) == 0, 0).otherwise(let(xs, run)).cast("long")


def stats(xs: Column) -> Column:
    """``struct(start, end, mean, sd, net, step)``: step is the mean absolute one."""

    def of(v: Column) -> Column:
        ends = F.coalesce(F.get(v, F.lit(0)), F.lit(0.0)), F.coalesce(F.get(v, F.size(v) - 1), F.lit(0.0))
        return F.struct(
            ends[0].alias("start"), ends[1].alias("end"), mean(v).alias("mean"), deviation(v).alias("sd"),
            (ends[1] - ends[0]).alias("net"), mean(F.transform(diffs(v), F.abs)).alias("step"),
        )

    return let(xs, of)


def direction(net: Column, eps: float = 1e-6) -> Column:
    return F.when(net > eps, "up").when(net < -eps, "down").otherwise("flat")


def delta_summary(p: Column, t: Column, eps: float = 1e-8) -> Column:
    """``struct(changed, first, last, span, mean_abs, max_abs)`` over the places that differ."""

    def of(gap: Column) -> Column:
        moved = F.filter(F.transform(gap, lambda g, i: F.when(g > eps, i)), lambda i: i.isNotNull())
        sizes = F.filter(gap, lambda g: g > eps)
        return let(F.struct(moved.alias("m"), sizes.alias("s")), lambda v: F.struct(
            F.size(v["m"]).cast("long").alias("changed"), F.array_min(v["m"]).cast("long").alias("first"),
            F.array_max(v["m"]).cast("long").alias("last"),
            F.coalesce(F.array_max(v["m"]) - F.array_min(v["m"]) + 1, F.lit(0)).cast("long").alias("span"),
            mean(v["s"]).alias("mean_abs"), F.coalesce(F.array_max(v["s"]), F.lit(0.0)).alias("max_abs"),
        ))

    return let(with_both(p, t, lambda a, b: F.zip_with(a, b, lambda x, y: F.abs(x - y))), of)


# --- local edits of a forecast (M32, M33) -------------------------------------------------------------


def spikes(xs: Column) -> Column:
    """Inner places whose steps to both neighbours are large and go back: zero-based."""

    def find(v: Column) -> Column:
        def spike(bound: Column):
            def test(i: Column) -> Column:
                left, right = at(v, i) - at(v, i - 1), at(v, i + 1) - at(v, i)
                return (F.abs(left) > bound) & (F.abs(right) > bound) & (left * right < 0)

            return test

        inner = F.when(F.size(v) >= 3, F.sequence(F.lit(1), F.size(v) - 2)).otherwise(F.array().cast("array<int>"))
        return let(F.greatest(3 * diff_mad(v), F.lit(1e-4)), lambda bound: F.filter(inner, spike(bound)))

    return let(xs, find)


def smoothed(xs: Column) -> Column:
    """Spikes replaced from left to right by the mean of their neighbours (the left one already smoothed)."""

    def fold(v: Column) -> Column:
        def step(places: Column):
            def one(done: Column, i: Column) -> Column:
                middle = 0.5 * (F.element_at(done, -1) + at(v, i + 1))
                return F.concat(done, F.array(F.when(F.array_contains(places, i), middle).otherwise(at(v, i))))

            return one

        rest = F.when(F.size(v) > 1, F.sequence(F.lit(1), F.size(v) - 1)).otherwise(F.array().cast("array<int>"))
        return let(spikes(v), lambda places: F.aggregate(rest, head(v, F.lit(1)), step(places)))

    return let(xs, fold)


def _tails(xs: Column, history: Column) -> Column:
    return F.least(F.lit(12), F.size(xs), F.size(history))


def _gap(xs: Column, history: Column, of, scale, times: float) -> Column:
    """Half of ``of(history) - of(xs)`` over the last points where it is large for the history; null elsewhere."""
    pair = F.struct(xs.alias("x"), history.alias("h"))

    def test(v: Column) -> Column:
        w = _tails(v["x"], v["h"])
        bound = F.greatest(times * F.greatest(scale(v["h"]), F.lit(1e-4)), F.lit(1e-4))
        gap = of(tail(v["h"], w), w) - of(tail(v["x"], w), w)
        return F.when(w >= 4, let(gap, lambda g: F.when(F.abs(g) > bound, 0.5 * g)))

    return let(pair, test)


def level_gap(xs: Column, history: Column) -> Column:
    """What the last points should rise by; null where the level is fine."""
    return _gap(xs, history, lambda v, w: mean(v), mad, 1.5)


def slope_gap(xs: Column, history: Column) -> Column:
    """What each of the last points should rise by over the one before; null where the slope is fine."""
    slope = lambda v, w: let(v, lambda u: (F.element_at(u, -1) - F.element_at(u, 1)) / F.greatest(w - 1, F.lit(1)))
    return _gap(xs, history, slope, diff_mad, 2.0)


def level_adjusted(xs: Column, history: Column) -> Column:
    w, gap = _tails(xs, history), F.coalesce(level_gap(xs, history), F.lit(0.0))
    return let(gap, lambda g: F.transform(xs, lambda x, i: F.when(i >= F.size(xs) - w, x + g).otherwise(x)))


def slope_adjusted(xs: Column, history: Column) -> Column:
    w, gap = _tails(xs, history), F.coalesce(slope_gap(xs, history), F.lit(0.0))
    return let(gap, lambda g: F.transform(xs, lambda x, i: x + g * F.greatest(i - (F.size(xs) - w), F.lit(0))))


def local_edits(xs: Column, history: Column) -> Column:
    """Array of ``struct(op, values)``: the edits that apply, in their order, no two alike."""
    made = F.array(
        F.struct(F.lit("isolated_spike_smoothing").alias("op"), F.when(F.size(spikes(xs)) > 0, smoothed(xs)).alias("values")),
        F.struct(F.lit("local_level_adjust").alias("op"), F.when(level_gap(xs, history).isNotNull(), level_adjusted(xs, history)).alias("values")),
        F.struct(F.lit("local_slope_adjust").alias("op"), F.when(slope_gap(xs, history).isNotNull(), slope_adjusted(xs, history)).alias("values")),
    )
    return F.filter(made, lambda e: e["values"].isNotNull())


def edits_for(edits: Column, model: Column) -> Column:
    """Edits that a model's forecasts allow."""
    m = F.lower(F.trim(F.coalesce(model, F.lit(""))))
    level, spike = F.lit("local_level_adjust"), F.lit("isolated_spike_smoothing")
    return F.filter(edits, lambda e: ~(m.isin("arima", "itransformer") & (e["op"] == level)) & ~((m == "itransformer") & (e["op"] == spike)))


def meaningful(base: Column, edited: Column, truth: Column) -> Column:
    """Whether an edit is local and gains enough over ``base``: more than half a percent in either error, and any in MSE."""
    made = F.struct(
        delta_summary(edited, base).alias("d"), mse(base, truth).alias("m0"), mse(edited, truth).alias("m1"),
        mae(base, truth).alias("a0"), mae(edited, truth).alias("a1"), F.size(base).alias("n"),
    )

    def test(v: Column) -> Column:
        few = (v["d"]["changed"] > 0) & (v["d"]["changed"] <= F.least(F.lit(24), F.greatest(F.lit(4), F.floor(v["n"] / 4))))
        near = v["d"]["span"] <= F.least(F.lit(32), F.greatest(F.lit(8), F.floor(v["n"] / 3)))
        enough = lambda k: v[f"{k}0"] - v[f"{k}1"] > F.greatest(F.lit(1e-6), 0.005 * v[f"{k}0"])
        return few & near & (enough("m") | enough("a")) & (v["m0"] - v["m1"] > 1e-8)

    return let(made, test)
