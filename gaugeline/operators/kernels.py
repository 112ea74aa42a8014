"""Numeric kernels on ``array<double>`` columns: vectorised numpy behind Arrow batches.

Spectrum, change points and peaks have no built-in counterpart; everything else is
in ``functions.arrays``.  Kernels take one array and return one struct; arrays of
other than finite values are sanitised first (missing and infinite values count as 0).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType


def kernel(names: tuple[str, ...], compute: Callable[[np.ndarray], tuple]) -> Callable[[Column], Column]:
    """A function of an array column that returns a struct of doubles."""
    schema = StructType([StructField(n, DoubleType()) for n in names])

    def apply(xs: Column) -> Column:
        @F.pandas_udf(schema)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for arrays in batches:
                rows = [compute(np.nan_to_num(np.asarray([] if a is None else a, float), posinf=0, neginf=0)) for a in arrays]
                yield pd.DataFrame(rows, columns=list(names), dtype=float)

        return run(xs)

    return apply


def _spectrum(x: np.ndarray) -> tuple[float, float]:
    n = len(x)
    power = np.abs(np.fft.rfft(x)[: n // 2]) ** 2 if n > 1 else np.zeros(0)
    if not len(power) or not power.sum():
        return 0.0, 0.0
    share = power[power > 0] / power.sum()
    return float(power.argmax() / n), float(-(share * np.log2(share)).sum()) if len(share) > 1 else 0.0


#: Frequency of the strongest bin (the mean included) and spectral entropy in bits.
spectrum = kernel(("peak_freq", "spec_entropy"), _spectrum)


#: Places at which segments may end are multiples of this.
JUMP = 5


def breakpoints(x: np.ndarray, penalty: float = 5.0, least: int = 2, jump: int = JUMP) -> list[int]:
    """Ends of the segments of the penalised optimum: kernel costs with a Gaussian kernel.

    A segment costs its length minus the mean similarity within it; the kernel's width is
    the median squared distance.  Optimal partitioning over multiples of ``jump``, with the
    pruning of segments that can't win any more.
    """
    n = len(x)
    distance = (x[:, None] - x[None, :]) ** 2
    inner = distance[np.triu_indices(n, 1)]
    width = np.median(inner) if n > 1 else 0.0
    gamma = 1.0 / width if width > 0 else 1.0
    gram = np.exp(-np.clip(gamma * distance, 1e-2, 1e2))
    sums = np.zeros((n + 1, n + 1))
    sums[1:, 1:] = gram.cumsum(0).cumsum(1)
    diagonal = np.concatenate([[0.0], np.diag(gram).cumsum()])

    def cost(a: int, b: int) -> float:
        return diagonal[b] - diagonal[a] - (sums[b, b] - sums[a, b] - sums[b, a] + sums[a, a]) / (b - a)

    ends = [e for e in range(0, n, jump) if e >= least] + [n]
    best, before, open_ = {0: 0.0}, {}, [0]
    for end in ends:
        options = [(best[a] + cost(a, end) + penalty, a) for a in open_ if end - a >= least and a in best]
        if not options:
            continue
        best[end], before[end] = min(options)
        open_ = [a for value, a in options if value <= best[end] + penalty] + [a for a in open_ if end - a < least] + [end]
    out, at = [], n
    while at:
        out.append(at)
        at = before[at]
    return out[::-1]


@F.pandas_udf(ArrayType(LongType()))
def break_places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Where new segments start in each array; none in arrays of fewer than ten points."""
    for arrays in batches:
        found = []
        for a in arrays:
            x = np.nan_to_num(np.asarray([] if a is None else a, float), posinf=0, neginf=0)
            found.append([int(p) for p in breakpoints(x)[:-1]] if len(x) >= 10 else [])
        yield pd.Series(found)


def _change_points(x: np.ndarray) -> tuple[float, float]:
    if len(x) < 10:
        return 0.0, 0.0
    ends = breakpoints(x)
    means = [part.mean() for part in np.split(x, ends[:-1])]
    jumps = np.abs(np.diff(means))
    return float(min(len(ends) - 1, 5)), float(jumps.max()) if len(jumps) else 0.0


#: Change points (five at most are counted) and the largest jump between segment means.
change_points = kernel(("changepoint_count", "changepoint_score"), _change_points)


def peaks(x: np.ndarray, prominence: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Places of local maxima (middle of a plateau) that stand out by ``prominence``, and their widths at half of it."""
    places, widths, i, n = [], [], 1, len(x)
    while i < n - 1:
        if x[i] <= x[i - 1]:
            i += 1
            continue
        j = i
        while j < n - 1 and x[j + 1] == x[i]:
            j += 1
        if j < n - 1 and x[j + 1] < x[i]:
            p = (i + j) // 2
            higher = np.flatnonzero(x > x[p])
            left, right = higher[higher < p], higher[higher > p]
            a, b = (left[-1] + 1 if len(left) else 0), (right[0] if len(right) else n)
            low_a, low_b = x[a:p + 1], x[p:b]
            stands = x[p] - max(low_a.min(), low_b.min())
            if stands >= prominence:
                level = x[p] - stands / 2
                # The walk to either side stops at the peak's bases: the lowest points nearest to it.
                base_a = a + len(low_a) - 1 - int(low_a[::-1].argmin())
                base_b = p + int(low_b.argmin())
                s, e = p, p
                while s > base_a and x[s] > level:
                    s -= 1
                while e < base_b and x[e] > level:
                    e += 1
                start = s + (level - x[s]) / (x[s + 1] - x[s]) if x[s] < level else float(s)
                end = e - (level - x[e]) / (x[e - 1] - x[e]) if x[e] < level else float(e)
                places.append(p)
                widths.append(end - start)
        i = j + 1
    return np.array(places, int), np.array(widths)


def _peak_shape(x: np.ndarray) -> tuple[float, float, float]:
    if len(x) < 3:
        return 0.0, 0.0, 0.0
    places, widths = peaks((x - x.mean()) / (x.std() + 1e-8))
    gaps = np.diff(places)
    return float(len(places)), float(widths.max()) if len(widths) else 0.0, float(gaps.std() / (gaps.mean() + 1e-8)) if len(gaps) else 0.0


#: Peaks of the standardised series: number, largest width, and variation of their spacing.
peak_shape = kernel(("peak_count", "peak_max_width", "peak_spacing_cv"), _peak_shape)


def _residuals(x: np.ndarray) -> tuple[float, float, float, float, float]:
    if len(x) <= 3:
        return 0.0, 0.0, 0.0, 0.0, 0.0
    past, now = x[:-1], x[1:]
    spread = past - past.mean()
    slope = float(spread @ (now - now.mean())) / float(spread @ spread) if spread @ spread > 0 else 0.0
    r = now - (now.mean() + slope * spread)
    centred, size = r - r.mean(), np.sort(np.abs(r))
    total = centred @ centred
    return (
        float(r.mean()), float(size[-1]), float((np.abs(r) > 2 * (r.std() + 1e-8)).mean()),
        float(centred[1:] @ centred[:-1] / total) if total > 0 else 0.0, float(size[int(0.9 * len(r)):].sum() / (size.sum() + 1e-8)),
    )


#: Residuals of a first-order autoregression: mean, largest, share beyond two deviations, lag-1 correlation, share of the top tenth.
residuals = kernel(("residual_mean", "residual_max", "residual_exceed", "residual_acf1", "residual_concentration"), _residuals)


def segments(x: np.ndarray) -> list[np.ndarray]:
    """Stretches between large changes of the step, ends shared; eight at most, thirds where fewer than three."""
    n = len(x)
    if n < 4:
        return [x]
    d = np.diff(x)
    cuts = [0, *(np.flatnonzero(np.abs(np.diff(d)) > 1.5 * d.std() + 1e-6) + 1).tolist(), n - 1]
    parts = [x[a:b + 1] for a, b in zip(cuts, cuts[1:])][:8]
    return parts if len(parts) >= 3 else [x[: n // 3], x[n // 3:2 * (n // 3)], x[2 * (n // 3):]]


def _events(x: np.ndarray) -> tuple[float, ...]:
    if not len(x):
        return 0.0, 0.0, 0.0, 0.0, 0.0, 0.0
    bound, parts, counts = 0.05 * x.std() + 1e-6, segments(x), [0, 0, 0, 0]
    for p in parts:
        if len(p) >= 2:
            net = p[-1] - p[0]
            counts[0 if net > bound else 1 if net < -bound else 3 if p.std() > 2 * bound else 2] += 1
    return float(len(parts)), *map(float, counts), float(int(np.argmax(counts)))


#: Segments, how many rise, fall, stay flat or oscillate, and which kind leads (0 to 3, in that order).
events = kernel(("segments", "rise", "fall", "flat", "oscillation", "dominant"), _events)


def autoregression(x: np.ndarray, horizon: int) -> np.ndarray:
    """Forecast by least squares on lags; the last value where the series is short or still."""
    if len(x) < 12 or x.std() < 1e-6:
        return np.full(horizon, x[-1] if len(x) else 0.0)
    p = max(1, min(24, len(x) // 8))
    lags = np.stack([x[p - k - 1:len(x) - k - 1] for k in range(p)], 1)
    weights, *_ = np.linalg.lstsq(np.hstack([np.ones((len(lags), 1)), lags]), x[p:], rcond=None)
    out = list(x)
    for _ in range(horizon):
        out.append(float(weights[0] + weights[1:] @ np.array(out[-1:-p - 1:-1])))
    return np.array(out[len(x):])
