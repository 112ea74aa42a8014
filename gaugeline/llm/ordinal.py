"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades run from 0 (worst) to ``GRADES - 1``.  All grades share one weight vector
over hashed words; ordered thresholds turn a text's score s into
P(grade > k) = sigmoid(s - threshold k).  The expected grade is the sum of those
tails, and the last tail is the probability of the top grade; both select.

The model is fitted on every labelled document but one in ``HELD``, and all of those
set the selection bound.  Tasks add up loss and slopes, in whole units, so that any order of rows gives
the same sums; the driver holds one vector of parameters and takes quasi-Newton steps
until the loss settles.  A bounded first part of the rows (``fit_rows``, ``FIT_WORDS``)
only sets where the search begins.  Every document is scored on all its words.

A text's features are its distinct words, lower-cased, at weight one over the
fourth root of their number (one word of an insult still tells in a long text),
and apart from that the share of words in each of a few shapes.

Defined results: a null or wordless text has no features and takes the
intercept's score; ties at the selection bound are kept; documents that occur
twice are scored twice; an empty table gives an empty table; other columns play no
part, whatever their names.  Any ``toxic`` above 0 makes grade 0; ``quality`` below 0
counts as 0 and above ``GRADES - 2`` as that.  Labels with a null or without a document
are left out; several labels of one document count as its worst; of
several texts under one id the one with the least features in byte order is fitted.
Without a labelled document there is nothing to fit: the start's parameters score and the bound
is 0, so every document is kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memory, drop_tables, map_texts, materialize, utf8

GRADES = 3
BUCKETS = 1 << 18
#: Rows that set the start of the search, and their hashed words together at most (4 bytes each): rows come
#: whole, in the order of their ids' hashes, until the next one would pass it.  It bounds what reaches the driver.
FIT_ROWS, FIT_WORDS = 12288, 16 << 20
RIDGE = 1e-4
#: Passes over all rows at most, and the share by which a step must lower the loss to go on.
PASSES, SETTLED = 60, 1e-4
#: Steps that a quasi-Newton direction remembers.
STEPS = 10
#: Units of a sum: multiples of 1 / UNIT add up exactly in doubles up to 2**53 of them.
UNIT = 2.0**22
#: Words that a task adds up at a time, and buckets of one block, in which sums travel.
SUMMED, BLOCK = 1 << 20, 1 << 13
#: Counts that a pass over values takes to the driver.
CELLS = 1024
#: Share of the top-grade documents, held out of the fit, that selection may lose.
LOSS = 0.01
#: One row in so many, by a hash of its id, sets the selection bound and is not fitted.
HELD = 8
SHAPES = 6
_STRIP = b".,;:!?\"'()[]"
_MARKS = re.compile(rb"[#*$%&|<>]")


def grade(quality: int, toxic: int) -> int:
    """0: toxic, 1: poor, 2: good."""
    return 0 if toxic > 0 else 1 + min(max(int(quality), 0), GRADES - 2)


def weight(n: int) -> float:
    """Of each of a text's ``n`` distinct words."""
    return max(1, n) ** -0.25


def bucket(word: bytes) -> int:
    return zlib.crc32(word.strip(_STRIP) or word) % BUCKETS


def shapes(words: list[bytes], data: bytes) -> np.ndarray:
    """Shares of a text in six shapes: symbols, shouting, repeats, digits, length, bias."""
    n = len(words)
    if not n:
        return np.array([0, 0, 0, 0, 0, 1.0])
    a = np.frombuffer(data, np.uint8)
    upper, lower = ((a >= 65) & (a <= 90)).sum(), ((a >= 97) & (a <= 122)).sum()
    return np.array([
        min(1.0, len(_MARKS.findall(data)) / n), upper / max(1, upper + lower), 1 - len(set(words)) / n,
        ((a >= 48) & (a <= 57)).mean(), min(1.0, n / 1000), 1.0,
    ])


def features(text: str | None) -> tuple[list[int], np.ndarray]:
    data = utf8(text)
    words = data.split()
    return sorted({bucket(w) for w in set(data.lower().split())}), shapes(words, data)


def fit(rows: list, grades: list[int], steps: int = 250, ridge: float = RIDGE, rate: float = 0.5) -> np.ndarray:
    """Weights, shape weights and ordered thresholds by full-batch steps with momentum.

    A row is (word ids, shapes).  Without rows these are the start's.
    """
    if not rows:
        return start()
    y, n = np.array(grades), len(rows)
    lengths = [len(b) for b, _ in rows]
    of, words = np.repeat(np.arange(n), lengths), np.concatenate([np.asarray(b, np.int64) for b, _ in rows])
    x = np.repeat([weight(k) for k in lengths], lengths)
    dense = np.array([s for _, s in rows])
    p = start()
    speed = np.zeros_like(p)
    for _ in range(steps):
        # One step length for all words: a rare word moves as little as its evidence.
        speed = 0.95 * speed - rate * gradient(p, y, of, words, x, dense, ridge)
        p = p + speed
        p[-(GRADES - 2):] = np.clip(p[-(GRADES - 2):], -4, 4)  # gaps neither vanish nor run away
    return p


def start() -> np.ndarray:
    """Parameters before the first step: weights, shape weights, first threshold, log gaps."""
    p = np.zeros(BUCKETS + SHAPES + GRADES - 1)
    p[-(GRADES - 1):] = [-1.0] + [0.5] * (GRADES - 2)
    return p


def _masses(p, y, of, words, x, dense):
    """Scores' tails padded with P = 1 and P = 0, and each row's probability of its own grade."""
    n = len(y)
    score = np.bincount(of, x * p[words], n) + (dense * p[BUCKETS:BUCKETS + SHAPES]).sum(1)
    tails = 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds(p), -30, 30)))  # P(grade > k)
    full = np.hstack([np.ones((n, 1)), tails, np.zeros((n, 1))])
    each = np.arange(n)
    return full, np.maximum(full[each, y] - full[each, y + 1], 1e-12)


def loss(p, y, of, words, x, dense, ridge: float) -> float:
    """Mean negative log-likelihood plus the ridge on word weights."""
    return float(-np.log(_masses(p, y, of, words, x, dense)[1]).mean() + ridge / 2 * (p[:BUCKETS] ** 2).sum())


def _slopes(p, y, of, words, x, dense):
    """Each row's negative log-likelihood, and its slopes by the thresholds below and above its grade."""
    each = np.arange(len(y))
    full, mass = _masses(p, y, of, words, x, dense)
    slope = full * (1 - full)  # zero in both padding columns
    return -np.log(mass), slope[each, y] / mass, slope[each, y + 1] / mass


def gradient(p, y, of, words, x, dense, ridge: float) -> np.ndarray:
    """Of ``loss``, by every parameter."""
    n = len(y)
    _, up, down = _slopes(p, y, of, words, x, dense)
    by_score = (down - up) / n
    g = np.empty_like(p)
    g[:BUCKETS] = np.bincount(words, x * by_score[of], BUCKETS) + ridge * p[:BUCKETS]
    g[BUCKETS:BUCKETS + SHAPES] = dense.T @ by_score
    by_threshold = np.zeros(GRADES + 1)
    np.add.at(by_threshold, y, up / n)
    np.add.at(by_threshold, y + 1, -down / n)
    g[-(GRADES - 1):] = _by_gaps(p, by_threshold)
    return g


def _by_gaps(p, by_threshold) -> list[float]:
    """Slopes by the first threshold and the log gaps; a gap moves every threshold after it."""
    sums = np.cumsum(by_threshold[GRADES - 1:0:-1])[::-1]
    return [sums[0], *(sums[1:] * np.exp(p[-(GRADES - 2):]))]


def sums(p, y, of, words, x, dense) -> np.ndarray:
    """Slopes by words, shapes and padded thresholds, loss and rows, each row's share in whole units."""
    cost, up, down = _slopes(p, y, of, words, x, dense)
    by_score = down - up
    by_threshold = np.zeros(GRADES + 1)
    np.add.at(by_threshold, y, np.rint(up * UNIT))
    np.add.at(by_threshold, y + 1, -np.rint(down * UNIT))
    return np.concatenate([
        np.bincount(words, np.rint(x * by_score[of] * UNIT), BUCKETS), np.rint(dense * by_score[:, None] * UNIT).sum(0),
        by_threshold, [np.rint(cost * UNIT).sum(), len(y)],
    ])


def thresholds(p: np.ndarray) -> np.ndarray:
    """Ordered by construction: the first one, then positive gaps."""
    first, *gaps = p[-(GRADES - 1):]
    return first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def tails_of(row: tuple[list[int], np.ndarray], p: np.ndarray) -> np.ndarray:
    """P(grade > k) of one text for each k."""
    ids, shape = row
    s = p[ids].sum() * weight(len(ids)) + shape @ p[BUCKETS:BUCKETS + SHAPES]
    return 1 / (1 + np.exp(-np.clip(s - thresholds(p), -30, 30)))


def bound(rows: list, grades: list[int], p: np.ndarray, lost: float = LOSS) -> float:
    """Top-grade probability that all but ``lost`` of the top-grade rows reach."""
    top = sorted(tails_of(r, p)[-1] for r, g in zip(rows, grades) if g == GRADES - 1)
    return between(len(top), top.__getitem__, lost)


def between(n: int, at: Callable[[int], float], lost: float = LOSS) -> float:
    """The quantile at place ``lost * (n + 1)`` among ``n`` ascending values, between neighbours in proportion.

    ``at`` gives the value at a place from 0.  One half ("likelier than not") is the place
    before the first, so that few rows move the bound only as far as they count.
    """
    place = lost * (n + 1)
    k = int(place)
    low, high = at(k - 1) if k else 0.5, at(k) if k < n else 1.0
    return float(low + (place - k) * (high - low))


def value_at(values: DataFrame, place: int) -> float:
    """The value at a place, from 0, of the ascending column ``v``: counts of ever narrower ranges, ``CELLS`` at a time."""
    low, high = values.agg(F.min("v"), F.max("v")).first()
    while low < high:
        cell = F.least(F.floor((F.col("v") - low) / (high - low) * CELLS), F.lit(CELLS - 1))
        inside = values.where(F.col("v").between(low, high)).groupBy(cell.alias("cell"))
        for _, n, low, high in sorted(inside.agg(F.count("*"), F.min("v"), F.max("v")).collect()):
            if place < n:
                break
            place -= n
    return low


# --- all labelled rows ----------------------------------------------------------------------


def described(docs: DataFrame, columns: list[str], schema: str) -> DataFrame:
    """``columns`` with ``words`` (hashed, 4 bytes each, ascending) and ``shapes`` of every document."""

    def make():
        memory = _memory()

        def apply(texts, *rest):
            data = list(map(utf8, texts))
            lowered = [list(set(d.lower().split())) for d in data]
            known = memory.look_up(lowered)
            words = [np.unique(np.fromiter(map(known, low), "<u4", len(low))).tobytes() for low in lowered]
            return [*rest, words, [shapes(d.split(), d).tobytes() for d in data]]

        return apply

    return map_texts(docs, ["text", *columns], make, schema + ", words binary, shapes binary")


def labelled(made: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, mark, held, words, shapes, grade`` of every labelled document of ``described`` ones, written."""
    rated = (
        labels.where("doc_id is not null and quality is not null and toxic is not null")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    )
    good = F.least(F.greatest(F.col("quality"), F.lit(0)), F.lit(GRADES - 2)) + 1
    graded = rated.select("doc_id", F.when(F.col("toxic") > 0, 0).otherwise(good).cast("int").alias("grade"))
    found = made.join(graded, "doc_id").groupBy("doc_id").agg(F.min(F.struct("words", "shapes", "grade")).alias("row"))
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(HELD)) == HELD - 1
    return materialize(found.select("doc_id", F.xxhash64("doc_id").alias("mark"), held.alias("held"), "row.*"), "ordinal-rows")


def first_rows(fitted: DataFrame, fit_rows: int) -> tuple[list, list[int]]:
    """At most ``fit_rows`` rows of ``FIT_WORDS`` words together, in the order of their ids' hashes, and their grades."""
    sizes = fitted.select("mark", "doc_id", (F.length("words") / 4).alias("size")).orderBy("mark", "doc_id").limit(fit_rows)
    before = F.sum("size").over(Window.orderBy("mark", "doc_id"))
    few = sizes.withColumn("sum", before).where(F.col("sum") <= FIT_WORDS).select("doc_id")
    rows = fitted.join(F.broadcast(few), "doc_id").orderBy("mark", "doc_id").select("words", "shapes", "grade").collect()
    return [(np.frombuffer(r[0], "<u4"), np.frombuffer(r[1])) for r in rows], [r[2] for r in rows]


def summed(fitted: DataFrame, p: np.ndarray) -> np.ndarray:
    """``sums`` over all rows; tasks that each own some blocks add them up."""
    shared = fitted.sparkSession.sparkContext.broadcast(p.astype("<f8").tobytes())  # BUCKETS weights, whatever the input

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, total, held, size = np.frombuffer(shared.value, "<f8"), None, [], 0

        def part():
            words, dense, y = zip(*held)
            lengths = np.array(list(map(len, words))) // 4
            return sums(
                p, np.array(y), np.repeat(np.arange(len(y)), lengths), np.frombuffer(b"".join(words), "<u4").astype(np.int64),
                np.repeat(np.maximum(1, lengths) ** -0.25, lengths), np.frombuffer(b"".join(dense)).reshape(-1, SHAPES),
            )

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            size += sum(len(w) for w in batch.column(0).to_pylist()) // 4
            if size >= SUMMED:
                total, held, size = part() + (0 if total is None else total), [], 0
        if held:
            total = part() + (0 if total is None else total)
        pack = zstandard.ZstdCompressor(level=1).compress
        for i in range(0, 0 if total is None else len(total), BLOCK):
            if (block := total[i:i + BLOCK]).any():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([pack(block.tobytes())], pa.binary())], ["at", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, total = zstandard.ZstdDecompressor().decompress, {}
        for batch in batches:
            for at, packed in zip(*(c.to_pylist() for c in batch.columns)):
                total[at] = np.frombuffer(unpack(packed)) + total.get(at, 0)
        for at, block in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([block.tobytes()], pa.binary())], ["at", "sums"])

    sent = fitted.select("words", "shapes", "grade").mapInArrow(add, "at long, sums binary")
    out = np.zeros(BUCKETS + SHAPES + GRADES + 3)
    for at, block in sent.repartition("at").mapInArrow(merge, "at long, sums binary").collect():  # one vector in all
        out[at:at + len(block) // 8] = np.frombuffer(block)
    shared.destroy()
    return out


def whole_loss(fitted: DataFrame, p: np.ndarray, ridge: float = RIDGE) -> tuple[float, np.ndarray]:
    """``loss`` and ``gradient`` over all rows."""
    total = summed(fitted, p)
    n, (words, dense, by_threshold) = total[-1], np.split(total[:-2] / UNIT, [BUCKETS, BUCKETS + SHAPES])
    g = np.concatenate([words / n + ridge * p[:BUCKETS], dense / n, _by_gaps(p, by_threshold / n)])
    return float(total[-2] / UNIT / n + ridge / 2 * (p[:BUCKETS] ** 2).sum()), g


def settle(evaluate: Callable, p: np.ndarray, passes: int = PASSES, settled: float = SETTLED) -> np.ndarray:
    """Parameters of the least loss by limited-memory quasi-Newton steps from ``p``; ``evaluate`` gives loss and gradient."""
    (value, g), known, passes = evaluate(p), [], passes - 1
    while passes > 0:
        d, shares = -g, []
        for s, y in reversed(known):
            shares.append((s @ d) / (s @ y))
            d = d - shares[-1] * y
        if known:
            s, y = known[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), share in zip(known, reversed(shares)):
            d = d + (share - (y @ d) / (s @ y)) * s
        step, lower = 1.0, False
        while passes > 0 and not lower:
            q = p + step * d
            q[-(GRADES - 2):] = np.clip(q[-(GRADES - 2):], -4, 4)  # gaps neither vanish nor run away
            (after, slope), passes = evaluate(q), passes - 1
            lower = after <= value + 1e-4 * step * (g @ d)
            step /= 4
            if step < 1e-4:
                break
        if after >= value:
            break
        if (q - p) @ (slope - g) > 1e-12:
            known = [*known, (q - p, slope - g)][-STEPS:]
        done = value - after <= settled * abs(value)
        p, g, value = q, slope, after
        if done:
            break
    return p


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, made: DataFrame | None = None) -> tuple[np.ndarray, float]:
    """Parameters and selection bound from all labelled documents; ``made`` are the documents ``described``, if they are already.

    One row in ``HELD`` sets the bound and the others are fitted.  ``fit_rows`` of them at
    most set the start.
    """
    rows = labelled(described(docs, ["doc_id"], "doc_id long") if made is None else made, labels)
    if rows.isEmpty():
        drop_tables(docs.sparkSession, rows)
        return start(), 0.0
    fitted = rows.where("not held")
    p = start()
    if not fitted.isEmpty():
        p = settle(lambda q: whole_loss(fitted, q), fit(*first_rows(fitted, fit_rows)))

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(*(c.to_pylist() for c in batch.columns))
            v = [float(tails_of((np.frombuffer(w, "<u4"), np.frombuffer(s)), p)[-1]) for w, s in both]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.float64())], ["v"])

    good = rows.where(F.col("held") & (F.col("grade") == GRADES - 1)).select("words", "shapes")
    values = materialize(good.mapInArrow(top, "v double"), "ordinal-held")
    least = between(values.count(), lambda place: value_at(values, place))
    drop_tables(docs.sparkSession, rows, values)
    return p, least


@lru_cache(maxsize=1)
def _memory() -> Memory:
    """Of each word: its bucket; shared by the tasks of a worker process."""
    return Memory(lambda words: [bucket(w) for w in words], 400_000)


def score(docs: DataFrame, columns: list[str], schema: str, p: np.ndarray, least: float) -> DataFrame:
    """``columns`` with expected grade, tail probabilities and ``kept``; no shuffle.

    A document is kept if it is likelier than not above grade 0 and its probability
    of the top grade is at least ``least``.
    """
    return score_described(described(docs, columns, schema), columns, schema, p, least)


def score_described(made: DataFrame, columns: list[str], schema: str, p: np.ndarray, least: float) -> DataFrame:
    """``score`` of documents that are ``described`` already."""
    packed = p.astype("<f8").tobytes()
    shared = made.sparkSession.sparkContext.broadcast(packed)  # BUCKETS weights, whatever the input

    def make():
        p = np.frombuffer(shared.value, "<f8")

        def apply(words, dense, *rest):
            tails = np.empty((len(words), GRADES - 1))
            for i, (w, s) in enumerate(zip(words, dense)):
                tails[i] = tails_of((np.frombuffer(w, "<u4"), np.frombuffer(s)), p)
            kept = (tails[:, 0] > 0.5) & (tails[:, -1] >= least)
            return [*rest, tails.sum(1).tolist(), tails[:, 0].tolist(), tails[:, -1].tolist(), kept.tolist()]

        return apply

    extra = ", expected_grade double, p_above_0 double, p_top double, kept boolean"
    return map_texts(made, ["words", "shapes", *columns], make, schema + extra)
