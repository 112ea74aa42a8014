"""Nearest neighbours by largest inner product with a hash-prefix forest.

Rows are dealt into shards by a hash of their id, and every shard holds a forest:
each tree is the sorted array of one long hash string (32 random-hyperplane bits)
of every distinct vector.  A query descends each tree to its longest matching
prefixes and then ascends all trees together, one bit at a time; every step widens
the ranges of the arrays that share the prefix, and their new members are scored.

The ascent ends by one rule at every size: once a vector as near as the k-th best
found so far would have shared a prefix of this length in some tree with
probability ``SURE`` at least.  A vector at the angle a shares d bits of a tree with
probability (1 - a / pi) ** d, so that probability is known exactly.  How much of a
shard a query meets follows from the data: near neighbours end the ascent early,
and where nothing is near, or fewer than k vectors exist, it reaches the root.

Inner products become angles by one added component that fills every vector up
to the shard's largest norm (zero for queries).  Equal vectors of a shard stand in
the forest once, with their ids in order, so large groups of copies cost nothing
and lose nothing: a query returns at most ``k``.

Queries meet every shard in blocks of a bounded size; the queries are a stated
set, not all pairs.  A (shard, block) group builds its forest once and streams the
block's queries past it, so a task holds one shard and one batch of queries.

Defined results: vectors that are null, zero or hold null or non-finite components
take no part, as query or candidate; neither do rows without an id.  Shorter
vectors count as padded with zeros.  Ties go to the smaller id.  Rows of the
query's own id are not its candidates.  Repeated (id, vector) rows count once; of
other rows with equal ids the one with the best score counts, and of several query
vectors under one id the least by its components asks.  Scores are double-precision
sums; components so large that products overflow score infinite.  Other columns play
no part, whatever their names.  Empty tables give an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 32
TREES = 96
SHARD_ROWS = 32768
BLOCK_ROWS = 2048
#: Least probability that a vector as near as the k-th best found was met.
SURE = 0.9
#: Trees that ascend a bit together before the end of the ascent is tested.
GROUP = 48
#: Queries hashed together.
BATCH = 64


class Forest:
    """Sorted hash strings of one shard's distinct vectors (scaled to largest norm 1)."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, seed: int = 7):
        self.n, dim = vectors.shape
        norms = np.einsum("ij,ij->i", vectors, vectors)
        fill = np.sqrt(np.maximum(norms.max() - norms, 0.0))
        self.planes = np.random.default_rng([seed, dim]).standard_normal((trees, dim + 1, BITS))
        # All trees in one ascending array: the tree's number stands above its strings' bits.
        self.keys = np.empty(trees * self.n, np.uint64)
        self.order = np.empty(trees * self.n, np.int32)
        for t, p in enumerate(self.planes):
            codes, at = _strings(vectors @ p[:-1] + fill[:, None] * p[-1]), slice(t * self.n, (t + 1) * self.n)
            order = np.argsort(codes, kind="stable")
            self.order[at], self.keys[at] = order, codes[order] | np.uint64(t << BITS)

    def strings(self, queries: np.ndarray) -> np.ndarray:
        """Keys of the queries in every tree: [query, tree]."""
        own = [_strings(queries @ p[:-1]) | np.uint64(t << BITS) for t, p in enumerate(self.planes)]
        return np.stack(own, 1)

    def longest(self, own: np.ndarray, wanted: int) -> int:
        """Length of the longest prefixes under which all trees together hold ``wanted`` places."""
        low, high = 0, BITS
        while low < high:  # the root holds most, so search by halves
            depth = (low + high + 1) // 2
            first, last = self.bounds(own, depth)
            low, high = (depth, high) if (last - first).sum() >= wanted else (low, depth - 1)
        return low

    def bounds(self, own: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        rest = np.uint64(2 ** (BITS - depth) - 1)
        return self.keys.searchsorted(own & ~rest, "left"), self.keys.searchsorted(own | rest, "right")

    def under(self, own: np.ndarray, depth: int) -> np.ndarray:
        """Vectors that share ``depth`` bits with the keys of some trees, as often as they stand there."""
        low, high = self.bounds(own, depth)
        sizes = high - low
        starts = np.cumsum(sizes) - sizes
        return self.order[np.arange(sizes.sum()) + np.repeat(low - starts, sizes)]


def _strings(projected: np.ndarray) -> np.ndarray:
    """``BITS`` signs a row as one integer, the first bit most significant."""
    return np.packbits(projected > 0, axis=1).view(">u4").ravel().astype(np.uint64)


def met(cosine: float, depth: int, trees: int, before: int) -> float:
    """Probability that a vector at this cosine shares ``depth`` bits in one of so many
    trees, or one bit more in one of the ``before`` trees."""
    bit = 1 - np.arccos(np.clip(cosine, -1.0, 1.0)) / np.pi
    return 1 - (1 - bit**depth) ** trees * (1 - bit ** (depth + 1)) ** before


class Shard:
    """One shard's vectors, forest and ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int = TREES):
        number: dict[bytes, int] = {}
        of = np.fromiter((number.setdefault(v.tobytes(), len(number)) for v in vectors), np.int64, len(vectors))
        order = np.lexsort((ids, of))  # members of each distinct vector, by id
        self.starts = np.searchsorted(of[order], np.arange(len(number) + 1))
        self.ids, self.distinct = ids[order], vectors[order[self.starts[:-1]]]
        # Scaled by a power of two, so single precision neither overflows nor rounds more.
        self.scale = 2.0 ** -np.ceil(np.log2(np.abs(self.distinct).max()))
        scaled = self.distinct * self.scale
        self.largest = float(np.linalg.norm(scaled, axis=1).max())
        self.forest = Forest(scaled / self.largest, trees)
        self.rough = scaled.astype(np.float32)
        # Of any float32 sum of products: relative rounding of both factors and of each sum.
        self.error = (vectors.shape[1] + 4) * 2.0**-23 * self.largest + vectors.shape[1] * 2.0**-120
        self.examined = 0  # distinct vectors scored, over all queries so far

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, sure: float = SURE):
        """Best ``k`` for each query: query ids, ids and scores."""
        width = self.distinct.shape[1]
        if queries.shape[1] > width:  # further components meet only zeros
            queries = queries[:, :width]
        queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
        out = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for at in range(0, len(queries), BATCH):
            part = queries[at:at + BATCH]
            most = np.abs(part).max(1, keepdims=True)
            unit = part / np.where(most > 0, most, 1.0)
            length = np.linalg.norm(unit, axis=1, keepdims=True)
            unit = unit / np.where(length > 0, length, 1.0)
            own = self.forest.strings(unit)
            for i in range(len(part)):
                ids, scores = self._one(query_ids[at + i], part[i], unit[i], own[i], k, sure)
                for column, values in zip(out, (np.full(len(ids), query_ids[at + i]), ids, scores)):
                    column.append(values)
        return tuple(map(np.concatenate, out))

    def _ascend(self, unit, own, wanted: int, sure: float) -> tuple[np.ndarray, np.ndarray]:
        """Distinct vectors met on the way up, and their scores in single precision."""
        trees, u = len(own), unit.astype(np.float32)
        seen, scores = np.zeros(self.forest.n, bool), np.empty(0, np.float32)
        found = [np.empty(0, np.int64)]
        depth = self.forest.longest(own, trees + wanted)  # the query's own vector may stand in every tree
        while depth >= 0:
            for first in range(0, trees, GROUP):
                group = own[first:first + GROUP]
                new = np.zeros(self.forest.n, bool)
                new[self.forest.under(group, depth)] = True
                new = np.flatnonzero(new & ~seen)
                if len(new):
                    seen[new] = True
                    found.append(new)
                    scores = np.concatenate([scores, self.rough[new] @ u])
                if len(scores) == self.forest.n:
                    return np.concatenate(found), scores
                if len(scores) >= wanted:
                    least = np.partition(scores, len(scores) - wanted)[len(scores) - wanted]
                    done = first + len(group)
                    if met(least / self.largest, depth, done, trees - done) >= sure:
                        return np.concatenate(found), scores
            depth -= 1
        raise AssertionError("the root holds every vector")

    def _one(self, own_id, query, unit, own, k, sure):
        wanted = min(k + 1, self.forest.n)  # one may be the query itself
        found, scores = self._ascend(unit, own, wanted, sure)
        self.examined += len(found)
        if len(found) > wanted:  # leaves out only what the rounding bound shows to be worse
            least = np.partition(scores, len(scores) - wanted)[len(scores) - wanted]
            found = found[scores >= least - 2 * self.error]
        with np.errstate(over="ignore", invalid="ignore"):
            scores = (self.distinct[found] * query).sum(1)
        members = [np.unique(self.ids[self.starts[f]:self.starts[f + 1]])[: k + 1] for f in found]
        ids, scores = np.concatenate(members), np.repeat(scores, list(map(len, members)))
        keep = ids != own_id
        ids, scores = ids[keep], scores[keep]
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best]


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select("vec_id", vector.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0)
    )


def _matrix(lists: list[list[float]]) -> np.ndarray:
    out = np.zeros((len(lists), max(map(len, lists), default=1)))
    for row, values in zip(out, lists):
        row[: len(values)] = values
    return out


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def nearest(
    rows: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for every query.

    ``rows`` and ``queries`` have vec_id and embedding.
    """
    rows = usable(rows)
    queries = usable(queries).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    shards = max(1, ceil(rows.count() / shard_rows))
    blocks = max(1, ceil(queries.count() / block_rows))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = rows.select(dealt(shards).alias("shard"), every(blocks).alias("block"), F.lit(0).alias("kind"), "vec_id", "vector")
    right = queries.select(every(shards).alias("shard"), dealt(blocks).alias("block"), F.lit(1).alias("kind"), "vec_id", "vector")
    keys = ["shard", "block"]
    both = left.union(right).repartition(parts, *keys).sortWithinPartitions(*keys, "kind", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, vectors, shard = None, [], [], None
        for batch in batches:
            asked_ids, asked, found = [], [], []

            def answer():
                nonlocal shard, vectors
                if asked and ids:
                    if shard is None:
                        shard, vectors = Shard(np.array(ids, np.int64), _matrix(vectors)), []
                    found.append(shard.search(np.array(asked_ids, np.int64), _matrix(asked), k))
                asked_ids.clear()
                asked.clear()

            for s, b, kind, vec_id, vector in zip(*(c.to_pylist() for c in batch.columns)):
                if (s, b) != group:
                    answer()
                    group, ids, vectors, shard = (s, b), [], [], None
                if kind:
                    asked_ids.append(vec_id)
                    asked.append(vector)
                else:
                    ids.append(vec_id)
                    vectors.append(vector)
            answer()
            for columns in found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND)], schema=FOUND)

    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
