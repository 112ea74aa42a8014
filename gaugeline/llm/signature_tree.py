"""Exact n-gram Jaccard join by signature trees, and its connected components.

Two sets that link (Jaccard 0.75 or more) share one of the first ``n - ceil(0.75 n)
+ 1`` elements of either, in any order common to all sets.  The order here puts
frequent shingles last, then goes by hash.  Documents with an equal set are one
from the start.  Prefix elements that two sets share make buckets; buckets with
the same members are one bucket.

A bucket is searched by a signature tree: leaves are sets with a hashed token
bitmap, inner nodes hold the OR and the AND of the bitmaps below and the range of
set sizes.  A dual traversal pairs nodes and drops a pair when even the largest
possible overlap, |a| minus the bits that all of a's sets have and none of b's,
is too small for the sizes.  Surviving leaf pairs are checked on the exact sets.

Two rounds keep close families from yielding all their pairs: in the first, every
set proposes one partner among its neighbours in the tree's order; what links is
merged.  The second searches every bucket, skips nodes of one component, and proposes
every surviving pair in the first bucket that both sets are in; after it no link
between components is left untested.  Buckets beyond ``BLOCK`` sets are cut into
blocks that are searched pairwise, so tasks stay bounded; in the second round a
component of more than ``BLOCK`` sets of a bucket has blocks of its own, which meet
every block but each other, so a large family costs its size and not its square.

Defined results: texts without words (and nulls) have no shingles and are alone;
texts of fewer than five words have one shingle; equal sets link; the component's
name is its smallest doc_id, itself included, nulls ignored; rows that repeat a
doc_id each get a row.  Different sets whose 64-bit keys agree are told apart by a
second hash and get new keys.  An empty table gives an empty table.  Further columns
play no part in the join and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, drop_tables, free_shuffles, map_texts, materialize
from .shingles import PERCENT, WIDTH, linked, prefix_length, set_check, set_key, shingle_set

#: Documents that hold a shingle from which it counts as frequent, in all and in a task's share.
FREQUENT, FREQUENT_HERE = 64, 8
#: Shingles that a task holds before it counts them.
COUNTED = 1_000_000
#: Frequent shingles that the order knows at most: 8 bytes each bound the broadcast.
#: Any common order is exact, so this bound only moves work.
KNOWN_FREQUENT = 1 << 18
#: Sets of a bucket searched in one task against one other block.
BLOCK = 1024
#: Earlier buckets that a set's row names.  Pairs that share one of them are proposed
#: there; where more would be needed a pair comes twice and is made distinct.
EARLIER = 16
LEAF, FAN = 16, 8
#: Sets of a bucket that are paired one by one: arrays and a tree cost more than so few pairs.
FEW = 12
#: Bytes of bitmaps that a traversal gathers at a time.
GATHERED = 32 << 20
NEIGHBOURS = 32
BITMAP_BITS = (256, 16384)
#: Stands for a missing doc_id in joins.
NO_ID = -(2**63)


def text_hash():
    """64-bit hash that tells apart the texts under one doc_id."""
    return F.xxhash64("text")


# --- sets ---------------------------------------------------------------------------------


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """The most frequent shingles, ascending; counts cover every document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            values, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= FREQUENT_HERE
            return pa.RecordBatch.from_arrays(
                [pa.array(values[often].view(np.int64)), pa.array(n[often])], ["token", "n"]
            )

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(shingle_set(text))
                size += len(held[-1])
                if size > COUNTED:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counts = docs.select("text").mapInArrow(count, "token long, n long")
    total = counts.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    rows = total.orderBy(F.desc("n"), "token").limit(KNOWN_FREQUENT).select("token").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def bitmap(shingles: np.ndarray, each: int = 2) -> bytes:
    """Hashed token bitmap; a power of two bits, at least ``each`` a shingle within the limits."""
    low, high = BITMAP_BITS
    bits = min(high, max(low, 1 << (each * len(shingles) - 1).bit_length()))
    out = np.zeros(bits, np.uint8)
    out[(shingles & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def prefixes(docs: DataFrame) -> DataFrame:
    """doc_id, thash (of the text), n (set size), skey, check, bitmap, prefix and its count of rare shingles, which come first."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs))  # KNOWN_FREQUENT at most

    def make():
        frequent = shared.value

        def apply(texts, doc_ids, hashes):
            n, keys, checks, maps, out, rare = [], [], [], [], [], []
            for text in texts:
                s = shingle_set(text)
                n.append(len(s))
                keys.append(set_key(s))
                checks.append(set_check(s))
                maps.append(bitmap(s) if len(s) else b"")
                want = prefix_length(len(s))
                if len(frequent):
                    at = np.searchsorted(frequent, s)
                    at[at == len(frequent)] = 0
                    often = frequent[at] == s
                    s = np.concatenate([s[~often], s[often]])
                    rare.append(min(want, len(s) - int(often.sum())))
                else:
                    rare.append(want)
                out.append(s[:want].view(np.int64))
            return [doc_ids, hashes, n, keys, checks, maps, out, rare]

        return apply

    schema = "doc_id long, thash long, n int, skey long, check long, bitmap binary, prefix array<long>, rare int"
    return map_texts(docs.select("text", "doc_id", text_hash().alias("thash")), ["text", "doc_id", "thash"], make, schema)


# --- signature trees ----------------------------------------------------------------------


def _bound(all_bits, any_bits, most):
    """Largest overlap of a set under one node with a set under another."""
    return most - np.bitwise_count(all_bits & ~any_bits).sum(-1, dtype=np.int64)


def _may_link(low_a, high_a, all_a, any_a, low_b, high_b, all_b, any_b, percent=PERCENT):
    """False only where no set under a can link with one under b."""
    ok = (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a)
    overlap = np.minimum(_bound(all_a, any_b, high_a), _bound(all_b, any_a, high_b))
    # overlap >= percent of the union, and the union is at least what overlap leaves of both
    return ok & (100 * overlap >= percent * (low_a + low_b - overlap))


class Tree:
    """Levels of nodes over the sets of one bucket block, leaves of single sets first."""

    def __init__(self, n: np.ndarray, words: np.ndarray, comp: np.ndarray):
        self.levels = [(n, n, words, words, comp)]  # sizes low, high; bits all, any; component or -1
        for fan in iter(lambda: LEAF if len(self.levels) == 1 else FAN, None):
            low, high, every, some, own = self.levels[-1]
            if len(low) == 1:
                break
            cuts = np.arange(0, len(low), fan)
            one = np.minimum.reduceat(own, cuts) == np.maximum.reduceat(own, cuts)
            self.levels.append((
                np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts),
                np.bitwise_and.reduceat(every, cuts), np.bitwise_or.reduceat(some, cuts),
                np.where(one, own[cuts], -1),
            ))

    def fan(self, level: int) -> int:
        return LEAF if level == 1 else FAN


def dual_traversal(a: Tree, b: Tree, same: bool, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all leaf pairs of different components that may link.

    Depth first in slices, so that the bitmaps gathered at a time stay bounded.
    """
    most = max(1, GATHERED // (4 * a.levels[0][2].shape[1] * 8))
    root = np.zeros(1, np.int64)
    stack, out_a, out_b = [(len(a.levels) - 1, len(b.levels) - 1, root, root)], [root[:0]], [root[:0]]
    while stack:
        la, lb, ia, ib = stack.pop()
        if len(ia) > most:
            stack += [(la, lb, ia[most:], ib[most:])]
            ia, ib = ia[:most], ib[:most]
        low_a, high_a, all_a, any_a, own_a = (x[ia] for x in a.levels[la])
        low_b, high_b, all_b, any_b, own_b = (x[ib] for x in b.levels[lb])
        keep = ~((own_a == own_b) & (own_a >= 0))
        if same and la == lb:
            keep &= (ia <= ib) if la else (ia < ib)
        keep &= _may_link(low_a, high_a, all_a, any_a, low_b, high_b, all_b, any_b, percent)
        ia, ib = ia[keep], ib[keep]
        if not len(ia):
            continue
        if la == lb == 0:
            out_a.append(ia)
            out_b.append(ib)
        elif la >= lb and la:
            ia, ib = _children(ia, ib, a.fan(la), len(a.levels[la - 1][0]))
            la -= 1
            if same and lb == la + 1:
                ib, ia = _children(ib, ia, b.fan(lb), len(b.levels[lb - 1][0]))
                lb -= 1
            stack.append((la, lb, ia, ib))
        else:
            ib, ia = _children(ib, ia, b.fan(lb), len(b.levels[lb - 1][0]))
            stack.append((la, lb - 1, ia, ib))
    return np.concatenate(out_a), np.concatenate(out_b)


def _children(node, other, fan, size):
    child = node[:, None] * fan + np.arange(fan)
    other = np.broadcast_to(other[:, None], child.shape)
    real = child < size
    return child[real], other[real]


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps cut to the shortest of them, as rows of 64-bit words."""
    size = min(map(len, maps))
    out = np.empty((len(maps), size // 8), np.uint64)
    for row, m in zip(out, maps):
        row[:] = np.bitwise_or.reduce(np.frombuffer(m, np.uint64).reshape(-1, size // 8), axis=0)
    return out


def _by_length(maps, n):
    """Groups of positions whose bitmaps are near in length, for tight bounds.

    Linked sets' sizes are within a factor of 4/3, so their bitmaps' lengths are
    equal or neighbours; a group holds one length and the next.
    """
    lengths = np.array([len(m) for m in maps])
    for size in np.unique(lengths):
        own, longer = lengths == size, lengths == 2 * size
        yield np.flatnonzero(own), np.flatnonzero(longer)


def propose(n, maps, comp, keys, block, first: bool, earlier=None, across: bool = False, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Candidate pairs of keys of one bucket, within its one block or ``across`` two."""
    out, seen = [], [frozenset(e) for e in earlier or [()] * len(n)]
    comp = np.unique(comp, return_inverse=True)[1]  # from 0, so a node can say -1 for several
    for own, longer in _by_length(maps, n):
        at = np.concatenate([own, longer])
        words = folded([maps[i] for i in at])
        order = np.lexsort((keys[at], n[at], comp[at])) if not first else np.lexsort((keys[at], n[at]))
        at, words = at[order], words[order]
        size, c, k, bl = n[at], comp[at], keys[at], block[at]
        if first:
            best, near = np.full(len(at), -1, np.int64), np.zeros(len(at))
            for step in range(1, min(NEIGHBOURS, len(at) - 1) + 1):
                x, y = np.arange(step, len(at)), np.arange(len(at) - step)
                ok = _may_link(size[x], size[x], words[x], words[x], size[y], size[y], words[y], words[y])
                overlap = np.minimum(_bound(words[x], words[y], size[x]), _bound(words[y], words[x], size[y]))
                value = np.where(ok & (k[x] != k[y]), overlap / np.maximum(size[x], size[y]), 0)
                better = value > near[x]
                best[x[better]], near[x[better]] = y[better], value[better]
            x = np.flatnonzero(best >= 0)
            out += zip(k[x].tolist(), k[best[x]].tolist())
        else:
            split = [np.flatnonzero(bl == v) for v in np.unique(bl)]
            if len(split) == 1 and across:  # its pairs are found within the block
                continue
            trees = [(s, Tree(size[s], words[s], c[s])) for s in split]
            (s, a), (t, b) = trees[0], trees[-1]
            x, y = (side[found] for side, found in zip((s, t), dual_traversal(a, b, len(trees) == 1, percent)))
            place = at.tolist()
            new = [seen[place[i]].isdisjoint(seen[place[j]]) for i, j in zip(x.tolist(), y.tolist())]
            new = np.array(new, bool)
            out += zip(k[x[new]].tolist(), k[y[new]].tolist())
    return [(x, y) if x < y else (y, x) for x, y in out if x != y]


def _folded_to(bits: int, size: int, to: int) -> int:
    """A bitmap of ``size`` bits cut to ``to`` of them, both powers of two."""
    while size > to:
        size //= 2
        bits = (bits & ((1 << size) - 1)) | (bits >> size)
    return bits


def propose_few(n, maps, comp, keys, first: bool, earlier, percent: int = PERCENT) -> list[tuple[int, int]]:
    """``propose`` for a bucket of ``FEW`` sets at most in one block: the same bounds on whole numbers, pair by pair."""
    order = sorted(range(len(n)), key=lambda i: (n[i], keys[i]))
    bits = [int.from_bytes(m, "little") for m in maps]
    out = []
    for place, i in enumerate(order):
        best, near = None, 0.0
        for j in reversed(order[:place]):
            if 100 * n[j] < percent * n[i]:  # sizes ascend: all before are smaller yet
                break
            if keys[i] == keys[j] or (not first and comp[i] == comp[j]):
                continue
            x, y, own, other = bits[i], bits[j], len(maps[i]), len(maps[j])
            if own != other:
                size = 8 * min(own, other)
                x, y = _folded_to(x, 8 * own, size), _folded_to(y, 8 * other, size)
            both = (x & y).bit_count()
            overlap = min(n[i] - x.bit_count(), n[j] - y.bit_count()) + both  # as in _bound
            if 100 * overlap < percent * (n[i] + n[j] - overlap):
                continue
            if not first:
                if not earlier[i] or not earlier[j] or set(earlier[i]).isdisjoint(earlier[j]):
                    out.append((keys[i], keys[j]))
            elif overlap / n[i] > near:
                best, near = j, overlap / n[i]
        if best is not None:
            out.append((keys[i], keys[best]))
    return [(x, y) if x < y else (y, x) for x, y in out]


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _blocks(rows: DataFrame) -> DataFrame:
    """``rows`` of buckets beyond ``BLOCK`` with the block of each (own) and all blocks it meets (other).

    Components of more than ``BLOCK`` sets of a bucket have blocks of their own, after
    those of all other sets.
    """
    size = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    counts = rows.groupBy("token", "comp").agg(F.count("*").alias("c")).withColumn("big", F.col("c") > BLOCK)
    small = size(F.sum(F.when(~F.col("big"), F.col("c")).otherwise(0)))
    own_blocks = F.sum(F.when(F.col("big"), size(F.col("c"))).otherwise(0)).cast("int")
    of_token = counts.groupBy("token").agg(small.alias("small"), (small + own_blocks).alias("all"))
    before = Window.partitionBy("token").orderBy("comp").rowsBetween(Window.unboundedPreceding, -1)
    large = counts.where("big").withColumn("width", size(F.col("c"))).select(
        "token", "comp", "width", F.coalesce(F.sum("width").over(before), F.lit(0)).cast("int").alias("place")
    )
    placed = rows.join(of_token, "token").join(large, ["token", "comp"], "left")
    first = F.coalesce(F.col("small") + F.col("place"), F.lit(0))
    width = F.coalesce("width", "small")
    placed = placed.withColumn("own", first + F.pmod(F.xxhash64("skey"), width).cast("int"))
    others = F.filter(
        F.sequence(F.lit(0), F.col("all") - 1), lambda o: F.col("width").isNull() | (o < first) | (o >= first + F.col("width"))
    )
    return placed.withColumn("other", F.explode(others))


_ROW = ("own", "skey", "n", "comp", "bitmap", "earlier")


def search(rows: DataFrame, first: bool, percent: int = PERCENT) -> DataFrame:
    """Distinct candidate pairs of the buckets in ``rows`` (token, members, skey, n, comp, bitmap, earlier)."""
    if first:  # neighbours within a block are enough to merge families
        blocks = F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")
        placed = rows.withColumn("own", F.pmod(F.xxhash64("skey"), blocks).cast("int")).withColumn("other", F.col("own"))
        placed = placed.withColumn("earlier", F.array().cast("array<long>"))
    else:
        few = rows.where(F.col("members") <= BLOCK).withColumns({"own": F.lit(0), "other": F.lit(0)})
        placed = few.select("token", "other", *_ROW).union(
            _blocks(rows.where(F.col("members") > BLOCK)).select("token", "other", *_ROW)
        )
    keyed = placed.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *_ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(group, key):
            own, keys, n, comp, maps, earlier = zip(*group)
            if len(group) <= FEW and key[1] == key[2]:
                return propose_few(n, maps, comp, keys, first, earlier, PERCENT if first else percent)
            pairs = propose(
                np.array(n, np.int64), maps, np.array(comp, np.int64), np.array(keys, np.int64), np.array(own),
                first, earlier, key[1] != key[2], percent,
            )
            return sorted(set(pairs))

        def made(found):
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=PAIRS)

        held, key = [], None
        for batch in batches:
            found = []
            for token, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (token, i, j) != key:
                    if len(held) > 1:
                        found += emit(held, key)
                    held, key = [], (token, i, j)
                held.append(row)
            yield made(found)
        if len(held) > 1:
            yield made(emit(held, key))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = keyed.repartition(parts, "token", "i", "j").sortWithinPartitions("token", "i", "j", "skey")
    return grouped.mapInArrow(run, "a long, b long").distinct()


def verify(pairs: DataFrame, docs: DataFrame, reps: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The pairs whose exact sets link.  Sets are made anew for the pairs' documents."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("skey")).distinct()
    needed = reps.join(keys, "skey").select(
        "skey", F.coalesce("rep", F.lit(NO_ID)).alias("id"), "thash", F.col("low").alias("check")
    )
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), text_hash().alias("thash"), "text")
    texts = rows.join(needed, ["id", "thash"])

    def make():
        done = set()  # keys of this task, 8 bytes each: rows that repeat a text are left out

        def apply(texts, keys, checks):
            found = []
            for t, k, check in zip(texts, keys, checks):
                if k not in done and set_check(s := shingle_set(t, width)) == check:
                    done.add(k)
                    found.append((k, s.tobytes()))
            return [[k for k, _ in found], [s for _, s in found]]

        return apply

    stored = materialize(map_texts(texts, ["text", "skey", "check"], make, "skey long, shingles binary"), "jaccard-sets")
    sets = stored.dropDuplicates(["skey"])
    both = pairs.join(sets.select(F.col("skey").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("skey").alias("b"), F.col("shingles").alias("y")), "b"
    )

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(i).to_pylist() for i in (2, 3))
            keep = [linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(x, y)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    links = materialize(both.select("a", "b", "x", "y").mapInArrow(test, "a long, b long"), "jaccard-links")
    drop_tables(docs.sparkSession, stored)
    return links


# --- components -----------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """``skey, comp``: the least key reachable from each linked key.

    Alternates large-star and small-star steps over edge tables; each step hangs
    nodes on the least neighbour, so the number of rounds grows with the logarithm
    of the longest chain.  Nothing is gathered but counts.
    """
    spark = links.sparkSession
    edges = materialize(links.select("a", "b").distinct(), "jaccard-edges")
    while not _stars(edges):
        twice = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = twice.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = twice.join(least, "a").where("b > a and b != m").select(F.col("m").alias("a"), "b").distinct()
        # small-star: every key hangs its smaller neighbours and itself on the least of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (
            large.join(low, "b").where("a != m").select(F.col("m").alias("x"), F.col("a").alias("y"))
            .union(low.select(F.col("m").alias("x"), F.col("b").alias("y")))
            .select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        )
        done = materialize(small, "jaccard-edges")
        drop_tables(spark, edges)
        edges = done
    roots = edges.select(F.col("a").alias("skey"), F.col("a").alias("comp")).distinct()
    found = materialize(roots.union(edges.select(F.col("b").alias("skey"), F.col("a").alias("comp"))), "jaccard-comps")
    drop_tables(spark, edges)
    return found


def _stars(edges: DataFrame) -> bool:
    """Whether every key hangs on one other key at most, which itself hangs on none."""
    ends = edges.select(F.col("b").alias("key"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(
        edges.select("a", F.lit(0), F.lit(1))
    )
    keys = ends.groupBy("key").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return keys.where("hangs > 1 or (hangs = 1 and holds = 1)").isEmpty()


def join_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    made, chosen, by_set = _join(docs)
    return named_documents(made, chosen, by_set)


def named_documents(made: DataFrame, chosen: DataFrame, by_set: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document of ``made``."""
    by_set = by_set.join(chosen.select("comp", F.col("first.doc_id").alias("component")), "comp")
    return (
        made.select("doc_id", "n", "skey").join(by_set.select("skey", "component"), "skey", "left")
        .select(
            "doc_id", F.col("n").cast("long").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        )
    )


def representatives(made: DataFrame) -> DataFrame:
    """``skey, rep, thash, low, high`` of every set that isn't empty: the document that stands
    for it (smallest doc_id, a missing one last, then least hash of the text) and its checks."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("rep"), "thash"))
    sets = made.where("n > 0").groupBy("skey").agg(first.alias("first"), F.min("check").alias("low"), F.max("check").alias("high"))
    return sets.select("skey", "first.rep", "first.thash", "low", "high")


def rekeyed(made: DataFrame, reps: DataFrame) -> DataFrame:
    """``made`` with a new key for every set whose key means several sets, but for the least check."""
    clash = reps.where("low <> high").select("skey", "low")
    other = F.col("low").isNotNull() & (F.col("check") != F.col("low"))
    new = F.when(other, F.xxhash64("skey", "check")).otherwise(F.col("skey"))
    return made.join(clash, "skey", "left").withColumn("skey", new).select(*made.columns)


def _join(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``prefixes`` of the documents; each component's first document; ``skey, comp`` of every set."""
    spark = docs.sparkSession
    made, reps = keyed_sets(prefixes(docs), "jaccard-prefixes")

    # One row a distinct set and prefix shingle; only shingles of two sets make buckets.
    one = distinct_sets(made, reps).select("skey", "n", "rare", F.posexplode("prefix").alias("at", "token"))
    sign = F.sum(F.xxhash64("skey").cast("decimal(20,0)"))
    of_token = {"least": F.min("skey"), "most": F.max("skey"), "members": F.count("*")}
    # Frequent shingles: tasks add up their sets before the shuffle, so one of all documents is no task of its own.
    often = one.where("at >= rare")
    totals = often.groupBy("token").agg(*(c.alias(k) for k, c in of_token.items()), sign.cast("string").alias("sign"))
    # The others, each in few sets, get the same figures in place.
    over = Window.partitionBy("token")
    rare = one.where("at < rare").select(
        "token", "skey", "n", *(c.over(over).alias(k) for k, c in of_token.items()), sign.over(over).cast("string").alias("sign"),
    )
    shared = rare.unionByName(often.select("token", "skey", "n").join(totals, "token")).where("least < most")
    shared = materialize(shared.select("token", "skey", "n", "least", "members", "sign"), "jaccard-shared")
    free_shuffles(spark)
    # Buckets with the same members: the one of the least shingle stands for all.
    kept = shared.groupBy("least", "members", "sign").agg(F.min("token").alias("token")).select("token")
    maps = made.where("n > 0").select("skey", "bitmap").dropDuplicates(["skey"])
    of_set = shared.select("token", "skey", "n", "members").join(kept, "token").groupBy("skey").agg(
        F.first("n").alias("n"),
        F.array_sort(F.collect_list(F.struct("token", "members"))).alias("in"),  # no more than the set's prefix
    )
    buckets = of_set.join(maps, "skey").select("skey", "n", "bitmap", "in", F.posexplode("in").alias("at", "one"))
    earlier = F.slice(F.col("in")["token"], 1, F.least("at", F.lit(EARLIER))).alias("earlier")
    buckets = materialize(buckets.select("one.token", "one.members", "skey", "n", "bitmap", earlier), "jaccard-buckets")
    drop_tables(spark, shared)
    free_shuffles(spark)

    tested = materialize(search(buckets.withColumn("comp", F.col("skey")), True), "jaccard-pairs")
    links = verify(tested, docs, reps)
    comps = components(links)
    free_shuffles(spark)
    named = buckets.join(comps, "skey", "left").withColumn("comp", F.coalesce("comp", "skey"))
    more = materialize(search(named, False).join(tested, ["a", "b"], "left_anti"), "jaccard-pairs")
    drop_tables(spark, buckets, comps, tested)
    further = verify(more, docs, reps)
    comps = components(links.union(further))
    drop_tables(spark, more, links, further)
    return (made, *first_documents(reps, comps))


def keyed_sets(made: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``made`` (doc_id, thash, n, skey, check and more) and its ``representatives``, written; every key means one set."""
    made = materialize(made, name)
    reps = materialize(representatives(made), "jaccard-reps")
    while not reps.where("low <> high").isEmpty():  # different sets of one key
        old = made, reps
        made = materialize(rekeyed(made, reps), name)
        reps = materialize(representatives(made), "jaccard-reps")
        drop_tables(made.sparkSession, *old)
    return made, reps


def distinct_sets(made: DataFrame, reps: DataFrame) -> DataFrame:
    """The rows of ``made`` that stand for their sets, one a set.

    A missing doc_id takes part through a stand-in; equal sets without ids are one.
    """
    keys = ["skey", "rep", "thash"]
    found = made.withColumn("rep", F.coalesce("doc_id", F.lit(NO_ID))).join(
        reps.select("skey", F.coalesce("rep", F.lit(NO_ID)).alias("rep"), "thash"), keys
    )
    return found.dropDuplicates(keys).select(*made.columns)  # dealt as the join dealt it


def first_documents(reps: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each component's first document, and ``skey, comp`` of every set."""
    named = reps.join(comps, "skey", "left").withColumn("comp", F.coalesce("comp", "skey"))
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), F.col("rep").alias("doc_id"), "thash"))
    return named.groupBy("comp").agg(first.alias("first")), named.select("skey", "comp")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, all columns: smallest doc_id, then least hash of the text.

    A row without an id gives way to any linked document that has one.  Rows that
    repeat both doc_id and text are one document; different texts under one doc_id
    are several.  Texts without words are alone: each row of them without an id stays.
    """
    made, chosen, _ = _join(docs)
    first = chosen.select("first.doc_id", "first.thash")
    alone = made.where("n = 0 and doc_id is not null").select("doc_id", "thash").distinct()
    named = first.union(alone).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("thash").alias("h"))
    keyed = docs.select(F.struct("*").alias("doc"), F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), text_hash().alias("h"))
    kept = keyed.join(named, ["id", "h"], "left_semi").dropDuplicates(["id", "h"]).select("doc.*")
    wordless = F.col("text").isNull() | ~F.col("text").rlike(WORD)
    return kept.union(docs.where(F.col("doc_id").isNull() & wordless))
