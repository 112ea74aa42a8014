"""Removal of repeated 200-byte strings with suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere
else.  Which strings can repeat is narrowed without loss first: every string has
an anchor, the leftmost of its least-hashed 64-byte grams, and equal strings have
equal anchors at equal places.  The strings that share one anchor lie side by side
and make a context (at most 336 bytes).  A gram that anchors only one context in
the whole corpus has no repeated string; if all its contexts are equal, and there
are several, all of their strings repeat.

What is left, anchors with differing contexts, goes by anchor to shards.  A shard
lays its distinct contexts end to end, builds their suffix array by
Larsson-Sadakane refinement (sorted groups drop out, ranks double their depth) and
takes Kasai's common prefixes in text order: an irreducible prefix is compared
directly, every other is one shorter than its left neighbour's.  Suffixes whose
common prefix reaches ``LENGTH`` are equal strings.  An anchor with very many
contexts is spread over several shards; the strings that were single in their
shard are then merged across shards in ranges of their fingerprints, by binary
search in the sorted range.

Grams, contexts and strings are compared across shards by 64-bit fingerprints.  Those
of contexts and strings mix a polynomial over the integers modulo 2**64 with one over
a prime field, so that texts made to agree in the first (Thue-Morse words) still differ.

Defined results: a null text is empty; matches never cross documents; a text
shorter than ``LENGTH`` loses nothing; rows that repeat a document repeat its
strings, so both lose them, nulls among the ids included.  An empty table gives an empty table.
Other columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, free_shuffles, map_texts, materialize, utf8
from .shingles import mixed

LENGTH = 200
GRAM = 64
WINDOW = LENGTH - GRAM + 1
#: String starts handled at a time; below 2**20, which is what a place takes in a key.
SEGMENT = 1 << 17
#: Contexts of one anchor in one shard, and bytes of one suffix array.
SHARD_CONTEXTS = 256
SHARD_BYTES = 3_000_000
_PLACE = np.uint64((1 << 20) - 1)


class _Powers:
    """Powers of a base and of its inverse modulo ``modulus``, as far as asked for."""

    def __init__(self, base: int, modulus: int):
        self.base, self.inverse, self.modulus = base, pow(base, -1, modulus), modulus
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            size = len(self.up)
            self.up = np.concatenate([self.up, self._times(self.up, pow(self.base, size, self.modulus))])
            self.down = np.concatenate([self.down, self._times(self.down, pow(self.inverse, size, self.modulus))])
        return self.up[:n], self.down[:n]

    def _times(self, values: np.ndarray, factor: int) -> np.ndarray:
        product = values * np.uint64(factor)
        return product if self.modulus == 1 << 64 else product % np.uint64(self.modulus)


_PRIME = (1 << 31) - 1
_RING, _FIELD = _Powers(0xD6E8FEB86659FD93, 1 << 64), _Powers(1_103_515_245, _PRIME)


class Prints:
    """Prefix sums of one stretch of bytes (below 2**24), for fingerprints of its strings."""

    def __init__(self, a: np.ndarray):
        plain = a + np.uint64(1)
        up, self.down = _RING.upto(len(a) + 1)
        self.sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(plain * up[:-1], out=self.sums[1:])
        up, self.field_down = _FIELD.upto(len(a) + 1)
        self.field_sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(plain * up[:-1], out=self.field_sums[1:])  # below 2**63: no wrap

    def grams(self, size: int) -> np.ndarray:
        """Fingerprint of every string of ``size`` bytes, from the first polynomial."""
        return mixed((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Fingerprints of some strings, from both polynomials."""
        ring = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        field = (self.field_sums[ends] - self.field_sums[starts]) % np.uint64(_PRIME)
        field = field * self.field_down[starts] % np.uint64(_PRIME)
        return mixed(mixed(ring) + field)


def anchors(data: bytes):
    """Of each anchor: gram and context fingerprints, first and last string start, place in the context."""
    out = []
    for at in range(0, len(data) - LENGTH + 1, SEGMENT):
        a = np.frombuffer(data, np.uint8)[at:at + SEGMENT + LENGTH - 1]
        prints = Prints(a)
        grams = prints.grams(GRAM)
        keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        # Least key of every window: from the blocks that a window straddles.
        blocks = -(-len(keys) // WINDOW)
        padded = np.full(blocks * WINDOW, ~np.uint64(0))
        padded[: len(keys)] = keys
        padded = padded.reshape(blocks, WINDOW)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(a) - LENGTH + 1
        least = np.minimum(behind[:n], ahead[WINDOW - 1:WINDOW - 1 + n])
        place = (least & _PLACE).astype(np.int64)
        low = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        high = np.concatenate([low[1:], [n]]) - 1
        own = place[low]
        context = prints.of(low, high + LENGTH)
        context = mixed(context + mixed(((high - low) * 256 + own - low + 1).astype(np.uint64)))
        out.append((grams[own].view(np.int64), context.view(np.int64), low + at, high + at, own - low))
    return tuple(map(np.concatenate, zip(*out))) if out else None


# --- suffix arrays ------------------------------------------------------------------------


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by Larsson-Sadakane refinement."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for i in range(7):  # seven bytes and how many of them exist: the end sorts first
        key = (key << np.uint64(8)) | padded[i:n + i]
    key = (key << np.uint64(8)) | np.minimum(np.arange(n, 0, -1), 7).astype(np.uint64)
    sa = np.argsort(key, kind="stable")
    fresh = np.concatenate([[True], key[sa[1:]] != key[sa[:-1]]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    depth = 7
    while True:
        single = fresh & np.concatenate([fresh[1:], [True]])
        slots = np.flatnonzero(~single)  # only unsorted groups are looked at again
        if not len(slots):
            return sa
        at = sa[slots]
        beyond = at + depth
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)], -1)
        group = rank[at]
        order = np.lexsort((second, group))
        at, second, group = at[order], second[order], group[order]
        sa[slots] = at
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        fresh[slots] = new
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        depth *= 2


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``sa`` (Kasai, in text order)."""
    n = len(text)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    i = np.arange(n)
    left = np.where((i > 0) & (before > 0), before - 1, 0)
    direct = (i == 0) | (before <= 0) | (text[np.maximum(i - 1, 0)] != text[left])
    first = sa[0]
    if first + 1 < n:
        direct[first + 1] = True
    length = np.zeros(n, np.int64)
    todo = np.flatnonzero(direct & (before >= 0))
    wide = np.zeros(n + 8, np.uint8)
    wide[:n] = text
    words = np.lib.stride_tricks.as_strided(wide[:8].view(np.uint64), (n + 1,), (1,))
    x, y = todo.copy(), before[todo]
    while len(todo):
        most = n - np.maximum(x, y)
        differ = words[x] ^ words[y]
        # the lowest set bit names the first differing byte
        bit = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        step = np.minimum(np.where(differ == 0, 8, bit // 8), most)
        length[todo] += step
        go = (step == 8) & (most > 8)
        todo, x, y = todo[go], x[go] + 8, y[go] + 8
    source = np.maximum.accumulate(np.where(direct, i, 0))
    out = length[source] - (i - source)
    return np.maximum(out, 0)[sa]


def shard_repeats(contexts: list[bytes], counts: list[int]):
    """Equal strings of a shard's contexts.

    Returns, for every string start (context, offset): whether the string repeats
    here, and whether the start stands for its string.
    """
    text = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    sa = suffix_array(text)
    group = np.cumsum(common_prefixes(text, sa) < LENGTH)
    owner = np.repeat(np.arange(len(contexts)), sizes)
    offset = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    starts = offset <= (sizes - LENGTH)[owner]
    pick = starts[sa]
    at, group = sa[pick], group[pick]
    lead = np.concatenate([[True], group[1:] != group[:-1]])
    number = np.cumsum(lead) - 1
    weight = np.bincount(number, np.array(counts, np.float64)[owner[at]])
    order = np.argsort(at)
    at = at[order]
    return owner[at], offset[at], (weight[number] > 1)[order], lead[order]


def runs(hit: np.ndarray) -> list[int]:
    """First and last place of every run of true values, flattened."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    edge[1::2] -= 1
    return edge.tolist()


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts (fp, salt, shards, c, n, context), sorted by anchor: repeats in this shard.

    Rows out: (fp, c, spans) for every context with repeats; of anchors in several
    shards also (fp, part, packed): a shard's distinct strings of one fingerprint range.
    """

    def solve(rows):
        contexts = [r[5] for r in rows]
        owner, offset, hit, lead = shard_repeats(contexts, [r[4] for r in rows])
        out, strings = [], {}
        cut = np.searchsorted(owner, np.arange(len(rows) + 1))
        for i, (fp, salt, shards, c, _, context) in enumerate(rows):
            own = slice(cut[i], cut[i + 1])
            spans = runs(hit[own])
            if spans:
                out.append((fp, c, spans, None, None))
            if shards > 1:
                at = offset[own][lead[own] | ~hit[own]]
                found = np.empty(len(at), STRING)
                found["value"] = Prints(np.frombuffer(context, np.uint8)).of(at, at + LENGTH)
                found["c"], found["at"], found["single"] = c, at, ~hit[own][at]
                strings.setdefault((fp, salt, shards), []).append(found)
        for (fp, _, shards), found in strings.items():
            found = np.concatenate(found)
            part = (found["value"] >> np.uint64(32)) * np.uint64(-(-shards // 16)) >> np.uint64(32)
            for p in np.unique(part):
                out.append((fp, None, None, int(p), found[part == p].tobytes()))
        return out

    held, size, key = [], 0, None
    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if size > SHARD_BYTES and row[:2] != key:
                out += solve(held)
                held, size = [], 0
            key = row[:2]
            held.append(row)
            size += len(row[5])
        yield _rows(out)
    if held:
        yield _rows(solve(held))


#: A distinct string of a shard: fingerprint, context, offset, and if it was single there.
STRING = np.dtype([("value", "<u8"), ("c", "<i8"), ("at", "<i4"), ("single", "?")])
_RESOLVED = pa.schema(
    [("fp", pa.int64()), ("c", pa.int64()), ("spans", pa.list_(pa.int32())), ("part", pa.int32()),
     ("packed", pa.binary())]
)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(_RESOLVED)
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _RESOLVED)], schema=_RESOLVED)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed strings (fp, part, packed), sorted by anchor and range: (fp, c, spans) of
    the strings that were single in their shard and that another shard holds."""

    def across(fp, packed):
        found = np.frombuffer(b"".join(packed), STRING)
        ordered = np.sort(found["value"])
        copies = np.searchsorted(ordered, found["value"], "right") - np.searchsorted(ordered, found["value"], "left")
        found = np.sort(found[(copies > 1) & found["single"]], order=["c", "at"])
        cuts = np.flatnonzero(np.diff(found["c"])) + 1
        return [(fp, int(x["c"][0]), np.repeat(x["at"], 2).tolist(), None, None) for x in np.split(found, cuts) if len(x)]

    held, key = [], None
    for batch in batches:
        out = []
        for fp, part, packed in zip(*(c.to_pylist() for c in batch.columns)):
            if (fp, part) != key:
                if len(held) > 1:
                    out += across(key[0], held)
                held, key = [], (fp, part)
            held.append(packed)
        yield _rows(out).select(["fp", "c", "spans"])
    if len(held) > 1:
        yield _rows(across(key[0], held)).select(["fp", "c", "spans"])


# --- the operator ---------------------------------------------------------------------------


def removed_spans(docs: DataFrame) -> DataFrame:
    """``key, spans``: flattened [start, end) bytes to remove; spans may overlap.

    ``docs`` has key and text; rows of one key have the same text.
    """
    spark = docs.sparkSession

    def find():
        def apply(texts, keys):
            out = [[] for _ in range(6)]
            for text, key in zip(texts, keys):
                found = anchors(utf8(text))
                if found:
                    for column, values in zip(out, (np.full(len(found[0]), key), *found)):
                        column.append(values)
            return [np.concatenate(c) if c else [] for c in out]

        return apply

    rows = map_texts(docs, ["text", "key"], find, "key long, fp long, c long, low int, high int, place int")
    rows = materialize(rows, "repeat-anchors")
    often = rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("n > 1")
    # Written first, so that both sides are dealt for the join alone and hot grams can be split.
    often = materialize(often.select("fp", (F.col("c0") != F.col("c1")).alias("differ")), "repeat-grams")
    marked = materialize(rows.join(often, "fp"), "repeat-marked")
    drop_tables(spark, rows, often)
    free_shuffles(spark)

    open_ = marked.where("differ")
    classes = open_.groupBy("fp", "c").agg(
        F.count("*").alias("n"), F.min(F.struct("key", "low", "high")).alias("from")
    )
    wanted = classes.groupBy(F.col("from.key").alias("key")).agg(
        F.collect_list(F.struct("fp", "c", "n", "from.low", "from.high")).alias("wanted")
    )
    schema = "key long, fp long, c long, n long, context binary"

    def cut():
        def apply(texts, keys, wanted):
            out = []
            for text, key, parts in zip(texts, keys, wanted):
                data = utf8(text)
                out += [(key, p["fp"], p["c"], p["n"], data[p["low"]:p["high"] + LENGTH]) for p in parts]
            return list(zip(*out)) or [[]] * 5

        return apply

    contexts = map_texts(docs.join(wanted, "key"), ["text", "key", "wanted"], cut, schema)
    # Rows that repeat a document cut the same contexts again.
    contexts = materialize(contexts.dropDuplicates(["fp", "c"]).drop("key"), "repeat-contexts")
    free_shuffles(spark)
    # Anchors of several shards are few: contexts stay where they are, and only those are spread.
    many = contexts.groupBy("fp").agg(F.ceil(F.count("*") / SHARD_CONTEXTS).cast("int").alias("many")).where("many > 1")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        contexts.join(many, "fp", "left").withColumn("shards", F.coalesce("many", F.lit(1)))
        .withColumn("salt", F.pmod("c", "shards").cast("int"))
        .repartition(parts, "fp", "salt").sortWithinPartitions("fp", "salt", "c")
    )
    solved = dealt.select("fp", "salt", "shards", "c", "n", "context").mapInArrow(
        _resolve, "fp long, c long, spans array<int>, part int, packed binary"
    )
    solved = materialize(solved, "repeat-solved")
    across = solved.where("packed is not null").repartition(parts, "fp", "part").sortWithinPartitions("fp", "part")
    merged = across.select("fp", "part", "packed").mapInArrow(_merge, "fp long, c long, spans array<int>")
    by_class = solved.where("spans is not null").select("fp", "c", "spans").unionByName(merged)
    pairs = F.transform(
        F.expr("sequence(0, cast(size(spans) div 2 as int) - 1)"),
        lambda i: F.struct(
            (F.element_at("spans", i * 2 + 1) + F.col("low")).alias("start"),
            (F.element_at("spans", i * 2 + 2) + F.col("low") + LENGTH).alias("end"),
        ),
    )
    differing = open_.join(by_class, ["fp", "c"]).select("key", F.explode(pairs).alias("span"))
    same = marked.where("not differ").select(
        "key", F.struct(F.col("low").alias("start"), (F.col("high") + LENGTH).alias("end")).alias("span")
    )
    return same.unionByName(differing).groupBy("key").agg(F.collect_set("span").alias("spans"))


def with_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text and a 64-bit ``key`` that rows of different id or text never share.

    A second hash shows if two documents got one key; then all keys are made anew from both.
    """
    key, check = F.xxhash64("doc_id", "text"), F.xxhash64("text", "doc_id")
    while True:
        pairs = docs.select(key.alias("key"), check.alias("check")).groupBy("key")
        if pairs.agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").isEmpty():
            return docs.select("doc_id", "text", key.alias("key"))
        key = F.xxhash64(key, check)


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    keyed = with_keys(docs)
    spans = materialize(removed_spans(keyed.select("key", "text")), "repeat-spans")
    free_shuffles(docs.sparkSession)
    joined = keyed.join(spans, "key", "left").withColumn("starts", F.col("spans.start")).withColumn("ends", F.col("spans.end"))

    def make():
        def apply(texts, doc_ids, starts, ends):
            n, gone, count, digest = [], [], [], []
            for text, s, e in zip(texts, starts, ends):
                kept, removed, holes = cut_out(utf8(text), s, e)
                n.append(len(kept) + removed)
                gone.append(removed)
                count.append(holes)
                digest.append(hashlib.sha256(kept).hexdigest())
            return [doc_ids, n, gone, count, digest]

        return apply

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return map_texts(joined, ["text", "doc_id", "starts", "ends"], make, schema)


def cut_out(data: bytes, starts: list[int] | None, ends: list[int] | None) -> tuple[bytes, int, int]:
    """Bytes left, bytes removed, and maximal removed runs."""
    if not starts:
        return data, 0, 0
    kept, at, removed, holes = [], 0, 0, 0
    stop = -1
    for s, e in sorted(zip(starts, ends)):
        if s > stop:
            if stop >= 0:
                removed += stop - begin
                holes += 1
            kept.append(data[at if stop < 0 else stop:s])
            begin, stop = s, e
        else:
            stop = max(stop, e)
    removed += stop - begin
    kept.append(data[stop:])
    return b"".join(kept), removed, holes + 1
