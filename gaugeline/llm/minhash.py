"""MinHash near-duplicates: one-permutation hashing, banded buckets, star-shaped candidates.

A document's set of four-word shingles is hashed once; the hash's top part names one of
``BINS`` bins, and a bin keeps its least hash.  Empty bins borrow from others (optimal
densification): bin j goes through all bins in an order of its own, the same for every
set, and takes the first that isn't empty; so bins of two sets agree with the chance of
their Jaccard similarity, however few shingles there are.  ``BANDS`` bands of ``ROWS`` bins
are bucket keys.  A pair of similarity 0.8 misses all of them with a chance of
(1 - 0.8**5)**64 = 1e-11; pairs above, with less.

In a bucket the set of the least hash is the hub; every set is proposed with up to ``HUBS``
hubs, those of most of its buckets: stars, so candidates grow with the sets and not with a
bucket's square.  Stars are confirmed on the full sets, and what links is merged.  Rounds with
other hubs follow in the buckets that still hold several components, while enough of what they
propose links.  What stars leave open are pairs of different components that share a bucket:
these are searched by the signature trees' exact bounds, in blocks, so that no link of a bucket is lost.

Documents of equal sets are one from the start; tasks hold no bucket beyond a block.

Defined results: texts without words (and nulls) have no shingles, are alone and kept;
texts of fewer than four words have one shingle; equal sets link; the component's name
is its smallest doc_id, nulls ignored; a row is kept if its doc_id is the name (null ids
count as equal here, so rows of a component without ids are all kept); rows that repeat a
doc_id each get a row.  An empty table gives an empty table; further columns play no part.
"""

from __future__ import annotations

from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, free_shuffles, map_texts, materialize
from .shingles import mixed, set_check, set_key, shingle_set
from .signature_tree import bitmap, components, distinct_sets, first_documents, keyed_sets, named_documents, search, text_hash, verify

WIDTH, PERCENT = 4, 80
BANDS, ROWS = 64, 5
BINS = BANDS * ROWS
#: Hubs that a set is proposed with in a round of stars, and the share (one in so many) of proposed pairs that must link for another round.
HUBS, FRUITFUL = 2, 4
#: Bits of a set's bitmap a shingle at least: what the exact bounds see of a difference.
BITS = 4
#: Place of each bin in each bin's order of borrowing (row: the borrower).
_ORDER = np.random.default_rng(0xB1).permuted(np.tile(np.arange(BINS, dtype=np.int16), (BINS, 1)), axis=1)
_MULTIPLY = np.random.default_rng(0xB2).integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_BAND = np.random.default_rng(0xB3).integers(0, 2**64, BANDS, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The ``BINS`` least hashes of a set that isn't empty, after densification."""
    h = mixed(shingles ^ np.uint64(0x5851F42D4C957F2D))
    bins = ((h >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, bins, h)
    own = np.zeros(BINS, bool)
    own[bins] = True
    full, empty = np.flatnonzero(own), np.flatnonzero(~own)
    if len(empty):
        least[empty] = least[full[_ORDER[np.ix_(empty, full)].argmin(axis=1)]]
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key a band."""
    return mixed((mixed(least.reshape(BANDS, ROWS) * _MULTIPLY)).sum(axis=1, dtype=np.uint64) + _BAND)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, thash (of the text), n (set size), skey, check, bitmap and bands of every document."""

    def make():
        def apply(texts, doc_ids, hashes):
            n, keys, checks, maps, found = [], [], [], [], []
            for text in texts:
                s = shingle_set(text, WIDTH)
                n.append(len(s))
                keys.append(set_key(s))
                checks.append(set_check(s))
                maps.append(bitmap(s, BITS) if len(s) else b"")
                found.append(bands(signature(s)).view(np.int64) if len(s) else [])
            return [doc_ids, hashes, n, keys, checks, maps, found]

        return apply

    schema = "doc_id long, thash long, n int, skey long, check long, bitmap binary, bands array<long>"
    rows = docs.select("text", "doc_id", text_hash().alias("thash"))
    return map_texts(rows, ["text", "doc_id", "thash"], make, schema)


def open_rows(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """``token, skey, comp`` of the buckets (token, skey) that hold several components."""
    if comps is None:
        named = rows.select("token", "skey", F.col("skey").alias("comp"))
    else:
        named = rows.select("token", "skey").join(comps, "skey", "left").select("token", "skey", F.coalesce("comp", "skey").alias("comp"))
    several = named.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("members"))
    return named.join(several.where("low < high").select("token", "members"), "token")


def stars(rows: DataFrame, turn: int) -> DataFrame:
    """``a, b`` (a < b): each set of open buckets with up to ``HUBS`` of their hubs in other components, those it shares most buckets with."""
    mark = F.xxhash64(F.lit(turn), "skey")
    hubs = rows.groupBy("token").agg(F.min(F.struct(mark.alias("mark"), F.col("skey").alias("hub"), F.col("comp").alias("other"))).alias("h"))
    met = rows.join(hubs.select("token", "h.hub", "h.other"), "token").where("comp <> other").select("skey", "hub")
    counted = met.repartition("skey").groupBy("skey", "hub").agg(F.count("*").alias("n"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "hub"))), 1, HUBS)  # of BANDS at most
    pairs = counted.groupBy("skey").agg(best.alias("best")).select("skey", F.explode("best.hub").alias("hub"))
    return pairs.select(F.least("skey", "hub").alias("a"), F.greatest("skey", "hub").alias("b")).distinct()


def for_search(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """Open buckets as the trees' search takes them."""
    of_set = rows.groupBy("skey", "comp").agg(F.array_sort(F.collect_list(F.struct("token", "members"))).alias("in"))  # BANDS at most
    placed = of_set.join(maps, "skey").select("skey", "n", "comp", "bitmap", "in", F.posexplode("in").alias("at", "one"))
    earlier = F.slice(F.col("in")["token"], 1, "at").alias("earlier")
    return placed.select("one.token", "one.members", "skey", "n", "comp", "bitmap", earlier)


def find(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``signatures`` of the documents; each component's first document; ``skey, comp`` of every set."""
    spark = docs.sparkSession
    made, reps = keyed_sets(signatures(docs), "minhash-signatures")
    sets = materialize(distinct_sets(made, reps).where("n > 0").select("skey", "n", "bitmap", "bands"), "minhash-sets")
    rows, comps, links, tested = sets.select("skey", F.explode("bands").alias("token")), None, None, None
    for turn in count():
        old = [] if turn == 0 else [rows, comps]
        rows = materialize(open_rows(rows, comps), "minhash-open")
        pairs = stars(rows, turn)
        pairs = materialize(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "minhash-stars")
        found = verify(pairs, docs, reps, WIDTH, PERCENT)
        tested, links = (pairs, found) if turn == 0 else (tested.union(pairs), links.union(found))
        comps = components(links)
        drop_tables(spark, *old)
        free_shuffles(spark)
        if found.count() * FRUITFUL < pairs.count() or pairs.isEmpty():
            break
    rest = materialize(for_search(open_rows(rows, comps), sets.select("skey", "n", "bitmap")), "minhash-open")
    more = materialize(search(rest, False, PERCENT).join(tested, ["a", "b"], "left_anti"), "minhash-pairs")
    drop_tables(spark, comps, rows, rest, sets)
    further = verify(more, docs, reps, WIDTH, PERCENT)
    comps = components(links.union(further))
    return (made, *first_documents(reps, comps))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document."""
    named = named_documents(*find(docs))
    return named.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
