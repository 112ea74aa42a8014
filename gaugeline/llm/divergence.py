"""Source divergence audit by sketch-prefiltered counting.

Every language keeps the terms that at least ``LEAST`` of its documents hold; every
source's smoothed term probabilities are set against the other sources' and the
language's.  Three steps, each over all documents:

1. Each task counts document frequencies of (lang, term) into a count-min sketch; the
   merged sketch (fixed size, never underestimating) says which terms can't be kept.
2. Tasks count occurrences and documents of (lang, source, term) and drop the
   impossible terms before anything is shuffled; the survivors' counts are exact.
3. Pairs of sources are compared on the terms that both have: where a source lacks a
   term its probability is that of count zero, so the rest follows from totals by count.
   A term's rows meet in blocks of ``SOURCES`` sources, so no task holds all pairs of a term.

Probabilities are whole billionths plus one, computed in decimals and added up in longs: no rounding.

Defined results: null text, lang and source count as ''; a source without terms has the
probabilities of count zero everywhere; a language without kept terms has pairs of value
0 and no term rows; a language with one source has no pairs; rows that repeat count as
often as they come; an empty table gives an empty table; further columns play no part.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_tables, materialize, utf8
from .count_min import hash_runs, possible, reached, seed
from .shingles import mixed

#: Documents of its language that hold a kept term.
LEAST = 30
#: Added to every count, and the scale of probabilities.
SMOOTH, SCALE = 5, 1_000_000_000
#: Rows of part ``term`` of a source.
TERM_RANKS = 50
#: The sketch: cells of a row and rows.
WIDTH, DEPTH = 1 << 22, 2
#: Different keys that a task holds before it passes them on.
HELD = 400_000
#: Sources of a block, beyond which a language's terms meet in pairs of blocks.
SOURCES = 64

#: Of UTF-8 text with A-Z lowered: letters and every byte of a character beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order."""
    return TERM.findall(utf8(text).lower())


def term_hashes(lang: str, found: list[bytes]) -> np.ndarray:
    """Hashes of (lang, term), one an entry."""
    return mixed(hash_runs(b" ".join(found), _LETTER)[2] + seed(lang))


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


class _Frequencies:
    """Documents that hold each (lang, term), gathered before they are hashed."""

    def __init__(self):
        self.held = defaultdict(Counter)

    def __call__(self, langs, texts, sketch):
        for lang, text in zip(langs, texts):
            self.held[lang].update(set(terms(text)))
        if sum(map(len, self.held.values())) > HELD:
            self.finish(sketch)

    def finish(self, sketch):
        for lang, counts in self.held.items():
            if counts:
                sketch.add(term_hashes(lang, list(counts)), np.fromiter(counts.values(), np.int64, len(counts)))
        self.held.clear()


def survivors(docs: DataFrame, width: int = WIDTH, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """``lang, source, term, n, docs``: exact counts of all terms that the sketch can't rule out."""
    rows = _read(docs)
    bits = rows.sparkSession.sparkContext.broadcast(  # depth * width / 8 bytes
        reached(rows.select("lang", "text"), _Frequencies, width, depth, least, "divergence-sketch")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(lambda: (Counter(), Counter()))

        def emit():
            for (lang, source), (n, df) in held.items():
                keys = list(n)
                if not keys:
                    continue
                ok = possible(bits.value, term_hashes(lang, keys), width, depth)
                keys = [k for k, o in zip(keys, ok.tolist()) if o]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(keys)), pa.array([source] * len(keys)), pa.array([k.decode() for k in keys], pa.string()),
                    pa.array([n[k] for k in keys], pa.int64()), pa.array([df[k] for k in keys], pa.int64()),
                ], ["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                n, df = held[lang, source]
                found = terms(text)
                n.update(found)
                df.update(set(found))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from emit()
        yield from emit()

    counted = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept)), exactly: ``div`` of decimals doesn't round."""
    over = F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(19,0)")
    return 1 + F.call_function("div", over, (total + SMOOTH * kept).cast("decimal(20,0)"))


def audit(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every group of lang and source."""
    spark = docs.sparkSession
    counts = materialize(survivors(docs, least=least), "divergence-counts")
    by_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    vocabulary = by_lang.where(F.col("docs") >= least).drop("docs")
    kept = materialize(counts.join(vocabulary, ["lang", "term"]).drop("docs"), "divergence-kept")
    # every group that occurs, numbered once in a written table, so the numbers stay
    groups = _read(docs).groupBy("lang", "source").count().select("lang", "source", F.monotonically_increasing_id().alias("g"))
    groups = materialize(groups, "divergence-groups")
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(
        F.sum("lang_n").alias("lang_total"), F.count("*").alias("v")
    )
    sources = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    zero = F.lit(0).cast("long")
    groups = (
        groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").join(sources, "lang")
        .withColumns({c: F.coalesce(c, zero) for c in ("total", "lang_total", "v")})
        .withColumn("base", F.when(F.col("v") > 0, probability(zero, F.col("total"), F.col("v"))).otherwise(zero))
        .withColumn("blocks", F.ceil(F.col("sources") / SOURCES).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    )
    groups = materialize(groups, "divergence-sizes")
    known = materialize(
        kept.join(groups, ["lang", "source"]).select(
            "lang", "g", "source", "term", "n", "base", "blocks", "block",
            probability(F.col("n"), F.col("total"), F.col("v")).alias("p"),
            probability(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"),
        ), "divergence-known",
    )
    drop_tables(spark, counts, kept)
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(known, groups).withColumn("rank", F.row_number().over(ranked)).withColumn("part", F.lit("pair"))
    above = known.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    # every task keeps its own first ranks before the shuffle (the optimizer's group limit)
    tops = above.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= TERM_RANKS).withColumn("part", F.lit("term"))
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.select(*columns).unionByName(tops.select(*columns))


def _pairs(known: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of each two groups of a language, both ways round.

    With base_a the probability of count zero: the sum over all kept terms is that of
    |base_a - base_b| over all, corrected over a's terms as if b had none, over b's as if a
    had none, and over the terms of both by what these two corrections got wrong.
    """
    one = groups.select("lang", F.col("g").alias("a"), F.col("source").alias("source"), F.col("base").alias("base_a"), "v")
    two = groups.select("lang", F.col("g").alias("b"), F.col("source").alias("item"), F.col("base").alias("base_b"))
    both = one.join(two, "lang").where("a <> b")  # the result has a row for each
    # a's terms against each b without them: equal probabilities of a are one row
    levels = known.groupBy("lang", F.col("g").alias("a"), "p", F.col("base").alias("base_a")).agg(F.count("*").alias("m"))
    alone = levels.join(two, "lang").where("a <> b").groupBy("a", "b").agg(
        F.sum(F.col("m") * (F.abs(F.col("p") - F.col("base_b")) - F.abs(F.col("base_a") - F.col("base_b")))).alias("alone")
    )
    left = known.select("lang", "term", F.col("block").alias("i"), F.explode(F.expr("sequence(block, blocks - 1)")).alias("j"), F.col("g").alias("a"), F.col("p").alias("pa"), F.col("base").alias("base_a"))
    right = known.select("lang", "term", F.col("block").alias("j"), F.explode(F.expr("sequence(0, block)")).alias("i"), F.col("g").alias("b"), F.col("p").alias("pb"), F.col("base").alias("base_b"))
    met = left.join(right, ["lang", "term", "i", "j"]).where("i < j or a < b")
    over = F.abs(F.col("pa") - F.col("pb")) - F.abs(F.col("pa") - F.col("base_b")) - F.abs(F.col("pb") - F.col("base_a")) + F.abs(F.col("base_a") - F.col("base_b"))
    shared = met.groupBy("a", "b").agg(F.sum(over).alias("shared"))
    shared = shared.union(shared.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    other = alone.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("alone").alias("other"))
    value = F.col("v") * F.abs(F.col("base_a") - F.col("base_b"))
    for c in ("alone", "other", "shared"):
        value = value + F.coalesce(c, F.lit(0).cast("long"))
    return both.join(alone, ["a", "b"], "left").join(other, ["a", "b"], "left").join(shared, ["a", "b"], "left").select(
        "lang", "source", "item", F.when(F.col("v") > 0, value).otherwise(F.lit(0).cast("long")).alias("value")
    )


#: The same rows in DuckDB SQL.
ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
found AS (SELECT d, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
vocab AS (SELECT lang, term, count(*) AS n FROM found GROUP BY ALL HAVING count(DISTINCT d) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM vocab GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN vocab USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY ALL),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * v.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 5)) // (v.total + 5 * v.v) AS q
  FROM groups g JOIN vocab k USING (lang) JOIN v USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN totals s ON s.lang = g.lang AND s.source = g.source),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM grid WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
