"""Mixing sources to target weights by systematic sampling (native operations only).

Every document of a source expects ``target / source size`` copies.  Within a
source the documents are put in an order, expected copies are prefix-summed, one
offset per source is added, and a document is emitted once for every integer
boundary that its stretch crosses.  The order goes by size class, then by a hash
of the document id: neighbours are alike in size, so the words taken stay close to
the target.

Ranks come from three levels of counts (size class, two digits of the hash, two
more), so no task ever holds a whole source: the innermost groups hold a 65,536th
of a size class, the levels above at most 256 counts each.

Defined results: null texts have size 0; the null source sorts last among sources;
rows of equal id and size are ordered by a hash of the text, so reruns agree whatever
the row order (rows equal in all of these differ at most in further columns); a null
id counts as an empty one; sources without words have the target 0 and nothing of them
is taken; an empty table gives an empty table.  The input's columns travel inside one
struct ``doc``, so they may have any names, those of the results included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
#: Percent of all words that the mix holds.
PERCENT = 150
#: A source's target never exceeds this many times its size.
MOST = 2
_KEYS = ("mix_source", "mix_class", "mix_hash_a", "mix_hash_b")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def keyed(docs: DataFrame, size: Column) -> DataFrame:
    """``doc`` (all columns), size, a null-safe source key, the size class, hash digits and a tie-breaker.

    A class spans an eighth of an octave: four leading bits of the size.
    """
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    tie = F.xxhash64("text") if "text" in docs.columns else F.lit(0)
    source = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source"))
    packed = docs.select(
        F.struct("*").alias("doc"), F.col("doc_id").alias("mix_id"), size.alias("mix_size"),
        source.alias("mix_source"), digest.alias("mix_digest"), tie.alias("mix_tie"),
    )
    return (
        packed
        .withColumn("mix_shift", F.greatest(F.length(F.bin("mix_size")) - 4, F.lit(0)))
        .withColumn("mix_class", F.expr("mix_shift * 16 + cast(shiftright(mix_size, mix_shift) as int)"))
        .withColumn("mix_hash_a", F.substring("mix_digest", 1, 2))
        .withColumn("mix_hash_b", F.substring("mix_digest", 3, 2))
        .drop("mix_shift", "mix_digest")
    )


def targets(counts: DataFrame) -> DataFrame:
    """One row a source: size, target, expected copies and offset.

    Sources are filled in order of the level at which they reach their limit; the
    level of those that never reach it shares what is left by weight.  That is
    where resharing the excess by weight ends.
    """
    by_point = Window.orderBy("mix_source")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    sizes = counts.groupBy("mix_source").agg(F.sum("words").alias("source_size"))
    fill = Window.orderBy("limit_level", "mix_source")
    everything = Window.partitionBy()
    level = (F.col("all_words") * PERCENT / 100 - F.col("filled_before")) / F.col("weight_left")
    ranked = (
        sizes.withColumn("place", F.row_number().over(by_point) - 1)
        .withColumn("weight", weight)
        .withColumn("limit", (F.col("source_size") * MOST).cast("double"))
        .withColumn("limit_level", F.col("limit") / F.col("weight"))
        .withColumn("all_words", F.sum("source_size").over(everything).cast("double"))
        .withColumn("filled_before", F.sum("limit").over(fill) - F.col("limit"))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.sum("weight").over(fill) + F.col("weight"))
        .withColumn("level", level)
    )
    open_level = F.min(F.when(F.col("level") <= F.col("limit_level"), F.struct("limit_level", "mix_source", "level"))).over(everything)
    return (
        ranked.withColumn("open", open_level["level"])
        .withColumn("target", F.when(F.col("open").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("open") * F.col("weight"))))
        .withColumn("copies_each", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("offset", F.conv(F.substring(F.md5("mix_source"), 1, 8), 16, 10).cast("double") / 4294967296.0)
        .select("mix_source", "source_size", "target", "copies_each", "offset")
    )


def mix(docs: DataFrame, size: Column | None = None) -> DataFrame:
    """Every document as ``doc``, with mix_size, source_size, target and ``copies`` (0, 1 or 2)."""
    rows = keyed(docs, word_count(F.col("text")) if size is None else size)
    counts = materialize(
        rows.groupBy(*_KEYS).agg(F.count("*").alias("docs"), F.sum("mix_size").alias("words")), "mix-counts"
    )

    def before(frame: DataFrame, keys: list[str], by: str) -> DataFrame:
        """Documents before each row of ``frame`` among rows of equal ``keys``."""
        w = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return frame.withColumn(f"before_{by}", F.coalesce(F.sum("docs").over(w), F.lit(0)))

    source, size_class, a, b = _KEYS
    total = lambda keys: counts.groupBy(*keys).agg(F.sum("docs").alias("docs"))
    by_class = before(total([source, size_class]), [source], size_class).drop("docs")
    by_a = before(total([source, size_class, a]), [source, size_class], a).drop("docs")
    by_b = before(counts.select(*_KEYS, "docs"), [source, size_class, a], b).drop("docs")
    shares = targets(counts)
    bases = (
        by_b.join(by_a, [source, size_class, a])
        .join(by_class, [source, size_class])
        .join(shares, source)
        .select(
            *_KEYS, "source_size", "target", "copies_each", "offset",
            (F.col(f"before_{size_class}") + F.col(f"before_{a}") + F.col(f"before_{b}")).alias("mix_base"),
        )
    )
    innermost = Window.partitionBy(*_KEYS).orderBy("mix_size", "mix_id", "mix_tie")
    placed = rows.withColumn("mix_rank", F.row_number().over(innermost)).join(bases, list(_KEYS))
    place = F.col("mix_base") + F.col("mix_rank")
    crossed = F.floor(F.col("offset") + F.col("copies_each") * place) - F.floor(
        F.col("offset") + F.col("copies_each") * (place - 1)
    )
    return placed.select("doc", "mix_size", "source_size", "target", crossed.alias("copies"))


def sample(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each document as often as it was taken, same columns."""
    mixed = mix(docs).where("copies > 0")
    return mixed.select("doc", F.explode(F.expr("sequence(1L, copies)")).alias("time")).select("doc.*")


#: The same rows in DuckDB SQL.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
keyed AS (
  SELECT *, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
    greatest(length(bin(size)) - 4, 0) AS shift, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM sized),
classed AS (SELECT *, shift * 16 + (size >> shift) AS c, substr(h, 1, 4) AS h4 FROM keyed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c, h4, size, doc_id) AS place FROM classed),
sources AS (
  SELECT k, sum(size)::BIGINT AS source_size,
    [5, 2, 1][(row_number() OVER (ORDER BY k) - 1) % 3 + 1] AS weight FROM keyed GROUP BY k),
limits AS (
  SELECT *, (source_size * 2)::DOUBLE AS cap, (source_size * 2)::DOUBLE / weight AS cap_level,
    (sum(source_size) OVER ())::DOUBLE AS all_words FROM sources),
levels AS (
  SELECT *, (all_words * 150 / 100 - (sum(cap) OVER f - cap)) /
    (sum(weight) OVER () - sum(weight) OVER f + weight)::DOUBLE AS level FROM limits
  WINDOW f AS (ORDER BY cap_level, k ROWS UNBOUNDED PRECEDING)),
opened AS (SELECT *, (SELECT level FROM levels WHERE level <= cap_level ORDER BY cap_level, k LIMIT 1) AS open FROM levels),
shares AS (
  SELECT k, source_size, CASE WHEN open IS NULL THEN cap ELSE least(cap, open * weight) END AS target FROM opened),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS r,
    ('0x' || substr(md5(k), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u FROM shares)
SELECT doc_id, size, source_size, target,
  ((floor(u + r * place) - floor(u + r * (place - 1))) * size)::BIGINT AS taken
FROM ranked JOIN rates USING (k)
"""
