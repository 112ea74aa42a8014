"""Phrase collocation mining by contiguous pattern growth from projected prefixes.

Frequent phrases of up to ``LONGEST`` words grow to the right as in PrefixSpan:

1. Two count-min sketches (fixed size, never underestimating) tell what can't be frequent:
   one of all words and neighbouring pairs of a language, one of the longer sequences that
   hold possible pairs only and of the words that stand in such pairs.  No frequent phrase
   holds what one of them rules out.
2. Projection: every occurrence of a word that may stand in a frequent pair is a pointer with
   what may still follow it, up to ``LONGEST`` words and the first impossible sequence; words
   of no such pair are in no phrase and no cut.  Tasks add up equal pointers, as many tasks as
   the cluster has slots: each sends every frequent sequence about once, so with a task a
   split the rows would grow as splits times sequences.  The table is dealt by sorted ranges,
   so a prefix's pointers lie together, one task a prefix; a prefix that holds a third of all
   rows is cut over several ranges.
3. Growth: the pointers of a prefix are grouped by the word that follows, supports are
   added up, and frequent groups grow on, depth first.  A prefix cut by the edge of a
   range or of a chunk is handed on whatever its support; sums over the edges decide.

Supports are exact and all arithmetic on scores is in decimals of 38 digits.

Scores set a phrase against its weakest cut.  Phrases that occur only inside a longer
frequent phrase are dropped: one word more is enough to look at, since every phrase
between the two occurs as often.

Defined results: null texts are empty; a null language counts as ``und``; one-word
pieces have no phrases; words may hold any character but the separators (control
characters included); a language without phrases has no rows; rows that repeat count as
often as they come; an empty table gives an empty table; further columns play no part.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_tables, materialize, utf8
from .count_min import hash_runs, possible, reached, seed
from .shingles import _A, mixed

#: Occurrences of a candidate, and its words.
LEAST, SHORTEST, LONGEST = 100, 2, 5
#: Phrases of a language in the report.
RANKS = 2000
#: The sketches: cells of a row and rows.
WIDTH, DEPTH = 1 << 23, 2
#: Different projected sequences that a task holds before it passes them on, and rows of a chunk of growth.
HELD, CHUNK = 400_000, 100_000

#: Working bytes: words end with 0, pieces with 10; 0 and 1 in the text are written as two bytes.
_GAP, _END = b"\x00", b"\n"
_TABLE = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ \t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz\x00\x00" + _END * 9
)
_INSIDE = np.ones(256, bool)
_INSIDE[[0, 10]] = False
#: Tells a word that stands in a pair from the word itself.
_PAIRED = seed("paired")


def prepared(text: str | None) -> bytes:
    """A text's working bytes: A-Z lowered, one gap between words, ends of pieces marked."""
    data = utf8(text)
    if b"\x00" in data or b"\x01" in data:
        data = data.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x03")
    data = data.translate(_TABLE)
    while _GAP + _GAP in data:
        data = data.replace(_GAP + _GAP, _GAP)
    return data


def shown(key: bytes) -> str:
    """The phrase of a key: words joined by spaces."""
    data = key.replace(_GAP, b" ")
    if b"\x01" in data:
        data = data.replace(b"\x01\x03", b"\x00").replace(b"\x01\x02", b"\x01")
    return data.decode("utf-8", "surrogatepass")


class Words:
    """The words of several texts of one language: places, hashes, and whether the next word is in the same piece."""

    def __init__(self, lang: str, texts: list[str | None]):
        self.data = _END.join(map(prepared, texts))
        self.starts, self.ends, hashes = hash_runs(self.data, _INSIDE)
        self.words = mixed(hashes + seed(lang))
        ends = np.flatnonzero(np.frombuffer(self.data, np.uint8) == _END[0])
        piece = np.searchsorted(ends, self.starts)
        self.near = piece[1:] == piece[:-1]
        self.pairs = mixed(mixed(self.words[:-1] * _A) + self.words[1:])

    def linked(self, bits: np.ndarray, width: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each word: whether it may be frequent, and whether with the next one."""
        single, pair = possible(bits, self.words, width, depth), np.zeros(len(self.words), bool)
        at = np.flatnonzero(self.near & single[:-1] & single[1:])
        pair[at[possible(bits, self.pairs[at], width, depth)]] = True
        return single, pair

    def paired(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the words at some places as words of a pair."""
        return mixed(self.words[at] + _PAIRED)

    def longer(self, pair: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Starts and hashes of the sequences of 3 to ``LONGEST`` words all of whose pairs may be frequent."""
        at = np.flatnonzero(pair)
        h = self.pairs[at]
        for k in range(2, LONGEST):
            on = pair[at + k - 1]
            at, h = at[on], h[on]
            h = mixed(mixed(h * _A) + self.words[at + k])
            yield at, h


def _by_lang(langs: list[str], texts: list[str | None]):
    groups = defaultdict(list)
    for lang, text in zip(langs, texts):
        groups[lang].append(text)
    for lang, own in groups.items():
        w = Words(lang, own)
        if len(w.words):
            yield w, lang


def project(rows: DataFrame, least: int = LEAST, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """``lang, key, n``: how often each sequence of words follows a pointer; ``key`` null counts all words."""
    context = rows.sparkSession.sparkContext
    rows = rows.coalesce(context.defaultParallelism)

    def count_pairs():
        def apply(langs, texts, sketch):
            for w, _ in _by_lang(langs, texts):
                sketch.add(w.words)
                sketch.add(w.pairs[w.near])

        return apply

    short = context.broadcast(reached(rows, count_pairs, width, depth, least, "phrases-sketch"))  # depth * width / 8 bytes

    def count_longer():
        def apply(langs, texts, sketch):
            for w, _ in _by_lang(langs, texts):
                pair = w.linked(short.value, width, depth)[1]
                sketch.add(w.paired(np.flatnonzero(pair | np.r_[False, pair[:-1]])))
                for _, hashes in w.longer(pair):
                    sketch.add(hashes)

        return apply

    long_ = context.broadcast(reached(rows, count_longer, width, depth, least, "phrases-sketch"))  # the same

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, totals = defaultdict(Counter), Counter()

        def emit():
            for lang, counts in held.items():
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64()),
                ], ["lang", "key", "n"])
            held.clear()

        for batch in batches:
            for w, lang in _by_lang(*(c.to_pylist() for c in batch.columns)):
                totals[lang] += len(w.words)
                single, pair = w.linked(short.value, width, depth)
                first = np.flatnonzero(single)
                single[first] = possible(long_.value, w.paired(first), width, depth)
                pair[:-1] &= single[:-1] & single[1:]
                more = pair.astype(np.int64)  # words that follow, at most
                for k, (at, hashes) in enumerate(w.longer(pair), 2):
                    at = at[possible(long_.value, hashes, width, depth)]
                    more[at[more[at] == k - 1]] = k
                first = np.flatnonzero(single)
                data, last = w.data, first + more[first]
                held[lang].update([data[s:e] for s, e in zip(w.starts[first].tolist(), w.ends[last].tolist())])
            if sum(map(len, held.values())) > HELD:
                yield from emit()
        yield from emit()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.string()), pa.array([None] * len(totals), pa.binary()), pa.array(list(totals.values()), pa.int64())],
            ["lang", "key", "n"],
        )

    return rows.mapInArrow(run, "lang string, key binary, n long")


class Growth:
    """Frequent prefixes of one chunk of sorted (key, n), found depth first."""

    def __init__(self, keys: list[bytes], times: list[int], least: int, open_start: bool, open_end: bool):
        self.least, self.open = least, (open_start, open_end)
        self.words = [k.split(_GAP) for k in keys]
        self.length = [len(w) for w in self.words]
        self.total = [0]
        for t in times:
            self.total.append(self.total[-1] + t)
        self.common = [0] * len(keys)  # words at the start that a key shares with the one before
        for i in range(1, len(keys)):
            a, b, k = self.words[i - 1], self.words[i], 0
            for x, y in zip(a, b):
                if x != y:
                    break
                k += 1
            self.common[i] = k
        self.found: list[tuple[bytes, int, int]] = []

    def run(self) -> list[tuple[bytes, int, int]]:
        self.grow(0, len(self.words), 0)
        return self.found

    def grow(self, low: int, high: int, depth: int) -> None:
        """Extends the prefix of ``depth`` words whose pointers are the rows from ``low`` to ``high``."""
        while low < high and self.length[low] == depth:  # pointers after which nothing follows
            low += 1
        while low < high:
            stop = low + 1
            while stop < high and self.common[stop] > depth:
                stop += 1
            support = self.total[stop] - self.total[low]
            cut = (low == 0 and self.open[0]) or (stop == len(self.words) and self.open[1])
            if support >= self.least or cut:
                self.found.append((_GAP.join(self.words[low][:depth + 1]), depth + 1, support))
                self.grow(low, stop, depth + 1)
            low = stop


def supports(projected: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, phrase, words, f`` of every phrase with ``least`` occurrences or more (single words: those of possible pairs)."""
    parts = int(projected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = projected.where("key is not null").repartitionByRange(parts, "lang", "key").sortWithinPartitions("lang", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(lang, keys, times, start, end):
            found = Growth(keys, times, least, start, end).run()
            k, size, f = zip(*found) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([
                pa.array([lang] * len(k), pa.string()), pa.array(map(shown, k), pa.string()), pa.array(size, pa.int32()), pa.array(f, pa.int64()),
            ], ["lang", "phrase", "words", "f"])

        own, keys, times, start = None, [], [], True  # a range's first and last prefixes may go on in another
        for batch in batches:
            for lang, key, n in zip(*(c.to_pylist() for c in batch.columns)):
                if lang != own or len(keys) >= CHUNK:
                    if keys:
                        yield emit(own, keys, times, start, lang == own)
                    start = lang == own or own is None
                    own, keys, times = lang, [], []
                if keys and keys[-1] == key:
                    times[-1] += n
                else:
                    keys.append(key)
                    times.append(n)
        if keys:
            yield emit(own, keys, times, start, True)

    grown = dealt.mapInArrow(run, "lang string, phrase string, words int, f long")
    return grown.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _joined(words: Column, first: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def mine(docs: DataFrame, least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    projected = materialize(project(rows, least), "phrases-projected")
    found = materialize(supports(projected, least), "phrases-supports")
    totals = materialize(projected.where("key is null").groupBy("lang").agg(F.sum("n").alias("n")), "phrases-totals")
    drop_tables(docs.sparkSession, projected)
    candidates = found.where(F.col("words") >= SHORTEST).select("lang", "phrase", "words", F.col("f").alias("a"))
    w, size = F.split("phrase", " "), F.col("words")

    # dropped for a candidate of one word more, at either end, that occurs as often
    inner = candidates.where(size > SHORTEST).select(
        "lang", "a", F.explode(F.array(_joined(w, 1, size - 1), _joined(w, 2, size - 1))).alias("phrase")
    )
    open_ = candidates.join(inner.distinct(), ["lang", "phrase", "a"], "left_anti")

    cuts = open_.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumns({"first": _joined(w, 1, F.col("k")), "rest": _joined(w, F.col("k") + 1, size - F.col("k"))})
    cuts = (
        cuts.join(found.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
        .join(found.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
        .join(totals, "lang")
    )
    exact = lambda c: F.col(c).cast("decimal(17,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (exact("a") * exact("n")), exact("l") * exact("r"))
    cuts = cuts.withColumn("score", score)
    weakest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    scored = weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    # every task keeps its own first ranks before the shuffle (the optimizer's group limit)
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same rows in DuckDB SQL.
ORACLE_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 6) AS s(k) WHERE len(w) >= k)),
f AS (SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
split AS (SELECT *, string_split(phrase, ' ') AS w FROM f),
longer AS (
  SELECT DISTINCT lang, f, array_to_string(w[i:i + j - 1], ' ') AS phrase
  FROM (SELECT lang, f, w, k, j, unnest(range(1, k - j + 2)) AS i FROM split, range(2, 5) AS s(j) WHERE j < k)),
cuts AS (
  SELECT lang, phrase, f AS a, w, k, unnest(range(1, k)) AS c FROM split WHERE k > 1),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.c, x.f AS l, y.f AS r, t.n,
    (1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN totals t USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:c.c], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[c.c + 1:c.k], ' ')),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
open AS (SELECT * FROM weakest w WHERE NOT EXISTS (
  SELECT 1 FROM longer g WHERE g.lang = w.lang AND g.phrase = w.phrase AND 100 * g.f >= 100 * w.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n, score::BIGINT AS score
FROM open QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
