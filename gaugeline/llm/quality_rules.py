"""Quality rules as a short-circuit cascade.

Each rule judges one text from lazily computed measures.  On a bounded sample
the cost (seconds) and the selectivity (share rejected) of every rule are
measured, and the rules are put in order of rejections per cost, conditional on
what the rules before them leave.  On the corpus a text leaves the cascade at
its first rejection; later, costlier rules never see it.  The verdict is a
conjunction, so the order (and timing noise in it) never changes a result.

Defined results: a null text has no words and counts as an empty text; it is
rejected by the word-count rule.  Rows are judged one by one, so repeated rows
and ties need no rule, an empty table gives an empty table, and further columns
of the input pass through ``filter_documents`` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from time import perf_counter

import numpy as np
from pyspark.sql import DataFrame

from .common import SPACES, map_texts, sample_texts, utf8

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Measures:
    """Measures of one text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self._kept: dict[str, float] = {}

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        kept = self._kept
        if name not in kept:
            kept[name] = _COMPUTE[name](self)
        return kept[name]


def _dup_lines(m: Measures) -> int:
    seen, dup = set(), 0
    for line in m.data.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    return dup


def _lines(m: Measures) -> int:
    return sum(1 for line in m.data.split(b"\n") if line.strip())


def _repeat_words(m: Measures) -> int:
    """Words inside 8-word windows that occur at least twice (windows doubled 1-2-4-8)."""
    words = m.words
    n = len(words)
    if n <= WINDOW:
        return 0
    number = dict.fromkeys(words)
    if len(number) == n:
        return 0
    for i, w in enumerate(number):
        number[w] = i
    ids, distinct = np.fromiter(map(number.__getitem__, words), np.int64, n), len(number)
    for span in (1, 2, 4):
        keys = ids[:-span] * distinct + ids[span:]
        unique, ids, counts = np.unique(keys, return_inverse=True, return_counts=True)
        distinct = len(unique)
        if distinct == len(keys):
            return 0
    starts = np.flatnonzero(counts[ids] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def _upper_share(m: Measures) -> float:
    """Upper-case share of the ASCII letters."""
    a = np.frombuffer(m.data, np.uint8)
    up = int(((a >= 65) & (a <= 90)).sum())
    low = int(((a >= 97) & (a <= 122)).sum())
    return up / (up + low) if up + low else 0.0


_COMPUTE: dict[str, Callable[[Measures], object]] = {
    "data": lambda m: utf8(m.text),
    "words": lambda m: m.data.split(),
    "n_words": lambda m: len(m.words),
    "word_chars": lambda m: len(m.text) - sum(map(m.text.count, SPACES)),
    "n_symbols": lambda m: sum(map(m.text.count, SYMBOLS)),
    "n_lines": _lines,
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
    "upper_share": _upper_share,
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a text that must go; ``base`` marks the contract's rules."""

    name: str
    rejects: Callable[[Measures], bool]
    base: bool = False


RULES = (
    Rule("few_words", lambda m: m.n_words < 20, True),
    Rule("repeated_windows", lambda m: 100 * m.n_repeat_words > 30 * m.n_words, True),
    Rule("symbols", lambda m: 10 * m.n_symbols > 3 * m.n_words),
    Rule("duplicate_lines", lambda m: m.n_dup_lines >= 4 and 2 * m.n_dup_lines > m.n_lines),
    Rule("word_length", lambda m: not 2 * m.n_words <= m.word_chars <= 20 * m.n_words),
    Rule("shouting", lambda m: m.upper_share > 0.6),
)


def measured(texts: list[str | None], rules: tuple[Rule, ...] = RULES):
    """Which texts each rule rejects, which measures it reads, and seconds a measure and rule.

    A measure's seconds are its own: what it reads of other measures is charged to them.
    """
    seconds: dict[str, float] = dict.fromkeys(_COMPUTE, 0.0)
    reads: list[set[str]] = [set() for _ in rules]
    own, out = [0.0] * len(rules), np.zeros((len(rules), len(texts)), bool)
    for t, text in enumerate(texts):
        for i, rule in enumerate(rules):
            m = Timed(text)
            began = perf_counter()
            out[i, t] = rule.rejects(m)
            own[i] += perf_counter() - began - sum(m.took.values())
            reads[i] |= set(m.took)
            for name, took in m.took.items():
                seconds[name] += took / len(rules)
    # every measure was computed once for each rule that reads it
    for name in seconds:
        seconds[name] *= len(rules) / max(1, sum(name in r for r in reads))
    return out, reads, seconds, own


class Timed(Measures):
    """Measures that keep the seconds each took by itself."""

    def __init__(self, text: str | None):
        super().__init__(text)
        self.took: dict[str, float] = {}

    def __getattr__(self, name: str):
        if name.startswith("_") or name == "took":
            raise AttributeError(name)
        if name in self._kept:
            return self._kept[name]
        began, before = perf_counter(), sum(self.took.values())
        value = super().__getattr__(name)
        self.took[name] = perf_counter() - began - (sum(self.took.values()) - before)
        return value


def order_rules(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> tuple[int, ...]:
    """Indices of ``rules``, greedily by rejections per second on what is left.

    A rule costs its own test and the measures that no rule before it has read.
    """
    out, reads, seconds, own = measured(texts, rules)
    left, order, have = np.ones(len(texts), bool), [], set()

    def cost(i: int) -> float:
        return own[i] + sum(seconds[name] for name in reads[i] - have) + 1e-9

    while len(order) < len(rules):
        rest = [i for i in range(len(rules)) if i not in order]
        best = max(rest, key=lambda i: ((out[i] & left).sum() / cost(i), -cost(i), -i))
        order.append(best)
        have |= reads[best]
        left &= ~out[best]
    return tuple(order)


def plan_cascade(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = 256, chars: int = 65536
) -> tuple[int, ...]:
    """Measure the rules on ``sample_texts``: ``rows`` of at most ``chars`` characters.

    The sample decides the order only; every text meets every rule it needs.
    """
    return order_rules(sample_texts(docs, rows, chars), rules)


def judge(
    docs: DataFrame,
    columns: list[str],
    schema: str,
    rules: tuple[Rule, ...] = RULES,
    order: tuple[int, ...] | None = None,
    report: tuple[str, ...] = (),
) -> DataFrame:
    """``columns`` of every document with the cascade's verdict.

    ``schema`` gives the DDL of ``columns``.  Adds the ``report`` measures, ``base_failed``
    (null unless reporting: it needs all base rules) and ``kept``, which the cascade decides
    before what is reported is measured.
    """
    order = plan_cascade(docs, rules) if order is None else order
    base = [r for r in rules if r.base]
    ordered = [rules[i] for i in order]

    def make():
        def apply(texts, *rest):
            out = [[] for _ in range(len(report) + 2)]
            for text in texts:
                m = Measures(text)
                out[-1].append(not any(r.rejects(m) for r in ordered))
                for values, name in zip(out, report):
                    values.append(getattr(m, name))
                out[-2].append(any(r.rejects(m) for r in base) if report else None)
            return [*rest, *out]

        return apply

    extra = "".join(f", {name} long" for name in report) + ", base_failed boolean, kept boolean"
    return map_texts(docs, ["text", *columns], make, schema + extra)


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents every rule accepts, with all their columns; no shuffle."""
    order = plan_cascade(docs, rules)
    ordered = [rules[i] for i in order]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            keep = []
            for text in texts:
                m = Measures(text)
                keep.append(not any(r.rejects(m) for r in ordered))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
