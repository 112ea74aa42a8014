"""Secret scanning: three patterns and a compression-novelty rule.

The patterns find assignments to secret-like names, access keys and long hex
runs.  The novelty rule takes further tokens in a sensitive context and measures
their marginal compressed bytes: zstandard is primed with a dictionary of
identifiers, those of source code in general and those counted over the whole
corpus, followed by the code around the candidate.  A candidate that
still costs many bytes per character cannot be predicted from either, so it is
reported as ``novel``.

"Around" is a definition, alike in every text: ``AROUND`` characters on either side
prime the compressor, and a token is in a sensitive context if it starts within
``REACH`` characters of a sensitive word on its line.

Defined results: a null text is an empty one and has no spans; offsets count
code points, ends are exclusive; rows are scanned one by one, so repeated rows,
ties and an empty table need no rule.  Whole texts are scanned.  ``redact`` keeps all
columns, whatever their names; it sets ``n_chars`` only where that is an integer column.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import map_texts, utf8

KINDS = ("assign", "access", "hex", "novel")
#: Letters of the names in either case, ASCII only.
_NAMES = ("password", "passwd", "secret", "token", "api", "key")


def _either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" for c in word)


_API_KEY = _either_case("api") + "_?" + _either_case("key")
ASSIGN = re.compile(
    "(" + "|".join([*map(_either_case, _NAMES[:4]), _API_KEY]) + ")"
    + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of 24 and more are the long ones among the maximal runs.
HEX = re.compile(r"[0-9a-f]{24,}")
#: Characters of a candidate at least.
LEAST = 16
_WORD = re.compile(
    r"key|pass|pwd|secret|token|auth|credential|bearer|private|signature|(?<![a-z])sig(?![a-z])",
    re.ASCII | re.IGNORECASE,
)
#: A run may start after "=", so that it can be the value of an unquoted name=value.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-][A-Za-z0-9+/_.=-]{15,}")
#: Characters of the same line between a sensitive word and the start of a run at most.
REACH = 48
_PIECE = re.compile(r"[^=]+=*")
#: Identifiers and words common in source code and configuration (fixed values).
IDENTIFIERS = (
    "string number boolean object array function return import from export class public private "
    "static void const default value values name names type types index count size length "
    "config configuration setting settings environment variable password passwd username user "
    "users secret secrets token tokens api_key apikey access_key secret_key client_id "
    "client_secret authorization authentication bearer basic credential credentials session "
    "cookie header headers request response server service client connection database host "
    "hostname port localhost https http www com org net example documentation version release "
    "2019 2020 2021 2022 2023 2024 2025 0123456789 abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ private_key public_key begin end certificate signature encoded "
    "placeholder changeme your_api_key_here your-token-here xxxxxxxxxxxxxxxx 0000000000000000 "
)
#: Characters of text on either side that prime the compressor.
AROUND = 256
#: Marginal bytes per character from which a candidate counts as incompressible.
NOVELTY = 0.75


_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z_-]{3,}(?![A-Za-z0-9+/])")


#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000


def learn_identifiers(docs: DataFrame, size: int = 8192) -> str:
    """Dictionary text: the corpus's own identifiers, then the common ones.

    Identifiers are letters, "_" and "-" only (a secret with a digit can't enter whole)
    and stand in two texts at least of all documents, whole texts of any length.  Tasks
    count them; ``size`` characters at most reach the driver; the most frequent stand
    last, nearest to what is measured.
    """

    def rows(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    def count(batches):
        found = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    found.update(set(_IDENTIFIER.findall(text)))
                if len(found) >= COUNTED:
                    yield rows(found)
                    found.clear()
        yield rows(found)

    counts = docs.select("text").mapInArrow(count, "word string, n long")
    often = counts.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1 and length(word) < 64")
    out, left = [], size
    for row in often.orderBy(F.desc("n"), "word").limit(size // 5).collect():  # four letters and a gap at least
        left -= len(row["word"]) + 1
        if left < 0:
            break
        out.append(row["word"])
    return " ".join([*out[::-1], IDENTIFIERS])


def marginal_bytes(candidate: str, around: str, identifiers: str = IDENTIFIERS) -> int:
    """Compressed bytes that ``candidate`` adds, given identifiers and nearby text."""
    primed = zstandard.ZstdCompressionDict(
        utf8(identifiers + around), dict_type=zstandard.DICT_TYPE_RAWCONTENT
    )
    packer = zstandard.ZstdCompressor(
        level=9, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    return len(packer.compress(utf8(candidate))) - len(packer.compress(b""))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the three patterns, by start and then kind."""
    found = []
    low = text.lower()
    if any(n in low for n in _NAMES[:5]):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=_place)


def _place(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def candidates(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Stretches of one run to measure: all of it, what follows its first name=, and
    from each piece between "=" (which stays as padding) as many as make ``LEAST``."""
    cuts = [m.start() for m in _PIECE.finditer(text, start, end)] + [end]
    found, j = [(start, end), (cuts[1], end)], 0
    for i in range(len(cuts) - 1):
        while j < len(cuts) and cuts[j] - cuts[i] < LEAST:
            j += 1
        if j == len(cuts):
            break
        found.append((cuts[i], cuts[j]))
    return [c for c in dict.fromkeys(found) if c[1] - c[0] >= LEAST]


def _next_run(text: str, at: int, most: int) -> re.Match | None:
    """The first run that starts from ``at`` to ``most``."""
    while at <= most:
        if run := _RUN.match(text, at):
            return run
        at += 1
    return None


def runs(text: str) -> list[tuple[int, int]]:
    """All runs that start within ``REACH`` of a sensitive word, each from its first such start."""
    first: dict[int, int] = {}
    word, done = _WORD.search(text), 0
    while word:
        at, line = word.end(), text.find("\n", word.end(), word.end() + REACH)
        most = word.end() + REACH if line < 0 else line
        at = max(at, done)  # starts before it are known from the words before
        while at <= most and (run := _next_run(text, at, most)):
            first.setdefault(run.end(), run.start())
            at = done = run.end()
        word = _WORD.search(text, word.start() + 1)
    return [(start, end) for end, start in first.items()]


def merged(spans: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint stretches that ``spans``, in order of their starts, cover."""
    starts, ends = [], []
    for start, end, _ in spans:
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def novel_spans(text: str, known: list[tuple[int, int, str]], identifiers: str = IDENTIFIERS) -> list[tuple[int, int, str]]:
    """Incompressible tokens in a sensitive context that no known span touches."""
    found = []
    starts, ends = merged(known)
    for run in runs(text):
        taken = run[0]
        for start, end in candidates(text, *run):
            before = bisect_left(starts, end) - 1  # the last known stretch that starts before the candidate's end
            if start < taken or (before >= 0 and start < ends[before]):
                continue
            token = text[start:end]
            if not any(c.isdigit() for c in token):  # words cost as many bytes as random letters
                continue
            around = text[max(0, start - AROUND):start] + text[end:end + AROUND]
            if marginal_bytes(token, around, identifiers) >= NOVELTY * len(token):
                found.append((start, end, "novel"))
                taken = end
    return found


def find_spans(text: str | None, identifiers: str = IDENTIFIERS) -> list[tuple[int, int, str]]:
    """All spans ``(start, end, kind)`` of one whole text, by start and then kind."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, identifiers), key=_place)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, columns: list[str], schema: str) -> DataFrame:
    """``columns`` of each document with its spans and their digest; no shuffle of texts."""
    identifiers = learn_identifiers(docs)

    def make():
        def apply(texts, *rest):
            found = [find_spans(t, identifiers) for t in texts]
            base = [[s for s in spans if s[2] != "novel"] for spans in found]
            counts = [[sum(s[2] == k for s in spans) for spans in found] for k in KINDS]
            digest = [hashlib.sha256(joined(b).encode()).hexdigest() for b in base]
            return [*rest, *counts, digest, [joined(s) for s in found]]

        return apply

    extra = ", n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"
    return map_texts(docs, ["text", *columns], make, schema + extra)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """Documents with every span replaced by ``mark``; overlapping spans merge.

    An integer column ``n_chars`` is set to the new length.  Other columns stay.
    """

    identifiers = learn_identifiers(docs)
    counted = "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, IntegralType)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [cut(t, mark, identifiers) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if counted:
                n = batch.schema.get_field_index("n_chars")
                old = batch.column(n).to_pylist()
                new = [o if t is None else len(t) for o, t in zip(old, texts)]
                columns[n] = pa.array(new, batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def cut(text: str | None, mark: str = "[secret]", identifiers: str = IDENTIFIERS) -> str | None:
    """One text with its spans replaced."""
    spans = find_spans(text, identifiers)
    if not spans:
        return text
    out, at, last = [], 0, -1
    for start, end, _ in spans:
        if start >= last:
            out += [text[at:start], mark]
        last = max(last, end)
        at = last
    return "".join([*out, text[at:]])
