"""Token counts of a SentencePiece BPE model by whole-token shortcuts.

A table is proved offline from the model file: which vocabulary strings the
library encodes alone as one token, and that no piece holds a space mark after
another character, so no merge ever crosses from a word into the next space.  A
text (a space in front, as the model adds) therefore falls into segments "space
marks, then other characters" whose counts add up.  A segment equal to a proved
string counts one; only the rest is merged by the library, once per distinct
segment of a worker.  A line feed that no piece contains is a boundary, too.

Defined results: a null text is an empty one with zero bytes and tokens; each
row is counted alone, so repeated rows, ties and an empty table need no rule;
whole texts are counted, whatever their length.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import Memory, map_texts, utf8

MARK = "▁"
#: Distinct merged segments that a worker remembers.
REMEMBERED = 400_000
_SPACED = re.compile(" +[^ ]*")


def prove_whole_tokens(model) -> tuple[dict[str, int], bool]:
    """Strings (space first) that encode alone as one token, and if "\\n" stands alone.

    Raises ValueError if a piece has a space mark after another character: then
    segments would not be independent.
    """
    pieces = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece holds a space mark after another character")
    words = [p[1:].replace(MARK, " ") for p in pieces if p.startswith(MARK) and p.strip(MARK)]
    counts = map(len, model.encode(words, num_threads=1))
    proved = {" " + w: 1 for w, n in zip(words, counts) if n == 1}
    if model.encode("a ", out_type=str)[-1:] == [MARK]:
        proved[" "] = 1
    alone = not any("\n" in p for p in pieces) and len(model.encode("\n")) == 2
    return proved, alone


class Counter:
    """Counts tokens of whole texts with one model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.proved, self.split_lines = prove_whole_tokens(self.model)
        self.memory = Memory(self._merge, len(self.proved) + REMEMBERED, self.proved)

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; what is neither proved nor remembered is merged in one call."""
        parts = [self._segments(t) for t in texts]
        known = self.memory.look_up([segments for segments, _ in parts])
        return [sum(map(known, segments)) + feeds for segments, feeds in parts]

    def _merge(self, new: list[str]) -> list[int]:
        # The model puts a space mark in front: it stands for the segment's first space,
        # or, before what follows a line feed, comes off again together with the feed.
        spaced = [s[0] == " " for s in new]
        texts = [s[1:] if first else "\n" + s for s, first in zip(new, spaced)]
        counts = map(len, self.model.encode(texts, num_threads=1))
        return [n if first else n - 2 for n, first in zip(counts, spaced)]

    def _segments(self, text: str | None) -> tuple[list[str], int]:
        """Segments of one text, and how many line feeds stand between them."""
        if not text:
            return [], 0
        text = " " + text.replace(MARK, " ")
        if not self.split_lines or "\n" not in text:
            return _spaced(text), 0
        first, *rest = text.split("\n")
        out = _spaced(first)
        for line in rest:
            head, space, tail = line.partition(" ")
            if head:
                out.append(head)
            if space:
                out += _spaced(space + tail)
        return out, len(rest)


def _spaced(text: str) -> list[str]:
    """Segments of a text that starts with a space."""
    if "  " in text:
        return _SPACED.findall(text)
    return [" " + w for w in text[1:].split(" ")]


@lru_cache(maxsize=2)
def shared_counter(path: str) -> Counter:
    """One counter for all tasks of a worker process."""
    return Counter(path)


def count_tokens(
    docs: DataFrame, columns: list[str], schema: str, path: str, limit: int = 4096
) -> DataFrame:
    """``columns`` with UTF-8 bytes, tokens and whether they exceed ``limit``; no shuffle."""

    def make():
        counter = shared_counter(path)

        def apply(texts, *rest):
            tokens = counter.count(texts)
            return [*rest, [len(utf8(t)) for t in texts], tokens, [n > limit for n in tokens]]

        return apply

    extra = ", n_bytes long, n_tokens long, over_limit boolean"
    return map_texts(docs, ["text", *columns], make, schema + extra)
