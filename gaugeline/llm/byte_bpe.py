"""Byte-level BPE encoding and decoding in padded numpy matrices.

Distinct pre-tokens are bucketed by length and become rows of a padded id
matrix.  Each round looks the pairs up in a hash table and every row merges its
leftmost pair of least rank; compaction closes the gap, and rows without a pair
leave.  Pre-tokens longer than ``LONGEST`` bytes take the same merges through a
heap, whose cost doesn't grow with the square of the length.

Defined results: a null text is an empty one and has no ids; texts are encoded
one by one, so repeated rows, ties and an empty table need no rule; whole texts
are encoded.  Lone surrogates can't occur in UTF-8 input.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import BEYOND_LATIN, Memory, latin_pattern, map_texts, utf8

LONGEST = 256
#: Distinct pre-tokens that a worker remembers.
REMEMBERED = 200_000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_NONE = np.int32(2**31 - 1)


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64, space, decimal rank a line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PairTable:
    """Open-addressing hash table from a pair of ids to the rank of their union."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.exact = dict(zip(keys, values))
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, _EMPTY, np.uint64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        left, ranks_left = np.array(keys, np.uint64), np.array(values, np.int32)
        place = self._place(left)
        while len(left):  # each round seats one key for every free slot asked for
            free = self.keys[place] == _EMPTY
            slots, first = np.unique(place[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.keys[slots], self.values[slots] = left[chosen], ranks_left[chosen]
            rest = np.ones(len(left), bool)
            rest[chosen] = False
            left, ranks_left = left[rest], ranks_left[rest]
            place = (place[rest] + 1) & (len(self.keys) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's union; ``_NONE`` where there is none."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        place = self._place(keys)
        found = self.keys[place]
        out = np.where(found == keys, self.values[place], _NONE)
        open_ = np.flatnonzero((found != keys) & (found != _EMPTY))
        while len(open_):
            place[open_] = (place[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[place[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[place[open_[hit]]]
            open_ = open_[~hit & (found != _EMPTY)]
        return out


class Codec:
    """Encodes and decodes with one rank file and one pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = load_ranks(path)
        self.pairs = PairTable(self.ranks)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        # White space by the Unicode property, whatever engine runs the pattern.
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.find_latin = re.compile(latin_pattern(pattern)).findall
        #: Ids of a pre-token, as 32-bit integers.
        self.memory = Memory(self._learn, REMEMBERED)
        digits = [f"{i} ".encode() for i in range(len(self.bytes_of))]
        width = max(map(len, digits))
        self.digits = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in digits), np.uint8).reshape(-1, width)

    def split(self, text: str | None) -> list[str]:
        if not text:
            return []
        return (self.find if BEYOND_LATIN.search(text) else self.find_latin)(text)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        split = list(map(self.split, texts))
        known = self.memory.look_up(split)
        return [np.frombuffer(b"".join(map(known, s)), np.uint32) for s in split]

    def decimal(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by one space."""
        padded = self.digits[ids].ravel()
        return padded[padded != 0].tobytes()[:-1]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def _learn(self, tokens: list[str]) -> list[bytes]:
        data, out = list(map(utf8, tokens)), [b""] * len(tokens)
        buckets: dict[int, list[int]] = {}
        for i, b in enumerate(data):
            whole = self.ranks.get(b)
            if whole is not None:
                out[i] = array("I", (whole,)).tobytes()
            elif len(b) > LONGEST:
                out[i] = array("I", self._merge_long(b)).tobytes()
            else:
                buckets.setdefault((len(b) + 1) // 2, []).append(i)
        for rows in buckets.values():
            for at in range(0, len(rows), 65536):
                part = rows[at:at + 65536]
                for i, ids in zip(part, self._merge_matrix([data[i] for i in part])):
                    out[i] = array("I", ids).tobytes()
        return out

    def _merge_matrix(self, rows: list[bytes]) -> list[list[int]]:
        width = max(map(len, rows))
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        raw = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8)
        ids = self.byte_ids[raw].reshape(len(rows), width)
        rank = self.pairs.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        rank[np.arange(width - 1) >= (lengths - 1)[:, None]] = _NONE
        row, out = np.arange(len(rows)), [None] * len(rows)
        while len(row):
            at = rank.argmin(axis=1)  # the first of equal ranks: the leftmost
            least = rank[np.arange(len(row)), at]
            ended = least == _NONE
            if ended.any():
                for i, r in zip(np.flatnonzero(ended), row[ended]):
                    out[r] = ids[i, : lengths[i]].tolist()
                go = ~ended
                row, ids, rank, lengths, at, least = row[go], ids[go], rank[go], lengths[go], at[go], least[go]
                if not len(row):
                    break
            each = np.arange(len(row))
            ids[each, at] = least
            keep = np.ones(ids.shape, bool)
            keep[each, at + 1] = False
            ids = ids[keep].reshape(len(row), -1)
            rank = rank[keep[:, 1:]].reshape(len(row), -1)  # the merged pair's own rank goes
            lengths = lengths - 1
            if not ids.shape[1] - 1:
                for i, r in enumerate(row):
                    out[r] = ids[i, : lengths[i]].tolist()
                break
            last = ids.shape[1] - 1
            right = at < lengths - 1  # the union has a neighbour on the right
            r, c = each[right], at[right]
            rank[r, c] = self.pairs.ranks(ids[r, c], ids[r, c + 1])
            tail = ~right & (at < last)
            rank[each[tail], at[tail]] = _NONE
            left = at > 0
            r, c = each[left], at[left]
            rank[r, c - 1] = self.pairs.ranks(ids[r, c - 1], ids[r, c])
        return out

    def _merge_long(self, data: bytes) -> list[int]:
        """The same merges for one long pre-token, with a heap of (rank, place)."""
        ids = [int(self.byte_ids[b]) for b in data]
        n, exact = len(ids), self.pairs.exact
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [
            (r, i) for i in range(n - 1) if (r := exact.get(ids[i] << 32 | ids[i + 1])) is not None
        ]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or exact.get(ids[i] << 32 | ids[j]) != rank:
                continue  # outdated
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := exact.get(rank << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := exact.get(ids[h] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, h))
        return [i for i in ids if i >= 0]


@lru_cache(maxsize=2)
def shared_codec(path: str, pattern: str) -> Codec:
    """One codec for all tasks of a worker process."""
    return Codec(path, pattern)


def encode_documents(
    docs: DataFrame, columns: list[str], schema: str, path: str, pattern: str, keep_ids: bool = False
) -> DataFrame:
    """``columns`` with token counts and digests of ids and decoded bytes; no shuffle.

    ``keep_ids`` adds the ids themselves, as little-endian unsigned 32-bit integers.
    """

    def make():
        codec = shared_codec(path, pattern)

        def apply(texts, *rest):
            n, ids_sha, decoded_sha, packed = [], [], [], []
            for ids in codec.encode(texts):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(codec.decimal(ids)).hexdigest())
                decoded_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if keep_ids:
                    packed.append(ids.astype("<u4").tobytes())
            return [*rest, n, ids_sha, decoded_sha, *([packed] if keep_ids else [])]

        return apply

    extra = ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return map_texts(docs, ["text", *columns], make, schema + extra)
