"""Count-min sketches of saturating counters, merged over all tasks, and hashes of byte runs.

A cell counts to 255 and stays there, so a merged cell is the least of 255 and the
true sum: it never underestimates a count below 255.  What a reader needs is only
which cells reach a threshold, one bit a cell; its size is fixed by the parameters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from .common import materialize
from .shingles import _A, _FACTORS, PIECE, mixed

FULL = 255
#: Cells of one block: the unit in which sketches travel.
BLOCK = 1 << 16
#: Hashes that are gathered before cells are touched.
GATHERED = 1 << 20


def hash_runs(data: bytes, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the longest runs of bytes for which ``inside`` (256 flags) holds.

    The hash is a multilinear form with random factors: two given runs of up to 4,096
    bytes agree by a chance of 2**-57 at most; of a longer run the rest counts with one factor.
    """
    starts, ends, hashes, a, at = [], [], [], np.frombuffer(data, np.uint8), 0
    while at < len(a):
        stop = min(len(a), at + PIECE)
        while stop < len(a) and inside[a[stop]]:
            stop += 1
        piece = a[at:stop]
        flags = np.zeros(len(piece) + 2, bool)
        flags[1:-1] = inside[piece]
        edges = np.flatnonzero(flags[1:] != flags[:-1])
        begin, size = edges[::2], edges[1::2] - edges[::2]
        if len(begin):
            first = np.cumsum(size) - size
            place = np.arange(first[-1] + size[-1]) - np.repeat(first, size)
            terms = _FACTORS[np.minimum(place, len(_FACTORS) - 1)] * (piece[flags[1:-1]] + np.uint64(1))
            starts.append(begin + at)
            ends.append(begin + size + at)
            hashes.append(mixed(np.add.reduceat(terms, first) + size.astype(np.uint64) * _A))
        at = stop
    if not starts:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def seed(name: str) -> np.uint64:
    """A 64-bit number of a name, the same everywhere."""
    return np.uint64(xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass")))


def cells(hashes: np.ndarray, width: int, row: int) -> np.ndarray:
    """The cell of each hash in one row of a sketch of ``width`` (a power of two) cells."""
    again = mixed(hashes + np.uint64((row + 1) * int(_A) & 0xFFFFFFFFFFFFFFFF))
    return (again & np.uint64(width - 1)).astype(np.int64)


class Sketch:
    """One task's sketch."""

    def __init__(self, width: int, rows: int):
        self.width, self.rows, self.held, self.size = width, rows, [], 0
        self.count = np.zeros((rows, width), np.uint8)

    def add(self, hashes: np.ndarray, times: np.ndarray | None = None) -> None:
        """Counts every hash once, or ``times`` it."""
        self.held.append((hashes, np.ones(len(hashes), np.int64) if times is None else times))
        self.size += len(hashes)
        if self.size >= GATHERED:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        hashes, times = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        for r in range(self.rows):
            at = cells(hashes, self.width, r)
            order = np.argsort(at)
            at, t = at[order], times[order]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
            if len(first):
                total = np.add.reduceat(t, first) + self.count[r, at[first]]
                self.count[r, at[first]] = np.minimum(total, FULL)

    def blocks(self) -> Iterator[pa.RecordBatch]:
        """The cells that aren't all zero, a block a row, compressed."""
        self.flush()
        pack = zstandard.ZstdCompressor(level=1).compress
        flat = self.count.reshape(-1, min(BLOCK, self.width))
        for i in np.flatnonzero(flat.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([pack(flat[i].tobytes())], pa.binary())], ["block", "cells"])


def reached(rows: DataFrame, make: Callable[[], Callable], width: int, depth: int, least: int, name: str) -> np.ndarray:
    """Packed bits, ``depth * width`` of them: the cells of the merged sketch that reach ``least`` (255 at most).

    ``make()`` runs once a task and gives ``f(columns of a batch, sketch)``, which counts
    into the sketch, and may give back a last call for what it still holds.  Every task
    sends its blocks; tasks that each own some blocks add them up, cell by cell, in bounded memory.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, apply = Sketch(width, depth), make()
        for batch in batches:
            if batch.num_rows:
                apply(*(c.to_pylist() for c in batch.columns), sketch)
        if hasattr(apply, "finish"):
            apply.finish(sketch)
        yield from sketch.blocks()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, total = zstandard.ZstdDecompressor().decompress, {}
        for batch in batches:
            for block, packed in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(unpack(packed), np.uint8)
                known = total.get(block)
                total[block] = part if known is None else np.minimum(known.astype(np.uint16) + part, FULL).astype(np.uint8)
        for block, found in total.items():
            bits = np.packbits(found >= least).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bits], pa.binary())], ["block", "bits"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = rows.mapInArrow(count, "block long, cells binary").repartition(parts, "block")
    merged = materialize(sent.mapInArrow(merge, "block long, bits binary"), name)
    size = min(BLOCK, width) // 8
    out = np.zeros(depth * width // 8, np.uint8)
    for row in merged.collect():  # depth * width / 8 bytes in all
        out[row["block"] * size:(row["block"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def possible(bits: np.ndarray, hashes: np.ndarray, width: int, depth: int) -> np.ndarray:
    """Whether each hash may have reached the threshold; never false for one that has."""
    ok = np.ones(len(hashes), bool)
    for r in range(depth):
        at = cells(hashes, width, r) + r * width
        ok &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return ok
