"""Token-id output in a bit-plane shuffled, chunked binary format.

Documents go to shards by range of their id and are encoded there in ascending
order.  A shard is a sequence of chunks of whole documents.  A chunk's ids are
cut into fixed-size blocks; each block is transposed into planes (all bytes of
equal significance together, or all bits), each plane is compressed with
zstandard, and an index holds the place of every plane:

    bytes 0-3   b"GLP1"
    4-7         ids in the chunk          (all integers little-endian, 32 bits)
    8-11        ids in a block
    12-15       planes of a block: 4 (bytes) or 32 (bits)
    16-...      end of each plane's frame, counted from the end of the index
    ...         the frames, block by block, least significant plane first

Chunks are rows of a Parquet table next to their document index (ids and
lengths), so Spark's committer publishes whole files only, whatever executor is
lost or task repeated, on any file system that Spark writes to.  Where a shard
starts in the whole stream is the sum of the shards before it; there are as many
shards as partitions, which bounds that table.

Defined results: a null text is an empty document and still gets its end id;
rows of equal id are ordered by text, nulls first; a null id sorts first.  An
empty table gives empty tables.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BEYOND_LATIN, Memory, latin_pattern, materialize, utf8

MAGIC = b"GLP1"
BLOCK_IDS = 16384
CHUNK_IDS = 1 << 18
#: Distinct words that a worker remembers.
REMEMBERED = 400_000
CHUNKS = "shard int, chunk int, first long, n_ids long, doc_ids array<long>, n_tokens array<long>, data binary"
_SCHEMA = pa.schema(
    [("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
     ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("data", pa.binary())]
)


def pack(ids: np.ndarray, block_ids: int = BLOCK_IDS, bits: bool = False, level: int = 1) -> bytes:
    """Ids (unsigned, 32 bits) in the chunk format."""
    packer, frames = zstandard.ZstdCompressor(level=level), []
    for at in range(0, len(ids), block_ids):
        block = np.ascontiguousarray(ids[at:at + block_ids], "<u4")
        planes = block.view(np.uint8).reshape(-1, 4)
        if bits:
            planes = np.unpackbits(planes, axis=1, bitorder="little")
            frames += [packer.compress(np.packbits(p, bitorder="little").tobytes()) for p in planes.T]
        else:
            frames += [packer.compress(np.ascontiguousarray(p).tobytes()) for p in planes.T]
    ends = np.cumsum([len(f) for f in frames], dtype="<u4").tobytes()
    head = struct.pack("<4sIII", MAGIC, len(ids), block_ids, 32 if bits else 4)
    return b"".join([head, ends, *frames])


def unpack(data: bytes) -> np.ndarray:
    """Ids of one chunk."""
    magic, n, block_ids, n_planes = struct.unpack_from("<4sIII", data)
    if magic != MAGIC:
        raise ValueError("not a chunk of token ids")
    blocks = -(-n // block_ids)
    ends = np.frombuffer(data, "<u4", blocks * n_planes, 16)
    body, start, reader = memoryview(data)[16 + ends.nbytes:], 0, zstandard.ZstdDecompressor()
    out = np.empty(n, "<u4")
    for b in range(blocks):
        part = out[b * block_ids:(b + 1) * block_ids]
        planes = []
        for end in ends[b * n_planes:(b + 1) * n_planes]:
            planes.append(np.frombuffer(reader.decompress(body[start:end]), np.uint8))
            start = int(end)
        if n_planes == 32:
            planes = [np.unpackbits(p, bitorder="little")[: len(part)] for p in planes]
            octets = np.packbits(np.stack(planes, 1), axis=1, bitorder="little")
        else:
            octets = np.stack(planes, 1)
        part[:] = np.ascontiguousarray(octets).view("<u4").ravel()
    return out


class Encoder:
    """Encodes whole texts with a tokenizers file whose pre-tokens never hold white space.

    A text is cut at ASCII white space, which the file's pre-tokenizer drops, and
    each distinct word is encoded by the library once per worker: words that are below
    U+0250 after normalizing and lowering are split here and their pieces merged by the
    library's model, all others (and special strings) pass through its whole pipeline.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        described = json.loads(self.library.to_str())
        kinds = [n["type"] for n in described["normalizer"]["normalizers"]]
        split = described["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"]:
            raise ValueError("not a file that drops white space and lowers")
        self.find = re.compile(latin_pattern(split["pattern"]["Regex"])).findall
        self.mark = os.path.commonprefix(
            [t.content for t in self.library.get_added_tokens_decoder().values()]
        ).encode()
        if not self.mark:
            raise ValueError("special strings without a common start")
        self.alphabet = dict(enumerate(_byte_alphabet()))
        self.pieces: dict[str, bytes] = {}
        self.memory = Memory(self._encode_words, REMEMBERED)

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        out, rest = [b""] * len(words), []
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        for i, word in enumerate(words):
            text = word.decode()
            if not text.isascii():  # the split sees what normalizing and lowering leave
                text = unicodedata.normalize("NFC", text).lower()
                if BEYOND_LATIN.search(text):
                    rest.append(i)
                    continue
            if self.mark in word:
                rest.append(i)
            else:
                out[i] = b"".join(map(self._piece, self.find(text.lower())))
        if rest:
            found = self.library.encode_batch([words[i].decode() for i in rest], add_special_tokens=False)
            for i, e in zip(rest, found):
                out[i] = np.array(e.ids, np.uint32).tobytes()
        return out

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            symbols = piece.encode().decode("latin-1").translate(self.alphabet)
            ids = array("I", [t.id for t in self.library.model.tokenize(symbols)]).tobytes()
            self.pieces[piece] = ids
        return ids

    def _words(self, text: str | None) -> list[bytes]:
        data = utf8(text)
        if data.isascii() and self.mark not in data:
            data = data.lower()
        return data.split()

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        """Ids of each text and the end id, as 32-bit integers."""
        words = list(map(self._words, texts))
        known, last = self.memory.look_up(words), np.uint32(end).tobytes()
        return [b"".join(map(known, w)) + last for w in words]


def _byte_alphabet() -> list[str]:
    """The character by which byte-level files write each byte: itself if printable."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return [chr(b) if b not in others else chr(256 + others.index(b)) for b in range(256)]


@lru_cache(maxsize=2)
def shared_encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(path)


def write_ids(docs: DataFrame, path: str, end: int, name: str = "token-ids", bits: bool = False) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into a table of chunks in the shared folder."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = (
        docs.select("doc_id", "text")
        .repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
        .select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, chunk, first = shared_encoder(path), 0, 0, 0
        held, doc_ids, lengths, size = [], [], [], 0

        def flush():
            data = pack(np.frombuffer(b"".join(held), np.uint32), bits=bits)
            row = ([shard], [chunk], [first], [size], [doc_ids], [lengths], [data])
            return pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(row, _SCHEMA)], schema=_SCHEMA
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column(0)[0].as_py()
            texts = batch.column(2).to_pylist()
            for doc_id, ids in zip(batch.column(1).to_pylist(), encoder.encode(texts, end)):
                if size and size + len(ids) // 4 > CHUNK_IDS:
                    yield flush()
                    chunk, first = chunk + 1, first + size
                    held, doc_ids, lengths, size = [], [], [], 0
                held.append(ids)
                doc_ids.append(doc_id)
                lengths.append(len(ids) // 4)
                size += lengths[-1]
        if held:
            yield flush()

    return materialize(ordered.mapInArrow(run, CHUNKS), name, codec="uncompressed")


def read_ids(chunks: DataFrame) -> DataFrame:
    """Documents of a chunk table: doc_id, start, n_tokens and ids (32-bit integers).

    ``start`` counts the ids of all documents before it.  Chunks hold whole
    documents, so any split of the files reads back alone.
    """
    return _decode(chunks, "ids binary", lambda ids: ids.tobytes(), pa.binary())


def read_digests(chunks: DataFrame) -> DataFrame:
    """Like ``read_ids``, with the CRC-32 of the ids in place of the ids."""
    return _decode(chunks, "ids_crc32 long", lambda ids: zlib.crc32(ids), pa.int64())


def _decode(chunks: DataFrame, column: str, value, kind: pa.DataType) -> DataFrame:
    sums = chunks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("value", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["data"])
                n = np.array(row["n_tokens"], np.int64)
                stops = np.cumsum(n)
                parts = np.split(ids, stops[:-1])
                start = row["base"] + row["first"] + stops - n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(n),
                     pa.array(list(map(value, parts)), kind)], schema=schema
                )

    # One row a shard, at most as many as partitions: a proven bound for the broadcast.
    joined = chunks.join(F.broadcast(base), "shard")
    out = joined.select("base", "first", "doc_ids", "n_tokens", "data").mapInArrow(
        run, "doc_id long, start long, n_tokens long, value " + column.split()[1]
    )
    return out.withColumnRenamed("value", column.split()[0])


def stored(spark: SparkSession, docs: DataFrame, path: str, end: int = 2) -> DataFrame:
    """Write and read back: the round trip that the query reports."""
    return read_digests(write_ids(docs, path, end))
