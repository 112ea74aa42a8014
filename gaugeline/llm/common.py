"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the controls 9-13.  On
#: UTF-8 bytes ``bytes.split()`` cuts at exactly those six characters.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of one Arrow batch at most (one longer text is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def configure(spark: SparkSession) -> SparkSession:
    """Set the session options that the operators rely on: small Arrow batches.

    They hold for the whole session; other queries only meet more, smaller batches.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null counts as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def map_texts(
    df: DataFrame, columns: list[str], make: Callable[[], Callable], schema: str
) -> DataFrame:
    """Apply a batch function to some columns of ``df`` in Python workers.

    ``make()`` runs once per task and returns ``f(*columns) -> list of column
    lists``; columns arrive as Python lists, and one output row per list entry
    leaves.  The work is narrow (no shuffle), so a lost executor costs only the
    recomputation of its tasks.
    """
    fields = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            if batch.num_rows:
                out = apply(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, type=f.type) for v, f in zip(out, fields)], schema=fields
                )

    return df.select(*columns).mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share, for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; a temporary folder is set
    only where that is unset and driver and executors are one process (tests).
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.gaugeline.local.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="gaugeline-")
        spark.conf.set("spark.gaugeline.local.dir", found)
    return found


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: committed files outlive any executor.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sample_texts(docs: DataFrame, rows: int, chars: int) -> list[str]:
    """Texts of the ``rows`` documents whose ids come first by a hash, those over ``chars`` characters left out.

    ``rows * chars`` bounds what reaches the driver.  The first pass reads ids alone; the
    second takes one text of each chosen id (nulls among the ids are one id).
    """
    mark = F.xxhash64("doc_id").alias("mark")
    last = docs.select(mark).distinct().orderBy("mark").limit(rows).agg(F.max("mark")).first()[0]
    if last is None:
        return []
    picked = docs.select(mark, "text").where((F.col("mark") <= last) & (F.length("text") <= chars))
    one = picked.groupBy("mark").agg(F.min("text").alias("text"))
    return [r["text"] for r in sorted(one.collect(), key=lambda r: r["mark"])]


def drop_tables(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by ``materialize`` once nothing reads them any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for table in tables:
        for file in table.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(conf).delete(folder, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished, unreferenced plans."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Memory:
    """Values of strings, computed in batches and remembered up to a bound.

    The first ``limit`` distinct strings stay (frequent ones come early); later
    ones are forgotten after their batch, so memory is bounded for any input.
    """

    def __init__(self, compute: Callable[[list[str]], list], limit: int, known: dict | None = None):
        self.compute, self.limit, self.known = compute, limit, dict(known or {})
        self._passing: list[str] = []

    def look_up(self, batch: list[list[str]]) -> Callable:
        """A getter that knows every string of ``batch``, until the next call."""
        for key in self._passing:
            del self.known[key]
        new = set()
        for keys in batch:
            new.update(keys)
        new = list(new.difference(self.known))
        self._passing = new[max(0, self.limit - len(self.known)):]
        if new:
            self.known.update(zip(new, self.compute(new)))
        return self.known.__getitem__


#: Texts below this code point are split by the standard library's faster engine.
LATIN_END = 0x250
BEYOND_LATIN = re.compile(f"[^\\0-{chr(LATIN_END - 1)}]")


def latin_pattern(pattern: str) -> str:
    """``pattern`` for texts below ``LATIN_END``: property classes spelled out."""

    def of(test) -> str:
        hits = [c for c in map(chr, range(LATIN_END)) if test(c)]
        return "".join(map(re.escape, hits))

    classes = {
        r"\p{L}": of(lambda c: unicodedata.category(c)[0] == "L"),
        r"\p{N}": of(lambda c: unicodedata.category(c)[0] == "N"),
        r"\s": of(lambda c: c in "\t\n\x0b\x0c\r \x85\xa0"),
    }
    out, inside = [], False
    for part in re.findall(r"\\p\{\w\}|\\.|.", pattern, re.S):
        if part in classes:
            part = classes[part] if inside else f"[{classes[part]}]"
        elif part == r"\S":
            part = f"[^{classes[chr(92) + 's']}]"
        elif part in "[]":
            inside = part == "["
        out.append(part)
    return "".join(out)
