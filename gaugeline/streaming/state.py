"""Stateful streams: count-based windows with a ring buffer, and tables that take each batch once.

Both survive a stop at any place: state and offsets come back from the checkpoint, and
what a batch writes stands under its number, so a batch that runs again replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

WINDOWS = "series_id string, start long, history array<double>, future array<double>"


#: Microseconds of event time whose rows wait together, arriving rows dealt at once, and windows of one output frame.
SPAN, DEALT, FRAME = 3_600_000_000, 65_536, 4096


class CountWindows(StatefulProcessor):
    """Every ``history`` values and the ``horizon`` after them, of each series in order of (time, id).

    Rows wait until the watermark has passed them, since an earlier one may still come; a
    timer wakes them.  Then they enter a ring of the last ``history + horizon - 1`` values.
    State of a series: that ring, and the rows of the span that the watermark allows to be late,
    in pieces of ``SPAN``.  One piece and one frame of windows are in memory at a time.
    """

    def __init__(self, history: int, horizon: int, span: int = SPAN):
        self.history, self.horizon, self.span = history, horizon, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getValueState("ring", "n long, values array<double>")
        self.waiting = handle.getMapState("waiting", "span long, part long", "us array<long>, id array<long>, value array<double>")
        self.parts = handle.getMapState("parts", "span long", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, held, counts = None, [], {}
        for frame in rows:
            if key[0] is not None and len(frame):
                held.append(frame)
                last = max(int(frame["us"].max()), last if last is not None else int(frame["us"].max()))
                if sum(map(len, held)) >= DEALT:
                    self._wait(pd.concat(held), counts)
                    held = []
        if held:
            self._wait(pd.concat(held), counts)
        for span, parts in counts.items():
            self.parts.updateValue((span,), (parts,))
        if last is not None:
            self.handle.registerTimer(last // 1000 + 1)
        return iter(())

    def _wait(self, rows: pd.DataFrame, counts: dict[int, int]) -> None:
        """Rows into the pieces of their times; ``counts`` has the parts of each piece met so far."""
        for span, piece in rows.groupby(rows["us"] // self.span):
            if span not in counts:
                counts[span] = self.parts.getValue((span,))[0] if self.parts.containsKey((span,)) else 0
            self.waiting.updateValue((span, counts[span]), tuple(piece[c].tolist() for c in ("us", "id", "value")))
            counts[span] += 1

    def _take(self, span: int) -> list[tuple]:
        """The rows of one piece, which leave the state."""
        rows = []
        for part in range(self.parts.getValue((span,))[0]):
            rows += zip(*self.waiting.getValue((span, part)))
            self.waiting.removeKey((span, part))
        self.parts.removeKey((span,))
        return sorted(rows)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due = sorted(k[0] for k in self.parts.keys() if k[0] * self.span < passed)
        n, values = self.ring.get() if self.ring.exists() else (0, [])
        size, held, out = self.history + self.horizon, list(values), []
        for span in due:
            rows = self._take(span)
            ready = [r for r in rows if r[0] // 1000 * 1000 < passed]
            if rest := rows[len(ready):]:  # of the piece that the watermark stands in
                self.waiting.updateValue((span, 0), tuple(map(list, zip(*rest))))
                self.parts.updateValue((span,), (1,))
            for _, _, value in ready:
                held.append(value)
                n += 1
                if len(held) == size:
                    out.append((key[0], n - size, held[:self.history], held[self.history:]))
                    held = held[1:]
                if len(out) == FRAME:
                    yield self._frame(out)
                    out = []
        self.ring.update((n, held))
        if out:
            yield self._frame(out)

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["series_id", "start", "history", "future"])

    def close(self) -> None:
        pass


def count_windows(events: DataFrame, series: str, history: int, horizon: int, late: str = "1 hour") -> DataFrame:
    """Stream of ``series_id, start, history, future`` over events (``series``, ts, event_id, value) that may be ``late``."""
    rows = events.select(
        F.col(series).alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("event_id").alias("id"), "value",
    )
    return rows.withWatermark("ts", late).groupBy("series_id").transformWithStateInPandas(
        CountWindows(history, horizon), outputStructType=WINDOWS, outputMode="append", timeMode="EventTime"
    )


class Stopped(RuntimeError):
    """A stream that was made to stop between writing a batch and committing it."""


def run(stream: DataFrame, checkpoint: str, store: Callable[[DataFrame, int], None], stop_after: int | None = None) -> None:
    """Runs all there is through ``store(batch, number)``; ``stop_after`` breaks off right after that batch was stored."""

    def each(batch: DataFrame, number: int) -> None:
        store(batch, number)
        if stop_after is not None and number >= stop_after:
            raise Stopped(f"after batch {number}")

    spark, name = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(each).start()
        query.awaitTermination()
    except Exception as e:
        if "Stopped" not in str(e):
            raise
    finally:
        spark.conf.set(name, before)


class BatchLog:
    """A table of batches, each a folder of its own: storing a batch again replaces it."""

    def __init__(self, folder: str):
        self.folder = folder

    def store(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/stored/batch={number}")

    def read(self, spark: SparkSession, schema: str) -> DataFrame:
        """All rows with ``batch``, the number of theirs."""
        names = F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(-?\d+)/", 1).cast("long")
        return spark.read.schema(schema).parquet(f"{self.folder}/*/batch=*").withColumn("batch", names)


class UpsertLog(BatchLog):
    """Rows by key, the last batch's counting: a batch costs its own rows, not the table's.

    A reader takes each key's row of the greatest batch.  ``compact`` makes one batch of all but the
    last (which may still be stored again), under the greatest of their numbers; a stop in between changes no result.
    """

    def __init__(self, folder: str, key: str, order: str):
        super().__init__(folder)
        self.key, self.order = key, order

    def store(self, batch: DataFrame, number: int) -> None:
        """The batch's last row of each key by ``order``."""
        columns = [c for c in batch.columns if c != self.key]
        last = batch.groupBy(self.key).agg(F.max_by(F.struct(*columns), self.order).alias("r"))
        super().store(last.select(self.key, "r.*").select(*batch.columns), number)

    def current(self, spark: SparkSession, schema: str, before: int | None = None) -> DataFrame:
        """Each key's last row, of all batches or those ``before`` one."""
        rows = self.read(spark, schema)
        rows = rows if before is None else rows.where(F.col("batch") < before)
        columns = [c for c in rows.columns if c not in (self.key, "batch")]
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*columns), "batch").alias("r"))
        return last.select(self.key, "r.*")

    def pending(self, spark: SparkSession, wanted: DataFrame, schema: str) -> DataFrame:
        """The rows of ``wanted`` whose key no batch has yet: what a resumed run still has to do."""
        return wanted.join(self.read(spark, schema).select(self.key), self.key, "left_anti")

    def compact(self, spark: SparkSession, schema: str) -> None:
        *older, last = sorted(r[0] for r in self.read(spark, schema).select("batch").distinct().collect())  # one a batch
        if len(older) < 2:
            return
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = fs_path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        made, place = fs_path(f"{self.folder}/compacting"), fs_path(f"{self.folder}/compacted/batch={older[-1]}")
        self.current(spark, schema, last).write.mode("overwrite").parquet(made.toString())
        files.mkdirs(place.getParent())
        files.rename(made, place)  # from here on readers see these rows twice, which changes no key's last row
        for n in older:
            files.delete(fs_path(f"{self.folder}/stored/batch={n}"), True)
            if n != older[-1]:
                files.delete(fs_path(f"{self.folder}/compacted/batch={n}"), True)
