"""File sources and sinks: CSV, JSON lines, Parquet, metadata and their contracts."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import numbered

# The phases of a curriculum and the stages each one trains on.
PHASES = {"stage1": ("easy",), "stage12": ("easy", "medium"), "stage123": ("easy", "medium", "hard"), "full": None}


def scratch(spark: SparkSession, name: str) -> str:
    """A folder for files that a query writes: shared where the cluster names one, temporary in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return os.path.join(folder or tempfile.mkdtemp(prefix="gaugeline-"), f"{name}-{os.urandom(8).hex()}")


def read_csv(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A CSV table with a header; ValueError if it lacks a required column."""
    header = spark.read.csv(path, header=True).columns
    missing = [c for c in required if c not in header]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)


def first_rows(rows: DataFrame, order: str, n: int, columns: list[str]) -> DataFrame:
    """The first ``n`` rows by ``order``; ValueError where there are fewer."""
    if rows.limit(n).count() < n:
        raise ValueError(f"fewer than {n} rows")
    return numbered(rows.select(*columns), order, name="pos").where(F.col("pos") < n)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines don't count."""
    return spark.read.schema(schema).json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects with ``line``, the zero-based number among the lines that aren't blank, in file order."""
    raw = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    raw = raw.where(F.trim("value") != "")
    placed = numbered(raw, "file_path", "file_block_start", "at", name="line")
    return placed.select("line", F.from_json("value", schema).alias("o")).select("line", "o.*")


def keyed(rows: DataFrame, key: str, fallback: str | None = None, order: str = "line", default_to_line: bool = False) -> DataFrame:
    """The last row of each key, which is ``key``, else ``fallback``, else (if asked) the line; negative keys are skipped."""
    parts = [F.col(key), *([F.col(fallback)] if fallback else []), *([F.col("line")] if default_to_line else [])]
    k = rows.withColumn("_key", F.coalesce(*(p.cast("long") for p in parts))).where("_key >= 0")
    last = k.groupBy("_key").agg(F.max_by(F.struct(*rows.columns), order).alias("r"))
    return last.select("_key", "r.*")


def read_stage(spark: SparkSession, path: str, stage: str, column: str = "turn_stage") -> DataFrame:
    """Rows of one stage, in any case; ValueError where there is none."""
    rows = spark.read.parquet(path).where(F.lower(column) == stage.lower())
    if rows.isEmpty():
        raise ValueError(f"no rows of stage {stage}")
    return rows


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Writes JSON lines and returns how many; ``mode`` append serves as a debug log."""
    from pyspark.sql import Observation

    seen = Observation()
    rows.observe(seen, F.count("*").alias("n")).write.mode(mode).json(path)
    return seen.get["n"]


def write_checked(rows: DataFrame, path: str, bad: DataFrame | None = None) -> None:
    """Writes Parquet once ``bad`` (rows that break a rule) is known to be empty; ValueError otherwise."""
    if bad is not None and not bad.isEmpty():
        raise ValueError("rows break the contract")
    rows.write.mode("overwrite").parquet(path)


def write_generations(rows: DataFrame, path: str) -> None:
    """One folder of JSON lines a step."""
    rows.write.mode("append").partitionBy("step").json(path)


def write_metadata(spark: SparkSession, payload: dict, path: str) -> None:
    """Pretty JSON, written by Spark so that any of its file systems serves."""
    text = json.dumps(payload, indent=2, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    found = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).limit(1).collect()))
    if not isinstance(found, dict):
        raise ValueError("metadata must be an object")
    return found


def check_metadata(payload: dict, kinds: set[str], stages: set[str] | None = None) -> dict:
    """The payload, if its kind (and stage) is expected; ValueError otherwise."""
    kind, stage = (str(payload.get(k) or "").strip() for k in ("dataset_kind", "pipeline_stage"))
    if kind not in kinds:
        raise ValueError(f"kind {kind or 'missing'}, expected one of {sorted(kinds)}")
    if stages is not None and stage not in stages:
        raise ValueError(f"stage {stage or 'missing'}, expected one of {sorted(stages)}")
    return payload


def check_multivariate(payload: dict, features: list[str], target: str, protocol: str) -> dict:
    """The payload, if it names exactly these features in order, their number, the target and the protocol."""
    found = [str(f).strip() for f in payload.get("observed_feature_columns") or []]
    wrong = [
        name for name, ok in (
            ("historical_data_protocol", payload.get("historical_data_protocol") == protocol), ("observed_feature_columns", found == features),
            ("observed_covariates", [str(c) for c in payload.get("observed_covariates") or []] == [f for f in features if f != target]),
            ("target_column", payload.get("target_column") == target), ("model_input_width", payload.get("model_input_width") == len(features)),
        ) if not ok
    ]
    if wrong:
        raise ValueError(f"metadata breaks the contract in {wrong}")
    return payload


def parse_phases(phases: str | list[str] | None) -> list[str]:
    """Names of known phases, trimmed, lowered, each once, in order; ValueError for an unknown one."""
    parts = phases.split(",") if isinstance(phases, str) else phases or []
    names = [p for p in (str(x).strip().lower() for x in parts) if p]
    unknown = [n for n in names if n not in PHASES]
    if unknown:
        raise ValueError(f"unknown phases {unknown}")
    return list(dict.fromkeys(names))


def phase_rows(rows: DataFrame, phase: str | None, training: bool, stage: str = "curriculum_stage") -> DataFrame:
    """Rows a phase trains on: a predicate on stages instead of a file each.

    Training on all of a staged table needs the phase ``full`` said in words.
    """
    if not phase:
        if training:
            raise ValueError("name a phase to train on a staged table")
        return rows
    stages = PHASES[parse_phases(phase)[0]]
    return rows if stages is None else rows.where(F.col(stage).isin(*stages))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and length of every file, with its name and its folder's."""
    files = spark.read.format("binaryFile").load(path)
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -1).alias("file"), F.element_at(parts, -2).alias("folder"), F.sha2("content", 256).alias("sha256"), "length")
