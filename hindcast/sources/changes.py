"""File resolution, change detection, resume and run manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.functions.ids import payload_digest


def list_files(spark: SparkSession, uri: str, pattern: str = "*") -> DataFrame:
    """Files below a folder with modification time; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(uri)
        .select("path", "modificationTime", "length")
    )


def latest_file(files: DataFrame, suffix: str) -> DataFrame:
    """The newest file whose path ends in ``suffix``."""
    return files.where(F.col("path").endswith(suffix)).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def complete_runs(files: DataFrame, required: list[str]) -> DataFrame:
    """Folders that hold every required file, newest first by ``newest``."""
    folder = F.regexp_extract("path", "^(.*)/[^/]+$", 1)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    wanted = F.array(*[F.lit(n) for n in required])
    relevant = files.withColumns({"run_dir": folder, "name": name}).where(F.col("name").isin(required))
    return (
        relevant.groupBy("run_dir").agg(F.collect_set("name").alias("_names"), F.max("modificationTime").alias("newest"))
        .where(F.size(F.array_except(wanted, "_names")) == 0).select("run_dir", "newest")
    )


def payloads(spark: SparkSession, uri: str, pattern: str = "*") -> DataFrame:
    """Raw payload files with their SHA-256."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(uri)
    return raw.select(F.col("path").alias("source"), payload_digest("content").alias("sha256"), "modificationTime")


def changed(current: DataFrame, state: DataFrame) -> DataFrame:
    """Payloads whose digest is not the stored one of their source."""
    return current.join(state.select("source", "sha256"), ["source", "sha256"], "left_anti")


def next_state(state: DataFrame, processed: DataFrame) -> DataFrame:
    """State after processing: new digests replace the stored ones of the same source."""
    kept = state.join(processed.select("source").distinct(), "source", "left_anti")
    return kept.select("source", "sha256").unionByName(processed.select("source", "sha256"))


def pending_tasks(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks without a stored result."""
    return tasks.join(done.select("task_id").distinct(), "task_id", "left_anti")


def latest_per_task(log: DataFrame, order: str = "completed_at") -> DataFrame:
    """Checkpoint log with the newest row per task (S16). ``max_by`` combines map-side, so a task with
    very many log rows is not gathered in one place."""
    rest = [c for c in log.columns if c != "task_id"]
    return log.groupBy("task_id").agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select("task_id", "_r.*")


def step_manifest(steps: DataFrame) -> DataFrame:
    """Roll step documents (step, run_id, rows, ...) up into one run document (S17); differing run ids fail."""
    same = F.when(
        F.count_distinct("run_id") > 1, F.raise_error(F.lit("steps belong to different runs"))
    ).otherwise(F.min("run_id"))
    return steps.agg(
        same.alias("run_id"),
        F.count(F.lit(1)).alias("step_count"),
        F.to_json(F.array_sort(F.collect_list(F.struct("step", "rows", "output_uri")))).alias("steps_json"),
    )
