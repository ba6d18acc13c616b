"""Sinks: immutable runs with a manifest, insert-once logs, current views of histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_run(frame: DataFrame, root: str, run_id: str) -> None:
    """A run's rows under its own folder; an existing run is never overwritten."""
    frame.write.mode("errorifexists").parquet(f"{root}/run_id={run_id}")


def write_manifest(frames: dict[str, DataFrame], root: str, run_id: str) -> DataFrame:
    """Rows and status of each source of a run, appended to the manifest."""
    parts = [f.agg(F.count("*").alias("rows")).select(F.lit(run_id).alias("run_id"), F.lit(name).alias("source"), "rows", F.when(F.col("rows") > 0, "ok").otherwise("empty").alias("status")) for name, f in sorted(frames.items())]
    manifest = parts[0]
    for p in parts[1:]:
        manifest = manifest.union(p)
    manifest.write.mode("append").json(f"{root}/_manifest")
    return manifest


def append_once(spark: SparkSession, new: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the rows whose key the log doesn't have; returns how many."""
    try:
        old = spark.read.parquet(path).select(*keys)
        new = new.join(old, keys, "left_anti")
    except Exception as e:  # a log that isn't there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new = new.dropDuplicates(keys)
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def current(history: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest row of each key."""
    columns = [c for c in history.columns if c != key]
    return history.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r")).select(key, "r.*")
