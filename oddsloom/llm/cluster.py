"""Folders that all executors share, checkpoints, sums of counter tables, and connected components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which all executors and the driver share.

    In local mode, where one machine is all there is, its warehouse stands in
    for a folder that isn't named.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/oddsloom-work"
    if not where:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return where.rstrip("/")


def checkpointed(frame: DataFrame) -> DataFrame:
    """Run ``frame`` now and go on from the files of its checkpoint."""
    spark = frame.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return frame.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` as a table in the shared folder and read it again."""
    path = new_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def summed(tables: DataFrame, parts: int, fan_in: int = 64) -> dict[int, np.ndarray]:
    """Sums of fixed-size counter tables that tasks have sent in slices: ``(slice int, part long, counts binary)``.

    ``counts`` is a slice's packed counters and ``part`` the number of the task.
    They are added up in groups of ``fan_in``, so neither a task nor the driver
    ever holds more than so many slices or one table of fixed size.
    """
    shape = "slice int, part long, counts binary"

    def add(table: pa.Table) -> pa.Table:
        total = sum(unpacked(x.as_py()) for x in table.column("counts"))
        return pa.table({"slice": table.column("slice")[:1], "part": table.column("part")[:1], "counts": pa.array([packed(total)], pa.binary())})

    left = max(2, parts)
    while left > 1:
        tables = tables.withColumn("part", F.floor(F.col("part") / fan_in)).groupBy("slice", "part").applyInArrow(add, shape)
        left = -(-left // fan_in)
    return {r["slice"]: unpacked(r["counts"]) for r in tables.collect()}


def packed(counts: np.ndarray) -> bytes:
    """Counters in as few bytes each as the largest one needs."""
    size = next(s for s in (1, 2, 4, 8) if s == 8 or not len(counts) or counts.max() < 1 << (8 * s))
    return bytes([size]) + counts.astype(f"u{size}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"u{data[0]}", offset=1).astype(np.int64)


def sliced(rows: list[np.ndarray]) -> pa.RecordBatch:
    """A task's counter table, row by row, for ``summed``."""
    from pyspark import TaskContext

    return pa.record_batch({"slice": pa.array(range(len(rows)), pa.int32()), "part": pa.array([TaskContext.get().partitionId()] * len(rows), pa.int64()), "counts": pa.array([packed(r) for r in rows], pa.binary())})


#: Up to so many edges a graph is one partition: its steps then need no shuffle.
SMALL_GRAPH = 20_000


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of an undirected graph, as rows ``(id, component)`` for every vertex with an edge.

    ``edges`` has two long columns ``a`` and ``b``; nulls are left out, loops
    and repeats do no harm. ``component`` is the smallest id that can be
    reached. Alternating large-star and small-star steps: each step is a
    grouped minimum and an equi-join, and the rows never outnumber the edges,
    so that a vertex with very many neighbours stays a partial aggregate and a
    join that can be split.
    """
    pairs = edges.where("a is not null and b is not null and a <> b")
    pairs = checkpointed(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def summary(rows: DataFrame):
        return rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()

    state = summary(pairs)
    small_graph = state["n"] <= SMALL_GRAPH
    together = lambda rows: rows.coalesce(1) if small_graph else rows
    pairs = together(pairs)
    for _ in range(rounds):
        both = together(pairs.union(pairs.select("v", "u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = together(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))))
        pairs = together(checkpointed(small.where("u <> v").distinct()))
        seen = summary(pairs)
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    members = pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return members.union(roots)
