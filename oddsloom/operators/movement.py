"""Ordered quote histories: as-of lookup, change capture, deduplication, movement between checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_latest(history: DataFrame, cutoffs: DataFrame, keys: list[str], join_key: str) -> DataFrame:
    """The last row of each key at or before its cutoff.

    ``cutoffs`` has ``join_key`` and ``cutoff``. A filter and a grouped
    maximum: no sort of a whole history, and partial maxima before the shuffle.
    """
    rows = history.join(cutoffs, join_key).where("ts <= cutoff")
    return rows.groupBy(*keys).agg(F.max_by(F.struct("price", "ts", "event_id"), F.struct("ts", "event_id")).alias("q")).select(*keys, F.col("q.price").alias("price"), F.col("q.event_id").alias("event_id"))


def changed_rows(rows: DataFrame, keys: list[str], stable: list[str], order: list[str]) -> DataFrame:
    """Rows whose stable columns differ from the row before them in their key; the first row of a key always counts."""
    digest = F.xxhash64(*stable)
    series = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_d", digest).withColumn("_b", F.lag("_d").over(series)).where(~F.col("_d").eqNullSafe(F.col("_b")) | F.col("_b").isNull()).drop("_d", "_b")


def dedup_by_content(rows: DataFrame, content: list[str], order: str) -> DataFrame:
    """One row for each digest of the content columns, with the smallest ``order`` and the number of rows."""
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    return rows.groupBy(digest.alias("fingerprint")).agg(F.min(order).alias(order), F.count("*").alias("copies"))


def checkpoint_movement(points: DataFrame, key: str, value: str, leader: str, order: list[str]) -> DataFrame:
    """First and last value, their difference, and how often the leader changed."""
    series = Window.partitionBy(key).orderBy(*order)
    turned = points.withColumn("turn", (F.col(leader) != F.lag(leader).over(series)).cast("long"))
    at = F.struct(*order)
    return turned.groupBy(key).agg(F.count("*").alias("snapshots"), F.round(F.max_by(value, at) - F.min_by(value, at), 6).alias("delta"), F.coalesce(F.sum("turn"), F.lit(0).cast("long")).alias("reversals"))


def fill_from_secondary(primary: DataFrame, secondary: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """All primary rows, with empty columns filled from the secondary row, and secondary rows of other keys."""
    p, s = primary.alias("p"), secondary.alias("s")
    joined = p.join(s, F.col(f"p.{key}") == F.col(f"s.{key}"), "full_outer")
    empty = lambda c: F.expr(f"nullif(p.{c}, '')")
    return joined.select(F.coalesce(f"p.{key}", f"s.{key}").alias(key), *[F.coalesce(empty(c), F.col(f"s.{c}")).alias(c) for c in columns], F.when(F.col(f"p.{key}").isNull(), "secondary").otherwise("primary").alias("source"))


def reconcile(primary: DataFrame, secondary: DataFrame, key: str, value: str) -> DataFrame:
    """Agreement of two sources on a value."""
    p, s = primary.select(key, F.col(value).alias("v1")), secondary.select(key, F.col(value).alias("v2"))
    status = F.when(F.col("v1").isNull(), "not_final").when(F.col("v2").isNull(), "secondary_missing").when(F.col("v1") == F.col("v2"), "agree").otherwise("conflict")
    return p.join(s, key, "full_outer").select(key, status.alias("status"), F.when(status != "conflict", F.coalesce("v1", "v2")).alias(value))


def survivors(rows: DataFrame, key: str, rank: list, columns: list[str]) -> DataFrame:
    """The row of each key with the highest rank (an ordered list of columns)."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*rank)).alias("r"), F.count("*").alias("rows")).select(key, "rows", *[F.col(f"r.{c}").alias(c) for c in columns])
