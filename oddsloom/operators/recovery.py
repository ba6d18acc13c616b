"""Recovery of missed checkpoints from histories of three families of quotes.

A history row meets its match's cutoffs, a handful each, and is folded at once
into the newest one of its company, family and cutoff: a partial aggregate, so
neither a match with very many quotes nor a company of one is a task of its
own. Prices of today never stand for prices of then: a company that a family
lists without a quote before the cutoff is left out of it, and what the
exchange shows, which has no history, is taken away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.operators.monitor import minutes_to

FAMILIES = ("one_x_two", "asian", "total")


def as_of_families(checkpoints: DataFrame, history: DataFrame, listed: DataFrame) -> DataFrame:
    """The newest quote of each family up to each cutoff: ``match_id, stage, company``, a struct and its time for each family, ``snapshots``.

    ``checkpoints``: ``match_id, stage, cutoff``; ``history``: ``match_id,
    company, family, ts, x, y, z`` (three prices, or a line and two waters);
    ``listed``: ``match_id, company, family``, what a page lists today. A
    family's quote counts only where the page lists the company under it;
    ``snapshots`` counts all its history rows up to the cutoff. Of quotes at
    one time the largest counts. Companies without any such row are left out.
    """
    met = history.join(checkpoints.select("match_id", "stage", "cutoff"), "match_id").where(F.col("ts") <= F.col("cutoff"))
    quote = F.struct("ts", "x", "y", "z")
    newest = met.groupBy("match_id", "stage", "company").agg(F.count("*").alias("snapshots"), *[F.max(F.when(F.col("family") == f, quote)).alias(f) for f in FAMILIES])
    lists = listed.groupBy("match_id", "company").agg(*[F.coalesce(F.bool_or(F.col("family") == f), F.lit(False)).alias(f"_{f}") for f in FAMILIES])
    rows = newest.join(lists, ["match_id", "company"], "left")
    return rows.select("match_id", "stage", "company", "snapshots", *[F.when(F.coalesce(f"_{f}", F.lit(False)), F.col(f)).alias(f) for f in FAMILIES])


def recovery_summary(checkpoints: DataFrame, found: DataFrame, exchange: DataFrame) -> DataFrame:
    """Whether each checkpoint is recovered: only if all three families have a quote; ``exchange`` has ``match_id`` of those with a page of it."""
    any_family = F.greatest(*[F.col(f).isNotNull() for f in FAMILIES])
    counts = found.groupBy("match_id", "stage").agg(
        *[F.count(f).alias(f) for f in FAMILIES], F.count_if(any_family).alias("companies"), F.max(F.greatest(*[F.col(f"{f}.ts") for f in FAMILIES])).alias("latest_quote")
    )
    rows = checkpoints.select("match_id", "stage", "cutoff").join(counts, ["match_id", "stage"], "left").join(exchange.select("match_id", F.lit("historical_unavailable").alias("exchange")).distinct(), "match_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    complete = F.least(*[zero(f) for f in FAMILIES]) > 0
    return rows.select("match_id", "stage", "cutoff", F.when(complete, "recovered").otherwise("insufficient_history").alias("status"), *[zero(f).alias(f) for f in FAMILIES], zero("companies").alias("companies"), "latest_quote", "exchange")


def missed_checkpoints(summary: DataFrame, kickoffs: DataFrame, now: Column) -> DataFrame:
    """What becomes of each checkpoint: pending, on time (five minutes), recovered from history, taken late before kickoff, or missing for good."""
    rows = summary.join(kickoffs.select("match_id", "kickoff"), "match_id", "left")
    late = -minutes_to(F.col("cutoff"), now)
    status = F.when(late < 0, "pending").when(late <= 5, "on_time").when(F.col("status") == "recovered", "historical_recovery").when(now <= F.col("kickoff"), "late_live").otherwise("permanently_missing")
    return rows.select("match_id", "stage", status.alias("outcome"))
