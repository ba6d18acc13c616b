"""Live events to typed rows: clock, metadata, market definitions and quotes from one nested payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed format: one event's payload.
PAYLOAD = "match_id string, clock struct<status: string, minute: string, home: int, away: int>, meta struct<home: string, away: string, competition: string>, markets array<struct<code: string, name: string, status: int, line: string, selections: array<struct<id: string, name: string, odds: long, display: double, status: int>>>>"


def parsed(events: DataFrame, column: str = "payload") -> DataFrame:
    """Events with their payload as a struct; what can't be read is null."""
    return events.withColumn("p", F.from_json(column, PAYLOAD))


def decimal_odds(raw: Column) -> Column:
    return F.round(raw / 100_000, 5)


def scale_verified(raw: Column, display: Column) -> Column:
    """Whether scaled odds agree with displayed ones, as decimal, fractional or American-style odds."""
    odds = decimal_odds(raw)
    shown = F.when(display > 0, 1 + display).otherwise(1 + 1 / F.abs(display))
    return F.coalesce((F.abs(odds - shown) <= 0.02) | (F.abs(odds - display) <= 0.02), F.lit(False))


def quote_rows(events: DataFrame) -> DataFrame:
    """One row for each selection; a blank line of a score market takes the selection's score."""
    rows = parsed(events).select("event_id", "ts", F.col("p.match_id").alias("match_id"), F.explode("p.markets").alias("m"))
    rows = rows.select("event_id", "ts", "match_id", F.col("m.code").alias("code"), F.col("m.status").alias("market_status"), F.col("m.line").alias("line"), F.explode("m.selections").alias("s"))
    line = F.when((F.coalesce("line", F.lit("")) == "") & F.col("s.name").rlike(r"^\d+[:-]\d+$"), F.replace(F.col("s.name"), F.lit(":"), F.lit("-"))).otherwise(F.col("line"))
    return rows.select("event_id", "ts", "match_id", "code", line.alias("line"), F.col("s.id").alias("selection_id"), F.col("s.name").alias("selection"), decimal_odds(F.col("s.odds")).alias("odds"), scale_verified(F.col("s.odds"), F.col("s.display")).alias("verified"), ((F.col("market_status") == 0) & (F.col("s.status") == 1) & F.col("s.odds").isNotNull()).alias("active"))


def clock_rows(events: DataFrame) -> DataFrame:
    return parsed(events).where("p.clock is not null").select("event_id", "ts", "p.match_id", "p.clock.*")


def metadata_rows(events: DataFrame) -> DataFrame:
    return parsed(events).where("p.meta is not null").select("event_id", "p.match_id", "p.meta.*")


def definition_rows(events: DataFrame) -> DataFrame:
    return parsed(events).select("p.match_id", F.explode("p.markets").alias("m")).select("match_id", F.col("m.code").alias("code"), F.col("m.name").alias("name")).where("name is not null").distinct()
