"""Live quotes as a stream: latest state by key, change capture, deduplication within a watermark.

Sources and sinks are Spark's own; each operator here takes a frame, streaming
or not, so the batch twin of a query is the same code.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dedup(events: DataFrame, columns: list[str], delay: str = "10 minutes") -> DataFrame:
    """One event for each content within the watermark."""
    return events.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*columns)), 256)).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["fingerprint"]).drop("fingerprint")


def windowed_prices(quotes: DataFrame, length: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Quotes and mean price of each match in event-time windows."""
    return quotes.withWatermark("ts", delay).groupBy(F.window("ts", length), "match_id").agg(F.count("*").alias("n"), F.avg("price").alias("mean"))


#: What tells one quote from another.
KEY = ("match_id", "provider", "market", "line", "outcome")
STATE = "price double, changes long, verified boolean"
CHANGES = "match_id long, provider long, market string, line string, outcome string, price double, changes long, verified boolean"
#: State of a key without quotes for so long is dropped.
IDLE = "2 days"


def _changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    price, changes, verified = state.get if state.exists else (None, 0, False)
    newest = 0
    for frame in frames:
        out = []
        for row in frame.sort_values(["ts", "event_id"]).itertuples():
            newest = max(newest, int(row.ts.timestamp() * 1000))
            verified = verified or bool(row.verified)
            if price is None or row.price != price:
                price, changes = row.price, changes + 1
                out.append((*key, price, changes, verified))
        if out:
            yield pd.DataFrame(out, columns=[*KEY, "price", "changes", "verified"])
    state.update((price, changes, verified))
    idle = int(pd.Timedelta(IDLE).total_seconds() * 1000)
    state.setTimeoutTimestamp(max(newest + idle, state.getCurrentWatermarkMs() + 1))


def change_stream(quotes: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Quotes that differ from the state of their key; once a key is verified it stays so.

    A key is a match, provider, market, line and outcome; its state ends when
    the watermark has passed its newest quote by ``IDLE``.
    """
    return quotes.withWatermark("ts", delay).groupBy(*KEY).applyInPandasWithState(_changes, CHANGES, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def latest_state(quotes: DataFrame, key: list[str]) -> DataFrame:
    """The newest quote of each key, in batch and in ``complete`` output."""
    return quotes.groupBy(*key).agg(F.max_by("price", F.struct("ts", "event_id")).alias("price"), F.count("*").alias("quotes"))
