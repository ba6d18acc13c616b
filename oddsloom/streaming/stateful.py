"""Keyed state with bounds and timers: count-bounded deduplication, and retries that wait and expire by event time.

Streams keep their state in Spark's state store (RocksDB, set by
``use_state_store``); the batch twins give the same rows from all events at
once: deduplication as one pass over events sorted by source and time, whose
memory is the remembered fingerprints, and retries as a fold in the row.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: so many fingerprints of a source are remembered.
REMEMBERED = 10_000
#: Wait before a retry, retries at most, and how long after its first deadline a fixture is left open.
RETRY_AFTER, MOST_RETRIES, OPEN_FOR = timedelta(minutes=45), 1, timedelta(hours=24)
#: Findings that a person has to look at.
FOR_A_PERSON = ("result_source_conflict", "secondary_source_unavailable")


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Remembered(StatefulProcessor):
    """The newest fingerprints of a source, oldest first; meeting one again doesn't make it newer."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fifo = handle.getListState("fifo", "fingerprint string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fifo = dict.fromkeys(r[0] for r in self.fifo.get()) if self.fifo.exists() else {}
        given, stored = pd.concat(list(rows)).sort_values(["ts", "event_id"]), []
        for row in given.itertuples(index=False):
            if _stored(fifo, row.fingerprint, self.most):
                stored.append((*key, row.event_id, row.fingerprint))
        if stored:
            self.fifo.put([(f,) for f in fifo])
        yield pd.DataFrame(stored, columns=["source", "event_id", "fingerprint"])

    def close(self) -> None:
        pass


def remembered(events: DataFrame, columns: list[str], most: int = REMEMBERED) -> DataFrame:
    """``(source, event_id, fingerprint)`` of events, streaming or not, whose content is none of their source's last ``most`` stored ones.

    ``events``: ``source, event_id, ts`` and the columns that make up the
    content. A source's events are taken by time, then id, within a
    micro-batch; its state is ``most`` fingerprints, however long it runs.
    Null counts as a value of a column and as a source.
    """
    shaped = events.select("source", F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias("fingerprint"))
    kind = "source string, event_id long, fingerprint string"
    if events.isStreaming:
        use_state_store(events.sparkSession)
        return shaped.groupBy("source").transformWithStateInPandas(_Remembered(most), kind, "Append", "None")

    def passed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, fifo = object(), {}
        for frame in frames:
            stored = []
            for row in frame.itertuples(index=False):
                if row.source != source:
                    source, fifo = row.source, {}
                stored.append(_stored(fifo, row.fingerprint, most))
            yield frame.loc[stored, ["source", "event_id", "fingerprint"]]

    return shaped.repartition("source").sortWithinPartitions("source", "ts", "event_id").mapInPandas(passed, kind)


def _stored(fifo: dict[str, None], fingerprint: str, most: int) -> bool:
    """Whether a fingerprint is new; if so it is remembered, and the oldest one beyond ``most`` forgotten."""
    if fingerprint in fifo:
        return False
    if len(fifo) >= most:
        del fifo[next(iter(fifo))]
    fifo[fingerprint] = None
    return True


_CHECK = "fixture long, at timestamp, status string, attempts int, due timestamp, reason string"
_COLUMNS = ["fixture", "at", "status", "attempts", "due", "reason"]


class _Retries(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("check", "status string, attempts int, due_ms long, ends_ms long, reason string")

    def _row(self, key, at_ms: int, status: str, attempts: int, due_ms: int | None, reason: str | None) -> tuple:
        stamp = lambda ms: None if ms is None else pd.Timestamp(ms, unit="ms")
        return (*key, stamp(at_ms), status, attempts, stamp(due_ms), reason)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, attempts, due, ends, reason = self.state.get() if self.state.exists() else ("pending", 0, None, None, None)
        given, told = pd.concat(list(rows)).sort_values(["ts", "event_id"]), []
        for row in given.itertuples(index=False):
            now = int(row.ts.timestamp() * 1000)
            if ends is None:
                ends = now + int(OPEN_FOR.total_seconds() * 1000)
                self.handle.registerTimer(ends)
            if status not in ("pending", "retry_scheduled", "retry_due"):
                continue  # an end is an end
            if now >= ends:
                status, due = "expired_unresolved", None
                told.append(self._row(key, ends, status, attempts, None, reason))
                continue
            if due is not None and status == "retry_scheduled":
                self.handle.deleteTimer(due)
                if now >= due:  # the timer would have come first
                    told.append(self._row(key, due, "retry_due", attempts, None, reason))
            attempts += 1
            due, reason = None, row.issue
            if row.final:
                status, reason = "result_verified", None
            elif attempts <= MOST_RETRIES:
                status, due = "retry_scheduled", now + int(RETRY_AFTER.total_seconds() * 1000)
                self.handle.registerTimer(due)
            else:
                status = "manual_review_required" if row.issue in FOR_A_PERSON else "expired_unresolved"
            told.append(self._row(key, now, status, attempts, due, reason))
        self.state.update((status, attempts, due, ends, reason))
        yield pd.DataFrame(told, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        status, attempts, due, ends, reason = self.state.get()
        told = []
        if at == due and status == "retry_scheduled":
            status, due = "retry_due", None
            told.append(self._row(key, at, status, attempts, None, reason))
        if at >= ends and status in ("pending", "retry_scheduled", "retry_due"):
            status, due = "expired_unresolved", None
            told.append(self._row(key, at, status, attempts, None, reason))
        self.state.update((status, attempts, due, ends, reason))
        yield pd.DataFrame(told, columns=_COLUMNS)

    def close(self) -> None:
        pass


def retries(checks: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """What becomes of each fixture's result checks, a row for each change of its state.

    ``checks``: ``fixture, event_id, ts, final`` (whether the result is
    certain) and ``issue``. A check that fails leads to one retry 45 minutes
    later (``retry_due`` when event time has come so far); a second failure,
    or 24 hours after the first check without a result, ends it:
    ``manual_review_required`` for what a person must look at, else
    ``expired_unresolved``. Ended fixtures take no more checks; their state
    is a row, so that a late check can't open them again.
    """
    use_state_store(checks.sparkSession)
    shaped = checks.select(F.col("fixture").cast("long").alias("fixture"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce("final", F.lit(False)).alias("final"), "issue")
    return shaped.withWatermark("ts", delay).groupBy("fixture").transformWithStateInPandas(_Retries(), _CHECK, "Append", "EventTime")


def retry_outcomes(checks: DataFrame, as_of) -> DataFrame:
    """Where each fixture stands at ``as_of`` (a column or literal time) after its checks until then: ``status, attempts, due, reason``.

    The same rules as ``retries``, folded over a fixture's checks in order of
    time and id. What counts are its first checks until an end, so a fixture
    with very many checks keeps only the earliest of them: they are picked in
    a partial aggregate before anything is collected.
    """
    wait, open_for = (int(x.total_seconds()) for x in (RETRY_AFTER, OPEN_FOR))
    when = F.unix_seconds(F.col("ts").cast("timestamp"))
    now = F.unix_seconds(F.lit(as_of).cast("timestamp"))
    shaped = checks.where(when <= now).select("fixture", F.struct(when.alias("at"), F.col("event_id").cast("long").alias("event_id"), F.coalesce("final", F.lit(False)).alias("final"), "issue").alias("c"))
    # After so many checks a fixture has ended, whatever they found.
    first, frames = shaped.groupBy("fixture").agg(F.min("c").alias("c0")), shaped
    for k in range(MOST_RETRIES):
        frames = frames.join(first, "fixture").where(F.col("c") > F.col(f"c{k}")).select("fixture", "c")
        first = first.join(frames.groupBy("fixture").agg(F.min("c").alias(f"c{k + 1}")), "fixture", "left")
    steps = F.filter(F.array(*[F.col(f"c{k}") for k in range(MOST_RETRIES + 1)]), lambda x: x.isNotNull())
    ends = F.col("c0.at") + open_for
    start = F.struct(F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("long").alias("due"), F.lit(None).cast("string").alias("reason"))

    def step(s, x):
        ended = s["status"].isin("result_verified", "manual_review_required", "expired_unresolved") | (x["at"] >= ends)
        tries = s["attempts"] + 1
        failed = F.when(tries <= MOST_RETRIES, "retry_scheduled").when(x["issue"].isin(*FOR_A_PERSON), "manual_review_required").otherwise("expired_unresolved")
        status = F.when(x["final"], "result_verified").otherwise(failed)
        made = F.struct(status.alias("status"), tries.alias("attempts"), F.when(status == "retry_scheduled", x["at"] + wait).alias("due"), F.when(~x["final"], x["issue"]).alias("reason"))
        return F.when(ended, s).otherwise(made)

    rows = first.select("fixture", ends.alias("ends"), F.aggregate(steps, start, step).alias("s"))
    waits = F.col("s.status") == "retry_scheduled"
    status = F.when(waits & (now >= F.col("ends")), "expired_unresolved").when(waits & (now >= F.col("s.due")), "retry_due").otherwise(F.col("s.status"))
    return rows.select("fixture", status.alias("status"), "s.attempts", F.when(status == "retry_scheduled", F.timestamp_seconds("s.due")).alias("due"), "s.reason")
