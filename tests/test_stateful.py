"""Keyed state: streams in several micro-batches against plain loops."""

import random
from datetime import datetime, timedelta

from oddsloom.streaming import stateful

START = datetime(2024, 5, 1, 12)


def streamed(spark, tmp_path, parts, shape, step):
    """Run a step over parts, a micro-batch each; rows of all batches."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{tmp_path}/in/part={k:03}")
    found, name = [], f"s{random.randrange(10**9)}"
    # A file a micro-batch, in order of time.
    import os

    files = sorted(os.path.join(d, f) for d, _, fs in os.walk(f"{tmp_path}/in") for f in fs if f.endswith(".parquet"))
    for k, f in enumerate(files):
        os.makedirs(f"{tmp_path}/all", exist_ok=True)
        os.replace(f, f"{tmp_path}/all/{k:03}.parquet")
        os.utime(f"{tmp_path}/all/{k:03}.parquet", (1_700_000_000 + k * 10, 1_700_000_000 + k * 10))
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/all")
    query = step(stream).writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").foreachBatch(lambda df, _: found.extend(df.collect())).start()
    query.awaitTermination()
    return found


EVENTS = "source string, event_id long, ts timestamp, kind string, body string"


def plain_fifo(rows, most):
    kept, stored = {}, []
    for source, event_id, _, kind, body in rows:
        fifo = kept.setdefault(source, [])
        if (kind, body) not in fifo:
            fifo.append((kind, body))
            del fifo[:-most]
            stored.append((source, event_id))
    return sorted(stored, key=str)


def test_a_bounded_number_of_fingerprints_is_remembered(spark, tmp_path):
    r = random.Random(7)
    rows = [(r.choice(["a", "b", None]), i, START + timedelta(seconds=i), r.choice("xy"), r.choice([None, *map(str, range(9))])) for i in range(900)]
    wanted = plain_fifo(rows, 5)
    assert 100 < len(wanted) < 850
    batch = stateful.remembered(spark.createDataFrame(rows, EVENTS).repartition(4), ["kind", "body"], 5).collect()
    assert sorted(((x["source"], x["event_id"]) for x in batch), key=str) == wanted
    found = streamed(spark, tmp_path, [rows[:300], rows[300:310], rows[310:]], EVENTS, lambda s: stateful.remembered(s, ["kind", "body"], 5))
    assert sorted(((x["source"], x["event_id"]) for x in found), key=str) == wanted


def test_an_event_counts_again_after_ten_thousand_others(spark):
    rows = [("s", i, START + timedelta(seconds=i), "k", "first" if i in (0, 9_999, 10_002) else str(i)) for i in range(10_003)]
    found = {x["event_id"] for x in stateful.remembered(spark.createDataFrame(rows, EVENTS), ["kind", "body"]).collect()}
    # Remembered while 9,998 others came, forgotten after 10,000.
    assert 9_999 not in found and 10_002 in found and len(found) == 10_002


CHECKS = "fixture long, event_id long, ts timestamp, final boolean, issue string"


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_retries_wait_and_expire(spark, tmp_path):
    first = [(1, 1, at(0), False, "result_not_final"), (2, 2, at(0), True, None), (3, 3, at(0), False, "result_source_conflict"), (4, 4, at(1), False, "not_found"), (5, 5, at(2), None, None)]
    # Event time passes the retry times; then the second checks; then it passes the end.
    later = [(9, 6, at(90), True, None)]
    second = [(1, 7, at(91), True, None), (3, 8, at(91), False, "result_source_conflict"), (4, 9, at(92), False, "not_found"), (2, 10, at(93), False, "late")]
    end = [(9, 11, at(1700), True, None)]
    last = [(9, 12, at(1800), True, None), (5, 13, at(1800), True, None)]
    found = streamed(spark, tmp_path, [first, later, second, end, last], CHECKS, stateful.retries)
    told = {}
    for r in found:
        told.setdefault(r["fixture"], []).append((r["status"], r["attempts"], int((r["at"] - START).total_seconds() // 60)))
    for v in told.values():
        v.sort(key=lambda x: x[2])
    assert told[1] == [("retry_scheduled", 1, 0), ("retry_due", 1, 45), ("result_verified", 2, 91)]
    assert told[2] == [("result_verified", 1, 0)]
    assert told[3] == [("retry_scheduled", 1, 0), ("retry_due", 1, 45), ("manual_review_required", 2, 91)]
    assert told[4] == [("retry_scheduled", 1, 1), ("retry_due", 1, 46), ("expired_unresolved", 2, 92)]
    assert told[5] == [("retry_scheduled", 1, 2), ("retry_due", 1, 47), ("expired_unresolved", 1, 1442)]
    assert {r["due"] for r in found if r["fixture"] == 1 and r["status"] == "retry_scheduled"} == {at(45)}
    # The batch twin, at several times.
    checks = spark.createDataFrame([*first, *second], CHECKS)
    for minute, wanted in ((10, "retry_scheduled retry_scheduled retry_scheduled retry_scheduled"), (60, "retry_due retry_due retry_due retry_due"), (100, "result_verified manual_review_required expired_unresolved retry_due"), (2000, "result_verified manual_review_required expired_unresolved expired_unresolved")):
        found = {r["fixture"]: r for r in stateful.retry_outcomes(checks, at(minute)).collect()}
        assert [found[k]["status"] for k in (1, 3, 4, 5)] == wanted.split() and found[2]["status"] == "result_verified" and found[2]["attempts"] == 1
    assert found[4]["attempts"] == 2 and found[5]["attempts"] == 1 and found[3]["reason"] == "result_source_conflict"
