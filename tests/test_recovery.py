"""Recovery of checkpoints: last quotes before a cutoff, family by family."""

from datetime import datetime

from oddsloom.operators import recovery

HISTORY = "match_id int, company int, family string, ts timestamp, x double, y double, z double"
at = lambda h, m=0: datetime(2026, 7, 19, h, m)


def found(spark, history, listed, cutoff):
    checkpoints = spark.createDataFrame([(m, "T-2H", cutoff) for m in {1, *(r[0] for r in history)}], "match_id int, stage string, cutoff timestamp")
    rows = recovery.as_of_families(checkpoints, spark.createDataFrame(history, HISTORY), spark.createDataFrame(listed, "match_id int, company int, family string"))
    exchange = spark.createDataFrame([(1,)], "match_id int")
    return {r["company"]: r for r in rows.collect()}, {r["match_id"]: r for r in recovery.recovery_summary(checkpoints, rows, exchange).collect()}


def test_the_last_quote_before_the_cutoff_counts(spark):
    history = [(1, 8, "one_x_two", at(18), 2.1, 3.2, 3.4), (1, 8, "one_x_two", at(19), 1.9, 3.3, 3.8), (1, 8, "asian", at(18, 20), -0.5, 0.9, 1.0), (1, 8, "total", at(18, 30), 2.5, 0.88, 1.02)]
    rows, summary = found(spark, history, [(1, 8, f) for f in recovery.FAMILIES], at(18, 45))
    assert rows[8]["one_x_two"]["x"] == 2.1 and rows[8]["snapshots"] == 3
    s = summary[1]
    assert (s["status"], s["companies"], s["exchange"], s["latest_quote"]) == ("recovered", 1, "historical_unavailable", at(18, 30))


def test_companies_and_quotes_after_the_cutoff_are_dropped(spark):
    history = [(1, 1, f, at(22), 2.0, 3.0, 4.0) for f in recovery.FAMILIES] + [(1, 1, "one_x_two", at(23, 59), 9.0, 9.0, 9.0), (1, 2, "one_x_two", at(23, 59), 9.0, 9.0, 9.0), (1, 3, "asian", at(20), 1.0, 1.0, 1.0)]
    listed = [(1, c, f) for c in (1, 2) for f in recovery.FAMILIES] + [(1, 3, "total")]
    rows, summary = found(spark, history, listed, at(23))
    assert rows[1]["one_x_two"]["x"] == 2.0 and 2 not in rows
    # Listed under another family only: its rows count, its quote doesn't.
    assert rows[3]["snapshots"] == 1 and rows[3]["asian"] is None
    assert (summary[1]["one_x_two"], summary[1]["asian"], summary[1]["total"], summary[1]["companies"]) == (1, 1, 1, 1)


def test_one_family_short_is_no_recovery(spark):
    history = [(1, 1, f, at(10), 1.0, 1.0, 1.0) for f in recovery.FAMILIES[:2]] + [(2, 1, "total", at(23, 59), 1.0, 1.0, 1.0)]
    _, summary = found(spark, history, [(m, 1, f) for m in (1, 2) for f in recovery.FAMILIES], at(23))
    assert summary[1]["status"] == summary[2]["status"] == "insufficient_history" and summary[2]["companies"] == 0 and summary[2]["latest_quote"] is None


def test_what_becomes_of_missed_checkpoints(spark):
    shape = "match_id int, stage string, cutoff timestamp, status string"
    now = at(12)
    rows = [(1, "a", at(13), "recovered"), (1, "b", at(11, 56), "insufficient_history"), (1, "c", at(10), "recovered"), (1, "d", at(10), "insufficient_history"), (2, "e", at(10), "insufficient_history"), (3, "f", at(10), "insufficient_history")]
    kickoffs = spark.createDataFrame([(1, at(14)), (2, at(11))], "match_id int, kickoff timestamp")
    from pyspark.sql import functions as F

    outcome = {r["stage"]: r["outcome"] for r in recovery.missed_checkpoints(spark.createDataFrame(rows, shape), kickoffs, F.lit(now)).collect()}
    assert outcome == {"a": "pending", "b": "on_time", "c": "historical_recovery", "d": "late_live", "e": "permanently_missing", "f": "permanently_missing"}
