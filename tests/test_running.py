"""Two-level scans with small slices against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from oddsloom.operators import running


def history(seed=3):
    r = random.Random(seed)
    rows = [(r.choice(["a", "a", "a", "b", None]), i, r.choice([None, *range(40)]) if i % 50 == 0 else r.randrange(40), float(r.randrange(-9, 10)), r.random() < 0.01) for i in range(700)]
    return [(k, i, None if t is None else t * running.UNIT * 3 + i % 3, v, f) for k, i, t, v, f in rows]


def by_key(rows):
    found = {}
    for row in sorted(rows, key=lambda r: (r[2], r[1])):
        found.setdefault(row[0], []).append(row)
    return found


@pytest.fixture(scope="module")
def rows(spark):
    made = [(k, i, running.NEVER if t is None else t, v, f) for k, i, t, v, f in history()]
    return made, spark.createDataFrame(made, "k string, id int, us long, v double, f boolean").repartition(5)


@pytest.mark.parametrize("size", [1, 25, 10**6])
def test_running_sums_and_flags(rows, size):
    made, frame = rows
    cut = running.sliced(frame, "k", "us", size)
    assert cut.count() == len(made) and (size > 700) == (cut.agg(F.max("slice")).first()[0] == 0)
    found = {r["id"]: (r["s"], r["any"]) for r in running.running(frame, "k", "us", ["id"], {"s": F.col("v")}, {"any": F.col("f")}, size).collect()}
    for own in by_key(made).values():
        total, flag = 0.0, False
        for _, i, _, v, f in own:
            total, flag = total + v, flag or f
            assert found[i] == (total, flag)


@pytest.mark.parametrize("size", [1, 25, 10**6])
def test_drawdown(rows, size):
    made, frame = rows
    found = {r["k"]: r["drawdown"] for r in running.largest_drawdown(frame, "k", "us", ["id"], "v", size).collect()}
    for k, own in by_key(made).items():
        total = peak = worst = 0.0
        for row in own:
            total += row[3]
            peak = max(peak, total)
            worst = max(worst, peak - total)
        assert found[k] == worst


@pytest.mark.parametrize("size", [1, 25, 10**6])
def test_next_value(spark, rows, size):
    made, frame = rows
    events = frame.where("id % 3 = 0").select("k", "us", F.col("id").cast("double").alias("v"))
    probes = frame.select("k", (F.col("us") - 7 * running.UNIT).alias("us"), "id")
    found = {r["id"]: (r["next_us"], r["next_value"]) for r in running.next_value(events, probes, "k", "us", "v", size).collect()}
    assert len(found) == len(made)
    for own in by_key(made).values():
        told = sorted((t, float(i)) for _, i, t, _, _ in own if i % 3 == 0)
        for _, i, t, _, _ in own:
            assert found[i] == next(((u, v) for u, v in told if u >= t - 7 * running.UNIT), (None, None))


def test_next_value_reads_each_row_once(spark):
    """No frame reaches forward to a slice's end: Spark reads such a frame anew for each row."""
    events = spark.range(100).selectExpr("id % 2 as k", "id as us", "id as v")
    plan = running.next_value(events, events.selectExpr("k", "us - 5 as us", "v as own"), "k", "us", "v", 20)
    assert "unboundedfollowing" not in plan._jdf.queryExecution().optimizedPlan().toString().lower()
    assert all(r["next_us"] == max(r["us"], r["own"] % 2) for r in plan.collect() if r["us"] % 2 == r["own"] % 2) and plan.count() == 100
