"""Selection and rule operators: core matches, rule registry, six-dimension score, market intent, timers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Minutes before kickoff of each checkpoint.
CHECKPOINTS = {"T-480M": 480, "T-360M": 360, "T-240M": 240, "T-120M": 120, "T-90M": 90, "T-60M": 60, "T-30M": 30, "T-10M": 10}


def core_selection(rows: DataFrame) -> DataFrame:
    """The day's core matches: best score first, at most two a kickoff, and at most 8, 6 (weekends) or 4 a day.

    ``rows`` has ``day, kickoff, match_num, tier_base, bound, odds_complete``.
    """
    base = F.col("tier_base") + F.when(F.col("bound"), 5).otherwise(0) + F.when(F.col("odds_complete"), 4).otherwise(0)
    fit = rows.withColumn("score", F.least(base, F.lit(100))).where((base >= 82) & F.col("bound"))
    major = F.max((F.col("tier_base") >= 88).cast("int")).over(Window.partitionBy("day"))
    cap = F.when(major == 1, 8).when(F.dayofweek("day").isin(1, 7), 6).otherwise(4)
    order = [F.desc("score"), "kickoff", "match_num"]
    slots = fit.withColumn("cap", cap).withColumn("in_slot", F.row_number().over(Window.partitionBy("day", "kickoff").orderBy(*order))).where("in_slot <= 2")
    chosen = slots.withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy(*order))).where("place <= cap")
    return chosen.select("match_num", "day", "score", F.col("place").cast("long").alias("place"))


def evaluate_rules(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row for each key and rule: triggered, not triggered, or not evaluable where an input is null."""
    listed = F.array(*[F.struct(F.lit(name).alias("rule"), condition.alias("value")) for name, condition in sorted(rules.items())])
    out = rows.select(key, F.explode(listed).alias("r"))
    return out.select(key, F.col("r.rule").alias("rule"), F.when(F.col("r.value"), "triggered").when(~F.col("r.value"), "not_triggered").otherwise("not_evaluable").alias("status"))


def market_rules() -> dict[str, Column]:
    """The rules that quote metrics can decide; columns as in ``oddsloom.operators.quotes.market_metrics``."""
    c = F.col
    return {
        "deep_open": c("asian_open") >= 1.5,
        "line_up_price_flat": (c("asian_line") - c("asian_open") >= 0.25) & (F.abs("lead_change") < 0.05),
        "price_and_line_fall": (c("lead_change") <= -0.05) & (c("asian_line") - c("asian_open") <= -0.25),
        "price_falls_line_still": (c("lead_change") <= -0.05) & (F.abs(c("asian_line") - c("asian_open")) < 0.01),
        "large_price_move": F.abs("lead_change") > 0.15,
        "wide_home_prices": c("home_spread") > 0.30,
        "wide_water": c("water_sigma") > 0.08,
        "high_total": c("total_line") >= 2.0,
    }


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def six_dimensions(rows: DataFrame, key: str) -> DataFrame:
    """Five weighted dimensions on a scale of six, and the action band.

    Inputs: ``subfactor_share, gap, dri, line_spread, triggered, water_sigma,
    p_draw``. As a missing value, zero counts for the gap (.5), the dispersion
    (60) and the draw (.3); nulls are neutral.
    """
    missing = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(d))
    gap = missing("gap", 0.5)
    d1 = F.when(F.col("subfactor_share").isNotNull(), clamp(F.col("subfactor_share"))).otherwise(0.5)
    d2 = clamp(1 - (gap / 0.50 + clamp(missing("dri", 60.0) / 60) / 2 + clamp(F.coalesce("line_spread", F.lit(0.0)) / 0.50)) / 3)
    d3 = clamp(1 - gap / 0.50)
    d4 = clamp(1 - F.col("triggered") / 4)
    d5 = clamp((1 - F.coalesce("water_sigma", F.lit(0.08)) / 0.08 + 1 - missing("p_draw", 0.30) / 0.30) / 2)
    score = F.round((0.25 * d1 + 0.25 * d2 + 0.15 * d3 + 0.15 * d4 + 0.20 * d5) * 6, 6)
    action = F.when(score >= 4.5, "confidence_plus_3pp").when(score >= 3.0, "neutral").when(score >= 2.0, "confidence_minus_3pp").otherwise("skip")
    return rows.select(key, score.alias("score"), action.alias("action"))


def market_intent(rows: DataFrame, key: str) -> DataFrame:
    """Direction of price pressure from four components (a missing one counts 0), and its effect on a model's pick.

    Inputs: ``euro, asian, water, sharp`` in -1 to 1 for home, and ``leader``.
    """
    parts = {"euro": 0.35, "asian": 0.30, "water": 0.15, "sharp": 0.20}
    score = sum((w * F.coalesce(c, F.lit(0.0)) for c, w in parts.items()), F.lit(0.0))
    score = F.round(score, 6)
    direction = F.when(score >= 0.18, "home").when(score <= -0.18, "away").otherwise("neutral")
    aligned = sum((F.when((F.abs(c) >= 0.18) & ((F.col(c) > 0) == (score > 0)), 1).otherwise(0) for c in parts), F.lit(0))
    split = F.greatest(*[F.coalesce(c, F.lit(0.0)) for c in parts]) > 0.18
    split = split & (F.least(*[F.coalesce(c, F.lit(0.0)) for c in parts]) < -0.18)
    confidence = F.when((aligned >= 2) & ~split, "medium").otherwise("low")
    impact = F.when((direction == "neutral") | F.col("leader").isNull(), "observe").when(direction == F.col("leader"), "confirm").otherwise("weaken")
    return rows.select(key, score.alias("score"), direction.alias("direction"), aligned.cast("long").alias("aligned"), confidence.alias("confidence"), impact.alias("impact"))


def due_checkpoints(matches: DataFrame, now: Column) -> DataFrame:
    """Checkpoints that are due at ``now``: planned time passed, at most six hours after kickoff, else missing for good."""
    stages = F.array(*[F.struct(F.lit(k).alias("stage"), F.lit(v).alias("minutes")) for k, v in CHECKPOINTS.items()])
    rows = matches.select("match_id", "kickoff", F.explode(stages).alias("s"))
    planned = F.col("kickoff") - F.make_interval(mins=F.col("s.minutes"))
    late = F.timestamp_diff("MINUTE", planned, now)
    status = F.when(planned > now, "planned").when(F.expr("kickoff + interval 6 hours") < now, "permanently_missing").when(late <= 5, "on_time").otherwise("late")
    return rows.select("match_id", F.col("s.stage").alias("stage"), late.cast("long").alias("minutes_late"), status.alias("status"))
