"""Review metrics and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum of w * x over the sum of w; 0 without any weight."""
    return F.coalesce(F.sum(weight * value) / F.nullif(F.sum(weight), F.lit(0.0)), F.lit(0.0))


def brier(probabilities: dict[str, Column], actual: Column) -> Column:
    total = F.lit(0.0)
    for name, p in probabilities.items():
        total = total + F.pow(p - F.when(actual == name, 1.0).otherwise(0.0), 2)
    return total


def brier_logloss(rows: DataFrame, key: str) -> DataFrame:
    """Weighted Brier score and log loss by ``key``; rows have ``p_home, p_draw, p_away, actual, weight``."""
    probs = {o: F.col(f"p_{o}") for o in ("home", "draw", "away")}
    hit = F.when(F.col("actual") == "home", F.col("p_home")).when(F.col("actual") == "draw", F.col("p_draw")).otherwise(F.col("p_away"))
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.round(weighted_mean(brier(probs, F.col("actual")), F.col("weight")), 6).alias("brier"), F.round(weighted_mean(-F.log(F.greatest(hit, F.lit(1e-12))), F.col("weight")), 6).alias("log_loss"))


def cut(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def walk_forward(rows: DataFrame, key: str, order: list[str], least: int = 18) -> DataFrame:
    """Walk-forward calibration by ``key``; rows have ``p_home, p_draw, p_away, actual, expected_goals, actual_total, weight``.

    The last min(8, max(5, n // 3)) rows are held out. From the rest come, all
    weighed, the outcome offsets log((actual + .03) / (predicted + .03)),
    centred and cut at +-.35, the shift of the total, cut at +-.5, and a tail
    mix from the residual variance. The held-out rows are scored before and
    after applying .3 of them, or .6 from 40 rows on. Offsets and shift are
    approved each by itself, when its error falls by at least 1 %.
    """
    by = Window.partitionBy(key)
    rows = rows.withColumn("n", F.count("*").over(by)).withColumn("back", F.row_number().over(by.orderBy(*[F.desc(c) for c in order])))
    rows = rows.withColumn("test", F.col("back") <= F.least(F.lit(8), F.greatest(F.lit(5), F.floor(F.col("n") / 3))))
    outcomes, w = ("home", "draw", "away"), F.col("weight")
    mean = lambda x: weighted_mean(x, w)
    residual = F.col("actual_total") - F.col("expected_goals")
    fit = rows.where("not test").groupBy(key).agg(
        *[F.log((mean((F.col("actual") == o).cast("double")) + 0.03) / (mean(F.col(f"p_{o}")) + 0.03)).alias(f"raw_{o}") for o in outcomes],
        F.round(cut(mean(residual), -0.5, 0.5), 6).alias("total_shift"),
        F.round(cut((mean(residual * residual) - 2.5) * 0.03, 0.0, 0.15), 6).alias("tail_mix"),
    )
    centre = (F.col("raw_home") + F.col("raw_draw") + F.col("raw_away")) / 3
    fit = fit.select(key, "total_shift", "tail_mix", *[F.round(cut(F.col(f"raw_{o}") - centre, -0.35, 0.35), 6).alias(f"offset_{o}") for o in outcomes])
    held = rows.where("test").join(fit, key).withColumn("strength", F.when(F.col("n") < 40, 0.3).otherwise(0.6))
    scaled = {o: F.greatest(F.col(f"p_{o}"), F.lit(1e-9)) * F.exp(F.col("strength") * F.col(f"offset_{o}")) for o in outcomes}
    total = scaled["home"] + scaled["draw"] + scaled["away"]
    before, after = brier({o: F.col(f"p_{o}") for o in outcomes}, F.col("actual")), brier({o: scaled[o] / total for o in outcomes}, F.col("actual"))
    out = held.groupBy(key).agg(
        F.max("n").alias("n"), F.count("*").alias("held_out"), F.max("strength").alias("strength"),
        F.round(mean(before), 6).alias("before"), F.round(mean(after), 6).alias("after"),
        F.round(mean(F.abs(residual)), 6).alias("mae_before"), F.round(mean(F.abs(residual - F.col("total_shift") * F.col("strength"))), 6).alias("mae_after"),
        *[F.max(c).alias(c) for c in ("offset_home", "offset_draw", "offset_away", "total_shift", "tail_mix")],
    )
    gain = lambda x, y: F.coalesce((F.col(x) - F.col(y)) / F.nullif(F.col(x), F.lit(0.0)), F.lit(0.0)) >= 0.01
    out = out.withColumns({"direction_approved": gain("before", "after"), "total_approved": gain("mae_before", "mae_after")})
    return out.withColumn("state", F.when(F.col("n") < least, "observing").when(F.col("direction_approved") | F.col("total_approved"), "partial_active").otherwise("shadow_only"))


#: What a review can hit or miss.
DIMENSIONS = ("primary", "outcome", "score", "total", "btts")


def review_windows(rows: DataFrame, order: list[str], sizes: tuple[int, ...] = (5, 10, 20, 40)) -> DataFrame:
    """Hit rates of each dimension over all rows, the last ones, each grade and each version, with the real score's rank.

    Rows have a boolean for each of ``DIMENSIONS`` (null: not settled),
    ``rank`` (of the real score, or null), ``grade`` and ``version``.
    Coverage is the share of ranks up to 3, 5 and 10.
    """
    # The newest rows are a short list, however many rows there are.
    last = rows.orderBy(*[F.desc(c) for c in order]).limit(max(sizes)).withColumn("back", F.row_number().over(Window.orderBy(*[F.desc(c) for c in order])))
    named = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    values = [*DIMENSIONS, "rank"]
    spread = rows.select(*values, F.explode(F.array(named("all", F.lit("all")), named("grade", F.col("grade")), named("version", F.col("version")))).alias("w"))
    recent = last.select(*values, F.explode(F.filter(F.array(*[F.struct(F.lit("last").alias("kind"), F.when(F.col("back") <= k, F.lit(str(k))).alias("value")) for k in sizes]), lambda x: x["value"].isNotNull())).alias("w"))
    sums = []
    for d in DIMENSIONS:
        sums += [F.count(d).alias(f"{d}_settled"), F.count_if(F.col(d)).alias(f"{d}_hits"), F.round(F.avg(F.col(d).cast("double")), 6).alias(f"{d}_rate")]
    sums += [F.round(F.avg((F.col("rank") <= k).cast("double")), 6).alias(f"top{k}") for k in (3, 5, 10)]
    return spread.union(recent).groupBy("w.kind", "w.value").agg(*sums, F.round(F.avg("rank"), 4).alias("mean_rank"))


def rolling(rows: DataFrame, key: str, order: list[str], sizes: tuple[int, ...] = (5, 10, 20, 40)) -> DataFrame:
    """Hit rate of the last rows of each key, for each window size and over all."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    hit = F.col("hit").cast("double")
    return rows.withColumn("back", back).groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("all_time"), *[F.round(F.avg(F.when(F.col("back") <= k, hit)), 6).alias(f"last_{k}") for k in sizes])


def metric_cube(rows: DataFrame, by: list[str]) -> DataFrame:
    """Hit rates over all rows, and by each column alone."""
    sets = rows.groupingSets([[], *[[c] for c in by]], *by).agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"))
    return sets.select(*[F.coalesce(c, F.lit("all")).alias(c) for c in by], "n", "hit_rate")


def form(matches: DataFrame, key: str, order: list[str], last: int = 10) -> DataFrame:
    """Wins, draws, losses and goals of each key's last matches."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    d = F.col("goals_for") - F.col("goals_against")
    return matches.withColumn("back", back).where(F.col("back") <= last).groupBy(key).agg(F.count("*").alias("matches"), F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("draws"), F.count_if(d < 0).alias("losses"), F.sum("goals_for").alias("goals_for"), F.sum("goals_against").alias("goals_against"))


def flow(rows: DataFrame, key: str) -> DataFrame:
    """Bought and sold volume of each side, their net, and its direction."""
    buy, sell = F.sum(F.when(F.col("action") == "buy", F.col("volume")).otherwise(0.0)), F.sum(F.when(F.col("action") == "sell", F.col("volume")).otherwise(0.0))
    out = rows.groupBy(key).agg(F.round(buy, 4).alias("buy"), F.round(sell, 4).alias("sell"), F.round(buy - sell, 4).alias("net"), F.count("*").alias("n"))
    return out.withColumn("direction", F.when(F.col("net") > 0, "in").when(F.col("net") < 0, "out").otherwise("flat"))


def evidence_grade(missing: Column, checkpoints: Column) -> Column:
    """Grade and weight of a prediction's evidence."""
    grade = F.when((missing == 0) & (checkpoints >= 4), "A").when((missing <= 2) & (checkpoints >= 2), "B").otherwise("C")
    return F.struct(grade.alias("grade"), F.when(grade == "A", 1.0).when(grade == "B", 0.7).otherwise(0.4).alias("weight"))
