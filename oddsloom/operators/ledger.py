"""Staking, settlement and accounts of simulated tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.operators.running import largest_drawdown, micros

#: Bankroll, part of the Kelly stake, largest share, step and least stake.
BANKROLL, KELLY_PART, MOST_SHARE, STEP, LEAST = 100.0, 0.25, 0.05, 0.01, 2.0
GROUPS = ("1x2", "total", "handicap", "score")


def with_stake(tickets: DataFrame) -> DataFrame:
    """A quarter of the Kelly stake, at most 5 % of the bankroll, rounded down to a step; none below the least stake."""
    ev = F.col("probability") * F.col("odds") - 1
    kelly = F.greatest(F.lit(0.0), ev / (F.col("odds") - 1) * KELLY_PART)
    stake = F.round(F.floor((F.least(BANKROLL * kelly, F.lit(BANKROLL * MOST_SHARE)) + 1e-9) / STEP) * STEP, 2)
    status = (
        F.when(F.col("odds").isNull() | F.col("probability").isNull(), "missing_price_or_probability")
        .when(ev <= 1e-12, "rejected_non_positive_ev")
        .when(stake < LEAST, "rejected_below_platform_minimum")
        .otherwise("paper_candidate")
    )
    return tickets.withColumns({"sizing_ev": ev, "sizing_status": status, "stake_units": F.when(status == "paper_candidate", stake).otherwise(0.0)})


def sign(x: Column) -> Column:
    return F.when(x > 1e-9, 1.0).when(x < -1e-9, -1.0).otherwise(0.0)


def result_factor(split_handicaps: bool = False) -> Column:
    """Part of a stake that a ticket wins (1) or loses (-1).

    Totals on quarter lines are settled in two halves; handicaps only with
    ``split_handicaps``.
    """
    h, a, line, s = (F.col(c) for c in ("home_goals", "away_goals", "line", "selection"))
    units = F.round(line * 4)
    odd = (units % 2) != 0
    low, high = F.when(odd, (units - 1) / 4).otherwise(line), F.when(odd, (units + 1) / 4).otherwise(line)
    total = (sign(h + a - low) + sign(h + a - high)) / 2
    side = lambda margin: (sign(margin + low) + sign(margin + high)) / 2 if split_handicaps else sign(margin + line)
    won = lambda c: F.when(c, 1.0).otherwise(-1.0)
    return (
        F.when(h.isNull() | a.isNull(), None)
        .when(s == "home", won(h > a)).when(s == "draw", won(h == a)).when(s == "away", won(h < a))
        .when(s == "over", total).when(s == "under", -total)
        .when(s == "home_handicap", side(h - a)).when(s == "away_handicap", side(a - h))
        .when(s.rlike(r"^\d+-\d+$"), won(s == F.concat_ws("-", h, a)))
    )


def settle(tickets: DataFrame) -> DataFrame:
    """Status, settlement and profit of every staked ticket."""
    rows = tickets.withColumn("factor", result_factor())
    status = (
        F.when(F.col("odds").isNull(), "observed_no_price")
        .when(F.col("sizing_status").startswith("rejected"), "rejected_by_ev")
        .when(F.col("home_goals").isNull(), "pending")
        .when(F.col("factor").isNull(), "observed_no_settlement_rule")
        .otherwise("settled")
    )
    f = F.col("factor")
    label = F.when(f == 1, "win").when(f > 0, "half_win").when(f == 0, "push").when(f > -1, "half_loss").otherwise("loss")
    profit = F.round(F.when(f > 0, F.col("stake_units") * (F.col("odds") - 1) * f).otherwise(F.col("stake_units") * f), 4)
    return rows.withColumn("status", status).withColumns({
        "settlement": F.when(F.col("status") == "settled", label),
        "profit_units": F.when(F.col("status") == "settled", profit).when(F.col("status") == "rejected_by_ev", 0.0),
    }).drop("factor")


def summarise(settled: DataFrame, key: str) -> DataFrame:
    """Account of each ``key``: counts by status, stake, profit, return, hit rate and largest drawdown from the running peak."""
    done = F.col("status") == "settled"
    curve = largest_drawdown(settled.where(done).withColumn("us", micros(F.col("kickoff"))), key, "us", ["ticket_id"], "profit_units")
    drawdown = curve.select(key, F.round("drawdown", 4).alias("max_drawdown"))
    stake, profit = F.sum(F.when(done, F.col("stake_units"))), F.sum(F.when(done, F.col("profit_units")))
    wins, losses = F.count_if(done & (F.col("profit_units") > 0)), F.count_if(done & (F.col("profit_units") < 0))
    sums = settled.groupBy(key).agg(
        F.count_if(done).alias("settled"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "rejected_by_ev").alias("rejected"),
        F.count_if(F.col("status").startswith("observed")).alias("observed"), F.round(stake, 4).alias("stake"), F.round(profit, 4).alias("profit"), F.round(F.round(profit, 4) / F.nullif(F.round(stake, 4), F.lit(0.0)), 6).alias("roi"),
        wins.alias("wins"), losses.alias("losses"), F.round(wins / F.nullif(wins + losses, F.lit(0)), 6).alias("hit_rate"),
    )
    return sums.join(drawdown, key, "left")


def market_group(selection: Column) -> Column:
    return F.when(selection.isin("home", "draw", "away"), "1x2").when(selection.isin("over", "under"), "total").when(selection.contains("handicap"), "handicap").otherwise("score")


def by_group(settled: DataFrame) -> DataFrame:
    """Tickets, stake and profit of each market group and of all together."""
    rows = settled.where("status = 'settled'").withColumn("market_group", market_group(F.col("selection")))
    sums = rows.rollup("market_group").agg(F.count("*").alias("tickets"), F.round(F.sum("stake_units"), 2).alias("stake"), F.round(F.sum("profit_units"), 3).alias("profit"))
    return sums.withColumn("market_group", F.coalesce("market_group", F.lit("all")))


def frozen(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-once: all old tickets and those new ones whose key is not there yet, the earliest of each."""
    first = new.join(old.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.min("ticket_id").alias("ticket_id"))
    return old.select(*keys, "ticket_id").unionByName(first.select(*keys, "ticket_id"))


def coverage_ev(legs: DataFrame) -> DataFrame:
    """Covering n legs with k picks each: tickets k ** n, and the expected return of the whole."""
    return legs.select("*", F.pow("picks", "legs").cast("long").alias("combinations"), F.round(F.pow(F.col("picks") * F.col("gross"), "legs"), 6).alias("gross_factor"))


def best_source(rows: DataFrame, key: str, ranks: dict[str, int]) -> DataFrame:
    """The row of each key from the best-ranked source; the earliest of equals."""
    rank = F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))])[F.col("source")]
    return rows.groupBy(key).agg(F.min_by(F.struct("source", "price", "event_id"), F.struct(F.coalesce(rank, F.lit(99)), "event_id")).alias("b")).select(key, "b.*")


def portfolio_layers(tickets: DataFrame, key: str) -> DataFrame:
    """Tickets and exposure of each layer, with zeros for layers without one, and keys that overlap."""
    layers = ("core", "upside", "watch")
    layer = F.when(F.col("stake_units") >= 4, "core").when(F.col("stake_units") > 0, "upside").otherwise("watch")
    rows = tickets.withColumn("layer", layer)
    wide = rows.groupBy(key).agg(*[x for n in layers for x in (F.count_if(F.col("layer") == n).alias(f"{n}_tickets"), F.round(F.sum(F.when(F.col("layer") == n, F.col("stake_units")).otherwise(0.0)), 2).alias(f"{n}_exposure"))], (F.count("*") > 1).alias("overlap"))
    return wide
