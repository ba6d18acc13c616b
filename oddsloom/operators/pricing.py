"""Model rates, reweighting, price audits and repricing gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oddsloom.operators.running import micros, running


def attack_defence_rates(home_for: Column, home_against: Column, away_for: Column, away_against: Column, league_home: Column, league_away: Column) -> list[Column]:
    """League-normalised attack times the other side's defence."""
    return [league_home * (home_for / league_home) * (away_against / league_home), league_away * (away_for / league_away) * (home_against / league_away)]


def log_adjusted(rate: Column, adjustments: Column) -> Column:
    """A rate times the exponential of the sum of a map's values."""
    return rate * F.exp(F.aggregate(F.map_values(adjustments), F.lit(0.0), lambda s, x: s + x))


def reweighted(matrix: DataFrame, offsets: dict[str, float], strength: float) -> DataFrame:
    """Scores moved by outcome offsets and made to add up again."""
    offset = F.when(F.col("h") > F.col("a"), offsets["home"]).when(F.col("h") == F.col("a"), offsets["draw"]).otherwise(offsets["away"])
    rows = matrix.withColumn("w", F.col("p") * F.exp(offset * strength))
    return rows.select("match_id", "h", "a", (F.col("w") / F.sum("w").over(Window.partitionBy("match_id"))).alias("p"))


def mixed(matrix: DataFrame, low: DataFrame, high: DataFrame, weight: float) -> DataFrame:
    """(1 - w) of a matrix and half of w of each of two others; a score missing in one counts zero."""
    weight = min(weight, 0.15)
    parts = matrix.withColumn("p", F.col("p") * (1 - weight)).union(low.withColumn("p", F.col("p") * (weight / 2))).union(high.withColumn("p", F.col("p") * (weight / 2)))
    return parts.groupBy("match_id", "h", "a").agg(F.sum("p").alias("p"))


def price_audit(prices: DataFrame) -> DataFrame:
    """Expected value and the least acceptable odds of each offer: 8 % above fair, and a floor for uncertain probabilities."""
    p, odds = F.col("probability"), F.col("odds")
    floor = 1.08 / F.greatest(F.lit(0.01), p - 0.075)
    return prices.select("*", F.round(p * odds - 1, 6).alias("ev"), F.round(1 / p, 6).alias("fair_odds"), F.round(floor, 6).alias("least_odds"), (odds >= floor).alias("acceptable"))


def reprice(contracts: DataFrame, live: DataFrame, most_age_seconds: int = 15) -> DataFrame:
    """Decision on each contract from the live quotes of its match, outcome and line.

    Gates in order: no quote, more than one, inactive, unverified, stale, and
    an expected value that is not positive; else a candidate. ``contracts``
    has ``contract_id, match_id, outcome, probability, now``; ``live`` has
    ``match_id, outcome, price, active, verified, ts``.
    """
    matched = contracts.join(live, ["match_id", "outcome"], "left")
    one = matched.groupBy("contract_id").agg(F.count("price").alias("n"), F.min("price").alias("price"), F.min("active").alias("active"), F.min("verified").alias("verified"), F.max("ts").alias("ts"), F.first("probability").alias("probability"), F.first("now").alias("now"))
    age = F.unix_seconds(F.col("now").cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))
    ev = F.col("probability") * F.col("price") - 1
    decision = (
        F.when(F.col("n") == 0, "not_found").when(F.col("n") > 1, "ambiguous").when(~F.col("active"), "inactive").when(~F.col("verified"), "unverified")
        .when(age > most_age_seconds, "stale").when(ev <= 0, "no_bet").otherwise("candidate")
    )
    return one.select("contract_id", F.col("n").alias("quotes"), decision.alias("decision"), F.when(F.col("n") == 1, F.round(ev, 6)).alias("ev"))


def retry_state(attempts: DataFrame, key: str, most: int = 2) -> DataFrame:
    """Where each job stands after its attempts, folded in order: done, waiting for a retry, or given up."""
    ordered = attempts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("attempt", "ok"))).alias("x"))
    start = F.struct(F.lit("pending").alias("state"), F.lit(0).alias("tries"))

    def step(s, x):
        ended = s["state"].isin("done", "failed")
        tries = F.when(ended, s["tries"]).otherwise(s["tries"] + 1)
        state = F.when(ended, s["state"]).when(x["ok"], "done").when(tries >= most, "failed").otherwise("retry")
        return F.struct(state.alias("state"), tries.alias("tries"))

    return ordered.select(key, F.aggregate("x", start, step).alias("s")).select(key, "s.state", "s.tries")


def sticky_verified(quotes: DataFrame, key: str) -> DataFrame:
    """Once a quote of a key was verified, all later ones are."""
    rows = quotes.withColumnRenamed("verified", "told").withColumn("us", micros(F.col("ts")))
    return running(rows, key, "us", ["event_id"], {}, {"verified": F.col("told")}).drop("told", "us")


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str], final: Column) -> DataFrame:
    """Schedules brought up to date: rows that are final stay as they are, others take the new values that are not null."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    keep = F.coalesce(final, F.lit(False))
    return joined.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *[F.when(keep, F.col(f"o.{c}")).otherwise(F.coalesce(f"n.{c}", f"o.{c}")).alias(c) for c in columns], F.when(F.col(f"o.{key}").isNull(), "created").when(keep, "kept").otherwise("updated").alias("change"))


def error_tags(given: Column, hits: dict[str, Column], rank: Column, overridden: Column, actual: Column, checkpoints: Column) -> Column:
    """Tags of a review, without repeats.

    Where the score was missed and the real one has a rank, one tag says why: a
    choice that overrode the model (up to rank 5), or how far down it stood.
    Only without any tag the misses of ``hits`` (``primary, score, total,
    btts``) are named, and missing checkpoints.
    """
    missed = {k: F.coalesce(~v, F.lit(False)) for k, v in hits.items()}
    ranked = missed["score"] & rank.isNotNull()
    place = F.when((rank <= 5) & F.coalesce(overridden, F.lit(False)), "selector_override_error").when(rank <= 5, "score_matrix_top5_miss").when(rank <= 10, "score_matrix_rank_error").otherwise("score_matrix_tail_error")
    given = F.coalesce(given, F.array().cast("array<string>"))
    first = F.when(ranked, F.concat(F.array_remove(given, "score_selector_error"), F.array(place))).otherwise(given)
    chain = F.array_compact(
        F.array(
            F.when(missed["primary"], "direction_error"),
            F.when(missed["primary"] & (actual == "draw"), "draw_underestimated").when(missed["primary"] & (actual == "away"), "away_tail_missed"),
            F.when(missed["score"], "score_selector_error"),
            F.when(missed["total"], "goal_total_error"),
            F.when(missed["btts"], "btts_error"),
            F.when(F.coalesce(checkpoints, F.lit(0)) == 0, "insufficient_snapshots"),
        )
    )
    return F.array_distinct(F.when(F.size(first) > 0, first).otherwise(chain))
