"""Lookups with alternatives: OR joins, ranked cascades, defaults, and predicates on rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def or_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], left_key: str, right_key: str) -> DataFrame:
    """Pairs of keys whose rows are equal in any of the column pairs.

    One equi-join for each pair and a distinct union, rather than a join on an
    OR, which Spark can only run as a product.
    """
    parts = [left.join(right, left[a] == right[b]).select(left[left_key].alias(left_key), right[right_key].alias(right_key)) for a, b in pairs]
    return reduce(DataFrame.union, parts).distinct()


def cascade(rows: DataFrame, key: str, candidates: list[DataFrame], value: str) -> DataFrame:
    """Each key's value from the first of several lookups that has one, and which that was.

    A candidate has ``key`` and ``value``; of several values in one the smallest counts.
    """
    ranked = reduce(DataFrame.union, [c.where(F.col(value).isNotNull()).select(key, value, F.lit(i).alias("rank")) for i, c in enumerate(candidates)])
    best = ranked.groupBy(key).agg(F.min(F.struct("rank", value)).alias("b"))
    return rows.select(key).join(best, key, "left").select(key, F.col(f"b.{value}").alias(value), F.col("b.rank").cast("long").alias("source_rank"))


def with_definition(quotes: DataFrame, definitions: DataFrame, match: str, code: str, name: str) -> DataFrame:
    """A quote's definition by match and code, else the general one (match 0) of its code."""
    own = definitions.where(F.col(match) != 0).select(match, code, F.col(name).alias("_own"))
    general = definitions.where(F.col(match) == 0).select(code, F.col(name).alias("_general"))
    joined = quotes.join(own, [match, code], "left").join(general, code, "left")
    return joined.withColumn(name, F.coalesce("_own", "_general")).drop("_own", "_general")


def publishable(home: Column, draw: Column, away: Column, rate: Column) -> Column:
    """A model that may be shown: a positive rate and probabilities that add up to one within .02; nulls may not."""
    return F.coalesce((rate > 0) & (F.abs(home + draw + away - 1) <= 0.02), F.lit(False))


def frozen_window(kickoff: Column, analysed: Column) -> Column:
    """Whether an analysis falls in the 90 to 60 minutes before kickoff; a missing time counts as in, an unreadable one as out."""
    missing = (F.coalesce(F.trim(kickoff.cast("string")), F.lit("")) == "") | (F.coalesce(F.trim(analysed.cast("string")), F.lit("")) == "")
    minutes = (F.unix_seconds(kickoff.cast("string").try_cast("timestamp")) - F.unix_seconds(analysed.cast("string").try_cast("timestamp"))) / 60
    return F.when(missing, True).otherwise(F.coalesce((minutes > 60) & (minutes <= 90), F.lit(False)))


def before_kickoff(kickoff: Column, analysed: Column) -> Column:
    """Whether an analysis is not later than kickoff; a missing or unreadable time counts as so."""
    return F.coalesce(analysed.cast("string").try_cast("timestamp") <= kickoff.cast("string").try_cast("timestamp"), F.lit(True))


#: Words of two-legged and of single knockout rounds.
TWO_LEGS = ("首回合", "次回合", "两回合", "second leg", "first leg", "2nd leg", "1st leg")
KNOCKOUT = ("单回合", "淘汰赛", "决赛", "半决赛", "四分之一决赛", "八分之一决赛", "附加赛", "knockout", "final", "semi-final", "semifinal", "quarter-final", "quarterfinal", "round of 16", "play-off", "playoff")


def knockout(text: Column) -> Column:
    """Whether a competition's text names a knockout round; two-legged ties are none."""
    low = F.lower(text)
    holds = lambda words: reduce(lambda x, y: x | y, [F.contains(low, F.lit(w)) for w in words])
    return ~holds(TWO_LEGS) & holds(KNOCKOUT)


def reject_reason(event: dict[str, Column]) -> Column:
    """Why a live event is not taken, the first of several reasons; null for one that is."""
    return (
        F.when(event["size"] > 1_500_000, "too_large")
        .when(~event["url"].startswith("https://"), "not_https")
        .when(~event["kind"].isin("websocket", "http", "page"), "unknown_source")
        .when(event["at"].try_cast("timestamp").isNull(), "bad_time")
        .when(F.trim(event["payload"]) == "", "empty")
    )


def redacted_keys(values: Column, secret: tuple[str, ...] = ("password", "token", "secret", "cookie", "authorization")) -> Column:
    """A map without its sensitive keys."""
    return F.map_filter(values, lambda k, v: ~F.lower(k).rlike("|".join(secret)))


def regulation_goals(events: DataFrame, key: str) -> DataFrame:
    """Goals of each side up to minute 90 ("90+3" counts as 90), and those of extra time."""
    minute = F.regexp_extract("minute", r"^(\d+)", 1).try_cast("int")
    goal = F.col("kind").isin(1, 7, 8)
    count = lambda side, late: F.count_if(goal & (F.col("side") == side) & ((minute > 90) if late else (minute <= 90)))
    return events.groupBy(key).agg(count("home", False).alias("home_90"), count("away", False).alias("away_90"), count("home", True).alias("home_extra"), count("away", True).alias("away_extra"))
