"""Contracts out of reports: what a report's first pick and its score pick stand for, with a price that was there before the match.

A report is a row; its price audit, prices and score probabilities are arrays
and structs of that row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.functions.text import parse_score

#: Words of a pick's text for totals, outcomes and handicaps, and of an outcome's labels in a price audit.
OVER, UNDER = "大", "小"
OUTCOMES = {"home": "主胜", "away": "客胜", "draw": "平局"}
HANDICAP_WORDS = ("净胜", "让")
OFFICIAL = "official_spf"

AUDIT = "array<struct<market: string, odds: double, model_probability: double, ev: double, conservative_probability: double, conservative_ev: double>>"


def terms(text: Column) -> Column:
    """A pick's text as ``(market_group, selection, line)``: a total with its line first, then an outcome, then a handicap; else "other"."""
    side = F.regexp_extract(text, rf"([{OVER}{UNDER}])\s*\d", 1)
    line = F.regexp_extract(text, rf"[{OVER}{UNDER}]\s*(\d+(\.\d+)?)", 1).try_cast("double")
    outcome = F.coalesce(*[F.when(F.contains(text, F.lit(word)), key) for key, word in OUTCOMES.items()])
    handicap = F.contains(text, F.lit(HANDICAP_WORDS[0])) | F.contains(text, F.lit(HANDICAP_WORDS[1]))
    total = side != ""
    group = F.when(total, "total").when(outcome.isNotNull(), "1x2").when(handicap, "handicap").otherwise("other")
    selection = F.when(total, F.when(side == UNDER, "under").otherwise("over")).when(outcome.isNotNull(), outcome).when(handicap, "unresolved_handicap")
    return F.struct(group.alias("market_group"), selection.alias("selection"), F.when(total, line).alias("line"))


def _short(number: Column) -> Column:
    """A line as texts write it: without zeros at its end."""
    return F.regexp_replace(F.regexp_replace(number.cast("decimal(10,4)").cast("string"), r"0+$", ""), r"\.$", "")


def primary_contracts(reports: DataFrame) -> DataFrame:
    """``report_id, market_group, selection, line, odds, probability, ev, conservative_ev, price_source`` of each report's first pick.

    ``reports``: ``report_id, primary, audits`` (the price audit, in order),
    ``official`` and ``probabilities`` (structs by outcome). The price is that
    of the first audit row whose label names the contract and that has odds;
    an outcome without one takes the official price, and an expected value
    only where both price and probability are there. A pick without any price
    keeps nulls: it is never priced after the fact. A missing text is no pick.
    """
    rows = reports.withColumn("t", terms(F.coalesce(F.trim("primary"), F.lit(""))))
    by_side = F.when(F.col("t.selection") == "under", UNDER).otherwise(OVER)
    words = F.create_map(*[F.lit(x) for pair in OUTCOMES.items() for x in pair])
    token = F.when(F.col("t.market_group") == "total", F.concat(by_side, _short(F.col("t.line")))).when(F.col("t.market_group") == "1x2", F.try_element_at(words, "t.selection"))
    rows = rows.withColumn("token", token)
    fits = F.filter("audits", lambda x: F.col("token").isNotNull() & F.contains(x["market"], F.col("token")) & F.coalesce(x["odds"] != 0, F.lit(False)))
    rows = rows.withColumn("a", F.get(fits, F.lit(0)))
    of = lambda struct: F.coalesce(*[F.when(F.col("t.selection") == o, F.col(f"{struct}.{o}")) for o in OUTCOMES])
    official = F.col("a").isNull() & (F.col("t.market_group") == "1x2")
    odds, probability = F.when(F.col("a").isNotNull(), F.col("a.odds")).when(official, of("official")), F.when(F.col("a").isNotNull(), F.col("a.model_probability")).when(official, of("probabilities"))
    priced = official & F.coalesce(of("official") != 0, F.lit(False)) & of("probabilities").isNotNull()
    ev = F.when(F.col("a").isNotNull(), F.col("a.ev")).when(priced, of("probabilities") * of("official") - 1)
    source = F.when(F.col("a").isNotNull(), F.col("a.market")).when(priced, OFFICIAL)
    return rows.select("report_id", "t.*", odds.alias("odds"), probability.alias("probability"), ev.alias("ev"), F.col("a.conservative_ev").alias("conservative_ev"), source.alias("price_source"))


def score_contracts(reports: DataFrame) -> DataFrame:
    """``report_id, selection, probability`` of each report that names one score.

    ``reports``: ``report_id, score`` (text), ``scores`` (array of ``score,
    probability``). The probability is that of the first listed row of the
    same score; no price is attached, as a score's price must be captured
    by itself. Reports without a readable score are left out.
    """
    rows = reports.withColumn("s", parse_score(F.col("score"))).where("s is not null")
    same = F.filter("scores", lambda x: F.coalesce(parse_score(x["score"]) == F.col("s"), F.lit(False)))
    return rows.select("report_id", F.concat_ws("-", "s.home", "s.away").alias("selection"), F.get(same, F.lit(0))["probability"].alias("probability"))
