"""The trap registry: 23 rules that a match's panel can decide, 24 that nothing here can, and what came of them.

A panel has a row for each match and company; all metrics are grouped
aggregates of it. A rule without its fields is not evaluable, never "not
triggered". Companies are known by their ids: one that leads, two that must
confirm it, and the Asian ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids of the leading company, the two others of the core, and the Asian ones.
LEAD, SECOND, THIRD = 1055, 3, 5
CORE, SHARP, ASIAN = (LEAD, SECOND, THIRD), (LEAD, SECOND), (THIRD, 280, 651, 9, 16)

#: Rules of the registry that need what no panel has, and why.
NOT_EVALUABLE = {
    **dict.fromkeys(("EA02", "EA05", "EA10"), "company_ids_unconfirmed"),
    **dict.fromkeys(("EA06", "U01"), "no_structured_counter_evidence"),
    **dict.fromkeys(("EA07", "U11"), "no_narrative_labels"),
    **dict.fromkeys(("EA15", "U14"), "no_referee_data"),
    "EA11": "no_stake_limits", "EA13": "no_suspension_fields", "U02": "history_too_short", "U03": "no_strength_measure", "U05": "no_first_move_chain", "U07": "no_reversal_series", "U10": "too_few_water_frames",
    "U12": "no_suspension_response", "U13": "no_regulator_fields", "U15": "no_news_audit", "U24": "no_debut_field", "U27": "no_clean_sheet_data", "U28": "no_weather_input", "MBI18": "no_third_sharp_source", "MBI19": "no_stillness_check",
}


def _relative(opening: str, current: str) -> Column:
    return F.when(F.col(opening) != 0, (F.col(current) - F.col(opening)) / F.col(opening))


def panel_metrics(panel: DataFrame) -> DataFrame:
    """Metrics of each match from ``match_id, company, open_home, home, open_draw, draw, open_line, line, open_water, water``.

    A price of zero counts as none. Lines count by their depth.
    """
    of = lambda company, c: F.max(F.when(F.col("company") == company, c))
    depth, open_depth = F.abs("line"), F.abs("open_line")
    price = F.when(F.col("home") != 0, F.col("home"))
    within = lambda companies, c: F.when(F.col("company").isin(*companies), c)
    spread = lambda c: F.when(F.count(c) >= 2, F.max(c) - F.min(c))
    moved = F.when(F.col("line") == F.col("open_line"), F.col("water") - F.col("open_water"))
    found = panel.groupBy("match_id").agg(
        of(LEAD, _relative("open_home", "home")).alias("home_change"), of(LEAD, _relative("open_draw", "draw")).alias("draw_change"), of(SECOND, _relative("open_home", "home")).alias("second_change"), of(LEAD, depth - open_depth).alias("line_change"),
        F.median(depth).alias("actual"), F.median(open_depth).alias("opening"), *[of(c, depth).alias(f"core_{k}") for k, c in enumerate(CORE)], spread(within(CORE, depth)).alias("core_line_spread"), spread(within(CORE, price)).alias("core_price_spread"),
        F.abs(F.median(within(SHARP, depth)) - F.median(within(ASIAN, depth))).alias("sharp_asian_gap"), *[of(c, moved).alias(f"water_{k}") for k, c in enumerate(CORE)], F.avg(price).alias("mean_home"),
        F.when(F.count("water") >= 2, F.stddev_pop("water")).alias("water_sigma"),
    )
    outliers = panel.join(found.select("match_id", "mean_home"), "match_id").groupBy("match_id").agg(F.count_if(F.abs(price - F.col("mean_home")) >= 0.10).alias("outliers"))
    return found.join(outliers, "match_id", "left")


def trap_rules() -> dict[str, Column]:
    """Rules over ``panel_metrics`` and ``theory`` (a model's depth), ``shin`` (outcome probabilities), ``mean_current`` (mean home price), ``tiers`` (signals of the home outcome by tier) and ``growth`` (volume ratios)."""
    c = F.col
    fall_and_depth = (c("home_change") <= -0.05) & (c("line_change") <= -0.25)
    h, a = c("home_change"), c("line_change")
    apart = lambda x, y: F.abs(c(x) - c(y)) >= 0.25
    signals = F.filter("tiers", lambda x: x.isNotNull() & (x != 0))
    one_way = F.forall(signals, lambda x: x > 0) | F.forall(signals, lambda x: x < 0)
    waters = [c(f"water_{k}") for k in range(3)]
    together = (F.least(*waters) > 0) | (F.greatest(*waters) < 0)
    # Least and greatest skip nulls; the sum doesn't, so all three must be there.
    all_waters = (waters[0] + waters[1] + waters[2]).isNotNull()
    return {
        "EA01": c("theory") - c("actual") >= 0.25,
        "EA03": F.when((c("draw_change") + c("actual") + c("theory")).isNotNull(), (c("draw_change") <= -0.08) & (c("actual") - c("theory") >= 0.25)),
        "EA04": F.when((h + a).isNotNull(), fall_and_depth),
        "EA08": F.when((h + a).isNotNull(), (h <= -0.05) & (F.abs(a) < 0.01)),
        "EA09": F.when((h + a).isNotNull(), ((h < 0) & (a < 0)) | ((h > 0) & (a > 0))),
        "EA12": c("opening") >= 1.5,
        "EA14": F.when((c("core_0") + c("core_1") + c("core_2")).isNotNull(), apart("core_0", "core_1") & apart("core_0", "core_2") & apart("core_1", "core_2")),
        "U04": F.when(F.size(signals) >= 2, one_way),
        "U06": F.when(c("mean_home").isNotNull(), c("outliers") == 1),
        "U08": F.when((h + a).isNotNull(), fall_and_depth),
        "U09": F.when((h != 0) & (c("second_change") != 0), h * c("second_change") < 0),
        "U16": F.when((h + a).isNotNull(), ((h < 0) & (a <= 0)) | ((h > 0) & (a >= 0))),
        "U17": c("core_line_spread") <= 0.15,
        "U18": c("shin.home") > 0.75,
        "U19": c("shin.draw") > 0.30,
        "U20": c("shin.away") > 0.40,
        "U21": F.abs(h) > 0.15,
        "U22": c("core_price_spread") > 0.30,
        "U23": c("core_line_spread") > 0.50,
        "U25": F.when(all_waters, (F.least(*[F.abs(w) for w in waters]) >= 0.15) & together),
        "U26": F.coalesce(F.nullif("mean_current", F.lit(0.0)), F.lit(99.0)) < 1.25,
        "MBI16": c("sharp_asian_gap") >= 0.25,
        "MBI17": F.when(F.size("growth") > 0, F.exists("growth", lambda x: F.coalesce(x > 2, F.lit(False)))),
    }


#: Rules of a registry at most.
MOST_RULES = 1000


def evaluated(matches: DataFrame, registry: DataFrame) -> DataFrame:
    """``match_id, rule, category, status, reason`` of every registry rule ``(rule, category)`` for every match with metrics."""
    listed = registry.select("rule", "category").distinct().orderBy("rule", "category").limit(MOST_RULES + 1).collect()
    if len(listed) > MOST_RULES:
        raise ValueError(f"a registry has {MOST_RULES} rules at most")
    rules = trap_rules()
    verdict = lambda v: F.when(v, "triggered").when(~v, "not_triggered").otherwise("not_evaluable")
    told = F.create_map(*[x for name, v in rules.items() for x in (F.lit(name), verdict(v))])
    reasons = F.create_map(*[F.lit(x) for pair in NOT_EVALUABLE.items() for x in pair])
    # The registry is a page of rules: it is read once and listed in each row, so nothing is joined.
    each = F.array(*[F.struct(F.lit(r["rule"]).alias("rule"), F.lit(r["category"]).alias("category")) for r in listed])
    rows = matches.select("match_id", told.alias("told"), F.explode(each).alias("r")).select("match_id", "told", "r.*")
    status = F.coalesce(F.try_element_at("told", "rule"), F.lit("not_evaluable"))
    reason = F.when(F.col("rule").isin(*rules), F.when(status == "not_evaluable", "fields_missing")).otherwise(F.coalesce(F.try_element_at(reasons, "rule"), F.lit("no_reliable_judgement")))
    return rows.select("match_id", "rule", "category", status.alias("status"), reason.alias("reason"))


def trap_summary(results: DataFrame) -> DataFrame:
    """Counts of each match: evaluated, triggered, triggered by category, and whether all of the registry could be evaluated."""
    hit = F.col("status") == "triggered"
    open_rules = F.count_if(F.col("status") == "not_evaluable")
    by = {f"triggered_{x.lower()}": F.count_if(hit & (F.col("category") == x)) for x in "ABC"}
    return results.groupBy("match_id").agg((F.count("*") - open_rules).alias("evaluated"), open_rules.alias("not_evaluable"), F.count_if(hit).alias("triggered"), *[v.alias(n) for n, v in by.items()], F.when(open_rules == 0, "completed").otherwise("degraded").alias("calculation_status"))
