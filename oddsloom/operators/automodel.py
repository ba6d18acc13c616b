"""The automatic pre-match model: rates from form and market, a calibrated score grid, one formal score with a challenger.

A match is a row and stays one: its grid is an array of 169 cells, the market's
share of the goals is found by bisection inside the row, dispersion and
direction corrections map over the array, and the scenario candidates are the
top of a constrained list held in the row. Nothing is shuffled or exploded.

Edge cases: a match without form of either side or without market
probabilities has no model (all results null); a missing total line falls back
to the form's own total, a missing handicap leaves its component out; a
calibration that is missing, inactive or of another family changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.operators.model import grid_sums, nearest_share, pmf, settled_line
from oddsloom.operators.scores import held

FAMILY = "recent_form_market_calibrated_poisson_v2"
OUTCOMES = ("home", "draw", "away")
#: Weights and bounds of the fusion.
FORM_WEIGHT, FORM_SHARE_WEIGHT = 0.60, 0.65
FORM_TOTAL, TOTAL, SHARE = (1.2, 4.2), (1.0, 4.8), (0.15, 0.85)
MOST_STRENGTH, MOST_TAIL = 0.6, 0.15
LOW_TAIL, HIGH_TAIL = 0.65, 1.45
#: What a candidate score needs of the grid's peak, and the weights of its seven components.
NEEDED, CANDIDATES = 0.42, 8
WEIGHTS = {"matrix": 0.55, "model": (0.18, -0.12), "total": 0.14, "btts": (0.08, -0.04), "market": (0.10, -0.05), "handicap": 0.10, "script": (0.04, -0.03)}
REACH = 1.75
CONFIDENT, LIKELY, FAIRLY = 0.12, 0.09, 0.05

#: Half of the ninth place: utilities have nine, so no gap of theirs stands half way once it is added.
HALF = 5e-10

FORM = "struct<matches: double, goals_for: double, goals_against: double>"
CALIBRATION = "struct<active: boolean, family: string, strength: double, direction: boolean, offsets: struct<home: double, draw: double, away: double>, total_goals: boolean, lambda_shift: double, dispersion: boolean, tail_weight: double>"


def consensus(quotes: DataFrame, key: str = "match_id") -> DataFrame:
    """Market view of each match: mean de-vigged outcomes of quotes whose three prices are over one, median lines within their ranges.

    ``quotes``: ``home, draw, away, total_line, handicap`` of one provider a
    row. Lines come in quarters, so the exact median is a partial aggregate
    over a few distinct values, and a match with very many quotes is no task
    of its own.
    """
    inverse = {n: 1 / F.col(n) for n in OUTCOMES}
    good = F.coalesce(F.least(*OUTCOMES) > 1, F.lit(False)) & F.expr(" and ".join(f"{n} is not null" for n in OUTCOMES))
    mean = lambda n: F.avg(F.when(good, inverse[n] / (inverse["home"] + inverse["draw"] + inverse["away"])))
    within = lambda c, low, high: F.median(F.when(F.col(c).between(low, high), F.col(c)))
    found = quotes.groupBy(key).agg(*[mean(n).alias(n) for n in OUTCOMES], within("total_line", 1.0, 5.0).alias("market_total"), within("handicap", -5.0, 5.0).alias("market_handicap"))
    return found.select(key, F.when(F.col("home").isNotNull(), F.struct(*OUTCOMES)).alias("market"), "market_total", "market_handicap")


def _mean(*values: str) -> str:
    """Mean of those that are there; null if none is."""
    there = f"filter(array({', '.join(values)}), x -> x is not null)"
    return f"if(size({there}) > 0, aggregate({there}, 0D, (s, x) -> s + x) / size({there}), null)"


def _per_match(form: str, what: str) -> str:
    return f"if({form}.matches > 0, {form}.{what} / {form}.matches, null)"


def calibration_gate(c: str = "calibration") -> dict[str, Column]:
    """Whether a calibration is compatible, its strength within bounds, and which of its three corrections apply."""
    fits = f"coalesce({c}.active and {c}.family = '{FAMILY}', false)"
    applied = {f"{n}_applied": F.expr(f"{fits} and coalesce({c}.{n}, false)") for n in ("direction", "total_goals", "dispersion")}
    return {"compatible": F.expr(fits), "strength": F.expr(f"if({fits}, greatest(0D, least({MOST_STRENGTH}D, coalesce({c}.strength, 0D))), 0D)")} | applied


def fused_rates(matches: DataFrame) -> DataFrame:
    """Add form rates, the calibrated total, the home share and the two scoring rates.

    ``matches``: ``home_home, away_away, home_overall, away_overall`` (form
    structs), ``market`` (outcome probabilities), ``market_total``,
    ``market_handicap``, ``calibration``.
    """
    venue = {side: f"if({side}_{side}.matches > 0, {side}_{side}, {side}_overall)" for side in ("home", "away")}
    rows = matches.withColumns({f"{side}_venue": F.expr(f"cast({e} as {FORM})") for side, e in venue.items()} | calibration_gate())
    goals = lambda own, other: _mean(_per_match(own, "goals_for"), _per_match(other, "goals_against"))
    at_venue = {"home": goals("home_venue", "away_venue"), "away": goals("away_venue", "home_venue")}
    overall = {"home": goals("home_overall", "away_overall"), "away": goals("away_overall", "home_overall")}
    rows = held(rows, {f"{s}_at_venue": F.expr(at_venue[s]) for s in ("home", "away")} | {f"{s}_in_all": F.expr(overall[s]) for s in ("home", "away")})
    rows = held(rows, {f"form_{s}": F.expr(_mean(f"{s}_at_venue", f"{s}_at_venue", f"{s}_in_all")) for s in ("home", "away")})
    known = "form_home is not null and form_away is not null and market is not null"
    clamp = lambda e, bounds: f"greatest({bounds[0]}D, least({bounds[1]}D, {e}))"
    rows = rows.withColumn("has_model", F.expr(known))
    rows = held(rows, {"form_total": F.expr(clamp("form_home + form_away", FORM_TOTAL)), "form_share": F.expr(clamp("form_home / greatest(form_home + form_away, 0.01D)", SHARE))})
    rows = held(rows, {"target_total": F.expr("coalesce(market_total, form_total)")})
    shifted = f"{FORM_WEIGHT}D * form_total + {1 - FORM_WEIGHT:.2f}D * target_total + if(total_goals_applied, coalesce(calibration.lambda_shift, 0D), 0D) * strength"
    rows = held(rows, {"total": F.expr(f"if(has_model, {clamp(shifted, TOTAL)}, null)"), "market_share": F.when(F.col("has_model"), nearest_share("target_total", *[F.col(f"market.{o}") for o in OUTCOMES]))})
    rows = held(rows, {"share": F.expr(f"{FORM_SHARE_WEIGHT}D * form_share + {1 - FORM_SHARE_WEIGHT:.2f}D * market_share")})
    return rows.withColumns({"lambda_home": F.expr("total * share"), "lambda_away": F.expr("total * (1 - share)")})


def with_score_grid(rows: DataFrame) -> DataFrame:
    """Add ``cells`` ``(h, a, p)``: the grid of the two rates, spread and moved as far as the calibration is approved."""
    factors = {"": 1.0, "low_": LOW_TAIL, "high_": HIGH_TAIL}
    rows = rows.withColumn("tail_", F.expr(f"if(dispersion_applied, greatest(0D, least({MOST_TAIL}D, coalesce(calibration.tail_weight, 0D) * strength)), 0D)"))
    rows = held(rows, {f"{n}{side[0]}_": F.expr(pmf(f"(lambda_{side} * {f}D)")) for n, f in factors.items() for side in ("home", "away")})
    # A plain grid's sum is the product of its sides' sums.
    weight = {"": "(1 - tail_)", "low_": "0.5D * tail_", "high_": "0.5D * tail_"}
    total = "aggregate({0}, 0D, (s, x) -> s + x)"
    rows = held(rows, {f"{n}w_": F.expr(f"{weight[n]} / ({total.format(n + 'h_')} * {total.format(n + 'a_')})") for n in factors})
    plain = "w_ * x * a_[a]"
    spread = " + ".join(f"{n}w_ * {n}h_[h] * {n}a_[a]" for n in factors)
    offset = "case when h > a then coalesce(calibration.offsets.home, 0D) when h = a then coalesce(calibration.offsets.draw, 0D) else coalesce(calibration.offsets.away, 0D) end"
    moved = f"if(tail_ > 0, {spread}, {plain}) * if(direction_applied, exp(strength * {offset}), 1D)"
    rows = held(rows, {"cells_": F.expr(f"flatten(transform(h_, (x, h) -> transform(a_, (y, a) -> named_struct('h', h, 'a', a, 'p', {moved}))))")})
    rows = held(rows, {"sum_": F.expr("aggregate(cells_, 0D, (s, x) -> s + x.p)")})
    rows = held(rows, {"cells": F.expr("if(sum_ is null, null, transform(cells_, x -> named_struct('h', x.h, 'a', x.a, 'p', x.p / sum_)))")})
    return rows.drop("tail_", "cells_", "sum_", *[f"{n}{c}_" for n in factors for c in "haw"])


def first_of(struct: str) -> str:
    """Name of the largest outcome of a struct; of those equal to nine places the first in order, as last bits are the summing order's chance."""
    nine = {n: f"round({struct}.{n}, 9)" for n in OUTCOMES}
    return f"case when {struct} is null then null when {nine['home']} >= {nine['draw']} and {nine['home']} >= {nine['away']} then 'home' when {nine['draw']} >= {nine['away']} then 'draw' else 'away' end"


def with_markets(rows: DataFrame) -> DataFrame:
    """Sums over ``cells``: ``outcomes``, ``btts_yes``, and the exact totals 0 to 6 and more as an array."""
    count = lambda test: f"aggregate(cells, 0D, (s, x) -> s + if({test}, x.p, 0D))"
    rows = held(rows, {"outcomes": F.expr(f"if(cells is null, null, named_struct('home', {count('x.h > x.a')}, 'draw', {count('x.h = x.a')}, 'away', {count('x.h < x.a')}))")})
    return held(rows, {"btts_yes": F.expr(f"round({count('x.h > 0 and x.a > 0')}, 6)"), "totals": F.expr(f"transform(sequence(0, 6), n -> round({count('least(6, x.h + x.a) = n')}, 6))")})


def with_scenario(rows: DataFrame) -> DataFrame:
    """Choose one score: the grid's peak stays the formal pick, the best of the scenario candidates is its challenger.

    Candidates are the cells with at least 42 % of the peak; of these the eight
    of highest utility are kept, in an array inside the row. Needs ``cells,
    outcomes, totals, btts_yes, total, market, market_total, market_handicap``
    and ``high_tail`` (whether the match's story names a risk of late swings).
    Utilities and chances that are equal to nine places go by the fewer home,
    then away goals.
    """
    w = WEIGHTS
    # Only cells that may be equal to the highest to nine places are rounded.
    rows = held(rows, {"most_": F.expr("aggregate(cells, 0D, (s, x) -> greatest(s, x.p))")})
    rows = held(rows, {"peak": F.expr("array_max(transform(filter(cells, x -> x.p >= most_ - 1e-8D), x -> named_struct('q', round(x.p, 9), 'h', -x.h, 'a', -x.a, 'p', x.p)))"), "leader": F.expr(first_of("outcomes")), "market_leader": F.expr(first_of("market"))})
    rows = held(rows, {"total_mode": F.expr("-array_max(transform(totals, (p, n) -> named_struct('p', p, 'n', -n))).n"), "centre": F.expr("coalesce(market_total, total)")})
    outcome = "case when x.h > x.a then 'home' when x.h = x.a then 'draw' else 'away' end"
    fit = lambda gap: f"greatest(0D, 1 - abs({gap}) / {REACH}D)"
    either = lambda test, pair: f"if({test}, {pair[0]}D, {pair[1]}D)"
    parts = {
        "matrix": f"{w['matrix']}D * x.p / greatest(peak.p, 1e-12D)",
        "model": either(f"{outcome} = leader", w["model"]),
        "total": f"{w['total']}D * {fit('x.h + x.a - centre')}",
        "btts": either("(x.h > 0 and x.a > 0) = (btts_yes >= 0.5D)", w["btts"]),
        "market": f"if(market_leader is null, 0D, {either(f'{outcome} = market_leader', w['market'])})",
        "handicap": f"if(market_handicap is null, 0D, {w['handicap']}D * {fit('x.h - x.a + market_handicap')})",
        "script": f"case when coalesce(high_tail, false) and x.h + x.a >= ceil(round(total, 9)) then {w['script'][0]}D when coalesce(high_tail, false) and x.h + x.a <= 1 then {w['script'][1]}D else 0D end",
    }
    components = "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in parts.items()) + ")"
    rows = held(rows, {"near_": F.expr(f"transform(filter(cells, x -> x.p >= peak.p * {NEEDED}D), x -> named_struct('h', x.h, 'a', x.a, 'p', x.p, 'c', {components}))")})
    utility = "round(" + " + ".join(f"x.c.{n}" for n in parts) + ", 9)"
    rows = held(rows, {"ranked_": F.expr(f"array_sort(transform(near_, x -> named_struct('u', -({utility}), 'q', -round(x.p, 9), 'h', x.h, 'a', x.a, 'p', x.p, 'c', x.c)))")})
    chosen = "case when i = 0 then 'challenger_selected' when x.h = -peak.h and x.a = -peak.a then 'matrix_selected' else 'rejected' end"
    rows = held(rows, {"candidates": F.expr(f"transform(slice(ranked_, 1, {CANDIDATES}), (x, i) -> named_struct('place', i + 1, 'h', x.h, 'a', x.a, 'p', x.p, 'utility', -x.u, 'components', x.c, 'decision', {chosen}))")})
    gap = "coalesce(get(ranked_, 1).u - get(ranked_, 0).u, -get(ranked_, 0).u)"
    rows = rows.withColumns({"utility_gap": F.expr(f"round({gap} + {HALF}D, 6)"), "formal_score": F.expr("concat(-peak.h, '-', -peak.a)"), "challenger_score": F.expr("concat(get(ranked_, 0).h, '-', get(ranked_, 0).a)")})
    confident = f"case when candidates is null then null when utility_gap >= {CONFIDENT} and get(ranked_, 0).p >= {LIKELY} then 'high' when utility_gap >= {FAIRLY} then 'medium' else 'low' end"
    return rows.withColumn("confidence", F.expr(confident)).drop("near_", "ranked_", "most_")


def priced_matches(matches: DataFrame) -> DataFrame:
    """A match's rates and its score grid, without what is chosen from it: all that pricing a line needs."""
    return with_score_grid(fused_rates(matches))


def automatic_model(matches: DataFrame) -> DataFrame:
    """All of a match's model in its row; see the functions it is made of for its columns."""
    return with_scenario(with_markets(priced_matches(matches)))


def candidate_rows(models: DataFrame, key: str = "match_id") -> DataFrame:
    """The scenario candidates, at most eight a match, with what each component gave; half a place goes up, whatever the last bit."""
    rows = models.select(key, F.explode("candidates").alias("c"))
    return rows.select(key, "c.place", "c.h", "c.a", F.round("c.p", 6).alias("p"), F.round(F.col("c.utility") + HALF, 6).alias("utility"), *[F.round(F.col(f"c.components.{n}") + 1e-9, 4).alias(n) for n in WEIGHTS], "c.decision")


def line_sums(models: DataFrame) -> DataFrame:
    """Running sums of goal differences (``upto_difference``) and totals (``upto_total``) of whole grids (``cells``, home goals first)."""
    return held(models, {"x_": grid_sums(F.expr("transform(cells, x -> x.p)"))}).select(*models.columns, F.col("x_.difference").alias("upto_difference"), F.col("x_.total").alias("upto_total"))


def offer_audit(models: DataFrame, offers: DataFrame, key: str = "match_id") -> DataFrame:
    """Each offer of a handicap or total against its match's grid: chances of win and push, expected value and the least odds to take.

    ``models`` needs ``cells`` only (``priced_matches``). ``offers``: the key, ``family`` (``handicap`` or ``total``), ``side``
    (``home``, ``away``, ``over``, ``under``), ``line`` (the home side's for
    handicaps) and ``water`` (profit on one unit; may be null). A line is
    settled at its two parts, each a look into running sums of the match's grid;
    offers of matches without a model are left out.
    """
    rows = offers.join(line_sums(models.where("cells is not null").select(key, "cells")).select(key, "upto_difference", "upto_total"), key)
    kinds = {"home": ("handicap", 1), "away": ("handicap", -1), "over": ("over", 1), "under": ("under", 1)}
    settled = {kind: settled_line("line", kind) for kind, _ in kinds.values()}

    def equivalent(full: str, half: str) -> Column:
        by_side = []
        for side, (kind, sign) in kinds.items():
            names = (full, half) if sign > 0 else tuple(n.replace("win", "x").replace("loss", "win").replace("x", "loss") for n in (full, half))
            by_side.append(f"when '{side}' then {settled[kind][names[0]]} + 0.5D * {settled[kind][names[1]]}")
        return F.expr(f"case side {' '.join(by_side)} end")

    rows = held(rows, {"w_": equivalent("full_win", "half_win"), "l_": equivalent("full_loss", "half_loss")})
    fair = F.when(F.col("w_") > 0, 1 + F.col("l_") / F.col("w_"))
    values = {"win": F.round("w_", 6), "push": F.round(F.greatest(F.lit(0.0), 1 - F.col("w_") - F.col("l_")), 6), "odds": F.round(1 + F.col("water"), 3), "ev": F.round(F.col("w_") * F.col("water") - F.col("l_"), 6), "least_odds": F.round(fair * 1.08, 3)}
    return rows.withColumns(values).drop("upto_difference", "upto_total", "w_", "l_")
