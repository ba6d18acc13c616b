"""Named queries of the automatic pre-match model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.operators import automodel
from oddsloom.plans.adapters import dealt, table
from oddsloom.plans.catalog import nearest_share_sql, query

#: Form of a part's two sides: matches, goals for and against.
_FORMS = {
    "home_home": ("k % 6", "k % 17", "k % 11"),
    "away_away": ("k * 3 % 7", "k * 5 % 13", "k * 7 % 19"),
    "home_overall": ("CASE WHEN k % 37 = 0 THEN 0 ELSE 10 END", "8 + k % 13", "6 + k % 9"),
    "away_overall": ("10", "5 + k % 15", "7 + k % 8"),
}
_CALIBRATION = {
    "active": "k % 4 <> 0",
    "family": f"CASE WHEN k % 5 = 0 THEN 'older' ELSE '{automodel.FAMILY}' END",
    "strength": "k % 9 * 0.1D",
    "direction": "k % 2 = 0",
    "total_goals": "k % 3 <> 0",
    "lambda_shift": "0.5D - k % 3 * 0.3D",
    "dispersion": "k % 7 < 4",
    "tail_weight": "k % 4 * 0.1D",
}


def provider_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider's three prices and two lines, one for each line item."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey as match_id", "l_orderkey * 10 + l_linenumber as provider", "l_linenumber", "1 + l_quantity / 10 as home", "0.9D + l_orderkey % 37 / 10 as draw", "1 + l_suppkey % 50 / 10 as away",
        "0.5D + l_orderkey % 21 / 4 as total_line", "(l_orderkey % 45 - 22) / 4 as handicap", "case when l_orderkey % 11 > 0 then 0.7D + l_linenumber / 20 end as water",
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(table(spark, sf_dir, "part").selectExpr("p_partkey as match_id", "p_partkey as k"), "match_id")
    forms = [f"cast(named_struct('matches', {m}, 'goals_for', {f}, 'goals_against', {a}) as {automodel.FORM}) as {n}" for n, (m, f, a) in _FORMS.items()]
    calibration = dict(_CALIBRATION, offsets="named_struct('home', -0.2D, 'draw', 0.1D, 'away', 0.2D)")
    rows = rows.selectExpr("match_id", "k % 10 = 3 as high_tail", *forms, "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in calibration.items()) + ") as calibration")
    return rows.join(automodel.consensus(provider_quotes(spark, sf_dir)), "match_id", "left")


_QUOTES = """SELECT l_partkey AS match_id, l_orderkey * 10 + l_linenumber AS provider, l_linenumber, 1 + l_quantity / 10 AS home, 0.9 + l_orderkey % 37 / 10 AS draw, 1 + l_suppkey % 50 / 10 AS away,
 0.5 + l_orderkey % 21 / 4 AS total_line, (l_orderkey % 45 - 22) / 4 AS handicap, CASE WHEN l_orderkey % 11 > 0 THEN 0.7 + l_linenumber / 20 END AS water FROM lineitem"""


def _model_sql() -> str:
    number = lambda e: f"({e.replace('D', '')})::DOUBLE" if "D" in e and "CASE" not in e else f"({e})"
    forms = ", ".join(f"({e})::DOUBLE AS {n}_{c}" for n, x in _FORMS.items() for c, e in zip("mfa", x))
    calibration = ", ".join(f"{number(e)} AS {n}" for n, e in _CALIBRATION.items())
    per = lambda form, c: f"CASE WHEN {form}_m > 0 THEN {form}_{c} / {form}_m END"
    mean = lambda *v: f"list_avg(list_filter([{', '.join(v)}], lambda x: x IS NOT NULL))"
    venue = {s: {c: f"CASE WHEN {s}_{s}_m > 0 THEN {s}_{s}_{c} / {s}_{s}_m WHEN {s}_overall_m > 0 THEN {s}_overall_{c} / {s}_overall_m END" for c in "fa"} for s in ("home", "away")}
    side = lambda s, o: mean(*[mean(venue[s]["f"], venue[o]["a"])] * 2, mean(per(f"{s}_overall", "f"), per(f"{o}_overall", "a")))
    clamp = lambda e, b: f"greatest({b[0]}, least({b[1]}, {e}))"
    poisson = lambda rate, g: f"exp(-({rate})) * pow({rate}, {g}) / factorial(CAST({g} AS INT))"
    cut = "sum({0}) OVER (PARTITION BY match_id)"
    plain = {n: f"{poisson(f'lh * {f}::DOUBLE', 'h')} * {poisson(f'la * {f}::DOUBLE', 'a')}" for n, f in (("p", 1.0), ("low", automodel.LOW_TAIL), ("high", automodel.HIGH_TAIL))}
    return f"""WITH q AS ({_QUOTES}), con AS (SELECT match_id, avg(1 / home / (1 / home + 1 / draw + 1 / away)) FILTER (least(home, draw, away) > 1) AS mh, avg(1 / draw / (1 / home + 1 / draw + 1 / away)) FILTER (least(home, draw, away) > 1) AS md,
 avg(1 / away / (1 / home + 1 / draw + 1 / away)) FILTER (least(home, draw, away) > 1) AS ma, median(total_line) FILTER (total_line BETWEEN 1 AND 5) AS market_total, median(handicap) FILTER (handicap BETWEEN -5 AND 5) AS market_handicap FROM q GROUP BY 1),
 part_k AS (SELECT p_partkey AS match_id, p_partkey AS k FROM part), base AS (SELECT match_id, k % 10 = 3 AS high_tail, {forms}, {calibration}, mh, md, ma, market_total, market_handicap FROM part_k LEFT JOIN con USING (match_id)),
 gate AS (SELECT *, active AND family = '{automodel.FAMILY}' AS compatible, {side("home", "away")} AS fh, {side("away", "home")} AS fa FROM base),
 known AS (SELECT *, CASE WHEN compatible THEN {clamp("strength", (0, automodel.MOST_STRENGTH))} ELSE 0 END AS st, {clamp("fh + fa", automodel.FORM_TOTAL)} AS form_total, {clamp("fh / greatest(fh + fa, 0.01)", automodel.SHARE)} AS form_share FROM gate WHERE fh IS NOT NULL AND fa IS NOT NULL AND mh IS NOT NULL),
 aim AS (SELECT match_id, coalesce(market_total, form_total) AS total, mh AS th, md AS td, ma AS ta FROM known){nearest_share_sql("aim", "found")},
 rates AS (SELECT known.*, {clamp("0.6 * form_total + 0.4 * aim.total + CASE WHEN compatible AND total_goals THEN lambda_shift ELSE 0 END * st", automodel.TOTAL)} AS total, 0.65 * form_share + 0.35 * share AS share FROM known JOIN aim USING (match_id) JOIN found USING (match_id)),
 two AS (SELECT *, total * share AS lh, total * (1 - share) AS la, CASE WHEN compatible AND dispersion THEN {clamp("tail_weight * st", (0, automodel.MOST_TAIL))} ELSE 0 END AS tail FROM rates),
 g1 AS (SELECT two.*, h, a, {", ".join(f"{e} AS {n}" for n, e in plain.items())} FROM two, range(13) x(h), range(13) y(a)),
 g2 AS (SELECT *, (1 - tail) * p / {cut.format("p")} + tail / 2 * (low / {cut.format("low")} + high / {cut.format("high")}) AS m FROM g1),
 g3 AS (SELECT * EXCLUDE (m, p), CASE WHEN compatible AND direction THEN m * exp(st * CASE WHEN h > a THEN -0.2 WHEN h = a THEN 0.1 ELSE 0.2 END) ELSE m END AS m FROM g2),
 cells AS (SELECT match_id, h, a, m / {cut.format("m")} AS p FROM g3),
 sums AS (SELECT match_id, sum(p) FILTER (h > a) AS ph, sum(p) FILTER (h = a) AS pd, sum(p) FILTER (h < a) AS pa, round(sum(p) FILTER (h > 0 AND a > 0), 6) AS btts_yes, arg_max(h, (round(p, 9), -h, -a)) AS top_h, arg_max(a, (round(p, 9), -h, -a)) AS top_a, arg_max(p, (round(p, 9), -h, -a)) AS peak FROM cells GROUP BY 1),
 mode AS (SELECT match_id, arg_max(n, (round(t, 6), -n)) AS total_mode FROM (SELECT match_id, least(6, h + a) AS n, sum(p) AS t FROM cells GROUP BY ALL) GROUP BY 1),
 lead AS (SELECT two.*, sums.* EXCLUDE (match_id), total_mode, CASE WHEN round(ph, 9) >= round(pd, 9) AND round(ph, 9) >= round(pa, 9) THEN 'home' WHEN round(pd, 9) >= round(pa, 9) THEN 'draw' ELSE 'away' END AS leader, CASE WHEN round(mh, 9) >= round(md, 9) AND round(mh, 9) >= round(ma, 9) THEN 'home' WHEN round(md, 9) >= round(ma, 9) THEN 'draw' ELSE 'away' END AS market_leader, coalesce(market_total, total) AS centre FROM two JOIN sums USING (match_id) JOIN mode USING (match_id)),
 near AS (SELECT l.*, h, a, p, CASE WHEN h > a THEN 'home' WHEN h = a THEN 'draw' ELSE 'away' END AS outcome FROM cells JOIN lead l USING (match_id) WHERE p >= peak * 0.42),
 part7 AS (SELECT *, 0.55 * p / peak AS c_matrix, CASE WHEN outcome = leader THEN 0.18 ELSE -0.12 END AS c_model, 0.14 * greatest(0, 1 - abs(h + a - centre) / 1.75) AS c_total, CASE WHEN (h > 0 AND a > 0) = (btts_yes >= 0.5) THEN 0.08 ELSE -0.04 END AS c_btts,
  CASE WHEN outcome = market_leader THEN 0.10 ELSE -0.05 END AS c_market, CASE WHEN market_handicap IS NULL THEN 0 ELSE 0.10 * greatest(0, 1 - abs(h - a + market_handicap) / 1.75) END AS c_handicap, CASE WHEN high_tail AND h + a >= ceil(round(total, 9)) THEN 0.04 WHEN high_tail AND h + a <= 1 THEN -0.03 ELSE 0 END AS c_script FROM near),
 useful AS (SELECT *, round(c_matrix + c_model + c_total + c_btts + c_market + c_handicap + c_script, 9) AS utility FROM part7),
 ranked AS (SELECT *, row_number() OVER w AS place, lead(utility) OVER w AS second FROM useful WINDOW w AS (PARTITION BY match_id ORDER BY utility DESC, round(p, 9) DESC, h, a))"""


@query(_model_sql() + """, best AS (SELECT *, round(CASE WHEN second IS NULL THEN utility ELSE utility - second END + 5e-10, 6) AS gap FROM ranked WHERE place = 1)
 SELECT base.match_id, lh IS NOT NULL AS has_model, round(lh + 1e-9, 6) AS lambda_home, round(la + 1e-9, 6) AS lambda_away, round(b.total + 1e-9, 6) AS expected_goals, round(ph, 6) AS p_home, round(pd, 6) AS p_draw, round(pa, 6) AS p_away, btts_yes, total_mode, leader, market_leader, coalesce(gate.compatible, false) AS compatible,
 CASE WHEN lh IS NOT NULL THEN top_h || '-' || top_a END AS formal_score, CASE WHEN lh IS NOT NULL THEN h || '-' || a END AS challenger_score, gap AS utility_gap, CASE WHEN lh IS NULL THEN NULL WHEN gap >= 0.12 AND p >= 0.09 THEN 'high' WHEN gap >= 0.05 THEN 'medium' ELSE 'low' END AS confidence
 FROM base JOIN gate USING (match_id) LEFT JOIN best b USING (match_id)""")
def automatic_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = automodel.automatic_model(matches(spark, sf_dir))
    six = lambda c, n: F.round(c, 6).alias(n)
    # Rates are made of short decimals, so half a millionth occurs: it goes up, whatever the last bit.
    up = lambda c, n: F.round(F.col(c) + 1e-9, 6).alias(n)
    return m.select(
        "match_id", "has_model", up("lambda_home", "lambda_home"), up("lambda_away", "lambda_away"), up("total", "expected_goals"), *[six(f"outcomes.{o}", f"p_{o}") for o in automodel.OUTCOMES], "btts_yes", "total_mode", "leader",
        F.when(F.col("has_model"), F.col("market_leader")).alias("market_leader"), "compatible", "formal_score", "challenger_score", "utility_gap", "confidence",
    )


@query(_model_sql() + """ SELECT match_id, CAST(place AS INT) AS place, CAST(h AS INT) AS h, CAST(a AS INT) AS a, round(p, 6) AS p, round(utility + 5e-10, 6) AS utility, round(c_matrix + 1e-9, 4) AS matrix, round(c_model + 1e-9, 4) AS model, round(c_total + 1e-9, 4) AS total, round(c_btts + 1e-9, 4) AS btts, round(c_market + 1e-9, 4) AS market, round(c_handicap + 1e-9, 4) AS handicap, round(c_script + 1e-9, 4) AS script,
 CASE WHEN place = 1 THEN 'challenger_selected' WHEN h = top_h AND a = top_a THEN 'matrix_selected' ELSE 'rejected' END AS decision FROM ranked WHERE place <= 8""")
def scenario_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automodel.candidate_rows(automodel.automatic_model(matches(spark, sf_dir)))


_OFFERS = "CASE l_linenumber % 4 WHEN 0 THEN 'home' WHEN 1 THEN 'away' WHEN 2 THEN 'over' ELSE 'under' END"


@query(_model_sql() + f""", offers AS (SELECT row_number() OVER () AS row, match_id, provider, CASE WHEN l_linenumber % 4 < 2 THEN 'handicap' ELSE 'total' END AS family, {_OFFERS} AS side, CASE WHEN l_linenumber % 4 < 2 THEN handicap ELSE total_line END AS line, water FROM q),
 o1 AS (SELECT *, CASE WHEN round(line * 4) % 2 <> 0 THEN line - 0.25 ELSE line END AS l0, CASE WHEN round(line * 4) % 2 <> 0 THEN line + 0.25 ELSE line END AS l1 FROM offers),
 o2 AS (SELECT o1.*, p, CASE WHEN side IN ('under', 'away') THEN -1 ELSE 1 END * CASE family WHEN 'total' THEN sign(h + a - l0) + sign(h + a - l1) ELSE sign(h - a + l0) + sign(h - a + l1) END / 2 AS net FROM o1 JOIN cells USING (match_id)),
 o3 AS (SELECT row, match_id, provider, family, side, line, water, sum(p * greatest(net, 0)) AS w, sum(p * greatest(-net, 0)) AS l FROM o2 GROUP BY ALL)
 SELECT match_id, provider, family, side, line, water, round(w, 6) AS win, round(greatest(0, 1 - w - l), 6) AS push, round(1 + water, 3) AS odds, round(w * water - l, 6) AS ev, CASE WHEN w > 0 THEN round((1 + l / w) * 1.08, 3) END AS least_odds FROM o3""")
def offer_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = provider_quotes(spark, sf_dir)
    family = F.when(F.col("l_linenumber") % 4 < 2, "handicap").otherwise("total")
    offers = q.select("match_id", "provider", family.alias("family"), F.expr(_OFFERS).alias("side"), F.when(F.col("l_linenumber") % 4 < 2, F.col("handicap")).otherwise(F.col("total_line")).alias("line"), "water")
    return automodel.offer_audit(automodel.priced_matches(matches(spark, sf_dir)), offers)
