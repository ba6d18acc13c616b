"""Named queries of in-row pricing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.operators import model
from oddsloom.plans.adapters import rates, table, with_views
from oddsloom.plans.catalog import _MATRIX, query

_SUMMARY = """round(sum(p) FILTER (h > a), 6) AS p_home, round(sum(p) FILTER (h = a), 6) AS p_draw, round(sum(p) FILTER (h < a), 6) AS p_away, round(sum(p) FILTER (h + a <= 2), 6) AS under_25,
 arg_max(h::VARCHAR || '-' || a::VARCHAR, (round(p, 9), -h, -a)) AS top_score"""


@query(with_views("rates") + _MATRIX + f" SELECT match_id, {_SUMMARY}, round(max(p), 6) AS top_probability FROM matrix GROUP BY 1")
def matrix_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.matrix_summary(rates(spark, sf_dir))


@query(with_views("rates").replace("rates AS (", "base AS (", 1) + """, rates AS (SELECT match_id || '|' || scenario AS match_id, CASE WHEN dh < 0 THEN greatest(0.05, lh + dh) ELSE lh + dh END AS lh, CASE WHEN da < 0 THEN greatest(0.05, la + da) ELSE la + da END AS la, rho FROM base,
 (VALUES ('base', 0.0::DOUBLE, 0.0::DOUBLE), ('fewer_goals', -0.10, -0.10), ('more_goals', 0.10, 0.10), ('home_up', 0.15, 0.0), ('away_up', 0.0, 0.15)) s(scenario, dh, da))""" + _MATRIX + f""", m AS (SELECT match_id AS k, {_SUMMARY} FROM matrix GROUP BY 1)
 SELECT CAST(split_part(k, '|', 1) AS BIGINT) AS match_id, split_part(k, '|', 2) AS scenario, round(lh, 6) AS lambda_home, round(la, 6) AS lambda_away, p_home, p_draw, p_away, under_25, top_score FROM m JOIN rates ON match_id = k""")
def sensitivity_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.sensitivity(rates(spark, sf_dir))


@query(with_views("rates") + """, t AS (SELECT match_id, lh + la AS e, 1.5 + (match_id % 13) * 0.25::DOUBLE AS line FROM rates), d AS (SELECT t.*, g, exp(-e)*pow(e, g)/factorial(CAST(g AS INT)) AS p FROM t, range(16) x(g)),
 f AS (SELECT match_id, line, g, p FROM d UNION ALL SELECT match_id, line, 16, greatest(0.0, 1 - sum(p)) FROM d GROUP BY ALL), q AS (SELECT *, CASE WHEN round(line*4) % 2 <> 0 THEN floor(line*2)/2 ELSE line END AS c0, CASE WHEN round(line*4) % 2 <> 0 THEN floor(line*2)/2 + 0.5 ELSE line END AS c1 FROM f),
 s AS (SELECT match_id, line, sum(p*((g > c0)::INT + (g > c1)::INT)/2) AS up, sum(p*((g < c0)::INT + (g < c1)::INT)/2) AS down FROM q GROUP BY ALL)
 SELECT match_id, line, side, round(CASE side WHEN 'over' THEN up ELSE down END, 6) AS win, round(CASE side WHEN 'over' THEN down ELSE up END, 6) AS loss, round(greatest(0.0, 1 - up - down), 6) AS push, round(1 + CASE side WHEN 'over' THEN down/up ELSE up/down END, 4) AS fair_odds FROM s, (VALUES ('over'), ('under')) v(side)""")
def total_line_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rates(spark, sf_dir).select("match_id", (F.col("lh") + F.col("la")).alias("expected"), (1.5 + (F.col("match_id") % 13) * 0.25).alias("line"))
    return model.total_line_pricing(rows, "match_id")


@query(with_views("rates") + _MATRIX + """, l AS (SELECT match_id, h, a, p, side, CASE WHEN side IN ('home', 'away') THEN (match_id % 17 - 8) / 4 ELSE 1.5 + (match_id % 9) / 4 END::DOUBLE AS line FROM matrix, (VALUES ('home'), ('away'), ('over'), ('under')) v(side)),
 q AS (SELECT *, CASE WHEN round(line*4) % 2 <> 0 THEN line - 0.25 ELSE line END AS c0, CASE WHEN round(line*4) % 2 <> 0 THEN line + 0.25 ELSE line END AS c1 FROM l),
 f AS (SELECT match_id, side, line, p, CASE WHEN side IN ('home', 'over') THEN 1 ELSE -1 END * (CASE WHEN side IN ('home', 'away') THEN sign(h - a + c0) + sign(h - a + c1) ELSE sign(h + a - c0) + sign(h + a - c1) END) / 2 AS f FROM q),
 s AS (SELECT match_id, side, line, sum(p*greatest(f, 0)) AS w, sum(p*greatest(-f, 0)) AS l, sum(p*(1 - abs(f))) AS x FROM f GROUP BY ALL)
 SELECT match_id, side, line, round(w, 6) AS win, round(x, 6) AS push, round(l, 6) AS loss, round(1 + l/w, 4) AS fair_odds FROM s""")
def win_push_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("match_id")
    return model.win_push_loss(rates(spark, sf_dir).withColumns({"handicap": (k % 17 - 8) / 4, "total_line": 1.5 + (k % 9) / 4}))


@query(with_views("rates") + _MATRIX + """, t AS (SELECT match_id, h + a AS g, sum(p) AS p FROM matrix GROUP BY ALL), l AS (SELECT t.*, n / 4 AS line FROM t, range(2, 29) x(n)), q AS (SELECT *, CASE WHEN round(line*4) % 2 <> 0 THEN line - 0.25 ELSE line END AS c0, CASE WHEN round(line*4) % 2 <> 0 THEN line + 0.25 ELSE line END AS c1 FROM l),
 s AS (SELECT match_id, line, sum(p*greatest((sign(g - c0) + sign(g - c1)) / 2, 0)) AS w, sum(p*greatest(-(sign(g - c0) + sign(g - c1)) / 2, 0)) AS l FROM q GROUP BY ALL), o AS (SELECT s.match_id, line, 1 + l/w AS odds, abs(line - lh - la) AS far FROM s JOIN rates USING (match_id) WHERE w > 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY round(abs(odds - 2), 9), round(far, 9), line) AS n FROM o) SELECT match_id, line::DOUBLE AS line, round(odds, 4) AS fair_odds FROM r WHERE n = 1""")
def closest_total_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.closest_total(rates(spark, sf_dir))


@query("""WITH r AS (SELECT p_partkey AS id, p_retailprice AS s, p_retailprice * (0.75 + p_size / 100) AS e, (p_size * 7 - 14)::DOUBLE AS d FROM part)
 SELECT id, CASE WHEN s > 0 AND e > 0 AND d > 0 THEN round(e/s - 1, 6) END AS holding_return, CASE WHEN s > 0 AND e > 0 AND d > 0 THEN round(pow(e/s, 365/d) - 1, 6) END AS annual_return FROM r""")
def annualised_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, size = F.col("p_retailprice"), F.col("p_size")
    held, year = model.annualised(price, price * (0.75 + size / 100), (size * 7 - 14).cast("double"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(held, 6).alias("holding_return"), F.round(year, 6).alias("annual_return"))


@query("""WITH q AS (SELECT l_suppkey AS match_id, l_quantity::BIGINT % 8 AS goals, avg(1.5 + l_extendedprice / 10000) AS odds FROM lineitem GROUP BY ALL)
 SELECT match_id, round(sum(CASE WHEN goals >= 7 THEN 7.5 ELSE goals END::DOUBLE / odds) / sum(1/odds), 2) AS expected_goals, round(100 * coalesce(sum(1/odds) FILTER (goals < 3), 0) / sum(1/odds), 1) AS under_25_pct, round(100 - 100 * coalesce(sum(1/odds) FILTER (goals < 3), 0) / sum(1/odds), 1) AS over_25_pct FROM q GROUP BY 1""")
def goals_expectation(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    prices = items.groupBy(F.col("l_suppkey").alias("match_id"), (F.col("l_quantity").cast("long") % 8).alias("goals")).agg(F.avg(1.5 + F.col("l_extendedprice") / 10000).alias("odds"))
    return model.goals_expectation(prices, "match_id")
