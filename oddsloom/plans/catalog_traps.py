"""Named queries of the trap registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.operators import traps
from oddsloom.plans.adapters import table
from oddsloom.plans.catalog import query

_COMPANIES = (1055, 3, 5, 280, 651, 9, 16, 77)
#: A company's row of a supplier's panel: sums of its line items' keys, cut to the ranges of prices, lines and waters.
_PANEL = {
    "open_home": "CASE WHEN q % 19 > 0 THEN 1.2 + q % 40 * 0.01 END", "home": "CASE WHEN q % 23 > 0 THEN 1.2 + n % 40 * 0.01 ELSE 0 END", "open_draw": "3 + q % 9 * 0.1", "draw": "3 + n % 11 * 0.1",
    "open_line": "(q % 9 - 4) * 0.25", "line": "CASE WHEN n % 13 > 0 THEN (n % 9 - 4) * 0.25 END", "open_water": "0.8 + q % 5 * 0.1", "water": "CASE WHEN q % 17 > 0 THEN 0.8 + n % 6 * 0.1 END",
}
_GIVEN = {"theory": "CASE WHEN k % 11 > 0 THEN k % 13 * 0.25 END", "home": "k % 17 * 0.05", "draw": "k % 7 * 0.05", "away": "k % 12 * 0.05", "mean_current": "CASE WHEN k % 5 > 0 THEN 1.1 + k % 9 * 0.05 END"}
_TIERS, _GROWTH = [f"CASE WHEN k % {p} > 1 THEN k % {p} - 3 END" for p in (5, 7, 11)], [f"CASE WHEN k % {p} > 0 THEN k % {p} * 0.5 END" for p in (4, 6)]

_RULES = {
    "EA01": "theory - actual >= 0.25", "EA03": "CASE WHEN draw_change + actual + theory IS NOT NULL THEN draw_change <= -0.08 AND actual - theory >= 0.25 END", "EA04": "CASE WHEN hc + lc IS NOT NULL THEN hc <= -0.05 AND lc <= -0.25 END",
    "EA08": "CASE WHEN hc + lc IS NOT NULL THEN hc <= -0.05 AND abs(lc) < 0.01 END", "EA09": "CASE WHEN hc + lc IS NOT NULL THEN sign(hc) * sign(lc) > 0 END", "EA12": "opening >= 1.5", "EA14": "CASE WHEN c0 + c1 + c2 IS NOT NULL THEN least(abs(c0 - c1), abs(c0 - c2), abs(c1 - c2)) >= 0.25 END",
    "U04": "CASE WHEN len(tiers) >= 2 THEN list_min(tiers) > 0 OR list_max(tiers) < 0 END", "U06": "CASE WHEN mean_home IS NOT NULL THEN outliers = 1 END", "U08": "CASE WHEN hc + lc IS NOT NULL THEN hc <= -0.05 AND lc <= -0.25 END", "U09": "CASE WHEN hc <> 0 AND sc <> 0 THEN hc * sc < 0 END",
    "U16": "CASE WHEN hc + lc IS NOT NULL THEN hc < 0 AND lc <= 0 OR hc > 0 AND lc >= 0 END", "U17": "line_spread <= 0.15", "U18": "p_home > 0.75", "U19": "p_draw > 0.30", "U20": "p_away > 0.40", "U21": "abs(hc) > 0.15", "U22": "price_spread > 0.30", "U23": "line_spread > 0.50",
    "U25": "CASE WHEN w0 + w1 + w2 IS NOT NULL THEN least(abs(w0), abs(w1), abs(w2)) >= 0.15 AND (least(w0, w1, w2) > 0 OR greatest(w0, w1, w2) < 0) END", "U26": "coalesce(mean_current, 99) < 1.25", "MBI16": "gap >= 0.25", "MBI17": "coalesce(list_max(growth), 0) > 2",
}
_OTHERS = sorted(traps.NOT_EVALUABLE)
_DOUBLE = lambda e: f"CAST({e} AS DOUBLE)"
_OF = lambda c, e: f"max({e}) FILTER (company = {c})"

_SQL = f"""WITH s AS (SELECT l_suppkey AS match_id, l_partkey % 8 AS c, CAST(sum(l_orderkey) AS BIGINT) AS q, CAST(sum(l_orderkey * 3 + l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY ALL),
 p AS (SELECT match_id, {list(_COMPANIES)}[c + 1] AS company, {", ".join(f"{_DOUBLE(e)} AS {n}" for n, e in _PANEL.items())} FROM s), v AS (SELECT *, abs(line) AS d, abs(open_line) AS od, nullif(home, 0) AS price, CASE WHEN line = open_line THEN water - open_water END AS moved FROM p),
 g AS (SELECT match_id, {_OF(1055, "(home - open_home) / open_home")} AS hc, {_OF(1055, "(draw - open_draw) / open_draw")} AS draw_change, {_OF(3, "(home - open_home) / open_home")} AS sc, {_OF(1055, "d - od")} AS lc, median(d) AS actual, median(od) AS opening,
  {", ".join(f"{_OF(c, 'd')} AS c{k}, {_OF(c, 'moved')} AS w{k}" for k, c in enumerate((1055, 3, 5)))}, CASE WHEN count(d) FILTER (company IN (1055, 3, 5)) >= 2 THEN max(d) FILTER (company IN (1055, 3, 5)) - min(d) FILTER (company IN (1055, 3, 5)) END AS line_spread,
  CASE WHEN count(price) FILTER (company IN (1055, 3, 5)) >= 2 THEN max(price) FILTER (company IN (1055, 3, 5)) - min(price) FILTER (company IN (1055, 3, 5)) END AS price_spread, abs(median(d) FILTER (company IN (1055, 3)) - median(d) FILTER (company IN (5, 280, 651, 9, 16))) AS gap, avg(price) AS mean_home FROM v GROUP BY 1),
 o AS (SELECT match_id, count(*) FILTER (abs(price - mean_home) >= 0.10) AS outliers FROM v JOIN g USING (match_id) GROUP BY 1),
 m AS (SELECT g.*, outliers, {", ".join(f"{_DOUBLE(e)} AS {'p_' + n if n in ('home', 'draw', 'away') else n}" for n, e in _GIVEN.items())}, list_filter([{", ".join(_TIERS)}], lambda x: x IS NOT NULL AND x <> 0) AS tiers, [{", ".join(_GROWTH)}] AS growth FROM (SELECT *, match_id AS k FROM g) g JOIN o USING (match_id)),
 r AS ({" UNION ALL ".join(f"SELECT match_id, '{n}' AS rule, CASE WHEN {e} THEN 'triggered' WHEN NOT ({e}) THEN 'not_triggered' ELSE 'not_evaluable' END AS status, 'fields_missing' AS why FROM m" for n, e in _RULES.items())}
  UNION ALL SELECT match_id, x.rule, 'not_evaluable', x.why FROM m, (VALUES {", ".join(f"('{n}', '{traps.NOT_EVALUABLE[n]}')" for n in _OTHERS)}, ('NEW1', 'no_reliable_judgement')) x(rule, why)),
 t AS (SELECT match_id, rule, CASE WHEN starts_with(rule, 'EA') THEN 'A' WHEN starts_with(rule, 'U') THEN 'B' ELSE 'C' END AS category, status, CASE WHEN status = 'not_evaluable' THEN why END AS reason FROM r)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("match_id"), (F.col("l_partkey") % 8).alias("c")).agg(F.sum("l_orderkey").alias("q"), F.sum(F.col("l_orderkey") * 3 + F.col("l_linenumber")).alias("n"))
    panel = sums.select("match_id", F.get(F.array(*map(F.lit, _COMPANIES)), F.col("c").cast("int")).alias("company"), *[F.expr(_DOUBLE(e)).alias(n) for n, e in _PANEL.items()])
    given = {n: F.expr(_DOUBLE(e)) for n, e in _GIVEN.items()}
    shin = F.struct(*[given[n].alias(n) for n in ("home", "draw", "away")])
    arrays = {"tiers": _TIERS, "growth": _GROWTH}
    matches = traps.panel_metrics(panel).withColumn("k", F.col("match_id")).withColumns({"theory": given["theory"], "shin": shin, "mean_current": given["mean_current"], **{n: F.array(*[F.expr(_DOUBLE(e)) for e in x]) for n, x in arrays.items()}})
    names = [*_RULES, *_OTHERS, "NEW1"]
    registry = spark.createDataFrame([(n, "A" if n.startswith("EA") else "B" if n.startswith("U") else "C") for n in names], "rule string, category string")
    return traps.evaluated(matches, registry)


@query(_SQL + " SELECT * FROM t")
def trap_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir)


@query(_SQL + """ SELECT match_id, count(*) FILTER (status <> 'not_evaluable') AS evaluated, count(*) FILTER (status = 'not_evaluable') AS not_evaluable, count(*) FILTER (status = 'triggered') AS triggered, count(*) FILTER (status = 'triggered' AND category = 'A') AS triggered_a,
 count(*) FILTER (status = 'triggered' AND category = 'B') AS triggered_b, count(*) FILTER (status = 'triggered' AND category = 'C') AS triggered_c, 'degraded' AS calculation_status FROM t GROUP BY 1""")
def trap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traps.trap_summary(_results(spark, sf_dir))
