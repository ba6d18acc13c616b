"""Named queries of recovery over three families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.operators import recovery
from oddsloom.plans.adapters import table
from oddsloom.plans.catalog import query

NOW = "1995-06-15 12:00:00"
_CUTOFFS = {"T-24H": "1992-03-01 10:00:00", "T-2H": "1993-09-01 10:00:00", "T-30M": "1995-06-15 11:57:00", "T-5M": "1996-01-01 00:00:00"}
_FAMILY = "CASE l_linenumber % 3 WHEN 0 THEN 'one_x_two' WHEN 1 THEN 'asian' ELSE 'total' END"

_SQL = f"""WITH cut AS (SELECT s_suppkey AS match_id, stage, CAST(moment AS TIMESTAMP) AS cutoff FROM supplier, (VALUES {', '.join(f"('{k}', '{v}')" for k, v in _CUTOFFS.items())}) v(stage, moment)),
 h AS (SELECT l_suppkey AS match_id, l_partkey % 6 AS company, {_FAMILY} AS family, l_shipdate + to_hours(CAST(l_linenumber AS BIGINT)) AS ts, l_quantity AS x, l_discount AS y, l_tax AS z FROM lineitem),
 l AS (SELECT s_suppkey AS match_id, c AS company, f AS family FROM supplier, range(6) r(c), (VALUES ('one_x_two', 0), ('asian', 1), ('total', 2)) v(f, n) WHERE (s_suppkey + c + n) % 4 > 0),
 m AS (SELECT h.*, stage FROM h JOIN cut USING (match_id) WHERE ts <= cutoff), b AS (SELECT match_id, stage, company, family, max({{'ts': ts, 'x': x, 'y': y, 'z': z}}) AS q FROM m GROUP BY ALL),
 n AS (SELECT match_id, stage, company, count(*) AS snapshots FROM m GROUP BY ALL), k AS (SELECT b.* FROM b JOIN l USING (match_id, company, family)),
 w AS (SELECT n.*, a.q AS a, s.q AS s, t.q AS t FROM n LEFT JOIN k a ON a.match_id = n.match_id AND a.stage = n.stage AND a.company = n.company AND a.family = 'one_x_two' LEFT JOIN k s ON s.match_id = n.match_id AND s.stage = n.stage AND s.company = n.company AND s.family = 'asian'
  LEFT JOIN k t ON t.match_id = n.match_id AND t.stage = n.stage AND t.company = n.company AND t.family = 'total')"""


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("match_id"))
    stages = F.array(*[F.struct(F.lit(k).alias("stage"), F.to_timestamp(F.lit(v)).alias("cutoff")) for k, v in _CUTOFFS.items()])
    checkpoints = supplier.withColumn("s", F.explode(stages)).select("match_id", "s.*")
    at = F.col("l_shipdate") + F.make_interval(hours=F.col("l_linenumber").cast("int"))
    history = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("match_id"), (F.col("l_partkey") % 6).alias("company"), F.expr(_FAMILY).alias("family"), at.cast("timestamp").alias("ts"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"))
    families = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(n).alias("n")) for n, f in enumerate(recovery.FAMILIES)])
    listed = supplier.withColumn("company", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("f", F.explode(families)).where((F.col("match_id") + F.col("company") + F.col("f.n")) % 4 > 0).select("match_id", "company", "f.family")
    return checkpoints, recovery.as_of_families(checkpoints, history, listed)


@query(_SQL + " SELECT match_id, stage, company, snapshots, a.x AS home, a.y AS draw, a.z AS away, s.x AS asian_line, t.x AS total_line, strftime(t.ts, '%Y-%m-%d %H:%M:%S') AS total_at FROM w")
def family_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = _found(spark, sf_dir)
    return found.select("match_id", "stage", "company", "snapshots", F.col("one_x_two.x").alias("home"), F.col("one_x_two.y").alias("draw"), F.col("one_x_two.z").alias("away"), F.col("asian.x").alias("asian_line"), F.col("total.x").alias("total_line"), F.date_format("total.ts", "yyyy-MM-dd HH:mm:ss").alias("total_at"))


_SUMMARY = _SQL + """, g AS (SELECT match_id, stage, count(a) AS one_x_two, count(s) AS asian, count(t) AS total, count(*) FILTER (a IS NOT NULL OR s IS NOT NULL OR t IS NOT NULL) AS companies, max(greatest(a.ts, s.ts, t.ts)) AS latest FROM w GROUP BY ALL),
 z AS (SELECT cut.match_id, cut.stage, cutoff, coalesce(one_x_two, 0) AS one_x_two, coalesce(asian, 0) AS asian, coalesce(total, 0) AS total, coalesce(companies, 0) AS companies, latest, CASE WHEN least(one_x_two, asian, total) > 0 THEN 'recovered' ELSE 'insufficient_history' END AS status FROM cut LEFT JOIN g ON g.match_id = cut.match_id AND g.stage = cut.stage)"""


@query(_SUMMARY + f""" SELECT match_id, stage, status, one_x_two, asian, total, companies, strftime(latest, '%Y-%m-%d %H:%M:%S') AS latest_quote, CASE WHEN match_id % 3 = 0 THEN 'historical_unavailable' END AS exchange,
 CASE WHEN cutoff > TIMESTAMP '{NOW}' THEN 'pending' WHEN cutoff >= TIMESTAMP '{NOW}' - INTERVAL 5 MINUTE THEN 'on_time' WHEN status = 'recovered' THEN 'historical_recovery' WHEN match_id % 2 = 0 THEN 'late_live' ELSE 'permanently_missing' END AS outcome FROM z""")
def recovery_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoints, found = _found(spark, sf_dir)
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("match_id"))
    summary = recovery.recovery_summary(checkpoints, found, supplier.where("match_id % 3 = 0"))
    kickoffs = supplier.withColumn("kickoff", F.expr("if(match_id % 2 = 0, timestamp '1996-02-01 00:00:00', timestamp '1995-01-01 00:00:00')"))
    outcome = recovery.missed_checkpoints(summary, kickoffs, F.to_timestamp(F.lit(NOW)))
    return summary.join(outcome, ["match_id", "stage"]).select("match_id", "stage", "status", *recovery.FAMILIES, "companies", F.date_format("latest_quote", "yyyy-MM-dd HH:mm:ss").alias("latest_quote"), "exchange", "outcome")
