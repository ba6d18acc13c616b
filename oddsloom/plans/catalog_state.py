"""Named queries of bounded deduplication, retries, and running values over long histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.plans.adapters import table
from oddsloom.plans.catalog import query
from oddsloom.streaming import stateful

AS_OF = "1995-06-17 12:00:00"


@query("SELECT event_type AS source, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY event_type, user_id % 100, props")
def fifo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 10,000 contents a type stand in the events, so the remembered ones are all; a test goes beyond."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), "event_id", "ts", (F.col("user_id") % 100).alias("user"), "props")
    return stateful.remembered(events, ["user", "props"]).select("source", "event_id")


_CHECKS = """SELECT l_orderkey AS fixture, l_linenumber AS event_id, CASE l_linestatus WHEN 'F' THEN NULL ELSE l_returnflag = 'R' END AS final, CASE l_partkey % 3 WHEN 0 THEN 'result_source_conflict' WHEN 1 THEN 'not_found' END AS issue, """


@query(f"""WITH c AS (SELECT DISTINCT fixture, event_id, coalesce(final, false) AS final, issue, ts FROM ({_CHECKS} TIMESTAMP '1995-06-16' + to_minutes(CAST(l_suppkey * 37 + l_linenumber * 11 AS BIGINT) % 2880) AS ts FROM lineitem) WHERE ts <= TIMESTAMP '{AS_OF}'),
 r AS (SELECT fixture, ts, final, issue, row_number() OVER (PARTITION BY fixture ORDER BY ts, event_id, final, issue NULLS FIRST) AS n FROM c),
 b AS (SELECT f.fixture, f.ts, f.final, f.issue, s.ts AS ts2, s.final AS final2, s.issue AS issue2, NOT f.final AND s.ts IS NOT NULL AND s.ts < f.ts + INTERVAL 24 HOUR AS twice FROM r f LEFT JOIN r s ON s.fixture = f.fixture AND s.n = 2 WHERE f.n = 1),
 o AS (SELECT *, CASE WHEN final OR twice AND final2 THEN 'result_verified' WHEN twice AND issue2 = 'result_source_conflict' THEN 'manual_review_required' WHEN twice OR TIMESTAMP '{AS_OF}' >= ts + INTERVAL 24 HOUR THEN 'expired_unresolved' WHEN TIMESTAMP '{AS_OF}' >= ts + INTERVAL 45 MINUTE THEN 'retry_due' ELSE 'retry_scheduled' END AS status FROM b)
 SELECT fixture, status, CASE WHEN twice THEN 2 ELSE 1 END AS attempts, CASE WHEN status = 'retry_scheduled' THEN strftime(ts + INTERVAL 45 MINUTE, '%Y-%m-%d %H:%M:%S') END AS due, CASE WHEN status <> 'result_verified' THEN CASE WHEN twice THEN issue2 ELSE issue END END AS reason FROM o""")
def retry_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    final = F.expr("case l_linestatus when 'F' then null else l_returnflag = 'R' end")
    issue = F.expr("case l_partkey % 3 when 0 then 'result_source_conflict' when 1 then 'not_found' end")
    minutes = ((F.col("l_suppkey") * 37 + F.col("l_linenumber") * 11) % 2880).cast("int")
    at = F.to_timestamp(F.lit("1995-06-16")) + F.make_interval(mins=minutes)
    checks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fixture"), F.col("l_linenumber").alias("event_id"), final.alias("final"), issue.alias("issue"), at.alias("ts"))
    return stateful.retry_outcomes(checks, AS_OF).withColumn("due", F.date_format("due", "yyyy-MM-dd HH:mm:ss"))
