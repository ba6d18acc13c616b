"""Views of the given tables as priced-event data; the same mapping as SQL in ``VIEWS``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows of much work each, dealt evenly over tasks: a table of few bytes is one row group, which one task would read and then work on alone."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), key)


def quotes_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-way prices: ``event_id, match_id, provider, outcome, price, ts``."""
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click", "purchase"))
    return events.select(
        "event_id",
        (F.col("user_id") % 12).alias("match_id"),
        (F.regexp_extract("props", "([0-9]+)", 1).cast("long") % 8).alias("provider"),
        F.when(F.col("event_type") == "view", "home").when(F.col("event_type") == "click", "draw").otherwise("away").alias("outcome"),
        (1.01 + F.col("value") / 100).alias("price"),
        "ts",
    )


def line_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handicap and total quotes: ``event_id, match_id, provider, family, line, water, ts``."""
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "error"))
    return events.select(
        "event_id",
        (F.col("user_id") % 12).alias("match_id"),
        (F.regexp_extract("props", "([0-9]+)", 1).cast("long") % 8).alias("provider"),
        F.when(F.col("event_type") == "signup", "asian").otherwise("total").alias("family"),
        (F.round(F.col("value") / 40) / 4).alias("line"),
        (0.75 + (F.col("event_id") % 50) / 100).alias("water"),
        "ts",
    )


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring rates of a match for every part: ``match_id, lh, la, rho``."""
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("match_id"),
        (0.4 + (F.col("p_partkey") % 23) / 10).alias("lh"),
        (0.3 + (F.col("p_size") % 17) / 10).alias("la"),
        (-0.12 + (F.col("p_partkey") % 5) * 0.03).alias("rho"),
    )
    return dealt(rows, "match_id")


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated tickets with results, one for each line item."""
    items = table(spark, sf_dir, "lineitem")
    kind = "case l_linenumber % 7 when 0 then 'home' when 1 then 'over' when 2 then 'under' when 3 then 'draw' when 4 then 'away' when 5 then 'home_handicap' else 'away_handicap' end"
    return items.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ticket_id"),
        F.col("l_suppkey").alias("account"),
        F.expr(kind).alias("selection"),
        F.expr("case when l_linenumber % 7 in (1, 2) then 1.5 + (l_partkey % 9) * 0.25 when l_linenumber % 7 in (5, 6) then -1.5 + (l_partkey % 7) * 0.5 end").alias("line"),
        F.when(F.col("l_partkey") % 97 != 0, 1.2 + F.col("l_tax") * 20).alias("odds"),
        (0.2 + F.col("l_discount") * 4).alias("probability"),
        F.when(F.col("l_partkey") % 89 != 0, (F.col("l_quantity").cast("long") % 6)).alias("home_goals"),
        F.when(F.col("l_partkey") % 89 != 0, (F.col("l_partkey") % 6)).alias("away_goals"),
        F.col("l_shipdate").alias("kickoff"),
    )


#: The same views in SQL, by name.
VIEWS = {
    "quotes": """SELECT event_id, user_id % 12 AS match_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 8 AS provider,
        CASE event_type WHEN 'view' THEN 'home' WHEN 'click' THEN 'draw' ELSE 'away' END AS outcome, 1.01 + value / 100 AS price, ts
        FROM events WHERE event_type IN ('view', 'click', 'purchase')""",
    "lines": """SELECT event_id, user_id % 12 AS match_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 8 AS provider,
        CASE event_type WHEN 'signup' THEN 'asian' ELSE 'total' END AS family, round(value / 40) / 4 AS line, 0.75 + (event_id % 50) / 100 AS water, ts
        FROM events WHERE event_type IN ('signup', 'error')""",
    "rates": """SELECT p_partkey AS match_id, 0.4 + (p_partkey % 23) / 10 AS lh, 0.3 + (p_size % 17) / 10 AS la, -0.12 + (p_partkey % 5) * 0.03::DOUBLE AS rho FROM part""",
    "tickets": """SELECT l_orderkey * 10 + l_linenumber AS ticket_id, l_suppkey AS account,
        CASE l_linenumber % 7 WHEN 0 THEN 'home' WHEN 1 THEN 'over' WHEN 2 THEN 'under' WHEN 3 THEN 'draw' WHEN 4 THEN 'away' WHEN 5 THEN 'home_handicap' ELSE 'away_handicap' END AS selection,
        CAST(CASE WHEN l_linenumber % 7 IN (1, 2) THEN 1.5 + (l_partkey % 9) * 0.25 WHEN l_linenumber % 7 IN (5, 6) THEN -1.5 + (l_partkey % 7) * 0.5 END AS DOUBLE) AS line,
        CASE WHEN l_partkey % 97 <> 0 THEN 1.2 + l_tax * 20 END AS odds, 0.2 + l_discount * 4 AS probability,
        CASE WHEN l_partkey % 89 <> 0 THEN CAST(l_quantity AS BIGINT) % 6 END AS home_goals, CASE WHEN l_partkey % 89 <> 0 THEN l_partkey % 6 END AS away_goals, l_shipdate AS kickoff
        FROM lineitem""",
}


def with_views(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
