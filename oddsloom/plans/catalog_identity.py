"""Named queries of alias groups, provider bindings, events of a pair and alike pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.operators import identity
from oddsloom.plans.adapters import table
from oddsloom.plans.catalog import query


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier is a team that also goes by the next one's name, but for every fifth: chains of five."""
    name = "concat('Team ', s_suppkey)"
    after = "if(s_suppkey % 5 <> 4, array(concat('TEAM&nbsp;', s_suppkey + 1, ' (U19)')), null)"
    return table(spark, sf_dir, "supplier").selectExpr(f"{name} as canonical", f"{after} as aliases")


_GROUPS = """WITH s AS (SELECT s_suppkey AS k, s_suppkey // 5 AS g FROM supplier), c AS (SELECT g, min('team' || k) AS canonical FROM s GROUP BY 1),
 n AS (SELECT k, g FROM s UNION SELECT k + 1, g FROM s WHERE k % 5 <> 4), named AS (SELECT 'team' || k AS name, canonical FROM n JOIN c USING (g))"""


@query(_GROUPS + " SELECT * FROM named")
def alias_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.alias_groups(registry(spark, sf_dir))


@query(_GROUPS + ", t AS (SELECT c_custkey AS id, 'team' || c_custkey % 300 AS name FROM customer) SELECT id, coalesce(canonical, name) AS team FROM t LEFT JOIN named USING (name)")
def canonical_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("<b>Team</b> "), F.col("c_custkey") % 300).alias("home"))
    return identity.canonical_names(rows, "home", identity.alias_groups(registry(spark, sf_dir)), "team").select("id", "team")


_BINDINGS = """SELECT {key} % 200 AS match_key, {provider} AS provider, 'p' || {id} AS provider_id, {c} / 7 AS confidence, {v} AS verification, 'h' || {id} AS home, 'a' || {id} AS away, {at} AS verified_at FROM {t}"""
_OLD = _BINDINGS.format(key="o_custkey", provider="o_orderpriority", id="o_orderkey", c="(o_orderkey % 7)", v="o_orderstatus", at="o_orderdate", t="orders")
_NEW = _BINDINGS.format(key="l_suppkey", provider="l_returnflag", id="l_orderkey", c="(l_linenumber % 7)", v="'page'", at="l_shipdate", t="lineitem")


@query(f"""WITH b AS ({_OLD} UNION ALL {_NEW}), n AS (SELECT match_key, provider, arg_max({{'i': provider_id, 'c': confidence, 'v': verification}}, (verified_at, provider_id, confidence)) AS x, max(verified_at) AS verified_at FROM b GROUP BY ALL),
 m AS (SELECT match_key, arg_min({{'h': home, 'a': away}}, (verified_at, provider_id)) AS y FROM b GROUP BY 1) SELECT match_key, provider, x.i AS provider_id, strftime(verified_at, '%Y-%m-%d') AS verified_on, y.h AS home, y.a AS away FROM n JOIN m USING (match_key)""")
def bindings_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(key, provider, id, c, v, at, t):
        return table(spark, sf_dir, t).selectExpr(f"{key} % 200 as match_key", f"{provider} as provider", f"concat('p', {id}) as provider_id", f"{c} / 7 as confidence", f"{v} as verification", f"concat('h', {id}) as home", f"concat('a', {id}) as away", f"cast({at} as timestamp) as verified_at")

    old = rows("o_custkey", "o_orderpriority", "o_orderkey", "o_orderkey % 7", "o_orderstatus", "o_orderdate", "orders")
    new = rows("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber % 7", "'page'", "l_shipdate", "lineitem")
    return identity.upsert_bindings(old, new).select("match_key", "provider", "provider_id", F.date_format("verified_at", "yyyy-MM-dd").alias("verified_on"), "home", "away")


@query("""WITH t AS (SELECT o_orderkey AS id, o_custkey % 40 AS h, o_custkey % 37 + 3 AS a, CASE WHEN o_orderkey % 50 > 0 THEN o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT)) END AS t1 FROM orders),
 m AS (SELECT row_number() OVER () AS n, 'g' || l_orderkey % 900 AS group_id, l_partkey % 40 AS h, l_suppkey % 37 + 3 AS a, CASE WHEN l_linenumber <> 6 THEN l_shipdate + to_hours(CAST(l_linenumber * 5 AS BIGINT)) END AS t2, l_quantity AS liquidity FROM lineitem WHERE l_linenumber % 4 <> 3),
 f AS (SELECT id, group_id, liquidity, abs(epoch(t1) - epoch(t2)) AS apart FROM t JOIN m USING (h, a) WHERE t1 IS NULL OR t2 IS NULL OR abs(epoch(t1) - epoch(t2)) <= 64800),
 g AS (SELECT id, group_id, count(*) AS markets, sum(liquidity) AS liquidity, min(apart) AS apart FROM f GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY markets DESC, round(liquidity, 6) DESC, group_id) AS place, count(*) OVER (PARTITION BY id) AS groups FROM g)
 SELECT t.id, CASE WHEN group_id IS NULL THEN 'no_exact_event' ELSE 'exact_event' END AS status, group_id, markets, round(liquidity, 6) AS liquidity, coalesce(groups, 0) AS groups, round(apart / 3600, 4) AS hours_apart FROM t LEFT JOIN r ON t.id = r.id AND place = 1""")
def events_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kickoff = F.when(F.col("o_orderkey") % 50 > 0, F.col("o_orderdate") + F.make_interval(hours=(F.col("o_orderkey") % 24).cast("int")))
    side = lambda c: F.concat(F.lit("Side "), c)
    targets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), side(F.col("o_custkey") % 40).alias("home"), side(F.col("o_custkey") % 37 + 3).alias("away"), kickoff.alias("kickoff"))
    at = F.when(F.col("l_linenumber") != 6, F.col("l_shipdate") + F.make_interval(hours=(F.col("l_linenumber") * 5).cast("int")))
    # One title in four names something before the sides.
    forms = ["'side {0} V side {1}'", "'Side {0} vs. Side {1}'", "'SIDE {0} vs Side {1} - More Markets'", "'More: Side {0} vs Side {1}'"]
    title = F.expr("case l_linenumber % 4 " + " ".join(f"when {k} then concat(" + f.format("', l_partkey % 40, '", "', l_suppkey % 37 + 3, '") + ")" for k, f in enumerate(forms)) + " end")
    markets = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("g"), F.col("l_orderkey") % 900).alias("group_id"), title.alias("title"), at.alias("at"), F.col("l_quantity").cast("double").alias("liquidity"))
    return identity.events_of_pairs(targets, markets)


@query()
def alike_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings of what users say, against those of the answers; SQL has no such ratio, a test holds the operator against all pairs."""
    said = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", F.regexp_extract(F.lower("text"), r"^\W*(\w+)", 1).alias("home"), F.regexp_extract(F.lower("text"), r"^\W*\w+\W+(\w+)", 1).alias("away")).where("home <> '' and away <> ''")
    return identity.alike_pairs(said.where("role = 'user'"), said.where("role <> 'user'"))
