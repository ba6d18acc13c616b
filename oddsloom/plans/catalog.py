"""Named queries over the given tables, and the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.functions import text as fx
from oddsloom.operators import ledger, model, movement, quotes, resolve, review, rules, scores
from oddsloom.plans.adapters import line_quotes, quotes_long, rates, table, tickets, with_views
from oddsloom.streaming import live

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_LATEST = """, latest AS (SELECT match_id, provider, outcome, arg_max(price, (ts, event_id)) AS price FROM quotes WHERE price > 1 GROUP BY ALL),
 wide AS (SELECT match_id, provider, max(price) FILTER (outcome = 'home') AS h, max(price) FILTER (outcome = 'draw') AS d, max(price) FILTER (outcome = 'away') AS a FROM latest GROUP BY ALL),
 full3 AS (SELECT * FROM wide WHERE h IS NOT NULL AND d IS NOT NULL AND a IS NOT NULL)"""
_ENDS = """, ends AS (SELECT match_id, provider, outcome, arg_min(price, (ts, event_id)) AS open, arg_max(price, (ts, event_id)) AS current, count(*) AS points FROM quotes WHERE price > 1 GROUP BY ALL)"""
_TIER = "CASE provider WHEN 0 THEN 'sharp' WHEN 1 THEN 'sharp' WHEN 2 THEN 'asian' WHEN 3 THEN 'asian' WHEN 4 THEN 'broad' WHEN 5 THEN 'broad' WHEN 6 THEN 'broad' END"


@query(
    with_views("quotes") + _LATEST + """, p AS (SELECT match_id, 1/h/(1/h+1/d+1/a) AS h, 1/d/(1/h+1/d+1/a) AS d, 1/a/(1/h+1/d+1/a) AS a FROM full3),
 m AS (SELECT match_id, count(*) AS providers, round(avg(h), 6) AS p_home, round(avg(d), 6) AS p_draw, round(avg(a), 6) AS p_away FROM p GROUP BY 1)
 SELECT *, CASE greatest(p_home, p_draw, p_away) WHEN p_home THEN 'home' WHEN p_draw THEN 'draw' ELSE 'away' END AS leader FROM m"""
)
def consensus_devig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.consensus_devig(quotes_long(spark, sf_dir))


@query(
    with_views("quotes") + _LATEST + """, z AS (SELECT *, greatest(0.0, (1/h+1/d+1/a-1)/2) AS z FROM full3), r AS (SELECT match_id, provider, (1-z)/((1-z)*h+z) AS h, (1-z)/((1-z)*d+z) AS d, (1-z)/((1-z)*a+z) AS a FROM z)
 SELECT match_id, provider, round(h/(h+d+a), 6) AS p_home, round(d/(h+d+a), 6) AS p_draw, round(a/(h+d+a), 6) AS p_away FROM r"""
)
def shin_devig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.shin_devig(quotes_long(spark, sf_dir))


@query(
    with_views("quotes") + """, s AS (SELECT match_id, outcome, price, CAST(event_id % 100 AS DOUBLE) AS stake FROM quotes)
 SELECT match_id, round(sum(stake) - coalesce(sum(stake*price) FILTER (outcome='home'), 0), 4) AS profit_home, round(sum(stake) - coalesce(sum(stake*price) FILTER (outcome='draw'), 0), 4) AS profit_draw,
 round(sum(stake) - coalesce(sum(stake*price) FILTER (outcome='away'), 0), 4) AS profit_away FROM s GROUP BY 1"""
)
def operator_pl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.operator_profit(quotes_long(spark, sf_dir).withColumn("stake", (F.col("event_id") % 100).cast("double")))


@query(with_views("quotes") + _ENDS + f""" SELECT match_id, coalesce({_TIER}, 'unmapped') AS tier, outcome, count(DISTINCT provider) AS providers, round(avg(open), 6) AS mean_open, round(avg(current), 6) AS mean_current FROM ends GROUP BY ALL""")
def tier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.tier_panel(quotes_long(spark, sf_dir))


@query(
    with_views("quotes") + f""", c AS (SELECT *, CASE WHEN price <> lag(price) OVER w THEN ts END AS changed FROM quotes WHERE price > 1 WINDOW w AS (PARTITION BY match_id, provider, outcome ORDER BY ts, event_id)),
 g AS (SELECT match_id, provider, outcome, arg_min(price, (ts, event_id)) AS open, arg_max(price, (ts, event_id)) AS current, count(*) AS n, stddev_pop(price) AS sigma, max(changed) AS lc, max(ts) AS latest FROM c GROUP BY ALL),
 s AS (SELECT match_id, outcome, {_TIER} AS tier, CASE WHEN abs(current-open) < greatest(0.02*open, CASE WHEN n >= 3 THEN 1.5*sigma ELSE 0 END) THEN 0.0
  ELSE (CASE WHEN current < open THEN 1.0 ELSE -1.0 END) * least(abs((current-open)/open)/0.10, 1.0) * exp(-coalesce((epoch_us(latest)-epoch_us(lc))/3.6e9, 0.0)/24) END AS signal FROM g),
 t AS (SELECT match_id, outcome, tier, avg(signal) AS score, CASE tier WHEN 'sharp' THEN 0.5 WHEN 'asian' THEN 0.3 ELSE 0.2 END::DOUBLE AS w FROM s WHERE tier IS NOT NULL GROUP BY ALL)
 SELECT match_id, outcome, round(sum(w*score)/sum(w), 6) AS signed_score, count(*) AS tiers FROM t GROUP BY ALL"""
)
def scs_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.scs_score(quotes_long(spark, sf_dir))


@query(
    with_views("quotes") + _ENDS + """, s AS (SELECT match_id, outcome, stddev_pop(current)*100 AS x FROM ends GROUP BY ALL), w AS (SELECT match_id, max(x) FILTER (outcome='home')*0.5 + max(x) FILTER (outcome='draw')*0.3 + max(x) FILTER (outcome='away')*0.2 AS r FROM s GROUP BY 1)
 SELECT match_id, round(r, 6) AS raw, CASE WHEN r < 12 THEN 'tight' WHEN r <= 35 THEN 'normal' WHEN r <= 60 THEN 'high' ELSE 'extreme' END AS risk_band FROM w WHERE r IS NOT NULL"""
)
def dri_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.dri_band(quotes_long(spark, sf_dir))


@query(
    with_views("lines") + """, x AS (SELECT *, 0.95 - (event_id % 40) / 100 AS away FROM lines WHERE family = 'asian'), e AS (SELECT match_id, provider, arg_min(line, (ts, event_id)) AS l0, arg_max(line, (ts, event_id)) AS l1, arg_max(water, (ts, event_id)) - arg_min(water, (ts, event_id)) AS h, arg_max(away, (ts, event_id)) - arg_min(away, (ts, event_id)) AS a FROM x GROUP BY ALL),
 s AS (SELECT match_id, count(*) AS sources, count(*) FILTER (h < 0 OR a > 0) AS home_in, count(*) FILTER (NOT (h < 0 OR a > 0) AND (h > 0 OR a < 0)) AS home_out, count(*) FILTER (h = 0 AND a = 0) AS neutral FROM e WHERE l0 = l1 GROUP BY 1)
 SELECT *, round(abs(home_in-home_out)/sources, 6) AS flow_ratio, CASE WHEN home_in > home_out THEN 'home' WHEN home_in < home_out THEN 'away' ELSE 'neutral' END AS direction FROM s"""
)
def water_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.water_flow(line_quotes(spark, sf_dir).withColumn("water_away", 0.95 - (F.col("event_id") % 40) / 100))


@query(
    with_views("quotes") + """, m AS (SELECT *, lag(price) OVER (PARTITION BY match_id, provider, outcome ORDER BY ts, event_id) AS b FROM quotes WHERE price > 1), c AS (SELECT * FROM m WHERE abs(price-b) >= 0.01),
 f AS (SELECT match_id, provider, min(event_id) AS event_id, arg_min(outcome, (ts, event_id)) AS outcome, arg_min(CASE WHEN price < b THEN 'shortened' ELSE 'lengthened' END, (ts, event_id)) AS direction, count(DISTINCT outcome) AS outcomes FROM c GROUP BY ALL)
 SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY event_id) AS place FROM f"""
)
def trend_first_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.trend_first_move(quotes_long(spark, sf_dir))


@query(
    with_views("quotes") + """, v AS (SELECT event_id, match_id, epoch_us(ts) AS us, sum(price) OVER (PARTITION BY match_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS volume FROM quotes),
 r AS (SELECT *, coalesce(first_value(volume) OVER (PARTITION BY match_id ORDER BY us RANGE BETWEEN 14400000000 PRECEDING AND 1 PRECEDING), lag(volume) OVER (PARTITION BY match_id ORDER BY us)) AS ref FROM v)
 SELECT event_id, match_id, round(volume/ref, 6) AS growth FROM r WHERE ref IS NOT NULL"""
)
def exchange_growth_4h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.exchange_growth(quotes_long(spark, sf_dir))


@query(
    with_views("quotes", "lines") + """, e AS (SELECT match_id, provider, family, arg_min(line, (ts, event_id)) AS o, arg_max(line, (ts, event_id)) AS c, arg_max(water, (ts, event_id)) AS w FROM lines GROUP BY ALL),
 b AS (SELECT match_id, round(median(abs(c)) FILTER (family='asian' AND c BETWEEN -5 AND 5), 6) AS asian_line, round(median(abs(o)) FILTER (family='asian' AND o BETWEEN -5 AND 5), 6) AS asian_open, round(median(c) FILTER (family='total' AND c BETWEEN 1 AND 5), 6) AS total_line, round(stddev_pop(w) FILTER (family='asian'), 6) AS water_sigma FROM e GROUP BY 1),
 h AS (SELECT match_id, provider, arg_min(price, (ts, event_id)) AS o, arg_max(price, (ts, event_id)) AS c FROM quotes WHERE price > 1 AND outcome = 'home' GROUP BY ALL),
 p AS (SELECT match_id, round(max(c)-min(c), 6) AS home_spread, round(max(c/o-1) FILTER (provider=0), 6) AS lead_change FROM h GROUP BY 1)
 SELECT coalesce(b.match_id, p.match_id) AS match_id, asian_line, asian_open, total_line, water_sigma, home_spread, lead_change FROM b FULL JOIN p ON b.match_id = p.match_id"""
)
def market_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.market_metrics(quotes_long(spark, sf_dir), line_quotes(spark, sf_dir))


@query(
    with_views("quotes") + _LATEST + """, b AS (SELECT match_id, max(price) FILTER (outcome='home') AS h, max(price) FILTER (outcome='draw') AS d, max(price) FILTER (outcome='away') AS a FROM latest GROUP BY 1), t AS (SELECT *, 1/h+1/d+1/a AS t FROM b WHERE h IS NOT NULL AND d IS NOT NULL AND a IS NOT NULL)
 SELECT match_id, round(t, 6) AS inverse_sum, t < 1 AS arbitrage, round(1/h/t, 6) AS stake_home, round(1/d/t, 6) AS stake_draw, round(1/a/t, 6) AS stake_away FROM t"""
)
def arbitrage_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.arbitrage(quotes_long(spark, sf_dir))


@query(
    with_views("quotes") + """, k AS (SELECT match_id, max(ts) - INTERVAL 7 DAY AS cutoff FROM quotes GROUP BY 1), r AS (SELECT q.*, cutoff FROM quotes q JOIN k USING (match_id) WHERE ts <= cutoff)
 SELECT match_id, provider, outcome, arg_max(price, (ts, event_id)) AS price, arg_max(event_id, (ts, event_id)) AS event_id FROM r GROUP BY ALL"""
)
def asof_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = quotes_long(spark, sf_dir)
    cutoffs = history.groupBy("match_id").agg((F.max("ts") - F.expr("interval 7 days")).alias("cutoff"))
    return movement.asof_latest(history, cutoffs, ["match_id", "provider", "outcome"], "match_id")


@query(
    with_views("quotes") + """, d AS (SELECT *, date_trunc('day', ts) AS day FROM quotes), p AS (SELECT match_id, day, round(avg(price), 9) AS mean, arg_max(outcome, (price, event_id)) AS leader FROM d GROUP BY ALL),
 t AS (SELECT *, CAST(leader <> lag(leader) OVER (PARTITION BY match_id ORDER BY day) AS INT) AS turn FROM p)
 SELECT match_id, count(*) AS snapshots, round(arg_max(mean, day) - arg_min(mean, day), 6) AS delta, CAST(coalesce(sum(turn), 0) AS BIGINT) AS reversals FROM t GROUP BY 1"""
)
def checkpoint_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = quotes_long(spark, sf_dir).groupBy("match_id", F.date_trunc("day", "ts").alias("day")).agg(F.round(F.avg("price"), 9).alias("mean"), F.max_by("outcome", F.struct("price", "event_id")).alias("leader"))
    return movement.checkpoint_movement(daily, "match_id", "mean", "leader", ["day"])


@query(
    """WITH t AS (SELECT conv_id, turn, role, length(text) // 200 AS size, lag(role) OVER w AS r, lag(length(text) // 200) OVER w AS s, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role))
 SELECT conv_id, turn, role FROM t WHERE n = 1 OR r IS DISTINCT FROM role OR s IS DISTINCT FROM size"""
)
def decision_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.floor(F.length("text") / 200).alias("size"))
    return movement.changed_rows(rows, ["conv_id"], ["role", "size"], ["turn", "role"]).select("conv_id", "turn", "role")


@query(
    with_views("lines") + """, t AS (SELECT *, lag(line) OVER w AS b, row_number() OVER w AS n FROM lines WINDOW w AS (PARTITION BY match_id, provider, family ORDER BY ts, event_id))
 SELECT event_id, match_id, provider, family, line FROM t WHERE n = 1 OR b <> line"""
)
def cdc_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return movement.changed_rows(line_quotes(spark, sf_dir), ["match_id", "provider", "family"], ["line"], ["ts", "event_id"]).select("event_id", "match_id", "provider", "family", "line")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text, lang")
def fingerprint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return movement.dedup_by_content(table(spark, sf_dir, "documents"), ["text", "lang"], "doc_id").select("doc_id", "copies")


@query(
    """WITH p AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 5 <> 0), s AS (SELECT c_custkey AS id, 'second ' || c_name AS name, c_mktsegment AS segment FROM customer)
 SELECT coalesce(p.id, s.id) AS id, coalesce(nullif(p.name, ''), s.name) AS name, coalesce(nullif(p.segment, ''), s.segment) AS segment, CASE WHEN p.id IS NULL THEN 'secondary' ELSE 'primary' END AS source FROM p FULL JOIN s ON p.id = s.id"""
)
def primary_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    primary = rows.where("id % 5 <> 0").withColumn("segment", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("segment")))
    return movement.fill_from_secondary(primary, rows.withColumn("name", F.concat(F.lit("second "), "name")), "id", ["name", "segment"])


@query(
    """WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS v FROM orders), l AS (SELECT l_orderkey AS id, max(l_linestatus) AS v FROM lineitem GROUP BY 1)
 SELECT coalesce(o.id, l.id) AS id, CASE WHEN o.v IS NULL THEN 'not_final' WHEN l.v IS NULL THEN 'secondary_missing' WHEN o.v = l.v THEN 'agree' ELSE 'conflict' END AS status,
 CASE WHEN NOT (o.v IS NOT NULL AND l.v IS NOT NULL AND o.v <> l.v) THEN coalesce(o.v, l.v) END AS v FROM o FULL JOIN l ON o.id = l.id"""
)
def dual_source_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("v"))
    second = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_linestatus").alias("v"))
    return movement.reconcile(first, second, "id", "v")


@query(
    """SELECT o_custkey AS custkey, count(*) AS rows, arg_max(o_orderkey, (o_orderpriority = '1-URGENT', o_totalprice, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderpriority = '1-URGENT', o_totalprice, o_orderkey)) AS o_orderstatus FROM orders GROUP BY 1"""
)
def survivorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = [(F.col("o_orderpriority") == "1-URGENT"), F.col("o_totalprice"), F.col("o_orderkey")]
    return movement.survivors(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "custkey"), "custkey", rank, ["o_orderkey", "o_orderstatus"])


@query()
def entity_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a second listing of them with changed names and times; the ratio is a Python function."""
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("club "), (F.col("o_custkey") * 7919).cast("string")).alias("home"), F.concat(F.lit("team "), (F.col("o_orderkey") * 104729).cast("string")).alias("away"), (F.col("o_orderdate") + F.make_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))).alias("kickoff"))
    other = base.select((F.col("id") + 1_000_000_000).alias("id"), F.when(F.col("id") % 3 == 0, F.concat("home", F.lit(" fc"))).otherwise(F.col("home")).alias("home"), "away", (F.col("kickoff") + F.make_interval(mins=(F.col("id") % 90).cast("int"))).alias("kickoff"))
    return resolve.resolve(base, other)


@query("SELECT s_nationkey AS nation, count(DISTINCT s_suppkey) AS candidates, CASE WHEN count(DISTINCT s_suppkey) = 1 THEN min(s_suppkey) END AS s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000 GROUP BY 1")
def alias_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return resolve.unique_or_null(pairs.withColumnRenamed("s_nationkey", "nation"), "nation", "s_suppkey")


_MATRIX = """, grid AS (SELECT match_id, lh, la, rho, h, a FROM rates, range(13) x(h), range(13) y(a)),
 raw AS (SELECT match_id, h, a, greatest(0.0, exp(-lh)*pow(lh,h)/factorial(CAST(h AS INT)) * exp(-la)*pow(la,a)/factorial(CAST(a AS INT)) * CASE WHEN h=0 AND a=0 THEN 1-lh*la*rho WHEN h=0 AND a=1 THEN 1+lh*rho WHEN h=1 AND a=0 THEN 1+la*rho WHEN h=1 AND a=1 THEN 1-rho ELSE 1 END) AS w FROM grid),
 matrix AS (SELECT match_id, h, a, w / sum(w) OVER (PARTITION BY match_id) AS p FROM raw)"""


@query(with_views("rates") + _MATRIX + " SELECT match_id, CAST(h AS INT) AS h, CAST(a AS INT) AS a, round(p, 6) AS p FROM matrix")
def score_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.score_matrix(rates(spark, sf_dir)).select("match_id", "h", "a", F.round("p", 6).alias("p"))


@query(
    with_views("rates") + _MATRIX + """ SELECT match_id, round(sum(p) FILTER (h > a), 6) AS p_home, round(sum(p) FILTER (h = a), 6) AS p_draw, round(sum(p) FILTER (h < a), 6) AS p_away, round(sum(p) FILTER (h > 0 AND a > 0), 6) AS p_btts,
 round(sum(p) FILTER (h + a > 2), 6) AS p_over25, round(sum(p) FILTER (h + a IN (1, 3)), 6) AS p_total_1_or_3 FROM matrix GROUP BY 1"""
)
def score_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.score_marginals(rates(spark, sf_dir))


@query(
    with_views("rates") + _MATRIX + """, r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY round(p, 9) DESC, h, a) AS n FROM matrix) SELECT match_id, CAST(n AS INT) AS place, CAST(h AS INT) AS h, CAST(a AS INT) AS a, round(p, 6) AS p, round(1/p, 3) AS fair_odds FROM r WHERE n <= 10"""
)
def score_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.top_scores(rates(spark, sf_dir))


def _settled(lines: str, margin: str) -> str:
    return with_views("rates") + _MATRIX + f""", l AS (SELECT *, unnest({lines}) AS line FROM matrix), u AS (SELECT *, round(line*4) AS q FROM l), w AS (SELECT *, CASE WHEN q % 2 <> 0 THEN (q-1)/4 ELSE q/4 END AS p1, CASE WHEN q % 2 <> 0 THEN (q+1)/4 ELSE q/4 END AS p2 FROM u),
 n AS (SELECT match_id, line, p, sign(round({margin.replace('part', 'p1')}, 6)) + sign(round({margin.replace('part', 'p2')}, 6)) AS net FROM w),
 s AS (SELECT match_id, line, coalesce(sum(p) FILTER (net=2), 0) AS fw, coalesce(sum(p) FILTER (net=1), 0) AS hw, coalesce(sum(p) FILTER (net=0), 0) AS pu, coalesce(sum(p) FILTER (net=-1), 0) AS hl, coalesce(sum(p) FILTER (net=-2), 0) AS fl FROM n GROUP BY ALL)
 SELECT match_id, line, round(fw, 6) AS full_win, round(hw, 6) AS half_win, round(pu, 6) AS push, round(hl, 6) AS half_loss, round(fl, 6) AS full_loss, round(fw+hw/2-fl-hl/2, 6) AS net_at_2, round(1+(fl+hl/2)/(fw+hw/2), 4) AS fair_odds FROM s"""


@query(_settled("[-1.0, -0.75, -0.25, 0.0, 0.5]::DOUBLE[]", "h-a+part"))
def asian_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.settle_lines(rates(spark, sf_dir), [-1.0, -0.75, -0.25, 0.0, 0.5], "handicap")


@query(_settled("[2.0, 2.25, 2.5, 2.75]::DOUBLE[]", "h+a-part"))
def total_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.settle_lines(rates(spark, sf_dir), [2.0, 2.25, 2.5, 2.75], "over")


@query(
    with_views("rates") + _MATRIX + """, m AS (SELECT match_id, h-a AS margin, sum(p) AS p FROM matrix GROUP BY ALL), l AS (SELECT *, unnest(range(-20, 21)) AS q FROM m),
 n AS (SELECT match_id, q/4 AS line, p, sign(round(margin + CASE WHEN q % 2 <> 0 THEN (q-1)/4 ELSE q/4 END, 6)) + sign(round(margin + CASE WHEN q % 2 <> 0 THEN (q+1)/4 ELSE q/4 END, 6)) AS net FROM l),
 o AS (SELECT match_id, line, round(1 + coalesce(sum(-net*p/2) FILTER (net < 0), 0) / sum(net*p/2) FILTER (net > 0), 6) AS odds FROM n GROUP BY ALL HAVING sum(net*p/2) FILTER (net > 0) > 0)
 SELECT match_id, arg_min(line, (round(abs(odds-2), 5), abs(line), line)) AS line, round(arg_min(odds, (round(abs(odds-2), 5), abs(line), line)), 4) AS fair_odds FROM o GROUP BY 1"""
)
def fair_line_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.fair_line(rates(spark, sf_dir))


_HALF = lambda k: f"""d{k} AS (SELECT match_id, h-a AS d{k}, sum(exp(-h{k})*pow(h{k},h)/factorial(CAST(h AS INT)) * exp(-a{k})*pow(a{k},a)/factorial(CAST(a AS INT))) AS p FROM halves, range(11) x(h), range(11) y(a) GROUP BY ALL)"""
_JOINT = with_views("rates") + f""", halves AS (SELECT match_id, lh*0.45::DOUBLE AS h1, la*0.42::DOUBLE AS a1, lh*0.55::DOUBLE AS h2, la*0.58::DOUBLE AS a2 FROM rates), {_HALF(1)}, {_HALF(2)}, j AS (SELECT match_id, CASE WHEN d1 > 0 THEN 'H' WHEN d1 = 0 THEN 'D' ELSE 'A' END AS half, CASE WHEN d1+d2 > 0 THEN 'H' WHEN d1+d2 = 0 THEN 'D' ELSE 'A' END AS "full", sum(d1.p*d2.p) AS p FROM d1 JOIN d2 USING (match_id) GROUP BY ALL),
 joint AS (SELECT match_id, half, "full", round(p / sum(p) OVER (PARTITION BY match_id), 6) AS p FROM j)"""


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(spark, sf_dir).select("match_id", *[(F.col(c) * share).alias(n) for c, share, n in (("lh", 0.45, "h1"), ("la", 0.42, "a1"), ("lh", 0.55, "h2"), ("la", 0.58, "a2"))])


@query(_JOINT + """ SELECT match_id, round(sum(p) FILTER (half='H'), 6) AS half_h, round(sum(p) FILTER (half='D'), 6) AS half_d, round(sum(p) FILTER (half='A'), 6) AS half_a, round(sum(p) FILTER ("full"='H'), 6) AS full_h, round(sum(p) FILTER ("full"='D'), 6) AS full_d, round(sum(p) FILTER ("full"='A'), 6) AS full_a, round(sum(p) FILTER (half='H' AND "full"='H')/sum(p) FILTER (half='H'), 4) AS hold_lead FROM joint GROUP BY 1""")
def htft_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.half_time_marginals(scores.half_full_time(_halves(spark, sf_dir)))


@query(_JOINT + " SELECT * FROM joint")
def htft_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.half_full_time(_halves(spark, sf_dir))


@query(
    with_views("rates") + """, k AS (SELECT match_id, lh, la, sum(exp(-lh)*pow(lh,g)/factorial(CAST(g AS INT))) AS x, sum(exp(-la)*pow(la,g)/factorial(CAST(g AS INT))) AS y FROM rates, range(13) t(g) GROUP BY ALL)
 SELECT match_id, round(x*y, 9) AS retained, 1-x*y <= 1e-6 AS pricing_allowed FROM k"""
)
def truncation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.truncation_audit(rates(spark, sf_dir))


def nearest_share_sql(aim: str, name: str) -> str:
    """All 699 shares of each row ``(match_id, total, th, td, ta)`` of ``aim``, and the nearest as table ``name``."""
    pmf = lambda rate: f"list_transform(range(13), lambda g: exp(-({rate})) * pow({rate}, g) / factorial(CAST(g AS INT)))"
    return f""", {name}_1 AS (SELECT match_id, th, td, ta, k, {pmf("total * k / 1000.0::DOUBLE")} AS ph, {pmf("total * (1 - k / 1000.0::DOUBLE)")} AS pa FROM {aim}, range(151, 850) x(k)),
 {name}_2 AS (SELECT *, list_sum(ph) * list_sum(pa) AS mass, list_sum(list_transform(range(1, 13), lambda g: ph[g + 1] * list_sum(pa[1 : g]))) AS w, list_sum(list_transform(range(1, 14), lambda g: ph[g] * pa[g])) AS d FROM {name}_1),
 {name} AS (SELECT match_id, arg_min(k, (round(pow(w / mass - th, 2) + pow(d / mass - td, 2) + pow(1 - (w + d) / mass - ta, 2), 9), k)) / 1000 AS share FROM {name}_2 GROUP BY 1)"""


@query(with_views("rates") + ", aim AS (SELECT match_id, lh + la AS total, 0.30 + (match_id % 30) / 100 AS th, 0.25::DOUBLE AS td, 0.45 - (match_id % 30) / 100 AS ta FROM rates)" + nearest_share_sql("aim", "found") + " SELECT match_id, share FROM found")
def share_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = rates(spark, sf_dir)
    home = 0.30 + (F.col("match_id") % 30) / 100
    targets = base.select("match_id", home.alias("t_home"), F.lit(0.25).alias("t_draw"), (1 - home - 0.25).alias("t_away"))
    return model.share_search(base, targets)


_STAKED = """, e AS (SELECT *, probability*odds-1 AS ev FROM tickets), k AS (SELECT *, round(floor((least(100.0*greatest(0.0, ev/(odds-1)*0.25), 5.0) + 1e-9)/0.01)*0.01, 2) AS st FROM e),
 staked AS (SELECT * EXCLUDE (st), CASE WHEN odds IS NULL OR probability IS NULL THEN 'missing_price_or_probability' WHEN ev <= 1e-12 THEN 'rejected_non_positive_ev' WHEN st < 2.0 THEN 'rejected_below_platform_minimum' ELSE 'paper_candidate' END AS sizing_status,
  CASE WHEN odds IS NOT NULL AND ev > 1e-12 AND st >= 2.0 THEN st ELSE 0.0 END::DOUBLE AS stake_units FROM k)"""
_SETTLED = _STAKED + """, f AS (SELECT *, round(line*4) AS q FROM staked), f2 AS (SELECT *, CASE WHEN q % 2 <> 0 THEN (q-1)/4 ELSE line END AS lo, CASE WHEN q % 2 <> 0 THEN (q+1)/4 ELSE line END AS hi FROM f),
 f3 AS (SELECT *, CASE WHEN home_goals IS NULL OR away_goals IS NULL THEN NULL WHEN selection='home' THEN (CASE WHEN home_goals > away_goals THEN 1.0 ELSE -1.0 END) WHEN selection='draw' THEN (CASE WHEN home_goals = away_goals THEN 1.0 ELSE -1.0 END)
  WHEN selection='away' THEN (CASE WHEN home_goals < away_goals THEN 1.0 ELSE -1.0 END) WHEN selection='over' THEN (sign(home_goals+away_goals-lo)+sign(home_goals+away_goals-hi))/2 WHEN selection='under' THEN -(sign(home_goals+away_goals-lo)+sign(home_goals+away_goals-hi))/2
  WHEN selection='home_handicap' THEN sign(home_goals-away_goals+line) WHEN selection='away_handicap' THEN sign(away_goals-home_goals+line) END AS fa FROM f2),
 s0 AS (SELECT *, CASE WHEN odds IS NULL THEN 'observed_no_price' WHEN starts_with(sizing_status, 'rejected') THEN 'rejected_by_ev' WHEN home_goals IS NULL THEN 'pending' ELSE 'settled' END AS status FROM f3),
 settled AS (SELECT *, CASE WHEN status='settled' THEN (CASE WHEN fa=1 THEN 'win' WHEN fa>0 THEN 'half_win' WHEN fa=0 THEN 'push' WHEN fa>-1 THEN 'half_loss' ELSE 'loss' END) END AS settlement,
  CASE WHEN status='settled' THEN round(CASE WHEN fa>0 THEN stake_units*(odds-1)*fa ELSE stake_units*fa END, 4) + 0 WHEN status='rejected_by_ev' THEN 0.0 END AS profit_units FROM s0)"""


@query(with_views("tickets") + _STAKED + " SELECT ticket_id, round(ev, 6) AS sizing_ev, sizing_status, stake_units FROM staked")
def kelly_staking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.with_stake(tickets(spark, sf_dir)).select("ticket_id", F.round("sizing_ev", 6).alias("sizing_ev"), "sizing_status", "stake_units")


@query(with_views("tickets") + _SETTLED + " SELECT ticket_id, status, settlement, round(profit_units, 3) AS profit_units FROM settled")
def ticket_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.settle(ledger.with_stake(tickets(spark, sf_dir))).select("ticket_id", "status", "settlement", F.round(F.col("profit_units") + F.lit(0.0), 3).alias("profit_units"))


@query(
    with_views("tickets") + _SETTLED + """, c AS (SELECT account, ticket_id, kickoff, sum(profit_units) OVER (PARTITION BY account ORDER BY kickoff, ticket_id ROWS UNBOUNDED PRECEDING) AS curve FROM settled WHERE status='settled'),
 d AS (SELECT *, greatest(0.0, max(curve) OVER (PARTITION BY account ORDER BY kickoff, ticket_id ROWS UNBOUNDED PRECEDING)) AS peak FROM c), m AS (SELECT account, round(greatest(0.0, max(peak-curve)), 4) AS max_drawdown FROM d GROUP BY 1),
 s AS (SELECT account, count(*) FILTER (status='settled') AS settled, count(*) FILTER (status='pending') AS pending, count(*) FILTER (status='rejected_by_ev') AS rejected, count(*) FILTER (starts_with(status,'observed')) AS observed,
  sum(stake_units) FILTER (status='settled') AS st, sum(profit_units) FILTER (status='settled') AS pr, count(*) FILTER (status='settled' AND profit_units > 0) AS wins, count(*) FILTER (status='settled' AND profit_units < 0) AS losses FROM settled GROUP BY 1)
 SELECT s.account, settled, pending, rejected, observed, round(st, 3) AS stake, round(pr, 3) AS profit, round(round(pr, 4)/nullif(round(st, 4), 0), 6) AS roi, wins, losses, round(wins/nullif(wins+losses, 0), 6) AS hit_rate, round(max_drawdown, 3) AS max_drawdown FROM s LEFT JOIN m ON s.account = m.account"""
)
def ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.summarise(ledger.settle(ledger.with_stake(tickets(spark, sf_dir))), "account")
    return out.withColumns({"stake": F.round("stake", 3), "profit": F.round("profit", 3), "max_drawdown": F.round("max_drawdown", 3)})


@query(
    with_views("tickets") + _SETTLED + """, g AS (SELECT *, CASE WHEN selection IN ('home','draw','away') THEN '1x2' WHEN selection IN ('over','under') THEN 'total' WHEN contains(selection,'handicap') THEN 'handicap' ELSE 'score' END AS mg FROM settled WHERE status='settled')
 SELECT coalesce(mg, 'all') AS market_group, count(*) AS tickets, round(sum(stake_units), 2) AS stake, round(sum(profit_units), 2) AS profit FROM g GROUP BY ROLLUP (mg)"""
)
def ledger_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.by_group(ledger.settle(ledger.with_stake(tickets(spark, sf_dir)))).withColumn("profit", F.round("profit", 2))


@query(
    with_views("tickets") + _STAKED + """, l AS (SELECT *, CASE WHEN stake_units >= 4 THEN 'core' WHEN stake_units > 0 THEN 'upside' ELSE 'watch' END AS layer FROM staked)
 SELECT account, count(*) FILTER (layer='core') AS core_tickets, round(coalesce(sum(stake_units) FILTER (layer='core'), 0), 2) AS core_exposure, count(*) FILTER (layer='upside') AS upside_tickets, round(coalesce(sum(stake_units) FILTER (layer='upside'), 0), 2) AS upside_exposure,
 count(*) FILTER (layer='watch') AS watch_tickets, round(coalesce(sum(stake_units) FILTER (layer='watch'), 0), 2) AS watch_exposure, count(*) > 1 AS overlap FROM l GROUP BY 1"""
)
def portfolio_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.portfolio_layers(ledger.with_stake(tickets(spark, sf_dir)), "account")


@query(
    with_views("tickets") + """, o AS (SELECT account, selection, line, min(ticket_id) AS t FROM tickets WHERE ticket_id % 3 = 0 GROUP BY ALL), n AS (SELECT account, selection, line, min(ticket_id) AS t FROM tickets WHERE ticket_id % 3 <> 0 GROUP BY ALL)
 SELECT account, selection, coalesce(line, -99) AS line, t AS ticket_id FROM o UNION ALL SELECT account, selection, coalesce(line, -99), t FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.account=n.account AND o.selection=n.selection AND coalesce(o.line,-99)=coalesce(n.line,-99))"""
)
def frozen_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tickets(spark, sf_dir).withColumn("line", F.coalesce("line", F.lit(-99.0)))
    keys = ["account", "selection", "line"]
    old = rows.where("ticket_id % 3 = 0").groupBy(*keys).agg(F.min("ticket_id").alias("ticket_id"))
    return ledger.frozen(rows.where("ticket_id % 3 <> 0"), old, keys)


@query(
    """SELECT p_partkey AS id, CAST(2 + p_size % 3 AS INT) AS picks, CAST(1 + p_partkey % 4 AS INT) AS legs, 0.2 + (p_size % 10)/20 AS gross, CAST(pow(2 + p_size % 3, 1 + p_partkey % 4) AS BIGINT) AS combinations, round(pow((2 + p_size % 3) * (0.2 + (p_size % 10)/20), 1 + p_partkey % 4), 6) AS gross_factor FROM part"""
)
def coverage_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (2 + F.col("p_size") % 3).cast("int").alias("picks"), (1 + F.col("p_partkey") % 4).cast("int").alias("legs"), (0.2 + (F.col("p_size") % 10) / 20).alias("gross"))
    return ledger.coverage_ev(legs)


@query(
    with_views("quotes") + """, s AS (SELECT *, CASE provider % 4 WHEN 0 THEN 'official' WHEN 1 THEN 'exchange' WHEN 2 THEN 'book' ELSE 'other' END AS source FROM quotes), r AS (SELECT *, CASE source WHEN 'official' THEN 0 WHEN 'exchange' THEN 1 WHEN 'book' THEN 2 ELSE 99 END AS rk, user_key FROM (SELECT *, match_id * 10 + event_id % 10 AS user_key FROM s))
 SELECT user_key, arg_min(source, (rk, event_id)) AS source, arg_min(price, (rk, event_id)) AS price, arg_min(event_id, (rk, event_id)) AS event_id FROM r GROUP BY 1"""
)
def source_rank_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("provider") % 4
    rows = quotes_long(spark, sf_dir).withColumn("source", F.when(k == 0, "official").when(k == 1, "exchange").when(k == 2, "book").otherwise("other"))
    return ledger.best_source(rows.withColumn("user_key", F.col("match_id") * 10 + F.col("event_id") % 10), "user_key", {"official": 0, "exchange": 1, "book": 2})


@query(
    """WITH r AS (SELECT o_orderkey AS match_num, CAST(o_orderdate AS DATE) AS day, o_orderkey % 6 AS kickoff, CASE o_orderpriority WHEN '1-URGENT' THEN 96 WHEN '2-HIGH' THEN 88 WHEN '3-MEDIUM' THEN 78 ELSE 0 END AS base, o_orderkey % 3 <> 0 AS bound, o_totalprice > 50000 AS oc FROM orders),
 s AS (SELECT *, base + CASE WHEN bound THEN 5 ELSE 0 END + CASE WHEN oc THEN 4 ELSE 0 END AS sc FROM r), f AS (SELECT *, least(sc, 100) AS score FROM s WHERE sc >= 82 AND bound),
 k AS (SELECT *, CASE WHEN max(CASE WHEN base >= 88 THEN 1 ELSE 0 END) OVER (PARTITION BY day) = 1 THEN 8 WHEN dayofweek(day) IN (0, 6) THEN 6 ELSE 4 END AS cap, row_number() OVER (PARTITION BY day, kickoff ORDER BY score DESC, kickoff, match_num) AS n FROM f),
 p AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, kickoff, match_num) AS place FROM k WHERE n <= 2) SELECT match_num, CAST(day AS VARCHAR) AS day, CAST(score AS INT) AS score, place FROM p WHERE place <= cap"""
)
def core_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("match_num"), F.to_date("o_orderdate").alias("day"), (F.col("o_orderkey") % 6).alias("kickoff"),
        F.when(p == "1-URGENT", 96).when(p == "2-HIGH", 88).when(p == "3-MEDIUM", 78).otherwise(0).alias("tier_base"), (F.col("o_orderkey") % 3 != 0).alias("bound"), (F.col("o_totalprice") > 50000).alias("odds_complete"),
    )
    return rules.core_selection(rows).withColumn("day", F.col("day").cast("string"))


@query(
    """WITH t AS (SELECT l_suppkey AS team, CAST(l_quantity AS BIGINT) % 6 AS gf, l_partkey % 5 AS ga, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS n FROM lineitem)
 SELECT team, count(*) AS matches, count(*) FILTER (gf > ga) AS wins, count(*) FILTER (gf = ga) AS draws, count(*) FILTER (gf < ga) AS losses, CAST(sum(gf) AS BIGINT) AS goals_for, CAST(sum(ga) AS BIGINT) AS goals_against FROM t WHERE n <= 10 GROUP BY 1"""
)
def form_last10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("team"), (F.col("l_quantity").cast("long") % 6).alias("goals_for"), (F.col("l_partkey") % 5).alias("goals_against"), "l_shipdate", "l_orderkey", "l_linenumber")
    return review.form(rows, "team", ["l_shipdate", "l_orderkey", "l_linenumber"])


@query(
    """WITH s AS (SELECT user_id, sum(value) FILTER (event_type='purchase') AS b, sum(value) FILTER (event_type='click') AS s, count(*) AS n FROM events WHERE event_type IN ('purchase','click') GROUP BY 1), r AS (SELECT user_id, round(coalesce(b,0), 4) AS buy, round(coalesce(s,0), 4) AS sell, round(coalesce(b,0)-coalesce(s,0), 4) AS net, n FROM s)
 SELECT *, CASE WHEN net > 0 THEN 'in' WHEN net < 0 THEN 'out' ELSE 'flat' END AS direction FROM r"""
)
def flow_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type in ('purchase', 'click')").select("user_id", F.when(F.col("event_type") == "purchase", "buy").otherwise("sell").alias("action"), F.col("value").alias("volume"))
    return review.flow(rows, "user_id")


_RULES = {"deep_open": "asian_open >= 1.5", "line_up_price_flat": "asian_line - asian_open >= 0.25 AND abs(lead_change) < 0.05", "price_and_line_fall": "lead_change <= -0.05 AND asian_line - asian_open <= -0.25", "price_falls_line_still": "lead_change <= -0.05 AND abs(asian_line - asian_open) < 0.01", "large_price_move": "abs(lead_change) > 0.15", "wide_home_prices": "home_spread > 0.30", "wide_water": "water_sigma > 0.08", "high_total": "total_line >= 2.0"}


@query(
    ORACLE_SQL["market_metrics"].replace("SELECT coalesce(b.match_id", ", mm AS (SELECT coalesce(b.match_id") + ") " + " UNION ALL ".join(f"SELECT match_id, '{k}' AS rule, CASE WHEN {v} THEN 'triggered' WHEN NOT ({v}) THEN 'not_triggered' ELSE 'not_evaluable' END AS status FROM mm" for k, v in _RULES.items())
)
def rule_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.evaluate_rules(market_metrics(spark, sf_dir), "match_id", rules.market_rules())


@query(
    """WITH r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 <> 0 THEN (p_size % 5)/5 END AS sf, (p_size % 7)/10 AS gap, CAST(p_partkey % 80 AS DOUBLE) AS dri, (p_partkey % 6)/10 AS ls, p_size % 5 AS tr, CASE WHEN p_partkey % 3 <> 0 THEN (p_size % 10)/100 END AS ws, (p_partkey % 4)/10 AS pd FROM part),
 g AS (SELECT *, coalesce(nullif(gap, 0), 0.5) AS g2, least(1, coalesce(nullif(dri, 0), 60)/60) AS dn FROM r),
 s AS (SELECT id, round((0.25*coalesce(sf, 0.5) + 0.25*greatest(0, least(1, 1-(g2/0.5+dn/2+least(1, ls/0.5))/3)) + 0.15*greatest(0, least(1, 1-g2/0.5)) + 0.15*greatest(0, 1-tr/4) + 0.2*greatest(0, least(1, (1-coalesce(ws, 0.08)/0.08+1-coalesce(nullif(pd, 0), 0.3)/0.3)/2)))*6, 6) AS score FROM g)
 SELECT *, CASE WHEN score >= 4.5 THEN 'confidence_plus_3pp' WHEN score >= 3 THEN 'neutral' WHEN score >= 2 THEN 'confidence_minus_3pp' ELSE 'skip' END AS action FROM s"""
)
def sixd_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(k % 4 != 0, (s % 5) / 5).alias("subfactor_share"), ((s % 7) / 10).alias("gap"), (k % 80).cast("double").alias("dri"), ((k % 6) / 10).alias("line_spread"), (s % 5).alias("triggered"),
        F.when(k % 3 != 0, (s % 10) / 100).alias("water_sigma"), ((k % 4) / 10).alias("p_draw"),
    )
    return rules.six_dimensions(rows, "id")


@query(
    """WITH r AS (SELECT p_partkey AS id, (p_partkey % 21 - 10)/10 AS e, CASE WHEN p_partkey % 5 <> 0 THEN (p_size % 21 - 10)/10 END AS a, (p_partkey % 11 - 5)/5 AS w, CASE WHEN p_size % 4 <> 0 THEN (p_size % 9 - 4)/4 END AS s, CASE p_partkey % 4 WHEN 0 THEN 'home' WHEN 1 THEN 'away' WHEN 2 THEN 'draw' END AS leader FROM part),
 t AS (SELECT *, round(0.35*e + 0.30*coalesce(a, 0) + 0.15*w + 0.20*coalesce(s, 0), 6) AS score FROM r), d AS (SELECT *, CASE WHEN score >= 0.18 THEN 'home' WHEN score <= -0.18 THEN 'away' ELSE 'neutral' END AS direction,
  CAST(list_sum(list_transform([e, a, w, s], lambda x: CASE WHEN abs(x) >= 0.18 AND (x > 0) = (score > 0) THEN 1 ELSE 0 END)) AS BIGINT) AS aligned, greatest(e, coalesce(a,0), w, coalesce(s,0)) > 0.18 AND least(e, coalesce(a,0), w, coalesce(s,0)) < -0.18 AS split FROM t)
 SELECT id, score, direction, aligned, CASE WHEN aligned >= 2 AND NOT split THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN direction = 'neutral' OR leader IS NULL THEN 'observe' WHEN direction = leader THEN 'confirm' ELSE 'weaken' END AS impact FROM d"""
)
def market_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        k.alias("id"), ((k % 21 - 10) / 10).alias("euro"), F.when(k % 5 != 0, (s % 21 - 10) / 10).alias("asian"), ((k % 11 - 5) / 5).alias("water"), F.when(s % 4 != 0, (s % 9 - 4) / 4).alias("sharp"),
        F.when(k % 4 == 0, "home").when(k % 4 == 1, "away").when(k % 4 == 2, "draw").alias("leader"),
    )
    return rules.market_intent(rows, "id")


_CALIBRATION = """WITH r AS (SELECT l_suppkey AS grp, l_orderkey * 10 + l_linenumber AS id, l_shipdate AS ts, (1 + l_partkey % 5)::DOUBLE AS x, (1 + l_linenumber % 3)::DOUBLE AS y, (1 + l_quantity % 4)::DOUBLE AS z, CASE l_orderkey % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'draw' ELSE 'away' END AS actual, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'R' THEN 0.7 ELSE 0.4 END::DOUBLE AS weight, 1.5 + (l_partkey % 20) / 10 AS eg, (l_quantity::BIGINT % 6)::DOUBLE AS goals FROM lineitem),
 b AS (SELECT grp, id, ts, x/(x+y+z) AS p_home, y/(x+y+z) AS p_draw, z/(x+y+z) AS p_away, actual, weight, eg, goals FROM r)"""


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("grp"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("ts"),
        (1 + F.col("l_partkey") % 5).cast("double").alias("x"), (1 + F.col("l_linenumber") % 3).cast("double").alias("y"), (1 + F.col("l_quantity") % 4).cast("double").alias("z"),
        F.when(F.col("l_orderkey") % 3 == 0, "home").when(F.col("l_orderkey") % 3 == 1, "draw").otherwise("away").alias("actual"), F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "R", 0.7).otherwise(0.4).alias("weight"),
        (1.5 + F.col("l_partkey") % 20 / 10).alias("expected_goals"), (F.col("l_quantity").cast("long") % 6).cast("double").alias("actual_total"),
    )
    total = F.col("x") + F.col("y") + F.col("z")
    return rows.select("grp", "id", "ts", (F.col("x") / total).alias("p_home"), (F.col("y") / total).alias("p_draw"), (F.col("z") / total).alias("p_away"), "actual", "weight", "expected_goals", "actual_total")


_BRIER = "pow(p_home-(actual='home')::INT,2)+pow(p_draw-(actual='draw')::INT,2)+pow(p_away-(actual='away')::INT,2)"


@query(_CALIBRATION + f" SELECT grp, count(*) AS n, round(sum(weight*({_BRIER}))/sum(weight), 6) AS brier, round(sum(-weight*ln(CASE actual WHEN 'home' THEN p_home WHEN 'draw' THEN p_draw ELSE p_away END))/sum(weight), 6) AS log_loss FROM b GROUP BY 1")
def brier_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.brier_logloss(_reviews(spark, sf_dir), "grp")


_MEAN = lambda x: f"sum(weight*({x}))/sum(weight)"


@query(
    _CALIBRATION + f""", n AS (SELECT *, count(*) OVER (PARTITION BY grp) AS n, row_number() OVER (PARTITION BY grp ORDER BY ts DESC, id DESC) AS back FROM b), t AS (SELECT *, back <= least(8, greatest(5, n // 3)) AS test, CASE WHEN n < 40 THEN 0.3 ELSE 0.6 END::DOUBLE AS strength FROM n),
 f AS (SELECT grp, {", ".join(f"ln(({_MEAN(f"(actual='{o}')::INT")}+0.03)/({_MEAN(f'p_{o}')}+0.03)) AS {o[0]}" for o in ("home", "draw", "away"))}, round(greatest(-0.5, least(0.5, {_MEAN('goals-eg')})), 6) AS total_shift, round(greatest(0.0, least(0.15, ({_MEAN('(goals-eg)*(goals-eg)')}-2.5)*0.03)), 6) AS tail_mix FROM t WHERE NOT test GROUP BY 1),
 o AS (SELECT grp, total_shift, tail_mix, {", ".join(f"round(greatest(-0.35, least(0.35, {o[0]}-(h+d+a)/3)), 6) AS offset_{o}" for o in ("home", "draw", "away"))} FROM f),
 s AS (SELECT t.grp, n, actual, weight, strength, goals - eg AS res, {_BRIER} AS b0, {", ".join(f"p_{o}*exp(strength*offset_{o}) AS {o[0]}" for o in ("home", "draw", "away"))}, o.* EXCLUDE grp FROM t JOIN o ON t.grp = o.grp WHERE test),
 g AS (SELECT grp, max(n) AS n, count(*) AS held_out, max(strength) AS strength, round({_MEAN('b0')}, 6) AS "before", round({_MEAN("pow(h/(h+d+a)-(actual='home')::INT,2)+pow(d/(h+d+a)-(actual='draw')::INT,2)+pow(a/(h+d+a)-(actual='away')::INT,2)")}, 6) AS "after", round({_MEAN('abs(res)')}, 6) AS mae_before, round({_MEAN('abs(res-total_shift*strength)')}, 6) AS mae_after, max(offset_home) AS offset_home, max(offset_draw) AS offset_draw, max(offset_away) AS offset_away, max(total_shift) AS total_shift, max(tail_mix) AS tail_mix FROM s GROUP BY 1),
 k AS (SELECT *, ("before"-"after")/"before" >= 0.01 AS direction_approved, (mae_before-mae_after)/mae_before >= 0.01 AS total_approved FROM g)
 SELECT *, CASE WHEN n < 18 THEN 'observing' WHEN direction_approved OR total_approved THEN 'partial_active' ELSE 'shadow_only' END AS state FROM k"""
)
def walk_forward_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.walk_forward(_reviews(spark, sf_dir), "grp", ["ts", "id"])


_HITS = "WITH h AS (SELECT lang, source, doc_id, quality = 1 AS hit FROM documents JOIN labels USING (doc_id))"


@query(_HITS + ", r AS (SELECT *, hit::INT AS x, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n FROM h) SELECT source, count(*) AS n, round(avg(x), 6) AS all_time, round(avg(x) FILTER (n <= 5), 6) AS last_5, round(avg(x) FILTER (n <= 10), 6) AS last_10, round(avg(x) FILTER (n <= 20), 6) AS last_20, round(avg(x) FILTER (n <= 40), 6) AS last_40 FROM r GROUP BY 1")
def review_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.rolling(_hits(spark, sf_dir), "source", ["doc_id"])


@query(_HITS + " SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS n, round(avg(hit::INT), 6) AS hit_rate FROM h GROUP BY GROUPING SETS ((), (lang), (source))")
def review_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.metric_cube(_hits(spark, sf_dir), ["lang", "source"])


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "source", (F.col("quality") == 1).alias("hit"))


@query(
    """WITH m AS (SELECT o_orderkey AS match_id, o_orderdate + to_minutes(o_orderkey % 1440) AS kickoff FROM orders), c AS (SELECT m.*, stage, minutes FROM m, (VALUES ('T-480M',480),('T-360M',360),('T-240M',240),('T-120M',120),('T-90M',90),('T-60M',60),('T-30M',30),('T-10M',10)) v(stage, minutes)),
 p AS (SELECT match_id, stage, kickoff, kickoff - to_minutes(minutes) AS planned, TIMESTAMP '1995-06-15 12:00:00' AS now FROM c), l AS (SELECT *, CAST(trunc((epoch_us(now)-epoch_us(planned))/60000000) AS BIGINT) AS minutes_late FROM p)
 SELECT match_id, stage, minutes_late, CASE WHEN planned > now THEN 'planned' WHEN kickoff + INTERVAL 6 HOUR < now THEN 'permanently_missing' WHEN minutes_late <= 5 THEN 'on_time' ELSE 'late' END AS status FROM l"""
)
def due_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("match_id"), (F.col("o_orderdate") + F.make_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))).alias("kickoff"))
    return rules.due_checkpoints(matches, F.to_timestamp(F.lit("1995-06-15 12:00:00")))


_REDACT = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\bbearer\\s+[a-z0-9._~+/=-]+', 'bearer [redacted]', 'gi'), '\\beyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+', '[redacted]', 'g'), '\\b(password|passwd|secret|token|api[_-]?key)(\\s*[=:]\\s*)[^\\s,;]+', '\\1\\2[redacted]', 'gi'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[redacted]', 'g')"""


@query(f"WITH r AS (SELECT doc_id, text, {_REDACT} AS t FROM documents) SELECT doc_id, md5(t) AS digest, t <> text AS changed FROM r")
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", fx.redact(F.col("text")).alias("t"))
    return rows.select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"), (F.col("t") != F.col("text")).alias("changed"))


@query(
    """WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN (p_size % 4)::VARCHAR || '/' || (p_size % 4 + 0.5)::DOUBLE::VARCHAR WHEN 1 THEN (p_size / 4)::VARCHAR WHEN 2 THEN '-' || (p_size % 3)::VARCHAR || '/' || '-' || (p_size % 3 + 0.5)::DOUBLE::VARCHAR ELSE 'Over  GOALS' END AS x FROM part),
 s AS (SELECT id, try_cast(split_part(x, '/', 1) AS DECIMAL(18,6)) AS a, try_cast(split_part(x, '/', 2) AS DECIMAL(18,6)) AS b, contains(x, '/') AS two, x FROM t), v AS (SELECT id, x, CASE WHEN NOT two THEN a::DOUBLE ELSE (a + b)::DOUBLE / 2 END AS v FROM s)
 SELECT id, coalesce(regexp_replace(CASE WHEN v = 0 THEN '0' ELSE v::VARCHAR END, '\\.0$', ''), lower(regexp_replace(x, '\\s+', ' ', 'g'))) AS line FROM v"""
)
def canonical_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey") % 4, F.col("p_size")
    half = lambda m: (s % m + F.lit(0.5)).cast("double").cast("string")
    text = F.when(k == 0, F.concat((s % 4).cast("string"), F.lit("/"), half(4))).when(k == 1, (s / 4).cast("string")).when(k == 2, F.concat(F.lit("-"), (s % 3).cast("string"), F.lit("/-"), half(3))).otherwise("Over  GOALS")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), fx.canonical_line(text).alias("line"))


@query(
    """SELECT o_orderkey AS id, 'M-' || strftime(o_orderdate, '%Y%m%d%H%M') || '-' || left(sha1('customer' || o_custkey::VARCHAR || '|' || regexp_replace(lower(o_orderpriority), '[^0-9a-z]', '', 'g')), 10) AS match_id FROM orders"""
)
def canonical_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderkey").alias("id"), fx.canonical_match_id(F.col("o_orderdate"), F.concat(F.lit("Customer#"), F.col("o_custkey").cast("string")), F.col("o_orderpriority")).alias("match_id"))


@query(with_views("quotes") + " SELECT match_id, provider, outcome, arg_max(price, (ts, event_id)) AS price, count(*) AS quotes FROM quotes GROUP BY ALL")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch twin of the live state; the streaming run of the same operator is in the tests."""
    return live.latest_state(quotes_long(spark, sf_dir), ["match_id", "provider", "outcome"])


@query()
def folded_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unicode folding of every document's text, as a digest; a Python function, so without SQL."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(fx.fold("text").cast("binary")).alias("folded"))


