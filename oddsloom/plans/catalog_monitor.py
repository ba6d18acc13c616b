"""Named queries of queues, timers, reviews, panels and parsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.functions import parse
from oddsloom.operators import lookups, monitor, quotes, resolve, review
from oddsloom.operators.rules import CHECKPOINTS
from oddsloom.plans.adapters import quotes_long, table, with_views
from oddsloom.plans.catalog import _ENDS, _TIER, query

NOW = "1995-06-15 12:00:00"
_STAGES = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in CHECKPOINTS.items()) + ") v(stage, target)"
_MATCHES = "m AS (SELECT o_orderkey AS match_id, o_custkey AS pair, o_orderdate + to_minutes(o_orderkey % 1440) AS kickoff, o_orderstatus, o_orderpriority, o_totalprice FROM orders)"


def now() -> Column:
    return F.to_timestamp(F.lit(NOW))


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    kickoff = F.col("o_orderdate") + F.make_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("match_id"), F.col("o_custkey").alias("pair"), kickoff.alias("kickoff"), "o_orderstatus", "o_orderpriority", "o_totalprice")


_QUEUE = f"""WITH {_MATCHES}, r AS (SELECT match_id, pair, CASE WHEN match_id % 41 > 0 THEN kickoff END AS kickoff, CASE WHEN match_id % 5 IN (0, 4) THEN 195 ELSE 135 END AS delay, CASE WHEN match_id % 5 IN (0, 4) THEN 'single_leg_knockout' ELSE 'standard_90m' END AS basis FROM m),
 d AS (SELECT DISTINCT o_custkey AS pair FROM orders WHERE o_totalprice > 200000), q AS (SELECT match_id, delay, basis, kickoff + to_minutes(delay) AS due_at, CASE WHEN d.pair IS NOT NULL THEN 'reviewed' WHEN kickoff IS NULL THEN 'blocked_missing_kickoff' WHEN TIMESTAMP '{NOW}' < kickoff + to_minutes(delay) THEN 'waiting_for_finish' ELSE 'pending_result_verification' END AS status FROM r LEFT JOIN d USING (pair))"""


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, k = _matches(spark, sf_dir), F.col("match_id") % 5
    text = F.when(k == 0, "Cup Final").when(k == 1, "League round 3").when(k == 2, "Semi-final second leg").when(k == 3, "Group A").otherwise("1/8 Knockout")
    reports = rows.select("match_id", "pair", text.alias("competition"), F.when(F.col("match_id") % 41 > 0, F.col("kickoff")).alias("kickoff"))
    return monitor.review_queue(reports, rows.where("o_totalprice > 200000"), now())


@query(_QUEUE + " SELECT * FROM q")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queue(spark, sf_dir)


@query(_QUEUE + " SELECT status, count(*) AS n, min(due_at) AS first_due, max(due_at) AS last_due FROM q GROUP BY 1")
def review_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.status_counts(_queue(spark, sf_dir))


_OPEN = f"""WITH {_MATCHES}, x AS (SELECT match_id, TIMESTAMP '{NOW}' + to_minutes(match_id % 900 - 400) AS kickoff, o_orderstatus FROM m), s AS (SELECT match_id, kickoff, (epoch_us(kickoff) - epoch_us(TIMESTAMP '{NOW}')) / 6e7 AS minutes, stage, target FROM x, {_STAGES}),
 o AS (SELECT match_id, kickoff, round(minutes, 2) AS minutes, stage, round(target - minutes, 2) AS lateness FROM s WHERE minutes BETWEEN -360 AND 480 AND target >= minutes AND NOT EXISTS (SELECT 1 FROM x WHERE x.match_id = s.match_id AND o_orderstatus = 'F' AND stage IN ('T-480M', 'T-60M'))),
 q AS (SELECT *, CASE WHEN abs(lateness) <= 5 THEN 'on_time' ELSE 'pending_recovery' END AS capture_quality FROM o)"""


def _open(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _matches(spark, sf_dir).withColumn("kickoff", now() + F.make_interval(mins=(F.col("match_id") % 900 - 400).cast("int")))
    captured = rows.where("o_orderstatus = 'F'").select("match_id", F.explode(F.array(F.lit("T-480M"), F.lit("T-60M"))).alias("stage"), F.lit("captured").alias("status"))
    other = rows.select("match_id", F.lit("T-360M").alias("stage"), F.lit("pending").alias("status"))
    return monitor.open_stages(rows, captured.union(other), now())


@query(_OPEN + " SELECT *, CASE WHEN lateness >= 0 AND lateness < 1 THEN 'primary' WHEN lateness >= 10 AND lateness < 11 THEN 'bounded_retry' END AS attempt FROM q")
def open_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _open(spark, sf_dir).withColumn("attempt", monitor.dispatch_attempt(F.col("lateness")))


@query(_OPEN + ", p AS (SELECT *, kickoff - to_minutes(CAST(round(minutes + lateness) AS INT)) AS planned FROM q ORDER BY planned, kickoff, match_id LIMIT 12) SELECT match_id, stage, CASE WHEN lateness >= 0 AND lateness < 1 THEN 'primary' WHEN lateness >= 10 AND lateness < 11 THEN 'bounded_retry' END AS attempt FROM p")
def due_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.due_events(_open(spark, sf_dir))


_CHECKS = """WITH c AS (SELECT l_orderkey AS match_id, 'S' || l_linenumber AS stage, l_shipdate AS planned, CASE WHEN l_returnflag = 'A' THEN 'captured' WHEN l_returnflag = 'R' THEN 'late_live' ELSE 'pending' END AS status FROM lineitem)"""


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.concat(F.lit("S"), F.col("l_linenumber").cast("string")).alias("stage"), F.col("l_shipdate").alias("planned"), F.when(flag == "A", "captured").when(flag == "R", "late_live").otherwise("pending").alias("status"))


@query(_CHECKS + f""" SELECT match_id, count(*) AS total, count(*) FILTER (status <> 'pending') AS completed, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'pending' AND planned <= TIMESTAMP '{NOW}') AS overdue,
 arg_max(stage, (planned, stage)) FILTER (status <> 'pending') AS latest_stage, arg_min(stage, (planned, stage)) FILTER (status = 'pending' AND planned > TIMESTAMP '{NOW}') AS next_stage FROM c GROUP BY 1""")
def monitor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.monitor_summary(_checks(spark, sf_dir), now())


@query(f"""WITH s AS (SELECT l_orderkey AS match_id, 'S' || l_linenumber AS stage, l_shipdate AS planned, l_shipdate + INTERVAL 8 HOUR AS kickoff FROM lineitem), h AS (SELECT o_orderkey AS match_id, o_orderdate + to_days(CAST(o_orderkey % 60 AS INT)) AS ts, o_totalprice AS value FROM orders),
 f AS (SELECT match_id, stage, planned, kickoff, max(ts) FILTER (ts <= planned) AS ts, arg_max(value, (ts, value)) FILTER (ts <= planned) AS value FROM s LEFT JOIN h USING (match_id) GROUP BY ALL),
 r AS (SELECT *, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(planned)) / 6e7 AS late FROM f), t AS (SELECT *, CASE WHEN late < 0 THEN 'pending' WHEN late <= 5 THEN 'on_time' WHEN ts IS NOT NULL THEN 'historical_recovery' WHEN TIMESTAMP '{NOW}' <= kickoff THEN 'late_live' ELSE 'permanently_missing' END AS status FROM r)
 SELECT match_id, stage, status, CASE WHEN status = 'historical_recovery' THEN value END AS value FROM t""")
def late_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = _checks(spark, sf_dir).select("match_id", "stage", "planned", (F.col("planned") + F.expr("interval 8 hours")).alias("kickoff"))
    history = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("match_id"), (F.col("o_orderdate") + F.make_interval(days=(F.col("o_orderkey") % 60).cast("int"))).alias("ts"), F.col("o_totalprice").alias("value"))
    return monitor.recovered(stages, history, now())


_BETS = """WITH b AS (SELECT l_suppkey AS account, l_orderkey * 10 + l_linenumber AS bet_id, CASE l_partkey % 7 WHEN 0 THEN 'won' WHEN 1 THEN 'lost' WHEN 2 THEN 'push' WHEN 3 THEN 'half_won' WHEN 4 THEN 'half_lost' ELSE 'locked' END AS status, l_quantity AS stake, 1.5 + l_discount * 10 AS odds FROM lineitem),
 r AS (SELECT *, stake * CASE status WHEN 'won' THEN odds WHEN 'lost' THEN 0 WHEN 'push' THEN 1 WHEN 'half_won' THEN (1 + odds) / 2 WHEN 'half_lost' THEN 0.5 ELSE 0 END AS returned FROM b)"""


def _bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey") % 7
    status = F.when(k == 0, "won").when(k == 1, "lost").when(k == 2, "push").when(k == 3, "half_won").when(k == 4, "half_lost").otherwise("locked")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("account"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("bet_id"), status.alias("status"), F.col("l_quantity").alias("stake"), (1.5 + F.col("l_discount") * 10).alias("odds"))
    s, odds = F.col("status"), F.col("odds")
    return rows.withColumn("returned", F.col("stake") * F.when(s == "won", odds).when(s == "push", 1.0).when(s == "half_won", (1 + odds) / 2).when(s == "half_lost", 0.5).otherwise(0.0))


@query(_BETS + """, g AS (SELECT account, count(*) AS settled, sum(CASE status WHEN 'won' THEN 1.0 WHEN 'half_won' THEN 0.5 ELSE 0 END)::DOUBLE AS hits, round(sum(stake), 4) AS stake, round(sum(returned), 4) AS returned FROM r WHERE status <> 'locked' GROUP BY 1)
 SELECT account, settled, round(100 * hits / settled, 4) AS hit_rate, stake, returned, round(returned - stake, 4) AS profit, round(100 * (returned - stake) / stake, 4) AS roi FROM g""")
def real_bet_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.settled_kpis(_bets(spark, sf_dir), "account")


@query(_BETS + " SELECT bet_id, CASE status WHEN 'won' THEN round(stake * (odds - 1), 2) WHEN 'lost' THEN -stake ELSE 0 END AS profit FROM r WHERE status IN ('won', 'lost', 'push')")
def real_bet_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.when(F.col("status") == "won", True).when(F.col("status") == "lost", False)
    return _bets(spark, sf_dir).where("status in ('won', 'lost', 'push')").select("bet_id", monitor.real_bet_profit(F.col("stake"), F.col("odds"), hit).alias("profit"))


@query(f"""WITH {_MATCHES}, k AS (SELECT match_id, CASE WHEN match_id % 50 > 0 THEN kickoff END AS kickoff FROM m), n AS (SELECT match_id, coalesce(strftime(kickoff, '%Y%m%d'), 'HISTORY') AS stamp, row_number() OVER (ORDER BY CAST(kickoff AS DATE) DESC NULLS LAST, kickoff DESC NULLS LAST, match_id) AS n FROM k)
 SELECT match_id, stamp || '-' || lpad(n::VARCHAR, 9, '0') AS display_id FROM n""")
def display_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.display_ids(_matches(spark, sf_dir).withColumn("kickoff", F.when(F.col("match_id") % 50 > 0, F.col("kickoff"))), "match_id")


@query("""WITH g AS (SELECT o_custkey AS match_id, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS p, min(o_orderkey) AS one, min(o_orderkey) FILTER (o_orderpriority = '1-URGENT') AS top FROM orders GROUP BY 1), c AS (SELECT match_id, CASE WHEN n = 1 THEN one WHEN p = 1 THEN top END AS profile_id FROM g)
 SELECT *, CASE WHEN profile_id IS NULL THEN 'ambiguous' ELSE 'active' END AS state FROM c""")
def single_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("match_id"), F.col("o_orderkey").alias("profile_id"), (F.col("o_orderpriority") == "1-URGENT").alias("is_primary"))
    return monitor.single_profile(rows)


@query("""WITH t AS (SELECT o_orderkey AS ticket_id, o_custkey % 50 AS match_id, (o_orderkey % 3) || '-' || (o_custkey % 3) AS sel FROM orders), q AS (SELECT user_id % 50 AS match_id, replace((event_id % 3) || ':' || (event_id // 3 % 3), ':', '-') AS sel, 1 + value / 100 AS odds, ts FROM events WHERE event_id % 4 > 0 AND 1 + value / 100 > 1 AND event_id % 3 < 2),
 f AS (SELECT match_id, sel, arg_min(odds, (ts, odds)) AS odds, min(ts) AS received FROM q GROUP BY ALL) SELECT ticket_id, received, odds FROM t JOIN f USING (match_id, sel)""")
def earliest_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c, e = F.col("o_orderkey"), F.col("o_custkey"), F.col("event_id")
    tickets = table(spark, sf_dir, "orders").select(k.alias("ticket_id"), (c % 50).alias("match_id"), F.concat((k % 3).cast("string"), F.lit("-"), (c % 3).cast("string")).alias("selection"))
    books = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("match_id"), F.concat((e % 3).cast("string"), F.lit(":"), (F.floor(e / 3) % 3).cast("string")).alias("line"), F.when(e % 3 == 0, "7").when(e % 3 == 1, "1100484").otherwise("9").alias("market_code"), (e % 4 > 0).alias("verified"), (1 + F.col("value") / 100).alias("odds"), F.col("ts").alias("received"))
    return monitor.earliest_qualified(tickets, books)


_FLAGS = {"primary": "doc_id % 3 = 0", "outcome": "doc_id % 4 < 2", "score": "quality = 1", "total": "n_chars % 2 = 0", "btts": "n_chars % 3 = 0"}


@query(
    "WITH r AS (SELECT doc_id, lang AS version, source, CASE doc_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS grade, CASE WHEN doc_id % 6 > 0 THEN doc_id % 14 + 1 END AS rank, "
    + ", ".join(f"CASE WHEN doc_id % 10 > 0 THEN {e} END AS \"{d}\"" for d, e in _FLAGS.items())
    + """ FROM documents JOIN labels USING (doc_id)), n AS (SELECT *, row_number() OVER (ORDER BY doc_id DESC) AS back FROM r),
 w AS (SELECT 'all' AS kind, 'all' AS value, * FROM n UNION ALL SELECT 'grade', grade, * FROM n UNION ALL SELECT 'version', version, * FROM n UNION ALL SELECT 'last', k::VARCHAR, n.* FROM n, (VALUES (5), (10), (20), (40)) v(k) WHERE back <= k)
 SELECT kind, value, """
    + ", ".join(f'count("{d}") AS {d}_settled, count(*) FILTER ("{d}") AS {d}_hits, round(avg("{d}"::INT), 6) AS {d}_rate' for d in _FLAGS)
    + ", "
    + ", ".join(f"round(avg((rank <= {k})::INT), 6) AS top{k}" for k in (3, 5, 10))
    + ", round(avg(rank), 4) AS mean_rank FROM w GROUP BY ALL"
)
def review_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, k = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id"), F.col("doc_id")
    grade = F.when(k % 4 == 0, "A").when(k % 4 == 1, "B").when(k % 4 == 2, "C").otherwise("D")
    rows = rows.select("doc_id", F.col("lang").alias("version"), grade.alias("grade"), F.when(k % 6 > 0, k % 14 + 1).alias("rank"), *[F.when(k % 10 > 0, F.expr(e)).alias(d) for d, e in _FLAGS.items()])
    return review.review_windows(rows, ["doc_id"])


@query(with_views("quotes") + f""", l AS (SELECT match_id, provider, outcome, arg_max(0.8 + event_id % 40 / 100, (ts, event_id)) AS kelly FROM quotes GROUP BY ALL), t AS (SELECT *, {_TIER} AS tier FROM l)
 SELECT match_id, tier, count(DISTINCT provider) AS companies, round(avg(kelly) FILTER (outcome='home'), 6) AS kelly_home, round(avg(kelly) FILTER (outcome='draw'), 6) AS kelly_draw, round(avg(kelly) FILTER (outcome='away'), 6) AS kelly_away FROM t WHERE tier IS NOT NULL GROUP BY ALL""")
def kelly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.kelly_panel(quotes_long(spark, sf_dir).withColumn("kelly", 0.8 + F.col("event_id") % 40 / 100))


@query(with_views("quotes") + """, p AS (SELECT match_id, date_trunc('day', ts) AS snapshot, round(avg(price) FILTER (outcome='home'), 6) AS home, round(avg(price) FILTER (outcome='draw'), 6) AS draw, round(avg(price) FILTER (outcome='away'), 6) AS away FROM quotes GROUP BY ALL), f AS (SELECT *, count(*) OVER (PARTITION BY match_id) AS points FROM p WHERE home IS NOT NULL AND draw IS NOT NULL AND away IS NOT NULL)
 SELECT match_id, home, draw, away, points, strftime(snapshot, '%Y-%m-%d') AS snapshot FROM f WHERE points >= 3""")
def genuine_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.genuine_timeline(quotes_long(spark, sf_dir).withColumn("snapshot", F.date_format("ts", "yyyy-MM-dd")))


@query(with_views("quotes") + _ENDS + """, m AS (SELECT match_id, outcome, avg(open) AS o, avg(current) AS c FROM ends GROUP BY ALL), r AS (SELECT *, round((o - c) / o, 6) AS change FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY change DESC, outcome = 'home' DESC, outcome = 'draw' DESC) AS n FROM r)
 SELECT match_id, outcome AS direction, change AS relative_change, CASE WHEN change >= 0.08 THEN 'strong' WHEN change >= 0.03 THEN 'moderate' ELSE 'weak' END AS strength FROM k WHERE n = 1""")
def price_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.price_pressure(quotes_long(spark, sf_dir))


@query(with_views("quotes") + _ENDS + " SELECT match_id, " + ", ".join(f"round(avg({c}) FILTER (outcome='{o}') + 1e-9, 4) AS {c}_{o}" for o in ("home", "draw", "away") for c in ("open", "current")) + " FROM ends GROUP BY 1")
def page_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.page_average(quotes_long(spark, sf_dir))


@query("""WITH b AS (SELECT l_orderkey AS match_id, CASE l_linenumber % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'draw' ELSE 'away' END AS outcome, CASE WHEN l_partkey % 5 > 0 THEN l_discount END AS bid, l_tax + 0.02 AS ask, CASE WHEN l_partkey % 7 > 0 THEN l_quantity / 100 END AS f FROM lineitem),
 m AS (SELECT match_id, outcome, coalesce(CASE WHEN ask >= bid THEN (bid + ask) / 2 END, f) AS mid FROM b), w AS (SELECT match_id, avg(mid) FILTER (outcome='home') AS h, avg(mid) FILTER (outcome='draw') AS d, avg(mid) FILTER (outcome='away') AS a FROM m GROUP BY 1)
 SELECT match_id, CASE WHEN h > 0 AND d > 0 AND a > 0 THEN 'complete' ELSE 'incomplete' END AS quality, CASE WHEN h > 0 AND d > 0 AND a > 0 THEN round(h/(h+d+a), 6) END AS p_home, CASE WHEN h > 0 AND d > 0 AND a > 0 THEN round(d/(h+d+a), 6) END AS p_draw, CASE WHEN h > 0 AND d > 0 AND a > 0 THEN round(a/(h+d+a), 6) END AS p_away FROM w""")
def mid_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") % 3
    books = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.when(n == 0, "home").when(n == 1, "draw").otherwise("away").alias("outcome"), F.when(F.col("l_partkey") % 5 > 0, F.col("l_discount")).alias("bid"), (F.col("l_tax") + 0.02).alias("ask"), F.when(F.col("l_partkey") % 7 > 0, F.col("l_quantity") / 100).alias("first"))
    return quotes.mid_consensus(books)


def _choice(values: list[str]) -> Column:
    """One of ``values`` for each part, in turn."""
    return F.get(F.array(*[F.lit(v) for v in values]), (F.col("p_partkey") % len(values)).cast("int"))


def _choice_sql(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][p_partkey % {len(values)} + 1]"


_LINES = ["0.5", "2/2.5", "-1.25", "平手", "受半/一", "球半", "一球", "受两球", "none", "", "1 / 1.5"]
_DEPTHS = {"平手": -0.0, "受半/一": 0.75, "球半": -0.5, "一球": -1.0, "受两球": 2.0}


@query(f"WITH t AS (SELECT p_partkey AS id, {_choice_sql(_LINES)} AS x FROM part) SELECT id, CASE x " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _DEPTHS.items()) + " WHEN '2/2.5' THEN 2.25 WHEN '1 / 1.5' THEN 1.25 ELSE try_cast(nullif(x, '') AS DOUBLE) END::DOUBLE AS handicap FROM t")
def handicap_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), parse.handicap_number(_choice(_LINES)).alias("handicap"))


_CONTRACTS = ["主胜 (55%)", "平局", "客胜 1.8", "大 2.5", "小3", "双方进球 是", "BTTS no", "other (12%) text", "小 2"]
_KINDS = """CASE WHEN contains(x, '主胜') THEN '1x2:home' WHEN contains(x, '平局') THEN '1x2:draw' WHEN contains(x, '客胜') THEN '1x2:away' END"""


@query(f"""WITH t AS (SELECT p_partkey AS id, {_choice_sql(_CONTRACTS)} AS x, p_size % 4 AS h, p_size % 3 AS a FROM part), s AS (SELECT *, {_KINDS} AS o, regexp_extract(x, '(大|小)\\s*(\\d+(?:\\.\\d+)?)', 1) AS side, try_cast(nullif(regexp_extract(x, '(大|小)\\s*(\\d+(?:\\.\\d+)?)', 2), '') AS DOUBLE) AS line, contains(x, '双方进球') OR contains(x, 'BTTS') AS pair FROM t)
 SELECT id, CASE WHEN o IS NOT NULL THEN o WHEN side <> '' THEN 'total:' || CASE side WHEN '大' THEN 'over' ELSE 'under' END || regexp_extract(x, '(大|小)\\s*(\\d+(?:\\.\\d+)?)', 2) WHEN pair THEN CASE WHEN contains(x, '是') THEN 'btts:yes' ELSE 'btts:no' END ELSE regexp_replace(x, '\\([^)]*%[^)]*\\)', '', 'g') END AS signature,
 CASE WHEN o IS NOT NULL THEN o = '1x2:' || CASE WHEN h > a THEN 'home' WHEN h = a THEN 'draw' ELSE 'away' END WHEN side <> '' THEN CASE WHEN h + a = line THEN NULL WHEN side = '大' THEN h + a > line ELSE h + a < line END WHEN pair THEN contains(x, '是') = (h > 0 AND a > 0) END AS hit,
 CASE WHEN o IS NOT NULL THEN 'outcome' WHEN side <> '' THEN 'total' WHEN pair THEN 'btts' ELSE 'unknown' END AS kind FROM s""")
def contract_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), _choice(_CONTRACTS).alias("x"), (F.col("p_size") % 4).alias("h"), (F.col("p_size") % 3).alias("a"))
    settled = parse.settled_text(F.col("x"), F.col("h"), F.col("a"))
    return rows.select("id", parse.contract_signature(F.col("x")).alias("signature"), settled["hit"].alias("hit"), settled["kind"].alias("kind"))


_TIMES = ["1995-03-17 14:30", "1995-03-17T14:30:05", "1995/03/17 14:30", "17 March", "", "1995-13-40 10:00"]


@query(f"""WITH t AS (SELECT p_partkey AS id, {_choice_sql(_TIMES)} AS x, lpad((1 + p_partkey % 12)::VARCHAR, 2, '0') || '-10 08:' || lpad((p_partkey % 60)::VARCHAR, 2, '0') AS y FROM part), k AS (SELECT *, coalesce(try_strptime(x, '%Y-%m-%d %H:%M'), try_strptime(x, '%Y-%m-%dT%H:%M:%S'), try_strptime(x, '%Y/%m/%d %H:%M')) AS kickoff, strptime('1995-' || y, '%Y-%m-%d %H:%M') AS s FROM t)
 SELECT id, kickoff, CASE WHEN s > TIMESTAMP '1995-03-17 23:59:00' AND floor((epoch_us(s) - epoch_us(TIMESTAMP '1995-03-17 14:30:00')) / 86400e6) > 30 THEN strptime('1994-' || y, '%Y-%m-%d %H:%M') ELSE s END AS trend, strftime(kickoff + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS shown, coalesce(TIMESTAMP '{NOW}' >= kickoff + INTERVAL 135 MINUTE, false) AS finished FROM k""")
def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), parse.kickoff_time(_choice(_TIMES)).alias("kickoff"), F.concat(F.lpad((1 + k % 12).cast("string"), 2, "0"), F.lit("-10 08:"), F.lpad((k % 60).cast("string"), 2, "0")).alias("y"))
    return rows.select("id", "kickoff", parse.trend_time(F.col("y"), F.to_timestamp(F.lit("1995-03-17 14:30:00"))).alias("trend"), parse.local_display(F.col("kickoff")).alias("shown"), monitor.should_be_finished(F.col("kickoff"), now()).alias("finished"))


_NAMES = ["Real FC", "上海 申花 足球俱乐部", "AFC Ajax 1900", "北京国安队", "Club", "v/s - X|Y", ""]
_COMPACT = {"Real FC": "real", "上海 申花 足球俱乐部": "上海申花", "AFC Ajax 1900": "ajax1900", "北京国安队": "北京国安", "Club": "", "v/s - X|Y": "vsxy", "": ""}


@query(f"""WITH t AS (SELECT p_partkey AS id, {_choice_sql(_NAMES)} AS x, p_size AS s FROM part) SELECT id, CASE x {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _COMPACT.items())} END AS compact, lower(regexp_replace(x, '[\\s\\-—_｜|vsVS.·]+', '', 'g')) AS queue_name,
 coalesce(nullif(regexp_replace(regexp_replace(coalesce(nullif(x, ''), 'unknown'), '[^0-9A-Za-z._-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown') AS safe, CASE WHEN s % 2 = 0 THEN 'shuju:' || s ELSE 'fixture:' || lower(regexp_replace(x, '[\\s\\-—_｜|vsVS.·]+', '', 'g')) || ':b:1' END AS report FROM t""")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, size = _choice(_NAMES), F.col("p_size")
    key = parse.report_key(F.when(size % 2 == 0, size), name, F.lit("B"), F.lit("1"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), parse.compact_name(name).alias("compact"), parse.queue_name(name).alias("queue_name"), parse.safe_key(name).alias("safe"), key.alias("report"))


@query("""WITH t AS (SELECT p_partkey AS id, p_partkey % 7 AS k, p_size AS s, ['0', '1', '', ' 0 '][p_partkey % 4 + 1] AS st, CASE p_partkey % 3 WHEN 0 THEN '12.5' WHEN 1 THEN 'NaN' ELSE 'inf' END AS x FROM part)
 SELECT id, CASE trim(st) WHEN '0' THEN 'pre_match' WHEN '' THEN 'unknown' ELSE 'non_pre_match' END AS phase, CASE WHEN x = '12.5' THEN 12.5 END::DOUBLE AS number, CASE WHEN s > 1 THEN round((p - s + 1) / (s - 1), 6) END AS change, CASE k WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE (s * 3 > 60 AND s * 3 <= 90) END AS frozen, k = 0 OR k = 2 OR k = 1 OR true AS before,
 k > 0 AND abs(s / 50 + 0.4 + 0.3 - 1) <= 0.02 AS publishable FROM (SELECT t.*, p_retailprice AS p FROM t JOIN part ON p_partkey = id)""")
def row_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 7, F.col("p_size")
    status = _choice(["0", "1", "", " 0 "])
    number = F.when(F.col("p_partkey") % 3 == 0, "12.5").when(F.col("p_partkey") % 3 == 1, "NaN").otherwise("inf")
    kickoff = F.when(k == 0, None).when(k == 1, "no time").otherwise("1995-01-02 12:00:00")
    analysed = F.when(k == 2, "").otherwise(F.date_format(F.to_timestamp(F.lit("1995-01-02 12:00:00")) - F.make_interval(mins=size * 3), "yyyy-MM-dd HH:mm:ss"))
    old, rate = (size - 1).cast("double"), F.when(k > 0, 1.2).otherwise(0.0)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), monitor.match_phase(status).alias("phase"), parse.finite(number).alias("number"), F.round(parse.relative_change(old, F.col("p_retailprice")), 6).alias("change"),
        lookups.frozen_window(kickoff, analysed).alias("frozen"), lookups.before_kickoff(kickoff, analysed).alias("before"), lookups.publishable(size / 50, F.lit(0.4), F.lit(0.3), rate).alias("publishable"),
    )


@query("SELECT o_orderkey AS report_id, list_filter(" + str(list(monitor.MODULES)) + ", lambda m: CASE WHEN m = 'identity' THEN o_orderkey % 2 ELSE CASE WHEN m = 'model' THEN o_orderkey % 3 ELSE CASE WHEN m = 'rules' THEN 0 ELSE 1 END END END = 0)::VARCHAR AS missing FROM orders")
def report_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    state = lambda ok: F.when(ok, "completed").otherwise("degraded")
    states = F.map_concat(F.create_map(F.lit("identity"), state(k % 2 != 0), F.lit("model"), state(k % 3 != 0)), F.create_map(*[x for m in monitor.MODULES if m not in ("identity", "model", "rules") for x in (F.lit(m), F.lit("completed"))]))
    missing = monitor.incomplete_modules(states)
    return table(spark, sf_dir, "orders").select(k.alias("report_id"), F.concat(F.lit("["), F.array_join(missing, ", "), F.lit("]")).alias("missing"))


@query("""WITH f AS (SELECT o_orderkey AS fixture_id, o_custkey AS pair, o_orderkey % 40 AS match_num, CAST(o_orderdate AS DATE) AS business_date, o_totalprice AS updated FROM orders), r AS (SELECT l_orderkey * 10 + l_linenumber AS report_id, l_partkey AS pair, l_orderkey % 40 AS match_num, CAST(l_shipdate AS DATE) AS business_date FROM lineitem),
 p AS (SELECT pair, arg_max(fixture_id, (updated, fixture_id)) AS of_pair FROM f GROUP BY 1), n AS (SELECT match_num, business_date, arg_max(fixture_id, (updated, fixture_id)) AS of_number FROM f GROUP BY ALL)
 SELECT report_id, coalesce(of_pair, of_number) AS fixture_id, CASE WHEN of_pair IS NOT NULL THEN 'pair' WHEN of_number IS NOT NULL THEN 'number' END AS basis FROM r LEFT JOIN p USING (pair) LEFT JOIN n USING (match_num, business_date)""")
def report_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixtures = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fixture_id"), F.col("o_custkey").alias("pair"), (F.col("o_orderkey") % 40).alias("match_num"), F.to_date("o_orderdate").alias("business_date"), F.col("o_totalprice").alias("updated"))
    reports = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("report_id"), F.col("l_partkey").alias("pair"), (F.col("l_orderkey") % 40).alias("match_num"), F.to_date("l_shipdate").alias("business_date"))
    return resolve.pair_or_number(reports, fixtures)


@query("""WITH t AS (SELECT s_suppkey AS id, 'Supplier ' || s_suppkey AS a, CASE WHEN s_suppkey % 2 = 0 THEN 'Supplier ' || s_suppkey ELSE 'Another name' END AS b, s_suppkey % 400 AS apart FROM supplier)
 SELECT id, array_to_string(list_filter([CASE WHEN a <> b THEN 'HOME_TEAM_MISMATCH' END, CASE WHEN apart > 180 THEN 'KICKOFF_MISMATCH' END], lambda x: x IS NOT NULL), ',') AS reasons FROM t""")
def identity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    own, start = F.concat(F.lit("Supplier "), k.cast("string")), F.to_timestamp(F.lit(NOW))
    page = F.when(k % 2 == 0, own).otherwise("Another name")
    reasons = resolve.verified(own, F.lit("same side"), page, F.lit("same side"), start, start + F.make_interval(mins=(k % 400).cast("int")))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), F.array_join(reasons, ",").alias("reasons"))
