"""More named queries: pricing, state folds, page and log sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.operators import lookups, model, movement, pricing, quotes, review
from oddsloom.plans.adapters import quotes_long, rates, table, tickets, with_views
from oddsloom.plans.catalog import _MATRIX, query
from oddsloom.sources import readers
from oddsloom.streaming import normalise


@query(with_views("rates") + _MATRIX + """, w AS (SELECT match_id, h, a, p*exp(0.6*CASE WHEN h > a THEN 0.2 WHEN h = a THEN -0.1 ELSE -0.1 END::DOUBLE) AS w FROM matrix), n AS (SELECT *, w/sum(w) OVER (PARTITION BY match_id) AS p FROM w)
 SELECT match_id, round(sum(p) FILTER (h > a), 6) AS p_home, round(sum(p) FILTER (h = a), 6) AS p_draw FROM n GROUP BY 1""")
def reweighted_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.reweighted_outcomes(rates(spark, sf_dir), {"home": 0.2, "draw": -0.1, "away": -0.1}, 0.6)
    return rows.select("match_id", F.round("p_home", 6).alias("p_home"), F.round("p_draw", 6).alias("p_draw"))


@query(with_views("rates").replace("rates AS (", "base AS (", 1) + "".join(f", {n} AS (WITH rates AS (SELECT match_id, lh*{f}::DOUBLE AS lh, la*{f}::DOUBLE AS la, rho FROM base){_MATRIX} SELECT * FROM matrix)" for n, f in (("mid", "1.0"), ("lo", "0.65"), ("hi", "1.45"))) + """, u AS (SELECT match_id, h, a, p*0.9 AS p FROM mid UNION ALL SELECT match_id, h, a, p*0.05 FROM lo UNION ALL SELECT match_id, h, a, p*0.05 FROM hi), m AS (SELECT match_id, h, a, sum(p) AS p FROM u GROUP BY ALL)
 SELECT match_id, round(sum(p) FILTER (h > a), 6) AS p_home, round(sum(p) FILTER (h + a > 2), 6) AS p_over25 FROM m GROUP BY 1""")
def dispersion_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.mixed_marginals(rates(spark, sf_dir), 0.65, 1.45, 0.10)
    return rows.select("match_id", F.round("p_home", 6).alias("p_home"), F.round("p_over25", 6).alias("p_over25"))


@query("""WITH r AS (SELECT p_partkey AS id, (0.8 + p_size % 9 / 10)::DOUBLE AS hf, (0.7 + p_size % 7 / 10)::DOUBLE AS ha, (0.6 + p_partkey % 11 / 10)::DOUBLE AS af, (0.9 + p_partkey % 5 / 10)::DOUBLE AS aa, (p_partkey % 7 - 3) / 20 AS adj FROM part)
 SELECT id, round(1.5*(hf/1.5)*(aa/1.5)*exp(adj), 6) AS lambda_home, round(1.2*(af/1.2)*(ha/1.2)*exp(-adj), 6) AS lambda_away FROM r""")
def team_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    home, away = pricing.attack_defence_rates(0.8 + s % 9 / 10, 0.7 + s % 7 / 10, 0.6 + k % 11 / 10, 0.9 + k % 5 / 10, F.lit(1.5), F.lit(1.2))
    adj = (k % 7 - 3) / 20
    return table(spark, sf_dir, "part").select(k.alias("id"), F.round(pricing.log_adjusted(home, F.create_map(F.lit("form"), adj)), 6).alias("lambda_home"), F.round(pricing.log_adjusted(away, F.create_map(F.lit("form"), -adj)), 6).alias("lambda_away"))


@query(with_views("tickets") + """ SELECT ticket_id, round(probability*odds-1, 6) AS ev, round(1/probability, 6) AS fair_odds, round(1.08/greatest(0.01, probability-0.075), 6) AS least_odds, odds >= 1.08/greatest(0.01, probability-0.075) AS acceptable FROM tickets""")
def price_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.price_audit(tickets(spark, sf_dir)).select("ticket_id", "ev", "fair_odds", "least_odds", "acceptable")


@query(with_views("quotes") + """, live AS (SELECT match_id, outcome, provider, arg_max(price, (ts, event_id)) AS price, arg_max(event_id % 5 <> 0, (ts, event_id)) AS active, arg_max(event_id % 7 <> 0, (ts, event_id)) AS verified, max(ts) AS ts FROM quotes WHERE provider < 4 GROUP BY ALL),
 c AS (SELECT event_id AS contract_id, match_id, outcome, provider, 0.2 + (event_id % 60)/100 AS probability, ts + INTERVAL 10 SECOND AS now FROM quotes),
 j AS (SELECT c.*, l.price AS lp, l.active, l.verified, l.ts AS lts FROM c LEFT JOIN live l ON c.match_id = l.match_id AND c.outcome = l.outcome AND c.provider = l.provider)
 SELECT contract_id, CAST((lp IS NOT NULL)::INT AS BIGINT) AS quotes, CASE WHEN lp IS NULL THEN 'not_found' WHEN NOT active THEN 'inactive' WHEN NOT verified THEN 'unverified' WHEN floor(epoch(now)) - floor(epoch(lts)) > 15 THEN 'stale' WHEN probability*lp-1 <= 0 THEN 'no_bet' ELSE 'candidate' END AS decision, round(probability*lp-1, 6) AS ev FROM j""")
def repricing_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quotes_long(spark, sf_dir).withColumn("outcome", F.concat_ws("/", "outcome", "provider"))
    order = F.struct("ts", "event_id")
    live = rows.where("provider < 4").groupBy("match_id", "outcome").agg(F.max_by("price", order).alias("price"), F.max_by(F.col("event_id") % 5 != 0, order).alias("active"), F.max_by(F.col("event_id") % 7 != 0, order).alias("verified"), F.max("ts").alias("ts"))
    contracts = rows.select(F.col("event_id").alias("contract_id"), "match_id", "outcome", (0.2 + (F.col("event_id") % 60) / 100).alias("probability"), (F.col("ts") + F.expr("interval 10 seconds")).alias("now"))
    return pricing.reprice(contracts, live)


@query("""WITH a AS (SELECT l_orderkey AS job, l_returnflag = 'A' AS ok, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag = 'A') AS n FROM lineitem), s AS (SELECT job, count(*) AS c, min(n) FILTER (ok) AS k FROM a GROUP BY 1)
 SELECT job, CASE WHEN k <= 2 THEN 'done' WHEN c >= 2 THEN 'failed' ELSE 'retry' END AS state, CAST(CASE WHEN k <= 2 THEN k WHEN c >= 2 THEN 2 ELSE c END AS INT) AS tries FROM s""")
def retry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("attempt"), (F.col("l_returnflag") == "A").alias("ok"))
    return pricing.retry_state(attempts, "job")


@query(with_views("quotes") + " SELECT event_id, match_id, coalesce(max(event_id % 41 = 0) OVER (PARTITION BY match_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS verified FROM quotes")
def sticky_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.sticky_verified(quotes_long(spark, sf_dir).withColumn("verified", F.col("event_id") % 41 == 0), "match_id").select("event_id", "match_id", "verified")


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders), n AS (SELECT l_orderkey AS id, max(l_linestatus) AS status, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1)
 SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.status = 'F' THEN o.status ELSE coalesce(n.status, o.status) END AS status, CASE WHEN o.status = 'F' THEN o.price ELSE coalesce(n.price, o.price) END AS price, CASE WHEN o.id IS NULL THEN 'created' WHEN o.status = 'F' THEN 'kept' ELSE 'updated' END AS change FROM o FULL JOIN n ON o.id = n.id""")
def schedule_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    new = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_linestatus").alias("status"), F.round(F.sum("l_extendedprice"), 2).alias("price"))
    return pricing.upsert(old, new, "id", ["status", "price"], F.col("o.status") == "F")


@query("""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN doc_id % 14 + 1 END AS rank, n_chars % 2 = 0 AS ov, quality = 1 AS hit, doc_id % 3 = 0 AS p, doc_id % 4 = 0 AS t, doc_id % 7 = 0 AS b, CASE doc_id % 6 WHEN 0 THEN 'home' WHEN 1 THEN 'draw' ELSE 'away' END AS actual, doc_id % 2 AS checks, CASE WHEN doc_id % 11 = 0 THEN ['score_selector_error', 'weather'] ELSE [] END AS given FROM documents JOIN labels USING (doc_id)),
 f AS (SELECT *, CASE WHEN NOT hit AND rank IS NOT NULL THEN list_filter(given, lambda x: x <> 'score_selector_error') || [CASE WHEN rank <= 5 THEN CASE WHEN ov THEN 'selector_override_error' ELSE 'score_matrix_top5_miss' END WHEN rank <= 10 THEN 'score_matrix_rank_error' ELSE 'score_matrix_tail_error' END] ELSE given END AS first FROM r),
 c AS (SELECT *, list_filter([CASE WHEN NOT p THEN 'direction_error' END, CASE WHEN NOT p AND actual = 'draw' THEN 'draw_underestimated' WHEN NOT p AND actual = 'away' THEN 'away_tail_missed' END, CASE WHEN NOT hit THEN 'score_selector_error' END, CASE WHEN NOT t THEN 'goal_total_error' END, CASE WHEN NOT b THEN 'btts_error' END, CASE WHEN checks = 0 THEN 'insufficient_snapshots' END], lambda x: x IS NOT NULL) AS chain FROM f)
 SELECT doc_id, array_to_string(CASE WHEN len(first) > 0 THEN first ELSE chain END, ',') AS tags FROM c""")
def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, k = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id"), F.col("doc_id")
    actual = F.when(k % 6 == 0, "home").when(k % 6 == 1, "draw").otherwise("away")
    given = F.when(k % 11 == 0, F.array(F.lit("score_selector_error"), F.lit("weather")))
    hits = {"primary": k % 3 == 0, "score": F.col("quality") == 1, "total": k % 4 == 0, "btts": k % 7 == 0}
    tags = pricing.error_tags(given, hits, F.when(k % 5 > 0, k % 14 + 1), F.col("n_chars") % 2 == 0, actual, k % 2)
    return rows.select("doc_id", F.array_join(tags, ",").alias("tags"))


@query("""WITH s AS (SELECT o_custkey AS id, count(*) FILTER (o_orderstatus = 'P') AS missing, count(*) FILTER (o_orderstatus <> 'P') AS checkpoints FROM orders GROUP BY 1), g AS (SELECT id, CASE WHEN missing = 0 AND checkpoints >= 4 THEN 'A' WHEN missing <= 2 AND checkpoints >= 2 THEN 'B' ELSE 'C' END AS grade FROM s)
 SELECT id, grade, CASE grade WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.7 ELSE 0.4 END::DOUBLE AS weight FROM g""")
def evidence_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count_if(F.col("o_orderstatus") == "P").alias("missing"), F.count_if(F.col("o_orderstatus") != "P").alias("checkpoints"))
    return counts.select("id", review.evidence_grade(F.col("missing"), F.col("checkpoints")).alias("g")).select("id", "g.grade", "g.weight")


@query("""WITH l AS (SELECT page_id, generate_subscripts(x, 1) - 1 AS place, unnest(x) AS a FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref="[^"]*"[^>]*>.*?</a>') AS x FROM pages))
 SELECT page_id, CAST(place AS INT) AS place, regexp_extract(a, '(?i)\\bhref="([^"]*)"', 1) AS href, trim(regexp_replace(regexp_replace(a, '(?s)<[^>]*>', ' ', 'g'), '(\\s|&nbsp;)+', ' ', 'g')) AS text FROM l""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.links(table(spark, sf_dir, "pages"), "page_id", "html")


@query(with_views("quotes") + """, d AS (SELECT match_id, provider, count(*) AS n, min(event_id) AS e FROM quotes GROUP BY ALL) SELECT match_id, arg_max(provider, (n, -e)) AS provider, max(n) AS n FROM d GROUP BY 1""")
def provider_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = quotes_long(spark, sf_dir).groupBy("match_id", "provider").agg(F.count("*").alias("n"), F.min("event_id").alias("e"))
    return counts.groupBy("match_id").agg(F.max_by("provider", F.struct("n", -F.col("e"))).alias("provider"), F.max("n").alias("n"))


@query(with_views("quotes") + """, h AS (SELECT match_id, provider, outcome, arg_max(price, (ts, event_id)) AS price FROM quotes WHERE price > 1 GROUP BY ALL), b AS (SELECT match_id, outcome, round(median(price), 6) AS median_price, round(max(price)-min(price), 6) AS spread, count(*) AS providers FROM h GROUP BY ALL) SELECT * FROM b""")
def price_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = quotes.latest_quotes(quotes_long(spark, sf_dir).where("price > 1"), ["match_id", "provider", "outcome"])
    return latest.groupBy("match_id", "outcome").agg(F.round(F.median("price"), 6).alias("median_price"), F.round(F.max("price") - F.min("price"), 6).alias("spread"), F.count("*").alias("providers"))


@query("""WITH p AS (SELECT o_custkey AS k, o_orderdate AS ts, o_totalprice AS v, o_orderkey AS id FROM orders), w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, id DESC) AS n FROM p) SELECT k AS custkey, id AS o_orderkey, v AS o_totalprice FROM w WHERE n = 1""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "custkey")
    return movement.survivors(rows, "custkey", [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderkey", "o_totalprice"]).drop("rows")


@query("""SELECT DISTINCT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey OR o_orderkey = c_custkey""")
def or_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.or_join(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), [("o_custkey", "c_custkey"), ("o_orderkey", "c_custkey")], "o_orderkey", "c_custkey")


@query("""WITH a AS (SELECT o_orderkey AS id, s_suppkey AS v, 0 AS r FROM orders JOIN supplier ON o_custkey = s_suppkey WHERE s_acctbal > 0), b AS (SELECT o_orderkey, min(l_suppkey), 1 FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY 1), c AS (SELECT o_orderkey, min(l_suppkey), 2 FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
 u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c), m AS (SELECT id, arg_min(v, (r, v)) AS supplier, min(r) AS source_rank FROM u GROUP BY 1) SELECT o_orderkey AS id, supplier, CAST(source_rank AS BIGINT) AS source_rank FROM orders LEFT JOIN m ON o_orderkey = m.id""")
def id_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("supplier"), "l_returnflag")
    good = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("o_custkey"), F.col("s_suppkey").alias("supplier"))
    return lookups.cascade(orders, "id", [orders.join(good, "o_custkey"), items.where("l_returnflag = 'R'"), items], "supplier")


@query(with_views("quotes") + """, d AS (SELECT match_id, provider, min(event_id) AS definition FROM quotes WHERE outcome = 'draw' GROUP BY ALL), own AS (SELECT * FROM d WHERE match_id <> 0), g AS (SELECT * FROM d WHERE match_id = 0)
 SELECT event_id, coalesce(own.definition, g.definition) AS definition FROM quotes q LEFT JOIN own ON q.match_id = own.match_id AND q.provider = own.provider LEFT JOIN g ON q.provider = g.provider""")
def quote_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quotes_long(spark, sf_dir)
    definitions = rows.where("outcome = 'draw'").groupBy("match_id", "provider").agg(F.min("event_id").alias("definition"))
    return lookups.with_definition(rows, definitions, "match_id", "provider", "definition").select("event_id", "definition")


@query("""SELECT o_orderkey AS id, CASE WHEN o_totalprice > 250000 THEN 'too_large' WHEN o_orderstatus = 'P' THEN 'not_https' WHEN o_orderpriority = '5-LOW' THEN 'unknown_source' WHEN o_orderkey % 11 = 0 THEN 'bad_time' WHEN o_custkey % 13 = 0 THEN 'empty' END AS reason FROM orders""")
def event_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    event = {
        "size": F.col("o_totalprice") * 6, "url": F.when(F.col("o_orderstatus") == "P", "http://x").otherwise("https://x"), "kind": F.when(F.col("o_orderpriority") == "5-LOW", "mail").otherwise("page"),
        "at": F.when(F.col("o_orderkey") % 11 == 0, "soon").otherwise("2024-01-01T00:00:00Z"), "payload": F.when(F.col("o_custkey") % 13 == 0, " ").otherwise("{}"),
    }
    return rows.select(F.col("o_orderkey").alias("id"), lookups.reject_reason(event).alias("reason"))


@query("""WITH e AS (SELECT l_orderkey AS match_id, CASE WHEN l_linenumber % 2 = 0 THEN 'home' ELSE 'away' END AS side, 1 + l_partkey % 110 AS m, 1 + l_suppkey % 9 AS kind FROM lineitem)
 SELECT match_id, count(*) FILTER (kind IN (1, 7, 8) AND side = 'home' AND m <= 90) AS home_90, count(*) FILTER (kind IN (1, 7, 8) AND side = 'away' AND m <= 90) AS away_90, count(*) FILTER (kind IN (1, 7, 8) AND side = 'home' AND m > 90) AS home_extra, count(*) FILTER (kind IN (1, 7, 8) AND side = 'away' AND m > 90) AS away_extra FROM e GROUP BY 1""")
def regulation_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("match_id"), F.when(F.col("l_linenumber") % 2 == 0, "home").otherwise("away").alias("side"), F.concat((1 + F.col("l_partkey") % 110).cast("string"), F.lit("+2")).alias("minute"), (1 + F.col("l_suppkey") % 9).alias("kind"),
    )
    return lookups.regulation_goals(events, "match_id")


@query("""WITH e AS (SELECT event_id, user_id::VARCHAR AS match_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, value FROM events)
 SELECT event_id, match_id, 'm' || (k % 5)::VARCHAR AS code, CASE WHEN k % 4 = 0 THEN (k % 3)::VARCHAR || '-1' ELSE '2.5' END AS line, round(round(value * 1000 + 100000) / 100000, 5) AS odds, k % 10 <> 0 AS active FROM e""")
def event_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a nested payload, read back as quote rows."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    selection = F.struct(F.lit("1").alias("id"), F.when(k % 4 == 0, F.concat((k % 3).cast("string"), F.lit(":1"))).otherwise("over").alias("name"), F.round(F.col("value") * 1000 + 100000).cast("long").alias("odds"), F.lit(1.0).alias("display"), F.lit(1).alias("status"))
    market = F.struct(F.concat(F.lit("m"), (k % 5).cast("string")).alias("code"), F.lit("n").alias("name"), F.when(k % 10 == 0, 1).otherwise(0).alias("status"), F.when(k % 4 == 0, "").otherwise("2.5").alias("line"), F.array(selection).alias("selections"))
    events = table(spark, sf_dir, "events").select("event_id", "ts", F.to_json(F.struct(F.col("user_id").cast("string").alias("match_id"), F.array(market).alias("markets"))).alias("payload"))
    return normalise.quote_rows(events).select("event_id", "match_id", "code", "line", "odds", "active")
