"""Named queries of nested payloads; every event tells one, whose shape goes by its type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.operators import payloads
from oddsloom.plans.adapters import dealt, table
from oddsloom.plans.catalog import query

_SELECTIONS = """'[{"obv":"1","oid":"o1","os":1,"ot":"1","ov":"' || (100000 + event_id % 97 * 1000) || '","ov2":"' || (event_id % 97) / 100 || '"},{"oid":"o2","os":' || event_id % 3 || ',"ot":"' || event_id % 4 || ':1","ov":"' || (event_id % 5 - 1) * 70000 || '","ov2":"-2.5"}]'"""
_PUSHED = f"""'{{"hls2":{{"' || CASE event_id % 3 WHEN 0 THEN '115' WHEN 1 THEN '1100484' ELSE '7' END || '":[{{"hid":"h' || event_id || '","hs":' || event_id % 2 || ',"hv":"","mid":"' || user_id || '","ol":' || {_SELECTIONS} || '}}]}}}}'"""
_LISTED = f"""'{{"data":{{"hpsData":[{{"hl":[{{"hid":"l' || event_id || '","hs":0,"hv":"' || event_id % 9 || '","ol":' || {_SELECTIONS} || '}}],"hpid":"2","hpn":"Total","mid":"m' || event_id % 50 || '"}},{{"hpid":"9","hpn":"Other' || event_id % 7 || '"}}],"mhn":"Home' || user_id || '","mid":"' || user_id || '"}}}}'"""
_OTHER = """'{"deep":[[[[[[[[[[' || props || ']]]]]]]]]],"note":"Bearer abc.' || event_id || ' old","password":"p' || event_id || '","who":{"n":' || event_id || ',"user_id":' || user_id || '}}'"""
_TYPED = f"CASE event_type WHEN 'view' THEN {_PUSHED} WHEN 'click' THEN {_LISTED} ELSE {_OTHER} END"
#: Two of three stand one or four levels further down.
_TEXT = f"CASE event_id % 3 WHEN 0 THEN {_TYPED} WHEN 1 THEN '{{\"d\":' || {_TYPED} || '}}' ELSE '[{{\"c\":[[' || {_TYPED} || ']]}}]' END"


def told(spark: SparkSession, sf_dir: str, text: str = _TEXT) -> DataFrame:
    """Payloads take much work each, so events are dealt over tasks while they are small."""
    return dealt(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "props"), "event_id").select("event_id", F.expr(text).alias("payload"))


_P = f"WITH p AS (SELECT event_id, {_TEXT} AS payload FROM events), tree AS (SELECT event_id, t.key, t.value, t.type, t.fullkey FROM p, json_tree(p.payload) t)"


@query(_P + r" SELECT event_id, count(*) AS nodes, count(*) FILTER (type NOT IN ('OBJECT', 'ARRAY')) AS leaves, CAST(max(len(regexp_extract_all(fullkey, '[.\[]'))) AS INT) AS depth FROM tree GROUP BY 1")
def payload_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = payloads.walked(told(spark, sf_dir), "payload")
    container = F.expr("rlike(to_json(value), '^[{\\\\[]')")
    return nodes.groupBy("event_id").agg(F.count("*").alias("nodes"), F.count_if(~F.coalesce(container, F.lit(False))).alias("leaves"), F.max("level").alias("depth"))


_QUOTE_SQL = r""" SELECT event_id, match_id, market_code, market_id, market_status, CASE WHEN market_code IN ('7', '341', '1100484', '1100485') AND regexp_full_match(score, '\d+[:-]\d+') THEN replace(score, ':', '-') ELSE line END AS line, selection_id, selection, selection_status,
 CASE WHEN raw > 0 THEN round(raw / 100000, 5) END AS odds, coalesce(raw > 0 AND abs(round(raw / 100000, 5) - CASE WHEN shown > 0 THEN 1 + shown WHEN shown < 0 THEN 1 + 1 / abs(shown) END) <= 0.02, false) AS odds_verified
 FROM (SELECT *, CASE WHEN line <> '' THEN line ELSE selection END AS score FROM (SELECT event_id, match_id, market_code, l ->> '$.hid' AS market_id, CAST(l ->> '$.hs' AS INT) AS market_status, coalesce(l ->> '$.hv', '') AS line, s.value ->> '$.oid' AS selection_id, s.value ->> '$.ot' AS selection,
 CAST(s.value ->> '$.os' AS INT) AS selection_status, CAST(s.value ->> '$.ov' AS BIGINT) AS raw, CAST(s.value ->> '$.ov2' AS DOUBLE) AS shown FROM lines, json_each(l -> '$.ol') s))"""


@query(_P + r""", lines AS (SELECT event_id, value ->> '$.mid' AS match_id, regexp_extract(fullkey, 'hls2\."?(\w+)"?\[\d+\]$', 1) AS market_code, value AS l FROM tree WHERE type = 'OBJECT' AND regexp_matches(fullkey, 'hls2\."?\w+"?\[\d+\]$')
 UNION ALL SELECT event_id, value ->> '$.mid', value ->> '$.hpid', h.value FROM tree, json_each(tree.value -> '$.hl') h WHERE type = 'OBJECT' AND value ->> '$.mid' <> '' AND value ->> '$.hpid' <> '')""".replace("SELECT event_id, value ->> '$.mid', value ->> '$.hpid', h.value FROM tree, json_each(tree.value -> '$.hl') h WHERE type = 'OBJECT' AND value ->> '$.mid' <> '' AND value ->> '$.hpid' <> ''", "SELECT event_id, m, c, h.value FROM (SELECT event_id, value ->> '$.mid' AS m, value ->> '$.hpid' AS c, value -> '$.hl' AS hl FROM tree WHERE type = 'OBJECT') t, json_each(t.hl) h WHERE m <> '' AND c <> ''") + _QUOTE_SQL)
def payload_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = payloads.walked(told(spark, sf_dir), "payload")
    return payloads.pushed_quotes(nodes, ["event_id"]).unionByName(payloads.listed_quotes(nodes, ["event_id"]))


@query(_P + """, o AS (SELECT event_id, fullkey, value ->> '$.mid' AS mid, value ->> '$.hpid' AS code, value ->> '$.hpn' AS name FROM tree WHERE type = 'OBJECT'),
 near AS (SELECT o.event_id, o.code, o.name, arg_max(a.mid, len(a.fullkey)) AS match_id FROM o LEFT JOIN o a ON a.event_id = o.event_id AND a.mid <> '' AND starts_with(o.fullkey, a.fullkey) WHERE o.code IS NOT NULL AND o.name <> '' GROUP BY o.event_id, o.fullkey, o.code, o.name)
 SELECT DISTINCT event_id, coalesce(match_id, '') AS match_id, code AS market_code, name AS market_name FROM near""")
def payload_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.definition_rows(payloads.walked(told(spark, sf_dir), "payload", {"match_id": "mid"}), ["event_id"])



@query("""WITH p AS (SELECT event_id, user_id, replace(props, ' ', '') AS props FROM events)
 SELECT event_id, '{"deep":[[[[[[[["[DEPTH_LIMIT]"]]]]]]]],"note":"[REDACTED_BEARER] old","who":{"n":' || event_id || '}}' AS cleaned,
 '{"deep":[[[[[[[["[depth-limited]"]]]]]]]],"note":"Bearer abc.' || event_id || ' old","password":"p' || event_id || '","who":{"n":' || event_id || ',"user_id":' || user_id || '}}' AS pruned,
 '{"deep":[[[[[[[[[[' || props || ']]]]]]]]]],"note":"bearer abc.' || event_id || ' new","password":"p' || event_id || '","who":{"n":' || event_id || ',"user_id":' || user_id || '}}' AS rewritten FROM p""")
def payload_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payloads.pruned(payloads.cleaned(told(spark, sf_dir, _OTHER), "payload"), "payload")
    return payloads.rewritten(rows, "payload", [("old", "new"), ("Bearer", "bearer")]).drop("payload")


_BASE = """'{"a":{"b":{"c":' || event_id || ',"d":"base"},"k":' || props || '},"s":' || user_id || ',"t":[1,2]}'"""
_OVER = """CASE event_id % 4 WHEN 0 THEN '{"a":{"b":{"d":"over","e":[' || event_id || ']}},"z":{"y":1}}' WHEN 1 THEN '{"a":' || event_id || '}' WHEN 2 THEN '{"s":{"u":' || user_id || '},"t":{"v":1}}' ELSE '{}' END"""
_PATHS = {"c": "$.a.b.c", "d": "$.a.b.d", "e": "$.a.b.e", "k": "$.a.k.k", "s": "$.s.u", "t": "$.t", "z": "$.z.y", "a": "$.a"}


@query(f"WITH m AS (SELECT event_id, json_merge_patch(CAST({_BASE} AS JSON), CAST({_OVER} AS JSON)) AS j FROM events) SELECT event_id, " + ", ".join(f"j ->> '{p}' AS {n}" if n != "a" else "CASE WHEN json_type(j -> '$.a') = 'OBJECT' THEN 'object' ELSE j ->> '$.a' END AS a" for n, p in _PATHS.items()) + " FROM m")
def payload_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_BASE).alias("base"), F.expr(_OVER).alias("other"))
    j = F.col("merged")
    found = [F.get_json_object(j, p).alias(n) for n, p in _PATHS.items() if n != "a"]
    return payloads.merged(rows, "base", "other").select("event_id", *found, F.when(F.get_json_object(j, "$.a").startswith("{"), "object").otherwise(F.get_json_object(j, "$.a")).alias("a"))


_LOGGED = """CASE event_id % 4 WHEN 0 THEN replace('{"cmd":"js_code","data":{"fun":"wslog.send_msg","param":["WS---R:","{~"cd~":{~"n~":' || event_id || '}}"]}}', '~', chr(92)) WHEN 1 THEN '{"cmd":"js_code","data":{"fun":"wslog.send_msg","param":["WS---S:","' || event_id || '"]}}'
 WHEN 2 THEN '{"cd":{"n":' || event_id || '},"data":"H4sI ' || user_id || '"}' ELSE 'no json ' || event_id END"""


@query("""SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'outbound' WHEN 3 THEN 'not_json' END AS refused, CAST(NULL AS VARCHAR) AS encoding, CASE WHEN event_id % 4 IN (0, 2) THEN event_id END AS n,
 CASE event_id % 4 WHEN 2 THEN 'H4sI ' || user_id WHEN 0 THEN '{"fun":"wslog.send_msg","param":["WS---R:",{"cd":{"n":' || event_id || '}}]}' END AS data FROM events""")
def payload_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payloads.decoded(told(spark, sf_dir, _LOGGED), "payload")
    n = "coalesce(try_variant_get(payload, '$.data.param[1].cd.n', 'long'), try_variant_get(payload, '$.cd.n', 'long'))"
    return rows.select("event_id", "refused", "encoding", F.expr(n).alias("n"), F.expr("try_variant_get(payload, '$.data', 'string')").alias("plain"), F.expr("to_json(try_variant_get(payload, '$.data', 'variant'))").alias("j")).select("event_id", "refused", "encoding", "n", F.coalesce(F.when(~F.col("j").startswith("{"), F.col("plain")), F.col("j")).alias("data"))
