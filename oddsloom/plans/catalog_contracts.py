"""Named queries of contracts in reports; every part stands for a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.operators import contracts
from oddsloom.plans.adapters import table
from oddsloom.plans.catalog import query

_PRIMARY = "CASE k % 9 WHEN 0 THEN '全场大' || k % 4 || '.5' WHEN 1 THEN '小 ' || (1 + k % 3) || '.0 球' WHEN 2 THEN '胜平负：主胜（模型45%）' WHEN 3 THEN '客胜' WHEN 4 THEN '平局 或 主胜' WHEN 5 THEN '主队净胜1球' WHEN 6 THEN '让球' WHEN 7 THEN ' ' END"
_AUDITS = [
    ("'SPF主胜'", "CASE WHEN k % 5 > 0 THEN 1.5 + k % 7 * 0.1 END", "0.3 + k % 5 * 0.1", "k % 5 * 0.02"),
    ("'A 大' || k % 4 || '.5'", "CASE WHEN k % 7 > 0 THEN 1.8 ELSE 0 END", "0.52", "k % 3 * 0.01"),
    ("'B 大2.5'", "1.9", "0.5", "0.03"),
    ("'B 小' || (1 + k % 3)", "2.0", "CASE WHEN k % 2 > 0 THEN 0.48 END", "0.04"),
    ("'SPF平局'", "3.2", "0.28", "CASE WHEN k % 4 > 0 THEN -0.1 END"),
]
_OFFICIAL, _CHANCES = ("CASE WHEN k % 6 > 0 THEN 2.1 END", "3.1", "CASE WHEN k % 11 > 0 THEN 2.5 + k % 3 * 0.5 ELSE 0 END"), ("0.4", "0.3", "CASE WHEN k % 4 > 0 THEN 0.3 END")
_ROUNDED = ("odds", "probability", "ev")


def _sql_struct(values: dict[str, str]) -> str:
    return "{" + ", ".join(f"'{n}': CAST({e} AS {'VARCHAR' if n == 'm' else 'DOUBLE'})" for n, e in values.items()) + "}"


@query(f"""WITH r AS (SELECT p_partkey AS k, trim(coalesce({_PRIMARY.replace('k %', 'p_partkey %')}, '')) AS t FROM part),
 a AS (SELECT *, [{", ".join(_sql_struct(dict(zip("mope", x))) for x in _AUDITS)}] AS audits, {_sql_struct(dict(zip(("home", "draw", "away"), _OFFICIAL)))} AS o, {_sql_struct(dict(zip(("home", "draw", "away"), _CHANCES)))} AS c, regexp_extract(t, '[大小]\\s*(\\d+(\\.\\d+)?)', 1) AS line FROM r),
 g AS (SELECT *, CASE WHEN line <> '' THEN 'total' WHEN regexp_matches(t, '主胜|客胜|平局') THEN '1x2' WHEN regexp_matches(t, '净胜|让') THEN 'handicap' ELSE 'other' END AS market_group,
  CASE WHEN line <> '' THEN CASE WHEN contains(t, '小') THEN 'under' ELSE 'over' END WHEN contains(t, '主胜') THEN 'home' WHEN contains(t, '客胜') THEN 'away' WHEN contains(t, '平局') THEN 'draw' WHEN regexp_matches(t, '净胜|让') THEN 'unresolved_handicap' END AS selection FROM a),
 w AS (SELECT *, CASE market_group WHEN 'total' THEN CASE selection WHEN 'under' THEN '小' ELSE '大' END || regexp_replace(line, '\\.0$', '') WHEN '1x2' THEN CASE selection WHEN 'home' THEN '主胜' WHEN 'away' THEN '客胜' ELSE '平局' END END AS token FROM g),
 f AS (SELECT *, list_filter(audits, lambda x: token IS NOT NULL AND contains(x.m, token) AND x.o IS NOT NULL AND x.o <> 0)[1] AS x, CASE selection WHEN 'home' THEN o.home WHEN 'draw' THEN o.draw WHEN 'away' THEN o.away END AS po, CASE selection WHEN 'home' THEN c.home WHEN 'draw' THEN c.draw WHEN 'away' THEN c.away END AS pc FROM w)
 SELECT k AS report_id, market_group, selection, TRY_CAST(nullif(line, '') AS DOUBLE) AS line, round(CASE WHEN x IS NOT NULL THEN x.o WHEN market_group = '1x2' THEN po END, 6) AS odds, round(CASE WHEN x IS NOT NULL THEN x.p WHEN market_group = '1x2' THEN pc END, 6) AS probability,
 round(CASE WHEN x IS NOT NULL THEN x.e WHEN market_group = '1x2' AND po <> 0 AND pc IS NOT NULL THEN pc * po - 1 END, 6) AS ev, CASE WHEN x IS NOT NULL THEN x.m WHEN market_group = '1x2' AND po <> 0 AND pc IS NOT NULL THEN 'official_spf' END AS price_source FROM f""")
def primary_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))
    number = lambda e: F.expr(f"cast({e} as double)")
    nothing = F.lit(None).cast("double")
    audits = [F.struct(F.expr(m).alias("market"), number(o).alias("odds"), number(p).alias("model_probability"), number(e).alias("ev"), nothing.alias("conservative_probability"), nothing.alias("conservative_ev")) for m, o, p, e in _AUDITS]
    by_outcome = lambda x: F.struct(*[number(e).alias(n) for n, e in zip(("home", "draw", "away"), x)])
    reports = rows.select(F.col("k").alias("report_id"), F.expr(_PRIMARY).alias("primary"), F.array(*audits).alias("audits"), by_outcome(_OFFICIAL).alias("official"), by_outcome(_CHANCES).alias("probabilities"))
    found = contracts.primary_contracts(reports).drop("conservative_ev")
    return found.withColumns({n: F.round(n, 6) for n in _ROUNDED})


@query("""SELECT p_partkey AS report_id, (p_partkey % 5) || '-' || (p_size % 4) AS selection, CASE WHEN p_partkey % 5 = 1 AND p_size % 4 = 1 THEN 0.12 WHEN p_partkey % 5 = 2 AND p_size % 4 = 0 THEN 0.09 END AS probability FROM part WHERE p_partkey % 7 > 0""")
def score_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    text = F.when(k % 7 == 0, F.lit("no score")).otherwise(F.concat(F.lit("score "), k % 5, F.lit("："), s % 4))
    listed = F.array(*[F.struct(F.lit(t).alias("score"), F.lit(p).alias("probability")) for t, p in (("1-1", 0.12), ("2 : 0", 0.09), ("1-1", 0.5))])
    return contracts.score_contracts(table(spark, sf_dir, "part").select(k.alias("report_id"), text.alias("score"), listed.alias("scores")))
