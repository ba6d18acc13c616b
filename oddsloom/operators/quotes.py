"""Prices of several providers: overround removal, consensus, panels by tier.

Prices at or below 1 are no prices. Three-way prices come in long form, one
row a quote; ``outcome`` is home, draw or away. All operators are grouped
aggregates with a partial sum before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oddsloom.operators import running

OUTCOMES = ("home", "draw", "away")
#: Providers by tier; and weights of tiers (synthetic, as tiers are input).
TIERS = {0: "sharp", 1: "sharp", 2: "asian", 3: "asian", 4: "broad", 5: "broad", 6: "broad"}
TIER_WEIGHTS = {"sharp": 0.5, "asian": 0.3, "broad": 0.2}


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def latest_quotes(quotes: DataFrame, keys: list[str]) -> DataFrame:
    """The last quote of each key, by time and then event id."""
    return quotes.groupBy(*keys).agg(F.max_by("price", F.struct("ts", "event_id")).alias("price"))


def three_way(quotes: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key with all three latest prices above 1; others are left out."""
    valid = latest_quotes(quotes.where("price > 1"), [*keys, "outcome"])
    wide = valid.groupBy(*keys).agg(*[F.max(F.when(F.col("outcome") == o, F.col("price"))).alias(o) for o in OUTCOMES])
    return wide.where("home is not null and draw is not null and away is not null")


def devig(home: Column, draw: Column, away: Column) -> list[Column]:
    """Proportional removal of the margin."""
    total = 1 / home + 1 / draw + 1 / away
    return [1 / x / total for x in (home, draw, away)]


def shin(home: Column, draw: Column, away: Column) -> list[Column]:
    """Practical Shin removal: z = max(0, (sum of inverse prices - 1) / 2)."""
    z = F.greatest(F.lit(0.0), (1 / home + 1 / draw + 1 / away - 1) / 2)
    raw = [(1 - z) / ((1 - z) * x + z) for x in (home, draw, away)]
    return [r / (raw[0] + raw[1] + raw[2]) for r in raw]


def first_largest(columns: list[tuple[str, Column]]) -> Column:
    """Name of the largest value, the first of equal ones."""
    best = F.greatest(*[c for _, c in columns])
    out = None
    for name, c in columns:
        out = F.when(c == best, name) if out is None else out.when(c == best, name)
    return out


def consensus_devig(quotes: DataFrame) -> DataFrame:
    """Mean of the providers' de-vigged probabilities of each match, and the leader."""
    wide = three_way(quotes, ["match_id", "provider"])
    probs = wide.select("match_id", *[c.alias(o) for o, c in zip(OUTCOMES, devig(F.col("home"), F.col("draw"), F.col("away")))])
    mean = probs.groupBy("match_id").agg(F.count("*").alias("providers"), *[F.round(F.avg(o), 6).alias(f"p_{o}") for o in OUTCOMES])
    return mean.withColumn("leader", first_largest([(o, F.col(f"p_{o}")) for o in OUTCOMES]))


def shin_devig(quotes: DataFrame) -> DataFrame:
    wide = three_way(quotes, ["match_id", "provider"])
    return wide.select("match_id", "provider", *[F.round(c, 6).alias(f"p_{o}") for o, c in zip(OUTCOMES, shin(F.col("home"), F.col("draw"), F.col("away")))])


def operator_profit(stakes: DataFrame) -> DataFrame:
    """What a provider keeps in each scenario: all stakes less the winning outcome's payout."""
    sums = stakes.groupBy("match_id").agg(F.sum("stake").alias("total"), *[F.sum(F.when(F.col("outcome") == o, F.col("stake") * F.col("price")).otherwise(0.0)).alias(f"pay_{o}") for o in OUTCOMES])
    return sums.select("match_id", *[F.round(F.col("total") - F.col(f"pay_{o}"), 4).alias(f"profit_{o}") for o in OUTCOMES])


def with_tier(rows: DataFrame, tiers: dict[int, str] = TIERS) -> DataFrame:
    """Left lookup of a provider's tier in a short fixed list; providers outside it have none."""
    mapping = F.create_map(*[x for k, v in tiers.items() for x in (F.lit(k).cast("long"), F.lit(v))])
    return rows.withColumn("tier", F.try_element_at(mapping, F.col("provider")))


def open_and_current(quotes: DataFrame) -> DataFrame:
    """First and last price of each match, provider and outcome."""
    order = F.struct("ts", "event_id")
    return quotes.where("price > 1").groupBy("match_id", "provider", "outcome").agg(F.min_by("price", order).alias("open"), F.max_by("price", order).alias("current"), F.count("*").alias("points"))


def tier_panel(quotes: DataFrame) -> DataFrame:
    """Providers and mean opening and current prices by match, tier and outcome; unmapped ones under ``unmapped``."""
    rows = with_tier(open_and_current(quotes)).withColumn("tier", F.coalesce("tier", F.lit("unmapped")))
    return rows.groupBy("match_id", "tier", "outcome").agg(F.countDistinct("provider").alias("providers"), F.round(F.avg("open"), 6).alias("mean_open"), F.round(F.avg("current"), 6).alias("mean_current"))


def scs_score(quotes: DataFrame, weights: dict[str, float] = TIER_WEIGHTS) -> DataFrame:
    """Signed consensus of price moves: mean by tier, then a weighted mean over tiers that have one.

    A move counts if it is not less than the noise, the larger of 2 % of the
    opening price and 1.5 standard deviations (of three points or more), and
    fades by the age of the last change.
    """
    series = Window.partitionBy("match_id", "provider", "outcome").orderBy("ts", "event_id")
    changed = quotes.where("price > 1").withColumn("changed", F.when(F.col("price") != F.lag("price").over(series), F.col("ts")))
    order = F.struct("ts", "event_id")
    rows = changed.groupBy("match_id", "provider", "outcome").agg(
        F.min_by("price", order).alias("open"), F.max_by("price", order).alias("current"), F.count("*").alias("n"),
        F.stddev_pop("price").alias("sigma"), F.max("changed").alias("last_change"), F.max("ts").alias("latest"),
    )
    age = F.coalesce((micros("latest") - micros("last_change")) / 3.6e9, F.lit(0.0))
    delta = F.col("current") - F.col("open")
    noise = F.greatest(0.02 * F.col("open"), F.when(F.col("n") >= 3, 1.5 * F.col("sigma")).otherwise(0.0))
    size = F.least(F.abs(delta / F.col("open")) / 0.10, F.lit(1.0))
    signal = F.when(F.abs(delta) < noise, 0.0).otherwise(F.when(delta < 0, 1.0).otherwise(-1.0) * size * F.exp(-age / 24))
    tiers = with_tier(rows.withColumn("signal", signal)).where("tier is not null").groupBy("match_id", "outcome", "tier").agg(F.avg("signal").alias("score"))
    weight = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])[F.col("tier")]
    return tiers.groupBy("match_id", "outcome").agg(F.round(F.sum(weight * F.col("score")) / F.sum(weight), 6).alias("signed_score"), F.count("*").alias("tiers"))


def dri_band(quotes: DataFrame, league_median: float | None = None) -> DataFrame:
    """Dispersion of providers' current prices, weighed .5 / .3 / .2, and its risk band."""
    spread = open_and_current(quotes).groupBy("match_id", "outcome").agg((F.stddev_pop("current") * 100).alias("dispersion"))
    wide = spread.groupBy("match_id").agg(*[F.max(F.when(F.col("outcome") == o, F.col("dispersion"))).alias(o) for o in OUTCOMES])
    raw = F.col("home") * 0.5 + F.col("draw") * 0.3 + F.col("away") * 0.2
    value = raw / league_median * 30 if league_median else raw
    band = F.when(value < 12, "tight").when(value <= 35, "normal").when(value <= 60, "high").otherwise("extreme")
    return wide.where("home is not null and draw is not null and away is not null").select("match_id", F.round(raw, 6).alias("raw"), band.alias("risk_band"))


def water_flow(lines: DataFrame) -> DataFrame:
    """Direction of the water of providers whose line did not change, by match.

    Money is taken to come in on the home side where its water falls or the
    away side's rises, and to go out where it is the other way round.
    """
    order = F.struct("ts", "event_id")
    ends = lines.where("family = 'asian'").groupBy("match_id", "provider").agg(*[f(c, order).alias(f"{c}_{n}") for c in ("line", "water", "water_away") for n, f in (("open", F.min_by), ("current", F.max_by))])
    same = ends.where("line_open = line_current and water_open is not null and water_current is not null and water_away_open is not null and water_away_current is not null")
    same = same.withColumns({"home": F.col("water_current") - F.col("water_open"), "away": F.col("water_away_current") - F.col("water_away_open")})
    in_ = F.expr("home < 0 or away > 0")
    out = same.groupBy("match_id").agg(F.count("*").alias("sources"), F.count_if(in_).alias("home_in"), F.count_if(~in_ & F.expr("home > 0 or away < 0")).alias("home_out"), F.count_if(F.expr("home = 0 and away = 0")).alias("neutral"))
    ratio = F.abs(F.col("home_in") - F.col("home_out")) / F.col("sources")
    return out.select("match_id", "sources", "home_in", "home_out", "neutral", F.round(ratio, 6).alias("flow_ratio"), F.when(F.col("home_in") > F.col("home_out"), "home").when(F.col("home_out") > F.col("home_in"), "away").otherwise("neutral").alias("direction"))


def kelly_panel(quotes: DataFrame) -> DataFrame:
    """Providers and mean current Kelly index of each outcome by match and tier; an index of prices, not a stake."""
    latest = quotes.groupBy("match_id", "provider", "outcome").agg(F.max_by("kelly", F.struct("ts", "event_id")).alias("kelly"))
    rows = with_tier(latest).where("tier is not null")
    return rows.groupBy("match_id", "tier").agg(F.countDistinct("provider").alias("companies"), *[F.round(F.avg(F.when(F.col("outcome") == o, F.col("kelly"))), 6).alias(f"kelly_{o}") for o in OUTCOMES])


def genuine_timeline(quotes: DataFrame, least: int = 3) -> DataFrame:
    """Mean prices at each snapshot that has all three outcomes, of matches with at least ``least`` such snapshots."""
    points = quotes.groupBy("match_id", "snapshot").agg(*[F.round(F.avg(F.when(F.col("outcome") == o, F.col("price"))), 6).alias(o) for o in OUTCOMES]).where("home is not null and draw is not null and away is not null")
    return points.withColumn("points", F.count("*").over(Window.partitionBy("match_id"))).where(F.col("points") >= least)


def price_pressure(quotes: DataFrame) -> DataFrame:
    """The outcome whose mean price fell most from opening to current, and how strongly (from 8 % strong, from 3 % moderate)."""
    mean = open_and_current(quotes).groupBy("match_id", "outcome").agg(F.avg("open").alias("open"), F.avg("current").alias("current"))
    rank = F.when(F.col("outcome") == "home", 2).when(F.col("outcome") == "draw", 1).otherwise(0)
    change = (F.col("open") - F.col("current")) / F.col("open")
    best = mean.groupBy("match_id").agg(F.max(F.struct(F.round(change, 6).alias("change"), rank.alias("rank"), "outcome")).alias("b"))
    strength = F.when(F.col("b.change") >= 0.08, "strong").when(F.col("b.change") >= 0.03, "moderate").otherwise("weak")
    return best.select("match_id", F.col("b.outcome").alias("direction"), F.col("b.change").alias("relative_change"), strength.alias("strength"))


def page_average(quotes: DataFrame) -> DataFrame:
    """Mean opening and current prices of a match's providers, to four places."""
    return open_and_current(quotes).groupBy("match_id").agg(*[F.round(F.avg(F.when(F.col("outcome") == o, F.col(c))) + 1e-9, 4).alias(f"{c}_{o}") for o in OUTCOMES for c in ("open", "current")])


def middle(bid: Column, ask: Column, first: Column) -> Column:
    """Half way between bid and ask where they fit together, else the first listed price."""
    return F.coalesce(F.when(ask >= bid, (bid + ask) / 2), first)


def mid_consensus(books: DataFrame) -> DataFrame:
    """Normalised middles of matches that have a positive one for all three outcomes; others say why not.

    ``books`` has ``match_id, outcome, bid, ask, first``.
    """
    mids = books.groupBy("match_id").agg(*[F.avg(F.when(F.col("outcome") == o, middle(F.col("bid"), F.col("ask"), F.col("first")))).alias(o) for o in OUTCOMES])
    total = F.col("home") + F.col("draw") + F.col("away")
    complete = F.expr("home > 0 and draw > 0 and away > 0")
    return mids.select("match_id", F.when(complete, "complete").otherwise("incomplete").alias("quality"), *[F.when(complete, F.round(F.col(o) / total, 6)).alias(f"p_{o}") for o in OUTCOMES])


def trend_first_move(quotes: DataFrame, least: float = 0.01) -> DataFrame:
    """Each provider's first changed quote of a match, earliest over outcomes, and its order among providers."""
    series = Window.partitionBy("match_id", "provider", "outcome").orderBy("ts", "event_id")
    moved = quotes.where("price > 1").withColumn("before", F.lag("price").over(series)).where(F.abs(F.col("price") - F.col("before")) >= least)
    order = F.struct("ts", "event_id")
    first = moved.groupBy("match_id", "provider").agg(F.min("event_id").alias("event_id"), F.min_by("outcome", order).alias("outcome"), F.min_by(F.when(F.col("price") < F.col("before"), "shortened").otherwise("lengthened"), order).alias("direction"), F.countDistinct("outcome").alias("outcomes"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("match_id").orderBy("event_id")).cast("long"))


def exchange_growth(quotes: DataFrame, hours: int = 4) -> DataFrame:
    """Growth of a running volume against the earliest point of the trailing hours, else the point before."""
    rows = quotes.select("event_id", "match_id", "price", running.micros(F.col("ts")).alias("us"))
    rows = running.running(rows, "match_id", "us", ["event_id"], {"volume": F.col("price"), "points": F.lit(1)})
    # The earliest point of the trailing hours is the first one at or after their start; it counts if it is before the quote.
    probes = rows.select("match_id", (F.col("us") - hours * 3_600_000_000).alias("us"), "event_id", "volume", "price", "points", F.col("us").alias("own_us"))
    rows = running.next_value(rows, probes, "match_id", "us", "volume")
    before = F.when(F.col("points") > 1, F.col("volume") - F.col("price"))
    rows = rows.withColumn("reference", F.coalesce(F.when(F.col("next_us") < F.col("own_us"), F.col("next_value")), before))
    return rows.where("reference is not null").select("event_id", "match_id", F.round(F.col("volume") / F.col("reference"), 6).alias("growth"))


def market_metrics(quotes: DataFrame, lines: DataFrame) -> DataFrame:
    """Exact medians of absolute lines (between -5 and 5), spread and deviation of prices, and the change of a match's first provider."""
    order = F.struct("ts", "event_id")
    ends = lines.groupBy("match_id", "provider", "family").agg(F.min_by("line", order).alias("open"), F.max_by("line", order).alias("current"), F.max_by("water", order).alias("water"))
    asian = lambda c: F.when((F.col("family") == "asian") & F.col(c).between(-5, 5), F.abs(c))
    by = ends.groupBy("match_id").agg(
        F.round(F.median(asian("current")), 6).alias("asian_line"),
        F.round(F.median(asian("open")), 6).alias("asian_open"),
        F.round(F.median(F.when((F.col("family") == "total") & F.col("current").between(1, 5), F.col("current"))), 6).alias("total_line"),
        F.round(F.stddev_pop(F.when(F.col("family") == "asian", F.col("water"))), 6).alias("water_sigma"),
    )
    home = open_and_current(quotes).where("outcome = 'home'")
    prices = home.groupBy("match_id").agg(F.round(F.max("current") - F.min("current"), 6).alias("home_spread"), F.round(F.max(F.when(F.col("provider") == 0, F.col("current") / F.col("open") - 1)), 6).alias("lead_change"))
    return by.join(prices, "match_id", "full_outer")


def arbitrage(quotes: DataFrame) -> DataFrame:
    """Best price of each outcome over providers, the sum of inverses, and equal-payout stakes of one unit."""
    best = latest_quotes(quotes.where("price > 1"), ["match_id", "provider", "outcome"]).groupBy("match_id").agg(*[F.max(F.when(F.col("outcome") == o, F.col("price"))).alias(o) for o in OUTCOMES])
    total = sum((1 / F.col(o) for o in OUTCOMES), F.lit(0.0))
    return best.where("home is not null and draw is not null and away is not null").select("match_id", F.round(total, 6).alias("inverse_sum"), (total < 1).alias("arbitrage"), *[F.round(1 / F.col(o) / total, 6).alias(f"stake_{o}") for o in OUTCOMES])
