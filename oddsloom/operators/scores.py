"""Score distributions: Dixon-Coles matrices, marginals, settlement of quarter lines, fair lines.

A matrix is rows ``(match_id, h, a, p)``: each match's grid is made from its
rates by ``sequence`` and ``explode``, so matches stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GOALS = 12
CATEGORIES = {2: "full_win", 1: "half_win", 0: "push", -1: "half_loss", -2: "full_loss"}


def held(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``rows`` with more columns, computed once a row.

    Spark would else put such a column's expression in place of its name, and
    so evaluate it again for each step of a function over an array.
    """
    kept = rows.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_held"))
    return kept.select(*[F.col(f"`{n}`") for n in rows.columns], *[F.col(f"_held.{n}").alias(n) for n in columns])


def poisson(rate: Column, goals: Column) -> Column:
    return F.exp(-rate) * F.pow(rate, goals) / F.factorial(goals)


def score_matrix(rates: DataFrame, goals: int = GOALS) -> DataFrame:
    """Score probabilities of each match: two Poisson rates, corrected in the four low scores, cut at zero, adding up to one.

    The sum of a match's grid is known in its row before the grid is made, so
    nothing is shuffled.
    """
    h, a, lh, la, rho = (F.col(c) for c in ("h", "a", "lh", "la", "rho"))
    low = {(0, 0): 1 - lh * la * rho, (0, 1): 1 + lh * rho, (1, 0): 1 + la * rho, (1, 1): 1 - rho}
    mass = lambda rate: F.aggregate(F.sequence(F.lit(0), F.lit(goals)), F.lit(0.0), lambda s, g: s + poisson(rate, g))
    total = mass(lh) * mass(la)
    for (x, y), t in low.items():
        total = total + poisson(lh, F.lit(x)) * poisson(la, F.lit(y)) * (F.greatest(F.lit(0.0), t) - 1)
    grid = rates.select("match_id", "lh", "la", "rho", total.alias("total"), F.explode(F.sequence(F.lit(0), F.lit(goals))).alias("h"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(goals))).alias("a"))
    tau = F.lit(1.0)
    for (x, y), t in low.items():
        tau = F.when((h == x) & (a == y), t).otherwise(tau)
    return grid.select("match_id", "h", "a", (F.greatest(F.lit(0.0), poisson(lh, h) * poisson(la, a) * tau) / F.col("total")).alias("p"))


def score_marginals(matrix: DataFrame) -> DataFrame:
    """Outcomes, both-score and over 2.5 of each match."""
    s = lambda c: F.round(F.sum(F.when(F.expr(c), F.col("p")).otherwise(0.0)), 6)
    return matrix.groupBy("match_id").agg(s("h > a").alias("p_home"), s("h = a").alias("p_draw"), s("h < a").alias("p_away"), s("h > 0 and a > 0").alias("p_btts"), s("h + a > 2").alias("p_over25"), s("h + a in (1, 3)").alias("p_total_1_or_3"))


def top_scores(matrix: DataFrame, k: int = 10) -> DataFrame:
    """The likeliest scores of each match, with rank and fair odds."""
    order = Window.partitionBy("match_id").orderBy(F.round("p", 9).desc(), "h", "a")
    return matrix.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("match_id", "place", "h", "a", F.round("p", 6).alias("p"), F.round(1 / F.col("p"), 3).alias("fair_odds"))


def line_parts(line: Column) -> list[Column]:
    """A quarter line's two half lines; any other line twice."""
    units = F.round(line * 4)
    odd = (units % 2) != 0
    return [F.when(odd, (units - 1) / 4).otherwise(units / 4), F.when(odd, (units + 1) / 4).otherwise(units / 4)]


def settled_units(margin: Column) -> Column:
    return F.when(margin > 1e-9, 1).when(margin < -1e-9, -1).otherwise(0)


def settle_lines(matrix: DataFrame, lines: list[float], kind: str) -> DataFrame:
    """Probabilities of the five settlements of each line, win and loss units and fair odds.

    ``kind``: ``handicap`` (home side), ``over`` or ``under``.
    """
    rows = matrix.withColumn("line", F.explode(F.array(*[F.lit(float(x)) for x in lines])))
    parts = line_parts(F.col("line"))
    if kind == "handicap":
        margins = [F.col("h") - F.col("a") + p for p in parts]
    else:
        margins = [(F.col("h") + F.col("a") - p) * (1 if kind == "over" else -1) for p in parts]
    rows = rows.withColumn("net", settled_units(margins[0]) + settled_units(margins[1]))
    sums = rows.groupBy("match_id", "line").agg(*[F.sum(F.when(F.col("net") == n, F.col("p")).otherwise(0.0)).alias(c) for n, c in CATEGORIES.items()])
    win, loss = F.col("full_win") + 0.5 * F.col("half_win"), F.col("full_loss") + 0.5 * F.col("half_loss")
    return sums.select("match_id", "line", *[F.round(c, 6).alias(c) for c in CATEGORIES.values()], F.round(win - loss, 6).alias("net_at_2"), F.when(win > 0, F.round(1 + loss / win, 4)).alias("fair_odds"))


def fair_line(matrix: DataFrame) -> DataFrame:
    """Of the home handicaps from -5 to 5 in quarters, the one whose fair odds are nearest to 2; ties to the smaller, then the lower one."""
    margin = matrix.groupBy("match_id", (F.col("h") - F.col("a")).alias("margin")).agg(F.sum("p").alias("p"))
    rows = margin.withColumn("line", F.explode(F.expr("transform(sequence(-20, 20), x -> x / 4D)")))
    parts = line_parts(F.col("line"))
    rows = rows.withColumn("net", settled_units(F.col("margin") + parts[0]) + settled_units(F.col("margin") + parts[1]))
    odds = rows.groupBy("match_id", "line").agg(F.sum(F.when(F.col("net") > 0, F.col("net") * F.col("p") / 2).otherwise(0.0)).alias("win"), F.sum(F.when(F.col("net") < 0, -F.col("net") * F.col("p") / 2).otherwise(0.0)).alias("loss"))
    odds = odds.where("win > 0").withColumn("odds", F.round(1 + F.col("loss") / F.col("win"), 6))
    order = F.struct(F.round(F.abs(F.col("odds") - 2), 5), F.abs("line"), "line")
    return odds.groupBy("match_id").agg(F.min_by(F.struct("line", "odds"), order).alias("b")).select("match_id", F.col("b.line").alias("line"), F.round("b.odds", 4).alias("fair_odds"))


def truncation_audit(rates: DataFrame, goals: int = GOALS) -> DataFrame:
    """Mass of the grid before it is made to add up, and whether so little is cut that prices may be made."""
    mass = lambda c: F.aggregate(F.sequence(F.lit(0), F.lit(goals)), F.lit(0.0), lambda s, g: s + poisson(F.col(c), g))
    kept = mass("lh") * mass("la")
    return rates.select("match_id", F.round(kept, 9).alias("retained"), (1 - kept <= 1e-6).alias("pricing_allowed"))


def half_full_time(rates: DataFrame, goals: int = 10) -> DataFrame:
    """Nine outcomes of half-time and full-time, from a rate of each side in each half: ``h1, a1, h2, a2``.

    Each half's goal differences are summed into an array first, so a match
    takes two arrays of 2 * goals + 1 numbers in its row rather than a grid of
    four, and nothing is shuffled. A missing or negative rate gives no rows:
    halves are never inferred from whole matches.
    """
    pmf = lambda c: f"transform(sequence(0, {goals}), g -> exp(-{c}) * pow({c}, g) / factorial(g))"
    rows = rates.where("h1 >= 0 and a1 >= 0 and h2 >= 0 and a2 >= 0")
    rows = held(rows, {f"p_{c}": F.expr(pmf(c)) for c in ("h1", "a1", "h2", "a2")})
    differences = {}
    for k in (1, 2):
        differences[f"d{k}"] = (F.expr(f"transform(sequence(-{goals}, {goals}), m -> aggregate(sequence(greatest(0, m), least({goals}, {goals} + m)), 0D, (s, h) -> s + p_h{k}[h] * p_a{k}[h - m]))"))
    # Running sums of the second half's differences: up to and including each.
    rows = held(rows, differences)
    rows = held(rows, {"up": F.expr("transform(d2, (x, i) -> aggregate(slice(d2, 1, i + 1), 0D, (s, y) -> s + y))")})
    size = 2 * goals + 1
    below = f"if({goals} - (i - {goals}) - 1 < 0, 0D, up[least({size - 1}, {goals} - (i - {goals}) - 1)])"
    upto = f"up[least({size - 1}, {goals} - (i - {goals}))]"
    final = {"A": below, "D": f"{upto} - {below}", "H": f"up[{size - 1}] - {upto}"}
    half = {"A": f"i < {goals}", "D": f"i = {goals}", "H": f"i > {goals}"}
    cells = [F.struct(F.lit(x).alias("half"), F.lit(y).alias("full"), F.expr(f"aggregate(transform(d1, (p, i) -> if({half[x]}, p * ({final[y]}), 0D)), 0D, (s, v) -> s + v)").alias("p")) for x in "HDA" for y in "HDA"]
    rows = held(rows.select("match_id", "d1", "up"), {"cells": F.array(*cells)}).withColumn("total", F.expr("aggregate(cells, 0D, (s, x) -> s + x.p)"))
    return rows.select("match_id", "total", F.explode("cells").alias("c")).select("match_id", "c.half", "c.full", F.round(F.col("c.p") / F.col("total"), 6).alias("p"))


def half_time_marginals(joint: DataFrame) -> DataFrame:
    """Half-time and full-time outcomes by themselves, and the chance of each final outcome given the one at half-time."""
    by_half = joint.groupBy("match_id").agg(*[F.round(F.sum(F.when(F.col(c) == o, F.col("p")).otherwise(0.0)), 6).alias(f"{c}_{o.lower()}") for c in ("half", "full") for o in "HDA"], F.round(F.sum(F.when(F.expr("half = 'H' and full = 'H'"), F.col("p"))) / F.nullif(F.sum(F.when(F.expr("half = 'H'"), F.col("p"))), F.lit(0.0)), 4).alias("hold_lead"))
    return by_half
