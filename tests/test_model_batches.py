"""Pricing in batches against plain loops over every cell, and whether small tables are dealt to many tasks."""

import math

import pytest

from oddsloom.operators import model, scores
from oddsloom.plans import catalog, catalog_model, catalog_more  # noqa: F401
from oddsloom.plans.adapters import rates

SF = "/root/testdata/sf0.001"
MATCHES = [(1, 1.4, 1.1, -0.05), (2, 2.75, 0.82, -0.12), (3, 0.4, 0.3, 0.0), (4, 1.0, 1.0, -0.03), (5, None, 1.0, 0.0)]


def given(spark):
    return spark.createDataFrame(MATCHES, "match_id long, lh double, la double, rho double").withColumns({"handicap": scores.F.lit(-0.75), "total_line": scores.F.lit(2.25)})


def grid(lh, la, rho):
    tau = {(0, 0): 1 - lh * la * rho, (0, 1): 1 + lh * rho, (1, 0): 1 + la * rho, (1, 1): 1 - rho}
    poisson = lambda x, g: math.exp(-x) * x**g / math.factorial(g)
    cells = {(h, a): max(0.0, poisson(lh, h) * poisson(la, a) * tau.get((h, a), 1.0)) for h in range(13) for a in range(13)}
    return {k: v / sum(cells.values()) for k, v in cells.items()}


def settled(p, margin, line):
    odd = round(line * 4) % 2 != 0
    parts = [line - 0.25, line + 0.25] if odd else [line, line]
    sign = lambda x: (x > 1e-9) - (x < -1e-9)
    factors = {k: sum(sign(margin(*k, q)) for q in parts) / 2 for k in p}
    return sum(p[k] * max(f, 0) for k, f in factors.items()), sum(p[k] * max(-f, 0) for k, f in factors.items())


def test_equivalents_and_closest_total_by_every_cell(spark):
    found = {(r["match_id"], r["side"]): r for r in model.win_push_loss(given(spark)).collect()}
    nearest = {r["match_id"]: r for r in model.closest_total(given(spark)).collect()}
    tops = {}
    for r in model.top_scores(given(spark)).collect():
        tops.setdefault(r["match_id"], []).append((r["place"], r["h"], r["a"]))
    assert set(nearest) == set(tops) == {1, 2, 3, 4} and found[5, "home"]["win"] is None
    for match, *three in MATCHES[:4]:
        p = grid(*three)
        for side, margin, line in (("home", lambda h, a, q: h - a + q, -0.75), ("away", lambda h, a, q: a - h - q, -0.75), ("over", lambda h, a, q: h + a - q, 2.25), ("under", lambda h, a, q: q - h - a, 2.25)):
            win, loss = settled(p, margin, line)
            r = found[match, side]
            assert (r["win"], r["loss"]) == (pytest.approx(win, abs=1e-6), pytest.approx(loss, abs=1e-6)) and r["fair_odds"] == pytest.approx(1 + loss / win, abs=1e-4)
        priced = [(settled(p, lambda h, a, q: h + a - q, n / 4), n / 4) for n in range(2, 29)]
        best = min((round(abs(loss / win - 1), 9), round(abs(line - three[0] - three[1]), 9), line) for (win, loss), line in priced if win > 0)
        assert nearest[match]["line"] == best[2]
        assert sorted(tops[match]) == [(n + 1, *k) for n, (_, k) in enumerate(sorted((-round(v, 9), k) for k, v in p.items())[:10])]


def test_shock_rows_hold_the_likeliest_score(spark):
    rows = {(r["match_id"], r["scenario"]): r for r in model.sensitivity(given(spark)).collect()}
    assert len(rows) == 25 and rows[5, "base"]["top_score"] is None
    for match, *three in MATCHES[:4]:
        p = grid(*three)
        h, a = min((-round(v, 9), k) for k, v in p.items())[1]
        assert rows[match, "base"]["top_score"] == f"{h}-{a}" and rows[match, "base"]["p_home"] == pytest.approx(sum(v for (x, y), v in p.items() if x > y), abs=1e-6)


def test_rates_are_dealt_over_many_tasks(spark):
    assert rates(spark, SF).rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["score_top10", "dispersion_mixture", "reweighted_outcomes", "htft_marginals"])
def test_a_match_is_moved_once(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
