"""The automatic model on known inputs, and its grid search against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from oddsloom.operators import automodel, model, scores

FORMS = ("home_home", "away_away", "home_overall", "away_overall")
SHAPE = ", ".join(f"{f} {automodel.FORM}" for f in FORMS) + f", market struct<home: double, draw: double, away: double>, market_total double, market_handicap double, calibration {automodel.CALIBRATION}, high_tail boolean, match_id int"


def devigged(*prices):
    inverse = [1 / p for p in prices]
    return tuple(x / sum(inverse) for x in inverse)


def built(spark, *rows):
    return [r.asDict(True) for r in automodel.automatic_model(spark.createDataFrame(rows, SHAPE)).orderBy("match_id").collect()]


BASE = ((10.0, 17.0, 10.0), (10.0, 10.0, 17.0), (10.0, 15.0, 12.0), (10.0, 12.0, 15.0), devigged(1.9, 3.4, 4.2), 2.5, None)


def test_a_whole_model(spark):
    first = ((10.0, 19.0, 11.0), (10.0, 16.0, 13.0), (10.0, 12.0, 13.0), (10.0, 22.0, 9.0), tuple((a + b) / 2 for a, b in zip(devigged(4.5, 4.0, 1.7), devigged(4.2, 3.8, 1.72))), 2.625, None, None, False, 1)
    (m,) = built(spark, first)
    assert m["has_model"] and m["lambda_home"] > 0 and m["lambda_away"] > 0
    assert abs(sum(m["outcomes"].values()) - 1) < 1e-12 and abs(sum(c["p"] for c in m["cells"]) - 1) < 1e-12 and len(m["cells"]) == 169
    assert m["leader"] == "away" == m["market_leader"] and 1 <= len(m["candidates"]) <= 8
    assert abs(m["form_home"] - (2 * (1.9 + 1.3) / 2 + (1.2 + 0.9) / 2) / 3) < 1e-12
    peak = max(m["cells"], key=lambda c: c["p"])
    assert m["formal_score"] == f"{peak['h']}-{peak['a']}"


def test_no_model_without_form_or_market(spark):
    no_form = (None, None, None, None, devigged(2, 3, 4), 2.5, None, None, False, 1)
    none_played = ((0.0, 1.0, 1.0), None, (0.0, 1.0, 1.0), (0.0, 1.0, 1.0), devigged(2, 3, 4), 2.5, None, None, False, 2)
    no_market = (*BASE[:4], None, 2.5, -1.0, None, False, 3)
    for m in built(spark, no_form, none_played, no_market):
        assert not m["has_model"] and m["formal_score"] is None and m["lambda_home"] is None and m["candidates"] is None and m["confidence"] is None


def test_whole_form_stands_in_for_missing_venues(spark):
    (m,) = built(spark, ((0.0, 9.0, 9.0), None, (5.0, 7.0, 6.0), (5.0, 9.0, 4.0), (0.30, 0.27, 0.43), None, None, None, False, 1))
    assert m["has_model"] and abs(m["form_home"] - (7 / 5 + 4 / 5) / 2) < 1e-12 and m["target_total"] == m["form_total"]


def test_a_validated_calibration_moves_total_and_direction(spark):
    approved = (True, automodel.FAMILY, 0.3, True, (-0.2, 0.1, 0.2), True, 0.5, False, 0.1)
    rows = [(*BASE, None, False, 1), (*BASE, approved, False, 2), (*BASE, (True, "older", *approved[2:]), False, 3), (*BASE, (False, *approved[1:]), False, 4), (*BASE, (*approved[:3], False, approved[4], False, 0.5, True, 0.5), False, 5)]
    plain, moved, other, idle, spread = built(spark, *rows)
    assert abs(moved["total"] - plain["total"] - 0.15) < 1e-12 and moved["outcomes"]["home"] < plain["outcomes"]["home"]
    assert moved["direction_applied"] and moved["total_goals_applied"] and not moved["dispersion_applied"]
    assert other["cells"] == plain["cells"] == idle["cells"] and not other["compatible"] and other["strength"] == 0
    # A tail weight counts to .15 at most, and spreads the goals without moving the rates.
    assert spread["lambda_home"] == plain["lambda_home"] and spread["totals"][6] > plain["totals"][6] and spread["totals"][0] > plain["totals"][0]
    strong = (True, automodel.FAMILY, 5.0, True, (-0.2, 0.1, 0.2), True, 0.5, True, 9.0)
    (most,) = built(spark, (*BASE, strong, False, 1))
    assert most["strength"] == automodel.MOST_STRENGTH and abs(most["total"] - plain["total"] - 0.3) < 1e-12


CELLS = "array<struct<h: int, a: int, p: double>>"


def test_the_peak_stays_formal_and_the_scenario_is_its_challenger(spark):
    cells = [(1, 1, 0.12), (2, 1, 0.11), (1, 0, 0.08), (0, 1, 0.06), (0, 0, 0.05)]
    totals = [0.0, 0.0, 0.30, 0.40, 0.0, 0.0, 0.0]
    shape = f"match_id int, cells {CELLS}, outcomes struct<home: double, draw: double, away: double>, totals array<double>, btts_yes double, total double, market struct<home: double, draw: double, away: double>, market_total double, market_handicap double, high_tail boolean"
    rows = [(1, cells, (0.55, 0.25, 0.20), totals, 0.65, 2.8, (0.58, 0.24, 0.18), 3.0, -1.0, False), (2, cells, (0.55, 0.25, 0.20), totals, 0.65, 2.8, None, None, None, True)]
    one, two = (r.asDict(True) for r in automodel.with_scenario(spark.createDataFrame(rows, shape)).orderBy("match_id").collect())
    assert one["formal_score"] == "1-1" and one["challenger_score"] == "2-1"
    # 0-0 has less than 42 % of the peak.
    assert [(c["h"], c["a"]) for c in one["candidates"]][0] == (2, 1) and len(one["candidates"]) == 4
    best = one["candidates"][0]["components"]
    wanted = {"matrix": 0.55 * 0.11 / 0.12, "model": 0.18, "total": 0.14, "btts": 0.08, "market": 0.10, "handicap": 0.10, "script": 0.0}
    assert all(abs(best[k] - v) < 1e-12 for k, v in wanted.items())
    assert [c["decision"] for c in one["candidates"]].count("matrix_selected") == 1 and one["confidence"] == "high"
    # Without a market its two components are nothing; with a risk of late swings high scores gain and low ones lose.
    parts = {(c["h"], c["a"]): c["components"] for c in two["candidates"]}
    assert all(p["market"] == p["handicap"] == 0 for p in parts.values()) and parts[2, 1]["script"] == 0.04 and parts[1, 0]["script"] == -0.03 and parts[1, 1]["script"] == 0


def test_offers_settle_by_halves(spark):
    chances = {(1, 0): 0.5, (1, 1): 0.3, (0, 2): 0.2}
    cells = [(h, a, chances.get((h, a), 0.0)) for h in range(13) for a in range(13)]
    models = spark.createDataFrame([(1, cells), (2, None)], f"match_id int, cells {CELLS}")
    offers = [(1, "handicap", "home", -0.75, 0.9), (1, "handicap", "away", 0.0, None), (1, "total", "over", 1.25, 1.0), (1, "total", "under", 2.0, 0.5), (2, "total", "under", 2.0, 0.5)]
    found = {(r["family"], r["side"]): r for r in automodel.offer_audit(models, spark.createDataFrame(offers, "match_id int, family string, side string, line double, water double")).collect()}
    assert len(found) == 4
    # -0.75 is -0.5 and -1: by one goal it wins by half.
    home = found["handicap", "home"]
    assert (home["win"], home["push"], home["ev"]) == (0.25, 0.25, round(0.25 * 0.9 - 0.5, 6))
    assert found["handicap", "away"]["ev"] is None and (found["handicap", "away"]["win"], found["handicap", "away"]["push"]) == (0.2, 0.3)
    assert (found["total", "over"]["win"], found["total", "over"]["push"]) == (0.5, 0.25)
    assert (found["total", "under"]["win"], found["total", "under"]["push"]) == (0.5, 0.5)


@pytest.mark.parametrize("target", [(0.45, 0.25, 0.30), (0.98, 0.01, 0.01), (0.0, 0.0, 1.0), (0.1, 0.8, 0.1), (0.5, 0.0, 0.5), (1 / 3, 1 / 3, 1 / 3)])
def test_share_by_bisection_equals_all_shares(spark, target):
    totals = [0.2, 0.9, 1.75, 2.6, 3.5, 4.8]
    rates = spark.createDataFrame([(i, t / 2, t / 2) for i, t in enumerate(totals)], "match_id int, lh double, la double")
    targets = rates.select("match_id", *[F.lit(x).alias(f"t_{n}") for n, x in zip(automodel.OUTCOMES, target)])
    found = {r["match_id"]: r["share"] for r in model.share_search(rates, targets).collect()}
    poisson = lambda rate: [math.exp(-rate) * rate**g / math.factorial(g) for g in range(13)]
    for i, t in enumerate(totals):
        best = None
        for k in range(151, 850):
            h, a = poisson(t * k / 1000), poisson(t * (1 - k / 1000))
            mass = sum(h) * sum(a)
            win, draw = (sum(x * y for p, x in enumerate(h) for q, y in enumerate(a) if test(p, q)) / mass for test in (int.__gt__, int.__eq__))
            error = round((win - target[0]) ** 2 + (draw - target[1]) ** 2 + (1 - win - draw - target[2]) ** 2, 9)
            best = min(best or (error, k), (error, k))
        assert found[i] == best[1] / 1000, (t, target)


def test_lines_from_running_sums_equal_a_grid(spark):
    rates = spark.createDataFrame([(1, 1.4, 1.1, -0.05), (2, 0.3, 2.9, 0.1), (3, 2.75, 0.82, -0.03)], "match_id int, lh double, la double, rho double")
    matrix, lines = scores.score_matrix(rates), [x / 4 for x in range(-12, 21)]
    for kind in ("handicap", "over", "under"):
        given = [x for x in lines if kind == "handicap" or x > 0]
        found, wanted = (sorted(map(tuple, f.select("match_id", "line", "full_win", "half_win", "push", "half_loss", "full_loss", "net_at_2").collect())) for f in (model.settle_lines(rates, given, kind), scores.settle_lines(matrix, given, kind)))
        assert all(abs(x - y) < 2e-6 for f, w in zip(found, wanted) for x, y in zip(f, w))
    assert sorted(map(tuple, model.fair_line(rates).collect())) == sorted(map(tuple, scores.fair_line(matrix).collect()))


def test_outcomes_equal_but_for_their_last_bit_go_by_order(spark):
    rows = spark.createDataFrame([(0.4, 0.2, 0.4 + 1e-16), (0.3, 0.35, 0.35 + 6e-17), (0.2, 0.3, 0.5)], "home double, draw double, away double").select(F.struct("home", "draw", "away").alias("o"))
    assert [r[0] for r in rows.select(F.expr(automodel.first_of("o"))).collect()] == ["home", "draw", "away"]


def test_half_places_of_candidates_go_up(spark):
    parts = ", ".join(f"'{n}', {v}D" for n, v in zip(automodel.WEIGHTS, (0.49334999999999996, 0.18, 0.14, 0.08, 0.1, 0.0143, 0.0)))
    rows = spark.sql(f"select 1 as match_id, array(named_struct('place', 1, 'h', 2, 'a', 1, 'p', 0.1D, 'utility', 0.5111585D, 'components', named_struct({parts}), 'decision', 'rejected')) as candidates")
    found = automodel.candidate_rows(rows).first()
    assert (found["matrix"], found["utility"]) == (0.4934, 0.511159)


def test_line_sums_against_plain_sums(spark):
    """Running sums of whole grids in batches; a match needs its cells only, no markets or candidates."""
    r = random.Random(6)
    grids = [[r.random() for _ in range(169)] for _ in range(3)]
    cells = [(i, [(k // 13, k % 13, p) for k, p in enumerate(g)]) for i, g in enumerate(grids)]
    frame = spark.createDataFrame(cells, "match_id int, cells array<struct<h: int, a: int, p: double>>").repartition(2)
    for row in automodel.line_sums(frame).collect():
        g = grids[row["match_id"]]
        assert row["upto_difference"] == pytest.approx([sum(p for k, p in enumerate(g) if k // 13 - k % 13 < d) for d in range(-12, 14)])
        assert row["upto_total"] == pytest.approx([sum(p for k, p in enumerate(g) if k // 13 + k % 13 < n) for n in range(26)])
    assert automodel.line_sums(frame.where("false")).count() == 0
