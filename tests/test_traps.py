"""Trap rules on small panels."""


from oddsloom.operators import traps

PANEL = "match_id int, company int, open_home double, home double, open_draw double, draw double, open_line double, line double, open_water double, water double"


def told(spark, panel, theory=None, shin=(0.4, 0.3, 0.3), mean=2.0, tiers=None, growth=None):
    metrics = traps.panel_metrics(spark.createDataFrame([(1, *p) for p in panel], PANEL))
    given = spark.createDataFrame([(1, theory, shin, mean, tiers or [], growth or [])], "match_id int, theory double, shin struct<home: double, draw: double, away: double>, mean_current double, tiers array<double>, growth array<double>")
    registry = spark.createDataFrame([(n, "A") for n in [*traps.trap_rules(), *traps.NOT_EVALUABLE, "X99"]], "rule string, category string")
    results = traps.evaluated(metrics.join(given, "match_id"), registry)
    return {r["rule"]: (r["status"], r["reason"]) for r in results.collect()}, traps.trap_summary(results).first()


LEADER = (1055, 2.0, 1.8, 3.5, 3.0, -0.5, -0.25, 0.9, 0.9)


def test_rules_on_a_full_core(spark):
    found, summary = told(spark, [LEADER, (3, 2.0, 2.3, 3.4, 3.4, -1.5, -1.5, 0.8, 1.0), (5, 2.0, 2.0, 3.4, 3.4, -1.0, -1.0, 0.8, 0.99)], theory=2.0, shin=(0.8, 0.31, 0.2), mean=1.2, tiers=[0.4, 0.1, 0.0], growth=[None, 2.5])
    hit = {r for r, (s, _) in found.items() if s == "triggered"}
    # Lines now .25, 1.5, 1: all three apart; the leader's price falls while its line gets shallower.
    assert hit == {"EA01", "EA04", "EA09", "EA14", "U04", "U08", "U09", "U16", "U18", "U19", "U22", "U23", "U26", "MBI17"}
    assert found["U25"] == ("not_evaluable", "fields_missing") and found["EA02"] == ("not_evaluable", "company_ids_unconfirmed") and found["X99"] == ("not_evaluable", "no_reliable_judgement")
    assert found["EA12"][0] == "not_triggered" and found["MBI16"][0] == "not_triggered" and found["U06"][0] == "not_triggered"
    assert (summary["triggered"], summary["calculation_status"], summary["evaluated"]) == (14, "degraded", 22)


def test_what_is_missing_is_not_evaluable(spark):
    found, _ = told(spark, [(99, None, None, None, None, None, None, None, None)])
    evaluable = {r for r, (s, _) in found.items() if s != "not_evaluable"}
    assert evaluable == {"U18", "U19", "U20", "U26"}


def test_waters_that_move_together(spark):
    core = [(c, 2.0, 2.0, 3.0, 3.0, -1.0, -1.0, 0.8, w) for c, w in ((1055, 1.0), (3, 0.96), (5, 0.951))]
    assert told(spark, core)[0]["U25"][0] == "triggered"
    assert told(spark, [*core[:2], (5, 2.0, 2.0, 3.0, 3.0, -1.0, -1.0, 1.0, 0.8)])[0]["U25"][0] == "not_triggered"


def test_metrics(spark):
    m = traps.panel_metrics(spark.createDataFrame([(1, *LEADER), (1, 280, 2.0, 0.0, 3.0, 3.0, 1.0, 1.0, 0.9, 1.1)], PANEL)).first()
    assert abs(m["home_change"] + 0.1) < 1e-12 and m["line_change"] == -0.25 and m["mean_home"] == 1.8 and m["sharp_asian_gap"] == 0.75 and m["outliers"] == 0
    assert m["core_line_spread"] is None
