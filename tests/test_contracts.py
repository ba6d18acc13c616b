"""Contracts out of reports."""

from oddsloom.operators import contracts

SHAPE = f"report_id int, primary string, audits {contracts.AUDIT}, official struct<home: double, draw: double, away: double>, probabilities struct<home: double, draw: double, away: double>"


def test_first_picks(spark):
    audits = [("SPF主胜", None, 0.5, 0.1, 0.4, 0.0), ("SPF主胜 二", 2.0, 0.5, 0.0, 0.425, -0.15), ("公司 大2.5", 1.9, 0.55, 0.045, 0.475, -0.1), ("公司 小2.25", 0.0, 0.4, 0.1, 0.3, 0.0)]
    official, chances = (2.2, 3.1, None), (0.5, 0.3, 0.2)
    texts = ["90分钟主胜", "大 2.50", "小2.25", "平局", "客胜", "让球 主队", "双方进球", None, "小3 而非主胜"]
    rows = [(i, t, audits, official, chances) for i, t in enumerate(texts)]
    found = [tuple(r)[1:] for r in contracts.primary_contracts(spark.createDataFrame(rows, SHAPE)).orderBy("report_id").collect()]
    # The first audit row with odds counts; zero is no price.
    assert found[0] == ("1x2", "home", None, 2.0, 0.5, 0.0, -0.15, "SPF主胜 二")
    assert found[1] == ("total", "over", 2.5, 1.9, 0.55, 0.045, -0.1, "公司 大2.5")
    assert found[2] == ("total", "under", 2.25, None, None, None, None, None)
    assert found[3][:5] == ("1x2", "draw", None, 3.1, 0.3) and abs(found[3][5] + 0.07) < 1e-12 and found[3][7] == "official_spf"
    assert found[4] == ("1x2", "away", None, None, 0.2, None, None, None)
    assert found[5][:2] == ("handicap", "unresolved_handicap") and found[6][:2] == ("other", None) == found[7][:2]
    assert found[8][:3] == ("total", "under", 3.0)


def test_score_picks(spark):
    rows = [(1, "唯一比分 2：1", [("1-1", 0.1), ("2-1", 0.08), ("2-1", 0.5)]), (2, "0-0", [("1-1", 0.1)]), (3, "none", []), (4, None, None)]
    found = contracts.score_contracts(spark.createDataFrame(rows, "report_id int, score string, scores array<struct<score: string, probability: double>>")).collect()
    assert sorted(map(tuple, found)) == [(1, "2-1", 0.08), (2, "0-0", None)]
