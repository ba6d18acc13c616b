"""Single operators on small fixtures with known results."""

from datetime import datetime

from pyspark.sql import functions as F

from oddsloom.functions import text as fx
from oddsloom.operators import ledger, movement, resolve, rules, scores
from oddsloom.streaming import live


def one(frame):
    return frame.collect()[0]


def test_quarter_total_loses_or_wins_half(spark):
    rows = spark.createDataFrame([(1, "under", 2.25, 1.9, 1, 1, 1.0, "paper_candidate"), (2, "over", 2.25, 1.9, 1, 1, 1.0, "paper_candidate"), (3, "1-1", None, 6.0, 1, 1, 1.0, "paper_candidate"), (4, "away_handicap", 0.0, 1.9, 1, 1, 1.0, "paper_candidate")], "ticket_id int, selection string, line double, odds double, home_goals int, away_goals int, stake_units double, sizing_status string")
    found = {r["ticket_id"]: (r["settlement"], r["profit_units"]) for r in ledger.settle(rows).collect()}
    assert found == {1: ("half_win", 0.45), 2: ("half_loss", -0.5), 3: ("win", 5.0), 4: ("push", 0.0)}


def test_fair_line_of_a_strong_home_side(spark):
    matrix = scores.score_matrix(spark.createDataFrame([(1, 2.75, 0.82, -0.03)], "match_id int, lh double, la double, rho double"))
    assert abs(one(matrix.agg(F.sum("p").alias("s")))["s"] - 1) < 1e-12
    r = one(scores.fair_line(matrix))
    assert r["line"] == -1.75 and abs(r["fair_odds"] - 1.9172) < 1e-3


def test_truncation_of_small_rates(spark):
    rates = spark.createDataFrame([(1, 0.685, 1.741)], "match_id int, lh double, la double")
    assert abs(one(scores.truncation_audit(rates, 5))["retained"] - 0.9909992165) < 1e-8
    assert one(scores.truncation_audit(rates, 12))["pricing_allowed"]


def test_settlement_categories_add_up(spark):
    matrix = scores.score_matrix(spark.createDataFrame([(1, 1.4, 1.1, -0.05)], "match_id int, lh double, la double, rho double"))
    for kind in ("handicap", "over", "under"):
        for r in scores.settle_lines(matrix, [-0.75, 0.0, 2.25, 2.5], kind).collect():
            assert abs(sum(r[c] for c in scores.CATEGORIES.values()) - 1) < 5e-6


def test_change_capture_is_idempotent(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("a", 3, 2.0), ("a", 4, None), ("a", 5, None), ("b", 1, None)], "k string, t int, v double")
    once = movement.changed_rows(rows, ["k"], ["v"], ["t"])
    assert sorted((r["k"], r["t"]) for r in once.collect()) == [("a", 1), ("a", 3), ("a", 4), ("b", 1)]
    assert movement.changed_rows(once, ["k"], ["v"], ["t"]).count() == once.count()


def test_resolution_needs_a_margin(spark):
    at = datetime(2024, 1, 1, 12)
    left = spark.createDataFrame([(1, "northern rovers", "southern town", at), (2, "eastern city", "western united", at), (3, "no such club", "nor this", at)], "id int, home string, away string, kickoff timestamp")
    right = spark.createDataFrame([(11, "northern rovers", "southern town", at), (21, "eastern city", "western united", at), (22, "eastern city", "western united", at)], "id int, home string, away string, kickoff timestamp")
    found = {r["left_id"]: (r["right_id"], r["status"]) for r in resolve.resolve(left, right).collect()}
    assert found == {1: (11, "exact"), 2: (None, "ambiguous"), 3: (None, "none")}


def test_timers(spark):
    rows = spark.createDataFrame([(1, datetime(2024, 1, 1, 12))], "match_id int, kickoff timestamp")
    found = {r["stage"]: r["status"] for r in rules.due_checkpoints(rows, F.lit(datetime(2024, 1, 1, 11, 2))).collect()}
    assert found["T-60M"] == "on_time" and found["T-90M"] == "late" and found["T-30M"] == "planned"


def test_scalar_functions(spark):
    rows = spark.createDataFrame([("2.5/3", "2-1", "90+3", "Bearer abc.def", "É B")], "line string, score string, minute string, secret string, name string")
    r = one(rows.select(fx.canonical_line(F.col("line")).alias("line"), fx.parse_score(F.col("score")).alias("score"), fx.event_minute(F.col("minute")).alias("minute"), fx.redact(F.col("secret")).alias("secret"), fx.fold("name").alias("name"), fx.scaled_odds(F.lit("180000")).alias("odds")))
    assert r["line"] == "2.75" and tuple(r["score"]) == (2, 1) and r["minute"] == 90 and r["odds"] == 1.8
    assert r["secret"] == "bearer [redacted]" and r["name"] == "e b"


def test_stream_agrees_with_batch(spark, tmp_path):
    quotes = spark.createDataFrame([(i, i % 2, 0, "1x2", "", "home", 1.5 + (i // 4) * 0.1, datetime(2024, 1, 1, 0, i), i == 5) for i in range(12)], "event_id long, match_id long, provider long, market string, line string, outcome string, price double, ts timestamp, verified boolean")
    quotes.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(quotes.schema).parquet(f"{tmp_path}/in")
    q = live.latest_state(stream, ["match_id", "provider", "outcome"]).writeStream.outputMode("complete").format("memory").queryName("latest_live").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = live.latest_state(quotes, ["match_id", "provider", "outcome"])
    assert sorted(map(tuple, spark.table("latest_live").collect())) == sorted(map(tuple, batch.collect()))
    q = live.change_stream(stream).writeStream.outputMode("append").format("memory").queryName("changes_live").trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.table("changes_live").collect()
    assert len(found) == 6 and max(r["verified"] for r in found if r["match_id"] == 1) and not any(r["verified"] for r in found if r["match_id"] == 0)
    q = live.dedup(stream.union(stream), ["event_id", "price"]).writeStream.outputMode("append").format("memory").queryName("dedup_live").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("dedup_live").count() == 12


def test_entry_survives_without_subpackage(spark, tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "oddsloom", tmp_path / "oddsloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'consensus_devig' in e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries()) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def test_resolution_against_all_pairs(spark):
    """Every pair scored in plain Python; bounds must lose none of them."""
    import difflib
    import random

    r = random.Random(5)
    names = ["northern rovers", "southern town", "上海申花", "上海申花队", "eastern city", "easten city", "western united", "western utd", "ab", "abc", "real", "real madrid"]
    side = lambda k, n: [(k + i, r.choice(names), r.choice(names), datetime(2024, 1, 1, r.randrange(24), r.randrange(60))) for i in range(n)]
    a, b, kind = side(0, 60), side(1000, 80), "id int, home string, away string, kickoff timestamp"

    def alike(x, y):
        short, long = sorted((x, y), key=len)
        ratio = difflib.SequenceMatcher(None, x, y).ratio()
        if x == y:
            return 1.0
        if len(short) >= 2 and not any("a" <= c <= "z" for c in short) and (long.startswith(short) or long.endswith(short)):
            return 0.92
        return 0.88 if len(short) >= 4 and short in long else 0.92 * ratio if ratio >= 0.86 else 0.0

    wanted = {}
    for i, h, w, k in a:
        found = []
        for j, h2, w2, k2 in b:
            apart, sh, sa = abs((k - k2).total_seconds()) / 60, alike(h, h2), alike(w, w2)
            if apart <= 180 and sh >= 0.75 and sa >= 0.75:
                found.append((-round(0.4 * sh + 0.4 * sa + 0.2 * (1 - apart / 180), 6), j))
        found.sort()
        if not found:
            wanted[i] = (None, "none")
        else:
            best, rest = -found[0][0], -found[1][0] if len(found) > 1 else 0.0
            status = "low" if best < 0.82 else "ambiguous" if best - rest < 0.05 else "exact"
            wanted[i] = (found[0][1] if status == "exact" else None, status)
    got = {x["left_id"]: (x["right_id"], x["status"]) for x in resolve.resolve(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)).collect()}
    assert got == wanted and len({s for _, s in wanted.values()}) >= 3


def test_crowded_buckets_hand_on_alike_pairs_alone(spark, monkeypatch):
    """Names that end in long numbers: parts, borders of buckets and bounds lose no pair, and what can't be alike never becomes a row."""
    import difflib
    import random

    monkeypatch.setattr(resolve, "PART", 40)
    monkeypatch.setattr(resolve, "COLUMNS", 16)
    r = random.Random(7)
    name = lambda k: f"{k} {r.randrange(10**10)}"
    near = lambda x: x[: (k := r.randrange(len(x)))] + r.choice("0123456789") * r.randrange(2) + x[k + r.randrange(3) :]
    a = [(i, name("club"), name("team"), r.randrange(0, 2 * 32 * 180 * 60)) for i in range(300)]
    a += [(300, "上" * 70 + "海", "ab", 0), (301, "", "x", 0), (302, None, "x", 0), (303, "x", "x", None), (304, "club 12345", "𝒳𝒴𝒵 1", 0)]
    b = [(f"{i} {n}", near(h) if h else h, w if r.random() < 0.5 else near(w), t if t is None else t + r.randrange(-11000, 11001)) for i, h, w, t in a for n in range(2)]
    kind = lambda k, of: f"id{k} {of}, h{k} string, a{k} string, t{k} long"
    found = resolve.near_pairs(spark.createDataFrame(a, kind(1, "int")), spark.createDataFrame(b, kind(2, "string")), 180).collect()
    got = [(x["id1"], x["id2"], x["h1"], x["h2"], x["t1"] - x["t2"]) for x in found]

    def alike(x, y):
        return x in y or y in x or difflib.SequenceMatcher(None, x, y).ratio() >= resolve.LEAST_RATIO

    whole = [(x, y) for x in a for y in b if None not in (*x, *y) and abs(x[3] - y[3]) <= 10800]
    wanted = {(x[0], y[0]) for x, y in whole if alike(x[1], y[1]) and alike(x[2], y[2])}
    assert wanted <= {g[:2] for g in got} and len(got) == len({g[:2] for g in got}) and all(abs(g[4]) <= 10800 for g in got)
    assert len(wanted) > 300 and len(got) < len(wanted) + 0.01 * len(whole)


def test_values_of_the_survey(spark):
    """Known values: shares of a half, grades, windows of an attempt, lines, equivalents."""
    from oddsloom.operators import model, monitor, review

    rows = spark.createDataFrame([(0, 4), (2, 2), (3, 9), (0, 3)], "missing int, checks int")
    assert [x["g"]["grade"] for x in rows.select(review.evidence_grade(F.col("missing"), F.col("checks")).alias("g")).collect()] == ["A", "B", "C", "B"]
    late = spark.createDataFrame([(0.0,), (0.99,), (1.0,), (10.5,), (11.0,)], "x double")
    assert [x["a"] for x in late.select(monitor.dispatch_attempt(F.col("x")).alias("a")).collect()] == ["primary", "primary", None, "bounded_retry", None]
    assert list(rules.CHECKPOINTS.values()) == [480, 360, 240, 120, 90, 60, 30, 10]
    lines = spark.createDataFrame([("2.5/3", "2.75"), ("2.750", "2.75"), ("-0", "0"), (" Over  2 ", "over 2"), ("", "")], "x string, y string")
    assert all(x["x"] == x["y"] for x in lines.select(fx.canonical_line(F.col("x")).alias("x"), "y").collect())
    priced = {x["side"]: x for x in model.total_line_pricing(spark.createDataFrame([(1, 2.5, 2.25)], "id int, expected double, line double"), "id").collect()}
    assert abs(priced["over"]["win"] + priced["over"]["loss"] + priced["over"]["push"] - 1) < 3e-6 and priced["over"]["win"] == priced["under"]["loss"]


def test_ball_signs_of_handicaps(spark):
    from oddsloom.functions import parse

    texts = ["球半", "受球半", "一球", "两球半", "1.5球", "平手", "x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in rows.select(parse.handicap_number(F.col("t"))).collect()] == [-0.5, 0.5, -1.0, None, 1.5, 0.0, None]
    assert [r[0] for r in rows.select(parse.handicap_number(F.col("t"), as_written=True)).collect()] == [-1.5, 1.5, -1.0, -2.5, 1.5, 0.0, None]
