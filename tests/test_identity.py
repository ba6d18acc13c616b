"""Names, alias groups, bindings, events of a pair, alike pairs."""

import difflib
import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oddsloom.operators import identity


def test_names_are_cleaned_before_they_are_folded(spark):
    given = ["Man&nbsp;Utd (U21)", "<b>Real</b> Madrid（女）", "ＦＣ Köln[中]", None, "  x &amp; y "]
    found = [r["c"] for r in spark.createDataFrame([(i, n) for i, n in enumerate(given)], "i int, n string").orderBy("i").select(identity.clean_name("n").alias("c")).collect()]
    assert found == ["Man Utd", "Real Madrid", "FC Köln", "", "x & y"]


def test_aliases_form_groups_over_chains(spark):
    registry = [("Alpha FC", ["Alpha United"]), ("alpha united", ["The Alphas"]), ("Beta", None), ("Gamma Club", ["THE ALPHAS!", ""]), ("Delta", ["Beta SK"])]
    groups = identity.alias_groups(spark.createDataFrame(registry, "canonical string, aliases array<string>"))
    found = {r["name"]: r["canonical"] for r in groups.collect()}
    chain = {found[n] for n in ("alphafc", "alphaunited", "thealphas", "gammaclub", "alpha", "gamma")}
    assert chain == {"alphafc"} and found["beta"] == found["delta"] == found["betask"] == "beta"
    rows = spark.createDataFrame([(1, "The Alphas"), (2, "Gamma FC"), (3, "Unknown"), (4, "Beta (U19)"), (5, None)], "id int, home string")
    named = {r["id"]: r["team"] for r in identity.canonical_names(rows, "home", groups, "team").collect()}
    assert named == {1: "alphafc", 2: "alphafc", 3: "unknown", 4: "beta", 5: ""}


def test_groups_equal_a_search(spark):
    r = random.Random(1)
    links = [(f"n{r.randrange(120):03}", f"n{r.randrange(120):03}") for _ in range(90)] + [(f"z{k:03}", f"z{k + 1:03}") for k in range(60)]
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def reach(x):
        seen, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return min(seen)

    found = {x["name"]: x["label"] for x in identity.linked_groups(spark.createDataFrame(links, "a string, b string")).collect()}
    assert found == {n: reach(n) for n in near}


def test_bindings_keep_the_newest(spark):
    shape = "match_key string, provider string, provider_id string, confidence double, verification string, home string, away string, verified_at timestamp"
    at = lambda d: datetime(2024, 1, d)
    old = spark.createDataFrame([("m1", "p", "1", 0.9, "name", "A", "B", at(1)), ("m2", "p", "2", 0.8, "name", "C", "D", at(1))], shape)
    new = spark.createDataFrame([("m1", "p", "7", 0.95, "page", "a", "b", at(2)), ("m1", "q", "8", 0.7, "page", "x", "y", at(3)), ("m2", "p", "3", 0.5, "late", "c", "d", datetime(2023, 1, 1))], shape)
    found = {(r["match_key"], r["provider"]): (r["provider_id"], r["home"]) for r in identity.upsert_bindings(old, new).collect()}
    assert found == {("m1", "p"): ("7", "A"), ("m1", "q"): ("8", "A"), ("m2", "p"): ("2", "c")}
    fixtures = spark.createDataFrame([("m1",), ("m3",)], "match_key string")
    assert {r["match_key"]: r["provider_id"] for r in identity.prebound(fixtures, identity.upsert_bindings(old, new), "p", 0.9).collect()} == {"m1": "7", "m3": None}


def test_every_alias_of_a_fixture(spark):
    rows = spark.createDataFrame([("FB1", 12, "s9", "H", "A"), ("FB2", None, "", None, "A")], "key string, match_id int, shuju_id string, home string, away string")
    found = {k: {r["alias"] for r in identity.identity_aliases(rows, "key").collect() if r["key"] == k} for k in ("FB1", "FB2")}
    assert found == {"FB1": {"FB1", "12", "s9", "shuju:s9", "H|A", "H vs A"}, "FB2": {"FB2"}}


def test_events_of_an_exact_pair(spark):
    t = datetime(2024, 6, 1, 18)
    markets = [
        ("g1", "Spain vs. Italy", t, 5.0), ("g1", "Spain vs. Italy - More Markets", t, 1.0), ("g2", "Spain v Italy", t + timedelta(hours=18), 50.0), ("g3", "Spain vs Italy", t + timedelta(hours=19), 500.0), ("g3", "Spain vs Italy", t + timedelta(hours=19), 500.0), ("g3", "SPAIN VS ITALY", t + timedelta(hours=19), 1.0),
        ("g4", "Italy vs Spain", t, 9.0), ("g5", "Spain vs Italy B", None, 1.0), ("g6", "Spain vs Italian", t, 1.0), ("", "Spain vs Italy", t, 1.0), ("g7", "France vs Peru", t, 2.0), ("g8", "France vs Peru", t, 2.0),
    ]
    frame = spark.createDataFrame(markets, "group_id string, title string, at timestamp, liquidity double")
    targets = spark.createDataFrame([(1, "Spain", "Italy", t), (2, "Spain", "Italy", None), (3, "France", "Peru", t), (4, "Chile", "Peru", t)], "id int, home string, away string, kickoff timestamp")
    found = {r["id"]: (r["status"], r["group_id"], r["markets"], r["groups"]) for r in identity.events_of_pairs(targets, frame).collect()}
    assert found == {1: ("exact_event", "g1", 2, 3), 2: ("exact_event", "g3", 3, 4), 3: ("exact_event", "g7", 1, 2), 4: ("no_exact_event", None, None, 0)}


def test_alike_pairs_equal_all_pairs(spark):
    r = random.Random(9)
    words = ["north", "rovers", "city", "united", "al", "real", "sport", "inter", "st", "olympic", "x", "ham"]
    name = lambda: "".join(r.choice(words) for _ in range(r.randrange(1, 4)))
    blur = lambda s: "".join(c for c in s if r.random() > 0.1) or "x"
    right = [(i, name(), name()) for i in range(60)]
    left = [(100 + i, *((blur(h), blur(a)) if i % 3 else (h, a))) for i, (_, h, a) in enumerate(right)] + [(300 + i, name(), name()) for i in range(40)]
    shape = "id int, home string, away string"
    found = {x["left_id"]: (x["right_id"], x["score"], x["basis"]) for x in identity.alike_pairs(spark.createDataFrame(left, shape), spark.createDataFrame(right, shape)).collect()}
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    for i, h, a in left:
        same = [j for j, x, y in right if (x, y) == (h, a)]
        scores = [(-round((ratio(h, x) + ratio(a, y)) / 2, 9), j) for j, x, y in right if (ratio(h, x) + ratio(a, y)) / 2 >= 0.72]
        if same:
            assert found[i] == (min(same), 1.0, "exact")
        elif scores:
            assert found[i] == (min(scores)[1], round(-min(scores)[0], 6), "alike")
        else:
            assert found[i] == (None, None, "none")
    assert {"exact", "alike", "none"} == {v[2] for v in found.values()}
    names = [spark.createDataFrame([(n,) for side in (left, right)[k : k + 1] for _, h, a in side for n in (h, a)], "name string") for k in (0, 1)]
    got = {(x["l"], x["r"]) for x in identity.alike_names(*names).collect()}
    every = [{n for _, h, a in side for n in (h, a)} for side in (left, right)]
    assert got == {(x, y) for x in every[0] for y in every[1] if ratio(x, y) >= 0.72}
    assert spark.createDataFrame([], shape).select(F.count("*")).first()[0] == 0


def test_events_of_a_crowded_pair(spark):
    """Many targets and many markets without a time: counted once for the pair, never target by target."""
    n = 30_000
    t = datetime(2024, 6, 1, 18)
    targets = spark.range(n).selectExpr("id", "'Spain' as home", "'Italy' as away", f"if(id % 100 = 0, null, timestamp'{t}' + make_interval(0, 0, 0, 0, int(id % 50))) as kickoff")
    markets = spark.range(n).selectExpr("concat('g', id % 3) as group_id", "'Spain vs Italy' as title", "cast(null as timestamp) as at", "1D as liquidity")
    near = spark.createDataFrame([("g1", "Spain v Italy", t, 1.0), ("g9", "SPAIN vs Italy - x", t, 7.0)], "group_id string, title string, at timestamp, liquidity double")
    for r in identity.events_of_pairs(targets, markets.union(near)).where("id < 600").collect():
        if r["id"] % 100 == 0:
            assert tuple(r)[2:] == ("g1", n // 3 + 1, n / 3 + 1, 4, None)
        elif r["id"] % 50 <= 18:
            assert tuple(r)[2:] == ("g1", n // 3 + 1, n / 3 + 1, 4, r["id"] % 50)
        else:
            assert tuple(r)[2:] == ("g0", n // 3, n / 3, 3, None)


@pytest.mark.parametrize("sent", [identity.SENT, 0])
def test_events_equal_all_pairs(spark, monkeypatch, sent):
    """Against all targets and markets compared: equal kickoffs and targets, times at the edges of slots, markets without a time, and pairs that no market names."""
    monkeypatch.setattr(identity, "SENT", sent)
    if not sent:
        monkeypatch.setattr(identity, "COMPARED", 5)
        monkeypatch.setattr(identity, "RETURNED", 3)
    r = random.Random(11)
    width, base = 18 * 3600, 4 * 18 * 3600 * 6600
    # Many stand at a slot's bound, or a width away from one.
    when = lambda: None if r.random() < 0.15 else base + r.choice([-2, -1, 0, 1, 4]) * width + r.choice([-1, 0, 1, r.randrange(-width, width)])
    names = ["Spain", "Italy B", "Perú", "Oman"]
    targets = [(i, r.choice([*names, "", None]), r.choice(names), when()) for i in range(300)]
    markets = [(r.choice([f"g{k}" for k in range(12)] + ["", None]), r.choice(["{} vs {}", "{} V. {}", "{} vs {} - more", "x {} vs {}", "{} or {}"]).format(r.choice(names[:3]), r.choice(names)), when(), r.choice([None, 0.5, 1.25, 3.0])) for _ in range(900)]
    shape = [("id int, home string, away string, kickoff long", "kickoff", targets), ("group_id string, title string, at long, liquidity double", "at", markets)]
    frames = [spark.createDataFrame(rows, columns).withColumn(c, F.timestamp_seconds(c)) for columns, c, rows in shape]
    found = {x["id"]: tuple(x)[1:] for x in identity.events_of_pairs(*frames).collect()}
    plain = lambda x: x.replace("ú", "u").lower()
    assert len(found) == 300
    for i, home, away, t1 in targets:
        groups = {}
        for group, title, t2, liquidity in markets:
            folded = plain(title).replace("v. ", "v ")
            fits = home and any(f"{folded} ".startswith(f"{plain(home)} {by} {plain(away)} ") for by in ("vs", "v"))
            if group and fits and (t1 is None or t2 is None or abs(t1 - t2) <= width):
                n, total, apart = groups.get(group, (0, 0.0, None))
                gap = None if t1 is None or t2 is None else abs(t1 - t2)
                groups[group] = (n + 1, total + (liquidity or 0.0), gap if apart is None else apart if gap is None else min(apart, gap))
        if groups:
            group = min(groups, key=lambda g: (-groups[g][0], -groups[g][1], g))
            n, total, apart = groups[group]
            assert found[i] == ("exact_event", group, n, total, len(groups), None if apart is None else round(apart / 3600, 4)), i
        else:
            assert found[i] == ("no_exact_event", None, None, None, 0, None), i


def test_sums_are_rounded_as_spark_rounds(spark):
    r = random.Random(5)
    given = [0.0, 0.1 + 0.2, 2.0000005, -2.0000005, 1.0000015, 1e9 + 0.0000005, 12345678901.25, 1e15 + 0.5, 1e300, float("inf"), *(r.randrange(10**9) / 1e7 for _ in range(500))]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x double").select("i", F.round("x", 6).alias("y")).orderBy("i").collect()
    assert identity._rounded(np.array(given)).tolist() == [x["y"] for x in rows]


def test_near_markets_of_a_slot_in_many_batches():
    """A pair's slot that goes over batches is counted as one, and slots of one batch apart."""
    shape = pa.schema([("pair", pa.int64()), ("slot", pa.int64()), ("group_id", pa.string()), ("t", pa.int64()), ("markets", pa.int64()), ("liquidity", pa.float64()), ("m0", pa.int64()), ("l0", pa.float64()), ("id", pa.int64())])
    rows = []
    for pair in range(3):
        rows += [(pair, 0, None, t, None, None, None, None, 10 * pair + t) for t in (1, 1, 5)]
        rows += [(pair, 0, group, t, 1, 2.0, m0, l0, None) for group, m0, l0 in (("a", None, None), ("b", 2, 1.0)) for t in range(7)]
    table = pa.Table.from_pylist([dict(zip(shape.names, row)) for row in rows], schema=shape)
    wanted = {(10 * pair + t, pair, near + 2, 0, 1, 2.0 * near + 1, "b") for pair in range(3) for t, near in ((1, 4), (5, 4))}
    for size in (1, 2, 7, 1000):
        found = [tuple(x.values()) for batch in identity._met_near(2)(iter(table.to_batches(max_chunksize=size))) for x in batch.to_pylist()]
        assert set(found) == wanted and len(found) == 9


def test_events_near_by_stay_in_their_task(spark):
    """What targets and markets meet near by is counted where they meet: it is neither shuffled nor spilled."""
    t = datetime(2024, 6, 1, 18)
    targets = spark.range(1000).selectExpr("id", "'Spain' as home", "'Italy' as away", f"timestamp'{t}' + make_interval(0, 0, 0, 0, 0, 0, id) as kickoff")
    markets = spark.range(1000).selectExpr("concat('g', id) as group_id", "'Spain vs Italy' as title", f"timestamp'{t}' + make_interval(0, 0, 0, 0, 0, 0, id) as at", "1D as liquidity")
    gateway = spark.sparkContext._gateway

    def written():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(x := stages.apply(k)).stageId(): x.shuffleWriteBytes() + x.diskBytesSpilled() for k in range(stages.size())}

    before = written()
    rows = identity.events_of_pairs(targets, markets).collect()
    assert {tuple(r)[1:6] for r in rows} == {("exact_event", "g0", 1, 1.0, 1000)} and len(rows) == 1000
    assert 0 < sum(n for k, n in written().items() if k not in before) < 1_000_000


def test_alike_names_in_many_blocks(spark, monkeypatch):
    """Each two blocks meet once, and no pair is lost between them; empty and missing names meet nothing."""
    monkeypatch.setattr(identity, "BLOCK", 3)
    r = random.Random(4)
    sides = [[*{"".join(r.choice("abcé") for _ in range(r.randrange(1, 9))) for _ in range(40)}, "", None] for _ in range(2)]
    frames = [spark.createDataFrame([(n,) for n in side * 2], "name string") for side in sides]
    found = [(x["l"], x["r"], x["ratio"]) for x in identity.alike_names(*frames).collect()]
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    assert len(found) == len(set(found))
    assert set(found) == {(x, y, ratio(x, y)) for x in sides[0] if x for y in sides[1] if y if ratio(x, y) >= 0.72}
