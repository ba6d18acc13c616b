"""The Jaccard join against all pairs, at several sizes and thresholds."""

import random
import re

import pytest

from oddsloom.llm import ngram_jaccard as nj

SCHEMA = "doc_id long, text string, n long, keys string, component string"


def shingles(text, width):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, width))
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            for s in sets[a]:
                for t in sets[b]:
                    if s and t and 100 * len(s & t) >= percent * len(s | t):
                        x, y = root(a), root(b)
                        up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def family(r, base, changes):
    words = base.split()
    for _ in range(changes):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_against_all_pairs(spark, prose, width, percent):
    r = random.Random(width)
    rows = [(None, "no id"), (0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE two"), (5, "one two three"), (6, "x" * 50_000)]
    n = 10
    for size in (8, 9, 10, 11, 12, 14, 18, 22, 30, 60, 150, 400):
        base = prose(size, size)
        for changes in (0, 0, 1, 1, 2, 3, max(1, size // 40), max(1, size // 25)):
            rows.append((n, family(r, base, changes)))
            n += 1
        rows.append((n, base.upper()))
        n += 1
    common = prose(99, 70)
    rows += [(n + k, f"{common} {prose(1000 + k, 40)}") for k in range(20)]
    frame = spark.createDataFrame([(i, t, 7, "k", "c") for i, t in rows], SCHEMA).repartition(3)
    found = {x["id"]: x for x in nj.jaccard_components(frame, "doc_id", "text", width, percent).collect()}
    wanted = brute(rows, width, percent)
    assert {i: x["component_id"] for i, x in found.items()} == wanted
    assert all(x["n_shingles"] == len(shingles(t, width)) for i, t in rows if i is not None for x in [found[i]])


def test_chain_that_one_star_misses(spark, prose):
    """Neighbours are linked, the ends are not: the head of a shared list doesn't reach all."""
    words = prose(5, 200).split()
    rows = []
    for k in range(12):
        rows.append((k, " ".join(words)))
        for j in range(3):
            words[(k * 17 + j * 61) % 200] = f"step{k}x{j}"
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x["id"]: x["component_id"] for x in nj.jaccard_components(frame).collect()}
    assert found == brute(rows, 3, 90)


def test_subsets_are_used_for_small_sets(spark, prose, monkeypatch):
    monkeypatch.setattr(nj, "cheapest_boundary", lambda *a: 14)
    r = random.Random(1)
    rows = [(10 * s + k, family(r, prose(s, s), k % 3)) for s in range(4, 22) for k in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x["id"]: x["component_id"] for x in nj.jaccard_components(frame, width=1, percent=80).collect()}
    assert found == brute(rows, 1, 80)


def test_empty_and_filter(spark, prose):
    assert nj.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, prose(1, 50), 1), (2, prose(1, 50), 2), (2, prose(1, 50), 2), (3, prose(3, 50), 3), (3, prose(3, 50), 3), (None, "a", 4)]
    kept = nj.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string, extra int"))
    assert kept.columns == ["doc_id", "text", "extra"]
    assert sorted((x["doc_id"] or -1, x["extra"]) for x in kept.collect()) == [(-1, 4), (1, 1), (3, 3)]


def test_rows_that_share_an_id(spark, prose):
    """Each text counts by itself; given columns may have any name."""
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    near = a.split()
    near[30] = "other"
    rows = [(5, a, 1, "x", "k"), (5, b, 2, "x", "k"), (9, c, 3, None, None), (7, " ".join(near), 4, "x", "k"), (5, a, 1, "x", "k"), (8, None, 5, "x", "k"), (8, None, 6, "x", "k"), (None, a, 7, "x", "k")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _gone int, _again string, `a.class` string")
    kept = nj.without_near_copies(frame)
    assert kept.columns == frame.columns
    assert sorted(x["_gone"] for x in kept.collect()) == [1, 2, 3, 5, 6, 7]
    found = {x["id"]: x["component_id"] for x in nj.jaccard_components(frame).collect()}
    assert found == {5: 5, 7: 5, 8: 8, 9: 9}  # 55 of 61 shingles
    found = {x["id"]: x["component_id"] for x in nj.jaccard_components(frame, width=5, percent=80).collect()}
    assert found == {5: 5, 7: 5, 8: 8, 9: 9}
