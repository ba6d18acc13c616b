import random

import pytest

from oddsloom.llm import decontaminate as dc


def test_finds_planted_items_only(spark, prose):
    r = random.Random(4)
    items = [(k, prose(500 + k, r.randrange(3, 60))) for k in range(150)] + [(900, None), (901, ""), (902, "?"), (903, prose(777, 700))]
    by_id = dict(items)
    docs, wanted = [], set()
    for d in range(200):
        text = prose(10_000 + d, r.randrange(1, 900)).split()
        for _ in range(r.randrange(3)):
            k = r.choice([i for i, t in items if t and len(t.split()) >= 8])
            cut = r.randrange(len(text) + 1)
            copy = by_id[k].upper() if r.random() < 0.3 else by_id[k]
            text[cut:cut] = (copy.split() if r.random() < 0.5 else copy.replace(" ", "\n").split("\n"))
        docs.append((d, " ".join(text)))
        plain = f" {docs[-1][1].lower()} "
        wanted |= {(d, k) for k, t in items if t and t != "?" and f" {t.lower()} " in plain}
    docs += [(None, by_id[3]), (1000, None), (1001, "")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(4)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, place int")
    found = {(x["id"], x["item_id"]) for x in dc.find_leaks(frame, bench).collect() if x["id"] is not None}
    assert wanted <= found
    # What is found besides holds at least four fifths of the item.
    for d, k in found - wanted:
        own, item = f" {dict(docs)[d].lower()} ", by_id[k].lower().split()
        grams = [" ".join(item[i : i + 5]) for i in range(max(1, len(item) - 4))]
        assert sum(f" {g} " in own for g in grams) >= 0.8 * len(grams)
    kept = dc.without_leaks(frame, bench)
    assert kept.columns == ["doc_id", "text", "score"]
    left = {x["doc_id"] for x in kept.collect()}
    assert left == {i for i, t in docs if i is not None and i not in {d for d, _ in found}}


def test_shards_give_the_same(spark, prose, monkeypatch):
    items = spark.createDataFrame([(k, prose(k, 30)) for k in range(60)], "item_id long, text string")
    docs = spark.createDataFrame([(k, prose(5000 + k, 100) + " " + prose(k % 70, 30)) for k in range(140)], "doc_id long, text string")
    one = {(x["id"], x["item_id"]) for x in dc.find_leaks(docs, items).collect()}
    monkeypatch.setattr(dc.item_shards, "__defaults__", (400,))
    assert {(x["id"], x["item_id"]) for x in dc.find_leaks(docs, items).collect()} == one == {(k, k % 70) for k in range(140) if k % 70 < 60}


def test_search_against_plain_bm25(prose):
    """Every passage against every item, with BM25 and overlaps written out anew; both directions."""
    import math
    from collections import Counter

    import numpy as np

    texts = [prose(k, 25 - k % 7) for k in range(80)]
    items = {k: t.split() for k, t in enumerate(texts)}
    frequency = Counter(w for ws in items.values() for w in set(ws))
    mean = sum(map(len, items.values())) / len(items)
    index = dc.ItemIndex([(k, texts[k], ws) for k, ws in items.items()], frequency, len(items), mean, 25, 0.5)
    number = {w: i for i, w in enumerate(index.vocabulary)}

    def weight(w, k):
        n, f = items[k].count(w), frequency[w]
        return math.log(1 + (len(items) - f + 0.5) / (f + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(items[k]) / mean))

    def share(part, passage):
        own = {tuple(part[i : i + 5]) for i in range(len(part) - 4)} or {tuple(part)}
        n = len(next(iter(own)))
        return len(own & {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}) / len(own)

    r = random.Random(1)
    for _ in range(60):
        words = items[r.randrange(80)]
        passage = ([w for w in words if r.random() < 0.97] + prose(r.randrange(10**6), 20).split())[:50]
        terms = np.array([number.get(w, -1) for w in passage])
        hits = {h[1]: h[2:6] for h in index.search(terms, np.array([0, len(terms)]))}
        wanted = {}
        for k, own in items.items():
            score = sum(weight(w, k) for w in set(own) & set(passage)) / sum(weight(w, k) for w in set(own))
            overlap = share(own, passage), share(own[: len(own) // 2], passage), share(own[len(own) // 2 :], passage)
            if score >= 0.5 and overlap[0] >= 0.8 and min(overlap[1:]) >= 0.5:
                wanted[k] = (score, *overlap)
        assert hits.keys() == wanted.keys()
        assert all(hits[k] == pytest.approx(wanted[k]) for k in wanted)


@pytest.mark.parametrize(("docs", "items"), [([], [(1, "a b c d e f")]), ([(1, "a b c d e f")], [])])
def test_empty(spark, docs, items):
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert dc.find_leaks(d, i).count() == 0
    assert dc.without_leaks(d, i).count() == len(docs)
