import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from oddsloom.llm import katz


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w] + [None]


def brute(rows, vocabulary=None):
    """Scores by plain counting; with ``vocabulary``, all other words are one class."""
    words, pairs, texts = Counter(), Counter(), 0
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            x = tokens(t)
            words.update(x)
            texts += 1
    n, v = sum(words.values()), len(words)
    if vocabulary is None:
        known = set(words)
    else:
        least = next(c for c in range(1, 10**6) if sum(k >= c for k in words.values()) <= vocabulary)
        known = {w for w, c in words.items() if c >= least} | {None}
    sym = lambda w: ("w", w) if w in known else "class"
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            x = ["start", *map(sym, tokens(t))]
            pairs.update(zip(x, x[1:]))

    def seen(c):
        out = np.zeros(katz.K + 3, dtype=int)
        for k in c.values():
            out[min(k, katz.K + 2)] += 1
        return out

    d1, d2 = katz.discounts(seen(words)), katz.discounts(seen(pairs))
    rate = lambda d, c: d[c] * c if c <= katz.K else c
    class_tokens, class_types = sum(c for w, c in words.items() if w not in known), sum(w not in known for w in words)
    p = {sym(w): rate(d1, words[w]) / n for w in known} if n else {}
    p["class"] = 1 - sum(p.values())
    count, kept, lower = Counter(), Counter(), Counter()
    for (h, w), c in pairs.items():
        count[h] += c
        kept[h] += rate(d2, c)
        lower[h] += p[w]

    def probability(h, w):
        if pairs[h, w]:
            return rate(d2, pairs[h, w]) / (count[h] + katz.RESERVE)
        return (1 - kept[h] / (count[h] + katz.RESERVE)) / (1 - lower[h]) * p[w]

    out = []
    for i, t in rows:
        x = tokens(t)
        s, h = 0.0, "start"
        for w in x:
            s += math.log10(probability(h, sym(w))) + (math.log10((words[w] + 1) / (class_tokens + class_types + 1)) if sym(w) == "class" else 0)
            h = sym(w)
        out.append((i, len(x), sum(words[w] > 0 for w in x), n, sum(math.log10((words[w] + 1) / (n + v + 1)) for w in x), s))
    for h in count:  # every history's probabilities add up to one
        assert abs(sum(probability(h, w) for w in p) - 1) < 1e-9
    return out


def check(spark, rows, vocabulary=None):
    frame = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n_tokens int, key string").repartition(3)
    found = sorted(((r["id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in katz.score_texts(frame).collect()), key=str)
    wanted = sorted(brute(rows, vocabulary), key=str)
    assert [f[:4] for f in found] == [w[:4] for w in wanted]
    for f, w in zip(found, wanted):
        assert f[4] == pytest.approx(w[4], abs=1e-6) and f[5] == pytest.approx(w[5], abs=1e-6)
    return frame


ROWS = [(None, "a b a"), (1000, None), (1001, ""), (1002, "solitary"), (1003, "the " * 3000), (1004, "same text here"), (1004, "same text here")]


def test_against_counting(spark, prose):
    check(spark, ROWS + [(i, prose(i, 40 + i % 90)) for i in range(120)])


def test_with_a_class_of_rare_words(spark, prose, monkeypatch):
    rows = ROWS + [(i, prose(i, 40 + i % 90)) for i in range(120)]
    monkeypatch.setattr(katz, "VOCABULARY", 500)
    monkeypatch.setattr(katz, "HOT", 20)
    monkeypatch.setattr(katz, "PACK_TOKENS", 700)
    check(spark, rows, 500)


def test_buckets_follow_the_texts(spark, prose, monkeypatch):
    monkeypatch.setattr(katz, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(katz, "HOT", 20)
    check(spark, ROWS + [(i, prose(i, 40 + i % 90)) for i in range(60)])


def test_a_pair_repeated_more_often_than_two_bytes_hold(spark, prose, monkeypatch):
    monkeypatch.setattr(katz, "HOT", 3)
    held = next(i for i in range(2000, 2100) if zlib.crc32(str(i).encode()) % 7 == 2)
    trained = next(i for i in range(2000, 2100) if zlib.crc32(str(i).encode()) % 7 != 2)
    check(spark, [(i, prose(i, 40)) for i in range(30)] + [(trained, "rare pair rare pair"), (held, "rare pair " * 70_000)])


def test_empty(spark):
    kind = "doc_id long, text string"
    assert katz.score_texts(spark.createDataFrame([], kind)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = katz.score_texts(spark.createDataFrame([(held, "only held out")], kind)).first()
    assert r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == 0.0


def test_batches_of_very_many_short_texts_score_like_small_ones(spark):
    rows = spark.range(0, 70_000, 1, 1).selectExpr("id as doc_id", "concat('w', id % 100, ' v', (id * 7) div 100 % 100) as text")
    key, sums = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)
    try:
        for size in (5_000, 100_000):
            spark.conf.set(key, size)
            sums.append(katz.score_texts(rows).selectExpr("round(sum(score), 3)", "max(score) < -0.5", "count(*)").first())
    finally:
        spark.conf.set(key, before)
    assert sums[0] == sums[1] and sums[0][1] and sums[0][2] == 70_000
