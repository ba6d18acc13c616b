"""Toxicity: noisy-channel restoration of disguised words, then a scored text.

A disguised word is read as what a writer might have meant: digits and signs
that stand for letters, letters written several times, letters set apart by
signs or spaces. These readings form a lattice of characters; Viterbi decoding
under a character trigram model of the corpus picks one. The score is a
logistic model on the distinct restored words of a text, and on the beginnings
that several of them share: a family of words is known where none of its
members is frequent.

The character model counts all texts. The logistic model learns from at most
``TRAIN_ROWS`` labelled rows outside the held-out fold (those with the
smallest hash of their id); it sees words only, no other column.

Edge cases: a null or blank text has no words and gets the model's base score;
long texts are read whole; repeated rows get equal scores; without labels, or
with labels of one kind only, the score is the (smoothed) share of label 1; an
empty table gives an empty result; other columns are ignored; a row with a
null id is scored and not held out.
"""

from __future__ import annotations

import math
import re
from collections import Counter, OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.llm import arrowtext as at
from oddsloom.llm.cluster import written

TRAIN_ROWS = 40_000
FEATURES = 256
#: Least association (G statistic) and documents of a word that can be a feature.
LEAST_G = 60.0
LEAST_DOCS = 5
FOLDS = 5
#: Lengths of beginnings, and how many distinct words of a text must share one.
BEGINNINGS, SHARED = (4, 6), 2

#: Letters that a digit or sign is written for.
READINGS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
#: Signs that may be left out, as what sets letters apart.
GAPS = set(".-_*~'/\\!$@|+,:;#%&=^`\"")
EDGES = ".,;:?\"'()[]{}<>|#%&*~`^-_=+/\\…“”‘’«»¿¡"

LETTERS = 32  # classes of the character model: 0 white space, 1 to 26 a to z, 27 a byte beyond ASCII, 28 a digit, 29 other
LOG_READ, LOG_GAP, LOG_MERGE = math.log(0.2), math.log(0.3), math.log(0.001)
_SUSPECT = r"[0-9@$!|+€]|[^\W\d_][^\w\s]+\w|[^\W\d_]_+\w|" + "|".join(c * 2 for c in "abcdefghijklmnopqrstuvwxyz")
#: A letter written twice, for words beyond ASCII.
_DOUBLED = re.compile(r"([^\W\d_])\1")
_RUN = re.compile(r"(.)\1*", re.S)
#: Words that are remembered, and the longest of them.
CACHE, CACHED_LENGTH = 30_000, 256


def byte_classes() -> np.ndarray:
    table = np.full(256, 29, dtype=np.int64)
    table[list(b" \t\n\r\f\v")] = 0
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[ord("A") : ord("Z") + 1] = np.arange(1, 27)
    table[128:] = 27
    table[ord("0") : ord("9") + 1] = 28
    return table


def class_of(char: str) -> int:
    if "a" <= char <= "z":
        return ord(char) - 96
    return 28 if char.isdigit() else 27 if ord(char) > 127 else 0 if char.isspace() else 29


def character_counts(documents: DataFrame) -> np.ndarray:
    """Counts of character-class trigrams over all texts: a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, total = byte_classes(), np.zeros(LETTERS**3, dtype=np.int64)
        for batch in batches:
            for part in at.slices(batch, "text", at.BYTE_SLICE):
                joined = " ".join(x for x in part.column("text").to_pylist() if x).encode()
                c = classes[np.frombuffer(b"  " + joined + b"  ", dtype=np.uint8)]
                total += np.bincount((c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:], minlength=LETTERS**3)
        seen = np.flatnonzero(total)
        yield pa.record_batch({"tri": pa.array(seen, pa.int32()), "n": pa.array(total[seen], pa.int64())})

    counts = documents.select("text").mapInArrow(count, "tri int, n long").groupBy("tri").agg(F.sum("n").alias("n"))
    total = np.zeros(LETTERS**3)
    for r in counts.collect():  # at most LETTERS ** 3 rows
        total[r["tri"]] = r["n"]
    return total


def character_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of a class after two others, interpolated with shorter contexts."""
    tri = counts.reshape(LETTERS, LETTERS, LETTERS)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (uni + 1) / (uni.sum() + LETTERS)
    p2 = (bi + 4 * p1) / (bi.sum(axis=1, keepdims=True) + 4)
    p3 = (tri + 4 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 4)
    return np.log(p3)


class Restorer:
    """Reads words; remembers those it has read lately."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.seen: OrderedDict[str, str] = OrderedDict()

    def lattice(self, word: str) -> Iterator[list[tuple[str, float]]]:
        """For each run of one character, the strings it can stand for and their costs."""
        for m in _RUN.finditer(word):
            char, n = m[1], len(m[0])
            options = [(char * min(n, 2), 0.0)]
            if n >= 2 and char.isalpha():
                options.append((char, LOG_MERGE if n == 2 else 0.0))
            for letter in READINGS.get(char, ""):
                options.append((letter, LOG_READ))
                if n >= 2:
                    options.append((letter * 2, LOG_READ))
            if char in GAPS:
                options.append(("", LOG_GAP))
            yield options

    def decode(self, word: str) -> str:
        """The likeliest reading: Viterbi over pairs of last classes."""
        # A path is its last string and the path before it, so each step costs the same however long the word is.
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        model = self.model
        for options in self.lattice(word):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, way) in states.items():
                for string, cost in options:
                    x, y, s = a, b, score + cost
                    for char in string:
                        c = class_of(char)
                        s += model[x][y][c]
                        x, y = y, c
                    if (x, y) not in after or s > after[x, y][0]:
                        after[x, y] = (s, (string, way))
            states = after
        ends = [(s + model[a][b][0], way) for (a, b), (s, way) in states.items()]
        best = max(s for s, _ in ends)
        return max(text_of(way) for s, way in ends if s == best)

    def read(self, word: str) -> str:
        if word in self.seen:
            return self.seen[word]
        found = self.decode(without_tail(word))
        if len(word) > CACHED_LENGTH:
            return found
        if len(self.seen) >= CACHE:
            self.seen.popitem(last=False)
        self.seen[word] = found
        return found


def text_of(way: tuple | None) -> str:
    parts = []
    while way is not None:
        string, way = way
        parts.append(string)
    return "".join(reversed(parts))


def without_tail(word: str) -> str:
    """``word`` without exclamation marks, and other signs written at least twice, at its end."""
    end = len(word)
    while end:
        char, start = word[end - 1], end
        while start and word[start - 1] == char:
            start -= 1
        if char != "!" and not (char in "$@|+" and end - start >= 2):
            break
        end = start
    return word[:end]


def restored(texts: pa.Array, restorer: Restorer) -> tuple[list[str], np.ndarray, np.ndarray, list[tuple[int, str]]]:
    """Restored forms of the distinct words, word codes, row offsets, and joined runs of single characters by row."""
    words, codes, offsets = at.split_words(texts)
    words = pc.utf8_trim(pc.utf8_lower(words), characters=EDGES)
    suspect = pc.match_substring_regex(words, _SUSPECT).to_numpy(zero_copy_only=False).copy()
    plain = words.to_pylist()
    beyond = ~suspect & ~pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(beyond):
        suspect[i] = _DOUBLED.search(plain[i]) is not None
    forms = list(plain)
    for i in np.flatnonzero(suspect):
        forms[i] = restorer.read(plain[i])
    runs = []
    if len(codes):
        single = (pc.utf8_length(words).to_numpy(zero_copy_only=False) == 1)[codes]
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], single, [0]]).astype(np.int8)) | np.diff(np.concatenate([[-1], rows, [-1]])).astype(bool))
        for start, end in zip(edge[:-1], edge[1:]):
            if single[start] and end - start >= 3:
                runs.append((int(rows[start]), restorer.read("".join(plain[c] for c in codes[start:end]))))
    return forms, codes, offsets, runs


def row_words(forms: list[str], codes: np.ndarray, offsets: np.ndarray, runs: list[tuple[int, str]]) -> list[set[str]]:
    found = [set(map(forms.__getitem__, np.unique(codes[a:b]))) for a, b in zip(offsets[:-1], offsets[1:])]
    for row, text in runs:
        found[row].add(text)
    return found


def beginnings(words: set[str]) -> list[str]:
    """Beginnings that are shared by ``SHARED`` of the words; a space at the end tells them from words."""
    seen = Counter(w[:k] for k in BEGINNINGS for w in words if len(w) >= k)
    return [f"{b} " for b, n in seen.items() if n >= SHARED]


def training_sample(labels: DataFrame, id_column: str, label_column: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids outside the held-out fold, those with the smallest hash."""
    known = labels.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(f"crc32(cast(id as string)) % {FOLDS} <> 0").groupBy("id").agg(F.max("y").alias("y"))
    return known.orderBy(F.xxhash64("id"), "id").limit(rows)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.0001, steps: int = 1000) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient; weights are not negative. Equal rows, nearly all, count as one."""
    n, k = x.shape
    bias = math.log((y.sum() + 1) / (n - y.sum() + 1))
    rows, times = np.unique(np.column_stack([x, y]), axis=0, return_counts=True)
    x, y = rows[:, :-1], rows[:, -1]
    weights, step = np.zeros(k), 4.0 / max(1.0, float((x.sum(axis=1) + 1).max()))
    z, zb, t = weights, bias, 1.0
    for _ in range(steps):
        residual = (1 / (1 + np.exp(-(x @ z + zb))) - y) * times
        w = np.maximum(0.0, z - step * (x.T @ residual / n + penalty))
        b = zb - step * residual.sum() / n
        s = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, zb = w + (t - 1) / s * (w - weights), b + (t - 1) / s * (b - bias)
        weights, bias, t = w, b, s
    return weights, bias


def learn(documents: DataFrame, labels: DataFrame, model: np.ndarray, id_column: str = "doc_id", label_column: str = "toxic", rows: int = TRAIN_ROWS) -> tuple[dict[str, float], float]:
    """Word weights and base of the score. Texts that occur more than once count once."""
    sample = training_sample(labels, id_column, label_column, rows)
    # The broadcast side has at most ``rows`` rows of two numbers.
    texts = documents.select("id", "text").join(F.broadcast(sample), "id")
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in batches:
            for part in at.slices(batch, "text"):
                forms, codes, offsets, runs = restored(part.column("text"), restorer)
                sets, starts = row_words(forms, codes, offsets, runs), map(beginnings, row_words(forms, codes, offsets, []))
                # One digest for texts with the same set of words.
                keys = [hash_of(s) for s in sets]
                yield pa.record_batch({"key": pa.array(keys, pa.int64()), "y": part.column("y"), "words": pa.array([sorted((s | set(b)) - {""}) for s, b in zip(sets, starts)], pa.list_(pa.string()))})

    kept = texts.mapInArrow(words, "key long, y int, words array<string>").groupBy("key").agg(F.max("y").alias("y"), F.min("words").alias("words"))
    kept = written(kept, "toxicity-words")
    totals = {r["y"]: r["n"] for r in kept.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = float(totals.get(1, 0)), float(totals.get(0, 0))
    if not n1 or not n0:
        return {}, math.log((n1 + 1) / (n0 + 1))
    counted = kept.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.sum("y").alias("hit1"), F.sum(1 - F.col("y")).alias("hit0"))
    # The G statistic in SQL, so that only the best words come to the driver.
    n = n1 + n0
    part = lambda seen, expected: F.expr(f"if({seen} > 0, ({seen}) * ln(({seen}) / ({expected})), 0D)")
    g = part("hit1", f"(hit1 + hit0) * {n1 / n}D") + part("hit0", f"(hit1 + hit0) * {n0 / n}D") + part(f"{n1}D - hit1", f"({n}D - hit1 - hit0) * {n1 / n}D") + part(f"{n0}D - hit0", f"({n}D - hit1 - hit0) * {n0 / n}D")
    best = counted.where(f"hit1 + hit0 >= {LEAST_DOCS} and hit1 * {n0}D > hit0 * {n1}D").withColumn("g", 2 * g).where(F.col("g") >= min(LEAST_G, 0.02 * n))
    features = [r["word"] for r in best.orderBy(F.desc("g"), "word").limit(FEATURES).collect()]
    if not features:
        return {}, math.log((n1 + 1) / (n0 + 1))
    listed = F.array(*[F.lit(w) for w in features])
    # At most ``rows`` rows with at most ``FEATURES`` words each.
    held = kept.select("key", "y", F.array_intersect(listed, "words").alias("held")).orderBy("key").collect()
    index = {w: i for i, w in enumerate(features)}
    x, y = np.zeros((len(held), len(features))), np.array([r["y"] for r in held], dtype=float)
    for i, r in enumerate(held):
        x[i, [index[w] for w in r["held"]]] = 1.0
    weights, bias = fit_logistic(x, y)
    return {w: float(v) for w, v in zip(features, weights) if v > 0}, bias


def hash_of(words: set[str]) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest("\n".join(sorted(words)).encode()) - (1 << 63)


def toxicity_scorer(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", rows: int = TRAIN_ROWS) -> Callable[[Column], Column]:
    """Learn from ``documents`` and ``labels``; what comes back turns a text column into its score (0 to 1)."""
    at.small_batches(documents.sparkSession)
    docs = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    model = character_model(character_counts(docs))
    weights, base = learn(docs, labels, model, id_column, label_column, rows)
    shared = docs.sparkSession.sparkContext.broadcast((model, weights, base))

    def make() -> Callable[[pa.Array], pa.Array]:
        model, weights, base = shared.value
        restorer = Restorer(model)
        known, value = {w: i for i, w in enumerate(weights)}, list(weights.values())

        def scores(texts: pa.Array) -> pa.Array:
            forms, codes, offsets, runs = restored(texts, restorer)
            of_word = np.fromiter((known.get(f, -1) for f in forms), dtype=np.int64, count=len(forms))
            rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            feature = of_word[codes] if len(codes) else codes
            hits = set(zip(rows[feature >= 0].tolist(), feature[feature >= 0].tolist())) if len(codes) else set()
            hits |= {(row, known[w]) for row, text in runs for w in known if w in text}
            for k in BEGINNINGS:
                of_start = np.fromiter((known.get(f"{f[:k]} ", -1) if len(f) >= k else -1 for f in forms), dtype=np.int64, count=len(forms))
                held = np.flatnonzero(of_start[codes] >= 0) if len(codes) else codes
                # Distinct words of each row and beginning: written otherwise, a word is the same.
                distinct = {(row, int(of_start[c]), forms[c]) for row, c in zip(rows[held].tolist(), codes[held].tolist())}
                hits |= {x for x, n in Counter(d[:2] for d in distinct).items() if n >= SHARED}
            total = [base] * len(texts)
            for row, f in hits:
                total[row] += value[f]
            return pa.array([1 / (1 + math.exp(-max(-500.0, min(500.0, z)))) for z in total], pa.float64())

        return scores

    return at.text_udf(make, "double")


def score_toxicity(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", rows: int = TRAIN_ROWS) -> DataFrame:
    """``(id, held_out, score, predicted)`` for every document; ``labels`` has the id column and the label column."""
    score = toxicity_scorer(documents, labels, id_column, text_column, label_column, rows)
    scored = documents.select(F.col(id_column).cast("long").alias("id"), score(F.col(text_column).cast("string")).alias("score"))
    return scored.select("id", F.coalesce(F.expr(f"crc32(cast(id as string)) % {FOLDS} = 0"), F.lit(False)).alias("held_out"), "score", F.expr("cast(score >= 0.5 as int)").alias("predicted"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_toxicity(documents, labels).withColumnRenamed("id", "doc_id")
