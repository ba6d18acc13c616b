"""Benchmark decontamination: a BM25 index of test items, searched by every training passage.

Documents are cut into overlapping passages, such that any item's length of
words lies whole in one of them. Each passage is a query to a BM25 inverted
index of the items, all items at or above a threshold are retrieved by
block-max WAND, and each hit is verified: word 5-grams of the item, and of its
question and answer parts, must be found in the passage.

Weights are divided by an item's score for its own text, so a threshold is a
share of that score. Two bounds spare work and lose nothing. Frequent terms
that together can't lift any item to the threshold are not searched by; of the
others, postings are held in blocks of items with the block's largest weight,
and only passages and blocks whose bounds reach the threshold are scored.

The index is built of shards with a bounded number of words, so that what is
broadcast is bounded; more shards mean more passes over the documents.

Edge cases: null and blank items match nothing; null and blank texts hold
nothing; items of fewer than five words must be found as a whole; equal items
are all reported; repeated rows give repeated results; empty tables give empty
results; other columns are ignored by the search and kept by the filter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.llm import arrowtext as at
from oddsloom.llm.cluster import written

K1, B = 1.2, 0.75
THRESHOLD = 0.5
BLOCK_ITEMS = 32
GRAM = 5
ITEM_OVERLAP = 0.8
PART_OVERLAP = 0.5
#: Words of the items in one shard, about.
SHARD_WORDS = 200_000
#: Shards that are searched in one pass over the documents; each takes under 100 MB in a task.
SHARDS_A_PASS = 4
#: Items up to these lengths are searched with passages of twice the length; longer ones by powers of eight.
LENGTHS = (64, 512, 4096, 32768)
EDGES = ".,;:!?\"'()[]{}<>|#$%&*@~`^-_=+/\\…“”‘’«»¿¡–—"


def normal_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, lower-cased and without signs at their ends, codes and row offsets; bare signs are left out."""
    words, codes, offsets = at.split_words(texts)
    words = pc.utf8_trim(pc.utf8_lower(words), characters=EDGES)
    bare = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if bare.any():
        keep = ~bare[codes]
        before = np.concatenate([[0], np.cumsum(keep)])
        codes, offsets = codes[keep], before[offsets]
    return words, codes, offsets


def word_lists(texts: pa.Array) -> list[list[str]]:
    words, codes, offsets = normal_words(texts)
    plain = words.to_pylist()
    return [[plain[c] for c in codes[a:b]] for a, b in zip(offsets[:-1], offsets[1:])]


def parts_of(words: list[str], text: str) -> tuple[list[str], list[str]]:
    """Question and answer: what stands up to the last question mark and what follows, else two halves."""
    head, mark, tail = text.rpartition("?")
    if mark and head.strip() and tail.strip():
        cut = len(word_lists(pa.array([head]))[0])
        if 0 < cut < len(words):
            return words[:cut], words[cut:]
    half = max(1, len(words) // 2)
    return words[:half], words[half:] or words


def grams(words: list) -> set[tuple]:
    return {tuple(words[i : i + GRAM]) for i in range(len(words) - GRAM + 1)} if len(words) >= GRAM else {tuple(words)}


class ItemIndex:
    """The inverted index of one shard: items that are searched with passages of one length."""

    def __init__(self, items: list[tuple[int, str, list[str]]], frequency: dict[str, int], total: int, mean: float, stride: int, threshold: float):
        self.stride, self.threshold = stride, threshold
        items = sorted(items, key=lambda x: (len(x[2]), x[0]))
        self.ids = [x[0] for x in items]
        self.vocabulary = sorted({w for _, _, ws in items for w in ws})
        term = {w: k for k, w in enumerate(self.vocabulary)}
        idf = np.array([math.log(1 + (total - frequency.get(w, 1) + 0.5) / (frequency.get(w, 1) + 0.5)) for w in self.vocabulary])
        postings: list[dict[int, float]] = []
        self.words, self.grams = [], []
        for _, text, words in items:
            own = [term[w] for w in words]
            weight = {t: idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(words) / mean)) for t, n in Counter(own).items()}
            whole = sum(weight.values())
            postings.append({t: w / whole for t, w in weight.items()})
            question, answer = parts_of(words, text)
            self.words.append(own)
            self.grams.append(tuple(grams([term[w] for w in x]) for x in (words, question, answer)))
        # Frequent terms that can't lift an item to the threshold by themselves.
        held, self.rest = np.zeros(len(items)), np.zeros(len(self.vocabulary), dtype=bool)
        of_term: list[list[tuple[int, float]]] = [[] for _ in self.vocabulary]
        for item, p in enumerate(postings):
            for t, w in p.items():
                of_term[t].append((item, w))
        for t in sorted(range(len(of_term)), key=lambda t: (-frequency.get(self.vocabulary[t], 1), t)):
            after = held.copy()
            for item, w in of_term[t]:
                after[item] += w
            if after.max() >= 0.9 * threshold:
                break
            held, self.rest[t] = after, True
        # Blocks of items: the largest weight of each searched term, and what frequent terms may add.
        self.blocks = -(-len(items) // BLOCK_ITEMS)
        self.may_add = np.array([held[b * BLOCK_ITEMS : (b + 1) * BLOCK_ITEMS].max() for b in range(self.blocks)])
        self.held = held
        starts, block_of, largest, first, item_of, weight_of = [0], [], [], [], [], []
        for t, entries in enumerate(of_term):
            if not self.rest[t]:
                for item, w in entries:  # in order of items, so of blocks
                    if len(block_of) == starts[-1] or block_of[-1] != item // BLOCK_ITEMS:
                        block_of.append(item // BLOCK_ITEMS)
                        largest.append(w)
                        first.append(len(item_of))
                    largest[-1] = max(w, largest[-1])
                    item_of.append(item)
                    weight_of.append(w)
            starts.append(len(block_of))
        self.starts, self.block_of, self.largest = np.array(starts), np.array(block_of, dtype=np.int64), np.array(largest)
        self.first, self.item_of, self.weight_of = np.array([*first, len(item_of)]), np.array(item_of, dtype=np.int64), np.array(weight_of)
        self.weights = postings

    def search(self, terms: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float, float, float, float, int]]:
        """Verified hits (row, item id, score, item, question and answer overlap, word place) in rows of term numbers (-1: not in any item)."""
        counts = np.diff(offsets)
        windows = np.maximum(1, -(-counts // self.stride) - 1)
        base = np.concatenate([[0], np.cumsum(windows)])
        searched = np.flatnonzero((terms >= 0) & ~self.rest[terms])
        if not len(searched):
            return []
        rows = np.searchsorted(offsets, searched, side="right") - 1
        step = (searched - offsets[rows]) // self.stride
        # A word lies in the passages that start one stride before its own stretch and with it.
        pairs = []
        for back in (0, 1):
            window = step - back
            fits = (window >= 0) & (window < windows[rows])
            pairs.append((base[rows[fits]] + window[fits]) * len(self.vocabulary) + terms[searched[fits]])
        pairs = np.unique(np.concatenate(pairs))
        window, term = pairs // len(self.vocabulary), pairs % len(self.vocabulary)
        n = self.starts[term + 1] - self.starts[term]
        entry = np.repeat(self.starts[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = np.repeat(window, n) * self.blocks + self.block_of[entry]
        keys, place = np.unique(key, return_inverse=True)
        bound = np.bincount(place, weights=self.largest[entry], minlength=len(keys)) + self.may_add[keys % self.blocks]
        # In the blocks that are left, the searched terms' own weights for each item.
        alive = bound[place] >= self.threshold - 1e-9
        entry, window = entry[alive], np.repeat(window, n)[alive]
        n = self.first[entry + 1] - self.first[entry]
        posting = np.repeat(self.first[entry] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        keys, place = np.unique(np.repeat(window, n) * len(self.ids) + self.item_of[posting], return_inverse=True)
        bound = np.bincount(place, weights=self.weight_of[posting], minlength=len(keys)) + self.held[keys % len(self.ids)]
        hits = []
        for key in keys[bound >= self.threshold - 1e-9]:
            window, item = divmod(int(key), len(self.ids))
            row = int(np.searchsorted(base, window, side="right") - 1)
            start = int(offsets[row]) + (window - int(base[row])) * self.stride
            passage = terms[start : min(start + 2 * self.stride, int(offsets[row + 1]))].tolist()
            held = set(passage)
            score = sum(w for t, w in self.weights[item].items() if t in held)
            if score >= self.threshold - 1e-9:
                overlap = self.overlaps(item, passage)
                if overlap[0] >= ITEM_OVERLAP and min(overlap[1:]) >= PART_OVERLAP:
                    hits.append((row, self.ids[item], score, *overlap, start - int(offsets[row])))
        return hits

    def overlaps(self, item: int, passage: list[int]) -> tuple[float, float, float]:
        found = grams(passage) if len(passage) >= GRAM else set()
        shares = []
        for wanted in self.grams[item]:
            short = [g for g in wanted if len(g) < GRAM]
            if short:
                n = len(short[0])
                own = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
                shares.append(float(short[0] in own))
            else:
                shares.append(len(wanted & found) / len(wanted))
        return tuple(shares)


def item_shards(items: DataFrame, shard_words: int = SHARD_WORDS):
    """One index's content after another, each of about ``shard_words`` words of items of like length.

    Document frequencies and the mean length are those of all items; they are
    counted once.
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = word_lists(batch.column("text"))
            size = [next((k for k, most in enumerate(LENGTHS) if len(w) <= most), int(math.log(max(2, len(w)), 8)) + 8) for w in words]
            yield pa.record_batch({"item": batch.column("item"), "text": batch.column("text"), "words": pa.array(words, pa.list_(pa.string())), "size": pa.array(size, pa.int32()), "n": pa.array(map(len, words), pa.int64())})

    found = written(items.mapInArrow(describe, "item long, text string, words array<string>, size int, n long").where("n > 0"), "leak-items")
    every = written(found.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "leak-words")
    totals = found.groupBy("size").agg(F.sum("n").alias("words"), F.count("*").alias("items"), F.max("n").alias("longest")).collect()
    total, mean = sum(r["items"] for r in totals), sum(r["words"] for r in totals) / max(1, sum(r["items"] for r in totals))
    for r in sorted(totals, key=lambda r: r["size"]):
        shards = -(-r["words"] // shard_words)
        own = found.where(F.col("size") == r["size"]).withColumn("shard", F.expr(f"pmod(xxhash64(item, text), {shards})"))
        stride = int(r["longest"])
        for k in range(shards):
            rows = own.where(F.col("shard") == k)
            words = rows.select(F.explode("words").alias("word")).distinct()
            frequency = {x["word"]: x["n"] for x in every.join(words, "word", "left_semi").collect()}
            listed = [(x["item"], x["text"], x["words"]) for x in rows.select("item", "text", "words").collect()]
            if listed:
                yield listed, frequency, total, mean, stride


def indexes(spark, items: DataFrame, id_column: str, text_column: str, threshold: float) -> Iterator[list]:
    """Broadcast indexes, ``SHARDS_A_PASS`` at a time: so many are searched in one pass over the documents."""
    wanted = items.select(F.col(id_column).cast("long").alias("item"), F.col(text_column).cast("string").alias("text")).where("item is not null and text is not null")
    shards = (spark.sparkContext.broadcast(ItemIndex(listed, frequency, total, mean, stride, threshold)) for listed, frequency, total, mean, stride in item_shards(wanted))
    while some := list(islice(shards, SHARDS_A_PASS)):
        yield some


def search_batch(texts: pa.Array, index: ItemIndex) -> list[tuple]:
    words, codes, offsets = normal_words(texts)
    number = pc.fill_null(pc.index_in(words, value_set=pa.array(index.vocabulary, words.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return index.search(number[codes] if len(codes) else np.zeros(0, dtype=np.int64), offsets)


MATCH = "id long, item_id long, score double, item_overlap double, question_overlap double, answer_overlap double, place long"


def find_leaks(documents: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and item found in it: the best passage's score and overlaps, and its place in words."""
    at.small_batches(documents.sparkSession)
    docs = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    found = None
    for shared in indexes(docs.sparkSession, items, item_column, item_text, threshold):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in at.slices(batch, "text"):
                    best: dict[tuple[int, int], tuple] = {}
                    for index in shared:
                        for hit in search_batch(part.column("text"), index.value):
                            if hit[:2] not in best or hit[3:6] > best[hit[:2]][3:6]:
                                best[hit[:2]] = hit
                    if best:
                        rows, *columns = zip(*best.values())
                        yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(rows)), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), *[pa.float64()] * 4, pa.int64())))], names=[x.split()[0] for x in MATCH.split(", ")])

        one = docs.mapInArrow(run, MATCH)
        found = one if found is None else found.union(one)
    return docs.mapInArrow(lambda batches: iter(()), MATCH) if found is None else found


def without_leaks(documents: DataFrame, items: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` that hold no item; all their columns stay, whatever they are called."""
    at.small_batches(documents.sparkSession)
    kept = documents
    for shared in indexes(documents.sparkSession, items, item_column, item_text, threshold):

        def leaky(texts: pa.Array, shared=shared) -> pa.Array:
            leaks = {hit[0] for index in shared for hit in search_batch(texts, index.value)}
            return pa.array([i in leaks for i in range(len(texts))], pa.bool_())

        kept = kept.where(~at.text_udf(lambda leaky=leaky: leaky, "boolean")(F.col(text_column).cast("string")))
    return kept


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    documents, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_leaks(documents, items).withColumnRenamed("id", "doc_id")
