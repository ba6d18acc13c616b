"""LM scoring: a Katz backoff bigram model over all training texts.

Counts of words and of word pairs are discounted by Good and Turing's
estimate up to a count of ``K``; what a history loses goes to the words not
seen after it, in proportion to their lower-order probability, by a weight
that makes each history's probabilities add up to one exactly.

Words: the most frequent training words, at most ``VOCABULARY`` of them (all
words with a count at or above the smallest threshold that leaves so many),
are symbols of the model. All others share one class; a word of the class has
the class's probability times (c + 1) / (tokens + types + 1) of the class,
so every word, even an unseen one, has its share, and nothing is left out.

The work runs in three passes over the texts. The first counts words. The
second sends each pair to the bucket of its history, with the documents it
stands in, so that one task has all pairs of a history: it counts them, sums
up what the backoff weight needs, and adds up each document's terms. The third
scores pairs of two frequent symbols, whose counts are one bounded table that
every task has. Histories that are frequent symbols are spread over buckets
by their next word. All that a task receives is packed arrays; the counts
are written as tables partitioned by bucket.

Edge cases: a null or blank text is one end token; long texts are read whole;
repeated rows get equal scores and count each in training; without any
training text every token has the class's probability 1; an empty table gives
an empty result; other columns are ignored; a row with a null id is trained
on and scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.llm import arrowtext as at
from oddsloom.llm.cluster import sliced, summed, written

K = 5
VOCABULARY = 1 << 18
HOT = 256
#: Tokens and documents that a task packs at once.
PACK_TOKENS, PACK_DOCUMENTS = 1_000_000, 60_000
#: A bucket stands for about this much text; as every pack sends a row to each bucket, there are at most so many.
BUCKET_BYTES, MOST_BUCKETS = 16 << 20, 1 << 16
HISTOGRAM = 1 << 14
#: Part of a count that every history keeps back besides the discounts: one whose counts are all above ``K`` has none.
RESERVE = 0.5
FOLDS, HELD_OUT = 7, 2
#: Symbols: the class of all other words, the end, the start; then words by falling count.
CLASS, END, START, FIRST = 0, 1, 2, 3
#: The end's place among word hashes.
END_HASH = np.uint64(xxhash.xxh3_64_intdigest(b"\x00end"))
BUCKET_MIX = 0x9E3779B1


def discounts(seen: np.ndarray) -> np.ndarray:
    """Good-Turing discounts for counts 1 to ``K`` by Katz's formula; ``seen[r]`` types have count r.

    Where the counts of counts don't give one between 0 and 1, a count loses a
    half instead.
    """
    found = np.array([1.0, *((r - 0.5) / r for r in range(1, K + 1))])
    if seen[1] > 0:
        tail = (K + 1) * seen[K + 1] / seen[1]
        for r in range(1, K + 1):
            if seen[r] > 0 and tail < 1:
                d = ((r + 1) * seen[r + 1] / (r * seen[r]) - tail) / (1 - tail)
                if 0 < d < 1:
                    found[r] = d
    return found


def grouped_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's words and its end, and row offsets."""
    words, codes, offsets = at.split_words(texts)
    hashes = at.hash_words(words)[codes] if len(words) else np.zeros(0, dtype=np.uint64)
    return np.insert(hashes, offsets[1:], END_HASH), offsets + np.arange(len(offsets))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(place, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def numbers(column, kind) -> np.ndarray:
    """All values of a column of packed arrays."""
    return np.concatenate([np.frombuffer(x.as_buffer(), dtype=kind) for x in column]) if len(column) else np.zeros(0, dtype=kind)


def packed(values: np.ndarray, kind) -> bytes:
    return values.astype(kind).tobytes()


def width_of(values: np.ndarray) -> type:
    """The smaller type that holds all of ``values``."""
    return np.uint16 if values.max(initial=0) < 1 << 16 else np.uint32


class Words:
    """The vocabulary and the unigram model; of bounded size."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tokens: int, types: int, texts: int, seen: np.ndarray):
        order = np.lexsort((hashes, -counts))
        end = hashes[order] == END_HASH
        order = order[~end]
        self.tokens, self.types, self.texts = tokens, types, texts
        self.count = np.concatenate([[0, texts, texts], counts[order]]).astype(np.float64)
        ids = np.arange(FIRST, FIRST + len(order))
        if tokens:  # without training texts the end is of the class too
            known, ids = np.concatenate([hashes[order], [END_HASH]]), np.concatenate([ids, [END]])
        else:
            known, ids = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        by_hash = np.argsort(known)
        self.known, self.ids = known[by_hash], ids[by_hash].astype(np.int64)
        word_counts = np.concatenate([[texts], counts[order]]) if texts else np.zeros(0)
        self.class_tokens, self.class_types = tokens - int(word_counts.sum()), types - len(word_counts)
        self.count[CLASS] = self.class_tokens
        self.hot = min(HOT, len(self.count))
        if tokens:
            d = discounts(seen)
            small = np.minimum(self.count, K + 1).astype(np.int64)
            rate = np.where(small <= K, np.concatenate([d, [1.0]])[small], 1.0)
            rate[CLASS] = rate[START] = 1.0
            p = self.count * rate / tokens
            p[START] = 0.0
            p[CLASS] += 1.0 - p.sum()
        else:
            p = np.zeros(len(self.count))
            p[CLASS] = 1.0
        self.p = p
        with np.errstate(divide="ignore"):
            self.log_p = np.log10(p)
        self.log_history = np.log10(self.count + RESERVE)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(hashes), dtype=np.int64)
        place = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[place] == hashes, self.ids[place], CLASS)


def count_words(documents: DataFrame, buckets: int) -> Words:
    """First pass: exact counts of all training words, written by bucket; the frequent ones come back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = texts = 0

        def flush():
            keys, n = merged(held)
            bucket = (keys % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            keys, n, bucket = keys[order], n[order], bucket[order]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            full = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
            return pa.record_batch({"bucket": pa.array(full, pa.int32()), "words": pa.array([packed(keys[cuts[b] : cuts[b + 1]], np.uint64) for b in full], pa.binary()), "counts": pa.array([packed(n[cuts[b] : cuts[b + 1]], np.uint32) for b in full], pa.binary()), "texts": pa.array([texts if i == 0 else 0 for i in range(len(full))], pa.int64())})

        for batch in batches:
            for part in at.slices(batch, "text"):
                part = part.filter(part.column("train"))
                if part.num_rows:
                    hashes, _ = grouped_rows(part.column("text"))
                    keys, n = np.unique(hashes, return_counts=True)
                    held.append((keys, n))
                    size += len(keys)
                    texts += part.num_rows
                    if size > PACK_TOKENS:
                        yield flush()
                        held, size, texts = [], 0, 0
        if held:
            yield flush()

    def add(table: pa.Table) -> pa.Table:
        keys, n = merged([(numbers(table.column("words"), np.uint64), numbers(table.column("counts"), np.uint32).astype(np.float64))])
        seen = np.bincount(np.minimum(n, HISTOGRAM - 1), minlength=HISTOGRAM)
        used = np.flatnonzero(seen)
        return pa.table({"bucket": table.column("bucket")[:1], "words": pa.array([packed(keys, np.uint64)], pa.binary()), "counts": pa.array([packed(n, np.int64)], pa.binary()), "texts": pa.array([sum(table.column("texts").to_pylist())], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64()), "of": pa.array([used.tolist()], pa.list_(pa.int32())), "types": pa.array([seen[used].tolist()], pa.list_(pa.int64()))})

    sent = documents.select("text", "train").mapInArrow(count, "bucket int, words binary, counts binary, texts long").repartition(buckets, "bucket")
    table = written(sent.groupBy("bucket").applyInArrow(add, "bucket int, words binary, counts binary, texts long, tokens long, of array<int>, types array<long>"), "katz-words")
    totals = table.agg(F.sum("tokens").alias("tokens"), F.sum("texts").alias("texts")).first()
    histogram = np.zeros(HISTOGRAM, dtype=np.int64)
    for r in table.select(F.explode(F.arrays_zip("of", "types")).alias("x")).groupBy("x.of").agg(F.sum("x.types").alias("n")).collect():
        histogram[r["of"]] = r["n"]
    above = np.cumsum(histogram[::-1])[::-1]
    least = int(np.argmax(above <= VOCABULARY)) if (above <= VOCABULARY).any() else HISTOGRAM - 1
    least = max(1, least)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(batch.column("words"), batch.column("counts")):
                words, counts = np.frombuffer(words.as_buffer(), dtype=np.uint64), np.frombuffer(counts.as_buffer(), dtype=np.int64)
                keep = (counts >= least) | (words == END_HASH)
                yield pa.record_batch({"words": pa.array([packed(words[keep], np.uint64)], pa.binary()), "counts": pa.array([packed(counts[keep], np.int64)], pa.binary())})

    # At most ``VOCABULARY`` words, but for ties at the histogram's last count.
    rows = table.select("words", "counts").mapInArrow(frequent, "words binary, counts binary").collect()
    hashes = np.concatenate([np.frombuffer(r["words"], dtype=np.uint64) for r in rows] or [np.zeros(0, dtype=np.uint64)])
    counts = np.concatenate([np.frombuffer(r["counts"], dtype=np.int64) for r in rows] or [np.zeros(0, dtype=np.int64)])
    return Words(hashes, counts, totals["tokens"] or 0, int(histogram.sum()), totals["texts"] or 0, histogram[: K + 2])


def pairs_of(words: Words, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Histories, next symbols, word hashes and row offsets of all tokens."""
    hashes, offsets = grouped_rows(texts)
    after = words.symbols(hashes)
    before = np.concatenate([[START], after[:-1]]) if len(after) else after
    before[offsets[:-1]] = START
    return before, after, hashes, offsets


def bucket_of(before: np.ndarray, after: np.ndarray, hot: int, buckets: int) -> np.ndarray:
    mixed = before * BUCKET_MIX + np.where(before < hot, after * 40503 + 7, 0)
    mixed ^= mixed >> 15
    return (mixed * 0x85EBCA77 >> 7) % buckets


PAIRS = "kind int, bucket int, pack long, keys binary, counts binary, docs binary, texts int"


def send_pairs(documents: DataFrame, shared, buckets: int) -> DataFrame:
    """Second pass, map side: pairs and words of the class, with their documents, packed by bucket.

    In a pack, training documents come first: ``texts`` is their number.
    Kind 0: pairs; 1: words of the class; 2: keys of the pack's documents.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words: Words = shared.value
        held: list[tuple] = []
        keys: list[np.ndarray] = []
        trains: list[np.ndarray] = []
        size = docs = packs = 0

        def rows(kind, bucket, key, doc, width):
            """One packed row for each bucket: distinct keys, how many tokens each has, and their documents."""
            order = np.lexsort((doc, key, bucket))
            bucket, key, doc = bucket[order], key[order], doc[order]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                own = key[cuts[b] : cuts[b + 1]]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                n = np.diff(np.concatenate([first, [len(own)]]))
                yield kind, int(b), packed(own[first], width), packed(n, np.uint32), packed(doc[cuts[b] : cuts[b + 1]], np.uint16)

        def flush():
            nonlocal packs
            train = np.concatenate(trains)
            place = np.empty(len(train), dtype=np.int64)
            order = np.argsort(~train, kind="stable")
            place[order] = np.arange(len(train))
            before, after, hashes, doc = (np.concatenate(x) for x in zip(*held))
            doc = place[doc]
            cold = (before >= words.hot) | (after >= words.hot)
            found = list(rows(0, bucket_of(before[cold], after[cold], words.hot, buckets), before[cold] << 32 | after[cold], doc[cold], np.int64))
            rare = after == CLASS
            found += rows(1, (hashes[rare] % np.uint64(buckets)).astype(np.int64), hashes[rare].view(np.int64), doc[rare], np.int64)
            found.append((2, packs % buckets, packed(np.concatenate(keys)[order], np.int64), b"", b""))
            pack = (TaskContext.get().partitionId() << 20) | packs
            packs += 1
            kind, bucket, key, n, docs = zip(*found)
            return pa.record_batch({"kind": pa.array(kind, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "pack": pa.array([pack] * len(kind), pa.int64()), "keys": pa.array(key, pa.binary()), "counts": pa.array(n, pa.binary()), "docs": pa.array(docs, pa.binary()), "texts": pa.array([int(train.sum())] * len(kind), pa.int32())})

        for batch in batches:
            # Document numbers of a pack take 16 bits, so a slice of very many short texts is cut by rows too.
            for part in (whole.slice(k, PACK_DOCUMENTS) for whole in at.slices(batch, "text") for k in range(0, whole.num_rows, PACK_DOCUMENTS)):
                before, after, hashes, offsets = pairs_of(words, part.column("text"))
                if held and docs + part.num_rows > PACK_DOCUMENTS:
                    yield flush()
                    held, keys, trains, size, docs = [], [], [], 0, 0
                held.append((before, after, hashes, np.repeat(np.arange(docs, docs + part.num_rows), np.diff(offsets))))
                keys.append(part.column("key").to_numpy())
                trains.append(part.column("train").to_numpy(zero_copy_only=False))
                size += len(after)
                docs += part.num_rows
                if size > PACK_TOKENS:
                    yield flush()
                    held, keys, trains, size, docs = [], [], [], 0, 0
        if held:
            yield flush()

    return documents.select("text", "train", "key").mapInArrow(send, PAIRS)


def count_hot(documents: DataFrame, shared) -> np.ndarray:
    """Training counts of pairs of two frequent symbols: a table of at most ``HOT`` squared."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Words = shared.value
        total = np.zeros(words.hot**2, dtype=np.int64)
        for batch in batches:
            for part in at.slices(batch, "text"):
                part = part.filter(part.column("train"))
                if part.num_rows:
                    before, after, _, _ = pairs_of(words, part.column("text"))
                    hot = (before < words.hot) & (after < words.hot)
                    total += np.bincount(before[hot] * words.hot + after[hot], minlength=len(total))
        yield sliced([total])

    found = summed(documents.select("text", "train").mapInArrow(count, "slice int, part long, counts binary"), documents.rdd.getNumPartitions())
    hot = shared.value.hot
    return found[0].reshape(hot, hot) if found else np.zeros((hot, hot), dtype=np.int64)


#: What a bucket sends on. Kind 0: terms of a pack's documents; 1: sums of histories; 2: counts of counts; 3: the bucket's pairs; 4: keys of a pack.
TERMS = "kind int, bucket int, pack long, keys binary, a binary, b binary, c binary"


def count_pairs(sent: DataFrame, shared, buckets: int) -> DataFrame:
    """Second pass, reduce side: each bucket's counts, sums of histories, and terms of documents."""

    def count(table: pa.Table) -> pa.Table:
        words: Words = shared.value
        bucket = table.column("bucket")[0].as_py()
        kinds = table.column("kind").to_numpy()
        out: list[tuple] = []
        for kind in (0, 1):
            rows = table.filter(pa.array(kinds == kind))
            if not rows.num_rows:
                continue
            keys, n, docs = numbers(rows.column("keys"), np.int64), numbers(rows.column("counts"), np.uint32).astype(np.int64), numbers(rows.column("docs"), np.uint16).astype(np.int64)
            in_row = np.array([len(x.as_buffer()) // 2 for x in rows.column("docs")])
            pack, texts = np.repeat(np.arange(rows.num_rows), in_row), np.repeat(rows.column("texts").to_numpy(), in_row)
            train = docs < texts
            types, place = np.unique(keys, return_inverse=True)
            place = np.repeat(place, n)
            r = np.bincount(place, weights=train, minlength=len(types)).astype(np.int64)
            own = r[place]
            doc_key = pack << 16 | docs
            where, spot = np.unique(doc_key, return_inverse=True)
            packs = rows.column("pack").to_numpy()
            cuts = np.searchsorted(where >> 16, np.arange(rows.num_rows + 1))
            if kind == 1:
                a = np.bincount(spot, weights=np.log10(own + 1.0), minlength=len(where))
                b = np.bincount(spot, weights=own > 0, minlength=len(where))
                for i in range(rows.num_rows):
                    s = slice(cuts[i], cuts[i + 1])
                    out.append((5, int(packs[i]), packed(where[s] & 0xFFFF, np.uint16), packed(a[s], np.float64), packed(b[s], np.uint32), b""))
                continue
            before, after = types >> 32, types & 0xFFFFFFFF
            # Counts of counts, and the sums that a history's backoff weight needs.
            seen = r > 0
            out.append((2, 0, b"", packed(np.bincount(np.minimum(r[seen], K + 2), minlength=K + 3), np.int64), b"", b""))
            histories, spot_h = np.unique(before[seen], return_inverse=True)
            sums = np.zeros((len(histories), K + 2))
            for k in range(1, K + 1):
                sums[:, k - 1] = np.bincount(spot_h, weights=r[seen] == k, minlength=len(histories))
            sums[:, K] = np.bincount(spot_h, weights=np.where(r[seen] > K, r[seen], 0), minlength=len(histories))
            sums[:, K + 1] = np.bincount(spot_h, weights=words.p[after[seen]], minlength=len(histories))
            out.append((1, 0, packed(histories, np.int64), packed(sums, np.float64), b"", b""))
            # Terms: seen pairs by count up to K, larger ones by their logarithm, less the history's; unseen ones by the word's.
            h, w = before[place], after[place]
            fixed = np.where(own > 0, np.where(own > K, np.log10(np.maximum(own, 1)), 0.0) - np.where(own > 0, words.log_history[h], 0.0), words.log_p[w])
            a = np.bincount(spot, weights=fixed, minlength=len(where))
            by_count = np.stack([np.bincount(spot, weights=own == k, minlength=len(where)) for k in range(1, K + 1)], axis=1)
            unseen = np.flatnonzero(own == 0)
            unseen = unseen[np.argsort(doc_key[unseen], kind="stable")]
            ends = np.searchsorted(doc_key[unseen] >> 16, np.arange(rows.num_rows + 1))
            for i in range(rows.num_rows):
                s, u = slice(cuts[i], cuts[i + 1]), unseen[ends[i] : ends[i + 1]]
                out.append((0, int(packs[i]), packed(where[s] & 0xFFFF, np.uint16), packed(a[s], np.float64), packed(by_count[s], width_of(by_count[s])), packed(docs[u] << 32 | h[u], np.int64)))
        for row in table.filter(pa.array(kinds == 2)).to_pylist():
            out.append((4, row["pack"], row["keys"], b"", b"", b""))
        kind, pack, keys, a, b, c = zip(*out) if out else ((),) * 6
        return pa.table({"kind": pa.array(kind, pa.int32()), "bucket": pa.array([bucket] * len(kind), pa.int32()), "pack": pa.array(pack, pa.int64()), "keys": pa.array(keys, pa.binary()), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "c": pa.array(c, pa.binary())})

    return written(sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(count, TERMS), "katz-terms")


class Backoff:
    """Discounts of pairs, backoff weights of histories, and the counts of frequent pairs."""

    def __init__(self, words: Words, hot: np.ndarray, seen: np.ndarray, histories: np.ndarray, sums: np.ndarray):
        self.words, self.hot = words, hot
        n = np.bincount(np.minimum(hot[hot > 0], K + 2), minlength=K + 3) + seen
        self.discount = discounts(n)
        total = np.zeros((len(words.count), K + 2))
        np.add.at(total, histories, sums)
        for h in range(words.hot):
            r = hot[h]
            for k in range(1, K + 1):
                total[h, k - 1] += (r == k).sum()
            total[h, K] += r[r > K].sum()
            total[h, K + 1] += words.p[: words.hot][r > 0].sum()
        kept = total[:, :K] @ (self.discount[1:] * np.arange(1, K + 1)) + total[:, K]
        with np.errstate(divide="ignore", invalid="ignore"):
            left = 1.0 - kept / (words.count + RESERVE)
            rest = 1.0 - total[:, K + 1]
            #: Where all symbols have followed a history, there is nothing to back off to.
            self.log_alpha = np.log10(np.where(rest > 1e-12, left / rest, 1.0))
            self.log_rate = np.log10(self.discount * np.arange(K + 1))
        self.log_rate[0] = 0.0
        with np.errstate(divide="ignore"):
            own = np.log10(np.where(hot > K, hot, 1)) + self.log_rate[np.where(hot > K, 0, hot)]
        count = words.log_history[: words.hot][:, None]
        self.hot_terms = np.where(hot > 0, own - np.where(hot > 0, count, 0.0), self.log_alpha[: words.hot][:, None] + words.log_p[None, : words.hot])


def pack_sums(terms: DataFrame, shared, buckets: int) -> DataFrame:
    """Each document's terms from all buckets: ``(key, bucket_score, bucket_base, bucket_known)``."""

    def add(table: pa.Table) -> pa.Table:
        model: Backoff = shared.value
        kinds = table.column("kind").to_numpy()
        keys = numbers(table.filter(pa.array(kinds == 4)).column("keys"), np.int64)
        score, base, known = (np.zeros(len(keys)) for _ in range(3))
        for row in table.to_pylist():
            if row["kind"] == 0:
                docs = np.frombuffer(row["keys"], dtype=np.uint16)
                score[docs] += np.frombuffer(row["a"], dtype=np.float64) + np.frombuffer(row["b"], dtype=f"u{len(row['b']) // (K * len(docs))}").reshape(-1, K) @ model.log_rate[1:]
                unseen = np.frombuffer(row["c"], dtype=np.int64)
                np.add.at(score, unseen >> 32, model.log_alpha[unseen & 0xFFFFFFFF])
            elif row["kind"] == 5:
                docs = np.frombuffer(row["keys"], dtype=np.uint16)
                base[docs] += np.frombuffer(row["a"], dtype=np.float64)
                known[docs] += np.frombuffer(row["b"], dtype=np.uint32)
        return pa.table({"key": pa.array(keys), "s": pa.array(score), "b": pa.array(base), "k": pa.array(known)})

    rows = terms.where("kind in (0, 4, 5)").repartition(buckets, "pack")
    return rows.groupBy("pack").applyInArrow(add, "key long, s double, b double, k double")


def history_sums(terms: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """What each history's backoff weight needs, added up over buckets: at most one short row for each symbol."""
    names = [f"s{k}" for k in range(K + 2)]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, a in zip(batch.column("keys"), batch.column("a")):
                sums = np.frombuffer(a.as_buffer(), dtype=np.float64).reshape(-1, K + 2)
                yield pa.record_batch([pa.array(np.frombuffer(keys.as_buffer(), dtype=np.int64)), *(pa.array(c) for c in sums.T.copy())], names=["h", *names])

    rows = terms.where("kind = 1").select("keys", "a").mapInArrow(unpack, ", ".join(["h long", *(f"{n} double" for n in names)]))
    found = rows.groupBy("h").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    return found.column("h").to_numpy(), np.stack([found.column(n).to_numpy() for n in names], axis=1)


def score_texts(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every document."""
    spark = documents.sparkSession
    fold = f"coalesce(crc32(cast(id as string)) % {FOLDS} = {HELD_OUT}, false)"
    docs = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    docs = docs.select("id", "text", F.expr(f"not {fold}").alias("train"), F.xxhash64("id", "text").alias("key"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_BUCKETS, -(-size // BUCKET_BYTES)))
    words = count_words(docs, buckets)
    shared_words = spark.sparkContext.broadcast(words)
    hot = count_hot(docs, shared_words)
    terms = count_pairs(send_pairs(docs, shared_words, buckets), shared_words, buckets)
    seen = np.zeros(K + 3, dtype=np.int64)
    for r in terms.where("kind = 2").select("a").collect():  # one short row a bucket
        seen = seen + np.frombuffer(r["a"], dtype=np.int64)
    histories, sums = history_sums(terms)
    shared = spark.sparkContext.broadcast(Backoff(words, hot, seen, histories, sums))

    def own_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Third pass: what a task can say itself."""
        model: Backoff = shared.value
        words = model.words
        for batch in batches:
            for part in at.slices(batch, "text"):
                before, after, _, offsets = pairs_of(words, part.column("text"))
                hot = (before < words.hot) & (after < words.hot)
                score = np.zeros(len(after))
                score[hot] = model.hot_terms[before[hot], after[hot]]
                symbol = after != CLASS
                base = np.where(symbol, np.log10(words.count[after] + 1), 0.0)
                sums = [np.add.reduceat(x, offsets[:-1]) if len(x) else x for x in (score, base, symbol & (words.count[after] > 0), after == CLASS)]
                yield pa.record_batch({"id": part.column("id"), "key": part.column("key"), "train": part.column("train"), "n_tokens": pa.array(np.diff(offsets), pa.int64()), "s": pa.array(sums[0], pa.float64()), "b": pa.array(sums[1], pa.float64()), "k": pa.array(sums[2].astype(np.float64)), "of_class": pa.array(sums[3].astype(np.float64))})

    own = docs.mapInArrow(own_terms, "id long, key long, train boolean, n_tokens long, s double, b double, k double, of_class double")
    # Equal rows share a key: their sums come together and are shared out again.
    others = pack_sums(terms, shared, buckets).groupBy("key").agg(F.sum("s").alias("os"), F.sum("b").alias("ob"), F.sum("k").alias("ok"), F.count("*").alias("copies"))
    found = own.join(others, "key", "left")
    share = lambda c: F.coalesce(F.col(c) / F.col("copies"), F.lit(0.0))
    log_total = math.log10(words.tokens + words.types + 1)
    log_class = math.log10(words.class_tokens + words.class_types + 1)
    return found.select(
        "id", (~F.col("train")).alias("held_out"), "n_tokens", F.round(F.col("k") + share("ok")).cast("long").alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("b") + share("ob") - F.col("n_tokens") * log_total).alias("base_score"),
        (F.col("s") + share("os") + share("ob") - F.col("of_class") * log_class).alias("score"),
    )


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
