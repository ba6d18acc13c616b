"""N-gram Jaccard join: a size-aware heavy-light join on word shingles.

Small sets meet through every fixed-size subset that a partner would have to
share; large sets meet by scanning inverted lists of their rarest shingles.
The size that parts the two is the one with the least estimated cost. Every
candidate is checked on the full sets, so the links are exact (but for equal
64-bit hashes of different shingles).

Edge cases: a null or blank text has no shingles, is linked with nothing and
is its own component; a text with fewer words than a shingle has its whole
word sequence as its only shingle; repeated rows and equal texts are one class
and so linked; an empty table gives an empty result; other columns are
ignored by the join and kept by the filter. Rows with a null id are left out,
as they can't be named in a pair; an id that stands on different texts takes
the smallest of their components, without joining them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.llm import arrowtext as at
from oddsloom.llm.cluster import checkpointed, connected_components, sliced, summed, written

SKETCH_WIDTH = 1 << 20
SKETCH_SLICES = 64
#: Subsets are listed for sets of at most this size, whatever the costs say.
SUBSETS_UP_TO = 24
#: Counters in a set's profile, from which an upper bound of an intersection is read.
PROFILE = 256
#: Up to so many ids (8 to 64 bytes each) a list of documents is broadcast; beyond that it is joined by a shuffle.
BROADCAST_IDS = 250_000


def need(n: int, m: int, percent: int) -> int:
    """Smallest intersection of sets of ``n`` and ``m`` items with 100 * intersection >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def partner_sizes(n: int, percent: int) -> range:
    """Sizes that a linked set can have."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subset_sizes(n: int, percent: int) -> list[int]:
    return sorted({need(n, m, percent) for m in partner_sizes(n, percent)})


def prefix_length(n, percent: int):
    """So many of a set's first shingles, in one order for all, hold one that any linked set shares in its own."""
    return n - (percent * n + 99) // 100 + 1


def text_sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text and their row offsets."""
    words, codes, offsets = at.split_words(batch.column("text"))
    hashed = at.hash_words(words)[codes] if len(words) else np.zeros(0, dtype=np.uint64)
    return at.distinct_per_row(*at.shingle_hashes(hashed, offsets, width))


def sketch_of(documents: DataFrame, width: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How often shingles occur, by bucket of a fixed-size table, and how many sets have each small size.

    Every task sends one table of ``SKETCH_WIDTH`` counters in slices.
    """
    size = SKETCH_WIDTH // SKETCH_SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SKETCH_WIDTH, dtype=np.int64)
        small = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for part in at.slices(batch, "text"):
                values, offsets = text_sets(part, width)
                table += np.bincount((values & np.uint64(SKETCH_WIDTH - 1)).astype(np.int64), minlength=SKETCH_WIDTH)
                small += np.bincount(np.minimum(np.diff(offsets), SUBSETS_UP_TO + 8), minlength=size)
        if small.any():
            yield sliced([*table.reshape(SKETCH_SLICES, size), small])

    tables = documents.select("text").mapInArrow(count, "slice int, part long, counts binary")
    found = summed(tables, documents.rdd.getNumPartitions())
    if not found:
        return np.zeros(SKETCH_WIDTH, dtype=np.int64), np.zeros(size, dtype=np.int64)
    return np.concatenate([found[k] for k in range(SKETCH_SLICES)]), found[SKETCH_SLICES]


def cheapest_boundary(small: np.ndarray, sketch: np.ndarray, percent: int) -> int:
    """Largest set size for which subsets are listed: the one with the least total cost.

    A small set costs one row for each subset; a large one costs, for each
    shingle of its prefix, a row and the scan of a list. The length of such a
    list is taken from the counters that rare shingles fall in, less what a
    counter holds by chance.
    """
    total = sketch.sum()
    if not total:
        return 0
    ordered = np.sort(sketch)
    rare = ordered[np.searchsorted(np.cumsum(ordered), total * (1 - percent / 100))]
    scan = 1 + max(1.0, float(rare) - total / SKETCH_WIDTH)
    sizes = range(1, SUBSETS_UP_TO + 1)
    light = {n: small[n] * sum(math.comb(n, c) for c in subset_sizes(n, percent)) for n in sizes}
    heavy = {n: small[n] * prefix_length(n, percent) * scan for n in sizes}
    cost = lambda x: sum(light[n] if n <= x else heavy[n] for n in sizes)
    return min(range(SUBSETS_UP_TO + 1), key=lambda x: (cost(x), x))


def keyed_sets(documents: DataFrame, width: int, percent: int, sketch: np.ndarray, boundary: int) -> DataFrame:
    """One row per document: its set's size, digest and the keys it can meet others by.

    ``keys`` holds, for a small set, a hash of each subset, and for a large one
    (or one small enough to be linked with a large one) the prefix of its
    shingles in order of rising frequency. ``places`` holds a shingle's place
    in that order, or -1 for a subset. ``profile`` counts the shingles by some
    of their hash's bits.
    """
    table = documents.sparkSession.sparkContext.broadcast(np.minimum(sketch, np.iinfo(np.int32).max).astype(np.int32))
    lists_from = -(-percent * (boundary + 1) // 100)
    by_size = {n: subset_sizes(n, percent) for n in range(1, boundary + 1)}

    def keys_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(values)
        keys, places = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int32)]
        if 0 < n <= boundary:
            mixed = at.mix64(values)
            for c in by_size[n]:
                sums = np.array([mixed[list(x)].sum(dtype=np.uint64) for x in combinations(range(n), c)], dtype=np.uint64)
                keys.append(at.mix64(sums + np.uint64(c)))
                places.append(np.full(len(sums), -1, dtype=np.int32))
        if n >= lists_from and n:
            count = table.value[(values & np.uint64(SKETCH_WIDTH - 1)).astype(np.int64)]
            first = np.lexsort((values, count))[: prefix_length(n, percent)]
            keys.append(values[first])
            places.append(np.arange(len(first), dtype=np.int32))
        return np.concatenate(keys), np.concatenate(places)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in at.slices(batch, "text"):
                values, offsets = text_sets(part, width)
                digests, keys, places, profiles = [], [], [], []
                for start, end in zip(offsets[:-1], offsets[1:]):
                    own = values[start:end]
                    digests.append(digest_of(own))
                    profiles.append(np.minimum(np.bincount((own >> np.uint64(40)).astype(np.int64) % PROFILE, minlength=PROFILE), 255).astype(np.uint8).tobytes())
                    k, p = keys_of(own)
                    keys.append(k)
                    places.append(p)
                at_key = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
                yield pa.record_batch({
                    "id": part.column("id"),
                    "n": pa.array(np.diff(offsets), pa.int64()),
                    "digest": pa.array(digests, pa.binary()),
                    "profile": pa.array(profiles, pa.binary()),
                    "keys": at.list_array(at.as_long(np.concatenate(keys)), at_key, pa.int64()),
                    "places": at.list_array(np.concatenate(places), at_key, pa.int32()),
                })

    return documents.mapInArrow(describe, "id long, n long, digest binary, profile binary, keys array<long>, places array<int>")


def possible(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose profiles allow an intersection that is large enough.

    Two sets share at most the smaller of their counts in each counter; a full
    counter (255) bounds nothing, so the other one counts.
    """
    left, right = (profiles.select(F.col("class").alias(i), F.col("n").alias(n), F.col("profile").alias(p)) for i, n, p in (("a", "n", "x"), ("b", "m", "y")))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, PROFILE).astype(np.int64) for c in "xy")
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            top = np.minimum(x, y)
            top[(x == 255) & (y == 255)] = np.iinfo(np.int32).max
            most = top.sum(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * most >= percent * (n + m)))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(bound, "a long, b long")


def with_sets(documents: DataFrame, classes: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """The distinct shingle hashes, as ``(class, items)``, of the classes in ``pairs``, each read from one of its documents."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in at.slices(batch, "text"):
                values, offsets = text_sets(part, width)
                # An id may stand on other texts too.
                own = [digest_of(values[a:b]) == d for a, b, d in zip(offsets[:-1], offsets[1:], part.column("digest").to_pylist())]
                yield pa.record_batch({"class": part.column("class"), "items": at.list_array(at.as_long(values), offsets, pa.int64())}).filter(pa.array(own, pa.bool_()))

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    wanted = listed(classes.join(wanted, "class", "left_semi"))
    return documents.join(wanted, "id").select("text", "class", "digest").mapInArrow(sets, "class long, items array<long>")


def digest_of(values: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None


def listed(rows: DataFrame) -> DataFrame:
    """A list of ids, broadcast if it was counted to be short."""
    rows = checkpointed(rows)
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are similar enough, counted on the whole sets."""
    left, right = sets.select(F.col("class").alias("a"), F.col("items").alias("x")), sets.select(F.col("class").alias("b"), F.col("items").alias("y"))

    common = F.size(F.array_intersect("x", "y"))
    close = 100 * common >= percent * (F.size("x") + F.size("y") - common)
    return pairs.join(left, "a").join(right, "b").where(close).select("a", "b").distinct()


def representatives(table: DataFrame) -> DataFrame:
    """One row for each distinct set: ``(digest, id, class, n, profile, keys, places)`` of its document with the smallest id.

    Copies meet in a partial aggregate before anything is shuffled. A class's
    number is its smallest id; only where several classes have one smallest id
    (it stands on different texts) is it a hash of the digest.
    """
    first = F.min_by(F.struct("n", "profile", "keys", "places"), "id")
    reps = written(table.where("n > 0").groupBy("digest").agg(F.min("id").alias("id"), first.alias("own")).select("digest", "id", "own.*"), "jaccard-classes")
    clashes = checkpointed(reps.groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("clash")))
    if clashes.isEmpty():
        return reps.withColumn("class", F.col("id"))
    return written(reps.join(clashes, "id", "left").withColumn("class", F.when(F.col("clash"), F.xxhash64("digest")).otherwise(F.col("id"))).drop("clash"), "jaccard-classes")


def star_pairs(lists: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """Candidates of every list's first class with its others."""
    heads = profiles.select(F.col("class").alias("a"), F.col("n").alias("m"))
    pairs = lists.where("class <> head").select(F.col("head").alias("a"), F.col("class").alias("b"), "n").distinct()
    return possible(pairs.join(heads, "a").where(size_fits("n", "m", percent)).select("a", "b"), profiles, percent)


def size_fits(n: str, m: str, percent: int):
    return F.expr(f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})")


def open_pairs(lists: DataFrame, labels: DataFrame, tried: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """Candidates from different components, of the lists that still hold more than one, but for those already ``tried``."""
    labelled = lists.join(labels, "class", "left").select("key", "class", "n", "place", F.coalesce("component", "class").alias("label"))
    several = labelled.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count("*").alias("k")).where("l < h and k > 2").select("key")
    left = checkpointed(labelled.join(several, "key", "left_semi"))
    right = left.select("key", F.col("class").alias("b"), F.col("n").alias("m"), F.col("place").alias("place_b"), F.col("label").alias("label_b"))
    # Two sets that first meet at these places of their prefixes share at most what is left of them.
    rest_fits = F.expr(f"place < 0 or least(n - place, m - place_b) * {100 + percent} >= {percent} * (n + m)")
    apart = F.expr("class < b and label <> label_b")
    pairs = left.join(right, "key").where(apart & size_fits("n", "m", percent) & rest_fits).select(F.col("class").alias("a"), "b").distinct()
    return possible(pairs.join(tried, ["a", "b"], "left_anti"), profiles, percent)


def over_components(links: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` after further ``links``: the components that these join become one."""
    of_a = labels.select(F.col("class").alias("a"), F.col("component").alias("la"))
    of_b = labels.select(F.col("class").alias("b"), F.col("component").alias("lb"))
    between = links.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    above = connected_components(between).select(F.col("id").alias("component"), F.col("component").alias("top"))
    # A class that had no link before is a component of its own.
    new = links.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(labels, "class", "left_anti")
    known = labels.union(new.select("class", F.col("class").alias("component")))
    return known.join(above, "component", "left").select("class", F.coalesce("top", "component").alias("component"))


def jaccard_classes(documents: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The join on ``documents (id, text)``: their table ``(id, n, digest, ...)``, and ``(id, digest, component)`` of those with shingles.

    Equal sets become one class at once. Every key's list is then checked
    against its first member (a star), and components are found; only lists
    that still hold members of different components are scanned in full, and
    there only pairs from different components. So a list of thousands of near
    copies costs a row a member, and no link that could join two components is
    passed over. A component's number is its smallest class.
    """
    at.small_batches(documents.sparkSession)
    sketch, small = sketch_of(documents, width, percent)
    boundary = cheapest_boundary(small, sketch, percent)
    table = written(keyed_sets(documents, width, percent, sketch, boundary), "jaccard-keys")
    reps = representatives(table)
    classes, profiles = reps.select("digest", "id", "class"), reps.select("class", "n", "profile")

    entry = reps.select("class", "n", F.explode(F.arrays_zip("keys", "places")).alias("e")).select(F.col("e.keys").alias("key"), "class", "n", F.col("e.places").alias("place"))
    heads = entry.groupBy("key").agg(F.min("class").alias("head"), F.count("*").alias("k")).where("k > 1")
    lists = checkpointed(entry.join(heads, "key"))
    stars = checkpointed(star_pairs(lists, profiles, percent))
    near = checkpointed(linked(stars, with_sets(documents, classes, stars, width), percent))
    labels = checkpointed(connected_components(near).withColumnRenamed("id", "class"))
    rest = checkpointed(open_pairs(lists, labels, stars, profiles, percent))
    more = checkpointed(linked(rest, with_sets(documents, classes, rest, width), percent))
    labels = over_components(more, labels)

    of_class = classes.join(labels, "class", "left").select("digest", F.coalesce("component", "class").alias("component"))
    return table, table.where("n > 0").select("id", "digest").join(of_class, "digest")


def jaccard_components(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """Components of the similarity join: ``(id, n_shingles, component_id)`` for every document.

    Two documents are linked when 100 * |A & B| >= percent * |A | B| for their
    sets of ``width``-word shingles; ``component_id`` is the smallest id that
    can be reached.
    """
    docs = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).where("id is not null")
    table, members = jaccard_classes(docs, width, percent)
    members = checkpointed(members)
    # A class's number is its smallest id, but where ids clash.
    least = members.groupBy("component").agg(F.min("id").alias("least")).where("least <> component")
    found = members.join(least, "component", "left").groupBy("id").agg(F.min(F.coalesce("least", "component")).alias("component"))
    return table.select("id", "n").join(found, "id", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def without_near_copies(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents`` but for near copies: of each component one row stays, that with the smallest id.

    Rows without an id and rows without words stay. Where an id stands on
    several rows, each text counts by itself: a row goes only if its own text
    is a near copy of one that stays. Of rows with one id and equal sets, that
    with the smallest hash of all its columns stays. All columns stay, whatever
    they are called.
    """
    given = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"), F.struct(*[F.col(f"`{n}`") for n in documents.columns]).alias("row"))
    table, members = jaccard_classes(given.select("id", "text").where("id is not null"), width, percent)
    members = checkpointed(members)
    repeated = checkpointed(table.groupBy("id").count().where("count > 1").select("id"))
    if repeated.isEmpty():
        gone = listed(members.where("id <> component").select("id"))
        return given.join(gone, "id", "left_anti").select("row.*")
    first = members.groupBy("component").agg(F.min(F.struct("id", "digest")).alias("first"))
    gone = checkpointed(members.join(first, "component").where(F.struct("id", "digest") != F.col("first")).select("id", "digest").distinct())
    repeated = listed(repeated)
    once = given.join(repeated, "id", "left_anti").join(listed(gone.select("id").distinct()), "id", "left_anti")

    def digests(texts: pa.Array) -> pa.Array:
        values, offsets = text_sets(pa.record_batch({"text": texts}), width)
        return pa.array([digest_of(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())

    several = given.join(repeated, "id", "left_semi").withColumn("digest", at.text_udf(lambda: digests, "binary")(F.col("text")))
    several = several.join(listed(gone), ["id", "digest"], "left_anti")
    single = several.where("digest is not null").groupBy("id", "digest").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return once.select("row.*").union(several.where("digest is null").select("row.*")).union(single.select("row.*"))


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(documents, "doc_id", "text", width=3, percent=90).withColumnRenamed("id", "doc_id")
