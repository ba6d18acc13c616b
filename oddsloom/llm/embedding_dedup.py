"""Embedding near-duplicates: random-hyperplane sign hashing, exact cosines, connected components.

Every vector gets one bucket in each of several tables: the signs of its
products with random hyperplanes. Vectors that share a bucket are compared by
their exact cosine in double precision.

Bitwise equal vectors are one class at once, and only one of a class is
hashed. The number of planes of a table follows the number of classes, so that
a bucket's expected size stays the same at every input size; the number of
tables follows from the planes and the recall asked for at the threshold
itself. A bucket that is large all the same (a dense group) is cut into
blocks and every pair of blocks is compared, so no pair is passed over.

Edge cases: vectors that are null, empty, zero or that hold null or non-finite
components link with nothing and are their own component; vectors of different
lengths are never compared; repeated rows are copies of one class; an empty
table gives an empty result; other columns are ignored. Rows with a null id
are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.llm.arrowtext import small_batches
from oddsloom.llm.cluster import connected_components, written

THRESHOLD = 0.9
RECALL = 0.97
BUCKET_SIZE = 256
BLOCK = 1024
#: So close to the threshold a cosine is computed again.
BORDER = 1e-9
SEED = 20_011


def table_plan(classes: int, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET_SIZE) -> tuple[int, int]:
    """Planes in a table and tables, for so many vectors.

    A pair at the threshold falls into one bucket of a table with probability
    (1 - angle / pi) ** planes.
    """
    planes = min(48, max(4, math.ceil(math.log2(max(2, classes / bucket)))))
    same = (1 - math.acos(threshold) / math.pi) ** planes
    return planes, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def planes_for(length: int, planes: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, length]).standard_normal((length, planes * tables))


def rows_of(column: pa.Array) -> list[np.ndarray]:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    offsets = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def hashed(vectors: DataFrame, planes: int, tables: int) -> DataFrame:
    """``(id, vector, length, buckets)``: a bucket for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = rows_of(batch.column("vector"))
            buckets = np.zeros((len(rows), tables), dtype=np.int64)
            for length, which in by_length(rows).items():
                if length not in made:
                    made[length] = planes_for(length, planes, tables)
                signs = (np.stack([rows[i] for i in which]) @ made[length] >= 0).reshape(len(which), tables, planes)
                buckets[which] = signs @ (1 << np.arange(planes, dtype=np.int64))
            offsets = np.arange(len(rows) + 1, dtype=np.int32) * tables
            yield pa.record_batch({"id": batch.column("id"), "vector": batch.column("vector"), "copies": batch.column("copies"), "length": pa.array([len(r) for r in rows], pa.int32()), "buckets": pa.ListArray.from_arrays(pa.array(offsets), pa.array(buckets.reshape(-1)))})

    kind = vectors.schema["vector"].dataType.simpleString()
    return vectors.select("id", "vector", "copies").mapInArrow(run, f"id long, vector {kind}, copies long, length int, buckets array<long>")


def by_length(rows: list[np.ndarray]) -> dict[int, list[int]]:
    found: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        found.setdefault(len(r), []).append(i)
    return found


def close(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each row of ``left`` and each of ``right`` have a cosine of at least ``threshold``.

    One matrix product of unit vectors decides, but for pairs next to the
    threshold: their cosine is the product over the root of both squares, taken
    of the vectors as they are (scaled by powers of two, which changes no digit).
    """
    x, y = (v / np.exp2(np.frexp(np.abs(v).max(axis=1))[1])[:, None] for v in (left, right))
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    cosine = (x / np.sqrt(xx)[:, None]) @ (y / np.sqrt(yy)[:, None]).T
    found = cosine >= threshold
    i, j = np.nonzero(np.abs(cosine - threshold) < BORDER)
    for k in range(0, len(i), BLOCK * BLOCK // 8):
        a, b = i[k : k + BLOCK * BLOCK // 8], j[k : k + BLOCK * BLOCK // 8]
        found[a, b] = (x[a] * y[b]).sum(axis=1) / np.sqrt(xx[a] * yy[b]) >= threshold
    return found


def smallest_reached(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of a bipartite graph's rows and columns: the smallest of the given ones that can be reached."""
    while True:
        low = np.minimum(right, np.where(links, left[:, None], np.iinfo(np.int64).max).min(axis=0, initial=np.iinfo(np.int64).max))
        up = np.minimum(left, np.where(links, low[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
        if np.array_equal(low, right) and np.array_equal(up, left):
            return left, right
        left, right = up, low


def links_and_edges(vectors: DataFrame, planes: int, tables: int, threshold: float) -> DataFrame:
    """Rows ``(class, links, root)`` that add up to each class's links, and whose edges have the graph's components.

    ``vectors`` has ``id`` (the class), ``vector`` and ``copies``. Buckets of up
    to ``BLOCK`` vectors are one group. A larger one is cut into blocks, by the
    hash of the class, and each pair of blocks is a group, so a group never
    holds more than about two blocks. A group sends one row for each of its
    vectors, however many links it has: the copies it is linked with for the
    first time (a pair counts in the first table in which it shares a bucket),
    and the smallest class it reaches in the group.
    """
    made = hashed(vectors, planes, tables)
    entries = made.select("id", "vector", "copies", "length", F.posexplode("buckets").alias("table", "bucket"), "buckets")
    # Only what earlier tables say is asked for.
    entries = entries.withColumn("buckets", F.expr("slice(buckets, 1, table)"))
    key = ["table", "length", "bucket"]
    sizes = made.select("length", F.posexplode("buckets").alias("table", "bucket")).groupBy(*key).agg(F.count("*").alias("k")).where("k > 1")
    sizes = sizes.select(*key, F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"))
    entries = entries.join(sizes, key).withColumn("own", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
    groups = F.expr("transform(sequence(0, blocks - 1), x -> named_struct('lo', least(x, own), 'hi', greatest(x, own)))")
    entries = entries.select("*", F.explode(groups).alias("g"))
    entries = entries.select("table", "length", "bucket", F.expr("g.lo").alias("lo"), F.expr("g.hi").alias("hi"), "id", "copies", "vector", "buckets", F.expr("if(own = g.lo, 0, 1)").alias("side"))

    def compare(group: pa.Table) -> pa.Table:
        ids, side, copies = (group.column(c).to_numpy() for c in ("id", "side", "copies"))
        table, one = group.column("table")[0].as_py(), group.column("lo")[0] == group.column("hi")[0]
        data = np.stack(rows_of(group.column("vector").combine_chunks()))
        shared = group.column("buckets").combine_chunks().flatten().to_numpy().reshape(len(ids), table)
        x = np.flatnonzero(side == 0)
        y = x if one else np.flatnonzero(side == 1)
        found = close(data[x], data[y], threshold)
        if one:
            found &= ~np.eye(len(x), dtype=bool)
        roots = smallest_reached(found, ids[x], ids[y])
        for t in range(table):
            found &= shared[x, t][:, None] != shared[y, t][None, :]
        sums = [found @ copies[y].astype(np.float64), copies[x].astype(np.float64) @ found]
        if one:
            parts = [(ids[x], sums[0], np.minimum(*roots))]
        else:
            parts = [(ids[x], sums[0], roots[0]), (ids[y], sums[1], roots[1])]
        own, links, root = (np.concatenate(c) for c in zip(*parts))
        keep = (links > 0) | (root != own)
        return pa.table({"class": pa.array(own[keep], pa.int64()), "links": pa.array(np.rint(links[keep]).astype(np.int64)), "root": pa.array(root[keep], pa.int64())})

    return entries.groupBy("table", "length", "bucket", "lo", "hi").applyInArrow(compare, "class long, links long, root long")


def embedding_components(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """Near-duplicates of every vector: ``(id, n_links, component_id, kept)``.

    ``n_links`` counts the other vectors with a cosine of at least
    ``threshold`` that were found, copies included; ``component_id`` is the
    smallest id that can be reached; ``kept`` marks it.
    """
    small_batches(vectors.sparkSession)
    kind = vectors.select(F.col(vector_column).alias("v")).schema["v"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"  # floats travel as floats
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast(kind).alias("vector")).where("id is not null")
    finite = F.expr("vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vector, x -> x <> 0)")
    keyed = rows.withColumn("digest", F.when(finite, F.expr("sha2(cast(array_join(transform(vector, x -> hex(cast(x as string))), ',') as binary), 256)")))
    table = written(keyed, "embedding-rows")
    # Copies meet in a partial aggregate before anything is shuffled.
    classes = written(table.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.min_by("vector", "id").alias("vector")), "embedding-classes")
    # A class's number is its smallest id, or, where several have the same (it stands on different vectors), a hash.
    clashes = written(classes.groupBy("rep").count().where("count > 1").select("rep", F.lit(True).alias("clash")), "embedding-clashes")
    classes = classes.join(clashes, "rep", "left").withColumn("class", F.when(F.col("clash"), F.xxhash64("digest")).otherwise(F.col("rep")))
    planes, tables = table_plan(classes.count(), threshold)
    found = written(links_and_edges(classes.select(F.col("class").alias("id"), "vector", "copies"), planes, tables, threshold), "embedding-links")

    links = found.groupBy("class").agg(F.sum("links").alias("others"))
    labels = connected_components(found.select(F.col("class").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("class"), "component")
    per_class = classes.join(links, "class", "left").join(labels, "class", "left").select("digest", "rep", F.expr("copies - 1 + coalesce(others, 0)").alias("n_links"), F.coalesce("component", "class").alias("label"))
    if not clashes.isEmpty():
        least = per_class.groupBy("label").agg(F.min("rep").alias("least"))
        per_class = per_class.join(least, "label").drop("label").withColumnRenamed("least", "label")
    found = table.select("id", "digest").join(per_class.select("digest", "n_links", F.col("label").alias("component_id")), "digest", "left")
    found = found.select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return found.withColumn("kept", F.col("id") == F.col("component_id"))


def op10_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
