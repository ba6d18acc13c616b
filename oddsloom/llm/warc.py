"""WARC archives: a deterministic sharded writer and a reader.

The writer range-sorts the pages by id, cuts them into shards of about equal
bytes, and writes each shard as one or more files, rolled by compressed size.
Headers and digests are made anew. A file is written under a temporary name,
moved to its own, and counts only when the manifest, written last, names it;
so a task that runs twice writes the same file twice and a task that dies
leaves nothing that a reader sees. Shards, files and bytes depend on the rows
alone, not on the cluster.

Of the records with equal payloads of at least ``REVISIT_BYTES`` bytes, those
with the smallest id are ``response`` and all others ``revisit``.

Edge cases: a null html is an empty payload; a null url is left out of the
headers; a null id sorts first and is kept; rows repeated with the smallest id
are all ``response``; a payload of any length is one record; an empty table
gives a manifest without files; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from oddsloom.llm.cluster import new_folder, written

REVISIT_BYTES = 100
#: A shard holds about this much payload, or as much as makes ``MAX_SHARDS`` shards.
SHARD_BYTES = 8 << 20
MAX_SHARDS = 16_384
#: A file is closed once its compressed bytes reach this part of a shard's payload, or ``FILE_BYTES``.
FILE_PART, FILE_BYTES = 16, 1 << 30
#: A task writes about this much payload where that makes more tasks than the cores ask for.
TASK_BYTES = 1 << 30
#: A page's place in the order; a null id comes first.
ID = "coalesce(page_id, -9223372036854775808)"
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "shard int, file string, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(uri: str | None) -> int | None:
    return None if uri is None or uri == record_id(None) else int(uri.removeprefix("<urn:page:").removesuffix(">"))


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own; the same bytes for the same record."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers).encode()
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + lines + b"Content-Length: %d\r\n\r\n" % len(block)) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, first: int | None, first_url: str | None, revisit: bool) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (b"" if revisit else payload)
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", clean(url)))
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first)), ("WARC-Refers-To-Date", DATE)]
        if first_url is not None:
            headers.append(("WARC-Refers-To-Target-URI", clean(first_url)))
    return member(headers, block)


def clean(value: str) -> str:
    """A header's value ends at its line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


class ShardFile:
    """A file of a shard: temporary until ``close`` moves it to its name."""

    def __init__(self, where: str, shard: int, number: int, attempt: int):
        self.store, base = fs.FileSystem.from_uri(where)
        self.shard, self.name = shard, f"pages-{shard:05d}-{number:04d}.warc.gz"
        self.path, self.temporary = f"{base}/{self.name}", f"{base}/_temporary-{attempt}-{self.name}"
        self.out = self.store.open_output_stream(self.temporary, compression=None)
        self.digest, self.bytes, self.records = hashlib.sha256(), 0, 0
        self.add(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{self.name}>"), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self.records = 0

    def add(self, data: bytes) -> None:
        self.out.write(data)
        self.digest.update(data)
        self.bytes += len(data)
        self.records += 1

    def close(self) -> tuple:
        self.out.close()
        self.store.move(self.temporary, self.path)
        return self.shard, self.name, self.records, self.bytes, self.digest.hexdigest()


def shard_starts(meta: DataFrame, shard_bytes: int) -> tuple[list[int], int, int]:
    """First id of every shard but the first (at most ``MAX_SHARDS`` values), a shard's bytes, and all bytes.

    Ids are range-partitioned, running sums are taken inside each range, and
    the ranges' totals, one short row each, are added up here. The sums don't
    depend on where the ranges end, and no task orders more than its range,
    however sparse the ids are.
    """
    spark = meta.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = meta.groupBy(F.expr(ID).alias("id")).agg(F.sum("payload_bytes").alias("bytes"))
    ids = written(ids.repartitionByRange(ranges, "id").withColumn("range", F.spark_partition_id()), "warc-ids")
    totals = sorted((r["least"], r["range"], r["all"]) for r in ids.groupBy("range").agg(F.min("id").alias("least"), F.sum("bytes").alias("all")).collect())
    ends = list(accumulate(n for _, _, n in totals))
    whole = ends[-1] if ends else 0
    size = max(shard_bytes, -(-whole // MAX_SHARDS), 1)
    if whole <= size:
        return [], size, whole
    before = spark.createDataFrame(pa.table({"range": pa.array([r for _, r, _ in totals], pa.int32()), "before": pa.array([0, *ends[:-1]], pa.int64())}))
    inside = ids.withColumn("inside", F.sum("bytes").over(Window.partitionBy("range").orderBy("id")) - F.col("bytes"))
    shards = inside.join(F.broadcast(before), "range").select("id", F.expr(f"(before + inside) div {size}").alias("shard"))
    starts = shards.groupBy("shard").agg(F.min("id").alias("start")).collect()
    return sorted(r["start"] for r in starts)[1:], size, whole


def write_warc(pages: DataFrame, where: str, shard_bytes: int = SHARD_BYTES, file_bytes: int | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives in the folder ``where``; returns the manifest.

    ``where`` must be a folder that all executors share. Payloads move once, to
    their shard; digests and decisions travel apart from them and are merged
    with the sorted rows inside the task. Without ``file_bytes`` the size at
    which files roll follows that of the shards, which grows with the pages.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    meta = written(rows.select("page_id", "url", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("digest")), "warc-meta")
    first = meta.where(f"payload_bytes >= {REVISIT_BYTES}").groupBy("digest").agg(F.count("*").alias("k"), F.min(F.struct("page_id", "url")).alias("first")).where("k > 1")
    # Revisits only: a few bytes for each, joined by digest.
    revisits = meta.where(f"payload_bytes >= {REVISIT_BYTES}").join(first, "digest").where("not (page_id <=> first.page_id)")
    revisits = revisits.groupBy("page_id", "digest").agg(F.min("first").alias("first"))

    found, shard_size, whole = shard_starts(meta, shard_bytes)
    starts = np.array(found, dtype=np.int64)
    if file_bytes is None:
        file_bytes = min(FILE_BYTES, -(-shard_size // FILE_PART))

    @F.pandas_udf(T.IntegerType())
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, ids.to_numpy(), side="right").astype(np.int32))

    def placed(frame: DataFrame) -> DataFrame:
        return frame.withColumn("shard", shard_of(F.expr(ID)))

    notes = placed(revisits).select("shard", "page_id", F.lit(0).alias("kind"), "digest", F.col("first.page_id").alias("first"), F.col("first.url").alias("url"), F.lit(None).cast("binary").alias("payload"))
    records = placed(rows).select("shard", "page_id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("first"), "url", "payload")
    parts = min(len(starts) + 1, max(4 * spark.sparkContext.defaultParallelism + 8, -(-whole // TASK_BYTES)))
    ordered = notes.unionByName(records).repartition(parts, "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "kind", "url", "digest", F.expr("xxhash64(payload)"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt, done, out, note_page, notes_now, number = TaskContext.get().taskAttemptId(), [], None, None, {}, 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("shard", "page_id", "kind", "digest", "first", "url", "payload"))):
                shard, page_id, kind, digest, first_id, url = (x.as_py() for x in row[:6])
                if notes_now and note_page != (page_id,):
                    notes_now = {}
                if kind == 0:
                    note_page = (page_id,)
                    notes_now[digest] = (first_id, url)
                    continue
                payload = row[6].as_py()
                if out is not None and (out.shard != shard or out.bytes >= file_bytes):
                    number = number + 1 if out.shard == shard else 0
                    done.append(out.close())
                    out = None
                if out is None:
                    number = number if done and done[-1][0] == shard else 0
                    out = ShardFile(where, shard, number, attempt)
                own = hashlib.sha256(payload).hexdigest()
                of = notes_now.get(own)
                out.add(page_record(page_id, url, payload, len(payload), own, *(of or (None, None)), of is not None))
        if out is not None:
            done.append(out.close())
        if done:
            yield pa.record_batch([pa.array(c) for c in zip(*done)], schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    store, base = fs.FileSystem.from_uri(where)
    store.create_dir(base, recursive=True)
    manifest = ordered.mapInArrow(write, MANIFEST)
    manifest.write.mode("overwrite").json(f"{where}/manifest")
    return spark.read.schema(MANIFEST).json(f"{where}/manifest")


def members(stream) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member of a stream."""
    offset, data, left = 0, zlib.decompressobj(31), b""
    held: list[bytes] = []
    size = 0
    while True:
        chunk = left or stream.read(1 << 20)
        if not chunk:
            break
        held.append(data.decompress(chunk))
        left = data.unused_data
        size += len(chunk) - len(left)
        if data.eof:
            yield offset, b"".join(held)
            offset, size, held, data = offset + size, 0, [], zlib.decompressobj(31)
    if size:
        raise ValueError("an archive ends inside a record")


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = content.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, block


def read_warc(spark: SparkSession, where: str) -> DataFrame:
    """All page records of the files that the manifest in ``where`` names, digests checked."""
    manifest = spark.read.schema(MANIFEST).json(f"{where}/manifest")
    files = manifest.select("file").repartition(4 * spark.sparkContext.defaultParallelism, "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(where)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for offset, content in members(stream):
                        headers, block = parse(content)
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        if headers["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
                            raise ValueError(f"block digest of {headers['WARC-Record-ID']} in {name}")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest, size = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(http.rpartition(b"Content-Length: ")[2])
                        revisit = headers["WARC-Type"] == "revisit"
                        if not revisit and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                            raise ValueError(f"payload digest of {headers['WARC-Record-ID']} in {name}")
                        rows.append((page_of(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), size, digest, headers["WARC-Type"], page_of(headers.get("WARC-Refers-To")), name, offset))
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset"])

    return files.mapInArrow(read, RECORD)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """Write every page to archives in the shared folder, then read them back."""
    where = new_folder(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), where)
    return read_warc(spark, where).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
