import gzip
import hashlib
import os

import pytest

from oddsloom.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, shard int"
BIG = "<p>same payload</p>" * 20


def rows():
    return [(5, "http://b/5", BIG, "d", 9), (2, "http://a/2", BIG, "d", 9), (3, None, None, None, 1), (4, "http://c\r\nX: 1", "", "", 1), (7, "http://d", "é" * 40_000, "x", 2), (8, "u", "short", "", 1), (9, "u", "short", "", 1), (9, "u", "short", "", 1), (None, "n", BIG + "x", "", 1)]


def expected(data):
    payloads = [(i, (h or "").encode()) for i, _, h, _, _ in data]
    out = []
    for i, p in payloads:
        first = min(((j is not None, j) for j, q in payloads if q == p))[1]
        revisit = len(p) >= 100 and i != first
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def read(frame):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in frame.collect()), key=str)


def test_round_trip(spark, tmp_path):
    where = f"file://{tmp_path}/w"
    manifest = warc.write_warc(spark.createDataFrame(rows(), SCHEMA).repartition(3), where)
    assert read(warc.read_warc(spark, where)) == expected(rows())
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows())
    assert not [f for f in os.listdir(tmp_path / "w") if f.startswith("_temporary")]


def test_files_are_the_same_whatever_the_partitions(spark, tmp_path):
    data = [(i, f"http://h/{i}", f"<p>{i}</p>" * 500, "", 0) for i in range(3000)]
    found = []
    for n in (1, 7):
        where = f"{tmp_path}/w{n}"
        warc.write_warc(spark.createDataFrame(data, SCHEMA).repartition(n), f"file://{where}", shard_bytes=1 << 20, file_bytes=1 << 15)
        found.append({f: hashlib.sha256(open(f"{where}/{f}", "rb").read()).hexdigest() for f in sorted(os.listdir(where)) if f.endswith(".gz")})
    assert found[0] == found[1] and len(found[0]) > 5
    assert any("-0001" in f for f in found[0])  # rolled by size


def test_sparse_ids_are_cut_and_rolled_alike(spark, tmp_path):
    """Ids far apart, with a null and a repeated one: shards of equal bytes, in order, rolled without a given size."""
    ids = [None, *(int.from_bytes(hashlib.sha256(b"%d" % i).digest()[:8], "big", signed=True) for i in range(2000))]
    data = [(i, f"http://h/{i}", hashlib.sha512(str(i).encode()).hexdigest() * 20, "", 0) for i in ids + ids[-1:]]
    names = []
    for n in (1, 5):
        where = f"{tmp_path}/s{n}"
        manifest = warc.write_warc(spark.createDataFrame(data, SCHEMA).repartition(n), f"file://{where}", shard_bytes=1 << 20)
        by_shard = {}
        for r in manifest.collect():
            by_shard[r["shard"]] = by_shard.get(r["shard"], 0) + r["records"]
        assert sorted(by_shard) == list(range(-(-len(data) * 2560 // (1 << 20)))) and max(by_shard.values()) <= (1 << 20) // 2560 + 2
        names.append({f: hashlib.sha256(open(f"{where}/{f}", "rb").read()).hexdigest() for f in sorted(os.listdir(where)) if f.endswith(".gz")})
    assert names[0] == names[1] and any("-0001" in f for f in names[0])
    assert read(warc.read_warc(spark, f"file://{tmp_path}/s1")) == expected(data)
    found = sorted((r["file"], r["offset"], r["page_id"] if r["page_id"] is not None else -(2**63)) for r in warc.read_warc(spark, f"file://{tmp_path}/s1").collect())
    assert [f[2] for f in found] == sorted(f[2] for f in found)


def test_damage_is_seen(spark, tmp_path):
    where = f"{tmp_path}/w"
    warc.write_warc(spark.createDataFrame(rows(), SCHEMA), f"file://{where}")
    name = next(f for f in os.listdir(where) if f.endswith(".gz"))
    text = gzip.decompress(open(f"{where}/{name}", "rb").read()).replace(b"same payload", b"xame payload", 1)
    open(f"{where}/{name}", "wb").write(gzip.compress(text))
    with pytest.raises(Exception, match="digest|length"):
        warc.read_warc(spark, f"file://{where}").collect()


def test_empty(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/w")
    assert warc.read_warc(spark, f"file://{tmp_path}/w").count() == 0
