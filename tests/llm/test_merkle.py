import hashlib
import zlib

import pytest

from oddsloom.llm import merkle

SHAPE = "doc_id long, source string, lang string, n_chars long, text string, tree int, hash string, size int, steps string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(digests):
    """Root and, for each leaf, its siblings by level, by walking up."""
    where, steps = list(range(len(digests))), [[] for _ in digests]
    while len(digests) > 1:
        for i, p in enumerate(where):
            run = p // 8 * 8
            steps[i].append((digests[run:p], digests[p + 1 : run + 8]))
            where[i] = p // 8
        digests = [h(*digests[k : k + 8]) for k in range(0, len(digests), 8)]
    return digests[0], steps


def walked(rows):
    groups = {}
    for i, source, lang, n, text, *_ in rows:
        leaf = altered = h(*map(field, (i, source, lang, n, text)))
        if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and text is not None:
            altered = h(*map(field, (i, source, lang, n, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))))
        groups.setdefault(lang, []).append((i is not None, i or 0, leaf, altered))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: tree([x[2] for x in sorted(groups[g])]) for g in order}
    root, tops = tree([built[g][0] for g in order])
    for g, top in zip(order, tops):
        for (known, i, leaf, altered), own in zip(sorted(groups[g]), built[g][1]):
            top_folded = altered
            for left, right in own + top:
                top_folded = h(*left, top_folded, *right)
            yield i if known else None, leaf, built[g][0], root, h(*["".join(a + b) for a, b in own + top]), top_folded, top_folded == root


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, SHAPE).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return merkle.op11_merkle_manifest(spark, str(tmp_path))


def padded(rows):
    return [(*r, 1, "x", 2, "y") for r in rows]


def test_equals_a_walk_over_trees_of_all_sizes(spark, tmp_path):
    # Groups of 1, 8, 9, 64, 65, 520 rows, nulls everywhere, negative and sparse ids, ties, repeated rows, one very long text.
    rows = [(k * 7 - 90, f"s{k % 3}", "en", k, f"Text {k} É") for k in range(520)]
    rows += [(10_000 + k, None, "de", None, "Ä" * k) for k in range(65)] + [(20_000 + k, "s", "fr", 1, None) for k in range(64)]
    rows += [(30_000 + k, "s", "", 1, "") for k in range(9)] + [(k * 10**12, "s", None, 1, "UPPER İ") for k in range(8)] + [(5, "s", "lone", 1, "One")]
    rows += [(None, "s", "en", 1, "No id"), (None, None, None, None, None)] + [(77, "s", "tie", k % 3, f"Tie {k % 4}") for k in range(40)] + [(3, "s", "long", 1, "Long " * 200_000)]
    rows = padded(rows)
    found = run(spark, tmp_path, rows)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, found.collect()), key=key) == sorted(walked(rows), key=key)


@pytest.mark.parametrize("groups", [1, 8, 70])
def test_roots_form_a_tree_of_their_own(spark, tmp_path, groups):
    rows = padded([(k, "s", f"l{k % groups:03}", 1, "A") for k in range(groups * 2)])
    assert sorted(map(tuple, run(spark, tmp_path, rows).collect())) == sorted(walked(rows))


def test_a_lone_row_is_the_root_and_no_rows_give_none(spark, tmp_path):
    rows = padded([(6, "s", "en", 1, "ABC")])
    (only,) = run(spark, tmp_path / "one", rows).collect()
    assert tuple(only) == next(walked(rows)) and only["root"] == only["leaf"] and only["proof_sha256"] == h("")
    assert run(spark, tmp_path / "none", []).count() == 0


def test_the_manifest_keeps_intervals_and_levels(spark):
    leaves = spark.range(100).selectExpr("'a' as tree", "unhex(sha2(cast(id as string), 256)) as hash", "id")
    made = merkle.build(leaves, ["id"])
    assert [level.count() for level in made.levels] == [13, 2, 1]
    assert made.levels[0].where("hi - lo <> size(children)").count() == 0
    assert [(r.lo, r.hi) for r in made.levels[1].orderBy("lo").collect()] == [(0, 64), (64, 100)]
    assert made.roots.first()["hash"].hex() == tree([h(str(k)) for k in range(100)])[0]


def test_rows_equal_in_all_but_place_spread(spark, tmp_path):
    rows = padded([(1, "s", "en", 1, "Same")] * 3000)
    found = run(spark, tmp_path, rows)
    assert found.select("leaf").distinct().count() == 1 and found.count() == 3000
    assert sorted(map(tuple, found.collect())) == sorted(walked(rows))
