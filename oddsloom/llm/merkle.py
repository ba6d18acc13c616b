"""Merkle manifest of a dataset, with a proof for every row.

Rows become leaves; each group's leaves (here: each language's) form a tree of
fan-out eight, and the groups' roots form one more tree. A node carries the
half-open interval of leaf ranks that it covers. Ancestors are attached by a
containment join in which both sides meet on the bucket of the upper level
(the lower node's first rank divided by the upper node's width), and siblings
are what is left of a parent's interval when a child's is taken away. Every
level is a table in the shared folder, an eighth of the one below it; a path
goes down from parent to child and is never built by walking a tree.

Ranks come from one range sort: the position inside a sorted partition plus
the sizes of the earlier partitions' parts, so a group of any size (one
language may hold most rows) spreads over all partitions and no window runs
over a group. A group of one has its leaf as its root; an empty table has no
root and gives no rows.

Edge cases: a null field is ``-``, an empty one ``0:``; rows whose group is
null form a group of their own, first in order; leaves of a group ascend by
the order column, nulls first, then by digest, so ties and repeated rows have
one order and each keeps its own leaf and proof; texts of any length are
hashed whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.llm.cluster import written

FAN = 8
#: A step up the tree: digests of the siblings before and after the node, as raw bytes.
STEPS = "array<struct<left: binary, right: binary>>"


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(f) for f in fields]), 256))


def ascii_lowered(text: Column) -> Column:
    """A-Z in lower case; the quicker function does just that where all characters are ASCII."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@dataclass
class Manifest:
    """Leaves ``(tree, lo, hi, size, hash, carried...)``, a table for each level above them, and the trees' roots ``(tree, size, hash)``."""

    leaves: DataFrame
    levels: list[DataFrame]
    roots: DataFrame


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``rank`` in the row's ``tree`` by ``order`` and the tree's ``size``."""
    keys = ["tree", *order]
    placed = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33)), "merkle-sorted")
    runs = written(placed.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count("*").alias("n")), "merkle-runs")
    # A row for each tree and partition: (tree, part) rows of one tree are as many as partitions at most.
    runs = runs.selectExpr("tree", "part", "first", "coalesce(sum(n) over (partition by tree order by part rows between unbounded preceding and 1 preceding), 0) as before", "sum(n) over (partition by tree) as size")
    return placed.join(runs, ["tree", "part"]).withColumn("rank", F.expr("before + place - first")).drop("place", "part", "first", "before")


def build(rows: DataFrame, order: list[str], carried: list[str] = []) -> Manifest:
    """All trees over ``rows`` ``(tree string, hash binary, ...)``; ``carried`` columns stay with the leaves."""
    base = ranked(rows, order).selectExpr("tree", "rank as lo", "rank + 1 as hi", "size", "hash", *[f"`{c}`" for c in carried])
    widest = base.agg(F.max("size")).first()[0] or 0
    levels, below, width, own = [], base, 1, carried
    while widest > width:
        children = F.array_sort(F.collect_list(F.struct("lo", "hi", "hash", *own)))
        level = below.where(F.col("size") > width).groupBy("tree", "size", F.expr(f"lo div {width * FAN}").alias("bucket")).agg(children.alias("children"))
        level = level.selectExpr("tree", "size", "bucket", "children[0].lo as lo", "children[size(children) - 1].hi as hi", "unhex(sha2(array_join(transform(children, c -> lower(hex(c.hash))), ''), 256)) as hash", "children")
        levels.append(written(level, f"merkle-level{len(levels) + 1}"))
        below, width, own = levels[-1], width * FAN, []
    tops = [base.where("size = 1")] + [level.where(F.col("size") <= FAN ** (k + 1)) for k, level in enumerate(levels)]
    roots = tops[0].select("tree", "size", "hash")
    for top in tops[1:]:
        roots = roots.union(top.select("tree", "size", "hash"))
    return Manifest(base, levels, written(roots, "merkle-roots"))


def _step(child: str, siblings: str) -> str:
    """Interval difference: the parent's nodes left of the child's interval, and those right of it."""
    digests = lambda side: f"unhex(array_join(transform(filter({siblings}, x -> {side}), x -> hex(x.hash)), ''))"
    return f"named_struct('left', {digests(f'x.hi <= {child}.lo')}, 'right', {digests(f'x.lo >= {child}.hi')})"


def proofs(manifest: Manifest, above: DataFrame, told: list[str] = []) -> DataFrame:
    """Leaves with ``steps``, the siblings level by level, lowest first, and the ``told`` columns of their tree.

    ``above`` has a row for each tree: ``tree``, ``steps`` from the tree's root on, and the ``told`` columns.
    """
    above = above.select("tree", "steps", *told)
    upper = None
    for k in range(len(manifest.levels), 0, -1):
        level, width = manifest.levels[k - 1], FAN**k
        paths = level.where(F.col("size") <= width).join(above, "tree")
        if upper is not None:
            lower = level.where(F.col("size") > width)
            inside = f"c.tree = p.tree and c.lo div {width * FAN} = p.bucket and p.lo <= c.lo and c.hi <= p.hi"
            joined = lower.alias("c").join(upper.alias("p"), F.expr(inside))
            paths = paths.unionByName(joined.selectExpr("c.*", f"concat(array({_step('c', 'p.children')}), p.steps) as steps", *[f"p.`{t}`" for t in told]))
        upper = paths
    leaves = manifest.leaves.where("size = 1").join(above, "tree")
    if upper is None:
        return leaves
    child = upper.selectExpr("tree", "size", "steps", "children", *[f"`{t}`" for t in told], "explode(children) as c")
    return leaves.unionByName(child.selectExpr("tree", "c.*", "size", f"concat(array({_step('c', 'children')}), steps) as steps", *[f"`{t}`" for t in told]))


def proof_digest(steps: str = "steps") -> Column:
    return F.expr(f"sha2(array_join(transform({steps}, s -> concat(lower(hex(s.left)), lower(hex(s.right)))), ''), 256)")


def folded(leaf: str, steps: str = "steps") -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.expr(f"aggregate({steps}, lower(hex({leaf})), (h, s) -> sha2(concat(lower(hex(s.left)), h, lower(hex(s.right))), 256))")


def dataset_proofs(leaves: DataFrame, order: list[str], carried: list[str] = []) -> DataFrame:
    """Proofs of all leaves ``(tree string, hash binary, carried...)`` up to the root over all trees.

    Gives ``tree``, ``lo`` (rank), ``hi``, ``size``, ``hash``, the carried columns, ``steps``, ``subroot`` and ``root``.
    """
    groups = build(leaves, order, carried)
    whole = build(groups.roots.selectExpr("'' as tree", "tree as member", "hash"), ["member"], ["member"])
    ends = whole.roots.selectExpr("tree", f"cast(array() as {STEPS}) as steps", "hash as root")
    above = proofs(whole, ends, ["root"]).selectExpr("member as tree", "steps", "hash as subroot", "root")
    return proofs(groups, written(above, "merkle-above"), ["subroot", "root"])


def document_leaves(documents: DataFrame) -> DataFrame:
    """``(tree, doc_id, hash, altered)``: each document's leaf, and the leaf of what is found later: some texts in lower case."""
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang", "n_chars", "text")])
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    found = F.when(tampered, leaf_digest(*fields, ascii_lowered(F.col("text"))))
    # Group names start with a letter, so that the null group's name is none of theirs.
    tree = F.coalesce(F.concat(F.lit("g"), F.col("lang")), F.lit(""))
    d = d.select(tree.alias("tree"), "doc_id", leaf_digest(*fields, F.col("text")).alias("hash"), found.alias("altered"), F.xxhash64(F.monotonically_increasing_id()).alias("apart"))
    return d.withColumn("altered", F.coalesce("altered", "hash"))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    leaves = written(document_leaves(spark.read.parquet(f"{sf_dir}/documents.parquet")), "merkle-leaves")
    # ``apart`` orders rows that are equal in all else, so that copies without end of one row still spread.
    proven = dataset_proofs(leaves, ["doc_id", "hash", "apart"], ["doc_id", "altered"])
    proven = proven.select("doc_id", hexed(F.col("hash")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"), proof_digest().alias("proof_sha256"), folded("altered").alias("folded_root"))
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))
