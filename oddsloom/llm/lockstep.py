"""Alignment of two tokenizers' tokens of the same texts.

Each text is encoded by tokenizer A (byte-level merges, with a space before
the text) and by tokenizer B (pieces with byte fallback, which adds that space
itself). Where the joined bytes of both are the text's, the tokens lie on one
byte axis and are aligned in lockstep: one state vector holds a pointer into
A's tokens and one into B's for every lane of the batch; a step emits a link
for every lane, moves on the pointer whose token ends first (both where both
end, which is a cut), and drops the lanes that are done. A document is one
lane; a long one is entered as several, which start at places where a token of
either tokenizer ends, so the number of steps is bounded by a lane's length
and not by the longest document.

How many documents hold a linked pair of ids is counted over the whole table:
each document hands on its distinct pairs once, with how often each occurs,
in a table in the shared folder; counting and scoring are a grouped sum and
joins on it. The most frequent pairs, a bounded number, are broadcast, so that
almost no link is shuffled; all others are joined by shuffle.

Edge cases: a text that is null or empty, or whose joined tokens differ from
it (as B writes U+2581 for a space, a text that holds it differs), has no
tokens, zeros and an empty digest; repeated rows, rows without an id and rows
of one id each stand for themselves and count as documents of their own; ties
for the highest count are all best; an empty table gives no rows; a text of
any length is encoded whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.llm import arrowtext as at
from oddsloom.llm.cluster import written
from oddsloom.llm.subword import Pieces, Subwords, byte_level, data_of, spread

SLICE_BYTES = 1 << 20
#: A's tokens in a lane, and how many of them are looked at for a common end.
LANE, WINDOW = 512, 32
#: Pairs that are broadcast, at 32 bytes each or so.
HOT_PAIRS = 500_000


class Tokens:
    """Tokens of a slice's texts: ids, row offsets, and where each token ends on the byte axis of the whole slice."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, width: np.ndarray):
        self.ids, self.offsets, self.width = ids, offsets, width
        self.ends = np.cumsum(width[ids])

    def without(self, dropped: np.ndarray) -> Tokens:
        """The same rows; those that are dropped have no tokens."""
        counts = np.where(dropped, 0, np.diff(self.offsets))
        return Tokens(self.ids[spread(self.offsets[:-1], counts)], np.concatenate([[0], np.cumsum(counts)]), self.width)

    def bytes_by_row(self) -> np.ndarray:
        return np.diff(np.concatenate([[0], self.ends])[self.offsets])


def lanes(a: Tokens, b: Tokens, size: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First A token, first B token and A's stop of each lane."""
    counts = np.diff(a.offsets)
    rows = np.flatnonzero(counts)
    # In long rows, after every ``size`` tokens: the first end near there that B shares.
    extra = (counts[rows] - 1) // size
    aims = np.repeat(a.offsets[rows], extra) + (spread(np.zeros(len(rows), dtype=np.int64), extra) + 1) * size - 1
    stops = np.repeat(a.offsets[rows + 1], extra) - 1
    near = np.minimum(aims[:, None] + np.arange(min(WINDOW, size)), stops[:, None])
    place = np.minimum(np.searchsorted(b.ends, a.ends[near]), max(0, len(b.ends) - 1))
    shared = (b.ends[place] == a.ends[near]) & (near < stops[:, None]) if len(near) else np.zeros(near.shape, dtype=bool)
    hit = shared.any(axis=1)
    which = shared.argmax(axis=1)
    starts = np.concatenate([a.offsets[rows], near[hit, which[hit]] + 1])
    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    in_b = np.concatenate([b.offsets[rows], place[hit, which[hit]] + 1])[order]
    return starts, in_b, np.concatenate([starts[1:], a.offsets[-1:]])


def align(a: Tokens, b: Tokens, size: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links as (A token, B token), and cuts as the (A token, B token) that end there."""
    at_a, at_b, stop = lanes(a, b, size)
    links: list[tuple[np.ndarray, np.ndarray]] = []
    cuts: list[tuple[np.ndarray, np.ndarray]] = []
    while len(at_a):
        links.append((at_a, at_b))
        end_a, end_b = a.ends[at_a], b.ends[at_b]
        cut = end_a == end_b
        cuts.append((at_a[cut], at_b[cut]))
        at_a, at_b = at_a + (end_a <= end_b), at_b + (end_b <= end_a)
        # A lane ends with a cut, so both pointers have passed its end when A's has.
        on = at_a < stop
        if not on.all():
            at_a, at_b, stop = at_a[on], at_b[on], stop[on]
    joined = lambda pairs, k: np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, dtype=np.int64)
    return joined(links, 0), joined(links, 1), joined(cuts, 0), joined(cuts, 1)


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = Subwords(a_path, spaced=False, plain_specials=True), Pieces(b_path)
        names = [self.a.tokenizer.id_to_token(i) or "" for i in range(self.a.size())]
        self.a_bytes, self.b_bytes = pa.array(map(byte_level, names), pa.binary()), self.b.surface
        self.a_width = self.a.width
        self.b_width = pc.binary_length(self.b_bytes).to_numpy().astype(np.int64)
        #: A token's text in a digest: its number and what stands after it, inside a group or at its end.
        self.base = 2 * len(names)
        self.written = pa.array([b"%d%c" % (i, c) for i in range(len(names)) for c in b",|"] + [b"%d%c" % (i, c) for i in range(len(self.b_bytes)) for c in b",;"], pa.binary())
        self.bits = pair_bits(len(self.b_bytes))

    def encode(self, texts: pa.Array) -> tuple[Tokens, Tokens]:
        full = pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0)
        spaced = pc.if_else(full, pc.binary_join_element_wise(" ", pc.fill_null(texts, ""), ""), "")
        a = Tokens(*self.a.encode(spaced), self.a_width)
        b = Tokens(*self.b.encode(spaced), self.b_width)
        data, places = data_of(spaced)
        different = np.zeros(len(texts), dtype=bool)
        for tokens, surface in ((a, self.a_bytes), (b, self.b_bytes)):
            different |= tokens.bytes_by_row() != np.diff(places)
            made, _ = data_of(pc.take(surface, pa.array(tokens.ids)))
            if len(made) != len(data) or not np.array_equal(made, data):
                own = np.concatenate([[0], tokens.ends])[tokens.offsets]
                for k in np.flatnonzero(~different):
                    different[k] = not np.array_equal(made[own[k] : own[k + 1]], data[places[k] : places[k + 1]])
        return (a.without(different), b.without(different)) if different.any() else (a, b)

    def digests(self, a: Tokens, b: Tokens, cut_a: np.ndarray, cut_b: np.ndarray) -> list[str]:
        """Of each row's groups: A's ids, B's ids, group by group."""
        ends_a, ends_b = np.zeros(len(a.ids), dtype=np.int64), np.zeros(len(b.ids), dtype=np.int64)
        ends_a[cut_a], ends_b[cut_b] = 1, 1
        # Both have a group's number of tokens before it; a token of A has B's tokens of earlier groups before it, one of B A's of its own group too.
        before_b = np.concatenate([[0], np.flatnonzero(ends_b) + 1])
        through_a = np.flatnonzero(ends_a) + 1
        codes = np.empty(len(a.ids) + len(b.ids), dtype=np.int64)
        codes[np.arange(len(a.ids)) + before_b[np.cumsum(ends_a) - ends_a]] = 2 * a.ids + ends_a
        codes[np.arange(len(b.ids)) + (through_a[np.cumsum(ends_b) - ends_b] if len(b.ids) else 0)] = self.base + 2 * b.ids + ends_b
        text = pc.take(self.written, pa.array(codes))
        data, places = data_of(text)
        data, places = data.tobytes(), places[a.offsets + b.offsets].tolist()
        return [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(places[:-1], places[1:])]

    def rows(self, part: pa.RecordBatch, detail: bool, pair_type: pa.DataType) -> pa.RecordBatch:
        a, b = self.encode(part.column("text"))
        link_a, link_b, cut_a, cut_b = align(a, b)
        n = part.num_rows
        row_of = np.repeat(np.arange(n), np.diff(a.offsets))
        link_row, cut_row = row_of[link_a], row_of[cut_a]
        # One number for row and pair: 40 bits hold any two vocabularies of a million tokens.
        key = np.sort(link_row << 40 | a.ids[link_a].astype(np.int64) << self.bits | b.ids[link_b])
        first = np.flatnonzero(np.diff(key, prepend=-1))
        pair, row = key[first] & ((1 << 40) - 1), key[first] >> 40
        per_row = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
        made = {
            "row": part.column("row"),
            "id": part.column("id"),
            "n_a": pa.array(np.diff(a.offsets), pa.int64()),
            "n_b": pa.array(np.diff(b.offsets), pa.int64()),
            "n_groups": pa.array(np.bincount(cut_row, minlength=n), pa.int64()),
            "n_links": pa.array(np.bincount(link_row, minlength=n), pa.int64()),
            "groups_sha256": pa.array(self.digests(a, b, cut_a, cut_b), pa.string()),
            "pairs": at.list_array(pair, per_row, pair_type),
            "times": at.list_array(np.diff(np.append(first, len(key))), per_row, pa.int32()),
        }
        if detail:
            order = np.lexsort((link_b, link_a))
            bounds = np.concatenate([[0], np.cumsum(np.bincount(link_row, minlength=n))])
            for name, tokens, link in (("a", a, link_a), ("b", b, link_b)):
                made[f"{name}_ids"] = at.list_array(tokens.ids, tokens.offsets, pa.int32())
                made[f"link_{name}"] = at.list_array((link - tokens.offsets[:-1][link_row])[order], bounds, pa.int32())
            cuts = np.sort(cut_a)
            began = np.concatenate([[0], a.ends])[a.offsets[:-1]]
            made["cuts"] = at.list_array(a.ends[cuts] - began[row_of[cuts]], np.concatenate([[0], np.cumsum(np.bincount(cut_row, minlength=n))]), pa.int32())
        return pa.record_batch(made)


def pair_bits(b_size: int) -> int:
    """A pair of ids is one number: A's id, then so many bits for B's."""
    return max(1, (b_size - 1).bit_length())


@cache
def vocabulary_sizes(a_path: str, b_path: str) -> tuple[int, int]:
    import sentencepiece

    return Subwords(a_path, spaced=False).size(), sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size()


def alignments(documents: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text", detail: bool = True) -> DataFrame:
    """Every row's alignment: ``row`` (its place), ``id``, counts, ``groups_sha256``, its distinct linked ``pairs`` and how many ``times`` each.

    ``detail`` adds the ids (``a_ids``, ``b_ids``), the links as positions
    (``link_a``, ``link_b``) and the byte offsets of the ``cuts``, counted with
    the space before the text.
    """
    at.small_batches(documents.sparkSession)
    a_size, b_size = vocabulary_sizes(a_path, b_path)
    small = a_size << pair_bits(b_size) <= 1 << 31
    pair_type, pair_kind = (pa.int32(), "int") if small else (pa.int64(), "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in batches:
            aligner = aligner or Aligner(a_path, b_path)
            for part in at.slices(batch, "text", SLICE_BYTES):
                yield aligner.rows(part, detail, pair_type)
        del aligner
        at.release()

    kind = f"row long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{pair_kind}>, times array<int>"
    kind += ", a_ids array<int>, link_a array<int>, b_ids array<int>, link_b array<int>, cuts array<int>" * detail
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, kind)


def pair_counts(aligned: DataFrame, bits: int) -> DataFrame:
    """``(pair, n, best)``: how many documents hold each pair, and whether no pair of the same A id is in more."""
    counts = written(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).withColumn("a", F.shiftright("pair", bits)), "pair-counts")
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def scored(aligned: DataFrame, bits: int, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``(row, n_best, count_sum)`` of every row with links; ``aligned`` is a table."""
    counts = written(pair_counts(aligned, bits), "pair-scores")
    # The most frequent pairs: as many whole classes of counts, by powers of two, as stay within the bound.
    classes = {r["k"]: r["m"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("m")).collect()}
    least, held = 1 << (max(classes, default=0) + 1), 0
    for k in sorted(classes, reverse=True):
        if held + classes[k] > hot_pairs:
            break
        least, held = 1 << k, held + classes[k]
    hot, rest = counts.where(F.col("n") >= least), counts.where(F.col("n") < least)
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").cast("long").alias("times"))
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum")]
    found = links.join(F.broadcast(hot), "pair").groupBy("row").agg(*sums)
    if held < sum(classes.values()):
        others = links.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(rest, "pair").groupBy("row").agg(*sums)
        found = found.union(others).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found


def alignment_scores(documents: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Each row's counts, digest, ``n_best`` and ``count_sum``."""
    aligned = written(alignments(documents, a_path, b_path, id_column, text_column, detail=False), "alignments")
    sums = scored(aligned, pair_bits(vocabulary_sizes(a_path, b_path)[1]), hot_pairs)
    whole = aligned.select("row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row", "left")
    return whole.select("id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")


def op13_cross_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return alignment_scores(documents, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")
