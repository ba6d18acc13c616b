"""Packing documents into training sequences of one length.

Each task tokenizes its rows. What fills whole sequences by itself is cut off
at once; only a document's rest, shorter than a sequence, is packed: rows are
dealt to groups at random (so every group has the same mix of lengths) and
each group runs first-fit decreasing by itself. A tournament tree over the
bins holds in each node the largest free space below it, so the first bin
that fits is found on one way down. Then the emptiest bins of the group give
their pieces, cut where needed, to fill the gaps of the fuller ones, and the
one bin that is left is cut into sequences whose lengths are powers of two,
which need no padding.

A group holds ``GROUP_DOCUMENTS`` rests, however large the table is: its size
is bounded by their number and the sequence length. Groups grow in number
only. Rows are dealt by their place in the table, not by their values, so
copies of one row spread like any other rows.

Edge cases: a null or empty text is its end id alone; repeated rows are packed
one by one; a null id is kept; ties of length are ordered by id, then by the
ids' bytes; an empty table has no pieces; other columns, whatever their names,
are ignored; a text of any length is tokenized and cut whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.llm import arrowtext as at
from oddsloom.llm.subword import Subwords

LENGTH = 2048
GROUP_DOCUMENTS = 1024
SLICE_BYTES = 1 << 20


class Bins:
    """Free space of ``n`` bins under a tournament tree."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.best = [capacity] * (2 * self.leaves)

    def put(self, need: int) -> int:
        """Put something into the first bin that has room for it; the bin's number."""
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < need:
                node += 1
        found = node - self.leaves
        best[node] -= need
        while node > 1:
            node //= 2
            left, right = best[2 * node], best[2 * node + 1]
            best[node] = left if left > right else right
        return found


def first_fit(sizes: list[int], capacity: int) -> list[list[list[int]]]:
    """Bins of pieces ``[item, start, stop]``; ``sizes`` come in falling order."""
    bins, found = Bins(len(sizes), capacity), []
    for item, size in enumerate(sizes):
        k = bins.put(size)
        if k == len(found):
            found.append([])
        found[k].append([item, 0, size])
    return found


def topped_up(bins: list[list[list[int]]], capacity: int) -> list[list[list[int]]]:
    """Fill the gaps of fuller bins with pieces of the emptiest; at most one bin is left with a gap, and it is cut at powers of two."""
    used = [sum(stop - start for _, start, stop in pieces) for pieces in bins]
    open_bins = sorted((k for k in range(len(bins)) if used[k] < capacity), key=lambda k: (-used[k], k))
    first, last = 0, len(open_bins) - 1
    while first < last:
        taker, giver = open_bins[first], open_bins[last]
        item, start, stop = piece = bins[giver][-1]
        moved = min(capacity - used[taker], stop - start)
        if moved == stop - start:
            bins[giver].pop()
        piece[2] = stop - moved
        bins[taker].append([item, stop - moved, stop])
        used[taker] += moved
        used[giver] -= moved
        first += used[taker] == capacity
        last -= used[giver] == 0
    full = [pieces for k, pieces in enumerate(bins) if used[k] == capacity]
    for k in (k for k in open_bins[first : last + 1] if 0 < used[k] < capacity):
        full += power_cuts(bins[k], used[k])
    return full


def power_cuts(pieces: list[list[int]], used: int) -> list[list[list[int]]]:
    """The pieces of one bin as bins whose lengths are the powers of two of ``used``, largest first."""
    found, queue = [], [list(p) for p in reversed(pieces)]
    for power in (1 << b for b in reversed(range(used.bit_length())) if used >> b & 1):
        taken, room = [], power
        while room:
            item, start, stop = queue.pop()
            cut = min(stop, start + room)
            taken.append([item, start, cut])
            room -= cut - start
            if cut < stop:
                queue.append([item, cut, stop])
        found.append(taken)
    return found


def tokenized(rows: DataFrame, path: str, length: int, end_id: int, keep_ids: bool) -> DataFrame:
    """``(bin_group, id, tokens, crcs, ids)`` for rows ``(bin_group, id, text)``: CRCs of the whole sequences in a document's ids, and its rest (or all its ids)."""
    at.small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        for batch in batches:
            words = words or Subwords(path, spaced=True)
            kind = "<u2" if max(words.size(), end_id + 1) <= 1 << 16 else "<u4"
            for part in at.slices(batch, "text", SLICE_BYTES):
                ids, offsets = words.encode(pc.fill_null(part.column("text"), ""))
                # The end id after each document's ids.
                ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
                offsets = (offsets + np.arange(len(offsets))).tolist()
                crcs, bodies = [], []
                for a, b in zip(offsets[:-1], offsets[1:]):
                    whole = a + (b - a) // length * length
                    crcs.append([zlib.crc32(ids[k : k + length]) for k in range(a, whole, length)])
                    bodies.append(ids[a if keep_ids else whole : b].astype(kind).tobytes())
                yield pa.record_batch({"bin_group": part.column("bin_group"), "id": part.column("id"), "tokens": pa.array(np.diff(offsets), pa.int64()), "crcs": pa.array(crcs, pa.list_(pa.int64())), "wide": pa.array([kind == "<u4"] * len(bodies)), "ids": pa.array(bodies, pa.binary())})
        del words
        at.release()

    return rows.mapInArrow(run, "bin_group long, id long, tokens long, crcs array<long>, wide boolean, ids binary")


def packed_pieces(documents: DataFrame, path: str, length: int = LENGTH, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = True, group_documents: int = GROUP_DOCUMENTS) -> DataFrame:
    """Pieces of all documents: ``id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and, if wanted, ``ids``."""
    groups = max(1, -(-documents.count() // group_documents))
    dealt = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"), F.monotonically_increasing_id().alias("place"))
    dealt = dealt.select(F.pmod(F.xxhash64("place"), F.lit(groups)).alias("bin_group"), "id", "text")
    columns = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def pack(table: pa.Table) -> pa.Table:
        group = table.column("bin_group")[0].as_py()
        kind = "<u4" if table.column("wide")[0].as_py() else "<u2"
        tokens, names, crcs, ids = (table.column(c).to_pylist() for c in ("tokens", "id", "crcs", "ids"))
        order = sorted(range(len(tokens)), key=lambda k: (-(tokens[k] % length), names[k] is not None, names[k] or 0, ids[k]))
        rests = [k for k in order if tokens[k] % length]
        found: dict[str, list] = {c: [] for c in columns}
        kept, sequence = [], group << 32

        def piece(k: int, start: int, size: int, crc: int, offset: int) -> None:
            for c, value in zip(columns, (names[k], start, size, crc, tokens[k], sequence, offset)):
                found[c].append(value)

        for k in order:
            for part, crc in enumerate(crcs[k]):
                piece(k, part * length, length, crc, 0)
                if keep_ids:
                    kept.append(np.frombuffer(ids[k], kind, count=length, offset=part * length * int(kind[2])).astype(np.int32))
                sequence += 1
        for pieces in topped_up(first_fit([tokens[k] % length for k in rests], length), length):
            offset = 0
            for item, start, stop in pieces:
                k = rests[item]
                whole = tokens[k] // length * length
                rest = np.frombuffer(ids[k], kind)[whole if keep_ids else 0 :][start:stop].astype("<u4")
                piece(k, whole + start, stop - start, zlib.crc32(rest), offset)
                if keep_ids:
                    kept.append(rest.astype(np.int32))
                offset += stop - start
            sequence += 1
        made = {c: pa.array(found[c], pa.int64()) for c in columns}
        if keep_ids:
            made["ids"] = pa.array(kept, pa.list_(pa.int32()))
        return pa.table(made)

    kind = ", ".join(f"{c} long" for c in columns) + ", ids array<int>" * keep_ids
    return tokenized(dealt, path, length, end_id, keep_ids).groupBy("bin_group").applyInArrow(pack, kind)


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """``(sequence_id, ids, n_tokens)``: pieces with ``ids`` put together; what is no power of two long is padded to ``length``."""
    whole = pieces.groupBy("sequence_id").agg(F.expr("flatten(transform(array_sort(collect_list(struct(offset, ids))), x -> x.ids))").alias("ids"))
    whole = whole.withColumn("n_tokens", F.size("ids").cast("long"))
    padding = F.when(F.expr("bit_count(n_tokens)") == 1, 0).otherwise(length - F.col("n_tokens")).cast("int")
    return whole.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), padding)).alias("ids"), "n_tokens")


def op12_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed_pieces(documents, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False).withColumnRenamed("id", "doc_id")
