"""Arrow helpers for tasks: slicing batches, splitting texts into words, hashing.

Everything here runs inside a Spark task on one Arrow batch at a time; no
function keeps more than one slice of text in memory.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bytes that Spark hands to a Python worker at once, unless the session says otherwise.
BATCH_BYTES = 4 << 20
SLICE_BYTES = 2 << 20
#: For steps that hold several numbers for each byte.
BYTE_SLICE = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, not rows only; a session that has set its own bound keeps it."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@cache
def _trim() -> Callable[[int], int]:
    """The C library's call that gives freed memory back, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def release() -> None:
    """Give memory that Python no longer uses back to the machine: workers stay alive between tasks, side by side with the JVM."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def text_udf(make: Callable[[], Callable[[pa.Array], pa.Array]], kind: str, limit: int = SLICE_BYTES) -> Callable[[Column], Column]:
    """A function on a text column: only the text travels to Python and only the answer back.

    ``make`` is called once in a task and gives the function of a slice of texts.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        answer = make()
        for texts in batches:
            parts = [answer(part.column("text")) for part in slices(pa.record_batch({"text": texts.cast(pa.string())}), "text", limit)]
            if parts:
                yield pa.concat_arrays(parts)
            else:
                yield answer(pa.array([], pa.string()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose text takes about ``limit`` bytes; a longer text is a run of its own."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = (np.cumsum(sizes) - sizes) // limit
    edges = np.flatnonzero(np.diff(block)) + 1
    for start, end in zip([0, *edges], [*edges, batch.num_rows]):
        yield batch.slice(int(start), int(end - start))
    release()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words between ASCII white space, A-Z lowered: distinct words, a code for each word, row offsets into the codes.

    Null texts have no words.
    """
    lowered = pc.ascii_lower(pc.fill_null(texts, ""))
    parts = pc.ascii_split_whitespace(lowered)
    flat = parts.flatten()
    offsets = parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = pc.dictionary_encode(flat)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    words = coded.dictionary
    blank = pc.index(words, pa.scalar("", words.type)).as_py()
    if blank >= 0:  # the splitter returns "" before leading and after trailing white space
        keep = codes != blank
        before = np.concatenate([[0], np.cumsum(keep)])
        codes, offsets = codes[keep], before[offsets]
    return words, codes, offsets


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash for each distinct word."""
    digest = xxhash.xxh3_64_intdigest
    raw = words.cast(pa.binary()).to_pylist()
    return np.fromiter((digest(w) for w in raw), dtype=np.uint64, count=len(raw))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(word_hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's ``width``-word shingles and their row offsets.

    A row with fewer words, but at least one, has its whole sequence as its only shingle.
    """
    n = len(word_hashes)
    counts = np.diff(offsets)
    lengths = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_offsets = np.concatenate([[0], np.cumsum(lengths)])
    rolled = np.zeros(max(n, 0), dtype=np.uint64)
    if n >= width:
        acc = np.zeros(n - width + 1, dtype=np.uint64)
        for k in range(width):
            acc = (acc + word_hashes[k : n - width + 1 + k]) * (MIX + np.uint64(2 * k))
            acc ^= acc >> np.uint64(29)
        rolled[: n - width + 1] = mix64(acc)
    # start of every shingle: the first lengths[i] word places of row i
    starts = np.repeat(offsets[:-1] - out_offsets[:-1], lengths) + np.arange(out_offsets[-1])
    result = rolled[starts.astype(np.int64)] if len(starts) else np.zeros(0, dtype=np.uint64)
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        key = word_hashes[offsets[i] : offsets[i + 1]].tobytes()
        result[out_offsets[i]] = xxhash.xxh3_64_intdigest(key, seed=len(key))
    return result, out_offsets


def distinct_per_row(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values, sorted and without repeats."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    first = np.ones(len(values), dtype=bool)
    first[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    counts = np.bincount(rows[first], minlength=len(offsets) - 1)
    return values[first], np.concatenate([[0], np.cumsum(counts)])


def as_long(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))
