"""Entity resolution: blocked fuzzy pairs, unique alias matches, margins over the runner-up."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

LEAST_RATIO = 0.86
#: Length of a bucket of kickoffs, in units of the time that two may be apart. A left row is in one bucket, a right one in the one or two that it can reach.
BUCKET = 32
#: Rows of one side of a bucket that a task holds at once; larger ones are dealt into parts, and each part of one side meets each of the other.
PART = 50_000
#: Rows of either side whose pairs are looked at in one step.
ROWS, COLUMNS = 128, 4096
#: Pairs that a task hands on at once.
PAIRS = 10_000
#: Characters that are told apart when a longest common subsequence is bounded, and the longest name that it is bounded of: a word's bits.
CLASSES, BITS = 32, 64


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching characters, as ``difflib`` finds them; Spark has no such function. Null where either is null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def signature(name: Column) -> Column:
    """64 bits of a name: one for each character and how often it stood before."""
    chars = F.split(name, "")
    seen = F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i), lambda x: x == c)).cast("string")))
    return F.aggregate(seen, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))))


def ratio_bound(a: Column, b: Column, bits_a: Column, bits_b: Column) -> Column:
    """An upper bound of ``sequence_ratio``: each bit of one name that the other lacks is a character without a partner."""
    lost_a, lost_b = F.bit_count(bits_a.bitwiseAND(F.bitwise_not(bits_b))), F.bit_count(bits_b.bitwiseAND(F.bitwise_not(bits_a)))
    return 2 * F.least(F.length(a) - lost_a, F.length(b) - lost_b) / (F.length(a) + F.length(b))


def plain_similarity(a: Column, b: Column) -> Column:
    """1 for equal names; .92 for one that begins or ends the other (two characters or more, no Latin letters); .88 for one inside the other (four or more); else null."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    safe = (F.length(short) >= 2) & ~short.rlike("[a-z]") & (F.startswith(long, short) | F.endswith(long, short))
    inside = (F.length(short) >= 4) & F.contains(long, short)
    return F.when(a == b, 1.0).when(safe, 0.92).when(inside, 0.88)


def characters(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All characters of all names, one after another, and the length of each name."""
    found = names.to_pylist()
    return np.frombuffer("".join(found).encode("utf-32-le"), dtype=np.uint32).astype(np.int64), np.fromiter(map(len, found), dtype=np.int64, count=len(found))


def by_frequency(values: np.ndarray) -> np.ndarray:
    """The place of each value among all of them by how often it stands there, the most frequent one first."""
    place = np.empty(int(values.max(initial=0)) + 1, dtype=np.int64)
    place[np.argsort(-np.bincount(values, minlength=len(place)), kind="stable")] = np.arange(len(place))
    return place[values]


class Names:
    """Bounds of how alike names of two sides are, for many pairs at once. The ``lefts`` first names are those of the left side."""

    def __init__(self, names: pa.Array, lefts: int):
        codes, self.length = characters(names)
        self.lefts, self.starts = lefts, np.cumsum(self.length) - self.length
        self.codes = by_frequency(codes)
        self.bits = self.signatures()
        self.set = np.bitwise_count(self.bits).astype(np.int64)
        # Right names of one length and one number of bits have the same least numbers of common bits.
        kinds, self.kind = np.unique(self.length[lefts:] * (BITS + 1) + self.set[lefts:], return_inverse=True)
        self.kinds = kinds // (BITS + 1), kinds % (BITS + 1)
        self.tables: tuple[np.ndarray, np.ndarray] | None = None

    def signatures(self) -> np.ndarray:
        """64 bits of each name: one for a character and how often it stood before. The most frequent of these share no bit."""
        kinds, filled = int(self.codes.max(initial=0)) + 1, self.length > 0
        key = np.sort(np.repeat(np.arange(len(self.length)), self.length) * kinds + self.codes)
        place, new = np.arange(len(key)), np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        before = np.minimum(place - np.maximum.accumulate(np.where(new, place, 0)), BITS - 1)
        bit = np.left_shift(np.uint64(1), (by_frequency(before * kinds + key % kinds) % BITS).astype(np.uint64))
        bits = np.zeros(len(self.length), dtype=np.uint64)
        if len(key):
            bits[filled] = np.bitwise_or.reduceat(bit, self.starts[filled])
        return bits

    def least_common(self, a: int, b: int) -> np.ndarray:
        """For each of the left names ``a`` to ``b`` and each kind of right name: the fewest common bits with which one can be alike to the other or part of it."""
        n, set_n, (m, set_m) = self.length[a:b, None], self.set[a:b, None], self.kinds
        ratio = np.ceil(LEAST_RATIO / 2 * (n + m) - 1e-9) + np.maximum(set_n - n, set_m - m)
        part = np.where(n < m, set_n, np.where(n > m, set_m, np.maximum(set_n, set_m)))
        return np.clip(np.minimum(ratio, part), 0, BITS + 1).astype(np.uint8)

    def masks(self) -> tuple[np.ndarray, np.ndarray]:
        """Of left names up to 64 characters the class of each character; of right ones the places of each class as bits. Class ``CLASSES`` stands nowhere."""
        if self.tables is None:
            short = np.where(self.length <= BITS, self.length, 0)
            most = int(short[: self.lefts].max(initial=0))
            left = np.full((self.lefts, most), CLASSES, dtype=np.int64)
            right = np.zeros((len(self.length) - self.lefts, CLASSES + 1), dtype=np.uint64)
            for k in range(int(short.max(initial=0))):
                rows = np.flatnonzero(short > k)
                found, cut = self.codes[self.starts[rows] + k] % CLASSES, np.searchsorted(rows, self.lefts)
                if cut:
                    left[rows[:cut], k] = found[:cut]
                right[rows[cut:] - self.lefts, found[cut:]] |= np.uint64(1 << k)
            self.tables = left, right
        return self.tables

    def could(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether left names ``i`` and right names ``j`` can be alike or one part of the other, by the length of their longest common subsequence (all pairs at once, a bit a place); longer names than a word has bits can."""
        left, right = self.masks()
        n, m = self.length[i], self.length[self.lefts + j]
        apart = np.full(len(i), (1 << BITS) - 1, dtype=np.uint64)
        for k in range(left.shape[1]):
            met = apart & right[j, left[i, k]]
            apart = (apart + met) | (apart - met)
        common = np.bitwise_count(~apart & ((np.uint64(1) << np.minimum(m, BITS - 1).astype(np.uint64)) - np.uint64(1) | np.where(m >= BITS, np.uint64(1 << (BITS - 1)), np.uint64(0))))
        return (n > BITS) | (m > BITS) | (2 * common >= LEAST_RATIO * (n + m) - 1e-9) | (common >= np.minimum(n, m))


def alike_rows(home: Names, away: Names, t1: np.ndarray, t2: np.ndarray, seconds: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the left and right rows whose two names can be alike and whose times are at most ``seconds`` apart. Both sides are sorted by time."""
    h1, h2, a1, a2 = home.bits[: len(t1)], home.bits[len(t1) :], away.bits[: len(t1)], away.bits[len(t1) :]
    for a in range(0, len(t1), ROWS):
        b = min(a + ROWS, len(t1))
        first, last = np.searchsorted(t2, t1[a] - seconds), np.searchsorted(t2, t1[b - 1] + seconds, side="right")
        if first == last:
            continue
        of_home, of_away = home.least_common(a, b), away.least_common(a, b)
        for c in range(first, last, COLUMNS):
            d = min(c + COLUMNS, last)
            i, j = np.nonzero(np.bitwise_count(h1[a:b, None] & h2[c:d]) >= np.take(of_home, home.kind[c:d], axis=1))
            kept = np.bitwise_count(a1[a + i] & a2[c + j]) >= of_away[i, away.kind[c + j]]
            i, j = a + i[kept], c + j[kept]
            kept = np.abs(t1[i] - t2[j]) <= seconds
            i, j = i[kept], j[kept]
            for names in (home, away):
                kept = names.could(i, j)
                i, j = i[kept], j[kept]
            if len(i):
                yield i, j


def ratios(a: pa.Array, b: pa.Array) -> pa.Array:
    """``sequence_ratio`` of names side by side, null where one holds the other: ``plain_similarity`` decides there."""
    found = []
    for x, y in zip(a.to_pylist(), b.to_pylist()):
        held = min(len(x), len(y)) >= 4 and (x in y or y in x)
        found.append(None if held else difflib.SequenceMatcher(None, x, y).ratio())
    return pa.array(found, pa.float64())


def near_pairs(left: DataFrame, right: DataFrame, minutes: int) -> DataFrame:
    """Pairs whose times are at most ``minutes`` apart and whose names can be alike: ``id1, h1, a1, t1, id2, h2, a2, t2, rh, ra``, the ratios last (null where one name holds the other).

    The sides have ``id1, h1, a1, t1`` and ``id2, h2, a2, t2``, times in
    seconds. Rows meet in buckets of time; there bounds are taken of all pairs
    at once in arrays, first by common characters, then by the longest common
    subsequence, so that a pair that can't be alike never becomes a row, and the
ratio is taken of what is left, as Spark has no such function. The
    pairs of a bucket grow with its square, at some nanoseconds each; a task
    holds one part of either side.
    """
    reach, width, spark = 60 * minutes, 60 * minutes * BUCKET, left.sparkSession
    bucket = lambda c: F.floor(c / width)
    a = left.dropna().withColumn("bucket", bucket(F.col("t1")))
    b = right.dropna().withColumn("bucket", F.explode(F.array_distinct(F.array(bucket(F.col("t2") - reach), bucket(F.col("t2") + reach)))))
    # Only buckets of more than PART rows, so these are few.
    sizes = a.select("bucket", F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.select("bucket", F.lit(0), F.lit(1))).groupBy("bucket").agg(*[F.ceil(F.sum(c) / PART).alias(c) for c in "xy"])
    large = F.broadcast(sizes.where("x > 1 or y > 1"))

    def side(rows: DataFrame, k: int) -> DataFrame:
        parts = rows.join(large, "bucket", "left").withColumns({c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)).cast("int") for c in "xy"})
        own, other = ("x", "y") if k == 1 else ("y", "x")
        dealt = parts.withColumn(f"part_{own}", F.pmod(F.xxhash64(f"id{k}", f"h{k}", f"a{k}"), own).cast("int")).withColumn(f"part_{other}", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        ids = [F.col(f"id{n}") if n == k else F.lit(None).cast(kind).alias(f"id{n}") for n, kind in ((1, left.schema["id1"].dataType), (2, right.schema["id2"].dataType))]
        return dealt.select("bucket", "part_x", "part_y", F.lit(k).alias("side"), *ids, F.col(f"h{k}").alias("h"), F.col(f"a{k}").alias("a"), F.col(f"t{k}").alias("t"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by([("side", "ascending"), ("t", "ascending")]).combine_chunks()
        lefts = pc.sum(pc.equal(rows["side"], 1)).as_py()
        if not 0 < lefts < rows.num_rows:
            return
        home, away = (Names(rows[c].combine_chunks(), lefts) for c in "ha")
        t = rows["t"].to_numpy()
        sides = [rows.slice(0, lefts).select(["id1", "h", "a", "t"]), rows.slice(lefts).select(["id2", "h", "a", "t"])]

        def made(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            taken = [s.take(pa.array(np.concatenate(which))) for s, which in zip(sides, zip(*found))]
            table = pa.table([c for s in taken for c in s.columns], names=["id1", "h1", "a1", "t1", "id2", "h2", "a2", "t2"]).combine_chunks()
            for batch in table.to_batches(PAIRS):
                told = [ratios(batch.column(f"{c}1"), batch.column(f"{c}2")) for c in "ha"]
                yield pa.record_batch([*batch.columns, *told], names=[*batch.schema.names, "rh", "ra"])

        found = []
        for pair in alike_rows(home, away, t[:lefts], t[lefts:], reach):
            found.append(pair)
            if sum(len(i) for i, _ in found) >= PAIRS:
                yield from made(found)
                found = []
        if found:
            yield from made(found)

    # A given number of tasks: buckets of few bytes are much work, and would else be put together. Each writes a file for every task after it, so not too many.
    tasks = 3 * spark.sparkContext.defaultParallelism
    keys = ["bucket", "part_x", "part_y"]
    shape = T.StructType([*left.select("id1", "h1", "a1", "t1").schema, *right.select("id2", "h2", "a2", "t2").schema, *[T.StructField(c, T.DoubleType()) for c in ("rh", "ra")]])
    return side(a, 1).union(side(b, 2)).repartition(tasks, *keys).groupBy(*keys).applyInArrow(meet, shape)


def resolve(left: DataFrame, right: DataFrame, minutes: int = 180, least: float = 0.82, margin: float = 0.05, aliases: DataFrame | None = None) -> DataFrame:
    """Best right match of each left row, judged by its margin.

    Both sides have ``id, home, away, kickoff``; ``aliases`` may give names
    their ``canonical`` one. Candidates come from ``near_pairs``: kickoffs at
    most ``minutes`` apart, and no bound that forbids the names to be alike.
    Confidence is .4 home + .4 away + .2 nearness.
    """

    def side(rows: DataFrame, k: int) -> DataFrame:
        if aliases is not None:
            for c in ("home", "away"):
                named = aliases.select(F.col("name").alias(c), F.col("canonical").alias("_canonical"))
                rows = rows.join(named, c, "left").withColumn(c, F.coalesce("_canonical", c)).drop("_canonical")
        return rows.select(F.col("id").alias(f"id{k}"), F.col("home").alias(f"h{k}"), F.col("away").alias(f"a{k}"), F.unix_seconds(F.col("kickoff").cast("timestamp")).alias(f"t{k}"))

    pairs, apart = near_pairs(side(left, 1), side(right, 2), minutes), F.abs(F.col("t1") - F.col("t2")) / 60
    for x in "ha":
        pairs = pairs.withColumn(f"s{x}", F.coalesce(plain_similarity(F.col(f"{x}1"), F.col(f"{x}2")), F.when(F.col(f"r{x}") >= LEAST_RATIO, 0.92 * F.col(f"r{x}")), F.lit(0.0)))
    fit = pairs.where("sh >= 0.75 and sa >= 0.75").withColumn("confidence", F.round(0.4 * F.col("sh") + 0.4 * F.col("sa") + 0.2 * (1 - apart / minutes), 6))
    order = Window.partitionBy("id1").orderBy(F.desc("confidence"), "id2")
    best = fit.withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("confidence").over(order)).where("place = 1")
    best = best.select(F.col("id1").alias("left_id"), F.col("id2").alias("right_id"), "confidence", "next")
    status = F.when(F.col("confidence").isNull(), "none").when(F.col("confidence") < least, "low").when(F.col("confidence") - F.coalesce("next", F.lit(0.0)) < margin, "ambiguous").otherwise("exact")
    return left.select(F.col("id").alias("left_id")).join(best, "left_id", "left").select("left_id", F.when(status == "exact", F.col("right_id")).alias("right_id"), "confidence", status.alias("status"))


def verified(target_home: Column, target_away: Column, home: Column, away: Column, target_kickoff: Column, kickoff: Column, minutes: int = 180) -> Column:
    """Why a page is not the wanted match: names that are too unlike, or times too far apart; an empty array where it is."""
    def alike(a: Column, b: Column) -> Column:
        ratio = sequence_ratio(a, b)
        return F.coalesce(plain_similarity(a, b), F.when(ratio >= LEAST_RATIO, 0.92 * ratio), F.lit(0.0))

    apart = F.abs(F.unix_seconds(target_kickoff.cast("timestamp")) - F.unix_seconds(kickoff.cast("timestamp"))) / 60
    return F.array_compact(F.array(F.when(alike(target_home, home) < 0.75, "HOME_TEAM_MISMATCH"), F.when(alike(target_away, away) < 0.75, "AWAY_TEAM_MISMATCH"), F.when(apart > minutes, "KICKOFF_MISMATCH")))


def pair_or_number(reports: DataFrame, fixtures: DataFrame) -> DataFrame:
    """A report's fixture by exact name pair, else the newest one of its match number and business date."""
    by_pair = fixtures.groupBy("pair").agg(F.max_by("fixture_id", F.struct("updated", "fixture_id")).alias("of_pair"))
    by_number = fixtures.groupBy("match_num", "business_date").agg(F.max_by("fixture_id", F.struct("updated", "fixture_id")).alias("of_number"))
    found = reports.join(by_pair, "pair", "left").join(by_number, ["match_num", "business_date"], "left")
    basis = F.when(F.col("of_pair").isNotNull(), "pair").when(F.col("of_number").isNotNull(), "number")
    return found.select("report_id", F.coalesce("of_pair", "of_number").alias("fixture_id"), basis.alias("basis"))


def unique_or_null(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """The value of each key if it has exactly one."""
    return pairs.groupBy(key).agg(F.countDistinct(value).alias("candidates"), F.min(value).alias("v")).select(key, "candidates", F.when(F.col("candidates") == 1, F.col("v")).alias(value))
