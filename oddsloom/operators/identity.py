"""Who is who: cleaned names, alias groups, bindings to providers, events of a pair, and alike pairs without a time."""

from __future__ import annotations

import difflib
import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsloom.functions.parse import compact_name
from oddsloom.functions.text import fold, normal_name
from oddsloom.operators.resolve import ratio_bound, sequence_ratio, signature
from oddsloom.operators.scores import held

#: Markers behind a displayed name (home, neutral, women, youth).
_MARKERS = re.compile(r"[\(（\[]\s*(?:主|中|中立|女|女子|U\d{1,2})\s*[\)）\]]", re.IGNORECASE)
_TAG = re.compile(r"<[^>]*>")


@F.pandas_udf(T.StringType())
def clean_name(names: pd.Series) -> pd.Series:
    """A name as a page shows it, without entities, tags and markers, in compatible characters (Spark has neither). Null is ""."""
    return names.map(lambda x: unicodedata.normalize("NFKC", _MARKERS.sub("", _TAG.sub("", html.unescape(x or "")))).strip())


def name_forms(name: Column) -> tuple[Column, Column]:
    """A name's two keys: normalised and compact."""
    cleaned = clean_name(name)
    return normal_name(cleaned), compact_name(cleaned)


def _checkpointed(frame: DataFrame) -> DataFrame:
    spark = frame.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and _local(spark):
            where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/oddsloom-work"
        if not where:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(where)
    return frame.checkpoint()


def _local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")


def linked_groups(links: DataFrame, rounds: int = 50) -> DataFrame:
    """``(name, label)`` for every name of links ``(a, b)``: the smallest name that it is linked to over any chain.

    Each round takes the smallest label of the neighbours and then the label
    of that label, so chains halve; a name with very many links is a grouped
    minimum like any other.
    """
    both = _checkpointed(links.where("a is not null and b is not null").select("a", "b").union(links.select("b", "a")).where("a is not null and b is not null").distinct())
    labels = _checkpointed(both.groupBy(F.col("a").alias("name")).agg(F.least(F.col("name"), F.min("b")).alias("label")))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("name").alias("b"), "label"), "b").groupBy(F.col("a").alias("name")).agg(F.min("label").alias("near"))
        least = labels.join(near, "name").select("name", F.least("label", "near").alias("next"), "label")
        jumped = least.join(labels.select(F.col("name").alias("next"), F.col("label").alias("far")), "next").select("name", F.least("next", "far").alias("next"), "label")
        step = _checkpointed(jumped)
        labels = step.select("name", F.col("next").alias("label"))
        if step.where("next <> label").isEmpty():
            return labels
    raise RuntimeError(f"groups did not settle in {rounds} rounds")


def alias_groups(registry: DataFrame) -> DataFrame:
    """``(name, canonical)`` of all name forms in a registry ``(canonical, aliases array)``.

    Rows that share any form are one group, over chains of any length; its
    canonical name is the smallest of its rows' normalised canonical names.
    Empty forms link nothing.
    """
    rows = registry.withColumn("alias", F.explode(F.array_union(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))))
    head = name_forms(F.col("canonical"))[0]
    forms = name_forms(F.col("alias"))
    named = rows.select(head.alias("own"), F.array(*forms).alias("forms")).select("own", F.explode("forms").alias("form")).where("own <> '' and form <> ''").distinct()
    named = _checkpointed(named)
    groups = _checkpointed(linked_groups(named.select(F.col("own").alias("a"), F.col("form").alias("b"))))
    best = named.select(F.col("own").alias("name")).distinct().join(groups, "name").groupBy("label").agg(F.min("name").alias("canonical"))
    return groups.join(best, "label").select("name", "canonical")


def canonical_names(rows: DataFrame, column: str, groups: DataFrame, out: str) -> DataFrame:
    """Add the canonical name of ``column``: of its normalised form, else of its compact form, else the normalised form itself."""
    normal, compact = name_forms(F.col(column))
    keyed = held(rows, {"_n": normal, "_c": compact})
    of_normal, of_compact = (groups.select(F.col("name").alias(k), F.col("canonical").alias(f"{k}g")) for k in ("_n", "_c"))
    return keyed.join(of_normal, "_n", "left").join(of_compact, "_c", "left").withColumn(out, F.coalesce("_ng", "_cg", "_n")).drop("_n", "_c", "_ng", "_cg")


def identity_aliases(rows: DataFrame, canonical_id: str) -> DataFrame:
    """Every name that a fixture goes by, in a row each: ``(canonical_id, alias)``.

    Ids are those of ``id, match_id, match_key, shuju_id, nowscore_id`` that
    the rows have; empty ones are none.
    """
    ids = [F.col(c).cast("string") for c in ("id", "match_id", "match_key", "shuju_id", "nowscore_id") if c in rows.columns]
    if "shuju_id" in rows.columns:
        ids.append(F.when(F.col("shuju_id").cast("string") != "", F.concat(F.lit("shuju:"), F.col("shuju_id").cast("string"))))
    pair = (F.coalesce(F.col("home"), F.lit("")) != "") & (F.coalesce(F.col("away"), F.lit("")) != "")
    ids += [F.when(pair, F.concat("home", F.lit(by), "away")) for by in ("|", " vs ")]
    return rows.select(F.col(canonical_id), F.explode(F.array(F.col(canonical_id), *ids)).alias("alias")).where("alias <> ''").distinct()


BINDING = ("match_key", "provider")


def upsert_bindings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Bindings ``(match_key, provider, provider_id, confidence, verification, home, away, verified_at)`` with new ones taken in.

    Of one match and provider the newest stands (the larger provider id at one
    time); what the match itself is called stays as it was first told.
    """
    both = old.unionByName(new)
    told = F.struct("provider_id", F.round("confidence", 6).alias("confidence"), "verification", "verified_at")
    newest = both.groupBy(*BINDING).agg(F.max_by(told, F.struct("verified_at", "provider_id")).alias("b"))
    names = both.groupBy("match_key").agg(F.min_by(F.struct("home", "away"), F.struct("verified_at", "provider_id")).alias("m"))
    return newest.join(names, "match_key").select(*BINDING, "b.*", "m.*")


def prebound(fixtures: DataFrame, bindings: DataFrame, provider: str, least: float = 0.0) -> DataFrame:
    """Fixtures ``(match_key, ...)`` with the provider's id that is already known of them, null where none is or it is too uncertain."""
    known = bindings.where((F.col("provider") == provider) & (F.col("confidence") >= least)).select("match_key", "provider_id", "confidence")
    return fixtures.join(known, "match_key", "left")


#: Rows of a table that is sent to every task; larger ones are joined by shuffle.
SENT = 250_000

#: Targets and markets that are compared at once, and rows that a task returns at once.
COMPARED, RETURNED = 1_000_000, 100_000
_DIGITS = Context(prec=400, rounding=ROUND_HALF_UP)


def _rounded(x: np.ndarray) -> np.ndarray:
    """To six places as Spark rounds: halves of the digits shown go away from zero."""
    y, size = np.round(x, 6), np.where(np.isfinite(x), np.abs(x), 0.0)
    for i in np.flatnonzero((np.abs(size * 1e6 % 1 - 0.5) < 1e-3) | (size > 1e9)):
        y[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("1e-6"), context=_DIGITS))
    return y


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it; the first row does."""
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]) if len(columns[0]) else np.zeros(0, int)


def _met_near(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``events_of_pairs``: the best group within ``width`` seconds of each target, and how many groups without timeless markets are.

    Rows come sorted by pair, slot, group and time, targets (without a group)
    first. A task holds the rows of one pair and slot, besides those of a batch.
    """

    def best(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        number = lambda c, none=0: rows[c].fill_null(none).to_numpy()
        pair, slot, group, id_of = number("pair"), number("slot"), rows["group_id"].combine_chunks(), rows["id"].combine_chunks()
        target = group.is_null().to_numpy(zero_copy_only=False)
        cell = np.zeros(len(pair), int)
        cell[_changes(pair, slot)[1:]] = 1
        cell = np.cumsum(cell)
        of_targets, of_markets = np.flatnonzero(target), np.flatnonzero(~target)
        time, names = number("t"), group.take(pa.array(of_markets))
        t2, markets, liquidity, m0, l0 = time[of_markets], *(number(c)[of_markets] for c in ("markets", "liquidity", "m0", "l0"))
        run = names.dictionary_encode().indices.to_numpy()
        # Targets of one cell and time meet the same.
        t1, home = time[of_targets], cell[of_targets]
        firsts = _changes(home, t1)
        which = np.repeat(np.arange(len(firsts)), np.diff(np.r_[firsts, len(t1)]))
        t1, home = t1[firsts], home[firsts]
        start, end = (np.searchsorted(cell[of_markets], home, side) for side in ("left", "right"))
        n = end - start
        found = {c: np.zeros(len(t1), kind) for c, kind in (("at", int), ("markets", int), ("apart", int), ("groups", int), ("liquidity", float))}
        ends = np.cumsum(n)
        low = 0
        while low < len(t1):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] - n[low] + COMPARED, "right")))
            met = n[low:high]
            at = np.arange(met.sum()) + np.repeat(start[low:high] - (ends[low:high] - met - (ends[low] - n[low])), met)
            apart = np.abs(t2[at] - np.repeat(t1[low:high], met))
            near = np.flatnonzero(apart <= width)
            at, apart, who = at[near], apart[near], np.repeat(np.arange(low, high), met)[near]
            low = high
            if not len(at):
                continue
            one = _changes(who, run[at])
            of, first = who[one], at[one]
            count = np.add.reduceat(markets[at], one) + m0[first]
            total = np.add.reduceat(liquidity[at], one) + l0[first]
            apart = np.minimum.reduceat(apart, one)
            # Most markets, then most liquidity (no number is least), then the group that comes first.
            own = _changes(of)
            spread = lambda x: np.repeat(x, np.diff(np.r_[own, len(of)]))
            shown = _rounded(total)
            most = count == spread(np.maximum.reduceat(count, own))
            much = spread(np.fmax.reduceat(np.where(most, shown, np.nan), own))
            most &= (shown == much) | (np.isnan(shown) & np.isnan(much))
            place = np.minimum.reduceat(np.where(most, np.arange(len(of)), len(of)), own)
            for c, x in (("at", first[place]), ("markets", count[place]), ("apart", apart[place]), ("liquidity", total[place]), ("groups", np.add.reduceat((m0[first] == 0).astype(int), own))):
                found[c][of[own]] = x
        found = {c: x[which] for c, x in found.items()}
        none = found["markets"] == 0
        for i in range(0, len(none), RETURNED):
            cut = slice(i, i + RETURNED)
            columns = {"id": id_of.take(pa.array(of_targets[cut])), "pair": pa.array(pair[of_targets[cut]])}
            columns |= {c: pa.array(found[c][cut], mask=none[cut]) for c in ("markets", "apart")} | {"groups": pa.array(found["groups"][cut])}
            columns |= {"liquidity": pa.array(found["liquidity"][cut], mask=none[cut]), "group_id": names.take(pa.array(found["at"][cut], mask=none[cut]))}
            yield pa.record_batch(columns)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if batch.num_rows:
                pair, slot = (batch.column(c).to_numpy() for c in ("pair", "slot"))
                starts = _changes(pair, slot)
                if last == (pair[0], slot[0]):
                    starts = starts[1:]
                if len(starts):
                    held.append(batch.slice(0, starts[-1]))
                    yield from best(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(starts[-1] if len(starts) else 0))
                last = (pair[-1], slot[-1])
        if held:
            yield from best(pa.Table.from_batches(held))

    return meet


def events_of_pairs(targets: DataFrame, markets: DataFrame, hours: float = 18.0) -> DataFrame:
    """The group of markets of each target's exact pair, near its kickoff.

    ``targets``: ``id, home, away, kickoff``; ``markets``: ``group_id, title,
    at, liquidity``. A title fits that is the pair ("a vs b" or "a v b") or
    begins with it, in folded words; so a title is looked up by each of its
    beginnings after the word between, never by comparing all. Times must be
    within ``hours`` where both are there: both sides meet in time slots of
    four times that length. Of several groups the one with most markets
    counts, then with most liquidity, then the smaller id.
    """
    width = int(hours * 3600)
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    # Slots are long, so that few markets are near two of them.
    slot = lambda t: F.floor(t / (4 * max(width, 1)))
    # Equal names and equal titles are folded once, and rows go by a number of their pair, not by names.
    sides = _checkpointed(targets.select("home", "away").distinct().select("home", "away", fold("home").alias("h"), fold("away").alias("a")).where("h <> '' and a <> ''"))
    pairs = _checkpointed(sides.select("h", "a").distinct().withColumn("pair", F.monotonically_increasing_id()))
    sent = F.broadcast if sides.count() <= SENT else lambda frame: frame
    t = targets.join(sent(sides.join(pairs, ["h", "a"]).select("home", "away", "pair")), ["home", "away"], "left").select("id", "pair", seconds("kickoff").alias("t1"))
    # Both words between have one length, so a title fits a pair by one beginning at most.
    starts = "filter(transform(w, (x, i) -> if(i > 1 and exists(slice(w, 2, i - 1), y -> y in ('vs', 'v')), array_join(slice(w, 1, i + 1), ' '), null)), x -> x is not null)"
    labels = pairs.withColumn("label", F.explode(F.array(*[F.concat("h", F.lit(by), "a") for by in (" vs ", " v ")])))
    grouped = markets.where("coalesce(group_id, '') <> ''")
    titles = _checkpointed(grouped.select("title").distinct().withColumn("w", F.split(fold("title"), " ")).withColumn("label", F.explode(F.expr(starts))).join(labels, "label").select("title", "pair"))
    known = F.broadcast(titles) if titles.count() <= SENT else titles
    m = grouped.select(F.col("group_id").cast("string").alias("group_id"), "title", seconds("at").alias("t2"), F.coalesce("liquidity", F.lit(0.0)).alias("liquidity")).join(known, "title").select("pair", "group_id", "t2", "liquidity")
    # Markets are dealt once by pair and group, for all that is counted of a group.
    m = m.repartition("pair", "group_id")
    # The smallest of negated counts, so that of equal groups the smaller id counts.
    rank = lambda markets, liquidity, apart: F.struct((-markets).alias("m"), (-F.round(liquidity, 6)).alias("l"), "group_id", apart.alias("apart"))
    never = F.lit(None).cast("long")
    timeless = F.col("t2").isNull()
    # A time is missing: all targets of a pair meet the same markets, which are counted once for the pair.
    whole = m.groupBy("pair", "group_id").agg(F.count("*").alias("markets"), F.sum("liquidity").alias("liquidity"), F.count_if(timeless).alias("m0"), F.sum(F.when(timeless, F.col("liquidity"))).alias("l0"))
    of_all, of_timeless = rank(F.col("markets"), F.col("liquidity"), never), F.when(F.col("m0") > 0, rank(F.col("m0"), F.col("l0"), never))
    standing = whole.groupBy("pair").agg(F.min(of_all).alias("b1"), F.count("*").alias("g1"), F.min(of_timeless).alias("b0"), F.count_if(F.col("m0") > 0).alias("g0"))
    by_group = Window.partitionBy("pair", "group_id")
    entries = m.groupBy("pair", "group_id", "t2").agg(F.count("*").alias("markets"), F.sum("liquidity").alias("liquidity"))
    entries = entries.withColumn("m0", F.sum(F.when(timeless, F.col("markets"))).over(by_group)).withColumn("l0", F.sum(F.when(timeless, F.col("liquidity"))).over(by_group)).where(~timeless)
    # A market stands in every slot that it is near to, so a slot's targets meet theirs in one task: what they meet is counted there and never shuffled.
    entries = entries.withColumn("slot", F.explode(F.sequence(slot(F.col("t2") - width), slot(F.col("t2") + width)))).withColumnRenamed("t2", "t")
    timed = t.where("t1 is not null and pair is not null").select("id", "pair", slot(F.col("t1")).alias("slot"), F.col("t1").alias("t"))
    # Targets have no group, so they come first.
    dealt = entries.unionByName(timed, allowMissingColumns=True).select("pair", "slot", "group_id", "t", "markets", "liquidity", "m0", "l0", "id").repartition("pair", "slot").sortWithinPartitions("pair", "slot", "group_id", "t")
    shape = T.StructType([T.StructField("id", t.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in ("pair", "markets", "apart", "groups")), T.StructField("liquidity", T.DoubleType()), T.StructField("group_id", T.StringType())])
    # A group near by has more markets than its timeless ones alone, so those never pass it.
    met = dealt.mapInArrow(_met_near(width), shape).withColumn("b", F.when(F.col("markets").isNotNull(), rank(F.col("markets"), F.col("liquidity"), F.col("apart")))).select("id", "pair", F.lit(True).alias("timed"), "b", "groups")
    rows = met.unionByName(t.where("t1 is null or pair is null").select("id", "pair", F.lit(False).alias("timed")), allowMissingColumns=True).join(sent(standing), "pair", "left")
    count = F.when(F.col("timed"), F.coalesce("groups", F.lit(0)) + F.coalesce("g0", F.lit(0))).otherwise(F.coalesce("g1", F.lit(0)))
    rows = rows.select("id", F.when(F.col("timed"), F.least("b", "b0")).otherwise(F.col("b1")).alias("b"), count.alias("groups"))
    return rows.select("id", F.when(F.col("b").isNull(), "no_exact_event").otherwise("exact_event").alias("status"), "b.group_id", (-F.col("b.m")).alias("markets"), F.round(-F.col("b.l"), 6).alias("liquidity"), "groups", F.round(F.col("b.apart") / 3600, 4).alias("hours_apart"))


#: Fixed value: the mean ratio of both names from which a pair counts as the same.
ALIKE = 0.72


#: Names of a block. Two blocks meet in a matrix of this size squared, whatever the number of names.
BLOCK = 1000


def _blocks(names: DataFrame, k: int) -> DataFrame:
    """Distinct names in blocks of about ``BLOCK``, of one length each: ``name, bits`` as arrays, and the length."""
    signed = _checkpointed(held(names.select("name").where("name <> ''").distinct(), {"bits": signature(F.col("name"))}).withColumn("n", F.length("name")))
    sizes = signed.groupBy("n").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = signed.join(F.broadcast(sizes), "n").withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")))
    return dealt.groupBy("n", "block").agg(F.collect_list(F.struct("name", "bits")).alias("x")).select(F.col("n").alias(f"s{k}"), F.col("x.name").alias(f"n{k}"), F.col("x.bits").alias(f"b{k}"))


def alike_names(left: DataFrame, right: DataFrame, least: float = ALIKE) -> DataFrame:
    """``(l, r, ratio)`` of distinct names whose ratio is at least ``least``; both sides have a column ``name``.

    Names are dealt into blocks of one length, and each two blocks whose
    lengths allow the ratio meet in one row. There the bound of ``ratio_bound``
    is taken for all their pairs at once, from a signature made once a name;
    the ratio only of the few pairs that it leaves. Pairs are met once, nothing
    but blocks is shuffled, and no more than two blocks are held at a time.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = difflib.SequenceMatcher(None)
        for batch in batches:
            for row in range(batch.num_rows):
                (n, m), names, bits = ([batch.column(f"{c}{k}")[row] for k in (1, 2)] for c in "snb")
                n, m, names = n.as_py(), m.as_py(), [x.as_py() for x in names]
                a, b = (x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in bits)
                lost = [np.bitwise_count(a[:, None] & ~b), np.bitwise_count(~a[:, None] & b)]
                could = 2.0 * np.minimum(n - lost[0].astype(int), m - lost[1]) / (n + m) >= least - 1e-9
                found = []
                # The matcher keeps what it knows of its second text.
                for j in np.flatnonzero(could.any(axis=0)):
                    matcher.set_seq2(names[1][j])
                    for i in np.flatnonzero(could[:, j]):
                        matcher.set_seq1(names[0][i])
                        ratio = matcher.ratio()
                        if ratio >= least:
                            found.append((names[0][i], names[1][j], ratio))
                l, r, ratio = zip(*found) if found else ((), (), ())
                yield pa.record_batch({"l": pa.array(l, pa.string()), "r": pa.array(r, pa.string()), "ratio": pa.array(ratio, pa.float64())})

    fits = (F.col("s1") * (2 - least) >= F.col("s2") * least - 1e-9) & (F.col("s2") * (2 - least) >= F.col("s1") * least - 1e-9)
    met = _blocks(left, 1).join(_blocks(right, 2), fits)
    tasks = max(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * met.sparkSession.sparkContext.defaultParallelism)
    return met.repartition(tasks).mapInArrow(meet, "l string, r string, ratio double")


def alike_pairs(left: DataFrame, right: DataFrame, least: float = ALIKE) -> DataFrame:
    """For each left row ``(id, home, away)`` the right row whose pair is the same, else most alike: ``left_id, right_id, score, basis``.

    The score is the mean of both names' ratios. It reaches ``least`` only if
    one of the ratios does, so pairs meet through alike home names or alike
    away names; the other ratio is taken where its bound, from signatures made
    once a pair, can make up the rest. Equal scores go to the smaller id. Rows
    with equal pairs are looked up once, and those with a same pair on the
    right need no alike one.
    """
    bits = lambda k: {f"{x}b{k}": signature(F.col(f"{x}{k}")) for x in "ha"}
    a = left.select(F.col("home").alias("h1"), F.col("away").alias("a1")).distinct()
    b = right.groupBy(F.col("home").alias("h2"), F.col("away").alias("a2")).agg(F.min("id").alias("right_id"))
    two = _checkpointed(held(b, bits(2)))
    named = _checkpointed(a.join(two.select(F.col("h2").alias("h1"), F.col("a2").alias("a1"), "right_id", F.lit(True).alias("same")), ["h1", "a1"], "left"))
    exact = named.where("same").select("h1", "a1", "right_id", F.lit(1.0).alias("score"), F.lit("exact").alias("basis"))
    one = _checkpointed(held(named.where("same is null").select("h1", "a1"), bits(1)))
    names = lambda rows, c: rows.select(F.col(c).alias("name"))
    found = exact
    for x, y in (("h", "a"), ("a", "h")):
        strong = alike_names(names(one, f"{x}1"), names(two, f"{x}2"), least).select(F.col("l").alias(f"{x}1"), F.col("r").alias(f"{x}2"), F.col("ratio").alias("rx"))
        pairs = one.join(_checkpointed(strong), f"{x}1").join(two, f"{x}2")
        # The other ratio must make up the rest.
        other = ratio_bound(F.col(f"{y}1"), F.col(f"{y}2"), F.col(f"{y}b1"), F.col(f"{y}b2"))
        close = pairs.where((F.col("rx") + other) / 2 >= least - 1e-9)
        judged = close.select("h1", "a1", "right_id", ((F.col("rx") + sequence_ratio(F.col(f"{y}1"), F.col(f"{y}2"))) / 2).alias("score")).where(F.col("score") >= least)
        found = found.union(judged.select("h1", "a1", "right_id", "score", F.lit("alike").alias("basis")))
    best = found.groupBy("h1", "a1").agg(F.min(F.struct((F.col("basis") != "exact").alias("later"), (-F.round("score", 9)).alias("s"), "right_id", "basis")).alias("b"))
    return left.join(best, (F.col("home") == F.col("h1")) & (F.col("away") == F.col("a1")), "left").select(F.col("id").alias("left_id"), F.col("b.right_id").alias("right_id"), F.round(-F.col("b.s"), 6).alias("score"), F.coalesce("b.basis", F.lit("none")).alias("basis"))
