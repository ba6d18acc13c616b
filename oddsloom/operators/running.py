"""Running values over histories of any length, as two-level scans.

A key's history is cut into slices of whole time units with about so many
rows each; no task ever orders more than a slice. Each slice yields a state
that can be combined (sum, peak, lowest point, drawdown, any); the states of a
key, a row for each slice, are scanned, and what they carry is joined back to
the slices. Results are those of one window over the whole key.

Null times come first; rows of a null key form a key of their own; equal times
are ordered by the further order columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLICE_ROWS = 200_000
#: Microseconds of a unit that is never cut: a slice has at least one.
UNIT = 60_000_000
#: Stands for no time: before all times.
NEVER = -(1 << 62)


def micros(at: Column) -> Column:
    return F.coalesce(F.unix_micros(at.cast("timestamp")), F.lit(NEVER))


def sliced(rows: DataFrame, key: str, us: str, slice_rows: int = SLICE_ROWS, unit: int = UNIT) -> DataFrame:
    """Add ``slice``, ascending with the time ``us`` inside a key. What is windowed here has a row for each time unit, not for each row."""
    rows = rows.withColumn("_unit", F.floor(F.col(us) / unit))
    units = rows.groupBy(F.col(key).alias("_key"), F.col("_unit").alias("_u")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_u").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    units = units.withColumn("slice", F.floor(before / slice_rows)).drop("_n")
    return rows.join(units, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_unit") == F.col("_u"))).drop("_key", "_u", "_unit")


def _carried(states: DataFrame, key: str, **columns: Column) -> DataFrame:
    """For each slice what its key's earlier slices come to; ``columns`` are aggregates over them."""
    earlier = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return states.select(F.col(key).alias("_key"), F.col("slice").alias("_slice"), *[c.over(earlier).alias(n) for n, c in columns.items()])


def _with_carry(rows: DataFrame, carry: DataFrame, key: str) -> DataFrame:
    return rows.join(carry, F.col(key).eqNullSafe(F.col("_key")) & (F.col("slice") == F.col("_slice"))).drop("_key", "_slice")


def running(rows: DataFrame, key: str, us: str, order: list[str], sums: dict[str, Column], any_of: dict[str, Column] | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add running sums and running flags, each row counted, in order of time and ``order``."""
    any_of = any_of or {}
    values = {f"_v_{n}": c.cast("double") for n, c in sums.items()} | {f"_v_{n}": F.coalesce(c, F.lit(False)) for n, c in any_of.items()}
    cut = sliced(rows.withColumns(values), key, us, slice_rows)
    total = lambda n: F.sum(f"_v_{n}") if n in sums else F.max(f"_v_{n}")
    states = cut.groupBy(key, "slice").agg(*[total(n).alias(f"_v_{n}") for n in (*sums, *any_of)])
    carry = _carried(states, key, **{f"_c_{n}": total(n) for n in (*sums, *any_of)})
    inside = Window.partitionBy(key, "slice").orderBy(us, *order).rowsBetween(Window.unboundedPreceding, 0)
    cut = _with_carry(cut.withColumns({n: total(n).over(inside) for n in (*sums, *any_of)}), carry, key)
    found = {n: F.coalesce(F.col(n), F.lit(0.0)) + F.coalesce(f"_c_{n}", F.lit(0.0)) for n in sums} | {n: F.col(n) | F.coalesce(f"_c_{n}", F.lit(False)) for n in any_of}
    return cut.withColumns(found).drop("slice", *[f"_{k}_{n}" for k in "vc" for n in (*sums, *any_of)])


def largest_drawdown(rows: DataFrame, key: str, us: str, order: list[str], value: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``(key, drawdown)``: how far the running sum of ``value`` ever falls below its highest point so far, which is 0 or more."""
    cut = sliced(rows, key, us, slice_rows)
    inside = Window.partitionBy(key, "slice").orderBy(us, *order).rowsBetween(Window.unboundedPreceding, 0)
    curve = cut.withColumn("_curve", F.sum(value).over(inside)).withColumn("_peak", F.max("_curve").over(inside))
    states = curve.groupBy(key, "slice").agg(F.sum(value).alias("_sum"), F.max("_curve").alias("_top"), F.min("_curve").alias("_low"), F.max(F.col("_peak") - F.col("_curve")).alias("_fall"))
    earlier = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    states = states.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)))
    states = states.withColumn("_high", F.greatest(F.lit(0.0), F.max(F.col("_before") + F.col("_top")).over(earlier)))
    # Inside a slice the fall is from its own peak or from the highest point before it.
    return states.groupBy(key).agg(F.greatest(F.lit(0.0), F.max(F.greatest(F.col("_fall"), F.col("_high") - F.col("_before") - F.col("_low")))).alias("drawdown"))


def next_value(events: DataFrame, probes: DataFrame, key: str, us: str, value: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Each probe with the first event of its key at or after its time: ``next_us`` and ``next_value``, null where none follows.

    ``events`` has ``key, us, value``; ``probes`` has ``key, us`` and columns
    of its own, which it keeps. Both go through the same slices; a slice that
    ends before an event comes takes the first event of a later one.
    """
    own = [c for c in probes.columns if c not in (key, us)]
    both = events.select(key, us, F.struct(F.col(us).alias("us"), F.col(value).alias("v")).alias("_e"), F.lit(None).cast(probes.select(F.struct(*own).alias("s")).schema["s"].dataType).alias("_p"))
    both = both.unionByName(probes.select(key, us, F.lit(None).cast(both.schema["_e"].dataType).alias("_e"), F.struct(*own).alias("_p")))
    cut = sliced(both, key, us, slice_rows)
    # From the latest back, as a frame that follows would be read anew for each row; at one time events stand before probes.
    back = Window.partitionBy(key, "slice").orderBy(F.desc(us), F.col("_e").isNotNull().desc(), F.desc("_e.v")).rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("_next", F.last("_e", ignorenulls=True).over(back))
    states = cut.where("_e is not null").groupBy(key, "slice").agg(F.min("_e").alias("_e"))
    every = cut.select(key, "slice").distinct().join(states.select(F.col(key).alias("_key"), F.col("slice").alias("_slice"), "_e"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("slice") == F.col("_slice")), "left").drop("_key", "_slice")
    later = Window.partitionBy(key).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    carry = every.select(F.col(key).alias("_key"), F.col("slice").alias("_slice"), F.last("_e", ignorenulls=True).over(later).alias("_later"))
    found = _with_carry(cut.where("_p is not null"), carry, key).withColumn("_next", F.coalesce("_next", "_later"))
    return found.select(key, us, "_p.*", F.col("_next.us").alias("next_us"), F.col("_next.v").alias("next_value"))
