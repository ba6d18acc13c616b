"""What is due, what is waiting and what was missed: queues, timers, gates and summaries of matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oddsloom.operators.lookups import knockout
from oddsloom.operators.rules import CHECKPOINTS

#: Checkpoint states that nothing is done about any more.
TERMINAL = ("report_updated", "report_failed", "source_unavailable", "captured", "historical_recovery", "late_live", "permanently_missing")
#: Minutes after the planned time in which an attempt is sent.
DISPATCH = {"primary": (0, 1), "bounded_retry": (10, 11)}
#: Minutes from kickoff to the review: of a usual match and of a single knockout one.
STANDARD_DELAY, KNOCKOUT_DELAY = 135, 195
#: Modules that a full report needs.
MODULES = ("identity", "consensus", "tiers", "flow", "trend", "exchange", "model", "scores", "rules", "price_audit")


def review_delay(text: Column, override: Column | None = None) -> Column:
    """Minutes from kickoff to a review, and why: ``minutes`` and ``basis``."""
    standard = F.when(knockout(text), F.struct(F.lit(KNOCKOUT_DELAY).alias("minutes"), F.lit("single_leg_knockout").alias("basis"))).otherwise(F.struct(F.lit(STANDARD_DELAY).alias("minutes"), F.lit("standard_90m").alias("basis")))
    return standard if override is None else F.when(override.isNotNull(), F.struct(override.cast("int").alias("minutes"), F.lit("manual_override").alias("basis"))).otherwise(standard)


def review_queue(reports: DataFrame, reviewed: DataFrame, now: Column) -> DataFrame:
    """Each report's place in the review queue; ``reports`` has ``match_id, pair, competition, kickoff``, ``reviewed`` has ``pair``."""
    done = reviewed.select("pair", F.lit(True).alias("done")).distinct()
    rows = reports.join(done, "pair", "left").withColumn("d", review_delay(F.col("competition")))
    due = F.col("kickoff") + F.make_interval(mins=F.col("d.minutes"))
    status = F.when(F.col("done"), "reviewed").when(F.col("kickoff").isNull(), "blocked_missing_kickoff").when(now < due, "waiting_for_finish").otherwise("pending_result_verification")
    return rows.select("match_id", F.col("d.minutes").alias("delay"), F.col("d.basis").alias("basis"), due.alias("due_at"), status.alias("status"))


def status_counts(queue: DataFrame) -> DataFrame:
    """Entries of each status, and the earliest and latest time that one is due."""
    return queue.groupBy("status").agg(F.count("*").alias("n"), F.min("due_at").alias("first_due"), F.max("due_at").alias("last_due"))


def should_be_finished(kickoff: Column, now: Column) -> Column:
    return F.coalesce(now >= kickoff + F.expr("interval 135 minutes"), F.lit(False))


def minutes_to(kickoff: Column, now: Column) -> Column:
    return (F.unix_seconds(kickoff.cast("timestamp")) - F.unix_seconds(now.cast("timestamp"))) / 60


def open_stages(matches: DataFrame, captured: DataFrame, now: Column, hours: int = 8) -> DataFrame:
    """Checkpoints whose time has come and that no terminal state has closed, of matches from ``hours`` before to 6 hours after kickoff.

    ``captured`` has ``match_id, stage, status``.
    """
    stages = F.array(*[F.struct(F.lit(k).alias("stage"), F.lit(v).alias("target")) for k, v in CHECKPOINTS.items()])
    left = minutes_to(F.col("kickoff"), now)
    rows = matches.select("match_id", "kickoff", left.alias("minutes"), F.explode(stages).alias("s")).where((F.col("minutes") >= -360) & (F.col("minutes") <= hours * 60) & (F.col("s.target") >= F.col("minutes")))
    # Bounds are held against exact minutes; only what is shown is rounded.
    rows = rows.select("match_id", "kickoff", F.round("minutes", 2).alias("minutes"), F.col("s.stage").alias("stage"), F.round(F.col("s.target") - F.col("minutes"), 2).alias("lateness"))
    closed = captured.where(F.col("status").isin(*TERMINAL)).select("match_id", "stage").distinct()
    rows = rows.join(closed, ["match_id", "stage"], "left_anti")
    return rows.withColumn("capture_quality", F.when(F.abs("lateness") <= 5, "on_time").otherwise("pending_recovery"))


def dispatch_attempt(lateness: Column) -> Column:
    """Which attempt a lateness in minutes falls in; null outside all windows."""
    out = None
    for name, (start, end) in DISPATCH.items():
        fits = (lateness >= start) & (lateness < end)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out


def due_events(open_rows: DataFrame, most: int = 12) -> DataFrame:
    """The first events to send: the earliest planned ones, at most ``most`` of them."""
    planned = F.col("kickoff") - F.make_interval(mins=F.round(F.col("minutes") + F.col("lateness")).cast("int"))
    return open_rows.withColumn("planned", planned).orderBy("planned", "kickoff", "match_id").limit(most).select("match_id", "stage", dispatch_attempt(F.col("lateness")).alias("attempt"))


def monitor_summary(checkpoints: DataFrame, now: Column) -> DataFrame:
    """By match: checkpoints done, pending and overdue, the last one done and the next one due.

    ``checkpoints`` has ``match_id, stage, planned, status``.
    """
    done = F.coalesce(F.col("status").isin(*TERMINAL), F.lit(False))
    return checkpoints.groupBy("match_id").agg(
        F.count("*").alias("total"), F.count_if(done).alias("completed"), F.count_if(~done).alias("pending"), F.count_if(~done & (F.col("planned") <= now)).alias("overdue"),
        F.max_by("stage", F.when(done, F.struct("planned", "stage"))).alias("latest_stage"), F.min_by("stage", F.when(~done & (F.col("planned") > now), F.struct("planned", "stage"))).alias("next_stage"),
    )


def recovered(stages: DataFrame, history: DataFrame, now: Column) -> DataFrame:
    """What becomes of checkpoints that were missed.

    One that is at most five minutes late is still live. A later one takes the
    newest history up to its planned time; without any it is taken late while
    the match has not begun, and is missing for good after kickoff. ``stages``
    has ``match_id, stage, planned, kickoff``; ``history`` ``match_id, ts,
    value``.
    """
    late = -minutes_to(F.col("planned"), now)
    met = stages.join(history.select("match_id", "ts", "value"), "match_id", "left")
    fits = F.col("ts") <= F.col("planned")
    found = met.groupBy("match_id", "stage", "planned", "kickoff").agg(F.max(F.when(fits, F.col("ts"))).alias("ts"), F.max_by("value", F.when(fits, F.struct("ts", "value"))).alias("value"))
    status = F.when(late < 0, "pending").when(late <= 5, "on_time").when(F.col("ts").isNotNull(), "historical_recovery").when(now <= F.col("kickoff"), "late_live").otherwise("permanently_missing")
    return found.select("match_id", "stage", status.alias("status"), F.when(status == "historical_recovery", F.col("value")).alias("value"))


def incomplete_modules(states: Column) -> Column:
    """Modules of a full report that a map of states does not call completed, in their order."""
    return F.filter(F.array(*[F.lit(m) for m in MODULES]), lambda m: F.coalesce(F.try_element_at(states, m), F.lit("missing")) != "completed")


def match_phase(status: Column) -> Column:
    text = F.trim(F.coalesce(status.cast("string"), F.lit("")))
    return F.when(text == "0", "pre_match").when(text == "", "unknown").otherwise("non_pre_match")


def display_ids(rows: DataFrame, key: str) -> DataFrame:
    """A day's stamp and a running number, newest first, for each row of ``key`` and ``kickoff``; without a time the stamp is HISTORY.

    Numbers run on over days: a day's rows are numbered by themselves and the
    days' totals added up, so no task sorts all rows.
    """
    day = F.coalesce(F.date_format("kickoff", "yyyyMMdd"), F.lit("HISTORY"))
    rows = rows.select(key, "kickoff", day.alias("stamp"))
    totals = rows.groupBy("stamp").agg(F.count("*").alias("n"))
    # One row a day; days without a time come last.
    newest = Window.orderBy(F.when(F.col("stamp") == "HISTORY", 1).otherwise(0), F.desc("stamp")).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("stamp", F.coalesce(F.sum("n").over(newest), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("stamp").orderBy(F.desc("kickoff"), key))
    numbered = rows.withColumn("own", own).join(before, "stamp")
    return numbered.select(key, F.concat("stamp", F.lit("-"), F.lpad((F.col("own") + F.col("before")).cast("string"), 9, "0")).alias("display_id"))


def single_profile(profiles: DataFrame) -> DataFrame:
    """The active profile of each match: its only one, or its only primary one; several without that leave it inactive."""
    sums = profiles.groupBy("match_id").agg(F.count("*").alias("n"), F.count_if("is_primary").alias("primaries"), F.min("profile_id").alias("only"), F.min(F.when(F.col("is_primary"), F.col("profile_id"))).alias("first"))
    chosen = F.when(F.col("n") == 1, F.col("only")).when(F.col("primaries") == 1, F.col("first"))
    return sums.select("match_id", chosen.alias("profile_id"), F.when(chosen.isNull(), "ambiguous").otherwise("active").alias("state"))


def settled_kpis(bets: DataFrame, key: str) -> DataFrame:
    """Settled bets of each key: hits (half wins count half), hit rate, stake, returns, profit and return on stake in percent."""
    rows = bets.where(F.col("status").isin("won", "lost", "push", "half_won", "half_lost"))
    hit = F.when(F.col("status") == "won", 1.0).when(F.col("status") == "half_won", 0.5).otherwise(0.0)
    sums = rows.groupBy(key).agg(F.count("*").alias("settled"), F.sum(hit).alias("hits"), F.round(F.sum("stake"), 4).alias("stake"), F.round(F.sum("returned"), 4).alias("returned"))
    profit = F.col("returned") - F.col("stake")
    return sums.select(key, "settled", F.round(100 * F.col("hits") / F.col("settled"), 4).alias("hit_rate"), "stake", "returned", F.round(profit, 4).alias("profit"), F.when(F.col("stake") > 0, F.round(100 * profit / F.col("stake"), 4)).alias("roi"))


def real_bet_profit(stake: Column, odds: Column, hit: Column) -> Column:
    """Profit of a bet that was settled as hit, missed, or neither (null)."""
    return F.when(hit, F.round(stake * (odds - 1), 2)).when(~hit, -stake).otherwise(0.0)


def earliest_qualified(tickets: DataFrame, quotes: DataFrame) -> DataFrame:
    """The first quote of each ticket's match and selection that is verified, of a fitting market and above 1.

    ``tickets``: ``ticket_id, match_id, selection``; ``quotes``: ``match_id,
    line, market_code, verified, odds, received``.
    """
    same = lambda c: F.trim(F.replace(F.col(c), F.lit(":"), F.lit("-")))
    good = quotes.where(F.col("verified") & (F.col("odds") > 1) & F.col("market_code").isin("7", "1100484")).select("match_id", same("line").alias("selection"), "odds", "received")
    wanted = tickets.select("ticket_id", "match_id", same("selection").alias("selection"))
    first = good.groupBy("match_id", "selection").agg(F.min(F.struct("received", "odds")).alias("b"))
    return wanted.join(first, ["match_id", "selection"]).select("ticket_id", F.col("b.received").alias("received"), F.col("b.odds").alias("odds"))
