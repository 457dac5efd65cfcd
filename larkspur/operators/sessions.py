"""Sessions, paths and funnels over event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions.checkpoints import cut


def sessionize(events: DataFrame, user: str, ts: str, gap_seconds: int = 1800, tie: str | None = None, slice_seconds: int | None = None) -> DataFrame:
    """events with session_no (from 1) and session_id: a gap of more than gap_seconds begins a session.

    slice_seconds cuts each user's time into slices, so that a user of very many events is spread over tasks:
    what is before a slice, its last event and its sessions, comes from running windows over slices.
    """
    if slice_seconds:
        return _sessionize_sliced(events, user, ts, gap_seconds, tie, slice_seconds)
    order = W.partitionBy(user).orderBy(ts, *([tie] if tie else []))
    before = F.lag(ts).over(order)
    new = before.isNull() | (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(before.cast("timestamp")) > gap_seconds * 1_000_000)
    numbered = events.withColumn("_new", new.cast("long")).withColumn("session_no", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.drop("_new").withColumn("session_id", F.concat_ws("-", F.col(user).cast("string"), F.col("session_no").cast("string")))


def _sessionize_sliced(events: DataFrame, user: str, ts: str, gap_seconds: int, tie: str | None, slice_seconds: int) -> DataFrame:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    part = [user, "_slice"]
    sliced = events.withColumn("_slice", F.floor(micros(F.col(ts)) / (slice_seconds * 1_000_000)))
    along = W.partitionBy(user).orderBy("_slice")
    ends = sliced.groupBy(*part).agg(F.max(ts).alias("_last")).select(*part, F.lag("_last").over(along).alias("_ahead"))
    order = W.partitionBy(*part).orderBy(ts, *([tie] if tie else []))
    before = F.coalesce(F.lag(ts).over(order), F.col("_ahead"))
    new = before.isNull() | (micros(F.col(ts)) - micros(before) > gap_seconds * 1_000_000)
    marked = cut(sliced.join(ends, part).withColumn("_new", new.cast("long")).withColumn("_no", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))))
    sums = marked.groupBy(*part).agg(F.sum("_new").alias("_sum"))
    sums = sums.select(*part, F.coalesce(F.sum("_sum").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = marked.join(sums, part).withColumn("session_no", F.col("_no") + F.col("_before"))
    return out.select(*events.columns, "session_no", F.concat_ws("-", F.col(user).cast("string"), F.col("session_no").cast("string")).alias("session_id"))


def paths(sessions: DataFrame, session: str, ts: str, step: str, tie: str, sep: str = ">") -> DataFrame:
    """One row for each session: its steps in order, runs of the same step collapsed to one."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct(ts, tie, step))), lambda x: x[step])
    collapsed = F.filter(F.col("_s"), lambda x, i: (i == 0) | (x != F.get(F.col("_s"), i - 1)))
    return sessions.groupBy(session).agg(steps.alias("_s")).select(session, F.concat_ws(sep, collapsed).alias("path"), F.size("_s").cast("long").alias("n_steps"))


def transitions(sessions: DataFrame, session: str, ts: str, step: str, tie: str) -> DataFrame:
    """(from_step, to_step, n): how often one step follows another in a session."""
    order = W.partitionBy(session).orderBy(ts, tie)
    pairs = sessions.select(F.col(step).alias("from_step"), F.lead(step).over(order).alias("to_step"))
    return pairs.where("to_step IS NOT NULL").groupBy("from_step", "to_step").agg(F.count("*").alias("n"))


def funnel(sessions: DataFrame, session: str, stages: dict[str, Column]) -> DataFrame:
    """One row: sessions, those that reach each stage (and all before it), and the share of the one before."""
    reached = sessions.groupBy(session).agg(*(F.bool_or(c).alias(n) for n, c in stages.items()))
    counts, so_far = [F.count("*").alias("sessions")], F.lit(True)
    for name in stages:
        so_far = so_far & F.col(name)
        counts.append(F.count_if(so_far).alias(f"n_{name}"))
    out = reached.agg(*counts)
    before = "sessions"
    for name in stages:
        out = out.withColumn(f"rate_{name}", F.round(F.try_divide(F.col(f"n_{name}").cast("double"), F.col(before)), 6))
        before = f"n_{name}"
    return out
