"""Sessions of an event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessionize(events: DataFrame, keys: list[str], gap_seconds: int = 1800) -> DataFrame:
    """events (ts, id, keys) plus session_no: a new session begins where the time since the last event of the key is over the gap.

    Each day of a key is sorted by itself. What the days before it hold (their last event, how many sessions began) comes
    from a table of one row for each day, so one long log is many tasks.
    """
    e = events.withColumn("_day", F.to_date("ts"))
    w = Window.partitionBy(*keys, "_day").orderBy("ts", "id")
    over = lambda now, before: F.coalesce((now.cast("double") - before.cast("double") > gap_seconds).cast("int"), F.lit(0))
    inner = e.withColumn("_new", over(F.col("ts"), F.lag("ts").over(w)))
    inner = inner.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    days = inner.groupBy(*keys, "_day").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.sum("_new").alias("n"))
    d = Window.partitionBy(*keys).orderBy("_day")
    days = days.withColumn("cut", over(F.col("a"), F.lag("b").over(d)))
    days = days.withColumn("_before", F.sum(F.col("n") + F.col("cut")).over(d.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"d.{k}")) for k in (*keys, "_day")]
    j = inner.alias("e").join(days.select(*keys, "_day", "_before").alias("d"), same)
    return j.select("e.*", "d._before").withColumn("session_no", (F.col("_before") + F.col("_run")).cast("long")).drop("_day", "_new", "_run", "_before")


def tool_mix(events: DataFrame, keys: list[str], gap_seconds: int = 1800, min_calls: int = 5) -> DataFrame:
    """Calls of each tool in each session of at least min_calls calls, with the tool's share in percent."""
    s = sessionize(events, keys, gap_seconds).groupBy(*keys, "session_no", "tool").agg(F.count("*").alias("calls"))
    total = F.sum("calls").over(Window.partitionBy(*keys, "session_no"))
    return s.withColumn("session_calls", total).filter(F.col("session_calls") >= min_calls).withColumn("share", F.round(100.0 * F.col("calls") / F.col("session_calls"), 1))
