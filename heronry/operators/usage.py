"""Turns, retention, latency and audit analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def turns(conversations: DataFrame) -> DataFrame:
    """User messages numbered by order, each with its first reply, if any."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    m = conversations.withColumn("turn_no", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    m = m.filter("turn_no > 0")
    asked = F.max(F.when(F.col("role") == "user", F.col("turn")))
    reply = F.min(F.when(F.col("role") == "assistant", F.col("turn")))
    return m.groupBy("conv_id", "turn_no").agg(asked.alias("asked"), reply.alias("reply"))


def retention(events: DataFrame) -> DataFrame:
    """Users of each Monday week and those who come again in the next one."""
    w = events.select("user_id", F.date_trunc("week", "ts").cast("date").alias("wk")).distinct()
    again = w.select("user_id", F.date_sub("wk", 7).alias("wk"), F.lit(1).alias("again"))
    return w.join(again, ["user_id", "wk"], "left").groupBy("wk").agg(F.count(F.lit(1)).alias("active"), F.count("again").alias("revisited"))


def heatmap(events: DataFrame) -> DataFrame:
    """Events by weekday (0 is Sunday) and hour."""
    return events.groupBy((F.dayofweek("ts") - 1).alias("dow"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def _hashes(body):
    """What an entry notes: the hash of its predecessor's content, and of that with its own."""
    prev = F.coalesce(F.lag(F.sha2(body, 256)).over(Window.partitionBy("user_id").orderBy("event_id")), F.lit(""))
    return prev, F.sha2(F.concat(prev, body), 256)


def chain(events: DataFrame) -> DataFrame:
    """Entries with the hash of their predecessor's content and their own."""
    body = F.concat_ws("|", "event_id", "user_id", "event_type")
    prev, own = _hashes(body)
    return events.select("user_id", "event_id", prev.alias("prev_hash"), own.alias("entry_hash"))


def verify_chain(entries: DataFrame) -> DataFrame:
    """First entry of each chain (user_id, event_id, event_type, prev_hash, entry_hash) whose hashes aren't those of the rows."""
    prev, own = _hashes(F.concat_ws("|", "event_id", "user_id", "event_type"))
    bad = entries.withColumn("__prev", prev).withColumn("__own", own)
    bad = bad.withColumn("ok", F.col("prev_hash").eqNullSafe(F.col("__prev")) & F.col("entry_hash").eqNullSafe(F.col("__own")))
    return bad.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(~F.col("ok"), F.col("event_id"))).alias("broken_at"))
