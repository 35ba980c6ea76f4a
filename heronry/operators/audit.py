"""Call logs, ledgers and reports made of log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_calls(log: DataFrame, turn_filter) -> tuple[DataFrame, DataFrame]:
    """Merge call logs (call, proc, seq, ts) of several processes.

    Rows of other turns are dropped; of rows with equal ``call`` the first by
    (ts, proc, seq) stays. Also gives, per process, what was kept and dropped and
    how many sequence numbers are missing. A null ``call`` is a broken line.
    """
    mine = log.withColumn("mine", F.coalesce(turn_filter, F.lit(False))).withColumn("ok", F.col("call").isNotNull())
    order = F.struct("ts", "proc", "seq")
    kept = mine.filter("mine AND ok").groupBy("call").agg(F.min(order).alias("first")).select("call", "first.*")
    seen = mine.groupBy("proc").agg(
        F.count_if(~F.col("mine")).alias("other_turn"),
        F.count_if(F.col("mine") & ~F.col("ok")).alias("broken"),
        F.count_if(F.col("mine") & F.col("ok")).alias("rows"),
        (F.max("seq") - F.count_distinct("seq")).alias("gaps"),
    )
    per = kept.groupBy("proc").agg(F.count(F.lit(1)).alias("kept"))
    summary = seen.join(per, "proc", "left").select("proc", F.coalesce("kept", F.lit(0)).alias("kept"), "other_turn", "broken", (F.col("rows") - F.coalesce("kept", F.lit(0))).alias("duplicates"), "gaps")
    return kept, summary


def tool_totals(calls: DataFrame, roles: list[str]) -> DataFrame:
    """Calls, hits, time, errors and truncated calls by (tool, role); unknown roles are undetermined."""
    role = F.when(F.col("role").isin(*roles), F.col("role")).otherwise("undetermined")
    return calls.groupBy("tool", role.alias("role")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("found").alias("found"), F.round(F.sum("ms"), 3).alias("ms"),
        F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "truncated").alias("truncated"),
    )


def found_docs(calls: DataFrame) -> DataFrame:
    """Hits, distinct lines and queries of each document, and its first sequence number."""
    return calls.groupBy("doc").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("line").alias("lines"), F.count_distinct("query").alias("queries"), F.min("seq").alias("first_seq"))


def visible(conversations: DataFrame, shares: DataFrame, user: int) -> DataFrame:
    """A user's own rows and those shared with them that aren't expired; own ones win."""
    own = conversations.filter(F.col("owner") == user).withColumn("origin", F.lit("own"))
    mine = shares.filter((F.col("receiver") == user) & ~F.col("expired")).select("conv_id").distinct()
    got = conversations.filter(~F.col("owner").eqNullSafe(F.lit(user))).join(mine, "conv_id", "left_semi").withColumn("origin", F.lit("received"))
    return own.unionByName(got)


def replace_failures(old: DataFrame, failing: DataFrame) -> DataFrame:
    """Full replace of (doc_id, reason, tries): rows that no longer fail go, others count one more try."""
    o = old.select("doc_id", F.col("tries").alias("before"))
    return failing.join(o, "doc_id", "left").select("doc_id", "reason", (F.coalesce("before", F.lit(0)) + 1).alias("tries"))


def apply_delta(ledger: DataFrame, delta: DataFrame) -> DataFrame:
    """Ledger (key, generation, value) after a delta (key, expected, value; null value removes).

    A row changes only where its generation is the expected one (0: absent); status tells.
    """
    d = delta.select("key", "expected", F.col("value").alias("new"))
    both = ledger.join(d, "key", "full")
    hit = F.col("expected").isNotNull()
    same = hit & (F.coalesce("generation", F.lit(0)) == F.col("expected"))
    status = F.when(~hit, "kept").when(~same, "conflict").when(F.col("new").isNull(), "removed").otherwise("applied")
    out = both.withColumn("status", status)
    return out.select(
        "key", "status",
        F.when(F.col("status") == "applied", F.coalesce("generation", F.lit(0)) + 1).when(F.col("status") != "removed", F.col("generation")).alias("generation"),
        F.when(F.col("status") == "applied", F.col("new")).when(F.col("status") != "removed", F.col("value")).alias("value"),
    )


def log_fields(lines: DataFrame) -> DataFrame:
    """(stage, ms, error) of lines such as ``[stage] doc=1 ms=2.5`` or ``[stage] error: text``; others are dropped."""
    part = lambda p: F.regexp_extract("line", p, 1)
    rows = lines.select(part(r"\[(\w+)\]").alias("stage"), F.nullif(part(r"ms=([0-9.]+)"), F.lit("")).cast("double").alias("ms"), F.nullif(F.regexp_replace(part(r"error: (.*)$"), r"[0-9]+", "#"), F.lit("")).alias("error"))
    return rows.filter("stage <> ''")


def gaps(events: DataFrame, group: str, order: str) -> DataFrame:
    """Microseconds since the row before it, by group."""
    us = F.unix_micros(F.col(order).cast("timestamp"))
    return events.withColumn("gap_us", us - F.lag(us).over(Window.partitionBy(group).orderBy(order, "event_id")))


def preserved(original: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """How many distinct words of an original text its derived text still has."""
    words = lambda d: d.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9]+)"), 1))).alias("word")).distinct()
    o = words(original)
    kept = o.join(words(derived), [key, "word"], "left_semi").withColumn("there", F.lit(1))
    both = o.withColumn("there", F.lit(0)).unionByName(kept)
    return both.groupBy(key).agg(F.count_if(F.col("there") == 0).alias("words"), F.count_if(F.col("there") == 1).alias("kept"))
