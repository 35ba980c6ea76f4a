"""Index ledgers: whether to rebuild, what to replace, what to fill, what it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rebuild_reasons(meta: DataFrame, wanted: dict[str, object], counts: DataFrame, key: str = "world") -> DataFrame:
    """(key, reasons, rebuild) of index descriptions: fields that differ from those wanted, null included, and the count.

    A described count that isn't there is not compared; an empty index counts unless it says 0.
    """
    both = meta.join(counts.select(key, "n"), key, "left")
    n = F.coalesce("n", F.lit(0))
    differs = [F.when(~F.col(c).eqNullSafe(F.lit(v)), F.lit(c)) for c, v in wanted.items()]
    empty = F.when((n == 0) & ~F.col("doc_count").eqNullSafe(F.lit(0)), F.lit("empty"))
    count = F.when(F.col("doc_count").isNotNull() & (n != F.col("doc_count")), F.lit("doc_count"))
    reasons = F.array_compact(F.array(*differs, empty, count))
    return both.select(key, reasons.alias("reasons"), (F.size(reasons) > 0).alias("rebuild"))


def count_check(stamps: DataFrame, nodes: DataFrame, edges: DataFrame, era: int, key: str = "world") -> DataFrame:
    """(key, reason) of graphs: no_stamp, era_mismatch, count_mismatch or null."""
    n = nodes.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    e = edges.groupBy(key).agg(F.count(F.lit(1)).alias("e"))
    both = stamps.join(n, key, "left").join(e, key, "left")
    same = (F.coalesce("n", F.lit(0)) == F.col("node_count")) & (F.coalesce("e", F.lit(0)) == F.col("edge_count"))
    reason = F.when(F.col("node_count").isNull() | F.col("edge_count").isNull(), "no_stamp").when(~F.col("era").eqNullSafe(F.lit(era)), "era_mismatch").when(~same, "count_mismatch")
    return both.select(key, reason.alias("reason"))


def replaced(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``new`` in place of all rows of ``old`` with the same keys; other rows stay."""
    gone = new.select(*keys).distinct()
    return old.join(gone, list(keys), "left_anti").unionByName(new)


def upserted(rows: DataFrame, order: list[str], *keys: str) -> DataFrame:
    """The last row of each key; ties go by all columns."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in [*order, *[c for c in rows.columns if c not in order]]])
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def vector_key(text, provider: str, model: str, dim: int, algorithm: str):
    """Content address of a text's vector."""
    return F.sha1(F.concat(F.lit(f"{provider}|{model}|{dim}|{algorithm}|"), text))


def vector_fill(chunks: DataFrame, cache: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Chunks (chunk_id, key) with the cached vector of their key, or status missing; and the distinct keys to embed."""
    good = cache.filter((F.size("vector") == dim) & F.exists("vector", lambda x: x != 0)).groupBy("key").agg(F.min("vector").alias("vector"))
    filled = chunks.join(good, "key", "left").withColumn("status", F.when(F.col("vector").isNull(), "missing").otherwise("cached"))
    return filled, filled.filter("status = 'missing'").select("key").distinct()


def identity_state(meta: DataFrame, wanted: dict[str, object], key: str = "world") -> DataFrame:
    """(key, state): vectors are used only if every part of their identity is the one wanted, else the search goes on by words."""
    same = F.lit(True)
    for c, v in wanted.items():
        same = same & F.col(c).eqNullSafe(F.lit(v))
    return meta.select(key, F.when(same, "vectors").otherwise("words").alias("state"))


def disk_needs(sources: DataFrame, manifest: DataFrame, coefficients: DataFrame, free: DataFrame) -> DataFrame:
    """Per world: bytes in all, changed since the manifest, needed (family coefficients, rounded up) and status.

    sources (world, family, path, bytes), manifest (path, bytes), coefficients (family, peak), free (world, free).
    Short if less is free than needed, tight below one and a half times, unknown without either.
    """
    old = manifest.select("path", F.col("bytes").alias("was"))
    s = sources.join(old, "path", "left").withColumn("changed", ~F.col("bytes").eqNullSafe(F.col("was")))
    per = s.groupBy("world", "family").agg(F.sum("bytes").alias("bytes"), F.sum(F.when(F.col("changed"), F.col("bytes")).otherwise(0)).alias("changed"))
    need = per.join(coefficients, "family", "left").withColumn("need", F.ceil(F.col("changed") * F.col("peak")))
    known = F.count("need") == F.count(F.lit(1))
    w = need.groupBy("world").agg(F.sum("bytes").alias("bytes"), F.sum("changed").alias("changed"), F.when(known, F.sum("need")).alias("need"))
    status = F.when(F.col("need").isNull() | F.col("free").isNull(), "unknown").when(F.col("free") < F.col("need"), "short").when(2 * F.col("free") < 3 * F.col("need"), "tight").otherwise("ok")
    return w.join(free, "world", "left").select("world", "bytes", "changed", "need", status.alias("status"))


def quality_runs(runs: DataFrame, first: str, last: str) -> DataFrame:
    """Sums by (condition, rounds) of runs that lie wholly within a period; runs without one don't count."""
    inside = runs.filter((F.col("executed_from") >= F.lit(first).cast("timestamp")) & (F.col("executed_to") <= F.lit(last).cast("timestamp")))
    return inside.groupBy("condition", "rounds").agg(F.count(F.lit(1)).alias("runs"), F.sum("asked").alias("asked"), F.sum("right").alias("right"), F.round(F.sum("cost"), 2).alias("cost"))


def with_feedback(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """Messages with the last feedback of each, if any: (message_id, at, verdict)."""
    last = feedback.groupBy("message_id").agg(F.max_by("verdict", F.struct("at", "verdict")).alias("verdict"), F.count(F.lit(1)).alias("given"))
    return messages.join(last, "message_id", "left").withColumn("given", F.coalesce("given", F.lit(0)))
