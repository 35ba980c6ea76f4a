"""Vector search and fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.scalars import dot, unit


def knn(vectors: DataFrame, query: list[float], k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Exact top k by cosine; filters on ``vectors`` apply before the cut."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, F.round(dot(unit(F.col(column)), unit(q)), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def rrf(hits: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = 10, c: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of (key, score) by engine, after keeping each key's best hit."""
    ranked = []
    for name, h in hits.items():
        h = h.groupBy("key").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.orderBy(F.desc("score"), "key"))
        ranked.append(h.select("key", F.lit(name).alias("engine"), ((weights or {}).get(name, 1.0) / (c + rank)).alias("part")))
    every = reduce(DataFrame.unionByName, ranked)
    out = every.groupBy("key").agg(F.round(F.sum("part"), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("engine")), ",").alias("engines"))
    return out.orderBy(F.desc("score"), "key").limit(k)


#: Engines in the order in which their snippets are taken, the worth of a graph hit by its judgement, paths shown.
ENGINES, JUDGED, PATHS = ("keyword", "vector", "graph"), {"sure": 1.0, "review": 0.6, "presumed": 0.3}, 5


def fused(hits: DataFrame, weights: dict[str, float] | None = None, k: int = 10, c: int = 60) -> DataFrame:
    """(key, score, sources, snippet, line, judgement, paths, omitted): top k of hits (engine, key, place, snippet, line, judgement, path), lists that their engines have cut.

    Hits of one engine and key are one, at their best place and best judgement, with their paths; places are then ranks from 1. A
    rank gives weight / (c + rank), for graph hits times what their judgement is worth. The snippet, with its line, is
    the first engine's that has one; sources are engine:rank.
    """
    of = lambda column, values: F.element_at(F.create_map(*[F.lit(x) for kv in values for x in kv]), column)
    place = of(F.col("engine"), [(e, n) for n, e in enumerate(ENGINES)])
    worse = F.try_element_at(F.create_map(*[F.lit(x) for n, j in enumerate(JUDGED) for x in (j, n)]), F.coalesce("judgement", F.lit("")))
    one = hits.groupBy("engine", "key").agg(
        F.min("place").alias("place"), F.min(F.struct("place", "snippet", "line")).alias("s"), F.min(F.when(worse.isNotNull(), F.struct(worse.alias("w"), "judgement"))).alias("j"),
        F.array_sort(F.collect_set(F.when(F.col("engine") == "graph", F.col("path")))).alias("all_paths"),
    )
    rank = F.row_number().over(Window.partitionBy("engine").orderBy("place", "key"))
    worth = F.when(F.col("engine") == "graph", F.coalesce(of(F.col("j.judgement"), JUDGED.items()), F.lit(1.0))).otherwise(1.0)
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in (weights or {"": 1.0}).items() for x in kv]), F.col("engine")), F.lit(1.0))
    ranked = one.withColumn("rank", rank).withColumn("part", weight * worth / (c + F.col("rank"))).withColumn("order", place)
    shown = F.min(F.when(F.coalesce("s.snippet", F.lit("")) != "", F.struct("order", "s.snippet", "s.line")))
    got = ranked.groupBy("key").agg(
        F.round(F.sum("part"), 6).alias("score"), F.array_sort(F.collect_list(F.struct("order", "engine", "rank"))).alias("o"), shown.alias("s"),
        F.max(F.when(F.col("engine") == "graph", F.col("j.judgement"))).alias("judgement"), F.flatten(F.collect_list("all_paths")).alias("p"),
    )
    sources = F.array_join(F.transform("o", lambda x: F.concat_ws(":", x["engine"], x["rank"].cast("string"))), ",")
    out = got.select("key", "score", sources.alias("sources"), "s.snippet", "s.line", "judgement", F.slice("p", 1, PATHS).alias("paths"), F.greatest(F.size("p") - PATHS, F.lit(0)).alias("omitted"))
    return out.orderBy(F.desc("score"), "key").limit(k)


def merged_hits(hits: DataFrame, most: int) -> DataFrame:
    """(key, paths, judgement) of hits (key, path, judgement): the first ``most`` distinct paths and the best judgement; rows are cut before they are gathered."""
    each = hits.groupBy("key", "path").agg(F.min("judgement").alias("judgement"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("path"))
    paths = each.withColumn("nth", nth).filter(F.col("nth") <= most).groupBy("key").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return paths.join(hits.groupBy("key").agg(F.min("judgement").alias("judgement")), "key")
