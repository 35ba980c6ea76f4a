"""Incremental maintenance: differences, signatures, publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.session import file_system, put_new, remove


def diff(old: DataFrame, new: DataFrame, key: str, *by: str) -> DataFrame:
    """added, removed or changed rows between two manifests."""
    o, n = old.select(key, F.struct(*by).alias("o")), new.select(key, F.struct(*by).alias("n"))
    both = o.join(n, key, "full")
    state = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    return both.select(key, state.alias("state")).filter("state IS NOT NULL")


def signature(df: DataFrame, group: list[str], key: str, *by: str) -> DataFrame:
    """One hash per group over its rows in key order; rows are hashed first, so little moves."""
    row = F.sha2(F.concat_ws("|", key, *by), 256)
    g = df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), row.alias("h")))).alias("a"))
    return g.select(*group, F.sha2(F.array_join(F.col("a.h"), ""), 256).alias("signature"))


def publish(df: DataFrame, root: str, name: str, generation: str) -> str:
    """Write a new generation, then a pointer to it; readers see the old or the new one.

    A pointer is a small file with the next number, made only if no other has it, so that two publishers never share
    one; a write that fails leaves the old generation in force.
    """
    spark, path = df.sparkSession, f"{root}/{name}-g{generation}"
    df.write.parquet(path)
    number = max([0, *(n for n, _ in pointers(spark, root, name))])
    while not put_new(spark, f"{root}/{name}-pointers/{number + 1:012d}", path):
        number += 1
    return path


def pointers(spark: SparkSession, root: str, name: str) -> list[tuple[int, str]]:
    """(number, path) of all generations that have a pointer, in order."""
    p, fs = file_system(spark, f"{root}/{name}-pointers")
    if not fs.exists(p) or not fs.listStatus(p):
        return []
    rows = spark.read.text(p.toString()).select(F.regexp_extract(F.input_file_name(), r"(\d+)$", 1).cast("long").alias("n"), "value")
    return sorted((r.n, r.value) for r in rows.collect())


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The published generation."""
    return spark.read.parquet(pointers(spark, root, name)[-1][1])


def sweep(spark: SparkSession, root: str, name: str, keep: int = 2) -> int:
    """Delete all but the last ``keep`` generations, the pointers first; how many went."""
    old = pointers(spark, root, name)[:-keep]
    for n, path in old:
        remove(spark, f"{root}/{name}-pointers/{n:012d}")
        remove(spark, path)
    return len(old)


def missing(left: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Rows still to do."""
    return left.join(have.select(key), key, "left_anti")
