"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only.

Digests are computed once and written with their run number: a hash of the id deals
rows to runs of about ``RUN_ROWS`` rows, a power of ``FAN_IN`` of them, so that their
number grows with the table. Each run is first reduced to one entry per digest, with
the smallest id and a count. Then come the rounds of a binomial tree with ``FAN_IN``
children a node: in each, run r goes to run r / FAN_IN by an exchange, where a
window over rows sorted by (slice, run, digest, id) merges the up to FAN_IN runs that meet
and keeps the first entry of each digest, with the sum of their counts. log(runs) rounds
leave the winner of every digest. A slice is a part of the digest space, as many as
``spark.sql.shuffle.partitions`` says, so that no run, not even the last, is one task.
An entry is keyed by the SHA-256, a second 64-bit hash and the length of the normalised
text, so the smallest id kept at each level is one of verified equals.

On the way down winners meet first the entries of the first level (at most one a run
and digest) and then the rows, joined by digest and run: no task gets all
copies of one text, whatever share of the table they are.

Defined results: a null text counts as empty; a null id never wins against
another id and is kept only where all ids of its group are null; rows that share
id and text share their fate; extra columns pass through, those named like a
result column give way to it; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.llm.common import SPACE_CLASS, Scratch, set_columns

RUN_ROWS, FAN_IN = 16_384, 16
KEY = ["__sha", "__alt", "__len"]


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with KEY, the digest of the text with white space made one."""
    norm = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACE_CLASS, " ")
    keyed = docs.withColumn("__norm", norm).withColumn("__sha", F.unhex(F.sha2("__norm", 256)))
    return keyed.withColumn("__alt", F.xxhash64("__norm")).withColumn("__len", F.length("__norm")).drop("__norm")


def merged(entries: DataFrame, slices: int, fan_in: int) -> DataFrame:
    """One round: entries (KEY, __run, __min, __n) of fan_in neighbouring runs become one sorted run."""
    met = entries.withColumn("__run", F.floor(F.col("__run") / fan_in)).withColumn("__slice", F.pmod("__alt", F.lit(slices)))
    met = met.repartition("__slice", "__run")
    same = Window.partitionBy("__slice", "__run", *KEY).orderBy(F.col("__min").asc_nulls_last())
    every = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = met.withColumn("__nth", F.row_number().over(same)).withColumn("__n", F.sum("__n").over(every)).filter("__nth = 1")
    return first.select(*KEY, "__run", "__min", "__n")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, run_rows: int = RUN_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """All rows of ``docs`` with keep_id, group_size, kept, text_sha256 beside the id and the columns ``carry`` (all if None)."""
    spark = docs.sparkSession
    with Scratch(spark, "exact") as s:
        columns = [c for c in docs.columns if carry is None or c == id_col or c in carry]
        base = s.keep(digests(docs, id_col, text_col).select(*[F.col(f"`{c}`") for c in columns], *KEY), "digests")
        rows, runs, rounds = base.count(), 1, 0
        while runs * run_rows < rows:
            runs, rounds = runs * fan_in, rounds + 1
        base = base.withColumn("__run", F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(runs)))
        first = s.keep(base.groupBy(*KEY, "__run").agg(F.min(F.col(f"`{id_col}`")).alias("__min"), F.count(F.lit(1)).alias("__n")), "runs")
    level, slices = first, int(spark.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(rounds):
        level = merged(level, slices, fan_in)
    winners = level.select(*KEY, F.col("__min").alias("__keep"), F.col("__n").alias("__size"))
    found = base.join(first.select(*KEY, "__run").join(winners, KEY), [*KEY, "__run"])
    out = set_columns(
        found,
        {
            "keep_id": F.col("__keep"),
            "group_size": F.col("__size").cast("long"),
            "kept": F.col(f"`{id_col}`").eqNullSafe(F.col("__keep")),
            "text_sha256": F.lower(F.hex("__sha")),
        },
    )
    return out.drop(*KEY, "__run", "__keep", "__size")


#: The same in SQL.
ORACLE = """
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM n
"""
