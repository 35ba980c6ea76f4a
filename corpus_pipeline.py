"""A corpus pipeline of five stages; each takes and returns whole documents.

A row is known by its doc_id and its text together, so ids may be null or repeat.
Defined results: a document with a null text, or without letters, is rejected by
the language stage (all pass if no language could be learned); of texts equal but for white space
the row with the smallest doc_id stays, a null one last, and of several such rows one;
of a group of near duplicates the row with the smallest doc_id; a document without words has
no share in the mix and goes there. Extra columns pass through, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.llm import op2_language, op3_bpe, op6_exact_dedup, op8_near_dedup, op10_mix
from heronry.llm.common import filter_texts, materialise, new_folder, table, temporary, without

ROW = "__row"


def _with_row(docs: DataFrame) -> DataFrame:
    """``docs`` with what tells rows apart, ordered by doc_id, null last."""
    return docs.withColumn(ROW, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.length("text").alias("length")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the language models reject; fitted on labelled ones."""
    models = op2_language.fit(docs.filter(~op2_language.held_out("doc_id", 4, 2)))
    if not models.langs:
        return docs
    shared = spark.sparkContext.broadcast(models)
    return filter_texts(docs, lambda texts: [accepted for *_, accepted in shared.value.predict(texts)])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first of equal texts, one row of each."""
    kept = op6_exact_dedup.exact_dedup(docs.select(F.col("doc_id").alias("__id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col("text").alias("__text")), "__id", "__text", carry=["__doc"]).filter("kept")
    twice = materialise(kept.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("text_sha256"), "exact-twice")
    if twice.limit(1).count():  # rows that share id and text
        kept = kept.join(twice, "text_sha256", "left_anti").unionByName(kept.join(twice, "text_sha256", "left_semi").dropDuplicates(["text_sha256"]))
    return kept.select("__doc.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate component."""
    rows = _with_row(docs)
    others = op8_near_dedup.near_dedup(rows, ROW).filter("NOT kept").select(ROW)
    return without(rows, ROW, materialise(others, "near-others")).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, rounded (half up); 0 to 2 times."""
    rows = _with_row(docs)
    per = op10_mix.mix(rows, ROW).groupBy(ROW).agg(F.sum("taken").alias("__t"), F.sum("size").alias("__n"))
    times = per.filter("__n > 0").select(F.col(ROW).alias("__of"), F.floor(F.col("__t") / F.col("__n") + 0.5).cast("int").alias("__times")).filter("__times > 0")
    joined = rows.join(times, F.col(ROW) == F.col("__of"))  # equal structs have equal nulls
    return joined.withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    e = op3_bpe.bpe_encode(docs.select(F.struct("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).alias("key"), "text"), id_col="key")
    return e.select("key.doc_id", "key.source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("key.sha")).alias("round_trip"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mixed), ("encode", encode)]
#: Language models and BPE can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again, what a stage needed for itself goes."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        to = new_folder(spark, f"stage-{name}")
        with temporary(spark, name):
            docs = materialise(stage(spark, docs, sf_dir), name, to)
    return STAGES[-1][1](spark, docs, sf_dir)
