"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from heronry.session import Scratch, materialise, new_folder, shared_dir, table, temporary  # noqa: F401

#: Texts handled together inside one Arrow batch, in characters and rows; bounds memory.
SLICE_CHARS, SLICE_ROWS = 400_000, 512


def sliced(batch: pa.RecordBatch, at: int = 0, text_at: int = 1, chars: int = SLICE_CHARS):
    """Yield (ids, texts) of a batch in slices of about ``chars``, whole texts only; null is empty."""
    for first in range(0, batch.num_rows, SLICE_ROWS):
        part = batch.slice(first, SLICE_ROWS)
        texts = ["" if t is None else t for t in part.column(text_at).to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= chars or i == len(texts) - 1:
                yield part.column(at).slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0


#: Rows and bytes that Spark hands to Python at once, where the session has Spark's own values.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("268435456", "8388608")}


def small_batches(spark) -> None:
    """Texts are long: hold few of them in Arrow at once. Settings that the user made stay."""
    for key, (given, ours) in BATCHES.items():
        if spark.conf.get(key, given) in (given, "256MB", "256m"):
            spark.conf.set(key, ours)


def map_texts(docs: DataFrame, work, schema: T.StructType, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Run ``work(ids, texts) -> dict of columns`` over slices of Arrow batches.

    Nulls in the text become empty strings; only the two columns are read.
    """
    arrow = to_arrow_schema(schema)
    names = schema.names

    def run(batches):
        for b in batches:
            for ids, texts in sliced(b):
                got = work(ids, texts)
                cols = [got[n] if isinstance(got[n], pa.Array) else pa.array(got[n], arrow.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)

    small_batches(docs.sparkSession)
    two = docs.select(F.col(id_col).alias("__i"), F.col(text_col).cast("string").alias("__t"))
    return two.mapInArrow(run, schema)


def filter_texts(docs: DataFrame, keep, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` for which ``keep(texts)`` is true, with all their columns."""
    at = docs.columns.index(text_col)
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            mask = [m for _, texts in sliced(b, at, at) for m in keep(texts)]
            yield b.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


#: Bits of a sieve: at most this / 64 rows are sent to all executors.
SIEVE_BITS = 1 << 24


def _may_be(df: DataFrame, key, wanted: DataFrame, wanted_key) -> DataFrame:
    """``df`` with a column __may: whether a bit for the hash of the key is set by some wanted row."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE_BITS))
    bits = wanted.select(place(wanted_key).alias("__h")).groupBy(F.shiftright("__h", 6).alias("__word")).agg(F.expr("bit_or(shiftleft(1L, int(__h & 63)))").alias("__bits"))
    at = df.withColumn("__h", place(key)).join(F.broadcast(bits), F.shiftright("__h", 6) == F.col("__word"), "left")
    may = F.coalesce(F.getbit("__bits", F.expr("int(__h & 63)")) == 1, F.lit(False))
    return at.withColumn("__may", may).drop("__h", "__word", "__bits")


def sieve(df: DataFrame, key, wanted: DataFrame, wanted_key) -> DataFrame:
    """Rows of ``df`` that may be among ``wanted`` by a bit for the hash of a column; spares a join most of the others.

    Every wanted row passes; the bits have a fixed size, so with more wanted rows than bits all pass.
    """
    return _may_be(df, key, wanted, wanted_key).filter("__may").drop("__may")


def without(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` isn't in ``gone``; most rows are passed on by the sieve and not exchanged."""
    at = _may_be(df, key, gone, key)
    rest = at.filter("__may").join(gone.select(F.col(key).alias("__gone")), F.col(key).eqNullSafe(F.col("__gone")), "left_anti")
    return at.filter("NOT __may").unionByName(rest).drop("__may")


def id_field(docs: DataFrame, id_col: str = "doc_id") -> T.StructField:
    """The id's field, as the result carries it."""
    return T.StructField(id_col, docs.schema[id_col].dataType, True)


def set_columns(df: DataFrame, cols: dict) -> DataFrame:
    """Add result columns; a column of the input with the same name gives way."""
    lower = {k.lower() for k in cols}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lower], *[e.alias(k) for k, e in cols.items()])


def byte_table(chars: bytes) -> np.ndarray:
    """Boolean table over byte values."""
    t = np.zeros(256, dtype=bool)
    t[np.frombuffer(chars, dtype=np.uint8)] = True
    return t


#: White space of the contracts, \x20 and \x09 to \x0D.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
#: The same as a regular expression of Java and RE2.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
