"""Resampling documents by importance, towards the distribution of a target corpus.

Features of a text are its words and, up to ``longest``, runs of consecutive words; a
feature's bucket is the CRC-32 of its UTF-8 bytes modulo ``buckets``. Each task gives
its batches to a DuckDB of its own, which unnests the words, makes the runs by a window over
their places and counts buckets with zlib's CRC as a registered function, called once for
each distinct feature. A task's counts, one row a bucket at most, go to Parquet, and Spark adds
them up for the documents and for the target. A second pass over the texts, in DuckDB again, adds
the gains of a document's features and draws its Gumbel noise.

What tasks share is one list of ``buckets`` gains. Scores are whole numbers between about
-200,000 and 200,000 whatever the input, so documents are ranked by a histogram of scores, with windows
over those that share one score; no window holds all documents.

A null text has no features: weight 0 and never drawn; nor does an empty one; a null doc_id
draws the noise of an empty id and goes last among ties; repeated rows have equal scores and take one rank each; an
empty target leaves gains that only depend on the documents; extra columns aren't read; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronry.llm.common import Scratch, id_field, sliced, small_batches
from heronry.llm.duck import CHARS, connect, words_sql

#: Fixed value: words of the contract.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, LONGEST, SEED, PERCENT, LEAST_WORDS = 10_000, 1, 2024, 10, 20
#: Scores of one block of the histogram.
BLOCK = 256


def features_sql(longest: int) -> str:
    """Common tables up to ``features`` (row, feature) of a table ``texts`` (row, text)."""
    runs = ["SELECT row, word AS feature FROM words"]
    for n in range(2, longest + 1):
        run = f"PARTITION BY row ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING"
        runs.append(f"SELECT row, feature FROM (SELECT row, string_agg(word, ' ') OVER ({run}) AS feature, count(*) OVER ({run}) AS n FROM words) WHERE n = {n}")
    return f"words AS ({words_sql(WORD, 'texts')}), features AS ({' UNION ALL '.join(runs)})"


def counts_sql(buckets: int, longest: int) -> str:
    """Occurrences by bucket."""
    return f"""WITH {features_sql(longest)}, each AS (SELECT feature, count(*) AS n FROM features GROUP BY feature)
SELECT crc32(feature) % {buckets} AS bucket, sum(n)::BIGINT AS n FROM each GROUP BY bucket"""


def weights_sql(buckets: int, longest: int) -> str:
    """By row: words, features, and the sum of their gains."""
    return f"""WITH {features_sql(longest)}, each AS MATERIALIZED (SELECT row, feature, count(*) AS n FROM features GROUP BY ALL),
hashed AS (SELECT feature, gain FROM (SELECT feature, crc32(feature) % {buckets} AS bucket FROM (SELECT DISTINCT feature FROM each)) JOIN gains USING (bucket)),
lengths AS (SELECT row, count(*) AS n_words FROM words GROUP BY row)
SELECT row, any_value(n_words) AS n_words, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM each JOIN hashed USING (feature) JOIN lengths USING (row) GROUP BY row"""


#: Noise of a row from its key, in doubles.
NOISE = "SELECT floor(-1000 * ln(-ln((('0x' || sha256(key)[1:8])::BIGINT + 0.5) / 4294967296)))::BIGINT AS noise FROM keys ORDER BY row"


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, text_col: str = "text") -> DataFrame:
    """(bucket, n): one row a task and bucket at most."""
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("n", T.LongType())])
    sql = counts_sql(buckets, longest)

    def run(batches):
        con, total = connect(), np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for _, texts in sliced(b, 0, 0, CHARS):
                con.register("texts", pa.table({"row": range(len(texts)), "text": texts}))
                got = con.execute(sql).to_arrow_table()
                total[got["bucket"].to_numpy()] += got["n"].to_numpy()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=schema.names)

    small_batches(docs.sparkSession)
    return docs.select(F.col(text_col).cast("string").alias("__t")).mapInArrow(run, schema)


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """Gain of each bucket, in thousandths of a nat, rounded down."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    return [math.floor(1000 * math.log((int(y) + 1) * (s + n) / ((int(x) + 1) * (t + n)))) for x, y in zip(source, target)]


def scored(docs: DataFrame, gain: list[int], longest: int = LONGEST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_features, weight, score."""
    schema = T.StructType([id_field(docs, id_col), *[T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight", "score")]])
    sql, shared = weights_sql(len(gain), longest), docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        con, each = connect(), shared.value
        con.register("gains", pa.table({"bucket": range(len(each)), "gain": pa.array(each, pa.int64())}))
        for b in batches:
            for ids, texts in sliced(b, 0, 1, CHARS):
                con.register("texts", pa.table({"row": range(len(texts)), "text": texts}))
                got, found = con.execute(sql).to_arrow_table(), np.zeros((3, len(texts)), dtype=np.int64)
                found[:, got["row"].to_numpy()] = [got[c].to_numpy() for c in ("n_words", "n_features", "total")]
                keys = [f"{seed}:{'' if i is None else i}" for i in ids.to_pylist()]
                con.register("keys", pa.table({"row": range(len(keys)), "key": keys}))
                noise = con.execute(NOISE).to_arrow_table()["noise"].to_numpy()
                weight = np.floor_divide(found[2], np.maximum(found[1], 1))
                columns = [found[0], found[1], weight, weight + noise]
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int64()) for c in columns]], names=schema.names)

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("__t")).mapInArrow(run, schema)


def ranked(rows: DataFrame, drawn: int, id_col: str) -> DataFrame:
    """The ``drawn`` rows with the highest scores, ranked, of those with ``eligible``; a null rank for all others."""
    counts = rows.filter("eligible").groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.floor(F.col("score") / BLOCK))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n")).select("block", before(Window.orderBy(F.desc("block"))).alias("above_block"))
    inside = counts.select("score", "block", before(Window.partitionBy("block").orderBy(F.desc("score"))).alias("inside"))
    above = inside.join(blocks, "block").select("score", (F.col("above_block") + F.col("inside")).alias("above")).filter(F.col("above") < drawn)
    at = rows.join(F.broadcast(above), "score", "left")  # scores have a fixed range
    may = F.col("eligible") & F.col("above").isNotNull()
    rank = F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy(F.col(id_col).asc_nulls_last()))
    some = at.filter(may).withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    return some.unionByName(at.filter(~may).withColumn("rank", F.lit(None).cast("long"))).drop("above")


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_features, weight, score, and the rank of those that are drawn."""
    with Scratch(docs.sparkSession, "resample") as s:
        both = [s.save(bucket_counts(d, buckets, longest, text_col), name) for d, name in ((docs, "source"), (target, "target"))]
        totals = []
        for part in both:
            total = np.zeros(buckets, dtype=object)
            for r in part.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
                total[r.bucket] = r.n
            totals.append(total)
        rows = s.keep(scored(docs, gains(*totals), longest, seed, id_col, text_col), "scored").withColumn("eligible", F.col("n_words") >= least_words)
    drawn = percent * rows.filter("eligible").count() // 100
    return ranked(rows, drawn, id_col).select(id_col, "n_features", "weight", "score", "rank")


#: The same in SQL; CRC-32 by its table of 256 remainders, a byte at a time.
ORACLE = f"""
WITH RECURSIVE bits(i, c, k) AS (SELECT i, i::BIGINT, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')) AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')) AS w FROM benchmark),
v AS (SELECT DISTINCT w FROM (SELECT w FROM w UNION ALL SELECT w FROM b)),
h AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(w)), lambda i: ('0x' || hex(w)[2 * i + 1:2 * i + 2])::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % {BUCKETS} AS bucket FROM v, tab),
s AS (SELECT bucket, count(*) AS n FROM w JOIN h USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM b JOIN h USING (w) GROUP BY bucket),
g AS (SELECT i AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM w) + {BUCKETS}) / ((coalesce(s.n, 0) + 1) * ((SELECT count(*) FROM b) + {BUCKETS}))))::BIGINT AS gain FROM range({BUCKETS}) r(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i),
d AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM w JOIN h USING (w) JOIN g USING (bucket) GROUP BY doc_id),
e AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight FROM documents LEFT JOIN d USING (doc_id)),
f AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || doc_id)[1:8])::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM e),
r AS (SELECT *, CASE WHEN n_features >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) END AS k FROM f)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= {PERCENT} * (SELECT count(*) FROM f WHERE n_features >= {LEAST_WORDS}) // 100 THEN k END AS rank FROM r
"""
