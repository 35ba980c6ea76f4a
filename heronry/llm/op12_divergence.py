"""Divergence of sources: how far the terms of each source of a language are from the other sources and from the language.

Each task counts the terms of its batches in a DuckDB of its own, so that one row for a
(lang, source, term) and stretch of the table leaves it. Those rows are dealt to shards by a hash of (lang, term); a
shard's DuckDB adds them up in one streamed statement and keeps the terms with enough documents in their
language. Spark sums the totals of groups and languages. With them the counts go to shards again, where DuckDB
computes the partial sums of all pairs of sources and the shard's first terms of every group, and Spark merges sums and rankings.

A group has a probability for every kept term, also for those that it lacks. Only terms that both groups of a pair
have are compared one by one; for the others a group's probabilities depend on its count alone, so
histograms of counts say the rest: with p0 for a count of 0,

    sum of f(p, q) = V f(p0, q0) + sum over the first's terms of f(p, q0) - f(p0, q0) + the same for the second's
        + sum over common terms of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

All of it is integer arithmetic, in 128 bits where products need it. Work on pairs grows with the pairs of sources that share a term, not with
sources squared times terms. The number of shards grows with the bytes of text.

Null text, lang and source count as empty strings; equal values rank by their item; repeated rows count each; a group
without terms has the pairs of its language; a language without kept terms has pairs of value 0 and no terms;
extra columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronry.llm.common import Scratch, sliced, small_batches
from heronry.llm.duck import connect, words_sql

#: Terms, their least number of documents, one added to each count, the probabilities' unit, and the ranks given of terms.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST, ADDED, UNIT, TOP = 3, 1, 1_000_000_000, 200
#: Characters counted in one statement, rows that a task holds before it hands them on, bytes of text a shard.
CHARS, HELD, SHARD_BYTES = 8_000_000, 1_500_000, 16 << 20
#: Parts that a group's terms are ranked in before they meet.
SALTS = 64
DECIMAL = T.DecimalType(38, 0)

#: Counts of one slice.
SLICE_SQL = f"""INSERT INTO held WITH words AS ({words_sql(TERM, "texts")}), each AS (SELECT row, word, count(*) AS n FROM words GROUP BY ALL)
SELECT lang, source, word, sum(n)::BIGINT, count(*) FROM each JOIN texts USING (row) GROUP BY ALL"""
HELD_SQL = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM held GROUP BY ALL"
#: A shard's counts of kept terms, with the language's; ``first`` stands once at each term.
SHARD_SQL = f"""WITH g AS (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM part GROUP BY ALL)
SELECT lang, source, term, n, (sum(n) OVER t)::BIGINT AS of_lang, (row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1)::BIGINT AS first
FROM g WINDOW t AS (PARTITION BY lang, term) QUALIFY sum(docs) OVER t >= {LEAST}"""


def _p(n: str, total: str) -> str:
    return f"(1 + ({UNIT}::HUGEINT * ({n} + {ADDED})) // ({total} + {ADDED} * terms))::BIGINT"


_f = lambda p, q: f"(({p}) - ({q})) * (({p}) - ({q})) // ({q})"
#: A shard's rows with probabilities: its own, that of a count of 0, the language's.
SCORED_SQL = f"CREATE OR REPLACE TEMP TABLE e AS SELECT lang, source, term, {_p('n', 'total')} AS p, {_p('0', 'total')} AS p0, {_p('of_lang', 'lang_total')} AS q FROM part"
PAIRS_SQL = f"""SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum({_f('a.p', 'b.p')} - {_f('a.p', 'b.p0')} - {_f('a.p0', 'b.p')} + {_f('a.p0', 'b.p0')})::DECIMAL(38, 0) AS value
FROM e a JOIN e b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL"""
TERMS_SQL = f"""SELECT lang, source, 'term' AS part, term AS item, ({_f('p', 'q')})::DECIMAL(38, 0) AS value FROM e WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY {_f('p', 'q')} DESC, term) <= {TOP}"""


def _batches(con, sql: str):
    yield from con.execute(sql).to_arrow_reader(50_000)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, one row for each stretch of the table that has it."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("lang", "source", "term")] + [T.StructField(c, T.LongType()) for c in ("n", "docs")])

    def run(batches):
        con = connect()
        con.execute("CREATE TEMP TABLE held (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        for b in batches:
            for key, texts in sliced(b, 0, 1, CHARS):
                con.register("texts", pa.table({"row": range(len(texts)), "lang": key.field("lang"), "source": key.field("source"), "text": texts}))
                con.execute(SLICE_SQL)
                if con.execute("SELECT count(*) FROM held").fetchall()[0][0] >= HELD:
                    yield from _batches(con, HELD_SQL)
                    con.execute("TRUNCATE held")
        yield from _batches(con, HELD_SQL)

    small_batches(docs.sparkSession)
    return docs.select(F.struct("lang", "source").alias("key"), "text").mapInArrow(run, schema)


def shard(rows: DataFrame, schema: T.StructType, statements: list[str], results: list[str]) -> DataFrame:
    """Each partition of ``rows`` streamed as the table ``part`` into a DuckDB: the statements, then all rows of the results."""
    def run(batches):
        first = next(batches, None)
        if first is None:
            return

        def every():
            yield first
            yield from batches

        con = connect()
        part = pa.RecordBatchReader.from_batches(first.schema, every())  # noqa: F841  DuckDB finds it by name
        con.register("part", part)
        for s in statements:
            con.execute(s)
        for s in results:
            yield from _batches(con, s)

    return rows.mapInArrow(run, schema)


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` with each other source of the language, ``term`` with the group's first terms."""
    spark = docs.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    three = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    key = ["lang", "source"]
    with Scratch(spark, "divergence") as s:
        size = three.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES + 1)
        schema = T.StructType([T.StructField(c, T.StringType()) for c in ("lang", "source", "term")] + [T.StructField(c, T.LongType()) for c in ("n", "of_lang", "first")])
        counts = s.save(shard(term_counts(three).repartition(shards, "lang", "term"), schema, [], [SHARD_SQL]), "counts")

        groups = three.select(*key).distinct().join(counts.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("first").alias("first")), key, "left").fillna(0)
        groups = s.save(groups, "groups")
        langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("first").alias("terms"))
        groups = s.save(groups.join(langs, "lang").select(*key, F.col("n").alias("total"), "lang_total", "terms"), "totals")

        rows = counts.drop("first").join(groups, key).repartition(shards, "lang", "term")
        out = T.StructType([T.StructField(c, T.StringType()) for c in ("lang", "source", "part", "item")] + [T.StructField("value", DECIMAL)])
        parts = s.save(shard(rows, out, [SCORED_SQL], [PAIRS_SQL, TERMS_SQL]), "parts")

        p = lambda n: F.expr(f"1 + (cast({UNIT} AS decimal(10, 0)) * cast({n} + {ADDED} AS decimal(20, 0))) div cast(total + {ADDED} * terms AS decimal(20, 0))")
        f = lambda x, q: F.expr(f"({x} - {q}) * ({x} - {q}) div {q}").cast(DECIMAL)
        some = groups.filter("terms > 0").select(*key, "total", "terms", p("0").alias("p0"))
        each = counts.groupBy(*key, "n").agg(F.count(F.lit(1)).alias("m")).join(some, key).groupBy(*key, "p0", p("n").alias("p")).agg(F.sum("m").alias("m"))
        other = some.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
        met = each.join(other, "lang").filter("source <> item")
        m = F.col("m").cast(DECIMAL)
        ways = F.array(
            F.struct("source", "item", (m * (f("p", "q0") - f("p0", "q0"))).cast(DECIMAL).alias("value")),
            F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (m * (f("q0", "p") - f("q0", "p0"))).cast(DECIMAL).alias("value")),
        )
        rest = met.select("lang", F.inline(ways))
        none = groups.select(*key, "terms").join(some.select(*key, "p0"), key, "left")
        base = none.join(none.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")), "lang").filter("source <> item")
        base = base.select(*key, "item", F.coalesce(F.col("terms").cast(DECIMAL) * f("p0", "q0"), F.lit(0)).cast(DECIMAL).alias("value"))
        common = parts.filter("part = 'pair'").select(*key, "item", "value")
        sums = base.unionByName(rest).unionByName(common).groupBy(*key, "item").agg(F.sum("value").cast(DECIMAL).alias("value"))
        sums = s.keep(sums.withColumn("part", F.lit("pair")), "pairs")

        best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), "item"))
        terms = parts.filter("part = 'term'").withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)))
        terms = s.keep(terms.withColumn("rank", best(*key, "salt")).filter(F.col("rank") <= TOP).drop("rank", "salt"), "terms")
    ranked = sums.withColumn("rank", best(*key)).unionByName(terms.withColumn("rank", best(*key)).filter(F.col("rank") <= TOP))
    return ranked.select(*key, "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


#: The same in SQL, with every probability of every group.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM d),
k AS (SELECT lang, term FROM (SELECT DISTINCT r, lang, term FROM w) GROUP BY ALL HAVING count(*) >= {LEAST}),
v AS (SELECT lang, count(*) AS terms FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + ({UNIT} * (n + 1)) // ((sum(n) OVER (PARTITION BY lang, source))::BIGINT + terms) AS p FROM a JOIN v USING (lang)),
l AS (SELECT lang, term, 1 + ({UNIT} * (sum(n)::BIGINT + 1)) // ((sum(sum(n)) OVER (PARTITION BY lang))::BIGINT + any_value(terms)) AS q FROM a JOIN v USING (lang) GROUP BY lang, term),
s AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
o AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM o QUALIFY part = 'pair' OR rank <= {TOP}
"""
