"""Mixing sources to target weights by a low-discrepancy schedule.

Sources in code-point order, null last, have the weights 3, 1, 2, repeating, and
share ``SHARE`` of all words. A target stops at twice its source's size and the
excess goes to the others by weight: target = min(2 * size, level * weight),
where level is the largest of the levels that result if the k sources with the
smallest size per weight are the ones that stop.

Each source's documents are shuffled (by a hash of their ids) and laid one after
the other; that stream is cut into blocks of equally many words, as many for all sources
but small ones, whose blocks are smaller. A schedule of
slots, each worth one block of its source, maps the multiples of the golden ratio, as fractions
of 2**32, through the cumulative targets (in blocks), so that any stretch of the schedule has
each source in its share of words. A slot's rank among its source's slots is the block it
takes, from the first again after the last, twice at most. Words taken of a
document are those of its parts in taken blocks, counted as often as taken.

A block is at most 1/``SLOTS`` of all words, and at most 1/``BLOCKS`` of its source's size and
of its target, or one word; so a target is met within a few thousandths of itself or a
few words, however large the other sources are. Running sums over a source go by
buckets of the hash, whose number grows with the table, ranks over the schedule by stretches of it: no window holds
a whole source.

A null text or one without words has size 0 and nothing taken; null is a source of its
own; a null doc_id is shuffled like others; repeated rows count one by one; other
columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.llm.common import materialise

#: Weights of sources in turn, and their share of all words.
WEIGHTS, SHARE = (3, 1, 2), 1.5
SLOTS, STRETCH = 131_072, 1024
#: Least number of blocks in a source and in its target, if they have so many words.
BLOCKS = 4096
#: 2**32 / golden ratio, odd.
GOLDEN = 2_654_435_769
WORDS = r"[^\x20\x09-\x0D]+"
#: Rows that a bucket of the shuffle hash holds at most, about; a bucket has so many leading digits in common.
BUCKET_ROWS = 65_536


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, source and number of words of each row."""
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("src"), F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))


def targets(rows: DataFrame) -> DataFrame:
    """Per source: src, idx, source_size, target, blocks, and its part [lo, hi) of 2**32; plus block and slots."""
    per = rows.groupBy("src").agg(F.sum("size").alias("source_size"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("src").asc_nulls_last())
    per = per.withColumn("idx", F.row_number().over(order)).withColumn("total", F.sum("source_size").over(everything))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("idx") - 1) % len(WEIGHTS) + 1)
    per = per.withColumn("weight", weight).withColumn("cap", 2.0 * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "idx")
    stopped = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", (SHARE * F.col("total") - stopped) / left)
    per = per.withColumn("target", F.least("cap", F.max("level").over(everything) * F.col("weight")))
    per = per.withColumn("widest", F.greatest(F.lit(1), F.floor(F.col("total") / SLOTS)).cast("long"))
    own = F.floor(F.least(F.col("source_size").cast("double"), F.col("target")) / BLOCKS)
    per = per.withColumn("block", F.greatest(F.lit(1), F.least("widest", own)).cast("long"))
    per = per.withColumn("part", F.floor(F.floor("target") * F.col("widest") / F.col("block")))  # the target, if its blocks were the widest
    per = per.withColumn("upto", F.sum("part").over(Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)))
    per = per.withColumn("whole", F.max("upto").over(everything))
    edge = lambda c: F.floor(c / F.greatest(F.col("whole"), F.lit(1)) * float(1 << 32)).cast("long")
    per = per.withColumn("lo", edge(F.col("upto") - F.col("part"))).withColumn("hi", edge(F.col("upto")))
    per = per.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    return per.withColumn("slots", F.floor(F.col("whole") / F.col("widest")).cast("long")).select("src", "idx", "source_size", "target", "blocks", "lo", "hi", "block", "slots")


def schedule(per: DataFrame) -> DataFrame:
    """The slots in order: slot, idx of the source, and the number of its block."""
    spark = per.sparkSession
    count = per.agg(F.max("slots")).first()[0] or 0
    slots = spark.range(count).select(F.col("id").alias("slot"), F.pmod(F.col("id") * GOLDEN, F.lit(1 << 32)).alias("u"))
    slots = slots.withColumn("cell", F.shiftright("u", 22))
    cells = per.filter("hi > lo").select("idx", "blocks", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", 22), F.shiftright(F.col("hi") - 1, 22))).alias("cell"))
    dealt = slots.join(cells, "cell").filter("u >= lo AND u < hi").withColumn("stretch", F.floor(F.col("slot") / STRETCH))
    counts = dealt.groupBy("idx", "stretch").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("idx").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("idx", "stretch", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("idx", "stretch").orderBy("slot"))
    ranked = dealt.withColumn("inside", inside).join(counts, ["idx", "stretch"]).withColumn("rank", F.col("before") + F.col("inside") - 1)
    return ranked.filter(F.col("rank") < 2 * F.col("blocks")).select("slot", "idx", F.pmod("rank", "blocks").alias("nth"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of ``docs``: id, size, source_size, target, taken."""
    rows = materialise(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    per = materialise(targets(rows), "mix-targets")
    taken = schedule(per).groupBy("idx", "nth").agg(F.count(F.lit(1)).alias("times"))

    key = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    at = rows.alias("r").join(per.alias("p"), F.col("r.src").eqNullSafe(F.col("p.src"))).select("id", "size", "idx", "source_size", "target", "block", key.alias("key"))
    digits = 2
    while rows.count() > BUCKET_ROWS * 16**digits:
        digits += 1
    at = at.withColumn("bucket", F.substring("key", 1, digits))
    sums = at.groupBy("idx", "bucket").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("idx").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("idx", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("idx", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = at.withColumn("upto", inside).join(sums, ["idx", "bucket"]).withColumn("first", F.col("before") + F.col("upto") - F.col("size"))

    some = at.filter("size > 0")
    span = F.sequence(F.floor(F.col("first") / F.col("block")), F.floor((F.col("first") + F.col("size") - 1) / F.col("block")))
    parts = some.select("id", "size", "idx", "source_size", "target", "first", "block", F.explode(span).alias("nth"))
    both = F.least(F.col("first") + F.col("size"), (F.col("nth") + 1) * F.col("block")) - F.greatest("first", F.col("nth") * F.col("block"))
    got = parts.join(taken, ["idx", "nth"], "left").withColumn("words", both * F.coalesce("times", F.lit(0)))
    full = got.groupBy("id", "idx", "first", "size", "source_size", "target").agg(F.sum("words").cast("long").alias("taken"))
    columns = [F.col("id").alias(id_col), "size", "source_size", "target", "taken"]
    return full.select(*columns).unionByName(at.filter("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*columns))


#: The same in SQL, for tables in which no source is so small that its blocks are smaller.
ORACLE = f"""
WITH r AS (SELECT doc_id AS id, source AS src, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
a AS (SELECT src, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY src NULLS LAST) AS idx FROM r GROUP BY src),
b AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS total, [3.0, 1.0, 2.0][((idx - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM a),
c AS (SELECT *, (1.5::DOUBLE * total - coalesce(sum(cap) OVER (ORDER BY cap / weight, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER (ORDER BY cap / weight, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM b),
d AS (SELECT *, least(cap, max(level) OVER () * weight) AS target FROM c),
e AS (SELECT *, (sum(floor(target)::BIGINT) OVER (ORDER BY idx))::BIGINT AS upto, (sum(floor(target)::BIGINT) OVER ())::BIGINT AS whole, greatest(1, total // {SLOTS})::BIGINT AS block FROM d),
p AS (SELECT src, idx, source_size, target, block, ((source_size + block - 1) // block)::BIGINT AS blocks, (whole // block)::BIGINT AS slots,
  floor((upto - floor(target)::BIGINT)::DOUBLE / greatest(whole, 1) * 4294967296.0::DOUBLE)::BIGINT AS lo, floor(upto::DOUBLE / greatest(whole, 1) * 4294967296.0::DOUBLE)::BIGINT AS hi FROM e),
s AS (SELECT i AS slot, (i * {GOLDEN}) % 4294967296 AS u FROM (SELECT unnest(range((SELECT max(slots) FROM p))) AS i)),
k AS (SELECT p.idx, p.blocks, row_number() OVER (PARTITION BY p.idx ORDER BY slot) - 1 AS rank FROM s JOIN p ON s.u >= p.lo AND s.u < p.hi),
t AS (SELECT idx, rank % blocks AS nth, count(*) AS times FROM k WHERE rank < 2 * blocks GROUP BY ALL),
w AS (SELECT r.id, r.size, p.idx, p.source_size, p.target, p.block, (sum(r.size) OVER (PARTITION BY p.idx ORDER BY md5('mix:' || coalesce(r.id::VARCHAR, 'null')), r.id, r.size ROWS UNBOUNDED PRECEDING))::BIGINT - r.size AS first FROM r JOIN p ON r.src IS NOT DISTINCT FROM p.src),
x AS (SELECT id, size, idx, source_size, target, first, block, unnest(range(first // block, (first + size - 1) // block + 1)) AS nth FROM w WHERE size > 0),
y AS (SELECT x.id, x.idx, x.first, x.size, x.source_size, x.target, sum((least(first + size, (x.nth + 1) * block) - greatest(first, x.nth * block)) * coalesce(times, 0)) AS taken FROM x LEFT JOIN t ON x.idx = t.idx AND x.nth = t.nth GROUP BY ALL)
SELECT id AS doc_id, size, source_size, target, taken::BIGINT AS taken FROM y UNION ALL SELECT id, size, source_size, target, 0 FROM w WHERE size = 0
"""
