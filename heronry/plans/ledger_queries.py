"""Queries over index ledgers, replacements, vector caches and needs; made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.operators import ledger
from heronry.plans.base import Registry
from heronry.session import table

query = Registry()
#: Nations as indexes: how they describe themselves.
META = """SELECT n_nationkey AS world, 's' || (n_nationkey % 3) AS content_sig, CASE WHEN n_nationkey % 4 <> 0 THEN 7 END AS mapping_version, CASE WHEN n_nationkey % 5 <> 0 THEN c + CASE WHEN n_nationkey % 7 = 0 THEN 1 ELSE 0 END END AS doc_count,
CASE WHEN n_nationkey % 6 = 1 THEN 'm2' ELSE 'm1' END AS model, 64 AS dim FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_nationkey <> 3 GROUP BY 1) ON c_nationkey = n_nationkey"""


def described(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer").filter("c_nationkey <> 3").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("c"))
    k = F.col("n_nationkey")
    return n.join(c, n.n_nationkey == c.c_nationkey, "left").select(
        k.alias("world"), F.concat(F.lit("s"), k % 3).alias("content_sig"), F.when(k % 4 != 0, 7).alias("mapping_version"), F.when(k % 5 != 0, F.col("c") + F.when(k % 7 == 0, 1).otherwise(0)).alias("doc_count"),
        F.when(k % 6 == 1, "m2").otherwise("m1").alias("model"), F.lit(64).alias("dim"),
    )


def counted(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter("c_nationkey <> 3").groupBy(F.col("c_nationkey").alias("world")).agg(F.count(F.lit(1)).alias("n"))


@query("rebuild_reasons", f"""WITH m AS ({META}), b AS (SELECT m.*, coalesce((SELECT count(*) FROM customer WHERE c_nationkey = world AND c_nationkey <> 3), 0) AS n FROM m),
r AS (SELECT world, list_filter([CASE WHEN content_sig <> 's1' THEN 'content_sig' END, CASE WHEN mapping_version IS DISTINCT FROM 7 THEN 'mapping_version' END, CASE WHEN n = 0 AND doc_count IS DISTINCT FROM 0 THEN 'empty' END, CASE WHEN doc_count IS NOT NULL AND n <> doc_count THEN 'doc_count' END], lambda x: x IS NOT NULL) AS reasons FROM b)
SELECT world, reasons, len(reasons) > 0 AS rebuild FROM r""")
def rebuild_reasons(spark, sf_dir):  # K05
    return ledger.rebuild_reasons(described(spark, sf_dir), {"content_sig": "s1", "mapping_version": 7}, counted(spark, sf_dir))


@query("vector_identity", f"WITH m AS ({META}) SELECT world, CASE WHEN model = 'm1' AND dim = 64 THEN 'vectors' ELSE 'words' END AS state FROM m")
def vector_identity(spark, sf_dir):  # V06
    return ledger.identity_state(described(spark, sf_dir), {"model": "m1", "dim": 64})


@query("graph_counts", """WITH s AS (SELECT n_nationkey AS world, CASE WHEN n_nationkey % 6 <> 5 THEN (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) END AS node_count, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) + CASE WHEN n_nationkey % 4 = 1 THEN 1 ELSE 0 END AS edge_count, CASE WHEN n_nationkey % 3 = 0 THEN 8 ELSE 9 END AS era FROM nation)
SELECT world, CASE WHEN node_count IS NULL THEN 'no_stamp' WHEN era <> 9 THEN 'era_mismatch' WHEN world % 4 = 1 THEN 'count_mismatch' END AS reason FROM s""")
def graph_counts(spark, sf_dir):  # K07
    nodes, edges = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("world")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("world"))
    k = F.col("world")
    per = lambda d, c: d.groupBy("world").agg(F.count(F.lit(1)).alias(c))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("world"))
    stamps = n.join(per(nodes, "nodes"), "world", "left").join(per(edges, "edges"), "world", "left").select(
        k, F.when(k % 6 != 5, F.coalesce("nodes", F.lit(0))).alias("node_count"), (F.coalesce("edges", F.lit(0)) + F.when(k % 4 == 1, 1).otherwise(0)).alias("edge_count"), F.when(k % 3 == 0, 8).otherwise(9).alias("era")
    )
    return ledger.count_check(stamps, nodes, edges, 9)


@query("replaced_rows", """SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS l_quantity FROM lineitem WHERE l_orderkey % 10 <> 0 OR l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)
UNION ALL SELECT l_orderkey, l_linenumber, l_quantity + 1 FROM lineitem WHERE l_orderkey % 10 = 0 AND l_linenumber = 1""")
def replaced_rows(spark, sf_dir):  # K03, K08
    old = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"))
    new = old.filter("l_orderkey % 10 = 0 AND l_linenumber = 1").withColumn("l_quantity", F.col("l_quantity") + 1)
    return ledger.replaced(old, new, "l_orderkey")


@query("upserted_facts", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY o_custkey")
def upserted_facts(spark, sf_dir):  # K11
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return ledger.upserted(o, ["o_orderdate", "o_orderkey"], "o_custkey").drop("o_orderdate")


CHUNKS = "SELECT doc_id AS chunk_id, sha1('p|m|64|v1|' || text) AS key FROM documents WHERE text IS NOT NULL"


@query("vector_fill", f"""WITH c AS ({CHUNKS}), v AS (SELECT DISTINCT key FROM c JOIN embeddings ON vec_id = chunk_id WHERE vec_id % 3 = 0 AND vec_id % 9 <> 0)
SELECT chunk_id, c.key, CASE WHEN v.key IS NULL THEN 'missing' ELSE 'cached' END AS status FROM c LEFT JOIN v ON c.key = v.key""")
def vector_fill(spark, sf_dir):  # V05, V07
    key = ledger.vector_key(F.col("text"), "p", "m", 64, "v1")
    chunks = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("chunk_id"), key.alias("key"))
    e = table(spark, sf_dir, "embeddings").filter("vec_id % 3 = 0")
    spoilt = F.when(F.col("vec_id") % 9 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    cache = e.join(chunks, e.vec_id == chunks.chunk_id).select("key", spoilt.alias("vector"))
    return ledger.vector_fill(chunks, cache, 64)[0].select("chunk_id", "key", "status")


@query("disk_needs", """WITH s AS (SELECT source AS world, coalesce(lang, '?') AS family, doc_id, n_chars AS bytes, CASE WHEN doc_id % 4 <> 0 THEN n_chars + CASE WHEN doc_id % 8 = 1 THEN 1 ELSE 0 END END AS was FROM documents),
p AS (SELECT world, family, sum(bytes)::BIGINT AS bytes, sum(CASE WHEN bytes IS DISTINCT FROM was THEN bytes ELSE 0 END)::BIGINT AS changed FROM s GROUP BY ALL),
n AS (SELECT *, ceil(changed * CASE family WHEN 'en' THEN 2.5 WHEN 'de' THEN 1.5 WHEN 'fr' THEN 3.0 END::DOUBLE)::BIGINT AS need FROM p),
w AS (SELECT world, sum(bytes)::BIGINT AS bytes, sum(changed)::BIGINT AS changed, CASE WHEN count(need) = count(*) THEN sum(need)::BIGINT END AS need FROM n GROUP BY world)
SELECT *, CASE WHEN need IS NULL OR world IS NULL OR world = 'src5' THEN 'unknown' WHEN 9000 * len(world) < need THEN 'short' WHEN 18000 * len(world) < 3 * need THEN 'tight' ELSE 'ok' END AS status FROM w""")
def disk_needs(spark, sf_dir):  # A26
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("world"), F.coalesce("lang", F.lit("?")).alias("family"), F.col("doc_id").alias("path"), F.col("n_chars").cast("long").alias("bytes"))
    manifest = d.filter("path % 4 <> 0").select("path", (F.col("bytes") + F.when(F.col("path") % 8 == 1, 1).otherwise(0)).alias("bytes"))
    free = d.filter("world <> 'src5'").select("world").distinct().select("world", (9000 * F.length("world")).alias("free"))
    return ledger.disk_needs(d, manifest, spark.createDataFrame([("en", 2.5), ("de", 1.5), ("fr", 3.0)], "family string, peak double"), free)


@query("depth_quality", """WITH r AS (SELECT event_type AS condition, event_id % 4 AS rounds, CASE WHEN event_id % 11 <> 0 THEN ts END AS a, ts + to_minutes((event_id % 50)::INT) AS b, event_id % 9 AS asked, event_id % 5 AS ok, event_id % 100 AS cost FROM events)
SELECT condition, rounds, count(*) AS runs, sum(asked)::BIGINT AS asked, sum(ok)::BIGINT AS "right", sum(cost)::BIGINT AS cost FROM r WHERE a >= TIMESTAMP '2024-01-05' AND b <= TIMESTAMP '2024-01-20' GROUP BY ALL""")
def depth_quality(spark, sf_dir):  # A19
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    to = F.col("ts") + F.make_interval(mins=(i % 50).cast("int"))
    runs = e.select(F.col("event_type").alias("condition"), (i % 4).alias("rounds"), F.when(i % 11 != 0, F.col("ts")).alias("executed_from"), to.alias("executed_to"), (i % 9).alias("asked"), (i % 5).alias("right"), (i % 100).alias("cost"))
    return ledger.quality_runs(runs, "2024-01-05", "2024-01-20")


@query("messages_with_feedback", """WITH f AS (SELECT l_orderkey AS message_id, arg_max(l_linestatus, (l_shipdate, l_linestatus)) AS verdict, count(*) AS given FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey AS message_id, verdict, coalesce(given, 0) AS given FROM orders LEFT JOIN f ON message_id = o_orderkey""")
def messages_with_feedback(spark, sf_dir):  # J23
    f = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("message_id"), F.col("l_shipdate").alias("at"), F.col("l_linestatus").alias("verdict"))
    return ledger.with_feedback(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("message_id")), f)
