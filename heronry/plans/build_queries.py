"""Queries from files to a graph to impact; a corpus of programs, jobs and copybooks made of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.operators import build, graph
from heronry.plans.base import Registry
from heronry.session import Scratch, table

query = Registry()
#: Program k calls program k / 2 and copies book k % 30; books from 25 are in another top folder only; every fifth has a job.
CBL = "'       PROGRAM-ID. P' || k || '.' || chr(10) || CASE WHEN k % 4 = 0 THEN '      * CALL \"NO' || k || '\".' || chr(10) ELSE '' END || CASE WHEN k % 3 = 0 THEN '           CALL \"P' ELSE '           call \"p' END || (k DIV 2) || '\".' || chr(10) || '       COPY C' || (k % 30) || '.'"
JOB = "'//J' || k || ' JOB 1' || chr(10) || '//* EXEC PGM=P1' || chr(10) || '//S1 EXEC PGM=P' || k"


def corpus(spark, sf_dir):
    """Files (doc_id, path, text)."""
    k = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    sql = lambda s: F.expr(s.replace("chr(10)", "'\\n'"))
    programs = k.select((F.col("k") * 3).alias("doc_id"), sql("'w/cbl/d' || (k % 7) || '/P' || k || '.cbl'").alias("path"), sql(CBL).alias("text"))
    jobs = k.filter("k % 5 = 0").select((F.col("k") * 3 + 1).alias("doc_id"), sql("'w/jcl/J' || k || '.jcl'").alias("path"), sql(JOB).alias("text"))
    books = k.select((F.col("k") % 30).alias("c")).distinct().select((F.col("c") * 3 + 2).alias("doc_id"), sql("CASE WHEN c < 25 THEN 'w' ELSE 'other' END || '/cpy/C' || c || '.cpy'").alias("path"), sql("'01 X' || c || ' PIC X.'").alias("text"))
    return programs.unionByName(jobs).unionByName(books)


EDGES_SQL = """p AS (SELECT o_orderkey AS k, 'program|w/cbl/d' || (o_orderkey % 7) || '/P' || o_orderkey || '.cbl|P' || o_orderkey AS cid FROM orders),
e AS (SELECT a.cid AS src, 'INVOKES' AS type, b.cid AS dst FROM p a JOIN p b ON b.k = a.k // 2 UNION ALL SELECT cid, 'INCLUDES', 'copybook|w/cpy/C' || (k % 30) || '.cpy|C' || (k % 30) FROM p WHERE k % 30 < 25
UNION ALL SELECT 'job|w/jcl/J' || k || '.jcl|J' || k, 'EXECUTES', cid FROM p WHERE k % 5 = 0)"""


@query("graph_edges", f"WITH {EDGES_SQL} SELECT * FROM e")
def graph_edges(spark, sf_dir):  # G01, K06
    return build.build(corpus(spark, sf_dir))[1].select("src", "type", "dst")


@query("unresolved_references", """SELECT CASE WHEN k % 30 >= 25 THEN 'cross_scope' END AS status, 'C' || (k % 30) AS name, count(*) AS n FROM (SELECT o_orderkey AS k FROM orders) WHERE k % 30 >= 25 GROUP BY ALL
UNION ALL SELECT 'unresolved', 'P' || (a.o_orderkey // 2), count(*) FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_orderkey = a.o_orderkey // 2) GROUP BY ALL""")
def unresolved_references(spark, sf_dir):  # G01, G13
    return build.build(corpus(spark, sf_dir))[2].groupBy("status", "name").agg(F.count(F.lit(1)).alias("n"))


@query("impact_from_files", f"""WITH RECURSIVE {EDGES_SQL}, w(id, level) AS (SELECT 'copybook|w/cpy/C7.cpy|C7', 0 UNION SELECT e.src, w.level + 1 FROM w JOIN e ON e.dst = w.id), s AS (SELECT id, min(level) AS level FROM w GROUP BY id)
SELECT id AS cid, split_part(id, '|', 1) AS kind, split_part(id, '|', 3) AS name, level::INT AS level FROM s""")
def impact_from_files(spark, sf_dir):  # G01, G02, G04, G09, G15
    return build.impact_of(*build.build(corpus(spark, sf_dir)), "c7.", 40)[0].select("cid", "kind", "name", "level")


@query("impact_coverage", """SELECT count(*) AS n, 0::BIGINT AS lost, ['depth_truncated'] AS limits, false AS complete FROM (SELECT 1 UNION ALL SELECT 1 FROM orders WHERE o_orderkey % 30 = 7)""")
def impact_coverage(spark, sf_dir):  # G13, G14
    return build.impact_of(*build.build(corpus(spark, sf_dir)), "C7", 1)[1]


#: Ancestors of program k by calls are k, k / 2, k / 4 ...; a book reaches the programs with one that copies it, and their jobs.
GOLD_SQL = """p AS (SELECT o_orderkey AS k FROM orders), a AS (SELECT DISTINCT k, (k >> i) % 30 AS c FROM p, (SELECT unnest(range(0, 40)) AS i) WHERE (k >> i) % 30 < 25 AND (i = 0 OR k >> (i - 1) > 0)), d AS (SELECT k, k % 30 AS c FROM p WHERE k % 30 < 25),
n AS (SELECT (SELECT count(*) + count(*) FILTER (k % 5 = 0) FROM a) AS whole, (SELECT count(*) + count(*) FILTER (k % 5 = 0) FROM d) AS direct)"""


@query("closure_quality", f"""WITH {GOLD_SQL} SELECT '' AS dropped, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS "precision" UNION ALL SELECT 'INVOKES', round(direct / whole, 6), 1.0 FROM n""")
def closure_quality(spark, sf_dir):  # G15
    nodes, edges, _ = build.build(corpus(spark, sf_dir))
    books = nodes.filter("kind = 'copybook'").select(F.col("cid").alias("id"))
    k = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    ancestors = "array_distinct(filter(transform(filter(sequence(0, length(bin(k))), i -> i = 0 OR shiftright(k, i - 1) > 0), i -> shiftright(k, i) % 30), c -> c < 25))"
    up = k.select("k", F.explode(F.expr(ancestors)).alias("c"))
    book, path = F.expr("'copybook|w/cpy/C' || c || '.cpy|C' || c").alias("start"), {"program": "'program|w/cbl/d' || (k % 7) || '/P' || k || '.cbl|P' || k", "job": "'job|w/jcl/J' || k || '.jcl|J' || k"}
    gold = up.select(book, F.expr(path["program"]).alias("id")).unionByName(up.filter("k % 5 = 0").select(book, F.expr(path["job"]).alias("id")))
    out = None
    with Scratch(spark, "closure") as s:
        edges = s.save(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type"), "edges")
        numbers = graph.numbered(books.unionByName(gold.select(F.col("start").alias("id"))))
        truth = s.save(graph.marked(gold, numbers), "gold")
        for dropped in ("", "INVOKES"):
            back, asked = edges.filter(F.col("type") != dropped), numbers.join(books, F.col("start") == F.col("id"), "left_semi")
            one = s.keep(build.quality(graph.reached(back, asked), truth), "quality").select(F.lit(dropped).alias("dropped"), "recall", "precision")
            out = one if out is None else out.unionByName(one)
    return out


@query("impact_limits", """WITH n AS (SELECT count(*) AS n FROM orders WHERE o_orderkey % 30 = 7) SELECT 'deep' AS question, 'depth' AS kind, 'impact' AS stage, NULL::BIGINT AS count UNION ALL SELECT 'rows', 'row_cap', 'impact', 5 UNION ALL SELECT 'starts', 'narrow_required', 'anchor', 1
UNION ALL SELECT 'results', 'depth', 'impact', NULL UNION ALL SELECT 'results', 'result_cap', 'impact', n + 1 - 3 FROM n UNION ALL SELECT 'files', 'source_unparsed', 'impact', 4 UNION ALL SELECT 'old', 'graph_reingest_required', 'anchor', NULL""")
def impact_limits(spark, sf_dir):  # G13, G14
    nodes, edges, _ = build.build(corpus(spark, sf_dir))
    questions = {"deep": {"depth": 1}, "rows": {"depth": 1, "ceiling": 5}, "starts": {"most_starts": 0}, "results": {"depth": 1, "most": 3}, "files": {"depth": 40, "unparsed": 4, "ceiling": 10**9}, "old": {"same_era": False}}
    out = None
    with Scratch(spark, "limits") as s:
        nodes, edges = s.save(nodes, "nodes"), s.save(edges.select("src", "type", "dst"), "edges")
        for name, how in questions.items():
            limits = build.answer(nodes, edges, "C7", **how)[1].withColumn("question", F.lit(name))
            out = limits if out is None else out.unionByName(limits)
    return out


@query("impact_traces", f"""WITH RECURSIVE {EDGES_SQL}, w(id, level) AS (SELECT 'copybook|w/cpy/C7.cpy|C7', 0 UNION SELECT e.src, w.level + 1 FROM w JOIN e ON e.dst = w.id), s AS (SELECT id, min(level) AS level FROM w GROUP BY id),
t(id, trace, types, level) AS (SELECT id, [id], []::VARCHAR[], 0 FROM s WHERE level = 0 UNION ALL SELECT x.id, list_append(t.trace, x.id), list_append(t.types, x.type), x.level FROM t JOIN (SELECT s.id, s.level, min({{'f': e.dst, 't': e.type}}).f AS parent, min({{'f': e.dst, 't': e.type}}).t AS type FROM s JOIN e ON e.src = s.id JOIN s p ON p.id = e.dst AND p.level = s.level - 1 GROUP BY s.id, s.level) x ON x.parent = t.id AND x.level = t.level + 1)
SELECT id AS cid, level::INT AS level, trace, types FROM t""")
def impact_traces(spark, sf_dir):  # G02, G09
    nodes, edges, _ = build.build(corpus(spark, sf_dir))
    return build.answer(nodes, edges, "c7.", 40, 10**9)[0].select("cid", "level", "trace", "types")


DEFS = "SELECT doc_id AS def_id, source || '/' || (doc_id % 5) || '/d' || doc_id AS path, 'n' || (doc_id % 41) AS name, doc_id % 3 = 0 AS definition FROM documents"
REFS = "SELECT doc_id AS ref_id, source || '/' || (doc_id % 7) || '/r' || doc_id AS path, 'n' || (doc_id % 43) AS name FROM documents"


@query("keyed_calls", f"""WITH d AS ({DEFS}), r AS ({REFS}), j AS (SELECT ref_id, def_id, definition, split_part(r.path, '/', 1) = split_part(d.path, '/', 1) AS same, CASE WHEN split_part(r.path, '/', 2) = split_part(d.path, '/', 2) THEN 0 ELSE 2 END AS dist FROM r LEFT JOIN d USING (name)),
m AS (SELECT *, coalesce(bool_or(same AND definition) OVER (PARTITION BY ref_id), false) AS defined FROM j), g AS (SELECT *, same AND (definition OR NOT defined) AS ok FROM m), h AS (SELECT *, min(CASE WHEN ok THEN dist END) OVER (PARTITION BY ref_id) AS least FROM g)
SELECT ref_id, CASE WHEN count(*) FILTER (ok AND dist = least) = 1 THEN min(def_id) FILTER (ok AND dist = least) END AS def_id, CASE WHEN count(*) FILTER (ok AND dist = least) = 1 THEN 'resolved' WHEN count(*) FILTER (ok AND dist = least) > 1 THEN 'ambiguous' WHEN count(def_id) > 0 THEN 'cross_scope' ELSE 'unresolved' END AS status FROM h GROUP BY ref_id""")
def keyed_calls(spark, sf_dir):  # J07
    d = table(spark, sf_dir, "documents")
    path = lambda n, x: F.concat("source", F.lit("/"), F.col("doc_id") % n, F.lit(f"/{x}"), "doc_id").alias("path")
    defs = d.select(F.col("doc_id").alias("def_id"), path(5, "d"), F.lit("f").alias("kind"), F.concat(F.lit("n"), F.col("doc_id") % 41).alias("name"), (F.col("doc_id") % 3 == 0).alias("definition"))
    refs = d.select(F.col("doc_id").alias("ref_id"), path(7, "r"), F.lit("f").alias("kind"), F.concat(F.lit("n"), F.col("doc_id") % 43).alias("name"))
    return graph.nearest_keyed(refs, defs)
