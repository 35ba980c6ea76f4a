"""Queries of includes by path and of types with their subtypes, made of parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.operators import hierarchy
from heronry.plans.base import Registry
from heronry.session import table

query = Registry()
PATHS = ["a//b/./c", "../x/y", "a/b/../../c/d.h", "a\\b\\..\\c", "./a/../..//b", "x/..", "/abs/../q"]
FOLDED = ["a/b/c", "../x/y", "c/d.h", "a/c", "../b", "", "q"]


@query("folded_paths", f"SELECT p_partkey, CASE p_partkey % {len(PATHS)} {' '.join(f'WHEN {k} THEN {v!r}' for k, v in enumerate(FOLDED))} END AS folded FROM part")
def folded_paths(spark, sf_dir):  # J05
    k = table(spark, sf_dir, "part")
    path = F.element_at(F.array(*map(F.lit, PATHS)), (F.col("p_partkey") % len(PATHS) + 1).cast("int"))
    return k.select("p_partkey", hierarchy.folded(path).alias("folded"))


ALIASES, COPY_PATHS = {"inc": "g0/lib", "two": "inc/sub", "loop": "loop2/x", "loop2": "loop"}, ["g0/cpy/a", "g1/cpy", "g0/cpy"]
#: Header k is in one of two top folders; every third lies in a folder below.
FILE = "'g' || (k % 2) || '/lib/' || CASE WHEN k % 3 = 0 THEN 'sub/' ELSE '' END || 'h' || k || '.h'"
#: Books of 20 names below three folders of g0 and one of g1.
BOOK = "'g' || (k % 2) || '/cpy/' || CASE k % 3 WHEN 0 THEN 'a/' WHEN 1 THEN 'b/' ELSE '' END || 'd' || (k % 7) || '/C' || (k % 20) || '.cpy'"
#: Includes of order k: relative, by an alias, by an alias of an alias, by a circular one, without a folder.
INCLUDE = "CASE k % 5 WHEN 0 THEN '../lib/h' || n || '.h' WHEN 1 THEN 'inc/h' || n || '.h' WHEN 2 THEN 'two\\\\.\\\\h' || n || '.h' WHEN 3 THEN 'loop/h' || n || '.h' ELSE 'h' || n || '.h' END"


@query("include_targets", f"""WITH f AS (SELECT {FILE} AS path, p_partkey AS k FROM (SELECT *, p_partkey AS k FROM part)), b AS (SELECT DISTINCT {BOOK} AS path, k % 20 AS c FROM (SELECT p_partkey AS k FROM part)),
r AS (SELECT k, k % 97 AS n FROM (SELECT o_orderkey AS k FROM orders)),
t AS (SELECT k, f.path AS target, CASE k % 5 WHEN 0 THEN 'relative' ELSE 'alias' END AS how FROM r JOIN (SELECT path, k AS fk FROM f) f ON fk = n AND ((r.k % 5 = 0 AND f.path = 'g' || (r.k % 2) || '/lib/h' || n || '.h') OR (r.k % 5 = 1 AND r.k % 2 = 0 AND f.path = 'g0/lib/h' || n || '.h') OR (r.k % 5 = 2 AND r.k % 2 = 0 AND f.path = 'g0/lib/sub/h' || n || '.h'))),
p AS (SELECT unnest([0, 1, 2]) AS o, unnest(['g0/cpy/a', 'g1/cpy', 'g0/cpy']) AS prefix), a AS (SELECT c, o, prefix, min(path) AS target FROM b JOIN p ON starts_with(b.path, prefix || '/') GROUP BY ALL HAVING count(*) = 1),
x AS (SELECT k, arg_min(target, o) AS target FROM r JOIN a ON a.c = r.k % 23 AND split_part(prefix, '/', 1) = 'g' || (r.k % 2) GROUP BY k)
SELECT 'i' || r.k AS ref_id, t.target, t.how FROM r LEFT JOIN t USING (k) UNION ALL SELECT 'c' || r.k, x.target, CASE WHEN x.target IS NOT NULL THEN 'copy_path' END FROM r LEFT JOIN x USING (k)""")
def include_targets(spark, sf_dir):  # J05
    p, o = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    headers = p.select(F.expr(FILE).alias("path"), F.lit("file").alias("kind"), F.expr("'h' || k || '.h'").alias("name"))
    books = p.select(F.expr(BOOK).alias("path"), F.lit("copybook").alias("kind"), F.expr("'C' || (k % 20)").alias("name"))
    o = o.withColumn("n", F.col("k") % 97)
    path = F.expr("'g' || (k % 2) || '/src/m' || k || '.c'").alias("path")
    ref = o.select(F.expr("'i' || k").alias("ref_id"), path, F.expr(INCLUDE).alias("include"), F.lit("file").alias("kind"), F.expr("'h' || n || '.h'").alias("name"))
    copies = o.select(F.expr("'c' || k").alias("ref_id"), path, F.expr("'C' || (k % 23)").alias("include"), F.lit("copybook").alias("kind"), F.expr("'C' || (k % 23)").alias("name"))
    return hierarchy.include_paths(ref.unionByName(copies), headers.unionByName(books), ALIASES, COPY_PATHS)


#: Type k extends k / 4; every 50th has a second parent, and types 3 and 13 are in a circle of two with what is below them.
RELATIONS = "SELECT o_orderkey AS child, o_orderkey // 4 AS parent FROM orders WHERE o_orderkey // 4 > 0 UNION ALL SELECT o_orderkey, o_orderkey // 7 FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT 3, 13 UNION ALL SELECT 13, 3"
TREE_SQL = f"rel AS (SELECT DISTINCT child, parent FROM ({RELATIONS})), amb AS (SELECT child AS id FROM rel GROUP BY child HAVING count(*) > 1), e AS (SELECT * FROM rel WHERE child NOT IN (SELECT id FROM amb))"


def relations(spark, sf_dir):
    k = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    third = spark.createDataFrame([(3, 13), (13, 3)], "child long, parent long")
    return k.selectExpr("k AS child", "k DIV 4 AS parent").filter("parent > 0").unionByName(k.filter("k % 50 = 0").selectExpr("k AS child", "k DIV 7 AS parent")).unionByName(third)


@query("all_subtypes", f"WITH RECURSIVE {TREE_SQL}, r(id, subtype) AS (SELECT parent, child FROM e WHERE parent < 60 UNION SELECT r.id, e.child FROM r JOIN e ON e.parent = r.subtype), root(id) AS (SELECT parent FROM rel WHERE parent NOT IN (SELECT child FROM e) UNION SELECT e.child FROM root JOIN e ON e.parent = root.id) SELECT r.id, r.subtype, EXISTS (SELECT 1 FROM e WHERE e.parent = r.id AND e.child = r.subtype) AS direct FROM r WHERE r.id IN (SELECT id FROM root)")
def all_subtypes(spark, sf_dir):  # G11
    labels, _ = hierarchy.labelled(relations(spark, sf_dir))
    return hierarchy.subtypes(labels, spark.range(60))


@query("unplaced_types", f"WITH RECURSIVE {TREE_SQL}, root(id) AS (SELECT id FROM (SELECT child AS id FROM rel UNION SELECT parent FROM rel) WHERE id NOT IN (SELECT child FROM e) UNION SELECT e.child FROM root JOIN e ON e.parent = root.id) SELECT id, 'ambiguous' AS reason FROM amb UNION ALL SELECT id, 'circular' FROM (SELECT child AS id FROM rel UNION SELECT parent FROM rel) WHERE id NOT IN (SELECT id FROM root)")
def unplaced_types(spark, sf_dir):  # G11
    return hierarchy.labelled(relations(spark, sf_dir))[1]
