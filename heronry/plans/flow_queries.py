"""Queries of data that flows between programs by files and copied items; texts are made of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.operators import build, graph
from heronry.plans.base import Registry
from heronry.session import table

query = Registry()
N = " || chr(10) || "


def _lines(*parts: str) -> str:
    return N.join(f"'{p}'" if not p.startswith("=") else p[1:] for p in parts)


#: Program k reads IND, writes OUTD0 to OUTD2 and, every fifth, updates UPD; statements over lines, comments, and files opened only by READ and WRITE.
PROGRAM = _lines(
    "000100 IDENTIFICATION DIVISION.", "=CASE WHEN k % 2 = 0 THEN '000200 PROGRAM-ID. P' || k || '.' ELSE '       PROGRAM-ID.' || chr(10) || '           P' || k || '.' END", "       ENVIRONMENT DIVISION.", "       INPUT-OUTPUT SECTION.", "       FILE-CONTROL.",
    "           SELECT INF ASSIGN TO UT-S-IND.", "      *    SELECT NOF ASSIGN TO NODD.", "=CASE WHEN k % 4 = 0 THEN '           SELECT OPTIONAL OUTF' || chr(10) || '               ASSIGN OUTD' || (k % 3) || '.' ELSE '           select outf assign to DA-OUTD' || (k % 3) || ' organization sequential.' END",
    "           SELECT BOTHF ASSIGN TO UPD. SELECT LITF ASSIGN TO \"x.dat\". SELECT SRTF ASSIGN TO SRT.", "       DATA DIVISION.", "       FILE SECTION.", "       FD  INF.", "       01  IN-R PIC X(80).", "       FD  OUTF.", "       01  OUT-R PIC X(80).", "       SD  SRTF.", "       WORKING-STORAGE SECTION.", "       PROCEDURE DIVISION.",
    "=CASE WHEN k % 4 = 0 THEN '           OPEN INPUT INF OUTPUT OUTF.' WHEN k % 4 = 1 THEN '           OPEN INPUT INF' || chr(10) || '                EXTEND OUTF.' ELSE '           READ INF. WRITE OUT-R FROM IN-R.' END", "=CASE WHEN k % 5 = 0 THEN '           OPEN I-O WITH NO REWIND BOTHF.' ELSE '           DISPLAY ' || chr(39) || 'OPEN I-O BOTHF' || chr(39) || '.' END", "           SORT SRTF.",
)
#: Every third k has a job: its program, then program k / 2, with relative generations, a concatenation over lines, a back reference, a temporary and a symbolic data set.
JOB = _lines(
    "=chr(47) || '/J' || k || ' JOB 1'", "//* EXEC PGM=NO", "=chr(47) || '/S1 EXEC PGM=P' || k || ',REGION=1M'", "=chr(47) || '/IND DD DSN=A.D' || (k % 50) || '(+1),DISP=SHR'", "=chr(47) || '/    DD DSN=B.D' || (k % 7) || ','", "//* note", "//     DISP=OLD", "=chr(47) || '/OUTD0 DD DSN=A.D' || ((k + 1) % 50) || '(0)'", "//UPD DD DSN=&&T,DISP=(NEW,PASS)", "//SYSIN DD *",
    "=chr(47) || '/S2 EXEC PGM=P' || (k DIV 2)", "//IND DD DSN=*.S1.OUTD0", "//UPD DD DSN=&HLQ..X", "//S3 EXEC PGM=IDCAMS", "//IND DD DSN=NOT.ME",
)


def corpus(spark, sf_dir):
    """Files (doc_id, path, text)."""
    k = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    sql = lambda s: F.expr(s.replace("chr(10)", "'\\n'"))
    programs = k.select((F.col("k") * 2).alias("doc_id"), F.expr("'g' || (k % 2) || '/p/P' || k || '.cbl'").alias("path"), sql(PROGRAM).alias("text"))
    return programs.unionByName(k.filter("k % 3 = 0").select((F.col("k") * 2 + 1).alias("doc_id"), F.expr("'g' || (k % 2) || '/j/J' || k || '.jcl'").alias("path"), sql(JOB).alias("text")))


SQL = """o AS (SELECT o_orderkey AS k FROM orders), j AS (SELECT k FROM o WHERE k % 3 = 0),
d AS (SELECT k, k AS p, 'IND' AS dd, 'A.D' || (k % 50) AS ds FROM j UNION ALL SELECT k, k, 'IND', 'B.D' || (k % 7) FROM j UNION ALL SELECT k, k, 'OUTD0', 'A.D' || ((k + 1) % 50) FROM j
  UNION ALL SELECT k, k, 'UPD', 'g' || (k % 2) || '/j/J' || k || '.jcl:&&T' FROM j UNION ALL SELECT k, k // 2, 'IND', 'A.D' || ((k + 1) % 50) FROM j WHERE (k // 2) % 2 = k % 2 AND k // 2 IN (SELECT k FROM o)),
b AS (SELECT p, dd, 'dataset|g' || (k % 2) || '|' || ds AS ds, k FROM d),
io AS (SELECT k AS p, 'IND' AS dd, 'r' AS m FROM o UNION ALL SELECT k, 'OUTD' || (k % 3), 'w' FROM o UNION ALL SELECT k, 'UPD', 'rw' FROM o WHERE k % 5 = 0),
f AS (SELECT DISTINCT 'program|g' || (p % 2) || '/p/P' || p || '.cbl|P' || p AS c, ds, m FROM io JOIN b USING (p, dd))"""


@query("dataset_flows", f"WITH {SQL} SELECT c AS src, ds AS dst, 'write_file' AS via FROM f WHERE contains(m, 'w') UNION ALL SELECT ds, c, 'read_file' FROM f WHERE contains(m, 'r')")
def dataset_flows(spark, sf_dir):  # J11
    return build.flows(build.resolve(corpus(spark, sf_dir)))[0].select("src", "dst", "via").distinct()


@query("unbound_datasets", f"WITH {SQL} SELECT 'g' || (p % 2) || '/p/P' || p || '.cbl' AS path, dd AS name, CASE WHEN m = 'r' THEN 'read_file' ELSE 'write_file' END AS via FROM io WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.p = io.p AND b.dd = io.dd)")
def unbound_datasets(spark, sf_dir):  # J11
    from heronry.operators import flow

    io, bindings = build.file_use(build.resolve(corpus(spark, sf_dir)))
    return flow.unbound(io, bindings).select("path", "name", "via")


@query("dataset_members", f"WITH {SQL} SELECT DISTINCT ds AS dataset, 'g' || (k % 2) || '/j/J' || k || '.jcl' AS path FROM b WHERE ds IN (SELECT ds FROM f)")
def dataset_members(spark, sf_dir):  # G16, J11
    return build.flows(build.resolve(corpus(spark, sf_dir)))[2]


#: Book c copies the next one of its five; the fifth of every second five copies the first again.
BOOK = _lines("=CASE WHEN c % 5 < 4 THEN '       COPY B' || (c + 1) || '.' WHEN c % 10 = 4 THEN '       COPY B' || (c - 4) || '.' ELSE '      * COPY NONE.' END", "       01 REC.", "=chr(32) || '        05 I' || c || ' PIC X.'", "=chr(32) || '        05 X' || (c % 3) || ' PIC X.'", "           88 YES VALUE 1.")
#: Program k copies one or two books and uses an item that is there or not, and one that several books may have.
USES = _lines(
    "=chr(32) || '      PROGRAM-ID. P' || k || '.'", "       DATA DIVISION.", "       WORKING-STORAGE SECTION.", "=chr(32) || '          COPY B' || (k % 200) || '.'", "=CASE WHEN k % 3 = 0 THEN '           COPY B' || ((k * 7) % 200) || '.' ELSE '           COPY NONE.' END", "       PROCEDURE DIVISION.",
    "=chr(32) || '          MOVE I' || ((k + k // 200 % 4) % 200) || chr(10) || '             TO X' || (k % 3) || '.'", "           DISPLAY \"I1 I2 I3\".",
)


def books(spark, sf_dir):
    """Files (doc_id, path, text)."""
    k = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    sql = lambda s: F.expr(s.replace("chr(10)", "'\\n'").replace("k // 200", "k DIV 200"))
    c = spark.range(200).select(F.col("id").alias("c"))
    return k.select("k", sql("'w/p/P' || k || '.cbl'").alias("path"), sql(USES).alias("text")).unionByName(c.select((-1 - F.col("c")).alias("k"), sql("'w/c/B' || c || '.cpy'").alias("path"), sql(BOOK).alias("text"))).withColumnRenamed("k", "doc_id")


BOOKS_SQL = """e(a, b) AS (SELECT c, CASE WHEN c % 5 < 4 THEN c + 1 ELSE c - 4 END FROM range(200) r(c) WHERE c % 5 < 4 OR c % 10 = 4),
o AS (SELECT o_orderkey AS k FROM orders), p(k, c) AS (SELECT k, k % 200 FROM o UNION SELECT k, (k * 7) % 200 FROM o WHERE k % 3 = 0),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), q AS (SELECT k, c FROM p UNION SELECT k, b FROM p JOIN r ON p.c = r.a),
i AS (SELECT c, 'I' || c AS name, 'item|w/c/B' || c || '.cpy|REC.I' || c AS cid FROM range(200) r(c) UNION ALL SELECT c, 'X' || (c % 3), 'item|w/c/B' || c || '.cpy|REC.X' || (c % 3) FROM range(200) r(c)),
n AS (SELECT k, 'I' || ((k + k // 200 % 4) % 200) AS name FROM o UNION ALL SELECT k, 'X' || (k % 3) FROM o),
h AS (SELECT k, name, count(DISTINCT cid) AS n, min(cid) AS cid FROM q JOIN i USING (c) JOIN n USING (k, name) GROUP BY ALL)"""


@query("item_uses", f"WITH RECURSIVE {BOOKS_SQL} SELECT cid AS src, 'program|w/p/P' || k || '.cbl|P' || k AS dst, CASE WHEN name[1] = 'I' THEN 7 ELSE 8 END::INT AS line FROM h WHERE n = 1")
def item_uses(spark, sf_dir):  # J12
    return build.flows(build.resolve(books(spark, sf_dir)))[0].filter("via = 'use'").select("src", "dst", "line")


@query("ambiguous_items", f"WITH RECURSIVE {BOOKS_SQL} SELECT 'w/p/P' || k || '.cbl' AS path, string_agg(name, ',' ORDER BY name) AS name, 'use_ambiguous' AS status FROM h WHERE n > 1 GROUP BY k")
def ambiguous_items(spark, sf_dir):  # J12
    return build.flows(build.resolve(books(spark, sf_dir)))[3].filter("status = 'use_ambiguous'").select("path", "name", "status")


@query("reached_pairs", """WITH RECURSIVE e AS (SELECT DISTINCT l_partkey % 400 AS src, l_suppkey % 100 * 4 + 1 AS dst FROM lineitem WHERE l_linenumber = 1), r(start, id) AS (SELECT src, dst FROM e UNION SELECT r.start, e.dst FROM r JOIN e ON e.src = r.id) SELECT * FROM r""")
def reached_pairs(spark, sf_dir):  # J12
    e = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select((F.col("l_partkey") % 400).alias("src"), (F.col("l_suppkey") % 100 * 4 + 1).alias("dst")).distinct()
    return graph.reach(e)
