"""Queries over cells and ranges of sheets, made of suppliers, parts and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.operators import identifiers, sheets
from heronry.plans.base import Registry
from heronry.session import table

query = Registry()
PLACE = "chr((64 + {c})::INT) || {r}"
#: Sections of different sizes on the sheets of a document, chunks within them or not.
SECTION_SQL = "SELECT p_partkey AS section_id, p_partkey % 40 AS doc, 'S' || (p_partkey % 3) AS sheet, (p_partkey * 37) % 900 + 1 AS r1, p_partkey % 9 + 1 AS c1, (p_partkey * 37) % 900 + 1 + (p_partkey * 13) % 300 AS r2, p_partkey % 9 + 1 + p_partkey % 7 AS c2 FROM part"
CHUNK_SQL = "SELECT o_orderkey AS chunk_id, o_orderkey % 41 AS doc, 'S' || (o_orderkey % 3) AS sheet, (o_orderkey * 11) % 1200 + 1 AS r1, o_orderkey % 12 + 1 AS c1, (o_orderkey * 11) % 1200 + 1 + o_orderkey % 4 AS r2, o_orderkey % 12 + 1 + o_orderkey % 2 AS c2 FROM orders"


def _named(spark, sf_dir, source, sql):
    t = table(spark, sf_dir, source)
    cut = sql[len("SELECT ") : sql.rindex(" FROM ")].replace("||", "||")
    return t.selectExpr(*cut.split(", ")).withColumn("cell_range", F.when((F.col("r1") == F.col("r2")) & (F.col("c1") == F.col("c2")), F.expr("chr(64 + c1) || r1")).otherwise(F.expr("chr(64 + c1) || r1 || ':' || chr(64 + c2) || r2")))


NAME = "CASE WHEN {0}.r1 = {0}.r2 AND {0}.c1 = {0}.c2 THEN chr((64 + {0}.c1)::INT) || {0}.r1 ELSE chr((64 + {0}.c1)::INT) || {0}.r1 || ':' || chr((64 + {0}.c2)::INT) || {0}.r2 END"


@query("display_excerpts", f"""WITH s AS ({SECTION_SQL}), c AS ({CHUNK_SQL}),
m AS (SELECT c.chunk_id, arg_min(s.section_id, ((s.r2 - s.r1 + 1) * (s.c2 - s.c1 + 1), s.r1, s.c1, s.section_id)) AS section_id FROM c JOIN s ON s.doc = c.doc AND s.sheet = c.sheet AND c.r1 BETWEEN s.r1 AND s.r2 AND c.r2 BETWEEN s.r1 AND s.r2 AND c.c1 BETWEEN s.c1 AND s.c2 AND c.c2 BETWEEN s.c1 AND s.c2 GROUP BY c.chunk_id)
SELECT c.chunk_id, CASE WHEN s.section_id IS NULL THEN 'quote ' || c.chunk_id ELSE 'section ' || s.section_id END AS quote, CASE WHEN s.section_id IS NULL THEN 'rag' ELSE 'human_md' END AS source, 'シート「' || c.sheet || '」' || CASE WHEN s.section_id IS NULL THEN {NAME.format('c')} ELSE {NAME.format('s')} END AS hint
FROM c LEFT JOIN m USING (chunk_id) LEFT JOIN s ON s.section_id = m.section_id""")
def display_excerpts(spark, sf_dir):  # X20
    parts = _named(spark, sf_dir, "part", SECTION_SQL).withColumn("text", F.concat(F.lit("section "), "section_id"))
    chunks = _named(spark, sf_dir, "orders", CHUNK_SQL).withColumn("quote", F.concat(F.lit("quote "), "chunk_id"))
    return sheets.excerpts(chunks.select("chunk_id", "doc", "sheet", "cell_range", "quote"), parts.select("section_id", "doc", "sheet", "cell_range", "text"))


#: A readable text with a sheet's sections, one of them empty and one without a sheet.
MD = "'### A1:B2' || chr(10) || 'no sheet' || chr(10) || '## シート「T' || (doc_id % 3) || '」' || chr(10) || '### A1:C' || (doc_id % 9 + 2) || chr(10) || chr(10) || '| a |' || chr(10) || source || chr(10) || '### D1' || chr(10) || ' ' || chr(10) || '### E' || doc_id || ' ' || chr(10) || lang || chr(10) || '## other' || chr(10) || '### A1' || chr(10) || 'x'"


@query("readable_sections", "SELECT doc_id, 'T' || (doc_id % 3) AS sheet, 'A1:C' || (doc_id % 9 + 2) AS cell_range, '### A1:C' || (doc_id % 9 + 2) || chr(10) || chr(10) || '| a |' || chr(10) || source AS text FROM documents UNION ALL SELECT doc_id, 'T' || (doc_id % 3), 'E' || doc_id, '### E' || doc_id || chr(10) || chr(10) || lang FROM documents")
def readable_sections(spark, sf_dir):  # X20
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(MD.replace("chr(10)", "'\\n'")).alias("text"))
    return sheets.sections(d)


#: One table a customer k, in one of five shapes, six rows and a blank one below each other: (shape, row, col, value, row_span, col_span).
SHAPES = (
    # a title, a header, three rows
    (0, 0, 0, "'List ' || k", 1, 1), (0, 1, 0, "'Item ID'", 1, 1), (0, 1, 1, "'Name'", 1, 1), (0, 1, 2, "'Count'", 1, 1), *[x for r in (2, 3, 4) for x in ((0, r, 0, f"'AB-' || k || '{r}'", 1, 1), (0, r, 1, "'name'", 1, 1), (0, r, 2, "'' || k", 1, 1))],
    # a header at once, with a column that has no text in it
    (1, 0, 0, "'番号'", 1, 1), (1, 0, 1, "'Text'", 1, 1), *[x for r in (1, 2) for x in ((1, r, 0, f"'{r}'", 1, 1), (1, r, 1, "'words of ' || k", 1, 1))],
    # numbers only
    *[(2, r, c, f"'' || (k + {r} * {c})", 1, 1) for r in (0, 1, 2) for c in (0, 1)],
    # a title, wide labels over two columns each, a header below them
    (3, 0, 0, "'Plan ' || k", 1, 1), (3, 1, 0, "'Left'", 1, 2), (3, 1, 2, "'Right'", 1, 2), (3, 2, 0, "'Code'", 1, 1), (3, 2, 1, "'A'", 1, 1), (3, 2, 2, "'B'", 1, 1), (3, 2, 3, "'no'", 1, 1), (3, 3, 0, "'X' || k", 1, 1), (3, 3, 1, "'7'", 1, 1), (3, 3, 2, "'8'", 1, 1), (3, 3, 3, "'n' || k", 1, 1),
    # a label beside two rows of sentences
    (4, 0, 0, "'Note'", 2, 1), (4, 0, 1, "'これは文です。'", 1, 1), (4, 1, 1, "'もう一つ。'", 1, 1),
)


def cells(spark, sf_dir):
    """Cells (doc, sheet, row, col, value, row_span, col_span)."""
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    every = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(r).alias("r"), F.lit(c).alias("c"), F.expr(v).alias("value"), F.lit(a).alias("row_span"), F.lit(b).alias("col_span")) for s, r, c, v, a, b in SHAPES])
    rows = k.select("k", F.inline(F.filter(every, lambda x: x["s"] == F.col("k") % 5)))
    return rows.select((F.col("k") % 30).alias("doc"), F.lit("S").alias("sheet"), (F.floor(F.col("k") / 30) * 7 + 1 + F.col("r")).cast("int").alias("row"), (F.col("k") % 4 + 1 + F.col("c")).cast("int").alias("col"), "value", "row_span", "col_span")


AT = "k % 30 AS doc, 'S' AS sheet, (k // 30 * 7 + 1)::INT AS top, (k % 4 + 1)::INT AS \"left\""
K = "(SELECT c_custkey AS k FROM customer)"


@query("table_headers", f"""SELECT {AT}, CASE WHEN k % 5 IN (0, 3) THEN (k // 30 * 7 + 1)::INT END AS title_row, CASE k % 5 WHEN 0 THEN 'List ' || k WHEN 3 THEN 'Plan ' || k END AS title,
(k // 30 * 7 + 1 + CASE k % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 2 END)::INT AS header_row, CASE k % 5 WHEN 2 THEN 0.75 WHEN 4 THEN 0 ELSE 1 END::DOUBLE AS confidence FROM {K}""")
def table_headers(spark, sf_dir):  # M10
    return sheets.headers(sheets.regions(cells(spark, sf_dir))).select("doc", "sheet", "top", "left", "title_row", "title", "header_row", "confidence")


@query("table_records", f"""WITH r AS (SELECT {AT}, k, (k // 30 * 7 + 1)::INT AS t, unnest(CASE k % 5 WHEN 0 THEN [2, 3, 4] WHEN 1 THEN [1, 2] WHEN 2 THEN [1, 2] WHEN 3 THEN [3] ELSE [] END) AS r FROM {K})
SELECT doc, sheet, top, "left", (t + r)::INT AS "row", CASE k % 5 WHEN 0 THEN ['Item ID=AB-' || k || r] WHEN 1 THEN ['番号=' || r] WHEN 2 THEN [] ELSE ['Right > no=n' || k] || CASE WHEN len('X' || k) >= 3 THEN ['Left > Code=X' || k] ELSE [] END END AS keys FROM r""")
def table_records(spark, sf_dir):  # M10
    c = sheets.regions(cells(spark, sf_dir))
    return sheets.records(c, sheets.headers(c))


#: A text with identifiers in both widths, a list of references and words that are none, under one of four headers.
TEXT = "'see ＡＢ－' || k || ' and plain words, 参照先: X_' || k || ', Y-' || (k % 9) || ' then Z' || k || '/Q1'"
LABEL = "CASE k % 4 WHEN 0 THEN '画面ID' WHEN 1 THEN '呼出先' WHEN 2 THEN '' ELSE 'Table > 項目 ＩＤ' END"


@query("identifier_mentions", f"""WITH b AS (SELECT c_custkey AS k, {LABEL.replace('k %', 'c_custkey %')} AS label, c_custkey % 3 = 0 AS is_key FROM customer),
m AS (SELECT *, unnest([{{'start': 4, 'value': 'ＡＢ－' || k, 'normalized': 'ab-' || k, 'how': 'plain'}}, {{'start': 30 + len(k::VARCHAR), 'value': 'X_' || k, 'normalized': 'x_' || k, 'how': 'list'}}, {{'start': 34 + 2 * len(k::VARCHAR), 'value': 'Y-' || (k % 9), 'normalized': 'y-' || (k % 9), 'how': 'list'}}, {{'start': 43 + 2 * len(k::VARCHAR), 'value': 'Z' || k || '/Q1', 'normalized': 'z' || k || '/q1', 'how': 'slash'}}]) AS x FROM b)
SELECT k, x.start::INT AS "start", (x.start + len(x.value))::INT AS "end", x.value AS value, x.normalized AS normalized, CASE WHEN x.how = 'slash' THEN 'unclassified' WHEN k % 4 = 1 OR x.how = 'list' THEN 'reference' WHEN k % 4 IN (0, 3) AND is_key THEN 'record_identity' ELSE 'unclassified' END AS role FROM m""")
def identifier_mentions(spark, sf_dir):  # M11
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    rows = k.select("k", F.expr(TEXT).alias("value"), F.expr(LABEL).alias("label"), (F.col("k") % 3 == 0).alias("is_key"))
    return identifiers.mentions(rows).select("k", F.inline("mentions")).drop("basis")
