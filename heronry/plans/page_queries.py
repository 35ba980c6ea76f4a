"""Queries over positioned text of pages, made of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.operators import pages
from heronry.plans.base import Registry
from heronry.session import table

query = Registry()
LONG = "'line of words that goes on and on to the end of the row, with some more of them, number '"
#: Pieces of two pages an order: (page, nth, x0, y0, text, size, when); a heading, a paragraph of one to three lines, one far below in two pieces a line, and a foot.
PIECES = (
    (1, 0, 40, 700, "'Part ' || k", 14, "true"), *[(1, 1 + i, 40, 680 - 12 * i, f"{LONG} || k || '.{i}'", 10, f"k % 3 >= {i}") for i in range(3)],
    *[(1, 10 + 2 * i + j, 40 + 200 * j, 500 - 12 * i, f"'piece {i}{j} of the words of ' || k", 10, "true") for i in (0, 1) for j in (0, 1)], (1, 30, 40, 12, "'page 1'", 8, "true"),
    (2, 0, 40, 700, f"{LONG} || k || ' again'", 10, "true"), (2, 1, 40, 688, f"{LONG} || k || ' more'", 10, "k % 2 = 0"), (2, 2, 40, 12, "'page 2'", 8, "true"),
)


def pieces(spark, sf_dir):
    k = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    every = F.array(*[F.when(F.expr(w), F.struct(F.lit(p).alias("page"), F.lit(n).alias("nth"), F.lit(float(x)).alias("x0"), F.lit(float(y)).alias("y0"), F.lit(x + 190.0).alias("x1"), F.lit(y + 10.0).alias("y1"), F.expr(t).alias("text"), F.lit(float(s)).alias("size"))) for p, n, x, y, t, s, w in PIECES])
    return k.select(F.col("k").alias("doc"), F.inline(F.array_compact(every)))


ROW = f"({LONG} || k || '"


@query("page_chunks", f"""WITH o AS (SELECT o_orderkey AS k FROM orders),
c AS (SELECT k, 1 AS page, 0 AS nth, 'heading' AS kind, 'Part ' || k || chr(10) || {ROW}.0') || CASE WHEN k % 3 >= 1 THEN chr(10) || {ROW}.1') ELSE '' END || CASE WHEN k % 3 >= 2 THEN chr(10) || {ROW}.2') ELSE '' END AS text, NULL AS heading FROM o
UNION ALL SELECT k, 1, 1, 'body', 'piece 00 of the words of ' || k || ' piece 01 of the words of ' || k || chr(10) || 'piece 10 of the words of ' || k || ' piece 11 of the words of ' || k, 'Part ' || k FROM o
UNION ALL SELECT k, 1, 2, 'margin', 'page 1', NULL FROM o UNION ALL SELECT k, 2, 0, 'body', {ROW} again') || CASE WHEN k % 2 = 0 THEN chr(10) || {ROW} more') ELSE '' END, 'Part ' || k FROM o UNION ALL SELECT k, 2, 1, 'margin', 'page 2', NULL FROM o)
SELECT k AS doc, page::INT AS page, nth::INT AS nth, kind, text, heading FROM c""")
def page_chunks(spark, sf_dir):  # M12
    p = pieces(spark, sf_dir)
    boxes = p.select("doc", "page").distinct().withColumns({"bottom": F.lit(0.0), "top": F.lit(800.0)})
    return pages.chunks(p, boxes).select("doc", "page", "nth", "kind", "text", "heading")
