"""Queries of chunks by anchors; evidence and texts with every fault, made of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.operators import anchored
from heronry.plans.base import Registry
from heronry.session import table

query = Registry()
#: Faults in turn; the first two have none.
REASONS = (
    None, None, "rag_md_missing", "rag_md_no_anchors", "rag_md_duplicate_anchor", "rag_md_anchor_missing", "rag_md_anchor_surplus", "invalid_utf8", "invalid_json", "row_not_object", "missing_chunk_id", "source_rel_path_mismatch", "duplicate_chunk_id",
    "line_too_large", "too_many_rows", "search_text_too_long", "rag_md_too_large", "rag_md_stat_failed", "rag_md_invalid_utf8", "rag_md_read_failed",
)
#: Limits that the small texts here can pass.
LIMITS = {"row_bytes": 300, "text_bytes": 700, "most": 5, "chars": 100}


def inputs(spark, sf_dir):
    """Rows (doc, line, raw) and texts (doc, raw, state); a document of class 1 has a blank row and three chunks, others two."""
    d = table(spark, sf_dir, "orders").select(F.concat(F.lit("d"), "o_orderkey").alias("doc"), (F.col("o_orderkey") % len(REASONS)).cast("int").alias("f"))
    is_ = lambda name: F.col("f") == REASONS.index(name)
    row = lambda chunk, more="": F.concat(F.lit('{"chunk_id": "'), F.lit(chunk), F.lit('", "source_rel_path": "'), "doc", F.lit(f'"{more}}}'))
    second = (
        F.when(is_("invalid_json"), F.lit('{"chunk_id": ')).when(is_("row_not_object"), F.lit("[1, 2]")).when(is_("missing_chunk_id"), F.lit('{"chunk_id": 7}')).when(is_("source_rel_path_mismatch"), F.lit('{"chunk_id": "c2", "source_rel_path": "other"}'))
        .when(is_("duplicate_chunk_id"), row("c1")).when(is_("line_too_large"), row("c2", ', "x": "' + "y" * 300 + '"')).when(is_("rag_md_anchor_missing"), row("c9")).when(is_("rag_md_anchor_surplus"), F.lit(" ")).otherwise(row("c2"))
    )
    lines = F.array(row("c1"), second, F.when(F.col("f") == 1, row("c3")), F.when(F.col("f") == 1, F.lit("  ")))
    rows = d.select("doc", "f", F.posexplode(lines).alias("line", "t")).filter("t IS NOT NULL")
    broken = F.when((F.col("f") == REASONS.index("invalid_utf8")) & (F.col("line") == 1), F.unhex(F.lit("7BFF7D"))).otherwise(F.encode("t", "UTF-8"))
    number = F.when((F.col("f") == REASONS.index("too_many_rows")) & (F.col("line") == 1), 6).otherwise(F.col("line") + 1)
    part = lambda c, body: F.concat(F.lit(f"<!-- chunk:{c} -->\n"), body, F.lit("\n\n"))
    text = F.concat(
        F.concat(F.lit("# "), "doc", F.lit("\n")), part("c1", F.concat(F.lit("body of "), "doc")), F.when(is_("rag_md_duplicate_anchor"), part("c1", F.lit("again"))).otherwise(F.lit("")),
        part("c2", F.when(is_("search_text_too_long"), F.repeat(F.lit("z"), 101)).when(is_("rag_md_too_large"), F.repeat(F.lit("z "), 400)).otherwise(F.lit("two\nlines"))), F.when(F.col("f") == 1, part("c3", F.lit("third"))).otherwise(F.lit("")),
    )
    raw = F.when(is_("rag_md_no_anchors"), F.encode(F.lit("# no anchors"), "UTF-8")).when(is_("rag_md_invalid_utf8"), F.unhex(F.lit("FF3C"))).otherwise(F.encode(text, "UTF-8"))
    state = F.when(is_("rag_md_stat_failed"), "stat_failed").when(is_("rag_md_read_failed"), "read_failed").otherwise("ok")
    return rows.select("doc", number.alias("line"), broken.alias("raw")), d.filter(~is_("rag_md_missing")).select("doc", raw.alias("raw"), state.alias("state"))


CASES = " ".join(f"WHEN {k} THEN '{r}'" for k, r in enumerate(REASONS) if r)


@query("withdrawn_chunks", f"SELECT 'd' || o_orderkey AS doc, CASE o_orderkey % {len(REASONS)} {CASES} END AS reason FROM orders WHERE o_orderkey % {len(REASONS)} > 1")
def withdrawn_chunks(spark, sf_dir):  # X15
    return anchored.judged(*inputs(spark, sf_dir), **LIMITS)[1]


@query("anchored_chunks", f"SELECT 'd' || o_orderkey AS doc, x.c AS chunk_id, CASE x.c WHEN 'c1' THEN 'body of d' || o_orderkey WHEN 'c2' THEN 'two' || chr(10) || 'lines' ELSE 'third' END AS body, x.l::INT AS line FROM orders, (SELECT unnest(['c1', 'c2', 'c3']) AS c, unnest([1, 2, 3]) AS l) x WHERE o_orderkey % {len(REASONS)} = 1 OR (o_orderkey % {len(REASONS)} = 0 AND x.l < 3)")
def anchored_chunks(spark, sf_dir):  # X15
    return anchored.judged(*inputs(spark, sf_dir), **LIMITS)[0]
