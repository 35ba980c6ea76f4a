"""Chunks of a document by the anchors of its text and the rows of its evidence; one fault withdraws all of them.

Rows (doc, line, raw) are the lines of a document's evidence as bytes, texts (doc, raw, state) its text with one anchor
line a chunk. Rules are columns of a row; the fault of a document is that of its text, else of its first row with one, else an anchor
that no row names. A document with a fault has no chunks, only the reason; it can then be cut by lines. Blank rows
are skipped; a document with rows but no text, and one with a null text, lacks its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a row and of a text, rows of a document and characters of a chunk at most; how an anchor is written.
ROW_BYTES, TEXT_BYTES, ROWS, CHARS = 1 << 20, 256 << 20, 200_000, 20_000
ANCHOR = r"(?m)^<!-- chunk:(\S+) -->\r?\n"


def _first(rules: list[tuple]):
    """The name of the first rule that holds."""
    at = F.lit(None).cast("string")
    for when, name in reversed(rules):
        at = F.when(F.coalesce(when, F.lit(False)), F.lit(name)).otherwise(at)
    return at


def bodies(texts: DataFrame, most: int = TEXT_BYTES) -> DataFrame:
    """(doc, fault, anchors, parts) of texts: a fault of the text itself, or its anchors with what stands below each, trimmed."""
    plain = F.try_validate_utf8(F.col("raw").cast("string"))
    t = texts.select("doc", "state", F.octet_length("raw").alias("size"), F.col("raw").isNull().alias("none"), plain.alias("text"))
    t = t.withColumn("anchors", F.when(F.col("size") <= most, F.regexp_extract_all("text", F.lit(ANCHOR), 1)))
    fault = _first([
        (F.col("state") == "stat_failed", "rag_md_stat_failed"), (F.col("state") == "read_failed", "rag_md_read_failed"), (F.col("none"), "rag_md_missing"), (F.col("size") > most, "rag_md_too_large"),
        (F.col("text").isNull(), "rag_md_invalid_utf8"), (F.size("anchors") == 0, "rag_md_no_anchors"), (F.size(F.array_distinct("anchors")) < F.size("anchors"), "rag_md_duplicate_anchor"),
    ])
    parts = F.transform(F.slice(F.split("text", ANCHOR), 2, 1 << 30), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return t.select("doc", fault.alias("fault"), "anchors", parts.alias("parts"))


def judged(rows: DataFrame, texts: DataFrame, row_bytes: int = ROW_BYTES, text_bytes: int = TEXT_BYTES, most: int = ROWS, chars: int = CHARS) -> tuple[DataFrame, DataFrame]:
    """(doc, chunk_id, body, line) of documents without fault, and (doc, reason) of all others.

    Rows meet the anchors by chunk id, so neither a document's rows nor its chunks come together in one row.
    """
    text = bodies(texts, text_bytes)
    anchors = text.filter("fault IS NULL").select("doc", F.inline(F.arrays_zip(F.col("anchors").alias("chunk_id"), F.col("parts").alias("body"))))
    plain = F.try_validate_utf8(F.col("raw").cast("string"))
    r = rows.select("doc", "line", F.octet_length("raw").alias("size"), F.trim(plain).alias("row"), F.col("raw").isNull().alias("none")).filter("NOT none AND (row IS NULL OR row <> '')")
    value = F.try_parse_json("row")
    of = lambda name: F.try_variant_get(F.col("v"), f"$.{name}", "string")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(F.col("v"), path, "variant"))
    r = r.withColumn("v", value).withColumn("chunk_id", F.when(kind("$.chunk_id") == "STRING", of("chunk_id")))
    nth = F.row_number().over(Window.partitionBy("doc", "chunk_id").orderBy("line"))
    r = r.withColumn("nth", nth).join(anchors, ["doc", "chunk_id"], "left")
    rule = _first([
        (F.col("line") > most, "too_many_rows"), (F.col("size") > row_bytes, "line_too_large"), (F.col("row").isNull(), "invalid_utf8"), (F.col("v").isNull(), "invalid_json"), (~F.startswith(kind("$"), F.lit("OBJECT")), "row_not_object"),
        (F.coalesce("chunk_id", F.lit("")) == "", "missing_chunk_id"), (~of("source_rel_path").eqNullSafe(F.col("doc").cast("string")), "source_rel_path_mismatch"), (F.col("nth") > 1, "duplicate_chunk_id"),
        (F.coalesce("body", F.lit("")) == "", "rag_md_anchor_missing"), (F.length("body") > chars, "search_text_too_long"),
    ])
    r = r.select("doc", "line", "chunk_id", "body", rule.alias("rule"))
    worst = r.filter("rule IS NOT NULL").groupBy("doc").agg(F.min(F.struct("line", "rule"))["rule"].alias("row_fault"))
    named = r.filter("rule IS NULL").select("doc", "chunk_id")
    extra = anchors.join(named, ["doc", "chunk_id"], "left_anti").select("doc").distinct().withColumn("surplus", F.lit("rag_md_anchor_surplus"))
    docs = rows.select("doc").union(texts.select("doc")).distinct().join(text.select("doc", "fault", F.lit(True).alias("there")), "doc", "left")
    reason = F.coalesce("fault", F.when(F.col("there").isNull(), F.lit("rag_md_missing")), "row_fault", "surplus")
    state = docs.join(worst, "doc", "left").join(extra, "doc", "left").select("doc", reason.alias("reason"))
    good = r.join(state.filter("reason IS NULL").select("doc"), "doc", "left_semi").select("doc", "chunk_id", "body", "line")
    return good, state.filter("reason IS NOT NULL")
