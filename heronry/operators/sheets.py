"""Tables in sheets: regions of cells with their titles, headers and records, and the section of a readable text that holds a range."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.scalars import column_letters, column_number
from heronry.operators.code import by_document

#: Headings of sheets and ranges in readable texts, and how a place is written.
SHEET_HEADING, RANGE_HEADING = re.compile(r"^## シート「(.*)」\s*$"), re.compile(r"^### (\S.*?)\s*$")
RANGE = r"^\$?([A-Z]{1,3})\$?(\d{1,7})(?::\$?([A-Z]{1,3})\$?(\d{1,7}))?$"
#: Words of a key's header, the best first; what looks like an identifier, a number that is data, a year.
KEY_WORDS = ("id", "コード", "番号", "連番", "キー", "no", "ｎｏ")
ID = r"^(?=.*[A-Za-z])(?=.*\d)[A-Za-z0-9_.:/-]{3,}$"
NUMBER, YEAR = r"^[+-]?\d[\d,]*(\.\d+)?%?$", r"^(19|20)\d\d$"
#: Rows after the title that may be the header; length of a text that is no header; least confidence.
HEADER_ROWS, LONG, SURE = 5, 40, 0.55
#: Halvings of the rows of a sheet.
LEVELS = 21
REGION = ["doc", "sheet", "top", "left"]


def box(cell_range: Column) -> Column:
    """A1 or A1:C4 as a struct r1, c1, r2, c2; null if it is neither."""
    part = lambda i: F.regexp_extract(cell_range, RANGE, i)
    row, col = lambda i: part(i).try_cast("int"), lambda i: column_number(part(i))
    both = part(3) != ""
    found = F.struct(row(2).alias("r1"), col(1).alias("c1"), F.when(both, row(4)).otherwise(row(2)).alias("r2"), F.when(both, col(3)).otherwise(col(1)).alias("c2"))
    return F.when(cell_range.rlike(RANGE), found)


def range_name(r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    """The inverse."""
    one = lambda r, c: F.concat(column_letters(c), r.cast("string"))
    return F.when((r1 == r2) & (c1 == c2), one(r1, c1)).otherwise(F.concat(one(r1, c1), F.lit(":"), one(r2, c2)))


def _level(a: Column, b: Column) -> Column:
    """How often row numbers from 0 must be halved until both are equal."""
    return F.when(a == b, 0).otherwise(F.length(F.bin(a.bitwiseXOR(b))))


def _sections(text: str):
    sheet = heading = None
    body: list[str] = []
    for line in [*text.split("\n"), "## "]:
        if line.startswith(("## ", "### ")):
            if heading is not None and "".join(body).strip():
                yield sheet, heading, f"### {heading}\n\n" + "\n".join(body).strip()
            heading, body = None, []
            if line.startswith("## "):
                m = SHEET_HEADING.match(line)
                sheet = m[1] if m else None
            elif sheet is not None and (m := RANGE_HEADING.match(line)):
                heading = m[1]
        elif heading is not None:
            body.append(line)


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, sheet, cell_range, text) of readable texts: what stands below the heading of a range on a sheet's part; empty ones have none."""
    return by_document(docs, _sections, "sheet string, cell_range string, text string")


def _smallest(places: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc, sheet, box, section_id) of distinct places (doc, sheet, box) in sections (section_id, doc, sheet, box): the smallest that holds all of the place.

    Rows are halved again and again; a section stands at the one interval that just holds its rows, and a place asks at
    all intervals above its own. So neither side grows with the height of a range, and no place meets the sections beside
    it. Of sections of one box only the first is met.
    """
    bits = lambda d: (d.withColumn("b", F.col("box")).filter("box IS NOT NULL").withColumn("lo", F.col("b.r1") - 1).withColumn("own", _level(F.col("b.r1") - 1, F.col("b.r2") - 1)))
    first = parts.filter("box IS NOT NULL").groupBy("doc", "sheet", "box").agg(F.min("section_id").alias("section_id"))
    s = bits(first).select("doc", "sheet", F.col("own").alias("level"), F.expr("shiftright(lo, own)").alias("at"), "section_id", F.col("b").alias("s"))
    c = bits(places).select("doc", "sheet", "b", "lo", F.explode(F.sequence("own", F.lit(LEVELS))).alias("level")).withColumn("at", F.expr("shiftright(lo, level)"))
    inside = (F.col("s.r1") <= F.col("b.r1")) & (F.col("s.r2") >= F.col("b.r2")) & (F.col("s.c1") <= F.col("b.c1")) & (F.col("s.c2") >= F.col("b.c2"))
    area = (F.col("s.r2") - F.col("s.r1") + 1).cast("long") * (F.col("s.c2") - F.col("s.c1") + 1)
    met = c.join(s.hint("merge"), ["doc", "sheet", "level", "at"]).filter(inside)
    return met.groupBy("doc", "sheet", F.col("b").alias("box")).agg(F.min(F.struct(area.alias("area"), "s.r1", "s.c1", "section_id"))["section_id"].alias("section_id"))


def enclosing(chunks: DataFrame, parts: DataFrame) -> DataFrame:
    """(chunk_id, section_id) of chunks (chunk_id, doc, sheet, box) in sections (section_id, doc, sheet, box): the smallest that holds all of the chunk."""
    best = _smallest(chunks.select("doc", "sheet", "box").distinct(), parts)
    return chunks.join(best.hint("merge"), ["doc", "sheet", "box"]).select("chunk_id", "section_id")


def excerpts(chunks: DataFrame, parts: DataFrame) -> DataFrame:
    """(chunk_id, quote, source, hint) for chunks (chunk_id, doc, sheet, cell_range, quote): the text of the enclosing section, else the chunk's own.

    source is human_md or rag; the hint names sheet and range, those of the section if there is one. Sections are looked
    up once for each place; chunks meet only the answers.
    """
    p = parts.withColumn("box", box(F.col("cell_range")))
    places = chunks.select("doc", "sheet", "cell_range").distinct().withColumn("box", box(F.col("cell_range")))
    best = _smallest(places.select("doc", "sheet", "box").distinct(), p.select("section_id", "doc", "sheet", "box"))
    text = p.select("section_id", F.col("text").alias("found"), F.col("cell_range").alias("at"))
    known = places.join(best.hint("merge"), ["doc", "sheet", "box"]).join(text, "section_id").select("doc", "sheet", "cell_range", "found", "at")
    both = chunks.join(known.hint("merge"), ["doc", "sheet", "cell_range"], "left")
    hint = F.concat(F.lit("シート「"), "sheet", F.lit("」"), F.coalesce("at", "cell_range", F.lit("")))
    return both.select("chunk_id", F.coalesce("found", "quote").alias("quote"), F.when(F.col("found").isNotNull(), "human_md").otherwise("rag").alias("source"), hint.alias("hint"))


def _islands(cells: DataFrame, by: list[str], at: str, span: str, name: str) -> DataFrame:
    """``cells`` with ``name``, the first of the row or column numbers that follow each other without a gap around the cell.

    One window in order, so no second table of what is taken is made; cells without a place go.
    """
    w = Window.partitionBy(*by).orderBy(at)
    upto = F.max(F.col(at) + F.col(span) - 1).over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = F.when(upto.isNull() | (F.col(at) > upto + 1), F.col(at))
    rows = cells.dropna(subset=[*by, at]).withColumn("first", first)
    return rows.withColumn(name, F.last("first", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("first")


def regions(cells: DataFrame) -> DataFrame:
    """Cells (doc, sheet, row, col, value, row_span, col_span) that hold text, with the region they are in: top and left.

    Regions are parted by empty rows, then by empty columns, then by rows again; merged cells reach over what they cover.
    """
    c = cells.filter(F.trim(F.coalesce("value", F.lit(""))) != "").withColumn("value", F.trim("value"))
    for s in ("row_span", "col_span"):
        c = c.withColumn(s, F.greatest(F.coalesce(s, F.lit(1)), F.lit(1)))
    c = _islands(c, ["doc", "sheet"], "row", "row_span", "a")
    c = _islands(c, ["doc", "sheet", "a"], "col", "col_span", "left")
    return _islands(c, ["doc", "sheet", "a", "left"], "row", "row_span", "top").drop("a")


def headers(cells: DataFrame) -> DataFrame:
    """One row a region of ``regions``: bounds, title_row, title, header_row, confidence (0 without header).

    The title is a first row with one cell in a region of several columns. The header is one of the rows after it: no
    tall cells, no long texts or sentences, text below it; the fullest, then the densest with most words, then the upper one. If a row of
    numbers was taken, the rows of words above it are the header, the last of them in force.
    """
    odd = (F.length("value") > LONG) | F.col("value").rlike("[。！？]$") | F.contains("value", F.lit("\n"))
    number = F.col("value").rlike(NUMBER) & ~F.col("value").rlike(YEAR)
    rows = cells.groupBy(*REGION, "row").agg(
        F.count(F.lit(1)).alias("n"), F.sum((~F.col("value").rlike(NUMBER)).cast("int")).alias("words"), F.max(F.col("row_span") > 1).alias("tall"), F.max(odd).alias("odd"), F.max(number).alias("number"),
        F.min("value").alias("one"), F.max(F.col("row") + F.col("row_span") - 1).alias("end"), F.max(F.col("col") + F.col("col_span") - 1).alias("right"),
    )
    w = Window.partitionBy(*REGION)
    rows = rows.withColumn("bottom", F.max("end").over(w)).withColumn("last", F.max("row").over(w)).withColumn("right", F.max("right").over(w))
    rows = rows.withColumn("width", F.col("right") - F.col("left") + 1)
    title = F.max(F.when((F.col("row") == F.col("top")) & (F.col("n") == 1) & (F.col("width") > 1) & (F.col("last") > F.col("top")), F.struct("row", "one"))).over(w)
    rows = rows.withColumn("t", title).withColumn("start", F.coalesce(F.col("t.row") + 1, F.col("top")))
    near = (F.col("row") >= F.col("start")) & (F.col("row") <= F.least(F.col("bottom") - 1, F.col("start") + HEADER_ROWS - 1))
    score = F.col("n") / F.col("width") * 0.75 + F.col("words") / F.col("n") * 0.25
    full = F.col("n") >= F.least(F.lit(2), F.col("width"))
    may = near & ~F.col("tall") & ~F.col("odd") & (F.col("row") < F.col("last")) & full
    rows = rows.withColumn("score", score).withColumn("chosen", (-F.max(F.when(may, F.struct("n", "score", (-F.col("row")).alias("up")))).over(w)["up"]))
    upto = (F.col("row") >= F.col("start")) & (F.col("row") <= F.col("chosen"))
    rows = rows.withColumn("data", F.min(F.when(upto & F.col("number"), F.col("row"))).over(w))
    band = (F.col("row") >= F.col("start")) & (F.col("row") < F.col("data"))
    good = (F.col("data") > F.col("start")) & ~F.coalesce(F.max(F.when(band, F.col("odd"))).over(w), F.lit(False)) & F.coalesce(F.max(F.when(band & (F.col("row") == F.col("data") - 1), full)).over(w), F.lit(False))
    rows = rows.withColumn("header", F.when(good, F.col("data") - 1).otherwise(F.col("chosen")))
    sure = F.round(F.least(F.lit(1.0), F.col("score") * F.when(F.col("n") >= 2, 1.0).otherwise(0.7)), 3)
    at = rows.groupBy(*REGION, "bottom", "right").agg(F.first("t").alias("t"), F.max(F.when(F.col("row") == F.col("header"), F.struct("row", sure.alias("sure")))).alias("h"))
    known = F.coalesce(F.col("h.sure") >= SURE, F.lit(False))
    return at.select(*REGION, "bottom", "right", F.col("t.row").alias("title_row"), F.col("t.one").alias("title"), F.when(known, F.col("h.row")).alias("header_row"), F.when(known, F.col("h.sure")).otherwise(0.0).alias("confidence"))


def labels(cells: DataFrame, found: DataFrame) -> DataFrame:
    """(region, col, label): a column's header, below wider ones between it and the title."""
    heads = found.filter("header_row IS NOT NULL").select(*REGION, "title_row", "header_row")
    c = cells.join(heads.hint("merge"), REGION).filter(F.col("row") <= F.col("header_row"))
    direct = (F.col("row") + F.col("row_span") > F.col("header_row")) & (F.col("row") > F.coalesce("title_row", F.lit(0)))
    wide = (F.col("row") > F.col("title_row")) & (F.col("row") < F.col("header_row")) & (F.col("col_span") > 1)
    each = c.filter(direct | wide).select(*REGION, "row", "value", F.col("col").alias("owner"), F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)).alias("col"))
    each = each.groupBy(*REGION, "col", "row").agg(F.min(F.struct("owner", "value"))["value"].alias("value"))
    path = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("row", "value"))), lambda x: x["value"]))  # HEADER_ROWS at most
    return each.groupBy(*REGION, "col").agg(F.array_join(path, " > ").alias("label"))


def records(cells: DataFrame, found: DataFrame) -> DataFrame:
    """(region, row, keys): rows below a header with at most two keys (label, value), the best by the words of their header and the look of their value."""
    heads = found.filter("header_row IS NOT NULL").select(*REGION, "header_row")
    c = cells.join(heads.hint("merge"), REGION).filter(F.col("row") > F.col("header_row")).join(labels(cells, found).hint("merge"), [*REGION, "col"], "left")
    label = F.coalesce("label", F.lit(""))
    words = F.greatest(*[F.when(F.contains(F.lower(label), F.lit(w)), 100 - 10 * k).otherwise(0) for k, w in enumerate(KEY_WORDS)])
    score = words + F.when(F.col("value").rlike(ID), 60).otherwise(0)
    c = c.select(*REGION, "row", "col", "value", F.when(label == "", "識別子").otherwise(label).alias("label"), score.alias("score"))
    # of equal values the best one
    best = c.filter("score > 0").groupBy(*REGION, "row", "value").agg(F.max(F.struct("score", (-F.col("col")).alias("left_most"), "label")).alias("k"))
    nth = F.row_number().over(Window.partitionBy(*REGION, "row").orderBy(F.desc("k")))
    two = best.withColumn("nth", nth).filter("nth <= 2").groupBy(*REGION, "row").agg(F.array_sort(F.collect_list(F.struct("nth", "k.label", "value"))).alias("keys"))
    keys = F.transform("keys", lambda k: F.concat(k["label"], F.lit("="), k["value"]))
    return c.select(*REGION, "row").distinct().join(two.hint("merge"), [*REGION, "row"], "left").select(*REGION, "row", F.coalesce(keys, F.array().cast("array<string>")).alias("keys"))
