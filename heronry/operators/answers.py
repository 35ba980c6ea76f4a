"""What an answer shows of its hits: excerpts, marks, labels, ranges, and impact presumed from text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.scalars import clip_bytes, code_name, column_letters, column_number, top_folder


def clipped_hits(docs: DataFrame, needle: str, most: int, around: int = 3) -> DataFrame:
    """Per line that holds the literal: line and shown text of at most ``most`` bytes.

    A text within the bound is shown whole. Of others the lines ``around`` the hit stay, and marks
    say which lines are left out, so that they never look like one passage.
    """
    row = docs.filter(F.contains("text", F.lit(needle))).select("doc_id", "text", F.split("text", "\n").alias("every"))
    hits = F.filter(F.transform("every", lambda x, i: F.when(F.contains(x, F.lit(needle)), i + 1)), lambda i: i.isNotNull())
    at = row.select("doc_id", "every", F.when(F.octet_length("text") <= most, F.col("text")).alias("whole"), F.explode(hits).alias("line"))
    first, last, n = F.greatest(F.col("line") - around, F.lit(1)), F.least(F.col("line") + around, F.size("every")), F.size("every")
    # fixed values: marks of one line, of several and of the rest
    several = F.when(first > 2, F.concat(F.lit("〜"), (first - 1).cast("string"))).otherwise("")
    before = F.when(first > 1, F.concat(F.lit("⋯（1"), several, F.lit("行目を省略）⋯\n"))).otherwise("")
    after = F.when(last < n, F.concat(F.lit("\n⋯（"), (last + 1).cast("string"), F.lit("行目以降を省略）⋯"))).otherwise("")
    near = F.concat(before, clip_bytes(F.array_join(F.slice("every", first, last - first + 1), "\n"), most - 128), after)
    return at.select("doc_id", "line", F.coalesce("whole", near).alias("shown"))


def marked(hits: DataFrame, docs: DataFrame, terms: list[str], fields: list[str], key: str = "doc_id") -> DataFrame:
    """Hits of another engine with the fields in which a term occurs, and whether any does."""
    has = lambda f: F.when(F.reduce(F.array(*[F.lit(t.lower()) for t in terms]), F.lit(False), lambda s, t: s | F.coalesce(F.contains(F.lower(f), t), F.lit(False))), F.lit(f))
    seen = docs.select(key, F.array_compact(F.array(*[has(f) for f in fields])).alias("matched"))
    out = hits.join(seen, key, "left").withColumn("matched", F.coalesce("matched", F.array().cast("array<string>")))
    return out.withColumn("keyword", F.size("matched") > 0)


def labels(records: DataFrame, least: str, longest: int = 128, most: int = 32) -> DataFrame:
    """(key, labels) of records (key, body, identifiers): values of lines ``name: value`` in the script of the pattern, no identifiers, distinct."""
    value = lambda x: F.trim(F.regexp_extract(x, r"^[^:：]+[:：](.*)$", 1))
    values = F.transform(F.split("body", "\n"), value)
    good = F.filter(values, lambda v: (v != "") & (F.length(v) <= longest) & v.rlike(least) & ~F.array_contains("identifiers", v))
    return records.select("key", F.slice(F.array_distinct(good), 1, most).alias("labels"))


def envelopes(cells: DataFrame) -> DataFrame:
    """(key, range): the outer frame of A1 references (key, ref), such as B2 or A1:C5; null where one can't be read."""
    part = F.explode(F.split(F.upper(F.regexp_replace("ref", " ", "")), ":"))
    each = cells.select("key", part.alias("p")).select("key", F.regexp_extract("p", r"^\$?([A-Z]{1,3})\$?([0-9]{1,7})$", 1).alias("c"), F.regexp_extract("p", r"^\$?([A-Z]{1,3})\$?([0-9]{1,7})$", 2).alias("r"))
    col, row = F.when(F.col("c") != "", column_number(F.col("c"))), F.when(F.col("r") != "", F.col("r").cast("int"))
    g = each.groupBy("key").agg(F.min(col).alias("a"), F.max(col).alias("b"), F.min(row).alias("x"), F.max(row).alias("y"), F.count_if(F.col("c") == "").alias("bad"))
    name = F.concat(column_letters(F.col("a")), "x", F.lit(":"), column_letters(F.col("b")), "y")
    return g.select("key", F.when(F.col("bad") == 0, name).alias("range"))


def presumed(hits: DataFrame, nodes: DataFrame, stop: list[str], most: int = 20, quote: int = 160) -> DataFrame:
    """Nodes (cid, name, path) that tokens of hits (doc_id, path, line, txt) name: cid, doc_id, line, quote.

    A name resolves below the hit's top folder, else where one node only has it. A node comes once, with
    its first hit; the first ``most`` by hit stay.
    """
    tokens = F.array_distinct(F.transform(F.regexp_extract_all("txt", F.lit(r"([A-Za-z][A-Za-z0-9_#@$-]{2,})"), 1), code_name))
    top = F.coalesce(top_folder(F.col("path")), F.lit("/"))
    said = hits.select("doc_id", "line", F.substring(F.trim("txt"), 1, quote).alias("quote"), top.alias("top"), F.posexplode(tokens).alias("pos", "name")).filter(~F.col("name").isin(*stop))
    known = nodes.select(code_name(F.col("name")).alias("name"), top.alias("top"), "cid")
    here = known.groupBy("name", "top").agg(F.min("cid").alias("here"))
    only = known.groupBy("name").agg(F.min("cid").alias("only"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    found = said.join(here, ["name", "top"], "left").join(only, "name", "left").withColumn("cid", F.coalesce("here", "only")).filter("cid IS NOT NULL")
    first = found.groupBy("cid").agg(F.min(F.struct("doc_id", "line", "pos", "quote")).alias("m"))
    return first.select("cid", "m.doc_id", "m.line", "m.quote", "m.pos").orderBy("doc_id", "line", "pos", "cid").limit(most).drop("pos")


def repeated_calls(calls: DataFrame) -> DataFrame:
    """Calls (turn, seq, name, args) with whether the same name and arguments came before in the turn; null arguments never repeat."""
    w = Window.partitionBy("turn", "name", "args").orderBy("seq")
    return calls.withColumn("repeated", F.col("args").isNotNull() & (F.row_number().over(w) > 1))
