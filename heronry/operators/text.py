"""Line, chunk and term operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.scalars import LINE_END, top_folder


def lines(docs: DataFrame, *keys: str) -> DataFrame:
    """One row per line, numbered from 1."""
    return docs.select(*keys, F.posexplode(F.split("text", "\n")).alias("pos", "txt")).select(*keys, (F.col("pos") + 1).alias("line"), "txt")


def grep(docs: DataFrame, needle: str, window: int = 2) -> DataFrame:
    """Lines that hold the literal, either case, with ``window`` lines on both sides."""
    wanted = F.lit(needle.lower())
    hit = docs.filter(F.contains(F.lower("text"), wanted)).select("doc_id", F.split("text", "\n").alias("every"))

    def found(x, i):
        first = F.greatest(i - window, F.lit(0))
        near = F.array_join(F.slice("every", first + 1, i + window - first + 1), "\n")
        return F.when(F.contains(F.lower(x), wanted), F.struct((i + 1).alias("line"), x.alias("txt"), near.alias("near")))

    # only hits leave the row, not its lines
    return hit.select("doc_id", F.inline(F.filter(F.transform("every", found), lambda h: h.isNotNull())))


def chunks(docs: DataFrame, size: int = 40) -> DataFrame:
    """Chunks of ``size`` lines, stripped, without blank ones; line is the first one's number."""
    at = docs.select("doc_id", F.split("text", LINE_END).alias("l"))
    body = lambda k: F.regexp_replace(F.array_join(F.slice("l", k * size + 1, size), "\n"), r"^\s+|\s+$", "")
    every = F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / size).cast("int")), lambda k: F.struct((k * size + 1).alias("line"), body(k).alias("body")))
    return at.select("doc_id", F.inline(every)).filter("body <> ''")


def postings(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, tf, dl): lower-case terms of letters, digits and underscores."""
    terms = docs.select(key, F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9_]+)"), 1).alias("t"))
    return terms.select(key, F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, query: list[str], k: int = 10, k1: float = 1.2, b: float = 0.75, key: str = "doc_id") -> DataFrame:
    """Top k by BM25. Only query terms are exploded; lengths and the mean come from one pass."""
    terms = F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9_]+)"), 1)
    base = docs.select(key, terms.alias("t")).select(key, F.size("t").alias("dl"), F.filter("t", lambda x: x.isin(*query)).alias("t"))
    total = base.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    tf = base.select(key, "dl", F.explode("t").alias("term")).groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = tf.join(F.broadcast(df), "term").join(F.broadcast(total)).groupBy(key).agg(F.round(F.sum(part), 6).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def outline(docs: DataFrame) -> DataFrame:
    """Headings of levels 1 to 3."""
    found = lines(docs, "doc_id").filter(F.col("txt").rlike(r"^#{1,3}\s+.+"))
    return found.select("doc_id", "line", F.length(F.regexp_extract("txt", "^(#+)", 1)).alias("level"), F.substring(F.regexp_extract("txt", r"^#{1,3}\s+(.+)", 1), 1, 300).alias("title"))


def mentions(docs: DataFrame, dictionary: DataFrame, least: int = 4, most: int = 200) -> DataFrame:
    """Targets (name, cid, path) that documents (doc_id, path, text) mention by a token, once each, first ones first.

    Only targets below the same top folder count, all that have the name; files at the root are of one
    folder. The overflow says how many more than ``most`` there are. Tokens are made distinct in their row.
    """
    tokens = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9_#@$-]+)"), 1)), lambda x: F.length(x) >= least)
    folder = F.coalesce(top_folder(F.col("path")), F.lit("/"))  # no folder has this name
    said = docs.select("doc_id", folder.alias("top"), F.posexplode(tokens).alias("pos", "name"))
    targets = dictionary.select("name", "cid", folder.alias("top")).distinct()
    first = said.join(targets, ["name", "top"]).groupBy("doc_id", "cid").agg(F.min(F.struct("pos", "name")).alias("m"))
    w = Window.partitionBy("doc_id")
    hit = first.select("doc_id", "cid", "m.*").withColumn("nth", F.row_number().over(w.orderBy("pos", "cid"))).withColumn("overflow", F.greatest(F.count(F.lit(1)).over(w) - most, F.lit(0)))
    return hit.filter(F.col("nth") <= most).select("doc_id", "name", "cid", "nth", "overflow")


def headed(docs: DataFrame, needle: str) -> DataFrame:
    """Lines that hold the literal, with the last heading (a line of # and a title) at or above each: line, heading, title."""
    row = docs.filter(F.contains("text", F.lit(needle))).select("doc_id", F.split("text", "\n").alias("every"))
    title = lambda x: F.trim(F.regexp_replace(x, "^#+", ""))
    heads = F.filter(F.transform("every", lambda x, i: F.when(F.startswith(x, F.lit("#")) & (title(x) != ""), F.struct((i + 1).alias("line"), title(x).alias("title")))), lambda h: h.isNotNull())
    hits = F.filter(F.transform("every", lambda x, i: F.when(F.contains(x, F.lit(needle)), i + 1)), lambda h: h.isNotNull())
    at = row.select("doc_id", heads.alias("heads"), F.explode(hits).alias("line"))
    last = F.try_element_at(F.filter("heads", lambda h: h["line"] <= F.col("line")), F.lit(-1))
    return at.select("doc_id", "line", last.alias("h")).select("doc_id", "line", F.col("h.line").alias("heading"), F.col("h.title").alias("title"))


def with_identifiers(docs: DataFrame, pattern: str, wanted: list[str]) -> DataFrame:
    """Documents one of whose identifiers, by the pattern, is exactly one of those wanted."""
    found = F.regexp_extract_all("text", F.lit(f"({pattern})"), 1)
    return docs.filter(F.arrays_overlap(found, F.array(*[F.lit(w) for w in wanted]))).select("doc_id")
