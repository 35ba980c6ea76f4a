"""Small relational operators behind reports, cards and period checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: what ends a logical line.
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\u0085\\u2028\\u2029]"


def existing_hits(hits: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Hits without a key pass; others only if ``docs`` has it."""
    return hits.filter(F.col(key).isNull()).unionByName(hits.filter(F.col(key).isNotNull()).join(docs.select(key), key, "left_semi"))


def in_scope_only(items: DataFrame, evidence: str, scope: str) -> DataFrame:
    """Items with their nested paths pruned to a folder."""
    return items.withColumn(evidence, F.filter(evidence, lambda p: (p == scope) | p.startswith(scope + "/")))


def tables(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """Resolve table references (ref_id, schema, name) to (def_id, schema, name).

    With a schema: that one, else definitions without one; without: any, ambiguous over
    several schemas. More than one definition left is ambiguous.
    """
    d = defs.select("name", F.col("schema").alias("s"), "def_id")
    j = refs.join(d, "name", "left")
    exact, bare = F.col("s") == F.col("schema"), F.col("s").isNull()
    count = lambda c: F.count(F.when(c, F.col("def_id")))
    first = lambda c: F.min(F.when(c, F.col("def_id")))
    g = j.groupBy("ref_id", "schema").agg(count(exact).alias("ne"), first(exact).alias("de"), count(bare).alias("nb"), first(bare).alias("db"), F.count("def_id").alias("n"), F.min("def_id").alias("d"))
    n = F.when(F.col("schema").isNull(), F.col("n")).when(F.col("ne") > 0, F.col("ne")).otherwise(F.col("nb"))
    d = F.when(F.col("schema").isNull(), F.col("d")).when(F.col("ne") > 0, F.col("de")).otherwise(F.col("db"))
    return g.select("ref_id", F.when(n == 1, d).alias("def_id"), F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved").alias("status"))


def cards(graph: DataFrame, grep: DataFrame, key: str) -> DataFrame:
    """Documents of either side and which: both, graph or grep."""
    g, t = graph.select(key).distinct().withColumn("g", F.lit(1)), grep.select(key).distinct().withColumn("t", F.lit(1))
    return g.join(t, key, "full").select(key, F.when(F.col("g").isNull(), "grep").when(F.col("t").isNull(), "graph").otherwise("both").alias("source"))


def capped(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each group and how many more it has."""
    w = Window.partitionBy(by)
    r = rows.withColumn("nth", F.row_number().over(w.orderBy(order))).withColumn("overflow", F.greatest(F.count(F.lit(1)).over(w) - most, F.lit(0)))
    return r.filter(F.col("nth") <= most)


def period_parents(folders: DataFrame) -> DataFrame:
    """(project, folder, parent): the folder with the next smaller number in its name, where numbers are unique and two or more."""
    number = F.nullif(F.regexp_extract(F.translate("folder", "０１２３４５６７８９", "0123456789"), "([0-9]+)", 1), F.lit("")).cast("long")
    f = folders.select("project", "folder").distinct().withColumn("number", number)
    ok = f.groupBy("project").agg((F.count_distinct("number") == F.count(F.lit(1))).alias("ok"))
    parent = F.lag("folder").over(Window.partitionBy("project").orderBy("number"))
    return f.withColumn("parent", parent).join(ok, "project").select("project", "folder", F.when(F.col("ok"), F.col("parent")).alias("parent"))


def shared_by_neighbours(rows: DataFrame) -> DataFrame:
    """(period, after, same): how many paths each period shares with the next one; rows (period, path)."""
    r = rows.distinct()
    order = r.select("period").distinct().select("period", F.lead("period").over(Window.orderBy("period")).alias("after")).filter("after IS NOT NULL")
    both = r.join(order, "period").select(F.col("period").alias("before"), F.col("after").alias("period"), "path").join(r, ["period", "path"])
    same = both.groupBy(F.col("before").alias("period")).agg(F.count(F.lit(1)).alias("same"))
    return order.join(same, "period", "left").select("period", "after", F.coalesce("same", F.lit(0)).alias("same"))


def logical_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, txt) split at every kind of line end."""
    return docs.select("doc_id", F.posexplode(F.split("text", LINE_END)).alias("line", "txt")).withColumn("line", F.col("line") + 1)


def first_term_with_hits(docs: DataFrame, phrase: str) -> DataFrame:
    """(term, doc_id): hits of the whole phrase, or else of its longest term that has any."""
    terms = [phrase, *sorted(set(phrase.split()), key=lambda t: (-len(t), t))]
    low = F.lower("text")
    found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t.lower())), F.struct(F.lit(i).alias("rank"), F.lit(t).alias("term"))) for i, t in enumerate(terms)]))
    hits = docs.select("doc_id", F.inline(found))
    return hits.join(F.broadcast(hits.agg(F.min("rank").alias("rank"))), "rank").select("term", "doc_id")


def stacked(parts: list[DataFrame]) -> DataFrame:
    """Rows of several reports; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
