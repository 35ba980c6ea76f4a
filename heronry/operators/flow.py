"""Data that passes between programs: by files that jobs bind to data sets, and by items of copied books."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.functions.scalars import top_folder
from heronry.operators import graph

#: Names given in a report of ambiguous ones.
NAMED = 5


def dataset_id(path, kind, dataset) -> F.Column:
    """One node for each data set of a top folder, whatever its generations; temporary ones are of their job only."""
    own = F.when(kind == "temporary", F.concat(path, F.lit(":"), dataset)).otherwise(dataset)
    return F.concat_ws("|", F.lit("dataset"), F.coalesce(top_folder(path), F.lit("")), own)


def bound(steps: DataFrame, dds: DataFrame) -> DataFrame:
    """(program, dd, dataset, name, generation, path, line) of steps (path, step, program) and data definitions (path, step, kind, dd, name, generation, line).

    Only definitions of steps whose program is known count.
    """
    return dds.join(steps, ["path", "step"]).select("program", "dd", dataset_id(F.col("path"), F.col("kind"), F.col("name")).alias("dataset"), "name", "generation", "path", "line")


def dataset_flow(io: DataFrame, bindings: DataFrame) -> DataFrame:
    """(src, dst, via, path, line, binding): flows between programs and data sets.

    io (program, path, dd, mode, line) says r, w or rw; a file that is written flows into its data set, one that is read
    out of it. Each flow has two places: the program's statement, and the job's definition; ``binding`` is the job.
    """
    both = io.select("program", "dd", "mode", F.col("path").alias("own"), F.col("line").alias("at")).join(bindings, ["program", "dd"])
    way = lambda mode, a, b, via: F.when(F.contains("mode", F.lit(mode)), F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(via).alias("via")))
    ways = F.array_compact(F.array(way("w", "program", "dataset", "write_file"), way("r", "dataset", "program", "read_file")))
    places = F.array(F.struct(F.col("own").alias("path"), F.col("at").alias("line")), F.struct(F.col("path"), F.col("line")))
    each = both.select(F.inline(ways), places.alias("places"), F.col("path").alias("binding"))
    return each.select("src", "dst", "via", "binding", F.inline("places")).distinct()


def unbound(io: DataFrame, bindings: DataFrame) -> DataFrame:
    """(path, name, via, line) of files that no job binds."""
    left = io.join(bindings.select("program", "dd").distinct(), ["program", "dd"], "left_anti")
    return left.select("path", F.col("dd").alias("name"), F.when(F.col("mode") == "r", "read_file").otherwise("write_file").alias("via"), "line")


def datasets(bindings: DataFrame, used: DataFrame, most: int = 20) -> DataFrame:
    """(id, name, path, places, overflow, generations) of data sets in ``used`` (dataset); the first definition by path and line gives the path."""
    d = bindings.join(used, "dataset", "left_semi")
    place = F.struct("path", "line")
    per = d.groupBy("dataset").agg(F.min("name").alias("name"), F.min(place).alias("first"), F.count_distinct("path", "line").alias("n"), F.bool_or(F.col("generation").isNotNull()).alias("generations"))
    places = graph.first_sorted(d.select("dataset", place.alias("place")).distinct(), "dataset", "place", most)
    return per.join(places, "dataset").select(F.col("dataset").alias("id"), "name", "first.path", "places", F.greatest(F.col("n") - most, F.lit(0)).cast("int").alias("overflow"), "generations")


def membership(bindings: DataFrame) -> DataFrame:
    """(dataset, path): every job that names a data set, without a limit."""
    return bindings.select("dataset", "path").distinct()


def _hits(copies: DataFrame, items: DataFrame, names: DataFrame) -> DataFrame:
    """(program, name, line, n, item): how many items of the books that a program copies, directly or by other books, have a name that it uses."""
    wanted = names.join(items.select("name").distinct(), "name", "left_semi").groupBy("program", "name").agg(F.min("line").alias("line"))
    books = graph.reach(copies).select(F.col("start").alias("program"), F.col("id").alias("book"))
    # a program's books meet their items by book, not by name: a name that stands in very many books makes no product
    found = books.join(wanted.select("program").distinct(), "program", "left_semi").join(items.withColumnRenamed("id", "item"), "book").join(wanted, ["program", "name"])
    return found.groupBy("program", "name", "line").agg(F.count_distinct("item").alias("n"), F.min("item").alias("item"))


def item_use(copies: DataFrame, items: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, line) from items (id, book, name) to the programs that use them, and ambiguous names (program, count, names).

    names (program, name, line) are those of the programs' procedures; copies (src, dst) those of programs and books,
    which may be circular. A name that one item of all copied books has makes an edge, one that several have is reported.
    """
    hits = _hits(copies, items, names)
    some = hits.filter("n > 1").select("program", F.struct("line", "name").alias("at"))
    first = graph.first_sorted(some, "program", "at", NAMED).select("program", F.col("places.name").alias("names"))
    lost = some.groupBy("program").agg(F.count(F.lit(1)).alias("count")).join(first, "program")
    return hits.filter("n = 1").select(F.col("item").alias("src"), F.col("program").alias("dst"), "line"), lost
