"""From files to a graph of dependencies, and from a name to what a change of it reaches."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.functions.scalars import code_name, top_folder, via_rank
from heronry.operators import flow, graph, programs
from heronry.session import Scratch

#: Kinds of definitions that may own their file's references, the first one by line; a bean or the file itself if it has none.
OWNERS = ("program", "job", "proc", "copybook", "type", "table")
#: Kinds of evidence by type of edge.
VIA = {"INVOKES": "call", "CALLS": "call", "EXECUTES": "exec_proc", "INCLUDES": "copy", "EXTENDS": "extends", "IMPLEMENTS": "implements", "INJECTS": "inject", "IMPORTS": "import", "READS": "exec_sql", "WRITES": "exec_sql"}


class World(NamedTuple):
    """A graph and what could not be made into it."""

    nodes: DataFrame  #: cid, kind, name, path, top
    edges: DataFrame  #: src, type, dst, via, lines, overflow
    flags: DataFrame  #: path, line, kind, name, status
    membership: DataFrame  #: dataset, path


class Resolved(NamedTuple):
    """Facts, written once, and where their references lead."""

    facts: DataFrame
    defs: DataFrame  #: cid, doc_id, path, kind, name, line
    refs: DataFrame  #: ref_id, doc_id, path, line, kind, name, type, inside, step, src, def_id, status


def definitions(found: DataFrame) -> DataFrame:
    """One row a definition, at its first line; an item's id has its groups."""
    d = found.filter("role = 'def'").select("doc_id", "path", F.when(F.col("kind") == "declaration", "function").otherwise(F.col("kind")).alias("kind"), "name", "line", F.when(F.col("kind") == "item", F.col("a")).alias("key"), (F.col("kind") != "declaration").alias("definition"))
    d = d.withColumn("cid", F.concat_ws("|", "kind", "path", F.coalesce("key", "name")))
    return d.groupBy("cid", "doc_id", "path", "kind", "name").agg(F.min("line").alias("line"), F.bool_or("definition").alias("definition"))


def resolve(files: DataFrame) -> Resolved:
    """Read files (doc_id, path, text) once and resolve their references to the nearest definitions.

    A reference belongs to the definition around it where the language tells, else to the first definition of its file.
    Calls of functions prefer definitions to declarations.
    """
    with Scratch(files.sparkSession, "build") as s:
        found = s.keep(programs.facts(files), "facts")
        defs = s.keep(definitions(found), "defs")
        refs = found.filter("role = 'ref'").select("doc_id", "path", "line", "kind", "name", F.col("a").alias("type"), F.when(F.col("kind") == "function", F.col("b")).alias("inside"), F.col("n").alias("step")).distinct()
        refs = s.save(refs.withColumn("ref_id", F.concat_ws("|", "path", F.col("line").cast("string"), "kind", "type", "name")), "refs")
        ask = refs.select("ref_id", "path", "kind", "name").distinct()
        # written one by one: files of exchanges of one step go before the next
        of = defs.select(F.col("cid").alias("def_id"), "path", "kind", "name", "definition")
        plain = s.save(graph.nearest(ask.filter("kind <> 'function'"), of.filter("kind <> 'function'").drop("definition")), "plain")
        called = s.save(graph.nearest_keyed(ask.filter("kind = 'function'"), of.filter("kind = 'function'")), "called")
        ranks = F.when(F.col("kind").isin(*OWNERS), 0).when(F.col("kind") == "bean", 1).when(F.col("kind") == "file", 2)
        owner = defs.filter(ranks.isNotNull()).groupBy("path").agg(F.min_by("cid", F.struct(ranks.alias("rank"), "line", "cid")).alias("first"))
        at = refs.join(plain.unionByName(called), "ref_id").join(owner, "path", "left")
        src = F.when(F.col("inside").isNotNull(), F.concat_ws("|", F.lit("function"), "path", "inside")).otherwise(F.col("first"))
        return Resolved(found, defs, s.keep(at.withColumn("src", src).drop("first"), "resolved"))


def _edges(refs: DataFrame) -> DataFrame:
    made = refs.filter("status = 'resolved' AND src IS NOT NULL")
    via = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in VIA.items() for x in kv]), F.col("type")), F.lower("type"))
    return made.select("src", "type", F.col("def_id").alias("dst"), via.alias("via"), via_rank(via).alias("rank"), "line")


def _nodes(defs: DataFrame) -> DataFrame:
    return defs.filter("definition").select("cid", "kind", "name", "path", top_folder(F.col("path")).alias("top"))


def _flags(refs: DataFrame) -> DataFrame:
    return refs.filter("status <> 'resolved' OR src IS NULL").select("ref_id", "path", "line", "kind", "name", F.when(F.col("src").isNull(), "no_owner").otherwise(F.col("status")).alias("status"))


def build(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (cid, kind, name, path, top), edges (src, type, dst, via, lines, overflow) and references that made none (ref_id, name, status and where)."""
    r = resolve(files)
    return _nodes(r.defs), graph.merge_edges(_edges(r.refs)), _flags(r.refs)


def _programs(r: Resolved) -> DataFrame:
    """(path, cid): the first program or copybook of each file."""
    return r.defs.filter("kind IN ('program', 'copybook')").groupBy("path").agg(F.min_by("cid", F.struct("line", "cid")).alias("cid"))


def file_use(r: Resolved) -> tuple[DataFrame, DataFrame]:
    """What programs do to files (program, path, dd, mode, line), and what jobs bind these to, as ``flow.bound``."""
    of = lambda role: r.facts.filter(F.col("role") == role)
    io = of("io").join(_programs(r), "path").select(F.col("cid").alias("program"), "path", F.col("a").alias("dd"), F.col("kind").alias("mode"), "line")
    steps = r.refs.filter("type = 'EXECUTES' AND step IS NOT NULL AND status = 'resolved'").select("path", "step", F.col("def_id").alias("program")).distinct()
    dds = of("dd").select("path", F.col("n").alias("step"), "kind", F.col("name").alias("dd"), F.col("a").alias("name"), F.col("b").alias("generation"), "line")
    return io, flow.bound(steps, dds)


def flows(r: Resolved) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Edges of data (src, dst, via, line), data sets with their places, their jobs, and flags (path, line, kind, name, status)."""
    first = _programs(r)
    io, bindings = file_use(r)
    files = flow.dataset_flow(io, bindings)
    used = files.select(F.when(F.col("via") == "read_file", F.col("src")).otherwise(F.col("dst")).alias("dataset")).distinct()
    copies = r.refs.filter("kind = 'copybook' AND status = 'resolved'").select("src", F.col("def_id").alias("dst"))
    items = r.defs.filter("kind = 'item'").join(first.withColumnRenamed("cid", "book"), "path").select(F.col("cid").alias("id"), "book", "name")
    names = r.facts.filter("role = 'use'").join(first, "path").select(F.col("cid").alias("program"), "name", "line")
    uses, lost = flow.item_use(copies, items, names)
    edges = files.select("src", "dst", "via", "line").unionByName(uses.withColumn("via", F.lit("use")))
    back = first.select(F.col("cid").alias("program"), "path")
    flags = flow.unbound(io, bindings).select("path", "line", F.lit("dataset").alias("kind"), "name", F.lit("unresolved").alias("status"))
    flags = flags.unionByName(lost.join(back, "program").select("path", F.lit(None).cast("int").alias("line"), F.lit("item").alias("kind"), F.array_join("names", ",").alias("name"), F.lit("use_ambiguous").alias("status")))
    return edges, flow.datasets(bindings, used), flow.membership(bindings.join(used, "dataset", "left_semi")), flags


def world(files: DataFrame) -> World:
    """The whole graph: dependencies and flows of data (type FLOWS_TO)."""
    r = resolve(files)
    moved, sets, jobs, lost = flows(r)
    moved = moved.select("src", F.lit("FLOWS_TO").alias("type"), "dst", "via", via_rank(F.col("via")).alias("rank"), "line")
    edges = graph.merge_edges(_edges(r.refs).unionByName(moved))
    nodes = _nodes(r.defs).unionByName(sets.select(F.col("id").alias("cid"), F.lit("dataset").alias("kind"), "name", "path", top_folder(F.col("path")).alias("top")))
    return World(nodes, edges, _flags(r.refs).drop("ref_id").unionByName(lost), jobs)


def starts(nodes: DataFrame, term: str) -> DataFrame:
    """Nodes that a term names: by exact name, as it is or in upper case without dots at its end."""
    return nodes.filter(F.col("name").isin(term) | (F.col("name") == code_name(F.lit(term)))).select(F.col("cid").alias("id"))


def impact_of(nodes: DataFrame, edges: DataFrame, flags: DataFrame, term: str, depth: int = 10) -> tuple[DataFrame, DataFrame]:
    """What a change of ``term`` reaches: nodes with their level; and one row that says how far the answer goes.

    Its limits: no_start, depth_truncated, and unresolved_names if references that made no edge name a node found.
    """
    found, more = graph.impact(edges.select("src", "dst"), starts(nodes, term), depth)
    named = found.join(nodes, F.col("id") == F.col("cid")).select("cid", "kind", "name", "path", "level")
    lost = flags.join(named.select("name").distinct(), "name", "left_semi").agg(F.count(F.lit(1)).alias("lost"))
    limits = F.array_compact(F.array(F.when(F.col("n") == 0, F.lit("no_start")), F.when(F.lit(more), F.lit("depth_truncated")), F.when(F.col("lost") > 0, F.lit("unresolved_names"))))
    cover = named.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(lost)).select("n", "lost", limits.alias("limits"), (F.size(limits) == 0).alias("complete"))
    return named, cover


#: Why an answer is not whole.
LIMITS = ("timeout", "row_cap", "depth", "result_cap", "doc_search_truncated", "card_cap", "graph_unavailable", "graph_reingest_required", "plugin_failed", "source_unparsed", "narrow_required")


def answer(nodes: DataFrame, edges: DataFrame, term: str, depth: int = 10, ceiling: int | None = None, most_starts: int = 50, most: int | None = None, unparsed: int = 0, same_era: bool = True) -> tuple[DataFrame, DataFrame]:
    """What a change of ``term`` reaches, (cid, kind, name, path, level, trace, types) with the way to each node, and the limits of the answer (kind, stage, count).

    Too many starts ask for a narrower term and nothing is walked; a graph of another era or without nodes says so; files that
    could not be parsed are counted; ``most`` cuts the answer by level and cid and counts what is left out. Without a row in the
    limits the answer is whole.
    """
    spark, limits = nodes.sparkSession, []
    first = starts(nodes, term)
    n = first.limit(most_starts + 1).count()
    if not same_era:
        limits.append(("graph_reingest_required", "anchor", None))
    elif nodes.isEmpty():
        limits.append(("graph_unavailable", "anchor", None))
    elif n > most_starts:
        limits.append(("narrow_required", "anchor", first.count()))
    walk = first if not limits else first.limit(0)
    found, ended = graph.traced(edges.select("src", "dst", "type"), walk, depth, ceiling)
    limits += [(kind, "impact", count) for kind, count in ended.items()]
    if unparsed:
        limits.append(("source_unparsed", "impact", unparsed))
    named = found.join(nodes, F.col("id") == F.col("cid")).select("cid", "kind", "name", nodes["path"], "level", found["path"].alias("trace"), "types")
    if most is not None:
        total = found.count()
        if total > most:
            limits.append(("result_cap", "impact", total - most))
            named = named.orderBy("level", "cid").limit(most)
    return named, spark.createDataFrame(limits, "kind string, stage string, count long")


def quality(found: DataFrame, gold: DataFrame) -> DataFrame:
    """(recall, precision) of what starts reach, both as ``graph.marked`` with the same numbers; 1 where there is nothing to find, or nothing found."""
    both = found.withColumnRenamed("bits", "f").join(gold.withColumnRenamed("bits", "g"), ["id", "block"], "full")
    f, g = (F.coalesce(c, F.lit(0).cast("long")) for c in ("f", "g"))
    n = lambda bits: F.coalesce(F.sum(F.bit_count(bits)), F.lit(0))
    share = lambda c: F.when(n(c) == 0, 1.0).otherwise(F.round(n(f.bitwiseAND(g)) / n(c), 6))
    return both.agg(share(g).alias("recall"), share(f).alias("precision"))
