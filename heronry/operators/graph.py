"""Resolution joins and graph traversal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.scalars import ancestors, parts
from heronry.session import Scratch

#: Starts in a block.
BITS = 63


def nearest(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """Resolve refs (ref_id, path, kind, name) to defs (def_id, path, kind, name).

    Of definitions below the same top folder (files at the root are of one folder) the nearest
    by steps in the tree is taken; equal ones are ambiguous, ones elsewhere only are cross_scope, else
    unresolved. Both sides meet by (kind, name, folder above), where definitions are aggregated to
    the least depth, how many have it and the smallest of them, so no pair of a reference and a definition is made.
    """

    def above(df: DataFrame) -> DataFrame:
        folders = F.when(F.contains("path", F.lit("/")), ancestors(F.col("path"))).otherwise(F.array(F.lit("/")))
        return df.withColumn("depth", F.size(parts(F.col("path")))).withColumn("folder", F.explode(folders))

    key = ["kind", "name", "folder"]
    per = above(defs).groupBy(*key, "depth").agg(F.count(F.lit(1)).alias("n"), F.min("def_id").alias("d"))
    per = per.groupBy(*key).agg(F.min(F.struct("depth", "n", "d")).alias("best"))
    level = F.when(F.col("folder") == "/", 0).otherwise(F.size(parts(F.col("folder"))))
    met = above(refs).join(per, key, "left").withColumn("dist", F.col("depth") + F.col("best.depth") - 2 * level)
    # of the folders that refs and definitions share, those at the least distance hold exactly the nearest definitions
    at = met.groupBy("ref_id", "kind", "name", "dist").agg(F.sum("best.n").alias("n"), F.min("best.d").alias("d"))
    near = at.groupBy("ref_id", "kind", "name").agg(F.min(F.when(F.col("dist").isNotNull(), F.struct("dist", "n", "d"))).alias("m"))
    some = defs.select("kind", "name").distinct().withColumn("any", F.lit(True))
    n = F.coalesce(F.col("m.n"), F.lit(0))
    status = F.when(n == 1, "resolved").when(n > 1, "ambiguous").when(F.col("any"), "cross_scope").otherwise("unresolved")
    return near.join(some, ["kind", "name"], "left").select("ref_id", F.when(n == 1, F.col("m.d")).alias("def_id"), status.alias("status"))


def impact(edges: DataFrame, starts: DataFrame, depth: int = 10, reverse: bool = True) -> tuple[DataFrame, bool]:
    """Level by level from ``starts`` (id) along edges (src, dst); smallest parent first.

    Gives (id, level, parent) and whether more lies beyond the depth. Each level is
    a written table; the visited set is an anti join, never a list on the driver.
    """
    e = edges.select(F.col("dst").alias("from"), F.col("src").alias("id")) if reverse else edges.select(F.col("src").alias("from"), F.col("dst").alias("id"))
    with Scratch(edges.sparkSession, "impact") as s:
        e = s.save(e.distinct(), "edges")
        none = F.lit(None).cast(starts.schema["id"].dataType)
        seen = front = s.keep(starts.select("id").distinct().select("id", F.lit(0).alias("level"), none.alias("parent")), "level")
        for level in range(1, depth + 2):
            step = front.select(F.col("id").alias("from")).join(e, "from").groupBy("id").agg(F.min("from").alias("parent"))
            new = step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(level).alias("level"), "parent")
            if level > depth:
                return seen, not new.isEmpty()
            front = s.keep(new, "level")
            if front.isEmpty():
                break
            seen = seen.unionByName(front)
        return seen, False


def traced(edges: DataFrame, starts: DataFrame, depth: int = 10, ceiling: int | None = None) -> tuple[DataFrame, dict]:
    """As ``impact`` against edges (src, dst, type): (id, level, path, types), the path from its start and the types of its edges; and what ended it.

    Without a ``ceiling`` nothing is cut. With one no more rows are found beside the starts: a level that passes it is cut, the smallest ids stay, and
    row_cap says so; depth says that more lies beyond the last level. Of several ways the smallest parent's is taken.
    """
    none = F.array().cast("array<string>")
    with Scratch(edges.sparkSession, "traced") as s:
        e = s.save(edges.select(F.col("dst").alias("from"), F.col("src").alias("id"), "type").distinct(), "edges")
        front = s.keep(starts.select("id").distinct().select("id", F.lit(0).alias("level"), F.array("id").alias("path"), none.alias("types")), "level")
        seen, left, ended = front, ceiling, {}
        for level in range(1, depth + 2):
            way = F.min(F.struct("from", "type", "path", "types")).alias("w")
            step = front.select(F.col("id").alias("from"), "path", "types").join(e, "from").groupBy("id").agg(way)
            new = step.join(seen.select("id"), "id", "left_anti")
            if level > depth:
                if not new.isEmpty():
                    ended["depth"] = None
                break
            new = s.save(new.select("id", F.lit(level).alias("level"), F.concat("w.path", F.array("id")).alias("path"), F.concat("w.types", F.array("w.type")).alias("types")), "new")
            n = new.count()
            if left is not None and n > left:
                ended["row_cap"] = ceiling
                seen = seen.unionByName(s.keep(new.orderBy("id").limit(left), "level"))
                break
            if not n:
                break
            front, left = s.keep(new, "level"), None if left is None else left - n
            s.drop(new)
            seen = seen.unionByName(front)
    return seen, ended


def numbered(starts: DataFrame) -> DataFrame:
    """(start, block, mask) of distinct starts (id): each has a bit of its own in one of the blocks of ``BITS``; a written table."""
    with Scratch(starts.sparkSession, "numbered") as s:
        each = s.save(starts.select(F.col("id").alias("start")).filter("start IS NOT NULL").distinct(), "starts")
        blocks = max(1, each.count() // 32)
        dealt = each.withColumn("deal", F.pmod(F.xxhash64("start"), F.lit(blocks)))
        nth = F.row_number().over(Window.partitionBy("deal").orderBy("start")) - 1
        dealt = dealt.withColumn("nth", nth)
        block, mask = F.col("deal") + blocks * F.floor(F.col("nth") / BITS), F.expr(f"shiftleft(1L, nth % {BITS})")
        return s.keep(dealt.select("start", block.cast("long").alias("block"), mask.alias("mask")), "numbers")


def marked(pairs: DataFrame, numbers: DataFrame) -> DataFrame:
    """Pairs (start, id) as (id, block, bits), the starts of an id in one row a block."""
    return pairs.join(numbers, "start").groupBy("id", "block").agg(F.bit_or("mask").alias("bits"))


def reached(edges: DataFrame, numbers: DataFrame, small: int = 100_000) -> DataFrame:
    """(id, block, bits): all that can be reached along edges (src, dst) from the starts of ``numbered``, as ``marked``.

    While that takes a good part of them, edges to what leads nowhere are taken off in layers; the starts of a node are complete once the
    layers behind its own are done, so each of these edges is followed once. What is left, with all circles, is
    followed step by step, and only bits that are new go further.
    """
    with Scratch(edges.sparkSession, "reached") as s:
        every = s.save(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
        rest = every.filter("src <> dst")
        n, layers = rest.count(), []
        while n > small:
            leads = rest.select(F.col("src").alias("dst")).distinct().withColumn("leads", F.lit(True))
            parted = s.save(rest.join(leads.hint("merge"), "dst", "left").select("src", "dst", F.coalesce("leads", F.lit(False)).alias("leads")), "layer")
            left = parted.filter("leads").count()
            if n - left < n / 16:
                break
            layers.append(parted.filter("NOT leads").select("src", "dst"))
            rest, n = parted.filter("leads").select("src", "dst"), left
        own = numbers.select(F.col("start").alias("id"), "block", F.col("mask").alias("bits"))
        ored = lambda rows: rows.groupBy("id", "block").agg(F.bit_or("bits").alias("bits"))
        follow = lambda at, e: ored(at.join(e.withColumnRenamed("src", "id"), "id").select(F.col("dst").alias("id"), "block", "bits"))
        seen = s.save(follow(own, rest).withColumn("new", F.col("bits")), "bits")
        none = F.lit(0).cast("long")
        while not (front := seen.filter("new <> 0").select("id", "block", F.col("new").alias("bits"))).isEmpty():
            met = seen.drop("new").join(follow(front, rest).withColumnRenamed("bits", "more"), ["id", "block"], "full")
            had, more = F.coalesce("bits", none), F.coalesce("more", none)
            old, seen = seen, s.save(met.select("id", "block", had.bitwiseOR(more).alias("bits"), more.bitwiseAND(F.bitwise_not(had)).alias("new")), "bits")
            s.drop(old)
        # bits of each node stand in one of these: its way to itself beside them
        loops = every.filter("src = dst").select(F.col("src").alias("id")).join(own, "id")
        parts = [s.keep(seen.drop("new"), "bits"), s.keep(loops, "loops")]
        for layer in reversed(layers):
            parts.append(s.keep(follow(reduce(DataFrame.unionByName, [own, *parts]), layer), "bits"))
    return ored(reduce(DataFrame.unionByName, parts))


def reach(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(start, id): all that can be reached along edges (src, dst) from each of ``starts`` (id), all sources if None; a start in a cycle reaches itself.

    Only what is new goes further in each step. Without ``starts`` pairs are found for inner nodes once and shared by all
    sources that lead to them.
    """
    if starts is not None:
        numbers = numbered(starts)
        return reached(edges, numbers).join(numbers, "block").filter("bits & mask <> 0").select("start", "id")
    with Scratch(edges.sparkSession, "reach") as s:
        e = s.save(edges.select("src", "dst").distinct(), "edges")
        at = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        step = e.select(F.col("src").alias("id"), F.col("dst").alias("next"))
        seen = new = s.keep(at.select(F.col("src").alias("start"), F.col("dst").alias("id")), "pairs")
        while not new.isEmpty():
            more = new.join(step, "id").select("start", F.col("next").alias("id")).distinct()
            new = s.keep(more.join(seen, ["start", "id"], "left_anti"), "pairs")
            seen = seen.unionByName(new)
        first = s.keep(e, "first")
    further = first.join(seen.withColumnRenamed("id", "far"), F.col("dst") == F.col("start")).select(F.col("src").alias("start"), F.col("far").alias("id"))
    return first.select(F.col("src").alias("start"), F.col("dst").alias("id")).unionByName(further).distinct()


def first_sorted(rows: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """(key, places): for each key the ``most`` smallest values in order; no group comes together before it is cut."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(value))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= most).groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("places"))


def neighbours(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """Undirected shortest distances up to ``depth``."""
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    found, _ = impact(both, starts, depth)
    return found.select("id", "level")


def _fixed(s: Scratch, first: DataFrame, step, changed, name: str, hops: int = 4) -> DataFrame:
    """``step(table)`` until ``changed(new, old)`` is false; every ``hops`` steps make a written table."""
    at = first
    while True:
        new = at
        for _ in range(hops):
            new = step(new)
        new = s.save(new, name)
        if not changed(new, at):
            return new
        if at is not first:
            s.drop(at)
        at = new


def cycles(edges: DataFrame) -> DataFrame:
    """Strongly connected groups of two or more: (id, group), the group's smallest id.

    Edges that no cycle can hold are trimmed. Then every node learns the smallest id that reaches it, and of
    those with one such id the nodes that reach it back are its group. Groups leave, and the rest goes
    round again. Only nodes and edges are kept, never pairs of what reaches what.
    """
    groups = []
    with Scratch(edges.sparkSession, "cycles") as s:
        e = s.save(edges.select("src", "dst").filter("src <> dst").distinct(), "edges")

        def trim(at):
            kept = at.join(at.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            return kept.join(at.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")

        while True:
            e = _fixed(s, e, trim, lambda new, old: new.count() < old.count(), "trimmed")
            if e.isEmpty():
                break
            ids = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()

            def forward(at, e=e):
                seen = e.join(at.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("least").alias("other"))
                return at.join(seen, "id", "left").select("id", F.least("least", "other").alias("least"))

            def lower(new, old):
                return not new.join(old.withColumnRenamed("least", "was"), "id").filter("least < was").isEmpty()

            least = _fixed(s, s.save(ids.withColumn("least", F.col("id")), "least"), forward, lower, "least")
            of = lambda c: least.select(F.col("id").alias(c), F.col("least").alias(f"of_{c}"))
            inside = s.save(e.join(of("src"), "src").join(of("dst"), "dst").filter("of_src = of_dst"), "inside")

            def backward(at, inside=inside):
                more = inside.join(at.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), F.col("of_src").alias("group"))
                return at.union(more).distinct()

            roots = s.save(least.filter("id = least").select("id", F.col("least").alias("group")), "roots")
            found = _fixed(s, roots, backward, lambda new, old: new.count() > old.count(), "back")
            groups.append(s.keep(found, "group"))
            rest = e.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti")
            e = s.save(rest, "edges")
    if not groups:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("group")).limit(0)
    every = reduce(DataFrame.unionByName, groups)
    large = every.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("group")
    return every.join(large, "group").select("id", "group")


def nearest_keyed(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """As ``nearest`` for defs that also say whether they are a definition (column definition): those go before declarations below the same top folder."""
    first, every = nearest(refs, defs.filter("definition")), nearest(refs, defs)
    other = every.select("ref_id", F.col("def_id").alias("d"), F.col("status").alias("s"))
    own = F.col("status").isin("resolved", "ambiguous")
    return first.join(other, "ref_id").select("ref_id", F.when(own, F.col("def_id")).otherwise(F.col("d")).alias("def_id"), F.when(own, F.col("status")).otherwise(F.col("s")).alias("status"))


def merge_edges(edges: DataFrame, most: int = 20) -> DataFrame:
    """One edge per (src, type, dst): best-ranked evidence first, sources distinct, sorted, capped with the overflow's size."""
    key = ["src", "type", "dst"]
    each = edges.groupBy(*key, "line").agg(F.min(F.struct("rank", "line", "via")).alias("best"))
    w = Window.partitionBy(*key)
    each = each.withColumn("nth", F.row_number().over(w.orderBy("line")))
    kept = F.array_sort(F.collect_list(F.when(F.col("nth") <= most, F.col("line"))))  # most at most
    g = each.groupBy(*key).agg(F.min("best").alias("best"), kept.alias("lines"), F.count(F.lit(1)).alias("n"))
    return g.select(*key, F.col("best.via").alias("via"), "lines", F.greatest(F.col("n") - most, F.lit(0)).cast("int").alias("overflow"))
