"""Includes by path, and types with all their subtypes as a range of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.scalars import top_folder
from heronry.session import Scratch


def folded(path: Column) -> Column:
    r"""A path with ``\`` as ``/``, without empty parts and ``.``, and ``..`` taken with what stands before it; those that lead out stay."""
    none = F.array().cast("array<string>")

    def step(stack, part):
        up = (part == "..") & (F.size(stack) > 0) & (F.coalesce(F.try_element_at(stack, F.lit(-1)), F.lit("..")) != "..")
        return F.when(part.isin("", "."), stack).when(up, F.slice(stack, F.lit(1), F.size(stack) - 1)).otherwise(F.concat(stack, F.array(part)))

    return F.array_join(F.aggregate(F.split(F.translate(path, "\\", "/"), "/"), none, step), "/")


def expanded(aliases: dict[str, str]) -> dict[str, str]:
    """Aliases that lead to aliases, led to their end; circular ones are left out."""
    out = {}
    for name in aliases:
        at, seen = aliases[name], {name}
        while at is not None and (head := at.split("/")[0]) in aliases:
            at = None if head in seen else aliases[head] + at[len(head) :]
            seen.add(head)
        if at is not None:
            out[name] = at
    return out


def include_paths(refs: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None, copy_paths: list[str] | None = None) -> DataFrame:
    """(ref_id, target, how) of refs (ref_id, path, include, kind, name) to files (path, kind, name); a null target if no rule decides.

    First the include as a path from the ref's folder, if it has a folder in it; then with an alias at its beginning
    replaced; both only if that file is there, with that kind and name, below the ref's top folder. Last the
    folders of ``copy_paths`` of that top folder in order: the first one with exactly one such file below it decides.
    """
    top = lambda c: F.coalesce(top_folder(F.col(c)), F.lit(""))
    inc = F.translate("include", "\\", "/")
    base = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "/")).otherwise("")
    relative = F.when(F.contains(inc, F.lit("/")), folded(F.concat(base, inc)))
    known = expanded(aliases or {})
    head = F.substring_index(inc, "/", 1)
    prefix = F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), head) if known else F.lit(None).cast("string")
    alias = F.when(prefix.isNotNull(), folded(F.concat(prefix, F.substring(inc, F.length(head) + 1, F.length(inc)))))
    ways = F.array(F.struct(F.lit(0).alias("stage"), relative.alias("target")), F.struct(F.lit(1).alias("stage"), alias.alias("target")))
    tried = refs.select("ref_id", "path", "kind", "name", F.inline(ways)).filter("target IS NOT NULL").filter(top("target") == top("path"))
    there = files.select(F.col("path").alias("target"), "kind", "name").distinct()
    hit = tried.join(there, ["target", "kind", "name"]).select("ref_id", "stage", "target")
    if copy_paths:
        places = F.array(*[F.struct(F.lit(k + 2).alias("stage"), F.lit(p.strip("/")).alias("prefix")) for k, p in enumerate(copy_paths)])
        below = files.select("path", "kind", "name", F.inline(places)).filter(F.startswith("path", F.concat("prefix", F.lit("/"))))
        # counted by name and folder before refs come in
        alone = below.groupBy("kind", "name", "stage", top("prefix").alias("top")).agg(F.count_distinct("path").alias("n"), F.min("path").alias("target")).filter("n = 1")
        more = refs.select("ref_id", "kind", "name", top("path").alias("top")).join(alone, ["kind", "name", "top"])
        hit = hit.unionByName(more.select("ref_id", "stage", "target"))
    best = hit.groupBy("ref_id").agg(F.min(F.struct("stage", "target")).alias("b"))
    how = F.when(F.col("b.stage") == 0, "relative").when(F.col("b.stage") == 1, "alias").when(F.col("b.stage") > 1, "copy_path")
    return refs.select("ref_id").join(best, "ref_id", "left").select("ref_id", F.col("b.target").alias("target"), how.alias("how"))


def labelled(relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels (id, root, parent, level, low, high) of the forest of relations (child, parent), and what isn't in it (id, reason).

    The subtypes of a type are those of its root with ``low`` in (its low, its high]. A child with several parents is
    ambiguous: it is reported and begins a tree of its own; types in a circle and below it are reported only. Levels are found from the roots, sizes
    added up from the leaves, and each child's range begins behind those of its smaller siblings; one written table a level and way.
    """
    spark = relations.sparkSession
    with Scratch(spark, "types") as s:
        rel = s.save(relations.select("child", "parent").filter("child IS NOT NULL AND parent IS NOT NULL").distinct(), "relations")
        several = s.keep(rel.groupBy("child").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("child").alias("id")), "ambiguous")
        one = s.save(rel.join(several.withColumnRenamed("id", "child"), "child", "left_anti"), "single")
        every = rel.select(F.col("child").alias("id")).union(rel.select("parent")).distinct()
        roots = every.join(one.select(F.col("child").alias("id")), "id", "left_anti")
        none = F.lit(None).cast(rel.schema["parent"].dataType)
        levels = [s.save(roots.select("id", F.col("id").alias("root"), none.alias("parent")), "level")]
        while not levels[-1].isEmpty():
            down = levels[-1].select(F.col("id").alias("parent"), "root").join(one, "parent")
            levels.append(s.save(down.select(F.col("child").alias("id"), "root", "parent"), "level"))
        levels.pop()
        sized, below = [], None
        for at in reversed(levels):
            if below is None:
                now = at.withColumn("size", F.lit(1).cast("long"))
            else:
                sums = below.groupBy(F.col("parent").alias("id")).agg(F.sum("size").alias("more"))
                now = at.join(sums, "id", "left").select("id", "root", "parent", (1 + F.coalesce("more", F.lit(0))).alias("size"))
            below = s.save(now, "sizes")
            sized.append(below)
        before = F.coalesce(F.sum("size").over(Window.partitionBy("parent").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out, above = [], None
        for k, now in enumerate(reversed(sized)):
            if above is None:
                low = now.withColumn("low", F.lit(0).cast("long"))
            else:
                low = now.withColumn("before", before).join(above.select(F.col("id").alias("parent"), F.col("low").alias("start")), "parent").withColumn("low", F.col("start") + 1 + F.col("before"))
            above = s.keep(low.select("id", "root", "parent", F.lit(k).alias("level"), "low", (F.col("low") + F.col("size") - 1).alias("high")), "labels")
            out.append(above)
        found = out[0] if out else None
        for part in out[1:]:
            found = found.unionByName(part)
        if found is None:
            found = every.select("id", F.col("id").alias("root"), none.alias("parent"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high")).limit(0)
        circles = s.keep(every.join(found.select("id"), "id", "left_anti").withColumn("reason", F.lit("circular")), "circular")
    return found, several.withColumn("reason", F.lit("ambiguous")).unionByName(circles)


def subtypes(labels: DataFrame, of: DataFrame) -> DataFrame:
    """(id, subtype, direct): all types below those in ``of`` (id), by their ranges."""
    top = labels.join(of.select("id").distinct(), "id").select(F.col("id").alias("type"), "root", F.col("low").alias("a"), F.col("high").alias("b"))
    met = labels.join(top, "root").filter((F.col("low") > F.col("a")) & (F.col("low") <= F.col("b")))
    return met.select(F.col("type").alias("id"), F.col("id").alias("subtype"), (F.col("parent") == F.col("type")).alias("direct"))
