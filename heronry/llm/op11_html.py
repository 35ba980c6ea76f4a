"""Main text of web pages by wrappers that are inferred for each host.

A page becomes a tree of blocks; neighbours that repeat are folded, and what is left without the texts is
the page's skeleton, with numbered slots for text. A host's distinct skeletons are aligned
one after the other: a mismatch makes what only one of them has optional, or, where it repeats what stands beside it, a
repeated item or group. The result is the host's wrapper, a regular expression without unions. Each slot
carries how often it occurs, the least and greatest hash of its texts and its characters, in links and in all; these add up
exactly, so a slot that has the same text on every page is known without holding texts together. The slots
that hold the article are chosen once for each wrapper (``html_tree.chosen``), and each skeleton learns from it which of its slots to keep.

Pages are counted by host and skeleton before anything is exchanged. Skeletons of a host meet at most
some ``FAN_IN`` at a time, in groups by a hash, and the wrappers of the groups again in further rounds, in an order that only depends on
them; so neither the pages nor the skeletons of one host come together, and results don't depend on partitions. A
wrapper's elements are bounded (``html_tree.MOST``). Pages join the marks of their skeleton by host and digest, a join that Spark can split.

A null html is empty and has empty text, as has a page without blocks; a null url, or one without host, belongs to the host ''; equal pages have equal texts and
each row gives one; a page that is alone on its host has its own skeleton as wrapper; extra
columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronry.llm import html_tree as H
from heronry.llm.common import Scratch, sliced, small_batches

FAN_IN = 32
#: Skeletons that a task holds before it hands them on.
HELD = 4096
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_string, _long = T.StringType(), T.LongType()
_slot = T.StructType([T.StructField(n, _long) for n in ("n", "lo", "hi", "chars", "links")])


def host_of(url) -> F.Column:
    """Host of an address, in lower case; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), HOST, 1)), F.lit(""))


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def skeletons(pages: DataFrame) -> DataFrame:
    """(host, key, tree, pages, slots) of pages (host, html); several rows may have one host and key."""
    schema = T.StructType([T.StructField(n, _string) for n in ("host", "key", "tree")] + [T.StructField("pages", _long), T.StructField("slots", T.ArrayType(_slot))])
    arrow = pa.schema([("host", pa.string()), ("key", pa.string()), ("tree", pa.string()), ("pages", pa.int64()), ("slots", pa.list_(pa.struct([(n, pa.int64()) for n in _slot.names])))])

    def out(held):
        rows = [{"host": h, "key": k, "tree": tree, "pages": n, "slots": [dict(zip(_slot.names, s)) for s in stats]} for (h, k), (tree, n, stats) in held.items()]
        return pa.RecordBatch.from_pylist(rows, schema=arrow)

    def run(batches):
        held: dict[tuple, list] = {}
        for b in batches:
            for hosts, texts in sliced(b):
                for host, html in zip(hosts.to_pylist(), texts):
                    key, tree, blocks = H.skeleton(html)
                    at = held.setdefault((host, key), [tree, 0, []])
                    at[1] += 1
                    for slot, text, links in blocks:
                        while len(at[2]) <= slot:
                            at[2].append([0, (1 << 63) - 1, -(1 << 63), 0, 0])
                        s, h = at[2][slot], _hash(text)
                        at[2][slot] = [s[0] + 1, min(s[1], h), max(s[2], h), s[3] + len(text), s[4] + links]
            if len(held) >= HELD:
                yield out(held)
                held = {}
        yield out(held)

    small_batches(pages.sparkSession)
    return pages.select("host", "html").mapInArrow(run, schema)


def with_stats(found: DataFrame) -> DataFrame:
    """One row a host and key; what slots carry is added up."""
    key = ["host", "key"]
    each = found.select(*key, F.posexplode("slots").alias("at", "s")).groupBy(*key, "at")
    each = each.agg(F.sum("s.n").alias("n"), F.min("s.lo").alias("lo"), F.max("s.hi").alias("hi"), F.sum("s.chars").alias("chars"), F.sum("s.links").alias("links"))
    slots = each.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", *_slot.names))).alias("slots"))  # as many as a page has
    trees = found.groupBy(*key).agg(F.min("tree").alias("tree"), F.sum("pages").alias("pages"))
    return trees.join(slots, key, "left")


def _first(tree: str, stats) -> H.Item:
    root = H.load(json.loads(tree))
    at = {} if stats is None else {s["at"]: [int(s[n]) for n in _slot.names] for s in stats}
    for k, slot in enumerate(H.slots(root)):
        slot.stats = at.get(k)
    return root


def wrappers(found: DataFrame, scratch: Scratch, fan_in: int = FAN_IN) -> DataFrame:
    """(host, wrapper, pages) of skeletons (host, key, tree, pages, slots): one round for each power of ``fan_in`` in the largest host's number."""
    schema = "host string, bucket long, wrapper string, pages long"
    per = found.groupBy("host").agg(F.count(F.lit(1)).alias("count"))
    most = per.agg(F.max("count")).first()[0] or 0

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pages", "order"], ascending=[False, True])
        root = None
        for tree, stats in zip(rows["tree"], rows["slots"] if "slots" in rows else [None] * len(rows)):
            new = _first(tree, stats) if "slots" in rows else H.load(json.loads(tree))
            if root is None:
                root = new
            else:
                H.merge(root, new)
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "bucket": [rows["bucket"].iloc[0]], "wrapper": [json.dumps(H.dump(root), separators=(",", ":"), ensure_ascii=False)], "pages": [int(rows["pages"].sum())]})

    buckets = F.ceil(F.col("count") / fan_in).cast("long")
    at = found.join(per, "host").withColumn("bucket", F.pmod(F.xxhash64("key"), buckets)).withColumnRenamed("key", "order").drop("count")
    at = scratch.save(at.groupBy("host", "bucket").applyInPandas(joined, schema), "wrappers")
    while most > fan_in:
        most = -(-most // fan_in)
        per = at.groupBy("host").agg(F.count(F.lit(1)).alias("count"))
        next_ = at.withColumnRenamed("wrapper", "tree").withColumn("order", F.format_string("%020d", "bucket")).join(per, "host")
        next_ = next_.withColumn("bucket", F.pmod(F.xxhash64("bucket"), buckets)).drop("count")
        at = scratch.save(next_.groupBy("host", "bucket").applyInPandas(joined, schema), "wrappers")
    return at.select("host", "wrapper", "pages")


def marks(found: DataFrame, made: DataFrame) -> DataFrame:
    """(host, key, keep): for each slot of a skeleton 1 or 0, whether it holds main text."""
    schema = T.StructType([T.StructField(n, _string) for n in ("host", "key", "keep")])

    def run(batches):
        for b in batches:
            keep, last, root = [], None, None
            for tree, stats, wrapper in zip(b["tree"].to_pylist(), b["slots"].to_pylist(), b["wrapper"].to_pylist()):
                if wrapper != last:
                    last, root = wrapper, H.load(json.loads(wrapper))
                keep.append(H.kept(root, _first(tree, stats)))
            yield pa.RecordBatch.from_arrays([b["host"], b["key"], pa.array(keep, pa.string())], names=schema.names)

    return found.join(made.select("host", "wrapper"), "host").select("host", "key", "tree", "slots", "wrapper").mapInArrow(run, schema)


def blocks(pages: DataFrame, carry: list[str]) -> DataFrame:
    """Columns ``carry`` of pages (host, html, *carry), with host, key and the page's blocks (slot, text)."""
    block = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("text", _string)])
    schema = T.StructType([T.StructField(n, _string) for n in ("host", "key")] + [T.StructField("blocks", T.ArrayType(block))] + [pages.schema[c] for c in carry])
    list_type = pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string())]))

    def run(batches):
        for b in batches:
            at = 0
            for hosts, texts in sliced(b):
                got = [H.skeleton(t) for t in texts]
                each = pa.array([[{"slot": s, "text": t} for s, t, _ in found] for *_, found in got], list_type)
                rest = [b.column(2 + k).slice(at, len(texts)) for k in range(len(carry))]
                at += len(texts)
                yield pa.RecordBatch.from_arrays([hosts, pa.array([k for k, *_ in got], pa.string()), each, *rest], names=schema.names)

    small_batches(pages.sparkSession)
    return pages.select("host", "html", *carry).mapInArrow(run, schema)


def _pages(pages: DataFrame, html_col: str, url_col: str, *more) -> DataFrame:
    return pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"), *more)


def infer(pages: DataFrame, html_col: str = "html", url_col: str = "url", fan_in: int = FAN_IN) -> DataFrame:
    """(host, pages, wrapper): the wrapper of each host as a regular expression over elements and slots (#)."""
    with Scratch(pages.sparkSession, "wrappers") as s:
        found = s.save(with_stats(skeletons(_pages(pages, html_col, url_col))), "skeletons")
        made = s.keep(wrappers(found, s, fan_in), "made")
    written = F.udf(lambda w: H.regex(H.load(json.loads(w))))
    return made.select("host", "pages", written("wrapper").alias("wrapper"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", fan_in: int = FAN_IN) -> DataFrame:
    """Per row of ``pages``: id, url, text, n_chars."""
    spark = pages.sparkSession
    with Scratch(spark, "html") as s:
        found = s.save(with_stats(skeletons(_pages(pages, html_col, url_col))), "skeletons")
        keep = s.keep(marks(found, s.save(wrappers(found, s, fan_in), "made")), "marks")
    each = blocks(_pages(pages, html_col, url_col, F.col(id_col).alias("__id"), F.col(url_col).alias("__url")), ["__id", "__url"])
    at = each.join(keep, ["host", "key"], "left")
    some = F.filter("blocks", lambda b: F.substring(F.col("keep"), b["slot"] + 1, F.lit(1)) == "1")
    text = F.coalesce(F.array_join(F.transform(some, lambda b: b["text"]), "\n"), F.lit(""))
    return at.select(F.col("__id").alias(id_col), F.col("__url").alias(url_col), text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
