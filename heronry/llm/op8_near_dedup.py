"""Near-duplicate detection by MinHash with one permutation.

A text's set holds the 64-bit hashes of its five-word shingles; texts with equal
sets are one class. A class's signature comes from
one hash function: ``BINS`` ranges of hashes, the smallest one in each, and empty
ranges filled by optimal densification (each tries the same pseudo-random ranges in
every text until it finds one that isn't empty). ``BANDS`` groups of values are
the buckets: at a similarity of 0.85 eight values agree with probability 0.27, so a
pair misses all 48 buckets with probability 3e-7.

Candidates are stars: each other member of a bucket with the one that meets most
others over all buckets, the smallest number if equal; of many variants of a text that is
most likely the text itself. All are confirmed on full sets. Members of one bucket that
stay in different components after that may still be linked to each other, so a second
pass looks for pairs of different components among all members of such buckets. Each brings its full set. Sets
meet by their rarest hashes (``prefixes``), of which two similar ones share one at places that both sizes allow; what no
other set has comes first, so that variants of one text that have more of their own than the share leaves never meet,
however many they are and however long. Pairs that met are compared by sketches, the ``SKETCH`` smallest hashes of each
set: sets no larger than that exactly; of larger ones at least ``LEAST`` of the smallest hashes of the union are common at
0.85 but for a probability of 1e-8. What passes is confirmed on the full sets.
Components come from minimum labels with pointer jumping; each step is a
written table, deleted after use. Joins on hot keys have an exchange on both sides, so that Spark
splits skewed ones.

Defined results: a null text counts as empty; a text without words has an empty set, is
linked with nothing and kept; one of 1 to 4 words has one shingle, all of it; a null
id is linked like others but never represents a component, unless all of its ids are null; rows
with equal ids and other texts are rows of their own, each in its text's component; rows with
equal ids and texts share their fate; other columns aren't read; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronry.llm.common import Scratch, id_field, map_texts, sieve
from heronry.llm.words import mixed, word_hashes

WORDS, PERCENT = 5, 85
BINS, BANDS = 384, 48
ROWS = BINS // BANDS
#: Hashes in a sketch, and how many of those of a union two similar large sets have in common at least.
SKETCH, LEAST = 512, 381
_rng = np.random.default_rng(8)
_PLACE = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROW = _rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64)
_TRIES = _rng.integers(0, BINS, (4 * BINS, BINS))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, first = word_hashes(texts)
    n = max(0, len(words) - WORDS + 1)
    every = np.zeros(n, dtype=np.uint64)
    for i in range(WORDS):
        every += words[i : i + n] * _PLACE[i]
    every = mixed(every)
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(every[a : b - WORDS + 1]))
        elif b > a:
            out.append(mixed((words[a:b] * _PLACE[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of a sorted set that isn't empty, densified."""
    bins = ((s >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    head = np.concatenate(([True], bins[1:] != bins[:-1]))
    have = bins[head].astype(np.int64)
    sig = np.zeros(BINS, dtype=np.uint64)
    full = np.zeros(BINS, dtype=bool)
    sig[have], full[have] = s[head], True
    if len(have) == 1:
        sig[:] = s[0]
        return sig
    empty, own = np.flatnonzero(~full), sig.copy()
    for tries in _TRIES:
        if not len(empty):
            return sig
        from_ = tries[empty]
        ok = full[from_]
        sig[empty[ok]] = own[from_[ok]]
        empty = empty[~ok]
    sig[empty] = s[0]
    return sig


def buckets(s: np.ndarray) -> np.ndarray:
    """Bucket keys of a set, one for each band."""
    rows = mixed(signature(s).reshape(BANDS, ROWS) * _ROW)
    return mixed(rows.sum(axis=1) + _BAND).view(np.int64)


def _key(s: np.ndarray) -> bytes | None:
    """The name of a set; null if empty."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, n_shingles, key of the set (null if empty) and its bucket keys."""
    schema = T.StructType([id_field(docs, id_col), T.StructField("n", T.IntegerType()), T.StructField("key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def work(ids, texts):
        sets = shingle_sets(texts)
        return {
            id_col: ids,
            "n": [len(s) for s in sets],
            "key": [_key(s) for s in sets],
            "bands": [buckets(s) if len(s) else None for s in sets],
        }

    return map_texts(docs, work, schema, id_col, text_col).withColumnRenamed(id_col, "id")


def sets_of(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, set) for ``nodes`` (node, id, key): the text of each is a row with that id whose set has that key."""
    two = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"))
    wanted = nodes.join(sieve(two, "__id", nodes, "id"), F.col("id").eqNullSafe(F.col("__id"))).select(F.struct("node", "key").alias("name"), "text")
    schema = T.StructType([T.StructField("name", wanted.schema["name"].dataType), T.StructField("set", T.ArrayType(T.LongType()))])

    def work(names, texts):
        sets = shingle_sets(texts)
        return {"name": names, "set": [s.view(np.int64) if _key(s) == k else None for s, k in zip(sets, names.field("key").to_pylist())]}

    found = map_texts(wanted, work, schema, "name", "text").filter("set IS NOT NULL")
    return found.select("name.node", "set").dropDuplicates(["node"])


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (node, set) are similar enough."""
    left = pairs.select("a", "b").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    both = left.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    return both.filter(100 * common >= PERCENT * union).select("a", "b")


def confirm(s: Scratch, docs: DataFrame, classes: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    nodes = s.save(classes.select("node", "id", "key").join(nodes, "node", "left_semi"), "nodes")
    sets = s.save(sets_of(docs, nodes, id_col, text_col), "sets")
    links = s.save(similar(pairs, sets), "links")
    s.drop(sets, nodes)
    return links


def components(s: Scratch, links: DataFrame) -> DataFrame:
    """(node, comp) for all nodes of the links; comp is the smallest node reachable."""
    links = s.save(links.union(links.select("b", "a")).distinct(), "both-ways")
    labels = s.save(links.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("comp")), "labels")
    while True:
        seen = links.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        near = labels.join(seen, "node").select("node", F.least("comp", "near").alias("near"), F.col("comp").alias("old"))
        near = s.save(near, "step")
        up = near.select(F.col("node").alias("near"), F.col("near").alias("up"))
        jumped = s.save(near.join(up, "near").select("node", F.least("near", "up").alias("comp"), "old"), "labels")
        s.drop(labels, near)
        labels = jumped
        if jumped.filter("comp < old").isEmpty():
            s.drop(links)
            return jumped.select("node", "comp")


def stars(s: Scratch, classes: DataFrame) -> DataFrame:
    """(bucket, node, n, head, head_n) for the members of buckets with several."""
    rows = classes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    met = s.save(rows.join(shared, "bucket"), "met")
    meets = met.groupBy("node").agg(F.sum("m").alias("meets"))
    ranked = s.save(met.join(meets, "node").drop("m"), "ranked")
    first = F.min(F.struct((-F.col("meets")).alias("less"), "node", "n"))
    heads = ranked.groupBy("bucket").agg(first.alias("h")).select("bucket", F.col("h.node").alias("head"), F.col("h.n").alias("head_n"))
    members = s.save(ranked.join(s.save(heads, "heads"), "bucket").drop("meets"), "members")
    s.drop(met, ranked)
    return members


def _close(x, y):
    """Whether sizes alone allow the similarity."""
    return 100 * F.least(x, y) >= PERCENT * F.greatest(x, y)


def prefixes(s: Scratch, each: DataFrame) -> DataFrame:
    """(token, node, n, comp, pos): for each row (node, n, comp, set) the rarest of its hashes with their places, one of which any similar set has among its own rarest.

    Two sets with ``need`` hashes in common share one of the first n - need + 1 in any order that holds for all;
    hashes go by how many sets have them, so that a template's come last. Those that no other has only count.
    """
    tokens = s.save(each.select("node", F.explode("set").alias("token")), "tokens")
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    order = tokens.join(often, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("m", "token"))).alias("order"))
    at = each.select("node", "n", "comp").join(order, "node").withColumn("alone", F.col("n") - F.size("order"))
    most = F.floor(F.col("n") * (100 - PERCENT) / 100).cast("int") + 1 - F.col("alone")
    first = at.select("node", "n", "comp", "alone", F.posexplode(F.slice("order", F.lit(1), F.greatest(most, F.lit(0)))).alias("at", "p"))
    return first.select("p.token", "node", "n", "comp", (F.col("alone") + F.col("at")).alias("pos"))


def across(s: Scratch, docs: DataFrame, classes: DataFrame, members: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) between different components, of the members of buckets that hold several."""
    at = s.save(members.join(labels, "node", "left").select("bucket", "node", "n", F.coalesce("comp", "node").alias("comp")), "open")
    kinds = at.groupBy("bucket").agg(F.min("comp").alias("one"), F.max("comp").alias("other")).filter("one < other").select("bucket")
    rest = s.save(at.join(kinds, "bucket").select("node", "n", "comp").distinct(), "rest")
    sets = sets_of(docs, classes.select("node", "id", "key").join(rest.select("node"), "node"), id_col, text_col)
    each = s.save(rest.join(sets, "node"), "rest-sets")
    first = s.save(prefixes(s, each), "prefixes")
    largest = first.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("size")).groupBy("token").agg(F.max(F.struct("size", "comp"))["comp"].alias("largest"), F.count(F.lit(1)).alias("kinds"))
    open_ = s.save(first.join(largest.filter("kinds > 1").drop("kinds"), "token"), "met")
    c = open_.filter("comp <> largest").select("token", *[F.col(x).alias(f"c_{x}") for x in ("node", "n", "comp", "pos")])
    #: The first common hash has at least as many from itself on, in both orders, as two sets of these sizes need in common.
    left = F.least(F.col("n") - F.col("pos"), F.col("c_n") - F.col("c_pos"))
    placed = (100 + PERCENT) * left >= PERCENT * (F.col("n") + F.col("c_n"))
    #: Once also where both are outside the largest component.
    once = (F.col("comp") == F.col("largest")) | (F.col("node") < F.col("c_node"))
    met = open_.join(c, "token").filter((F.col("comp") != F.col("c_comp")) & once & placed)
    pairs = s.save(met.select(F.least("node", "c_node").alias("a"), F.greatest("node", "c_node").alias("b")).distinct(), "candidates")
    of = lambda k, x, n: each.select(F.col("node").alias(k), F.slice("set", 1, SKETCH).alias(x), F.col("n").alias(n))
    both = pairs.join(of("b", "y", "m"), "b").join(of("a", "x", "n"), "a")
    common = F.size(F.array_intersect("x", "y"))
    small = 100 * common >= PERCENT * (F.col("n") + F.col("m") - common)
    alike = s.save(both.filter(F.when(F.greatest("n", "m") <= SKETCH, small).otherwise(common >= LEAST)).select("a", "b"), "alike")
    out = s.save(similar(alike, each.select("node", "set")), "across")
    s.drop(at, rest, each, first, open_, pairs, alike)
    return out


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id, kept."""
    with Scratch(docs.sparkSession, "near") as s:
        sigs = s.save(signatures(docs, id_col, text_col), "signatures")
        rows = s.keep(sigs.select("id", "n", "key"), "rows")
        classes = sigs.filter("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        classes = s.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
        s.drop(sigs)
        members = stars(s, classes)
        tried = members.filter((F.col("node") != F.col("head")) & _close(F.col("n"), F.col("head_n"))).select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
        links = confirm(s, docs, classes, s.save(tried, "pairs"), id_col, text_col)
        labels = components(s, links)
        second = across(s, docs, classes, members, labels, id_col, text_col)
        if not second.isEmpty():
            labels = components(s, links.union(second))
        comps = classes.join(labels, "node", "left").select("key", "id", F.coalesce("comp", "node").alias("comp"))
        named = comps.groupBy("comp").agg(F.min("id").alias("component"))
        found = s.keep(comps.join(named, "comp").select("key", "component"), "found")
    out = rows.join(found, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
