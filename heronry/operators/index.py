"""A stored keyword index: postings with positions by field, in buckets of terms, changed by whole documents.

An index is a folder. Each change writes a segment of its own: ``postings`` (field, term, doc, tf, dl, positions) in folders by bucket,
which is the CRC-32 of the term modulo the index's number of buckets, sorted by term; ``lengths`` (doc, field, dl); and ``gone``
(doc) of the documents that it takes the place of or removes. A commit is a small file with the next number, made only if
no other has it, that lists the segments in order and sums of documents and lengths by field; readers take the last one. So a
change that fails, or is not committed, leaves all rows as they were, and two writers can't both win.

A search reads the buckets of its terms and, of their row groups, those that may hold the terms. Postings of a document count
if no later segment has it in ``gone``. Scores are BM25 by field, with the best field in full and the others by a share.
Null texts have no terms but are documents; a null key isn't indexed.
"""

from __future__ import annotations

import json
import zlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.session import file_system, put_new

TERM = r"([a-z0-9_]+)"
BUCKETS = 64
#: Rows of one bucket's file, about.
SPREAD_ROWS = 5_000_000
#: Weights of the fields of a chunk, and the share of fields that aren't the best.
FIELDS = {"text": 1.0, "labels": 0.3, "region_context": 0.3}
TIE = 0.1


class Conflict(Exception):
    """Another writer has committed in the meantime."""


def _commits(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    p, fs = file_system(spark, f"{root}/commits")
    return sorted((int(s.getPath().getName().split(".")[0]), s.getPath().toString()) for s in fs.listStatus(p)) if fs.exists(p) else []


def state(spark: SparkSession, root: str) -> dict:
    """The last whole commit: buckets, segments, fields' sums; and the last number that is taken, also by one that was cut off."""
    made = _commits(spark, root)
    for _, path in reversed(made):
        text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
        if text.endswith("\n"):
            return json.loads(text) | {"number": made[-1][0]}
    return {"number": made[-1][0] if made else 0, "buckets": BUCKETS, "segments": [], "sums": {}}


def commit(spark: SparkSession, root: str, old: dict, new: dict) -> None:
    """Make ``new`` the state after ``old``; a Conflict if another one is by now."""
    if not put_new(spark, f"{root}/commits/{old['number'] + 1:012d}.json", json.dumps(new)):
        raise Conflict(f"commit {old['number'] + 1} of {root} exists")


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def postings(docs: DataFrame, key: str, fields: list[str], term: str = TERM) -> DataFrame:
    """(doc, field, dl, term, tf, positions) of lower-case terms.

    A document's terms are sorted and cut into runs within its row, so that nothing is exchanged for it.
    """
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.regexp_extract_all(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(term), 1).alias("t")) for f in fields])
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.inline(each)).filter(F.size("t") > 0)
    # arrays are bound by lambdas, so that each is made once
    run = lambda x, at, to: F.struct(x[at]["term"].alias("term"), (to - at).alias("tf"), F.transform(F.slice(x, at + 1, to - at), lambda y: y["pos"]).alias("positions"))
    first = lambda x: F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (x[i]["term"] != x[F.greatest(i - 1, F.lit(0))]["term"]))
    cut = lambda x: F.transform(F.array(first(x)), lambda at: F.transform(at, lambda i, k: run(x, i, F.coalesce(F.get(at, k + 1), F.size(x)))))
    ordered = F.array_sort(F.transform("t", lambda w, i: F.struct(w.alias("term"), i.alias("pos"))))
    runs = F.flatten(F.flatten(F.transform(F.array(ordered), cut)))
    return rows.select("doc", "field", F.size("t").alias("dl"), F.inline(runs))


def _sums(lengths: DataFrame) -> dict:
    return {r.field: [r.n, r.total] for r in lengths.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total")).collect()}


def change(spark: SparkSession, root: str, docs: DataFrame | None, key: str = "doc_id", fields: list[str] | None = None, removed: DataFrame | None = None, buckets: int = BUCKETS) -> dict:
    """Put whole documents in the place of those with their keys, or add them, and remove the keys of ``removed``; one commit."""
    old = state(spark, root)
    buckets = old["buckets"] if old["segments"] else buckets
    to = f"{root}/segments/{old['number'] + 1:012d}-{spark.range(1).select(F.expr('uuid()')).first()[0]}"
    part: dict = {"path": to}
    keys = [] if removed is None else [removed.select(F.col(key).alias("doc"))]
    sums = {f: list(v) for f, v in old["sums"].items()}
    if docs is not None:
        fields = fields or ["text"]
        lengths = F.array(*[F.struct(F.lit(f).alias("field"), F.size(F.regexp_extract_all(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(TERM), 1)).alias("dl")) for f in fields])
        docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.inline(lengths)).write.parquet(f"{to}/lengths")
        made = spark.read.parquet(f"{to}/lengths")
        added = _sums(made)
        spread = max(1, sum(t for _, t in added.values()) // (SPREAD_ROWS * buckets) + 1)
        rows = postings(docs, key, fields).withColumn("bucket", F.pmod(F.crc32("term"), F.lit(buckets)).cast("int"))
        rows = rows.repartition(min(buckets * spread, 4096), "bucket", F.pmod(F.xxhash64("doc"), F.lit(spread))).sortWithinPartitions("bucket", "term", "doc")
        rows.write.partitionBy("bucket").parquet(f"{to}/postings")
        part["postings"] = part["lengths"] = True
        keys.append(made.select("doc").distinct())
        for f, (n, total) in added.items():
            sums[f] = [a + b for a, b in zip(sums.get(f, [0, 0]), (n, total))]
    if old["segments"] and keys:
        have = _lengths(spark, old).join(reduce(DataFrame.unionByName, keys).distinct(), "doc", "left_semi")
        have.select("doc").distinct().write.parquet(f"{to}/gone")
        for f, (n, total) in _sums(have).items():
            sums[f] = [sums[f][0] - n, sums[f][1] - total]
        part["gone"] = True
    new = {"buckets": buckets, "segments": [*old["segments"], part], "sums": sums}
    commit(spark, root, old, new)
    return new


def _live(spark: SparkSession, at: dict, rows: DataFrame) -> DataFrame:
    """Rows (doc, segment, ...) that no later segment has taken away."""
    gone = [spark.read.parquet(f"{s['path']}/gone").withColumn("until", F.lit(k)) for k, s in enumerate(at["segments"]) if s.get("gone")]
    if not gone:
        return rows
    last = reduce(DataFrame.unionByName, gone).groupBy("doc").agg(F.max("until").alias("until"))
    return rows.join(last, "doc", "left").filter("until IS NULL OR segment >= until").drop("until")


def _read(spark: SparkSession, at: dict, what: str, keep=None) -> DataFrame:
    """All segments' tables of one name, each cut by ``keep`` before they meet."""
    parts = [spark.read.parquet(f"{s['path']}/{what}").withColumn("segment", F.lit(k)) for k, s in enumerate(at["segments"]) if s.get(what)]
    return reduce(DataFrame.unionByName, parts if keep is None else map(keep, parts))


def _lengths(spark: SparkSession, at: dict) -> DataFrame:
    return _live(spark, at, _read(spark, at, "lengths"))


def matches(spark: SparkSession, root: str, terms: list[str], at: dict | None = None) -> DataFrame:
    """Live postings of the terms; only their buckets are read."""
    at = at or state(spark, root)
    held = sorted({bucket_of(t, at["buckets"]) for t in terms})
    return _live(spark, at, _read(spark, at, "postings", lambda p: p.filter(F.col("bucket").isin(held) & F.col("term").isin(terms))))


def search(spark: SparkSession, root: str, terms: list[str], k: int = 10, weights: dict[str, float] | None = None, tie: float = TIE, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc, score): top k by BM25 over the fields of ``weights`` (text only if None)."""
    at, weights = state(spark, root), weights or {"text": 1.0}
    found = matches(spark, root, terms, at).filter(F.col("field").isin(*weights))
    df = found.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))  # terms times fields
    sums = {f: v for f, v in at["sums"].items() if f in weights}
    of = lambda i: F.element_at(F.create_map(*[F.lit(x) for f, v in sums.items() for x in (f, float(v[0] if i == 0 else v[1] / max(v[0], 1)))]), F.col("field"))
    idf = F.log(1 + (of(0) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / of(1)))
    weight = F.element_at(F.create_map(*[F.lit(x) for f, w in weights.items() for x in (f, float(w))]), F.col("field"))
    per = found.join(F.broadcast(df), ["field", "term"]).groupBy("doc", "field").agg(F.sum(part).alias("s")).withColumn("s", F.col("s") * weight)
    scored = per.groupBy("doc").agg(F.round(F.max("s") + tie * (F.sum("s") - F.max("s")), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "doc").limit(k)


def phrase(spark: SparkSession, root: str, words: list[str], field: str = "text") -> DataFrame:
    """(doc, n): how often the words follow each other in a field."""
    found = matches(spark, root, sorted(set(words))).filter(F.col("field") == field)
    begins = lambda k: found.filter(F.col("term") == words[k]).select("doc", F.transform("positions", lambda p: p - k).alias(f"p{k}"))
    at = begins(0).withColumnRenamed("p0", "p")
    for k in range(1, len(words)):
        at = at.join(begins(k), "doc").select("doc", F.array_intersect("p", f"p{k}").alias("p"))
    return at.select("doc", F.size("p").alias("n")).filter("n > 0")
