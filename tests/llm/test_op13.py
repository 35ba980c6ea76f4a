import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from heronry.llm import op13_resample as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, percent=10, least=20, buckets=10_000, longest=1, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, features(x, longest)[1]))
    for x in target:
        t.update(map(bucket, features(x, longest)[1]))
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets))))
    out = []
    for i, x in docs:
        words, found = features(x, longest)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    may = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def corpus(n):
    rng = random.Random(11)
    vocabulary = ["a", "Bb", "é", "日本", "x1", "don't", "Z\x7fz", "\x00q", "ÀB"] + [f"w{i}" for i in range(300)]
    docs = [(i, rng.choice([None, "", " .,", "only"]) if i % 17 == 0 else " ".join(rng.choices(vocabulary, k=rng.randint(1, 90)))) for i in range(n)]
    docs += [(None, "w1 " * 30), (3, docs[3][1]), (3, docs[3][1]), (n, "w7 w8 " * 200_000)]
    return docs, ["w1 w2 w3 Bb", None, "", "w4 " * 50]


@pytest.mark.parametrize("longest, buckets, percent", [(1, 10_000, 10), (3, 50, 35)])
def test_against_brute_force(spark, longest, buckets, percent):
    docs, target = corpus(300)
    d = spark.createDataFrame([(i, t, 1.5, "x") for i, t in docs], "doc_id long, text string, Score double, rank string").repartition(5)
    b = spark.createDataFrame([(t,) for t in target], "text string")
    got = op.importance_resample(d, b, percent=percent, longest=longest, buckets=buckets)
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, target, percent, longest=longest, buckets=buckets)


def test_empty(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert op.importance_resample(d, b).collect() == []
    one = spark.createDataFrame([(1, "w " * 40)], "doc_id long, text string")
    assert [tuple(r) for r in op.importance_resample(one, b, percent=100).collect()] == plain([(1, "w " * 40)], [], 100)


def test_query_equals_sql(spark):
    import duckdb

    from heronry.llm import queries

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.queries()["op13_importance_resample"](spark, sf)
    want = c.execute(queries.oracle_sql()["op13_importance_resample"]).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
