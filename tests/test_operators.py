"""Operators without a query: publishing, streams, chains, nearest resolution's rules."""

import pytest
from pyspark.sql import functions as F

from heronry.functions import scalars as S
from heronry.operators import build, graph, maintenance, search, text, usage
from heronry.streaming import events as stream


def test_publish_moves_the_pointer(spark, tmp_path):
    root = str(tmp_path)
    maintenance.publish(spark.range(3), root, "t", "1")
    maintenance.publish(spark.range(5), root, "t", "2")
    assert maintenance.current(spark, root, "t").count() == 5
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        maintenance.publish(spark.range(9), root, "t", "2")
    assert maintenance.current(spark, root, "t").count() == 5  # a failed write leaves the old one


def test_stream_windows_equal_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(f"{tmp_path}/in")
    out = stream.windowed(stream.read_events(spark, f"{tmp_path}/in", e.schema))
    q = out.writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    want = e.groupBy(F.window("ts", "1 hour"), "event_type").count()
    assert spark.table("w").agg(F.sum("n")).first()[0] == e.count() and spark.table("w").count() == want.count()


def test_nearest_statuses(spark):
    defs = spark.createDataFrame([(1, "a/x/f", "k", "n"), (2, "a/y/f", "k", "n"), (3, "b/f", "k", "only_b")], "def_id long, path string, kind string, name string")
    refs = spark.createDataFrame([(1, "a/x/g", "k", "n"), (2, "a/z/g", "k", "n"), (3, "a/g", "k", "only_b"), (4, "a/g", "k", "none")], "ref_id long, path string, kind string, name string")
    got = {r.ref_id: (r.def_id, r.status) for r in graph.nearest(refs, defs).collect()}
    assert got == {1: (1, "resolved"), 2: (None, "ambiguous"), 3: (None, "cross_scope"), 4: (None, "unresolved")}


def test_impact_reports_what_lies_beyond(spark):
    e = spark.createDataFrame([(2, 1), (3, 2), (4, 3)], "src long, dst long")
    one = spark.createDataFrame([(1,)], "id long")
    assert graph.impact(e, one, 2)[1] and not graph.impact(e, one, 3)[1]


def test_chain_break(spark):
    rows = [("u", 1, "a"), ("u", 2, "b"), ("u", 3, "c"), ("v", 1, "a"), ("w", 1, "a"), ("w", 2, "x")]
    d = spark.createDataFrame(rows, "user_id string, event_id int, event_type string")
    entries = d.join(usage.chain(d), ["user_id", "event_id"])
    edited = entries.withColumn("event_type", F.when((F.col("user_id") == "u") & (F.col("event_id") == 2), "edited").otherwise(F.col("event_type")))
    edited = edited.withColumn("prev_hash", F.when(F.col("event_type") == "x", "bad").otherwise(F.col("prev_hash")))
    assert {r.user_id: r.broken_at for r in usage.verify_chain(edited).collect()} == {"u": 2, "v": None, "w": 2}
    assert {r.broken_at for r in usage.verify_chain(entries).collect()} == {None}


def test_sniff_rules(spark):
    texts = {"": "document", "a\0b": "binary", "\ufffd" * 3 + "x" * 100: "binary", "x" * 1000 + "\ufffd": "document", " \n#!/bin/sh": "code", "-----BEGIN PRIVATE KEY-----": "binary", "key: two words\nb = 1": "code", "9a: x\n8b: y": "document", " \n\t": "document"}
    texts |= {"項目: 値\n名前: 山田": "document", "/* a\n* b\nc": "code", "f(){}": "code", "a\r\n# b\r\n": "code"}
    d = spark.createDataFrame(list(texts.items()), "text string, want string").select("text", "want", S.sniff(F.col("text")).alias("got"))
    assert [r for r in d.collect() if r.want != r.got] == []


def test_secret_names_and_classes(spark):
    names = ["a/.netrc", ".npmrc", "x/.git-credentials", ".env.local", "ID_RSA.pub", "Credentials.xlsx", "k.PEM", "b.env", "my_credentials.txt", "environment.md"]
    d = spark.createDataFrame([(n,) for n in names], "p string")
    assert [r[0] for r in d.select(S.is_secret_name(F.col("p"))).collect()] == [True] * 8 + [False] * 2
    kinds = {"a.ts": "code", "a.TOML": "code", "a.log": "document", "a.tsv": "document", "a.bin": None}
    assert {r[0]: r[1] for r in spark.createDataFrame([(n,) for n in kinds], "p string").select("p", S.file_class(F.col("p"))).collect()} == kinds


def test_clip_bytes(spark):
    text = "aé日😀z"
    d = spark.createDataFrame([(text, n) for n in range(13)], "t string, n int")
    for n in range(13):
        want = text.encode()[:n].decode(errors="ignore")
        assert d.limit(1).select(S.clip_bytes(F.lit(text), n)).first()[0] == want


def test_mentions_of_one_folder_only(spark):
    docs = spark.createDataFrame([(1, "a/d.md", "use PAYROLL and PAYROLL or BILLING"), (2, "root.md", "PAYROLL"), (3, "b/d.md", "PAYROLL abc")], "doc_id long, path string, text string")
    names = spark.createDataFrame([("PAYROLL", 10, "a/p.cbl"), ("PAYROLL", 11, "a/x/p.cbl"), ("BILLING", 12, "a/b.cbl"), ("PAYROLL", 13, "r.cbl"), ("abc", 14, "b/c.cbl"), ("BILLING", 10, "a/p.cbl")], "name string, cid long, path string")
    got = sorted(tuple(r) for r in text.mentions(docs, names, most=2).collect())
    assert got == [(1, "PAYROLL", 10, 1, 1), (1, "PAYROLL", 11, 2, 1), (2, "PAYROLL", 13, 1, 0)]


def test_root_files_are_of_one_folder(spark):
    defs = spark.createDataFrame([(1, "x.cbl", "k", "n"), (2, "a/x.cbl", "k", "n"), (3, "a/b/y.cbl", "k", "m"), (4, "a/z.cbl", "k", "m")], "def_id long, path string, kind string, name string")
    refs = spark.createDataFrame([(1, "y.cbl", "k", "n"), (2, "a/q/y.cbl", "k", "n"), (3, "y.cbl", "k", "m"), (4, "a/b/c/d.cbl", "k", "m")], "ref_id long, path string, kind string, name string")
    got = {r.ref_id: (r.def_id, r.status) for r in graph.nearest(refs, defs).collect()}
    assert got == {1: (1, "resolved"), 2: (2, "resolved"), 3: (None, "cross_scope"), 4: (3, "resolved")}


def test_rrf_ties_go_by_key(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.5), (2, 0.4)], "key long, score double")
    got = search.rrf({"keyword": a, "vector": a}).collect()
    assert [(r.key, r.engines) for r in got] == [(1, "keyword,vector"), (2, "keyword,vector")]


def test_cycles_of_random_graphs(spark):
    import random

    for seed in range(2):
        rng = random.Random(seed)
        pairs = {(rng.randrange(24), rng.randrange(24)) for _ in range(34)}
        reach = {(a, b) for a, b in pairs}
        while True:
            more = {(a, d) for a, b in reach for c, d in reach if b == c} - reach
            if not more:
                break
            reach |= more
        want = {}
        for v in range(24):
            group = [u for u in range(24) if (u, v) in reach and (v, u) in reach] + [v]
            if len(set(group)) > 1:
                want[v] = min(group)
        got = {r.id: r.group for r in graph.cycles(spark.createDataFrame(sorted(pairs), "src long, dst long")).collect()}
        assert got == want
    assert graph.cycles(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")).collect() == []


def test_impact_of_says_what_it_lacks(spark):
    files = [(1, "a/P.cbl", "       PROGRAM-ID. P.\n           CALL 'Q'.\n       COPY X."), (2, "a/Q.cbl", "       PROGRAM-ID. Q."), (3, "b/Q.cbl", "       PROGRAM-ID. R.\n           CALL 'Q'."), (4, "a/J.jcl", "//J JOB 1\n//S EXEC PGM=P")]
    parts = build.build(spark.createDataFrame(files, "doc_id long, path string, text string"))
    got, cover = build.impact_of(*parts, "q")
    assert sorted((r.name, r.level) for r in got.collect()) == [("J", 2), ("P", 1), ("Q", 0)]
    assert cover.first().limits == ["unresolved_names"] and cover.first().lost == 1  # b's call of Q is in another folder
    assert build.impact_of(*parts, "q", 1)[1].first().limits == ["depth_truncated", "unresolved_names"]
    assert build.impact_of(*parts, "nothing")[1].first().limits == ["no_start"]
    # the evaluation notices a missing kind of edge
    nodes, edges, flags = parts
    assert build.impact_of(nodes, edges.filter("type <> 'INVOKES'"), flags, "q")[0].count() == 1


def test_globs():
    import re

    for pattern, yes, no in (("*.md", ["a.md", "x/y/a.md"], ["a.mdx"]), ("a/**/b.txt", ["a/b.txt", "a/c/d/b.txt"], ["ab.txt"]), ("[!a]?.py", ["bc.py"], ["ac.py"])):
        r = re.compile(S.glob_regex(pattern))
        assert all(r.match(p) for p in yes) and not any(r.match(p) for p in no)
