"""The stored keyword index: pruned reads, changes of documents, failures, writers in each other's way."""

import pytest
from pyspark.sql import functions as F

from heronry.operators import index, maintenance, text

DOCS = [(1, "the apple tree"), (2, "apple apple pie"), (3, None), (4, "Tree of the night"), (5, "night apple"), (None, "apple")]


@pytest.fixture
def root(spark, tmp_path):
    d = spark.createDataFrame(DOCS, "doc_id long, text string")
    index.change(spark, str(tmp_path), d, buckets=8)
    return str(tmp_path)


def found(df):
    return [tuple(r) for r in df.collect()]


def plain(spark, rows, terms):
    return found(text.bm25(spark.createDataFrame([r for r in rows if r[0] is not None], "doc_id long, text string").fillna("", ["text"]), terms))


def test_equals_the_scan_and_reads_only_buckets(spark, root):
    for terms in (["apple"], ["apple", "night", "none"], ["none"]):
        assert found(index.search(spark, root, terms)) == plain(spark, DOCS, terms)
    got = index.matches(spark, root, ["apple", "night"])
    held = {index.bucket_of(t, 8) for t in ("apple", "night")}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(term" in plan
    files = got.select(F.input_file_name()).distinct().collect()
    assert files and all(any(f"bucket={b}/" in f[0] for b in held) for f in files)


def test_postings_are_made_within_rows(spark):
    rows = [(1, "b a b. A_1 b"), (2, ""), (3, None), (4, "z " * 3000 + "y"), (None, "a")]
    got = index.postings(spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit("a")), "doc_id", ["text", "labels"])
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    text = {(r.doc, r.term): (r.dl, r.tf, list(r.positions)) for r in got.filter("field = 'text'").collect()}
    assert text == {(1, "b"): (5, 3, [0, 2, 4]), (1, "a"): (5, 1, [1]), (1, "a_1"): (5, 1, [3]), (4, "z"): (3001, 3000, list(range(3000))), (4, "y"): (3001, 1, [3000])}
    assert sorted((r.doc, r.term, r.tf) for r in got.filter("field = 'labels'").collect()) == [(k, "a", 1) for k in (1, 2, 3, 4)]


def test_changes_and_removals(spark, root):
    def change(rows, removed=()):
        gone = spark.createDataFrame([(i,) for i in removed], "doc_id long") if removed else None
        index.change(spark, root, spark.createDataFrame(rows, "doc_id long, text string") if rows else None, removed=gone)

    change([(2, "pear"), (9, "apple pear night")])
    now = [(1, "the apple tree"), (2, "pear"), (3, None), (4, "Tree of the night"), (5, "night apple"), (9, "apple pear night")]
    assert found(index.search(spark, root, ["apple", "pear"])) == plain(spark, now, ["apple", "pear"])
    change([], [1, 77])
    change([(2, "apple pear pear")])
    now = [(2, "apple pear pear"), *[r for r in now if r[0] not in (1, 2)]]
    assert found(index.search(spark, root, ["apple", "pear", "tree"])) == plain(spark, now, ["apple", "pear", "tree"])
    assert found(index.phrase(spark, root, ["apple", "pear"]).orderBy("doc")) == [(2, 1), (9, 1)]


def test_a_failed_change_leaves_the_old_rows(spark, root):
    before = found(index.search(spark, root, ["apple"]))
    bad = spark.createDataFrame([(2, "x"), (5, "y")], "doc_id long, text string").withColumn("text", F.when(F.col("doc_id") == 5, F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        index.change(spark, root, bad)
    assert found(index.search(spark, root, ["apple"])) == before and index.state(spark, root)["number"] == 1


def test_two_writers(spark, root):
    old = index.state(spark, root)
    index.change(spark, root, spark.createDataFrame([(7, "plum")], "doc_id long, text string"))
    with pytest.raises(index.Conflict):
        index.commit(spark, root, old, {k: v for k, v in old.items() if k != "number"})
    assert found(index.search(spark, root, ["plum"]))[0][0] == 7
    with open(f"{root}/commits/000000000003.json", "w") as f:  # cut off: not whole
        f.write('{"buckets"')
    assert found(index.search(spark, root, ["plum"]))[0][0] == 7 and index.state(spark, root)["number"] == 3
    index.change(spark, root, spark.createDataFrame([(8, "plum plum")], "doc_id long, text string"))
    assert {d for d, _ in found(index.search(spark, root, ["plum"]))} == {7, 8}


def test_published_pointers_are_unique(spark, tmp_path):
    root = str(tmp_path)
    for g in ("a", "b", "c"):
        maintenance.publish(spark.range(ord(g)), root, "t", g)
    assert maintenance.current(spark, root, "t").count() == ord("c")
    numbers = maintenance.pointers(spark, root, "t")
    assert [n for n, _ in numbers] == [1, 2, 3]
    assert maintenance.sweep(spark, root, "t", keep=1) == 2 and maintenance.current(spark, root, "t").count() == ord("c")
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        maintenance.publish(spark.range(1), root, "t", "c")
