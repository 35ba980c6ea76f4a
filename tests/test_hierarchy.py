"""Paths folded as posixpath does; labels of random forests."""

import posixpath
import random

from pyspark.sql import functions as F

from heronry.operators import hierarchy


def test_folding_equals_posixpath(spark):
    rng = random.Random(1)
    paths = ["/".join(rng.choices(["a", "b", "..", ".", "", "c d"], k=rng.randint(1, 8))) for _ in range(300)]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", hierarchy.folded(F.col("p")).alias("f")).collect()
    for r in got:
        want = posixpath.normpath(r.p.lstrip("/") or ".")
        assert r.f == ("" if want == "." else want), r.p


def test_aliases():
    assert hierarchy.expanded({"a": "b/x", "b": "g/y", "c": "c", "d": "e", "e": "d/z", "f": "q"}) == {"a": "g/y/x", "b": "g/y", "f": "q"}


def test_first_folder_with_one_file_decides(spark):
    files = spark.createDataFrame([("g/a/x/C.cpy", "copybook", "C"), ("g/a/y/C.cpy", "copybook", "C"), ("g/b/C.cpy", "copybook", "C"), ("h/b/C.cpy", "copybook", "C"), ("g/lib/i.h", "file", "i.h")], "path string, kind string, name string")
    refs = spark.createDataFrame([(1, "g/p.cbl", "C", "copybook", "C"), (2, "h/p.cbl", "C", "copybook", "C"), (3, "g/src/m.c", "../lib/i.h", "file", "i.h"), (4, "h/src/m.c", "../../g/lib/i.h", "file", "i.h"), (5, "g/m.c", "lib\\i.h", "file", "i.h"), (6, "g/m.c", "lib/i.h", "file", "other")], "ref_id int, path string, include string, kind string, name string")
    got = {r.ref_id: (r.target, r.how) for r in hierarchy.include_paths(refs, files, {}, ["g/a", "h/none", "g/b", "g"]).collect()}
    assert got == {1: ("g/b/C.cpy", "copy_path"), 2: (None, None), 3: ("g/lib/i.h", "relative"), 4: (None, None), 5: ("g/lib/i.h", "relative"), 6: (None, None)}


def test_labels_of_a_random_forest(spark):
    rng = random.Random(4)
    parent = {k: rng.randrange(k) for k in range(1, 120) if rng.random() < 0.9}
    extra = [(50, 3), (51, 50)]
    parent[51] = 50
    rows = [*parent.items(), *extra, (200, 201), (201, 200), (202, 201), (7, None)]
    if 50 not in parent or parent[50] == 3:
        rows.append((50, 4))
        parent.setdefault(50, 3)
    labels, odd = hierarchy.labelled(spark.createDataFrame(rows, "child int, parent int"))
    assert {(r.id, r.reason) for r in odd.collect()} == {(50, "ambiguous"), (200, "circular"), (201, "circular"), (202, "circular")}
    del parent[50]

    def above(k):
        while k in parent:
            k = parent[k]
            yield k

    want = {(a, k) for k in parent for a in above(k)}
    got = hierarchy.subtypes(labels, labels.select("id")).collect()
    assert {(r.id, r.subtype) for r in got} == want and len(got) == len(want)
    assert {(r.id, r.subtype) for r in got if r.direct} == {(p, k) for k, p in parent.items()}
    assert [d.collect() for d in hierarchy.labelled(spark.createDataFrame([], "child int, parent int"))] == [[], []]
