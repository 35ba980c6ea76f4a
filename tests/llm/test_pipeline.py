import re

import corpus_pipeline as p
from heronry.llm import op2_language, op3_bpe
from heronry.llm.common import materialise
from test_op8 import brute


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    steps = [docs]
    for name, f in p.STAGES:
        steps.append(materialise(f(spark, steps[-1], "/root/testdata/sf0.001"), name))
    for s in steps[1:-1]:
        assert s.schema == docs.schema
    models = op2_language.fit(docs.filter(~op2_language.held_out("doc_id", 4, 2)))
    ids = sorted(rows)
    kept = [i for i, x in zip(ids, models.predict([rows[i].text or "" for i in ids])) if x[3]]
    assert sorted(r.doc_id for r in steps[1].collect()) == kept and len(kept) > 0.98 * len(ids)
    first = {}
    for i in kept:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i].text or ""), i)
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(first.values())
    want = sorted(i for i, _, _, k in brute([(i, rows[i].text) for i in first.values()]) if k)
    assert sorted(r.doc_id for r in steps[3].collect()) == want
    mixed = [r.doc_id for r in steps[4].collect()]
    assert set(mixed) <= set(want) and max(map(mixed.count, mixed)) <= 2
    words = lambda i: len(re.findall(r"[^\x20\x09-\x0D]+", rows[i].text or ""))
    assert abs(sum(map(words, mixed)) / (1.5 * sum(map(words, want))) - 1) < 0.1
    bpe, _ = op3_bpe.encoder(op3_bpe.VOCABULARY)
    last = steps[5].collect()
    assert sorted(r.doc_id for r in last) == sorted(mixed) and all(r.round_trip for r in last)
    for r in last[:20]:
        assert bpe.decode([int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4)]) == rows[r.doc_id].text.encode()


def test_edges_of_each_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    real = [r.asDict() for r in docs.filter("lang IS NOT NULL AND text IS NOT NULL").collect()]
    base = [(i, r["text"], r["lang"], r["source"], r["n_chars"], i, "t", 3, "m") for i, r in enumerate(real)]
    text = next(r["text"] for r in real if r["lang"] == "en" and len(r["text"].split()) > 30)
    other = next(r["text"] for r in real if r["lang"] == "en" and len(r["text"].split()) > 30 and r["text"] != text)
    new = text + " and then some more words of this kind"
    odd = [(500, None, "en"), (501, "", "en"), (None, new, "en"), (None, new, None), (502, new, None), (502, new.replace(" ", "  "), None), (502, new, None), (503, other + " quite another end", None), (503, text + " the end", None)]
    rows = base + [(i, t, g, None, 1, 1, "x", None, None) for i, t, g in odd]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, times string, nth int, row string")
    at, seen = d, []
    for name, f in p.STAGES:
        at = materialise(f(spark, at, ""), name)
        if name != "encode":
            assert at.schema == d.schema
        seen.append(sorted(((r.doc_id, r.text) for r in at.collect() if r.doc_id is None or r.doc_id >= 500), key=str) if name != "encode" else at.count())
    language, exact, near, mixed, _ = seen
    assert len(language) == 7 and all(t for _, t in language)  # null and empty texts are rejected
    assert len(exact) == 3 and (502, new) in exact or (502, new.replace(" ", "  ")) in exact
    assert {i for i, _ in exact} == {502, 503} and len(near) <= 3 and {i for i, _ in near} <= {502, 503}
    for stages in (p.STAGES, p.STAGES[3:]):
        at = d.limit(0)
        for _, f in stages:
            at = f(spark, at, "")
        assert at.collect() == []


def test_run_leaves_no_folders_of_its_stages(spark, tmp_path):
    from pathlib import Path

    root = Path(spark.conf.get("spark.checkpoint.dir"))
    before = {x.name for x in root.iterdir()}
    assert p.run(spark, "/root/testdata/sf0.001").count() > 100
    assert all(x.name.startswith("heronry-stage-") for x in root.iterdir() if x.name not in before)
