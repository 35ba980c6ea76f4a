import random
import re

import numpy as np

from heronry.llm import op8_near_dedup as op


def brute(rows):
    sets = {}
    for i, t in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                n = len(sets[x] & sets[y])
                if 100 * n >= 85 * (len(sets[x]) + len(sets[y]) - n):
                    a, b = sorted((find(x), find(y)))
                    comp[b] = a
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocab) for _ in range(60)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([3, 7, 30, 150, 400]))] for _ in range(n // 6)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base[:3] if rng.random() < 0.5 else base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.2:
            w += passage
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w) if rng.random() < 0.9 else " ".join(w).upper()))
    return rows


def test_against_all_pairs(spark):
    for seed in (1, 2):
        rows = [*corpus(seed, 240), (1000, None), (1001, ""), (1002, " \t"), (1003, "x"), (1004, "X"), (1005, "a b c d"), (1006, "big " * 60_000)]
        d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
        assert {tuple(r) for r in op.near_dedup(d).collect()} == brute(rows)


def test_edges(spark):
    d = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, "q r s")], "doc_id long, text string")
    got = sorted(map(str, op.near_dedup(d).collect()))
    assert len(got) == 4 and sum("kept=True" in g for g in got) == 3
    assert op.near_dedup(d.limit(0)).collect() == []


def test_equal_ids_with_other_texts_are_rows_of_their_own(spark):
    near = " ".join(f"u{i}" for i in range(40))
    rows = [(7, "a b c d e f"), (7, near), (3, near + " more"), (7, near), (9, "a b c d e f"), (None, near), (None, "only null")]
    got = {tuple(r) for r in op.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(7, 2, 7, True), (9, 2, 7, False), (7, 36, 3, False), (3, 37, 3, True), (None, 36, 3, False), (None, 1, None, True)}


def test_recall_of_planted_pairs_and_sketches():
    rng = np.random.default_rng(5)
    missed = tried = 0
    for n in (20, 60, 150, 1000):
        for _ in range(1500):
            share = rng.uniform(0.85, 0.9)
            u = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            k = int((1 - share) * n)
            cut = int(rng.integers(0, k + 1))
            x, y = np.unique(u[cut:]), np.unique(u[: n - (k - cut)])
            tried += 1
            missed += not np.intersect1d(op.buckets(x), op.buckets(y)).size
            common = np.intersect1d(x[: op.SKETCH].astype(np.uint32), y[: op.SKETCH].astype(np.uint32)).size
            if max(len(x), len(y)) > op.SKETCH:
                assert common >= op.LEAST
            else:
                assert 100 * (common + 1) >= op.PERCENT * (len(x) + len(y) - common - 1)
    assert tried == 6000 and missed == 0


def test_estimates_are_unbiased():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.85):
        agree = []
        for n in (20, 100, 3000):
            for _ in range(40):
                u = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
                k = int(n * (1 - share) / 2)
                agree.append((op.signature(np.unique(u[k:])) == op.signature(np.unique(u[: n - k]))).mean())
        assert abs(np.mean(agree) - share) < 0.06


def test_pages_of_one_template_make_no_pairs(spark, monkeypatch):
    """Unlinked pages that share most words: hardly any candidate in the second pass, however many pages; linked ones among them are found."""
    seen = []
    keep = op.Scratch.save

    def save(self, df, name):
        out = keep(self, df, name)
        if name == "candidates":
            seen.append(out.count())
        return out

    monkeypatch.setattr(op.Scratch, "save", save)
    rng = random.Random(4)
    template = [f"t{i}" for i in range(164)]
    for rows in (250, 500):
        texts = [template[:82] + [f"u{rng.randrange(10**9)}" for _ in range(36)] + template[82:] for _ in range(rows)]
        texts[7] = texts[3][:100] + ["other"] + texts[3][101:]
        d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
        got = op.near_dedup(d).filter("NOT kept").collect()
        assert [(r.doc_id, r.component_id) for r in got] == [(7, 3)]
    assert len(seen) == 2 and max(seen) <= 5


def test_long_variants_of_one_text_make_no_pairs(spark, monkeypatch):
    """Long texts with more edits than the share allows meet nowhere, though sketches of that size can't rule them out; links across the limit are found."""
    seen = []
    keep = op.Scratch.save

    def save(self, df, name):
        out = keep(self, df, name)
        if name == "candidates":
            seen.append(out.count())
        return out

    monkeypatch.setattr(op.Scratch, "save", save)
    rng = random.Random(6)
    template = [f"t{i}" for i in range(1000)]

    def edited(words, edits):
        out = list(words)
        for i in rng.sample(range(len(out)), edits):
            out[i] = f"u{rng.randrange(10**9)}"
        return out

    texts = [edited(template, 20) for _ in range(80)]
    texts[7] = edited(texts[3], 2)
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [(r.doc_id, r.component_id) for r in op.near_dedup(d).filter("NOT kept").collect()] == [(7, 3)]
    assert len(seen) == 1 and seen[0] <= 5
    rows = [(i, " ".join(edited(template, rng.randrange(24)))) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in op.near_dedup(d).collect()} == brute(rows)
