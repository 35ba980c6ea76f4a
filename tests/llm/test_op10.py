import random
import re
from collections import defaultdict

from heronry.llm import op10_mix as op


def level_targets(sizes, share=1.5):
    """Share by weight; those above twice their size stop, the excess goes to the others, again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 2 * sizes[s] + 1e-9]
        if not over:
            return fixed | {s: left * weight[s] / w for s in free}
        for s in over:
            fixed[s] = 2.0 * sizes[s]
        left = share * sum(sizes.values()) - sum(fixed.values())


def test_targets_and_limits(spark):
    rng = random.Random(3)
    names = ["a", "b", "é", "z", "\U0001f600", None, "B"]
    rows = [(i, rng.choice([None, "", " \t", "w " * rng.randint(1, 400)]) if i % 5 else "x " * rng.randint(1, 3000), rng.choices(names, [30, 5, 3, 2, 1, 3, 1])[0], 1.5) for i in range(600)] + [(None, "n " * 50, "a", 0.0), (3, "n " * 50, "a", 0.0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    got = op.mix(d).collect()
    assert len(got) == len(rows)
    sizes, texts = defaultdict(int), defaultdict(list)
    for i, t, s, _ in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] += n
        texts[i].append((n, s))
    want = level_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        n, s = next(x for x in texts[r.doc_id] if x[0] == r["size"])
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 2 * n
        taken[s] += r.taken
    total = sum(sizes.values())
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.002 * total + 5
    assert sorted(map(str, got)) == sorted(map(str, op.mix(d.repartition(7)).collect()))
    assert op.mix(d.limit(0)).collect() == []
    assert [r.taken for r in op.mix(d.filter("text = ''")).collect()][:1] == [0]


def test_small_sources_beside_a_huge_one(spark, monkeypatch):
    monkeypatch.setattr(op, "sizes", lambda docs, *_: docs.selectExpr("doc_id AS id", "source AS src", "size"))
    small = {"a": 2000, "b": 5000, "c": 20_000, "d": 30_000, "e": 90_000, "f": 3, "h": 7_000_000}
    rows = [(f"{s}{i}", s, n // 10 + (n % 10 if i == 0 else 0)) for s, n in small.items() for i in range(10)] + [(f"z{i}", "z", 50_000_000) for i in range(100)]
    got = op.mix(spark.createDataFrame(rows, "doc_id string, source string, size long")).collect()
    want = level_targets({**small, "z": 5_000_000_000})
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    for s, target in want.items():
        taken = sum(r.taken for r in got if r.doc_id[0] == s)
        assert abs(taken - target) <= 0.003 * target + 4, (s, target, taken)
