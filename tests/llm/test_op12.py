import random
import re
from collections import Counter, defaultdict

from heronry.llm import op12_divergence as op

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs):
    count, files, sources = Counter(), Counter(), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        terms = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sources[lang].add(source)
        files.update((lang, t) for t in set(terms))
        count.update((lang, source, t) for t in terms)
    out = []
    for lang, groups in sources.items():
        kept = [t for (x, t), n in files.items() if x == lang and n >= 3]
        total = {s: sum(count[lang, s, t] for t in kept) for s in groups}
        every = {t: sum(count[lang, s, t] for s in groups) for t in kept}
        p = {(s, t): 1 + 10**9 * (count[lang, s, t] + 1) // (total[s] + len(kept)) for s in groups for t in kept}
        q = {t: 1 + 10**9 * (every[t] + 1) // (sum(total.values()) + len(kept)) for t in kept}
        f = lambda x, y: (x - y) * (x - y) // y
        for s in groups:
            pair = [(sum(f(p[s, t], p[o, t]) for t in kept), o) for o in groups if o != s]
            term = [(f(p[s, t], q[t]), t) for t in kept if count[lang, s, t] and p[s, t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (v, i) in enumerate(found) if part == "pair" or k < 200]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op, "HELD", 300)
    monkeypatch.setattr(op, "CHARS", 3000)
    monkeypatch.setattr(op, "SHARD_BYTES", 3000)
    rng = random.Random(2)
    words = ["The", "the", "É", "日本", "a-b", "x1y"] + ["".join(rng.choices("abcdefgé", k=3)) for _ in range(700)]
    docs = [(rng.choice([None, "", "12 .,"]) if i % 13 == 0 else " ".join(rng.choices(words[: 30 * (1 + i % 24)], k=rng.randint(1, 60))), rng.choice(["en", "de", None, "", "x"]), rng.choices(["a", "b", "B", None, "", "é", "\U0001f600", "z"], [9, 3, 3, 1, 1, 2, 1, 1])[0]) for i in range(500)]
    docs += [("nothing kept", "rare", "a"), (None, "rare", "b"), ("only one", "alone", "q"), ("The " * 150_000, "en", "a"), *[docs[5]] * 3, ("one two", "few", "a"), ("one two", "few", "b"), ("one", "few", "c"), ("12", "few", "d")]
    d = spark.createDataFrame([(*x, "p", 3) for x in docs], "text string, lang string, source string, part string, Value int").repartition(5)
    got = op.source_divergence(d)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(map(tuple, got.collect())) == plain(docs)
    assert op.source_divergence(d.limit(0)).collect() == []


def test_query_equals_sql(spark):
    import duckdb

    from heronry.llm import queries

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = queries.queries()["op12_source_divergence"](spark, sf)
    want = c.execute(queries.oracle_sql()["op12_source_divergence"]).fetchall()
    assert len(want) > 1000 and sorted(map(tuple, got.collect())) == sorted(want)
