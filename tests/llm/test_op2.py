import zlib
from collections import Counter, defaultdict

import numpy as np

from heronry.llm import op2_language as op
from heronry.llm.queries import op2_language_documents


def slow(texts, text):
    """Interpolated Kneser-Ney by dictionaries: bits a character."""
    pad = "\0" * (op.ORDER - 1)

    def clean(t):
        out = []
        for c in t.lower():
            c = c if c.isalpha() else " "
            if c != " " or (out and out[-1] != " "):
                out.append(c)
        return "".join(out)

    top = Counter()
    for t in texts:
        s = pad + clean(t)
        top.update(s[i - op.ORDER + 1 : i + 1] for i in range(op.ORDER - 1, len(s)))
    counts = {op.ORDER: top}
    for k in range(op.ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    size = len({c for g in top for c in g if c != "\0"}) + 1
    info = {}
    for k, c in counts.items():
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        total, kinds = defaultdict(int), defaultdict(int)
        for g, v in c.items():
            total[g[:-1]] += v
            kinds[g[:-1]] += 1
        info[k] = (n1 / (n1 + 2 * n2) if n1 and n2 else 0.5, total, kinds)

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / size
        d, total, kinds = info[k]
        if not total[g[:-1]]:
            return p(g[1:])
        return max(counts[k][g] - d, 0) / total[g[:-1]] + d * kinds[g[:-1]] / total[g[:-1]] * p(g[1:])

    s = pad + clean(text)
    return -np.mean([np.log2(p(s[i - op.ORDER + 1 : i + 1])) for i in range(op.ORDER - 1, len(s))])


def test_equals_dictionaries():
    train = ["the cat sat on the mat, the rat ran", "a cat and a bat", "that hat is flat"]
    m = op.Models(train, ["en"] * 3)
    probe = ["the bat sat", "Cats that  ran!!", "a", "mat\nmat"]
    bits, n = m.bits(probe)
    for t, b in zip(probe, bits[:, 0]):
        assert abs(b - slow(train, t)) < 1e-4
    together, _ = m.bits(["", probe[0], "123", probe[2]])
    assert np.allclose(together[[1, 3]], bits[[0, 2]], atol=1e-5)


def test_predictions(spark):
    got = op2_language_documents(spark, "/root/testdata/sf0.01").collect()
    lang = dict(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect())
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert len(got) == 1000 and len(out) > 150
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.accepted for r in got]) > 0.99


def test_edges(spark):
    train = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("the cat sat on the mat and ran", "en"), ("der hund und die katze schlafen", "de")] * 20)], "doc_id long, text string, lang string")
    m = op.fit(train)
    rows = [(1, None, 0), (2, "", 0), (3, "123 !?", 0), (4, "the cat", 0), (4, "the cat", 0), (None, "die katze und der hund " * 20_000, 0), (5, "xqzj kvwq pfgb zzxq qqwv kjxz " * 5, 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = {r.doc_id: r for r in op.identify(d, m).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, None)] == ["und", "und", "und", "en", "de"]
    assert [got[i].accepted for i in (1, 2, 3, 4, 5)] == [False, False, False, True, False]
    assert op.identify(d.limit(0), m).collect() == []
    none = op.fit(train.limit(0))
    assert {r.lang_pred for r in op.identify(d, none).collect()} == {"und"}


def test_languages_of_long_texts_are_learned(spark):
    rows = [(i, "the cat sat on the mat " * 20, "en") for i in range(40)] + [(100 + i, "der hund lief in den wald " * 2000, "de") for i in range(2)]
    rows += [(200 + i, "le chien court dans la rue " * 20_000, "fr") for i in range(2)] + [(300 + i, "le chat dort dans la maison " * 5, "fr") for i in range(20)]
    models = op.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), chars=20_000, all_chars=60_000)
    assert sorted(models.langs) == ["de", "en", "fr"]
    assert [x[0] for x in models.predict(["der hund lief in den wald", "le chat dort dans la maison", "the cat sat on the mat"])] == ["de", "fr", "en"]


def test_ties_go_to_the_first_by_name(spark):
    rows = [(i, "same words for both of them", g) for i in range(20) for g in ("xx", "aa")]
    m = op.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [x[0] for x in m.predict(["words for them", "both of them"])] == ["aa", "aa"]


def test_shares_below_a_millionth_still_draw(spark):
    from pyspark.sql import functions as F

    rows = spark.range(3_000_000).select(op.drawn(F.lit(3e-6), "id", F.lit("lang")).alias("hit"))
    assert 0 < rows.filter("hit").count() < 40
    assert spark.range(1000).filter(op.drawn(F.lit(1.0), "id")).count() == 1000
