import random
import re

from heronry.llm.op6_exact_dedup import exact_dedup


def test_against_brute_force(spark):
    rng = random.Random(5)
    pool = ["a b", "a  b", "a\tb", "a b", "", None, " ", "x" * 200_000, "é", "é"]
    rows = [(i, rng.choice(pool), i * 2, True) for i in range(400)] + [(None, "a b", 0, False), (None, "only", 0, False), (7, "a b", 1, True)]
    d = spark.createDataFrame(rows, "doc_id long, text string, keep_id int, Kept boolean")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got = exact_dedup(d).select(*columns).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = []
    for ids in groups.values():
        least = min((i for i in ids if i is not None), default=None)
        want += [(i, least, len(ids), i == least) for i in ids]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted([tuple(r)[:4] for r in got], key=key) == sorted(want, key=key)
    assert exact_dedup(d.limit(0)).collect() == []
    for rows_a_run, fan_in in ((400, 16), (30, 2), (10, 4), (1, 16)):  # one run up to 512, one to nine rounds
        again = exact_dedup(d, carry=[], run_rows=rows_a_run, fan_in=fan_in)
        assert sorted(again.columns) == sorted(columns)
        assert sorted(map(str, again.select(*columns).collect())) == sorted(map(str, got))
    assert exact_dedup(d).columns[:2] == ["doc_id", "text"]
