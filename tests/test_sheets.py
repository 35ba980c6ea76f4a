"""Ranges in sections, tables in cells, identifiers: against plain versions."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from heronry.operators import identifiers, sheets


def test_boxes_and_names(spark):
    names = ["A1", "$B$2", "A1:C4", "AA10:ZZ20", "a1", "A", "1", "A1:B", "", None, "XFD1048576"]
    d = spark.createDataFrame([(n,) for n in names], "n string").select("n", sheets.box(F.col("n")).alias("b"))
    got = {r.n: tuple(r.b) if r.b else None for r in d.collect()}
    assert got == {"A1": (1, 1, 1, 1), "$B$2": (2, 2, 2, 2), "A1:C4": (1, 1, 4, 3), "AA10:ZZ20": (10, 27, 20, 702), "XFD1048576": (1048576, 16384, 1048576, 16384)} | dict.fromkeys(["a1", "A", "1", "A1:B", "", None])
    back = d.filter("b IS NOT NULL").select("n", sheets.range_name(*[F.col(f"b.{x}") for x in ("r1", "c1", "r2", "c2")]).alias("m"))
    assert all(r.m == r.n.replace("$", "") for r in back.collect())


def test_smallest_section_equals_all_pairs(spark):
    rng = random.Random(3)

    def some(n, tall):
        out = []
        for i in range(n):
            r, c = rng.choice([1, rng.randint(1, 3000), 1 << rng.randint(0, 11)]), rng.randint(1, 30)
            out.append((i, rng.randint(0, 2), "s", r, c, r + rng.choice([0, rng.randint(0, tall)]), c + rng.randint(0, 9)))
        return out

    parts, chunks = [*some(150, 2500), (900, 0, "s", 1, 1, 1 << 20, 16384)], some(400, 20)
    named = lambda rows, k: spark.createDataFrame(rows, f"{k} int, doc int, sheet string, r1 int, c1 int, r2 int, c2 int").withColumn("box", F.struct("r1", "c1", "r2", "c2"))
    got = {r.chunk_id: r.section_id for r in sheets.enclosing(named(chunks, "chunk_id"), named(parts, "section_id")).collect()}
    want = {}
    for i, d, s, a, b, c, e in chunks:
        inside = [((p[5] - p[3] + 1) * (p[6] - p[4] + 1), p[3], p[4], p[0]) for p in parts if p[1:3] == (d, s) and p[3] <= a and p[5] >= c and p[4] <= b and p[6] >= e]
        if inside:
            want[i] = min(inside)[3]
    assert got == want and len(want) > 100


def test_excerpts_without_place(spark):
    c = spark.createDataFrame([(1, "d", None, None, "q1"), (2, "d", "x", "A1", "q2"), (3, "d", "x", "nonsense", "q3")], "chunk_id int, doc string, sheet string, cell_range string, quote string")
    p = spark.createDataFrame([(7, "d", "x", "A1:B2", "text"), (8, "d", "x", "?", "bad")], "section_id int, doc string, sheet string, cell_range string, text string")
    assert sorted(map(tuple, sheets.excerpts(c, p).collect())) == [(1, "q1", "rag", None), (2, "text", "human_md", "シート「x」A1:B2"), (3, "q3", "rag", "シート「x」nonsense")]


def made_by_joins(df):
    """Most rows that a join of the plan made."""

    def walk(node):
        inner = [getattr(node, x)() for kind, x in (("AdaptiveSparkPlan", "executedPlan"), ("QueryStage", "plan")) if kind in node.getClass().getSimpleName()]
        below = [node.children().apply(k) for k in range(node.children().size())]
        rows = node.metrics().get("numOutputRows") if "Join" in node.nodeName() else None
        return max([rows.get().value() if rows is not None and rows.isDefined() else 0, *map(walk, inner + below)])

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_many_chunks_of_one_place_meet_its_sections_once(spark):
    c = spark.range(2000).selectExpr("id AS chunk_id", "id % 2 AS doc", "'s' AS sheet", "'B2:C3' AS cell_range", "'q' AS quote")
    p = spark.range(1000).selectExpr("1000 - id AS section_id", "id % 2 AS doc", "'s' AS sheet", "if(id % 4 < 2, 'A1:D4', 'A1:E5') AS cell_range", "concat('t', 1000 - id) AS text")
    out = sheets.excerpts(c, p)
    assert made_by_joins(out) == 2000  # all pairs: a million
    assert {(r.chunk_id % 2, r.quote, r.hint) for r in out.collect()} == {(0, "t4", "シート「s」A1:D4"), (1, "t3", "シート「s」A1:D4")}


def grid(spark, rows):
    return spark.createDataFrame([("d", "s", r, c, v, *(span or (1, 1))) for r, c, v, *span in rows], "doc string, sheet string, row int, col int, value string, row_span int, col_span int")


def test_regions_are_parted_by_empty_rows_and_columns(spark):
    rng = random.Random(8)
    filled = {(r, c) for r in range(1, 40) for c in range(1, 20) if rng.random() < 0.35 and r % 7 and c % 5}
    got = {(x.row, x.col): (x.top, x.left) for x in sheets.regions(grid(spark, [(r, c, "x") for r, c in filled])).collect()}

    def runs(numbers):
        out, first = {}, None
        for n in sorted(set(numbers)):
            first = n if first is None or n - 1 not in out else first
            out[n] = first
        return out

    want = {}
    rows = runs(r for r, _ in filled)
    for top in set(rows.values()):
        inside = {(r, c) for r, c in filled if rows[r] == top}
        cols = runs(c for _, c in inside)
        for left in set(cols.values()):
            part = {(r, c) for r, c in inside if cols[c] == left}
            again = runs(r for r, _ in part)
            want |= {(r, c): (again[r], left) for r, c in part}
    assert got == want


def test_tables_are_not_broadcast(spark):
    """Estimates miss rows made of arrays: a small file can be many cells."""
    made = F.explode(F.sequence(F.lit(1), F.lit(50))).alias("row")
    cells = spark.range(20).select((F.col("id") % 2).alias("doc"), F.lit("s").alias("sheet"), F.col("id"), made).selectExpr("doc", "sheet", "int(id * 60 + row) AS row", "1 AS col", "string(row) AS value", "1 AS row_span", "1 AS col_span")
    found = sheets.regions(cells)
    for df in (found, sheets.headers(found), sheets.records(found, sheets.headers(found))):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert found.select("doc", "top").distinct().count() == 20


def test_headers_of_odd_tables(spark):
    merged = grid(spark, [(1, 1, "Head", 1, 3), (2, 1, "a"), (2, 3, "c")])  # one merged cell holds the region together
    assert {(r.top, r.left) for r in sheets.regions(merged).collect()} == {(1, 1)}
    band = grid(spark, [(1, 1, "t"), (2, 1, "Id"), (2, 2, "v"), (2, 3, "2021"), (3, 1, "a1"), (3, 2, "5"), (3, 3, "6"), (4, 1, "a2"), (4, 2, "7"), (4, 3, "8")])
    cells = sheets.regions(band)
    h = sheets.headers(cells).first()
    assert (h.title, h.header_row) == ("t", 2)
    assert [(r.row, list(r["keys"])) for r in sheets.records(cells, sheets.headers(cells)).orderBy("row").collect()] == [(3, ["Id=a1"]), (4, ["Id=a2"])]
    assert sheets.headers(sheets.regions(grid(spark, []))).collect() == []
    blank = grid(spark, [(1, 1, None), (2, 2, "  ")])
    assert sheets.regions(blank).collect() == []


def test_identifiers_equal_a_plain_reading(spark):
    rng = random.Random(6)
    pieces = ["ABC-1", "ａｂｃ＿２", "plain", "x", "参照先: ", "、", ", ", " ", "A1/B2", "é", "9-9", "A.b", "a_b", "（", "真：", "が", "z" * 300 + "1", "F１"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 9))) for _ in range(300)] + [None, "A-1 " * 200]
    d = spark.createDataFrame([(k, t, rng.choice(["画面ＩＤ", "呼出先", "", None, "x > 項目id", "名前"]), bool(k % 2)) for k, t in enumerate(texts)], "k int, value string, label string, is_key boolean")
    inner = "A-Za-z0-9Ａ-Ｚａ-ｚ０-９"
    for r in identifiers.mentions(d).collect():
        text, want, at = r.value or "", [], 0
        while at < len(text):  # the longest runs by hand
            end = at
            while end < len(text) and re.match(rf"[{inner}_.:/\-．／－：＿]", text[end]):
                end += 1
            run = text[at:end]
            for m in identifiers.TOKEN.finditer(text, at, end) if run else ():
                v = m[0]
                folded = unicodedata.normalize("NFKC", v).casefold()
                if len(v) <= 256 and re.search("[A-Za-zＡ-Ｚａ-ｚ]", v) and (re.search("[0-9０-９]", v) or re.search("[-_/:]", folded)):
                    want.append((m.start(), m.end(), v, folded))
            at = max(end, at + 1)
        got = [(m.start, m.end, m.value, m.normalized) for m in r.mentions]
        assert all(text[a:b] == v for a, b, v, _ in got) and got == want[:128] and r.mention_count == len(want)
    roles = lambda t, label, key=False: [(m["value"], m["role"], m["basis"]) for m in identifiers.found(t, label, key)]
    assert roles("A-1", "画面ID", True) == [("A-1", "record_identity", "record_key_identity:画面id")] and roles("A-1", "画面ID") == [("A-1", "unclassified", "identity_label_not_record_key")]
    assert roles("A-1", "呼出先") == [("A-1", "reference", "field_reference:呼出先")] and roles("A-1", "") == [("A-1", "unclassified", "missing_field_label")] and roles("A-1", "名前") == [("A-1", "unclassified", "unsupported_field_label")]
    assert [x[1] for x in roles("参照先: A-1, B-2 の C-3", "名前")] == ["reference", "reference", "unclassified"] and roles("A/B1", "呼出先")[0][2] == "ambiguous_slash_compound"
