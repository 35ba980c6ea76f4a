"""Queries over what answers show, and over small column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.functions import scalars as S
from heronry.operators import answers, text
from heronry.plans.base import FILES_SQL, Registry, files
from heronry.plans.text_queries import KNN, LINES, knn
from heronry.session import table

query = Registry()


@query("clip_bytes", "WITH d AS (SELECT doc_id, replace(text, 'e', 'é日') AS t FROM documents) SELECT doc_id, CASE WHEN strlen(t) <= 101 THEN t ELSE t[1:list_max(list_filter(range(0, 102), lambda k: strlen(t[1:k]) <= 101))] END AS clipped FROM d")
def clip_bytes(spark, sf_dir):  # C02
    return table(spark, sf_dir, "documents").select("doc_id", S.clip_bytes(F.replace("text", F.lit("e"), F.lit("é日")), 101).alias("clipped"))


@query("clipped_hits", f"""WITH {LINES}, n AS (SELECT doc_id, max(line) AS n FROM l GROUP BY doc_id), h AS (SELECT doc_id, line FROM l WHERE contains(txt, 'icense')),
w AS (SELECT h.doc_id, h.line, string_agg(l.txt, chr(10) ORDER BY l.line) AS near FROM h JOIN l ON l.doc_id = h.doc_id AND l.line BETWEEN h.line - 3 AND h.line + 3 GROUP BY ALL)
SELECT w.doc_id, w.line::INT AS line, md5(CASE WHEN strlen(text) <= 1500 THEN text ELSE (CASE WHEN line = 5 THEN '⋯（1行目を省略）⋯' || chr(10) WHEN line > 5 THEN '⋯（1〜' || (line - 4) || '行目を省略）⋯' || chr(10) ELSE '' END)
 || (CASE WHEN strlen(near) <= 1372 THEN near ELSE near[1:list_max(list_filter(range(0, 1373), lambda k: strlen(near[1:k]) <= 1372))] END)
 || (CASE WHEN line + 3 < n THEN chr(10) || '⋯（' || (line + 4) || '行目以降を省略）⋯' ELSE '' END) END) AS hash FROM w JOIN documents USING (doc_id) JOIN n USING (doc_id)""")
def clipped_hits(spark, sf_dir):  # X03
    h = answers.clipped_hits(table(spark, sf_dir, "documents"), "icense", 1500)
    return h.select("doc_id", "line", F.md5("shown").alias("hash"))


@query("keyword_marks", f"""WITH {KNN}, m AS (SELECT vec_id AS doc_id, score, list_filter(['text', 'source'], lambda f: (f = 'text' AND (contains(lower(text), 'the ') OR contains(lower(text), 'src1'))) OR (f = 'source' AND (contains(lower(source), 'the ') OR contains(lower(source), 'src1')))) AS matched FROM k LEFT JOIN documents ON doc_id = vec_id)
SELECT doc_id, score, coalesce(matched, []) AS matched, coalesce(len(matched), 0) > 0 AS keyword FROM m""")
def keyword_marks(spark, sf_dir):  # X06
    hits = knn(spark, sf_dir).withColumnRenamed("vec_id", "doc_id")
    return answers.marked(hits, table(spark, sf_dir, "documents"), ["the ", "SRC1"], ["text", "source"])


RECORD = "'項目: 値' || (doc_id % 5) || chr(10) || 'source: ' || source || chr(10) || '状態：完了 ' || chr(10) || 'no field' || chr(10) || '別名: 値' || (doc_id % 5)"


@query("chunk_labels", "SELECT doc_id AS key, list_distinct_kept AS labels FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 3 THEN ['完了'] ELSE ['値' || (doc_id % 5), '完了'] END AS list_distinct_kept FROM documents)")
def chunk_labels(spark, sf_dir):  # X18
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.expr(RECORD).alias("body"), F.array(F.lit("値3"), F.col("source")).alias("identifiers"))
    return answers.labels(d, "[぀-ヿ一-鿿]")


REF = "CASE WHEN l_orderkey % 50 = 0 AND l_linenumber = 1 THEN 'R1C1' ELSE chr(65 + l_linenumber % 26) || (l_partkey % 50 + 1) || ':$a$' || chr(97 + l_suppkey % 26) || (l_partkey % 70 + 1) END"


@query("cell_envelopes", """SELECT l_orderkey AS key, CASE WHEN l_orderkey % 50 = 0 AND bool_or(l_linenumber = 1) THEN NULL ELSE chr((65 + min(l_linenumber % 26))::INT) || min(least(l_partkey % 50, l_partkey % 70) + 1) || ':A' || chr((65 + max(l_suppkey % 26))::INT) || max(greatest(l_partkey % 50, l_partkey % 70) + 1) END AS range FROM lineitem GROUP BY l_orderkey""")
def cell_envelopes(spark, sf_dir):  # X17, C12
    # '$a$' || 'c' || 7 is read as column AC
    ref = F.replace(F.expr(REF.replace("chr(", "char(")), F.lit("$a$"), F.lit("A"))
    return answers.envelopes(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), ref.alias("ref")))


NODES = [("licensed", 1, "src7/a"), ("LICENSED.", 2, "src1/b"), ("apache", 3, "src2/z"), ("Version", 4, "src1/q"), ("version", 5, "src9/q"), ("under", 6, "zzz/u"), ("License", 7, "top.cbl"), ("the", 8, "src1/t")]


@query("presumed_impact", f"""WITH {FILES_SQL}, l AS (SELECT doc_id, path, unnest(string_split(text, chr(10))) AS txt, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM files),
h AS (SELECT doc_id, line, trim(txt)[1:160] AS quote, split_part(path, '/', 1) AS top, regexp_extract_all(txt, '[A-Za-z][A-Za-z0-9_#@$-]{{2,}}') AS x FROM l WHERE contains(lower(txt), 'licensed')),
t AS (SELECT doc_id, line, quote, top, upper(unnest(x)) AS name, generate_subscripts(x, 1) AS pos FROM h),
n AS (SELECT upper(rtrim(name, '.')) AS name, cid, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '/' END AS top FROM (VALUES {", ".join(map(str, NODES))}) v(name, cid, path)),
here AS (SELECT name, top, min(cid) AS here FROM n GROUP BY ALL), one AS (SELECT name, min(cid) AS one FROM n GROUP BY name HAVING count(*) = 1),
f AS (SELECT coalesce(here, one) AS cid, doc_id, line, quote, pos FROM t LEFT JOIN here USING (name, top) LEFT JOIN one USING (name) WHERE t.name <> 'THE')
SELECT cid::BIGINT AS cid, arg_min(doc_id, (doc_id, line, pos)) AS doc_id, arg_min(line, (doc_id, line, pos))::INT AS line, arg_min(quote, (doc_id, line, pos)) AS quote FROM f WHERE cid IS NOT NULL GROUP BY cid""")
def presumed_impact(spark, sf_dir):  # X19
    hits = text.grep(files(spark, sf_dir), "licensed").join(files(spark, sf_dir).select("doc_id", "path"), "doc_id")
    return answers.presumed(hits, spark.createDataFrame(NODES, "name string, cid long, path string"), ["THE"])


@query("repeated_calls", "WITH c AS (SELECT user_id AS turn, event_id AS seq, event_type AS name, CASE WHEN event_id % 13 <> 0 THEN props->>'k' END AS args FROM events) SELECT turn, seq, args IS NOT NULL AND row_number() OVER (PARTITION BY turn, name, args ORDER BY seq) > 1 AS repeated FROM c")
def repeated_calls(spark, sf_dir):  # R08
    e = table(spark, sf_dir, "events")
    c = e.select(F.col("user_id").alias("turn"), F.col("event_id").alias("seq"), F.col("event_type").alias("name"), F.when(F.col("event_id") % 13 != 0, F.get_json_object("props", "$.k")).alias("args"))
    return answers.repeated_calls(c).select("turn", "seq", "repeated")


GIVEN = "CASE event_id % 7 WHEN 0 THEN '12' WHEN 1 THEN '-3' WHEN 2 THEN 'true' WHEN 3 THEN '' WHEN 4 THEN '007' WHEN 5 THEN '1.5' END"


@query("number_guards", f"SELECT event_id, CASE WHEN regexp_full_match({GIVEN}, '[0-9]+') THEN ({GIVEN})::BIGINT ELSE 0 END AS clamped, CASE WHEN regexp_full_match({GIVEN}, '[0-9]+') THEN ({GIVEN})::BIGINT END AS known, CASE WHEN event_id % 2 = 0 THEN (event_id // 2)::VARCHAR ELSE (event_id // 2)::VARCHAR || '.5' END AS shown FROM events")
def number_guards(spark, sf_dir):  # C08, C10
    s = F.expr(GIVEN)
    return table(spark, sf_dir, "events").select("event_id", S.non_negative(s).alias("clamped"), S.non_negative(s, None).alias("known"), S.plain_number(F.col("event_id") / 2).alias("shown"))


@query("via_ranks", f"SELECT event_id, CASE WHEN event_id % 26 < {len(S.VIA_ORDER)} THEN event_id % 26 ELSE {len(S.VIA_ORDER)} END::INT AS rank FROM events")
def via_ranks(spark, sf_dir):  # C11
    names = F.array(*[F.lit(v) for v in S.VIA_ORDER], F.lit("other"), F.lit(None))
    return table(spark, sf_dir, "events").select("event_id", S.via_rank(F.element_at(names, (F.col("event_id") % 26 + 1).cast("int"))).alias("rank"))


@query("sheet_columns", "SELECT l_orderkey, l_linenumber, n, CASE WHEN n <= 26 THEN chr((64 + n)::INT) WHEN n <= 702 THEN chr((64 + (n - 1) // 26)::INT) || chr((65 + (n - 1) % 26)::INT) ELSE chr((64 + (n - 27) // 676)::INT) || chr((65 + (n - 27) // 26 % 26)::INT) || chr((65 + (n - 1) % 26)::INT) END AS letters FROM (SELECT l_orderkey, l_linenumber, (l_orderkey * 7 + l_linenumber) % 16384 + 1 AS n FROM lineitem)")
def sheet_columns(spark, sf_dir):  # C12
    n = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 16384 + 1
    letters = S.column_letters(n)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.column_number(letters).cast("long").alias("n"), letters.alias("letters"))


@query("narrowed_scopes", """WITH d AS (SELECT doc_id, source AS s, CASE doc_id % 8 WHEN 0 THEN ' ' WHEN 1 THEN source || '/en/' WHEN 2 THEN '/abs' WHEN 3 THEN 'a/../b' WHEN 4 THEN 'x' WHEN 5 THEN 'elsewhere' WHEN 6 THEN source END AS p FROM documents)
SELECT doc_id, CASE doc_id % 8 WHEN 1 THEN [s || '/en'] WHEN 4 THEN ['x/y'] WHEN 6 THEN [s] ELSE [s, 'x/y'] END AS scopes, CASE doc_id % 8 WHEN 2 THEN 'not a folder' WHEN 3 THEN 'not a folder' WHEN 5 THEN 'outside' END AS error FROM d""")
def narrowed_scopes(spark, sf_dir):  # F18
    p = F.expr("CASE doc_id % 8 WHEN 0 THEN ' ' WHEN 1 THEN source || '/en/' WHEN 2 THEN '/abs' WHEN 3 THEN 'a/../b' WHEN 4 THEN 'x' WHEN 5 THEN 'elsewhere' WHEN 6 THEN source END")
    return table(spark, sf_dir, "documents").select("doc_id", S.narrowed(F.array("source", F.lit("x/y")), p).alias("n")).select("doc_id", "n.scopes", "n.error")
