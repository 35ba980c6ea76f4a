"""Queries over lines, chunks, terms and vectors; ids of the inventory in the names' comments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heronry.functions import scalars as S
from heronry.operators import search, text
from heronry.plans.base import FILES_SQL, Registry, files
from heronry.session import table

query = Registry()
LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS txt, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"
TERMS = "t AS (SELECT doc_id, len(x) AS dl, unnest(x) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS x FROM documents))"
BM25 = f"""b AS (WITH {TERMS}, n AS (SELECT count(*) AS n, avg(len(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS avgdl FROM documents),
 tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM t WHERE term IN ('licensed', 'apache', 'version') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
 SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term), n GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10)"""
QUERY_TERMS = ["licensed", "apache", "version"]
KNN = """k AS (WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)
 SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10)"""


@query("grep_lines", f"WITH {LINES} SELECT doc_id, line::INT AS line, txt FROM l WHERE contains(lower(txt), 'licensed') ORDER BY doc_id, line LIMIT 50")
def grep_lines(spark, sf_dir):  # X01, T01
    hits = text.grep(table(spark, sf_dir, "documents"), "licensed")
    return hits.select("doc_id", "line", "txt").orderBy("doc_id", "line").limit(50)


@query("grep_window", f"""WITH {LINES}, h AS (SELECT doc_id, line FROM l WHERE contains(lower(txt), 'licensed'))
SELECT h.doc_id, h.line::INT AS line, string_agg(l.txt, chr(10) ORDER BY l.line) AS near FROM h JOIN l ON l.doc_id = h.doc_id AND l.line BETWEEN h.line - 2 AND h.line + 2 GROUP BY ALL""")
def grep_window(spark, sf_dir):  # X01, X12
    return text.grep(table(spark, sf_dir, "documents"), "LICENSED").select("doc_id", "line", "near")


@query("chunk_40_lines", f"""WITH {LINES}, c AS (SELECT doc_id, ((line - 1) // 40) * 40 + 1 AS line, string_agg(txt, chr(10) ORDER BY line) AS body FROM l GROUP BY doc_id, (line - 1) // 40)
SELECT doc_id, line::INT AS line, md5(regexp_replace(body, '^\\s+|\\s+$', '', 'g')) AS hash FROM c WHERE regexp_replace(body, '^\\s+|\\s+$', '', 'g') <> ''""")
def chunk_40_lines(spark, sf_dir):  # X14
    return text.chunks(table(spark, sf_dir, "documents")).select("doc_id", "line", F.md5("body").alias("hash"))


#: Documents with headings of three levels.
MD = "'# All of ' || source || chr(10) || 'begin ' || doc_id || chr(10) || '## Part ' || (doc_id % 7) || chr(10) || text || chr(10) || '###' || chr(10) || '### End, License'"
MD_LINES = f"l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS txt, generate_subscripts(string_split(t, chr(10)), 1) AS line FROM (SELECT doc_id, {MD} AS t FROM documents))"


def markdown(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(MD).alias("text"))


@query("outline", f"""WITH {MD_LINES} SELECT doc_id, line::INT AS line, len(regexp_extract(txt, '^(#+)', 1))::INT AS level, regexp_extract(txt, '^#{{1,3}}\\s+(.+)', 1)[1:300] AS title FROM l WHERE regexp_matches(txt, '^#{{1,3}}\\s+.+')""")
def outline(spark, sf_dir):  # X11
    return text.outline(markdown(spark, sf_dir))


@query("bm25", f"WITH {BM25} SELECT * FROM b")
def bm25(spark, sf_dir):  # T02, X21
    return text.bm25(table(spark, sf_dir, "documents"), QUERY_TERMS)


@query("knn", f"WITH {KNN} SELECT * FROM k")
def knn(spark, sf_dir):  # T03
    e = table(spark, sf_dir, "embeddings")
    return search.knn(e, e.filter("vec_id = 0").first()["embedding"])


@query("hybrid_rrf", f"""WITH {BM25}, {KNN}, h AS (SELECT doc_id AS key, 'keyword' AS engine, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS part FROM b
UNION ALL SELECT vec_id, 'vector', 1.0 / (60 + row_number() OVER (ORDER BY score DESC, vec_id)) FROM k)
SELECT key, round(sum(part), 6) AS score, string_agg(DISTINCT engine, ',' ORDER BY engine) AS engines FROM h GROUP BY key ORDER BY score DESC, key LIMIT 10""")
def hybrid_rrf(spark, sf_dir):  # X05, X07, W05, U01, U04
    b = text.bm25(table(spark, sf_dir, "documents"), QUERY_TERMS).withColumnRenamed("doc_id", "key")
    return search.rrf({"keyword": b, "vector": knn(spark, sf_dir).withColumnRenamed("vec_id", "key")})


@query("quantise_int8", """SELECT vec_id, list_transform(embedding, lambda x: (sign(x::DOUBLE) * floor(abs(x::DOUBLE) * (127.0::DOUBLE / top) + 0.5))::INT) AS q FROM (SELECT *, greatest(list_max(embedding)::DOUBLE, -list_min(embedding)::DOUBLE) AS top FROM embeddings)""")
def quantise_int8(spark, sf_dir):  # V04
    return table(spark, sf_dir, "embeddings").select("vec_id", S.quantise(F.col("embedding")).alias("q"))


@query("vector_validity", "SELECT vec_id, len(embedding) = 64 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 AS ok FROM embeddings")
def vector_validity(spark, sf_dir):  # V03
    return table(spark, sf_dir, "embeddings").select("vec_id", S.valid_vector(F.col("embedding"), 64).alias("ok"))


@query("mean_pool", "WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL) SELECT label, i::INT AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 5) AS x FROM m")
def mean_pool(spark, sf_dir):  # V02
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    m = e.groupBy("label", (F.col("pos") + 1).alias("i")).agg(F.avg(F.col("x").cast("double")).alias("x"))
    return m.select("label", "i", F.round(F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("label"))), 5).alias("x"))


@query("mention_join", f"""WITH {FILES_SQL}, n AS (SELECT unnest(string_split(p_name, ' ')) AS name, p_partkey AS cid, 'src' || (p_partkey % 20) || '/lib/p.cbl' AS path FROM part UNION ALL SELECT name, cid, source || path FROM (VALUES ('Licensed', -1, '/a.cbl'), ('Licensed', -2, '/x/b.cbl'), ('under', -1, '/a.cbl'), ('Apache', -3, '.cbl')) v(name, cid, path), (SELECT DISTINCT source FROM documents WHERE source <> 'src3')),
d AS (SELECT DISTINCT name, cid, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) END AS top FROM n),
w AS (SELECT doc_id, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) END AS top, generate_subscripts(x, 1) AS pos, unnest(x) AS name FROM (SELECT doc_id, path, regexp_extract_all(text, '[A-Za-z0-9_#@$-]+') AS x FROM files)),
f AS (SELECT doc_id, cid, min(pos) AS pos, arg_min(w.name, pos) AS name FROM w JOIN d ON w.name = d.name AND w.top IS NOT DISTINCT FROM d.top WHERE len(w.name) >= 4 GROUP BY ALL),
r AS (SELECT doc_id, name, cid, row_number() OVER (PARTITION BY doc_id ORDER BY pos, cid)::INT AS nth, greatest(count(*) OVER (PARTITION BY doc_id) - 200, 0) AS overflow FROM f) SELECT * FROM r WHERE nth <= 200""")
def mention_join(spark, sf_dir):  # J09, J24
    p = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("name"), F.col("p_partkey").alias("cid"), F.concat(F.lit("src"), F.col("p_partkey") % 20, F.lit("/lib/p.cbl")).alias("path"))
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).cast("long").alias("cid"), F.concat("source", F.lit(x)).alias("path")) for n, c, x in (("Licensed", -1, "/a.cbl"), ("Licensed", -2, "/x/b.cbl"), ("under", -1, "/a.cbl"), ("Apache", -3, ".cbl"))])
    own = table(spark, sf_dir, "documents").filter("source <> 'src3'").select("source").distinct().select(F.inline(names))
    return text.mentions(files(spark, sf_dir), p.union(own))


@query("locate_with_heading", f"""WITH {MD_LINES}, m AS (SELECT doc_id, line, txt, last_value(CASE WHEN starts_with(txt, '#') AND trim(ltrim(txt, '#')) <> '' THEN {{'a': line, 'b': trim(ltrim(txt, '#'))}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line) AS h FROM l)
SELECT doc_id, line::INT AS line, h.a::INT AS heading, h.b AS title FROM m WHERE contains(txt, 'icense')""")
def locate_with_heading(spark, sf_dir):  # J10
    return text.headed(markdown(spark, sf_dir), "icense")


@query("html_links", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def html_links(spark, sf_dir):  # P10
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))


@query("conversation_search", """SELECT conv_id, max(turn) AS turn, max_by(text[greatest(1, strpos(lower(text), 'the') - 60) : strpos(lower(text), 'the') + 62], turn) AS snippet FROM conversations WHERE text ILIKE '%the%' GROUP BY conv_id""")
def conversation_search(spark, sf_dir):  # X09, W07
    c = table(spark, sf_dir, "conversations").filter(F.ilike("text", F.lit("%the%")))
    at = F.locate("the", F.lower("text"))
    first = F.greatest(F.lit(1), at - 60)
    return c.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by(F.substr("text", first, at + 62 - first + 1), "turn").alias("snippet"))


@query("exact_identifiers", "SELECT doc_id FROM documents WHERE doc_id % 97 IN (0, 7, 14, 21, 28)")
def exact_identifiers(spark, sf_dir):  # F16: ID-7 isn't found in ID-70
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" ID-"), F.col("doc_id") % 97).alias("text"))
    return text.with_identifiers(d, r"ID-[0-9]+", ["ID-0", "ID-7", "ID-14", "ID-21", "ID-28"])


@query("redact", "SELECT doc_id, md5(regexp_replace(regexp_replace(text, 'AKIA[A-Z0-9]{12,}', '[redacted]', 'g'), '(?i)(password|passwd|secret|token)( *[:=] *)[^\\s]+', '\\1\\2[redacted]', 'g')) AS hash FROM documents")
def redact(spark, sf_dir):  # F17, C13
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(S.redact(F.col("text"))).alias("hash"))


#: One text a rule, by doc_id.
SNIFFED = """CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'x' || chr(10) || '-----BEGIN RSA PRIVATE KEY-----' || text WHEN 2 THEN '  ' || chr(10) || ' #!/bin/sh' || chr(10) || text
WHEN 3 THEN 'key: two words' || chr(10) || 'b.c=' || doc_id || chr(10) || '9x: no key' || chr(10) || chr(10) WHEN 4 THEN '日本語の文書です、' || substring(text, 1, 40) WHEN 5 THEN 'int f(){return g[' || doc_id || '];}'
WHEN 6 THEN '/* note' || chr(10) || '-- more' || chr(10) || 'plain ' || doc_id WHEN 7 THEN '  ' || chr(10) || '   ' ELSE text END"""


@query("content_sniff", f"""WITH d AS (SELECT doc_id, {SNIFFED} AS text FROM documents), e AS (SELECT *, greatest(len(text), 1) AS n, list_filter(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c]'), lambda x: regexp_matches(x, '\\S')) AS ls FROM d)
SELECT doc_id, CASE WHEN text = '' THEN 'document' WHEN contains(text, 'PRIVATE KEY-----') THEN 'binary' WHEN len(regexp_extract_all(text, '�')) / n > 0.02 THEN 'binary' WHEN starts_with(ltrim(text, ' ' || chr(9) || chr(10) || chr(13)), '#!') THEN 'code' WHEN len(ls) = 0 THEN 'document'
WHEN len(regexp_extract_all(text, '[\\x{{3040}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9fff}}]')) / n > 0.1 THEN 'document' WHEN len(list_filter(ls, lambda x: regexp_matches(trim(x), '^[A-Za-z_][A-Za-z0-9_.-]*\\s*[:=]\\s*\\S'))) / len(ls) > 0.5 THEN 'code'
WHEN len(regexp_extract_all(text, '[{{}}();<>\\[\\]]')) / n > 0.02 THEN 'code' WHEN len(list_filter(ls, lambda x: starts_with(trim(x), '//') OR starts_with(trim(x), '#') OR starts_with(trim(x), '/*') OR starts_with(trim(x), '--') OR starts_with(trim(x), '*'))) / len(ls) > 0.3 THEN 'code' ELSE 'document' END AS kind FROM e""")
def content_sniff(spark, sf_dir):  # S06
    return table(spark, sf_dir, "documents").select("doc_id", S.sniff(F.expr(SNIFFED)).alias("kind"))
