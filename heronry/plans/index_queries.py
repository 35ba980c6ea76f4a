"""Queries on a stored keyword index, written below the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.operators import index, search
from heronry.plans.base import Registry
from heronry.plans.text_queries import BM25, QUERY_TERMS
from heronry.session import new_folder, table

query = Registry()


def built(spark, sf_dir, fields=("text",)):
    """An index of all documents; source and language are fields of labels and context."""
    root = new_folder(spark, "index")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("labels"), F.concat_ws(" ", "lang", F.lit("version"), "source").alias("region_context"))
    index.change(spark, root, d, fields=list(fields))
    return root, d


@query("indexed_bm25", f"WITH {BM25} SELECT doc_id AS doc, score FROM b")
def indexed_bm25(spark, sf_dir):  # K01, T02
    return index.search(spark, built(spark, sf_dir)[0], QUERY_TERMS)


@query("weighted_fields", """WITH d AS (SELECT doc_id, unnest(['text', 'labels', 'region_context']) AS field, unnest([regexp_extract_all(lower(text), '[a-z0-9_]+'), regexp_extract_all(lower(source), '[a-z0-9_]+'), regexp_extract_all(lower(lang || ' version ' || source), '[a-z0-9_]+')]) AS x FROM documents),
n AS (SELECT field, count(*) AS n, avg(len(x)) AS avgdl FROM d GROUP BY field), tf AS (SELECT doc_id, field, len(x) AS dl, term, count(*) AS tf FROM (SELECT *, unnest(x) AS term FROM d) WHERE term IN ('licensed', 'version', 'src3', 'de') GROUP BY ALL), df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT doc_id, field, CASE WHEN field = 'text' THEN 1.0 ELSE 0.3 END::DOUBLE * sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s FROM tf JOIN df USING (field, term) JOIN n USING (field) GROUP BY doc_id, field)
SELECT doc_id AS doc, round(max(s) + 0.1::DOUBLE * (sum(s) - max(s)), 6) AS score FROM s GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 40""")
def weighted_fields(spark, sf_dir):  # X21, T02
    root, _ = built(spark, sf_dir, index.FIELDS)
    return index.search(spark, root, ["licensed", "version", "src3", "de"], 40, index.FIELDS)


CHANGED = "(SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'Licensed now, version ' || doc_id ELSE text END AS text FROM documents WHERE doc_id % 10 <> 2)"


@query("replaced_documents", f"WITH {BM25.replace('FROM documents', f'FROM {CHANGED}').replace('LIMIT 10', 'LIMIT 30')} SELECT doc_id AS doc, score FROM b")
def replaced_documents(spark, sf_dir):  # K01, K03
    root, d = built(spark, sf_dir)
    text = F.concat(F.lit("Licensed now, version "), F.col("doc_id").cast("string"))
    index.change(spark, root, d.filter("doc_id % 10 = 1").withColumn("text", F.lit("apache")))
    index.change(spark, root, d.filter("doc_id % 10 = 1").withColumn("text", text), removed=d.filter("doc_id % 10 = 2"))
    return index.search(spark, root, QUERY_TERMS, 30)


@query("phrase_hits", """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS x FROM documents), p AS (SELECT doc_id, unnest(range(1, len(x))) AS i, x FROM t)
SELECT doc_id AS doc, count(*)::INT AS n FROM p WHERE x[i] = 'of' AND x[i + 1] = 'the' GROUP BY doc_id""")
def phrase_hits(spark, sf_dir):  # K01
    return index.phrase(spark, built(spark, sf_dir)[0], ["of", "the"])


#: Hits of three engines: places from ids, some without snippet; graph hits twice or more, by up to eight paths and with several judgements.
KEYWORD = "SELECT 'keyword' AS engine, doc_id AS key, n_chars * -1 AS place, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'k' || doc_id END AS snippet, doc_id % 9 AS line, NULL AS judgement, NULL AS path FROM documents WHERE doc_id % 2 = 0"
VECTOR = "SELECT 'vector', doc_id, doc_id * 37 % 101 * 1000 + doc_id, 'v' || doc_id, NULL, NULL, NULL FROM documents WHERE doc_id % 3 = 0"
GRAPH = "SELECT 'graph', doc_id, (doc_id * 13 % 89 + x) * 1000 + doc_id, CASE WHEN x = 0 THEN 'g' || doc_id END, x, CASE (doc_id + x) % 4 WHEN 0 THEN 'sure' WHEN 1 THEN 'review' WHEN 2 THEN 'presumed' END, 'p' || x FROM documents, (SELECT explode(sequence(0, 7)) AS x) WHERE doc_id % 5 = 0 AND x <= doc_id % 8"
HITS = f"{KEYWORD} UNION ALL {VECTOR} UNION ALL {GRAPH}"


@query("fused_hits", f"""WITH h AS ({HITS.replace("explode(sequence(0, 7))", "unnest(range(8))")}), o AS (SELECT engine, key, min(place) AS place, arg_min(snippet, place) AS snip, arg_min(line, place) AS line, arg_min(snippet IS NULL, place) AS no_snip, min(CASE judgement WHEN 'sure' THEN 0 WHEN 'review' THEN 1 WHEN 'presumed' THEN 2 END) AS j, list_sort(list(DISTINCT path) FILTER (engine = 'graph')) AS p FROM h GROUP BY engine, key),
r AS (SELECT *, row_number() OVER (PARTITION BY engine ORDER BY place, key) AS rank, CASE engine WHEN 'keyword' THEN 0 WHEN 'vector' THEN 1 ELSE 2 END AS e, CASE WHEN no_snip THEN NULL ELSE snip END AS snippet FROM o),
m AS (SELECT key, round(sum(CASE engine WHEN 'vector' THEN 0.5 ELSE 1.0 END::DOUBLE * CASE WHEN engine = 'graph' THEN CASE j WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 WHEN 2 THEN 0.3 ELSE 1.0 END ELSE 1.0 END::DOUBLE / (60 + rank)), 6) AS score, string_agg(engine || ':' || rank, ',' ORDER BY e) AS sources, arg_min(snippet, e) FILTER (coalesce(snippet, '') <> '') AS snippet, min(e) FILTER (coalesce(snippet, '') <> '') AS se, max(CASE WHEN engine = 'graph' THEN j END) AS j, max(p) FILTER (engine = 'graph') AS p FROM r GROUP BY key)
SELECT m.key, score, sources, m.snippet, r.line::BIGINT AS line, CASE m.j WHEN 0 THEN 'sure' WHEN 1 THEN 'review' WHEN 2 THEN 'presumed' END AS judgement, coalesce(m.p[1:5], []) AS paths, greatest(len(coalesce(m.p, [])) - 5, 0)::INT AS omitted FROM m LEFT JOIN r ON r.key = m.key AND r.e = se ORDER BY score DESC, m.key LIMIT 60""")
def fused_hits(spark, sf_dir):  # X07, W05, U01
    h = spark.sql(HITS.replace("FROM documents", "FROM {d}"), d=table(spark, sf_dir, "documents"))
    return search.fused(h, {"vector": 0.5}, 60)
