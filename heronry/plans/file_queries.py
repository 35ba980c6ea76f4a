"""Queries over paths, scopes, rules and manifests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heronry.functions import scalars as S
from heronry.operators import maintenance
from heronry.plans.base import FILES_SQL, Registry, files
from heronry.session import table

query = Registry()
ANC = f"{FILES_SQL}, a AS (SELECT doc_id, path, unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS folder FROM files)"
CODE = ", ".join(repr(x) for x in S.CODE_EXT)
DOC = ", ".join(repr(x) for x in S.DOC_EXT)
EXT = "regexp_extract(path, '\\.([^./]+)$', 1)"


@query("scan_classified", f"""WITH {FILES_SQL} SELECT doc_id, path, CASE WHEN {EXT} IN ({CODE}) THEN 'code' WHEN {EXT} IN ({DOC}) THEN 'document' END AS kind FROM files WHERE {EXT} NOT IN ('tmp', 'bak', 'swp', 'lock', 'key', 'pem', 'ppk', 'env')""")
def scan_classified(spark, sf_dir):  # S01-S05, S07, S08
    p = F.col("path")
    return files(spark, sf_dir).filter(~S.is_noise(p) & ~S.is_secret_name(p) & ~S.has_vcs_dir(p)).select("doc_id", "path", S.file_class(p).alias("kind"))


@query("scope_normalise", "SELECT doc_id, [source, lang] AS scopes FROM documents WHERE source <> lang")
def scope_normalise(spark, sf_dir):  # F01
    raw = F.array(F.concat(F.lit(" "), "source"), F.lit(" "), F.col("lang"), F.col("source"))
    return table(spark, sf_dir, "documents").filter("source <> lang").select("doc_id", S.normalise_scopes(raw).alias("scopes"))


@query("scope_filter", f"WITH {FILES_SQL} SELECT doc_id, path FROM files WHERE path LIKE 'src1/%' OR path LIKE 'src2/en/%'")
def scope_filter(spark, sf_dir):  # F02
    return files(spark, sf_dir).filter(S.in_scope(F.col("path"), ["src1", "src2/en"])).select("doc_id", "path")


@query("scope_meta", f"WITH {FILES_SQL} SELECT doc_id, string_split(path, '/')[1] AS top_scope, string_split(path, '/')[2] AS phase, string_split(path, '/')[3] AS category FROM files")
def scope_meta(spark, sf_dir):  # F04
    at = lambda i: F.try_element_at(S.parts(F.col("path")), F.lit(i))
    return files(spark, sf_dir).select("doc_id", at(1).alias("top_scope"), at(2).alias("phase"), at(3).alias("category"))


@query("scope_tree", f"WITH {ANC} SELECT folder, len(string_split(folder, '/')) - 1 AS depth, count(*) AS docs FROM a GROUP BY folder")
def scope_tree(spark, sf_dir):  # F03, F05
    a = files(spark, sf_dir).select(F.explode(S.ancestors(F.col("path"))).alias("folder"))
    return a.groupBy("folder").agg(F.count(F.lit(1)).alias("docs")).select("folder", (F.size(S.parts(F.col("folder"))) - 1).cast("long").alias("depth"), "docs")


@query("folder_tree", f"""WITH {ANC}, d AS (SELECT folder, count(*) AS total, count(*) FILTER (regexp_replace(path, '/[^/]*$', '') = folder) AS direct FROM a GROUP BY folder),
c AS (SELECT regexp_replace(folder, '/[^/]*$', '') AS folder, count(*) AS children FROM d WHERE contains(folder, '/') GROUP BY 1)
SELECT d.folder, total AS total_files, direct AS direct_files, coalesce(children, 0) AS child_folders FROM d LEFT JOIN c ON d.folder = c.folder WHERE len(string_split(d.folder, '/')) <= 3""")
def folder_tree(spark, sf_dir):  # A24
    parent = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    a = files(spark, sf_dir).select("path", F.explode(S.ancestors(F.col("path"))).alias("folder"))
    d = a.groupBy("folder").agg(F.count(F.lit(1)).alias("total_files"), F.count_if(parent(F.col("path")) == F.col("folder")).alias("direct_files"))
    c = d.filter(F.contains("folder", F.lit("/"))).groupBy(parent(F.col("folder")).alias("folder")).agg(F.count(F.lit(1)).alias("n"))
    return d.join(c, "folder", "left").filter(F.size(S.parts(F.col("folder"))) <= 3).select("folder", "total_files", "direct_files", F.coalesce("n", F.lit(0)).alias("child_folders"))


@query("layer_filter", f"WITH {FILES_SQL} SELECT doc_id FROM files WHERE {EXT} NOT IN ({DOC})")
def layer_filter(spark, sf_dir):  # unknown kinds pass
    return files(spark, sf_dir).filter(S.in_layer(F.col("path"), "code")).select("doc_id")


@query("path_rules", f"WITH {FILES_SQL} SELECT doc_id, path, starts_with(path, 'src3/de/') AS priority FROM files WHERE NOT starts_with(path, 'src3/en/') AND starts_with(path, 'src3/') ORDER BY priority DESC, path LIMIT 40")
def path_rules(spark, sf_dir):  # F08, T05: exclusion before the limit, priority first
    f = files(spark, sf_dir).filter(S.in_scope(F.col("path"), ["src3"]) & ~S.in_scope(F.col("path"), ["src3/en"]))
    return f.select("doc_id", "path", S.in_scope(F.col("path"), ["src3/de"]).alias("priority")).orderBy(F.desc("priority"), "path").limit(40)


@query("rule_collapse", f"WITH {ANC}, r AS (SELECT DISTINCT folder FROM a WHERE hash(folder) IS NOT NULL AND length(folder) % 3 <> 1) SELECT folder FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE starts_with(r.folder, o.folder || '/'))")
def rule_collapse(spark, sf_dir):  # rules below another rule go
    r = files(spark, sf_dir).select(F.explode(S.ancestors(F.col("path"))).alias("folder")).filter(F.length("folder") % 3 != 1).distinct()
    up = r.select("folder", F.explode(S.ancestors(F.col("folder"))).alias("up"))
    covered = up.join(r.withColumnRenamed("folder", "up"), "up", "left_semi").select("folder").distinct()
    return r.join(covered, "folder", "left_anti")


@query("list_docs", f"WITH {FILES_SQL}, m AS (SELECT doc_id, path FROM files WHERE path LIKE 'src%/en/%' AND contains(lower(path), 'f1')) SELECT doc_id, path, (SELECT count(*) FROM m) AS total FROM m ORDER BY path LIMIT 20 OFFSET 10")
def list_docs(spark, sf_dir):  # F11, T08
    m = files(spark, sf_dir).filter(F.col("path").rlike("^src[0-9]+/en/") & F.contains(F.lower("path"), F.lit("f1")))
    total = m.agg(F.count(F.lit(1)).alias("total"))
    return m.select("doc_id", "path").orderBy("path").offset(10).limit(20).join(F.broadcast(total))


@query("glob_search", f"WITH {FILES_SQL} SELECT doc_id, path FROM files WHERE regexp_matches(path, '^src1[^/]*/[^/]+/d[0-3]/f[^/]*\\.md$')")
def glob_search(spark, sf_dir):  # F12
    return files(spark, sf_dir).filter(F.lower("path").rlike(S.glob_regex("src1*/*/d[0-3]/f*.md"))).select("doc_id", "path")


@query("glob_any_depth", f"WITH {FILES_SQL} SELECT doc_id FROM files WHERE regexp_matches(path, '/f[^/]\\.[^/]*$')")
def glob_any_depth(spark, sf_dir):  # F12
    return files(spark, sf_dir).filter(F.lower("path").rlike(S.glob_regex("F?.*"))).select("doc_id")


@query("csv_guard", "SELECT event_id, CASE WHEN round(value, 2) < 5 THEN '''=' || event_type ELSE event_type END AS cell FROM events")
def csv_guard(spark, sf_dir):  # K10
    raw = F.when(F.round("value", 2) < 5, F.concat(F.lit("="), "event_type")).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", S.csv_safe(raw).alias("cell"))


@query("code_names", "SELECT p_partkey, upper(rtrim(trim(p_name), '.')) AS name FROM part")
def code_names(spark, sf_dir):  # C01
    return table(spark, sf_dir, "part").select("p_partkey", S.code_name(F.concat(F.lit("  "), "p_name", F.lit("..  "))).alias("name"))


@query("importance_rules", f"""WITH {ANC}, r(folder, level) AS (VALUES ('src1', 'low'), ('src1/en', 'high'), ('src1/en/d2', 'none'), ('src4', 'high')),
m AS (SELECT a.doc_id, arg_max(level, len(a.folder)) AS level FROM a JOIN r USING (folder) GROUP BY a.doc_id) SELECT doc_id, level FROM m WHERE level <> 'none'""")
def importance_rules(spark, sf_dir):  # D07: the deepest folder's rule wins
    r = spark.createDataFrame([("src1", "low"), ("src1/en", "high"), ("src1/en/d2", "none"), ("src4", "high")], "folder string, level string")
    a = files(spark, sf_dir).select("doc_id", F.explode(S.ancestors(F.col("path"))).alias("folder"))
    return a.join(r, "folder").groupBy("doc_id").agg(F.max_by("level", F.length("folder")).alias("level")).filter("level <> 'none'")


@query("manifest_diff", """WITH o AS (SELECT doc_id, n_chars FROM documents WHERE doc_id % 10 <> 3), n AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 11 <> 5)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS state FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE o.n_chars IS DISTINCT FROM n.n_chars""")
def manifest_diff(spark, sf_dir):  # J21
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    new = d.filter("doc_id % 11 <> 5").withColumn("n_chars", F.when(F.col("doc_id") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return maintenance.diff(d.filter("doc_id % 10 <> 3"), new, "doc_id", "n_chars")


@query("change_signature", "SELECT source, sha256(string_agg(sha256(doc_id || '|' || n_chars), '' ORDER BY doc_id)) AS signature FROM documents GROUP BY source")
def change_signature(spark, sf_dir):  # R01
    return maintenance.signature(table(spark, sf_dir, "documents"), ["source"], "doc_id", "n_chars")


@query("backfill_missing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def backfill_missing(spark, sf_dir):  # R05, U05, K04
    return maintenance.missing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("path_suffix", f"""WITH {FILES_SQL}, s AS (SELECT doc_id, array_to_string(string_split(path, '/')[-2:], '/') AS suffix, string_split(path, '/')[1] AS top FROM files), u AS (SELECT top, suffix, min(doc_id) AS target, count(*) AS n FROM s GROUP BY ALL)
SELECT s.doc_id, CASE WHEN n = 1 THEN target END AS target, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM s LEFT JOIN u ON s.top = u.top AND u.suffix = regexp_replace(s.suffix, 'f[0-9]+', 'f' || (s.doc_id // 2))""")
def path_suffix(spark, sf_dir):  # J06
    p = S.parts(F.col("path"))
    s = files(spark, sf_dir).select("doc_id", F.array_join(F.slice(p, -2, 2), "/").alias("suffix"), F.element_at(p, 1).alias("top"))
    u = s.groupBy("top", "suffix").agg(F.min("doc_id").alias("t"), F.count(F.lit(1)).alias("n"))
    refs = s.select("doc_id", "top", F.regexp_replace("suffix", F.lit("f[0-9]+"), F.concat(F.lit("f"), F.floor(F.col("doc_id") / 2).cast("string"))).alias("suffix"))
    status = F.when(F.col("n").isNull(), "unresolved").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    return refs.join(u, ["top", "suffix"], "left").select("doc_id", F.when(F.col("n") == 1, F.col("t")).alias("target"), status.alias("status"))


@query("byte_page", "WITH j AS (SELECT doc_id, sum(strlen(text)) OVER (ORDER BY doc_id) AS upto FROM documents WHERE source = 'src1') SELECT doc_id, upto::BIGINT AS upto FROM j WHERE upto <= 60000 OR doc_id = (SELECT min(doc_id) FROM j)")
def byte_page(spark, sf_dir):  # T06: a page by bytes, at least one item
    d = table(spark, sf_dir, "documents").filter("source = 'src1'")
    w = Window.partitionBy("source").orderBy("doc_id")
    j = d.select("doc_id", F.sum(F.octet_length("text")).over(w).alias("upto"), F.row_number().over(w).alias("nth"))
    return j.filter("upto <= 60000 OR nth = 1").select("doc_id", "upto")
