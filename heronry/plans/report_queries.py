"""Queries of reports, cards and period checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.operators import reports, search
from heronry.plans.base import Registry
from heronry.session import table

query = Registry()


@query("scope_validity", "SELECT c_custkey, c_nationkey IN (SELECT s_nationkey FROM supplier) AS valid FROM customer")
def scope_validity(spark, sf_dir):  # F06
    known = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey")).distinct().withColumn("k", F.lit(1))
    return table(spark, sf_dir, "customer").join(known, "c_nationkey", "left").select("c_custkey", F.col("k").isNotNull().alias("valid"))


@query("existing_hits", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 1 OR l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def existing_hits(spark, sf_dir):  # F14
    hits = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 1, F.col("l_partkey")).alias("p_partkey"))
    return reports.existing_hits(hits, table(spark, sf_dir, "part").filter("p_size > 10"), "p_partkey").select("l_orderkey", "l_linenumber")


@query("pruned_evidence", "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 1 THEN ['s1/x', 's1/y'] ELSE ['s1/y'] END AS paths FROM orders")
def pruned_evidence(spark, sf_dir):  # F10, F15
    paths = F.array(F.concat(F.lit("s"), F.col("o_custkey") % 3, F.lit("/x")), F.lit("s1/y"), F.lit("s10/z"))
    return reports.in_scope_only(table(spark, sf_dir, "orders").select("o_orderkey", paths.alias("paths")), "paths", "s1")


@query("table_resolution", """WITH r AS (SELECT c_custkey AS ref_id, CASE WHEN c_custkey % 2 = 0 THEN 's' || (c_custkey % 5) END AS sch, c_custkey % 40 AS name FROM customer), d AS (SELECT s_suppkey AS def_id, CASE WHEN s_suppkey % 3 > 0 THEN 's' || (s_suppkey % 7) END AS s, s_suppkey % 60 AS name FROM supplier),
g AS (SELECT ref_id, sch, count(def_id) FILTER (s = sch) AS ne, min(def_id) FILTER (s = sch) AS de, count(def_id) FILTER (s IS NULL) AS nb, min(def_id) FILTER (s IS NULL) AS db, count(def_id) AS n, min(def_id) AS d FROM r LEFT JOIN d USING (name) GROUP BY ALL), x AS (SELECT ref_id, CASE WHEN sch IS NULL THEN n WHEN ne > 0 THEN ne ELSE nb END AS k, CASE WHEN sch IS NULL THEN d WHEN ne > 0 THEN de ELSE db END AS v FROM g)
SELECT ref_id, CASE WHEN k = 1 THEN v END AS def_id, CASE WHEN k = 1 THEN 'resolved' WHEN k > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status FROM x""")
def table_resolution(spark, sf_dir):  # J02
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    refs = table(spark, sf_dir, "customer").select(c.alias("ref_id"), F.when(c % 2 == 0, F.concat(F.lit("s"), c % 5)).alias("schema"), (c % 40).alias("name"))
    return reports.tables(refs, table(spark, sf_dir, "supplier").select(s.alias("def_id"), F.when(s % 3 > 0, F.concat(F.lit("s"), s % 7)).alias("schema"), (s % 60).alias("name")))


@query("stopped_turns", "SELECT a.o_orderkey, a.o_custkey::VARCHAR AS conv, CASE WHEN a.o_orderkey % 2 = 0 THEN a.o_totalprice ELSE -1.0 END AS price FROM orders a")
def stopped_turns(spark, sf_dir):  # J16, C05
    o = table(spark, sf_dir, "orders")
    detail = F.concat(F.lit('{"message":"'), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).otherwise("x"), F.lit('"}'))
    audit = o.select("o_orderkey", F.concat(F.lit("conv:"), "o_custkey").alias("resource"), detail.alias("detail"))
    audit = audit.select("o_orderkey", F.regexp_extract("resource", "^conv:(.*)$", 1).alias("conv"), F.get_json_object("detail", "$.message").try_cast("bigint").alias("id"))
    return audit.join(o.select(F.col("o_orderkey").alias("id"), "o_totalprice"), "id", "left").select("o_orderkey", "conv", F.coalesce("o_totalprice", F.lit(-1.0)).alias("price"))


@query("json_pairs", "SELECT o_orderkey, 'a' AS key, o_custkey AS value FROM orders UNION ALL SELECT o_orderkey, 'b', 2 FROM orders")
def json_pairs(spark, sf_dir):  # J18, C15
    made = F.concat(F.lit('{"a":'), "o_custkey", F.lit(',"b":2}'))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.from_json(made, "map<string,bigint>")).alias("key", "value"))


@query("evidence_cards", "WITH g AS (SELECT DISTINCT o_custkey AS k FROM orders), t AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000) SELECT coalesce(g.k, t.k) AS doc, CASE WHEN g.k IS NULL THEN 'grep' WHEN t.k IS NULL THEN 'graph' ELSE 'both' END AS source FROM g FULL JOIN t ON g.k = t.k")
def evidence_cards(spark, sf_dir):  # J20, G08
    return reports.cards(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc")), table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("doc")), "doc")


@query("limits_by_provider", "SELECT l_returnflag AS provider, CASE WHEN l_returnflag <> 'R' THEN count(*) FILTER (l_discount > 0) END AS hit, CASE WHEN l_returnflag <> 'R' THEN sum(round(l_discount * 100)::BIGINT)::BIGINT END AS total, count(*) FILTER (l_tax > 0.02) AS taxed FROM lineitem GROUP BY 1")
def limits_by_provider(spark, sf_dir):  # A08
    measured = F.col("provider") != "R"
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("provider")).agg(F.count_if(F.col("l_discount") > 0).alias("h"), F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("t"), F.count_if(F.col("l_tax") > 0.02).alias("taxed"))
    return g.select("provider", F.when(measured, F.col("h")).alias("hit"), F.when(measured, F.col("t")).alias("total"), "taxed")


@query("three_states", "SELECT l_linestatus AS mode, count(*) FILTER (l_returnflag = 'A') AS yes, count(*) FILTER (l_returnflag = 'R') AS no, count(*) FILTER (l_returnflag = 'N') AS unknown FROM lineitem GROUP BY 1")
def three_states(spark, sf_dir):  # A10, A22
    flag = F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("mode")).agg(F.count_if(flag).alias("yes"), F.count_if(~flag).alias("no"), F.count_if(flag.isNull()).alias("unknown"))


@query("kind_matrix", "SELECT 'chat' AS kind, count(*) AS n, NULL::DOUBLE AS most FROM orders UNION ALL SELECT event_type, count(*), max(value) FROM events GROUP BY 1")
def kind_matrix(spark, sf_dir):  # A17, A18
    chat = table(spark, sf_dir, "orders").groupBy(F.lit("chat").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return reports.stacked([chat, table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))])


@query("unresolved_capped", "SELECT * FROM (SELECT l_orderkey AS doc, l_linenumber AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nth, greatest(count(*) OVER (PARTITION BY l_orderkey) - 2, 0) AS overflow FROM lineitem) WHERE nth <= 2")
def unresolved_capped(spark, sf_dir):  # A27, G12
    return reports.capped(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line")), "doc", "line", 2)


@query("period_parents", "WITH f AS (SELECT DISTINCT o_custkey % 50 AS project, 'P' || (o_orderkey % 12) || 'th' AS folder, o_orderkey % 12 AS n FROM orders) SELECT project, folder, lag(folder) OVER (PARTITION BY project ORDER BY n) AS parent FROM f")
def period_parents(spark, sf_dir):  # W08, C09, D08
    return reports.period_parents(table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("project"), F.concat(F.lit("P"), F.col("o_orderkey") % 12, F.lit("th")).alias("folder")))


@query("neighbour_periods", "WITH r AS (SELECT DISTINCT year(o_orderdate)::INT AS period, o_custkey AS path FROM orders), p AS (SELECT period, lead(period) OVER (ORDER BY period) AS after FROM (SELECT DISTINCT period FROM r)) SELECT p.period, p.after, (SELECT count(*) FROM r a JOIN r b ON a.path = b.path WHERE a.period = p.period AND b.period = p.after) AS same FROM p WHERE after IS NOT NULL")
def neighbour_periods(spark, sf_dir):  # W09, D06
    return reports.shared_by_neighbours(table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("period"), F.col("o_custkey").alias("path")))


@query("top_conversations", "SELECT o_custkey AS id, count(*) AS turns, list_sort(list(DISTINCT o_orderstatus)) AS kinds FROM orders GROUP BY 1 ORDER BY turns DESC, id LIMIT 20")
def top_conversations(spark, sf_dir):  # T04
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("turns"), F.array_sort(F.collect_set("o_orderstatus")).alias("kinds"))
    return g.orderBy(F.desc("turns"), "id").limit(20)


@query("logical_lines", "SELECT o_orderkey AS doc_id, 1 AS line, 'a' AS txt FROM orders UNION ALL SELECT o_orderkey, 2, 'b' FROM orders UNION ALL SELECT o_orderkey, 3, o_custkey::VARCHAR FROM orders")
def logical_lines(spark, sf_dir):  # X04
    return reports.logical_lines(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("a\r\nb\f"), "o_custkey").alias("text")))


@query("merged_graph_hits", "SELECT l_partkey AS key, list_sort(list(DISTINCT l_orderkey))[1:5] AS paths, min(l_returnflag) AS judgement FROM lineitem GROUP BY 1")
def merged_graph_hits(spark, sf_dir):  # X08
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("path"), F.col("l_returnflag").alias("judgement"))
    return search.merged_hits(hits, 5)


@query("fallback_terms", "SELECT 'an' AS term, doc_id FROM documents WHERE contains(lower(text), 'an') AND NOT EXISTS (SELECT 1 FROM documents WHERE contains(lower(text), 'qqxqqxqq'))")
def fallback_terms(spark, sf_dir):  # X10, D04
    return reports.first_term_with_hits(table(spark, sf_dir, "documents"), "an qqxqqxqq")


@query("related_documents", "SELECT DISTINCT l_orderkey AS doc, l_partkey AS id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1)")
def related_documents(spark, sf_dir):  # G06
    wanted = table(spark, sf_dir, "part").filter("p_size = 1").select(F.col("p_partkey").alias("id"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("id")).join(wanted, "id", "left_semi").distinct()
