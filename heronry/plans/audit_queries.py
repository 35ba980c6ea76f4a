"""Queries over call logs, ledgers and log lines, made of events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.operators import audit
from heronry.plans.base import FILES_SQL, Registry, files
from heronry.session import table

query = Registry()
#: Events as calls of tools; every seventh repeats the call before it, every 50th is broken.
CALLS = """c AS (SELECT CASE WHEN event_id % 50 = 49 THEN NULL ELSE event_id - (CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) END AS call, user_id % 4 AS proc, event_id AS seq, ts, event_type AS tool,
CASE user_id % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'sub' ELSE 'x' END AS role, (props->>'k')::BIGINT AS found, value AS ms, CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 9 = 0 THEN 'truncated' ELSE 'ok' END AS status, user_id FROM events)"""


def calls(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    call = F.when(F.col("event_id") % 50 != 49, F.col("event_id") - F.when(F.col("event_id") % 7 == 0, 1).otherwise(0))
    role = F.when(F.col("user_id") % 3 == 0, "main").when(F.col("user_id") % 3 == 1, "sub").otherwise("x")
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_id") % 9 == 0, "truncated").otherwise("ok")
    return e.select(
        call.alias("call"), (F.col("user_id") % 4).alias("proc"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("tool"), role.alias("role"),
        F.get_json_object("props", "$.k").cast("long").alias("found"), F.col("value").alias("ms"), status.alias("status"), "user_id",
    )


@query("call_log_merge", f"""WITH {CALLS}, m AS (SELECT * FROM c WHERE tool <> 'signup' AND call IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY call ORDER BY ts, proc, seq) AS n FROM m), p AS (SELECT proc, count(*) AS kept FROM k WHERE n = 1 GROUP BY proc)
SELECT c.proc, coalesce(any_value(p.kept), 0) AS kept, count(*) FILTER (tool = 'signup') AS other_turn, count(*) FILTER (tool <> 'signup' AND call IS NULL) AS broken, count(*) FILTER (tool <> 'signup' AND call IS NOT NULL) - coalesce(any_value(p.kept), 0) AS duplicates, max(seq) - count(DISTINCT seq) AS gaps FROM c LEFT JOIN p USING (proc) GROUP BY c.proc""")
def call_log_merge(spark, sf_dir):  # M01
    return audit.merge_calls(calls(spark, sf_dir), F.col("tool") != "signup")[1]


@query("tool_totals", f"WITH {CALLS} SELECT tool, CASE WHEN role IN ('main', 'sub') THEN role ELSE 'undetermined' END AS role, count(*) AS calls, sum(found)::BIGINT AS found, round(sum(ms), 3) AS ms, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'truncated') AS truncated FROM c GROUP BY 1, 2")
def tool_totals(spark, sf_dir):  # M02
    return audit.tool_totals(calls(spark, sf_dir), ["main", "sub"])


@query("found_docs", f"WITH {CALLS} SELECT found AS doc, count(*) AS hits, count(DISTINCT seq % 50) AS lines, count(DISTINCT user_id) AS queries, min(seq) AS first_seq FROM c WHERE status <> 'error' GROUP BY found")
def found_docs(spark, sf_dir):  # M03
    c = calls(spark, sf_dir).filter("status <> 'error'")
    return audit.found_docs(c.select(F.col("found").alias("doc"), (F.col("seq") % 50).alias("line"), F.col("user_id").alias("query"), "seq"))


@query("provenance", f"WITH {FILES_SQL} SELECT doc_id, path, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) END AS generation FROM files")
def provenance(spark, sf_dir):  # M07
    return files(spark, sf_dir).select("doc_id", "path", F.when(F.contains("path", F.lit("/")), F.split_part("path", F.lit("/"), F.lit(1))).alias("generation"))


@query("visible_conversations", """WITH c AS (SELECT conv_id, conv_id % 11 AS owner, max(turn) AS last_turn FROM conversations GROUP BY conv_id)
SELECT conv_id, owner, last_turn, CASE WHEN owner = 3 THEN 'own' ELSE 'received' END AS origin FROM c WHERE owner = 3 OR (conv_id % 5 = 0 AND (conv_id + 1) % 7 = 3 AND conv_id % 15 <> 0)""")
def visible_conversations(spark, sf_dir):  # M13
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.col("conv_id") % 11).alias("owner"), F.max("turn").alias("last_turn"))
    shares = table(spark, sf_dir, "conversations").filter("turn = 0 AND conv_id % 5 = 0").select("conv_id", ((F.col("conv_id") + 1) % 7).alias("receiver"), (F.col("conv_id") % 15 == 0).alias("expired"))
    return audit.visible(c, shares, 3)


@query("api_key_calls", "SELECT 'ext:' || user_id AS actor, count(*) AS n FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-20' GROUP BY 1")
def api_key_calls(spark, sf_dir):  # M15
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase' AND ts >= TIMESTAMP_NTZ '2024-01-20'")
    return e.groupBy(F.concat(F.lit("ext:"), "user_id").alias("actor")).agg(F.count(F.lit(1)).alias("n"))


@query("recent_events", "SELECT event_id, user_id, value FROM events WHERE event_type = 'view' AND props->>'k' IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_events(spark, sf_dir):  # M17: the newest 20 are the feature
    e = table(spark, sf_dir, "events").filter("event_type = 'view'").filter(F.get_json_object("props", "$.k").isNotNull())
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id", "value")


@query("failed_documents", "SELECT d.doc_id, 'short' AS reason, (CASE WHEN d.doc_id % 3 = 0 THEN d.doc_id % 5 ELSE 0 END + 1)::BIGINT AS tries FROM documents d WHERE n_chars < 200")
def failed_documents(spark, sf_dir):  # M18
    d = table(spark, sf_dir, "documents")
    old = d.filter("doc_id % 3 = 0").select("doc_id", (F.col("doc_id") % 5).alias("tries"))
    return audit.replace_failures(old, d.filter("n_chars < 200").select("doc_id", F.lit("short").alias("reason")))


@query("latest_run", "SELECT o_custkey, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS run, arg_max(o_orderstatus, struct_pack(a := o_orderdate, b := o_orderkey)) AS state FROM orders GROUP BY o_custkey")
def latest_run(spark, sf_dir):  # M19: max_by combines before the exchange, a window would not
    best = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", best).alias("run"), F.max_by("o_orderstatus", best).alias("state"))


@query("ledger_delta", """SELECT CASE WHEN c_custkey % 4 = 0 AND c_custkey % 3 <> 1 THEN 'conflict' WHEN c_custkey % 4 = 0 AND c_custkey % 8 = 0 THEN 'removed' WHEN c_custkey % 4 = 0 THEN 'applied' ELSE 'kept' END AS status, count(*) AS n,
sum(CASE WHEN c_custkey % 4 = 0 AND c_custkey % 3 = 1 THEN CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE 2 END ELSE c_custkey % 3 END)::BIGINT AS generations FROM customer GROUP BY 1""")
def ledger_delta(spark, sf_dir):  # M22
    c = table(spark, sf_dir, "customer")
    ledger = c.select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 3).alias("generation"), F.col("c_name").alias("value"))
    delta = c.filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("key"), F.lit(1).cast("long").alias("expected"), F.when(F.col("c_custkey") % 8 != 0, F.lit("new")).alias("value"))
    return audit.apply_delta(ledger, delta).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("generation").alias("generations"))


LINES = "l AS (SELECT CASE WHEN event_type = 'error' THEN '[embed] error: row ' || event_id || ' of user ' || user_id % 3 || CASE WHEN user_id % 2 = 0 THEN ' lost' ELSE ' late' END ELSE '[' || event_type || '] doc=' || event_id || ' ms=' || (event_id * 37 % 1000) || '.5' END AS line FROM events)"


def log_lines(spark, sf_dir):
    bad = F.concat(F.lit("[embed] error: row "), "event_id", F.lit(" of user "), F.col("user_id") % 3, F.when(F.col("user_id") % 2 == 0, " lost").otherwise(" late"))
    good = F.concat(F.lit("["), "event_type", F.lit("] doc="), "event_id", F.lit(" ms="), F.col("event_id") * 37 % 1000, F.lit(".5"))
    return table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", bad).otherwise(good).alias("line"))


@query("log_report", f"WITH {LINES} SELECT regexp_extract(line, '\\[(\\w+)\\]', 1) AS stage, count(*) AS n, round(avg(nullif(regexp_extract(line, 'ms=([0-9.]+)', 1), '')::DOUBLE), 6) AS mean, quantile_cont(nullif(regexp_extract(line, 'ms=([0-9.]+)', 1), '')::DOUBLE, 0.5) AS median FROM l GROUP BY 1")
def log_report(spark, sf_dir):  # M23
    f = audit.log_fields(log_lines(spark, sf_dir))
    return f.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ms"), 6).alias("mean"), F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY ms)").alias("median"))


@query("error_groups", f"WITH {LINES} SELECT regexp_replace(regexp_extract(line, 'error: (.*)$', 1), '[0-9]+', '#', 'g') AS error, count(*) AS n FROM l WHERE contains(line, 'error: ') GROUP BY 1")
def error_groups(spark, sf_dir):  # M23
    return audit.log_fields(log_lines(spark, sf_dir)).filter("error IS NOT NULL").groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("turn_timeline", "WITH g AS (SELECT user_id, event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) SELECT user_id, sum(gap) FILTER (event_type IN ('view', 'click'))::BIGINT AS wait_us, sum(gap) FILTER (event_type NOT IN ('view', 'click'))::BIGINT AS tool_us, max(gap) AS longest_us FROM g GROUP BY user_id")
def turn_timeline(spark, sf_dir):  # M24, M25
    g = audit.gaps(table(spark, sf_dir, "events"), "user_id", "ts")
    wait = F.col("event_type").isin("view", "click")
    return g.groupBy("user_id").agg(F.sum(F.when(wait, F.col("gap_us"))).alias("wait_us"), F.sum(F.when(~wait, F.col("gap_us"))).alias("tool_us"), F.max("gap_us").alias("longest_us"))


@query("trial_scores", "SELECT CASE WHEN value IS NULL THEN 'invalid' WHEN event_type = 'error' THEN 'failed' WHEN value > 50 THEN 'counted' ELSE 'uncounted' END AS class, count(*) AS n, round(avg(value), 5) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def trial_scores(spark, sf_dir):  # M26
    kind = F.when(F.col("value").isNull(), "invalid").when(F.col("event_type") == "error", "failed").when(F.col("value") > 50, "counted").otherwise("uncounted")
    p = lambda q: F.round(F.expr(f"percentile_cont({q}) WITHIN GROUP (ORDER BY value)"), 6)
    return table(spark, sf_dir, "events").groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 5).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"))


WORDS = "SELECT DISTINCT conv_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM conversations WHERE role ="


@query("preserved_words", f"WITH u AS ({WORDS} 'user'), a AS ({WORDS} 'assistant') SELECT u.conv_id, count(*) AS words, count(a.word) AS kept FROM u LEFT JOIN a ON a.conv_id = u.conv_id AND a.word = u.word GROUP BY u.conv_id")
def preserved_words(spark, sf_dir):  # M29
    c = table(spark, sf_dir, "conversations")
    return audit.preserved(c.filter("role = 'user'"), c.filter("role = 'assistant'"), "conv_id")
