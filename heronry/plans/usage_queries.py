"""Usage and audit analytics over events and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heronry.operators import usage
from heronry.plans.base import Registry
from heronry.session import table

query = Registry()
TURNS = """m AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS turn_no FROM conversations),
t AS (SELECT conv_id, turn_no::BIGINT AS turn_no, max(turn) FILTER (role = 'user') AS asked, min(turn) FILTER (role = 'assistant') AS reply FROM m WHERE turn_no > 0 GROUP BY ALL)"""


@query("turn_pairs", f"WITH {TURNS} SELECT * FROM t")
def turn_pairs(spark, sf_dir):  # J13, J14, W01, W03
    return usage.turns(table(spark, sf_dir, "conversations"))


@query("turn_distribution", f"WITH {TURNS}, c AS (SELECT conv_id, count(*) AS n, count(reply) AS answered FROM t GROUP BY conv_id) SELECT round(avg(n), 6) AS mean, quantile_cont(n, 0.5) AS median, max(n) AS most, quantile_disc(n, 0.9) AS p90, round(count(*) FILTER (n >= 2 AND answered = n) / nullif(count(*) FILTER (n >= 2), 0), 6) AS rate FROM c")
def turn_distribution(spark, sf_dir):  # A15, A16
    c = usage.turns(table(spark, sf_dir, "conversations")).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count("reply").alias("answered"))
    return c.agg(F.round(F.avg("n"), 6).alias("mean"), F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY n)").alias("median"), F.max("n").alias("most"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY n)").cast("long").alias("p90"), F.round(F.count_if((F.col("n") >= 2) & (F.col("answered") == F.col("n"))) / F.nullif(F.count_if(F.col("n") >= 2), F.lit(0)), 6).alias("rate"))


@query("per_user", "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, count(DISTINCT ts::DATE) AS days, max(ts) AS last, count(*) FILTER (event_type = 'error') AS errors, list_sort(list(DISTINCT event_type)) AS types, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS rate FROM events GROUP BY user_id")
def per_user(spark, sf_dir):  # A01
    e = table(spark, sf_dir, "events")
    bad = F.count_if(F.col("event_type") == "error")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("kinds"), F.count_distinct(F.to_date("ts")).alias("days"), F.max("ts").alias("last"), bad.alias("errors"), F.array_sort(F.collect_set("event_type")).alias("types"), F.round(bad / F.count(F.lit(1)), 6).alias("rate"))


@query("daily", "SELECT (ts + INTERVAL 9 HOUR)::DATE::VARCHAR AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def daily(spark, sf_dir):  # A02, C06: days at UTC+9
    day = F.to_date(F.col("ts") + F.expr("INTERVAL 9 HOURS"))
    return table(spark, sf_dir, "events").groupBy(day.cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("heatmap", "SELECT extract(dow FROM ts)::INT AS dow, extract(hour FROM ts)::INT AS hour, count(*) AS n FROM events GROUP BY ALL")
def heatmap(spark, sf_dir):  # A03
    return usage.heatmap(table(spark, sf_dir, "events"))


@query("retention", "WITH w AS (SELECT DISTINCT user_id, date_trunc('week', ts)::DATE AS wk FROM events) SELECT w.wk::VARCHAR AS wk, count(*) AS active, count(n.user_id) AS revisited FROM w LEFT JOIN w n ON n.user_id = w.user_id AND n.wk = w.wk + 7 GROUP BY w.wk")
def retention(spark, sf_dir):  # A04, J17
    return usage.retention(table(spark, sf_dir, "events")).withColumn("wk", F.col("wk").cast("string"))


@query("token_sums", "SELECT event_type, sum((props->>'k')::BIGINT)::BIGINT AS k, count(*) FILTER (props->>'k' IS NULL) AS unknown FROM events GROUP BY event_type")
def token_sums(spark, sf_dir):  # A05, A06, C05
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count_if(k.isNull()).alias("unknown"))


@query("vocabulary_histogram", "SELECT CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type ELSE 'unknown' END AS kind, count(*) AS n FROM events WHERE event_type IS DISTINCT FROM 'signup' GROUP BY 1")
def vocabulary_histogram(spark, sf_dir):  # A07, C07
    e = table(spark, sf_dir, "events").filter(~F.col("event_type").eqNullSafe("signup"))
    return e.groupBy(F.when(F.col("event_type").isin("click", "view", "purchase"), F.col("event_type")).otherwise("unknown").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("response_time", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most, quantile_cont(value, 0.5) AS median, quantile_disc(value, 0.9) AS p90 FROM events GROUP BY GROUPING SETS ((), (event_type))")
def response_time(spark, sf_dir):  # A11, A12
    table(spark, sf_dir, "events").createOrReplaceTempView("heronry_events")
    return spark.sql("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most, percentile_cont(0.5) WITHIN GROUP (ORDER BY value) AS median, percentile_disc(0.9) WITHIN GROUP (ORDER BY value) AS p90 FROM heronry_events GROUP BY GROUPING SETS ((), (event_type))")


@query("rollup_coarse", "WITH f AS (SELECT event_type, (ts::DATE) AS day, count(*) AS n, sum(value) AS v FROM events GROUP BY ALL) SELECT event_type, sum(n)::BIGINT AS n, round(sum(v) / sum(n), 5) AS mean FROM f GROUP BY event_type")
def rollup_coarse(spark, sf_dir):  # A13, A14
    f = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    return f.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("v") / F.sum("n"), 5).alias("mean"))


@query("tool_stats", "SELECT event_type, map_from_entries(list((k, n) ORDER BY k)) AS by_role FROM (SELECT event_type, (user_id % 3)::VARCHAR AS k, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type")
def tool_stats(spark, sf_dir):  # A09, M02: as entries, sorted
    g = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 3).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("event_type").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("by_role"))


@query("as_of", """WITH v AS (SELECT user_id, ts, event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events WHERE event_type = 'view')
SELECT e.event_id, max(v.event_id) AS after_view FROM events e LEFT JOIN v ON v.user_id = e.user_id AND e.ts >= v.ts AND (v.nxt IS NULL OR e.ts < v.nxt) WHERE e.event_type = 'purchase' GROUP BY e.event_id""")
def as_of(spark, sf_dir):  # J15, W02: the last view at or before each purchase
    e = table(spark, sf_dir, "events").filter("event_type IN ('view', 'purchase')")
    is_view = F.col("event_type") == "view"
    order = Window.partitionBy("user_id").orderBy("ts", F.when(is_view, 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(is_view, F.col("event_id")), ignorenulls=True).over(order)
    return e.withColumn("after_view", last).filter("event_type = 'purchase'").select("event_id", "after_view")


@query("latest_per_group", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest_per_group(spark, sf_dir):  # W06, J25, M19
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("ts").alias("ts"))


@query("chain_verified", """WITH b AS (SELECT user_id, event_id, concat_ws('|', event_id, user_id, event_type) AS body, event_id % 997 = 5 AS edited FROM events), p AS (SELECT *, lag(edited) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM b)
SELECT user_id, count(*) AS n, min(CASE WHEN edited OR before THEN event_id END) AS broken_at FROM p GROUP BY user_id""")
def chain_verified(spark, sf_dir):  # W04: rows edited after their hashes were taken
    e = table(spark, sf_dir, "events")
    rows = e.select("user_id", "event_id", F.when(F.col("event_id") % 997 == 5, "edited").otherwise(F.col("event_type")).alias("event_type"))
    return usage.verify_chain(rows.join(usage.chain(e), ["user_id", "event_id"]))


@query("chain_entries", """WITH b AS (SELECT user_id, event_id, concat_ws('|', event_id, user_id, event_type) AS body FROM events), p AS (SELECT *, coalesce(lag(sha256(body)) OVER (PARTITION BY user_id ORDER BY event_id), '') AS prev_hash FROM b) SELECT user_id, event_id, prev_hash, sha256(prev_hash || body) AS entry_hash FROM p""")
def chain_entries(spark, sf_dir):  # W04
    return usage.chain(table(spark, sf_dir, "events"))


@query("keyset_page", "SELECT event_id, user_id, event_type FROM events WHERE event_id < 500 ORDER BY event_id DESC LIMIT 51")
def keyset_page(spark, sf_dir):  # T09, F13
    return table(spark, sf_dir, "events").filter("event_id < 500").select("event_id", "user_id", "event_type").orderBy(F.desc("event_id")).limit(51)


@query("rate_limit", "WITH w AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events) SELECT event_id, n FROM w WHERE n > 2")
def rate_limit(spark, sf_dir):  # R04: events within the hour before
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return table(spark, sf_dir, "events").select("event_id", F.count(F.lit(1)).over(w).alias("n")).filter("n > 2")


@query("feedback_summary", "SELECT 'day' AS part, (ts::DATE)::VARCHAR AS key, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 2 UNION ALL SELECT 'user', user_id::VARCHAR, count(*) FROM events WHERE event_type = 'error' GROUP BY 2")
def feedback_summary(spark, sf_dir):  # A20, U06
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    part = lambda name, c: e.groupBy(c.cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "key", "n")
    return part("day", F.to_date("ts")).unionAll(part("user", F.col("user_id")))


@query("tumbling_hours", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_hours(spark, sf_dir):  # R07, on the batch
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("users_suggested", "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%00001%' AND c_custkey <> 12 ORDER BY c_custkey LIMIT 10")
def users_suggested(spark, sf_dir):  # M16
    c = table(spark, sf_dir, "customer").filter(F.ilike("c_name", F.lit("%00001%")) & (F.col("c_custkey") != 12))
    return c.select("c_custkey", "c_name").orderBy("c_custkey").limit(10)


@query("round_robin", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS rank FROM events QUALIFY rank <= 3")
def round_robin(spark, sf_dir):  # M06: first three of each group, to be read by rank
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).alias("rank")).filter("rank <= 3")


@query("set_algebra", "(SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey = 3")
def set_algebra(spark, sf_dir):  # U02, U03, U07
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return o.intersect(c.filter("c_acctbal > 0").select("c_custkey")).subtract(c.filter("c_nationkey = 3").select("c_custkey"))
