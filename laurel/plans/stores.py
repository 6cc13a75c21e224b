"""Queries over triplets, versions, expert labels, usage and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stores as S
from ..sources import tables as T
from .registry import query

TRI, USE, TEL, SME = T.TRIPLETS_SQL, T.USAGE_SQL, T.TELEMETRY_SQL, T.LABELS_SQL
_COST = "(CASE usage_type WHEN 'api_call' THEN 0.001e0 WHEN 'token_input' THEN 0.000003e0 WHEN 'token_output' THEN 0.000015e0 WHEN 'verification' THEN 0.0001e0 WHEN 'execution' THEN 0.001e0 WHEN 'storage' THEN 0.00001e0 ELSE 0e0 END * quantity * CASE tier WHEN 'free' THEN 0e0 WHEN 'premium' THEN 1.5e0 WHEN 'enterprise' THEN 0.8e0 ELSE 1e0 END)"
_CONSENSUS = SME + """, votes AS (SELECT comparison_id, coalesce(sum(tenths) FILTER (winner = 'a'), 0) AS a, coalesce(sum(tenths) FILTER (winner = 'b'), 0) AS b, coalesce(sum(tenths) FILTER (winner = 'tie'), 0) AS t, count(*) AS n_labels FROM sme GROUP BY 1),
agreed AS (SELECT comparison_id, n_labels, CASE WHEN a + b + t = 0 THEN NULL WHEN a >= b AND a >= t THEN 'a' WHEN b >= t THEN 'b' ELSE 'tie' END AS winner, CAST(greatest(a, b, t) AS DOUBLE) / CAST(a + b + t AS DOUBLE) AS confidence FROM votes)"""


@query("flt01_triplet_query", f"{TRI} SELECT id, confidence, created_at FROM triplets WHERE status = 'active' AND quality = 'silver' AND source IN ('1-URGENT', '2-HIGH') AND confidence >= 0.5 ORDER BY created_at DESC, id LIMIT 1000")
def triplet_query(spark: SparkSession, d: str) -> DataFrame:
    rows = S.matching(T.triplets(spark, d), "silver", ["1-URGENT", "2-HIGH"], 0.5)
    return S.page(rows, [F.desc("created_at"), F.col("id")], 1000).select("id", "confidence", "created_at")


@query("flt02_gold_query", f"{_CONSENSUS} SELECT comparison_id, round(confidence, 6) AS confidence FROM agreed WHERE winner = 'a' AND confidence >= 0.7 ORDER BY comparison_id DESC LIMIT 100 OFFSET 20")
def gold_query(spark: SparkSession, d: str) -> DataFrame:
    rows = S.consensus(T.expert_labels(spark, d), "tenths").filter("winner = 'a' AND confidence >= 0.7")
    return S.page(rows, [F.desc("comparison_id")], 100, 20).select("comparison_id", F.round("confidence", 6).alias("confidence"))


@query("flt03_by_trace", f"{TEL}, top AS (SELECT min(trace_id) AS trace_id FROM telemetry) SELECT event_id, ts FROM telemetry JOIN top USING (trace_id)")
def by_trace(spark: SparkSession, d: str) -> DataFrame:
    e = T.telemetry(spark, d)
    first = e.agg(F.min("trace_id").alias("trace_id"))
    return e.join(F.broadcast(first), "trace_id").select("event_id", "ts").orderBy("ts", "event_id")


@query("flt04_client_recent", f"{TEL} SELECT event_id, ts, event_type FROM telemetry WHERE client_id = 7 ORDER BY ts DESC, event_id LIMIT 100")
def client_recent(spark: SparkSession, d: str) -> DataFrame:
    return S.page(T.telemetry(spark, d).filter("client_id = 7"), [F.desc("ts"), F.col("event_id")], 100).select("event_id", "ts", "event_type")


@query("flt05_errors_since", f"{TEL} SELECT event_id, ts, client_id FROM telemetry WHERE severity IN ('error', 'critical') ORDER BY ts DESC, event_id LIMIT 100")
def errors_since(spark: SparkSession, d: str) -> DataFrame:
    bad = T.telemetry(spark, d).filter(F.col("severity").isin("error", "critical"))
    return S.page(bad, [F.desc("ts"), F.col("event_id")], 100).select("event_id", "ts", "client_id")


@query("flt06_snapshot", f"{TRI} SELECT 'v1' AS version_id, count(*) AS triplet_count FROM triplets WHERE status = 'active' AND quality = 'gold' AND confidence >= 0.75")
def snapshot(spark: SparkSession, d: str) -> DataFrame:
    return S.snapshot(T.triplets(spark, d), "v1", quality="gold", min_confidence=0.75)[1]


@query("flt08_point_lookup", f"{TRI} SELECT id, source, status, quality FROM triplets WHERE id = 33")
def lookup(spark: SparkSession, d: str) -> DataFrame:
    return T.triplets(spark, d).filter("id = 33").select("id", "source", "status", "quality")


@query("flt09_status_update", f"{TRI}, log AS (SELECT l_orderkey AS id, arg_max(CASE WHEN l_linestatus = 'O' THEN 'deleted' ELSE 'active' END, l_linenumber * 10 + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS new FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT id, coalesce(new, status) AS status FROM triplets LEFT JOIN log USING (id)")
def status_update(spark: SparkSession, d: str) -> DataFrame:
    log = T.table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_linestatus") == "O", "deleted").otherwise("active").alias("status"), (F.col("l_linenumber") * 10 + F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("at"))
    return S.with_status(T.triplets(spark, d), log).select("id", "status")


@query("flt10_retention", f"{TEL} SELECT count(*) AS kept FROM telemetry WHERE ts >= (SELECT max(ts) FROM telemetry) - INTERVAL 5 DAY")
def retention(spark: SparkSession, d: str) -> DataFrame:
    e = T.telemetry(spark, d)
    now = e.agg(F.max("ts").alias("now"))
    return S.retained(e.join(F.broadcast(now), F.lit(True)), F.col("now"), 5).agg(F.count(F.lit(1)).alias("kept"))


@query("flt13_dynamic_filter", f"{TEL} SELECT CASE WHEN duration_ms < 10 THEN 'short' WHEN event_type = 'error' THEN 'failed' ELSE 'kept' END AS reason, count(*) AS n FROM telemetry GROUP BY 1")
def dynamic_filter(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("duration_ms") < 10, "short").when(F.col("event_type") == "error", "failed").otherwise("kept")
    return T.telemetry(spark, d).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("flt15_certificate_validity", f"{TRI} SELECT id, status = 'active' AND (id % 7 = 0 OR TIMESTAMP '1997-01-01 00:00:00' <= created_at + INTERVAL 24 HOUR) AS valid FROM triplets")
def validity(spark: SparkSession, d: str) -> DataFrame:
    expires = F.when(F.col("id") % 7 != 0, F.col("created_at") + F.expr("INTERVAL 24 HOURS"))
    valid = (F.col("status") == "active") & (expires.isNull() | (F.lit("1997-01-01 00:00:00").cast("timestamp_ntz") <= expires))
    return T.triplets(spark, d).select("id", valid.alias("valid"))


@query("join01_version_triplets", f"{TRI} SELECT t.id, t.source, t.confidence FROM (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R') v JOIN triplets t USING (id)")
def version_triplets(spark: SparkSession, d: str) -> DataFrame:
    return S.version_triplets(T.version_members(spark, d), T.triplets(spark, d), "R").select("id", "source", "confidence")


@query("join02_nested_labels", f"{SME} SELECT o_orderkey AS comparison_id, count(sme_id) AS n, coalesce(string_agg(sme_id || winner || tenths, ',' ORDER BY sme_id, winner, tenths), '') AS labels FROM orders LEFT JOIN sme ON o_orderkey = comparison_id GROUP BY 1")
def nested_labels(spark: SparkSession, d: str) -> DataFrame:
    comparisons = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("comparison_id"))
    out = S.nested_labels(comparisons, T.expert_labels(spark, d))
    text = F.array_join(F.transform("labels", lambda x: F.concat(x["sme_id"].cast("string"), x["winner"], x["tenths"].cast("string"))), ",")
    return out.select("comparison_id", F.coalesce(F.size("labels"), F.lit(0)).cast("bigint").alias("n"), F.coalesce(text, F.lit("")).alias("labels"))


@query("agg01_store_statistics", f"{TRI} SELECT quality, source, count(*) AS n, round(coalesce(avg(confidence), 0), 6) AS mean_confidence FROM triplets WHERE status = 'active' GROUP BY GROUPING SETS ((), (quality), (source))")
def store_statistics(spark: SparkSession, d: str) -> DataFrame:
    return S.store_statistics(T.triplets(spark, d)).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("agg02_usage_summary", f"{USE} SELECT client_id, " + ", ".join(f"round(coalesce(sum(quantity) FILTER (usage_type = '{k}'), 0), 4) AS {k}_quantity" for k in S.PRICES if k != "storage") + f", round(sum({_COST}), 6) AS total_cost FROM usage GROUP BY 1")
def usage_summary(spark: SparkSession, d: str) -> DataFrame:
    out = S.usage_summary(T.usage(spark, d), "client_id")
    return out.select("client_id", *(F.round(c, 6 if c == "total_cost" else 4).alias(c) for c in out.columns[1:]))


@query("agg03_monthly_invoice", f"{USE} SELECT client_id, CAST(date_trunc('month', ts) AS DATE) AS month, " + ", ".join(f"round(coalesce(sum({_COST}) FILTER (usage_type = '{k}'), 0), 6) AS {k}_cost" for k in S.LINES) + f", round(sum({_COST}), 6) AS subtotal FROM usage GROUP BY 1, 2")
def monthly_invoice(spark: SparkSession, d: str) -> DataFrame:
    out = S.monthly_invoice(T.usage(spark, d))
    return out.select("client_id", "month", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


@query("agg04_quota_check", f"{USE}, g AS (SELECT client_id, CAST(ts AS DATE) AS day, count(*) FILTER (usage_type = 'api_call') AS requests, coalesce(sum(quantity) FILTER (usage_type IN ('token_input', 'token_output')), 0) AS tokens, sum({_COST}) AS cost FROM usage GROUP BY 1, 2) SELECT client_id, day, requests, CASE WHEN requests >= 3 THEN 'requests' WHEN tokens >= 200 THEN 'tokens' WHEN cost >= 0.1 THEN 'cost' END AS reason FROM g")
def quota_check(spark: SparkSession, d: str) -> DataFrame:
    return S.quota_check(T.usage(spark, d), {"requests": 3, "tokens": 200, "cost": 0.1}).select("client_id", "day", "requests", "reason")


@query("agg05_cost_statistics", f"{USE} SELECT count(*) AS records, count(DISTINCT client_id) AS clients, round(sum({_COST}), 4) AS total_cost FROM usage")
def cost_statistics(spark: SparkSession, d: str) -> DataFrame:
    return T.usage(spark, d).agg(F.count(F.lit(1)).alias("records"), F.countDistinct("client_id").alias("clients"), F.round(F.sum(S.cost()), 4).alias("total_cost"))


@query("agg06_telemetry_statistics", f"{TEL} SELECT event_type, severity, count(*) AS n, count(DISTINCT client_id) AS clients FROM telemetry GROUP BY GROUPING SETS ((), (event_type), (severity))")
def telemetry_statistics(spark: SparkSession, d: str) -> DataFrame:
    return S.telemetry_statistics(T.telemetry(spark, d))


@query("agg07_consensus", f"{_CONSENSUS} SELECT comparison_id, n_labels, winner, round(confidence, 6) AS confidence FROM agreed")
def consensus(spark: SparkSession, d: str) -> DataFrame:
    return S.consensus(T.expert_labels(spark, d), "tenths").withColumn("confidence", F.round("confidence", 6))


@query("agg08_label_statistics", f"{_CONSENSUS}, x AS (SELECT count(*) AS n_comparisons, count(*) FILTER (confidence >= 0.7) AS n_sure, count(*) FILTER (winner = 'a') AS n_a, count(*) FILTER (winner = 'b') AS n_b, count(*) FILTER (winner = 'tie') AS n_tie, count(*) FILTER (winner IS NULL) AS n_none FROM agreed), y AS (SELECT count(*) AS n_labels, count(DISTINCT sme_id) AS n_smes FROM sme) SELECT x.*, y.*, round(n_labels / CAST(greatest(n_comparisons, 1) AS DOUBLE), 6) AS per_comparison FROM x, y")
def label_statistics(spark: SparkSession, d: str) -> DataFrame:
    labels = T.expert_labels(spark, d)
    return S.label_statistics(S.consensus(labels, "tenths"), labels).withColumn("per_comparison", F.round("per_comparison", 6))


@query("src12_checked_labels", f"{SME}, c AS (SELECT comparison_id || '_a' AS trajectory, CASE WHEN comparison_id % 50 = 0 THEN 'invalid' ELSE winner END AS winner, CASE WHEN sme_id % 7 = 0 THEN tenths * 0.2e0 ELSE tenths * 0.1e0 END AS confidence FROM sme) SELECT CASE WHEN winner NOT IN ('a', 'b', 'tie') THEN 'winner' WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence' END AS error, count(*) AS n, count(DISTINCT trajectory) AS trajectories FROM c GROUP BY 1")
def checked_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = T.expert_labels(spark, d).select(F.concat(F.col("comparison_id").cast("string"), F.lit("_a")).alias("trajectory"), F.when(F.col("comparison_id") % 50 == 0, "invalid").otherwise(F.col("winner")).alias("winner"), (F.col("tenths") * F.when(F.col("sme_id") % 7 == 0, 0.2).otherwise(0.1)).alias("confidence"))
    return S.checked_labels(rows).groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("trajectory").alias("trajectories"))


@query("src08_usage_rows", "WITH r AS (SELECT event_id AS request_id, user_id AS client_id, CAST(floor(value) AS BIGINT) AS i, event_id % 3 AS o, event_id % 2 AS v, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS s FROM events), u AS (SELECT request_id, client_id, unnest([{'t': 'api_call', 'q': 1, 'u': 'call'}, {'t': 'token_input', 'q': i, 'u': 'token'}, {'t': 'token_output', 'q': o, 'u': 'token'}, {'t': 'verification', 'q': v, 'u': 'check'}, {'t': 'execution', 'q': s, 'u': 'second'}]) AS x FROM r) SELECT request_id, client_id, x.t AS usage_type, CAST(x.q AS DOUBLE) AS quantity, x.u AS unit FROM u WHERE x.q > 0")
def usage_rows(spark: SparkSession, d: str) -> DataFrame:
    r = T.table(spark, d, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("client_id"), F.floor("value").alias("input_tokens"), (F.col("event_id") % 3).alias("output_tokens"), (F.col("event_id") % 2).alias("verifications"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("seconds"))
    return S.usage_rows(r)


@query("src07_priced_usage", f"{USE} SELECT record_id, round({_COST}, 8) AS cost_usd FROM usage")
def priced(spark: SparkSession, d: str) -> DataFrame:
    return T.usage(spark, d).select("record_id", F.round(S.cost(), 8).alias("cost_usd"))


@query("src10_request_events", "WITH r AS (SELECT event_id AS request_id, event_type <> 'error' AS ok, value FROM events) SELECT request_id, 'request_start' AS event_type, 'info' AS severity, 'Request started: ' || request_id AS message, CAST(NULL AS DOUBLE) AS duration_ms FROM r UNION ALL SELECT request_id, 'request_end', CASE WHEN ok THEN 'info' ELSE 'error' END, CASE WHEN ok THEN 'Request completed: ' ELSE 'Request failed: ' END || request_id, value FROM r")
def request_events(spark: SparkSession, d: str) -> DataFrame:
    r = T.table(spark, d, "events").select(F.col("event_id").alias("request_id"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("latency"))
    return S.request_events(r)


@query("stm12_span_tree", "WITH RECURSIVE s AS (SELECT event_id AS span_id, CASE WHEN event_id % 100 <> 0 THEN (event_id // 100) * 100 + (event_id % 100) // 3 END AS parent FROM events), t(span_id, depth) AS (SELECT span_id, CAST(0 AS BIGINT) FROM s WHERE parent IS NULL UNION ALL SELECT s.span_id, t.depth + 1 FROM s JOIN t ON s.parent = t.span_id) SELECT span_id, depth FROM t")
def span_tree(spark: SparkSession, d: str) -> DataFrame:
    parent = F.when(F.col("event_id") % 100 != 0, F.expr("(event_id div 100) * 100 + (event_id % 100) div 3"))
    return S.span_depths(T.table(spark, d, "events").select(F.col("event_id").alias("span_id"), parent.alias("parent_span_id")))


@query("stm06_failure_runs", f"{TEL}, m AS (SELECT *, sum(CASE WHEN severity = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY client_id ORDER BY ts, event_id) AS island FROM telemetry), r AS (SELECT client_id, island, count(*) AS run FROM m WHERE severity = 'error' GROUP BY 1, 2) SELECT client_id, max(run) AS longest, count(*) FILTER (run >= 2) AS opened FROM r GROUP BY 1")
def failure_runs(spark: SparkSession, d: str) -> DataFrame:
    return S.failure_runs(T.telemetry(spark, d)).groupBy("client_id").agg(F.max("run").alias("longest"), F.count_if(F.col("run") >= 2).alias("opened"))


@query("agg18_gateway_health", f"{TEL}, g AS (SELECT client_id, count(*) AS total, count(*) FILTER (severity = 'error') AS failed FROM telemetry GROUP BY 1) SELECT client_id, total, failed, round(failed / CAST(greatest(total, 1) AS DOUBLE), 6) AS error_rate, failed / CAST(greatest(total, 1) AS DOUBLE) < 0.5 AS healthy FROM g")
def health(spark: SparkSession, d: str) -> DataFrame:
    g = T.telemetry(spark, d).groupBy("client_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity") == "error").alias("failed"))
    rate = F.col("failed") / F.greatest("total", F.lit(1))
    return g.select("client_id", "total", "failed", F.round(rate, 6).alias("error_rate"), (rate < 0.5).alias("healthy"))


@query("agg19_hit_rates", f"{TEL} SELECT event_type, count(*) FILTER (duration_ms >= 50) AS hits, count(*) FILTER (duration_ms < 50) AS misses, round(count(*) FILTER (duration_ms >= 50) / CAST(count(*) AS DOUBLE), 6) AS rate FROM telemetry GROUP BY 1")
def hit_rates(spark: SparkSession, d: str) -> DataFrame:
    return S.hit_rates(T.telemetry(spark, d), F.col("duration_ms") >= 50, "event_type").withColumn("rate", F.round("rate", 6))


@query("win12_list_versions", "SELECT l_returnflag AS version_id, count(DISTINCT l_orderkey) AS triplet_count, CAST(max(l_shipdate) AS TIMESTAMP) AS created_at FROM lineitem GROUP BY 1 ORDER BY created_at DESC, version_id LIMIT 100")
def list_versions(spark: SparkSession, d: str) -> DataFrame:
    v = T.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("version_id")).agg(F.countDistinct("l_orderkey").alias("triplet_count"), F.max("l_shipdate").cast("timestamp_ntz").alias("created_at"))
    return S.page(v, [F.desc("created_at"), F.col("version_id")], 100)
