"""Queries that write tables to a store or a file and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distil as D
from ..operators import stores as S
from ..session import shared_dir
from ..sources import stores as ST
from ..sources import tables as T
from .registry import query
from .stores import TEL

_AS_OF = "2024-01-01"


def _as_of():
    return F.lit(_AS_OF).cast("timestamp_ntz")


@query("src01_triplet_store", f"{T.TRIPLETS_SQL} SELECT status, quality, count(*) AS n, CAST(sum(CAST(round(confidence * 1000) AS BIGINT)) AS BIGINT) AS thousandths FROM triplets GROUP BY ALL")
def triplet_store(spark: SparkSession, d: str) -> DataFrame:
    """Triplets with their statuses, written in two batches, partitioned by status."""
    store, t = ST.Store.create(spark, shared_dir(spark)), T.triplets(spark, d)
    for rest in (0, 1):
        store.append("triplets", t.filter(F.col("id") % 2 == rest).withColumns({"id": F.col("id").cast("string"), "updated_at": F.col("created_at")}))
    return store.read("triplets").groupBy("status", "quality").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("confidence") * 1000).cast("bigint")).alias("thousandths"))


@query("src02_usage_store", f"{T.USAGE_SQL} SELECT usage_type, CAST(ts AS DATE) AS day, count(*) AS n FROM usage WHERE CAST(ts AS DATE) >= DATE '2024-01-10' GROUP BY ALL")
def usage_store(spark: SparkSession, d: str) -> DataFrame:
    """Usage rows by day; a filter on the day reads its folders only."""
    store, u = ST.Store.create(spark, shared_dir(spark)), T.usage(spark, d)
    store.append("usage_records", u.withColumn("day", F.to_date("ts")))
    return store.read("usage_records").filter("day >= DATE '2024-01-10'").groupBy("usage_type", "day").agg(F.count(F.lit(1)).alias("n"))


@query("src03_telemetry_store", f"{TEL} SELECT severity, CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT trace_id) AS traces FROM telemetry GROUP BY ALL")
def telemetry_store(spark: SparkSession, d: str) -> DataFrame:
    store, t = ST.Store.create(spark, shared_dir(spark)), T.telemetry(spark, d)
    store.append("events", t.withColumn("day", F.to_date("ts")))
    return store.read("events").groupBy("severity", "day").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("trace_id").alias("traces"))


@query("src04_label_store", f"{T.LABELS_SQL} SELECT CAST(comparison_id AS VARCHAR) AS comparison_id, count(*) AS n, CAST(sum(tenths) AS BIGINT) AS tenths FROM sme GROUP BY 1")
def label_store(spark: SparkSession, d: str) -> DataFrame:
    """Comparisons and their labels in two tables, joined again."""
    store, labels = ST.Store.create(spark, shared_dir(spark)), T.expert_labels(spark, d)
    store.append("gold_comparisons", labels.select(F.col("comparison_id").cast("string").alias("id")).distinct())
    store.append("sme_labels", labels.withColumn("confidence", F.col("tenths") / 10))
    got = store.read("gold_comparisons").select(F.col("id").alias("comparison_id")).join(store.read("sme_labels"), "comparison_id")
    return got.groupBy("comparison_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("confidence") * 10).cast("bigint")).alias("tenths"))


@query("src05_insert_triplets", f"SELECT o_orderkey AS input_query, 0.5e0 AS confidence, 'bronze' AS quality, 'tournament' AS source, 'active' AS status, TIMESTAMP '{_AS_OF}' AS created_at, true AS named FROM orders")
def insert_triplets(spark: SparkSession, d: str) -> DataFrame:
    """Rows with nothing but their query get ids, defaults and times."""
    store = ST.Store.create(spark, shared_dir(spark))
    store.append("triplets", ST.new_triplets(T.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("input")), _as_of()))
    got = store.read("triplets")
    return got.select(F.col("input_query").cast("bigint").alias("input_query"), "confidence", "quality", "source", "status", "created_at", (F.length("id") == 36).alias("named"))


@query("src09_insert_events", f"{TEL} SELECT event_id AS request_id, unnest(['request_start', 'request_end']) AS event_type, unnest(['info', CASE WHEN severity = 'error' THEN 'error' ELSE 'info' END]) AS severity FROM telemetry")
def insert_events(spark: SparkSession, d: str) -> DataFrame:
    """The start and end events of requests, appended one kind after the other."""
    store, t = ST.Store.create(spark, shared_dir(spark)), T.telemetry(spark, d)
    e = S.request_events(t.select(F.col("event_id").alias("request_id"), (F.col("severity") != "error").alias("success"), F.col("duration_ms").alias("latency")))
    for kind in ("request_start", "request_end"):
        store.append("events", e.filter(F.col("event_type") == kind))
    return store.read("events").select(F.col("request_id").cast("bigint").alias("request_id"), "event_type", "severity")


@query("src11_gold_comparisons", "SELECT conv_id AS id, md5(arg_min(coalesce(text, ''), (turn, role, coalesce(text, '')))) AS first, count(*) AS n FROM conversations GROUP BY 1")
def gold_comparisons(spark: SparkSession, d: str) -> DataFrame:
    """Comparisons of a conversation with itself cut short; trajectories come back as they were."""
    m = T.conversations(spark, d)
    full = F.transform("messages", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), F.lit(None).cast("string").alias("reasoning_content"), F.lit(None).cast("array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>").alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id")))
    store = ST.Store.create(spark, shared_dir(spark))
    store.append("gold_comparisons", m.select(F.col("conv_id").cast("string").alias("id"), full.alias("trajectory_a"), F.slice(full, 1, 1).alias("trajectory_b")))
    return store.read("gold_comparisons").select(F.col("id").cast("bigint").alias("id"), F.md5(F.coalesce(F.element_at("trajectory_b", 1)["content"], F.lit(""))).alias("first"), F.size("trajectory_a").cast("bigint").alias("n"))


@query("src16_export_dispatch", "SELECT unnest(['jsonl', 'parquet', 'orc', 'csv']) AS kind, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, count(DISTINCT o_orderstatus) AS states FROM orders")
def export_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """One table in every format, read back."""
    rows, out = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("state")), None
    for kind, read in (("jsonl", "json"), ("parquet", "parquet"), ("orc", "orc"), ("csv", "csv")):
        path = shared_dir(spark)
        D.export(rows, path, kind)
        back = getattr(spark.read.schema("k bigint, state string"), read)(path)
        one = back.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("k").alias("keys"), F.countDistinct("state").alias("states"))
        out = one if out is None else out.unionByName(one)
    return out


@query("src21_text_files", "SELECT md5(l) AS line, count(*) AS n FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM benchmark) GROUP BY 1")
def text_files(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts as text files, read line by line."""
    path = shared_dir(spark)
    T.table(spark, d, "benchmark").select(F.coalesce("text", F.lit("")).alias("value")).write.text(path)
    return ST.texts(spark, path, split=True).groupBy(F.md5("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("src23_tool_answers", "SELECT event_type AS tool, 'q' || user_id AS query, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY ALL")
def recorded_answers(spark: SparkSession, d: str) -> DataFrame:
    path = shared_dir(spark)
    D.export(T.table(spark, d, "events").select(F.col("event_type").alias("tool"), F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("query"), F.lit("a").alias("answer")), path, "jsonl")
    return ST.tool_answers(spark, path, "view").groupBy("tool", "query").agg(F.count(F.lit(1)).alias("n"))
