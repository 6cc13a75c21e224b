"""Readers, and the tables that stand for the library's entities in queries.

Groups of candidates are runs of 16 document ids, so their size does not grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GROUP = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strength() -> Column:
    """A whole-number judge score of a candidate, 0 to 10."""
    return 4 * F.col("quality") + 3 * (1 - F.col("toxic")) + F.least(F.floor(F.col("n_chars") / 2000), F.lit(3)).cast("int")


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, idx (from 0; 0 is the anchor), doc_id, strength, quality, toxic: groups of at least two candidates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    docs = docs.withColumn("group_id", F.expr(f"doc_id div {GROUP}"))
    w = W.partitionBy("group_id")
    out = docs.select(
        "group_id",
        (F.row_number().over(w.orderBy("doc_id")) - 1).cast("bigint").alias("idx"),
        "doc_id",
        strength().cast("bigint").alias("strength"),
        "quality",
        "toxic",
        F.count(F.lit(1)).over(w).alias("n"),
    )
    return out.filter("n >= 2").drop("n")


#: The same in SQL, to stand before a query.
PLAYERS_SQL = """WITH players AS (SELECT * EXCLUDE (n) FROM (SELECT doc_id // 16 AS group_id, row_number() OVER (PARTITION BY doc_id // 16 ORDER BY doc_id) - 1 AS idx, doc_id,
  CAST(4 * quality + 3 * (1 - toxic) + least(n_chars // 2000, 3) AS BIGINT) AS strength, quality, toxic, count(*) OVER (PARTITION BY doc_id // 16) AS n
  FROM documents JOIN labels USING (doc_id)) WHERE n >= 2)"""


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, messages: array of (turn, role, content) in the order of turns."""
    t = table(spark, sf_dir, "conversations")
    return t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry events: client, type, severity, duration, trace."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        "event_type",
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("user_id").alias("client_id"),
        F.when(F.col("event_type") == "error", "error").otherwise("info").alias("severity"),
        F.col("value").alias("duration_ms"),
        F.concat_ws(":", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("trace_id"),
        F.col("props").alias("details"),
    )


TELEMETRY_SQL = """WITH telemetry AS (SELECT event_id, event_type, CAST(ts AS TIMESTAMP) AS ts, user_id AS client_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS severity,
  value AS duration_ms, user_id || ':' || strftime(ts, '%Y-%m-%d') AS trace_id, props AS details FROM events)"""

#: What an event counts as, for billing.
USAGE_OF = {"click": "api_call", "view": "token_input", "purchase": "token_output", "signup": "verification", "error": "execution"}
TIERS = ("free", "standard", "premium", "enterprise")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage rows: record_id, client_id, tier, usage_type, quantity, ts."""
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*(F.lit(x) for kv in USAGE_OF.items() for x in kv))
    return e.select(
        F.col("event_id").alias("record_id"),
        F.col("user_id").alias("client_id"),
        F.element_at(F.array(*map(F.lit, TIERS)), (F.col("user_id") % 4 + 1).cast("int")).alias("tier"),
        kind[F.col("event_type")].alias("usage_type"),
        F.col("value").alias("quantity"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
    )


USAGE_SQL = """WITH usage AS (SELECT event_id AS record_id, user_id AS client_id, (['free', 'standard', 'premium', 'enterprise'])[user_id % 4 + 1] AS tier,
  CASE event_type WHEN 'click' THEN 'api_call' WHEN 'view' THEN 'token_input' WHEN 'purchase' THEN 'token_output' WHEN 'signup' THEN 'verification' WHEN 'error' THEN 'execution' END AS usage_type,
  value AS quantity, CAST(ts AS TIMESTAMP) AS ts FROM events)"""


def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference triplets: id, source, status, confidence, quality, created_at."""
    o = table(spark, sf_dir, "orders")
    confidence = F.least(F.floor(F.col("o_totalprice") * 2) / 1000000, F.lit(1.0))
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("source"),
        F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "O", "archived").otherwise("deleted").alias("status"),
        confidence.alias("confidence"),
        F.when(confidence > 0.7, "gold").when(confidence > 0.4, "silver").otherwise("bronze").alias("quality"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
    )


TRIPLETS_SQL = """WITH triplets AS (SELECT id, source, status, confidence, CASE WHEN confidence > 0.7 THEN 'gold' WHEN confidence > 0.4 THEN 'silver' ELSE 'bronze' END AS quality, created_at
  FROM (SELECT o_orderkey AS id, o_orderpriority AS source, CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'archived' ELSE 'deleted' END AS status,
  least(floor(o_totalprice * 2) / 1000000, 1e0) AS confidence, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders))"""


def version_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership of dataset versions: one version for each return flag."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("version_id"), F.col("l_orderkey").alias("triplet_id")).distinct()


def expert_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """comparison_id, sme_id, winner (a, b, tie), tenths: confidence in tenths as a whole number."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        F.col("l_orderkey").alias("comparison_id"),
        F.col("l_suppkey").alias("sme_id"),
        F.when(F.col("l_returnflag") == "R", "a").when(F.col("l_returnflag") == "A", "b").otherwise("tie").alias("winner"),
        F.round(5 + 50 * F.col("l_discount")).cast("bigint").alias("tenths"),
    )


LABELS_SQL = """WITH sme AS (SELECT l_orderkey AS comparison_id, l_suppkey AS sme_id, CASE l_returnflag WHEN 'R' THEN 'a' WHEN 'A' THEN 'b' ELSE 'tie' END AS winner,
  CAST(round(5 + 50 * l_discount) AS BIGINT) AS tenths FROM lineitem)"""
