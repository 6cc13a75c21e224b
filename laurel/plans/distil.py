"""Queries that build and measure preference data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distil as D
from ..operators import ranking as R
from ..operators import stores as S
from ..sources import tables as T
from .ranking import _ANCHOR
from .registry import query
from .stores import _CONSENSUS

_TRIPLETS = f"{T.PLAYERS_SQL}, {_ANCHOR.format('players')}, s AS (SELECT group_id, idx, score / 20 AS score FROM scores), w AS (SELECT *, row_number() OVER v AS rn, first_value(idx) OVER v AS chosen, first_value(score) OVER v AS top FROM s WINDOW v AS (PARTITION BY group_id ORDER BY score DESC, idx)), t AS (SELECT group_id, chosen, idx AS rejected, top - score AS diff FROM w WHERE rn > 1), q AS (SELECT *, CASE WHEN diff > 0.5 THEN 'gold' WHEN diff > 0.2 THEN 'silver' ELSE 'bronze' END AS quality, least(diff + 0.5, 1e0) AS confidence FROM t)"


def _triplets(spark: SparkSession, d: str) -> DataFrame:
    scores = R.anchor_scores(T.players(spark, d)).withColumn("score", F.col("score") / 20)
    return D.triplets_from_scores(scores)


@query("gen07_distillation", f"{_TRIPLETS} SELECT group_id, chosen, rejected, round(diff, 6) AS diff, quality, round(confidence, 6) AS confidence FROM q")
def distillation(spark: SparkSession, d: str) -> DataFrame:
    return _triplets(spark, d).withColumn("diff", F.round("diff", 6)).withColumn("confidence", F.round("confidence", 6))


@query("flt07_training_filter", f"{_TRIPLETS} SELECT CASE WHEN confidence < 0.6 THEN 'confidence' WHEN 1 + chosen * 7 > 50 THEN 'chosen too long' WHEN 1 + rejected * 7 > 50 THEN 'rejected too long' END AS reason, count(*) AS n FROM q GROUP BY 1")
def training_filter(spark: SparkSession, d: str) -> DataFrame:
    t = _triplets(spark, d).withColumn("n_chosen", 1 + F.col("chosen") * 7).withColumn("n_rejected", 1 + F.col("rejected") * 7)
    return t.groupBy(D.rejection_reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("agg11_distillation_statistics", f"{_TRIPLETS} SELECT quality, count(*) AS processed, count(*) FILTER (confidence >= 0.6) AS passed FROM q GROUP BY 1")
def distillation_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _triplets(spark, d).groupBy("quality").agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("confidence") >= 0.6).alias("passed"))


@query("gen08_train_eval_split", "WITH h AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || 'seed')) AS r, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN r <= CAST(floor(n * 0.9e0) AS BIGINT) THEN 'train' ELSE 'eval' END AS part FROM h")
def split(spark: SparkSession, d: str) -> DataFrame:
    return D.train_eval_split(T.table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.9, "seed")


_ATTEMPTS = "WITH a AS (SELECT l_orderkey AS trajectory_id, l_linenumber AS attempt, max(l_partkey % 3) AS failures FROM lineitem GROUP BY 1, 2), s AS (SELECT trajectory_id, min(attempt) FILTER (failures = 0) AS solved, arg_min(failures, attempt) AS f, arg_max(failures, attempt) AS l, max(attempt) AS used FROM a WHERE attempt <= 3 GROUP BY 1), c AS (SELECT trajectory_id, CASE WHEN solved IS NOT NULL THEN 'success' WHEN l < f THEN 'partial' ELSE 'failed' END AS status, coalesce(solved, used) AS attempts FROM s)"


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("trajectory_id"), F.col("l_linenumber").alias("attempt")).agg(F.max(F.col("l_partkey") % 3).alias("failures"))


@query("gen06_correction_loop", f"{_ATTEMPTS} SELECT trajectory_id, status, CAST(attempts AS BIGINT) AS attempts FROM c")
def correction(spark: SparkSession, d: str) -> DataFrame:
    return D.correction_status(_attempts(spark, d)).withColumn("attempts", F.col("attempts").cast("bigint"))


@query("agg09_correction_statistics", f"{_ATTEMPTS} SELECT count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'failed') AS failed, round(count(*) FILTER (status <> 'failed') / CAST(count(*) AS DOUBLE), 6) AS success_rate, round(avg(attempts), 6) AS mean_attempts FROM c")
def correction_statistics(spark: SparkSession, d: str) -> DataFrame:
    out = D.correction_statistics(D.correction_status(_attempts(spark, d)))
    return out.withColumn("success_rate", F.round("success_rate", 6)).withColumn("mean_attempts", F.round("mean_attempts", 6))


@query("agg10_failure_types", "WITH f AS (SELECT l_orderkey, l_linenumber, unnest(['p' || l_partkey % 4, 'p' || l_suppkey % 4]) AS plugin FROM lineitem) SELECT plugin, count(*) AS n, round(avg(l_linenumber), 6) AS mean_attempt FROM f GROUP BY 1")
def failure_types(spark: SparkSession, d: str) -> DataFrame:
    p = lambda c: F.concat(F.lit("p"), (F.col(c) % 4).cast("string"))
    f = T.table(spark, d, "lineitem").select("l_linenumber", F.explode(F.array(p("l_partkey"), p("l_suppkey"))).alias("plugin"))
    return f.groupBy("plugin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_linenumber"), 6).alias("mean_attempt"))


@query("gen05_correction_policy", f"{_ATTEMPTS} SELECT trajectory_id, attempt, attempt < 3 AND failures > 0 AS again FROM a")
def policy(spark: SparkSession, d: str) -> DataFrame:
    return _attempts(spark, d).select("trajectory_id", "attempt", ((F.col("attempt") < 3) & (F.col("failures") > 0)).alias("again"))


@query("src18_judge_training", f"{_CONSENSUS} SELECT comparison_id, comparison_id || CASE winner WHEN 'a' THEN '_a' ELSE '_b' END AS chosen, comparison_id || CASE winner WHEN 'a' THEN '_b' ELSE '_a' END AS rejected, winner, round(confidence, 6) AS confidence FROM agreed WHERE confidence >= 0.7 AND winner IN ('a', 'b') ORDER BY agreed.confidence DESC, comparison_id LIMIT 10000")
def judge_training(spark: SparkSession, d: str) -> DataFrame:
    return D.judge_training_rows(S.consensus(T.expert_labels(spark, d), "tenths")).withColumn("confidence", F.round("confidence", 6))


@query("gen10_gold_examples", f"{_CONSENSUS} SELECT comparison_id, CASE WHEN winner = 'a' THEN 'a' ELSE 'b' END AS expected, round(confidence, 6) AS confidence FROM agreed WHERE winner IS NOT NULL")
def gold_examples(spark: SparkSession, d: str) -> DataFrame:
    g = S.consensus(T.expert_labels(spark, d), "tenths").filter("winner IS NOT NULL")
    return g.select("comparison_id", F.when(F.col("winner") == "a", "a").otherwise("b").alias("expected"), F.round("confidence", 6).alias("confidence"))


@query("gen09_instruction_search", f"{_CONSENSUS}, g AS (SELECT comparison_id, CASE WHEN winner = 'a' THEN 'a' ELSE 'b' END AS expected, confidence FROM agreed WHERE winner IS NOT NULL), c AS (SELECT k, avg(CASE WHEN (comparison_id + k) % (k + 2) = 0 AND expected = 'a' OR (comparison_id + k) % (k + 2) <> 0 AND expected = 'b' THEN 0.5 + 0.5 * confidence ELSE 0 END) AS metric FROM g, (SELECT unnest(range(0, 6)) AS k) GROUP BY 1), b AS (SELECT arg_max(k, metric) AS best, max(metric) AS top, max(metric) FILTER (k = 0) AS base FROM c) SELECT best, round(top, 6) AS metric, round(top - base, 6) AS improvement FROM b")
def instruction_search(spark: SparkSession, d: str) -> DataFrame:
    """Six candidates (their answers are a function of candidate and example) scored in one pass; the first best wins."""
    g = gold_examples(spark, d)
    g = S.consensus(T.expert_labels(spark, d), "tenths").filter("winner IS NOT NULL").select("comparison_id", F.when(F.col("winner") == "a", "a").otherwise("b").alias("expected"), "confidence")
    c = g.select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    said = F.when((F.col("comparison_id") + F.col("k")) % (F.col("k") + 2) == 0, "a").otherwise("b")
    m = c.groupBy("k").agg(F.avg(F.when(said == F.col("expected"), 0.5 + 0.5 * F.col("confidence")).otherwise(0.0)).alias("metric"))
    b = m.agg(F.max_by("k", F.struct("metric", -F.col("k"))).cast("bigint").alias("best"), F.max("metric").alias("top"), F.max(F.when(F.col("k") == 0, F.col("metric"))).alias("base"))
    return b.select("best", F.round("top", 6).alias("metric"), F.round(F.col("top") - F.col("base"), 6).alias("improvement"))


@query("agg20_eval_summary", f"{T.PLAYERS_SQL} SELECT group_id, string_agg(idx || ':' || strength, ',' ORDER BY idx) AS rewards, count(*) FILTER (toxic = 1) AS truncated FROM players GROUP BY 1")
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    p = T.players(spark, d).groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("idx", "strength"))).alias("x"), F.count_if(F.col("toxic") == 1).alias("truncated"))
    return p.select("group_id", F.array_join(F.transform("x", lambda s: F.concat(s["idx"].cast("string"), F.lit(":"), s["strength"].cast("string"))), ",").alias("rewards"), "truncated")


@query("src22_prompt_scan", "SELECT item_id, k, item_id * 4 + k AS idx FROM benchmark, (SELECT unnest(range(0, 4)) AS k)")
def prompt_scan(spark: SparkSession, d: str) -> DataFrame:
    """Four copies of each prompt, numbered."""
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("k")
    return T.table(spark, d, "benchmark").select("item_id", k).withColumn("idx", F.col("item_id") * 4 + F.col("k"))


@query("src25_sample_json", "SELECT doc_id, md5('{\"index\":' || doc_id || ',\"label\":\"' || lang || '\"' || CASE WHEN doc_id % 2 = 0 THEN ',\"status\":\"completed\"' ELSE '' END || '}') AS digest FROM documents")
def sample_json(spark: SparkSession, d: str) -> DataFrame:
    s = F.to_json(F.struct(F.col("doc_id").alias("index"), F.col("lang").alias("label"), F.when(F.col("doc_id") % 2 == 0, "completed").alias("status")))
    return T.table(spark, d, "documents").select("doc_id", F.md5(s).alias("digest"))
