"""Queries over sources, exports, parsers and certificates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import distil as D
from ..operators import configs as C
from ..operators import documents as P
from ..operators import ranking as R
from ..operators import verify as V
from ..sources import stores as ST
from ..sources import tables as T
from .registry import query


@query("src06_batch_defaults", "SELECT o_orderkey AS input_query, CASE WHEN o_orderkey % 2 = 0 THEN 0.5e0 ELSE 0.9e0 END AS confidence, 'bronze' AS quality, 'batch_import' AS source, 'active' AS status FROM orders")
def batch_defaults(spark: SparkSession, d: str) -> DataFrame:
    rows = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("input"), F.when(F.col("o_orderkey") % 2 == 1, 0.9).alias("confidence"))
    out = ST.new_triplets(rows.withColumn("input", F.col("input").cast("string")), F.lit("2024-01-01").cast("timestamp_ntz"), "batch_import")
    return out.select(F.col("input_query").cast("bigint").alias("input_query"), "confidence", "quality", "source", "status")


_TURNS = "WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)"


@query("src14_trainer_export", f"{_TURNS} SELECT conv_id, md5(string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY turn, role, text)) AS chosen, 0.8e0 AS chosen_score, 0.2e0 AS rejected_score FROM m GROUP BY 1")
def trainer_export(spark: SparkSession, d: str) -> DataFrame:
    t = T.conversations(spark, d).select(F.col("conv_id").alias("prompt"), F.col("messages").alias("chosen"), F.slice("messages", 1, 1).alias("rejected"), F.lit(0.8).alias("confidence"))
    return D.slime_rows(t).select(F.col("prompt").alias("conv_id"), F.md5("chosen").alias("chosen"), "chosen_score", F.round("rejected_score", 6).alias("rejected_score"))


_PAIRED = f"{_TURNS}, r AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)), p AS (SELECT conv_id, arg_min(text, k) AS prompt, string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY k) AS chosen, string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY k) FILTER (k < n) AS rejected FROM r GROUP BY 1)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """A conversation is preferred to itself without its last turn."""
    m = T.conversations(spark, d)
    return m.select("conv_id", F.element_at("messages", 1)["content"].alias("prompt"), F.col("messages").alias("chosen"), F.slice("messages", F.lit(1), F.size("messages") - 1).alias("rejected"))


@query("src17_dpo_pairs", f"{_PAIRED} SELECT conv_id, md5(prompt) AS prompt, md5(chosen) AS chosen, md5(coalesce(rejected, '')) AS rejected FROM p")
def dpo_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = D.dpo_rows(_pairs(spark, d))
    return p.select("conv_id", *(F.md5(F.coalesce(c, F.lit(""))).alias(c) for c in ("prompt", "chosen", "rejected")))


@query("src15_columnar_export", f"{_PAIRED} SELECT md5(prompt) AS prompt, md5(chosen) AS chosen, md5(coalesce(rejected, '')) AS rejected FROM p")
def columnar_export(spark: SparkSession, d: str) -> DataFrame:
    """Three columns, as a columnar file holds them."""
    p = D.columnar_rows(_pairs(spark, d))
    return p.select(*(F.md5(F.coalesce(c, F.lit(""))).alias(c) for c in p.columns))


@query("src19_rationale_rows", "WITH r AS (SELECT l_orderkey AS comparison_id, l_suppkey AS sme_id, unnest(['category' || l_linenumber, 'style']) AS category FROM lineitem) SELECT comparison_id, sme_id, category, count(*) AS n FROM r GROUP BY 1, 2, 3")
def rationale_rows(spark: SparkSession, d: str) -> DataFrame:
    labels = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("comparison_id"), F.col("l_suppkey").alias("sme_id"), F.array(F.struct(F.concat(F.lit("category"), F.col("l_linenumber").cast("string")).alias("category")), F.struct(F.lit("style").alias("category"))).alias("rationales"))
    return labels.select("comparison_id", "sme_id", F.inline("rationales")).groupBy("comparison_id", "sme_id", "category").agg(F.count(F.lit(1)).alias("n"))


@query("src20_correction_training", "WITH a AS (SELECT l_orderkey AS trajectory_id, l_linenumber AS attempt, max(l_partkey % 3) AS failures FROM lineitem GROUP BY 1, 2), s AS (SELECT trajectory_id, min(attempt) FILTER (failures = 0 AND attempt <= 3) AS solved, arg_min(failures, attempt) FILTER (attempt <= 3) AS first, arg_max(failures, attempt) FILTER (attempt <= 3) AS last FROM a GROUP BY 1) SELECT trajectory_id, CASE WHEN any_value(solved) IS NOT NULL THEN 'success' ELSE 'partial' END AS status, string_agg(attempt || ':' || failures, ',' ORDER BY attempt) AS attempts FROM a JOIN s USING (trajectory_id) WHERE attempt <= 3 AND (solved IS NOT NULL OR last < first) GROUP BY 1")
def correction_training(spark: SparkSession, d: str) -> DataFrame:
    """Corrections that ended well, wholly or in part, with their attempts."""
    a = T.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("trajectory_id"), F.col("l_linenumber").alias("attempt")).agg(F.max(F.col("l_partkey") % 3).alias("failures"))
    said = F.concat_ws(":", F.col("attempt").cast("string"), F.col("failures").cast("string"))
    rows = a.filter("attempt <= 3").groupBy("trajectory_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("attempt", said.alias("said")))), lambda x: x["said"]), ",").alias("attempts"))
    return D.correction_status(a).filter("status IN ('success', 'partial')").select("trajectory_id", "status").join(rows, "trajectory_id")


@query("src24_tool_registry", "SELECT event_id AS call_id, event_type AS tool, CASE event_type WHEN 'click' THEN 's1' WHEN 'view' THEN 's2' END AS server, CASE WHEN event_type NOT IN ('click', 'view') THEN '[Error] unknown tool ' || event_type END AS error FROM events")
def tool_registry(spark: SparkSession, d: str) -> DataFrame:
    tools = spark.createDataFrame([("click", "s1"), ("view", "s2")], "tool string, server string")
    return ST.tool_results(T.table(spark, d, "events").select(F.col("event_id").alias("call_id"), F.col("event_type").alias("tool")), tools)


@query("str04_markdown", "SELECT event_id, 'Client Id: ' || user_id || chr(10) || '# Body' || chr(10) || 'Kind: ' || event_type AS md FROM events")
def markdown(spark: SparkSession, d: str) -> DataFrame:
    j = F.to_json(F.struct(F.col("user_id").alias("client_id"), F.struct(F.col("event_type").alias("kind")).alias("body")))
    return T.table(spark, d, "events").select("event_id", P.to_markdown(j).alias("md"))


@query("str07_assistant_parts", "SELECT event_id, 'why ' || event_id AS reasoning, 'Answer ' || event_type AS content, CAST(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_calls, CASE WHEN event_id % 2 = 0 THEN 'call_0,call_1' ELSE 'call_1' END AS ids FROM events")
def assistant_parts(spark: SparkSession, d: str) -> DataFrame:
    first = F.when(F.col("event_id") % 2 == 0, '{"name": "a"}').otherwise("{bad")
    t = F.concat(F.lit("<think>why "), F.col("event_id").cast("string"), F.lit("</think>Answer "), F.col("event_type"), F.lit("<tool_call>"), first, F.lit('</tool_call><tool_call>{"name": "b"}</tool_call>'))
    p = T.table(spark, d, "events").select("event_id", X.assistant_parts(t).alias("p"))
    return p.select("event_id", "p.reasoning", "p.content", F.size("p.calls").cast("bigint").alias("n_calls"), F.array_join(F.transform("p.calls", lambda c: c["id"]), ",").alias("ids"))


@query("str12_infra_text", "SELECT s_suppkey AS traj_id, 'aws_s3_bucket' AS type, 'b' || s_suppkey AS name, 's3_encryption' AS rule FROM supplier UNION ALL SELECT s_suppkey, 'aws_s3_bucket', 'b' || s_suppkey, 's3_public' FROM supplier WHERE s_suppkey % 2 = 0")
def infra_text(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    body = F.concat(F.lit('resource "aws_s3_bucket" "b'), k.cast("string"), F.lit('" {\n  acl = "'), F.when(k % 2 == 0, "public-read").otherwise("private"), F.lit('"\n  count = 2\n}\n'))
    found = V.resource_findings(C.resources(T.table(spark, d, "supplier").select(k.alias("traj_id"), body.alias("text"))), V.infra_checks())
    return found.filter("rule LIKE 's3%'").select("traj_id", "type", "name", "rule")


@query("str19_signature_template", "SELECT event_type, 'Judge ' || event_type || chr(10) || 'Inputs: query, a, b' || chr(10) || 'Outputs: winner' AS prompt FROM (SELECT DISTINCT event_type FROM events)")
def signature(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "events").select("event_type").distinct().select("event_type", F.concat_ws("\n", F.concat(F.lit("Judge "), F.col("event_type")), F.lit("Inputs: query, a, b"), F.lit("Outputs: winner")).alias("prompt"))


@query("mth06_length_judge", f"{_TURNS}, s AS (SELECT conv_id, count(*) - 5 * max(CASE WHEN contains(lower(text), 'error') THEN 1 ELSE 0 END) AS score FROM m GROUP BY 1) SELECT a.conv_id, CASE WHEN a.score > b.score THEN 'a' WHEN a.score < b.score THEN 'b' ELSE 'tie' END AS winner, CASE WHEN a.score = b.score THEN 0.5e0 ELSE 0.7e0 END AS confidence FROM s a JOIN s b ON b.conv_id = a.conv_id + 1")
def length_judge(spark: SparkSession, d: str) -> DataFrame:
    bad = F.exists("messages", lambda m: F.contains(F.lower(F.coalesce(m["content"], F.lit(""))), F.lit("error")))
    s = T.conversations(spark, d).select("conv_id", (F.size("messages") - 5 * bad.cast("int")).alias("score"))
    j = s.join(s.select((F.col("conv_id") - 1).alias("conv_id"), F.col("score").alias("other")), "conv_id")
    return j.select("conv_id", F.when(F.col("score") > F.col("other"), "a").when(F.col("score") < F.col("other"), "b").otherwise("tie").alias("winner"), F.when(F.col("score") == F.col("other"), 0.5).otherwise(0.7).alias("confidence"))


@query("ver02_code_linter", "SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' ELSE 'skipped' END AS status FROM documents")
def linter(spark: SparkSession, d: str) -> DataFrame:
    code = F.element_at(F.array(F.lit("```python\nx = 1\n```"), F.lit("```\nx = (\n```"), F.lit("plain")), (F.col("doc_id") % 3 + 1).cast("int"))
    return P.lint(T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), code.alias("text")))


@query("gen03_shadow_loop", "WITH v AS (SELECT item_id, i, round(0.1 + 0.8 * i / 3, 6) AS temperature, 'Variation ' || i || ' of: ' || coalesce(text, '') || ' Think step ' || i || '.' AS r FROM benchmark, (SELECT unnest(range(0, 4)) AS i)), s AS (SELECT *, length(replace(r, 'e', '')) % 7 AS score FROM v), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, i) AS k FROM s) SELECT item_id, i AS best, temperature, score, md5(r) AS response FROM k WHERE k = 1")
def shadow_loop(spark: SparkSession, d: str) -> DataFrame:
    """Four variations of each prompt, scored by a function of their responses; the best one, the first of equals."""
    b = T.table(spark, d, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("prompt"))
    respond = lambda i, prompt: F.concat(F.lit("Variation "), i.cast("string"), F.lit(" of: "), prompt, F.lit(" Think step "), i.cast("string"), F.lit("."))
    best = D.shadow_loop(b, "item_id", respond, lambda r, _: F.length(F.replace(r, F.lit("e"))) % 7, 4)
    return best.select("item_id", "best", F.round("temperature", 6).alias("temperature"), F.col("score").cast("bigint").alias("score"), F.md5("response").alias("response"))


@query("gen01_agent_steps", f"{_TURNS}, a AS (SELECT conv_id, md5(text) AS x, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS back FROM m WHERE role = 'assistant' WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)), s AS (SELECT conv_id, x, k, least(n, 3) AS size FROM a WHERE k <= 2 OR (k = 3 AND n = 3) OR (n > 3 AND back = 1)) SELECT conv_id, CASE WHEN k > 2 THEN 2 ELSE k - 1 END + 3 - size AS slot, CASE WHEN k > 2 THEN 2 ELSE k - 1 END AS step, x FROM s UNION ALL SELECT DISTINCT conv_id, unnest(range(0, 3 - size)), -1, NULL FROM s")
def agent_steps(spark: SparkSession, d: str) -> DataFrame:
    s = D.agent_steps(T.conversations(spark, d), 2)
    return s.select("conv_id", F.col("slot").cast("bigint").alias("slot"), F.col("step").cast("bigint").alias("step"), F.md5(F.when(F.col("step") >= 0, F.coalesce("content", F.lit("")))).alias("x"))


@query("gen02_generation_status", "WITH g AS (SELECT event_id, least(500, 1000 - event_id % 1000) AS budget, (['length', 'abort', 'stop'])[event_id % 3 + 1] AS reason FROM events) SELECT event_id, budget, CASE WHEN budget <= 100 THEN 'truncated' WHEN reason = 'length' THEN 'truncated' WHEN reason = 'abort' THEN 'aborted' ELSE 'completed' END AS status, event_id % 8 = 0 AS greedy FROM g")
def generation_status(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    e = T.table(spark, d, "events").select("event_id", D.generation(k % 1000, 1000, 500, F.element_at(F.array(F.lit("length"), F.lit("abort"), F.lit("stop")), (k % 3 + 1).cast("int")), k, 8).alias("g"))
    return e.select("event_id", "g.*")


@query("gen04_shadow_arena", f"{T.PLAYERS_SQL}, ok AS (SELECT * FROM players WHERE toxic = 0), p AS (SELECT a.group_id, a.idx, avg(least(a.strength + 1, 10) + least(a.strength, 10)) AS mean FROM ok a JOIN ok b ON a.group_id = b.group_id AND a.idx <> b.idx GROUP BY 1, 2), s AS (SELECT q.group_id, q.idx, q.doc_id, q.toxic, CASE WHEN q.toxic = 1 THEN -1.0 ELSE coalesce(mean, 1.0) END AS score FROM players q LEFT JOIN p USING (group_id, idx)), r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, idx) AS k FROM s) SELECT group_id, CASE WHEN toxic = 0 THEN doc_id END AS best FROM r WHERE k = 1")
def shadow_arena(spark: SparkSession, d: str) -> DataFrame:
    """Verify, play, and answer with the best verified candidate, if there is one."""
    p = T.players(spark, d)
    s = R.arena_scores(p, F.col("toxic") == 0).join(p.select("group_id", "idx", "doc_id"), ["group_id", "idx"])
    best = s.groupBy("group_id").agg(F.max_by(F.struct("doc_id", "valid"), F.struct("score", -F.col("idx"))).alias("x"))
    return best.select("group_id", F.when(F.col("x.valid"), F.col("x.doc_id")).alias("best"))
