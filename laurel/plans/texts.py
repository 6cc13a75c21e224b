"""Queries over messages, texts, verdicts and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import verify as V
from ..sources import tables as T
from .registry import query

_MSGS = "WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)"
_LAST = "SELECT conv_id, arg_max(text, turn) AS x FROM m WHERE role = '{0}' GROUP BY 1"


@query("str01_messages_to_text", f"{_MSGS} SELECT conv_id, sha256(string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY turn, role, text)) AS digest FROM m GROUP BY 1")
def messages_to_text(spark: SparkSession, d: str) -> DataFrame:
    return T.conversations(spark, d).select("conv_id", F.sha2(X.messages_to_text("messages"), 256).alias("digest"))


@query("str02_letters_only", "SELECT doc_id, sha256(regexp_replace(text, '[^0-9a-zA-Z一-鿿]', '', 'g')) AS digest, regexp_matches(text, '[一-龥]') AS cjk FROM documents")
def letters(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "documents").select("doc_id", F.sha2(X.letters_only("text"), 256).alias("digest"), X.has_cjk("text").alias("cjk"))


@query("str03_truncate_middle", r"""WITH t AS (SELECT doc_id, text, left(text, 500) AS h, right(text, 500) AS e FROM documents),
u AS (SELECT *, CASE WHEN regexp_matches(h, '\s') AND length(regexp_extract(h, '(?s)^(.*)\s', 1)) > 0 THEN regexp_extract(h, '(?s)^(.*)\s', 1) ELSE h END AS h2, CASE WHEN regexp_matches(e, '\s') AND length(regexp_extract(e, '(?s)^\S*\s(.*)$', 1)) > 0 THEN regexp_extract(e, '(?s)^\S*\s(.*)$', 1) ELSE e END AS e2 FROM t)
SELECT doc_id, sha256(CASE WHEN length(text) <= 1000 THEN text ELSE h2 || chr(10) || '... [' || (length(text) - length(h2) - length(e2)) || ' characters omitted] ...' || chr(10) || e2 END) AS digest FROM u""")
def truncate(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "documents").select("doc_id", F.sha2(X.truncate_middle("text", 1000), 256).alias("digest"))


@query("str05_code_blocks", r"""WITH f AS (SELECT doc_id, 'see' || chr(10) || '```python' || chr(10) || coalesce(text, '') || chr(10) || '```' || chr(10) || '```' || chr(10) || 'x = 1' || chr(10) || '```' AS c FROM documents)
SELECT doc_id, len(regexp_extract_all(c, '(?s)```(?:python|py)?\s*\n(.*?)```', 1)) AS n, md5(array_to_string(regexp_extract_all(c, '(?s)```(?:python|py)?\s*\n(.*?)```', 1), '|')) AS digest FROM f""")
def code_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of whole documents, each fenced and followed by a block; fences inside a text count as they come."""
    body = F.concat(F.lit("see\n```python\n"), F.coalesce("text", F.lit("")), F.lit("\n```\n```\nx = 1\n```"))
    found = X.code_blocks(body)
    return T.table(spark, d, "documents").select("doc_id", F.size(found).cast("bigint").alias("n"), F.md5(F.array_join(found, "|")).alias("digest"))


@query("str06_hosts", "WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^/:]+)', 1) AS host FROM pages) SELECT host, count(*) AS n FROM h WHERE host <> '' GROUP BY 1")
def hosts(spark: SparkSession, d: str) -> DataFrame:
    p = T.table(spark, d, "pages").select(X.host(F.try_element_at(X.urls("url"), F.lit(1))).alias("host"))
    return p.filter("host IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("n"))


@query("str08_judge_scores", "SELECT event_id, CASE WHEN event_type = 'error' THEN 5e0 ELSE CAST(event_id % 11 AS DOUBLE) END AS a, CASE WHEN event_type = 'error' THEN 5e0 ELSE CAST(event_id % 7 AS DOUBLE) + 0.5e0 END AS b FROM events")
def judge_scores(spark: SparkSession, d: str) -> DataFrame:
    """Answers are built from events; errors leave out one score."""
    n = lambda e: F.expr(e).cast("string")
    answer = F.concat(F.lit('{"combined_scores": {"Agent_A": '), n("event_id % 11"), F.when(F.col("event_type") == "error", "}}").otherwise(F.concat(F.lit(', "Agent_B": '), n("event_id % 7"), F.lit(".5}}"))))
    return T.table(spark, d, "events").select("event_id", X.judge_scores(answer).alias("s")).select("event_id", "s.*")


@query("str09_split_answer", f"{_MSGS}, l AS (SELECT conv_id, max(turn) AS last FROM m GROUP BY 1) SELECT m.conv_id, count(*) FILTER (role = 'assistant' AND turn < last) AS n_steps, sha256(CASE WHEN max(role) FILTER (turn = last) = 'assistant' THEN max(text) FILTER (turn = last) ELSE 'No reply.' END) AS digest FROM m JOIN l USING (conv_id) GROUP BY 1")
def split_answer(spark: SparkSession, d: str) -> DataFrame:
    m = T.conversations(spark, d).select("conv_id", X.split_answer("messages").alias("s"))
    return m.select("conv_id", F.size("s.steps").cast("bigint").alias("n_steps"), F.sha2(F.coalesce("s.answer", F.lit("")), 256).alias("digest"))


@query("str10_content_hash", "SELECT substr(sha256(text), 1, 16) AS h, count(*) AS n FROM documents GROUP BY 1")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "documents").groupBy(X.content_hash("text").alias("h")).agg(F.count(F.lit(1)).alias("n"))


@query("str11_cache_key", "SELECT doc_id, md5(CASE WHEN length(source || ':' || text) > 1024 THEN md5(source || ':' || text) ELSE source || ':' || text END) AS k FROM documents")
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "documents").select("doc_id", F.md5(X.cache_key("source", "text")).alias("k"))


@query("str13_rationale", "SELECT event_id, '<thinking>' || chr(10) || CASE WHEN event_id % 3 = 0 THEN 'r' ELSE 'x' END || event_id || chr(10) || '</thinking>' AS rationale FROM events")
def rationale(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events")
    out = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("rationale")))).otherwise(F.to_json(F.struct(F.lit("").alias("rationale"), F.concat(F.lit("x"), F.col("event_id").cast("string")).alias("explanation"))))
    return e.select("event_id", X.rationale(out).alias("rationale"))


@query("str14_correction_prompt", "SELECT user_id, CASE WHEN count(*) > 40 THEN 'Attempt 2 still has problems:' ELSE 'Your answer has problems:' END || chr(10) || string_agg(rn || '. ' || event_type || ': event ' || event_id, chr(10) ORDER BY rn) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE event_type = 'error') GROUP BY 1")
def correction_prompt(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events").filter("event_type = 'error'")
    g = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.col("event_type").alias("plugin"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message")))).alias("f"))
    attempt = F.when(F.size("f") > 40, 2).otherwise(1)
    return g.select("user_id", X.correction_prompt("f", attempt).alias("prompt"))


@query("str15_error_lines", "SELECT user_id, string_agg('- check: ' || event_id || chr(10) || '  * first' || chr(10) || '  * second', chr(10) ORDER BY event_id) AS lines FROM events WHERE event_type = 'error' GROUP BY 1")
def error_lines(spark: SparkSession, d: str) -> DataFrame:
    r = F.struct("event_id", F.lit("check").alias("plugin"), F.when(F.col("event_type") == "error", "failed").otherwise("passed").alias("status"), F.col("event_id").cast("string").alias("message"), F.array(F.lit("first"), F.lit("second")).alias("errors"))
    g = T.table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(r)).alias("r"))
    return g.select("user_id", X.error_lines("r").alias("lines")).filter("lines <> ''")


@query("str16_inject_message", f"{_MSGS}, l AS (SELECT conv_id, max(turn) FILTER (role = 'assistant') AS a, count(*) AS n FROM m GROUP BY 1), p AS (SELECT m.conv_id, count(*) FILTER (turn < a) AS before FROM m JOIN l USING (conv_id) GROUP BY 1) SELECT l.conv_id, n + 1 AS n, CASE WHEN a IS NULL THEN n + 1 ELSE before + 1 END AS at FROM l JOIN p USING (conv_id)")
def inject(spark: SparkSession, d: str) -> DataFrame:
    note = F.struct(F.lit(-1).cast("bigint").alias("turn"), F.lit("tool").alias("role"), F.lit("fix it").alias("content"))
    m = T.conversations(spark, d).select("conv_id", X.inject("messages", note).alias("m"))
    at = F.array_position(F.transform("m", lambda x: x["turn"]), F.lit(-1).cast("bigint"))
    return m.select("conv_id", F.size("m").cast("bigint").alias("n"), at.cast("bigint").alias("at"))


@query("str17_token_estimate", f"{_MSGS} SELECT conv_id, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM m GROUP BY 1")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return T.conversations(spark, d).select("conv_id", X.token_estimate("messages").alias("tokens"))


@query("str18_system_prompt", "SELECT event_id, 'Current time: ' || strftime(ts, '%d/%m/%Y, %H:%M') || chr(10) || CASE WHEN event_id % 6 < 5 THEN (5 - event_id % 6) || ' tool turns remain.' ELSE 'No tool turns remain: answer now.' END AS prompt FROM events")
def system_prompt(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "events").select("event_id", X.system_prompt(F.col("ts").cast("timestamp_ntz"), F.col("event_id") % 6, 5).alias("prompt"))


@query("win13_last_and_first", f"{_MSGS}, a AS ({_LAST.format('assistant')}), u AS ({_LAST.format('user').replace('arg_max', 'arg_min')}) SELECT c.conv_id, sha256(a.x) AS last_assistant, sha256(u.x) AS first_user FROM (SELECT DISTINCT conv_id FROM m) c LEFT JOIN a USING (conv_id) LEFT JOIN u USING (conv_id)")
def last_and_first(spark: SparkSession, d: str) -> DataFrame:
    return T.conversations(spark, d).select("conv_id", F.sha2(X.last_of("messages", "assistant"), 256).alias("last_assistant"), F.sha2(X.first_of("messages", "user"), 256).alias("first_user"))


@query("flt12_truthiness", "SELECT event_id, lower(event_type) IN ('1', 'true', 'yes') AS truthy, length(trim(props)) > 0 AS filled FROM events")
def truthiness(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "events").select("event_id", X.to_bool("event_type").alias("truthy"), X.has_text("props").alias("filled"))


@query("mth02_quality_tier", "WITH x AS (SELECT event_id, value / 100 AS d FROM events) SELECT event_id, CASE WHEN d > 0.5 THEN 'gold' WHEN d > 0.2 THEN 'silver' ELSE 'bronze' END AS tier, round(least(d + 0.5, 1e0), 9) AS confidence FROM x")
def tiers(spark: SparkSession, d: str) -> DataFrame:
    x = T.table(spark, d, "events").select("event_id", (F.col("value") / 100).alias("d"))
    return x.select("event_id", X.quality_tier("d").alias("tier"), F.round(X.tier_confidence("d"), 9).alias("confidence"))


@query("mth03_accuracy", "SELECT round(avg(CASE WHEN event_type = 'view' THEN 0.5e0 + 0.5e0 * coalesce(value / 100, 0.5e0) ELSE 0e0 END), 6) AS accuracy FROM events")
def accuracy(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "events").agg(F.round(F.coalesce(F.avg(X.accuracy(F.upper("event_type"), F.lit("VIEW"), F.col("value") / 100)), F.lit(0.0)), 6).alias("accuracy"))


@query("mth04_training_cost", "SELECT p_partkey, round(p_size * 2000e0 / CASE p_partkey % 3 WHEN 0 THEN 50000e0 WHEN 1 THEN 5000e0 ELSE 15000e0 END / 3600, 8) AS hours, round(p_size * 2000e0 / CASE p_partkey % 3 WHEN 0 THEN 50000e0 WHEN 1 THEN 5000e0 ELSE 15000e0 END / 3600 * CASE p_partkey % 3 WHEN 0 THEN 4e0 WHEN 1 THEN 0.35e0 ELSE 1e0 END, 8) AS dollars FROM part")
def training_cost(spark: SparkSession, d: str) -> DataFrame:
    p = T.table(spark, d, "part").withColumn("gpu", F.element_at(F.array(F.lit("H100"), F.lit("T4"), F.lit("other")), (F.col("p_partkey") % 3 + 1).cast("int")))
    return p.select("p_partkey", F.round(X.training_hours("p_size", "gpu"), 8).alias("hours"), F.round(X.training_cost("p_size", "gpu"), 8).alias("dollars"))


@query("mth05_sweep", "SELECT n_nationkey, i, round(0.1 + 0.8 * i / 3, 6) AS temperature FROM nation, (SELECT unnest(range(0, 4)) AS i)")
def sweep(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "nation").select("n_nationkey", F.posexplode(X.sweep(0.1, 0.9, 4)).alias("i", "t")).select("n_nationkey", F.col("i").cast("bigint").alias("i"), F.round("t", 6).alias("temperature"))


@query("mth07_rubric", "WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey % 11 AS a, l_suppkey % 11 AS b, l_orderkey % 11 AS c FROM lineitem) SELECT l_orderkey, l_linenumber, CAST((6 * CAST(floor((2 * (a + b + c) + 3) / 6) AS BIGINT) + 4 * CAST(floor((2 * (a + a + b + c) + 4) / 8) AS BIGINT)) AS BIGINT) AS tenths FROM x")
def rubric(spark: SparkSession, d: str) -> DataFrame:
    a, b, c = F.col("l_partkey") % 11, F.col("l_suppkey") % 11, F.col("l_orderkey") % 11
    return T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(10 * X.rubric([a, b, c], [a, a, b, c])).cast("bigint").alias("tenths"))


# ---- verification ------------------------------------------------------------------------------------------------------


@query("ver11_secret_scan", r"""SELECT doc_id, 'token' AS rule, CAST(len(regexp_extract_all(text, 'token\s*=\s*[''"][0-9a-f]{40}[''"]')) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, 'token\s*=\s*[''"][0-9a-f]{40}[''"]') UNION ALL SELECT doc_id, 'password', CAST(len(regexp_extract_all(text, 'password\s*=\s*[0-9A-Za-z]+')) AS BIGINT) FROM documents WHERE regexp_matches(text, 'password\s*=\s*[0-9A-Za-z]+') UNION ALL SELECT doc_id, 'aws_key', CAST(len(regexp_extract_all(text, 'AKIA[0-9A-Z]{16}')) AS BIGINT) FROM documents WHERE regexp_matches(text, 'AKIA[0-9A-Z]{16}') UNION ALL SELECT doc_id, 'private_key', CAST(len(regexp_extract_all(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----')) AS BIGINT) FROM documents WHERE regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----')""")
def secrets(spark: SparkSession, d: str) -> DataFrame:
    return V.findings(T.table(spark, d, "documents").select("doc_id", "text"), V.SECRET_RULES).select("doc_id", "rule", "n")


_RESULTS = r"""WITH r AS (SELECT doc_id AS traj_id, CASE WHEN n_chars > 20000 THEN 'failed' ELSE 'passed' END AS status, 'too long' AS message, 1.0e0 AS modifier FROM documents
UNION ALL SELECT doc_id, CASE WHEN regexp_matches(text, 'token\s*=\s*"[0-9a-f]{40}"') THEN 'failed' ELSE 'passed' END, 'secret', 0.5e0 FROM documents
UNION ALL SELECT doc_id, CASE WHEN lang = 'fr' THEN 'skipped' WHEN doc_id % 97 = 0 THEN 'error' ELSE 'passed' END, 'language', 1.0e0 FROM documents)"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    docs = T.table(spark, d, "documents")
    row = lambda status, message, m: docs.select(F.col("doc_id").alias("traj_id"), F.lit(message).alias("plugin_name"), status.alias("status"), F.lit(message).alias("message"), F.lit(m).alias("modifier"))
    long = row(F.when(F.col("n_chars") > 20000, "failed").otherwise("passed"), "too long", 1.0)
    secret = row(F.when(F.col("text").rlike(r'token\s*=\s*"[0-9a-f]{40}"'), "failed").otherwise("passed"), "secret", 0.5)
    lang = row(F.when(F.col("lang") == "fr", "skipped").when(F.col("doc_id") % 97 == 0, "error").otherwise("passed"), "language", 1.0)
    return long.unionByName(secret).unionByName(lang)


@query("agg12_verdicts", f"{_RESULTS} SELECT traj_id, bool_and(status IN ('passed', 'skipped')) AS all_passed, bool_or(status = 'failed') AS hard_failure, CASE WHEN bool_or(status = 'failed') THEN 0e0 ELSE product(CASE WHEN status = 'passed' THEN modifier ELSE 1e0 END) END AS modifier, coalesce(string_agg(message, ',' ORDER BY message) FILTER (status = 'failed'), '') AS messages FROM r GROUP BY 1")
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    return V.verdicts(_results(spark, d)).withColumn("messages", F.array_join("messages", ","))


@query("flt14_validity_split", f"{_RESULTS}, v AS (SELECT traj_id, bool_and(status IN ('passed', 'skipped')) AS ok, bool_or(status = 'failed') AS bad FROM r GROUP BY 1) SELECT count(*) FILTER (ok) AS valid, count(*) FILTER (bad) AS dead, count(*) FILTER (NOT ok AND NOT bad) AS neither FROM v")
def validity_split(spark: SparkSession, d: str) -> DataFrame:
    ok, bad = F.col("all_passed"), F.col("hard_failure")
    return V.verdicts(_results(spark, d)).agg(F.count_if(ok).alias("valid"), F.count_if(bad).alias("dead"), F.count_if(~ok & ~bad).alias("neither"))


@query("join07_failure_messages", f"{_RESULTS}, f AS (SELECT traj_id, string_agg(message, ';' ORDER BY message) AS reasons FROM r WHERE status = 'failed' GROUP BY 1) SELECT doc_id, coalesce(reasons, '') AS reasons FROM documents JOIN labels USING (doc_id) LEFT JOIN f ON doc_id = traj_id WHERE quality = 0")
def failure_messages(spark: SparkSession, d: str) -> DataFrame:
    lost = T.table(spark, d, "documents").select("doc_id").join(T.table(spark, d, "labels").filter("quality = 0").select("doc_id"), "doc_id")
    why = _results(spark, d).filter("status = 'failed'").groupBy("traj_id").agg(F.array_join(F.array_sort(F.collect_list("message")), ";").alias("reasons"))
    return lost.join(why, F.col("doc_id") == F.col("traj_id"), "left").select("doc_id", F.coalesce("reasons", F.lit("")).alias("reasons"))


@query("ver06_conditions", "SELECT page_id, url = 'x' AS eq, url <> 'x' AS ne, contains(url, 'example') AS has, regexp_matches(url, '^(?:https)') AS starts, page_id < 10 AS lt FROM pages")
def conditions(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return T.table(spark, d, "pages").select("page_id", V.condition(u, "==", "x").alias("eq"), V.condition(u, "!=", "x").alias("ne"), V.condition(u, "contains", "example").alias("has"), V.condition(u, "matches", "https").alias("starts"), V.condition(F.col("page_id"), "<", 10).alias("lt"))


@query("ver09_infra_rules", "WITH x AS (SELECT s_suppkey AS k, unnest(['s3_encryption', 's3_public', 'tag_environment', 'tag_owner', 'tag_project']) AS rule FROM supplier) SELECT k AS traj_id, rule, CASE WHEN rule LIKE 'tag%' THEN 'medium' ELSE 'high' END AS severity FROM x WHERE (rule = 's3_public' AND k % 2 = 0) OR (rule = 's3_encryption' AND k % 3 <> 0) OR rule IN ('tag_owner', 'tag_project') OR (rule = 'tag_environment' AND k % 5 <> 0)")
def infra_rules(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    config = F.to_json(F.struct(F.when(k % 2 == 0, "public-read").otherwise("private").alias("acl"), F.when(k % 3 == 0, "aes").alias("encryption"), F.struct(F.when(k % 5 == 0, "prod").alias("Environment")).alias("tags")))
    r = T.table(spark, d, "supplier").select(k.alias("traj_id"), F.lit("aws_s3_bucket").alias("type"), F.lit("b").alias("name"), config.alias("config"))
    return V.resource_findings(r, V.infra_checks()).select("traj_id", "rule", "severity")


@query("ver10_container_rules", "WITH x AS (SELECT p_partkey AS k, unnest(['privileged', 'no_limits', 'latest_image']) AS rule FROM part) SELECT k AS traj_id, rule FROM x WHERE (rule = 'privileged' AND k % 7 = 0) OR (rule = 'no_limits' AND k % 2 = 0) OR (rule = 'latest_image' AND k % 3 = 0)")
def container_rules(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    c = F.struct(F.lit("c").alias("name"), F.when(k % 3 == 0, "app:latest").otherwise("app:1.2").alias("image"), (k % 7 == 0).alias("privileged"), F.when(k % 2 != 0, "100m").alias("cpu"))
    m = T.table(spark, d, "part").select(k.alias("traj_id"), F.to_json(F.struct(F.array(c).alias("containers"))).alias("config"))
    return V.container_findings(m).select("traj_id", "rule")


@query("ver03_tool_calls", "SELECT event_id AS call_id, CASE WHEN event_id % 5 = 0 THEN 'unknown tool' WHEN event_id % 5 = 1 THEN 'arguments are not JSON' WHEN event_id % 5 = 2 THEN 'missing: city,days' END AS error FROM events")
def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    calls = T.table(spark, d, "events").select(F.col("event_id").alias("call_id"), F.when(k == 0, "nothing").otherwise("weather").alias("tool"), F.when(k == 1, "{oops").when(k == 2, "{}").otherwise('{"city": "x", "days": 2}').alias("arguments"))
    tools = spark.createDataFrame([("weather", ["city", "days"])], "tool string, required array<string>")
    return V.tool_call_errors(calls, tools)


@query("ver13_test_counts", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 5 ELSE 2 END AS passed, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END AS failed FROM events")
def test_counts(spark: SparkSession, d: str) -> DataFrame:
    out = F.element_at(F.array(F.lit("3 passed, 1 failed in 2s"), F.lit("Ran 5 tests in 1s\n\nOK"), F.lit("Ran 4 tests in 1s\nFAILED (failures=2)")), (F.col("event_id") % 3 + 1).cast("int"))
    return T.table(spark, d, "events").select("event_id", V.test_counts(out).alias("t")).select("event_id", F.col("t.passed").cast("int").alias("passed"), F.col("t.failed").cast("int").alias("failed"))


@query("src13_jsonl_export", "SELECT o_orderkey, md5('{\"id\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}') AS line FROM orders")
def jsonl(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "orders").select("o_orderkey", F.md5(F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")))).alias("line"))
