"""Verification of messages: rule tables, policies and certificates.

Detectors work on rows (traj_id, message_index, role, content); a verdict row is (traj_id, plugin, status, message,
modifier) with status passed, failed, skipped or error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rules by name, severity and pattern.
CODE_RULES = [
    ("B307", "high", r"\beval\s*\("),
    ("B102", "high", r"\bexec\s*\("),
    ("B605", "high", r"\bos\.system\s*\("),
    ("B602", "high", r"\bsubprocess\.call\s*\([^)]*shell\s*=\s*True"),
    ("B301", "medium", r"\bpickle\.loads?\s*\("),
    ("B506", "medium", r"\byaml\.load\s*\([^)]*Loader\s*=\s*None"),
    ("B105", "medium", r"password\s*=\s*['\"][^'\"]+['\"]"),
    ("B105", "medium", r"api_key\s*=\s*['\"][^'\"]+['\"]"),
    ("B311", "low", r"\brandom\."),
    ("B101", "low", r"\bassert\s+"),
]
# Our own rules.
SECRET_RULES = [
    ("token", "critical", r"token\s*=\s*['\"][0-9a-f]{40}['\"]"),
    ("password", "critical", r"password\s*=\s*[0-9A-Za-z]+"),
    ("aws_key", "critical", r"AKIA[0-9A-Z]{16}"),
    ("private_key", "critical", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]
BLOCKED = ("rm -rf /", "drop table", "delete from", "; drop", "truncate table")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule string, severity string, pattern string")


def findings(texts: DataFrame, rules: list[tuple[str, str, str]], text: str = "text") -> DataFrame:
    """One row for each rule that a text meets, with its number of matches. Rules are columns, so each text is read once and no join is made."""
    hits = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), F.regexp_count(F.col(text), F.lit(p)).cast("bigint").alias("n")) for r, s, p in rules))
    return texts.withColumn("f", F.explode(F.filter(hits, lambda x: x["n"] > 0))).select("*", "f.*").drop("f")


def line_findings(code: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(id, line, rule, severity): rules met by lines of code, numbered from 1."""
    lines = code.select("id", F.posexplode(F.split("code", "\n")).alias("at", "text"))
    return findings(lines, rules).select("id", (F.col("at") + 1).cast("bigint").alias("line"), "rule", "severity")


def verdicts(results: DataFrame) -> DataFrame:
    """All results of a trajectory: all passed or skipped, any failure, and the product of modifiers (0 after a failure)."""
    passed = F.filter(F.collect_list(F.when(F.col("status") == "passed", F.coalesce("modifier", F.lit(1.0)))), lambda x: x.isNotNull())
    g = results.groupBy("traj_id").agg(
        F.bool_and(F.col("status").isin("passed", "skipped")).alias("all_passed"),
        F.bool_or(F.col("status") == "failed").alias("hard_failure"),
        F.aggregate(F.array_sort(passed), F.lit(1.0), lambda a, x: a * x).alias("product"),
        F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.col("message")))).alias("messages"),
    )
    return g.select("traj_id", "all_passed", "hard_failure", F.when(F.col("hard_failure"), 0.0).otherwise(F.col("product")).alias("modifier"), "messages")


def rollup(severities: Column | str = "severity") -> list[Column]:
    """Counts by severity and the compliance that follows."""
    n = {s: F.count_if(F.col(severities) == s) for s in ("critical", "high", "medium", "low")}
    status = F.when((n["critical"] > 0) | (n["high"] > 0), "non_compliant").when(n["medium"] > 0, "partial").otherwise("compliant")
    return [*(x.cast("bigint").alias(f"n_{s}") for s, x in n.items()), status.alias("status")]


def condition(attribute: Column, operator: str, value) -> Column:
    """A policy condition on an attribute; null is unequal to everything and never less or greater."""
    v = F.lit(value) if not isinstance(value, (list, Column)) else value
    return {
        "==": lambda: attribute.eqNullSafe(v),
        "!=": lambda: ~attribute.eqNullSafe(v),
        "in": lambda: F.coalesce(attribute.isin(value), F.lit(False)),
        "contains": lambda: F.coalesce(F.contains(attribute, v), F.lit(False)),
        "matches": lambda: F.coalesce(F.regexp_like(attribute, F.concat(F.lit("^(?:"), v, F.lit(")"))), F.lit(False)),
        "<": lambda: F.coalesce(attribute < v, F.lit(False)),
        ">": lambda: F.coalesce(attribute > v, F.lit(False)),
    }[operator]()


def resource_findings(resources: DataFrame, checks: list[tuple[str, str, str, Column]]) -> DataFrame:
    """Checks (id, resource type, severity, condition that is a violation) over resources (traj_id, type, name, config)."""
    hits = F.array(*(F.struct(F.lit(i).alias("rule"), F.lit(s).alias("severity"), ((F.col("type") == t) & F.coalesce(bad, F.lit(False))).alias("bad")) for i, t, s, bad in checks))
    return resources.withColumn("f", F.explode(F.filter(hits, lambda x: x["bad"]))).select("traj_id", "type", "name", "f.rule", "f.severity")


def _config(key: str) -> Column:
    return F.get_json_object("config", f"$.{key}")


REQUIRED_TAGS = ("Environment", "Owner", "Project")


def infra_checks() -> list[tuple[str, str, str, Column]]:
    """Rule id, resource type, severity, and the condition that breaks the rule."""
    return [
        ("s3_public", "aws_s3_bucket", "high", _config("acl").isin("public-read", "public-read-write")),
        ("s3_encryption", "aws_s3_bucket", "high", _config("encryption").isNull()),
        ("ebs_encryption", "aws_ebs_volume", "high", ~F.coalesce(_config("encrypted") == "true", F.lit(False))),
        ("vpc_required", "aws_instance", "medium", _config("subnet_id").isNull()),
        *((f"tag_{t.lower()}", "aws_s3_bucket", "medium", _config(f"tags.{t}").isNull()) for t in REQUIRED_TAGS),
    ]


CONTAINERS = "array<struct<name:string,image:string,privileged:boolean,cpu:string>>"


def container_findings(manifests: DataFrame) -> DataFrame:
    """Rules over the containers of manifests (traj_id, config as JSON)."""
    c = manifests.select("traj_id", F.explode(F.from_json(F.get_json_object("config", "$.containers"), CONTAINERS)).alias("c")).select("traj_id", "c.*")
    rules = F.array(
        F.struct(F.lit("privileged").alias("rule"), F.lit("critical").alias("severity"), F.coalesce("privileged", F.lit(False)).alias("bad")),
        F.struct(F.lit("no_limits").alias("rule"), F.lit("medium").alias("severity"), F.col("cpu").isNull().alias("bad")),
        F.struct(F.lit("latest_image").alias("rule"), F.lit("low").alias("severity"), (F.endswith("image", F.lit(":latest")) | ~F.contains("image", F.lit(":"))).alias("bad")),
    )
    return c.withColumn("f", F.explode(F.filter(rules, lambda x: x["bad"]))).select("traj_id", "name", "f.rule", "f.severity")


def tool_call_errors(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Errors of tool calls (call_id, tool, arguments as JSON) against known tools (tool, required): unknown, bad JSON, missing arguments."""
    j = calls.join(tools, "tool", "left")
    missing = F.array_except("required", F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>")))
    error = F.when(F.col("required").isNull(), "unknown tool").when(F.try_parse_json("arguments").isNull(), "arguments are not JSON").when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(F.array_sort(missing), ",")))
    return j.select("call_id", error.alias("error"))


def test_counts(output: str | Column) -> Column:
    """struct(passed, failed, errors) read from a test run's output, in either of two common forms."""
    o = F.col(output) if isinstance(output, str) else output
    n = lambda p: F.coalesce(F.nullif(F.regexp_extract(o, p, 1), F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))
    ran, bad = n(r"Ran (\d+) test"), n(r"failures=(\d+)")
    first = o.rlike(r"\d+ (passed|failed|error)")
    return F.struct(F.when(first, n(r"(\d+) passed")).otherwise(F.when(o.rlike(r"\bOK\b"), ran).otherwise(ran - bad)).alias("passed"), F.when(first, n(r"(\d+) failed")).otherwise(bad).alias("failed"), F.when(first, n(r"(\d+) error")).otherwise(0).alias("errors"))


def edge_reason(text: str, blocked: tuple[str, ...] = BLOCKED, most: int = 100_000) -> Column:
    """The first reason to stop a text at the edge, or null: length, blocklist, secrets."""
    t = F.col(text)
    low = F.lower(t)
    listed = F.lit(False)
    for b in blocked:
        listed = listed | F.contains(low, F.lit(b))
    secret = F.lit(False)
    for _, _, p in SECRET_RULES:
        secret = secret | t.rlike(p)
    return F.when(t.isNull(), "format").when(F.length(t) > most, "format").when(listed, "blocklist").when(secret, "policy")
