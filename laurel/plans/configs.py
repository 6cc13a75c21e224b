"""Queries over configurations in messages: each document's text is followed by fenced HCL, YAML or JSON whose values hang on its id and length.

Of five documents one has no configuration, one HCL, one YAML, one JSON, and one HCL, YAML and a block that does not parse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import configs as C
from ..operators import plugins as G
from ..operators import schemas as J
from ..sources import tables as T
from .registry import query


def _join(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _either(condition: Column, yes: str, no: str) -> Column:
    return F.when(condition, yes).otherwise(no)


def messages(spark: SparkSession, d: str) -> DataFrame:
    """traj_id, message_index, role, content."""
    k = F.col("doc_id")
    n = F.char_length(F.coalesce("text", F.lit("")))
    encryption = _either(k % 3 == 0, '  server_side_encryption_configuration {\n    rule { apply = "aes" } # } nested\n  }\n', "")
    tags = _either(k % 2 == 0, '{ Environment = "prod", Owner : "me", Project = "{p}" }', '{\n    Owner = "me"\n  }')
    bucket = _join('# for "', k, '" {\nresource "aws_s3_bucket" "b', k, '" {\n  acl = "', _either(k % 4 == 0, "public-read", "private"), '" // }\n', encryption, "  tags = ", tags, "\n  rule { days = ", n, " }\n  rule {\n    days = [", n % 7, ", 2]\n    to { class = var.x[0] }\n  }\n  note = <<EOT\n} = ", k, "\nEOT\n}\n")
    volume = _join('resource "aws_ebs_volume" "v" { encrypted = ', _either(k % 7 != 0, "true", "false"), "\n size = 10 }\n")
    hcl = _join("```hcl\n", bucket, volume, "```")
    container = lambda name, image, privileged: _join("      - name: ", name, "\n        image: ", image, "\n        securityContext: {privileged: ", privileged, "}\n        resources:\n          limits:\n            cpu: 0.5\n")
    deployment = _join(
        "kind: Deployment # first\nmetadata:\n  name: 'd", k, "'\nspec:\n  template:\n    spec:\n      hostNetwork: ", _either(k % 6 == 0, "yes", "no"), "\n      containers:\n",
        container(F.lit("web"), _either(k % 4 < 2, '"nginx:latest"', "nginx:1.2"), _either(k % 9 == 0, "true", "false")), "        livenessProbe:\n          exec: [a, \"b: c\"]\n", container(F.lit("side"), F.lit("app:7"), F.lit("no")),
    )
    yaml = _join("```yaml\n", deployment, "---\nkind: Service\nmetadata: {name: s, n: ", n, "}\n```")
    json = _join('```json\n{"resource": {"aws_instance": {"i', k, '": {"subnet_id": ', _either(k % 4 == 0, "null", '"s"'), ', "metadata_options": {"http_tokens": "', _either(k % 8 < 4, "required", "optional"), '"}, "tags": {"Owner": ', n, "}}}}}\n```")
    broken = F.lit("```hcl\nresource \"aws_s3_bucket\" \"x\" {\n```\n```yaml\na: b\n  c: d\n```")
    said = {1: [hcl], 2: [yaml], 3: [json], 4: [hcl, broken, yaml]}
    content = F.coalesce(*(F.when(k % 5 == m, F.concat_ws("\n", F.lit("Use this:"), *blocks)) for m, blocks in said.items()), F.lit("Nothing. ```hcl```"))
    m = F.array(F.struct(F.lit(0).alias("message_index"), F.lit("user").alias("role"), F.col("text").alias("content")), F.struct(F.lit(1).alias("message_index"), F.lit("assistant").alias("role"), content.alias("content")))
    return T.table(spark, d, "documents").select(k.alias("traj_id"), F.inline(m))


_SQL = """WITH k AS (SELECT doc_id AS k, length(coalesce(text, '')) AS n FROM documents), hcl AS (SELECT * FROM k WHERE k % 5 IN (1, 4)), yaml AS (SELECT * FROM k WHERE k % 5 IN (2, 4)), js AS (SELECT * FROM k WHERE k % 5 = 3)"""


@query(
    "str12_message_configs",
    f"""{_SQL} SELECT k AS traj_id, 'aws_s3_bucket' AS type, 'b' || k AS name, CASE WHEN k % 2 = 0 THEN '{{p}}' END AS a, n % 7 || ',2' AS b, n::VARCHAR AS c, '}} = ' || k AS d FROM hcl
UNION ALL SELECT k, 'aws_ebs_volume', 'v', NULL, NULL, NULL, NULL FROM hcl
UNION ALL SELECT k, 'Deployment', 'd' || k, CASE WHEN k % 4 < 2 THEN 'nginx:latest' ELSE 'nginx:1.2' END, 'b: c', '0.5', 'false' FROM yaml
UNION ALL SELECT k, 'Service', 's', NULL, NULL, n::VARCHAR, NULL FROM yaml
UNION ALL SELECT k, 'aws_instance', 'i' || k, NULL, NULL, n::VARCHAR, NULL FROM js""",
)
def message_configs(spark: SparkSession, d: str) -> DataFrame:
    """Values from deep inside of resources and manifests."""
    v = lambda path: F.get_json_object("config", path)
    first = "$.spec.template.spec.containers[0]"
    listed = F.array_join(F.from_json(v("$.rule[1].days"), "array<string>"), ",")
    c = C.configurations(C.extracted(messages(spark, d)))
    return c.select(
        "traj_id", "type", "name",
        F.coalesce(v("$.tags.Project"), v(f"{first}.image")).alias("a"),
        F.coalesce(listed, v(f"{first}.livenessProbe.exec[1]")).alias("b"),
        F.coalesce(v("$.rule[0].days"), v(f"{first}.resources.limits.cpu"), v("$.metadata.n"), F.when(F.col("type") == "aws_instance", v("$.tags.Owner"))).alias("c"),
        F.coalesce(F.rtrim(v("$.note"), F.lit("\n")), v("$.spec.template.spec.containers[1].securityContext.privileged")).alias("d"),
    )


_RULES_SQL = f"""{_SQL}, v AS (SELECT k, 'no_public_s3' AS rule FROM hcl WHERE k % 4 = 0 UNION ALL SELECT k, 'encrypted_ebs' FROM hcl WHERE k % 7 = 0 UNION ALL SELECT k, 'tags_required' FROM hcl WHERE k % 2 <> 0
UNION ALL SELECT k, 'tags_required' FROM js UNION ALL SELECT k, 'vpc_required' FROM js WHERE k % 4 = 0
UNION ALL SELECT k, 'no_privileged' FROM yaml WHERE k % 9 = 0 UNION ALL SELECT k, 'no_latest_tag' FROM yaml WHERE k % 4 < 2 UNION ALL SELECT k, 'no_host_network' FROM yaml WHERE k % 6 = 0)"""


@query("ver08_message_policies", f"{_RULES_SQL}, g AS (SELECT k, count(*) FILTER (rule <> 'tags_required') AS e, count(*) FILTER (rule = 'tags_required') AS w FROM v GROUP BY 1) SELECT k AS traj_id, CASE WHEN e > 0 THEN 'failed' ELSE 'passed' END AS status, CASE WHEN k % 5 = 0 THEN 'no configuration' ELSE coalesce(e, 0) || ' errors, ' || coalesce(w, 0) || ' warnings' END AS message FROM k LEFT JOIN g USING (k)")
def message_policies(spark: SparkSession, d: str) -> DataFrame:
    return C.message_policy(messages(spark, d)).select("traj_id", "status", "message")


@query("ver14_all_plugins", f"{_RULES_SQL}, g AS (SELECT k, count(*) FILTER (rule <> 'tags_required') AS e FROM v GROUP BY 1) SELECT k AS traj_id, coalesce(e, 0) = 0 AS all_passed, coalesce(e, 0) > 0 AS hard_failure, CASE WHEN e > 0 THEN 0e0 ELSE 1e0 END AS modifier FROM k LEFT JOIN g USING (k)")
def all_plugins(spark: SparkSession, d: str) -> DataFrame:
    """Safety, schemas and policy together: some trajectories pass all, and some are skipped by one."""
    return G.composite(messages(spark, d), ["safety_filter", "json_schema", "policy"]).select("traj_id", "all_passed", "hard_failure", "modifier")


_CERTIFIED_SQL = f"""{_SQL}, v AS (SELECT k, CAST(k % 3 <> 0 AS INT) + CAST(k % 4 = 0 AS INT) AS n FROM hcl UNION ALL SELECT k, CAST(k % 9 = 0 AS INT) + 1 FROM yaml UNION ALL SELECT k, CAST(k % 8 >= 4 AS INT) FROM js),
g AS (SELECT k AS traj_id, coalesce(sum(v.n), 0)::BIGINT AS n_violations, CASE WHEN k % 5 = 0 THEN 'unknown' WHEN sum(v.n) > 0 THEN 'non_compliant' ELSE 'compliant' END AS status FROM k LEFT JOIN v USING (k) GROUP BY k)"""


@query("ver23_message_certificates", f"{_CERTIFIED_SQL} SELECT *, CASE WHEN status = 'compliant' THEN TIMESTAMP '2024-01-02' END AS expires FROM g")
def message_certificates(spark: SparkSession, d: str) -> DataFrame:
    return C.message_certificates(messages(spark, d), F.lit("2024-01-01").cast("timestamp_ntz"))


@query("agg15_message_compliance", f"{_CERTIFIED_SQL} SELECT status, count(*) AS n, sum(n_violations)::BIGINT AS n_violations FROM g GROUP BY 1")
def message_compliance(spark: SparkSession, d: str) -> DataFrame:
    out = C.message_certificates(messages(spark, d), F.lit("2024-01-01").cast("timestamp_ntz"))
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("n_violations").alias("n_violations"))


_SCHEMA = {
    "type": "object",
    "required": ["id", "user"],
    "properties": {
        "id": {"type": "integer"},
        "user": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "tags": {"type": "array"}, "it's": {"type": "null"}}},
        "value": {"type": "number"},
        "done": {"type": "boolean"},
    },
}


@query("ver04_json_schema", "SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN '$: k is missing' ELSE '' END AS violations FROM events")
def json_schema(spark: SparkSession, d: str) -> DataFrame:
    found = J.violations(F.col("props"), {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}}})
    return T.table(spark, d, "events").select("event_id", F.array_join(found, ", ").alias("violations"))


def json_messages(spark: SparkSession, d: str) -> DataFrame:
    """An answer about each event, with a good block, a block with wrong parts, no fence, a block that is no JSON, none at all, and two blocks."""
    k = F.col("event_id")
    user = lambda name: F.struct(name.alias("name"), F.when(k % 4 < 2, F.array(F.lit("}"), F.lit("{x"))).alias("tags"), F.lit(None).cast("string").alias("it's"))
    good = F.to_json(F.struct(k.alias("id"), user(F.col("event_type")).alias("user"), "value", (k % 2 == 0).alias("done")), {"ignoreNullFields": "false"})
    wrong = F.to_json(F.struct(F.when(k % 3 == 0, k.cast("string")).alias("id"), F.struct(F.when(k % 5 == 0, F.array(k)).alias("name"), "value").alias("user"), F.col("props").alias("value")))
    fenced = lambda tag, json: F.concat(F.lit(f"Here:\n```{tag}\n"), json, F.lit("\n```\nend"))
    forms = {0: fenced("json", good), 1: fenced("", wrong), 2: F.concat(F.lit('a 5" {b} '), good, F.lit(' and {"id": ')), 3: fenced("json", F.substring(good, 2, 20)), 4: F.lit("Nothing }{"), 5: F.concat(fenced("json", good), F.lit("\n"), fenced("json", wrong))}
    content = F.coalesce(*(F.when(k % 6 == n, form) for n, form in forms.items()))
    return T.table(spark, d, "events").select(k.alias("traj_id"), F.lit(1).alias("message_index"), F.lit("assistant").alias("role"), content.alias("content"))


_GOOD_SQL = "CASE WHEN k % 4 >= 2 THEN '$.user.tags: not array' ELSE '' END"
_WRONG_SQL = "concat_ws(', ', CASE WHEN k % 3 <> 0 THEN '$: id is missing' ELSE '$.id: not integer' END, CASE WHEN k % 5 = 0 THEN '$.user.name: not string' ELSE '$.user: name is missing' END, '$.value: not number')"
_BLOCKS_SQL = f"""WITH e AS (SELECT event_id AS k FROM events), b AS (SELECT k, 0 AS block, {_GOOD_SQL} AS violations FROM e WHERE k % 6 IN (0, 5) UNION ALL SELECT k, 0, {_WRONG_SQL} FROM e WHERE k % 6 = 1 UNION ALL SELECT k, 1, {_WRONG_SQL} FROM e WHERE k % 6 = 5
UNION ALL SELECT k, 0, 'not JSON' FROM e WHERE k % 6 IN (2, 3) UNION ALL SELECT k, 1, {_GOOD_SQL} FROM e WHERE k % 6 = 2)"""


@query("ver04_message_blocks", f"{_BLOCKS_SQL} SELECT k AS traj_id, block, violations FROM b")
def message_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = J.json_blocks(json_messages(spark, d), inline=True)
    return blocks.select("traj_id", "block", F.array_join(J.violations(F.col("json"), _SCHEMA), ", ").alias("violations"))


@query("ver04_message_verdicts", f"{_BLOCKS_SQL}, g AS (SELECT k, count(violations) AS n, count(*) FILTER (violations <> '') AS bad FROM e LEFT JOIN b USING (k) GROUP BY 1) SELECT k AS traj_id, CASE WHEN n = 0 THEN 'skipped' WHEN bad > 0 THEN 'failed' ELSE 'passed' END AS status, CASE WHEN n = 0 THEN 'no JSON' WHEN bad > 0 THEN bad || ' of ' || n || ' blocks' ELSE n || ' blocks' END AS message FROM g")
def message_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return J.schema_verdicts(json_messages(spark, d), _SCHEMA, inline=True).select("traj_id", "status", "message")
