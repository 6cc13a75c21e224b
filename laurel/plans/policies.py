"""Queries over access policies: conditional permits and forbids over orders, and over requests that messages about pages make.

The operators count the conditions that hold; the SQL asks that there be none that does not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import policies as P
from ..sources import tables as T
from .registry import query

ORDER_POLICIES = [
    ("cheap", "permit", "Agent::*", "*", "Order::*", [("total", "<", "150000"), ("status", "in", '["F", "O"]')]),
    ("low", "permit", "Agent::*", "read", "Order::*", [("tags", "contains", '"LOW"')]),
    ("early", "permit", "Agent::a1", "read", "*", [("status", "matches", '"[FP]"'), ("total", ">", "1000.5")]),
    ("big", "forbid", "*", "*", "*", [("total", ">", "300000"), ("late", "==", "true")]),
    ("unset", "forbid", "Agent::*", "write", "Order::*", [("late", "!=", "true"), ("name", ">", '"c9"')]),
    ("named", "forbid", "Agent::a2", "*", "Order::1-URGENT", [("name", "contains", '"7"')]),
    ("missing", "permit", "*", "*", "*", [("nothing", "==", '"x"')]),
    ("seven", "forbid", "Agent::a3", "write", "Order::*", []),
]
_ORDERS_SQL = """WITH r AS (SELECT o_orderkey AS request_id, 'a' || o_custkey % 5 AS who, CASE WHEN o_orderkey % 3 = 0 THEN 'write' ELSE 'read' END AS act, o_orderpriority AS what, o_totalprice AS total, o_orderstatus AS status, o_orderstatus = 'O' AS late, 'c' || o_custkey AS name FROM orders),
m AS (SELECT request_id,
  [id for id in CASE WHEN total < 150000 AND status IN ('F', 'O') THEN ['cheap'] ELSE [] END] AS c1,
  [id for id in CASE WHEN act = 'read' AND what LIKE '%-LOW' THEN ['low'] ELSE [] END] AS c2,
  [id for id in CASE WHEN act = 'read' AND who = 'a1' AND status IN ('F', 'P') AND total > 1000.5 THEN ['early'] ELSE [] END] AS c3,
  [id for id in CASE WHEN total > 300000 AND late THEN ['big'] ELSE [] END] AS f1,
  [id for id in CASE WHEN act = 'write' AND NOT late AND name > 'c9' THEN ['unset'] ELSE [] END] AS f2,
  [id for id in CASE WHEN who = 'a2' AND what = '1-URGENT' AND contains(name, '7') THEN ['named'] ELSE [] END] AS f3,
  [id for id in CASE WHEN who = 'a3' AND act = 'write' THEN ['seven'] ELSE [] END] AS f4 FROM r),
n AS (SELECT request_id, list_sort(c1 || c2 || c3) AS p, list_sort(f1 || f2 || f3 || f4) AS f FROM m)
SELECT request_id, len(p) > 0 AND len(f) = 0 AS allowed, array_to_string(p, ',') AS permits, array_to_string(f, ',') AS forbids FROM n"""


def _decided(requests: DataFrame, policies: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(c, ",").alias(c)
    return P.decisions(requests, policies).select("request_id", "allowed", joined("permits"), joined("forbids"))


@query("join05_policy_requests", _ORDERS_SQL)
def policy_requests(spark: SparkSession, d: str) -> DataFrame:
    """Orders as requests, with numbers, strings, truth values, lists and missing attributes in their contexts."""
    o = T.table(spark, d, "orders")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    context = F.map_filter(
        F.create_map(
            *(F.lit("total"), F.col("o_totalprice").cast("string")),
            *(F.lit("status"), text(F.col("o_orderstatus"))),
            *(F.lit("late"), F.when(F.col("o_orderstatus") == "O", "true").when(F.col("o_orderkey") % 2 == 0, "false")),
            *(F.lit("name"), text(F.concat(F.lit("c"), F.col("o_custkey").cast("string")))),
            *(F.lit("tags"), F.to_json(F.split("o_orderpriority", "-"))),
        ),
        lambda _, v: v.isNotNull(),
    )
    agent = F.concat(F.lit("Agent::a"), (F.col("o_custkey") % 5).cast("string"))
    action = F.when(F.col("o_orderkey") % 3 == 0, "write").otherwise("read")
    r = o.select(F.col("o_orderkey").alias("request_id"), agent.alias("principal"), action.alias("action"), F.concat(F.lit("Order::"), "o_orderpriority").alias("resource"), context.alias("context"))
    return _decided(r, spark.createDataFrame(ORDER_POLICIES, P.POLICY))


NETWORK_POLICIES = [
    ("p1", "permit", "Agent::*", 'Action::"connect"', "Host::*", [("role", "in", '["user", "tool"]')]),
    ("p2", "permit", "Agent::*", 'Action::"fetch"', "Host::*", [("tool", "==", '"fetch"'), ("argument", "!=", '"target"')]),
    ("f1", "forbid", "Agent::*", 'Action::"connect"', "Host::*", [("url", "matches", '"http://10[.]"')]),
    ("f2", "forbid", "*", "*", "*", [("url", "contains", '"utm_source"'), ("role", "==", '"tool"')]),
    ("f3", "forbid", "*", "*", "*", [("url", "<", '"http://c"')]),
    ("f4", "forbid", "*", "*", "*", [("url", ">", '"https://x"')]),
    ("f5", "forbid", 'Agent::"a7"', "*", "*", []),
    ("f6", "forbid", "*", 'Action::"fetch"', 'Host::"cache.example.org"', []),
]
_ROWS = ",\n".join(f"('{i}', '{e}', '{p}', '{a}', '{r}')" for i, e, p, a, r, _ in NETWORK_POLICIES)
_CONDITIONS = ", ".join(f"('{i}', '{a}', '{o}', {v if o != 'in' else 'null'})".replace('"', "'") for i, *_, cs in NETWORK_POLICIES for a, o, v in cs)
_NETWORK_SQL = f"""WITH m AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/:]+)', 1) AS host, 'Agent::"a' || page_id % 10 || '"' AS who FROM pages),
r AS (
  SELECT page_id, 0 AS message_index, who, 'Action::"connect"' AS act, host, url, 'user' AS role, NULL AS tool, NULL AS argument FROM m
  UNION ALL SELECT page_id, 0, who, 'Action::"connect"', '10.0.0.' || page_id % 3, 'http://10.0.0.' || page_id % 3 || '/x', 'user', NULL, NULL FROM m WHERE page_id % 4 = 0
  UNION ALL SELECT page_id, 1, who, 'Action::"fetch"', host, NULL, NULL, 'fetch', 'url' FROM m WHERE page_id % 11 <> 0
  UNION ALL SELECT page_id, 1, who, 'Action::"fetch"', 'cache.example.org', NULL, NULL, 'fetch', 'host' FROM m WHERE page_id % 11 <> 0 AND page_id % 5 = 0
  UNION ALL SELECT page_id, 1, who, 'Action::"probe"', 'db-1', NULL, NULL, 'probe', 'target' FROM m WHERE page_id % 7 = 0
  UNION ALL SELECT page_id, 2, who, 'Action::"connect"', host, url, 'tool', NULL, NULL FROM m WHERE page_id % 2 = 0
), q AS (SELECT row_number() OVER () AS k, * FROM r),
p AS (SELECT * FROM (VALUES {_ROWS}) v(id, effect, principal, action, resource)),
c AS (SELECT * FROM (VALUES {_CONDITIONS}) v(id, attribute, operator, value)),
covered AS (SELECT k, p.id, effect FROM q JOIN p ON (principal IN ('*', who) OR (principal LIKE '%::*' AND starts_with(who, rtrim(principal, '*'))))
  AND (action IN ('*', act) OR (action LIKE '%::*' AND starts_with(act, rtrim(action, '*'))))
  AND (resource IN ('*', 'Host::"' || host || '"') OR (resource LIKE '%::*' AND starts_with('Host::"' || host || '"', rtrim(resource, '*'))))),
attribute AS (SELECT k, unnest(['url', 'role', 'tool', 'argument']) AS attribute, unnest([url, role, tool, argument]) AS found FROM q),
met AS (SELECT * FROM covered v WHERE NOT EXISTS (SELECT 1 FROM c JOIN attribute a ON a.attribute = c.attribute WHERE c.id = v.id AND a.k = v.k AND NOT coalesce(
  CASE operator WHEN '==' THEN found = value WHEN '!=' THEN found IS DISTINCT FROM value WHEN 'in' THEN found IN ('user', 'tool') WHEN 'contains' THEN contains(found, value)
  WHEN 'matches' THEN regexp_matches(found, '^(?:' || value || ')') WHEN '<' THEN found < value WHEN '>' THEN found > value END, false))),
d AS (SELECT k, count(*) FILTER (effect = 'permit') > 0 AND count(*) FILTER (effect = 'forbid') = 0 AS allowed, coalesce(string_agg(id, ',' ORDER BY id) FILTER (effect = 'permit'), '') AS permits, coalesce(string_agg(id, ',' ORDER BY id) FILTER (effect = 'forbid'), '') AS forbids FROM met GROUP BY k)"""


def network_messages(spark: SparkSession, d: str) -> DataFrame:
    """Three messages about each page: what the user asks, an answer with tool calls (some broken), and what a tool says."""
    n, url = F.col("page_id"), F.col("url")
    call = lambda when, name, arguments: F.when(when, F.struct(F.lit(name).alias("name"), arguments.alias("arguments")))
    fetch = F.to_json(F.struct("url", (n % 7).alias("depth"), F.when(n % 5 == 0, "cache.example.org").alias("host"), F.lit("not a host!").alias("endpoint"), F.array(F.lit("x")).alias("address")))
    broken = F.lit('{"url": "http://never.example/"')
    calls = F.filter(F.array(call(F.lit(True), "fetch", F.when(n % 11 == 0, broken).otherwise(fetch)), call(n % 7 == 0, "probe", F.lit('{"target": "db-1", "host": 7}'))), lambda x: x.isNotNull())
    none = F.lit(None).cast("array<struct<name:string,arguments:string>>")
    ask = F.concat(F.lit("Look at "), url, F.when(n % 4 == 0, F.concat(F.lit(" and (http://10.0.0."), (n % 3).cast("string"), F.lit("/x)"))).otherwise(""), F.lit("\nplease"))
    said = F.when(n % 2 == 0, F.concat(F.lit("moved to <"), url, F.lit(">"))).otherwise("nothing, see example.org")
    message = lambda k, role, content, tools: F.struct(F.lit(k).alias("message_index"), F.lit(role).alias("role"), content.alias("content"), tools.alias("tool_calls"))
    m = F.array(message(0, "user", ask, none), message(1, "assistant", F.lit(None).cast("string"), calls), message(2, "tool", said, none))
    return T.table(spark, d, "pages").select(n.alias("traj_id"), F.inline(m))


def _agent():
    return F.concat(F.lit("a"), (F.col("traj_id") % 10).cast("string"))


@query("ver05_network_policy", f"{_NETWORK_SQL} SELECT page_id AS traj_id, message_index, act AS action, host, coalesce(allowed, false) AS allowed, coalesce(permits, '') AS permits, coalesce(forbids, '') AS forbids, count(*) AS n FROM q LEFT JOIN d USING (k) GROUP BY ALL")
def network_policy(spark: SparkSession, d: str) -> DataFrame:
    """The requests of all messages, each decided."""
    r = P.network_requests(network_messages(spark, d), _agent())
    r = r.withColumn("request_id", F.struct("traj_id", "message_index", "action", "resource", "principal"))
    host = F.regexp_extract("request_id.resource", '"(.*)"', 1)
    out = _decided(r, spark.createDataFrame(NETWORK_POLICIES, P.POLICY))
    return out.groupBy("request_id.traj_id", "request_id.message_index", "request_id.action", host.alias("host"), "allowed", "permits", "forbids").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ver05_network_verdicts",
    f"{_NETWORK_SQL}, g AS (SELECT page_id, count(*) AS n, count(*) FILTER (NOT coalesce(allowed, false)) AS bad FROM q LEFT JOIN d USING (k) GROUP BY 1) SELECT page_id AS traj_id, 'network_policy' AS plugin, CASE WHEN bad > 0 THEN 'failed' ELSE 'passed' END AS status, CASE WHEN bad > 0 THEN bad || ' requests refused' ELSE n || ' requests allowed' END AS message, CASE WHEN bad > 0 THEN -1e0 ELSE 1e0 END AS modifier FROM g",
)
def network_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return P.network_verdicts(network_messages(spark, d), spark.createDataFrame(NETWORK_POLICIES, P.POLICY), _agent())


@query(
    "ver07_policy_text",
    """SELECT s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN 'forbid' ELSE 'permit' END || ' (' || chr(10) || '  principal Agent::"' || s_name || '",' || chr(10) || '  action Action::*,' || chr(10) || '  resource Host::"n' || s_nationkey || '"' || chr(10) || ')' || chr(10)
|| CASE s_suppkey % 3 WHEN 0 THEN ';' WHEN 1 THEN 'when {' || chr(10) || '  total < ' || s_nationkey || chr(10) || '};' ELSE 'when {' || chr(10) || '  url.contains("' || s_name || '") &&' || chr(10) || '  role == "user"' || chr(10) || '};' END AS text FROM supplier""",
)
def policy_text(spark: SparkSession, d: str) -> DataFrame:
    """A policy for each supplier, with no condition, one or two."""
    k = F.col("s_suppkey")
    quoted = lambda *c: F.concat(F.lit('"'), *c, F.lit('"'))
    condition = lambda attribute, operator, value: F.struct(F.lit(attribute).alias("attribute"), F.lit(operator).alias("operator"), value.alias("value"))
    one = F.array(condition("total", "<", F.col("s_nationkey").cast("string")))
    two = F.array(condition("url", "contains", quoted("s_name")), condition("role", "==", F.lit('"user"')))
    p = T.table(spark, d, "supplier").select(
        k.alias("id"),
        F.when(F.col("s_acctbal") < 0, "forbid").otherwise("permit").alias("effect"),
        F.concat(F.lit("Agent::"), quoted("s_name")).alias("principal"),
        F.lit("Action::*").alias("action"),
        F.concat(F.lit("Host::"), quoted(F.lit("n"), F.col("s_nationkey").cast("string"))).alias("resource"),
        F.when(k % 3 == 1, one).when(k % 3 == 2, two).otherwise(F.array()).alias("conditions"),
    )
    return p.select("id", P.policy_text().alias("text"))
