"""Queries over serving state: limits, caches, breakers, queues and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables as T
from ..streaming import limits as L
from .registry import query

TEL = T.TELEMETRY_SQL


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return T.telemetry(spark, d).withColumnRenamed("event_id", "request_id")


_REC = TEL.replace("WITH telemetry", "WITH RECURSIVE telemetry")
_ONE, _FOUR = (("bucket", 2, 1, 3600),), (("burst", 2, 2, 60), ("minute", 3, 3, 3600), ("hour", 5, 5, 86400), ("day", 20, 20, 10 * 86400))


def _limit_sql(rules) -> str:
    """The buckets as a recursion over each client's requests: f is what a bucket holds once refilled, m when it was refilled last, a whether it was asked."""
    k = range(len(rules))
    first = ", ".join(f"{c} - 1 AS t{i}, us AS l{i}" for i, (_, c, _, _) in enumerate(rules))
    filled = ", ".join(f"CASE WHEN q.us - l{i} >= {s}000000 THEN least({c}, t{i} + (q.us - l{i}) // {s}000000 * {r}) ELSE t{i} END AS f{i}, CASE WHEN q.us - l{i} >= {s}000000 THEN q.us ELSE l{i} END AS m{i}" for i, (_, c, r, s) in enumerate(rules))
    asked = {i: " AND ".join(["true", *(f"f{j} >= 1" for j in range(i))]) for i in k}
    after = ", ".join(f"CASE WHEN NOT ({asked[i]}) THEN t{i} WHEN f{i} >= 1 THEN f{i} - 1 ELSE f{i} END, CASE WHEN {asked[i]} THEN m{i} ELSE l{i} END" for i in k)
    denied = " ".join(f"WHEN f{i} < 1 THEN '{name}'" for i, (name, *_) in enumerate(rules))
    kept = ", ".join(f"t{i}, l{i}" for i in k)
    return f"""q AS (SELECT event_id AS request_id, client_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY client_id ORDER BY ts, event_id) AS n FROM telemetry),
run AS (SELECT request_id, client_id, n, CAST(NULL AS VARCHAR) AS denied_by, {first} FROM q WHERE n = 1
UNION ALL SELECT request_id, client_id, n, CASE {denied} END, {after} FROM (SELECT q.request_id, q.client_id, q.n, {kept}, {filled} FROM run JOIN q ON q.client_id = run.client_id AND q.n = run.n + 1))"""


@query("stm01_token_bucket", f"{_REC}, {_limit_sql(_ONE)} SELECT request_id, client_id, denied_by FROM run")
def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    return L.rate_limited(_requests(spark, d), _ONE)


@query("stm02_rate_limiter", f"{_REC}, {_limit_sql(_FOUR)} SELECT request_id, client_id, denied_by FROM run")
def rate_limiter(spark: SparkSession, d: str) -> DataFrame:
    return L.rate_limited(_requests(spark, d), _FOUR)


def _cache_sql(calls: str, seconds: int, name: str = "kept") -> str:
    """A cache as a recursion over the calls (event_id, key, us, stores) of each key."""
    fresh = f"coalesce(o.us - stored < {seconds}000000, false)"
    return f"""o{name} AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us, event_id) AS n FROM ({calls})),
{name} AS (SELECT event_id, key, n, false AS hit, CASE WHEN stores THEN us END AS stored FROM o{name} WHERE n = 1
UNION ALL SELECT o.event_id, o.key, o.n, {fresh}, CASE WHEN o.stores AND NOT {fresh} THEN o.us ELSE stored END FROM {name} k JOIN o{name} o ON o.key = k.key AND o.n = k.n + 1)"""


@query("stm03_result_cache", f"{_REC}, {_cache_sql('SELECT event_id, client_id || chr(58) || event_type AS key, epoch_us(ts) AS us, true AS stores FROM telemetry', 36 * 3600)} SELECT event_id, hit FROM kept")
def result_cache(spark: SparkSession, d: str) -> DataFrame:
    return L.cache_hits(T.telemetry(spark, d), F.concat_ws(":", F.col("client_id").cast("string"), "event_type"), 36 * 3600)


@query(
    "stm04_prefix_cache",
    """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n, coalesce(role, chr(3)) || chr(1) || coalesce(text, chr(3)) AS s FROM conversations),
p AS (SELECT conv_id, k, n, string_agg(s, chr(2)) OVER (PARTITION BY conv_id ORDER BY k) AS pre FROM t), e AS (SELECT pre, min(conv_id) AS since FROM p WHERE k = n - 1 GROUP BY 1)
SELECT conv_id, coalesce(max(k) FILTER (since < conv_id), 0) AS prefix FROM p LEFT JOIN e USING (pre) GROUP BY 1""",
)
def prefix_cache(spark: SparkSession, d: str) -> DataFrame:
    """What each conversation finds in a cache that every earlier one has filled with all its messages but the last."""
    c = T.conversations(spark, d)
    return L.longest_prefix(c, c.withColumn("messages", F.slice("messages", F.lit(1), F.size("messages") - 1)))


@query("stm05_tool_cache", f"{_REC}, {_cache_sql('SELECT event_id, event_type || details AS key, epoch_us(ts) AS us, duration_ms < 60 AS stores FROM telemetry WHERE event_type NOT IN (chr(45), $$error$$)', 5 * 3600)} SELECT event_id, hit FROM kept UNION ALL SELECT event_id, false FROM telemetry WHERE event_type = 'error'")
def tool_cache(spark: SparkSession, d: str) -> DataFrame:
    calls = T.telemetry(spark, d).select("event_id", "ts", F.col("event_type").alias("tool"), F.col("details").alias("arguments"), (F.col("duration_ms") < 60).alias("ok"))
    return L.tool_cache(calls, 5 * 3600, ("error",))


def _lru_sql(calls: str, seconds: int, capacity: int) -> str:
    """A cache of so many entries as a recursion over all calls (event_id, key, us, stores) in order; its state is a list, the entry used last first."""
    return f"""c AS (SELECT *, row_number() OVER (ORDER BY us, event_id) AS n FROM ({calls})),
kept AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS event_id, false AS hit, []::STRUCT(k VARCHAR, s BIGINT)[] AS st
UNION ALL SELECT n, event_id, fresh, CASE WHEN stores OR fresh THEN ([{{'k': key, 's': CASE WHEN fresh THEN old ELSE us END}}] || list_filter(st, lambda x: x.k <> key))[1:{capacity}] ELSE st END
FROM (SELECT *, coalesce(us - old < {seconds}000000, false) AS fresh FROM (SELECT c.*, st, list_filter(st, lambda x: x.k = c.key)[1].s AS old FROM kept JOIN c ON c.n = kept.n + 1)))"""


@query("stm03_bounded_cache", f"{_REC}, {_lru_sql('SELECT event_id, client_id % 40 || chr(58) || event_type AS key, epoch_us(ts) AS us, true AS stores FROM telemetry', 3 * 86400, 60)} SELECT event_id, hit FROM kept WHERE n > 0")
def bounded_cache(spark: SparkSession, d: str) -> DataFrame:
    """One cache of 60 results for all clients."""
    key = F.concat_ws(":", (F.col("client_id") % 40).cast("string"), "event_type")
    return L.cache_hits(T.telemetry(spark, d), key, 3 * 86400, capacity=60)


@query("stm05_bounded_tool_cache", f"{_REC}, {_lru_sql('SELECT event_id, event_type || details AS key, epoch_us(ts) AS us, duration_ms < 60 AS stores FROM telemetry WHERE event_type <> $$error$$', 2 * 86400, 40)} SELECT event_id, hit FROM kept WHERE n > 0 UNION ALL SELECT event_id, false FROM telemetry WHERE event_type = 'error'")
def bounded_tool_cache(spark: SparkSession, d: str) -> DataFrame:
    """Answers that went badly are not stored, but a call that hits keeps its entry young."""
    calls = T.telemetry(spark, d).select("event_id", "ts", F.col("event_type").alias("tool"), F.col("details").alias("arguments"), (F.col("duration_ms") < 60).alias("ok"))
    return L.tool_cache(calls, 2 * 86400, ("error",), 40)


_PREFIX_BUDGET = 1500
_PREFIX_SQL = f"""WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, coalesce(role, chr(3)) || chr(1) || coalesce(text, chr(3)) AS s, length(coalesce(text, '')) // 4 AS w FROM conversations),
h AS (SELECT DISTINCT conv_id, 0 AS k, 'system' || chr(1) || 'topic ' || conv_id % 7 AS s, 1 AS w FROM t UNION ALL SELECT * FROM t),
p AS (SELECT conv_id, k + 1 AS k, string_agg(s, chr(2)) OVER (PARTITION BY conv_id ORDER BY k) AS pre, sum(w) OVER (PARTITION BY conv_id ORDER BY k) AS w FROM h),
q AS (SELECT k * 1000000 + conv_id AS id, row_number() OVER (ORDER BY k, conv_id) AS i, list_reverse(list({{'k': k, 'p': pre}}) OVER (PARTITION BY conv_id ORDER BY k)) AS ps, pre AS own, w::BIGINT AS ow FROM p),
run AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS id, 0::BIGINT AS prefix, []::STRUCT(p VARCHAR, w BIGINT)[] AS st
UNION ALL SELECT i, id, coalesce(f.k, 0), list_filter(st3, lambda x, j: list_sum(list_transform(st3[1:j], lambda y: y.w)) <= {_PREFIX_BUDGET})
FROM (SELECT *, [{{'p': own, 'w': ow}}] || list_filter(st2, lambda x: x.p <> own) AS st3 FROM (SELECT *, CASE WHEN f IS NULL THEN st ELSE list_filter(st, lambda x: x.p = f.p) || list_filter(st, lambda x: x.p <> f.p) END AS st2
FROM (SELECT q.*, st, list_filter(q.ps, lambda x: list_contains(list_transform(st, lambda y: y.p), x.p))[1] AS f FROM run JOIN q ON q.i = run.i + 1))))"""


@query("stm04_prefix_budget", f"{_PREFIX_SQL} SELECT id AS conv_id, prefix FROM run WHERE i > 0")
def prefix_budget(spark: SparkSession, d: str) -> DataFrame:
    """Conversations take turns, after one of seven system messages; each turn asks with all messages so far and leaves them in a cache of 1500 tokens."""
    system = F.struct(F.lit("system").alias("role"), F.concat(F.lit("topic "), (F.col("conv_id") % 7).cast("string")).alias("content"))
    plain = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    c = T.conversations(spark, d).select("conv_id", F.concat(F.array(system), plain).alias("messages"))
    turns = c.select("*", F.explode(F.sequence(F.lit(1), F.size("messages"))).alias("k")).select((F.col("k").cast("long") * 1_000_000 + F.col("conv_id")).alias("conv_id"), F.slice("messages", F.lit(1), F.col("k")).alias("messages"))
    return L.longest_kept_prefix(turns, turns, _PREFIX_BUDGET)


_BREAKER_SQL = f"""{_REC}, q AS (SELECT event_id, client_id, severity = 'error' AS bad, epoch_us(ts) AS us, row_number() OVER (PARTITION BY client_id ORDER BY ts, event_id) AS n FROM telemetry),
run AS (SELECT event_id, client_id, n, false AS open, CASE WHEN bad THEN 1 ELSE 0 END AS f, CAST(NULL AS BIGINT) AS since FROM q WHERE n = 1
UNION ALL SELECT event_id, client_id, n, since IS NOT NULL, CASE WHEN bad THEN f + 1 ELSE 0 END, CASE WHEN bad AND f + 1 >= 2 AND since IS NULL THEN us WHEN NOT bad THEN NULL ELSE since END
FROM (SELECT q.event_id, q.client_id, q.n, q.bad, q.us, CASE WHEN q.us - since >= {7 * 86400}000000 THEN 0 ELSE f END AS f, CASE WHEN q.us - since >= {7 * 86400}000000 THEN NULL ELSE since END AS since FROM run JOIN q ON q.client_id = run.client_id AND q.n = run.n + 1))"""


@query("stm06_circuit_breaker", f"{_BREAKER_SQL} SELECT event_id, open FROM run")
def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    return L.breaker_states(T.telemetry(spark, d), 2, 7 * 86400)


_KINDS = ("click", "view", "purchase")


def _gateway_requests(spark: SparkSession, d: str) -> DataFrame:
    k, value = F.col("request_id"), F.col("duration_ms")
    outcome = F.when(value > 95, "timeout").when(value < 5, "broken").otherwise("ok")
    return _requests(spark, d).select("request_id", "client_id", "ts", F.col("event_type").alias("kind"), F.concat_ws(":", "event_type", (k % 40).cast("string")).alias("payload"), (k % 110).alias("tokens"), (k % 9).alias("variations"), outcome.alias("outcome"))


_GATEWAY_SQL = f"""{_REC}, {_limit_sql(_FOUR)}, g AS (SELECT event_id, denied_by, epoch_us(ts) AS us, event_type || ':' || event_id % 40 AS key, CASE WHEN event_id % 110 > 100 THEN 'tokens' WHEN event_id % 9 > 7 THEN 'variations' WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'unknown kind' END AS wrong,
CASE WHEN duration_ms > 95 THEN 'timeout' WHEN duration_ms < 5 THEN 'broken' ELSE 'ok' END AS outcome FROM telemetry JOIN run ON event_id = request_id),
{_cache_sql("SELECT event_id, key, us, wrong IS NULL AND outcome = 'ok' AS stores FROM g WHERE denied_by IS NULL", 36 * 3600)}
SELECT g.event_id AS request_id, CASE WHEN denied_by IS NOT NULL THEN 'rate_limited' WHEN hit THEN 'cached' WHEN wrong IS NOT NULL THEN 'failed' WHEN outcome = 'ok' THEN 'completed' WHEN outcome = 'timeout' THEN 'timeout' ELSE 'failed' END AS status,
CASE WHEN denied_by IS NOT NULL THEN denied_by WHEN hit THEN 'cache' ELSE coalesce(wrong, outcome) END AS by FROM g LEFT JOIN kept USING (event_id)"""


@query("stm11_gateway", _GATEWAY_SQL)
def gateway(spark: SparkSession, d: str) -> DataFrame:
    return L.gateway(_gateway_requests(spark, d), _FOUR, 36 * 3600, 100, 7, _KINDS)


@query("stm10_retry", "WITH a AS (SELECT event_id, k, (event_id + k) % 5 AS e, (event_id * 3 + ((event_id + k) % 5) * k) % 4 = 0 AS ok FROM events, range(3) r(k)), f AS (SELECT event_id, coalesce(min(k) FILTER (ok), 2) AS last, bool_or(ok) AS ok FROM a GROUP BY 1) SELECT event_id AS request_id, last + 1 AS attempts, (event_id + last) % 5 AS endpoint, ok, CASE last WHEN 0 THEN 0e0 WHEN 1 THEN 0.5e0 ELSE 1.5e0 END AS waited FROM f")
def retry(spark: SparkSession, d: str) -> DataFrame:
    r = T.table(spark, d, "events").select(F.col("event_id").alias("request_id"), F.col("event_id").alias("start"))
    return L.retried(r, lambda attempt, endpoint: (F.col("start") * 3 + endpoint * attempt) % 4 == 0, 5, base=0.5)


@query("stm07_priority_queue", f"{TEL} SELECT event_id, row_number() OVER (PARTITION BY client_id ORDER BY event_id % 4 DESC, ts, event_id) AS place FROM telemetry")
def priority_queue(spark: SparkSession, d: str) -> DataFrame:
    q = T.telemetry(spark, d).select("event_id", F.col("client_id").alias("queue"), (F.col("event_id") % 4).alias("priority"), F.struct("ts", "event_id").alias("seq"))
    return L.drain_order(q).select("event_id", "place")


_QUEUE_SQL = f"""{_REC}, q AS (SELECT event_id, client_id % 20 AS queue, event_id % 5 AS p, row_number() OVER (PARTITION BY client_id % 20 ORDER BY ts, event_id) AS n FROM telemetry),
run AS (SELECT queue, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::BIGINT AS p, false AS refused, NULL::BIGINT AS taken, []::STRUCT(p BIGINT, n BIGINT, id BIGINT)[] AS st FROM (SELECT DISTINCT queue FROM q)
UNION ALL SELECT queue, n, event_id, p, p < 4 AND held >= 3, CASE WHEN p = 4 THEN best.id END,
  CASE WHEN p = 4 THEN list_filter(st, lambda x: x.id <> coalesce(best.id, -1)) WHEN held >= 3 THEN st ELSE st || [{{'p': -p, 'n': n, 'id': event_id}}] END
FROM (SELECT q.queue, q.n, q.event_id, q.p, st, len(list_filter(st, lambda x: x.p = -q.p)) AS held, list_sort(st)[1] AS best FROM run JOIN q ON q.queue = run.queue AND q.n = run.n + 1)),
t AS (SELECT taken, row_number() OVER (PARTITION BY queue ORDER BY n) AS place FROM run WHERE taken IS NOT NULL)"""


@query("stm07_bounded_queue", f"{_QUEUE_SQL} SELECT event_id, CASE WHEN refused THEN 'refused' WHEN place IS NULL THEN 'waiting' ELSE 'taken' END AS status, place FROM run LEFT JOIN t ON run.event_id = t.taken WHERE p < 4")
def bounded_queue(spark: SparkSession, d: str) -> DataFrame:
    """Twenty queues of four levels with three places each; every fifth event takes a request."""
    k = F.col("event_id")
    q = T.telemetry(spark, d).select("event_id", (F.col("client_id") % 20).alias("queue"), "ts", F.when(k % 5 < 4, k % 5).alias("priority"))
    return L.bounded_queue(q, 3)


_POOL_SQL = f"""{_REC}, r AS (SELECT event_id AS id, event_id % 3 AS pool, epoch_us(ts) AS us, epoch_us(ts) + CAST(floor(duration_ms) AS BIGINT) * 600000000 AS until FROM telemetry),
e AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY t, id) AS n FROM (SELECT id, pool, us * 2 + 1 AS t, true AS starts FROM r UNION ALL SELECT id, pool, until * 2, false FROM r)),
run AS (SELECT pool, 0::BIGINT AS n, NULL::BIGINT AS id, false AS starts, NULL::BIGINT AS endpoint, []::STRUCT(id BIGINT, k BIGINT)[] AS st FROM (SELECT DISTINCT pool FROM r)
UNION ALL SELECT pool, n, id, starts, CASE WHEN starts THEN k END, CASE WHEN starts THEN st || [{{'id': id, 'k': k}}] ELSE list_filter(st, lambda x: x.id <> id) END
FROM (SELECT e.pool, e.n, e.id, e.starts, st, list_sort(list_transform(range(4), lambda k: {{'n': len(list_filter(st, lambda x: x.k = k)), 'k': k}}))[1].k AS k FROM run JOIN e ON e.pool = run.pool AND e.n = run.n + 1))"""


@query("stm08_least_connections", f"{_POOL_SQL} SELECT id AS request_id, endpoint FROM run WHERE starts")
def least_connections(spark: SparkSession, d: str) -> DataFrame:
    """Three pools of four endpoints; a request lasts ten minutes for each of its milliseconds."""
    ends = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.floor("duration_ms") * 600_000_000)
    r = T.telemetry(spark, d).select(F.col("event_id").alias("request_id"), (F.col("event_id") % 3).alias("pool"), F.col("ts").cast("timestamp").alias("ts"), ends.alias("until"))
    return L.least_connections(r, 4)


_WEIGHTS = {"large": 5.0, "middle": 3.0, "small": 1.5, "spare": 0.5}
_WEIGHTED_SQL = "SELECT event_id, arg_min(name, -ln((('0x' || md5(event_id || '|' || name)[1:13])::BIGINT + 0.5) / 4503599627370496.0) / w) AS {} FROM events, (VALUES {}) v(name, w) GROUP BY 1"


def _weighted_sql(name: str, weights: dict[str, float]) -> str:
    return _WEIGHTED_SQL.format(name, ", ".join(f"('{k}', {w}::DOUBLE)" for k, w in weights.items()))


@query("stm08_weighted", f"SELECT event_id, endpoint, without, random FROM ({_weighted_sql('endpoint', _WEIGHTS)}) JOIN ({_weighted_sql('without', {k: w for k, w in _WEIGHTS.items() if k != 'middle'})}) USING (event_id) JOIN ({_weighted_sql('random', dict.fromkeys(_WEIGHTS, 1.0))}) USING (event_id)")
def weighted(spark: SparkSession, d: str) -> DataFrame:
    """Where requests go by weights, where without one of the endpoints, and where by equal weights."""
    key = F.col("event_id").cast("string")
    rest = {k: w for k, w in _WEIGHTS.items() if k != "middle"}
    return T.table(spark, d, "events").select("event_id", L.weighted(key, _WEIGHTS).alias("endpoint"), L.weighted(key, rest).alias("without"), L.weighted(key, dict.fromkeys(_WEIGHTS, 1.0)).alias("random"))


@query(
    "stm09_connection_gauge",
    f"""{_REC}, q AS (SELECT event_id, client_id, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE -1 END AS step, row_number() OVER (PARTITION BY client_id ORDER BY ts, event_id) AS n FROM telemetry),
run AS (SELECT event_id, client_id, n, greatest(0, step) AS gauge FROM q WHERE n = 1 UNION ALL SELECT q.event_id, q.client_id, q.n, greatest(0, gauge + step) FROM run JOIN q ON q.client_id = run.client_id AND q.n = run.n + 1) SELECT event_id, gauge::BIGINT AS gauge FROM run""",
)
def gauge(spark: SparkSession, d: str) -> DataFrame:
    """Connections that open with a click or a view and close with anything else; there are never fewer than none."""
    step = F.when(F.col("event_type").isin("click", "view"), 1).otherwise(-1)
    return L.gauge(T.telemetry(spark, d).withColumn("step", step), "step", ["ts", "event_id"], "client_id").select("event_id", "gauge")


@query("stm08_hash_routing", "WITH h AS (SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS m FROM events) SELECT event_id, CAST(((CAST('0x' || substr(m, 1, 16) AS UHUGEINT) % 7) * 2 + CAST('0x' || substr(m, 17, 16) AS UHUGEINT) % 7) % 7 AS BIGINT) AS endpoint FROM h")
def hash_routing(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "events").select("event_id", L.by_hash(F.col("event_id").cast("string"), 7).alias("endpoint"))


@query("stm08_round_robin", f"{TEL} SELECT event_id, (row_number() OVER (PARTITION BY client_id ORDER BY ts, event_id) - 1) % 3 AS endpoint FROM telemetry")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    return T.telemetry(spark, d).select("event_id", L.round_robin([F.col("ts"), F.col("event_id")], 3, "client_id").alias("endpoint"))


@query("flt11_preferred_endpoints", "WITH c AS (SELECT n_nationkey AS request_id, s_suppkey AS endpoint, s_acctbal > 0 AS healthy, s_acctbal > 5000 AS fast, s_suppkey % 2 = 0 AS tier FROM nation JOIN supplier ON n_nationkey = s_nationkey), a AS (SELECT *, bool_or(fast) OVER (PARTITION BY request_id) AS f FROM c WHERE healthy), b AS (SELECT *, bool_or(tier) OVER (PARTITION BY request_id) AS t FROM a WHERE fast OR NOT f) SELECT request_id, endpoint FROM b WHERE tier OR NOT t")
def preferred(spark: SparkSession, d: str) -> DataFrame:
    s = T.table(spark, d, "supplier").select(F.col("s_nationkey").alias("request_id"), F.col("s_suppkey").alias("endpoint"), (F.col("s_acctbal") > 0).alias("healthy"), (F.col("s_acctbal") > 5000).alias("fast"), (F.col("s_suppkey") % 2 == 0).alias("tier"))
    return L.preferred(s.filter("healthy"), "fast", "tier").select("request_id", "endpoint")


@query("stm13_oversampling", "WITH k AS (SELECT event_id, user_id, value FROM events WHERE event_type <> 'error' ORDER BY ts, event_id LIMIT 64) SELECT event_id, user_id FROM k")
def oversampling(spark: SparkSession, d: str) -> DataFrame:
    """The first 64 arrivals that the filter keeps, put back in the order of ids."""
    kept = T.table(spark, d, "events").filter("event_type <> 'error'").orderBy("ts", "event_id").limit(64)
    return kept.select("event_id", "user_id").orderBy("event_id")
