"""Access policies: which requests a set of permits and forbids allows, with conditions on the requests' contexts.

A policy is a row (id, effect, principal, action, resource, conditions): each part is a name, `*`, or `X::*` for all names that begin with `X::`; conditions
are an array of (attribute, operator, value), a value being JSON text. A request is a row (request_id, principal, action, resource, context): context maps
attributes to JSON texts. Ids of policies are unique. Conditions hold all together, which is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import written

PARTS = ["principal", "action", "resource"]
POLICY = "id string, effect string, principal string, action string, resource string, conditions array<struct<attribute:string,operator:string,value:string>>"
# Names of arguments that may hold a host.
HOST_ARGUMENTS = ("url", "host", "endpoint", "target", "address")


def typed(json: Column) -> Column:
    """struct(said, text, number, items) of a JSON text: all of it, and what it is if it is a string, a number or a list; what is missing or no JSON is null."""
    v = X.json_value(json)
    kind = F.schema_of_variant(v)
    return F.struct(
        F.coalesce(F.to_json(v), F.lit("null")).alias("said"),
        F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).alias("text"),
        F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double")).alias("number"),
        F.transform(F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")), lambda x: F.to_json(x)).alias("items"),
    )


def holds(a: Column, operator: Column, b: Column) -> Column:
    """Whether a `typed` attribute stands to a `typed` value as an operator says; different types are unequal, and neither is less."""
    equal = F.coalesce(a["number"] == b["number"], a["said"] == b["said"])
    less = lambda x, y: F.coalesce(x["number"] < y["number"], x["text"] < y["text"])
    met = (
        F.when(operator == "==", equal)
        .when(operator == "!=", ~equal)
        .when(operator == "in", F.coalesce(F.exists(b["items"], lambda x: x == a["said"]), F.contains(b["text"], a["text"])))
        .when(operator == "contains", F.coalesce(F.contains(a["text"], b["text"]), F.exists(a["items"], lambda x: x == b["said"])))
        .when(operator == "matches", F.regexp_like(a["text"], F.concat(F.lit("^(?:"), b["text"], F.lit(")"))))
        .when(operator == "<", less(a, b))
        .when(operator == ">", less(b, a))
    )
    return F.coalesce(met, F.lit(False))


def _covers(name: str) -> Column:
    """All that a policy may say to cover a request's part: the part itself, `*`, and `X::*` for each prefix `X::` of it."""
    parts = F.split(name, "::")
    prefixes = F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: k > 0), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "::"), F.lit("::*")))
    return F.explode(F.array_distinct(F.concat(F.array(F.col(name), F.lit("*")), prefixes)))


def policy_text() -> Column:
    """A policy's row in the policy language: its parts, and its conditions joined by `&&`."""
    # Words and layout of the language.
    condition = lambda c: F.when(c["operator"].isin("contains", "matches"), F.concat(c["attribute"], F.lit("."), c["operator"], F.lit('("'), F.coalesce(F.try_variant_get(F.try_parse_json(c["value"]), "$", "string"), c["value"]), F.lit('")'))).otherwise(F.concat_ws(" ", c["attribute"], c["operator"], c["value"]))
    when = F.array_join(F.transform("conditions", lambda c: F.concat(F.lit("  "), condition(c))), " &&\n")
    head = F.concat(F.col("effect"), F.lit(" (\n"), F.array_join(F.array(*(F.concat(F.lit(f"  {p} "), F.col(p)) for p in PARTS)), ",\n"), F.lit("\n)\n"))
    return F.concat(head, F.when(F.size("conditions") > 0, F.concat(F.lit("when {\n"), when, F.lit("\n};"))).otherwise(";"))


def applicable(parts: DataFrame, policies: DataFrame) -> DataFrame:
    """(principal, action, resource, said): the policies (id, effect, conditions with typed values) that cover distinct parts of requests, conditions aside."""
    sought = parts
    for c in PARTS:
        sought = sought.select("*", _covers(c).alias(f"{c}_said"))
    conditions = F.col("conditions") if "conditions" in policies.columns else F.lit(None).cast("array<struct<attribute:string,operator:string,value:string>>")
    # values are typed below the joins, once each
    each = F.transform(F.coalesce(conditions, F.array()), lambda c: F.struct(c["attribute"].alias("attribute"), c["operator"].alias("operator"), typed(c["value"]).alias("value")))
    said = policies.select("id", "effect", *(F.col(c).alias(f"{c}_said") for c in PARTS), each.alias("conditions"))
    return sought.join(said, [f"{c}_said" for c in PARTS]).groupBy(*PARTS).agg(F.collect_list(F.struct("id", "effect", "conditions")).alias("said"))


def decisions(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """request_id, allowed, and the ids of matching permits and forbids: forbid beats permit, and nothing is allowed by default.

    Policies are found once for each distinct principal, action and resource, by equal joins of what may cover them, however many there are; each request meets
    what its parts have found, counts the conditions that hold in its context, and keeps its place: contexts are neither taken apart nor grouped. A null part is
    covered by no policy; `context` and `conditions` may be missing.
    """
    context = F.map_entries("context") if "context" in requests.columns else F.lit(None).cast("array<struct<key:string,value:string>>")
    found = F.map_from_entries(F.transform(F.coalesce(context, F.array()), lambda x: F.struct(x["key"], typed(x["value"]))))
    rows = requests.select("request_id", *PARTS, found.alias("context"))
    none = typed(F.lit(None).cast("string"))
    # written, so that its size is known: few parts are broadcast, and requests are not shuffled
    met = rows.join(written(applicable(requests.select(*PARTS).distinct(), policies)), PARTS, "left")
    # looked up once for each condition
    pairs = lambda p: F.transform(p["conditions"], lambda c: F.struct(F.coalesce(F.try_element_at("context", c["attribute"]), none).alias("found"), c.alias("asked")))
    holding = lambda p: F.size(F.filter(pairs(p), lambda x: holds(x["found"], x["asked"]["operator"], x["asked"]["value"])))
    met = met.select("request_id", F.filter(F.coalesce("said", F.array()), lambda p: holding(p) == F.size(p["conditions"])).alias("met"))
    ids = lambda effect: F.array_sort(F.transform(F.filter("met", lambda p: p["effect"] == effect), lambda p: p["id"])).alias(f"{effect}s")
    out = met.select("request_id", ids("permit"), ids("forbid"))
    return out.select("request_id", ((F.size("permits") > 0) & (F.size("forbids") == 0)).alias("allowed"), "permits", "forbids")


def host_policies(spark: SparkSession, blocked: tuple[str, ...] = (), allowed: tuple[str, ...] = ()) -> DataFrame:
    """A forbid for each blocked host and a permit for each allowed one, for all agents and actions."""
    rows = [(f"{verb}-{h}", effect, "Agent::*", "Action::*", f'Host::"{h}"', []) for verb, effect, hosts in (("block", "forbid", blocked), ("allow", "permit", allowed)) for h in hosts]
    return spark.createDataFrame(rows, POLICY)


def _entity(kind: str, name: Column) -> Column:
    return F.concat(F.lit(f'{kind}::"'), name, F.lit('"'))


def network_requests(messages: DataFrame, agent: Column | str = "default-agent") -> DataFrame:
    """Requests (traj_id, message_index, principal, action, resource, context) that messages (traj_id, message_index, role, content, tool_calls) make.

    Every URL of any message asks to connect to its host. Of an assistant's tool calls (an array of (name, arguments)), arguments that are JSON objects ask,
    in the tool's name, for the hosts that are strings under one of the known names.
    """
    who = _entity("Agent", F.lit(agent) if isinstance(agent, str) else agent)
    listed = lambda c: F.to_json(F.array(c))
    quoted = lambda c: F.substr(listed(c), F.lit(2), F.length(listed(c)) - 2)  # noqa: E731  a string as JSON
    base = messages.select("traj_id", "message_index", who.alias("principal"), "role", "content", *(["tool_calls"] if "tool_calls" in messages.columns else []))
    keep = ["traj_id", "message_index", "principal"]

    urls = base.select(*keep, "role", F.explode(X.urls("content")).alias("url")).withColumn("host", X.host("url"))
    context = F.create_map(F.lit("url"), quoted(F.col("url")), F.lit("role"), quoted(F.coalesce("role", F.lit(""))))
    out = urls.filter("host IS NOT NULL").select(*keep, F.lit('Action::"connect"').alias("action"), _entity("Host", F.col("host")).alias("resource"), context.alias("context"))
    if "tool_calls" not in base.columns:
        return out
    calls = base.filter("role = 'assistant'").select(*keep, F.explode("tool_calls").alias("c")).select(*keep, F.coalesce("c.name", F.lit("")).alias("tool"), X.json_value("c.arguments").alias("v"))
    given = lambda k: F.when(F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant")) == "STRING", F.try_variant_get("v", f"$.{k}", "string"))
    targets = F.explode(F.array(*(F.struct(F.lit(k).alias("argument"), X.host(given(k)).alias("host")) for k in HOST_ARGUMENTS)))
    asked = calls.select(*keep, "tool", targets.alias("t")).select(*keep, "tool", "t.*").filter("host IS NOT NULL")
    context = F.create_map(F.lit("tool"), quoted(F.col("tool")), F.lit("argument"), quoted(F.col("argument")))
    return out.unionByName(asked.select(*keep, _entity("Action", F.col("tool")).alias("action"), _entity("Host", F.col("host")).alias("resource"), context.alias("context")))


def network_verdicts(messages: DataFrame, policies: DataFrame, agent: Column | str = "default-agent") -> DataFrame:
    """Verdict rows of the network policy: a trajectory fails with the first of its requests that is not allowed."""
    asked = network_requests(messages, agent)
    key = F.to_json(F.struct(*PARTS, F.array_sort(F.map_entries("context")).alias("context")))
    asked = asked.withColumn("request_id", F.sha2(key, 256))
    decided = decisions(asked.dropDuplicates(["request_id"]), policies).select("request_id", "allowed")
    g = asked.join(decided, "request_id").groupBy("traj_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("allowed")).alias("bad"))
    g = messages.select("traj_id").distinct().join(g, "traj_id", "left").na.fill(0, ["n", "bad"])
    message = F.when(F.col("n") == 0, "no requests").when(F.col("bad") > 0, F.concat(F.col("bad").cast("string"), F.lit(" requests refused"))).otherwise(F.concat(F.col("n").cast("string"), F.lit(" requests allowed")))
    return g.select("traj_id", F.lit("network_policy").alias("plugin"), F.when(F.col("bad") > 0, "failed").otherwise("passed").alias("status"), message.alias("message"), F.when(F.col("bad") > 0, -1.0).otherwise(1.0).alias("modifier"))
