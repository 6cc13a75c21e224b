"""Conditional policies against one request and one policy at a time."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from laurel.operators import policies as P

VALUES = ["1", "2", "2.5", "-3", '"a"', '"ab"', '"b"', '"1"', '"["', "true", "null", '["a", "b"]', "[1, 2]", "[]", '{"k": 1}', "{broken"]


def parsed(j):
    try:
        return json.loads(j)
    except (TypeError, ValueError):
        return None


def is_number(x):
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def same(a, b):
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def brute(found, operator, value):
    a, b = parsed(found), parsed(value)
    text = isinstance(a, str) and isinstance(b, str)
    comparable = text or (is_number(a) and is_number(b))
    return {
        "==": lambda: same(a, b),
        "!=": lambda: not same(a, b),
        "in": lambda: any(same(a, x) for x in b) if isinstance(b, list) else text and a in b,
        "contains": lambda: any(same(b, x) for x in a) if isinstance(a, list) else text and b in a,
        "matches": lambda: text and b != "[" and bool(re.match(b, a)),
        "<": lambda: comparable and a < b,
        ">": lambda: comparable and a > b,
    }[operator]()


@pytest.mark.parametrize("operator", ["==", "!=", "in", "contains", "matches", "<", ">"])
def test_operators(spark, operator):
    cases = [(a, b) for a in [None, *VALUES] for b in VALUES if not (operator == "matches" and b == '"["')]
    rows = spark.createDataFrame(cases, "a string, b string")
    got = [r[0] for r in rows.select(P.holds(P.typed(F.col("a")), F.lit(operator), P.typed(F.col("b")))).collect()]
    assert got == [brute(a, operator, b) for a, b in cases]
    assert len(set(got)) == 2


def test_decisions_with_conditions(spark):
    rng = random.Random(5)
    names = ["p", "q", "r"]
    conditions = lambda: [(rng.choice(names), rng.choice(["==", "!=", "<", ">", "in", "contains"]), rng.choice(VALUES)) for _ in range(rng.choice([0, 0, 1, 2, 3]))]
    policies = [(f"p{i}", "forbid" if i % 6 == 5 else "permit", rng.choice(["*", "A::*", "A::1", "A::2"]), rng.choice(["*", "read", "write"]), rng.choice(["*", "H::x", "H::*", "H::x::*"]), conditions()) for i in range(30)]
    requests = [(i, rng.choice(["A::1", "A::2", "B", None]), rng.choice(["read", "write", ""]), rng.choice(["H::x", "H::y", "H::x::y"]), {n: rng.choice(VALUES) for n in names if rng.random() < 0.7} if rng.random() < 0.9 else None) for i in range(300)]

    def covers(said, part):
        return part is not None and (said in (part, "*") or (said.endswith("::*") and part.startswith(said[:-1])))

    want = {}
    for i, *parts, context in requests:
        met = [(e, n) for n, e, *said, cs in policies if all(map(covers, said, parts)) and all(brute((context or {}).get(a), o, v) for a, o, v in cs)]
        permits, forbids = (sorted(n for e, n in met if e == x) for x in ("permit", "forbid"))
        want[i] = (bool(permits) and not forbids, permits, forbids)
    r = spark.createDataFrame(requests, "request_id int, principal string, action string, resource string, context map<string,string>")
    p = spark.createDataFrame(policies, P.POLICY)
    got = {x["request_id"]: (x["allowed"], x["permits"], x["forbids"]) for x in P.decisions(r, p).collect()}
    assert got == want
    assert {w[0] for w in want.values()} == {True, False}
    assert all(x[1:] == (False, [], []) for x in map(tuple, P.decisions(r, p.limit(0)).collect()))
    assert P.decisions(r.limit(0), p).count() == 0


def test_contexts_are_not_shuffled(spark):
    """Few parts of many requests are met where the requests stand."""
    r = spark.range(5000).select(F.col("id").alias("request_id"), F.concat(F.lit("A::"), (F.col("id") % 3).cast("string")).alias("principal"), F.lit("read").alias("action"), F.lit("H::x").alias("resource"), F.create_map(F.lit("n"), F.col("id").cast("string")).alias("context"))
    p = spark.createDataFrame([("low", "permit", "A::*", "*", "H::*", [("n", "<", "100")]), ("one", "forbid", "A::1", "*", "*", [])], P.POLICY)
    got = P.decisions(r, p)
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.filter("allowed").count() == 67 and got.filter("size(forbids) = 1").count() == 1667


MESSAGES = "traj_id string, message_index int, role string, content string, tool_calls array<struct<name:string,arguments:string>>"


def test_requests_of_messages(spark):
    rows = [
        ("a", 0, "user", 'see https://x.example:8080/p?q="1" and http://y.example', None),
        ("a", 1, "assistant", None, [("get", '{"url": "http://z.example/a", "host": "h-1", "target": 5, "endpoint": "no host!", "other": "u.example"}'), ("bad", "{"), ("list", '["url"]'), (None, '{"address": "w.example"}')]),
        ("a", 2, "user", None, [("get", '{"url": "http://ignored.example"}')]),
        ("b", 0, "user", "nothing", None),
        ("c", 0, None, "http://10.0.0.1/x", None),
    ]
    m = spark.createDataFrame(rows, MESSAGES)
    got = sorted((r["traj_id"], r["message_index"], r["principal"], r["action"], r["resource"], tuple(sorted(r["context"].items()))) for r in P.network_requests(m, "bot").collect())
    me = 'Agent::"bot"'
    tool = lambda name, argument: (("argument", f'"{argument}"'), ("tool", f'"{name}"'))
    assert got == sorted([
        ("a", 0, me, 'Action::"connect"', 'Host::"x.example"', (("role", '"user"'), ("url", '"https://x.example:8080/p?q="'))),
        ("a", 0, me, 'Action::"connect"', 'Host::"y.example"', (("role", '"user"'), ("url", '"http://y.example"'))),
        ("a", 1, me, 'Action::"get"', 'Host::"z.example"', tool("get", "url")),
        ("a", 1, me, 'Action::"get"', 'Host::"h-1"', tool("get", "host")),
        ("a", 1, me, 'Action::""', 'Host::"w.example"', tool("", "address")),
        ("c", 0, me, 'Action::"connect"', 'Host::"10.0.0.1"', (("role", '""'), ("url", '"http://10.0.0.1/x"'))),
    ])
    verdicts = {r["traj_id"]: (r["status"], r["message"], r["modifier"]) for r in P.network_verdicts(m, P.host_policies(spark, ("10.0.0.1",), ("x.example", "y.example", "z.example", "h-1")), "bot").collect()}
    assert verdicts == {"a": ("failed", "1 requests refused", -1.0), "b": ("passed", "no requests", 1.0), "c": ("failed", "1 requests refused", -1.0)}
