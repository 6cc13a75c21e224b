"""Compiled JSON schemas against a walk over parsed values, and objects inside of texts."""

import json
import random

from pyspark.sql import functions as F

from laurel.operators import schemas as J

KINDS = {"object": dict, "array": list, "string": str, "number": (int, float), "integer": int, "boolean": bool, "null": type(None)}


def walk(value, schema, at="$"):
    kind = schema.get("type")
    if kind and not isinstance(value, KINDS[kind]):
        return [f"{at}: not {kind}"]
    if not isinstance(value, dict):
        return []
    out = [f"{at}: {k} is missing" for k in schema.get("required", []) if k not in value]
    for k, sub in schema.get("properties", {}).items():
        if k in value:
            out += walk(value[k], sub, f"{at}.{k}")
    return out


def test_violations(spark):
    rng = random.Random(6)
    keys = ["a", "b c", "d.e", "it's", "é"]

    def schema(depth):
        s = {"type": rng.choice(["object"] * 4 + list(KINDS))} if rng.random() < 0.9 else {}
        if depth and s.get("type", "object") == "object":
            s |= {"required": rng.sample(keys, rng.randint(0, 2)), "properties": {k: schema(depth - 1) for k in rng.sample(keys, rng.randint(0, 3))}}
        return s

    def value(depth):
        if depth and rng.random() < 0.7:
            return {k: value(depth - 1) for k in rng.sample(keys, rng.randint(0, 5))}
        return rng.choice([None, True, 3, -2.5, 10**19, "x", "", [], [1, {}], {}])

    values = [value(3) for _ in range(150)]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, j string").cache()
    seen = set()
    for s in [{}, *(schema(2) for _ in range(7))]:
        got = {r["i"]: r["v"] for r in rows.select("i", J.violations(F.col("j"), s).alias("v")).collect()}
        assert got == {i: walk(v, s) for i, v in enumerate(values)}
        seen |= {len(v) for v in got.values()}
    assert len(seen) > 2
    odd = spark.createDataFrame([("{",), ("",), (None,), ("NaN",), ('{"a": 1, "a": 2}',), ("[1]",), ("1]",), ("1, 2",), ("[1] x",), ('{"a": 1}}',), ('[1], "x": 2',)], "j string")
    assert [r[0] for r in odd.select(J.violations(F.col("j"), {"type": "array"})).collect()] == [["not JSON"], ["not JSON"], None, ["not JSON"], ["not JSON"], [], *[["not JSON"]] * 5]


def test_inline_objects(spark):
    cases = {
        "none": [],
        "a {b} c {d {e {f}} g}": ["{b}", "{d {e {f}} g}"],
        'x {"a": "}{", "b": "\\"}"} y': ['{"a": "}{", "b": "\\"}"}'],
        "} { open {closed} {too}": ["{closed}", "{too}"],
        '5" wide {"k": 1}': ['{"k": 1}'],
        '{"never: {closed}': [],
        "é🙂{é🙂}": ["{é🙂}"],
        "": [],
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r["t"]: r["o"] for r in rows.select("t", J.inline_objects(F.col("t")).alias("o")).collect()} == cases


def test_verdicts(spark):
    fence = "```"
    rows = [
        ("good", "assistant", f"{fence}json\n{{\"a\": 1}}\n{fence}"),
        ("plain", "assistant", f"{fence}\n  [1] \n{fence} and {{x}}"),
        ("bad", "assistant", f"{fence}json\n{{\"a\": 1}}\n{fence}\n{fence}json\n{{a}}\n{fence}"),
        ("inline", "assistant", 'see {"a": "x"}'),
        ("user", "user", f"{fence}json\n{{\n{fence}"),
        ("null", "assistant", None),
    ]
    m = spark.createDataFrame([(t, 0, r, c) for t, r, c in rows], "traj_id string, message_index int, role string, content string")
    status = lambda **k: {r["traj_id"]: (r["status"], r["modifier"]) for r in J.schema_verdicts(m, {"properties": {"a": {"type": "integer"}}}, **k).collect()}
    want = {"good": ("passed", 1.0), "plain": ("passed", 1.0), "bad": ("failed", 0.0), "inline": ("skipped", 1.0), "user": ("skipped", 1.0), "null": ("skipped", 1.0)}
    assert status() == want and status(inline=True) == want | {"inline": ("failed", 0.0)}
