"""JSON schemas compiled to columns over variants, and the JSON that messages hold, fenced or inline.

A schema is a dict of type, required and properties, nested at will. It is compiled once, to one expression: a violation is a string with the path and
what is wrong there. Texts that are not JSON (a key given twice is not) have one violation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# The types of JSON schemas as patterns of variant types; a truth value passes for a number, as it does in Python, and 1.0 for an integer.
TYPES = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING$", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)", "integer": r"^(BIGINT|DECIMAL\(\d+,0\)|BOOLEAN)$", "boolean": "^BOOLEAN$", "null": "^VOID$"}
# Fences with or without the tag.
FENCED = r"(?s)```(?:json)?\s*\n(.*?)```"


def _compiled(v: Column, schema: dict, at: str) -> list[Column]:
    """A column for each thing that may be wrong with a variant, null if it is not."""
    kind, found = F.schema_of_variant(v), []
    if expected := schema.get("type"):
        found.append(F.when(~kind.rlike(TYPES[expected]), F.lit(f"{at}: not {expected}")))
    below = lambda k: F.try_variant_get(v, f"$['{k}']" if "'" not in k else f'$["{k}"]', "variant")  # noqa: E731  no key holds quotes of both kinds
    found += [F.when(kind.startswith("OBJECT") & below(k).isNull(), F.lit(f"{at}: {k} is missing")) for k in schema.get("required", [])]
    for k, sub in schema.get("properties", {}).items():
        found += _compiled(below(k), sub, f"{at}.{k}")
    return found


def violations(json: Column, schema: dict) -> Column:
    """All violations of a schema by JSON texts, in the schema's order; an empty array if there are none, null for a null text."""
    v = X.json_value(json)
    found = _compiled(v, schema, "$")
    wrong = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    return F.when(json.isNotNull(), F.when(v.isNull(), F.array(F.lit("not JSON"))).otherwise(wrong))


def inline_objects(text: Column) -> Column:
    """The outermost `{...}` of a text, by matching brackets; inside them, those in strings do not count. An object in one that is never closed is outermost."""
    tokens = F.regexp_extract_all(text, F.lit(r'(?s)\\.|["{}]|[^\\"{}]+|\\'), F.lit(0))
    span = "struct<a:int,b:int>"
    start = F.struct(F.lit(1).alias("at"), F.lit(False).alias("quoted"), F.array().cast("array<int>").alias("open"), F.array().cast(f"array<{span}>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        depth = F.size(s["open"])
        opens, closes = ~s["quoted"] & (t == "{"), ~s["quoted"] & (t == "}") & (depth > 0)
        a = F.try_element_at(s["open"], F.lit(-1))
        closed = F.array_append(F.filter(s["spans"], lambda x: x["a"] < a), F.struct(a.alias("a"), (s["at"] + 1).alias("b")))
        return F.struct(
            (s["at"] + F.length(t)).alias("at"),
            F.when((t == '"') & (depth > 0), ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"),
            F.when(opens, F.array_append(s["open"], s["at"])).when(closes, F.slice(s["open"], F.lit(1), F.greatest(depth - 1, F.lit(0)))).otherwise(s["open"]).alias("open"),
            F.when(closes, closed).otherwise(s["spans"]).alias("spans"),
        )

    spans = F.aggregate(tokens, start, step, lambda s: s["spans"])
    return F.transform(spans, lambda x: F.substr(text, x["a"], x["b"] - x["a"]))


def json_blocks(messages: DataFrame, inline: bool = False) -> DataFrame:
    """traj_id, message_index, block and json of an assistant's fenced blocks; with `inline`, of the objects in messages without any."""
    fenced = F.filter(F.transform(F.regexp_extract_all("content", F.lit(FENCED), F.lit(1)), lambda x: F.trim(x, F.lit(" \t\n\r\f\x0b"))), lambda x: x != "")
    rows = messages.filter("role = 'assistant' AND content IS NOT NULL").select("traj_id", "message_index", "content", fenced.alias("blocks"))
    if inline:
        rows = rows.withColumn("blocks", F.when(F.size("blocks") > 0, F.col("blocks")).otherwise(inline_objects(F.col("content"))))
    return rows.select("traj_id", "message_index", F.posexplode("blocks").alias("block", "json"))


def schema_verdicts(messages: DataFrame, schema: dict | None = None, inline: bool = False) -> DataFrame:
    """Verdict rows of the schema check: every block has to be JSON and to meet the schema; skipped without blocks."""
    wrong = F.size(violations(F.col("json"), schema or {})) > 0
    g = json_blocks(messages, inline).groupBy("traj_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("bad"))
    g = messages.select("traj_id").distinct().join(g, "traj_id", "left").na.fill(0, ["n", "bad"])
    status = F.when(F.col("n") == 0, "skipped").when(F.col("bad") > 0, "failed").otherwise("passed")
    said = F.when(F.col("n") == 0, "no JSON").when(F.col("bad") > 0, F.concat(F.col("bad").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" blocks"))).otherwise(F.concat(F.col("n").cast("string"), F.lit(" blocks")))
    return g.select("traj_id", F.lit("json_schema").alias("plugin"), status.alias("status"), said.alias("message"), F.when(F.col("bad") > 0, 0.0).otherwise(1.0).alias("modifier"))
