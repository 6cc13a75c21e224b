"""Checks that need a parser: code and nested documents. Parsing runs in Arrow batches; rules over what was parsed are columns."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import FENCE


@F.pandas_udf(T.BooleanType())
def parses(code: pd.Series) -> pd.Series:
    """Whether Python code can be parsed; it is never run."""

    def ok(x):
        if x is None:
            return None
        try:
            ast.parse(x)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
        return True

    return code.map(ok)


def lint(texts: DataFrame, text: str = "text") -> DataFrame:
    """status by id: failed if a fenced block of Python does not parse, skipped without blocks."""
    blocks = texts.select("id", F.explode_outer(F.regexp_extract_all(F.col(text), F.lit(FENCE), F.lit(1))).alias("code"))
    g = blocks.groupBy("id").agg(F.bool_and(parses("code")).alias("ok"), F.count("code").alias("n"))
    return g.select("id", F.when(F.col("n") == 0, "skipped").when(F.col("ok"), "passed").otherwise("failed").alias("status"))


def markdown(value, depth: int = 1, mark: str = "#") -> str:
    """Nested JSON as headers and lines."""
    if isinstance(value, dict):
        out = []
        for k, v in value.items():
            title = str(k).replace("_", " ").title()
            out.append(f"{mark * depth} {title}\n{markdown(v, depth + 1, mark)}" if isinstance(v, (dict, list)) else f"{title}: {v}")
        return "\n".join(out)
    if isinstance(value, list):
        return "\n".join(markdown(v, depth, mark) if isinstance(v, (dict, list)) else f"- {v}" for v in value)
    return str(value)


@F.pandas_udf(T.StringType())
def to_markdown(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else markdown(json.loads(t)))


def certificate(ok_network: Column, audited: Column, exit_code: Column, as_of: Column) -> Column:
    """struct(status, expires): valid for a day if the network was allowed, the audit passed and the run ended with 0; no code at all is invalid."""
    valid = F.coalesce(ok_network & audited & (exit_code == 0), F.lit(False))
    return F.struct(F.when(valid, "valid").otherwise("invalid").alias("status"), F.when(valid, as_of + F.expr("INTERVAL 24 HOURS")).alias("expires"))
