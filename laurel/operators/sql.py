"""The SQL surface: custom rules as table functions over partitions, and scalar functions of the library as SQL functions.

A rule is a Python table function (`spark.udtf`): `SELECT * FROM my_rule(TABLE(configs) PARTITION BY traj_id)`. It sees the rows of one trajectory one after the other and
may keep what it needs of them until their end, so rules about a whole trajectory are as easy as rules about a row. Scalar functions are SQL text, which the optimizer
puts in place of the call: no Python runs for them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_FOUND = "traj_id bigint, rule string, path string, severity string"

#: (path, severity) of each violation, from one configuration (kind, type, name, config) or, at a trajectory's end, from what the rule has kept.
Check = Callable[[dict, dict], Iterable[tuple[str, str]]]


def register_rule(spark: SparkSession, name: str, check: Check, end: Callable[[dict], Iterable[tuple[str, str]]] | None = None):
    """Registers a table function of that name over (traj_id, kind, type, name, config): check(row, kept) for every row, end(kept) after the last of a partition.

    Rows of a partition go through one task as a stream; `kept` is a dict of the rule's own, new for each partition.
    """

    class Rule:
        def __init__(self):
            self.traj, self.kept = None, {}

        def eval(self, row):
            found = row.asDict()
            self.traj = found["traj_id"]
            for path, severity in check(found, self.kept):
                yield self.traj, name, path, severity

        def terminate(self):
            if end is not None and self.traj is not None:
                for path, severity in end(self.kept):
                    yield self.traj, name, path, severity

    made = F.udtf(Rule, returnType=_FOUND)
    spark.udtf.register(name, made)
    return made


#: Names, parameters, result and body of SQL functions.
FUNCTIONS = [
    ("url_host", "url STRING", "STRING", r"coalesce(nullif(regexp_extract(url, '^https?://([^/:]+)', 1), ''), CASE WHEN url RLIKE '^[\\w.-]+$' THEN url END)"),
    ("token_estimate", "text STRING", "BIGINT", "CAST(coalesce(char_length(text), 0) div 4 AS BIGINT)"),
    ("quality_tier", "confidence DOUBLE", "STRING", "CASE WHEN confidence > 0.7 THEN 'gold' WHEN confidence > 0.4 THEN 'silver' ELSE 'bronze' END"),
    ("content_hash", "text STRING", "STRING", "substr(sha2(coalesce(text, ''), 256), 1, 16)"),
]


def register_functions(spark: SparkSession, prefix: str = "laurel_") -> list[str]:
    """Creates the SQL functions for the session and returns their names."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {result} RETURN {body}")
    return [prefix + f[0] for f in FUNCTIONS]
