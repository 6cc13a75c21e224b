"""Tables of the stores, their schemas, and what is written to them; text and tool sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "struct<role:string,content:string,reasoning_content:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>,tool_call_id:string>"

#: Fixed formats: the stores' tables, and the column that each is partitioned by.
SCHEMAS = {
    "triplets": (f"id string, input_query string, chosen array<{MESSAGE}>, rejected array<{MESSAGE}>, confidence double, quality string, rationale string, failure_reasons array<string>, source string, status string, created_at timestamp_ntz, updated_at timestamp_ntz, metadata map<string,string>", "status"),
    "dataset_versions": ("version_id string, name string, description string, triplet_count bigint, created_at timestamp_ntz, created_by string, filters_applied string", None),
    "version_triplets": ("version_id string, triplet_id string", "version_id"),
    "gold_comparisons": (f"id string, input_query string, trajectory_a array<{MESSAGE}>, trajectory_b array<{MESSAGE}>, consensus_winner string, consensus_confidence double, created_at timestamp_ntz, updated_at timestamp_ntz", None),
    "sme_labels": ("id string, comparison_id string, sme_id string, ts timestamp_ntz, winner string, confidence double, rationales array<struct<category:string,description:string,severity:int>>, notes string", None),
    "events": ("event_id string, event_type string, ts timestamp_ntz, request_id string, client_id string, severity string, message string, details string, trace_id string, span_id string, parent_span_id string, duration_ms double, day date", "day"),
    "usage_records": ("record_id string, client_id string, usage_type string, quantity double, unit string, cost_usd double, ts timestamp_ntz, request_id string, day date", "day"),
}


class Store:
    """Parquet tables below one folder: created empty, appended to, and read with fixed schemas; a table that is not there is an error. Statistics of sorted files stand in for indexes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, root: str) -> Store:
        """A store with all its tables, empty; those that are there stay as they are."""
        store = cls(spark, root)
        for name, (schema, _) in SCHEMAS.items():
            spark.createDataFrame([], schema).coalesce(1).write.mode("ignore").parquet(store.path(name))
        return store

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def append(self, name: str, rows: DataFrame) -> None:
        schema, part = SCHEMAS[name]
        want = self.spark.createDataFrame([], schema).schema
        have = {c.lower() for c in rows.columns}
        rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name.lower() in have else F.lit(None).cast(f.dataType).alias(f.name) for f in want.fields))
        writer = rows.write.mode("append")
        (writer.partitionBy(part) if part else writer).parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        """A table, which joins read by sorting and merging: a few columns of a wide table, mostly null, count as next to nothing, and would be broadcast through the driver at any size."""
        return self.spark.read.schema(SCHEMAS[name][0]).parquet(self.path(name)).hint("merge")


def new_triplets(rows: DataFrame, as_of: Column, source: str = "tournament") -> DataFrame:
    """Rows with an id, the status active, one time for all, and defaults where a value is missing."""
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    return rows.select(
        F.expr("uuid()").alias("id"),
        F.coalesce(has("input_query"), has("input"), F.lit("")).alias("input_query"),
        *(has(c).alias(c) for c in ("chosen", "rejected") if c in rows.columns),
        F.coalesce(has("confidence"), F.lit(0.5)).alias("confidence"),
        F.coalesce(has("quality"), F.lit("bronze")).alias("quality"),
        F.coalesce(has("source"), F.lit(source)).alias("source"),
        F.lit("active").alias("status"),
        as_of.alias("created_at"),
        as_of.alias("updated_at"),
    )


def texts(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """A text file as one row, or as one row for each line."""
    return spark.read.text(path, wholetext=not split)


def tool_results(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Calls (call_id, tool) with the server of their tool; unknown tools give an error row."""
    j = calls.join(tools, "tool", "left")
    return j.select("call_id", "tool", "server", F.when(F.col("server").isNull(), F.concat(F.lit("[Error] unknown tool "), F.col("tool"))).alias("error"))


def tool_answers(spark: SparkSession, path: str, tool: str | None = None) -> DataFrame:
    """A tool's recorded answers (JSON lines of tool, query and answer, in any store that Spark reads), in place of a network service."""
    rows = spark.read.schema("tool string, query string, answer string").json(path)
    return rows if tool is None else rows.filter(F.col("tool") == tool)


class Registry:
    """Named things; a later one of a name replaces the earlier. `prefix/suffix` finds what is registered under the prefix."""

    def __init__(self):
        self._items: dict[str, object] = {}

    def register(self, name: str) -> Callable:
        def add(x):
            self._items[name] = x
            return x

        return add

    def __getitem__(self, name: str):
        return self._items[name] if name in self._items else self._items[name.partition("/")[0]]

    def __contains__(self, name: str) -> bool:
        return name in self._items or name.partition("/")[0] in self._items


#: Extension points: judges (pairs -> pairs with score_a, score_b), rewards (scores -> scores with a reward), plugins (trajectories -> verdict rows).
JUDGES, REWARDS, PLUGINS = Registry(), Registry(), Registry()
