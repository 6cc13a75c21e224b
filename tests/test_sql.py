"""Rules and functions called from SQL."""

from pyspark.sql import functions as F

from laurel.functions import text as X
from laurel.operators import sql as Q

CONFIGS = "traj_id bigint, kind string, type string, name string, config string"


def test_rules_see_one_trajectory_at_a_time(spark):
    rows = [(i % 3, "terraform", f"t{i % 4}", f"n{i}", "{}") for i in range(12)] + [(9, "kubernetes", "Pod", "p", "{}")]
    configs = spark.createDataFrame(rows, CONFIGS).repartition(4)

    def check(row, kept):
        kept["n"] = kept.get("n", 0) + 1
        return [(row["name"], "error")] if row["type"] == "t3" else []

    Q.register_rule(spark, "third", check, lambda kept: [(str(kept["n"]), "low")])
    got = sorted(map(tuple, spark.sql("SELECT * FROM third(TABLE(SELECT * FROM {c}) PARTITION BY traj_id)", c=configs).collect()))
    want = [(i % 3, "third", f"n{i}", "error") for i in range(12) if i % 4 == 3] + [(t, "third", n, "low") for t, n in [(0, "4"), (1, "4"), (2, "4"), (9, "1")]]
    assert got == sorted(want)
    assert spark.sql("SELECT * FROM third(TABLE(SELECT * FROM {c}) PARTITION BY traj_id)", c=configs.limit(0)).count() == 0


def test_functions_are_those_of_the_columns(spark):
    assert Q.register_functions(spark) == ["laurel_url_host", "laurel_token_estimate", "laurel_quality_tier", "laurel_content_hash"]
    urls = spark.createDataFrame([(u,) for u in ["https://a.b:80/c", "http://x", "host-1", "no host", "", None]], "u string")
    got = urls.select(F.expr("laurel_url_host(u)").alias("a"), X.host("u").alias("b"), F.expr("laurel_token_estimate(u)").alias("n"))
    assert all(r["a"] == r["b"] for r in got.collect()) and [r["n"] for r in got.collect()] == [4, 2, 1, 1, 0, 0]
    assert "PythonUDF" not in got._jdf.queryExecution().toString()
