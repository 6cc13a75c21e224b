"""Stores, exports, registries and parsers."""

import datetime as dt
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from laurel.functions import text as X
from laurel.operators import distil as D
from laurel.operators import documents as P
from laurel.operators import policies as PO
from laurel.operators import stores as S
from laurel.operators import verify as V
from laurel.sources import stores as ST


def now():
    return F.lit("2024-05-01 10:00:00").cast("timestamp_ntz")


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_store_round_trip(spark, tmp_path):
    store = ST.Store.create(spark, str(tmp_path))
    assert store.read("triplets").count() == 0
    rows = spark.createDataFrame([("q", 0.9, "gold"), ("r", None, None)], "input string, confidence double, quality string")
    store.append("triplets", ST.new_triplets(rows, now()))
    store.append("triplets", ST.new_triplets(rows, now()))
    got = store.read("triplets")
    assert got.count() == 4 and got.select("id").distinct().count() == 4
    assert {(r["input_query"], r["confidence"], r["quality"], r["source"]) for r in got.collect()} == {("q", 0.9, "gold", "tournament"), ("r", 0.5, "bronze", "tournament")}
    assert S.matching(got, quality="gold", min_confidence=0.7).count() == 2
    members, manifest = S.snapshot(got, "v1", quality="gold")
    assert manifest.first()["triplet_count"] == 2 and S.version_triplets(members, got, "v1").count() == 2


def test_joins_of_stores_are_not_broadcast(spark, tmp_path):
    store = ST.Store.create(spark, str(tmp_path))
    store.append("gold_comparisons", spark.range(2000).select(F.col("id").cast("string").alias("id")))
    store.append("sme_labels", spark.range(6000).select((F.col("id") % 2000).cast("string").alias("comparison_id"), F.lit(0.5).alias("confidence")))
    j = store.read("gold_comparisons").select(F.col("id").alias("comparison_id")).join(store.read("sme_labels"), "comparison_id")
    assert "Broadcast" not in j._jdf.queryExecution().executedPlan().toString() and j.count() == 6000


@pytest.mark.parametrize("kind", ["jsonl", "parquet"])
def test_exports(spark, tmp_path, kind):
    D.export(spark.createDataFrame([(1, "a"), (2, None)], "id int, s string"), str(tmp_path / "x"), kind)
    back = spark.read.json(str(tmp_path / "x")) if kind == "jsonl" else spark.read.parquet(str(tmp_path / "x"))
    assert sorted(r["id"] for r in back.collect()) == [1, 2]
    with pytest.raises(ValueError, match="format"):
        D.export(back, "x", "csvv")


def test_file_tool(spark, tmp_path):
    p = tmp_path / "answers.jsonl"
    p.write_text("".join(json.dumps({"tool": t, "query": "q", "answer": t * 2}) + "\n" for t in "ab"))
    assert [r["answer"] for r in ST.tool_answers(spark, str(p), "b").collect()] == ["bb"]
    assert ST.tool_answers(spark, str(p)).count() == 2


def test_a_lost_table_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        ST.Store(spark, str(tmp_path / "none")).read("triplets")


def test_text_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a\nb\n")
    assert ST.texts(spark, str(tmp_path / "t.txt")).count() == 1
    assert ST.texts(spark, str(tmp_path / "t.txt"), split=True).count() == 2


def test_registry():
    r = ST.Registry()
    r.register("anchor")(1)
    r.register("anchor")(2)
    assert r["anchor/x"] == 2 and "anchor/x" in r and "none" not in r


def test_consensus_and_usage(spark):
    labels = spark.createDataFrame([(1, "a", 0.9), (1, "a", 0.8), (1, "b", 0.6)], "comparison_id int, winner string, confidence double")
    got = S.consensus(labels, "confidence").first()
    assert (got["winner"], round(got["confidence"], 6)) == ("a", 0.73913)
    req = spark.createDataFrame([(1, 1, 1000, 500, 3, 0.0)], "request_id int, client_id int, input_tokens int, output_tokens int, verifications int, seconds double")
    rows = S.usage_rows(req).withColumn("tier", F.lit("standard"))
    assert rows.count() == 4 and round(rows.agg(F.sum(S.cost())).first()[0], 6) == 0.0118


def test_modifiers(spark):
    rows = [("t", "passed", 1.0), ("t", "passed", 0.5), ("t", "skipped", 9.0), ("f", "passed", 0.5), ("f", "failed", 0.0), ("e", "passed", 0.5), ("e", "error", 1.0)]
    df = spark.createDataFrame([(*r, "m") for r in rows], "traj_id string, status string, modifier double, message string")
    got = {r["traj_id"]: (r["all_passed"], r["hard_failure"], r["modifier"]) for r in V.verdicts(df).collect()}
    assert got == {"t": (True, False, 0.5), "f": (False, True, 0.0), "e": (False, False, 0.5)}


def test_policies(spark):
    req = spark.createDataFrame([(1, "A::1", "connect", "Host::ok"), (2, "A::1", "connect", "Host::bad"), (3, "A::1", "read", "File::x")], "request_id int, principal string, action string, resource string")
    pol = spark.createDataFrame([("p", "permit", "*", "connect", "Host::*"), ("f", "forbid", "*", "*", "Host::bad")], "id string, effect string, principal string, action string, resource string")
    got = {r["request_id"]: (r["allowed"], r["forbids"]) for r in PO.decisions(req, pol).collect()}
    assert got == {1: (True, []), 2: (False, ["f"]), 3: (False, [])}
    deep = spark.createDataFrame([(1, "A::1", "connect", "Host::x::y"), (2, None, "connect", "Host::x"), (3, "A::1", "connect", "Host")], "request_id int, principal string, action string, resource string")
    pol = spark.createDataFrame([("p", "permit", "*", "*", "Host::*"), ("f", "forbid", "A::*", "connect", "Host::x::*")], "id string, effect string, principal string, action string, resource string")
    got = {r["request_id"]: (r["allowed"], r["forbids"]) for r in PO.decisions(deep, pol).collect()}
    assert got == {1: (False, ["f"]), 2: (False, []), 3: (False, [])}


def test_parsers():
    assert P.markdown({"a_b": 1, "c": {"d": [1, 2]}}) == "A B: 1\n# C\n## D\n- 1\n- 2"


def test_text_functions(spark):
    r = one(spark, X.truncate_middle(F.lit("aaa bbb ccc ddd eee"), 10).alias("cut"), X.letters_only(F.lit("aé1漢!")).alias("letters"), X.host(F.lit("http://h.x:80/p")).alias("host"), X.host(F.lit("bare.host")).alias("bare"), X.judge_scores(F.lit("nothing")).alias("none"))
    assert r["cut"].startswith("aaa\n... [") and r["cut"].endswith("eee")
    assert (r["letters"], r["host"], r["bare"], tuple(r["none"])) == ("a1漢", "h.x", "bare.host", (5.0, 5.0))


def test_split_is_exact(spark):
    for n, share in ((10, 0.8), (7, 0.5), (3, 0.1), (0, 0.9)):
        rows = spark.range(n).withColumnRenamed("id", "k")
        got = D.train_eval_split(rows, "k", share, "s").groupBy("part").count().collect()
        assert {r["part"]: r["count"] for r in got}.get("train", 0) == int(n * share)
    same = spark.range(10).select(F.lit("x").alias("k"))
    assert D.train_eval_split(same, "k", 0.5, "s").filter("part = 'train'").count() == 5


def test_retention(spark):
    e = spark.createDataFrame([(dt.datetime(2024, 3, 31),), (dt.datetime(2024, 4, 2),)], "ts timestamp_ntz")
    assert S.retained(e, now(), 30).count() == 1


def test_depths_of_long_chains_and_cycles(spark):
    rows = [(i, i - 1 if i else None) for i in range(301)] + [(400, None), (401, 400), (402, 400), (500, 501), (501, 500), (502, 500), (600, 999), (601, 600)]
    got = S.span_depths(spark.createDataFrame(rows, "span_id bigint, parent_span_id bigint")).collect()
    assert sorted(map(tuple, got)) == [(i, i) for i in range(301)] + [(400, 0), (401, 1), (402, 1)]
    assert S.span_depths(spark.createDataFrame([], "span_id bigint, parent_span_id bigint")).count() == 0
