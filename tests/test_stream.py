"""Limits, caches and breakers: batch against hand-made cases, stream against batch."""

import datetime as dt
import os

from pyspark.sql import functions as F

from laurel.streaming import limits as L

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_bucket_forgets_fractions():
    b = L.Buckets(rules=(("b", 2, 1, 10),))
    assert [b.ask(t) for t in (0, 0, 0, 9.9, 15, 24, 25)] == [None, None, "b", "b", None, "b", None]


def test_denial_does_not_refund_earlier_buckets():
    b = L.Buckets(rules=(("burst", 3, 3, 1000), ("day", 1, 1, 1000)))
    assert [b.ask(0) for _ in range(4)] == [None, "day", "day", "burst"]


def streamed(spark, df, tmp_path, name, make):
    """What a stream over df in two files, taken one at a time, gives."""
    half = df.count() // 2
    for k, part in enumerate((df.orderBy("ts").limit(half), df.orderBy(F.desc("ts")).limit(df.count() - half))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    make(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    return sorted(map(tuple, spark.table(name).collect()), key=str)


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, i, i % 3, ["error", "error", "info"][i * 7 % 3], at(i * 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "request_id bigint, event_id bigint, client_id bigint, severity string, ts timestamp")
    rules = (("a", 2, 1, 50), ("b", 8, 8, 1000))
    key, stores = F.col("client_id") + 0, F.col("severity") == "error"
    forms = {
        "limited": (lambda x: L.rate_limited(x, rules), lambda x: L.rate_limited_stream(x, rules)),
        "hits": (lambda x: L.cache_hits(x, key, 40, stores), lambda x: L.cache_hits_stream(x, key, 40, stores)),
        "open": (lambda x: L.breaker_states(x, 2, 30), lambda x: L.breaker_states_stream(x, 2, 30)),
    }
    for name, (batch, stream) in forms.items():
        want = sorted(map(tuple, batch(df).collect()), key=str)
        assert len({r[-1] for r in want}) > 1
        assert streamed(spark, df, tmp_path / name, name, stream) == want


def delayed(spark, rows, schema, tmp_path, name, make):
    """What a stream over files of rows, one at a time, gives, and the number of state rows after each trigger."""
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
        for f in (tmp_path / "in" / str(k)).glob("*.parquet"):
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    state = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress]
    return sorted(map(tuple, spark.table(name).collect()), key=str), state


SCHEMA = "request_id bigint, event_id bigint, client_id bigint, severity string, ts timestamp"


def test_streams_wait_for_late_rows_and_forget(spark, tmp_path):
    # each file holds rows of its own minute, but every third comes one file late; a row far ahead lets all others be answered
    rows = [(i, i, i % 3, ["error", "error", "info"][i * 7 % 3], at(i * 7)) for i in range(60)]
    files = [[r for r in rows if r[0] // 15 + (r[0] % 3 == 0) == k] for k in range(5)]
    last = (999, 999, 77, "info", at(10**6))
    rules = (("a", 2, 1, 50), ("b", 8, 8, 1000))
    key, stores = F.col("client_id") + 0, F.col("severity") == "error"
    forms = {
        "late_limited": (lambda x: L.rate_limited(x, rules), lambda x: L.rate_limited_stream(x, rules, "200 seconds")),
        "late_hits": (lambda x: L.cache_hits(x, key, 40, stores), lambda x: L.cache_hits_stream(x, key, 40, stores, "200 seconds")),
        "late_open": (lambda x: L.breaker_states(x, 2, 30), lambda x: L.breaker_states_stream(x, 2, 30, "200 seconds")),
    }
    for name, (batch, stream) in forms.items():
        want = sorted(map(tuple, batch(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
        got, state = delayed(spark, [*files, [last]], SCHEMA, tmp_path / name, name, stream)
        assert got == want and len({r[-1] for r in want}) > 1
        # what is left is the last row, which waits with its timer, and the machines that a pending error keeps
        assert max(state) > 3 and state[-1] == 1, state


def test_cache_entries_live_from_insertion(spark):
    calls = spark.createDataFrame([(i, "k", at(t)) for i, t in enumerate([0, 5, 9, 11, 20])], "event_id bigint, key string, ts timestamp")
    got = {r["event_id"]: r["hit"] for r in L.cache_hits(calls, F.col("key"), 10).collect()}
    assert got == {0: False, 1: True, 2: True, 3: False, 4: True}


def test_breaker(spark):
    sev = ["error", "error", "error", "info", "error"]
    calls = spark.createDataFrame([(i, 1, s, at(t)) for i, (s, t) in enumerate(zip(sev, [0, 1, 2, 3, 100], strict=True))], "event_id bigint, client_id bigint, severity string, ts timestamp")
    got = {r["event_id"]: r["open"] for r in L.breaker_states(calls, 2, 60).collect()}
    assert got == {0: False, 1: False, 2: True, 3: True, 4: False}


def test_hash_routing_is_md5_modulo(spark):
    import hashlib

    keys = [f"req{i}" for i in range(20)]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", L.by_hash(F.col("k"), 7).alias("n")).collect()
    assert all(int(hashlib.md5(r["k"].encode()).hexdigest(), 16) % 7 == r["n"] for r in got)
