"""Queues, routing and gauges against replays in order."""

import collections
import datetime as dt
import random

from pyspark.sql import functions as F

from laurel.streaming import limits as L

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_bounded_queue(spark):
    rng = random.Random(2)
    rows = [(i, i % 2, i // 3, rng.choice([0, 1, 2, None, None]) if i < 400 else 1) for i in range(420)]
    waiting, want, takes = collections.defaultdict(list), {}, collections.Counter()
    for i, queue, _, priority in rows:
        if priority is None:
            if waiting[queue]:
                p, j = min(waiting[queue])
                waiting[queue].remove((p, j))
                takes[queue] += 1
                want[j] = ("taken", takes[queue])
        elif sum(p == -priority for p, _ in waiting[queue]) >= 2:
            want[i] = ("refused", None)
        else:
            waiting[queue].append((-priority, i))
            want[i] = ("waiting", None)
    df = spark.createDataFrame([(i, q, at(t), p) for i, q, t, p in rows], "event_id long, queue long, ts timestamp, priority int").repartition(3)
    got = {r["event_id"]: (r["status"], r["place"]) for r in L.bounded_queue(df, 2).collect()}
    assert got == want and {s for s, _ in want.values()} == {"taken", "refused", "waiting"}


def test_least_connections(spark):
    rng = random.Random(3)
    rows = [(i, i % 2, rng.randrange(300), rng.choice([0, 5, 60, None])) for i in range(300)]
    events = sorted([(2 * t + 1, i, True, p) for i, p, t, _ in rows] + [(2 * (t + n), i, False, p) for i, p, t, n in rows if n is not None])
    count, where, want = collections.defaultdict(lambda: [0, 0, 0]), {}, {}
    for _, i, starts, pool in events:
        if starts:
            want[i] = where[i] = min(range(3), key=lambda k: count[pool][k])
            count[pool][where[i]] += 1
        elif i in where:
            count[pool][where.pop(i)] -= 1
    df = spark.createDataFrame([(i, p, at(t), None if n is None else at(t + n)) for i, p, t, n in rows], "request_id long, pool long, ts timestamp, until timestamp").repartition(3)
    got = {r["request_id"]: r["endpoint"] for r in L.least_connections(df, 3).collect()}
    assert got == want and set(want.values()) == {0, 1, 2}


def test_weighted_choice_keeps_shares_and_moves_little(spark):
    weights = {"a": 6.0, "b": 3.0, "c": 1.0}
    key = F.col("id").cast("string")
    rows = spark.range(100_000).select(L.weighted(key, weights).alias("all"), L.weighted(key, {"a": 6.0, "c": 1.0}).alias("some"), L.weighted(key, {**weights, "off": 0.0}).alias("off"))
    n = {(r["all"], r["some"]): r["n"] for r in rows.groupBy("all", "some").agg(F.count(F.lit(1)).alias("n")).collect()}
    for name, w in weights.items():
        assert abs(sum(k for (a, _), k in n.items() if a == name) / 100_000 - w / 10) < 0.01
    assert all(a == b for a, b in n if a != "b") and {b for a, b in n if a == "b"} == {"a", "c"}
    assert rows.filter("all <> off").isEmpty()


def test_gauge_never_falls_below_zero(spark):
    rng = random.Random(4)
    rows = [(i, i % 3, rng.choice([1, -1, -1, 2])) for i in range(300)]
    now, want = collections.Counter(), {}
    for i, k, step in rows:
        now[k] = max(0, now[k] + step)
        want[i] = now[k]
    df = spark.createDataFrame(rows, "id long, k long, step int").repartition(3)
    assert {r["id"]: r["gauge"] for r in L.gauge(df, "step", ["id"], "k").collect()} == want
