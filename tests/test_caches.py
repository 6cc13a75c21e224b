"""Caches with a capacity against replays in order."""

import collections
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from laurel.streaming import limits as L
from laurel.streaming import reuse as R

T0 = dt.datetime(2024, 1, 1)
CALLS = "event_id long, key string, ts timestamp, stores boolean"


def replay(calls, seconds, capacity):
    """(event_id, key, second, stores) in order -> hits of a cache of that many entries."""
    cache, out = collections.OrderedDict(), {}
    for i, key, t, stores in calls:
        hit = key in cache and t - cache[key] < seconds
        if stores and not hit:
            cache[key] = t
        if stores or hit:
            cache.move_to_end(key)
            if len(cache) > capacity:
                cache.popitem(last=False)
        out[i] = hit
    return out


def made(n, keys, storing, seed):
    rng = random.Random(seed)
    hot = [f"k{int(rng.paretovariate(0.7)) % keys}" for _ in range(n)]
    t, out = 0, []
    for i, k in enumerate(hot):
        t += rng.choice([0, 1, 1, 2, 9])
        out.append((i, "hot" if rng.random() < 0.3 else k, t, rng.random() < storing))
    return out


def got_hits(spark, calls, seconds, capacity, block):
    df = spark.createDataFrame([(i, k, T0 + dt.timedelta(seconds=t), s) for i, k, t, s in calls], CALLS).repartition(5)
    return {r["event_id"]: r["hit"] for r in L.cache_hits(df, F.col("key"), seconds, F.col("stores"), capacity, block).collect()}


@pytest.mark.parametrize(("storing", "capacity", "seconds", "block"), [(1.0, 20, 400, 64), (1.0, 1, 10**6, 1000), (0.5, 15, 300, 128), (0.2, 5, 10**6, 37), (0.6, 10**6, 50, 100)])
def test_lru_with_time_to_live(spark, storing, capacity, seconds, block):
    calls = made(700, 60, storing, 3)
    want = replay(calls, seconds, capacity)
    assert got_hits(spark, calls, seconds, capacity, block) == want
    assert len(set(want.values())) == 2


def test_lru_of_many_calls(spark):
    calls = made(100_000, 5000, 1.0, 8)
    want = replay(calls, 10**5, 800)
    assert got_hits(spark, calls, 10**5, 800, 1 << 14) == want and len(set(want.values())) == 2


def test_empty_and_single_calls(spark):
    assert got_hits(spark, [], 10, 5, 10) == {}
    assert got_hits(spark, [(1, None, 0, True), (2, None, 1, True), (3, "a", 1, False)], 10, 5, 10) == {1: False, 2: True, 3: False}


def test_dominance_counts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 129):
        x, v, w = (rng.integers(0, 40, n) for _ in range(3))
        want = [sum(int(w[j]) for j in range(n) if x[j] < x[i] and v[j] > v[i]) for i in range(n)]
        assert R.dominated(x, v, w).tolist() == want


MESSAGES = "conv_id long, messages array<struct<role:string,content:string>>"


def replay_prefixes(rows, budget):
    tokens = lambda m: sum(len(c or "") // 4 for _, c in m)
    cache, out = collections.OrderedDict(), {}
    for i, messages in rows:
        m = tuple(messages)
        found = next((k for k in range(len(m), 0, -1) if m[:k] in cache), 0)
        if found:
            cache.move_to_end(m[:found])
        if m[:-1]:
            cache[m[:-1]] = None
            cache.move_to_end(m[:-1])
            while sum(map(tokens, cache)) > budget:
                cache.popitem(last=False)
        out[i] = found
    return out


@pytest.mark.parametrize(("budget", "block"), [(40, 1000), (90, 50), (10**9, 64)])
def test_prefix_cache_with_a_budget(spark, budget, block):
    rng = random.Random(4)
    turns = [("user", "x" * rng.randint(0, 30)) for _ in range(6)]
    rows = [(i, [rng.choice(turns[:2]), *(rng.choice(turns) for _ in range(rng.randint(0, 4)))]) for i in range(150)]
    df = spark.createDataFrame(rows, MESSAGES)
    cached = df.withColumn("messages", F.slice("messages", F.lit(1), F.size("messages") - 1))
    got = {r["conv_id"]: r["prefix"] for r in L.longest_kept_prefix(df, cached, budget, block).collect()}
    want = replay_prefixes(rows, budget)
    assert got == want and len(set(want.values())) > 2
    if budget == 10**9:
        assert got == {r["conv_id"]: r["prefix"] for r in L.longest_prefix(df, cached).collect()}


@pytest.fixture
def rounds(monkeypatch):
    """How often the replay has written a table."""
    done, write = [], R.written
    monkeypatch.setattr(R, "written", lambda df: done.append(1) or write(df))
    return done


@pytest.mark.parametrize("at_once", [1, 8])
def test_a_prefix_that_is_kept_alive_takes_few_rounds(spark, rounds, monkeypatch, at_once):
    """What a request finds depends on the one before it, all the way back: rounds grow with the blocks, not with the requests."""
    monkeypatch.setattr(R, "ROUNDS", at_once, raising=False)
    rows = [(0, [("system", "s" * 20), ("user", "u")])] + [(i, [("system", "s" * 20), ("user", f"{i:040}"), ("user", "u")]) for i in range(1, 200)]
    df = spark.createDataFrame(rows, MESSAGES)
    cached = df.withColumn("messages", F.slice("messages", F.lit(1), F.size("messages") - 1))
    got = {r["conv_id"]: r["prefix"] for r in L.longest_kept_prefix(df, cached, 40, 100).collect()}
    assert got == replay_prefixes(rows, 40) and set(got.values()) == {0, 1}
    assert len(rounds) <= 1 + 4 + 1


def test_hits_that_keep_an_entry_young_take_few_rounds(spark, rounds):
    """A chain of calls that do not store, each of which hits because the one before did."""
    calls = [(0, "a", 0, True)] + [(i, "a" if i % 2 else f"k{i}", i, i % 2 == 0) for i in range(1, 240)]
    assert got_hits(spark, calls, 10**6, 2, 60) == replay(calls, 10**6, 2)
    assert len(rounds) <= 1 + 4 + 1
