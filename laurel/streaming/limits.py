"""Keyed state machines: rate limits, caches, circuit breakers and load balancing, in batch and as streams.

A machine answers the rows of one key in order of time. The batch form runs over sorted partitions; the streaming form keeps the
same state by key, so a finished stream and the batch give the same answers.
"""

from __future__ import annotations

import collections
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import cache_key
from .forgetful import answered
from .reuse import BLOCK, Kept, numbered, replayed, residents

# Buckets as (name, capacity, refill, seconds of one refill), in the order in which they are asked.
BUCKETS = (("burst", 10, 10, 1), ("minute", 60, 60, 60), ("hour", 1000, 1000, 3600), ("day", 10000, 10000, 86400))


class Buckets:
    """The four buckets of one client. A bucket is refilled once a whole interval has passed, and then forgets the rest of it; a request that a later bucket denies has already spent from the earlier ones."""

    def __init__(self, state: list[tuple[float, float]] | None = None, rules=BUCKETS):
        self.rules, self.state = rules, state

    def ask(self, now: float) -> str | None:
        """None if allowed, or the name of the bucket that denies."""
        if self.state is None:
            self.state = [(float(c), now) for _, c, _, _ in self.rules]
        for k, (name, capacity, refill, seconds) in enumerate(self.rules):
            tokens, last = self.state[k]
            whole = int((now - last) // seconds)
            if whole >= 1:
                tokens, last = min(float(capacity), tokens + whole * refill), now
            if tokens < 1:
                self.state[k] = (tokens, last)
                return name
            self.state[k] = (tokens - 1, last)
        return None

    def answer(self, us: int) -> str | None:
        return self.ask(us / 1e6)

    def kept(self) -> tuple[float, ...]:
        return tuple(float(v) for pair in self.state for v in pair)

    def horizon(self) -> int:
        """Microseconds after which all buckets are full again."""
        return 1_000_000 * max(-(-c // r) * s for _, c, r, s in self.rules)

    def idle(self, us: int) -> bool:
        """Whether a new client's buckets would give the same answers from here on."""
        return all(min(c, t + int((us / 1e6 - last) // s) * r) >= c and us / 1e6 - last >= s for (t, last), (_, c, r, s) in zip(self.state, self.rules, strict=True))

    def restored(self, values: tuple[float, ...]) -> Buckets:
        self.state = list(zip(values[::2], values[1::2], strict=True))
        return self


class Entry:
    """One key's place in a cache: when it was stored, in microseconds, or -1."""

    def __init__(self, seconds: int):
        self.life, self.stored = seconds * 1_000_000, -1

    def answer(self, us: int, stores: bool, resident: bool = True) -> bool:
        """Whether the call hits; if not, it stores its answer where it may. `resident` is false if the entry has been pushed out."""
        if not resident:
            self.stored = -1
        fresh = self.stored >= 0 and us - self.stored < self.life
        if stores and not fresh:
            self.stored = us
        return fresh

    def kept(self) -> tuple[float, ...]:
        return (float(self.stored),)

    def horizon(self) -> int:
        return self.life

    def idle(self, us: int) -> bool:
        """Whether the entry has outlived its time."""
        return self.stored < 0 or us - self.stored >= self.life

    def restored(self, values: tuple[float, ...]) -> Entry:
        self.stored = int(values[0])
        return self


class Breaker:
    """One circuit: errors in a row, and since when it is open, in microseconds, or -1."""

    def __init__(self, failures: int, seconds: int):
        self.failures, self.life, self.n, self.since = failures, seconds * 1_000_000, 0, -1

    def answer(self, us: int, bad: bool) -> bool:
        """Whether the circuit is open when the call comes."""
        if self.since >= 0 and us - self.since >= self.life:
            self.n, self.since = 0, -1
        open_ = self.since >= 0
        self.n = self.n + 1 if bad else 0
        if self.n >= self.failures and not open_:
            self.since = us
        elif not bad:
            self.since = -1
        return open_

    def kept(self) -> tuple[float, ...]:
        return float(self.n), float(self.since)

    def horizon(self) -> int:
        return self.life

    def idle(self, us: int) -> bool:
        """Whether there is nothing to remember: an open circuit has closed by time, or no error is pending. A run of errors that has not opened it is kept."""
        return us - self.since >= self.life if self.since >= 0 else self.n == 0

    def restored(self, values: tuple[float, ...]) -> Breaker:
        self.n, self.since = int(values[0]), int(values[1])
        return self


def _batch(rows: DataFrame, key: str, inputs: list[str], make, ident: str, out: str) -> DataFrame:
    """Each row's answer from the machine of its key. Rows of a key are sorted inside partitions and streamed, so a key of any size needs the memory of one batch."""
    names = [x.split()[0] for x in out.split(", ")]
    ordered = rows.repartition(key).sortWithinPartitions(key, "us", ident)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, machine = None, make()
        for pdf in batches:
            said = []
            for k, *given in zip(pdf[key].tolist(), *(pdf[c].tolist() for c in inputs), strict=True):
                if k != last:
                    last, machine = k, make()
                said.append(machine.answer(*given))
            yield pd.DataFrame({c: pdf[c] for c in names[:-1]} | {names[-1]: said})

    return ordered.mapInPandas(run, out)


def _stream(rows: DataFrame, key: str, inputs: list[str], make, ident: str, out: str, state: int, delay: str | None = None) -> DataFrame:
    """The same as a stream: state is that many numbers of each key's machine. Without a delay, rows of one trigger are taken in order of time and state is kept for ever; with one, see `forgetful`."""
    if delay is not None:
        return answered(rows, delay, key, inputs, make, ident, out, state)
    from pyspark.sql.streaming.state import GroupStateTimeout

    names = [x.split()[0] for x in out.split(", ")]

    def run(_, batches, kept):
        pdf = pd.concat(list(batches)).sort_values(["us", ident])
        machine = make().restored(tuple(kept.get)) if kept.exists else make()
        said = [machine.answer(*given) for given in zip(*(pdf[c].tolist() for c in inputs), strict=True)]
        kept.update(machine.kept())
        yield pd.DataFrame({c: pdf[c] for c in names[:-1]} | {names[-1]: said})

    return rows.groupBy(key).applyInPandasWithState(run, out, ", ".join(f"s{k} double" for k in range(state)), "append", GroupStateTimeout.NoTimeout)


def _us() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp")).alias("us")


_LIMITED = "request_id bigint, client_id bigint, denied_by string"


def _limit_rows(requests: DataFrame) -> DataFrame:
    return requests.select("request_id", "client_id", _us(), "ts")


def rate_limited(requests: DataFrame, rules=BUCKETS) -> DataFrame:
    """denied_by for each request (request_id, client_id, ts), null if allowed."""
    return _batch(_limit_rows(requests), "client_id", ["us"], lambda: Buckets(rules=rules), "request_id", _LIMITED)


def rate_limited_stream(requests: DataFrame, rules=BUCKETS, delay: str | None = None) -> DataFrame:
    return _stream(_limit_rows(requests), "client_id", ["us"], lambda: Buckets(rules=rules), "request_id", _LIMITED, 2 * len(rules), delay)


_HIT = "event_id bigint, hit boolean"


def _call_rows(calls: DataFrame, key: Column, stores: Column | None) -> DataFrame:
    kept = F.coalesce(stores, F.lit(False)) if stores is not None else F.lit(True)
    return calls.select("event_id", key.alias("key"), _us(), kept.alias("stores"), "ts")


def cache_hits(calls: DataFrame, key: Column, seconds: int, stores: Column | None = None, capacity: int | None = None, block: int | None = None) -> DataFrame:
    """hit: whether an equal key was stored less than `seconds` before, as seen from the call that stored it; calls for which `stores` is not true store nothing.

    An entry lives from its insertion, so hits depend on where the last one was stored: keys are taken in order. With a capacity, the entries used least
    recently are pushed out: a call uses its key if it stores or hits, and an entry that has outlived its time keeps its place until then.
    """
    if capacity is not None:
        key = F.to_json(F.struct(key.alias("k")))  # a null key is one like others
        rows = _call_rows(calls, key, stores).withColumnRenamed("event_id", "ident").withColumn("weight", F.lit(1).cast("long"))

        if rows.filter(~F.col("stores")).isEmpty():
            seen = residents(numbered(rows, ["us", "ident"], block or BLOCK).withColumn("used", F.lit(True)), capacity, block or BLOCK)
            said = _batch(seen.withColumnRenamed("at", "event_id"), "key", ["us", "stores", "resident"], lambda: Entry(seconds), "event_id", _HIT)
            return seen.withColumnRenamed("at", "seen").join(said.withColumnRenamed("event_id", "seen"), "seen").select(F.col("ident").alias("event_id"), "hit")
        rows = rows.withColumn("asked", F.lit(None).cast("array<string>"))
        said = replayed(numbered(rows, ["us", "ident"], block), lambda: Kept(capacity, seconds * 1_000_000))
        return said.select(F.col("ident").alias("event_id"), (F.col("said") == 1).alias("hit"))
    return _batch(_call_rows(calls, key, stores), "key", ["us", "stores"], lambda: Entry(seconds), "event_id", _HIT)


def cache_hits_stream(calls: DataFrame, key: Column, seconds: int, stores: Column | None = None, delay: str | None = None) -> DataFrame:
    """`cache_hits` without a capacity, as a stream."""
    return _stream(_call_rows(calls, key, stores), "key", ["us", "stores"], lambda: Entry(seconds), "event_id", _HIT, 1, delay)


def tool_cache(calls: DataFrame, seconds: int = 600, bypass: tuple[str, ...] = (), capacity: int | None = None) -> DataFrame:
    """hit for tool calls (event_id, ts, tool, arguments, ok): only answers that went well are stored, and tools in `bypass` neither store nor hit."""
    cached = ~F.col("tool").isin(*bypass) if bypass else F.lit(True)
    hits = cache_hits(calls.filter(cached), cache_key("tool", "arguments"), seconds, F.col("ok"), capacity)
    return hits.unionByName(calls.filter(~cached).select("event_id", F.lit(False).alias("hit")))


def gateway(requests: DataFrame, rules=BUCKETS, seconds: int = 3600, max_tokens: int = 100_000, max_variations: int = 16, handlers: tuple[str, ...] = ()) -> DataFrame:
    """request_id, status, by: what becomes of requests (request_id, client_id, ts, kind, payload, tokens, variations, outcome).

    In order: the client's limits, the cache of completed answers, validation, the handler of the kind, and the handler's recorded outcome (ok,
    timeout or an error). Only what a step lets through reaches the next: a limited request neither reads nor fills the cache.
    """
    asked = requests.join(rate_limited(requests, rules).select("request_id", "denied_by"), "request_id")
    invalid = F.when(F.col("tokens") > max_tokens, "tokens").when(F.col("variations") > max_variations, "variations").when(~F.col("kind").isin(*handlers), "unknown kind")
    asked = asked.withColumn("wrong", invalid)
    done = F.col("wrong").isNull() & (F.col("outcome") == "ok")
    passed = asked.filter("denied_by IS NULL").withColumn("event_id", F.col("request_id"))
    hits = cache_hits(passed, F.col("payload"), seconds, done).select(F.col("event_id").alias("request_id"), "hit")
    out = asked.join(hits, "request_id", "left")
    status = F.when(F.col("denied_by").isNotNull(), "rate_limited").when(F.col("hit"), "cached").when(F.col("wrong").isNotNull(), "failed").when(F.col("outcome") == "ok", "completed").when(F.col("outcome") == "timeout", "timeout").otherwise("failed")
    by = F.when(F.col("denied_by").isNotNull(), F.col("denied_by")).when(F.col("hit"), "cache").otherwise(F.coalesce("wrong", "outcome"))
    return out.select("request_id", status.alias("status"), by.alias("by"))


def retried(requests: DataFrame, handler, endpoints: int, most: int = 3, base: float = 1.0) -> DataFrame:
    """request_id, attempts, endpoint, ok, waited: attempts of requests (request_id, start) until one goes well, `most` at most.

    Every attempt is routed anew, to the next endpoint; before attempt k (from 1) a request waits base * 2 ** (k - 1) seconds. handler(attempt, endpoint) is a
    column of the requests that is true where an attempt goes well.
    """
    endpoint = lambda a: (F.col("start") + a) % endpoints
    tried = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda a: F.struct(a.alias("attempt"), endpoint(a).alias("endpoint"), F.coalesce(handler(a, endpoint(a)), F.lit(False)).alias("ok")))
    out = requests.select("request_id", tried.alias("tried")).withColumn("good", F.try_element_at(F.filter("tried", lambda t: t["ok"]), F.lit(1)))
    last = F.coalesce("good.attempt", F.lit(most - 1))
    return out.select("request_id", (last + 1).cast("bigint").alias("attempts"), F.get("tried", last)["endpoint"].alias("endpoint"), F.col("good").isNotNull().alias("ok"), (base * (F.pow(F.lit(2.0), last) - 1)).alias("waited"))


_OPEN = "event_id bigint, open boolean"


def _breaker_rows(calls: DataFrame) -> DataFrame:
    return calls.select("event_id", "client_id", _us(), (F.col("severity") == "error").alias("bad"), "ts")


def breaker_states(calls: DataFrame, failures: int = 5, seconds: int = 60) -> DataFrame:
    """open: whether a client's circuit is open when a call comes. Enough failures in a row open it for `seconds`; a success or the end of that time resets the count."""
    return _batch(_breaker_rows(calls), "client_id", ["us", "bad"], lambda: Breaker(failures, seconds), "event_id", _OPEN)


def breaker_states_stream(calls: DataFrame, failures: int = 5, seconds: int = 60, delay: str | None = None) -> DataFrame:
    return _stream(_breaker_rows(calls), "client_id", ["us", "bad"], lambda: Breaker(failures, seconds), "event_id", _OPEN, 2, delay)


def prefix_hashes(messages: Column) -> Column:
    """The hash of each prefix of a list of messages, each from the one before it."""
    one = lambda x: F.to_json(F.struct(x["role"], x["content"]))
    step = lambda s, x: F.array_append(s, F.sha2(F.concat(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit("")), one(x)), 256))
    return F.aggregate(messages, F.array().cast("array<string>"), step)


def longest_prefix(requests: DataFrame, cached: DataFrame) -> DataFrame:
    """For each list of messages (conv_id, messages), the length of its longest prefix that an earlier one (a smaller conv_id) has left in the cache: hashes of all prefixes against those of whole entries."""
    prefixes = requests.select("conv_id", F.posexplode(prefix_hashes(F.col("messages"))).alias("at", "hash"))
    entries = cached.filter(F.size("messages") > 0).groupBy(F.element_at(prefix_hashes(F.col("messages")), -1).alias("hash")).agg(F.min("conv_id").alias("since"))
    best = prefixes.join(entries, "hash").filter("since < conv_id").groupBy("conv_id").agg((F.max("at") + 1).cast("bigint").alias("prefix"))
    return requests.select("conv_id").join(best, "conv_id", "left").select("conv_id", F.coalesce("prefix", F.lit(0).cast("bigint")).alias("prefix"))


def prefix_tokens(messages: Column) -> Column:
    """A quarter of each message's characters, rounded down."""
    return F.aggregate(messages, F.lit(0).cast("long"), lambda n, m: n + F.floor(F.char_length(F.coalesce(m["content"], F.lit(""))) / 4))


def longest_kept_prefix(requests: DataFrame, cached: DataFrame, budget: int, block: int | None = None) -> DataFrame:
    """Like `longest_prefix`, in a cache that holds entries of at most `budget` tokens together and drops those used least recently.

    Requests come in the order of conv_id; each first looks for its longest prefix, which it uses, and then stores its own entry. Which prefix that is depends on
    earlier uses, so blocks of requests are replayed (see `replayed`).
    """
    none, hashes = (lambda kind: F.lit(None).cast(kind)), prefix_hashes(F.col("messages"))
    asked = requests.select("conv_id", F.lit(0).alias("turn"), none("string").alias("key"), F.lit(0).cast("long").alias("weight"), F.coalesce(hashes, F.array()).alias("asked"))
    own = cached.filter(F.size("messages") > 0)
    stored = own.select("conv_id", F.lit(1).alias("turn"), F.element_at(hashes, -1).alias("key"), prefix_tokens(F.col("messages")).alias("weight"), none("array<string>").alias("asked"))
    rows = asked.unionByName(stored).select(F.col("conv_id").alias("ident"), "turn", "key", "weight", none("long").alias("us"), (F.col("turn") == 1).alias("stores"), "asked")
    calls = numbered(rows, ["ident", "turn", "key"], block)
    said = replayed(calls.withColumn("ident", F.struct("ident", "turn")), lambda: Kept(budget))
    return said.filter("ident.turn = 0").select(F.col("ident.ident").alias("conv_id"), F.col("said").alias("prefix"))


def drain_order(queued: DataFrame) -> DataFrame:
    """The place of each request in its queue's drain: higher priorities first, first come first served inside one."""
    w = W.partitionBy("queue").orderBy(F.desc("priority"), "seq")
    return queued.withColumn("place", F.row_number().over(w).cast("bigint"))


class Levels:
    """A queue of bounded levels, one for each priority: a request is refused where its level is full, and the next to go is the oldest of the highest level."""

    def __init__(self, capacity: int):
        self.capacity, self.levels = capacity, {}

    def answer(self, ident: int, priority: int | None) -> int:
        """For a request with a priority, whether it is refused (1) or not (0); for a take (no priority), the id of the request that goes, or -1."""
        if priority is not None and priority == priority:
            level = self.levels.setdefault(int(priority), collections.deque())
            if len(level) >= self.capacity:
                return 1
            level.append(ident)
            return 0
        some = [k for k, level in self.levels.items() if level]
        return self.levels[max(some)].popleft() if some else -1


def bounded_queue(events: DataFrame, capacity: int) -> DataFrame:
    """event_id, status (refused, waiting or taken) and place (the how-many-eth take of its queue took it) of requests put into queues.

    Events (event_id, queue, ts, priority) are requests, or takes where the priority is null; they are replayed in order, a queue in the memory of what waits in it.
    """
    rows = events.select("event_id", "queue", _us(), F.col("priority").cast("double").alias("priority"))
    said = _batch(rows.withColumn("ident", F.col("event_id")), "queue", ["ident", "priority"], lambda: Levels(capacity), "event_id", "event_id long, queue long, us long, priority double, said long")
    w = W.partitionBy("queue").orderBy("us", "event_id")
    takes = said.filter("isnan(priority) OR priority IS NULL").filter("said >= 0").select(F.col("said").alias("event_id"), F.row_number().over(w).cast("long").alias("place"))
    puts = said.filter("NOT (isnan(priority) OR priority IS NULL)").select("event_id", "said")
    out = puts.join(takes, "event_id", "left")
    return out.select("event_id", F.when(F.col("said") == 1, "refused").when(F.col("place").isNull(), "waiting").otherwise("taken").alias("status"), "place")


class Connections:
    """Open connections of a pool's endpoints; a request goes to the endpoint that has fewest, the first of these."""

    def __init__(self, endpoints: int):
        self.open, self.heap, self.at = [0] * endpoints, [(0, k) for k in range(endpoints)], {}

    def answer(self, request: int, starts: bool) -> int:
        """The endpoint that a request goes to, or that it leaves (-1 if it is at none)."""
        if starts:
            while self.heap[0][0] != self.open[self.heap[0][1]]:  # an entry that has been overtaken
                heapq.heappop(self.heap)
            k = self.at[request] = self.heap[0][1]
            self.open[k] += 1
        elif (k := self.at.pop(request, -1)) < 0:
            return -1
        else:
            self.open[k] = max(0, self.open[k] - 1)
        heapq.heappush(self.heap, (self.open[k], k))
        return k


def least_connections(requests: DataFrame, endpoints: int) -> DataFrame:
    """request_id, endpoint: where requests (request_id, pool, ts, until) go, each to the endpoint of its pool with fewest open connections when it comes; ends come before starts of the same time."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    events = F.array(F.struct((us("ts") * 2 + 1).alias("us"), F.lit(True).alias("starts")), F.struct((us("until") * 2).alias("us"), F.lit(False).alias("starts")))
    rows = requests.select("request_id", "pool", F.inline(events)).filter("us IS NOT NULL").withColumn("request", F.col("request_id"))
    said = _batch(rows, "pool", ["request", "starts"], lambda: Connections(endpoints), "request_id", "request_id long, starts boolean, endpoint long")
    return said.filter("starts").select("request_id", "endpoint")


def weighted(key: Column, weights: dict[str, float]) -> Column:
    """The endpoint that a key belongs to, by rendezvous: the least of -ln(u) / weight, u being a number in (0, 1) from the digest of key and endpoint.

    Endpoints get keys in proportion to their weights, and one that goes gives its own keys to the others and moves no other. With equal weights this is a random choice.
    """
    u = lambda name: (F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{name}"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    scores = [F.struct((-F.ln(u(name)) / w).alias("score"), F.lit(name).alias("name")) for name, w in sorted(weights.items()) if w > 0]
    return F.array_min(F.array(*scores))["name"]


def gauge(rows: DataFrame, step: str, order: list[str], *partition: str) -> DataFrame:
    """rows with `gauge`, a running sum of steps that never falls below zero: the sum less the least sum so far, where that is negative."""
    w = W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    walked = rows.withColumn("gauge", F.sum(step).over(w))
    return walked.withColumn("gauge", (F.col("gauge") - F.least(F.min("gauge").over(w), F.lit(0))).cast("long"))


def by_hash(key: Column, n: int) -> Column:
    """md5(key) mod n, from the digest's two halves."""
    digest = F.md5(key)
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)")
    return ((half(1) % n) * ((1 << 64) % n) + half(17) % n).cast("bigint") % n


def round_robin(order: list[Column], n: int, *partition: str) -> Column:
    return ((F.row_number().over(W.partitionBy(*partition).orderBy(*order)) - 1) % n).cast("bigint")


def preferred(candidates: DataFrame, *preferences: str) -> DataFrame:
    """Candidates of each request narrowed by one preference (a boolean column) after another; one that nobody meets is passed over."""
    for p in preferences:
        any_ = F.max(p).over(W.partitionBy("request_id"))
        candidates = candidates.withColumn("_any", any_).filter(F.col(p) | ~F.col("_any")).drop("_any")
    return candidates
