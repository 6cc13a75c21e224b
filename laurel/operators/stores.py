"""Operators over the stored tables: triplets, dataset versions, expert labels, usage and telemetry."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

# Prices of a unit, multipliers by tier, and the limits of a day.
PRICES = {"api_call": 0.001, "token_input": 0.000003, "token_output": 0.000015, "verification": 0.0001, "execution": 0.001, "storage": 0.00001}
MULTIPLIERS = {"free": 0.0, "standard": 1.0, "premium": 1.5, "enterprise": 0.8}
QUOTA = {"requests": 10_000, "tokens": 1_000_000, "cost": 100.0}


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))



def matching(triplets: DataFrame, quality: str | None = None, sources: list[str] | None = None, min_confidence: float | None = None, status: str = "active") -> DataFrame:
    """Triplets that meet all given conditions; empty strings and lists do not restrict."""
    out = triplets.filter(F.col("status") == status)
    if quality:
        out = out.filter(F.col("quality") == quality)
    if sources:
        out = out.filter(F.col("source").isin(sources))
    if min_confidence is not None:
        out = out.filter(F.col("confidence") >= min_confidence)
    return out


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of a listing: a top-k, never a full sort on one node."""
    return rows.orderBy(*order).offset(offset).limit(limit) if offset else rows.orderBy(*order).limit(limit)


def with_status(triplets: DataFrame, changes: DataFrame) -> DataFrame:
    """Status after a change log (id, status, at): the latest change of an id wins."""
    last = changes.groupBy("id").agg(F.max_by("status", "at").alias("new"))
    return triplets.join(last, "id", "left").withColumn("status", F.coalesce("new", "status")).drop("new")


def retained(events: DataFrame, as_of: Column, days: int) -> DataFrame:
    return events.filter(F.col("ts") >= as_of - F.make_dt_interval(F.lit(days)))


def snapshot(triplets: DataFrame, name: str, **conditions) -> tuple[DataFrame, DataFrame]:
    """(membership, manifest) of a dataset version."""
    members = matching(triplets, **conditions).select(F.lit(name).alias("version_id"), F.col("id").alias("triplet_id"))
    return members, members.groupBy("version_id").agg(F.count(F.lit(1)).alias("triplet_count"))


def version_triplets(members: DataFrame, triplets: DataFrame, version: str) -> DataFrame:
    return members.filter(F.col("version_id") == version).join(triplets, F.col("triplet_id") == F.col("id")).drop("triplet_id")


def store_statistics(triplets: DataFrame) -> DataFrame:
    """Counts by quality and source and the mean confidence of active triplets, in one pass of grouping sets."""
    active = triplets.filter("status = 'active'")
    out = active.groupingSets([[], ["quality"], ["source"]], "quality", "source").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"))
    return out


# ---- expert labels -----------------------------------------------------------------------------------------------------


def checked_labels(labels: DataFrame) -> DataFrame:
    """Labels with an error column: winners other than a, b, tie and confidences outside 0..1 are marked."""
    bad = F.when(~F.coalesce(F.col("winner").isin("a", "b", "tie"), F.lit(False)), "winner").when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence")
    return labels.withColumn("error", bad)


def consensus(labels: DataFrame, confidence: str) -> DataFrame:
    """Votes weighted by confidence; the first largest of a, b, tie wins; null if all weights are 0."""
    vote = lambda w: F.coalesce(F.sum(F.when(F.col("winner") == w, F.col(confidence))), F.lit(0)).alias(w)
    v = labels.groupBy("comparison_id").agg(vote("a"), vote("b"), vote("tie"), F.count(F.lit(1)).alias("n_labels"))
    a, b, t = F.col("a"), F.col("b"), F.col("tie")
    total = a + b + t
    winner = F.when(total == 0, None).when((a >= b) & (a >= t), "a").when(b >= t, "b").otherwise("tie")
    return v.select("comparison_id", "n_labels", winner.alias("winner"), F.when(total != 0, F.greatest(a, b, t) / total).alias("confidence"))


def nested_labels(comparisons: DataFrame, labels: DataFrame) -> DataFrame:
    """Each comparison with its labels as an array: one aggregation and one join."""
    nested = labels.groupBy("comparison_id").agg(F.array_sort(F.collect_list(F.struct("sme_id", "winner", "tenths"))).alias("labels"))
    return comparisons.join(nested, "comparison_id", "left")


def label_statistics(agreed: DataFrame, labels: DataFrame) -> DataFrame:
    a = agreed.agg(F.count(F.lit(1)).alias("n_comparisons"), F.count_if(F.col("confidence") >= 0.7).alias("n_sure"), *(F.count_if(F.col("winner").eqNullSafe(F.lit(w))).alias(f"n_{w}") for w in ("a", "b", "tie")), F.count_if(F.col("winner").isNull()).alias("n_none"))
    b = labels.agg(F.count(F.lit(1)).alias("n_labels"), F.countDistinct("sme_id").alias("n_smes"))
    return a.join(b, F.lit(True)).withColumn("per_comparison", F.col("n_labels") / F.greatest("n_comparisons", F.lit(1)))


# ---- usage and billing -------------------------------------------------------------------------------------------------


def cost(kind: str = "usage_type", quantity: str = "quantity", tier: str = "tier") -> Column:
    """Price x quantity x tier multiplier; unknown types cost nothing, unknown tiers count as standard."""
    return F.coalesce(_map(PRICES)[F.col(kind)], F.lit(0.0)) * F.col(quantity) * F.coalesce(_map(MULTIPLIERS)[F.col(tier)], F.lit(1.0))


def usage_rows(requests: DataFrame) -> DataFrame:
    """A request's usage rows: one call, and one row for each positive amount."""
    row = lambda kind, unit, n: F.struct(F.lit(kind).alias("usage_type"), n.cast("double").alias("quantity"), F.lit(unit).alias("unit"))
    rows = F.array(row("api_call", "call", F.lit(1)), row("token_input", "token", F.col("input_tokens")), row("token_output", "token", F.col("output_tokens")), row("verification", "check", F.col("verifications")), row("execution", "second", F.col("seconds")))
    return requests.select("request_id", "client_id", F.explode(F.filter(rows, lambda x: x["quantity"] > 0)).alias("u")).select("request_id", "client_id", "u.*")


def usage_summary(usage: DataFrame, *keys: str) -> DataFrame:
    """Quantities by type, and the cost of all types."""
    amount = lambda kind: F.coalesce(F.sum(F.when(F.col("usage_type") == kind, F.col("quantity"))), F.lit(0.0)).alias(f"{kind}_quantity")
    return usage.groupBy(*keys).agg(*(amount(k) for k in PRICES if k != "storage"), F.sum(cost()).alias("total_cost"))


LINES = ("api_call", "token_input", "token_output", "verification")


def monthly_invoice(usage: DataFrame) -> DataFrame:
    """Line items of four types and a subtotal over all types, by client and calendar month."""
    month = F.date_trunc("month", "ts").cast("date").alias("month")
    line = lambda k: F.coalesce(F.sum(F.when(F.col("usage_type") == k, cost())), F.lit(0.0)).alias(f"{k}_cost")
    return usage.groupBy("client_id", month).agg(*(line(k) for k in LINES), F.sum(cost()).alias("subtotal"))


def quota_check(usage: DataFrame, limits: dict = QUOTA) -> DataFrame:
    """By client and day: the first limit reached of requests, tokens, cost; no row of limits allows all."""
    day = F.col("ts").cast("date").alias("day")
    n = F.count_if(F.col("usage_type") == "api_call").alias("requests")
    tokens = F.coalesce(F.sum(F.when(F.col("usage_type").isin("token_input", "token_output"), F.col("quantity"))), F.lit(0.0)).alias("tokens")
    got = usage.groupBy("client_id", day).agg(n, tokens, F.sum(cost()).alias("cost"))
    reason = F.when(F.col("requests") >= limits["requests"], "requests").when(F.col("tokens") >= limits["tokens"], "tokens").when(F.col("cost") >= limits["cost"], "cost")
    return got.withColumn("reason", reason).withColumn("allowed", reason.isNull())


# ---- telemetry ---------------------------------------------------------------------------------------------------------


def request_events(requests: DataFrame) -> DataFrame:
    """Start and end events of requests: severity follows success."""
    start = F.struct(F.lit("request_start").alias("event_type"), F.lit("info").alias("severity"), F.concat(F.lit("Request started: "), F.col("request_id").cast("string")).alias("message"), F.lit(None).cast("double").alias("duration_ms"))
    end = F.struct(F.lit("request_end").alias("event_type"), F.when(F.col("success"), "info").otherwise("error").alias("severity"), F.concat(F.when(F.col("success"), "Request completed: ").otherwise("Request failed: "), F.col("request_id").cast("string")).alias("message"), F.col("latency").alias("duration_ms"))
    return requests.select("request_id", F.explode(F.array(start, end)).alias("e")).select("request_id", "e.*")


def telemetry_statistics(events: DataFrame) -> DataFrame:
    """Counts by type and severity and of distinct clients, in one pass."""
    return events.groupingSets([[], ["event_type"], ["severity"]], "event_type", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("client_id").alias("clients"))


def span_depths(spans: DataFrame) -> DataFrame:
    """(span_id, depth) of a forest given by parent_span_id, roots at 0; spans without a path to a root are left out.

    Pointer doubling over written tables: after t rounds a row (span_id, up, depth) has gone 2**t steps up, or to its root,
    where up is null. No path is longer than the number of spans, so what has gone further goes round a cycle."""
    paths = written(spans.select("span_id", F.col("parent_span_id").alias("up"), F.when(F.col("parent_span_id").isNull(), 0).otherwise(1).cast("bigint").alias("depth")))
    n, steps = paths.count(), 1
    while steps <= n and not paths.filter("up IS NOT NULL").isEmpty():
        open_, above = paths.filter("up IS NOT NULL"), paths.select(F.col("span_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        paths = written(paths.filter("up IS NULL").unionByName(open_.join(above, "up").select("span_id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))))
        steps *= 2
    return paths.filter("up IS NULL").select("span_id", "depth")


def failure_runs(events: DataFrame) -> DataFrame:
    """Runs of consecutive errors of each client (gaps and islands)."""
    w = W.partitionBy("client_id").orderBy("ts", "event_id")
    failed = F.col("severity") == "error"
    marked = events.withColumn("island", F.sum(F.when(failed, 0).otherwise(1)).over(w)).filter(failed)
    return marked.groupBy("client_id", "island").agg(F.count(F.lit(1)).alias("run"))


def hit_rates(events: DataFrame, hit: Column, *keys: str) -> DataFrame:
    """Hits, misses and hits / (hits + misses), 0 without any."""
    out = events.groupBy(*keys).agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"))
    return out.withColumn("rate", F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0)))
