"""Preference data from rankings, corrections and labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import written


def triplets_from_scores(scores: DataFrame) -> DataFrame:
    """group_id, idx, score -> the winner against every other member, with the tier of the difference."""
    w = W.partitionBy("group_id").orderBy(F.desc("score"), "idx")
    out = scores.withColumn("rn", F.row_number().over(w)).withColumn("x", F.first(F.struct("idx", "score")).over(w)).filter("rn > 1")
    diff = F.col("x.score") - F.col("score")
    return out.select("group_id", F.col("x.idx").alias("chosen"), F.col("idx").alias("rejected"), diff.alias("diff"), X.quality_tier(diff).alias("quality"), X.tier_confidence(diff).alias("confidence"))


def rejection_reason(min_confidence: float = 0.6, most: int = 50) -> Column:
    """The first reason to leave a triplet out of training, or null."""
    return F.when(F.col("confidence") < min_confidence, "confidence").when(F.col("n_chosen") > most, "chosen too long").when(F.col("n_rejected") > most, "rejected too long")


def train_eval_split(rows: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """part: train for exactly floor(n * share) rows, in the order of a hash of the key; rows of one key may part at the cut.

    Rows are range-partitioned by the hash and written with their numbers; the count of each partition tells where the cut lies.
    """
    hashed = rows.withColumn("_h", F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(seed))))
    placed = written(hashed.repartitionByRange("_h").sortWithinPartitions("_h").withColumn("_at", F.monotonically_increasing_id()))
    counts = sorted(tuple(r) for r in placed.groupBy(F.shiftrightunsigned("_at", 33)).agg(F.count(F.lit(1))).collect())  # a row for each partition
    left, cut = int(sum(n for _, n in counts) * share), 0
    for part, n in counts:
        if left <= n:
            cut = (part << 33) + left
            break
        left -= n
    return placed.withColumn("part", F.when(F.col("_at") < cut, "train").otherwise("eval")).drop("_h", "_at")


def correction_status(attempts: DataFrame) -> DataFrame:
    """trajectory_id, attempt, failures (their number) -> status and attempts used, of at most three: success at the first attempt without failures, partial if there are fewer than at first, else failed."""
    g = attempts.filter("attempt <= 3").groupBy("trajectory_id").agg(
        F.min(F.when(F.col("failures") == 0, F.col("attempt"))).alias("solved"),
        F.min_by("failures", "attempt").alias("first"),
        F.max_by("failures", "attempt").alias("last"),
        F.max("attempt").alias("used"),
    )
    status = F.when(F.col("solved").isNotNull(), "success").when(F.col("last") < F.col("first"), "partial").otherwise("failed")
    return g.select("trajectory_id", status.alias("status"), F.coalesce("solved", "used").alias("attempts"))


def correction_statistics(status: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    good = F.count_if(F.col("status").isin("success", "partial"))
    return status.agg(n.alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("success", "partial", "failed")), F.coalesce(F.try_divide(good, n), F.lit(0.0)).alias("success_rate"), F.coalesce(F.avg("attempts"), F.lit(0.0)).alias("mean_attempts"))


def slime_rows(triplets: DataFrame) -> DataFrame:
    """Trainer rows: chosen and rejected as text, with scores c and 1 - c."""
    return triplets.select(F.col("prompt"), X.messages_to_text("chosen").alias("chosen"), X.messages_to_text("rejected").alias("rejected"), F.col("confidence").alias("chosen_score"), (1 - F.col("confidence")).alias("rejected_score"))


def dpo_rows(pairs: DataFrame) -> DataFrame:
    """Preference pairs as text: prompt, chosen and rejected, beside whatever else a row has."""
    return pairs.withColumns({"chosen": X.messages_to_text("chosen"), "rejected": X.messages_to_text("rejected")})


def columnar_rows(triplets: DataFrame) -> DataFrame:
    """The columns prompt, chosen and rejected, for a columnar file."""
    return dpo_rows(triplets).select("prompt", "chosen", "rejected")


def shadow_loop(prompts: DataFrame, key: str, respond: Callable[[Column, Column], Column], scorer: Callable[[Column, Column], Column], n: int, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """n variations of each prompt at evenly spaced temperatures: respond(i, prompt) is a variation's response, scorer(response, temperature) its score; the best one, the first of equals."""
    v = prompts.select(key, "prompt", F.posexplode(X.sweep(low, high, n)).alias("i", "temperature")).withColumn("response", respond(F.col("i"), F.col("prompt")))
    v = v.withColumn("score", scorer(F.col("response"), F.col("temperature"))).withColumn("best", F.col("i").cast("bigint"))
    x = F.max_by(F.struct("best", "temperature", "score", "response"), F.struct("score", -F.col("best")))
    return v.groupBy(key).agg(x.alias("x")).select(key, "x.*")


def agent_steps(conversations: DataFrame, most: int) -> DataFrame:
    """conv_id, slot, step, role, content: the assistant's turns as steps, `most` at most and one that answers (the last turn, where there are more), after as many empty slots (step -1) as fill most + 1. Conversations without such turns have none."""
    turns = F.filter("messages", lambda m: m["role"] == "assistant")
    kept = F.when(F.size(turns) <= most + 1, turns).otherwise(F.concat(F.slice(turns, 1, most), F.slice(turns, -1, 1)))
    steps = F.transform(kept, lambda m, i: F.struct(i.alias("step"), m["role"].alias("role"), m["content"].alias("content")))
    empty = F.struct(F.lit(-1).alias("step"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("content"))
    padded = F.concat(F.array_repeat(empty, F.lit(most + 1) - F.size(kept)), steps)
    return conversations.filter(F.size(turns) > 0).select("conv_id", F.posexplode(padded).alias("slot", "s")).select("conv_id", "slot", "s.*")


def generation(prompt_tokens: Column, context: int, new_tokens: int, finish: Column, index: Column, group: int) -> Column:
    """struct(budget, status, greedy) of one generation: what fits the context, truncated at once if that is 100 tokens or fewer, else by the reason of its end; the first of a group is drawn greedily."""
    budget = F.least(F.lit(new_tokens), context - prompt_tokens).cast("bigint")
    status = F.when(budget <= 100, "truncated").otherwise(F.when(finish == "length", "truncated").when(finish == "abort", "aborted").when(finish == "stop", "completed"))
    return F.struct(budget.alias("budget"), status.alias("status"), (F.lit(group > 1) & (index % group == 0)).alias("greedy"))


def judge_training_rows(agreed: DataFrame, min_confidence: float = 0.7, limit: int = 10_000) -> DataFrame:
    """Comparisons with a clear winner, chosen and rejected in its order; the surest first."""
    kept = agreed.filter((F.col("confidence") >= min_confidence) & F.col("winner").isin("a", "b"))
    a, b = F.concat(F.col("comparison_id").cast("string"), F.lit("_a")), F.concat(F.col("comparison_id").cast("string"), F.lit("_b"))
    won = F.col("winner") == "a"
    out = kept.select("comparison_id", F.when(won, a).otherwise(b).alias("chosen"), F.when(won, b).otherwise(a).alias("rejected"), "winner", "confidence")
    return out.orderBy(F.desc("confidence"), "comparison_id").limit(limit)


def export(rows: DataFrame, path: str, kind: str) -> None:
    """Writes rows as jsonl, parquet or text lines."""
    if kind == "jsonl":
        rows.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    elif kind in ("parquet", "orc", "csv"):
        getattr(rows.write, kind)(path)
    else:
        raise ValueError(f"unknown format {kind!r}")
