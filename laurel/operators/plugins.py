"""Extension points: judges, rewards and verification plugins, found by name in the registries, and what runs them.

A judge turns pairs into pairs with score_a and score_b; a reward turns scores (group_id, idx, score) into rows with a reward; a plugin turns
messages (traj_id, message_index, role, content) into verdict rows. Metrics, scorers, predictors and handlers are functions of columns
that return a column, and are given to the operators that call them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stores import JUDGES, PLUGINS, REWARDS
from . import configs as C
from . import documents as P
from . import scanners as S
from . import schemas as J
from . import verify as V

Plugin = Callable[[DataFrame], DataFrame]
_VERDICT = ["traj_id", "plugin", "status", "message", "modifier"]


@PLUGINS.register("safety_filter")
def safety_filter(messages: DataFrame) -> DataFrame:
    return S.safety(messages)


@PLUGINS.register("code_linter")
def code_linter(messages: DataFrame) -> DataFrame:
    by_message = messages.select(F.struct("traj_id", "message_index").alias("id"), "content")
    found = P.lint(by_message, "content").groupBy("id.traj_id").agg(F.count_if(F.col("status") == "failed").alias("bad"), F.count_if(F.col("status") == "passed").alias("good"))
    status = F.when(F.col("bad") > 0, "failed").when(F.col("good") > 0, "passed").otherwise("skipped")
    return found.select("traj_id", F.lit("code_linter").alias("plugin"), status.alias("status"), F.concat(F.col("bad").cast("string"), F.lit(" do not parse")).alias("message"), F.when(F.col("bad") > 0, 0.0).otherwise(1.0).alias("modifier"))


@PLUGINS.register("edge")
def edge(messages: DataFrame) -> DataFrame:
    e = S.edge(messages)
    return e.select("traj_id", F.lit("edge").alias("plugin"), F.when(F.col("passed"), "passed").otherwise("failed").alias("status"), F.coalesce("reason", F.concat(F.col("n_warnings").cast("string"), F.lit(" warnings"))).alias("message"), F.when(F.col("passed"), 1.0).otherwise(0.0).alias("modifier"))


@PLUGINS.register("json_schema")
def json_schema(messages: DataFrame) -> DataFrame:
    """Fenced blocks of JSON parse; a schema is given by an extra plugin made of `schemas.schema_verdicts`."""
    return J.schema_verdicts(messages)


@PLUGINS.register("policy")
def policy(messages: DataFrame) -> DataFrame:
    return C.message_policy(messages)


def verified(messages: DataFrame, names: list[str], skip: dict[str, Column] | None = None, extra: dict[str, Plugin] | None = None) -> DataFrame:
    """Verdict rows of the plugins named, `extra` ones first of their name. Trajectories for which `skip[name]` is true for every message give no row of that plugin.

    A plugin that is unknown or whose call raises gives rows of status error. That is the planning of its rows (and what it runs while planning); an error in a task of the job
    that reads the verdicts stops that job, as it does anywhere.
    """
    out = None
    for name in names:
        rows = messages
        if skip and name in skip:
            rows = messages.join(messages.groupBy("traj_id").agg(F.bool_and(skip[name]).alias("skipped")).filter("NOT skipped").select("traj_id"), "traj_id", "left_semi")
        try:
            found = ((extra or {}).get(name) or PLUGINS[name])(rows)
        except Exception as e:  # noqa: BLE001  whatever a plugin raises becomes its verdict
            said = f"{type(e).__name__}: {e}".splitlines()[0][:200]
            found = rows.select("traj_id").distinct().select("traj_id", F.lit(name).alias("plugin"), F.lit("error").alias("status"), F.lit(said).alias("message"), F.lit(1.0).alias("modifier"))
        found = found.select(*_VERDICT)
        out = found if out is None else out.unionByName(found)
    return out


def composite(messages: DataFrame, names: list[str], **how) -> DataFrame:
    """The verdicts of several plugins together, one row for each trajectory."""
    return V.verdicts(verified(messages, names, **how))


# ---- judges and rewards ------------------------------------------------------------------------------------------------


@JUDGES.register("length")
def by_length(pairs: DataFrame) -> DataFrame:
    """Longer answers are better, but for 500 characters less if they speak of an error."""
    value = lambda c: F.length(c) - F.when(F.contains(F.lower(c), F.lit("error")), 500).otherwise(0)
    return pairs.withColumns({"score_a": value(F.coalesce("answer_a", F.lit(""))).cast("double"), "score_b": value(F.coalesce("answer_b", F.lit(""))).cast("double")})


def judged(pairs: DataFrame, judge: str, both_ways: bool = True) -> DataFrame:
    """Pairs (pair_id, answer_a, answer_b) with the scores of a judge; both ways: the sum of its scores for the pair and for the pair turned round."""
    ask = JUDGES[judge]
    there = ask(pairs).select("pair_id", "score_a", "score_b")
    if not both_ways:
        return there
    turned = pairs.withColumns({"answer_a": F.col("answer_b"), "answer_b": F.col("answer_a")})
    back = ask(turned).select("pair_id", F.col("score_b").alias("score_a"), F.col("score_a").alias("score_b"))
    return there.unionByName(back).groupBy("pair_id").agg(F.sum("score_a").alias("score_a"), F.sum("score_b").alias("score_b"))


@REWARDS.register("rank")
def rank_reward(scores: DataFrame) -> DataFrame:
    """1 for the best of a group down to 0 for the last; ties share the best rank."""
    n = F.count(F.lit(1)).over(W.partitionBy("group_id"))
    rank = F.rank().over(W.partitionBy("group_id").orderBy(F.desc("score")))
    return scores.withColumn("reward", F.when(n > 1, (n - rank) / (n - 1)).otherwise(1.0))


@REWARDS.register("zscore")
def zscore_reward(scores: DataFrame) -> DataFrame:
    w = W.partitionBy("group_id")
    sd = F.stddev_pop("score").over(w)
    return scores.withColumn("reward", F.when(sd > 0, (F.col("score") - F.avg("score").over(w)) / sd).otherwise(0.0))


def rewarded(scores: DataFrame, name: str, valid: Column | None = None, floor: float = -1.0) -> DataFrame:
    """Scores with a registered reward; members that are not valid take no part and get the floor."""
    if valid is None:
        return REWARDS[name](scores)
    good = REWARDS[name](scores.filter(valid)).select("group_id", "idx", "reward")
    return scores.join(good, ["group_id", "idx"], "left").withColumn("reward", F.coalesce("reward", F.lit(floor)))


def scalar_rewarded(rows: DataFrame, reward: Column, valid: Column | None = None, floor: float = -1.0) -> DataFrame:
    """Rows with a reward of their own; rows that are not valid, or whose reward is null, get the floor."""
    ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    return rows.withColumn("reward", F.coalesce(F.when(ok, reward), F.lit(floor)))
