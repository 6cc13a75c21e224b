"""Ranking of groups of candidates: duels, rewards and tournament topologies as joins and windows.

Players are rows (group_id, idx, strength); idx 0 is the anchor. A duel table has both sides' scores. All windows are
partitioned by the group, whose size is that of a rollout group and does not grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FLOOR, NEUTRAL, GATE_FLOOR, GATE_BONUS = -1.0, 5.0, -10.0, 1.0


# ---- rewards -----------------------------------------------------------------------------------------------------------


def competition_rank(score: Column, *group: str) -> Column:
    """Rank 1 for the highest score; ties share the smallest rank."""
    return F.rank().over(W.partitionBy(*group).orderBy(score.desc())).cast("bigint")


def rank_reward(rank: str, *group: str) -> Column:
    """Ranks mapped to [0, 1]; all 0 if there is one rank only."""
    top = F.max(rank).over(W.partitionBy(*group))
    return F.when(top == 1, 0.0).otherwise((top - F.col(rank)) / (top - 1))


def zscore(value: str, *group: str) -> Column:
    """(x - mean) / (sample standard deviation + 1e-6); null for a group of one."""
    w = W.partitionBy(*group)
    return (F.col(value) - F.avg(value).over(w)) / (F.stddev_samp(value).over(w) + 1e-6)


def positional_reward(order: list[Column], *group: str) -> Column:
    """1 for the first, 0 for the last, evenly spaced."""
    w = W.partitionBy(*group)
    return 1 - (F.row_number().over(w.orderBy(*order)) - 1) / (F.count(F.lit(1)).over(w) - 1)


def with_rewards(scores: DataFrame) -> DataFrame:
    """group_id, idx, score -> rank, reward and z."""
    out = scores.withColumn("rank", competition_rank(F.col("score"), "group_id"))
    out = out.withColumn("reward", rank_reward("rank", "group_id"))
    return out.withColumn("z", zscore("reward", "group_id"))


# ---- duels -------------------------------------------------------------------------------------------------------------


def all_pairs(players: DataFrame) -> DataFrame:
    """Unordered pairs a < b within each group."""
    a = players.select("group_id", F.col("idx").alias("a"), F.col("strength").alias("sa"))
    b = players.select("group_id", F.col("idx").alias("b"), F.col("strength").alias("sb"))
    return a.join(b, "group_id").filter("a < b")


def anchor_pairs(players: DataFrame) -> DataFrame:
    """Every other player (side a) against the anchor (side b)."""
    a = players.filter("idx > 0").select("group_id", F.col("idx").alias("a"), F.col("strength").alias("sa"))
    b = players.filter("idx = 0").select("group_id", F.col("idx").alias("b"), F.col("strength").alias("sb"))
    return a.join(b, "group_id")


def one_way(pairs: DataFrame) -> DataFrame:
    """A judge that adds 1 for the side shown first and answers 0 to 10; no answer is neutral on both sides."""
    known = F.col("sa").isNotNull() & F.col("sb").isNotNull()
    first = F.when(known, F.least(F.col("sa") + 1, F.lit(10)).cast("double")).otherwise(NEUTRAL)
    second = F.when(known, F.least(F.col("sb"), F.lit(10)).cast("double")).otherwise(NEUTRAL)
    return pairs.withColumn("score_a", first).withColumn("score_b", second)


def bidirectional(pairs: DataFrame) -> DataFrame:
    """Both orders of each pair judged and added up by side."""
    there = one_way(pairs)
    back = one_way(pairs.select("group_id", F.col("b").alias("a"), F.col("sb").alias("sa"), F.col("a").alias("b"), F.col("sa").alias("sb")))
    both = there.select("group_id", "a", "b", "score_a", "score_b").unionByName(back.select("group_id", F.col("b").alias("a"), F.col("a").alias("b"), F.col("score_b").alias("score_a"), F.col("score_a").alias("score_b")))
    return both.groupBy("group_id", "a", "b").agg(F.sum("score_a").alias("score_a"), F.sum("score_b").alias("score_b"))


def duel(pairs: DataFrame) -> DataFrame:
    """bidirectional() in one projection: both orders are functions of the same row, so no shuffle is needed."""
    ten = F.lit(10)
    one = lambda own, other: F.when(F.col(own).isNotNull() & F.col(other).isNotNull(), (F.least(F.col(own) + 1, ten) + F.least(F.col(own), ten)).cast("double")).otherwise(2 * NEUTRAL)
    return pairs.withColumn("score_a", one("sa", "sb")).withColumn("score_b", one("sb", "sa"))


# ---- topologies --------------------------------------------------------------------------------------------------------


def anchor_scores(players: DataFrame) -> DataFrame:
    """Each player's duel score against the anchor; the anchor's is the mean of its sides."""
    d = duel(anchor_pairs(players))
    rest = d.select("group_id", F.col("a").alias("idx"), F.col("score_a").alias("score"))
    anchor = d.groupBy("group_id").agg(F.avg("score_b").alias("score")).select("group_id", F.lit(0).cast("bigint").alias("idx"), "score")
    return rest.unionByName(anchor)


def sides(duels: DataFrame) -> DataFrame:
    """One row for each side of a duel: group_id, idx, own, other."""
    side = F.explode(F.array(F.struct(F.col("a").alias("idx"), F.col("score_a").alias("own"), F.col("score_b").alias("other")), F.struct(F.col("b").alias("idx"), F.col("score_b").alias("own"), F.col("score_a").alias("other"))))
    return duels.select("group_id", side.alias("s")).select("group_id", "s.*")


def round_robin_scores(players: DataFrame) -> DataFrame:
    """Wins over all pairs; a tie is half a win for each side."""
    won = F.when(F.col("own") > F.col("other"), 1.0).when(F.col("own") == F.col("other"), 0.5).otherwise(0.0)
    return sides(duel(all_pairs(players))).groupBy("group_id", "idx").agg(F.sum(won).alias("score"))


def arena_scores(players: DataFrame, valid: Column, floor: float = FLOOR) -> DataFrame:
    """Mean of a valid player's own scores over all pairs of valid players; a lone valid player has 1, others the floor."""
    kept = players.filter(valid)
    mean = sides(duel(all_pairs(kept))).groupBy("group_id", "idx").agg(F.avg("own").alias("mean"))
    out = players.withColumn("valid", valid).join(mean, ["group_id", "idx"], "left")
    score = F.when(~F.col("valid"), floor).otherwise(F.coalesce("mean", F.lit(1.0)))
    return out.select("group_id", "idx", "valid", score.alias("score"))


def lightning_scores(players: DataFrame, budget: int) -> DataFrame:
    """Anchor against the others in order, `budget` duels at most: the anchor gathers its share s of each, the other 1 - s; then scores over the largest."""
    d = duel(anchor_pairs(players)).filter(F.col("a") <= budget)
    share = F.col("score_b") / (F.col("score_a") + F.col("score_b"))
    rest = d.select("group_id", F.col("a").alias("idx"), (1 - share).alias("score"))
    anchor = d.groupBy("group_id").agg(F.sum(share).alias("score")).select("group_id", F.lit(0).cast("bigint").alias("idx"), "score")
    got = players.select("group_id", "idx").join(rest.unionByName(anchor), ["group_id", "idx"], "left").fillna(0.0, ["score"])
    return got.withColumn("normal", F.col("score") / F.greatest(F.max("score").over(W.partitionBy("group_id")), F.lit(1e-6)))


def verified_anchor(players: DataFrame, valid: Column, floor: float = FLOOR) -> DataFrame:
    """The anchor tournament among valid players; others get the floor; a lone valid player gets 1."""
    w = W.partitionBy("group_id")
    marked = players.withColumn("valid", valid)
    fit = marked.filter("valid").withColumn("seat", (F.row_number().over(w.orderBy("idx")) - 1).cast("bigint")).withColumn("n", F.count(F.lit(1)).over(w))
    seats = fit.filter("n > 1").select("group_id", F.col("seat").alias("idx"), "strength")
    z = with_rewards(anchor_scores(seats)).select("group_id", F.col("idx").alias("seat"), "z")
    inner = fit.join(z, ["group_id", "seat"], "left").select("group_id", "idx", F.coalesce("z", F.lit(1.0)).alias("reward"))
    return marked.join(inner, ["group_id", "idx"], "left").select("group_id", "idx", "valid", F.coalesce("reward", F.lit(floor)).alias("reward"))


def gated(duels: DataFrame) -> DataFrame:
    """Duels gated by verification (ok_a, ok_b, mod_a, mod_b): both fail: floors; one fails: floor against bonus; else scores times modifiers."""
    a, b = F.col("ok_a"), F.col("ok_b")
    side = lambda own, other, score, mod: F.when(~own, GATE_FLOOR).when(~other, GATE_BONUS).otherwise(F.col(score) * F.col(mod))
    return duels.withColumn("gated_a", side(a, b, "score_a", "mod_a")).withColumn("gated_b", side(b, a, "score_b", "mod_b"))


# ---- topologies with state ---------------------------------------------------------------------------------------------
# Bracket play decides each round's pairs from the last one's results. Groups are small and hold only (idx, strength), so a group
# is played in one call. Random orders are replaced by an order on a hash of (seed, group, round, idx), the same on any cluster.


def _order(seed: int, group, round_: int, idx: list[int]) -> list[int]:
    import hashlib

    return sorted(idx, key=lambda i: hashlib.md5(f"{seed}:{group}:{round_}:{i}".encode()).hexdigest())


def _beats(s: dict[int, float], a: int, b: int) -> tuple[float, float]:
    top = lambda x: min(x + 1, 10) + min(x, 10)
    return float(top(s[a])), float(top(s[b]))


def swiss_group(s: dict[int, float], group=0, seed: int = 0, rounds: int | None = None) -> list[tuple[int, float, float]]:
    """(idx, points, buchholz) after min(ceil(log2 n), n - 1) rounds: players of like points meet, rematches only if there is nobody else, an odd one gets a point."""
    n = len(s)
    rounds = min(rounds or max(1, (n - 1).bit_length()), n - 1)
    points, met = {i: 0.0 for i in s}, {i: set() for i in s}
    for r in range(rounds):
        line = sorted(_order(seed, group, r, list(s)), key=lambda i: -points[i])
        while len(line) > 1:
            a = line.pop(0)
            b = next((x for x in line if x not in met[a]), line[0])
            line.remove(b)
            x, y = _beats(s, a, b)
            points[a] += 1.0 if x > y else 0.5 if x == y else 0.0
            points[b] += 1.0 if y > x else 0.5 if x == y else 0.0
            met[a].add(b)
            met[b].add(a)
        if line:
            points[line[0]] += 1.0
    return [(i, points[i], sum(points[j] for j in met[i])) for i in s]


def fold_seeds(n: int) -> list[int]:
    """Bracket slots by seed for n players: 1 meets the last, and so on, down to pairs; byes left out."""
    slots, size = [0], 1
    while size < n:
        size *= 2
        slots = [x for i in slots for x in (i, size - 1 - i)]
    return [i for i in slots if i < n]


class _Record:
    def __init__(self, s):
        self.points = {i: [] for i in s}
        self.out: list[list[int]] = []

    def play(self, s, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the first listed wins ties."""
        x, y = _beats(s, a, b)
        self.points[a].append(x)
        self.points[b].append(y)
        return (a, b) if x >= y else (b, a)

    def mean(self, i: int) -> float:
        return sum(self.points[i]) / len(self.points[i]) if self.points[i] else 0.0

    def ranked(self, champion: int) -> list[int]:
        """The champion, then the latest out first; within a round by mean points."""
        return [champion] + [i for lost in reversed(self.out) for i in sorted(lost, key=lambda i: -self.mean(i))]


def single_elimination_group(s: dict[int, float], group=0, seed: int = 0) -> list[int]:
    """Final order of a bracket seeded by duels with the anchor."""
    rec = _Record(s)
    others = [i for i in s if i != 0]
    seeding = {i: _beats(s, i, 0)[0] for i in others}
    seeding[0] = sum(_beats(s, i, 0)[1] for i in others) / len(others)
    line = sorted(s, key=lambda i: (-seeding[i], i))
    line = [line[k] for k in fold_seeds(len(line))]
    while len(line) > 1:
        nxt, lost = ([line[0]] if len(line) % 2 else []), []
        rest = line[len(line) % 2 :]
        for a, b in zip(rest[::2], rest[1::2], strict=True):
            w, x = rec.play(s, a, b)
            nxt.append(w)
            lost.append(x)
        rec.out.append(lost)
        line = nxt
    return rec.ranked(line[0])


def double_elimination_group(s: dict[int, float], group=0, seed: int = 0) -> list[int]:
    """Final order after a winners' bracket, a losers' bracket fed round by round, and one final."""
    rec, turn = _Record(s), 0

    def play_round(line: list[int]) -> tuple[list[int], list[int]]:
        nonlocal turn
        line = _order(seed, group, turn, line)
        turn += 1
        won, lost = [], []
        for a, b in zip(line[::2], line[1::2], strict=False):
            w, x = rec.play(s, a, b)
            won.append(w)
            lost.append(x)
        return won + (line[-1:] if len(line) % 2 else []), lost

    winners, fed = list(s), []
    while len(winners) > 1:
        winners, lost = play_round(winners)
        fed.append(lost)
    losers: list[int] = []
    for lost in fed:
        losers += lost
        if len(losers) >= 2:
            losers, gone = play_round(losers)
            rec.out.append(gone)
    while len(losers) > 1:
        losers, gone = play_round(losers)
        rec.out.append(gone)
    if not losers:
        return rec.ranked(winners[0])
    w, x = rec.play(s, winners[0], losers[0])
    rec.out.append([x])
    return rec.ranked(w)


def _played(players: DataFrame, play, schema: str) -> DataFrame:
    import pandas as pd

    names = [x.split()[0] for x in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        s = dict(zip(pdf["idx"].tolist(), pdf["strength"].tolist(), strict=True))
        group = pdf["group_id"].iloc[0]
        return pd.DataFrame([(group, *row) for row in play(s, group)], columns=names)

    return players.select("group_id", "idx", "strength").groupBy("group_id").applyInPandas(run, schema)


def swiss(players: DataFrame, seed: int = 0) -> DataFrame:
    """Swiss rounds; players equal in points and buchholz share the mean of their positions' rewards; z over the group."""
    got = _played(players, lambda s, g: swiss_group(s, g, seed), "group_id bigint, idx bigint, points double, buchholz double")
    w = W.partitionBy("group_id")
    own = 1 - (F.row_number().over(w.orderBy(F.desc("points"), F.desc("buchholz"), "idx")) - 1) / (F.count(F.lit(1)).over(w) - 1)
    got = got.withColumn("place", own)
    return got.withColumn("reward", F.avg("place").over(W.partitionBy("group_id", "points", "buchholz"))).drop("place").withColumn("z", zscore("reward", "group_id"))


def elimination(players: DataFrame, double: bool = False, seed: int = 0) -> DataFrame:
    """Final places, positional rewards and z of a single or double elimination."""
    play = double_elimination_group if double else single_elimination_group
    got = _played(players, lambda s, g: [(i, k) for k, i in enumerate(play(s, g, seed), 1)], "group_id bigint, idx bigint, place bigint")
    got = got.withColumn("reward", positional_reward([F.col("place")], "group_id"))
    return got.withColumn("z", zscore("reward", "group_id"))
