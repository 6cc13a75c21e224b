"""Queries over rankings, rewards and tournaments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import ranking as R
from ..sources.tables import PLAYERS_SQL, players
from .registry import query

#: Twice the judge's answer for a side, as both orders add up.
_TWO = "(least({0} + 1, 10) + least({0}, 10))"
_PAIRS = PLAYERS_SQL + """,
pairs AS (SELECT a.group_id, a.idx AS a, b.idx AS b, CAST(least(a.strength + 1, 10) + least(a.strength, 10) AS DOUBLE) AS score_a, CAST(least(b.strength + 1, 10) + least(b.strength, 10) AS DOUBLE) AS score_b
  FROM players a JOIN players b ON a.group_id = b.group_id AND a.idx < b.idx)"""
_ANCHOR = """duels AS (SELECT a.group_id, a.idx, CAST(least(a.strength + 1, 10) + least(a.strength, 10) AS DOUBLE) AS own, CAST(least(b.strength + 1, 10) + least(b.strength, 10) AS DOUBLE) AS other
  FROM {0} a JOIN {0} b ON a.group_id = b.group_id AND a.idx > 0 AND b.idx = 0),
scores AS (SELECT group_id, idx, own AS score FROM duels UNION ALL SELECT group_id, 0, avg(other) FROM duels GROUP BY group_id)"""
_REWARDS = """ranked AS (SELECT *, rank() OVER (PARTITION BY group_id ORDER BY score DESC) AS rank FROM scores),
rewarded AS (SELECT *, CASE WHEN max(rank) OVER (PARTITION BY group_id) = 1 THEN 0.0 ELSE (max(rank) OVER (PARTITION BY group_id) - rank) / CAST(max(rank) OVER (PARTITION BY group_id) - 1 AS DOUBLE) END AS reward FROM ranked),
final AS (SELECT *, (reward - avg(reward) OVER (PARTITION BY group_id)) / (stddev_samp(reward) OVER (PARTITION BY group_id) + 1e-6) AS z FROM rewarded)"""
_OUT = "SELECT group_id, idx, round(score, 6) AS score, rank, round(reward, 6) AS reward, round(z, 6) AS z FROM final"


def _out(df: DataFrame) -> DataFrame:
    return df.select("group_id", "idx", F.round("score", 6).alias("score"), "rank", F.round("reward", 6).alias("reward"), F.round("z", 6).alias("z"))


@query("trn02_anchor", f"{PLAYERS_SQL}, {_ANCHOR.format('players')}, {_REWARDS} {_OUT}")
def anchor(spark: SparkSession, d: str) -> DataFrame:
    return _out(R.with_rewards(R.anchor_scores(players(spark, d))))


@query("trn01_round_robin", f"{_PAIRS}, sides AS (SELECT group_id, a AS idx, score_a AS own, score_b AS other FROM pairs UNION ALL SELECT group_id, b, score_b, score_a FROM pairs), scores AS (SELECT group_id, idx, sum(CASE WHEN own > other THEN 1e0 WHEN own = other THEN 0.5e0 ELSE 0e0 END) AS score FROM sides GROUP BY 1, 2), {_REWARDS} {_OUT}")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    return _out(R.with_rewards(R.round_robin_scores(players(spark, d))))


@query("join03_all_pairs", f"{_PAIRS} SELECT group_id, a, b, score_a, score_b FROM pairs")
def all_pairs(spark: SparkSession, d: str) -> DataFrame:
    return R.duel(R.all_pairs(players(spark, d))).select("group_id", "a", "b", "score_a", "score_b")


@query("join04_anchor_pairs", f"{PLAYERS_SQL}, {_ANCHOR.format('players')} SELECT group_id, idx AS a, CAST(0 AS BIGINT) AS b, own AS score_a, other AS score_b FROM duels")
def anchor_pairs(spark: SparkSession, d: str) -> DataFrame:
    return R.duel(R.anchor_pairs(players(spark, d))).select("group_id", "a", "b", "score_a", "score_b")


@query("trn09_bidirectional", f"{PLAYERS_SQL}, one AS (SELECT x.group_id, x.idx AS p, y.idx AS q, CAST(least(x.strength + 1, 10) AS DOUBLE) AS sp, CAST(least(y.strength, 10) AS DOUBLE) AS sq FROM players x JOIN players y ON x.group_id = y.group_id AND x.idx <> y.idx) SELECT u.group_id, u.p AS a, u.q AS b, u.sp + v.sq AS score_a, u.sq + v.sp AS score_b FROM one u JOIN one v ON u.group_id = v.group_id AND u.p = v.q AND u.q = v.p WHERE u.p < u.q")
def bidirectional(spark: SparkSession, d: str) -> DataFrame:
    return R.bidirectional(R.all_pairs(players(spark, d)))


@query("trn13_one_way_judge", f"{PLAYERS_SQL} SELECT a.group_id, a.idx AS a, CASE WHEN a.toxic = 1 THEN 5.0 ELSE CAST(least(a.strength + 1, 10) AS DOUBLE) END AS score_a, CASE WHEN a.toxic = 1 THEN 5.0 ELSE CAST(least(b.strength, 10) AS DOUBLE) END AS score_b FROM players a JOIN players b ON a.group_id = b.group_id AND a.idx > 0 AND b.idx = 0")
def one_way(spark: SparkSession, d: str) -> DataFrame:
    """Candidates marked toxic get no answer from the judge, hence the neutral score."""
    p = players(spark, d)
    p = p.withColumn("strength", F.when((F.col("toxic") == 0) | (F.col("idx") == 0), F.col("strength")))
    return R.one_way(R.anchor_pairs(p)).select("group_id", "a", "score_a", "score_b")


@query("trn08_shadow_arena", f"""{PLAYERS_SQL}, ok AS (SELECT * FROM players WHERE toxic = 0 AND quality = 1),
pairs AS (SELECT a.group_id, a.idx AS a, b.idx AS b, least(a.strength + 1, 10) + least(a.strength, 10) AS score_a, least(b.strength + 1, 10) + least(b.strength, 10) AS score_b FROM ok a JOIN ok b ON a.group_id = b.group_id AND a.idx < b.idx),
m AS (SELECT group_id, idx, avg(own) AS mean FROM (SELECT group_id, a AS idx, score_a AS own FROM pairs UNION ALL SELECT group_id, b, score_b FROM pairs) GROUP BY 1, 2)
SELECT p.group_id, p.idx, p.toxic = 0 AND p.quality = 1 AS valid, CASE WHEN NOT (p.toxic = 0 AND p.quality = 1) THEN -1.0 ELSE round(coalesce(mean, 1.0), 6) END AS score FROM players p LEFT JOIN m USING (group_id, idx)""")
def arena(spark: SparkSession, d: str) -> DataFrame:
    out = R.arena_scores(players(spark, d), (F.col("toxic") == 0) & (F.col("quality") == 1))
    return out.withColumn("score", F.round("score", 6))


@query("trn07_lightning", f"""{PLAYERS_SQL}, {_ANCHOR.format('players')}, used AS (SELECT *, other / (own + other) AS share FROM duels WHERE idx <= 5),
got AS (SELECT group_id, idx, 1 - share AS score FROM used UNION ALL SELECT group_id, 0, sum(share) FROM used GROUP BY 1),
s AS (SELECT p.group_id, p.idx, coalesce(score, 0.0) AS score FROM players p LEFT JOIN got USING (group_id, idx))
SELECT group_id, idx, round(score, 6) AS score, round(score / greatest(max(score) OVER (PARTITION BY group_id), 1e-6), 6) AS normal FROM s""")
def lightning(spark: SparkSession, d: str) -> DataFrame:
    return R.lightning_scores(players(spark, d), 5).select("group_id", "idx", F.round("score", 6).alias("score"), F.round("normal", 6).alias("normal"))


@query("trn06_verified_anchor", f"""{PLAYERS_SQL}, fit AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY idx) - 1 AS seat, count(*) OVER (PARTITION BY group_id) AS n FROM players WHERE toxic = 0 AND quality = 1),
seats AS (SELECT group_id, seat AS idx, strength FROM fit WHERE n > 1), {_ANCHOR.format('seats')}, {_REWARDS}
SELECT p.group_id, p.idx, f.seat IS NOT NULL AS valid, round(CASE WHEN f.seat IS NULL THEN -1.0 ELSE coalesce(z, 1.0) END, 6) AS reward
FROM players p LEFT JOIN fit f ON p.group_id = f.group_id AND p.idx = f.idx LEFT JOIN final x ON f.group_id = x.group_id AND f.seat = x.idx AND f.n > 1""")
def verified(spark: SparkSession, d: str) -> DataFrame:
    out = R.verified_anchor(players(spark, d), (F.col("toxic") == 0) & (F.col("quality") == 1))
    return out.withColumn("reward", F.round("reward", 6))


@query("trn10_gated_compare", f"""{PLAYERS_SQL}, g AS (SELECT a.group_id, a.idx AS a, a.toxic = 0 AS ok_a, b.toxic = 0 AS ok_b, 0.5 + 0.5 * a.quality AS mod_a, 0.5 + 0.5 * b.quality AS mod_b,
least(a.strength + 1, 10) + least(a.strength, 10) AS score_a, least(b.strength + 1, 10) + least(b.strength, 10) AS score_b FROM players a JOIN players b ON a.group_id = b.group_id AND a.idx > 0 AND b.idx = 0)
SELECT group_id, a, CASE WHEN NOT ok_a THEN -10.0 WHEN NOT ok_b THEN 1.0 ELSE CAST(score_a * mod_a AS DOUBLE) END AS gated_a, CASE WHEN NOT ok_b THEN -10.0 WHEN NOT ok_a THEN 1.0 ELSE CAST(score_b * mod_b AS DOUBLE) END AS gated_b FROM g""")
def gated(spark: SparkSession, d: str) -> DataFrame:
    p = players(spark, d)
    own = lambda s: [(F.col("toxic") == 0).alias(f"ok_{s}"), (0.5 + 0.5 * F.col("quality")).alias(f"mod_{s}")]
    duels = R.duel(R.anchor_pairs(p)).join(p.select("group_id", F.col("idx").alias("a"), *own("a")), ["group_id", "a"])
    duels = duels.join(p.filter("idx = 0").select("group_id", *own("b")), "group_id")
    return R.gated(duels).select("group_id", "a", "gated_a", "gated_b")


@query("trn11_group_reward_broadcast", f"{PLAYERS_SQL}, {_ANCHOR.format('players')}, {_REWARDS}, steps AS (SELECT group_id, idx, unnest(range(0, 3)) AS step FROM players) SELECT s.group_id, s.idx, s.step, round(z, 6) AS reward FROM steps s JOIN final USING (group_id, idx)")
def broadcast_reward(spark: SparkSession, d: str) -> DataFrame:
    """A candidate's reward copied to each of its three steps."""
    p = players(spark, d)
    steps = p.select("group_id", "idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("step"))
    z = R.with_rewards(R.anchor_scores(p))
    return steps.join(z, ["group_id", "idx"]).select("group_id", "idx", "step", F.round("z", 6).alias("reward"))


@query("trn12_eval_win_rate", f"{PLAYERS_SQL}, {_ANCHOR.format('players')} SELECT group_id, round(avg(CASE WHEN own > other THEN 1.0 WHEN own < other THEN 0.0 ELSE 0.5 END), 6) AS win_rate FROM duels GROUP BY 1")
def win_rate(spark: SparkSession, d: str) -> DataFrame:
    duels = R.duel(R.anchor_pairs(players(spark, d)))
    won = F.when(F.col("score_a") > F.col("score_b"), 1.0).when(F.col("score_a") < F.col("score_b"), 0.0).otherwise(0.5)
    return duels.groupBy("group_id").agg(F.round(F.avg(won), 6).alias("win_rate"))


@query("win01_competition_rank", f"{PLAYERS_SQL} SELECT group_id, idx, rank() OVER (PARTITION BY group_id ORDER BY strength DESC) AS rank FROM players")
def competition_rank(spark: SparkSession, d: str) -> DataFrame:
    return players(spark, d).select("group_id", "idx", R.competition_rank(F.col("strength"), "group_id").alias("rank"))


@query("win02_rank_reward", f"{PLAYERS_SQL}, r AS (SELECT group_id, idx, rank() OVER (PARTITION BY group_id ORDER BY strength DESC) AS rank FROM players), m AS (SELECT *, max(rank) OVER (PARTITION BY group_id) AS top FROM r) SELECT group_id, idx, CASE WHEN top = 1 THEN 0.0 ELSE round((top - rank) / CAST(top - 1 AS DOUBLE), 6) END AS reward FROM m")
def rank_reward(spark: SparkSession, d: str) -> DataFrame:
    r = players(spark, d).withColumn("rank", R.competition_rank(F.col("strength"), "group_id"))
    return r.select("group_id", "idx", F.round(R.rank_reward("rank", "group_id"), 6).alias("reward"))


@query("win03_group_zscore", f"{PLAYERS_SQL} SELECT group_id, idx, round((strength - avg(strength) OVER w) / (stddev_samp(strength) OVER w + 1e-6), 6) AS z FROM players WINDOW w AS (PARTITION BY group_id)")
def zscore(spark: SparkSession, d: str) -> DataFrame:
    return players(spark, d).select("group_id", "idx", F.round(R.zscore("strength", "group_id"), 6).alias("z"))


@query("win04_positional_reward", f"{PLAYERS_SQL} SELECT group_id, idx, round(1 - (row_number() OVER (PARTITION BY group_id ORDER BY strength DESC, idx) - 1) / CAST(count(*) OVER (PARTITION BY group_id) - 1 AS DOUBLE), 6) AS reward FROM players")
def positional(spark: SparkSession, d: str) -> DataFrame:
    return players(spark, d).select("group_id", "idx", F.round(R.positional_reward([F.desc("strength"), F.col("idx")], "group_id"), 6).alias("reward"))


@query("win05_tie_averaged_reward", f"{PLAYERS_SQL}, p AS (SELECT *, 1 - (row_number() OVER (PARTITION BY group_id ORDER BY strength DESC, idx) - 1) / CAST(count(*) OVER (PARTITION BY group_id) - 1 AS DOUBLE) AS place FROM players) SELECT group_id, idx, round(avg(place) OVER (PARTITION BY group_id, strength), 6) AS reward FROM p")
def tie_averaged(spark: SparkSession, d: str) -> DataFrame:
    p = players(spark, d).withColumn("place", R.positional_reward([F.desc("strength"), F.col("idx")], "group_id"))
    return p.select("group_id", "idx", F.round(F.avg("place").over(W.partitionBy("group_id", "strength")), 6).alias("reward"))


@query("win06_argmax", f"{PLAYERS_SQL} SELECT group_id, arg_max(idx, strength * 1000 - idx) AS idx, max(strength) AS strength FROM players GROUP BY 1")
def argmax(spark: SparkSession, d: str) -> DataFrame:
    best = F.max_by(F.struct("idx", "strength"), F.struct("strength", -F.col("idx")))
    return players(spark, d).groupBy("group_id").agg(best.alias("x")).select("group_id", "x.*")


@query("win07_max_normalised", f"{PLAYERS_SQL}, n AS (SELECT group_id, idx, round(strength / greatest(max(strength) OVER (PARTITION BY group_id), 1e-6), 6) AS normal FROM players) SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY normal DESC, idx) AS place FROM n")
def normalised(spark: SparkSession, d: str) -> DataFrame:
    n = F.round(F.col("strength") / F.greatest(F.max("strength").over(W.partitionBy("group_id")), F.lit(1e-6)), 6)
    out = players(spark, d).select("group_id", "idx", n.alias("normal"))
    return out.withColumn("place", F.row_number().over(W.partitionBy("group_id").orderBy(F.desc("normal"), "idx")).cast("bigint"))


@query("win08_winner_vs_rest", f"{PLAYERS_SQL}, r AS (SELECT *, row_number() OVER w AS rn, first_value(idx) OVER w AS chosen, first_value(strength) OVER w AS top FROM players WINDOW w AS (PARTITION BY group_id ORDER BY strength DESC, idx)) SELECT group_id, chosen, idx AS rejected, top - strength AS diff FROM r WHERE rn > 1")
def winner_vs_rest(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("group_id").orderBy(F.desc("strength"), "idx")
    out = players(spark, d).withColumn("rn", F.row_number().over(w)).withColumn("x", F.first(F.struct("idx", "strength")).over(w))
    return out.filter("rn > 1").select("group_id", F.col("x.idx").alias("chosen"), F.col("idx").alias("rejected"), (F.col("x.strength") - F.col("strength")).alias("diff"))


@query("win10_buchholz", f"{_PAIRS}, sides AS (SELECT group_id, a AS idx, b AS opp, score_a AS own FROM pairs WHERE b - a <= 2 UNION ALL SELECT group_id, b, a, score_b FROM pairs WHERE b - a <= 2), pts AS (SELECT group_id, idx, sum(own) AS points FROM sides GROUP BY 1, 2) SELECT s.group_id, s.idx, sum(p.points) AS buchholz FROM (SELECT DISTINCT group_id, idx, opp FROM sides) s JOIN pts p ON s.group_id = p.group_id AND s.opp = p.idx GROUP BY 1, 2")
def buchholz(spark: SparkSession, d: str) -> DataFrame:
    """The sum of the points of a player's distinct opponents, here those at most two seats away."""
    duels = R.duel(R.all_pairs(players(spark, d))).filter("b - a <= 2")
    side = F.explode(F.array(F.struct(F.col("a").alias("idx"), F.col("b").alias("opp"), F.col("score_a").alias("own")), F.struct(F.col("b").alias("idx"), F.col("a").alias("opp"), F.col("score_b").alias("own"))))
    s = duels.select("group_id", side.alias("s")).select("group_id", "s.*")
    points = s.groupBy("group_id", F.col("idx").alias("opp")).agg(F.sum("own").alias("points"))
    return s.select("group_id", "idx", "opp").distinct().join(points, ["group_id", "opp"]).groupBy("group_id", "idx").agg(F.sum("points").alias("buchholz"))


_TOP = "(least(strength + 1, 10) + least(strength, 10))"
#: One pairing after another, as a recursion over each group: the players still to be paired in this round, everybody's points, and who met whom.
_SWISS_SQL = f"""{PLAYERS_SQL.replace("WITH players", "WITH RECURSIVE players")}, g AS (SELECT group_id, count(*) AS n, list({_TOP} ORDER BY idx) AS top, least(greatest(1, CAST(ceil(log2(count(*))) AS INT)), count(*) - 1) AS rounds FROM players GROUP BY 1),
st AS (SELECT group_id, n, top, rounds, -1 AS r, CAST([] AS BIGINT[]) AS line, list_transform(range(n), lambda i: 0e0) AS points, CAST([] AS BIGINT[]) AS met FROM g
UNION ALL SELECT group_id, n, top, rounds, CASE WHEN pairs THEN r ELSE r + 1 END,
CASE WHEN pairs THEN list_filter(line, lambda x: x <> a AND x <> b) ELSE list_transform(list_sort(list_transform(range(n), lambda i: {{'p': -points2[i + 1], 'h': md5('0:' || group_id || ':' || (r + 1) || ':' || i), 'i': i}})), lambda x: x.i) END,
CASE WHEN pairs THEN list_transform(range(n), lambda i: points[i + 1] + CASE WHEN i = a THEN CASE WHEN top[a + 1] > top[b + 1] THEN 1e0 WHEN top[a + 1] = top[b + 1] THEN 0.5e0 ELSE 0e0 END WHEN i = b THEN CASE WHEN top[b + 1] > top[a + 1] THEN 1e0 WHEN top[a + 1] = top[b + 1] THEN 0.5e0 ELSE 0e0 END ELSE 0e0 END) ELSE points2 END,
CASE WHEN pairs THEN met || [a * 16 + b, b * 16 + a] ELSE met END
FROM (SELECT *, len(line) > 1 AS pairs, line[1] AS a, coalesce(list_filter(line[2:], lambda x: NOT list_contains(met, line[1] * 16 + x))[1], line[2]) AS b, list_transform(range(n), lambda i: points[i + 1] + CASE WHEN len(line) = 1 AND line[1] = i THEN 1e0 ELSE 0e0 END) AS points2 FROM st WHERE r < rounds)),
done AS (SELECT group_id, n, points, list_distinct(met) AS met FROM st WHERE r = rounds),
p AS (SELECT group_id, n, i AS idx, points[i + 1] AS points, coalesce(list_sum(list_transform(list_filter(met, lambda x: x // 16 = i), lambda x: points[x % 16 + 1])), 0e0) AS buchholz FROM (SELECT *, unnest(range(n)) AS i FROM done)),
q AS (SELECT *, 1 - (row_number() OVER (PARTITION BY group_id ORDER BY points DESC, buchholz DESC, idx) - 1) / CAST(n - 1 AS DOUBLE) AS place FROM p),
w AS (SELECT *, avg(place) OVER (PARTITION BY group_id, points, buchholz) AS reward FROM q)
SELECT group_id, idx, points, buchholz, round(reward, 6) AS reward, round((reward - avg(reward) OVER g) / (stddev_samp(reward) OVER g + 1e-6), 6) AS z FROM w WINDOW g AS (PARTITION BY group_id)"""


@query("trn03_swiss", _SWISS_SQL)
def swiss(spark: SparkSession, d: str) -> DataFrame:
    return R.swiss(players(spark, d)).select("group_id", "idx", "points", "buchholz", F.round("reward", 6).alias("reward"), F.round("z", 6).alias("z"))


def _bracket_sql() -> str:
    """Rounds of a bracket of up to 16 one by one: a round's odd line gives its first place a bye; ties go to the place listed first."""
    slots = ", ".join(f"({n}, {slot}, {seed})" for n in range(2, 17) for slot, seed in enumerate(R.fold_seeds(n)))
    out = f"""{PLAYERS_SQL}, slots(n, slot, seed) AS (VALUES {slots}), seeded AS (SELECT group_id, idx, {_TOP} AS top, row_number() OVER (PARTITION BY group_id ORDER BY {_TOP} DESC, idx) - 1 AS seed, count(*) OVER (PARTITION BY group_id) AS n FROM players),
r0 AS (SELECT group_id, idx, top, slot AS pos, n, 0 AS k FROM seeded JOIN slots USING (n, seed))"""
    for r in range(1, 5):
        out += f""", d{r} AS (SELECT *, n > 1 AND pos >= n % 2 AS plays, (pos - n % 2) // 2 AS pair, (pos - n % 2) % 2 AS side FROM r{r - 1}),
e{r} AS (SELECT *, row_number() OVER (PARTITION BY group_id, plays, pair ORDER BY top DESC, side) AS place FROM d{r}),
r{r} AS (SELECT group_id, idx, top, CASE WHEN plays THEN pair + n % 2 ELSE 0 END AS pos, CASE WHEN n > 1 THEN n // 2 + n % 2 ELSE 1 END AS n, 0 AS k FROM e{r} WHERE NOT plays OR place = 1),
l{r} AS (SELECT group_id, idx, top, {r} AS round, pair FROM e{r} WHERE plays AND place = 2)"""
    lost = " UNION ALL ".join(f"SELECT * FROM l{r}" for r in range(1, 5))
    return out + f""", o AS ({lost} UNION ALL SELECT group_id, idx, top, 9, 0 FROM r4), p AS (SELECT group_id, idx, row_number() OVER (PARTITION BY group_id ORDER BY round DESC, top DESC, pair) AS place, count(*) OVER (PARTITION BY group_id) AS n FROM o),
w AS (SELECT group_id, idx, place, 1 - (place - 1) / CAST(n - 1 AS DOUBLE) AS reward FROM p)
SELECT group_id, idx, place, round(reward, 6) AS reward, round((reward - avg(reward) OVER g) / (stddev_samp(reward) OVER g + 1e-6), 6) AS z FROM w WINDOW g AS (PARTITION BY group_id)"""


@query("trn04_single_elimination", _bracket_sql())
def single(spark: SparkSession, d: str) -> DataFrame:
    return R.elimination(players(spark, d)).select("group_id", "idx", "place", F.round("reward", 6).alias("reward"), F.round("z", 6).alias("z"))


def _double_sql() -> str:
    """The winners' rounds, then the losers' with those that each winners' round feeds, then the final; a round's pairs stand next to each other in the order of a hash."""

    def played(name: str, line: str, turn: str) -> str:
        return f""", {name} AS MATERIALIZED (SELECT *, pos // 2 AS pair, row_number() OVER (PARTITION BY group_id, pos // 2 ORDER BY top DESC, pos) AS place
FROM (SELECT l.*, row_number() OVER (PARTITION BY l.group_id ORDER BY md5('0:' || l.group_id || ':' || CAST({turn} AS BIGINT) || ':' || l.idx)) - 1 AS pos FROM ({line}) l JOIN turn0 t USING (group_id)))"""

    own = "SELECT group_id, idx, top FROM"
    out = f"{PLAYERS_SQL}, w0 AS (SELECT group_id, idx, {_TOP} AS top, 1 AS place FROM players), turn0 AS MATERIALIZED (SELECT group_id, ceil(log2(count(*))) AS t FROM players GROUP BY 1)"
    for r in range(1, 5):
        out += played(f"w{r}", f"{own} w{r - 1} WHERE place = 1", str(r - 1))
    for j in range(1, 8):
        fed = f" UNION ALL {own} w{j} WHERE place = 2" if j <= 4 else ""
        out += f", f{j} AS MATERIALIZED ({f'{own} l{j - 1} WHERE place = 1{fed}' if j > 1 else f'{own} w1 WHERE place = 2'})"
        before = " + ".join(["t.t", *(f"(SELECT CAST(count(*) > 1 AS INT) FROM f{i} x WHERE x.group_id = l.group_id)" for i in range(1, j))])
        out += played(f"l{j}", f"{own} f{j}", before)
    gone = " UNION ALL ".join(f"SELECT group_id, idx, top, {j} AS round, pair FROM l{j} WHERE place = 2" for j in range(1, 8))
    out += f""", e AS (SELECT w.group_id, w.idx AS wi, w.top AS wt, l.idx AS li, l.top AS lt FROM w4 w JOIN l7 l USING (group_id) WHERE w.place = 1 AND l.place = 1),
o AS ({gone} UNION ALL SELECT group_id, CASE WHEN wt >= lt THEN wi ELSE li END, 0, 100, 0 FROM e UNION ALL SELECT group_id, CASE WHEN wt >= lt THEN li ELSE wi END, 0, 99, 0 FROM e),
p AS (SELECT group_id, idx, row_number() OVER (PARTITION BY group_id ORDER BY round DESC, top DESC, pair) AS place, count(*) OVER (PARTITION BY group_id) AS n FROM o),
w AS (SELECT group_id, idx, place, 1 - (place - 1) / CAST(n - 1 AS DOUBLE) AS reward FROM p)
SELECT group_id, idx, place, round(reward, 6) AS reward, round((reward - avg(reward) OVER g) / (stddev_samp(reward) OVER g + 1e-6), 6) AS z FROM w WINDOW g AS (PARTITION BY group_id)"""
    return out


@query("trn05_double_elimination", _double_sql())
def double(spark: SparkSession, d: str) -> DataFrame:
    return R.elimination(players(spark, d), double=True).select("group_id", "idx", "place", F.round("reward", 6).alias("reward"), F.round("z", 6).alias("z"))


@query("win09_seeded_bracket", f"{PLAYERS_SQL}, slots(seats, slot, seed) AS (VALUES (2, 0, 0), (2, 1, 1), (4, 0, 0), (4, 1, 3), (4, 2, 1), (4, 3, 2), (8, 0, 0), (8, 1, 7), (8, 2, 3), (8, 3, 4), (8, 4, 1), (8, 5, 6), (8, 6, 2), (8, 7, 5), (16, 0, 0), (16, 1, 15), (16, 2, 7), (16, 3, 8), (16, 4, 3), (16, 5, 12), (16, 6, 4), (16, 7, 11), (16, 8, 1), (16, 9, 14), (16, 10, 6), (16, 11, 9), (16, 12, 2), (16, 13, 13), (16, 14, 5), (16, 15, 10)), seeded AS (SELECT group_id, idx, row_number() OVER (PARTITION BY group_id ORDER BY strength DESC, idx) - 1 AS seed, count(*) OVER (PARTITION BY group_id) AS n FROM players), placed AS (SELECT s.group_id, s.idx, s.seed, t.slot FROM seeded s JOIN slots t ON t.seed = s.seed AND t.seats = CASE WHEN n <= 2 THEN 2 WHEN n <= 4 THEN 4 WHEN n <= 8 THEN 8 ELSE 16 END) SELECT group_id, idx, seed, row_number() OVER (PARTITION BY group_id ORDER BY slot) - 1 AS slot FROM placed")
def seeded_bracket(spark: SparkSession, d: str) -> DataFrame:
    """Bracket slots by seed; the slot map has one row for each seat of each possible group size."""
    seats = [(n, slot, seed) for n in range(2, 17) for slot, seed in enumerate(R.fold_seeds(n))]
    slots = spark.createDataFrame(seats, "n bigint, slot bigint, seed bigint")
    w = W.partitionBy("group_id")
    seeded = players(spark, d).select("group_id", "idx", (F.row_number().over(w.orderBy(F.desc("strength"), "idx")) - 1).cast("bigint").alias("seed"), F.count(F.lit(1)).over(w).alias("n"))
    return seeded.join(F.broadcast(slots), ["n", "seed"]).select("group_id", "idx", "seed", "slot")
