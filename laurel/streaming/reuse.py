"""Caches with a capacity that drop what was used least recently, over recorded calls.

Where every call uses its key, by reuse distances: an entry is still there when a call comes if the weights of all different keys used since its own last use,
with its own, fit the capacity. That needs no replay in order: of the uses in between, those whose key was used in between before are taken away again, and how many there are
is a count of points in a quadrant, (time, time of the key's last use). Calls are numbered by a range exchange and cut into blocks of `BLOCK`. The quadrant is
then counted in three parts: inside a block of times, inside a block of last uses (which no two uses share), and over whole blocks from their sums. No task
holds more than a block, and no window runs over a key's calls.

Where a use depends on a hit, blocks are replayed beside each other (`replayed`), each from what the cache is assumed to hold when it begins.
"""

from __future__ import annotations

import collections
import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

BLOCK = 1 << 17
#: Replays: calls in a block at least, blocks at most, and rounds in which all changed blocks are replayed anew.
LEAST, BLOCKS, ROUNDS = 1 << 15, 64, 8


def dominated(x: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each point, the weights of those with smaller x and greater v: merge levels of the order by v, each one sort and one running sum."""
    order = np.lexsort((-x, -v))
    n, out = len(x), np.zeros(len(x), np.int64)
    xs, ws = np.unique(x, return_inverse=True)[1][order], w[order].astype(np.int64)
    at, width = np.arange(n), 1
    while width < n:
        pair, right = at // (2 * width), (at // width) & 1
        o = np.lexsort((1 - right, xs, pair))
        before = np.concatenate([[0], np.cumsum(np.where(right[o] == 0, ws[o], 0))])
        out[order[o]] += np.where(right[o] == 1, before[1:] - before[pair[o] * 2 * width], 0)
        width *= 2
    return out


def numbered(rows: DataFrame, order: list[str], block: int | None = None) -> DataFrame:
    """rows, written, with their place `at` in an order and its block, of `LEAST` rows or as many as make `BLOCKS` blocks if no size is given."""
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()))
    block = block or max(LEAST, math.ceil(placed.count() / BLOCKS))
    part = F.shiftrightunsigned("id", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("start"))  # a row for each task
    out = placed.withColumn("part", part).join(starts, "part").withColumn("at", F.col("start") + F.col("id").bitwiseAND((1 << 33) - 1))
    return out.drop("part", "start", "id").withColumn("block", F.expr(f"at div {block}"))


def _last_uses(rows: DataFrame) -> DataFrame:
    """rows (at, block, key, weight, used) with the weight used before them (`sum`), and `last` (at, sum with its own) of the last use of their key."""
    own = F.when(F.col("used"), F.col("weight")).otherwise(0)
    sums = rows.groupBy("block").agg(F.sum(own).alias("n"))
    starts = sums.select("block", (F.sum("n").over(W.orderBy("block")) - F.col("n")).alias("start"))  # a row for each block
    before = F.coalesce(F.sum(own).over(W.partitionBy("block").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(starts, "block").withColumn("sum", F.col("start") + before).drop("start")
    use = F.when(F.col("used"), F.struct("at", (F.col("sum") + F.col("weight")).alias("sum")))
    inside = F.last(use, True).over(W.partitionBy("key", "block").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    ends = rows.groupBy("key", "block").agg(F.max(use).alias("end"))  # a row for each block of a key
    carried = ends.select("key", "block", F.last("end", True).over(W.partitionBy("key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    return rows.withColumn("inside", inside).join(carried, ["key", "block"]).withColumn("last", F.coalesce("inside", "carried")).drop("inside", "carried")


def _counted(pdf: pd.DataFrame, strict: str) -> pd.DataFrame:
    x = pdf[strict].to_numpy(np.int64)
    return pd.DataFrame({"at": pdf["at"], "n": dominated(x, pdf["since"].to_numpy(np.int64), pdf["w"].to_numpy(np.int64))})


def repeats(rows: DataFrame, block: int) -> DataFrame:
    """(at, n): the weights of uses that repeat a key between the last use of a row's key and the row."""
    asked = written(rows.filter("last IS NOT NULL").select("at", "block", F.col("last.at").alias("since"), F.expr(f"last.at div {block}").alias("home"), F.when(F.col("used"), F.col("weight")).otherwise(0).alias("w")))
    kind = "at long, n long"
    near = asked.groupBy("block").applyInPandas(lambda pdf: _counted(pdf, "at"), kind)
    blocks = asked.agg(F.max("block")).first()[0] or 0
    if not blocks:
        return near
    # uses of one home are at most a block; what only reads is dealt out, in parts of a block, each beside all uses
    parts = asked.groupBy("home").agg(F.ceil(F.count_if(F.col("w") == 0) / block).cast("int").alias("parts"))
    dealt = asked.join(parts, "home")
    salt = F.when(F.col("w") == 0, F.array(F.pmod(F.xxhash64("at"), F.greatest("parts", F.lit(1))).cast("int"))).otherwise(F.sequence(F.lit(0), F.greatest("parts", F.lit(1)) - 1))
    same = dealt.withColumn("salt", F.explode(salt)).groupBy("home", "salt").applyInPandas(lambda pdf: _counted(pdf, "block"), kind).groupBy("at").agg(F.max("n").alias("n"))
    # sums over blocks of times before and homes after, on the grid of blocks
    spark = rows.sparkSession
    grid = spark.range(blocks + 1).select(F.col("id").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks).cast("long"))).alias("home"))
    cells = grid.join(asked.groupBy("block", "home").agg(F.sum("w").alias("w")), ["block", "home"], "left")
    earlier = F.coalesce(F.sum("w").over(W.partitionBy("home").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    later = F.coalesce(F.sum("earlier").over(W.partitionBy("block").orderBy(F.desc("home")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    far = asked.select("at", "block", "home").join(cells.withColumn("earlier", earlier).select("block", "home", later.alias("n")), ["block", "home"]).select("at", "n")
    return near.unionByName(same).unionByName(far).groupBy("at").agg(F.sum("n").alias("n"))


def residents(rows: DataFrame, capacity: int, block: int = BLOCK) -> DataFrame:
    """rows of `numbered` (key, weight, used and more) with `resident`: whether their key's entry has not been pushed out; a key has one weight."""
    seen = written(_last_uses(rows))
    out = seen.join(repeats(seen, block), "at", "left")
    load = F.col("weight") + F.col("sum") - F.col("last.sum") - F.coalesce("n", F.lit(0))
    return out.withColumn("resident", F.coalesce(load <= capacity, F.lit(False))).drop("sum", "last", "n", "used")


class Kept:
    """What a cache holds, (weight, time of storing) by key in the order of use, while the weights fit the capacity. Without a life, entries have no time."""

    def __init__(self, capacity: int, life: int | None = None):
        self.capacity, self.life, self.entries, self.load = capacity, life, collections.OrderedDict(), 0

    def use(self, key: str, weight: int, since: int | None) -> None:
        self.load += weight - self.entries.pop(key, (0,))[0]
        self.entries[key] = weight, since
        while self.load > self.capacity:
            self.load -= self.entries.popitem(last=False)[1][0]

    def answer(self, key: str | None, weight: int, us: int | None, stores: bool, asked: list[str] | None) -> int:
        """For a list of keys, the place (from 1) of the last that is there, which is used, or 0; for a call with one key, 1 if it hits: it uses its key if it hits or stores."""
        if asked is not None:
            n = next((n for n in range(len(asked), 0, -1) if asked[n - 1] in self.entries), 0)
            if n:
                self.entries.move_to_end(asked[n - 1])
            return n
        if key is None:
            return 0
        old = self.entries.get(key)
        if self.life is None:
            fresh, us = old is not None, None
        else:
            fresh = old is not None and us is not None and old[1] is not None and us - old[1] < self.life
        if stores or fresh:
            self.use(key, weight, old[1] if fresh else us)
        return int(fresh)

    def digest(self) -> str:
        said = hashlib.sha256()
        for entry in self.entries.items():
            said.update(repr(entry).encode())
        return said.hexdigest()


_INPUTS = ["key", "weight", "us", "stores", "asked"]


def _round(calls: DataFrame, blocks: int, make) -> DataFrame:
    """Calls and entries (at below 0) of blocks -> written: calls (ident, said), what each block leaves (at below 0), and its digest (at null)."""
    ident = calls.schema["ident"].dataType.simpleString()

    def run(batches):
        last, kept, schema = None, None, None

        def left():
            rows = [{"block": last, "at": i - len(kept.entries), "key": k, "weight": w, "us": us} for i, (k, (w, us)) in enumerate(kept.entries.items())]
            return pa.RecordBatch.from_pylist([*rows, {"block": last, "key": kept.digest()}], schema)

        for batch in batches:
            schema = schema or pa.schema([("block", pa.int64()), ("at", pa.int64()), ("ident", batch.schema.field("ident").type), ("said", pa.int64()), ("key", pa.string()), ("weight", pa.int64()), ("us", pa.int64())])
            said, asked = [], []
            for i, (block, at, *given) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "at", *_INPUTS)), strict=True)):
                if block != last:
                    if kept is not None:
                        yield left()
                    last, kept = block, make()
                if at < 0:
                    kept.use(*given[:3])
                else:
                    said.append(kept.answer(*given))
                    asked.append(i)
            rows = batch.select(["block", "at", "ident"]).take(pa.array(asked, pa.int64()))
            none = [pa.nulls(len(said), schema.field(c).type) for c in ("key", "weight", "us")]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(said, pa.int64()), *none], schema=schema)
        if kept is not None:
            yield left()

    dealt = calls.repartitionById(blocks, F.col("block").cast("int")).sortWithinPartitions("block", "at")
    return written(dealt.mapInArrow(run, f"block long, at long, ident {ident}, said long, key string, weight long, us long"))


def replayed(calls: DataFrame, make) -> DataFrame:
    """(ident, said): what a cache made by make() (see `Kept`) answers the calls (`numbered`: ident, key, weight, us, stores, asked) in order.

    All blocks are replayed at once, each from an empty cache, and again while the block before leaves something else than was assumed. What a cache holds is
    mostly soon the same, whatever it began with; where it is not, the first changed block is right in each round, and after `ROUNDS` rounds only that is
    replayed: then blocks go one after the other, in linear work. A task holds the cache and one batch; the driver sees a digest for each block.
    """
    blocks = (calls.agg(F.max("block")).first()[0] or 0) + 1
    calls = calls.select("block", "at", "ident", *_INPUTS)
    todo, rounds, runs, ends, began = list(range(blocks)), 0, {}, {}, dict.fromkeys(range(blocks), make().digest())
    while todo:
        asked = calls if len(todo) == blocks else calls.filter(F.col("block").isin(todo))
        if rounds:
            for out in {id(runs[b - 1]): runs[b - 1] for b in todo}.values():
                before = [b - 1 for b in todo if runs[b - 1] is out]
                entries = out.filter("at < 0").filter(F.col("block").isin(before)).select((F.col("block") + 1).alias("block"), "at", "key", "weight", "us")
                asked = asked.unionByName(entries, allowMissingColumns=True)
        out, rounds = _round(asked, blocks, make), rounds + 1
        runs |= dict.fromkeys(todo, out)
        ends |= {r["block"]: r["key"] for r in out.filter("at IS NULL").select("block", "key").collect()}
        todo = [b for b in range(1, blocks) if b - 1 in ends and ends[b - 1] != began[b]][: None if rounds < ROUNDS else 1]
        began |= {b: ends[b - 1] for b in todo}
    parts = [out.filter("at >= 0").filter(F.col("block").isin([b for b in runs if runs[b] is out])) for out in {id(x): x for x in runs.values()}.values()]
    answers = parts[0]
    for part in parts[1:]:
        answers = answers.unionByName(part)
    return answers.select("ident", "said")
