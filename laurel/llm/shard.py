"""Sharding by Hilbert-curve ordering, in native DataFrame operations.

Metadata (language, source, size) is quantised to 5 bits each, the cells are numbered along a 3-dimensional Hilbert
curve, rows are sorted by that number and cut into runs, so that each shard covers few cells and a reader that filters
on any of the three dimensions can skip shards by their min/max statistics. A dimension's cells are runs of its values in their own order:
size is cut at its quantiles over all rows, language and source at evenly spaced ones of all distinct values
(with up to 32 of them each has a cell of its own). The law is `rows`: counts of shards differ by one at most.

Equal texts are one group. They share a cell, the smallest of theirs, and so stand side by side. Where a cut
falls inside a group, its smaller part changes places with the nearest rows of single texts beyond the group, in the same half shard; a
group is split only if it is larger than a shard or that half holds too few single texts.

Ranks need no global window: rows are range-partitioned by (curve index, checksum, size, hash, doc_id), numbered inside each
partition, and shifted by the partition's offset. The numbering is written to the shared folder before offsets are
counted, so both see the same rows. What the driver sees is a few rows for each shard and for each partition.

Defined results: null text has 0 bytes (size 16) and the checksum of the empty string, and is equal to the empty text; null metadata counts
as the empty string; repeated rows each get a slot; an empty table gives no rows; extra columns are ignored by `assign` and kept by
`write`, but for `shard`, which it sets. Of a very long text only its size and hashes are shuffled by `assign`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash

BITS, DIMS = 5, 3
# Rules of the 3-dimensional curve, by the position w along a cell's 8 children: Gray code's inverse, the corner where the
# child is entered, and the axis along which it is left.
_GRAY_INVERSE = [0, 1, 3, 2, 7, 6, 4, 5]
_ENTRY = [0, 0, 0, 3, 3, 6, 6, 5]
_AXIS = [0, 1, 1, 2, 2, 1, 1, 0]


def hilbert_index(x: str, y: str, z: str, bits: int = BITS) -> Column:
    """Position along the curve of the cell named by three int columns: a fold over bit planes that carries the entry corner e and d1, the axis plus one."""
    table = lambda values, at: f"element_at(array({','.join(map(str, values))}), 1 + {at})"
    corner = f"((shiftright({x}, i) & 1) | shiftleft(shiftright({y}, i) & 1, 1) | shiftleft(shiftright({z}, i) & 1, 2))"
    turned = f"((shiftright({corner} ^ s.e, s.d1) | shiftleft({corner} ^ s.e, 3 - s.d1)) & 7)"
    entry = table(_ENTRY, "w")
    back = f"((shiftleft({entry}, s.d1) | shiftright({entry}, 3 - s.d1)) & 7)"
    state = f"named_struct('e', s.e ^ {back}, 'd1', (s.d1 + {table(_AXIS, 'w')} + 1) % 3, 'h', s.h * 8 + w)"
    step = f"element_at(transform(array({table(_GRAY_INVERSE, turned)}), w -> {state}), 1)"
    return F.expr(f"aggregate(sequence({bits - 1}, 0, -1), named_struct('e', 0, 'd1', 1, 'h', 0), (s, i) -> {step}, s -> s.h)")


def _between(value: Column, cuts: list) -> Column:
    """The number of cuts that value has reached."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= value)) if cuts else F.lit(0)


def _value_cuts(docs: DataFrame, name: str) -> list[str]:
    """At most 31 values that cut all of a column's distinct values evenly; only these reach the driver."""
    values = docs.select(F.coalesce(F.col(name).cast("string"), F.lit("")).alias("v")).distinct()
    n, placed = 1 << BITS, stash(values.repartitionByRange("v").sortWithinPartitions("v").withColumn("at", F.monotonically_increasing_id()))
    ranked, total = _ranked(placed)
    ranks = range(1, total) if total <= n else [total * i // n for i in range(1, n)]
    return sorted(r[0] for r in ranked.filter(F.col("rank").isin([*ranks])).select("v").collect())


def cells(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, a hash of the text and the quantised metadata of documents."""
    body, n = F.coalesce(F.col("text"), F.lit("")), 1 << BITS
    sizes = docs.agg(F.percentile_approx(F.octet_length(body), [i / n for i in range(1, n)], 10_000)).first()[0] or []
    name = lambda c: _between(F.coalesce(F.col(c).cast("string"), F.lit("")), _value_cuts(docs, c))
    return docs.select(
        "doc_id",
        (F.octet_length(body).cast("long") + 16).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("text_hash"),
        name("lang").alias("hx"),
        name("source").alias("hy"),
        _between(F.octet_length(body), sorted({*sizes})).alias("hz"),
    )


_TEXT = ["text_crc32", "size", "text_hash"]


def _ranked(placed: DataFrame) -> tuple[DataFrame, int]:
    """Rows with their rank in the order of a written table numbered by `at`, and their count."""
    part = F.shiftrightunsigned("at", 33)
    # one row for each partition of the range exchange, so this window and broadcast stay as small as the count of tasks
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", rank).drop("part", "before", "at"), placed.count()


def _exchanges(rows: DataFrame, starts: list[int], total: int) -> DataFrame | None:
    """(rank, other): ranks that change places so that groups cut by shards' starts are whole; None if there are none."""
    edge = rows.filter(F.col("copies") > 1).filter(F.col("rank").isin([x for s in starts[1:] for x in (s - 1, s)])).select("rank", *_TEXT).collect()
    by_rank = {r["rank"]: tuple(r)[1:] for r in edge}
    cut = {s: by_rank[s] for s in starts[1:] if by_rank.get(s) == by_rank.get(s - 1, 0)}
    if not cut:
        return None
    texts = [F.struct(*(F.lit(v).cast("long").alias(c) for c, v in zip(_TEXT, t, strict=True))) for t in sorted({*cut.values()})]
    keys = rows.sparkSession.range(1).select(F.inline(F.array(*texts)))  # a row for each shard at most
    extent = {tuple(r)[:3]: tuple(r)[3:] for r in rows.join(F.broadcast(keys), _TEXT).groupBy(*_TEXT).agg(F.min("rank"), F.max("rank") + 1).collect()}
    ends = dict(zip(starts, [*starts[1:], total], strict=True))
    moves = []  # (cut, first rank that moves, how many, ranks [lo, hi) that give places, whether the nearest is the first of them)
    for n, (s, text) in enumerate(sorted(cut.items())):
        a, b = extent[text]
        last = starts[starts.index(s) - 1]
        if b - a > ends[s] - s or a < last or b > ends[s]:
            continue
        moves.append((n, a, s - a, b, (s + ends[s]) // 2, True) if s - a <= b - s else (n, s, b - s, (last + s + 1) // 2, a, False))
    if not moves:
        return None
    zone = lambda f: F.coalesce(*(F.when((F.col("rank") >= m[3]) & (F.col("rank") < m[4]), F.lit(f(m))) for m in moves))
    distance = F.col("rank") * zone(lambda m: 1 if m[5] else -1)
    w = W.partitionBy("cut").orderBy("distance")
    free = rows.filter(F.col("copies") == 1).select("rank", zone(lambda m: m[0]).alias("cut"), distance.alias("distance")).filter("cut IS NOT NULL")
    free = free.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= max(m[2] for m in moves))
    free = free.withColumn("goes", F.coalesce(*(F.when((F.col("cut") == m[0]) & (F.col("n") <= m[2]), F.lit(m[1]) + F.col("n") - 1) for m in moves))).filter("goes IS NOT NULL")
    free = stash(free.select("cut", "rank", "goes"))
    have = {r["cut"]: r["n"] for r in free.groupBy("cut").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = [m[0] for m in moves if have.get(m[0]) == m[2]]
    free = free.filter(F.col("cut").isin(whole))
    return free.select("rank", F.col("goes").alias("other")).unionByName(free.select(F.col("goes").alias("rank"), F.col("rank").alias("other")))


def assign(docs: DataFrame, shards: int = 40) -> DataFrame:
    """A shard and a gapless slot for each row, by the law `rows`."""
    rows = stash(cells(docs))
    # written, so that the join reads two plain tables and a hot group's rows can be dealt to several tasks
    group = stash(rows.groupBy(*_TEXT).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("hx", "hy")).alias("least")).filter("copies > 1"))
    rows = rows.join(group, _TEXT, "left").withColumns({"hx": F.coalesce("least.hx", "hx"), "hy": F.coalesce("least.hy", "hy")})
    rows = rows.select("doc_id", *_TEXT, F.coalesce("copies", F.lit(1)).alias("copies"), hilbert_index("hx", "hy", "hz").alias("curve"))
    order = ["curve", *_TEXT, "doc_id"]
    placed = stash(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    out, total = _ranked(placed)
    starts = [(s * total + shards - 1) // shards for s in range(shards)]
    moved = _exchanges(out, starts, total) if total >= 2 * shards else None
    if moved is not None:
        out = out.join(moved, "rank", "left").withColumn("rank", F.coalesce("other", "rank"))
    out = out.withColumn("shard", F.expr(f"(rank * {shards}) div {max(1, total)}"))
    start = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("rank") - start).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
        "text_hash",
    )


def write(docs: DataFrame, path: str, shards: int = 40) -> DataFrame:
    """Writes documents as one folder for each shard, in curve order inside it. Returns the assignment. Rows repeated with one id and text share their slots among them."""
    placed = stash(assign(docs, shards))
    kept, body = [c for c in docs.columns if c != "shard"], F.coalesce(F.col("text"), F.lit(""))
    # rows as structs, so that their columns' names meet no others; the n-th of equal rows takes the n-th slot
    id_ = lambda c: F.struct(F.isnull(c).alias("none"), F.coalesce(c, F.lit(0)).alias("id"))
    rows = docs.select(F.struct(*kept).alias("row"), id_("doc_id").alias("k"), F.xxhash64(body).alias("t"))
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("k", "t").orderBy(F.xxhash64("row"))))
    slots = placed.select(id_("doc_id").alias("k"), F.col("text_hash").alias("t"), "shard", "slot")
    slots = slots.withColumn("n", F.row_number().over(W.partitionBy("k", "t").orderBy("shard", "slot")))
    out = rows.join(slots, ["k", "t", "n"]).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    out.select(*(F.col(f"row.`{c}`") for c in kept), "shard").write.partitionBy("shard").parquet(path)
    return placed


def op7(spark, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")
