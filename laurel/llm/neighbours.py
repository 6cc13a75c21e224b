"""Approximate nearest neighbours by low-dimensional stable projections, kd-trees and a chi-square stopping test.

Vectors are projected to 12 dimensions by a fixed Gaussian (2-stable) matrix: the squared projected distance of two
vectors, divided by their squared distance, follows a chi-square law with 12 degrees of freedom. A query takes candidates
in the order of projected distance from kd-trees and verifies them on the original vectors, until the projected distance of all
that is left is so large against the distance of its k-th best that a nearer vector would stand there with a chance below
1 - CONFIDENCE.

The upper levels of the tree are fitted to a sample of `SAMPLE_A_CELL` projected vectors a cell; every row is indexed: rows are dealt to
cells, cells to parts of about `PART_ROWS` rows, and each part gets its own lower tree. There is a cell for each `CELL_ROWS` rows up to 256;
beyond, cells and their rows both grow with the square root of the rows (10**9 rows: 5600 cells, whose boxes and sample are some 5 MB). A query
first searches its own cell, and then, with the k-th distance as bound, just those cells that the stopping test does not rule out.
Queries of a cell are split by their own count, and rows are repeated once for each split of their own cell, so a hot cell or query set is
spread over tasks. Of equal vectors a part keeps the k + 1 with the smallest ids, as no others can be an answer; nothing that could be one is
dropped.

Defined results: null, empty and zero vectors and those with null or non-finite components take no part, nor do vectors
of another length than the commonest one; of several queries with one id the smallest vector is taken; rows with a
query's id are no candidates for it; rows repeated with one id and vector are one candidate, and rows of one id with
different vectors are one each; fewer candidates than k give them all; ties go to the smaller id; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Shared, stash

M, CONFIDENCE_Z, SAMPLE_A_CELL, CELL_ROWS, PART_ROWS, LEAF = 12, 2.33, 16, 8192, 16384, 128


def chi_square_quantile(m: int, z: float) -> float:
    """Wilson and Hilferty's value for the quantile whose normal score is z."""
    return m * (1 - 2 / (9 * m) + z * math.sqrt(2 / (9 * m))) ** 3


#: The test: what lies beyond LIMIT times the squared k-th distance (in squared projected distance) is not looked at. z = 2.33: 99 %.
LIMIT = chi_square_quantile(M, CONFIDENCE_Z)


def projection(dim: int, m: int = M) -> np.ndarray:
    return np.random.default_rng(4211).normal(size=(dim, m))


def _gap(lo: np.ndarray, hi: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances of p to boxes."""
    d = np.maximum(np.maximum(lo - p, p - hi), 0)
    return (d * d).sum(-1)


class KdTree:
    """Median splits along the widest side down to leaves; nodes have tight boxes. Row i of `children` is -1 for a leaf."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.order = points, np.arange(len(points))
        self.lo, self.hi, self.range, self.children = [], [], [], []
        stack = [(0, len(points), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            node = len(self.lo)
            if parent >= 0:
                self.children[parent][side] = node
            own = points[self.order[a:b]]
            lo, hi = own.min(0), own.max(0)
            self.lo.append(lo)
            self.hi.append(hi)
            self.range.append((a, b))
            self.children.append([-1, -1])
            axis = int(np.argmax(hi - lo))
            if b - a > leaf and hi[axis] > lo[axis]:
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], mid)]
                stack += [(a, a + mid, node, 0), (a + mid, b, node, 1)]
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def nearest_first(self, p: np.ndarray):
        """(squared projected distance at least, rows) in growing order of the distance; each leaf is split by nothing more."""
        gaps = _gap(self.lo, self.hi, p)
        heap = [(float(gaps[0]), 0)]
        while heap:
            gap, node = heapq.heappop(heap)
            a, b = self.children[node]
            if a < 0:
                lo, hi = self.range[node]
                yield gap, self.order[lo:hi]
            else:
                heapq.heappush(heap, (float(gaps[a]), a))
                heapq.heappush(heap, (float(gaps[b]), b))


class Part:
    """The rows of one part with their lower tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, matrix: np.ndarray):
        order = np.lexsort((ids, np.unique(vectors, axis=0, return_inverse=True)[1].ravel()))
        ids, vectors = ids[order], vectors[order]
        new = np.append(True, (vectors[1:] != vectors[:-1]).any(1))
        once = new | np.append(True, ids[1:] != ids[:-1])  # a repeated row stands next to itself, always in one part
        ids, vectors, new = ids[once], vectors[once], new[once]
        place = np.arange(len(ids)) - np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
        self.ids, self.vectors, self.k = ids[place <= k], vectors[place <= k], k
        self.tree = KdTree(self.vectors @ matrix)
        self.slack = 1e-9 * (1 + float(np.abs(self.tree.points).max()) ** 2)

    def search(self, own: int, v: np.ndarray, p: np.ndarray, bound: float) -> list[tuple[float, int]]:
        """The k nearest found (distance, id) that are not beyond bound."""
        best: list[tuple[float, int]] = []
        limit = bound
        for gap, rows in self.tree.nearest_first(p):
            if gap > LIMIT * limit * limit + self.slack:
                break
            near = self.tree.points[rows] - p
            rows = rows[(near * near).sum(1) <= LIMIT * limit * limit + self.slack]
            if not len(rows):
                continue
            d = self.vectors[rows] - v
            d = np.sqrt((d * d).sum(1))
            for x, i in zip(d.tolist(), self.ids[rows].tolist(), strict=True):
                if i != own and x <= limit:
                    best.append((x, i))
            best.sort()
            del best[self.k :]
            if len(best) == self.k:
                limit = min(limit, best[-1][0])
        return best


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the vectors that take part."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.filter(F.col("vec_id").isNotNull() & F.expr("size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)"))
    common = v.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return v.filter(F.size("embedding") == (common["d"] if common else 0))


def _matrix_of(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def cells_for(rows: int) -> int:
    n = rows / CELL_ROWS
    return max(1, math.ceil(n if n <= 256 else 256 * math.sqrt(n / 256)))


class Cells:
    """Cells that cover all space: median splits of a sample along its widest side, the fullest cell first; with their boxes."""

    def __init__(self, points: np.ndarray, n: int):
        m = points.shape[1]
        self.axis, self.cut, self.children = [0], [0.0], [[-1, -1]]  # by node; children of a leaf: -1 and its cell
        boxes = {0: (np.full(m, -np.inf), np.full(m, np.inf))}
        heap = [(-len(points), 0, points)] if len(points) else []
        while heap and len(boxes) < n:
            _, node, own = heapq.heappop(heap)
            axis = int(np.argmax(own.max(0) - own.min(0)))
            cut = float(np.median(own[:, axis]))
            left = own[:, axis] <= cut
            if left.all():  # a median that is the greatest value parts nothing
                cut = float(np.nextafter(own[:, axis].max(), -np.inf))
                left = own[:, axis] <= cut
            if not left.any():
                continue
            lo, hi = boxes.pop(node)
            low, high = hi.copy(), lo.copy()
            low[axis] = high[axis] = cut
            self.axis[node], self.cut[node] = axis, cut
            for side, part, box in ((0, own[left], (lo, low)), (1, own[~left], (high, hi))):
                child = len(self.axis)
                self.children[node][side] = child
                self.axis.append(0)
                self.cut.append(0.0)
                self.children.append([-1, -1])
                boxes[child] = box
                heapq.heappush(heap, (-len(part), child, part))
        leaves = sorted(boxes)
        for cell, node in enumerate(leaves):
            self.children[node][1] = cell
        self.axis, self.cut, self.children = np.array(self.axis), np.array(self.cut), np.array(self.children)
        self.lo, self.hi = (np.array([boxes[x][side] for x in leaves]) for side in (0, 1))

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell (lo, hi] of each point."""
        node = np.zeros(len(points), np.int64)
        go = np.flatnonzero(self.children[node, 0] >= 0)
        while len(go):
            at = node[go]
            node[go] = self.children[at, (points[go, self.axis[at]] > self.cut[at]).astype(np.int64)]
            go = go[self.children[node[go], 0] >= 0]
        return self.children[node, 1].astype(np.int32)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, by Euclidean distance."""
    spark = vectors.sparkSession
    rows = stash(usable(vectors))
    n = rows.count()
    kinds = "query_id bigint, vec_id bigint, score double"
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    matrix = projection(rows.select(F.size("embedding")).first()[0])
    n_cells = cells_for(n)
    sampled = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(256, SAMPLE_A_CELL * n_cells)).select("embedding")

    def flat(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(_matrix_of(b.column(0)) @ matrix), pa.list_(pa.float64()))], ["p"])

    sample = np.array([r[0] for r in sampled.mapInArrow(flat, "p array<double>").collect()])
    cells = Cells(sample, n_cells)
    shared = Shared(spark, (matrix, cells))  # of a size that grows with the square root of the rows

    def placed(batches):
        matrix, cells = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells.of(_matrix_of(b.column("embedding")) @ matrix))], [*b.schema.names, "cell"])

    rows = stash(rows.mapInArrow(placed, "vec_id bigint, embedding array<double>, cell int"))

    def shares(df: DataFrame) -> list[tuple]:
        """(cell, in how many its rows are shared out): a row for each cell at most."""
        return [tuple(r) for r in df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int")).collect()]

    def with_shares(df: DataFrame, found: list[tuple], name: str) -> DataFrame:
        return df.join(F.broadcast(spark.createDataFrame(found, f"cell int, {name} int")), "cell")

    parts = shares(rows)
    part = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("parts")).cast("int")
    data = with_shares(rows, parts, "parts").withColumn("part", part).drop("parts")
    asked = queries.select("vec_id").distinct().join(rows, "vec_id").groupBy("vec_id").agg(F.min(F.struct("embedding", "cell")).alias("x"))
    asked = stash(asked.select(F.col("vec_id").alias("query_id"), "x.*"))

    def visit(own: pa.Table, asking: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not own.num_rows or not asking.num_rows:
            return schema.empty_table()
        matrix = shared.value[0]
        part = Part(own.column("vec_id").to_numpy(), _matrix_of(own.column("embedding")), k, matrix)
        v = _matrix_of(asking.column("embedding"))
        p, out = v @ matrix, []
        for i, (q, bound) in enumerate(zip(asking.column("query_id").to_pylist(), asking.column("bound").to_pylist(), strict=True)):
            out += [(q, x, d) for d, x in part.search(q, v[i], p[i], math.inf if bound is None else bound)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema) if out else schema.empty_table()

    def asked_in(q: DataFrame) -> DataFrame:
        """The k best found of queries in the cells they name, in each part."""
        splits = shares(q)
        keys, upto = ["cell", "part", "split"], lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        own = with_shares(data, splits, "splits").withColumn("split", upto("splits"))
        q = with_shares(q, splits, "splits").withColumn("split", F.pmod(F.xxhash64("query_id"), F.col("splits")).cast("int"))
        q = with_shares(q, parts, "parts").withColumn("part", upto("parts"))
        return own.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(visit, kinds)

    def best(found: DataFrame) -> DataFrame:
        w = W.partitionBy("query_id").orderBy("score", "vec_id")  # k rows of each part at most
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    first = stash(best(asked_in(asked.withColumn("bound", F.lit(None).cast("double")))))
    bounds = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    again = asked.withColumnRenamed("cell", "home").join(bounds, "query_id", "left")

    def open_cells(batches):
        matrix, cells = shared.value
        lo, hi = cells.lo, cells.hi
        for b in batches:
            p = _matrix_of(b.column("embedding")) @ matrix
            open_ = []
            for i, (home, bound) in enumerate(zip(b.column("home").to_pylist(), b.column("bound").to_pylist(), strict=True)):
                gaps = _gap(lo, hi, p[i])
                keep = np.flatnonzero(gaps <= (math.inf if bound is None else LIMIT * bound * bound + 1e-9 * (1 + float(np.abs(p[i]).max()) ** 2)))
                open_.append(keep[keep != home].astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("query_id", "embedding", "bound")), pa.array(open_, pa.list_(pa.int32()))], ["query_id", "embedding", "bound", "cells"])

    again = stash(again.mapInArrow(open_cells, "query_id bigint, embedding array<double>, bound double, cells array<int>"))
    later = asked_in(again.select("query_id", "embedding", "bound", F.explode("cells").alias("cell")))
    found = first.select("query_id", "vec_id", "score").unionByName(later)  # of disjoint cells
    return best(found).select("query_id", "rank", "vec_id", "score")


def op5(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.filter("vec_id % 100 = 0"))
