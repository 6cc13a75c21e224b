"""MinHash near-duplicates by min-max hashing.

A document's set is that of its distinct two-word shingles. Of each permutation both the minimum and the maximum are kept, so `PERMUTATIONS`
evaluations give twice as many signature values: each of the two agrees between sets with probability of their similarity J, and a misfit of
the one makes that of the other less likely, which lowers the estimate's variance. Bands of `ROWS` values, minima and maxima apart, are the keys under
which sets meet: sets with J = 0.8 share none of the 52 with probability (1 - 0.8 ** 5) ** 52, 1.1e-9.

Links are confirmed on full sets of 64-bit shingle hashes. A bucket's sets are not paired with each other, but joined to classes step by step:

1. documents of equal sets are one node from the start;
2. each bucket's nodes are compared with the most popular of them, whose own buckets are the largest;
3. the nodes of buckets that hold several classes even then are compared by prefix filtering, which is exact: with elements ordered from the rarest on, similar
   sets share one of their first fifth, so near copies that have each been changed in their own way do not meet. So every two similar nodes that share a bucket are
   in one class or compared, and no link is lost.

Before sets are compared, a pair has to pass an upper bound of its intersection from bitmaps: a bit that only one of them has stands for at least one
element that the other lacks.

Defined results: a text of one word has that word as its set; null and empty texts and those without words have no set and no links, and are components of their own;
null doc_ids have no part in smallest ids (a component of them alone has a null id, and all its rows are kept); repeated rows and ids have one result each; an
empty table gives no rows; extra columns are ignored. Very long texts are taken whole: some 50 bytes are held for each word of the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import buffers, chunks, mix, stash, word_hashes
from .components import components

SHINGLE, PERCENT = 2, 80
ROWS, PERMUTATIONS = 5, 130
#: 64-bit words of a set's bitmap.
WORDS = 32
_DRAWN = np.random.default_rng(20240813)
_A = _DRAWN.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _DRAWN.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_C1, _C2, _C3 = (np.uint64(int(x) | 1) for x in _DRAWN.integers(1, 1 << 63, 3, dtype=np.uint64))


def shingle_sets(texts, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of texts, and len+1 offsets of texts into them."""
    h, at = word_hashes(*buffers(texts), lower=True)
    n = np.diff(at)
    size = np.where(n >= k, n - k + 1, n > 0)
    off = np.append(0, np.cumsum(size))
    doc = np.repeat(np.arange(len(n)), size)
    first = at[:-1][doc] + np.arange(off[-1]) - off[:-1][doc]
    words = np.minimum(n, k)[doc]
    out = words.astype(np.uint64)
    for i in range(k):
        some = words > i
        out[some] = mix(out[some] * _C1 + h[first[some] + i] * _C2 + np.uint64(i))
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    out, doc = out[new], doc[new]
    return out, np.searchsorted(doc, np.arange(len(n) + 1))


def signatures(items: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of the permutations over sets that are not empty: a row for each value."""
    x, first = (items >> np.uint64(32)).astype(np.uint32), off[:-1]
    out = np.empty((2 * PERMUTATIONS, len(first)), np.uint32)
    for i in range(PERMUTATIONS):
        v = x * _A[i] + _B[i]
        np.minimum.reduceat(v, first, out=out[i])
        np.maximum.reduceat(v, first, out=out[PERMUTATIONS + i])
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each set and band."""
    out = []
    for b in range(len(sig) // ROWS):
        key = np.full(sig.shape[1], mix(np.array([b + 1], np.uint64) * _C3)[0])
        for row in sig[b * ROWS : (b + 1) * ROWS]:
            key = mix(key * _C1 + row)
        out.append(key)
    return np.stack(out, axis=1)


def bitmaps(items: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which of 64 * WORDS cells sets have elements in."""
    cell = (items & np.uint64(64 * WORDS - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    bits = np.zeros((len(off) - 1, 64 * WORDS), bool)
    bits[doc, cell] = True
    return np.packbits(bits, axis=1).view(np.int64)


def _lists(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values.reshape(-1).view(np.int64)))


def _each(batches, make):
    """For runs of texts of a megabyte: their set sizes, digests and what `make` adds, under the doc_ids."""
    for batch in batches:
        ids, texts = batch.columns
        for i, j in chunks(buffers(texts)[1]):
            items, off = shingle_sets(texts.slice(i, j - i))
            n = np.diff(off)
            some = np.flatnonzero(n)
            starts = np.append(off[:-1][some], len(items))
            digest = np.zeros((2, len(n)), np.uint64)
            if len(some):
                digest[0, some] = np.add.reduceat(mix(items * _C2), starts[:-1])
                digest[1, some] = np.add.reduceat(mix(items * _C3), starts[:-1])
            more = make(items, starts, n, some)
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n, pa.int64()), *(pa.array(d.view(np.int64)) for d in digest), *more.values()], names=["doc_id", "n", "d1", "d2", *more])


def _mapped(docs: DataFrame, make, more: str) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _each(batches, make), f"doc_id {kind}, n long, d1 long, d2 long, {more}")


def _summed_up(items, starts, n, some) -> dict:
    def rows(values: np.ndarray):
        return _lists(values, np.append(0, np.cumsum(np.where(n > 0, values.shape[1], 0))))

    if not len(some):
        return {c: rows(np.zeros((0, 1), np.uint64)) for c in ("bands", "bits")}
    return {"bands": rows(band_keys(signatures(items, starts))), "bits": rows(bitmaps(items, starts))}


def _whole(items, starts, n, some) -> dict:
    return {"items": _lists(items, np.append(0, np.cumsum(n)))}


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, size, digest, band keys and bitmap of each document's set."""
    return _mapped(docs, _summed_up, "bands array<long>, bits array<long>")


def alike(common: Column, n: Column, m: Column) -> Column:
    return 100 * common >= PERCENT * (n + m - common)


def _confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of different nodes whose sets are similar."""
    side = lambda df, c, *more: df.select(F.col("node").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in more))
    lack = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda s, x: s + x)
    n, m = F.col("n_u"), F.col("n_v")
    most = F.least(n - lack("bits_u", "bits_v"), m - lack("bits_v", "bits_u"))
    near = pairs.join(side(nodes, "u", "n", "bits"), "u").join(side(nodes, "v", "n", "bits"), "v").filter(alike(most, n, m))
    near = stash(near.select("u", "v", "n_u", "n_v"))
    both = near.join(side(sets, "u", "items"), "u").join(side(sets, "v", "items"), "v")
    return stash(both.filter(alike(F.size(F.array_intersect("items_u", "items_v")), n, m)).select("u", "v"))


def _pair(a: str, b: str):
    return F.least(a, b).alias("u"), F.greatest(a, b).alias("v")


def _classed(shared: DataFrame, classes: DataFrame | None) -> DataFrame:
    """The rows of buckets that hold several classes, with their class."""
    if classes is None:
        return shared.withColumn("c", F.col("node"))
    shared = shared.join(classes, "node", "left").withColumn("c", F.coalesce("component", "node"))
    several = shared.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a < b").select("key")
    return stash(shared.join(several, "key"))


def _with_centre(live: DataFrame) -> DataFrame:
    """Pairs of each node and the most popular of its bucket."""
    top = live.groupBy("key").agg(F.max(F.struct("popular", "node")).alias("top"))
    return live.join(top, "key").filter("node <> top.node").select(*_pair("node", "top.node")).distinct()


def _prefixes(live: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, c, n, item, at): the rarest elements of live nodes' sets, counted from 1 in one order of all elements.

    Of a set of n, the first n - ceil(0.8 n) + 1: two similar sets share one of these. Elements that no other live node has keep their
    places in the order, but meet nobody.
    """
    nodes = live.select("node", "c").distinct()
    items = sets.join(nodes, "node").select("node", "c", F.size("items").alias("n"), F.explode("items").alias("item"))
    often = items.groupBy("item").agg(F.count(F.lit(1)).alias("often"))
    order = W.partitionBy("node").orderBy("often", "item")  # one document's elements
    places = items.join(often, "item").withColumn("at", F.row_number().over(order))
    return places.filter(f"often > 1 AND 100 * (n - at + 1) >= {PERCENT} * n").select("node", "c", "n", "item", "at")


def _between(live: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of live nodes of different classes that may be similar.

    They share an element of both prefixes. At the first that they share, what is left of either set bounds their intersection, so most pairs
    fall in the join. Of an element's nodes, those outside its largest class are joined to all.
    """
    prefixes = stash(_prefixes(live, sets))
    by_class = prefixes.groupBy("item", "c").agg(F.count(F.lit(1)).alias("k"))
    major = by_class.groupBy("item").agg(F.max_by("c", F.struct("k", "c")).alias("major"), F.count(F.lit(1)).alias("classes")).filter("classes > 1").select("item", "major")
    marked = stash(prefixes.join(major, "item"))
    minor = marked.filter("c <> major").select("item", *(F.col(c).alias(f"{c}_x") for c in ("node", "c", "n", "at")))
    fits = f"100 * least(n, n_x) >= {PERCENT} * greatest(n, n_x) AND {100 + PERCENT} * (1 + least(n - at, n_x - at_x)) >= {PERCENT} * (n + n_x)"
    met = minor.join(marked, "item").filter(f"c <> c_x AND (c = major OR node_x < node) AND {fits}")
    return met.select(*_pair("node_x", "node")).distinct()


def labels(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """d1, d2, n and component_id of each distinct set of written `sketches` of docs."""
    spark, groups = docs.sparkSession, rows.filter("n > 0").groupBy("d1", "d2", "n")
    nodes = stash(groups.agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("bits").alias("bits")).withColumn("node", F.monotonically_increasing_id()))
    members = nodes.select("node", F.explode("bands").alias("key"))
    crowd = members.groupBy("key").agg(F.count(F.lit(1)).alias("crowd")).filter("crowd > 1")
    met = stash(members.join(crowd, "key"))
    popular = stash(met.groupBy("node").agg(F.sum("crowd").alias("popular")))
    shared = stash(met.join(popular, "node").select("key", "node", "popular"))

    # full sets of the nodes that meet others, read again from one document of each
    wanted = nodes.join(popular, "node", "left_semi").select("node", "id", "d1", "d2", "n")
    texts = docs.select("doc_id", "text").join(wanted.select("id").distinct(), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    found = _mapped(texts, _whole, "items array<long>").join(wanted.select("node", "d1", "d2", "n"), ["d1", "d2", "n"])
    sets = stash(found.groupBy("node").agg(F.first("items").alias("items")))

    slim, edges, classes = nodes.select("node", "n", "bits"), None, None
    for pairs in (_with_centre, lambda live: _between(live, sets)):
        live = _classed(shared, classes)
        if live.isEmpty():
            break
        new = _confirmed(pairs(live), slim, sets)
        edges = new if edges is None else edges.unionByName(new)
        classes = components(edges)
    if classes is None:
        classes = spark.createDataFrame([], "node long, component long")
    named = nodes.join(classes, "node", "left").select("d1", "d2", "n", "id", F.coalesce("component", "node").alias("c"))
    return named.join(named.groupBy("c").agg(F.min("id").alias("component_id")), "c").select("d1", "d2", "n", "component_id")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and whether it is kept, of all documents."""
    rows = stash(sketches(docs))
    own = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    linked = rows.select("doc_id", "d1", "d2", "n").join(labels(docs, rows), ["d1", "d2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return own.unionByName(linked).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT r, doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d
), e AS (
  SELECT r, len(s) AS n, unnest(s) AS x FROM s
), links AS (
  SELECT a.r AS u, b.r AS v FROM e a JOIN e b ON a.x = b.x AND a.r <> b.r AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), reached AS (
  SELECT r, r AS o FROM s UNION SELECT reached.r, v FROM reached JOIN links ON o = u
), c AS (
  SELECT t.r, min(s.doc_id) AS component_id FROM reached t JOIN s ON s.r = t.o GROUP BY t.r
)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM s JOIN c USING (r)
"""
