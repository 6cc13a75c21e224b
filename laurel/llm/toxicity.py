"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text's features are its words and the n-grams (4 and 5 UTF-8 bytes) of its words with their borders, lower-cased in
ASCII, hashed to 2**18 buckets by tabulation. A text is the mean of its features' embeddings, with `PAD` zero vectors
added so that very short texts lean to the prior; a softmax over two classes reads it. Embeddings and softmax are trained
together by damped AdaGrad on whole texts. A misspelling that was never seen still shares n-grams, and so much of its
embedding, with the words it came from. A feature that stands in n texts of the sample counts n / (n + `MIN_DOCS`), at every
size of the sample, so rare ones weigh little and none is dropped.

Labels are taken from a sample of at most `SAMPLE` rows of each class (the smallest hashes of doc_id), and of a sampled text at most
`BAG` distinct features (the smallest hashes, with their shares scaled up to the whole), so the one task that trains holds 330 MB of features at
most, whatever the texts. Texts of the sample are reduced to bucket counts on the executors. A fifth of the sample, and one row for each class
at its mean score, set the softmax's scale and bias, weighted by the square roots of the class shares of all labelled rows; the rule is the same
for any number of labels. As the model is linear after averaging, scoring needs one number for each bucket; every byte of every text counts.

Defined results: very long texts are scored whole, with some 60 bytes for each byte of the longest; null and empty texts have no features and get the prior's score; rows labelled null are not learned
from; of several labels of a document the largest counts; without both classes every score is the observed share;
repeated rows are scored alike; extra columns are kept by `keep_clean` and ignored elsewhere.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import aside, buffers, chunks, crc_mod, mix, powers, stash

BITS, NGRAMS, DIM, PAD = 18, (4, 5), 4, 50
#: Rows of classes 0 and 1 learned from at most.
SAMPLE = (3000, 2000)
#: Distinct features of a sampled text that are learned from at most.
BAG = 1 << 13
MIN_DOCS, STEPS, RATE, DAMP = 5, 60, 30.0, 1e4
_RNG = np.random.default_rng(977)
_OFFSETS = _RNG.integers(0, 1 << 63, (max(NGRAMS), 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BREAK = np.array([b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F for b in range(256)])
#: Every separator is one border mark; A-Z as a-z.
_FOLD = np.array([32 if _BREAK[b] else b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def features(data: np.ndarray, off: np.ndarray):
    """For each kind of feature: the positions (in a buffer with a border after each text) that hold one, and their buckets; then the texts' ends in that buffer."""
    n = len(off) - 1
    buf = np.full(len(data) + n + 1, 32, np.uint8)
    ends = off[1:] + np.arange(1, n + 1)
    put = np.ones(len(buf), bool)
    put[0] = False
    put[ends] = False
    buf[put] = _FOLD[data]
    inner = buf != 32
    kinds, h = [], _OFFSETS[0][buf]
    for k in range(1, max(NGRAMS)):
        h = h[:-1] + _OFFSETS[k][buf[k:]]
        if k + 1 in NGRAMS:
            at = inner[1 : 1 + len(h)].copy()
            for x in range(2, k):
                at &= inner[x : x + len(h)]
            at = np.flatnonzero(at)
            kinds.append((at, _bucket(h[at], k + 1)))
    # whole words: sums of position-weighted values between borders
    run = np.cumsum(_OFFSETS[0][buf] * inner * powers(_BASE, len(buf)))
    first = np.flatnonzero(inner[1:] & ~inner[:-1]) + 1
    last = np.flatnonzero(inner[:-1] & ~inner[1:])
    kinds.append((first, _bucket((run[last] - run[first - 1]) * powers(_INVERSE, len(buf))[first], 1)))
    return kinds, ends


_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64((0x9E3779B97F4A7C15 * (2 * kind + 1)) & ((1 << 64) - 1))
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


class Model:
    """Embeddings (buckets x DIM), softmax weights (DIM x 2) and biases (2)."""

    def __init__(self, emb: np.ndarray, out: np.ndarray, bias: np.ndarray):
        self.emb, self.out, self.bias = emb, out, bias

    def scores(self, texts) -> np.ndarray:
        """Probability of class 1 of each text of an Arrow column."""
        gain = (self.emb @ (self.out[:, 1] - self.out[:, 0])).astype(np.float64)
        data, off = buffers(texts)
        mean = np.zeros(len(off) - 1)
        for i, j in chunks(off):
            kinds, ends = features(data[off[i] : off[j]], off[i : j + 1] - off[i])
            total, count = np.zeros(j - i), np.zeros(j - i)
            for at, bucket in kinds:
                cut = np.append(0, np.searchsorted(at, ends))
                run = np.append(0.0, np.cumsum(gain[bucket]))
                total += run[cut[1:]] - run[cut[:-1]]
                count += np.diff(cut)
            mean[i:j] = total / (count + PAD)
        z = np.clip(mean + self.bias[1] - self.bias[0], -500, 500)
        return 1 / (1 + np.exp(-z))


def _calibrated(z: np.ndarray, y: np.ndarray, prior: np.ndarray) -> tuple[float, float]:
    """Scale and bias of a logistic curve through scores z, by Newton steps; classes weighted by prior."""
    n = np.bincount(y, minlength=2)
    goal = np.where(y == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    weight = (prior / np.maximum(n, 1))[y] * len(y)
    x = np.column_stack([z / max(1e-9, z.std()), np.ones(len(z))])
    c = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -50, 50)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        c = c - np.clip(np.linalg.solve(hess, x.T @ (weight * (p - goal)) + 1e-3 * c), -1, 1)
    return max(c[0], 1e-6) / max(1e-9, z.std()), c[1]


def fit(docs_of: np.ndarray, buckets: np.ndarray, shares: np.ndarray, labels: np.ndarray, prior: np.ndarray, seed: int = 5) -> Model:
    """Trains on (document, bucket, share) triples sorted by document (shares are overwritten); labels by document; prior: the classes' shares."""
    used = np.flatnonzero(np.bincount(buckets, minlength=1 << BITS))
    number = np.zeros(1 << BITS, np.int32)
    number[used] = np.arange(len(used))
    local = number[buckets]
    scale = (np.bincount(local, weights=shares) / len(labels)) ** -0.25
    shares *= scale.astype(np.float32)[local]
    order = np.argsort(local, kind="stable")
    d_sorted, s_sorted = docs_of[order], shares[order]
    del order
    at_bucket = np.append(0, np.cumsum(np.bincount(local))[:-1])
    some, at_doc = np.unique(docs_of, return_index=True)
    rng = np.random.default_rng(seed)
    tune = rng.random(len(labels)) < 0.2
    tune[[int(np.flatnonzero(labels == y)[0]) for y in (0, 1)]] = False
    e = rng.normal(0, 0.01, (len(used), DIM)).astype(np.float32)
    w = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    w[:, 1] = -w[:, 0]
    bias = np.zeros(2, np.float32)
    target = np.eye(2, dtype=np.float32)[labels]
    weight = (0.5 / np.maximum(1, np.bincount(labels[~tune], minlength=2)))[labels].astype(np.float32)[:, None] * ~tune[:, None]

    def forward() -> np.ndarray:
        x = np.zeros((len(labels), DIM), np.float32)
        for k in range(DIM):
            x[some, k] = np.add.reduceat(e[:, k][local] * shares, at_doc)
        return x

    sums = None
    for _ in range(STEPS):
        x = forward()
        z = x @ w + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - target) * weight
        gx = g @ w.T
        ge = np.empty_like(e)
        for k in range(DIM):
            ge[:, k] = np.add.reduceat(gx[:, k][d_sorted] * s_sorted, at_bucket)
        steps = [(e, ge, RATE), (w, x.T @ g, 0.1), (bias, g.sum(0), 0.1)]
        if sums is None:
            sums = [np.full_like(e, DAMP * np.mean(ge**2)), np.full_like(w, 1e-6), np.full_like(bias, 1e-6)]
        for (v, grad, rate), acc in zip(steps, sums, strict=True):
            acc += grad * grad
            v -= rate * grad / np.sqrt(acc + 1e-20)
    x = forward()
    z = x @ (w[:, 1] - w[:, 0])
    rest = [z[(labels == y) & ~tune] for y in (0, 1)]  # at least one row of each class is trained on
    z_check = np.append(z[tune], [r.mean() for r in rest]).astype(np.float64)
    slope, at = _calibrated(z_check, np.append(labels[tune], [0, 1]), prior)
    emb = np.zeros((1 << BITS, DIM), np.float32)
    emb[used] = e * scale[:, None]
    return Model(emb, (w * slope).astype(np.float32), np.array([0.0, at], np.float32))


def _bags(texts) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct buckets of each text and their shares of its features (padding included)."""
    data, off = buffers(texts)
    where, share = [], []
    for k in range(len(off) - 1):
        kinds, _ = features(data[off[k] : off[k + 1]], off[k : k + 2] - off[k])
        b, n = np.unique(np.concatenate([x for _, x in kinds]), return_counts=True)
        total, all_ = n.sum() + PAD, n.sum()
        if len(b) > BAG:
            keep = np.sort(np.argsort(mix(b.astype(np.uint64) + np.uint64(1)), kind="stable")[:BAG])
            b, n = b[keep], n[keep] * (all_ / n[keep].sum())
        where.append(b)
        share.append((n / total).astype(np.float32))
    return where, share


def _seen(batches):
    """In how many texts of the task each bucket stands."""
    n = np.zeros(1 << BITS, np.int32)
    for batch in batches:
        for b in _bags(batch.column(1))[0]:
            n[b] += 1
    yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()], pa.binary())], ["n"])


def train(docs: DataFrame, labels: DataFrame, held_out=None, sample: tuple[int, int] = SAMPLE) -> Model:
    """Learns from labelled documents for which held_out (a condition on doc_id) is not true."""
    spark = docs.sparkSession
    known = labels.filter("toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    if held_out is not None:
        known = known.filter(~held_out)
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    count = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = count.get(1, 0) / max(1, sum(count.values()))
    if len(count) < 2:
        return _prior_only(share)
    picked = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample[y]) for y in (0, 1)]
    chosen = spark.createDataFrame([(r["doc_id"], r["y"]) for x in picked for r in x.collect()], "doc_id bigint, y int")
    # at most sum(sample) rows; of a repeated doc_id one text is learned from
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy("text"))).filter("r = 1")
    texts = stash(texts.select("doc_id", "text", "y").repartition(8))
    seen = sum(np.frombuffer(r["n"], np.int32) for r in texts.mapInArrow(_seen, "n binary").collect())
    trust = (seen / (seen + MIN_DOCS)).astype(np.float32)

    def bags(batches):
        for batch in batches:
            where, shares = _bags(batch.column(1))
            shares = [(s * trust[b]).tobytes() for b, s in zip(where, shares, strict=True)]
            where = [b.astype(np.int32).tobytes() for b in where]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(where, pa.binary()), pa.array(shares, pa.binary())], ["doc_id", "y", "buckets", "shares"])

    prior = np.sqrt([1 - share, share])
    prior /= prior.sum()  # between balanced classes (fewest missed) and their shares (fewest errors)

    def fitted(batches):
        rows = []
        for batch in batches:
            rows += zip(*(c.to_pylist() for c in batch.columns), strict=True)
        rows.sort(key=lambda r: r[0])
        y = [r[1] for r in rows]
        where = [np.frombuffer(r[2], np.int32) for r in rows]
        shares = [np.frombuffer(r[3], np.float32) for r in rows]
        del rows
        docs_of = np.repeat(np.arange(len(y), dtype=np.int32), [len(x) for x in where])
        where, shares = np.concatenate(where), np.concatenate(shares)
        m = fit(docs_of, where, shares, np.array(y, np.int64), prior) if len(where) else _prior_only(share)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (m.emb * trust[:, None], m.out, m.bias)], ["emb", "out", "bias"])

    # one task trains on the whole bounded sample, on an executor, and returns the model
    bagged = texts.mapInArrow(bags, "doc_id bigint, y int, buckets binary, shares binary").repartition(1)
    got = bagged.mapInArrow(fitted, "emb binary, out binary, bias binary").first()
    return Model(*(np.frombuffer(got[c], np.float32).reshape(shape) for c, shape in (("emb", (1 << BITS, DIM)), ("out", (DIM, 2)), ("bias", (2,)))))


def _prior_only(share: float) -> Model:
    """A model that gives every text the same score."""
    odds = math.log((share + 1e-6) / (1 - share + 1e-6))
    return Model(np.zeros((1 << BITS, DIM), np.float32), np.zeros((DIM, 2), np.float32), np.array([0.0, odds], np.float32))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column `score`."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast((model.emb, model.out, model.bias))  # 2**18 x DIM floats
    at = docs.columns.index("text")

    def run(batches):
        m = Model(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m.scores(batch.column(at)))], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, docs.withColumn("score", F.lit(0.0)).schema)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the model does not call toxic, whole."""
    plain, back = aside(docs, "text")
    return back(score(plain, train(docs, labels)).filter("score < 0.5"))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = crc_mod(F.col("doc_id"), 5) == 0
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held)
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
