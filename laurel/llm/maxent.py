"""LM scoring with a hashed maximum-entropy model.

P(word | context) = P(class | context) * P(word | class, context), with 32 classes of words (the top bits of a word's hash).
Both factors are softmaxes with the same context features: the previous word, the previous two words and the word before the
previous (a skip), hashed.

    P(class k | x)    ~ mass(k) * exp(sum over features f of a[f, k])
    P(word w | k, x)  ~ (count(w) + 1) * exp(sum over features f of b[f & k, u(w)])

u(w) is one of 32 hash buckets of the words of a class (the next bits of the hash): a weight belongs to a context feature, a class and a
bucket of its words. The word softmax is exact: its normaliser is a sum over the 32 buckets, each with the mass (counts, and one added for each
word and for the unknown) of its words. The biases are the logarithms of masses and counts, which grow with the corpus and
have no bound; a and b are tables of `rows` by 32 weights, with one row for each `TOKENS_A_ROW` training tokens, a power of two up to
2**16 (16 MB in all): the model's size, as it is broadcast. Each text ends with an end token; its first contexts hold a start mark.

Training covers every word of every training text once, in `ROUNDS` slices. In a round, learners (one for each `LEARNER_BYTES` of text)
take minibatch gradient steps (AdaGrad) from the shared weights over their share of the slice, and their changes are averaged, weighted by
tokens, in two steps of small groups. Only the weights and the 1024 masses reach the driver.

Counts of words: documents are dealt to blocks of about 8 MB; a block reports each of its words once with its count, sums
over blocks are taken by word, and each block gets back the counts of its own words. So no vocabulary is
broadcast, and a word that stands everywhere is one row for each block.

Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased and are told apart by 64-bit hashes.

Defined results: null and empty texts are one end token; without training texts every count is 0; repeated rows count
each; an empty table gives no rows; extra columns are ignored. Very long texts are scored whole, with some 100 bytes for each of their
words; the softmaxes take `BATCH` tokens at a time.
"""

from __future__ import annotations

import copy
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, buffers, chunks, crc_mod, in_blocks, mix, stash, text_bytes, word_hashes

CLASS_BITS, BUCKET_BITS, MAX_ROW_BITS = 5, 5, 16
CLASSES, BUCKETS = 1 << CLASS_BITS, 1 << BUCKET_BITS
TOKENS_A_ROW = 64
ROUNDS, BATCH, RATE, LEARNER_BYTES = 2, 1 << 14, 0.1, 64 << 20
#: Tokens of a row that are added for all rows at once, one of each; a row's others are added row by row.
AT_ONCE = 32
#: Logits between which float32 exponentials, and sums of them, neither overflow nor vanish.
SAFE = 80
_END, _START = np.uint64(0x1F3A5C7E9B2D4F61), np.uint64(0xA5A5F00DCAFE1234)
_SALTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and ends of texts, and len+1 offsets of texts into them."""
    words, at = word_hashes(data, off, lower=True)
    return np.insert(words, at[1:], _END), at + np.arange(len(at))


def classes_of(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of words and their buckets in them."""
    leaf = (t >> np.uint64(64 - CLASS_BITS - BUCKET_BITS)).astype(np.int64)
    return leaf >> BUCKET_BITS, leaf & (BUCKETS - 1)


def contexts(t: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes (3 x tokens) of each token's context features."""
    one = np.append(_START, t[:-1])
    one[at[:-1]] = _START
    two = np.append(_START, one[:-1])
    two[at[:-1]] = _START
    return np.stack([mix(one * _SALTS[0]), mix(mix(one * _SALTS[1]) + two * _SALTS[0]), mix(two * _SALTS[2])])


def row_bits(n_tokens: int) -> int:
    return min(MAX_ROW_BITS, max(8, int(n_tokens // TOKENS_A_ROW).bit_length() - 1))


def summed(rows: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows that context features (features x tokens) select, and the sum of g (tokens x n) for each: all rows' first tokens, then the second ones of rows that have two, and so on."""
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    cut = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    size = np.diff(cut, append=len(flat))
    fewer = (AT_ONCE + 1 - np.minimum(size, AT_ONCE + 1)).astype(np.uint8)
    large_first = np.argsort(fewer, kind="stable")
    cut, size = cut[large_first], size[large_first]
    # how many rows have more than 1, 2, ... AT_ONCE tokens
    longer = np.searchsorted(fewer[large_first], np.arange(AT_ONCE, 0, -1, np.uint8), "left")
    order %= g.shape[0]
    out = g.take(order[cut], 0)
    for p, m in enumerate(longer[:-1], 1):
        if not m:
            break
        out[:m] += g.take(order[cut[:m] + p], 0)
    for i in range(longer[-1]):
        out[i] += g.take(order[cut[i] + AT_ONCE : cut[i] + size[i]], 0).sum(0)
    return flat[cut], out


class Model:
    """Weights and AdaGrad's sums of squares of the two softmaxes, and the logarithms of masses by class and bucket."""

    def __init__(self, bits: int, masses: np.ndarray):
        self.bits = bits
        self.bias = [np.log(masses.sum(1)).astype(np.float32), np.log(masses).astype(np.float32)]
        self.weights = [np.zeros((1 << bits, n), np.float32) for n in (CLASSES, BUCKETS)]
        self.squares = [np.full(1 << bits, 1e-2, np.float32) for _ in range(2)]

    def rows(self, x: np.ndarray, k: np.ndarray) -> list[np.ndarray]:
        """Rows of both tables of weights that context features select, for tokens of classes k."""
        low = np.uint64(64 - self.bits)
        of_class = (k.astype(np.uint64) + np.uint64(1)) * _SALTS[1]
        return [(x >> low).astype(np.uint16), (mix(x + of_class) >> low).astype(np.uint16)]

    def softmax(self, of: int, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Probabilities (tokens x classes or buckets)."""
        w = self.weights[of]
        z = w.take(rows[0], 0)
        for r in rows[1:]:
            z += w.take(r, 0)
        z += bias
        if not (z.max(initial=0) < SAFE and z.min(initial=0) > -SAFE):
            z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= np.einsum("ij->i", z)[:, None]
        return z

    def _batches(self, t: np.ndarray, x: np.ndarray):
        """(place, which softmax, rows, target, probabilities) of minibatches."""
        for i in range(0, len(t), BATCH):
            k, u = classes_of(t[i : i + BATCH])
            rows = self.rows(x[:, i : i + BATCH], k)
            for of, target, bias in ((0, k, self.bias[0]), (1, u, self.bias[1][k])):
                yield i, of, rows[of], target, self.softmax(of, rows[of], bias)

    def learn(self, t: np.ndarray, x: np.ndarray) -> None:
        """One AdaGrad step of both softmaxes for each minibatch, in place."""
        for _, of, rows, target, g in self._batches(t, x):
            n = len(target)
            g[np.arange(n), target] -= 1
            used, grad = summed(rows, g)
            squares = self.squares[of].take(used) + np.einsum("ij,ij->i", grad, grad) / grad.shape[1]
            self.squares[of][used] = squares
            grad *= (RATE / np.sqrt(squares + 1e-8))[:, None]
            self.weights[of][used] = self.weights[of].take(used, 0) - grad

    def log10(self, t: np.ndarray, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 P(token | context) for tokens with these training counts."""
        k, u = classes_of(t)
        out = np.log10(count + 1.0) - self.bias[1][k, u].astype(np.float64) / math.log(10)  # share of the bucket
        for i, _, _, target, p in self._batches(t, x):
            out[i : i + len(target)] += np.log10(p[np.arange(len(target)), target])
        return out

    def state(self) -> np.ndarray:
        """All that is learned, as one row for each row of the tables."""
        return np.hstack([*self.weights, *(s[:, None] for s in self.squares)])

    def add(self, change: np.ndarray) -> None:
        for v, c in zip((*self.weights, *self.squares), np.split(change, [CLASSES, CLASSES + BUCKETS, CLASSES + BUCKETS + 1], axis=1), strict=True):
            v += c.reshape(v.shape)


def _texts(column):
    data, off = buffers(column)
    for i, j in chunks(off):
        yield i, j, *tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])


_PARTS = 32


def packed(change: np.ndarray, parts: int = _PARTS) -> list[bytes]:
    """Rows of a change of state in equal parts: weights, whose steps are of RATE's size, as 16 bits; sums of squares, which have no bound, as 32."""
    n = CLASSES + BUCKETS
    out = []
    for x in np.split(change, parts):
        with np.errstate(over="ignore"):
            weights = x[:, :n].astype(np.float16)
        if not (np.isfinite(weights).all() and np.isfinite(x).all()):
            raise FloatingPointError("a learner's change is not finite")
        out.append(weights.tobytes() + np.ascontiguousarray(x[:, n:], np.float32).tobytes())
    return out


def unpacked(part: bytes) -> np.ndarray:
    """The rows that `packed` has written."""
    n = CLASSES + BUCKETS
    rows = len(part) // (2 * n + 8)
    return np.hstack([np.frombuffer(part, np.float16, rows * n).reshape(rows, n).astype(np.float32), np.frombuffer(part, np.float32, offset=2 * rows * n).reshape(rows, 2)])


def train(docs: DataFrame, masses: np.ndarray, n_tokens: int, rounds: int = ROUNDS) -> Model:
    """A model learned from all texts; masses by class and bucket."""
    spark = docs.sparkSession
    model = Model(row_bits(n_tokens), masses)
    sliced = docs.select("text", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(rounds)).alias("slice"))
    learners = max(1, math.ceil(text_bytes(docs) / LEARNER_BYTES))
    for r in range(rounds):
        now = Shared(spark, model)  # of bounded size

        def learn(batches, now=now):
            own = copy.deepcopy(now.value)
            before, n = own.state(), 0
            for batch in batches:
                for _, _, t, at in _texts(batch.column(0)):
                    own.learn(t, contexts(t, at))
                    n += len(t)
            if n:
                change = packed(own.state() - before)
                yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array([n] * _PARTS, pa.int64()), pa.array(change, pa.binary())], ["part", "n", "change"])

        def averaged(table: pa.Table) -> pa.Table:
            n = np.array(table.column("n").to_pylist(), np.float64)
            total = sum(k * unpacked(x.as_py()) for k, x in zip(n / n.sum(), table.column("change"), strict=True))
            return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "n": pa.array([int(n.sum())], pa.int64()), "change": pa.array(packed(total, 1), pa.binary())})

        kind = "part int, n bigint, change binary"
        got = sliced.filter(F.col("slice") == r).select("text").coalesce(learners).mapInArrow(learn, kind)
        salted = got.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("part", "salt").applyInArrow(averaged, kind)
        final = salted.groupBy("part").applyInArrow(averaged, kind).collect()  # 32 rows of 272 KB at most
        if final:
            model.add(np.concatenate([unpacked(x["change"]) for x in sorted(final, key=lambda x: x["part"])]))
        now.destroy()
    return model


def _counted(table: pa.Table) -> pa.Table:
    schema = pa.schema([("b", pa.int32()), ("h", pa.int64()), ("n", pa.int64())])
    learned = ~table.column("held").to_numpy(zero_copy_only=False).astype(bool)
    known, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for i, j, t, at in _texts(table.column("text")):
        weight = np.repeat(learned[i:j], np.diff(at)).astype(np.int64)
        u, inv = np.unique(np.concatenate([known, t]), return_inverse=True)
        n = np.bincount(inv, weights=np.concatenate([n, weight]), minlength=len(u)).astype(np.int64)
        known = u
    b = np.full(len(known), table.column("b")[0].as_py(), np.int32)
    return pa.table([pa.array(b), pa.array(known.view(np.int64)), pa.array(n)], schema=schema)


def score(docs: DataFrame, held) -> DataFrame:
    """Scores of all documents by a model of those for which `held` (a condition on doc_id) is false."""
    spark = docs.sparkSession
    blocks = in_blocks(docs.select("doc_id", "text"), 8 << 20).withColumn("held", held)
    by_block = blocks.groupBy("b")
    seen = stash(by_block.applyInArrow(_counted, "b int, h bigint, n bigint"))
    # summed before the shuffle, and joined back, so that the rows of a word of every block can be dealt to several tasks
    words = seen.groupBy("h").agg(F.sum("n").alias("c"), F.min("b").alias("least")).filter("c > 0")
    vocab = stash(seen.join(words, "h").select("b", "h", "c", (F.col("b") == F.col("least")).alias("lead")))
    totals = np.zeros((CLASSES * BUCKETS, 2), np.int64)
    for r in vocab.filter("lead").groupBy(F.shiftrightunsigned("h", 64 - CLASS_BITS - BUCKET_BITS).alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        totals[r["k"]] = r["n"], r["v"]
    n_all, v_all = (int(x) for x in totals.sum(0))
    masses = (totals.sum(1) + 1.0).reshape(CLASSES, BUCKETS)
    shared = Shared(spark, train(docs.filter(~held), masses, n_all))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((k, pa.int64()) for k in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        model = shared.value
        h = words.column("h").to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(h)
        h, c = h[order], words.column("c").to_numpy()[order]
        out = [[] for _ in range(4)]
        for _, _, t, at in _texts(docs.column("text")):
            count = np.zeros(len(t), np.int64)
            if len(h):
                place = np.minimum(np.searchsorted(h, t), len(h) - 1)
                count = np.where(h[place] == t, c[place], 0)
            base = np.log10((count + 1) / (n_all + v_all + 1))
            own = model.log10(t, contexts(t, at), count)
            out[0].append(np.diff(at))
            out[1].append(np.add.reduceat((count > 0).astype(np.int64), at[:-1]))
            out[2].append(np.add.reduceat(base, at[:-1]))
            out[3].append(np.add.reduceat(own, at[:-1]))
        n, known, base, own = (np.concatenate(x) for x in out)
        ids = docs.column("doc_id").combine_chunks()
        return pa.table([ids, docs.column("held").combine_chunks(), pa.array(n), pa.array(known), pa.array(np.full(len(n), n_all)), pa.array(base), pa.array(own)], schema=schema)

    kinds = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return by_block.cogroup(vocab.select("b", "h", "c").groupBy("b")).applyInArrow(run, kinds)


def op9(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), crc_mod(F.col("doc_id"), 7) == 2)
