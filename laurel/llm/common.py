"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import math
import pickle
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that one block of documents holds on average.
BLOCK_BYTES = 16 << 20
#: Bytes that the numpy kernels take at once.
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share; deleted when the JVM ends.

    That is spark.checkpoint.dir; where it is unset, the context's checkpoint folder, set to one in the warehouse if it is unset too.
    """
    base = _SCRATCH[-1] if _SCRATCH else spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if not spark.sparkContext.master.startswith("local") and (warehouse.startswith("file:") or ":" not in warehouse):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
        base = spark.sparkContext.getCheckpointDir()
    path = f"{base.rstrip('/')}/laurel-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


#: Folders that shared_dir uses, the innermost last.
_SCRATCH: list[str] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """What is stashed inside is deleted at the end; results have to be written elsewhere before that."""
    path = shared_dir(spark)
    _SCRATCH.append(path)
    try:
        yield
    finally:
        _SCRATCH.pop()
        dropped(spark, path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder that shared_dir has given."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stash(df: DataFrame) -> DataFrame:
    """Writes df below the shared folder and reads it back: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """Like stash, with rows dealt to buckets by keys: what groups by them reads the table without a shuffle, as often as it likes."""
    spark, name = df.sparkSession, f"laurel_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # as many buckets as aggregations have partitions, each written by one task
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", shared_dir(spark)).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # it leaves the catalog; its files go with the shared folder
    return out


def aside(docs: DataFrame, *own: str):
    """docs with all columns but `own` under names that meet no others, and a function that gives such rows back under the old names."""
    tag = uuid.uuid4().hex
    names = [c if c in own else f"{tag}_{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda df: df.select(*names).toDF(*docs.columns)


class Shared:
    """A broadcast object that travels by value with its class, so executors need not have this package; each worker process unpickles it once."""

    def __init__(self, spark: SparkSession, value):
        self.held = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        # a process keeps its Broadcast objects
        if not hasattr(self.held, "laurel"):
            self.held.laurel = pickle.loads(self.held.value)
        return self.held.laurel

    def destroy(self) -> None:
        self.held.destroy()


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def in_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, key: str = "doc_id") -> DataFrame:
    """(doc_id, text, b): documents dealt to blocks of about block_bytes by a hash of the id and the text; rows equal in both meet in one block."""
    n = max(1, math.ceil(text_bytes(docs) / block_bytes))
    return docs.select(F.col(key).alias("doc_id"), "text", F.pmod(F.xxhash64(key, "text"), F.lit(n)).cast("int").alias("b"))


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of a key as text, modulo n; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def buffers(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and len+1 offsets of an Arrow string column without copying; null as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.chunk(0) if texts.num_chunks == 1 else pa.concat_arrays(texts.chunks or [pa.array([], texts.type)])
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not (wide or pa.types.is_string(texts.type) or pa.types.is_binary(texts.type)):
        texts, wide = texts.cast(pa.large_string()), True
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, size: int = CHUNK_BYTES):
    """Runs (i, j) of texts of about size bytes; a longer text makes a run alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of an odd base, modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        full = np.full(size, np.uint64(base))
        full[0] = 1
        have = np.multiply.accumulate(full)
        if size <= 1 << 22:  # powers for one huge text are not kept
            _POWERS[base] = have
    return have[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Running sums of values times powers of an odd base, modulo 2**64; spans() reads the hash of any span from them."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_ODD, len(values)), out=out[1:])
    return out


def spans(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end), equal for equal contents wherever they stand."""
    return mix((pre[end] - pre[start]) * powers(_INV, len(pre))[start])


def _table(lower: bool) -> np.ndarray:
    t = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        t[65:91] = t[97:123]
    return t


BYTE_VALUES = {x: _table(x) for x in (False, True)}
#: Separators [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(data: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) of the words of all texts, and len+1 offsets of texts into them."""
    inside = ~sep[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool = False, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts, and len+1 offsets of texts into them."""
    out, where = [], [np.zeros(1, np.int64)]
    n = 0
    for i, j in chunks(off):
        d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        s, e, at = word_bounds(d, o, sep)
        out.append(spans(prefix(BYTE_VALUES[lower][d]), s, e))
        where.append(at[1:] + n)
        n += len(s)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate(where)
