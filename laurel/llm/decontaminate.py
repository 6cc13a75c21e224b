"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items (13 consecutive words; a shorter item is one window). For each
pattern length, a table gives for every block of two words how far the search may jump (words that stand in no
pattern allow the full jump); where the jump is 0, the block selects a bucket of patterns, split by a hash of their first
words, and the words themselves are compared. Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased.

Defined results: null or empty text has no words and no hits; item ids may repeat; null item texts give no window; a null item id
is searched like any other, counts as one item and is left out of the digest; an empty benchmark leaves every document clean; `hits` replaces
columns named like those that it adds and keeps others, `keep_clean` keeps all. Very long texts are searched whole; a task holds the words
of one text at a time.

The benchmark is cut into pieces of at most `PIECE` words (overlapping by a window less one, so each window stands in one), and pieces are
broadcast in blocks of about `block_windows` windows, which go through the driver one at a time. A larger benchmark takes several passes over the documents,
which are written once with a row number; a pass writes only the spans and items of the rows that it hits, before the next block is fetched, and
at the end these meet their documents in one join. So neither the driver nor an executor holds more than one block, and no pass moves texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shared, aside, stash

WINDOW = 13
#: Bytes that end a word become a space, A-Z become a-z; others stay.
TO_WORDS = bytes(32 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(TO_WORDS).split()


def windows_of(items, size: int = WINDOW) -> dict[tuple[bytes, ...], set]:
    """Window -> ids of the items that hold it."""
    out: dict[tuple[bytes, ...], set] = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            out.setdefault(tuple(w[i : i + size]), set()).add(item)
    return out


class WuManber:
    """Search for word sequences of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set]):
        self.m = m = len(next(iter(patterns)))
        self.b = b = min(2, m)
        self.far = m - b + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[int, list]] = {}
        for p, ids in patterns.items():
            for end in range(b, m + 1):
                block = b" ".join(p[end - b : end])
                self.shift[block] = min(self.shift.get(block, self.far), m - end)
            self.buckets.setdefault(b" ".join(p[m - b :]), {}).setdefault(hash(p[0]), []).append((list(p), ids))

    def find(self, w: list[bytes]) -> Iterator[tuple[int, set]]:
        """(start, item ids) of each occurrence."""
        m, b, far, shift, buckets = self.m, self.b, self.far, self.shift, self.buckets
        i, n = m, len(w)
        while i <= n:
            block = w[i - 2] + b" " + w[i - 1] if b == 2 else w[i - 1]
            jump = shift.get(block, far)
            if jump:
                i += jump
                continue
            for p, ids in buckets[block].get(hash(w[i - m]), ()):
                if w[i - m : i] == p:
                    yield i - m, ids
            i += 1


class Items:
    """A block of (item id, text) pieces; tables are made once for each Python worker."""

    def __init__(self, items: list, size: int):
        self.items, self.size, self.tables = items, size, None

    def searchers(self) -> list[WuManber]:
        if self.tables is None:
            by_length: dict[int, dict] = {}
            for p, ids in windows_of(self.items, self.size).items():
                by_length.setdefault(len(p), {})[p] = ids
            self.tables = [WuManber(x) for _, x in sorted(by_length.items(), reverse=True)]
        return self.tables


def scan(w: list[bytes], tables: list[WuManber]) -> tuple[list[tuple[int, int]], set]:
    """Merged hit spans (in words) and the items met."""
    found, items = [], set()
    for t in tables:
        if len(w) >= t.m:
            for at, ids in t.find(w):
                found.append((at, at + t.m))
                items.update(ids)
    return merged(found), items


_SPANS = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


#: Words of one piece of an item.
PIECE = 4096


def pieces_of(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, text, n): the items in pieces that hold n windows; each window of an item is in exactly one."""

    def run(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                w = words_of(text.as_py())
                n = max(1, len(w) - size + 1) if w else 0
                out += [(item, b" ".join(w[i : min(i + PIECE, n) + size - 1]).decode(), min(PIECE, n - i)) for i in range(0, n, PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64()))], ["item_id", "text", "n"])

    return items.select("item_id", "text").mapInArrow(run, "item_id bigint, text string, n bigint")


_FOUND = ["n_words", "hit_spans", "hit_items"]
_TYPES = "n_words bigint, hit_spans array<struct<s:bigint,e:bigint>>, hit_items array<bigint>"


def hits(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_windows: int = 200_000) -> DataFrame:
    """docs with n_words, hit_spans (merged, in words) and hit_items (ids of items with occurring windows)."""
    docs = docs.drop(*_FOUND)
    base = found = None
    block, load = [], 0
    for item, text, n in pieces_of(items, size).toLocalIterator(prefetchPartitions=False):
        if block and load + n > block_windows:
            base, found = _further(docs, base, found, Items(block, size))
            block, load = [], 0
        block.append((item, text))
        load += n
    if base is None:
        return _pass(docs, Items(block, size), docs.columns)
    base, found = _further(docs, base, found, Items(block, size))
    return base.join(_together(found), _ROW).drop(_ROW)


_ROW = "laurel_row"


def _further(docs: DataFrame, base: DataFrame | None, found: DataFrame | None, block: Items) -> tuple[DataFrame, DataFrame]:
    """The documents with a row number, written once, and what one more pass has found, written without texts: all rows of the first pass, then those with hits."""
    if base is None:
        base = stash(docs.withColumn(_ROW, F.monotonically_increasing_id()))
    new = _pass(base.select(_ROW, "text"), block, [_ROW])
    if found is None:
        return base, stash(new)
    return base, found.unionByName(stash(new.filter("size(hit_spans) > 0")))


def _together(found: DataFrame) -> DataFrame:
    """One row for each document from those of its passes."""
    g = found.groupBy(_ROW).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hit_spans")).alias("hit_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("hit_items"))

    def run(batches):
        for batch in batches:
            spans = [[{"s": a, "e": b} for a, b in merged([(x["s"], x["e"]) for x in row])] for row in batch.column("hit_spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(_ROW), batch.column("n_words"), pa.array(spans, _SPANS), batch.column("hit_items")], names=[_ROW, *_FOUND])

    return g.mapInArrow(run, f"{_ROW} bigint, {_TYPES}")


def _pass(docs: DataFrame, block: Items, keep: list[str]) -> DataFrame:
    """One search for a block of items: columns to keep, and what is found in `text`."""
    items = Shared(docs.sparkSession, block)
    at, kept = docs.columns.index("text"), [docs.columns.index(c) for c in keep]

    def run(batches):
        tables = items.value.searchers()
        for batch in batches:
            n, spans, met = [], [], []
            for text in batch.column(at).cast(pa.binary()):
                w = words_of(text.as_py())
                s, i = scan(w, tables)
                n.append(len(w))
                spans.append([{"s": a, "e": b} for a, b in s])
                met.append(sorted(i, key=lambda x: (x is None, x)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(n, pa.int64()), pa.array(spans, _SPANS), pa.array(met, pa.list_(pa.int64()))], names=keep + _FOUND)

    schema = T.StructType([*(docs.schema.fields[k] for k in kept), *T._parse_datatype_string(_TYPES).fields])
    return docs.mapInArrow(run, schema)


def rule() -> Column:
    """The contamination rule over the columns of hits()."""
    return (_n_hit() > 0) & (20 * _n_hit() >= F.col("n_words"))


def _n_hit() -> Column:
    return F.expr("aggregate(hit_spans, 0L, (a, v) -> a + v.e - v.s)")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        _n_hit().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("hit_items").cast("array<string>")), ","), 256).alias("items_sha256"),
        rule().alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that the contamination rule does not strike, whole."""
    plain, back = aside(docs, "text")
    return back(hits(plain, items).filter(~rule()))


def op6(spark, sf_dir: str) -> DataFrame:
    read = spark.read.parquet
    return digest(hits(read(f"{sf_dir}/documents.parquet").select("doc_id", "text"), read(f"{sf_dir}/benchmark.parquet")))


OP6_SQL = r"""
WITH it AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
pat AS (SELECT DISTINCT item_id, CASE WHEN len(w) <= 13 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+12], ' ') END AS p, least(len(w), 13) AS m
        FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM it WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
sizes AS (SELECT DISTINCT m FROM pat),
win AS (SELECT doc_id, m, i, array_to_string(w[i:i+m-1], ' ') AS p FROM (SELECT doc_id, w, m, unnest(range(1, greatest(1, len(w) - m + 2))) AS i FROM d, sizes)),
hit AS (SELECT doc_id, i, win.m, item_id FROM win JOIN pat USING (p)),
pos AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS x FROM hit) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n, sha256(string_agg(k, ',' ORDER BY k)) AS h FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS k FROM hit) GROUP BY 1)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(ids.n, 0) AS n_items, coalesce(ids.h, sha256('')) AS items_sha256,
       coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
