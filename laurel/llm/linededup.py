"""Line dedup with levelled sorted runs of line hashes, in native DataFrame operations.

A line's key is the line without [\\x20\\x09-\\x0D] at both ends and with A-Z lower-cased. Keys of at least 10 code points
lose all their lines except those in the smallest doc_id that holds the key.

Documents are taken in batches of ascending doc_id. The store keeps, for the keys seen so far, runs of (key hash, owner)
sorted by hash: every batch is reduced to one row for each key (its smallest doc_id), merge-anti-joined with each run, and
what is new becomes a run of level 0. `FAN` runs of one level are merged into one run of the next, so a batch meets
few runs. Runs are tables bucketed and sorted by hash in the shared folder: joins with them shuffle the batch only.
As owners come from earlier batches or are the smallest in their own, the result is that of one global pass.

A key is known by two 64-bit hashes with different seeds, so a false match needs a collision of 128 bits.

Lines that go are told to their rows by number: a row (doc_id and hash of the text) gets one set of numbers, and the lines left are those
of all numbers except the set, which hash sets find in time linear in the lines.

Defined results: null or empty text is one empty line; lines that are equal inside the owning document all stay; rows
with the same doc_id count as one document; null doc_ids count as one document with the smallest id of all; an empty table gives no rows;
extra columns of any name are kept by `dedup`, but for n_lines and n_dropped, which it sets. A very long text is one row whose lines are
held at once, some 60 bytes for each line besides the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stash

MIN_CHARS = 10
BATCHES = 4
FAN = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = " \t\n\x0b\x0c\r"


def key_of(line: Column) -> Column:
    bare = F.btrim(line, F.lit(_BLANK))
    # lower() is cheaper than translate() and equal to it on ASCII
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def marks(text: Column) -> Column:
    """(i, h, g) for each line whose key is long enough to count: its number from 0 and the pair of hashes of its key."""
    numbered = F.transform(F.transform(lines_of(text), key_of), lambda k, i: F.when(F.char_length(k) >= MIN_CHARS, F.struct(i.alias("i"), F.xxhash64(k).alias("h"), F.xxhash64(F.lit(7), k).alias("g"))))
    return F.filter(numbered, lambda m: m.isNotNull())


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class Runs:
    """The levelled store: runs of (h, g, owner), sorted by key and disjoint in it."""

    def __init__(self, spark):
        self.spark, self.levels, self.root, self.n = spark, {}, shared_dir(spark), 0
        # as many buckets as joins and aggregations have partitions: their tasks write one file each
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, df: DataFrame, level: int) -> None:
        self.n += 1
        name = f"run_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "h", "g").sortBy("h", "g").option("path", f"{self.root}/{self.n}").saveAsTable(name)
        self.levels.setdefault(level, []).append(name)

    def all(self) -> list[DataFrame]:
        return [self.spark.table(x) for level in sorted(self.levels, reverse=True) for x in self.levels[level]]

    def add(self, keys: DataFrame) -> None:
        """Merge-anti-joins a batch's (h, g, owner) rows with every run, keeps the rest as a new run, and compacts full levels."""
        for run in self.all():
            keys = keys.join(run.select("h", "g").hint("merge"), ["h", "g"], "left_anti")
        self._write(keys, 0)
        level = 0
        while len(self.levels.get(level, [])) >= FAN:
            old = self.levels.pop(level)
            union = self.spark.table(old[0])
            for x in old[1:]:
                union = union.unionByName(self.spark.table(x))
            self._write(union.repartition(self.buckets, "h", "g"), level + 1)
            self._forget(old)
            level += 1

    def owners(self) -> DataFrame:
        """All keys as one written table; the runs are closed."""
        out = self.all()
        union = out[0]
        for x in out[1:]:
            union = union.unionByName(x)
        union = stash(union)
        for names in self.levels.values():
            self._forget(names)
        return union

    def _forget(self, names: list[str]) -> None:
        """Tables leave the catalog; their files go with the shared folder."""
        for x in names:
            self.spark.sql(f"DROP TABLE {x}")


_FIRST = -(1 << 63)


def dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """docs with `text` reduced to the lines that stay, and n_lines and n_dropped."""
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    # the row as one struct, so that its columns' names meet no others
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id"), F.lit(_FIRST)).alias("k"), F.xxhash64("text").alias("t"))
    cuts = rows.agg(F.percentile_approx("k", [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    batch = sum((F.when(F.col("k") > c, 1).otherwise(0) for c in sorted({*cuts})), F.lit(0))
    found = rows.select("k", "t", F.explode(marks(F.col("row.text"))).alias("m"))
    lines = stash(found.select("k", "t", "m.i", "m.h", "m.g", batch.alias("batch")))
    runs = Runs(spark)
    for i in range(len({*cuts}) + 1):
        runs.add(lines.filter(F.col("batch") == i).groupBy("h", "g").agg(F.min("k").alias("owner")))
    lost = lines.join(runs.owners(), ["h", "g"]).filter(F.col("k") != F.col("owner"))
    lost = lost.groupBy("k", "t").agg(F.collect_set("i").alias("lost"))
    out = rows.join(lost, ["k", "t"], "left").withColumn("lines", lines_of(F.col("row.text")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost")
    kept = F.when(F.col("lost").isNull(), F.col("lines")).otherwise(F.transform(left, lambda i: F.get("lines", i)))
    return out.withColumn("kept", kept).select(
        *(F.array_join("kept", "\n").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
    )


def op8(spark, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
o AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k),
m AS (SELECT l.doc_id, i, line, o.owner IS NOT NULL AND o.owner <> l.doc_id AS lost FROM l LEFT JOIN o USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
