"""Merkle manifest of a dataset: digests of rows, of each group and of the whole, and a proof for every row.

Leaves of a group are numbered from 0 in the order of their ids, and every `FAN` consecutive nodes become one until one is left. A tree is
cut into aligned blocks of FAN ** HEIGHT leaves. A block is traversed recursively in postorder: the call returns the digest of its subtree,
and while it unwinds, each child's siblings are appended to all leaves that the child contains. The blocks' roots are the leaves of another
traversal, distributed in the same way, until each group has one node: its subroot. The subroots are the leaves of one more such tree. Paths
are then put together from the top down, each block taking its root's path.

A group of any size is thus many blocks: rows are numbered from a range exchange, whose partitions' offsets are joined back, without a window over a
group's rows. A path is, for each level, one byte of position and run length and the siblings' digests, so that proofs are checked from the row alone.

Defined results: null columns are hashed as `-`; null ids come first and null groups are the first group; rows that share an id go by their leaves'
digests, and equal rows have neighbouring places; an empty table gives no rows; extra columns are ignored, whatever their names. Of very long texts only
digests are shuffled.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc_mod, stash

#: Children of a node, and levels of a block.
FAN, HEIGHT = 3, 6
SPAN = FAN**HEIGHT
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def joined(digests: list[bytes]) -> bytes:
    """The digest of digests, concatenated as hex text."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def traversed(digests: list[bytes], height: int) -> tuple[bytes, list[list[bytes]]]:
    """The digest of the tree of a height over at most FAN ** height leaves, and each leaf's steps from the bottom up."""
    steps: list[list[bytes]] = [[] for _ in digests]

    def walk(lo: int, hi: int, h: int) -> bytes:
        if h == 0:
            return digests[lo]
        width = FAN ** (h - 1)
        cuts = [*range(lo, hi, width), hi]
        below = [walk(a, b, h - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            step = bytes([k << 4 | len(below)]) + b"".join(below[:k] + below[k + 1 :])
            for i in range(a, b):
                steps[i].append(step)
        return joined(below)

    return walk(0, len(digests), height), steps


def height_of(n: int) -> int:
    """Levels above n leaves until one node is left."""
    h = 0
    while FAN**h < n:
        h += 1
    return h


def steps_of(path: bytes):
    """(position, siblings) of each level of a path, from the bottom up."""
    i = 0
    while i < len(path):
        k, n = path[i] >> 4, (path[i] & 15) - 1
        yield k, [path[j : j + 32] for j in range(i + 1, i + 1 + 32 * n, 32)]
        i += 1 + 32 * n


def folded(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf's digest and its path lead to."""
    for k, others in steps_of(path):
        digest = joined([*others[:k], digest, *others[k:]])
    return digest


def row_digest(*columns: Column) -> Column:
    """Binary sha256 of columns, each `-` if null, else its UTF-8 byte count, `:` and its value as text."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with their rank inside their group, by order, and the group's total."""
    keys = [*group, *order]
    placed = stash(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("at", 33).alias("part")
    runs = placed.groupBy(part, *group).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    # a group has one run in each partition at most
    w = W.partitionBy(*group)
    runs = runs.withColumns({"before": F.sum("n").over(w.orderBy("part")) - F.col("n"), "total": F.sum("n").over(w)}).drop("n")
    out = placed.withColumn("part", part).join(runs, ["part", *group])
    return out.withColumn("rank", F.col("at") - F.col("first") + F.col("before")).drop("at", "first", "before", "part")


def _blocks(nodes: DataFrame, group: list[str]) -> DataFrame:
    """nodes (group, rank, total, digest and more) with the path inside their block, and the block's root at its first node."""
    dealt = nodes.withColumn("block", F.expr(f"rank div {SPAN}")).repartition(*group, "block").sortWithinPartitions(*group, "rank")

    def emit(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        digests = table.column("digest").to_pylist()
        total = table.column("total")[0].as_py()
        root, steps = traversed(digests, HEIGHT if total > SPAN else height_of(total))
        paths = pa.array([b"".join(s) for s in steps], pa.binary())
        return pa.RecordBatch.from_arrays([*table.columns, paths, pa.array([root] + [None] * (len(digests) - 1), pa.binary())], names=[*table.schema.names, "path", "root"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            ranks = batch.column("rank").to_numpy()
            cuts = [i for i, r in enumerate(ranks.tolist()) if r % SPAN == 0]
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a in cuts and held:
                    yield emit(held)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield emit(held)

    empty = F.lit(None).cast("binary")
    return dealt.mapInArrow(run, dealt.withColumns({"path": empty, "root": empty}).schema)


def tree(nodes: DataFrame, group: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Written traversals of numbered nodes, from the leaves up, and the root (group, digest) of each group."""
    levels, done = [], []
    while True:
        level = stash(_blocks(nodes, group))
        levels.append(level)
        roots = level.filter("root IS NOT NULL").select(*group, F.col("block").alias("rank"), F.expr(f"(total + {SPAN - 1}) div {SPAN}").alias("total"), F.col("root").alias("digest"))
        done.append(roots.filter("total = 1").select(*group, "digest"))
        nodes = roots.filter("total > 1")
        if nodes.isEmpty():
            out = done[0]
            for d in done[1:]:
                out = out.unionByName(d)
            return levels, stash(out)


def whole_paths(levels: list[DataFrame], group: list[str], above: DataFrame) -> DataFrame:
    """The lowest level's nodes with their path up to `above`: (group, up, and more), the paths of the groups' roots."""
    more = [c for c in above.columns if c not in (*group, "up")]
    out = None
    for level in reversed(levels):
        last = level.filter(f"root IS NOT NULL AND total <= {SPAN}").select(*group, "block").join(above, group)
        up = last if out is None else last.unionByName(out.select(*group, F.col("rank").alias("block"), F.col("path").alias("up"), *more))
        out = level.join(up, [*group, "block"]).withColumn("path", F.concat("path", "up")).drop("up", "block", "root")
    return out


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", columns: tuple[str, ...] = COLUMNS, claimed: Column | None = None) -> DataFrame:
    """key, group, leaf, subroot, root and path of each row in binary; with `claimed`, a digest to be checked, also that (`claim`)."""
    own = ["none", "name"]
    names = {"none": F.col(group).isNotNull(), "name": F.coalesce(F.col(group).cast("string"), F.lit(""))}  # false, a null group, comes first
    leaf = row_digest(*(F.col(c) for c in columns)).alias("digest")
    claim = (F.lit(None).cast("binary") if claimed is None else claimed).alias("claim")
    leaves = stash(docs.select(*(c.alias(n) for n, c in names.items()), F.col(key).alias("id"), leaf, claim))
    levels, subroots = tree(numbered(leaves, own, ["id", "digest"]), own)

    top = ["all"]
    groups = numbered(subroots.withColumn("all", F.lit(0)), top, own)
    above, root = tree(groups, top)
    found = root.first()
    start = root.select("all", F.lit(b"").alias("up"))
    sources = whole_paths(above, top, start).select(*own, F.col("path").alias("up"), F.col("digest").alias("subroot"))
    out = whole_paths(levels, own, stash(sources))
    where = F.when(F.col("none"), F.col("name")).alias(group)
    return out.select(F.col("id").alias(key), where, F.col("digest").alias("leaf"), "subroot", F.lit(found["digest"] if found else None).cast("binary").alias("root"), "path", "claim")


def checked(proofs: DataFrame) -> DataFrame:
    """Rows of `manifest` with the digest of each proof's siblings, and the root that the claim, else the leaf, folds to."""
    at = {c: proofs.columns.index(c) for c in ("leaf", "path", "claim")}

    def run(batches):
        for batch in batches:
            proof, root = [], []
            for leaf, path, claim in zip(*(batch.column(at[c]).to_pylist() for c in ("leaf", "path", "claim")), strict=True):
                proof.append(joined([x for _, others in steps_of(path) for x in others]))
                root.append(folded(leaf if claim is None else claim, path))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(proof, pa.binary()), pa.array(root, pa.binary())], names=[*batch.schema.names, "proof", "folded"])

    empty = F.lit(None).cast("binary")
    return proofs.mapInArrow(run, proofs.withColumns({"proof": empty, "folded": empty}).schema)


def op11(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = row_digest(*(F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in COLUMNS))
    out = checked(manifest(docs, claimed=F.when(crc_mod(F.col("doc_id"), 2) == 0, tampered)))
    text = lambda c: F.lower(F.hex(c))
    return out.select("doc_id", *(text(c).alias(c) for c in ("leaf", "subroot", "root")), text("proof").alias("proof_sha256"), text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in COLUMNS) + ")"
_TAMPERED = "sha256(" + " || ".join(_FIELD.format("replace(text, chr(10), '')" if c == "text" else c) for c in COLUMNS) + ")"
#: crc32 of the decimal id, bit by bit.
_CRC = """xor(4294967295, list_reduce(
    list_transform(range(length(doc_id::VARCHAR)), lambda i: ascii((doc_id::VARCHAR)[i + 1])::BIGINT),
    lambda c, b: list_reduce(range(8), lambda a, k: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)), 4294967295))"""

OP11_SQL = f"""
WITH RECURSIVE groups AS (
  SELECT source AS name, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT source FROM documents)
), leaves AS (
  SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, * FROM (
    SELECT doc_id, g, {_LEAF} AS leaf, CASE WHEN {_CRC} % 2 = 0 THEN {_TAMPERED} END AS claim
    FROM documents JOIN groups ON source IS NOT DISTINCT FROM name)
), nodes AS (
  SELECT g, 0 AS lvl, i, n, leaf AS d FROM leaves
  UNION ALL
  SELECT g, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY g, lvl, i // 3, n
), subroots AS (
  SELECT g, d AS subroot FROM nodes WHERE n = 1
), tops AS (
  SELECT -1 AS g, 0 AS lvl, g AS i, count(*) OVER () AS n, subroot AS d FROM subroots
  UNION ALL
  SELECT g, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY g, lvl, i // 3, n
), places AS (
  SELECT l.g, l.i, x.g AS tree, x.lvl, x.i AS place FROM leaves l JOIN nodes x ON x.g = l.g AND x.i = l.i // (3 ** x.lvl)::BIGINT AND x.n > 1
  UNION ALL
  SELECT l.g, l.i, x.g, x.lvl, x.i FROM leaves l JOIN tops x ON x.i = l.g // (3 ** x.lvl)::BIGINT AND x.n > 1
), every AS (
  SELECT * FROM nodes UNION ALL SELECT * FROM tops
), steps AS (
  SELECT p.g, p.i, p.tree, p.lvl, coalesce(string_agg(s.d, '' ORDER BY s.i) FILTER (s.i < p.place), '') AS before, coalesce(string_agg(s.d, '' ORDER BY s.i) FILTER (s.i > p.place), '') AS behind
  FROM places p JOIN every s ON s.g = p.tree AND s.lvl = p.lvl AND s.i // 3 = p.place // 3 GROUP BY ALL
), proofs AS (
  SELECT g, i, string_agg(before || behind, '' ORDER BY tree < 0, lvl) AS proof, list({{'l': before, 'r': behind}} ORDER BY tree < 0, lvl) AS way FROM steps GROUP BY g, i
), found AS (
  SELECT l.doc_id, l.leaf, s.subroot, (SELECT d FROM tops WHERE n = 1) AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
    list_reduce(coalesce(p.way, []), lambda a, x: {{'l': sha256(x.l || a.l || x.r), 'r': ''}}, {{'l': coalesce(l.claim, l.leaf), 'r': ''}}).l AS folded_root
  FROM leaves l JOIN subroots s USING (g) LEFT JOIN proofs p ON p.g = l.g AND p.i = l.i
)
SELECT *, folded_root = root AS verified FROM found
"""
