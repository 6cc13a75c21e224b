"""The Merkle manifest against trees built level by level."""

import hashlib

import pytest
from pyspark.sql import functions as F

from laurel.llm import merkle

from . import helpers as H

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, rank int, total int, path string, block int, none int"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def up(nodes):
    return [h(nodes[i : i + 3]) for i in range(0, len(nodes), 3)]


def root_of(nodes):
    while len(nodes) > 1:
        nodes = up(nodes)
    return nodes[0]


def siblings(nodes, i):
    """(before, after) by level."""
    while len(nodes) > 1:
        k = i - i % 3
        yield nodes[k:i], nodes[i + 1 : k + 3]
        nodes, i = up(nodes), i // 3


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
    subs = [root_of([x[2] for x in groups[g]]) for g in names]
    root, out = root_of(subs), []
    for s, g in enumerate(names):
        leaves = [x[2] for x in groups[g]]
        for i, (*_, leaf, r) in enumerate(groups[g]):
            way = [*siblings(leaves, i), *siblings(subs, s)]
            # ids as text; a null id counts as the empty text
            bad = H.crc("" if r[0] is None else r[0], 2) == 0 and r[4] is not None
            claim = leaf_of((*r[:4], r[4].replace("\n", ""))) if bad else leaf
            for before, after in way:
                claim = h([*before, claim, *after])
            out.append((r[0], leaf, subs[s], root, h(x for b, a in way for x in b + a), claim, claim == root))
    return sorted(out, key=repr)


def made(n_hot, small):
    rows = [(i * 7 % 100_003, "hot", "en", 5, f"a\nb{i}" if i % 3 else "c") for i in range(n_hot)]
    for k, n in enumerate(small):
        rows += [(i, [None, "", "é", "z", "Z", "zz"][k % 6] if k < 6 else f"g{k}", None if i % 2 else "de", None, None if i % 4 == 0 else f"{k}\n") for i in range(n)]
    return rows + [(None, "z", "en", 1, "x\ny"), (None, "z", "en", 1, "x\ny"), (5, "hot", "en", 5, "a\nb"), (5, "hot", "en", 5, "a\nb")]


def query(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 1, 1, "p", 1, 1) for r in rows], DOCS).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    return sorted((tuple(r) for r in merkle.op11(spark, str(tmp_path)).collect()), key=repr)


@pytest.mark.parametrize(("n_hot", "small"), [(2300, [1, 2, 3, 4, 28, 730, 1, 9, 10]), (0, [1]), (0, []), (5, [])])
def test_query(spark, tmp_path, n_hot, small):
    rows = made(n_hot, small)
    want = brute(rows)
    assert query(spark, tmp_path, rows) == want
    if n_hot > 5:
        assert {w[6] for w in want} == {True, False}


def test_several_phases_and_small_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    monkeypatch.setattr(merkle, "SPAN", 9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = made(800, [1] * 40 + [10, 82])
        assert query(spark, tmp_path, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table_and_other_columns(spark, tmp_path):
    assert query(spark, tmp_path, []) == []
    docs = spark.createDataFrame([(k, "a", f"t{k}") for k in range(4)], "k int, g string, t string")
    got = merkle.checked(merkle.manifest(docs, "k", "g", ("k", "t"))).collect()
    assert len(got) == 4 and all(r["folded"] == r["root"] == r["subroot"] for r in got)
    assert {r["leaf"].hex() for r in got} == {leaf_of((k, f"t{k}")) for k in range(4)}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27])
def test_traversal(n):
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    root, steps = merkle.traversed(digests, merkle.height_of(n))
    assert root.hex() == root_of([d.hex() for d in digests])
    assert all(merkle.folded(d, b"".join(s)) == root for d, s in zip(digests, steps, strict=True))


def test_a_changed_row_changes_the_root(spark):
    docs = spark.createDataFrame([(i, "a", "en", 1, f"t{i}") for i in range(30)], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    roots = {merkle.manifest(d).first()["root"] for d in (docs, docs.repartition(7), docs.withColumn("text", F.expr("IF(doc_id = 17, 'x', text)")), docs.filter("doc_id < 29"))}
    assert len(roots) == 3
