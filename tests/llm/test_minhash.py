"""Min-max hashing against all pairs of full sets."""

import random

import numpy as np
import pyarrow as pa
import pytest

from laurel.llm import minhash

from . import helpers as H

DOCS = "doc_id bigint, text string, n bigint, node bigint, key bigint, d1 bigint, c bigint, bands string"


def set_of(t):
    w = H.SPLIT.findall(H.low(t))
    return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset(w)


def brute(rows):
    sets = [set_of(t) for _, t in rows]
    groups = {}
    for k, s in enumerate(sets):
        groups.setdefault(s if s else ("", k), []).append(k)
    keys, parent = list(groups), list(range(len(groups)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            s, t = keys[a], keys[b]
            if isinstance(s, frozenset) and isinstance(t, frozenset):
                i = len(s & t)
                if 100 * i >= 80 * (len(s) + len(t) - i):
                    parent[find(a)] = find(b)
    low, where = {}, {}
    for g, k in enumerate(keys):
        for d in groups[k]:
            where[d] = find(g)
            i = rows[d][0]
            if i is not None:
                low[find(g)] = min(low.get(find(g), i), i)
    out = [(i, len(sets[d]), low.get(where[d])) for d, (i, _) in enumerate(rows)]
    return sorted(((*r, r[0] == r[2]) for r in out), key=repr)


def query(spark, rows, parts=4):
    docs = spark.createDataFrame([(*r, 1, 1, 1, 1, 1, "b") for r in rows], DOCS).repartition(parts)
    return sorted((tuple(r) for r in minhash.classes(docs).collect()), key=repr)


def changed(rng, words, share):
    return [f"{w}{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def test_tricky_rows(spark):
    rows = list(enumerate(H.tricky_texts()))
    rows += [(None, "one"), (None, None), (None, "only nulls here"), (None, "only nulls here"), (3, "repeated id, other text"), (3, "repeated id, other text"), (40, "ONE"), (41, "one  two"), (42, "Two\tone"), (43, "\x00 \x01")]
    assert query(spark, rows) == brute(rows)
    assert query(spark, []) == []
    assert query(spark, [(1, None), (2, " ")]) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_groups_chains_and_background(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for g in range(6):  # near copies of a hub, which seldom link to each other
        hub = [rng.choice(vocabulary) for _ in range(200)]
        texts += [" ".join(hub)] + [" ".join(changed(rng, hub, 0.03 + 0.015 * (g % 3))) for _ in range(25)]
    for _ in range(3):  # chains: each a step from the last, far from the first
        text = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(20):
            text = changed(rng, text, 0.03)
            texts.append(" ".join(text))
    shared = [rng.choice(vocabulary) for _ in range(100)]
    texts += [" ".join(shared + [rng.choice(vocabulary) for _ in range(rng.choice([20, 24, 25, 26, 40]))]) for _ in range(60)]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    texts += [f"a b c {x}" for x in "defghij"] + [f"a b c d e f {x}" for x in "ghi"] + ["a a a a", "a a", "a"]
    rng.shuffle(texts)
    rows = list(enumerate(texts + texts[:40]))
    got = query(spark, rows)
    assert got == brute(rows)
    assert 0 < sum(not r[3] for r in got) < len(got)


def test_links_at_the_threshold(spark):
    # 8 of 10 shingles are shared, and one less
    base = [f"x{i}" for i in range(10)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:9], "y"])), (3, " ".join([*base[:8], "z", "u"])), (4, " ".join(base[1:]))]
    sets = [set_of(t) for _, t in rows]
    assert len(sets[0] & sets[1]) * 10 == len(sets[0] | sets[1]) * 8
    assert query(spark, rows) == brute(rows)


def test_signature_values_agree_as_often_as_sets_do():
    rng = random.Random(9)
    agree = []
    for _ in range(40):
        common = [f"c{rng.random()}" for _ in range(80)]
        a, b = (" ".join(common + [f"{s}{rng.random()}" for _ in range(10)]) for s in "ab")
        items, off = minhash.shingle_sets(pa.array([a, b]))
        j = len(set_of(a) & set_of(b)) / len(set_of(a) | set_of(b))
        sig = minhash.signatures(items, off)
        agree.append((sig[:, 0] == sig[:, 1]).reshape(2, -1).mean(axis=1) - j)
    assert np.abs(np.mean(agree, axis=0)).max() < 0.02
    # a minimum that fails makes the maximum less likely to fail, so the two together vary less than independent values would
    assert np.var(np.mean(agree, axis=1)) < 1.3 * np.mean(np.var(agree, axis=0)) / 2


def test_bounds_of_intersections_hold():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 90))) for _ in range(60)]
    items, off = minhash.shingle_sets(pa.array(texts))
    bits = minhash.bitmaps(items, off).view(np.uint64)
    sets = [set_of(t) for t in texts]
    assert np.diff(off).tolist() == [len(s) for s in sets]
    for a in range(60):
        for b in range(60):
            lack = int(np.bitwise_count(bits[a] & ~bits[b]).sum())
            assert len(sets[a] & sets[b]) <= len(sets[a]) - lack


@pytest.mark.parametrize("size", [1, 5, 10**6])
def test_sketches_ignore_how_texts_are_batched(spark, size):
    texts = [t for t in H.tricky_texts() if t is None or len(t) < 3000]
    docs = H.docs_of(spark, texts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = {r["doc_id"]: tuple(r) for r in minhash.sketches(docs.repartition(2)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {r["doc_id"]: tuple(r) for r in minhash.sketches(docs).collect()}
    assert all((len(r[4]) == 52 and len(r[5]) == minhash.WORDS) == (r[1] > 0) for r in got.values())


def test_similar_sets_of_different_classes_meet(spark):
    rng = random.Random(7)
    base = list(range(60))
    sets = {k: sorted(set(rng.sample(base, rng.randint(30, 60))) | {1000 + rng.randrange(200) for _ in range(rng.choice([0, 3, 8, 20]))}) for k in range(120)}
    rows = spark.createDataFrame(list(sets.items()), "node long, items array<long>")
    live = spark.createDataFrame([(b, k, k // 10) for k in sets for b in range(2)], "key long, node long, c long")
    got = {tuple(r) for r in minhash._between(live, rows).collect()}
    close = {(a, b) for a in sets for b in sets if a < b and a // 10 != b // 10 and 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})}
    assert close and close <= got and all(a < b and a // 10 != b // 10 for a, b in got)
    assert len(got) < 120 * 119 // 4
