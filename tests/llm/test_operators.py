"""The dealt operators against brute force on tricky rows."""

import collections
import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from laurel.llm import chat, decontaminate, linededup, maxent, neighbours, phrases, pieces, shard, simhash, toxicity
from laurel.llm.common import crc_mod

from . import helpers as H


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return H.docs_of(spark).repartition(3).cache()


TEXTS = H.tricky_texts()
ROWS = list(enumerate(TEXTS))


# ---- 1 -----------------------------------------------------------------------------------------------------------------


def labelled(spark, n=900, seed=1):
    """Texts of made-up words; toxic ones hold spellings of three stems that differ from text to text."""
    rng = random.Random(seed)
    syll = ["ba", "ne", "tor", "li", "mu", "ska", "den", "pro", "fi", "ge"]
    word = lambda: "".join(rng.choice(syll) for _ in range(rng.randint(1, 4)))
    texts, toxic = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(30, 200))]
        bad = i % 6 == 0
        for _ in range(max(1, len(w) // 40) if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["zqux", "vorgl", "hrump"]) + word())
        texts.append(" ".join(w))
        toxic.append(int(bad))
    labels = spark.createDataFrame([(i, 1, t, "extra") for i, t in enumerate(toxic)] + [(10**6, 1, 1, "gone"), (3, 0, None, "null")], "doc_id bigint, quality int, toxic int, text string")
    return H.docs_of(spark, texts), labels, toxic


def test_toxicity_learns_stems_and_scores_held_out(spark):
    docs, labels, toxic = labelled(spark)
    held = crc_mod(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, labels, held)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    out = [i for i in got if H.crc(i, 5) == 0]
    caught = [got[i] >= 0.5 for i in out if toxic[i]]
    false = [got[i] >= 0.5 for i in out if not toxic[i]]
    assert np.mean(caught) >= 0.9 and np.mean(false) <= 0.05
    again = toxicity.train(docs.repartition(7), labels, held)
    assert (again.emb == model.emb).all() and (again.bias == model.bias).all()


def test_toxicity_does_not_jump_with_the_number_of_labels(spark):
    rng = random.Random(6)
    rare = ["".join(rng.sample("bcdfghjklmnpqrstvwxz", 8)) for _ in range(10)]  # each in four texts
    common = ["".join(rng.choice("aeiou") for _ in range(6)) for _ in range(30)]
    texts = [" ".join([*rng.sample(common, 8), *([rare[i // 4]] * 4 if i < 40 else [])]) for i in range(200)]
    docs = H.docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(200)], "doc_id bigint, toxic int")
    gaps = []
    for n in (199, 200):
        got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels.filter(F.col("doc_id") < n))).collect()}
        gaps.append(sum(got[i] for i in range(40)) / 40 - sum(got[i] for i in range(40, 200)) / 160)
    assert abs(gaps[1] - gaps[0]) < 0.1 and min(gaps) > 0.2


def test_toxicity_of_odd_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, none)).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["score"] < 0.5 for r in got)
    one = spark.createDataFrame([(1, 1, 1), (3, 1, 0), (7, 1, 0), (8, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, one)).collect()
    assert all(math.isfinite(r["score"]) for r in got)
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), none)).count() == 0
    kept = toxicity.keep_clean(docs, none)
    assert kept.columns == docs.columns and {r["score"] for r in kept.collect()} == {7.0}


def test_toxicity_ignores_how_texts_are_batched():
    rng = np.random.default_rng(0)
    m = toxicity.Model(rng.normal(size=(1 << toxicity.BITS, toxicity.DIM)).astype(np.float32), rng.normal(size=(toxicity.DIM, 2)).astype(np.float32), np.zeros(2, np.float32))
    t = pa.array(TEXTS)
    assert np.allclose(m.scores(t), np.concatenate([m.scores(t.slice(i, 1)) for i in range(len(TEXTS))]))


def brute_bag(text):
    """Counts of the buckets of a text's words and of the 4- and 5-grams of its words with their borders."""
    bag, m64 = collections.Counter(), (1 << 64) - 1
    table = [[int(x) for x in row] for row in toxicity._OFFSETS]

    def bucket(h, kind):
        h = (h ^ (h >> 31)) * ((0x9E3779B97F4A7C15 * (2 * kind + 1)) & m64) & m64
        return h >> (64 - toxicity.BITS)

    for w in bytes(toxicity._FOLD[list((text or "").encode())]).split(b" ") if text else []:
        if not w:
            continue
        bag[bucket(sum(table[0][b] * pow(toxicity._BASE, i, 1 << 64) for i, b in enumerate(w)) & m64, 1)] += 1
        edged = b" " + w + b" "
        for n in toxicity.NGRAMS:
            for i in range(len(edged) - n + 1):
                bag[bucket(sum(table[k][b] for k, b in enumerate(edged[i : i + n])) & m64, n)] += 1
    return bag


def test_toxicity_against_brute_force():
    texts = [t for t in TEXTS if len(t or "") < 3000] + ["Ab\x00cde ÀÉ f"]
    where, shares = toxicity._bags(pa.array(texts))
    rng = np.random.default_rng(4)
    m = toxicity.Model(rng.normal(size=(1 << toxicity.BITS, toxicity.DIM)).astype(np.float32), rng.normal(size=(toxicity.DIM, 2)).astype(np.float32), np.array([0.1, 0.4], np.float32))
    got = m.scores(pa.array(texts))
    for t, b, s, score in zip(texts, where, shares, got, strict=True):
        bag = brute_bag(t)
        total = sum(bag.values()) + toxicity.PAD
        assert dict(zip(b.tolist(), s.tolist(), strict=True)) == pytest.approx({k: n / total for k, n in bag.items()}, rel=1e-5)
        z = sum(n * (m.emb[k].astype(float) @ m.out.astype(float)) for k, n in bag.items()) / total + m.bias
        assert abs(1 / (1 + math.exp(z[0] - z[1])) - score) < 1e-4


def test_bags_of_long_texts_are_bounded():
    text = " ".join(str(n * 7919) for n in range(20_000))
    where, shares = toxicity._bags(pa.array([text]))
    bag = brute_bag(text)
    assert len(bag) > len(where[0]) == toxicity.BAG and set(where[0].tolist()) <= set(bag)
    assert shares[0].sum() == pytest.approx(1, abs=1e-3)


# ---- 2 -----------------------------------------------------------------------------------------------------------------


def test_template_language():
    t = chat.Template("{% set a = 1 + 2 %}{% if a == 3 and not false %}{{ 'x' ~ a | string }}{% else %}no{% endif %}{% for m in messages %}{{ loop.index }}{{ m['role'] | upper }}{% if loop.last %}.{% else %},{% endif %}{% endfor %}{# note #}")
    assert t.render([{"role": "a"}, {"role": "b"}])[0] == "x31A,2B."
    assert not t.separable
    assert chat.Template("a{{ 1 + 1 }}{% if true %}b{% endif %}").tree == [("text", "a2b")]
    text, spans = chat.Template("{% for m in messages %}<{% generation %}{{ m.t }}{% endgeneration %}>{% endfor %}").render([{"t": "ab"}, {"t": ""}, {"t": "c"}])
    assert text == "<ab><><c>" and [text[a:b] for a, b in spans] == ["ab", "c"]


@pytest.mark.parametrize("bad", ["{{ x.__class__() }}", "{% for x in y %}", "{{ a | eval }}", "{% import os %}", "{% endif %}", "{{ 'a }}", "{% for 1 in x %}{% endfor %}"])
def test_templates_that_are_refused(bad):
    with pytest.raises(chat.TemplateError):
        chat.Template(bad)


def test_dots_reach_no_attributes():
    assert chat.Template("{{ m.__class__ }}{{ m.x.y }}").render([], m={"x": "s"})[0] == ""


def test_guard_is_reversible():
    for t in [*filter(None, TEXTS), "\\l\\b<\\<</turn>\n<turn>", "\\### Assistant: </turn> ok"]:
        assert chat.unguard(chat.guard(t)) == t and "<" not in chat.guard(t)


CONV = "conv_id bigint, turn bigint, role string, text string, part bigint"


def conversations():
    out = [(1, k, ["user", "assistant"][k % 2], t, 0) for k, t in enumerate(TEXTS)]
    out += [(2, 0, "user", "</turn>\n<turn>", 0), (2, 0, "user", "</turn>\n<turn>", 0), (2, None, None, None, 0), (None, 1, "assistant", "a", 0), (None, 2, "assistant", "b", 0)]
    return out + [(c, k, "assistant" if k % 3 else "user", f"{c}-{k} <b>", 0) for c in range(3, 30) for k in range(5)] + [(77, k, "assistant", f"turn {k}", 0) for k in range(700)]


@pytest.mark.parametrize("size", [1 << 18, 200])
def test_formatted_conversations_read_back(spark, size):
    import hashlib

    rows = conversations()
    got = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, CONV).repartition(5), piece_chars=size)).collect()
    groups = collections.defaultdict(list)
    for c, turn, role, text, _ in rows:
        groups[c].append(((turn is not None, turn or 0), role or "", text or ""))
    assert len(got) == len(groups)
    for r in got:
        turns = sorted(groups[r["conv_id"]])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), H.sha(loss))
        assert r["formatted_chars"] == len(chat.Template(chat.CHAT).render([{"role": a, "text": t} for _, a, t in turns])[0])
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], CONV))).count() == 0


# ---- 3 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("block", "nodes"), [(8 << 20, 400_000), (20_000, 100)])
def test_repeats(spark, docs, block, nodes):
    got = rows_of(phrases.remove_repeats(docs, block_bytes=block, nodes=nodes), "doc_id", "n_words", "n_removed", "kept")
    want = sorted(((i, *x) for i, x in enumerate(H.brute_repeats(TEXTS))), key=repr)
    assert got == want
    assert phrases.remove_repeats(docs.limit(0)).count() == 0


def test_automata_alone_locate(spark, docs, monkeypatch):
    monkeypatch.setattr(phrases, "automata", lambda *_: [])
    assert {r["n_removed"] for r in phrases.remove_repeats(docs).collect()} == {0}


def test_phrases_are_spelled_once_and_whole(spark):
    rng = random.Random(2)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(500))
    docs = H.docs_of(spark, [text, text, "x " + text + " y", text])
    out = phrases.remove_repeats(docs).collect()
    assert sorted(r["n_removed"] for r in out) == [500] * 4
    w = phrases.Windows(*phrases.buffers(pa.array([text])))
    marks = pa.table({"b": pa.array([0] * len(set(w.anchor.tolist())), pa.int32()), "h": pa.array(np.unique(w.anchor).view(np.int64)), "single": [False] * len(set(w.anchor.tolist())), "chained": [True] * len(set(w.anchor.tolist()))})
    spelled = phrases._spelled(35)(pa.table({"doc_id": [1, 2], "text": [text, text], "b": pa.array([0, 0], pa.int32())}), marks)
    assert [x.as_py().decode() for x in spelled.column("phrase")] == [text]


def test_repeats_of_random_texts(spark):
    rng = random.Random(8)
    base = [str(rng.randrange(50)) for _ in range(600)]
    texts = []
    for _ in range(60):
        a = rng.randrange(500)
        w = base[a : a + rng.randint(30, 100)]
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = "new"
        texts.append(" ".join([str(rng.randrange(9)) for _ in range(rng.randrange(20))] + w))
    got = rows_of(phrases.remove_repeats(H.docs_of(spark, texts), block_bytes=3000, nodes=200), "doc_id", "n_words", "n_removed", "kept")
    assert got == sorted(((i, *x) for i, x in enumerate(H.brute_repeats(texts))), key=repr)


# ---- 4 -----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocab():
    return pieces.Pieces(pieces.vocabulary())


def weighted():
    """Text pieces by spelling: (id, weight), as the docstring defines weights; and byte pieces' ids."""
    words = [(p.replace("▁", " "), i) for i, (p, kind) in enumerate(pieces.vocabulary()) if kind == 0]
    norm = sum(1 / (r + 2.7) for r in range(len(words)))
    return {p: (i, 1 / (r + 2.7) / norm) for r, (p, i) in enumerate(words)}


def all_paths(text):
    """The law of all segmentations of a text of characters that are pieces."""
    vocab, text = weighted(), " " + text

    def rest(i):
        if i == len(text):
            return [((), 1.0)]
        arcs = [(vocab[text[i:j]], j) for j in range(i + 1, len(text) + 1) if text[i:j] in vocab]
        return [((v, *x), w * q) for (v, w), j in arcs for x, q in rest(j)]

    out = dict(rest(0))
    total = sum(out.values())
    return {p: w / total for p, w in out.items()}


def log_total(text):
    """Log of the weights of all segmentations of a text of characters that are pieces, by a sum over positions; and the vocabulary."""
    vocab, text = weighted(), " " + text
    logs = [0.0] * (len(text) + 1)
    for i in range(len(text) - 1, -1, -1):
        logs[i] = np.logaddexp.reduce([math.log(vocab[text[i:j]][1]) + logs[j] for j in range(i + 1, min(len(text), i + 20) + 1) if text[i:j] in vocab])
    return logs[0], {i: math.log(w) for i, w in vocab.values()}


def test_samples_follow_the_law_without_replacement(vocab):
    law = all_paths("the in")
    assert abs(sum(law.values()) - 1) < 1e-9
    n, k = 4000, 3
    first, total = collections.Counter(), collections.Counter()
    for found in pieces.Chunk(["the in"] * n, np.arange(n, dtype=np.uint64), vocab, 5).top_k(k):
        ids = [tuple(f[0].tolist()) for f in found]
        assert len(set(ids)) == k and [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)
        first[ids[0]] += 1
        for i, f in zip(ids, found, strict=True):
            assert abs(f[1] - math.log(law[i])) < 1e-8
            total[i] += 1 / f[3]
    for path in sorted(law, key=law.get)[-2:]:
        assert abs(first[path] / n - law[path]) < 0.015
        assert abs(total[path] / n - 1) < 0.1


def test_exhausted_lattices(vocab):
    law = all_paths("a")
    (found,) = pieces.Chunk(["a"], np.zeros(1, np.uint64), vocab, 5).top_k(50)
    assert {tuple(f[0].tolist()) for f in found} == set(law) and all(f[3] == 1 for f in found)


def test_long_stretches_follow_the_law(vocab):
    text = "".join(random.Random(5).choice("etaoinshrdlu") for _ in range(9000))  # nothing cuts it; longer than a block
    total, log_w = log_total(text)
    (found,) = pieces.Chunk([text], np.zeros(1, np.uint64), vocab, 3).top_k(3)
    assert len({tuple(f[0].tolist()) for f in found}) == 3
    assert all(abs(sum(log_w[i] for i in f[0].tolist()) - total - f[1]) < 1e-6 for f in found)
    short, n = text[:40], 3000
    total, log_w = log_total(short)
    got = [f for found in pieces.Chunk([short] * n, np.arange(n, dtype=np.uint64), vocab, 4).top_k(1) for f in found]
    total_mass = {tuple(f[0].tolist()): math.exp(f[1]) for f in got}
    seen = collections.Counter(tuple(f[0].tolist()) for f in got)
    for path, p in sorted(total_mass.items(), key=lambda x: -x[1])[:3]:
        assert abs(seen[path] / n - p) < 4 * math.sqrt(p / n) and abs(math.exp(sum(log_w[i] for i in path) - total) - p) < 1e-9


def test_samples_do_not_depend_on_segments(vocab):
    texts = [TEXTS[9], None, "".join(random.Random(6).choice("etaoin") for _ in range(3000)), TEXTS[16]]
    a, b = (pieces.Chunk(texts, np.arange(4, dtype=np.uint64), vocab, 3, segment=n).top_k(4) for n in (None, 300))
    assert [[(x[0].tolist(), *x[1:]) for x in t] for t in a] == [[(x[0].tolist(), *x[1:]) for x in t] for t in b]


def test_encoding_decodes_exactly_and_depends_on_the_row_only(spark, docs):
    a = pieces.decode(pieces.encode(docs, 3)).collect()
    both = pieces.encode(docs, 3, decoded=True)
    assert sorted(map(tuple, both.collect()), key=repr) == sorted(map(tuple, a), key=repr)
    text = {i: t or "" for i, t in ROWS}
    assert all(r["decoded"] == text[r["doc_id"]] for r in a)
    assert {r["doc_id"] for r in a} == set(text)
    assert max(collections.Counter((r["doc_id"], tuple(r["pieces"])) for r in a).values()) == 1
    b = pieces.encode(docs.repartition(1), 3).collect()
    key = lambda r: (r["doc_id"], r["rank"], tuple(r["pieces"]), r["perturbed"], r["inclusion"])
    assert sorted(map(key, a)) == sorted(map(key, b))
    assert pieces.encode(docs.limit(0)).count() == 0
    assert pieces.encode(spark.createDataFrame([(None, "a b")], "doc_id bigint, text string")).count() == 2


# ---- 5 -----------------------------------------------------------------------------------------------------------------


def brute_nearest(ids, v, q, k):
    at = int(np.flatnonzero(ids == q)[0])
    d = np.sqrt(((v - v[at]) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


def test_neighbours_recall_and_ties(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 300)
    monkeypatch.setattr(neighbours, "PART_ROWS", 200)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(2000, 16))
    v[::3] = v[0]  # a third of all rows are one vector
    ids = np.arange(2000)
    rows = [(int(i), [float(x) for x in r], 1, 0.0) for i, r in zip(ids, v, strict=True)]
    odd = [(5000, None, 1, 0.0), (5001, [], 1, 0.0), (5002, [0.0] * 16, 1, 0.0), (5003, [float("nan")] * 16, 1, 0.0), (5004, [1.0, None] * 8, 1, 0.0), (5005, [1.0] * 3, 1, 0.0), (None, [1.0] * 16, 1, 0.0)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, rank int, score double").repartition(4)
    got = collections.defaultdict(list)
    for r in neighbours.search(df, df.filter("vec_id % 50 = 0")).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit = n = 0
    for q in range(0, 2000, 50):
        want = brute_nearest(ids, v, q, 10)
        mine = sorted(got.pop(q))
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(abs(np.sqrt(((v[i] - v[q]) ** 2).sum()) - s) < 1e-12 for _, i, s in mine)
        if q % 3 == 0:
            assert [m[1] for m in mine] == [w[0] for w in want]  # ties at distance 0 go to the smaller ids
        hit += len({m[1] for m in mine} & {w[0] for w in want})
        n += 10
    assert hit / n >= 0.9 and not got


def test_neighbours_of_few_rows(spark):
    kind = "vec_id bigint, embedding array<float>"
    three = spark.createDataFrame([(0, [1.0, 0.0]), (100, [0.0, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0])], kind)
    got = rows_of(neighbours.search(three, three.filter("vec_id % 100 = 0")), "query_id", "rank", "vec_id")
    assert got == [(0, 1, 7), (0, 2, 100), (100, 1, 7), (100, 2, 0)]
    none = spark.createDataFrame([], kind)
    assert neighbours.search(none, none).count() == 0


def test_cells_cover_all_space():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(3000, 4))
    points[:1000] = points[0]
    cells = neighbours.Cells(points[::3], 40)
    probe = np.vstack([points, rng.normal(size=(500, 4)) * 50])
    c = cells.of(probe)
    assert len(cells.lo) == 40 and ((probe > cells.lo[c]) & (probe <= cells.hi[c])).all() and len(np.unique(c)) == 40
    assert len(neighbours.Cells(np.zeros((50, 4)), 8).lo) == 1
    assert [neighbours.cells_for(n) for n in (1, 8192, 8193, 1 << 21, 1 << 29)] == [1, 1, 2, 256, 4096]


def test_repeated_rows_take_one_place(spark):
    kind = "vec_id bigint, embedding array<float>"
    rows = [(0, [1.0, 0.0])] * 15 + [(7, [1.0, 0.5])] * 15 + [(i, [1.0, 0.0]) for i in (20, 21)] + [(i, [1.0, float(i)]) for i in range(30, 36)]
    rows += [(8, [1.0, 2.0]), (8, [1.0, -2.0])]  # one id, two vectors, equally far
    df = spark.createDataFrame(rows, kind).repartition(4)
    got = rows_of(neighbours.search(df, df.filter("vec_id = 0")), "query_id", "rank", "vec_id")
    assert sorted(got) == [(0, r, i) for r, i in enumerate([20, 21, 7, 8, 8, 30, 31, 32, 33, 34], 1)]


# ---- 6 -----------------------------------------------------------------------------------------------------------------


def test_decontamination(spark, docs, monkeypatch):
    long = TEXTS[15].split()
    items = [(1, " ".join(long[500:540])), (2, "one"), (3, None), (4, ""), (5, "one TWO"), (12, " ".join(long[700:713])), (30, TEXTS[7]), (1, "iota k9 x"), (6, "ha ha ha"), (None, " ".join(long[900:920])), (None, "gamma ha x")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, n_words int")
    want = sorted(H.brute_hits(ROWS, items), key=repr)
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for block, piece in ((200_000, 4096), (20, 4096), (20, 5)):
        monkeypatch.setattr(decontaminate, "PIECE", piece)
        assert rows_of(decontaminate.digest(decontaminate.hits(docs, bench, block_windows=block)), *cols) == want
    clean = decontaminate.keep_clean(docs.withColumn("n_words", F.lit("mine")), bench)
    assert clean.columns == [*docs.columns, "n_words"] and {r["n_words"] for r in clean.collect()} == {"mine"} and {r["doc_id"] for r in clean.collect()} == {w[0] for w in want if not w[5]}
    assert decontaminate.keep_clean(docs, bench.limit(0)).count() == len(TEXTS)
    assert decontaminate.hits(docs.limit(0), bench).count() == 0


def test_windows_that_many_items_share():
    items = [(i, "a b") for i in range(50_000)]
    began = time.process_time()
    (ids,) = decontaminate.windows_of(items).values()
    assert len(ids) == 50_000 and time.process_time() - began < 3


# ---- 7 -----------------------------------------------------------------------------------------------------------------


def test_curve_visits_neighbouring_cells(spark):
    n = 1 << 3
    cells = spark.range(n**3).selectExpr(f"cast(id % {n} as int) hx", f"cast(id div {n} % {n} as int) hy", f"cast(id div {n * n} as int) hz")
    path = [(r["hx"], r["hy"], r["hz"]) for r in cells.withColumn("c", shard.hilbert_index("hx", "hy", "hz", 3)).orderBy("c").collect()]
    assert len(set(path)) == n**3
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(path, path[1:], strict=False))


@pytest.mark.parametrize("times", [1, 30])
def test_shards(spark, docs, times):
    import zlib

    many = docs
    for _ in range(times - 1):
        many = many.unionByName(docs)
    got = shard.assign(many, 7).collect()
    assert len(got) == len(TEXTS) * times
    by = collections.defaultdict(list)
    for r in got:
        t = (TEXTS[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 16, zlib.crc32(t), "rows", None)
        by[r["shard"]].append(r)
    sizes = [len(by[s]) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(7))
    assert all(sorted(r["slot"] for r in rows) == list(range(len(rows))) for rows in by.values())
    assert shard.assign(docs.limit(0)).count() == 0


def shard_rows(spark, seed=3, n=4000, copies=True):
    """Texts with groups of 2 to 12 copies in different languages and sources."""
    rng = random.Random(seed)
    rows, i = [], 0
    while i < n:
        m = rng.choice([*[1] * 40, 2, 3, 5, 12]) if copies else 1
        t = "w" * rng.randrange(1, 3000) + str(i)
        for _ in range(m):
            rows.append((i, t, rng.choice(["de", "en", "es", "fr"]), f"s{rng.randrange(100):02d}"))
            i += 1
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(5)


def test_equal_texts_stay_in_one_shard(spark):
    docs = shard_rows(spark)
    got = shard.assign(docs, 20).collect()
    sizes = collections.Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 20
    where = collections.defaultdict(set)
    for r in got:
        where[r["text_hash"]].add(r["shard"])
    assert all(len(x) == 1 for x in where.values())
    plain = sorted(got, key=lambda r: (r["curve"], r["text_crc32"], r["size"], r["text_hash"], r["doc_id"]))
    cuts = [(k * len(got) + 19) // 20 for k in range(1, 20)]
    assert any(plain[c]["text_hash"] == plain[c - 1]["text_hash"] for c in cuts)  # mere runs would split some
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_cuts_come_from_all_values(spark):
    many = spark.range(6001).select(F.format_string("s%05d", "id").alias("source"))
    many = many.unionByName(many.limit(50)).unionByName(spark.createDataFrame([(None,)], "source string"))
    values = ["", *(f"s{i:05}" for i in range(6001))]
    assert shard._value_cuts(many, "source") == [values[6002 * i // 32] for i in range(1, 32)]
    few = spark.createDataFrame([(x,) for x in ["b", "a", None, "a", "c"]], "source string")
    assert shard._value_cuts(few, "source") == ["a", "b", "c"] and shard._value_cuts(few.limit(0), "source") == []


def test_shards_can_be_skipped(spark):
    docs = shard_rows(spark, copies=False)
    placed = {r["doc_id"]: r["shard"] for r in shard.assign(docs, 40).collect()}
    rows = docs.collect()

    def read(shard_of):
        """Shards whose least and greatest values admit a filter, summed over filters on each dimension."""
        n = 0
        for value, wanted in ((lambda r: r["lang"], ["en", "fr"]), (lambda r: r["source"], ["s10", "s77"]), (lambda r: len(r["text"]), [100, 2900])):
            stats = collections.defaultdict(list)
            for r in rows:
                stats[shard_of(r)].append(value(r))
            n += sum(min(x) <= v <= max(x) for x in stats.values() for v in wanted)
        return n

    rng = random.Random(1)
    assert read(lambda r: placed[r["doc_id"]]) < 0.6 * read(lambda r: rng.randrange(40))
    cell = shard.cells(docs)
    assert cell.select("hx").distinct().count() == 4 and cell.select("hy").distinct().count() == 32 and cell.select("hz").distinct().count() == 32


def test_written_shards_hold_all_rows(spark, docs, tmp_path):
    odd = docs.unionByName(docs.filter("doc_id < 4").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.filter("doc_id = 7"))
    odd = odd.withColumns({"shard": F.lit("x"), "curve": F.lit("y")})
    shard.write(odd, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("shard").distinct().count() == 4 and {r["shard"] for r in back.collect()} == set(range(4))
    same = [c for c in odd.columns if c != "shard"]
    assert rows_of(back, *same) == rows_of(odd, *same)


# ---- 8 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_lines(spark, docs, batches):
    out = linededup.dedup(docs, batches)
    got = rows_of(out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("d")), "doc_id", "n_lines", "n_dropped", "d")
    assert got == sorted(H.brute_lines(ROWS), key=repr)
    assert set(docs.columns) <= set(out.columns)


def test_lines_of_odd_tables(spark, docs):
    assert linededup.dedup(docs.limit(0)).count() == 0
    twice = linededup.dedup(H.docs_of(spark, ["a long line here\nb", "a long line here\nb", "a long line here"], [5, 5, None]))
    assert rows_of(twice, "doc_id", "n_dropped") == [(5, 1), (5, 1), (None, 0)]
    assert [x for x in spark.catalog.listTables() if x.name.startswith("run_")] == []
    names = ["k", "t", "h", "g", "i", "batch", "owner", "lost", "lines", "kept", "row", "_lost", "_k", "n_lines"]
    clash = H.docs_of(spark, ["a long line here\nb", "a long line here"]).select("doc_id", "text", *(F.lit(3).alias(n) for n in names))
    got = linededup.dedup(clash)
    assert got.columns == ["doc_id", "text", *names[:-1], "n_lines", "n_dropped"]
    assert rows_of(got, "doc_id", "text", "k", "row") == [(0, "a long line here\nb", 3, 3), (1, "", 3, 3)]


def test_lines_of_a_very_long_text(spark):
    long = "\n".join(f"line number {n} of many" for n in range(100_000))
    docs = H.docs_of(spark, [long, "x\n" + long + "\ny", long])
    assert rows_of(linededup.dedup(docs), "doc_id", "text", "n_lines", "n_dropped") == [(0, long, 100_000, 0), (1, "x\ny", 100_002, 100_000), (2, "", 100_000, 100_000)]


# ---- 9 -----------------------------------------------------------------------------------------------------------------


def test_lm_counts_and_law(spark, docs):
    got = rows_of(maxent.score(docs, crc_mod(F.col("doc_id"), 7) == 2), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    want = sorted(H.brute_base(ROWS), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) < 1e-9 * max(1, abs(w[5])) and math.isfinite(g[6]) and g[6] < 0 for g, w in zip(got, want, strict=True))
    assert maxent.score(docs.limit(0), crc_mod(F.col("doc_id"), 7) == 2).count() == 0
    none = maxent.score(docs, F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in none)


def test_lm_changes_travel_with_large_sums_of_squares():
    rng = np.random.default_rng(3)
    change = rng.normal(size=(64, maxent.CLASSES + maxent.BUCKETS + 2)).astype(np.float32)
    change[:, -2:] = 10.0 ** rng.uniform(0, 30, (64, 2))
    got = np.concatenate([maxent.unpacked(x) for x in maxent.packed(change)])
    assert np.allclose(got, change, rtol=1e-3, atol=1e-3) and (got[:, -2:] == change[:, -2:]).all()
    for bad in (np.inf, np.nan, 1e6):
        change[5, 7] = bad
        with pytest.raises(FloatingPointError):
            maxent.packed(change)


def test_lm_scores_stay_finite_where_contexts_are_hot(spark):
    # one context in every minibatch: its sums of squares pass 65504 in the first
    docs = H.docs_of(spark, ["same " * 20_000 + f"other{i}" for i in range(12)])
    held = crc_mod(F.col("doc_id"), 7) == 2
    got = maxent.score(docs, held).collect()
    assert all(math.isfinite(r["score"]) for r in got) and all(r["score"] > -20_000 for r in got)


def test_lm_learns_order(spark, monkeypatch):
    monkeypatch.setattr(maxent, "BATCH", 256)  # 24,000 words are a few minibatches only
    rng = random.Random(4)
    texts = []
    for _ in range(400):
        w = ["a"]
        for _ in range(60):
            w.append({"a": "b", "b": "c", "c": "d", "d": "a"}[w[-1]] if rng.random() < 0.9 else rng.choice("abcd"))
        texts.append(" ".join(w))
    got = maxent.score(H.docs_of(spark, texts), crc_mod(F.col("doc_id"), 7) == 2).filter("held_out").collect()
    assert sum(r["score"] for r in got) > 0.6 * sum(r["base_score"] for r in got)


def test_context_tells_words_of_one_class_apart():
    rng = random.Random(11)
    words = np.array([b << 54 | rng.getrandbits(54) for b in range(6)], np.uint64)  # all of class 0
    assert (maxent.classes_of(words)[0] == 0).all() and len(set(maxent.classes_of(words)[1])) == 6
    t = np.array([words[n % 6] for n in range(30_000)], np.uint64)
    at = np.array([0, len(t)])
    u, c = np.unique(t, return_counts=True)
    masses = np.ones((maxent.CLASSES, maxent.BUCKETS))
    for x, n in zip(u, c, strict=True):
        k, b = maxent.classes_of(np.array([x]))
        masses[k[0], b[0]] += n + 1
    m = maxent.Model(10, masses)
    x = maxent.contexts(t, at)
    for i in range(0, len(t), 200):
        m.learn(t[i : i + 200], x[:, i : i + 200])
    got = m.log10(t, x, np.full(len(t), c[0])).mean()
    assert got > -0.05 and math.log10(1 / 6) < -0.7


def test_word_softmax_against_brute_force():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    counts = rng.integers(1, 50, 300)
    k, u = maxent.classes_of(words)
    masses = np.ones((maxent.CLASSES, maxent.BUCKETS))  # the unknown word of each bucket
    np.add.at(masses, (k, u), counts + 1)
    m = maxent.Model(9, masses)
    for w in m.weights:
        w += rng.normal(size=w.shape).astype(np.float32)
    x = rng.integers(0, 1 << 64, (3, 300), dtype=np.uint64)
    got = m.log10(words, x, counts)
    for i in range(20):
        row = lambda of, kk, i=i: m.weights[of][m.rows(x[:, i : i + 1], np.array([kk]))[of][:, 0]].sum(0)
        of_class = np.exp(row(0, 0).astype(np.float64)) * masses.sum(1)
        all_words = {}  # the probability of every word, and of each bucket's unknown, in this context
        for c in range(maxent.CLASSES):
            s = np.exp(row(1, c).astype(np.float64))
            own = [(j, (counts[j] + 1) * s[u[j]]) for j in np.flatnonzero(k == c)] + [(("?", c, b), s[b]) for b in range(maxent.BUCKETS)]
            total = sum(p for _, p in own)
            all_words |= {j: of_class[c] / of_class.sum() * p / total for j, p in own}
        assert abs(sum(all_words.values()) - 1) < 1e-9
        assert abs(math.log10(all_words[i]) - got[i]) < 1e-4


def test_rows_follow_the_training_tokens():
    assert [maxent.row_bits(n) for n in (0, 10**5, 10**6, 10**7, 10**12)] == [8, 10, 13, 16, 16]


# ---- 10 ----------------------------------------------------------------------------------------------------------------


def test_components(spark, docs):
    got = rows_of(simhash.classes(docs).select("doc_id", simhash.hex_of("fp").alias("f"), "component_id"), "doc_id", "f", "component_id")
    assert got == sorted(H.brute_components(ROWS), key=repr)
    assert simhash.classes(docs.limit(0)).count() == 0
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {c for _, _, c in got}


def test_one_row_of_each_class_stays_whatever_ids_repeat(spark):
    a, b = TEXTS[7], TEXTS[12]
    rows = [(5, a, "x"), (5, b, "y"), (6, a, "z"), (5, a, "x"), (None, b, "w"), (None, "alone and apart", "n"), (None, "alone and apart", "m"), (9, "alone too", "o")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    got = rows_of(simhash.keep_first(docs), "doc_id", "text")
    assert got == sorted([(5, a), (5, b), (None, "alone and apart"), (9, "alone too")], key=repr)


def near_fingerprints(n=40):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(n)}
    for f in list(fps):
        for d in (1, 2, 3, 4):
            x = f
            for b in rng.sample(range(64), d):
                x ^= 1 << b
            fps.add(x)
    fps |= {0, 1, 3, 7, 15, 1 << 63, 1 << 31, 1 << 32}
    return [f - (1 << 64) if f >> 63 else f for f in fps]


def test_every_link_is_found(spark):
    fps = near_fingerprints()
    got = {(r["u"], r["v"]) for r in simhash.links(spark.createDataFrame([(f, f) for f in fps], "fp bigint, c bigint")).collect()}
    mask = (1 << 64) - 1
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & mask).bit_count() <= 3}
    assert got == want
    stars = {(r["u"], r["v"]) for r in simhash.stars(spark.createDataFrame([(f,) for f in fps], "fp bigint")).collect()}
    assert stars and all(a < b and ((a ^ b) & mask).bit_count() <= 2 for a, b in stars)


def test_a_cluster_of_near_fingerprints_does_not_emit_its_pairs(spark):
    base = random.Random(3).getrandbits(40)
    fps = sorted({base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)})
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    labelled = simhash.labels(spark.createDataFrame([(k, f) for k, f in enumerate(fps)], "doc_id bigint, fp bigint"))
    assert {r["component_id"] for r in labelled.collect()} == {0} and labelled.count() == len(fps)
    lone = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    assert simhash.stars(lone).count() <= 2 * len(fps)


def test_chains_are_one_component(spark):
    from laurel.llm.components import components

    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (5, 5)] + [(300, 301 + i) for i in range(50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100, **dict.fromkeys(range(300, 351), 300)}


@pytest.mark.parametrize(("n", "top"), [(1, 0), (12, 0), (90, 3), (1000, 40), (3000, 65_535)])
def test_gradients_of_a_row_are_summed(n, top):
    """Rows of one token, of some, and of more than are added at once."""
    rng = np.random.default_rng(n)
    rows = ((top + 1) * rng.random((3, n)) ** 3).astype(np.uint16)
    g = rng.normal(size=(n, 8)).astype(np.float32)
    want = np.zeros((top + 1, 8))
    np.add.at(want, rows.ravel(), np.tile(g.astype(np.float64), (3, 1)))
    used, got = maxent.summed(rows, g)
    assert sorted(used.tolist()) == np.unique(rows).tolist() and np.allclose(got, want[used], atol=1e-3)


def test_a_learning_step_sums_in_few_passes():
    """A step costs about as much as a few plain passes over its tokens; sums along the rows of a transposed gradient took three times as much."""
    rng = np.random.default_rng(4)
    t = maxent.mix((3000 * rng.random(4 * maxent.BATCH) ** 4).astype(np.uint64) + np.uint64(1))
    x = maxent.contexts(t, np.array([0, len(t)]))
    model = maxent.Model(16, np.ones((maxent.CLASSES, maxent.BUCKETS)))
    old = np.ones((4 * maxent.BATCH, maxent.CLASSES), np.float32)
    learn, plain = [], []
    for _ in range(4):
        a = time.process_time()
        model.learn(t, x)
        b = time.process_time()
        for _ in range(4):
            old.max(1), old.sum(1), np.exp(old), old.take(np.arange(len(old)), 0)
        learn.append(b - a)
        plain.append(time.process_time() - b)
    assert min(learn) < 2 * min(plain)


def test_softmax_of_large_logits():
    rng = np.random.default_rng(6)
    model = maxent.Model(8, np.ones((maxent.CLASSES, maxent.BUCKETS)))
    for scale in (1, 20, 60, 300, 1e6):
        model.weights[0][:] = rng.normal(size=model.weights[0].shape) * scale
        rows = rng.integers(0, 256, (3, 500)).astype(np.uint16)
        z = model.weights[0].astype(np.float64)[rows].sum(0) + model.bias[0]
        want = np.exp(z - z.max(1, keepdims=True))
        want /= want.sum(1, keepdims=True)
        got = model.softmax(0, rows, model.bias[0])
        assert np.isfinite(got).all() and np.allclose(got, want, atol=1e-4 if scale < 1000 else 0.3)
    assert model.softmax(0, rows[:, :0], model.bias[0]).shape == (0, maxent.CLASSES)
