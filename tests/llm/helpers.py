"""Small tables with nulls, empty and long texts, ties, repeats and clashing extra columns; and brute-force versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import xxhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, rank bigint, b int, score double, h bigint"


def tricky_texts():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "délta", "ÉPSI", "zeta", "eta!", "x", "ha", "iota", "k9", "<turn>"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, other = line(80), line(50)
    near = line(120).split()
    changed = near[:]
    changed[60] = "CHANGED"
    return [
        None,
        "",
        " \n\t ",
        "one",
        "one two",
        "Same line that is long enough\nshort\n  same LINE that is long enough  \n",
        "SAME line that is long enough\nshort\nother",
        shared,
        line(20) + " " + shared + " " + line(30),
        "\n".join(line(9) for _ in range(30)) + " " + shared[: len(shared) // 2],
        " ".join(near),
        " ".join(changed),
        other + "  " + other,
        "ha " * 400,
        "ha " * 36,
        line(20000),
        "y" * 5000 + " " + "▁ \x00\\<b 漢字🙂",
        "Same line that is long enough",
        other,
        "one",
    ]


def docs_of(spark, texts=None, ids=None):
    texts = tricky_texts() if texts is None else texts
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", f"s{k % 3}", len(t or ""), 7, 7, 7.0, 7) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


UP = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def low(t):
    return (t or "").encode().translate(UP).decode()


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute_repeats(texts, size=35):
    words = [SPLIT.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def brute_lines(rows):
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    owner = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                owner[key(x)] = min(owner.get(key(x), i), i)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if len(key(x)) < 10 or owner[key(x)] == i]
        out.append((i, len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    return out


def brute_fingerprint(t):
    w = SPLIT.findall(low(t))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """(doc_id, text) -> doc_id, fingerprint, component."""
    fp = [(i, brute_fingerprint(t)) for i, t in rows]
    parent = list(range(len(fp)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fp)):
        for b in range(a):
            if (fp[a][1] ^ fp[b][1]).bit_count() <= 3:
                parent[find(a)] = find(b)
    low_id = {}
    for k, (i, _) in enumerate(fp):
        low_id[find(k)] = min(low_id.get(find(k), i), i)
    return [(i, f"{f:016x}", low_id[find(k)]) for k, (i, f) in enumerate(fp)]


WORD6 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(rows, items, size=13):
    out = []
    wins = []
    for item, t in items:
        w = WORD6.findall(low(t))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            wins.append((w[i : i + size], item))
    for i, t in rows:
        w = WORD6.findall(low(t))
        hit, met = set(), set()
        for p, item in wins:
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit.update(range(k, k + len(p)))
                    met.add(item)
        out.append((i, len(w), len(hit), len(met), sha(",".join(sorted(str(x) for x in met if x is not None))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def brute_base(rows, n=7, out=2):
    toks = [[*SPLIT.findall(low(t)), None] for _, t in rows]
    c = collections.Counter(x for (i, _), w in zip(rows, toks, strict=True) if crc(i, n) != out for x in w)
    total, v = sum(c.values()), len(c)
    return [(i, crc(i, n) == out, len(w), sum(c[x] > 0 for x in w), total, sum(math.log10((c[x] + 1) / (total + v + 1)) for x in w)) for (i, _), w in zip(rows, toks, strict=True)]
