"""Fill-in-middle against slices of Python strings."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from laurel.llm import fim

from . import helpers as H

EXTRA = "doc_id bigint, text string, n long, form string, output string, h1 int"


def brute(i, t, seed=1):
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    t, n = t or "", len(t or "")
    if not t or any(x in t for x in fim.SENTINELS) or h3 % 100 >= 90:
        return i, n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return i, n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return i, n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def texts():
    rng = random.Random(2)
    odd = ["\r\n", "\n", "é", "👩‍👩‍👧", "🇩🇪", "\x00", " ", "<", "<P", "S>", "M>", "<<", "\U0010ffff", "汉"]
    mixed = ["".join(rng.choice(odd) for _ in range(rng.choice([1, 3, 255, 256, 257, 600]))) for _ in range(150)]
    return [*H.tricky_texts(), "a<P>b", "<S>", "<M", *mixed, "x" * 300_001, "one", "one"]


def test_transform_and_restore(spark):
    rows = [(i % 170 if i % 9 else None, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame([(*r, 5, "f", "o", 7) for r in rows], EXTRA).repartition(3)
    got = fim.transform(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = sorted((brute(*r) for r in rows), key=repr)
    assert sorted((tuple(r)[:6] for r in got), key=repr) == want
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    assert sorted(r["back"] for r in got) == sorted(t or "" for _, t in rows)
    assert fim.transform(docs.limit(0)).count() == 0


def test_settings(spark):
    docs = spark.createDataFrame([(str(i), f"text {i} [a]" if i % 5 else f"<P> {i}") for i in range(200)], "doc_id string, text string")
    marks = ("[a]", "[b]", "[c]")
    got = fim.transform(docs, seed=3, percent=100, spm_percent=0, sentinels=marks).collect()
    assert {r["form"] for r in got if int(r["doc_id"]) % 5} == {"plain"} and {r["form"] for r in got if int(r["doc_id"]) % 5 == 0} == {"psm"}
    assert {r["form"] for r in fim.transform(docs, percent=0).collect()} == {"plain"}


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_offsets_are_those_of_code_points(n):
    split, t = fim.splitter(), "".join(random.Random(n).choice("aé\n🙂\r") for _ in range(n))
    ends = fim.units(split, t)
    assert (ends[-1] if ends else 0) == n
    assert [fim.offset(split, t, ends, k) for k in range(n + 1)] == list(range(n + 1))


def test_pieces_met_again_are_not_handed_over_again(monkeypatch):
    """Recurring parts of words are split once while they are kept; counts and cuts are those of code points also where the kept ones are forgotten."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abé🙂\n\t") for _ in range(rng.randint(1, 9))) for _ in range(300)] + ["汉" * 700, ""]
    t = " ".join(rng.choice(words[:300]) for _ in range(60_000)) + " " + " ".join(words) + "  "
    from tokenizers import pre_tokenizers

    given, real = [], pre_tokenizers.Split

    class Counting:
        def __init__(self, *args):
            self.split = real(*args)

        def pre_tokenize_str(self, text):
            given.append(len(text))
            return self.split.pre_tokenize_str(text)

    monkeypatch.setattr(pre_tokenizers, "Split", Counting)
    split = fim.splitter()
    ends = fim.units(split, t)
    assert ends[-1] == len(t) and sum(given) < len(t) / 20
    ranks = [0, 1, 255, 256, 2047, 2048, 2049, 65_535, 65_536, len(t) - 1, len(t), *(rng.randrange(len(t)) for _ in range(60)), *range(len(t) - 720, len(t), 9)]
    assert [fim.offset(split, t, ends, k) for k in ranks] == ranks
    monkeypatch.setattr(fim, "KEPT", 7, raising=False)
    few = fim.splitter()
    assert fim.units(few, t) == ends and len(few) <= 7 and [fim.offset(few, t, ends, k) for k in ranks] == ranks
