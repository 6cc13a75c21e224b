"""Substring dedup with repeated-phrase automata.

A window is 35 consecutive words of one document. Every word that is covered by a window whose word sequence also starts
anywhere else goes. Words are [^\\x20\\x09-\\x0D]+, unchanged.

1. Confirm recurring passages. Each window is given an anchor, its 8-gram of smallest hash, chosen by the window's words
   alone; equal windows thus have equal anchors. A passage is the run of windows that share the occurrence of an anchor. Blocks of documents
   report each of their anchors once: its count, its passage and the passages next to it, where these are always the same. An
   anchor that occurs once clears its windows. An anchor that always has one passage confirms it. Only windows of the other
   anchors are counted one by one, with their neighbours, again once for each block.
2. Spell phrases. A confirmed passage or window is spelled by one block only, the first that holds it. Neighbours that always stand
   together are spelled as one phrase, so copies of a whole document are one phrase. Phrases are rows of the whole corpus, each there once.
3. Compile sharded automata and stream. A phrase goes to the blocks that reported its first anchor (or window). Each block compiles
   what it got into Aho-Corasick automata, in shards of at most `NODES` trie nodes, streams all its documents
   through them, and drops the words that matches cover. The automata alone locate occurrences. Their letters are numbers of
   groups of `LETTER` words, spelled in three signs: a document is streamed once from each of its first `LETTER` words on, and a phrase whose length is no
   multiple of that is two patterns, one from its first word and one up to its last, which together cover it (any 35 words of a
   phrase recur, so each pattern may be removed wherever it stands).

So no automaton grows with the corpus, and no document meets automata that cannot match it. Documents are shuffled once, to a table in
buckets that all steps read. What one anchor or phrase costs is one row for each block that holds it, whatever its number of copies: a
passage in every document of 100 TB is 12 million rows of 48 bytes where its count is summed.

Windows, anchors and passages are compared by 64-bit hashes of their words' 64-bit hashes.

Defined results: null or empty text has no words; texts under 35 words stay; repeated rows are documents of their own; an
empty table gives no rows; extra columns are ignored. A very long text is one document of one block, which holds some 100 bytes
for each of its words.
"""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bucketed, buffers, chunks, in_blocks, mix, prefix, spans, stash, word_hashes

WINDOW, GRAM, LETTER = 35, 8, 5
NODES = 400_000
_POS = np.uint64((1 << 24) - 1)


class Windows:
    """The windows of the texts [i, j) of a block, in runs that share the occurrence of an anchor."""

    def __init__(self, data: np.ndarray, off: np.ndarray, size: int = WINDOW, gram: int = GRAM):
        self.words, self.at = word_hashes(data, off)
        self.size, n = size, len(self.words)
        self.pre = prefix(self.words)
        self.starts = self.run = self.first = self.last = np.zeros(0, np.int64)
        self.anchor = self.passage = self.beside = np.zeros(0, np.uint64)
        if n < size:
            return
        begin = np.arange(n - gram + 1)
        g = spans(self.pre, begin, begin + gram)
        # smallest hash, then leftmost: the position stands in the low bits
        low = (g & ~_POS) | (begin.astype(np.uint64) & _POS)
        wide, reach = size - gram + 1, 1
        while reach * 2 <= wide:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < wide:
            low = np.minimum(low[: reach - wide], low[wide - reach :])
        first = np.arange(n - size + 1)
        place = first + ((low - first.astype(np.uint64)) & _POS).astype(np.int64)
        end = np.repeat(self.at[1:], np.diff(self.at))
        self.starts = first[first + size <= end[: len(first)]]
        if not len(self.starts):
            return
        place = place[self.starts]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (np.diff(self.starts) != 1)
        self.run = np.cumsum(new) - 1
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(place)) - 1
        self.anchor = g[place[a]]
        self.first, self.last = self.starts[a], self.starts[b]
        self.passage = mix(spans(self.pre, self.starts[a], self.starts[b] + size) ^ mix((place[a] - self.starts[a]).astype(np.uint64) + np.uint64(1)))

        self.beside = _beside(self.passage, self.first[1:] == self.last[:-1] + 1)

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, hashes and hashes of the neighbours of the windows of the runs for which `runs` is true."""
        h = spans(self.pre, self.starts, self.starts + self.size)
        chosen = runs[self.run]
        return self.starts[chosen], h[chosen], _beside(h, np.diff(self.starts) == 1)[chosen]


def _beside(h: np.ndarray, together: np.ndarray) -> np.ndarray:
    """Hashes of what stands before and after each of a row of hashes; together: whether one and the next are neighbours."""
    before, after = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
    before[1:] = np.where(together, h[:-1], 0)
    after[:-1] = np.where(together, h[1:], 0)
    return mix(mix(before + np.uint64(1)) + after)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _unsigned(column) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64)


def _windows(table: pa.Table, size: int):
    data, off = buffers(table.column("text"))
    for i, j in chunks(off, 2 << 20):
        yield i, j, data, off, Windows(data[off[i] : off[j]], off[i : j + 1] - off[i], size)


def _block(table: pa.Table) -> int:
    return table.column("b")[0].as_py()


_REPORT = pa.schema([("b", pa.int32()), ("h", pa.int64()), ("n", pa.int64()), ("p", pa.int64()), ("c", pa.int64())])


def _report(b: int, h: np.ndarray, passage: np.ndarray, beside: np.ndarray) -> pa.Table:
    """A row for each distinct h: its count, and what it is and stands beside, null where that varies."""
    if not len(h):
        return _REPORT.empty_table()
    order = np.argsort(h, kind="stable")
    h = h[order]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))

    def one(x: np.ndarray) -> pa.Array:
        x = x[order]
        return pa.array(x[at].view(np.int64), mask=np.minimum.reduceat(x, at) != np.maximum.reduceat(x, at))

    return pa.table([pa.array(np.full(len(at), b, np.int32)), _signed(h[at]), pa.array(np.diff(np.append(at, len(h)))), one(passage), one(beside)], schema=_REPORT)


def _anchors(size: int):
    def run(table: pa.Table) -> pa.Table:
        found = [(w.anchor, w.passage, w.beside) for *_, w in _windows(table, size)]
        return _report(_block(table), *(np.concatenate(x) for x in zip(*found, strict=True))) if found else _REPORT.empty_table()

    return run


def _lookup(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether values stand in the sorted array among."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def _mixed(size: int):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        if not docs.num_rows or not marks.num_rows:
            return _REPORT.empty_table()
        anchors = np.sort(_unsigned(marks.column("h")))
        found = [w.windows(_lookup(w.anchor, anchors)) for *_, w in _windows(docs, size) if len(w.run)]
        h, beside = (np.concatenate(x) for x in list(zip(*found, strict=True))[1:]) if found else (np.zeros(0, np.uint64),) * 2
        return _report(_block(docs), h, h, beside)

    return run


def _spelled(size: int):
    schema = pa.schema([("single", pa.bool_()), ("h", pa.int64()), ("phrase", pa.binary())])

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        """The phrases of a block from what it has to spell: passages by anchor and single windows; chained ones stand always beside the same."""
        if not docs.num_rows or not marks.num_rows:
            return schema.empty_table()
        h, single, chained = _unsigned(marks.column("h")), *(marks.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("single", "chained"))
        known = [[np.sort(h[(single == s) & (chained | c)]) for c in (True, False)] for s in (False, True)]  # all and chained ones
        rows, done = [], set()
        for i, j, data, off, w in _windows(docs, size):
            if not len(w.run):
                continue
            own = _lookup(w.anchor, known[0][0])
            first, key, _ = w.windows(~own)
            there = _lookup(key, known[1][0])
            first, key = np.append(w.first[own], first[there]), np.append(w.anchor[own], key[there])
            last, kind = np.append(w.last[own], first[own.sum() :]), np.arange(len(first)) >= own.sum()
            order = np.argsort(first, kind="stable")
            first, last, key, kind = first[order], last[order], key[order], kind[order]
            chain = np.where(kind, _lookup(key, known[1][1]), _lookup(key, known[0][1]))
            if not len(first):
                continue
            begin = np.ones(len(first), bool)
            begin[1:] = ~(chain[1:] & chain[:-1] & (kind[1:] == kind[:-1]) & (first[1:] == last[:-1] + 1))
            a = np.flatnonzero(begin)
            b = np.append(a[1:], len(first)) - 1
            doc, words = -1, []
            for k, s, lo, hi, d in zip(key[a].tolist(), kind[a].tolist(), first[a].tolist(), (last[b] + size).tolist(), (np.searchsorted(w.at, first[a], "right") - 1).tolist(), strict=True):
                if (s, k) in done:
                    continue
                done.add((s, k))
                if d != doc:
                    doc, words = d, data[off[i + d] : off[i + d + 1]].tobytes().split()
                rows.append((s, k, b" ".join(words[lo - int(w.at[d]) : hi - int(w.at[d])])))
        return pa.table([pa.array([r[0] for r in rows], pa.bool_()), _signed(np.array([r[1] for r in rows], np.uint64)), pa.array([r[2] for r in rows], pa.binary())], schema=schema)

    return run


def automata(patterns, nodes: int = NODES):
    """Aho-Corasick automata over sequences of letters; a match's value is the length of its pattern."""
    machine, load = None, 0
    for p in patterns:
        if machine is not None and load + len(p) > nodes:
            machine.make_automaton()
            yield machine
            machine = None
        if machine is None:
            machine, load = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), 0
        machine.add_word(p, len(p))
        load += len(p)
    if machine is not None:
        machine.make_automaton()
        yield machine


def _letters(words: np.ndarray, step: int) -> np.ndarray:
    """Hashes of the groups of `step` words that begin at each word; groups at a text's end run on into the next text."""
    begin = np.arange(max(0, len(words) - step + 1))
    return spans(prefix(words), begin, begin + step)


def _patterns(words: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of phrases, sorted; the phrases' patterns as numbers of letters from 1, one after the other; and the patterns' lengths."""
    a, m = at[:-1], np.diff(at) // step
    rest = np.diff(at) - m * step
    first, size = np.append(a, (a + rest)[rest > 0]), np.append(m, m[rest > 0])
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    letters = _letters(words, step)[np.repeat(first, size) + step * within] if len(size) else np.zeros(0, np.uint64)
    known = np.unique(letters)
    return known, np.searchsorted(known, letters) + 1, size


#: A letter is spelled in three signs of alphabets of their own, as an automaton looks through the signs that follow a node one by one.
SIGNS = 3


def _signs(letters: np.ndarray, base: int) -> list[int]:
    """Letters from 1 as `SIGNS` signs each; 0, which stands in no pattern, as zeros."""
    n = letters - 1
    spelled = np.stack([1 + n // (base * base), 1 + base + n // base % base, 1 + 2 * base + n % base], axis=1)
    return np.where(letters[:, None] > 0, spelled, 0).ravel().tolist()


def _located(size: int, nodes: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(docs: pa.Table, phrases: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        step = min(LETTER, size)
        known, letters, sizes = _patterns(*word_hashes(*buffers(phrases.column("phrase"))), step)
        base = math.ceil((len(known) + 1) ** (1 / 3)) + 1
        spelled, cut = _signs(letters, base), np.append(0, np.cumsum(sizes) * SIGNS).tolist()
        least = size // step  # letters of the shortest pattern
        data, off = buffers(docs.column("text"))
        parts, streams, covers = [], [], []
        for i, j in chunks(off, 2 << 20):
            words, at = word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
            g = _letters(words, step)
            there = _lookup(g, known)
            ids = np.zeros(len(words), np.int64)
            ids[: len(g)][there] = np.searchsorted(known, g[there]) + 1
            parts.append((i, j, at))
            # only texts with enough letters that stand in patterns
            some = np.append(0, np.cumsum(ids > 0))
            streams.append((ids, [(a, b) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) if b - a >= size and some[b] - some[a] >= least]))
            covers.append(np.zeros(len(words) + 1, np.int64))
        for machine in automata((tuple(spelled[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)), nodes):
            for (ids, texts), cover in zip(streams, covers, strict=True):
                ends, lengths = [], []
                for a, b in texts:
                    for first in range(a, min(a + step, b - step + 1)):
                        for end, length in machine.iter(tuple(_signs(ids[first : b - step + 1 : step], base))):
                            ends.append(first + (end + 1) // SIGNS * step)
                            lengths.append(length)
                ends = np.array(ends, np.int64)
                np.add.at(cover, ends - np.array(lengths, np.int64) // SIGNS * step, 1)
                np.add.at(cover, ends, -1)
        kept, n_words, n_removed = [], [], []
        for (i, j, at), cover in zip(parts, covers, strict=True):
            gone = np.cumsum(cover[:-1]) > 0
            lost = np.concatenate([[0], np.cumsum(gone)])
            for k in range(i, j):
                a, b = at[k - i], at[k - i + 1]
                words = data[off[k] : off[k + 1]].tobytes().split()
                if lost[b] > lost[a]:
                    words = [x for x, g in zip(words, gone[a:b].tolist(), strict=True) if not g]
                kept.append(b" ".join(words).decode())
                n_words.append(int(b - a))
                n_removed.append(int(lost[b] - lost[a]))
        return pa.table([docs.column("doc_id").combine_chunks(), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], schema=schema)

    return run


def remove_repeats(docs: DataFrame, size: int = WINDOW, block_bytes: int = 8 << 20, nodes: int = NODES) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of each document."""
    by_block = bucketed(in_blocks(docs, block_bytes), "b").groupBy("b")
    report, w = "b int, h bigint, n bigint, p bigint, c bigint", W.partitionBy("h")
    one = lambda c: (F.count(c).over(w) == F.count(F.lit(1)).over(w)) & (F.min(c).over(w) == F.max(c).over(w))

    def judged(found: DataFrame) -> DataFrame:
        """What occurs more than once, in each block: whether it is always the same (and chained), and whether this block spells it."""
        found = found.withColumn("all", F.sum("n").over(w)).withColumn("same", one("p")).withColumn("chained", one("c")).withColumn("home", F.min("b").over(w) == F.col("b"))
        return stash(found.filter("all > 1").select("b", "h", "same", "chained", "home"))

    seen = judged(by_block.applyInArrow(_anchors(size), report))
    mixed = judged(by_block.cogroup(seen.filter("NOT same").select("b", "h").groupBy("b")).applyInArrow(_mixed(size), report))
    marks = {False: seen.filter("same"), True: mixed}
    to_spell = [m.filter("home").select("b", "h", F.lit(s).alias("single"), "chained") for s, m in marks.items()]
    phrases = stash(by_block.cogroup(to_spell[0].unionByName(to_spell[1]).groupBy("b")).applyInArrow(_spelled(size), "single boolean, h bigint, phrase binary"))
    routed = [m.select("b", "h").join(phrases.filter(F.col("single") == s), "h").select("b", "phrase") for s, m in marks.items()]
    return by_block.cogroup(routed[0].unionByName(routed[1]).groupBy("b")).applyInArrow(_located(size, nodes), "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def op3(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+34], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 33))) AS i FROM d)),
rep AS (SELECT p FROM win GROUP BY p HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM win JOIN rep USING (p)),
word AS (SELECT doc_id, w[k] AS x, k FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS t FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
