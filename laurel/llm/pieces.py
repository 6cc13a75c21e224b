"""SentencePiece encoding with sampled segmentations, and exact decoding.

The lattice of a text has an arc for each vocabulary piece that matches at a position (and one of byte pieces for a
character that is no piece); a path is a segmentation. A piece of rank r has the weight 1 / (r + 2.7) (Zipf's law over
the merge order, as BPE vocabularies hold no probabilities), byte arcs the smallest weight for each byte; a path's probability is
its weight over that of all paths.

Gumbel top-k: each path's log-probability gets independent Gumbel noise, and the k largest are k samples without
replacement. They are found top down by A-star search. The lattice falls apart into stretches that no piece crosses (mostly words), so
a node is a stretch and a prefix of choices. The best path below a node inherits the node's perturbed value; all its
siblings at each stretch are one frontier node, whose largest value is a Gumbel variable of their total mass, truncated to
the parent's value. The frontier node of the largest value is opened next: one of its paths is drawn by forward
filtering, backward sampling without those taken, and leaves a new frontier. So each of the k paths costs one walk through
the text, whatever its length. Noise is seeded by the row's key; equal rows give equal samples on any cluster.

With kappa, the perturbed value that comes after the k-th, a path of log-probability l is included with probability
1 - exp(-exp(l - kappa)) (1 if there are no more paths).

Defined results: null and empty texts have one segmentation, of no pieces; texts with fewer than k segmentations give all of
them, once each; repeated rows give equal samples; a null key seeds like 0; an empty table gives no rows; extra columns are
ignored by `encode`. Very long texts are encoded whole: lattices are made for `_CHARS` characters at a time, and of a stretch that
nothing cuts one number for each character is kept, so a task needs some 40 bytes for each character of its longest text.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, chunks, mix, prefix, spans

#: The default of `model_file`, a path on the driver, which alone reads it; the pieces are broadcast.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
K, SEED = 2, 20
#: Longer stretches are walked one by one.
_SHORT = 32


def vocabulary(model_file: str = MODEL) -> list[tuple[str, int]]:
    """(piece, kind) by id; kind 0: text, 1: byte, 2: control or unknown."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kind = lambda i: 1 if sp.is_byte(i) else 2 if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else 0
    return [(sp.id_to_piece(i), kind(i)) for i in range(sp.vocab_size())]


def spelled(vocab: list[tuple[str, int]]) -> list[bytes]:
    """The bytes that each piece stands for."""
    return [bytes([int(p[3:5], 16)]) if kind == 1 else b"" if kind == 2 else p.replace("▁", " ").encode() for p, kind in vocab]


class Lattice:
    """The lattice of one stretch, read in blocks of positions. A path is the sequence of its arcs' sizes.

    block(i) gives the positions [lo, hi) around i and, for them, offsets of positions into arcs, and the arcs' values, sizes and shares
    of the mass of the paths from their position on.
    """

    def __init__(self, n: int):
        self.n = n

    def block(self, i: int) -> tuple[int, int, list, list, list, list]:
        raise NotImplementedError

    def walk(self, uniform, pick: np.ndarray) -> float:
        """Draws a path: its values go to pick, by position; its log-probability is returned. uniform(positions) gives the numbers that choose."""
        return self._drawn([], uniform, pick)

    def other(self, taken: list, uniform, pick: np.ndarray) -> float:
        """Like walk, but a path drawn from all but those taken, which are given with their log-probabilities."""
        return self._drawn([[t, 0, q] for t, q in taken], uniform, pick)

    def _drawn(self, rest: list, uniform, pick: np.ndarray) -> float:
        # rest: the taken paths that begin like this one, how far along they are, and the log-probability of what is left of each
        i, hi, log_p = 0, 0, 0.0
        while i < self.n:
            if i >= hi:
                lo, hi, off, value, size, share = self.block(i)
                numbers = uniform(np.arange(lo, hi)).tolist()
            a, last, u = off[i - lo], off[i - lo + 1] - 1, numbers[i - lo]
            if rest:
                masses = [max(0.0, share[x] - sum([math.exp(q) for t, k, q in rest if t[k] == size[x]])) for x in range(a, last + 1)]
                total = sum(masses)
                if total <= 0:
                    masses, total = share[a : last + 1], 1.0
                u, k = u * total, 0
                while k < len(masses) - 1 and u >= masses[k]:
                    u -= masses[k]
                    k += 1
                a += k
                rest = [[t, k + 1, q - math.log(share[a])] for t, k, q in rest if t[k] == size[a] and k + 1 < len(t)]
            else:
                while a < last and u >= share[a]:
                    u -= share[a]
                    a += 1
            pick[i] = value[a]
            log_p += math.log(share[a])
            i += size[a]
        return log_p


class Ready(Lattice):
    """A short stretch, whose arcs are at hand."""

    def __init__(self, off: list, value: list, size: list, share: list):
        super().__init__(len(off) - 1)
        self.arcs = (0, self.n, off, value, size, share)

    def block(self, i: int) -> tuple[int, int, list, list, list, list]:
        return self.arcs


class Long(Lattice):
    """A long stretch: one logarithm is kept for each position, arcs are made again for `BLOCK` positions at a time."""

    BLOCK = 4096

    def __init__(self, cp: np.ndarray, pieces: "Pieces"):
        super().__init__(len(cp))
        self.cp, self.pieces = cp, pieces
        self.logs, scale = np.zeros(self.n + 1), 0.0
        ahead = [1.0] + [0.0] * pieces.longest  # masses of the positions that follow, relative to exp(scale)
        for lo in range((self.n - 1) // self.BLOCK * self.BLOCK, -1, -self.BLOCK):
            off, _, size, weight = self._arcs(lo, min(lo + self.BLOCK, self.n))
            off, size, weight, m = off.tolist(), size.tolist(), weight.tolist(), len(off) - 1
            mass, logs = [0.0] * m + ahead, [0.0] * m
            for i in range(m - 1, -1, -1):
                total = 0.0
                for a in range(off[i], off[i + 1]):
                    total += weight[a] * mass[i + size[a]]
                if total < 1e-150:
                    mass[i + 1 : i + 1 + pieces.longest] = [x / total for x in mass[i + 1 : i + 1 + pieces.longest]]
                    scale, total = scale + math.log(total), 1.0
                mass[i], logs[i] = total, math.log(total) + scale
            self.logs[lo : lo + m] = logs
            ahead = mass[: pieces.longest + 1]

    def _arcs(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Offsets of the positions [lo, hi) into arcs, and the arcs' values, sizes and weights."""
        begin, size, value, weight = self.pieces.matches(self.cp, np.arange(lo, hi), np.full(hi - lo, self.n))
        order = np.argsort(begin, kind="stable")  # found by growing size
        return np.append(0, np.cumsum(np.bincount(begin - lo, minlength=hi - lo))), value[order], size[order], weight[order]

    def block(self, i: int) -> tuple[int, int, list, list, list, list]:
        hi = min(i + self.BLOCK, self.n)
        off, value, size, weight = self._arcs(i, hi)
        at = np.repeat(np.arange(i, hi), np.diff(off))
        share = weight * np.exp(self.logs[at + size] - self.logs[at])
        return i, hi, off.tolist(), value.tolist(), size.tolist(), share.tolist()


_EMPTY = np.uint64((1 << 64) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS = 19


class Pieces:
    """A vocabulary: weights, a trie (as a hash table of (state, character), for arrays), and the cut into stretches."""

    def __init__(self, vocab: list[tuple[str, int]]):
        ranked = [i for i, (_, kind) in enumerate(vocab) if kind == 0]
        raw = {i: 1 / (r + 2.7) for r, i in enumerate(ranked)}
        norm = sum(raw.values())
        weight = {i: w / norm for i, w in raw.items()}
        self.least = min(weight.values())
        self.bytes_of = [0] * 256
        trie: dict = {}
        self.longest = 1
        inner: set[str] = set()
        self.apart = True  # whether no piece goes on to a blank after something else
        for i, (piece, kind) in enumerate(vocab):
            if kind == 1:
                self.bytes_of[int(piece[3:5], 16)] = i
            elif kind == 0:
                key = piece.replace("▁", " ")
                self.longest = max(self.longest, len(key))
                node = trie
                for c in key:
                    node = node.setdefault(c, {})
                node[""] = i
                if len(key) > 1:
                    inner.update(key)
                self.apart &= " " not in key.lstrip(" ")
        self.raw = spelled(vocab)
        self.kinds = np.full(0x110000, 2, np.int8)  # of characters: 0 blank, 1 stands in a longer piece, 2 alone
        self.kinds[[ord(c) for c in inner]] = 1
        self.kinds[32] = 0
        keys, nexts, self.term = [], [], [-1]
        queue = [(trie, 0)]
        for node, state in queue:
            for c, child in node.items():
                if c:
                    keys.append(state << 21 | ord(c))
                    nexts.append(len(self.term))
                    self.term.append(child.get("", -1))
                    queue.append((child, len(self.term) - 1))
        self.term = np.array(self.term, np.int32)
        self.value = np.array([weight.get(int(i), 0.0) for i in self.term])
        self.bytes_at = np.array(self.bytes_of, np.int32)
        self.keys, self.nexts = np.full(1 << _SLOT_BITS, _EMPTY), np.zeros(1 << _SLOT_BITS, np.int32)
        keys, nexts = np.array(keys, np.uint64), np.array(nexts, np.int32)
        slot = (keys * _ODD) >> np.uint64(64 - _SLOT_BITS)
        while len(keys):
            free = self.keys[slot] == _EMPTY
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.nexts[slot[put]] = keys[put], nexts[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, nexts, slot = keys[left], nexts[left], (slot[left] + np.uint64(1)) & np.uint64((1 << _SLOT_BITS) - 1)

    def step(self, states: np.ndarray, cps: np.ndarray) -> np.ndarray:
        """Next states, or -1."""
        key = (states.astype(np.uint64) << np.uint64(21)) | cps.astype(np.uint64)
        slot = (key * _ODD) >> np.uint64(64 - _SLOT_BITS)
        have = self.keys[slot]
        out = np.where(have == key, self.nexts[slot], -1)
        again = np.flatnonzero((have != key) & (have != _EMPTY))
        while len(again):
            slot[again] = (slot[again] + np.uint64(1)) & np.uint64((1 << _SLOT_BITS) - 1)
            have = self.keys[slot[again]]
            hit = have == key[again]
            out[again[hit]] = self.nexts[slot[again[hit]]]
            again = again[~hit & (have != _EMPTY)]
        return out

    def matches(self, cp: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The arcs that begin at positions of cp and do not pass their ends: begins, sizes, values (a byte piece, or a mark for several, for a character that is no piece) and weights; by growing size."""
        begin, size, value, weight = [], [], [], []

        def found(b: np.ndarray, d: int, v: np.ndarray, w: np.ndarray) -> None:
            for x, y in ((begin, b), (size, np.full(len(b), d, np.int32)), (value, v), (weight, w)):
                x.append(y)

        states = self.step(np.zeros(len(at), np.int64), cp[at])
        plain = at[(states < 0) | (self.term[states] < 0)]
        c = cp[plain].astype(np.int32)
        found(plain, 1, np.where(c < 128, self.bytes_at[np.minimum(c, 255)], -2 - c), np.full(len(plain), self.least))
        d = 1
        while len(at):
            ok = states >= 0
            at, end, states = at[ok], end[ok], states[ok]
            done = self.term[states] >= 0
            ended = states[done]
            found(at[done], d, self.term[ended], self.value[ended])
            more = at + d < end
            at, end, states = at[more], end[more], states[more]
            states = self.step(states, cp[at + d])
            d += 1
        return tuple(np.concatenate(x) for x in (begin, size, value, weight))

    def ids(self, values: np.ndarray) -> np.ndarray:
        """Piece ids of values, with marks spelled in bytes."""
        if not len(values) or values.min() >= 0:
            return values.astype(np.int32)
        out: list[int] = []
        for v in values.tolist():
            out += [v] if v >= 0 else [self.bytes_of[b] for b in chr(-2 - v).encode()]
        return np.array(out, np.int32)


class Segment:
    """The stretches [t0, t1) of a chunk, with the lattices of the short ones as arrays; positions count from the segment's first character."""

    def __init__(self, chunk: "Chunk", t0: int, t1: int):
        self.pieces, self.t0 = chunk.pieces, t0  # not the chunk, which would be a cycle that holds arrays until it is found
        self.base = int(chunk.start[t0])
        self.start, self.end = chunk.start[t0:t1] - self.base, chunk.end[t0:t1] - self.base
        self.cp = chunk.cp[self.base : self.base + int(self.end[-1])]
        self.of = np.repeat(np.arange(t1 - t0, dtype=np.int32), self.end - self.start)
        self.long = self.end - self.start > _SHORT
        self.made: tuple[int, Long | None] = (-1, None)  # the last long lattice
        self._equals()
        self._arcs()

    def _equals(self) -> None:
        """Equal stretches share the lattice of the first of them, which stands `shift` characters away."""
        t, n = np.arange(len(self.start)), len(self.cp)
        pre = prefix(mix(self.cp.astype(np.uint64) + np.uint64(1)))
        _, first, which = np.unique(spans(pre, self.start, self.end), return_index=True, return_inverse=True)
        model = first[which]
        model = np.where(self.end - self.start == (self.end - self.start)[model], model, t)
        shift = self.start[model] - self.start
        wrong = self.cp != self.cp[np.arange(n) + shift[self.of]]
        if wrong.any():  # equal hashes of unequal stretches
            model[self.of[wrong]] = self.of[wrong]
            shift = self.start[model] - self.start
        self.shift, self.own = shift, model == t

    def _arcs(self) -> None:
        n, send = len(self.cp), self.end[self.of]
        at = np.flatnonzero((self.own & ~self.long)[self.of])
        begin, size, value, weight = self.pieces.matches(self.cp, at, send[at])
        order = np.argsort(begin, kind="stable")  # found by growing size
        begin, size, self.value, weight = begin[order], size[order], value[order], weight[order]
        self.off = np.append(0, np.cumsum(np.bincount(begin, minlength=n)))
        self.reach = begin + size
        # masses, from the ends of stretches backwards
        left = (send[begin] - begin).astype(np.int16)
        by_left = np.argsort(left, kind="stable")
        cut = np.append(np.searchsorted(left[by_left], np.arange(1, _SHORT + 1)), len(left))
        mass, arc_mass = np.ones(n + 1), np.empty(len(begin))
        ends = self.reach == send[begin]
        for r in range(_SHORT):
            a = by_left[cut[r] : cut[r + 1]]
            if len(a):
                m = weight[a] * np.where(ends[a], 1.0, mass[self.reach[a]])
                arc_mass[a] = m
                b = begin[a]
                new = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
                mass[b[new]] = np.add.reduceat(m, new)
        self.p = arc_mass / mass[begin]
        # running sums inside each position, arc by arc, so that they do not depend on the rest of the segment
        self.run, rank = self.p.copy(), np.arange(len(begin)) - self.off[begin]
        a = np.flatnonzero(rank == 1)
        while len(a):
            self.run[a] += self.run[a - 1]
            a = a[a + 1 < len(rank)] + 1
            a = a[rank[a] > 1]

    def lattice(self, t: int) -> Lattice:
        """Of stretch t of the chunk."""
        t -= self.t0
        a, b = int(self.start[t]), int(self.end[t])
        if self.long[t]:
            if self.made[0] != t:
                self.made = (t, Long(self.cp[a:b], self.pieces))
            return self.made[1]
        a, b = a + int(self.shift[t]), b + int(self.shift[t])
        lo, hi = self.off[a], self.off[b]
        size = self.reach[lo:hi] - np.repeat(np.arange(a, b), np.diff(self.off[a : b + 1]))
        return Ready((self.off[a : b + 1] - lo).tolist(), self.value[lo:hi].tolist(), size.tolist(), self.p[lo:hi].tolist())

    def draw(self, chunk: "Chunk", which: np.ndarray, sample: int, pick: np.ndarray, logs: np.ndarray) -> None:
        """Draws paths for stretches of the chunk: values to pick by position, log-probabilities to logs by stretch."""
        which = which - self.t0
        pick, logs = pick[self.base : self.base + len(self.cp)], logs[self.t0 : self.t0 + len(self.start)]
        for t in which[self.long[which]].tolist():
            a = int(self.start[t])
            logs[t] = self.lattice(t + self.t0).walk(lambda at, a=a: chunk.uniform(self.base + a + at, sample, 0), pick[a : int(self.end[t])])
        which = which[~self.long[which]]
        cur, logs[which] = self.start[which], 0.0
        while len(cur):
            shift = self.shift[which]
            a, last = self.off[cur + shift], self.off[cur + shift + 1] - 1
            go = np.flatnonzero(a < last)
            if len(go):
                u = chunk.uniform(self.base + cur[go], sample, 0)
                while len(go):
                    keep = u >= self.run[a[go]]
                    go, u = go[keep], u[keep]
                    a[go] += 1
                    keep = a[go] < last[go]
                    go, u = go[keep], u[keep]
            pick[cur] = self.value[a]
            logs[which] += np.log(self.p[a])
            cur = self.reach[a] - shift
            keep = cur < self.end[which]
            cur, which = cur[keep], which[keep]


class Chunk:
    """Texts joined to one array of characters, cut into stretches, whose lattices are made segment by segment.

    Numbers that choose come from a hash of (key of the text, sample, place in the text), so they do not depend on what else is in the chunk.
    """

    def __init__(self, texts: list[str | None], keys: np.ndarray, pieces: Pieces, seed: int, segment: int | None = None):
        self.pieces = pieces
        self.cp = np.frombuffer("".join([" " + t if t else "" for t in texts]).encode("utf-32-le"), np.uint32)
        n = len(self.cp)
        size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        self.doc_at = np.append(0, np.cumsum(size))
        self.key = mix(keys.astype(np.uint64) * _ODD + np.uint64(seed))
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), size)
        kind = pieces.kinds[self.cp]
        first = np.zeros(n, bool)
        first[self.doc_at[:-1][size > 0]] = True
        if pieces.apart and n:
            first[1:] |= (kind[1:] == 2) | (kind[:-1] == 2) | ((kind[1:] == 0) & (kind[:-1] != 0))
        self.start = np.flatnonzero(first)
        self.end = np.append(self.start[1:], n)
        self.stretch_at = np.searchsorted(self.start, self.doc_at)
        self.cuts = [0]  # of stretches into segments
        while self.cuts[-1] < len(self.start):
            t = int(np.searchsorted(self.end, self.start[self.cuts[-1]] + (segment or _CHARS), "right"))
            self.cuts.append(max(t, self.cuts[-1] + 1))
        self.last: tuple[int, Segment | None] = (-1, None)

    def segment(self, s: int) -> Segment:
        """Segment s; the last one asked for is kept."""
        if self.last[0] != s:
            self.last = (-1, None)
            self.last = (s, Segment(self, self.cuts[s], self.cuts[s + 1]))
        return self.last[1]

    def lattice(self, t: int) -> Lattice:
        return self.segment(bisect.bisect_right(self.cuts, t) - 1).lattice(t)

    def draw(self, which: np.ndarray, sample: int, pick: np.ndarray, logs: np.ndarray) -> None:
        at = np.searchsorted(which, self.cuts)
        for s, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            if a < b:
                self.segment(s).draw(self, which[a:b], sample, pick, logs)

    def uniform(self, at: np.ndarray, sample: int, use: int) -> np.ndarray:
        """Numbers in (0, 1) for places of the chunk."""
        d = self.doc[at]
        return self._hashed(self.key[d], at - self.doc_at[d], sample, use)

    def _hashed(self, key: np.ndarray, place: np.ndarray, sample: int, use: int) -> np.ndarray:
        h = mix(key + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64((sample * 0x2545F4914F6CDD1D + use * 0x61C8864680B583EB) & 0xFFFFFFFFFFFFFFFF))
        return ((h >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52

    def path(self, pick: np.ndarray, t: int) -> list[int]:
        """Sizes of the arcs chosen in stretch t."""
        at = np.flatnonzero(pick[self.start[t] : self.end[t]] != -1)
        return np.diff(np.append(at, self.end[t] - self.start[t])).tolist()

    def top_k(self, k: int):
        """For each text, up to k (ids, log-probability, perturbed value, inclusion probability), best first."""
        n_docs, n_str = len(self.key), len(self.start)
        parts = list(zip(self.stretch_at[:-1].tolist(), self.stretch_at[1:].tolist(), strict=True))
        doc_of = np.repeat(np.arange(n_docs), np.diff(self.stretch_at))
        value = -np.log(-np.log(self._hashed(self.key, np.zeros(n_docs, np.int64), 0, 1)))
        out: list[list] = [[] for _ in range(n_docs)]
        fronts: list[dict] = []
        live, from_ = np.ones(n_docs, bool), np.zeros(n_docs, np.int64)  # from_: the first stretch that a text's new path draws afresh
        from_[:] = self.stretch_at[:-1]
        pick, logs = np.full(len(self.cp), -1, np.int32), np.zeros(n_str)
        self.draw(np.arange(n_str), 1, pick, logs)
        taken: dict[tuple[int, int], list] = {}
        for r in range(1, k + 1):
            before = np.zeros(n_str)
            for d in np.flatnonzero(live).tolist():
                lo, hi = parts[d]
                before[lo:hi] = np.cumsum(logs[lo:hi]) - logs[lo:hi]
            with np.errstate(divide="ignore"):
                mass = before + np.log(np.maximum(-np.expm1(logs), 0))
                mass[(np.abs(logs) < 1e-13) | (np.arange(n_str) < from_[doc_of]) | ~live[doc_of]] = -np.inf
                noise = np.log(-np.log(self.uniform(self.start, r, 2)))
                top = -np.logaddexp(-value[doc_of], noise - mass)
            fronts.append({"pick": pick, "logs": logs, "before": before, "top": top})
            for d in np.flatnonzero(live).tolist():
                a, b = self.doc_at[d], self.doc_at[d + 1]
                chosen = pick[a:b]
                lo, hi = parts[d]
                out[d].append((self.pieces.ids(chosen[chosen != -1]), float(logs[lo:hi].sum()), float(value[d])))
            # the frontier node of the largest value, for each text
            best = np.full((len(fronts), n_docs), -np.inf)
            some = np.flatnonzero(np.diff(self.stretch_at) > 0)
            for f, x in enumerate(fronts):
                if len(some):
                    best[f, some] = np.maximum.reduceat(x["top"], self.stretch_at[some])
            of = best.argmax(0)
            value = np.where(live, best.max(0), -np.inf)
            live = live & (value > -np.inf)
            if r == k or not live.any():
                break
            pick, logs, from_ = np.full(len(self.cp), -1, np.int32), np.zeros(n_str), np.full(n_docs, n_str)
            fresh = []
            for d in np.flatnonzero(live).tolist():
                f, (lo, hi) = int(of[d]), parts[d]
                x = fronts[f]
                t = lo + int(np.argmax(x["top"][lo:hi]))
                a, b = int(self.doc_at[d]), int(self.start[t])
                pick[a:b], logs[lo:t] = x["pick"][a:b], x["logs"][lo:t]
                gone = taken.setdefault((f, t), [(self.path(x["pick"], t), float(x["logs"][t]))])
                lattice = self.lattice(t)
                logs[t] = lattice.other(gone, lambda at, b=b: self.uniform(b + at, r + 1, 3), pick[b : int(self.end[t])])
                gone.append((self.path(pick, t), float(logs[t])))
                rest = 1 - sum(math.exp(q) for _, q in gone)
                x["top"][t] = -np.inf
                if rest > 1e-12:
                    noise = math.log(-math.log(float(self.uniform(np.array([b]), r + 1, 4)[0])))
                    x["top"][t] = -np.logaddexp(-value[d], noise - x["before"][t] - math.log(rest))
                from_[d] = t + 1
                if t + 1 < hi:
                    fresh.append(np.arange(t + 1, hi))
            if fresh:
                self.draw(np.concatenate(fresh), r + 1, pick, logs)
        for d in range(n_docs):
            v = value[d]
            out[d] = [(ids, lp, g, 1.0 if v == -np.inf else -math.expm1(-math.exp(min(700.0, lp - v)))) for ids, lp, g in out[d]]
        return out


_ENCODED = "doc_id bigint, rank int, pieces array<int>, log_prob double, perturbed double, inclusion double"
#: Characters of texts (a longer text alone) and of segments that are worked on at once.
_CHARS = 1 << 17


def _sampled(batch: pa.RecordBatch, pieces: Pieces, k: int, seed: int):
    """Rows of _ENCODED for (key, text) rows."""
    size = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()))
    for i, j in chunks(size, _CHARS):
        keys = batch.column(0).slice(i, j - i)
        c = Chunk(batch.column(1).slice(i, j - i).to_pylist(), pc.fill_null(keys, 0).to_numpy().astype(np.int64).view(np.uint64), pieces, seed)
        rows = [(key, r, *x) for key, found in zip(keys.to_pylist(), c.top_k(k), strict=True) for r, x in enumerate(found, 1)]
        off = np.append(0, np.cumsum([len(r[2]) for r in rows])).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([r[2] for r in rows])))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), lists, *(pa.array([float(r[x]) for r in rows]) for x in (3, 4, 5))], ["doc_id", "rank", "pieces", "log_prob", "perturbed", "inclusion"])


def _decoded(ids, raw: list[bytes]) -> pa.Array:
    """The texts of a column of lists of piece ids."""
    out = []
    for x in ids:
        x = x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else []
        out.append(b"".join([raw[i] for i in x])[1:].decode("utf-8", "replace"))
    return pa.array(out, pa.string())


def encode(docs: DataFrame, k: int = K, seed: int = SEED, model_file: str = MODEL, decoded: bool = False) -> DataFrame:
    """Up to k sampled segmentations of each text, seeded by doc_id; with `decoded`, also the text that each is decoded to, by the same Python worker."""
    shared = Shared(docs.sparkSession, Pieces(vocabulary(model_file)))  # the vocabulary file's size bounds it

    def run(batches):
        pieces = shared.value
        for batch in batches:
            for out in _sampled(batch, pieces, k, seed):
                yield pa.RecordBatch.from_arrays([*out.columns, _decoded(out.column("pieces"), pieces.raw)], [*out.schema.names, "decoded"]) if decoded else out

    return docs.select("doc_id", "text").mapInArrow(run, _ENCODED + ", decoded string" * decoded)


def decode(encoded: DataFrame, model_file: str = MODEL) -> DataFrame:
    """encoded with a column `decoded`: the text of its pieces."""
    encoded = encoded.drop("decoded")
    shared = Shared(encoded.sparkSession, spelled(vocabulary(model_file)))
    at = encoded.columns.index("pieces")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(batch.column(at), shared.value)], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, encoded.withColumn("decoded", F.lit("")).schema)


def op4(spark, sf_dir: str) -> DataFrame:
    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), decoded=True)
    return out.select("doc_id", "rank", F.size("pieces").cast("long").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_xxh64"), "log_prob", "perturbed", "inclusion", F.sha2("decoded", 256).alias("decoded_sha256"))
