"""Substring dedup: fuzzy passages that repeat across documents, by collinear chaining of shared k-mer seeds.

1. Seeds: SEED-word hashes, those in the lowest DENSITY-th part of all values, and the least of every WINDOW consecutive
   ones.  The first kind is kept or not whatever stands beside it, which fuzzy passages need; by the second a shared run
   of SEED + WINDOW - 1 words always shares a seed.
2. A seed that at least two documents have is matched with its hub, its first place in the document of least id: a
   star, so a passage in a million documents gives a million matches and not their square.  A match stays if the SIDE words
   before the seed, or those after it, have enough in common, by their bits in a word of 64: a passage reaches at least as far to
   one side, while seeds that meet by chance have strangers beside them.  No pair of seeds in 50 exact words is let go.
3. Matches of a document with a hub are ordered and chained: gap costs, and the best predecessor of those within GAP words, found in
   Fenwick trees over blocks of the hub's words, from which ends left behind are taken.  Where a
   text repeats itself at a distance under 50 words, only one place in CELL words meets the seed's first place elsewhere (and
   all meet the place of the same number), so such text isn't aligned and reported on every diagonal.
4. Chains, of one match or more, are aligned on the words of both documents: along the diagonal if the chain keeps to one,
   each stretch that stands out by itself; else extended at both ends and scored by the edits along the chain, each gap's exactly, or along the
   diagonals of its ends if that fails.  Passages of at least ``least`` words and ``identity`` are returned.
5. A hub may hold a part of a passage only, and other hubs the other parts, or a seed by chance.  So where matches lie in no passage and reach far
   enough for one, pairs of seeds there meet the least document that has both there, and go through 3 and 4: stars again, however many documents share a seed.
6. Where shared seeds follow each other and the words aren't known to equal those of a document of lower id, the hash of each run of ``least`` words is
   matched in the same way, with the least document that holds all of the run.  Runs over a seed that no other document has are left out: kept for its own
   value, it would be kept and shared wherever such a run stands.

An exact shared run of ``least`` = 50 words has a seed, so no such run is lost by the seeds, nor by 6 by the hubs: each is in a passage with the least
document that holds it, or leads there over passages in which it is the same.  Documents that share a passage
share it with the hub, and through the hub with each other.

Defined results: null, empty and short texts have no passage; rows with a null id are left out; rows of equal id count as one
document, so copies under one id don't repeat; repeats within one document aren't reported; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, text
from .decontaminate import winnow

SEED, WINDOW, DENSITY, LEAST, IDENTITY = 5, 32, 4, 50, 0.75
#: Words of a gap that one matched word pays for; longest gap within a chain; words beyond a chain's ends looked at.
GAP_COST, GAP, MARGIN = 0.25, 96, 64
#: Words of a seed's side, and the bits that two sides must share (strangers share 6 of 64 by chance, a passage of LEAST words at IDENTITY 14 or more).
#: Where words repeat, sides have fewer bits, and share VARIED of them.
SIDE, ALIKE, VARIED = 24, 11, 0.6
#: Least and greatest distance of two seeds that are matched together where no passage was found with the hubs of single seeds.
PAIR = (12, LEAST - SEED)
#: Keeps values in the trees above 0.
_FLOOR = 1.0
#: Words of a cell in which a seed that repeats itself is matched once with the first place of others.
CELL = 24
#: Requests for stretches of one document that one row holds.
REQUESTS = 256


def _spaced(at: np.ndarray, new: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Of the places of each seed (in order; ``new`` where a seed's begin), those that meet the first place of others: all, but where they
    follow each other within less than ``least`` words, one in each CELL words, and the last that a whole passage may start from.

    Words that repeat at so short a distance are a passage only where a hub repeats them too, and there a passage from every such
    place reaches to the next.
    """
    if not len(at):
        return np.zeros(0, np.int64)
    back = np.diff(at, prepend=at[:1])
    apart = new | (back >= least)
    start = np.flatnonzero(apart)
    end = np.repeat(at[np.append(start[1:], len(at)) - 1], np.diff(np.append(start, len(at))))
    whole = at <= end + SEED - least
    last = whole & np.append(apart[1:] | ~whole[1:], True)
    return np.flatnonzero(apart | last | (at // CELL != (at - back) // CELL))


def _sides(h: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a seed, a bit for each of the SIDE words before it, and after it."""
    bits = np.zeros(len(h) + 2 * SIDE, np.uint64)
    bits[SIDE : SIDE + len(h)] = np.uint64(1) << (h >> np.uint64(58))
    w8 = bits
    for step in (1, 2, 4):
        w8 = w8[:-step] | w8[step:]
    w = w8[:-16] | w8[8:-8] | w8[16:]
    n = len(h) - seed + 1
    return w[:n], w[SIDE + seed : SIDE + seed + n]


def _gaps(at: np.ndarray, held: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each place, how far it is to the one of ``held`` before it in its document, times 256, and to the one after it; 255 where there is none so near."""
    if not len(held):
        return np.full(len(at), 0xFFFF, np.int64)
    k = np.searchsorted(held, at, "left") - 1
    back = np.where((k >= 0) & (held[k] >= start), at - held[k], 255)
    k = np.minimum(np.searchsorted(held, at, "right"), len(held) - 1)
    on = np.where((held[k] > at) & (held[k] < end), held[k] - at, 255)
    return np.minimum(back, 255) << 8 | np.minimum(on, 255)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        b, off = text.raw(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j in text.runs(off):
            h, w = text.words(b[off[i] : off[j]], off[i : j + 1] - off[i], text.BLANK)
            g = text.grams(h, SEED)
            # winnowed within each document, so that what is kept depends on its words only
            at, left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for r in np.flatnonzero(np.diff(w) >= SEED):
                lo, n = w[r], w[r + 1] - w[r] - SEED + 1
                own = g[lo : lo + n]
                low = own < np.uint64(2**64 // DENSITY)
                low[winnow(own, min(WINDOW, int(n)))] = True
                low = np.flatnonzero(low)
                at.append(lo + low)
                for held, side in zip((left, right), _sides(h[lo : w[r + 1]], SEED)):
                    held.append(side[low])
            at, left, right = map(np.concatenate, (at, left, right))
            row = np.searchsorted(w, at, "right") - 1
            order = np.lexsort((at, g[at], row))
            v, r = g[at][order], row[order]
            new = np.ones(len(at), bool)
            new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
            start = np.flatnonzero(new)
            nth = np.empty(len(at), np.int64)
            nth[order] = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
            again = np.flatnonzero(nth)  # the n-th place of a seed also meets the n-th one of others: text that repeats itself
            own = order[_spaced((at - w[row])[order], new)]
            key = np.concatenate([g[at[own]], text.mix(g[at[again]] + nth[again].astype(np.uint64))])
            every = np.concatenate([own, again])
            held = np.zeros(len(at), bool)
            held[own] = g[at[own]] < np.uint64(2**64 // DENSITY)
            place = (at - w[row]) << 16 | _gaps(at, at[held], w[row], w[row + 1])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[i + row[every]].astype(np.int64)), pa.array(place[every]), pa.array(left[every].view(np.int64)), pa.array(right[every].view(np.int64))], names=["h", "doc", "place", "before", "after"])


def seeds(docs: DataFrame) -> DataFrame:
    """(h, doc, place, before, after) of (id, text); place: 2**16 times x, and the gaps."""
    return docs.mapInArrow(_seeds, "h long, doc long, place long, before long, after long")


def _alike(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether two sides have enough bits in common."""
    few = np.minimum(np.bitwise_count(p), np.bitwise_count(q)).astype(np.int64)
    return np.bitwise_count(p & q) >= np.minimum(ALIKE, np.maximum(1, np.ceil(few * VARIED)))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, doc, x) or (h, doc, place, before, after), in this order, as (doc, hub, x, y, near), and the gaps of a place: every place of a key that two documents
    have, with the key's first place in the least of them; near where the sides are alike, false in the hub itself.  Of a key that goes on, only the hub's own places
    are held, and once another document came, its first."""
    rest, said = None, 0
    for batch in batches:
        m = [c.to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in batch.columns]
        if rest is not None:
            m = [np.concatenate(c) for c in zip(rest, m)]
        if not len(m[0]):
            continue
        h, doc, x = m[:3]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        end = np.append(start[1:], len(h))
        many = doc[start] != doc[end - 1]
        at = np.repeat(many, end - start)
        at[:said] = False
        at = np.flatnonzero(at)
        hub = np.repeat(start, end - start)[at]
        near = doc[at] != doc[hub]
        if len(m) > 3:
            before, after = (c.view(np.uint64) for c in m[3:])
            near &= _alike(before[at], before[hub]) | _alike(after[at], after[hub])
        if len(at):
            places = [x[at], x[hub]] if len(m) == 3 else [x[at] >> 16, x[hub] >> 16, x[at] & 0xFFFF]
            yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(doc[hub]), pa.array(near), *(pa.array(c.astype(np.int32)) for c in places)], names=["doc", "hub", "near", "x", "y", "gaps"][: 3 + len(places)])
        said = int(many[-1])
        rest = [c[start[-1] : start[-1] + 1 if said else None].copy() for c in m]


def stars(places: DataFrame) -> DataFrame:
    """Places of keys, matched with their hubs: one shuffle by key."""
    return places.repartition("h").sortWithinPartitions(*places.columns).mapInArrow(_stars, "doc long, hub long, near boolean, x int, y int" + (", gaps int" if "place" in places.columns else ""))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, x, near, gaps), in this order, as (doc, at, near, gaps): the places of shared seeds of each document."""
    rest = np.zeros((4, 0), np.int64)

    def out(m: np.ndarray) -> pa.RecordBatch:
        m = m[:, np.append((m[0, 1:] != m[0, :-1]) | (m[1, 1:] != m[1, :-1]), True)]  # of one place the last, which is near if any is
        start = np.flatnonzero(np.append(True, m[0, 1:] != m[0, :-1]))
        off = np.append(start, m.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(m[0, start]), text.list_column(m[1].astype(np.int32), off), text.list_column(m[2].astype(np.int32), off), text.list_column(m[3].astype(np.int32), off)], names=["doc", "at", "near", "gaps"])

    for batch in batches:
        m = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])], 1)
        if not m.shape[1]:
            continue
        cut = int(np.searchsorted(m[0], m[0, -1]))
        rest = m[:, cut:]
        if cut:
            yield out(m[:, :cut])
    if rest.shape[1]:
        yield out(rest)


def gathered(shared: DataFrame) -> DataFrame:
    """(doc, at, near, gaps): for each document the places of its seeds that others have, in order, whether one is near (1), and the gaps."""
    return shared.select("doc", "x", "near", "gaps").repartition("doc").sortWithinPartitions("doc", "x", "near").mapInArrow(_gathered, "doc long, at array<int>, near array<int>, gaps array<int>")


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    flat, off = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[lo:hi] for lo, hi in zip(off[:-1], off[1:])]


def segments(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> list[tuple[int, int, int, int]]:
    """Matches on one diagonal that follow each other, as (x0, x1, y0, y1), ends exclusive."""
    order = np.lexsort((x, y - x))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (np.diff(y - x) != 0) | (np.diff(x) > GAP)
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(x)) - 1
    return sorted(zip(x[lo].tolist(), (x[hi] + seed).tolist(), y[lo].tolist(), (y[hi] + seed).tolist()))


class Ends:
    """Fenwick trees over the ends of segments, one pair for each block of GAP + 1 words of y: the best score at or below a place of the
    block, and at or above it.  A node keeps its entries as a heap, the best on top; those left behind by x are taken off when met, for good."""

    SIZE = GAP + 1

    def __init__(self):
        self.below, self.above = defaultdict(list), defaultdict(list)

    def add(self, value: float, x: int, y: int, who: int) -> None:
        block, at = divmod(y, self.SIZE)
        for trees, k in ((self.below, at + 1), (self.above, self.SIZE - at)):
            while k <= self.SIZE:
                heapq.heappush(trees[block, k], (-value, who, x))
                k += k & -k

    def best(self, x: int, y: int) -> tuple[float, int]:
        """Of the ends with x - GAP <= end x and y - GAP <= end y <= y (and no end x beyond x was added): the greatest value, and whose it is."""
        block, at = divmod(y, self.SIZE)
        found = (0.0, -1)
        for trees, b, k in ((self.below, block, at + 1), (self.above, block - 1, self.SIZE - at - 1)):  # the second: from y - GAP on
            while k > 0:
                heap = trees.get((b, k))
                while heap and heap[0][2] < x - GAP:
                    heapq.heappop(heap)
                if heap and (heap[0][0], heap[0][1]) < (found[0], found[1] if found[1] >= 0 else 1 << 60):
                    found = heap[0][:2]
                k -= k & -k
        return -found[0], found[1]


def chain(parts: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int, int, int]]]:
    """Disjoint chains of segments (in order), best first; in each both coordinates rise, by gaps of GAP words at most.

    A predecessor is worth its score less GAP_COST for each word between, which is a sum of what it brings and what the segment brings, so
    the best of all near enough is one look-up in Fenwick trees, whatever better one lies too far away.
    """
    if len(parts) == 1:
        return [parts]
    ends, waiting = Ends(), []
    score, back = [0.0] * len(parts), [-1] * len(parts)
    for k, (x0, x1, y0, y1) in enumerate(parts):
        while waiting and waiting[0][0] <= x0:
            x, y, j = heapq.heappop(waiting)
            ends.add(score[j] + GAP_COST * (x + y) + _FLOOR, x, y, j)
        value, who = ends.best(x0, y0)
        value -= GAP_COST * (x0 + y0) + _FLOOR
        if who >= 0 and value > 0:
            back[k] = who
        score[k] = (x1 - x0) + (value if back[k] >= 0 else 0.0)
        heapq.heappush(waiting, (x1, y1, k))
    used, out = [False] * len(parts), []
    for k in sorted(range(len(parts)), key=lambda k: (-score[k], k)):
        own = []
        while k >= 0 and not used[k]:
            used[k] = True
            own.append(parts[k])
            k = back[k]
        if own:
            out.append(own[::-1])
    return out


def _chains(seed: int):
    """(doc, hub, x, y) in order, as chains (doc, hub, x0, x1, y0, y1, straight, parts); parts: the segments of one that isn't straight, four bounds each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 4), np.int64)

        def made(m: np.ndarray) -> Iterator[tuple]:
            cut = np.flatnonzero((np.diff(m[:, 0]) != 0) | (np.diff(m[:, 1]) != 0)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(m)]):
                for c in chain(segments(m[lo:hi, 2], m[lo:hi, 3], seed)):
                    straight = len({p[2] - p[0] for p in c}) == 1
                    yield m[lo, 0], m[lo, 1], c[0][0], c[-1][1], c[0][2], c[-1][3], straight, None if straight else [v for p in c for v in p]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] * 6 + [pa.bool_(), pa.list_(pa.int32())])], names=["doc", "hub", "x0", "x1", "y0", "y1", "straight", "parts"])

        for batch in batches:
            m = np.concatenate([rest, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], 1)])
            same = (m[:, 0] == m[-1, 0]) & (m[:, 1] == m[-1, 1])
            cut = len(m) - int(same[::-1].argmin()) if not same.all() else 0
            rest = m[cut:]
            if cut and (rows := list(made(m[:cut]))):
                yield out(rows)
        if len(rest) and (rows := list(made(rest))):
            yield out(rows)

    return run


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, requests) as (chain, side, lo, hi, at, words, straight, parts): 32 bits of each word's hash."""
    for batch in batches:
        b, off = text.raw(batch.column(0))
        asked = batch.column(1).to_pylist()
        for i, j in text.runs(off):
            h, w = text.words(b[off[i] : off[j]], off[i : j + 1] - off[i], text.BLANK)
            h = (h >> np.uint64(32)).astype(np.uint32)
            out = []
            for r in range(i, j):
                own = h[w[r - i] : w[r - i + 1]]
                for q in asked[r]:
                    lo = max(0, q["lo"] - MARGIN)
                    out.append((q["chain"], q["side"], q["lo"] - lo, q["hi"] - lo, lo, own[lo : q["hi"] + MARGIN].tobytes(), q["straight"], q["parts"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_(), pa.list_(pa.int32())])], names=["chain", "side", "lo", "hi", "at", "words", "straight", "parts"])


def _extend(a: np.ndarray, b: np.ndarray) -> int:
    """How many words from the start on belong to a match (1 a match, -2 a miss, the best prefix)."""
    n = min(len(a), len(b))
    if not n:
        return 0
    s = np.cumsum(np.where(a[:n] == b[:n], 1, -2))
    k = int(s.argmax())
    return k + 1 if s[k] > 0 else 0


def distance(a: np.ndarray, b: np.ndarray) -> int:
    """Edit distance of two sequences of words, all rows of the table at a time as bits of one number."""
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    k = int(differ.argmax()) if differ.any() else n
    a, b = a[k:], b[k:]
    n = min(len(a), len(b))
    if not n:
        return max(len(a), len(b))
    differ = a[::-1][:n] != b[::-1][:n]
    k = int(differ.argmax()) if differ.any() else n
    a, b = a[: len(a) - k].tolist(), b[: len(b) - k].tolist()
    if not a or not b:
        return max(len(a), len(b))
    at: dict[int, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full, top, up, down, score = (1 << len(a)) - 1, 1 << len(a) - 1, (1 << len(a)) - 1, 0, len(a)
    for w in b:
        same = at.get(w, 0)
        across = (((same & up) + up) ^ up) | same
        rise, fall = (down | ~(across | up)) & full, up & across
        score += bool(rise & top) - bool(fall & top)
        rise = rise << 1 | 1
        same |= down
        up, down = (fall << 1 | ~(same | rise)) & full, rise & same & full
    return score


def _shifted(parts: list[int] | None, x: int, y: int) -> list[tuple[int, int, int, int]]:
    """Segments counted from the first words at hand."""
    return [(a - x, b - x, c - y, d - y) for a, b, c, d in zip(*[iter(parts or [])] * 4)]


def likeness(a: np.ndarray, b: np.ndarray, parts: list[tuple[int, int, int, int]]) -> float:
    """Share of words matched: 1 - edits / longer length.  The edits are those along the chain: words that differ within its segments and,
    between them, the exact distance of what lies between (GAP words at most), so the work follows the length, at any length."""
    if not len(a) or not len(b):
        return 0.0
    edits, x, y = 0, 0, 0
    for x0, x1, y0, y1 in parts:
        edits += distance(a[x:x0], b[y:y0]) + int((a[x0:x1] != b[y0:y1]).sum())
        x, y = x1, y1
    return 1 - min(edits + distance(a[x:], b[y:]), max(len(a), len(b))) / max(len(a), len(b))


def stretches(same: np.ndarray, miss: int) -> list[tuple[int, int]]:
    """All disjoint stretches of words that stand out (1 a match, -miss a miss): the one of the greatest sum, then those of what is left on both
    sides, and so on (the maximal subsequences of Ruzzo and Tompa, in one pass)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    out, total, last = [], 0, 0  # (sum before, sum after, start, end, the last one before it whose sum before is less)
    for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()):
        left = total - miss * (lo - last)
        total, last, k = left + hi - lo, hi, len(out) - 1
        while True:
            while k >= 0 and out[k][0] >= left:
                k = out[k][4]
            if k < 0 or out[k][1] >= total:
                break
            left, lo, j = out[k][0], out[k][2], out[k][4]
            del out[k:]
            k = j
        out.append((left, total, lo, hi, k))
    return [o[2:4] for o in out]


def _widened(same: np.ndarray, p: int, q: int, least: int) -> tuple[int, int]:
    """A stretch that is too short, since words near its ends differ, as the best of ``least`` words or a few more around it that begin and
    end with a match; itself if there is none."""
    lo, hi = max(0, q - least), min(len(same), p + 2 * least)
    at = lo + np.flatnonzero(same[lo:hi])
    first = at[at <= p]
    k = np.searchsorted(at, np.maximum(first + least, q) - 1)
    first, k = first[k < len(at)], k[k < len(at)]
    if not len(first):
        return p, q
    ends, total = at[k] + 1, np.concatenate([[0], np.cumsum(same[lo:hi])])
    best = int(((total[ends - lo] - total[first - lo]) / (ends - first)).argmax())
    return int(first[best]), int(ends[best])


def along(a: np.ndarray, b: np.ndarray, shift: int, least: int, identity: float) -> list[tuple[int, int, int, int, float]]:
    """Passages on the diagonal b = a + shift, as bounds in a and b and the identity."""
    lo, hi = max(0, -shift), min(len(a), len(b) - shift)
    if hi - lo < least:
        return []
    same, out = a[lo:hi] == b[lo + shift : hi + shift], []
    for x0, x1 in stretches(same, 2):
        parts = [(x0, x1)] if same[x0:x1].mean() >= identity else [(x0 + p, x0 + q) for p, q in stretches(same[x0:x1], 3)]
        parts = [_widened(same, p, q, least) if q - p < least else (p, q) for p, q in parts]
        out += [(lo + p, lo + q, lo + p + shift, lo + q + shift, float(same[p:q].mean())) for p, q in parts if q - p >= least]
    return [r for r in out if r[4] >= identity]


def align(a: np.ndarray, alo: int, ahi: int, b: np.ndarray, blo: int, bhi: int, straight: bool, least: int = LEAST, identity: float = IDENTITY, parts: list[tuple[int, int, int, int]] = ()) -> list[tuple[int, int, int, int, float]]:
    """Passages, as bounds in a and b after extension and the identity; parts: the segments of a chain that isn't straight.

    A chain that isn't one passage is cut at its widest gap, and each part stands for itself."""
    if straight:
        return along(a, b, blo - alo, least, identity)
    out, shifts = [], {blo - alo, bhi - ahi}
    chains = [list(parts or [(alo, alo, blo, blo), (ahi, ahi, bhi, bhi)])]
    while chains:
        own = chains.pop()
        if len(own) == 1 or len({r - p for p, _, r, _ in own}) == 1:
            shifts.add(own[0][2] - own[0][0])
            continue
        (p, _, r, _), (_, q, _, t) = own[0], own[-1]
        left = _extend(a[:p][::-1], b[:r][::-1])
        right = _extend(a[q:], b[t:])
        x0, y0, x1, y1 = p - left, r - left, q + right, t + right
        if min(x1 - x0, y1 - y0) < least:  # too short, or its words lie on one diagonal
            shifts |= {r - p for p, _, r, _ in own}
            continue
        held = [(p - x0, q - x0, r - y0, t - y0) for p, q, r, t in own]
        held[0], held[-1] = (0, held[0][1], 0, held[0][3]), (held[-1][0], x1 - x0, held[-1][2], y1 - y0)  # the ends were extended along the diagonal
        same = likeness(a[x0:x1], b[y0:y1], held)
        if same >= identity:
            out.append((x0, x1, y0, y1, same))
            continue
        k = max(range(1, len(own)), key=lambda k: max(own[k][0] - own[k - 1][1], own[k][2] - own[k - 1][3]))
        chains += [own[:k], own[k:]]
    if len(out) == 1 and out[0][0] <= alo and out[0][1] >= ahi:
        return out
    return sorted({*out, *(r for shift in shifts for r in along(a, b, shift, least, identity) if not any(p <= r[0] and r[1] <= q and y <= r[2] and r[3] <= z for p, q, y, z, _ in out))})


def _equal(a: np.ndarray, b: np.ndarray, x0: int, x1: int, y0: int, y1: int, parts: list[tuple[int, int, int, int]], least: int) -> list[int]:
    """The stretches of a passage, as bounds in a, in which ``least`` words or more are the same in both."""
    out = []
    for p, q, r in [(x0, x1, y0)] if y1 - x1 == y0 - x0 else [(max(p, x0), min(q, x1), r + max(p, x0) - p) for p, q, r, _ in parts]:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], a[p:q] == b[r : r + max(0, q - p)], [False]]).astype(np.int8)))
        out += [v for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()) if hi - lo >= least for v in (p + lo, p + hi)]
    return out


def _aligned(least: int, identity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[1] == 0:
                    one = row
                elif one is not None and one[0] == row[0]:
                    a, b = (np.frombuffer(r[5], np.uint32) for r in (one, row))
                    parts = _shifted(one[7], one[4], row[4])
                    for x0, x1, y0, y1, same in align(a, one[2], one[3], b, row[2], row[3], one[6], least, identity, parts):
                        equal = [v + one[4] for v in _equal(a, b, x0, x1, y0, y1, parts, least)]
                        out.append((row[0], x0 + one[4], x1 + one[4], y0 + row[4], y1 + row[4], same, equal))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64()] * 5 + [pa.float64(), pa.list_(pa.int32())])], names=["chain", "x0", "x1", "y0", "y1", "identity", "equal"])

    return run


def _open_stretches(least: int):
    """(doc, shared seeds' places, gaps, bounds of what is the same in a document of lower id) as (doc, at, asked): where shared seeds follow each other
    without a break, the places of words at which a run of ``least`` may start that isn't known to be the same as one of lower id; and the seeds' places.
    A seed that is kept for its own value and lies in a gap isn't shared, so no run goes over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            docs, all_known = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            for doc, x, gaps, known in zip(docs, _lists(batch.column(1)), _lists(batch.column(2)), all_known):
                before, after = x - (gaps >> 8), x + (gaps & 255)
                cut = np.flatnonzero((np.diff(x) > WINDOW) | (after[:-1] < x[1:])) + 1
                first, last = np.append(0, cut), np.append(cut - 1, len(x) - 1)
                start = np.maximum(np.maximum(0, x[first] - WINDOW + 1), before[first] + 1)
                stop = np.minimum(x[last] + SEED + WINDOW - least, after[last] - max(0, least - SEED))
                some = start < stop
                held = sorted((s, e - least + 1) for s, e in zip(*[iter(known or ())] * 2))
                asked = []
                for lo, hi in zip(start[some].tolist(), stop[some].tolist()):
                    for s, e in held:
                        if s >= hi:
                            break
                        if lo < s:
                            asked += (lo, s)
                        lo = max(lo, e)
                    if lo < hi:
                        asked += (lo, hi)
                if asked:
                    out.append((doc, x, asked))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())))], names=["doc", "at", "asked"])

    return run


def _all_shared(g: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """For each place of a run of ``least`` words, whether every seed in it that is kept for its own value is one of those at the shared places.
    Judged by values: where a seed repeats itself, not each of its places is kept."""
    low = np.flatnonzero(g < np.uint64(2**64 // DENSITY))
    alone = np.zeros(len(g) + 1, np.int32)
    alone[low[~np.isin(g[low], g[at[at < len(g)]])] + 1] = 1
    np.cumsum(alone, out=alone)
    return alone[least - SEED + 1 :] == alone[: len(g) - least + SEED]


def _long_grams(least: int):
    """(doc, text, shared seeds' places, stretches) as (h, doc, x): hashes of ``least`` words from each place of the stretches, but where a seed within
    is kept for its own value and not shared: another document with these words would have it too.  Of words that repeat themselves, the first place, the
    last and one in CELL words, so that passages from these reach each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            b, off = text.raw(batch.column(1))
            places, asked = batch.column(2), batch.column(3)
            for i, j in text.runs(off):
                h, w = text.words(b[off[i] : off[j]], off[i : j + 1] - off[i], text.BLANK)
                out = []
                for r in range(i, j):
                    own = h[w[r - i] : w[r - i + 1]]
                    if len(own) < least:
                        continue
                    ends = asked[r].values.to_pylist()
                    at = np.concatenate([np.arange(lo, min(hi, len(own) - least + 1)) for lo, hi in zip(ends[::2], ends[1::2])])
                    if least >= SEED:
                        at = at[_all_shared(text.grams(own, SEED), places[r].values.to_numpy(), least)[at]]
                    if not len(at):
                        continue
                    key = text.grams_at(own, at, least)
                    order = np.lexsort((at, key))
                    key, at = key[order], at[order]
                    new, back = np.append(True, key[1:] != key[:-1]), np.diff(at, prepend=at[0])
                    kept = new | np.append(new[1:], True) | (back >= least) | (at // CELL != (at - back) // CELL)
                    out.append((key[kept], np.full(int(kept.sum()), ids[r], np.int64), at[kept]))
                if out:
                    key, doc, x = map(np.concatenate, zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(x.astype(np.int32))], names=["h", "doc", "x"])

    return run


def _unsettled(least: int):
    """(doc, places of shared seeds, whether they are near, passages) as (doc, at): the stretches (first and last places, in turn) of those that no passage holds, where they follow each other far enough for one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            docs, all_known = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            for doc, at, near, known in zip(docs, _lists(batch.column(1)), _lists(batch.column(2)), all_known):
                x = at[near > 0]
                if known and len(x):
                    inside = np.zeros(int(x[-1]) + 2, np.int32)
                    s, e = (np.minimum(np.array([q[c] for q in known]), len(inside) - 1) for c in "se")
                    np.add.at(inside, s, 1)
                    np.add.at(inside, e, -1)
                    x = x[np.cumsum(inside)[x] == 0]
                if not len(x):
                    continue
                cut = np.flatnonzero(np.diff(x) > least) + 1
                ends = [v for p in np.split(x, cut) if p[-1] + SEED - p[0] >= least * 2 // 5 for v in (max(0, int(p[0]) - SIDE), int(p[-1]) + SIDE)]
                if ends:
                    out.append((doc, ends))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.int32()))], names=["doc", "at"])

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, stretches) as (h, doc, x): all pairs of seeds in these stretches that lie PAIR words apart, the second kept for its own value: the first
    place of each pair and, where it repeats itself, also the last, which meets the last of others."""
    for batch in batches:
        ids, asked = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
        b, off = text.raw(batch.column(1))
        for i, j in text.runs(off):
            h, w = text.words(b[off[i] : off[j]], off[i : j + 1] - off[i], text.BLANK)
            for r in range(i, j):
                own = h[w[r - i] : w[r - i + 1]]
                if len(own) < SEED + PAIR[0]:
                    continue
                g, ends = text.grams(own, SEED), asked[r].values.to_pylist()
                open_ = np.zeros(len(g), bool)
                for lo, hi in zip(ends[::2], ends[1::2]):
                    open_[lo : hi + 1] = True
                low = open_ & (g < np.uint64(2**64 // DENSITY))
                key, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for d in range(PAIR[0], min(PAIR[1], len(g) - 1) + 1):
                    x = np.flatnonzero(open_[:-d] & low[d:])
                    key.append(text.mix(g[x] ^ text.mix(g[x + d])))
                    at.append(x)
                key, at = np.concatenate(key), np.concatenate(at)
                order = np.lexsort((at, key))
                key, at = key[order], at[order]
                if len(key):
                    new = np.append(True, key[1:] != key[:-1])
                    last = np.append(new[1:], True) & ~new
                    key, at = np.concatenate([key[new], text.mix(key[last] + np.uint64(1))]), np.concatenate([at[new], at[last]])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), ids[r], np.int64)), pa.array(at.astype(np.int32))], names=["h", "doc", "x"])


def _covered(found: DataFrame) -> DataFrame:
    return found.groupBy(F.col("id").alias("doc")).agg(F.collect_set(F.struct(F.col("start_word").alias("s"), F.col("end_word").alias("e"))).alias("known"))


def _further_hubs(rows: DataFrame, places: DataFrame, found: DataFrame, least: int, identity: float) -> DataFrame:
    """Passages with further documents: where near matches lie in no passage, pairs of seeds are matched anew, each with the least document that has
    both there."""
    open_ = places.join(_covered(found), "doc", "left").select("doc", "at", "near", "known").mapInArrow(_unsettled(least), "doc long, at array<int>")
    open_ = store.put(open_, "unsettled")
    pairs = store.sieve(rows, "id", open_, "doc").join(open_, F.col("id") == F.col("doc")).select("id", "text", "at").mapInArrow(_pairs, "h long, doc long, x int")
    near = store.put(stars(pairs).where("near").drop("near"), "pairs")
    store.drop(open_)
    return found.unionByName(_passages(rows, near, least, identity, SEED, "pairs"))


def _passages(rows: DataFrame, matches: DataFrame, least: int, identity: float, seed: int, name: str) -> DataFrame:
    """Passages (id, start_word, ...) from matches (doc, hub, x, y) of ``seed`` words each."""
    chains = matches.repartition("doc", "hub").sortWithinPartitions("doc", "hub", "x", "y").mapInArrow(_chains(seed), "doc long, hub long, x0 long, x1 long, y0 long, y1 long, straight boolean, parts array<int>")
    chains = store.put(chains.withColumn("chain", F.xxhash64("doc", "hub", "x0", "y0")).dropDuplicates(["doc", "hub", "x0", "y0"]), f"{name}_chains")
    asked = chains.select(F.explode(F.array(F.struct(F.col("doc").alias("id"), F.lit(0).alias("side"), F.col("x0").alias("lo"), F.col("x1").alias("hi"), F.col("parts").alias("parts")), F.struct(F.col("hub").alias("id"), F.lit(1).alias("side"), F.col("y0").alias("lo"), F.col("y1").alias("hi"), F.lit(None).cast("array<int>").alias("parts")))).alias("q"), "chain", "straight").select("q.*", "chain", "straight")
    count = store.put(asked.groupBy("id").agg(F.ceil(F.count(F.lit(1)) / REQUESTS).cast("int").alias("blocks")), f"{name}_blocks")
    # a hub's requests are dealt out before they are gathered, so that no task has them all
    dealt = store.put(asked, f"{name}_asked").join(count, "id").select("id", F.pmod(F.xxhash64("chain"), F.col("blocks")).alias("block"), F.struct("chain", "side", "lo", "hi", "straight", "parts").alias("q")).repartition("id", "block")
    requests = store.put(dealt.groupBy("id", "block").agg(F.collect_list("q").alias("asked")).select("id", "asked"), f"{name}_requests")
    words = (rows if name == "short" else store.sieve(rows, "id", requests, "id")).join(requests, "id").select("text", "asked").mapInArrow(_stretches, "chain long, side int, lo int, hi int, at int, words binary, straight boolean, parts array<int>")
    both = words.repartition("chain").sortWithinPartitions("chain", "side")
    found = both.mapInArrow(_aligned(least, identity), "chain long, x0 long, x1 long, y0 long, y1 long, identity double, equal array<int>")
    found = store.put(found, f"{name}_aligned")
    store.drop(count, requests)
    ends = chains.select("chain", "doc", "hub")
    return found.join(ends, "chain").select(F.col("doc").alias("id"), F.col("x0").alias("start_word"), F.col("x1").alias("end_word"), F.col("hub").alias("other_id"), F.col("y0").alias("other_start_word"), F.col("y1").alias("other_end_word"), (F.col("x1") - F.col("x0")).alias("n_words"), "identity", "equal")


def _repeated_passages(rows: DataFrame, least: int, identity: float) -> DataFrame:
    shared = store.put(stars(seeds(rows)), "shared")
    near = shared.where("near").select("doc", "hub", "x", "y")
    places = store.put(gathered(shared), "places")
    out = _further_hubs(rows, places, _passages(rows, near, least, identity, SEED, "short"), least, identity)

    same = out.where(F.size("equal") > 0).groupBy(F.col("id").alias("doc")).agg(F.flatten(F.collect_set("equal")).alias("known"))
    left = places.join(same, "doc", "left").select("doc", "at", "gaps", "known").mapInArrow(_open_stretches(least), "doc long, at array<int>, asked array<int>")
    left = store.put(left, "left")
    store.drop(shared, places)
    grams = store.sieve(rows, "id", left, "doc").join(left, F.col("id") == F.col("doc")).select("id", "text", "at", "asked").mapInArrow(_long_grams(least), "h long, doc long, x int")
    matches = store.put(stars(grams).where("near").drop("near"), "runs")
    return out.unionByName(_passages(rows, matches, least, identity, least, "long")).drop("equal").repartition("id").distinct().sortWithinPartitions("id", "n_words")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, identity: float = IDENTITY) -> DataFrame:
    """(id, start_word, end_word, other_id, other_start_word, other_end_word, n_words, identity), ends exclusive; other_id < id.
    A document's rows stand together, those within longer passages before these."""
    with store.by_bytes(docs.sparkSession):
        return _repeated_passages(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col(id_col).isNotNull()), least, identity)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(store.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").withColumnRenamed("other_id", "other_doc_id")


QUERIES = {"op3_substring_dedup": op3_substring_dedup}
ORACLE_SQL: dict[str, str] = {}
