"""Vectorised text kernel shared by the operators: words, word shingles and byte shingles as 64-bit hashes.

Everything works on the UTF-8 bytes of an Arrow string column, in pieces of at most ``PIECE`` bytes, so memory does
not follow the length of a document.  A word's hash is a polynomial over a random byte table (mod 2**64), finished
by a bijective mixer.  Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

PIECE = 1 << 18
U = np.uint64
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_STEP = U(0xD6E8FEB86659FD93)
BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
LOWER = np.array([x + 32 if 65 <= x <= 90 else x for x in range(256)], np.uint8)
#: Separators of ``[^\x20\x09-\x0D]+``.
BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
NOT_ALNUM = np.array([x < 48 or 58 <= x <= 96 or 123 <= x <= 127 for x in range(256)])
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64 bits (splitmix64's), in a new array."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_MULT**i and its inverse, for i < n at least."""
    if "up" not in _powers or n > len(_powers["up"]):
        for key, base in (("up", _MULT), ("down", _INV)):
            p = np.full(max(n, PIECE + 1), U(base), np.uint64)
            p[0] = 1
            _powers[key] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, and where each row starts (one more entry than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    n = len(column)
    _, where, data = column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, off - off[0]


def runs(off: np.ndarray, most: int = 0) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes each (0: PIECE); a longer row is alone."""
    most = most or PIECE
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


def _words(b: np.ndarray, edges: np.ndarray, blank: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of one piece; edges: where rows start."""
    n = len(b)
    if lower:
        b = LOWER[b]
    on = ~blank[b]
    first = on.copy()
    first[1:] &= ~on[:-1]
    inner = edges[(edges > 0) & (edges < n)]
    first[inner] = on[inner]
    last = on.copy()
    last[:-1] &= ~on[1:]
    last[inner - 1] = on[inner - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    up, down = powers(n)
    c = BYTE[b]
    c *= up[:n]
    np.cumsum(c, out=c)
    h = c[e]
    h[s > 0] -= c[s[s > 0] - 1]
    h *= down[s]
    return mix(h), s


def words(b: np.ndarray, off: np.ndarray, blank: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, one row after the other, and where each row's words start."""
    out, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for i, j in runs(off):
        lo, hi = int(off[i]), int(off[j])
        if hi - lo <= PIECE:
            h, s = _words(b[lo:hi], off[i : j + 1] - lo, blank, lower)
            out.append(h)
            counts.append(np.diff(np.searchsorted(s, off[i : j + 1] - lo)))
            continue
        total = 0
        while lo < hi:  # one very long row: cut between words
            to = min(hi, lo + PIECE)
            if to < hi:
                gap = np.flatnonzero(blank[LOWER[b[lo:to]]] if lower else blank[b[lo:to]])
                while not len(gap) and to < hi:
                    to = min(hi, to + PIECE)
                    gap = np.flatnonzero(blank[LOWER[b[lo:to]]] if lower else blank[b[lo:to]])
                to = lo + int(gap[-1]) + 1 if len(gap) and to < hi else to
            h, _ = _words(b[lo:to], np.array([0]), blank, lower)
            out.append(h)
            total += len(h)
            lo = to
        counts.append(np.array([total]))
    return np.concatenate(out), np.cumsum(np.concatenate(counts))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k entries from each position (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = h[:n].copy()
    for i in range(1, k):
        g *= _STEP
        g += h[i : i + n]
    g += U(k)
    return mix(g)


def shingles(h: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word shingles (a shorter row: its whole sequence), and where each row's start."""
    n = np.diff(off)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    to = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
    out = np.empty(int(to[-1]), np.uint64)
    full = np.repeat(n >= k, count)
    g = grams(h, k)
    inside = np.zeros(len(g), np.int32)
    long = np.flatnonzero(n >= k)
    np.add.at(inside, off[long], 1)
    ends = off[long] + n[long] - k + 1
    np.add.at(inside, ends[ends < len(g)], -1)
    out[full] = g[np.cumsum(inside) > 0]
    for m in range(1, k):
        rows = np.flatnonzero(n == m)
        if len(rows):
            out[to[rows]] = grams_at(h, off[rows], m)
    return out, to


def grams_at(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    g = h[at].copy()
    for i in range(1, k):
        g *= _STEP
        g += h[at + i]
    g += U(k)
    return mix(g)


def byte_grams(b: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position of one piece."""
    n = len(b)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = powers(n)
    c = BYTE[b]
    c *= up[:n]
    np.cumsum(c, out=c)
    g = c[k - 1 :].copy()
    g[1:] -= c[: n - k]
    g *= down[: n - k + 1]
    return mix(g)


def seeds(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of ``count`` multiply-add-shift hash functions (a universal family)."""
    r = np.random.Generator(np.random.PCG64(seed))
    return r.integers(1, 1 << 63, count, dtype=np.uint64) * U(2) + U(1), r.integers(0, 1 << 63, count, dtype=np.uint64)


def column_function(of: Callable[[pa.Array], pa.Array], kind: str):
    """A function of text columns: only the text goes to Python and only what ``of`` makes of it comes back; the rest of each row
    stays in the JVM.  Marked as not deterministic, so that no filter or projection has it worked out twice."""

    def run(t: pa.Array) -> pa.Array:
        out = of(t)
        pa.default_memory_pool().release_unused()
        return out

    return F.arrow_udf(run, kind).asNondeterministic()


def list_column(values: np.ndarray, off: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values))
