"""Toxicity by a bag of subwords: embeddings of words and of their character n-grams, averaged over a text, into a linear softmax.

Words are runs of letters, digits, characters beyond the first 65535 and the marks that stand in for letters (``@ $ *``), lower-cased; a word counts as itself and as its
n-grams of 3 to 5 characters, its ends marked, so a misspelling no text has shown before still has most of its vector from words
that were.  Embeddings and softmax are trained together in numpy, on labelled rows only, by Adam over the log loss.  A subword has a
vector if its presence goes with the label beyond what chance gives the likeliest of all subwords tried (and LEAST_ROWS texts hold it); the
mean is over all subwords, those without one counting as zeros.  Without that choice the many subwords of few texts learn the labels by
heart.  Since the softmax is linear, a subword's share in the margin is one number: scoring is one pass of table look-ups, without a shuffle.

The fit reads at most MAX_ROWS distinct labelled texts of MAX_BYTES altogether, those with the least hashes.

Defined results: null counts as empty; a text without words gets the score of the softmax's bias; an id or a text with both labels counts
as what most of its rows say (a tie: toxic); without labels of both kinds every score is 0.5; texts of any length are read whole, in pieces; repeated rows score alike; an
empty table gives an empty result.  A column named like the score gives way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, text
from .quality import held_out

MAX_ROWS, MAX_BYTES, LEAST_ROWS, THRESHOLD = 12000, 16 << 20, 3, 0.5
BITS, GRAMS, DIM, STEPS, RATE, DECAY, SEED = 18, (3, 4, 5), 8, 300, 0.1, 1e-6, 11
_OPEN, _CLOSE = 0x110000, 0x110001  # beyond all characters


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of the first 65536 characters (the last stands for all beyond): the lower case, and whether they make words."""
    chars = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(1 << 16)]
    lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(chars)], np.uint32)
    inside = np.array([c.isalnum() or c in "@$*" for c in chars])
    inside[-1] = True
    return lower, inside


_LOWER, _INSIDE = _tables()


def _pieces(b: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows i to j, their bytes and where each starts; one very long row comes in parts cut at blanks."""
    for i, j in text.runs(off):
        lo, hi = int(off[i]), int(off[j])
        if hi - lo <= text.PIECE:
            yield i, j, b[lo:hi], off[i : j + 1] - lo
            continue
        while lo < hi:
            to = min(hi, lo + text.PIECE)
            while to < hi and not text.BLANK[b[to - 1]]:
                gap = np.flatnonzero(text.BLANK[b[lo:to]])
                to = lo + int(gap[-1]) + 1 if len(gap) else min(hi, to + text.PIECE)
            yield i, j, b[lo:to], np.array([0, to - lo])
            lo = to


def subwords(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of one piece, and the row of each."""
    lead = (b & 0xC0) != 0x80
    starts = np.concatenate([[0], np.cumsum(lead)])[off]
    c = np.frombuffer(b.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    low = np.minimum(c, 0xFFFF)
    on = _INSIDE[low]
    c = np.where(c < 0xFFFF, _LOWER[low], c)
    n = len(c)
    first, last = on.copy(), on.copy()
    first[1:] &= ~on[:-1]
    last[:-1] &= ~on[1:]
    inner = starts[(starts > 0) & (starts < n)]
    first[inner], last[inner - 1] = on[inner], on[inner - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.searchsorted(starts, s, "right") - 1
    size = e - s + 2
    at = np.concatenate([[0], np.cumsum(size)])
    word = np.repeat(np.arange(len(s), dtype=np.int32), size)
    marked = np.empty(int(at[-1]), np.uint64)
    body = np.ones(len(marked), bool)
    body[at[:-1]] = body[at[1:] - 1] = False
    marked[at[:-1]], marked[at[1:] - 1] = _OPEN, _CLOSE
    marked[body] = c[on]
    powers, _ = text.powers(int(size.max()))
    place = np.arange(len(marked)) - np.repeat(at[:-1], size)
    with np.errstate(over="ignore"):
        whole = np.add.reduceat(text.mix(marked + text.U(1)) * powers[place], at[:-1])
        hashes, rows = [text.mix(whole)], [row]
        g = marked.copy()
        for k in range(1, max(GRAMS)):
            g = g[: len(marked) - k] * text._STEP + marked[k:]
            if k + 1 in GRAMS and len(g):
                inside = word[k:] == word[: len(g)]
                hashes.append(text.mix(g[inside] + text.U(k)))
                rows.append(row[word[: len(g)][inside]])
    return (np.concatenate(hashes) >> text.U(64 - BITS)).astype(np.int64), np.concatenate(rows)


def bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct buckets with their counts: buckets, counts, where each row starts."""
    b, off = text.raw(column)
    rows, keys, counts = len(off) - 1, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, _, piece, starts in _pieces(b, off):
        bucket, row = subwords(piece, starts)
        k, n = np.unique((row + i) << BITS | bucket, return_counts=True)
        keys.append(k)
        counts.append(n)
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.zeros(len(key), np.int64)
    np.add.at(count, at, np.concatenate(counts))
    return key & ((1 << BITS) - 1), count, np.searchsorted(key >> BITS, np.arange(rows + 1))


@dataclass
class Bag:
    """Trained embeddings of the buckets and the softmax over their mean; ``margin`` is what each bucket adds to the log odds."""

    buckets: np.ndarray  # those with a vector; the others count as zeros
    embeddings: np.ndarray  # (buckets, DIM)
    softmax: np.ndarray  # (DIM, 2)
    bias: np.ndarray  # (2,)

    def __post_init__(self):
        self.margin = np.zeros(1 << BITS, np.float32)
        self.margin[self.buckets] = self.embeddings @ (self.softmax[:, 1] - self.softmax[:, 0])
        self.offset = float(self.bias[1] - self.bias[0])

    def score(self, column: pa.Array) -> np.ndarray:
        """Probability of the second class; the mean is over all subwords of the text."""
        return score(self.margin, self.offset, column)


def score(margin: np.ndarray, offset: float, column: pa.Array) -> np.ndarray:
    b, off = text.raw(column)
    total, n = np.zeros(len(off) - 1), np.zeros(len(off) - 1)
    for i, j, piece, starts in _pieces(b, off):
        bucket, row = subwords(piece, starts)
        total[i:j] += np.bincount(row, margin[bucket], j - i)
        n[i:j] += np.bincount(row, minlength=j - i)
    return 1 / (1 + np.exp(-np.clip(offset + total / np.maximum(n, 1), -40, 40)))


def loss_and_gradient(e: np.ndarray, w: np.ndarray, bias: np.ndarray, at: np.ndarray, share: np.ndarray, off: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log loss of texts given as shares of embeddings (text k: entries off[k]:off[k + 1]), and its gradients by e, w and bias."""
    rows = np.repeat(np.arange(len(y)), np.diff(off))
    part = e[at] * share[:, None]
    mean = np.stack([np.bincount(rows, part[:, d], len(y)) for d in range(e.shape[1])], 1)
    z = mean @ w + bias
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(1, keepdims=True)
    loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).mean()
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    back = (p @ w.T)[rows] * share[:, None]
    ge = np.stack([np.bincount(at, back[:, d], len(e)) for d in range(e.shape[1])], 1)
    return float(loss), ge, mean.T @ p, p.sum(0)


def telling(n: np.ndarray, k: np.ndarray, total: float, ones: float) -> np.ndarray:
    """Buckets that tell the labels apart beyond chance, of n[b] rows with bucket b, k[b] of which are ones: the likelihood ratio of each
    one's two-by-two table against the log of how many are tried."""
    tried = n >= LEAST_ROWS

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-300) / np.maximum(expected, 1e-300)), 0)

    p = ones / total
    ratio = 2 * (part(k, n * p) + part(n - k, n * (1 - p)) + part(ones - k, (total - n) * p) + part(total - ones - n + k, (total - n) * (1 - p)))
    return np.flatnonzero(tried & (ratio > np.log(max(tried.sum(), 2))))


def fit(known: np.ndarray, at: np.ndarray, share: np.ndarray, off: np.ndarray, y: np.ndarray, steps: int = STEPS) -> Bag:
    """Embeddings of the buckets ``known`` and softmax, by Adam over the log loss of all rows (given as in loss_and_gradient)."""
    r = np.random.Generator(np.random.PCG64(SEED))
    theta = [np.zeros((len(known), DIM)), r.normal(0, DIM**-0.5, (DIM, 2)), np.log(np.array([np.mean(y == 0), np.mean(y == 1)]))]
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, steps + 1):
        _, *grads = loss_and_gradient(*theta, at, share, off, y)
        for t, g, mm, vv, decay in zip(theta, grads, m, v, (DECAY, DECAY, 0)):
            g = g + decay * t
            mm += 0.1 * (g - mm)
            vv += 0.01 * (g * g - vv)
            t -= RATE * (1 - step / (steps + 1)) * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-9)
    return Bag(known, *theta)


def _sample(rows: DataFrame, marks: DataFrame) -> list[tuple[int, int, int]]:
    """Id, hash and label of at most MAX_ROWS distinct texts of MAX_BYTES altogether, those with the least hashes."""
    usable = ~F.coalesce(held_out(F.col("id")), F.lit(True))
    known = marks.where(usable & F.col("y").isNotNull()).groupBy("id").agg(F.avg("y").alias("y"))
    seen = rows.where(usable).select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    texts = seen.join(known, "id").groupBy("hash").agg(F.avg("y").alias("y"), F.min("id").alias("id"), F.max("size").alias("size"))
    taken, left = [], MAX_BYTES
    for r in texts.orderBy(F.xxhash64("hash"), "hash").limit(MAX_ROWS).collect():
        left -= r["size"]
        if left < 0 and taken:
            break
        taken.append((r["id"], r["hash"], int(r["y"] >= 0.5)))
    return taken


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Bag | None:
    """The model; None without labels of both kinds.  The driver gets counts of buckets and, of each row, its telling ones only."""
    store.lean(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    taken = _sample(rows, labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")))
    total, ones = len(taken), sum(y for _, _, y in taken)
    if not 0 < ones < total:
        return None
    wanted = docs.sparkSession.createDataFrame(taken, "id long, hash long, y int")  # at most MAX_ROWS rows

    def counted(batches):
        for batch in batches:
            bucket, count, off = bags(batch.column(2))
            row = lambda x: pa.array([x[i:j].astype(np.uint32).tobytes() for i, j in zip(off[:-1], off[1:])], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), row(bucket), row(count)], names=["hash", "y", "bucket", "count"])

    hashed = rows.withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    sample = hashed.join(F.broadcast(wanted), ["id", "hash"]).dropDuplicates(["hash"]).select("hash", "y", "text")  # rows of one id and text count once
    bagged = store.put(sample.mapInArrow(counted, "hash long, y int, bucket binary, count binary"), "bags")

    def presence(batches):
        n, k = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for y, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                at = np.frombuffer(x.as_buffer(), np.uint32)
                n[at] += 1
                k[at] += y
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(k[some])], names=["bucket", "n", "k"])

    seen = bagged.select("y", "bucket").mapInArrow(presence, "bucket long, n long, k long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).toArrow()  # at most 2**BITS rows
    n, k = np.zeros(1 << BITS), np.zeros(1 << BITS)
    where = seen.column("bucket").to_numpy()
    n[where], k[where] = seen.column("n").to_numpy(), seen.column("k").to_numpy()
    known = telling(n, k, total, ones)
    place = np.full(1 << BITS, -1, np.int32)
    place[known] = np.arange(len(known))

    def shares(batches):
        for batch in batches:
            out = []
            for x, c in zip(batch.column(2), batch.column(3)):
                at, count = place[np.frombuffer(x.as_buffer(), np.uint32)], np.frombuffer(c.as_buffer(), np.uint32)
                out.append((at[at >= 0].tobytes(), (count[at >= 0] / max(count.sum(), 1)).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([o[i] for o in out], pa.binary()) for i in (0, 1))], names=["hash", "y", "at", "share"])

    got = bagged.mapInArrow(shares, "hash long, y int, at binary, share binary").toPandas().sort_values("hash")
    store.drop(bagged)
    off = np.concatenate([[0], np.cumsum([len(x) // 4 for x in got["at"]])]).astype(np.int64)
    return fit(known, np.frombuffer(b"".join(got["at"]), np.int32).astype(np.int64), np.frombuffer(b"".join(got["share"]), np.float64), off, got.y.to_numpy().astype(np.int64))


def score_toxicity(docs: DataFrame, bag: Bag | None, text_col: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """The columns ``keep`` (default: all) and the score; a column named like the score gives way."""
    store.lean(docs.sparkSession)
    kept = [F.col(f"`{c}`") for c in (keep or docs.columns) if c != out]
    if bag is None:
        return docs.select(*kept, F.lit(0.5).alias(out))
    margin, offset = bag.margin, bag.offset
    scored = text.column_function(lambda t: pa.array(score(margin, offset, t), pa.float64()), "double")
    return docs.select(*kept, scored(F.col(f"`{text_col}`")).alias(out))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents")
    bag = learn(docs, store.table(spark, sf_dir, "labels"))
    return score_toxicity(docs, bag, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op13_toxicity": op13_toxicity}
ORACLE_SQL: dict[str, str] = {}
