"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text are all it learns from; labels 0 are not used.  A first network
separates positives from unlabelled rows; where its ranking is purest, the ratio of the two tail masses estimates the class
prior of the unlabelled text (best-bin estimate).  The scorer is then trained on the non-negative unbiased risk

    prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)]),

logistic l, so that sigmoid(f) reads as a probability.  Features are shapes of the text only (shares of kinds of
characters, repetition, lengths).  The fit uses at most MAX_POSITIVE + MAX_UNLABELLED rows, those with the least hashes of their
ids; scoring is one pass without a shuffle.

Defined results: null counts as empty; empty texts get the score of an all-zero feature row; an id with labels 1 and 0 is no
trusted positive; without unlabelled rows all rows of the learning folds stand in for them; without positives every score is 0.5;
repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, text

MAX_POSITIVE, MAX_UNLABELLED, FOLDS, THRESHOLD = 6000, 12000, 5, 0.3
HIDDEN, STEPS, RATE, SEED = 24, 700, 0.02, 5
_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 a-z, 2 A-Z, 3 digit, 4 blank, 5 line end, 6 punctuation, 7 non-ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9]], _CLASS[[10, 13]], _CLASS[128:] = 1, 2, 3, 4, 5, 7
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 6
_PAIRS = [(1, 2), (2, 2), (6, 6), (6, 1), (4, 6), (3, 3)]
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
NAMES = [*(f"share_{k}" for k in range(8)), *(f"pair_{a}{b}" for a, b in _PAIRS), *(f"mark_{m}" for m in _MARKS), "words", "word_length", "distinct", "repeat_1", "repeat_2", "distinct_5", "lines", "distinct_lines", "nonempty"]


def features(column: pa.Array) -> np.ndarray:
    """(rows, NAMES) in float32."""
    b, off = text.raw(column)
    out = np.zeros((len(off) - 1, len(NAMES)), np.float32)
    for i, j in text.runs(off):
        _features(b[off[i] : off[j]], off[i : j + 1] - off[i], out[i:j])
    return out


def _per_row(on: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate([np.zeros(1, np.int32), np.cumsum(on, dtype=np.int32)])
    return c[off[1:]] - c[off[:-1]]


def _distinct(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((h, row))
    h, r = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[fresh], minlength=len(off) - 1)


def _features(b: np.ndarray, off: np.ndarray, out: np.ndarray) -> None:
    rows, size = len(off) - 1, np.maximum(np.diff(off), 1)
    kind = _CLASS[b]
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(off))
    for k in range(8):
        out[:, k] = _per_row(kind == k, off) / size
    two = np.zeros_like(kind)
    two[:-1] = kind[:-1] * 8 + kind[1:]
    at = 8
    for x, y in _PAIRS:
        out[:, at] = _per_row(two == x * 8 + y, off) / size
        at += 1
    where = np.flatnonzero(kind == 6)
    marks = np.bincount(row[where].astype(np.int64) * 256 + b[where], minlength=256 * rows).reshape(rows, 256)
    out[:, at : at + len(_MARKS)] = marks[:, list(_MARKS)] / size[:, None]
    at += len(_MARKS)
    h, w = text.words(b, off, text.BLANK)
    n = np.diff(w)
    some = np.maximum(n, 1)
    for back, slot in ((1, at + 3), (2, at + 4)):
        same = np.zeros(len(h), bool)
        same[back:] = h[back:] == h[:-back] if len(h) > back else False
        out[:, slot] = _per_row(same, w) / some
    g, gw = text.shingles(h, w, 5)
    lines, lw = text.words(b, off, np.isin(np.arange(256), [10, 13]))
    out[:, at] = np.log1p(n)
    out[:, at + 1] = np.where(n > 0, (np.diff(off) - _per_row(kind == 4, off) - _per_row(kind == 5, off)) / some, 0)
    out[:, at + 2] = _distinct(h, w) / some
    out[:, at + 5] = _distinct(g, gw) / np.maximum(np.diff(gw), 1)
    out[:, at + 6] = np.log1p(np.diff(lw))
    out[:, at + 7] = _distinct(lines, lw) / np.maximum(np.diff(lw), 1)
    out[:, at + 8] = n > 0


@dataclass
class Net:
    """One hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x).astype(np.float64))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _through(theta: list[np.ndarray], z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = np.tanh(z @ theta[0] + theta[1])
    return a, a @ theta[2] + theta[3]


def risk(theta: list[np.ndarray], zp: np.ndarray, zu: np.ndarray, prior: float | None) -> tuple[float, float]:
    """The positive part of the risk, and the negative one before it is stopped at 0 (prior None: of the plain separation)."""
    fp, fu = _through(theta, zp)[1], _through(theta, zu)[1]
    if prior is None:
        return np.logaddexp(0, -fp).mean() / 2, np.logaddexp(0, fu).mean()
    return prior * np.logaddexp(0, -fp).mean(), np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()


def gradient(theta: list[np.ndarray], zp: np.ndarray, zu: np.ndarray, prior: float | None) -> list[np.ndarray]:
    """Of both parts' sum; where the negative part is below 0, which no distribution can give, of minus that part, to undo some of it."""
    (ap, fp), (au, fu) = _through(theta, zp), _through(theta, zu)
    sp, su = _sigmoid(fp), _sigmoid(fu)
    if prior is None:
        gp, gu = (sp - 1) / len(sp) / 2, su / len(su)
    elif risk(theta, zp, zu, prior)[1] >= 0:
        gp, gu = (prior * (sp - 1) - prior * sp) / len(sp), su / len(su)
    else:
        gp, gu = prior * sp / len(sp), -su / len(su)

    def back(z, a, g):
        ga = np.outer(g, theta[2]) * (1 - a * a)
        return [z.T @ ga, ga.sum(0), a.T @ g, np.array([g.sum()])]

    return [x + y for x, y in zip(back(zp, ap, gp), back(zu, au, gu))]


def fit(p: np.ndarray, u: np.ndarray, prior: float | None, steps: int = STEPS) -> Net:
    """Adam on the non-negative risk; prior None: plain logistic separation of p from u."""
    r = np.random.Generator(np.random.PCG64(SEED))
    both = np.concatenate([p, u])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    zp, zu = (np.clip((x - mean) / scale, -6, 6).astype(np.float64) for x in (p, u))
    d = p.shape[1]
    theta = [r.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]

    for step in range(1, steps + 1):
        ip, iu = r.integers(0, len(zp), min(len(zp), 1024)), r.integers(0, len(zu), min(len(zu), 2048))
        grads = [g + 1e-4 * t for g, t in zip(gradient(theta, zp[ip], zu[iu], prior), theta)]
        for t, g, mm, vv in zip(theta, grads, m, v):
            mm += 0.1 * (g - mm)
            vv += 0.001 * (g * g - vv)
            t -= RATE * (1 - step / (steps + 1)) * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    return Net(mean, scale, *theta[:3], float(theta[3][0]))


def class_prior(p: np.ndarray, u: np.ndarray, delta: float = 0.1, gamma: float = 0.01, parts: int = 3, slack: float = 0.5) -> float:
    """Share of positives in u: the least upper bound of U's over P's mass above a score.

    Every row is scored by a network that has not seen it (one a part), as its rank among that network's positives, so all rows count in
    the bound, whose width shrinks with their number; of that width, ``slack`` is taken, since the whole of it draws small samples towards 1.
    """
    if len(p) < parts or len(u) < parts:
        return 0.5
    r = np.random.Generator(np.random.PCG64(SEED))
    fp, fu = r.permutation(len(p)) % parts, r.permutation(len(u)) % parts
    sp, su = np.zeros(len(p)), np.zeros(len(u))
    for k in range(parts):
        net = fit(p[fp != k], u[fu != k], None, STEPS // 2)
        seen = np.sort(net.margin(p[fp != k]))
        for scores, rows, own in ((sp, p, fp), (su, u, fu)):
            scores[own == k] = np.searchsorted(seen, net.margin(rows[own == k])) / len(seen)
    sp, su = np.sort(sp), np.sort(su)
    cut = np.unique(sp)
    qp, qu = 1 - np.searchsorted(sp, cut, "left") / len(sp), 1 - np.searchsorted(su, cut, "left") / len(su)
    width = (np.sqrt(np.log(4 / delta) / 2 / len(sp)) + np.sqrt(np.log(4 / delta) / 2 / len(su))) * (1 + gamma) / qp
    k = int(np.argmin(qu / qp + slack * width))
    return float(np.clip(qu[k] / qp[k], 0.02, 0.98))


def held_out(id_: Column) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % FOLDS == 0


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Net | None:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("y")).where(~F.coalesce(held_out(F.col("id")), F.lit(True)))
    least = lambda ids, n: ids.orderBy(F.xxhash64("id"), "id").limit(n)
    ids = rows.select("id").where(~F.coalesce(held_out(F.col("id")), F.lit(True)))
    known = marks.where(F.col("y").isNotNull()).groupBy("id").agg(F.min("y").alias("y"))
    positive = least(ids.distinct().join(known.where("y = 1"), "id", "left_semi"), MAX_POSITIVE).withColumn("p", F.lit(1))
    unlabelled = least(ids.distinct().join(known, "id", "left_anti"), MAX_UNLABELLED).withColumn("p", F.lit(0))
    sample = [(r["id"], r["p"]) for r in positive.unionByName(unlabelled).collect()]
    if not any(p == 0 for _, p in sample):
        sample += [(r["id"], 0) for r in least(ids.distinct(), MAX_UNLABELLED).collect()]
    if not any(p == 1 for _, p in sample) or not any(p == 0 for _, p in sample):
        return None
    wanted = docs.sparkSession.createDataFrame(sample, "id long, p int")  # at most MAX_POSITIVE + MAX_UNLABELLED rows

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in features(batch.column(2))], pa.binary())], names=["id", "p", "x"])

    got = rows.join(F.broadcast(wanted), "id").select("id", "p", "text").mapInArrow(run, "id long, p int, x binary").toPandas().sort_values(["id", "x"])
    x = np.frombuffer(b"".join(got.x), np.float32).reshape(-1, len(NAMES))
    p, u = x[got.p.to_numpy() == 1], x[got.p.to_numpy() == 0]
    if not len(p) or not len(u):
        return None
    return fit(p, u, class_prior(p, u))


def score(docs: DataFrame, net: Net | None, text_col: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """The columns ``keep`` (default: all) and the score; a column named like the score gives way."""
    store.lean(docs.sparkSession)
    kept = [F.col(f"`{c}`") for c in (keep or docs.columns) if c != out]
    scored = text.column_function(lambda t: pa.array(net.score(features(t)), pa.float64()), "double")
    return docs.select(*kept, (F.lit(0.5) if net is None else scored(F.col(text_col))).alias(out))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents")
    net = learn(docs, store.table(spark, sf_dir, "labels"))
    return score(docs, net, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op2_quality_classifier": op2_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
