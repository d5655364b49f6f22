"""Document fingerprints: threshold-scaled sketches of byte shingles.

A sketch keeps *every* shingle hash below a fixed fraction of the hash range, so sketches of different documents are
samples of one and the same random subset of all shingles: the sketch of a union is the union of the sketches, and
containment can be estimated between documents of very unequal length, which bottom-k sketches don't allow.

One rule holds for texts of all sizes: shingles of 8 bytes, one in four kept.  Of a text of 30 bytes inside another one no shingle is kept in
one case of a thousand; where any is, the containment of a whole text in another one comes out as 1, whatever their lengths.

Defined results: a null text counts as empty; an empty text has an empty sketch; a text shorter than a shingle
is one shingle; equal texts have equal fingerprints and likeness 1; likeness with an empty sketch is otherwise 0.
Equal rows give equal rows.  Other columns of the input, whatever their names, aren't touched.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store, text

#: Bytes of a shingle; the share of all hashes that is kept, as a power of two; bits stored of each kept hash.
SHINGLE, KEEP_LOG2, BITS = 8, 2, 32
U = np.uint64


def sketches(texts: list[str | None], shingle: int = SHINGLE, keep_log2: int = KEEP_LOG2) -> list[np.ndarray]:
    """Sorted distinct kept hashes of each text, of BITS bits each (the bits below those that are 0 in all)."""
    b, off = text.raw(pa.array(texts, pa.large_string()))
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    most, shift = U((1 << (64 - keep_log2)) - 1), U(64 - keep_log2 - BITS)
    for i, j in text.runs(off):
        lo, hi = int(off[i]), int(off[j])
        if hi - lo <= text.PIECE:
            g = text.byte_grams(b[lo:hi], shingle)
            at = np.flatnonzero(g <= most)
            row = np.searchsorted(off[i + 1 : j + 1] - lo, at, "right")
            fits = at + shingle <= off[i + 1 + row] - lo
            at, row = at[fits], row[fits]
            kept, cut = g[at] >> shift, np.searchsorted(row, np.arange(j - i + 1))
            for r in range(j - i):
                if cut[r + 1] > cut[r]:
                    out[i + r] = np.unique(kept[cut[r] : cut[r + 1]])
        else:
            found = []
            for p in range(lo, hi, text.PIECE):
                g = text.byte_grams(b[p : min(hi, p + text.PIECE + shingle - 1)], shingle)
                found.append(np.unique(g[g <= most] >> shift))
            out[i] = np.unique(np.concatenate(found))
    size = np.diff(off)
    for r in np.flatnonzero((size > 0) & (size < shingle)):
        g = text.byte_grams(b[off[r] : off[r + 1]], int(size[r]))
        out[r] = g[g <= most] >> shift
    return out


def digest(t: str | None) -> str:
    return hashlib.sha256((t or "").encode()).hexdigest()


def _packed(sketch: np.ndarray) -> str:
    b = sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :]
    return base64.b64encode(b.tobytes()).decode()


def _unpacked(body: str) -> np.ndarray:
    b = np.frombuffer(base64.b64decode(body), np.uint8).reshape(-1, BITS // 8)
    wide = np.zeros((len(b), 8), np.uint8)
    wide[:, 8 - BITS // 8 :] = b
    return wide.view(">u8").ravel().astype(np.uint64)


def encode(sketch: np.ndarray, sha256: str) -> str:
    """``<16 hex digits of the text's digest>:<base64 of the kept hashes, ascending, big-endian>``."""
    return f"{sha256[:16]}:{_packed(sketch)}"


def decode(fingerprint: str | None) -> tuple[str, np.ndarray]:
    head, _, body = (fingerprint or "").partition(":")
    return head, _unpacked(body)


def fingerprints(texts: list[str | None]) -> list[str]:
    return [encode(s, digest(t)) for s, t in zip(sketches(texts), texts)]


def common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def likeness(a: np.ndarray, b: np.ndarray, same: bool = False) -> float:
    """Estimated containment of the smaller in the larger document, each given by its sketch."""
    least = min(len(a), len(b))
    return 1.0 if same else common(a, b) / least if least else 0.0


@F.pandas_udf(T.StringType())
def _fingerprint(t):
    return type(t)(fingerprints(t.tolist()))


@F.pandas_udf(T.DoubleType())
def _containment(a, b):
    out = []
    for x, y in zip(a, b):
        (dx, own), (dy, other) = decode(x), decode(y)
        out.append(1.0 if dx == dy else common(own, other) / len(own) if len(own) else 0.0)
    return type(a)(out)


@F.pandas_udf(T.StringType())
def _merged(a, b):
    out = []
    for x, y in zip(a, b):
        out.append(encode(np.union1d(decode(x)[1], decode(y)[1]), digest(f"{x}|{y}")))
    return type(a)(out)


def fingerprint(column: Column | str) -> Column:
    """Fingerprint of a text column."""
    return _fingerprint(column)


def containment(a: Column | str, b: Column | str) -> Column:
    """Estimated share of a's shingles that b has, from two fingerprint columns."""
    return _containment(a, b)


def merged(a: Column | str, b: Column | str) -> Column:
    """Fingerprint of two documents together."""
    return _merged(a, b)


def _slot(id_: Column, bounds: list) -> Column:
    """How many of the ascending bounds are <= id_: a binary search in the JVM."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(math.ceil(math.log2(len(bounds) + 1))))]
    values = F.array(*[F.lit(x) for x in bounds])
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(F.coalesce(F.get(values, at + s - 1) <= id_, F.lit(False)), at + s).otherwise(at)
    )
    return F.when(id_.isNull(), F.lit(0)).otherwise(found)


def with_successor(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(slot, foreign, id, text): rows dealt to slots by ranges of id, one slot a partition and each in order (nulls
    first, ties by text); the last row of a slot is followed by a copy of the first row of the next slot (``foreign``),
    and at the very end by the first row of all.  The texts move once; no task sees more than a slot.
    """
    spark, n = docs.sparkSession, store.parts(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = rows.select(F.col("id"))
    bounds = sorted(set(map(int, ids.na.drop().approxQuantile("id", [k / n for k in range(1, n)], 0.25 / n)))) if n > 1 else []
    slot = _slot(F.col("id"), bounds)
    firsts = {r["slot"]: None if r["nulls"] else r["least"] for r in ids.groupBy(slot.alias("slot")).agg(F.min("id").alias("least"), F.max(F.col("id").isNull()).alias("nulls")).collect()}
    used = sorted(firsts)
    before = dict(zip(used, [*used[-1:], *used[:-1]]))
    #: By slot: its first id, whether it has rows, and where the copy of its first row goes.
    first = F.array(*[F.lit(firsts.get(s)).cast("long") for s in range(len(bounds) + 1)])
    to = F.array(*[F.lit(before.get(s)).cast("int") for s in range(len(bounds) + 1)])
    go = F.when(F.col("id").eqNullSafe(F.get(first, F.col("slot"))), F.get(to, F.col("slot")))
    own = rows.withColumn("slot", slot)
    dealt = own.select("id", "text", F.explode(F.array_compact(F.array(F.struct("slot", F.lit(False).alias("foreign")), F.when(go.isNotNull(), F.struct(go.alias("slot"), F.lit(True).alias("foreign")))))).alias("to"))
    dealt = dealt.select(F.col("to.slot").alias("slot"), F.col("to.foreign").alias("foreign"), "id", "text")
    return dealt.repartitionById(n, F.col("slot")).sortWithinPartitions("slot", "foreign", "id", "text")


def edited(own: str, following: str) -> str:
    """The text with its last floor(n/4) code points replaced by the first as many (or all) of the following one."""
    q = len(own) // 4
    return own[: len(own) - q] + following[:q] if q else own


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # (slot, foreign, id, text, sketch, sha256) of the row before
    for batch in batches:
        _, off = text.raw(batch.column(3))
        for i, j in text.runs(off, 4 * text.PIECE):
            part = batch.slice(i, j - i)
            slots, foreign, ids, texts = (part.column(c).to_pylist() for c in range(4))
            shas = list(map(digest, texts))
            rows = [*([held] if held else []), *zip(slots, foreign, ids, texts, sketches(texts), shas)]
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1] and a[0] == b[0]]
            held = rows[-1]
            if not pairs:
                continue
            changed = [edited(a[3], b[3]) for a, b in pairs]
            out = []
            for (a, b), t, s in zip(pairs, changed, sketches(changed)):
                sha = digest(t)
                out.append((a[2], len(a[3]), sha, encode(a[4], a[5]), encode(s, sha), likeness(a[4], s, a[5] == sha), likeness(a[4], b[4], a[5] == b[5])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()])], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how near the text's is to the edited one's and the next one's."""
    store.lean(docs.sparkSession)
    return with_successor(docs, id_col, text_col).mapInArrow(_digests, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_report(store.table(spark, sf_dir, "documents"))


QUERIES = {"op1_document_fingerprints": op1_document_fingerprints}
ORACLE_SQL: dict[str, str] = {}
