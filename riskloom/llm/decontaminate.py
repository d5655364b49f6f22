"""Benchmark decontamination by winnowing.

Of every ``SPAN - GRAM + 1`` consecutive ``GRAM``-word hashes the least is kept (all of them on ties), in the documents
and in the benchmark alike.  Two texts that share ``SPAN`` consecutive words then share a kept fingerprint, always.
Documents' fingerprints are joined to the benchmark's, and each hit is extended to the windows of ``SPAN`` words around
it, which are looked up exactly.  An item of m < SPAN words is one window of m words: for these, all m-word hashes are
fingerprints.

The benchmark is read in blocks of about ``block_bytes`` of text, measured before it is read; every block is matched against
all documents.  With more than one, only one block at a time is in the driver and in the executors: its hits are written before the
next is read, and the blocks' hits are merged by document.  No document text is shuffled.

Defined results: null or wordless texts have no words and hit nothing; items without words match nothing; a null
item id counts as ``null``; equal ids count once; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, text

SPAN, GRAM, BLOCK_BYTES = 10, 5, 16 << 20
SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Lookup:
    """64-bit keys, each with the items that have it; a bitmap answers most misses."""

    def __init__(self, keys: np.ndarray, items: np.ndarray):
        order = np.lexsort((items, keys))
        keys, items = keys[order], items[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (items[1:] != items[:-1])
        keys, self.items = keys[fresh], items[fresh]
        self.keys, first = np.unique(keys, return_index=True)
        self.first = np.append(first, len(keys)).astype(np.int64)
        self.shift = np.uint64(64 - max(16, min(24, int(np.ceil(np.log2(len(self.keys) + 1))) + 5)))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[self.keys >> self.shift] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h whose value is a key, and which key."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[h >> self.shift])
        k = np.searchsorted(self.keys, h[at])
        k[k == len(self.keys)] = 0
        ok = self.keys[k] == h[at]
        return at[ok], k[ok]


def winnow(g: np.ndarray, window: int) -> np.ndarray:
    """Positions of hashes that are the least of some ``window`` consecutive ones."""
    n = len(g) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = g[:n].copy()
    for i in range(1, window):
        np.minimum(least, g[i : i + n], out=least)
    kept = np.zeros(len(g), bool)
    for i in range(window):
        kept[i : i + n] |= g[i : i + n] == least
    return np.flatnonzero(kept)


class Block:
    """Fingerprints and windows of some benchmark items."""

    def __init__(self, items: list[tuple[str, str | None]], span: int = SPAN, gram: int = GRAM):
        self.span, self.gram, self.names = span, gram, sorted({str(i) if i is not None else "null" for i, _ in items})
        name = {x: k for k, x in enumerate(self.names)}
        windows: dict[int, list[tuple[np.ndarray, int]]] = {}
        prints = [np.zeros(0, np.uint64)]
        for item, t in items:
            h, w = text.words(*text.raw(pa.array([t], pa.large_string())), text.NOT_ALNUM)
            size = min(len(h), span)
            if size:
                windows.setdefault(size, []).append((text.grams(h, size), name[str(item) if item is not None else "null"]))
            if size == span:
                g = text.grams(h, gram)
                prints.append(g[winnow(g, span - gram + 1)])
        self.windows = {m: Lookup(np.concatenate([g for g, _ in x]), np.concatenate([np.full(len(g), k) for g, k in x])) for m, x in windows.items()}
        prints = np.unique(np.concatenate(prints))
        self.prints = Lookup(prints, np.zeros(len(prints), np.int64))

    def hits(self, h: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, first words, keys) of all windows that occur within a row."""
        for size, lookup in self.windows.items():
            if size < self.span:
                at, key = lookup.find(text.grams(h, size))
            else:
                g = text.grams(h, self.gram)
                kept = winnow(g, self.span - self.gram + 1)
                near, _ = self.prints.find(g[kept])
                at = np.unique((kept[near][:, None] - np.arange(self.span - self.gram + 1)).ravel())
                at = at[(at >= 0) & (at + self.span <= len(h))]
                near, key = lookup.find(text.grams_at(h, at, self.span))
                at = at[near]
            inside = off[np.searchsorted(off, at, "right")] >= at + size
            yield size, at[inside], key[inside]


def _scan(column: pa.Array, block: Block) -> Iterator[tuple]:
    """For each row: number of words, which words are hit (first and end of each stretch), items."""
    b, off = text.raw(column)
    for i, j in text.runs(off):
        h, w = text.words(b[off[i] : off[j]], off[i : j + 1] - off[i], text.NOT_ALNUM)
        cover, pairs = np.zeros(len(h) + 1, np.int64), [np.zeros((0, 2), np.int64)]
        for size, at, key in block.hits(h, w):
            if len(at):
                np.add.at(cover, at, 1)
                np.add.at(cover, at + size, -1)
                lookup, row = block.windows[size], np.searchsorted(w, at, "right") - 1
                both = np.unique(np.stack([row, key], 1), axis=0)
                count = lookup.first[both[:, 1] + 1] - lookup.first[both[:, 1]]
                start = np.repeat(lookup.first[both[:, 1]] - np.cumsum(count) + count, count)
                pairs.append(np.stack([np.repeat(both[:, 0], count), lookup.items[start + np.arange(len(start))]], 1))
        on = np.zeros(len(h) + 2, bool)
        on[1:-1] = np.cumsum(cover[:-1]) > 0
        pairs = np.unique(np.concatenate(pairs), axis=0)
        cut = np.searchsorted(pairs[:, 0], np.arange(j - i + 1))
        for r in range(j - i):
            lo, hi = int(w[r]), int(w[r + 1])
            if cut[r] == cut[r + 1]:
                yield hi - lo, (), (), ()
                continue
            x = np.zeros(hi - lo + 2, np.int8)
            x[1:-1] = on[lo + 1 : hi + 1]
            d = np.diff(x)
            yield hi - lo, np.flatnonzero(d == 1), np.flatnonzero(d == -1), [block.names[k] for k in pairs[cut[r] : cut[r + 1], 1]]


def _result(n: int, starts, ends, items) -> tuple:
    items = sorted(set(items))
    hit = int(np.sum(ends) - np.sum(starts)) if len(starts) else 0
    return n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0


def _union(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    starts, ends = [], []
    for s, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(e, ends[-1])
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The benchmark's rows, at most about block_bytes of text at a time."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + F.lit(64))).first()[0] or 0
    count = -(-int(total) // block_bytes)
    for k in range(count):
        part = rows if count == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k)
        yield [(r["item"], r["text"]) for r in part.collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES, prefix: str = "") -> DataFrame:
    """The columns ``keep`` of docs (default: all), then SCHEMA's, named with the prefix; a kept column of the same name gives way."""
    store.lean(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    own = {prefix + x for x in names}
    kept = [F.col(f"`{c}`") for c in (keep or docs.columns) if c not in own]
    blocks = blocks_of(benchmark, item_col, item_text_col, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is not None:
        return _many(docs.select(*kept, F.col(text_col).alias("__text")), chain([first, second], blocks), prefix)
    block = docs.sparkSession.sparkContext.broadcast(Block(first))
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()])))

    def of(column: pa.Array) -> pa.Array:
        out = [_result(*x) for x in _scan(column, block.value)]
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], names=names)

    found = text.column_function(of, "struct<" + SCHEMA.replace(" long", ":bigint").replace(" string", ":string").replace(" boolean", ":boolean").replace(", ", ",") + ">")
    return docs.select(*kept, found(F.col(text_col)).alias("__found")).select(*kept, *[F.col(f"__found.{x}").alias(prefix + x) for x in names])


def _many(rows: DataFrame, blocks: Iterator[list], prefix: str) -> DataFrame:
    """One block after the other against all documents; only one is held at a time, its hits are written before the next is read.
    Hits come together by document (a digest of the row), at most one row a block."""
    spark = rows.sparkSession
    keep = [c for c in rows.columns if c != "__text"]
    key = F.sha2(F.concat(*[F.coalesce(F.concat(F.lit("+"), F.to_json(F.struct(F.col(f"`{c}`")))), F.lit("-")) for c in rows.columns]), 256)
    rows = rows.withColumn("__key", key)
    hits = None
    for k, items in enumerate(blocks):
        block = spark.sparkContext.broadcast(Block(items))

        def run(batches, block=block, k=k):
            for batch in batches:
                out = [(key, n, list(map(int, s)), list(map(int, e)), list(i)) for key, (n, s, e, i) in zip(batch.column(0).to_pylist(), _scan(batch.column(1), block.value)) if k == 0 or len(i)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())])], names=["__key", "n", "s", "e", "i"])

        part = rows.select("__key", "__text").mapInArrow(run, "__key string, n long, s array<long>, e array<long>, i array<string>")
        part = store.put(part.dropDuplicates(["__key"]), "hits")
        block.destroy()
        hits = part if hits is None else hits.unionByName(part)

    def merge(pdf):
        spans = [(a, b) for s, e in zip(pdf.s, pdf.e) for a, b in zip(s, e)]
        n, hit, items, sha, bad = _result(int(pdf.n.iloc[0]), *map(np.array, _union(spans)), [x for i in pdf.i for x in i])
        return type(pdf)({"__key": [pdf["__key"].iloc[0]], "__n_words": [n], "__n_hit": [hit], "__n_items": [items], "__items_sha256": [sha], "__contaminated": [bad]})

    merged = hits.groupBy("__key").applyInPandas(merge, ", ".join(["__key string", *(f"__{x}" for x in SCHEMA.split(", "))]))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return rows.drop("__text").join(merged, "__key").select(*[F.col(f"`{c}`") for c in keep], *[F.col("__" + x).alias(prefix + x) for x in names])


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(store.table(spark, sf_dir, "documents"), store.table(spark, sf_dir, "benchmark"), keep=["doc_id"])


QUERIES = {"op10_benchmark_decontamination": op10_benchmark_decontamination}
ORACLE_SQL: dict[str, str] = {}
