"""MinHash near-duplicate detection.

Words are ``[^\x20\x09-\x0D]+`` of the text with A-Z lower-cased; a document's set has its distinct SHINGLE-word
shingles (fewer words: the whole sequence).  Documents link when their sets' Jaccard similarity is at least
PERCENT / 100; a group is a connected component of links.

1. One pass over the texts: set size, digest of the set, minima under BANDS * ROWS universal hashes, one key a band.
2. Documents with equal sets become one node, so copies cost nothing further.
3. Nodes of a bucket (band and key) are compared with the bucket's least node: a star, not all pairs.  Signatures are
   compared first, then the full sets.
4. Components of the verified links.  Then, in the buckets that still hold nodes of different components, every pair
   across components is compared too, in blocks of at most BLOCK nodes: signatures within a task, which lists only the
   pairs that pass, then the full sets of those; and components are formed again.  Only pairs already connected stay
   uncompared, so no link between candidates is lost.

At the threshold a pair shares no band with probability (1 - 0.75**4)**28 < 3e-5, and its signature of SIGNATURE minima, 8 bits of
each, falls below LEAST with probability 4e-5; both less above it.  Sets are compared by 48 bits of each shingle's hash.

Defined results: null, empty and blank texts have no shingles, link with nothing and are kept; a row with a null id
has a null component and is kept, and links nothing; rows of equal ids are linked, whatever their texts; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, text
from .components import components

SHINGLE, PERCENT, BANDS, ROWS, SEED = 5, 75, 28, 4, 11
#: Members of a star that one task compares with its head at a time; nodes of one side in a block of a bucket.
STAR, BLOCK = 64, 2048
#: Minima of the signature, and the share of equal ones below which a pair is let go (four standard errors below the threshold).
SIGNATURE, LEAST = 512, 0.675
WIDTH = 6
U = np.uint64


def _sets(batch: pa.RecordBatch, column: int, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct shingle hashes of runs of rows, and where each row's start."""
    b, off = text.raw(batch.column(column))
    for i, j in text.runs(off):
        s, to = text.shingles(*text.words(b[off[i] : off[j]], off[i : j + 1] - off[i], text.BLANK), shingle)
        rows = [np.unique(s[to[r] : to[r + 1]]) for r in range(j - i)]
        yield np.concatenate(rows), np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) for x in rows])])


def _minima(s: np.ndarray, to: np.ndarray, count: int) -> np.ndarray:
    """(rows with shingles, count) least hashes, 32 bits each."""
    a, b = text.seeds(max(SIGNATURE, count), SEED)
    starts = to[:-1][np.diff(to) > 0]
    out = np.empty((len(starts), count), np.uint32)
    if len(starts):
        x = np.empty_like(s)
        for k in range(count):
            np.multiply(s, a[k], out=x)
            x += b[k]
            out[:, k] = np.minimum.reduceat(x, starts) >> U(32)
    return out


def _band_keys(minima: np.ndarray, bands: int) -> np.ndarray:
    m = minima.reshape(len(minima), bands, minima.shape[1] // bands).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * U(0x9E3779B97F4A7C15)
    for k in range(m.shape[2]):
        key = text.mix(key ^ m[:, :, k])
    return key.view(np.int64)


def _pack(s: np.ndarray) -> bytes:
    return s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def _unpack(b: bytes) -> np.ndarray:
    wide = np.zeros((len(b) // WIDTH, 8), np.uint8)
    wide[:, :WIDTH] = np.frombuffer(b, np.uint8).reshape(-1, WIDTH)
    return wide.view(">u8").ravel().astype(np.uint64)


def profile(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n, d1, d2, keys): set size, digest of the set, band keys (empty without shingles)."""

    def run(batches):
        for batch in batches:
            at = 0
            for s, to in _sets(batch, 1, shingle):
                n = np.diff(to)
                keys = np.zeros((len(n), bands), np.int64)
                keys[n > 0] = _band_keys(_minima(s, to, bands * rows), bands)
                marks = np.array([np.frombuffer(hashlib.blake2b(s[to[r] : to[r + 1]].tobytes(), digest_size=16).digest(), np.int64) for r in range(len(n))]).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), pa.array(n), pa.array(marks[:, 0]), pa.array(marks[:, 1]), text.list_column(keys[n > 0].ravel(), np.concatenate([[0], np.cumsum((n > 0) * bands)]))], names=["id", "n", "d1", "d2", "keys"])
                at += len(n)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, d1 long, d2 long, keys array<long>")


def _full(rows: DataFrame, shingle: int, bands: int, each: int) -> DataFrame:
    """(id, text) as (node, keys, sig, shingles): 32 bits of each band key, signature, set."""

    def run(batches):
        for batch in batches:
            at = 0
            for s, to in _sets(batch, 1, shingle):
                n = np.diff(to)
                m = _minima(s, to, max(SIGNATURE, bands * each))
                sig, keys = np.zeros((len(n), SIGNATURE), np.uint8), np.zeros((len(n), bands), np.uint32)
                sig[n > 0] = m[:, :SIGNATURE]
                keys[n > 0] = _band_keys(m[:, : bands * each], bands)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), *(pa.array([x.tobytes() for x in v], pa.binary()) for v in (keys, sig)), pa.array([_pack(s[to[r] : to[r + 1]]) for r in range(len(n))], pa.binary())], names=["node", "keys", "sig", "shingles"])
                at += len(n)

    return rows.mapInArrow(run, "node long, keys binary, sig binary, shingles binary")


def verify(pairs: DataFrame, full: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The (a, b) of pairs whose sets are similar enough.  Each b's set goes to its a's in blocks of STAR."""
    pairs = store.put(pairs, "pairs")
    count = store.put(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("blocks")), "blocks")
    members = pairs.join(count, "b").select(F.col("a").alias("node"), "b", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"))
    sent = members.select("node", "b", "block", F.lit(1).alias("part")).unionByName(count.select(F.col("b").alias("node"), "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("part")))
    sent = store.put(sent, "sent")
    rows = sent.join(full, "node").select("b", "block", "part", "node", "sig", "shingles")
    rows = rows.repartition(store.parts(pairs.sparkSession), "b", "block").sortWithinPartitions("b", "block", "part")

    def run(batches):
        head, sig, own = None, None, None
        for batch in batches:
            out = []
            for b, block, part, node, s, x in zip(*(c.to_pylist() for c in batch.columns)):
                if part == 0:
                    head, sig, own = (b, block), np.frombuffer(s, np.uint8), _unpack(x)
                elif head == (b, block) and (sig == np.frombuffer(s, np.uint8)).mean() >= LEAST:
                    other = _unpack(x)
                    small, large = sorted((own, other), key=len)
                    at = np.searchsorted(large, small)
                    at[at == len(large)] = 0
                    both = int((large[at] == small).sum())
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        out.append((node, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    links = store.put(rows.mapInArrow(run, "a long, b long").distinct(), "links")
    store.drop(pairs, count, sent)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, component_id, kept), a row for each row of docs."""
    first = store.put(profile(docs, id_col, text_col, shingle, bands, rows), "profile")
    sets = F.struct("d1", "d2")
    several = first.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(sets).alias("x"), F.max(sets).alias("y")).where(F.col("x") < F.col("y"))
    if not several.isEmpty():
        store.drop(first)
        return _by_rows(docs, id_col, text_col, shingle, percent, bands, rows)
    least = store.put(first.where(F.col("n") > 0).groupBy("d1", "d2").agg(F.min("id").alias("node")), "least")
    nodes = first.join(least, ["d1", "d2"], "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("node", "id")).alias("node"), "keys")
    nodes = store.put(nodes.withColumn("keys", F.when((F.col("id") == F.col("node")) & (F.col("n") > 0), F.col("keys"))), "nodes")
    store.drop(first, least)
    banded = nodes.where(F.col("keys").isNotNull()).select("node", "n", F.explode("keys").alias("key"))
    heads = store.put(banded.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where(F.col("head") < F.col("last")).select("key", "head"), "heads")
    buckets = store.put(banded.join(heads, "key").select("key", "node", "n", "head"), "buckets")
    store.drop(heads)
    seen = store.put(buckets.select("node").distinct(), "seen")
    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(seen, F.col("id") == F.col("node"), "left_semi")
    full = store.put(_full(wanted, shingle, bands, rows), "full")
    store.drop(seen)

    links = verify(buckets.where(F.col("node") != F.col("head")).select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), full, percent)
    groups = store.put(components(links, "a", "b"), "groups")
    more = verify(_across(buckets, groups, full, percent), full, percent)
    if not more.isEmpty():
        groups = store.put(components(links.unionByName(more), "a", "b"), "groups")
    store.drop(full, buckets, links, more)

    out = nodes.select(F.col("id"), F.col("n").alias("n_shingles"), "node").join(groups, "node", "left")
    return out.select("id", "n_shingles", F.coalesce("component", "node").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("component", "node"), F.lit(True)).alias("kept"))


def _by_rows(docs: DataFrame, id_col: str, text_col: str, *settings: int) -> DataFrame:
    """The same where rows of equal id have different texts: rows are compared under numbers of their own (fixed by being written),
    and then rows of one id count as linked."""
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    own = store.put(own, "rows")
    got = store.put(near_duplicates(own, "row", "text", *settings).select(F.col("id").alias("row"), "n_shingles", F.col("component_id").alias("near")), "by-row")
    ids = own.select("row", "id")
    firsts = ids.groupBy("id").agg(F.min("row").alias("first"))
    edges = got.select(F.col("row").alias("a"), F.col("near").alias("b")).unionByName(ids.join(firsts, "id").select(F.col("row").alias("a"), F.col("first").alias("b")))
    linked = components(edges, "a", "b").withColumnRenamed("node", "row")
    of = store.put(got.join(ids, "row").join(linked, "row", "left").select("id", "n_shingles", F.coalesce("component", "row").alias("c")), "linked")
    out = of.join(of.groupBy("c").agg(F.min("id").alias("component_id")), "c").select("id", "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    rest = profile(docs.where(F.col(id_col).isNull()), id_col, text_col, *settings[:1], *settings[2:])
    store.drop(own)
    return out.unionByName(rest.select("id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))


def _across(buckets: DataFrame, groups: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a bucket, in different components, whose sizes and signatures allow the similarity.

    In each bucket the nodes outside its head's component (the few) meet all its nodes, block by block.  Of the buckets
    that a pair shares, only the first band's compares it.
    """
    own = store.put(buckets.join(groups, "node", "left").select("key", "node", "n", "head", F.coalesce("component", "node").alias("c")), "own")
    main = own.where(F.col("node") == F.col("head")).select("key", F.col("c").alias("main")).distinct()
    mixed = store.put(own.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where(F.col("x") < F.col("y")).select("key").join(main, "key"), "mixed")
    rows = store.put(own.join(mixed, "key").select("key", "node", "n", "c", (F.col("c") != F.col("main")).alias("few")), "mixed-rows")
    blocks = lambda x: F.ceil(F.count(x) / BLOCK).cast("int")
    size = store.put(rows.groupBy("key").agg(blocks(F.lit(1)).alias("mb"), blocks(F.when(F.col("few"), 1)).alias("fb")), "sizes")
    sized = rows.join(size, "key")
    mine = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    # in a bucket of one block its nodes are sent once and serve as both sides
    few = sized.where(F.col("few") & ((F.col("fb") > 1) | (F.col("mb") > 1))).select("key", "node", "n", "c", F.lit(0).alias("part"), mine("fb").alias("f"), all_of("mb").alias("m"))
    many = sized.select("key", "node", "n", "c", F.lit(1).alias("part"), all_of("fb").alias("f"), mine("mb").alias("m"), "few")
    dealt = store.put(few.withColumn("few", F.lit(True)).unionByName(many), "dealt")
    with_sig = dealt.join(full.select("node", "keys", "sig"), "node").select("key", "f", "m", "part", "node", "n", "c", "few", "keys", "sig")
    with_sig = with_sig.repartition(store.parts(buckets.sparkSession), "key", "f", "m").sortWithinPartitions("key", "f", "m", "part")

    def compare(key, left, right):
        def columns(rows):
            node, n, c, few = (np.array([r[k] for r in rows]) for k in range(4, 8))
            return node, n, c, few, np.frombuffer(b"".join(r[8] for r in rows), np.uint32).reshape(len(rows), -1), np.frombuffer(b"".join(r[9] for r in rows), np.uint8).reshape(len(rows), -1)

        node, n, c, few, keys, sig = columns(right)
        for a, na, ca, _, ka, sa in zip(*columns(left)):
            band = int(np.flatnonzero(ka == np.uint32(key & 0xFFFFFFFF))[0])
            ok = (c != ca) & (n * 100 >= na * percent) & (na * 100 >= n * percent) & (~few | (node > a))
            at = np.flatnonzero(ok)
            at = at[~(keys[at, :band] == ka[:band]).any(1)]
            at = at[(sig[at] == sa).mean(1) >= LEAST]
            yield from ((int(a), int(b)) for b in node[at])

    def run(batches):
        group, left, right = None, [], []

        def finish():
            own = left or [r for r in right if r[7]]
            if own and right:
                yield from compare(group[0], own, right)

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != group:
                    out += finish()
                    group, left, right = row[:3], [], []
                (right if row[3] else left).append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])
        if out := list(finish()):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])

    pairs = store.put(with_sig.mapInArrow(run, "a long, b long").distinct(), "across")
    store.drop(own, mixed, rows, size, dealt)
    return pairs


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(store.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op7_near_dedup": op7_near_dedup}
ORACLE_SQL: dict[str, str] = {}
