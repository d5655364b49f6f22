"""Centroid clustering by ball k-means, in integers, so that every run and every split of the table gives the same clusters.

A cluster is a ball: its centroid and a radius no member lies beyond.  A centroid further than twice the radius from another one can
take none of that ball's members, so only the others are its neighbours.  Ordered by distance, half of a neighbour's distance bounds a
shell: members nearer than the first half are the stable core and stay, those of the i-th annulus are compared with the first i
neighbours, exactly.  A ball whose own centroid and neighbours did not move is left as it is.  Each round reads the rows once without a
shuffle; a task returns one sum a cluster, and only centroids, radii and sums, bounded by k, reach the driver.

Defined results: vectors that are null, of another length, or hold a null or non-finite component belong to no cluster and give no row;
components go to floor(64 x), held within 2**26 on either side so that distances fit 64 bits; fewer vectors than k give as many
clusters as vectors; rows of one id are vectors of their own; a null id starts no centroid unless ids run out; ties go to the lower
number; repeated rows get one cluster; an empty table gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

SIZE, SCALE, K, ROUNDS, SEED, MOST = 64, 64, 16, 3, 1, 1 << 26
_STATE = "vec_id {kind}, x array<int>, cluster int, distance long, compared int"


def grid(v: Column, size: int = SIZE, scale: int = SCALE) -> Column:
    """The vector in whole steps; null if it isn't one."""
    good = (F.size(v) == size) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    step = lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(MOST)), F.lit(-MOST)).cast("int")
    return F.when(good, F.transform(v, step))


@dataclass
class Balls:
    """Centroids, and for each ball its neighbours in order, their squared distances, and whether nothing near it has moved."""

    centres: np.ndarray
    near: list[np.ndarray]
    gaps: list[np.ndarray]
    fixed: np.ndarray

    @classmethod
    def around(cls, centres: np.ndarray, before: np.ndarray | None = None, farthest: np.ndarray | None = None) -> Balls:
        """before: the centroids that members were last measured from; farthest: the largest squared distance then (-1: no member)."""
        k = len(centres)
        gaps = ((centres[:, None] - centres[None]) ** 2).sum(2)
        moved = np.zeros(k) if before is None else np.sqrt(((centres - before) ** 2).sum(1).astype(float))
        radius = np.full(k, np.inf) if farthest is None else np.where(farthest < 0, 0, np.sqrt(np.maximum(farthest, 0).astype(float)) + moved)
        near, between = [], []
        for j in range(k):
            order = np.lexsort((np.arange(k), gaps[j]))
            order = order[order != j]
            reach = order[np.sqrt(gaps[j, order].astype(float)) <= 2 * radius[j] * (1 + 1e-9) + 1e-9]  # rounded outwards
            near.append(reach)
            between.append(gaps[j, reach])
        still = moved == 0
        fixed = np.array([farthest is not None and still[j] and bool(still[near[j]].all()) for j in range(k)])
        return cls(centres, near, between, fixed)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid of rows that are in no ball yet."""
        best, far = np.zeros(len(x), np.int32), ((x - self.centres[0]) ** 2).sum(1)
        for j in range(1, len(self.centres)):
            d = ((x - self.centres[j]) ** 2).sum(1)
            best[d < far] = j
            far = np.minimum(far, d)
        return best, far, np.full(len(x), len(self.centres), np.int32)

    def again(self, x: np.ndarray, was: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid of rows that were in the balls ``was``, their distances, and how many distances that took."""
        best, far, compared = was.copy(), distance.copy(), np.zeros(len(x), np.int32)
        for j in np.unique(was):
            if self.fixed[j]:
                continue
            rows = np.flatnonzero(was == j)
            own = ((x[rows] - self.centres[j]) ** 2).sum(1)
            far[rows] = own
            shell = np.searchsorted(self.gaps[j], 4 * own, "right")  # neighbours at twice the distance at most; 0: stable core
            compared[rows] = 1 + shell
            for i, other in enumerate(self.near[j]):
                out = rows[shell > i]
                if not len(out):
                    break
                d = ((x[out] - self.centres[other]) ** 2).sum(1)
                closer = (d < far[out]) | ((d == far[out]) & (other < best[out]))
                best[out[closer]], far[out[closer]] = other, d[closer]
        return best, far, compared


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def assign(state: DataFrame, balls: Balls, id_type: str) -> DataFrame:
    """The rows with their nearest centroid; rows that carry a cluster are taken from that ball."""
    again = "cluster" in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            found = balls.again(x, batch.column(2).to_numpy(), batch.column(3).to_numpy()) if again else balls.first(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found[0], pa.int32()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int32())], names=["vec_id", "x", "cluster", "distance", "compared"])

    return state.select("vec_id", "x", *(["cluster", "distance"] if again else [])).mapInArrow(run, _STATE.format(kind=id_type))


def sums(state: DataFrame, k: int, size: int) -> dict[str, np.ndarray]:
    """For each cluster: rows, their componentwise sum, largest and summed distance; one row a cluster and task is added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, most, inertia, compared = np.zeros(k, np.int64), np.zeros((k, size), np.int64), np.full(k, -1, np.int64), [0] * k, np.zeros(k, np.int64)
        for batch in batches:
            x, own, far, took = _matrix(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for j in np.unique(own):
                rows = own == j
                count[j] += rows.sum()
                total[j] += x[rows].sum(0)
                most[j] = max(most[j], far[rows].max())
                inertia[j] += sum(far[rows].tolist())
                compared[j] += took[rows].sum()
        some = np.flatnonzero(count)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(count[some]), pa.array(most[some]), pa.array([str(inertia[j]) for j in some]), pa.array(compared[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "most", "inertia", "compared", "total"])

    parts = state.select("x", "cluster", "distance", "compared").mapInArrow(run, "cluster long, n long, most long, inertia string, compared long, total array<long>")
    parts = parts.select("cluster", "n", "most", F.col("inertia").cast("decimal(38,0)").alias("inertia"), "compared", "total")
    added = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(size)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.sum("inertia").alias("inertia"), F.sum("compared").alias("compared"), *added).collect()  # at most k rows
    out = {"n": np.zeros(k, np.int64), "most": np.full(k, -1, np.int64), "inertia": np.zeros(k, object), "compared": np.zeros(k, np.int64), "total": np.zeros((k, size), np.int64)}
    for r in rows:
        j = r["cluster"]
        out["n"][j], out["most"][j], out["inertia"][j], out["compared"][j] = r["n"], r["most"], int(r["inertia"]), r["compared"]
        out["total"][j] = [r[f"t{i}"] for i in range(size)]
    return out


def start(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the least hashes, in that order (rows of one id: by their components); a top-k, no sort of all."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(key.asc_nulls_last(), "x").limit(k).select("x").collect()
    return np.array([r["x"] for r in rows], np.int64)


def cluster(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE, scale: int = SCALE, history: list | None = None) -> tuple[DataFrame, np.ndarray, dict[str, np.ndarray]]:
    """The rows' ids with cluster and squared distance, the centroids, and each cluster's sums.

    history: a list that gets, a round, the rows and how many distances they took.
    """
    kind = dict(rows.dtypes)[id_col]
    v = F.col(f"`{vector_col}`")
    vectors = store.put(rows.select(F.col(f"`{id_col}`").alias("vec_id"), grid(v, size, scale).alias("x")).where(F.col("x").isNotNull()), "vectors")
    centres = start(vectors, k, seed)
    if not len(centres):
        none = vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return none, centres.reshape(0, size), {"n": np.zeros(0, np.int64), "inertia": np.zeros(0, object)}
    k, balls, state = len(centres), Balls.around(centres), vectors
    for step in range(rounds + 1):
        state, last = store.put(assign(state, balls, kind), "balls"), state
        store.drop(last)
        found = sums(state, k, size)
        if history is not None:
            history.append((int(found["n"].sum()), int(found["compared"].sum())))
        if step < rounds:
            new = np.where(found["n"][:, None] > 0, found["total"] // np.maximum(found["n"], 1)[:, None], centres)
            balls, centres = Balls.around(new, centres, found["most"]), new
    return state.select("vec_id", "cluster", "distance"), centres, found


def op12_ball_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, centres, found = cluster(store.table(spark, sf_dir, "embeddings"))
    long = lambda n: n if n < 1 << 63 else None
    whole = long(int(sum(found["inertia"])))
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    about = [(j, long(int(found["inertia"][j])), whole, digest(centres[j])) for j in range(len(centres))]
    balls = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return members.join(F.broadcast(balls), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = K, rounds: int = ROUNDS) -> str:
    far = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    parts = [
        f"v AS (SELECT vec_id, list_transform(embedding, lambda e: floor(e::DOUBLE * {SCALE})::BIGINT) AS x FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"c0 AS (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || CAST(vec_id AS VARCHAR)), x) - 1)::INT AS cluster, x FROM v ORDER BY cluster LIMIT {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS (SELECT vec_id, x, cluster, d AS distance FROM (SELECT v.vec_id, v.x, c.cluster, {far} AS d, row_number() OVER (PARTITION BY v.vec_id, v.x ORDER BY {far}, c.cluster) AS r FROM v, c{r} c) WHERE r = 1)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT cluster, i, sum(e)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS e, unnest(range({SIZE})) AS i FROM a{r}) GROUP BY cluster, i)")
            parts.append(f"m{r} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{r} GROUP BY cluster)")
            parts.append(f"c{r + 1} AS (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (cluster))")
    last = f"a{rounds}"
    return "WITH " + ", ".join(parts) + f" SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM {last} JOIN c{rounds} c USING (cluster)"


QUERIES = {"op12_ball_clusters": op12_ball_clusters}
ORACLE_SQL = {"op12_ball_clusters": _sql()}
