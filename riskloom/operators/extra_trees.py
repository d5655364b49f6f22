"""K6: extremely randomised trees, grown level by level over the whole table.

A node draws a few features and, for each, a cut anywhere between its rows' least and greatest value; the cut that leaves the classes purest
is taken.  All trees grow together: each level is one pass that finds the drawn features' bounds in all open nodes and one that counts classes on
both sides of all cuts.  Tasks send sums of nodes, so what reaches the driver is bounded by the model (trees, nodes of a level, features drawn),
whatever the table, and nothing is shuffled but those sums.

Draws depend on the seed, the tree and the node only, bounds and counts on no order, so a fit is the same however the table is cut.

Defined results: null and non-finite features count as 0; rows with a null label aren't learnt from; one class alone, or no row, gives trees of one leaf
(without rows: probability 0); a table without rows gives an empty result; a column named like the result gives way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TREES, DEPTH, LEAST, SEED = 30, 8, 5, 42


def _features(column: pa.Array, size: int) -> np.ndarray:
    x = column.flatten().fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return np.where(np.isfinite(x), x, 0.0)


def drawn(seed: int, tree: int, node: int, size: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The features that a node tries, and how far along its bounds it cuts each."""
    r = np.random.Generator(np.random.PCG64([seed, tree, node]))
    return r.permutation(size)[:most], r.random(most)


@dataclass
class Forest:
    """Trees as arrays by node, numbered as in a heap from 1: the feature (-1: a leaf) and the cut, and the share of ones among a leaf's rows."""

    size: int
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    share: list[np.ndarray] = field(default_factory=list)

    def nodes(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The node of each row as far as the tree has grown."""
        at = np.ones(len(x), np.int64)
        while True:
            f = self.feature[tree][at]
            inner = f >= 0
            if not inner.any():
                return at
            right = x[np.arange(len(x)), np.maximum(f, 0)] > self.cut[tree][at]
            at = np.where(inner, 2 * at + right, at)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.mean([self.share[t][self.nodes(x, t)] for t in range(len(self.feature))], 0) if self.feature else np.zeros(len(x))


def _gini(ones: np.ndarray, n: np.ndarray) -> np.ndarray:
    p = ones / np.maximum(n, 1)
    return n * 2 * p * (1 - p)


def _decide(forest: Forest, tree: int, node: int, features: np.ndarray, cuts: np.ndarray, valid: np.ndarray, left: np.ndarray, ones_left: np.ndarray, n: int, ones: int) -> bool:
    """Takes the purest valid cut; False if there is none."""
    valid = valid & (left > 0) & (left < n)
    if not valid.any():
        return False
    impurity = np.where(valid, _gini(ones_left, left) + _gini(ones - ones_left, n - left), np.inf)
    k = int(impurity.argmin())
    forest.feature[tree][node], forest.cut[tree][node] = features[k], cuts[k]
    return True


def fit(rows: DataFrame, vector: str, label: str, size: int, trees: int = TREES, depth: int = DEPTH, least: int = LEAST, tried: int | None = None, seed: int = SEED) -> Forest:
    """Of rows with an array of ``size`` features and a label of 0 or 1; nodes of under ``least`` rows aren't cut.  The rows are read once for each pass, so cache them."""
    tried = min(size, tried or max(1, int(np.sqrt(size))))
    known = rows.where(F.col(label).isNotNull() & (F.size(vector) == size)).select(F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"))
    forest = Forest(size, *([np.full(1 << (depth + 1), v, kind) for _ in range(trees)] for v, kind in ((-1, np.int32), (0.0, np.float64), (0.0, np.float64))))
    open_ = {(t, 1) for t in range(trees)}
    for level in range(depth + 1):
        draws = {k: drawn(seed, *k, size, tried) for k in open_}
        by_tree: dict[int, list[int]] = {}
        for t, node in sorted(open_):
            by_tree.setdefault(t, []).append(node)

        def parts(x: np.ndarray, by_tree=by_tree, draws=draws):
            """Of each tree: which rows are in open nodes, the place of each one's node, and the values of its drawn features."""
            for t, nodes in by_tree.items():
                at = forest.nodes(x, t)
                place = np.searchsorted(nodes, at)
                here = np.flatnonzero((place < len(nodes)) & (np.array(nodes)[np.minimum(place, len(nodes) - 1)] == at))
                features = np.array([draws[t, n][0] for n in nodes])
                yield t, nodes, here, place[here], x[here[:, None], features[place[here]]]

        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], list] = {}
            for batch in batches:
                x, y = _features(batch.column(0), size), batch.column(1).to_numpy()
                for t, nodes, here, place, values in parts(x):
                    order = np.argsort(place, kind="stable")
                    start = np.flatnonzero(np.append(True, np.diff(place[order]) > 0)) if len(order) else []
                    if not len(order):
                        continue
                    lo, hi, n = np.minimum.reduceat(values[order], start), np.maximum.reduceat(values[order], start), np.diff(np.append(start, len(order)))
                    ones = np.add.reduceat(y[here][order], start)
                    for k, s in enumerate(start):
                        old = held.setdefault((t, nodes[place[order[s]]]), [0, 0, lo[k], hi[k]])
                        old[0], old[1], old[2], old[3] = old[0] + int(n[k]), old[1] + int(ones[k]), np.minimum(old[2], lo[k]), np.maximum(old[3], hi[k])
            if held:
                yield pa.RecordBatch.from_pydict({"t": [k[0] for k in held], "node": [k[1] for k in held], "n": [v[0] for v in held.values()], "ones": [v[1] for v in held.values()], "lo": [v[2].tolist() for v in held.values()], "hi": [v[3].tolist() for v in held.values()]})

        sums = [F.min(F.col("lo")[k]).alias(f"lo{k}") for k in range(tried)] + [F.max(F.col("hi")[k]).alias(f"hi{k}") for k in range(tried)]
        found = known.mapInArrow(bounds, "t long, node long, n long, ones long, lo array<double>, hi array<double>").groupBy("t", "node").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"), *sums).collect()  # a row for each open node
        cuts: dict[tuple[int, int], tuple] = {}
        for r in found:
            key = r["t"], r["node"]
            forest.share[key[0]][key[1]] = r["ones"] / r["n"]
            lo, hi = (np.array([r[f"{c}{k}"] for k in range(tried)]) for c in ("lo", "hi"))
            if level < depth and r["n"] >= least and 0 < r["ones"] < r["n"] and (hi > lo).any():
                cuts[key] = (draws[key][0], lo + draws[key][1] * (hi - lo), hi > lo, r["n"], r["ones"])
        if not cuts:
            break
        by_tree = {}
        for t, node in sorted(cuts):
            by_tree.setdefault(t, []).append(node)

        def sides(batches: Iterator[pa.RecordBatch], by_tree=by_tree) -> Iterator[pa.RecordBatch]:
            held = {t: np.zeros((len(nodes), tried, 2), np.int64) for t, nodes in by_tree.items()}
            for batch in batches:
                x, y = _features(batch.column(0), size), batch.column(1).to_numpy()
                for t, nodes, here, place, values in parts(x, by_tree):
                    left = values <= np.array([cuts[t, n][1] for n in nodes])[place]
                    np.add.at(held[t][:, :, 0], place, left)
                    np.add.at(held[t][:, :, 1], place, left & (y[here] == 1)[:, None])
            out = [(t, n, held[t][k, :, 0].tolist(), held[t][k, :, 1].tolist()) for t, nodes in by_tree.items() for k, n in enumerate(nodes) if held[t][k].any()]
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(("t", "node", "l", "o"), map(list, zip(*out)))))

        sums = [F.sum(F.col("l")[k]).alias(f"l{k}") for k in range(tried)] + [F.sum(F.col("o")[k]).alias(f"o{k}") for k in range(tried)]
        counted = known.mapInArrow(sides, "t long, node long, l array<long>, o array<long>").groupBy("t", "node").agg(*sums).collect()
        open_ = set()
        for r in counted:
            key = r["t"], r["node"]
            features, at, valid, n, ones = cuts[key]
            left, ones_left = (np.array([r[f"{c}{k}"] for k in range(tried)]) for c in "lo")
            if _decide(forest, *key, features, at, valid, left, ones_left, n, ones):
                open_ |= {(key[0], 2 * key[1]), (key[0], 2 * key[1] + 1)}
        if not open_:
            break
    return forest


def score(forest: Forest, vector: Column) -> Column:
    """Probability of label 1, in Arrow batches; null for vectors of another size."""
    size = forest.size

    def run(column: pa.Array) -> pa.Array:
        good = np.array([n == size for n in column.value_lengths().to_pylist()], bool)
        out = np.full(len(column), np.nan)
        if good.any():
            out[good] = forest.probability(_features(column.filter(pa.array(good)), size))
        return pa.array(out, mask=~good)

    return F.arrow_udf(run, "double")(vector.cast("array<double>"))
