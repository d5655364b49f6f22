import numpy as np
from pyspark.sql import functions as F

from riskloom.operators import extra_trees as et


def plain(x, y, trees, depth, least, tried, seed):
    """One tree after the other, node by node, over rows in memory."""
    size = x.shape[1]
    out = et.Forest(size, *([np.full(1 << (depth + 1), v, k) for _ in range(trees)] for v, k in ((-1, np.int32), (0.0, np.float64), (0.0, np.float64))))

    def grow(t, node, rows):
        out.share[t][node] = y[rows].mean()
        if node.bit_length() > depth or len(rows) < least or y[rows].min() == y[rows].max():
            return
        features, along = et.drawn(seed, t, node, size, tried)
        best = None
        for f, u in zip(features, along):
            v = x[rows, f]
            cut = v.min() + u * (v.max() - v.min())
            left = v <= cut
            if v.min() < v.max() and 0 < left.sum() < len(rows):
                impurity = sum(len(s) * 2 * s.mean() * (1 - s.mean()) for s in (y[rows][left], y[rows][~left]))
                if best is None or impurity < best[0] - 1e-9:
                    best = impurity, f, cut, left
        if best:
            out.feature[t][node], out.cut[t][node] = best[1], best[2]
            grow(t, 2 * node, rows[best[3]])
            grow(t, 2 * node + 1, rows[~best[3]])

    for t in range(trees):
        grow(t, 1, np.arange(len(x)))
    return out


def table(spark, x, y, parts=3):
    return spark.createDataFrame([(i, v.tolist(), int(w)) for i, (v, w) in enumerate(zip(x, y))], "i int, x array<double>, y int").repartition(parts)


def test_trees_against_plain_ones_however_the_table_is_cut(spark):
    r = np.random.default_rng(1)
    x = np.column_stack([r.normal(0, 1, (400, 4)), r.integers(0, 3, 400), np.ones(400)])
    y = ((x[:, 0] * x[:, 1] > 0) ^ (r.random(400) < 0.05)).astype(int)
    want = plain(x, y, 4, 5, 5, 3, 7)
    for parts in (1, 5):
        got = et.fit(table(spark, x, y, parts), "x", "y", 6, trees=4, depth=5, tried=3, seed=7)
        for t in range(4):
            assert (got.feature[t] == want.feature[t]).all() and np.allclose(got.cut[t], want.cut[t]) and np.allclose(got.share[t], want.share[t])


def test_trees_learn_what_no_line_tells(spark):
    r = np.random.default_rng(2)
    x = r.normal(0, 1, (1200, 5))
    y = (x[:, 0] ** 2 + x[:, 1] ** 2 > 1.4).astype(int)
    forest = et.fit(table(spark, x[:800], y[:800]).cache(), "x", "y", 5, trees=20, depth=7, tried=4)
    scored = table(spark, x[800:], y[800:]).select("y", et.score(forest, F.col("x")).alias("p")).toPandas()
    ranks = scored.p.rank()
    ones = scored.y.sum()
    auc = (ranks[scored.y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(scored) - ones))
    assert auc > 0.93


def test_awkward_rows(spark):
    rows = spark.createDataFrame([([1.0, None], 1), ([float("nan"), 2.0], 0), (None, 1), ([1.0], 0), ([3.0, float("inf")], None), ([0.0, 0.0], 0)], "x array<double>, y int")
    forest = et.fit(rows, "x", "y", 2, trees=3, depth=2, least=1)
    got = [r["p"] for r in rows.select(et.score(forest, F.col("x")).alias("p")).collect()]
    assert [p is None for p in got] == [False, False, True, True, False, False]
    one = et.fit(rows.where("y = 1"), "x", "y", 2, trees=2)
    assert {r["p"] for r in rows.where("size(x) = 2").select(et.score(one, F.col("x")).alias("p")).collect()} == {1.0}
    none = et.fit(rows.limit(0), "x", "y", 2, trees=2)
    assert rows.limit(0).select(et.score(none, F.col("x"))).count() == 0 and none.probability(np.zeros((2, 2))).tolist() == [0.0, 0.0]
