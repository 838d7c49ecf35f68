"""Exact trees against numpy, a stock tree and known structure."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from valuescout.operators import exact_tree as et


def frame(spark, x, y):
    names = [f"x{i}" for i in range(x.shape[1])]
    rows = [(i, float(t), *map(float, v)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ", ".join(["id int", "y double", *(f"{n} double" for n in names)])), names


def plain(x, y, depth, min_leaf, number=1):
    """{node: (n, feature, threshold)} by trying every split."""
    best = (0.0,)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values, values[1:]):
            left = x[:, f] <= a
            n, m = left.sum(), (~left).sum()
            if min(n, m) >= min_leaf:
                gain = n * m / len(y) * (y[left].mean() - y[~left].mean()) ** 2
                if round(gain, 6) > round(best[0], 6):
                    best = gain, f, (a + b) / 2
    if depth == 0 or len(best) == 1:
        return {number: (len(y), None, None)}
    _, f, t = best
    low = x[:, f] <= t
    out = {number: (len(y), f, t)}
    out |= plain(x[low], y[low], depth - 1, min_leaf, 2 * number)
    return out | plain(x[~low], y[~low], depth - 1, min_leaf, 2 * number + 1)


@pytest.mark.parametrize("seed,depth,min_leaf", [(0, 1, 1), (1, 3, 5), (2, 5, 20), (3, 4, 1)])
def test_equals_trying_every_split(spark, seed, depth, min_leaf):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=300), rng.integers(0, 4, 300), -np.exp(rng.normal(size=300) * 9), rng.integers(0, 2, 300)])
    y = np.round(2 * (x[:, 0] > 0.3) + x[:, 1] * (x[:, 2] < -1) + rng.normal(size=300) / 4, 6)
    df, names = frame(spark, x, y)
    tree = et.grow(df.repartition(5), "y", names, depth, min_leaf)
    assert {n.number: (n.n, n.feature, n.threshold) for n in tree.nodes} == plain(x, y, depth, min_leaf)
    found = {r["id"]: r for r in et.predict(df, tree).collect()}
    for n in tree.nodes:
        if n.feature is None:
            mine = [r["id"] for r in found.values() if r["node"] == n.number]
            assert len(mine) == n.n and found[mine[0]]["prediction"] == pytest.approx(y[mine].mean())


def test_equals_the_stock_tree_where_that_has_a_bin_per_value(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 40, (2000, 3)).astype(float)
    y = np.round(np.sin(x[:, 0] / 5) * 3 + (x[:, 1] > 20) * x[:, 2] / 10 + rng.normal(size=2000) / 10, 6)
    df, names = frame(spark, x, y)
    tree = et.grow(df, "y", names, 4, 20)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    stock = DecisionTreeRegressor(labelCol="y", maxDepth=4, minInstancesPerNode=20, maxBins=64).fit(vectors)
    both = stock.transform(vectors).select("id", F.col("prediction").alias("stock")).join(et.predict(df, tree), "id")
    assert both.filter(F.abs(F.col("stock") - F.col("prediction")) > 1e-6).count() == 0
    assert tree.leaves == (stock.numNodes + 1) // 2
    ours, theirs = tree.importances(), stock.featureImportances.toArray()
    assert [n for n in names if ours[n] > 0.05] == [n for n, w in zip(names, theirs) if w > 0.05]


def test_grows_until_nothing_is_gained(spark):
    """Deeper than 30 levels, every distinct row in its own leaf."""
    x = np.arange(34, dtype=float)[:, None]
    y = 3.0 ** x[:, 0]
    df, names = frame(spark, x, y)
    tree = et.grow(df, "y", names)
    assert tree.depth > 30
    errors = et.predict(df, tree).select(F.max(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    assert errors < 1e-3


def test_missing_values_ties_and_constant_labels(spark):
    df = spark.createDataFrame(
        [(1.0, 0.0, 0.0), (1.0, 0.0, 0.0), (5.0, 1.0, 1.0), (5.0, 1.0, 1.0), (None, 1.0, 0.0), (2.0, None, 1.0), (3.0, float("nan"), 0.0)],
        "y double, a double, b double")
    tree = et.grow(df, "y", ["a", "b"])
    assert [(n.number, n.n, n.feature, n.threshold) for n in tree.nodes] == [(1, 4, 0, 0.5), (2, 2, None, None), (3, 2, None, None)]
    assert sorted(r["prediction"] for r in et.predict(df, tree).collect()) == [1.0, 1.0, 1.0, 5.0, 5.0, 5.0, 5.0]
    flat = et.grow(df.withColumn("y", F.lit(3.0)), "y", ["a", "b"])
    assert [(n.number, n.feature) for n in flat.nodes] == [(1, None)]
    assert et.grow(df.limit(0), "y", ["a"]).nodes == []


def test_no_task_sorts_all_values(spark):
    """Continuous values: the ranges, and what is sorted in each, stay small."""
    df = spark.range(400_000).select(F.lit(1).alias("_node"), F.array(F.randn(5)).alias("_x"), F.lit(1).cast(et.LABEL).alias("_y"))
    values = df.select(F.explode("_x").alias("v")).select(F.shiftright(et.ordered_code("v"), 64 - et._RANGE_BITS).alias("r"))
    sizes = values.groupBy("r").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] < 100
