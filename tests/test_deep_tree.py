"""Deep trees against Spark's own, whatever is grown over the cluster or in a task."""

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from valuescout.operators import deep_tree, pricing


@pytest.fixture(scope="module")
def prepared(spark):
    draw = np.random.default_rng(5)
    rows = []
    for i in range(3000):
        a, b, room = int(draw.integers(12)), float(draw.normal()), "abcde"[int(draw.integers(5))]
        price = float(np.exp(a / 5 + (b > 0.3) * (room in "bd") + draw.normal() / 9))
        rows.append((i, float(a), b, room, price, float(np.log(price)), int(i % 3 == 0)))
    names = "id int, a double, b double, room string, price_clean double, log_price double, in_test_set int"
    return spark.createDataFrame(rows, names).repartition(3).persist()


def errors(df):
    pairs = RegressionEvaluator(labelCol="log_price", predictionCol="predicted_log_price", metricName="rmse")
    return [pairs.evaluate(df.filter(F.col("in_test_set") == side)) for side in (0, 1)]


@pytest.mark.parametrize("depth,min_leaf", [(3, 1), (30, 1)])
def test_equals_the_dense_tree(prepared, depth, min_leaf):
    model = pricing.fair_price_fit(prepared, ["a", "b"], ["room"], max_depth=depth, min_leaf=min_leaf)
    dense = pricing.fair_price_score(model, prepared)
    found = []
    for node_rows in (10**6, 150, 1 if depth == 3 else 700):
        got = pricing.deep_tree_scores(prepared, ["a", "b"], ["room"], depth, min_leaf, node_rows=node_rows).persist()
        leaves = got.agg(F.sum("_leaves")).first()[0]
        rows = got.filter("in_test_set is not null")
        assert rows.count() == 3000
        assert leaves == pytest.approx(pricing.tree_size(model)["leaves"], rel=0.02 if depth == 30 else 0)
        assert errors(rows) == pytest.approx(errors(dense), rel=0.02 if depth == 30 else 1e-6, abs=1e-6)
        found.append((leaves, *sorted(tuple(r) for r in rows.select("log_price", "in_test_set", "predicted_log_price").collect())))
    # the same tree, whatever part of it is grown in tasks
    assert found[0][0] == found[1][0] == found[2][0]
    np.testing.assert_allclose(np.array(found[0][1:]), np.array(found[1][1:]))
    np.testing.assert_allclose(np.array(found[0][1:]), np.array(found[2][1:]))


def test_cuts(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"), (F.col("id") % 3).cast("double").alias("w"), F.lit(1.0).alias("same"))
    cuts = deep_tree.thresholds(df, ["v", "w", "same"], 8)
    assert len(cuts[0]) == 7 and cuts[1:] == [[0.5, 1.5], []]
    got = deep_tree.binned(df, ["v", "w", "same"], cuts).groupBy("_x0").count().collect()
    assert all(120 <= r["count"] <= 130 for r in got) and len(got) == 8
    on_cut = deep_tree.binned(spark.createDataFrame([(0.5,), (0.4,), (0.6,), (2.0,)], "w double"), ["w"], [[0.5, 1.5]])
    assert [r["_x0"] for r in on_cut.collect()] == [0, 0, 1, 2]


def test_the_report_grows_deep_trees_in_tasks(spark, prepared, monkeypatch):
    """Spark's tree of 30 levels is not called: it counts all bins of all nodes."""
    depths = []
    fit = pricing.fair_price_fit
    monkeypatch.setattr(pricing, "fair_price_fit", lambda *a, **k: depths.append(k["max_depth"]) or fit(*a, **k))
    found = pricing.overfit_report(prepared, ["a", "b"], ["room"], [("small", 5, 20), ("deep", 30, 1)]).collect()
    assert depths == [5] and {(r["tree"], r["split"]) for r in found} == {(t, s) for t in ("small", "deep") for s in ("train", "test", "all")}
    assert {r["n"] for r in found if r["split"] == "all"} == {3000}


def test_levels_leave_no_joins_behind(prepared):
    """Twenty levels over the cluster: the rows meet one small table, that of the means."""
    got = pricing.deep_tree_scores(prepared, ["a", "b"], ["room"], 30, 1, node_rows=20)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 1


def test_nodes_of_a_level_are_counted_in_parts(prepared, monkeypatch):
    """The same tree, whether a task holds the counters of all nodes or of one."""
    found = []
    for cells in (deep_tree.MAX_CELLS, 1):
        monkeypatch.setattr(deep_tree, "MAX_CELLS", cells)
        got = pricing.deep_tree_scores(prepared, ["a", "b"], ["room"], 6, 1, node_rows=500)
        found.append(sorted(tuple(r) for r in got.select("log_price", "predicted_log_price", "_leaves").filter("log_price is not null").collect()))
    assert found[0] == found[1] and len(found[0]) == 3000


def test_metrics_go_through_the_predictions_once(spark, prepared):
    scored = prepared.withColumn("predicted_log_price", F.lit(1.0)).withColumn("predicted_price", F.exp(F.lit(1.0)))
    metrics = pricing.price_metrics(scored)
    assert "scalar-subquery" not in metrics._jdf.queryExecution().analyzed().toString()
    got = {r["split"]: r for r in metrics.collect()}
    assert got["all"]["gap_to_all"] == 0.0 and got["all"]["n"] == 3000
    assert got["test"]["gap_to_all"] == pytest.approx(got["test"]["rmse_log"] - got["all"]["rmse_log"])


def test_levels_are_learnt_from_each_once(spark, prepared):
    """How often a level occurs does not matter; that of one test row counts."""
    rare = prepared.limit(1).withColumn("room", F.lit("z")).withColumn("in_test_set", F.lit(1))
    both = prepared.unionByName(rare)
    model = pricing.fair_price_fit(both, ["a", "b"], ["room"], max_depth=3, min_leaf=1)
    assert list(model.stages[0].labelsArray[0]) == list("zedcba")
    assert model.transform(both).count() == 3001
