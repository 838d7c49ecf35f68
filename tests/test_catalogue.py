import inspect

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from side_by_side import connect, differences

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert differences(spark, con, QUERIES[name], SQL[name], FOLDER) == ""


def test_names():
    assert set(SQL) <= set(QUERIES)
    for query in QUERIES.values():
        assert list(inspect.signature(query).parameters) == ["spark", "sf_dir"]


def test_entry(spark):
    df = driver.entry(spark)
    assert df.count() > 0 and "discount_pct" in df.columns


def test_models(spark):
    tree = {r["split"]: r for r in QUERIES["price_tree"](spark, FOLDER).collect()}
    assert tree["test"]["rmse_log"] < 0.8 and tree["all"]["depth"] <= 8
    baseline = QUERIES["perm_baseline"](spark, FOLDER).collect()
    assert len(baseline) == 4 and all(0 < r["purity_random_baseline"] <= 1 for r in baseline)


def test_registered_models(spark):
    """One statement on each query that has no SQL form."""
    def rows(name):
        return QUERIES[name](spark, FOLDER).collect()

    predictions = rows("price_predictions")
    assert len(predictions) > 50
    assert all(abs(r["price_clean"] - r["predicted_price"] - r["residual"]) < 1e-6 for r in predictions)
    ranked = [r["importance"] for r in rows("importances")]
    assert ranked and all(0 <= x <= 1 for x in ranked) and sum(ranked) <= 1 + 1e-9
    grid = {(r["max_depth"], r["min_leaf"]): r["rmse_log"] for r in rows("price_cv")}
    logs = [r["log_price"] for r in predictions]
    mean = sum(logs) / len(logs)
    spread = (sum((x - mean) ** 2 for x in logs) / len(logs)) ** 0.5
    assert set(grid) == {(d, n) for d in (4, 8) for n in (20, 100)} and all(0 < x < spread for x in grid.values())
    overfit = {(r["tree"], r["split"]): r for r in rows("price_overfit")}
    free, bound = overfit["unconstrained", "train"], overfit["constrained", "train"]
    assert free["leaves"] > 5 * bound["leaves"] and free["rmse_log"] < bound["rmse_log"] / 2
    # what the deeper tree has learnt by heart does not help on new rows
    gaps = {tree: overfit[tree, "test"]["rmse_log"] - overfit[tree, "train"]["rmse_log"] for tree in ("constrained", "unconstrained")}
    assert gaps["unconstrained"] > gaps["constrained"] > 0
    sse = {r["k"]: r["sse"] for r in rows("kmeans_sweep")}
    assert sorted(sse) == list(range(1, 8)) and all(sse[k] >= sse[k + 1] for k in range(1, 7))
    centres = rows("kmeans_centroids")
    assert {(r["k"], r["cluster"]) for r in centres} == {(4, i) for i in range(4)}
    assert len({tuple(r) for r in centres}) == 4
    assert all(-1 <= r["silhouette"] <= 1 for r in rows("silhouette"))
    found, observed = rows("external_validation"), {r["external_variable"]: r for r in rows("external_observed")}
    assert len(found) == len(observed) == 4
    for r in found:
        assert abs(r["purity"] - r["purity_random_baseline"] - r["purity_lift"]) < 1e-12
        assert abs(observed[r["external_variable"]]["purity"] - r["purity"]) < 1e-6
        # nations make up regions, all else is drawn at random: never less agreement than chance
        assert 0.5 < r["entropy_random_baseline"] and r["normalized_entropy"] < r["entropy_random_baseline"] + 0.1


def test_scans_are_pruned_and_filters_pushed(spark):
    plan = QUERIES["year_filter"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
    plan = QUERIES["positive_rate"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in plan


def test_no_cross_joins_and_no_python_in_column_work(spark):
    python = {"assign_sse", "kmeans_step", "perm_baseline", "external_validation"}
    for name in set(SQL) - python:
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan, name


def test_result_does_not_depend_on_partitioning(spark):
    from valuescout.catalogue.tables import predictions, facts
    from valuescout.operators.funnel import join_signals, select_gems

    def found(parts):
        f = facts(spark, FOLDER).repartition(parts)
        p = predictions(spark, FOLDER).repartition(parts + 2, "price_clean")
        joined = join_signals(f.select("listing_id", "is_hidden"), f.select("listing_id", "positive_rate"), p)
        return sorted(map(tuple, select_gems(joined, 0.5).select("listing_id", F.round("discount_pct", 9)).collect()))

    assert found(1) == found(13)


def test_hot_listing_is_spread(spark):
    """A third of all reviews on one listing: where the ids are too many to
    copy, no task of the membership join gets more than its share."""
    from valuescout.operators.rows import member_flag

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        reviews = spark.range(240_000).select(
            "id",
            F.when(F.col("id") % 3 == 0, "7").otherwise(F.col("id").cast("string")).alias("listing_id"),
        )
        ids = spark.range(0, 240_000, 5).select(F.col("id").cast("string").alias("listing_id"))
        ids = ids.unionByName(spark.range(7, 8).select(F.col("id").cast("string").alias("listing_id")))
        wanted = 80_000 + 1 + sum(1 for i in range(0, 240_000, 5) if i % 3)
        sizes = {}
        for rows in (0, 10**6):
            flagged = member_flag(reviews, ids, "listing_id", "inside", "id", rows)
            assert flagged.columns == ["listing_id", "id", "inside"]
            per_task = flagged.groupBy(F.spark_partition_id()).agg(
                F.count("*").alias("n"), F.sum("inside").alias("inside")
            ).collect()
            assert sum(r["n"] for r in per_task) == 240_000
            assert sum(r["inside"] for r in per_task) == wanted
            sizes[rows] = max(r["n"] for r in per_task)
        assert sizes[0] < 240_000 / 8 * 1.7
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
