import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from valuescout.operators import profile as pr, segments as sg, validation as vd
from valuescout.session import cut_lineage

# Published room-type counts per cluster and their agreement.
GOLDEN = {0: {"e": 15, "p": 3}, 1: {"e": 177, "p": 26}, 2: {"e": 47}, 3: {"e": 110, "p": 72, "h": 2}}
GOLDEN_PURITY, GOLDEN_ENTROPY = 0.7721238938053098, 0.44100483787873657
GOLDEN_RANDOM_PURITY, GOLDEN_RANDOM_ENTROPY = 0.7721482300884953, 0.5027154830593021


def _golden(spark):
    rows = [(c, k) for c, kinds in GOLDEN.items() for k, n in kinds.items() for _ in range(n)]
    return spark.createDataFrame(rows, "cluster int, room string").repartition(5)


def test_golden_agreement(spark):
    table = vd.crosstab_long(_golden(spark), "cluster", "room")
    assert {(r["cluster"], r["class"]): r["n"] for r in table.collect()} == {
        (c, k): n for c, kinds in GOLDEN.items() for k, n in kinds.items()}
    assert vd.purity(table).first()[0] == pytest.approx(GOLDEN_PURITY, abs=1e-15)
    assert vd.norm_entropy(table).first()[0] == pytest.approx(GOLDEN_ENTROPY, abs=1e-14)


def test_golden_baseline(spark):
    """Same null as 1000 label shuffles, so the same means up to noise."""
    row = vd.external_validation(_golden(spark), "cluster", ["room"]).first()
    assert row["purity"] == pytest.approx(GOLDEN_PURITY, abs=1e-15)
    assert row["purity_random_baseline"] == pytest.approx(GOLDEN_RANDOM_PURITY, abs=2e-4)
    assert row["entropy_random_baseline"] == pytest.approx(GOLDEN_RANDOM_ENTROPY, abs=1.5e-3)
    assert row["purity_lift"] == row["purity"] - row["purity_random_baseline"]
    again = vd.external_validation(_golden(spark).repartition(3), "cluster", ["room"]).first()
    assert again["entropy_random_baseline"] == pytest.approx(row["entropy_random_baseline"], abs=1e-12)


def test_baseline_equals_all_permutations(spark):
    """Brute force: every relabelling of a tiny table, against many draws."""
    labels, classes = [0, 0, 0, 1, 1, 2], list("aabbbc")
    purities, entropies = [], []
    for shuffled in set(itertools.permutations(labels)):
        table = pd.crosstab(pd.Series(shuffled), pd.Series(classes)).to_numpy().astype(float)
        share = table / table.sum(axis=1, keepdims=True)
        terms = -share * np.log(np.where(share > 0, share, 1))
        purities.append(table.max(axis=1).sum() / table.sum())
        entropies.append((terms.sum(axis=1) * table.sum(axis=1)).sum() / table.sum() / np.log(3))
    df = spark.createDataFrame(list(zip(labels, classes)), "cluster int, c string")
    drawn = vd.perm_baseline(vd.crosstabs(df, "cluster", ["c"]), shuffles=4000).first()
    assert drawn["purity_random_baseline"] == pytest.approx(np.mean(purities), abs=0.01)
    assert drawn["entropy_random_baseline"] == pytest.approx(np.mean(entropies), abs=0.01)


def test_one_class_and_missing_classes(spark):
    df = spark.createDataFrame([(0, "x"), (1, "x"), (1, None)], "cluster int, c string")
    row = vd.external_validation(df, "cluster", ["c"], shuffles=5).first()
    assert row["n_classes"] == 1 and row["purity"] == 1.0
    assert row["normalized_entropy"] is None and row["entropy_random_baseline"] is None


def test_large_population_draws():
    """The sampler for huge margins follows the same distribution."""
    ours = [vd._hypergeometric(np.random.default_rng([1, i]), 300, 700, 200) for i in range(4000)]
    exact = np.random.default_rng(2).hypergeometric(300, 700, 200, 4000)
    assert np.mean(ours) == pytest.approx(60, abs=0.5)
    assert np.var(ours) == pytest.approx(np.var(exact), rel=0.12)
    huge = np.array([4 * 10**9, 10**9, 5 * 10**9])
    row = vd._draw(np.random.default_rng(3), huge, 10**9)
    assert row.sum() == 10**9 and np.allclose(row / 1e9, [0.4, 0.1, 0.5], atol=1e-3)


def _blobs(spark, n=900):
    rng = np.random.default_rng(5)
    centers = np.array([[0, 0], [6, 0], [0, 6]])
    points = centers[rng.integers(3, size=n)] + rng.normal(size=(n, 2))
    return points, spark.createDataFrame([(float(a), float(b)) for a, b in points], "x double, y double").repartition(4)


def test_standardize(spark):
    points, df = _blobs(spark)
    z = sg.standardize(df.withColumn("flat", F.lit(2.0)), ["x", "y", "flat"]).toPandas()
    assert np.allclose(z[["z_x", "z_y"]].std(ddof=0), 1) and np.allclose(z[["z_x", "z_y"]].mean(), 0)
    assert (z["z_flat"] == 0).all()


def test_kmeans(spark):
    points, df = _blobs(spark)
    scaled = sg.standardize(df, ["x", "y"])
    columns = ["z_x", "z_y"]
    found = sg.kmeans_sweep(scaled, columns, ks=(1, 2, 3, 4))
    sse = {s.k: s.sse for s in found}
    assert sse[1] == pytest.approx(2 * len(points))
    assert sse[1] > sse[2] > sse[3] > sse[4]
    vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(scaled)
    for k in (2, 3, 4):
        theirs = min(KMeans(k=k, seed=s, maxIter=300).fit(vectors).summary.trainingCost for s in range(3))
        assert sse[k] <= theirs * 1.02
    three = found[2]
    assigned = sg.assign(scaled, list(enumerate(three.centers)), columns)
    assert assigned.agg(F.sum("dist2")).first()[0] == pytest.approx(three.sse, rel=1e-3)
    # Converged centres are the means of their members, in original units too.
    means = sg.cluster_means(assigned, ["x", "y"]).orderBy("cluster").collect()
    back = sg.centroid_table(scaled, ["x", "y"], [three]).orderBy("cluster").collect()
    for m, c in zip(means, back):
        assert c["x"] == pytest.approx(m["mean_x"], abs=0.05) and c["y"] == pytest.approx(m["mean_y"], abs=0.05)
    curve = sg.elbow(sg.sse_table(spark, found).select("k", "sse")).collect()
    assert [r["k"] for r in curve if r["is_elbow"] == 1] in ([2], [3])
    scores = {r["k"]: r["silhouette"] for r in sg.silhouette(scaled, columns, found).collect()}
    assert set(scores) == {2, 3, 4} and scores[3] == max(scores.values())


def test_assignment_forms_agree(spark):
    points, df = _blobs(spark)
    centers = [(7, [0.0, 0.0]), (9, [6.0, 0.0]), (11, [0.0, 6.0])]
    both = sg.assign(df.withColumn("v", F.array("x", "y")), centers, ["x", "y"])
    renamed = both.withColumnRenamed("cluster", "c1").withColumnRenamed("dist2", "d1")
    both = sg.assign_vectors(renamed, centers, "v").toPandas()
    assert (both["c1"] == both["cluster"]).all() and np.allclose(both["d1"], both["dist2"])
    tie = spark.createDataFrame([(1.0,)], "x double")
    assert sg.assign(tie, [(2, [0.0]), (5, [2.0])], ["x"]).first()["cluster"] == 2


def test_elbow(spark):
    curve = sg.elbow(spark.createDataFrame([(1, 100.0), (2, 60.0), (3, 40.0), (4, 35.0)], "k int, sse double"))
    got = curve.orderBy("k").collect()
    assert [r["gain_pct"] for r in got] == [None, 40.0, pytest.approx(100 / 3), 12.5]
    assert [r["removed_pct"] for r in got] == [0.0, 40.0, 60.0, 65.0]
    assert [r["second_diff"] for r in got] == [None, 20.0, 15.0, None]
    assert [r["is_elbow"] for r in got] == [0, 1, 0, 0]


def test_profile(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"cluster": rng.integers(0, 3, 400), "a": rng.normal(5, 2, 400), "b": rng.lognormal(size=400),
                        "room_type": rng.choice(list("xyz"), 400), "neighbourhood_cleansed": rng.choice(list("pqrst"), 400)})
    df = spark.createDataFrame(pdf).repartition(6)
    z = pr.cluster_z(df, ["a", "b"], cap=0.05).toPandas()
    want = (pdf.groupby("cluster")[["a", "b"]].mean() - pdf[["a", "b"]].mean()) / pdf[["a", "b"]].std()
    for r in z.itertuples():
        assert r.z == pytest.approx(want.loc[r.cluster, r.variable], abs=1e-12)
        assert r.clipped == int(abs(r.z) > 0.05) and abs(r.z_clipped) <= 0.05
    full = pr.full_profile(df, (("mean_a", "a", 1), ("mean_b_pct", "b", 100))).toPandas().set_index("cluster")
    for c, sub in pdf.groupby("cluster"):
        assert full.loc[c, "n_listings"] == len(sub)
        assert full.loc[c, "mean_b_pct"] == pytest.approx(sub["b"].mean() * 100)
        mix = (sub["room_type"].value_counts(normalize=True) * 100).round(1).to_dict()
        assert full.loc[c, "room_type_distribution_pct"] == pytest.approx(mix, abs=0.051)
        top = sub["neighbourhood_cleansed"].value_counts()
        got = full.loc[c, "top_neighbourhoods"]
        assert sorted(got.values(), reverse=True) == sorted(top, reverse=True)[:3]
        assert all(top[k] == v for k, v in got.items())


def test_kmeans_seeding_does_not_depend_on_partitions(spark):
    """All rows take part at every size; rows with missing values are counted."""
    rng = np.random.default_rng(8)
    for n in (9_999, 20_000):
        points = rng.standard_normal((n, 2)) + 6 * rng.integers(0, 3, (n, 1))
        rows = [tuple(map(float, p)) for p in points] + [(None, 1.0), (float("nan"), 2.0)]
        df = spark.createDataFrame(rows, "x double, y double")
        found = []
        for parts in (1, 3, 7):
            one, three = sg.kmeans_sweep(df.repartition(parts), ["x", "y"], ks=(1, 3), restarts=2)
            assert one.left_out == three.left_out == 2
            np.testing.assert_allclose(one.centers, [points.mean(axis=0)])
            assert abs(one.sse - points.var(axis=0).sum() * n) < 1e-6 * one.sse
            found.append(sorted(three.centers))
        np.testing.assert_allclose(found[0], found[1], rtol=1e-9)
        np.testing.assert_allclose(found[0], found[2], rtol=1e-9)


def test_standardised_sse_of_one_cluster(spark):
    df = spark.range(500).selectExpr("cast(id % 17 as double) a", "cast(id * id % 23 as double) b")
    scaled = sg.standardize(df, ["a", "b"])
    (one,) = sg.kmeans_sweep(scaled, ["z_a", "z_b"], ks=(1,))
    assert abs(one.sse - 500 * 2) < 1e-6


def expected_entropy(sizes, totals):
    """Mean normalised entropy over all relabellings, from the distribution of
    each cell: x ln x times the hypergeometric probability of x."""
    from math import exp, lgamma, log

    def choose(n, k):
        return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)

    n = sum(sizes)
    cells = 0.0
    for s in sizes:
        for t in totals:
            for x in range(max(1, s + t - n), min(s, t) + 1):
                cells += x * log(x) * exp(choose(t, x) + choose(n - t, s - x) - choose(n, s))
    return (sum(s * log(s) for s in sizes) - cells) / n / log(len(totals))


def test_baseline_against_its_closed_form(spark):
    rng = np.random.default_rng(12)
    sizes, n_classes = [40, 90, 170], 25
    labels = rng.integers(0, n_classes, sum(sizes))
    cluster = np.repeat(np.arange(3), sizes)
    df = spark.createDataFrame([(int(c), f"class {k}") for c, k in zip(cluster, labels)], "cluster int, c string")
    tables = vd.crosstabs(df, "cluster", ["c"])
    found = vd.perm_baseline(tables, shuffles=3000).first()
    assert found["entropy_random_baseline"] == pytest.approx(expected_entropy(sizes, np.bincount(labels).tolist()), abs=1e-3)
    again = vd.perm_baseline(tables.repartition(3), shuffles=3000).first()
    assert again["purity_random_baseline"] == pytest.approx(found["purity_random_baseline"], abs=1e-12)


def test_baseline_of_very_many_classes(spark):
    """A hundred thousand classes: no row holds more than a node's branches."""
    df = spark.range(250_000).select((F.col("id") % 3).cast("int").alias("cluster"), F.pmod(F.xxhash64("id"), F.lit(100_000)).cast("string").alias("c"))
    tables = cut_lineage(vd.crosstabs(df, "cluster", ["c"]))
    found = vd.perm_baseline(tables, shuffles=2).first()
    seen = vd.agreement(tables).first()
    assert seen["n_classes"] > 90_000
    assert found["entropy_random_baseline"] == pytest.approx(seen["normalized_entropy"], abs=2e-3)
    assert found["purity_random_baseline"] == pytest.approx(seen["purity"], abs=1e-4)
    code = F.xxhash64("class")
    for digits in range(vd._DIGITS + 1):
        parent, child = (F.shiftrightunsigned(code, 64 - vd._DIGIT_BITS * d) if d else F.lit("root") for d in (digits, digits + 1))
        child = code if digits == vd._DIGITS else child
        widest = tables.groupBy(parent).agg(F.countDistinct(child).alias("n")).agg(F.max("n")).first()[0]
        assert widest <= 1 << vd._DIGIT_BITS


def test_silhouette_of_all_k_in_two_jobs(spark):
    """Equal to the stock evaluator, with two passes over the data in all."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 1.0, (80, 3)) for c in (-6, 0, 5)] + [np.full((1, 3), 40.0)])
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in x], "a double, b double, c double").cache()
    df.count()
    columns = ["a", "b", "c"]
    solutions = [sg.Solution(k, 0.0, 1, x[np.linspace(0, len(x) - 1, k).astype(int)].tolist()) for k in range(1, 7)]
    spark.sparkContext.setJobGroup("silhouettes", "all k")
    found = {r["k"]: r["silhouette"] for r in sg.silhouette(df, columns, solutions).collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("silhouettes")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(found) == [2, 3, 4, 5, 6] and len(jobs) <= 5  # a shuffle stage of a plan may be a job
    vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(df)
    judge = ClusteringEvaluator(predictionCol="cluster", featuresCol="features", distanceMeasure="squaredEuclidean")
    for s in solutions[1:]:
        labelled = sg.assign(vectors, list(enumerate(s.centers)), columns)
        assert found[s.k] == pytest.approx(judge.evaluate(labelled), abs=1e-9)


def test_many_centres_do_not_become_literals(spark):
    rng = np.random.default_rng(8)
    centers = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 3)))]
    df = spark.createDataFrame([tuple(map(float, v)) for v in rng.normal(size=(50, 3))], "a double, b double, c double")
    found = sg.assign(df, centers, ["a", "b", "c"])
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 5000
    for r in found.collect():
        dist = [sum((r[c] - v) ** 2 for c, v in zip("abc", center)) for _, center in centers]
        assert r["cluster"] == int(np.argmin(dist)) and r["dist2"] == pytest.approx(min(dist))


def test_mean_vectors_are_summed_before_they_are_laid_out(spark):
    rows = [("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("b", [0.5, 0.5]), ("b", None), ("c", None), ("d", [1.0, None])]
    df = spark.createDataFrame(rows, "g string, v array<float>")
    means = sg.vector_means(df, "g", "v")
    assert sorted(map(tuple, means.collect())) == [("a", 0, 2.0), ("a", 1, 4.0), ("b", 0, 0.5), ("b", 1, 0.5)]
    plan = means._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate") and plan.count("Generate") == 1
