import numpy as np
import pytest
from pyspark.sql import functions as F

from valuescout.functions.order import ordered_code
from valuescout.operators import quantiles, rows as ops
from valuescout.operators.quantiles import (
    count_median, exact_medians, exact_quantiles, median_impute, tertile,
)


def test_dedupe_first_with_hot_key(spark):
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"),
        (30000 - F.col("id")).alias("ord"), F.col("id").alias("v"),
        F.when(F.col("id") % 2 == 0, F.lit("x")).alias("maybe"))
    out = ops.dedupe_first(df.repartition(11), "key", "ord")
    assert out.columns == df.columns
    assert out.count() == 20001
    assert out.filter("key = 'hot'").first()["v"] == 29997
    plan = out._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_valid_and_distinct_ids(spark):
    df = spark.createDataFrame([(" 1 ", 1), ("1.0", 2), ("x", 3), (None, 4), ("2", 5)], "k string, v int")
    assert sorted(r["v"] for r in ops.keep_valid_ids(df, "k").collect()) == [1, 2, 5]
    assert sorted(r["k"] for r in ops.distinct_ids(df, "k").collect()) == ["1", "2"]


def test_membership(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    ids = spark.createDataFrame([("a",), ("a",), ("z",)], "k string")
    flags = {r["v"]: r["f"] for r in ops.member_flag(df, ids, "k", "f").collect()}
    assert flags == {1: 1, 2: 0, 3: 0}
    assert [r["v"] for r in ops.keep_members(df, ids, "k").collect()] == [1]
    groups = {r["v"]: r["group"] for r in ops.split_groups(df, ids, "k").collect()}
    assert groups == {1: "in", 2: "out", 3: "out"}


def test_fold_top_n(spark):
    df = spark.createDataFrame([(c,) for c in "aaabbbccd"] + [(None,)], "c string")
    got = sorted(r["c"] for r in ops.fold_top_n(df, "c", 2).collect())
    assert got == sorted(["a"] * 3 + ["b"] * 3 + ["Other"] * 4)


def test_missing_rates_and_audit(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, "y"), (4, None)], "a int, b string")
    got = {r["column"]: (r["n_missing"], r["pct_missing"]) for r in ops.missing_rates(df, ["a", "b"]).collect()}
    assert got == {"a": (1, 25.0), "b": (2, 50.0)}
    steps = [("has a", F.col("a").isNotNull()), ("b is x", F.col("b") == "x")]
    table = [(r["step"], r["n_rows"], r["n_dropped"]) for r in ops.audit(df, steps).orderBy("ord").collect()]
    assert table == [("rows in", 4, 0), ("has a", 3, 1), ("b is x", 1, 2)]
    assert ops.drop_missing(df, ["a", "b"]).count() == 1


@pytest.mark.parametrize("kind", ["normal", "ties", "hot", "tiny"])
def test_quantiles_are_exact(spark, kind):
    rng = np.random.default_rng(7)
    values = {
        "normal": rng.normal(size=40001), "ties": rng.integers(0, 9, size=20000).astype(float),
        "hot": np.where(rng.random(30000) < 0.4, 3.25, rng.lognormal(size=30000)), "tiny": np.array([5.0, 1.0]),
    }[kind]
    cells = [(float(v), None if i % 3 else float(i)) for i, v in enumerate(values)]
    df = spark.createDataFrame(cells, "v double, w double").repartition(7)
    ps = [0.0, 0.01, 1 / 3, 0.5, 2 / 3, 0.999, 1.0]
    got = {(r["column"], round(r["probability"], 6)): r["value"] for r in exact_quantiles(df, ["v", "w"], ps).collect()}
    w = np.array([c[1] for c in cells if c[1] is not None])
    for p in ps:
        assert np.isclose(got["v", round(p, 6)], np.quantile(values, p), rtol=1e-12, atol=1e-12)
        assert np.isclose(got["w", round(p, 6)], np.quantile(w, p), rtol=1e-12, atol=1e-12)


def test_medians_and_imputation(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, 4.0, None)], "i int, a double, b double")
    row = exact_medians(df, ["a", "b"]).first()
    assert row["a"] == 2.5 and row["b"] is None
    filled = {r["i"]: r["a"] for r in median_impute(df, ["a"]).collect()}
    assert filled == {1: 1.0, 2: 2.5, 3: 4.0}
    fitted = {r["i"]: r["a"] for r in median_impute(df, ["a"], df.filter("i = 3")).collect()}
    assert fitted[2] == 4.0
    counts = spark.createDataFrame([(1,), (2,), (3,), (4,)], "n bigint")
    assert count_median(counts, "n").first()[0] == 2.5


def test_tertile(spark):
    df = spark.createDataFrame([(float(i), -float(i)) for i in range(1, 7)], "a double, b double")
    got = {r["a"]: (r["ta"], r["tb"]) for r in tertile(df, {"ta": "a", "tb": "b"}).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["low", "low", "mid", "mid", "high", "high"]
    assert [got[i][1] for i in range(1, 7)] == ["high", "high", "mid", "mid", "low", "low"]
    flat = spark.createDataFrame([(1.0,)] * 5 + [(2.0,)], "a double")
    with pytest.raises(Exception, match="equal tertile edges"):
        tertile(flat, {"t": "a"}).collect()


def test_codes_sort_as_the_numbers_do(spark):
    rng = np.random.default_rng(4)
    powers = 2.0 ** np.arange(-1074, 1024)
    edge = [0.0, -0.0, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, np.inf, -np.inf, np.nan]
    x = np.concatenate([edge, powers, -powers * (1 + 2**-52), powers[60:] * (1 - 2**-53), rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500)])
    rows = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    got = rows.select("v", ordered_code("v").alias("code")).collect()
    assert [r["code"] for r in got if r["v"] is None] == [None]
    got = [r for r in got if r["v"] is not None]
    bits = np.array([r["v"] for r in got]).view(np.int64)
    size = bits & np.int64(0x7FFFFFFFFFFFFFFF)
    assert [r["code"] for r in got] == np.where(bits < 0, -size, size).tolist()


def test_quantiles_of_many_distinct_values(spark):
    """Five million values, and what one task of a round has to sort."""
    df = spark.range(5_000_000).select((F.randn(3) * 1e6).alias("v"))
    got = {r["probability"]: r["value"] for r in exact_quantiles(df, ["v"], [0.1, 0.5, 0.9]).collect()}
    plain = df.agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))).first()[0]
    assert [got[p] for p in (0.1, 0.5, 0.9)] == plain
    cells = df.select(F.lit(0).alias("_c"), F.col("v").alias("_v"), ordered_code("v").alias("_code"))
    counted = quantiles._histogram(cells, None, 1)
    assert counted.count() <= 1 << quantiles.DIGIT_BITS
    fullest = counted.orderBy(F.desc("_n")).limit(1).select("_c", F.col("_prefix").alias("_bucket"), F.array().cast(quantiles._WANTS).alias("_wants"))
    inside = quantiles._histogram(cells, fullest, 2)
    assert inside.count() <= 1 << quantiles.DIGIT_BITS
    assert inside.agg(F.max("_n")).first()[0] < 50 < inside.agg(F.sum("_n")).first()[0] / 1000


def test_quantiles_are_one_plan(spark):
    """The same for two rows and for many; nothing runs while it is built."""
    spark.sparkContext.setJobGroup("built", "quantiles")
    plans = [exact_quantiles(spark.range(n).select(F.col("id").alias("v")), ["v"], [0.5]) for n in (2, 2_000_000)]
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("built")) == []
    nodes = [[line.split("(")[0] for line in p._jdf.queryExecution().optimizedPlan().toString().splitlines()] for p in plans]
    assert len(nodes[0]) == len(nodes[1])
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_quantiles_compute_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return float(v % 100)

    df = spark.range(1000).select(counted("id").alias("v"))
    assert exact_quantiles(df, ["v"], [0.5]).first()["value"] == 49.5
    assert seen.value == 1000
