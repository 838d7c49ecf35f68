import numpy as np
import pytest
from pyspark.sql import functions as F

from valuescout.operators import exposure, funnel as fn, pricing


def test_positive_rate_treats_nan_as_not_positive(spark):
    df = spark.createDataFrame([("1", 0.5), ("1", float("nan")), ("1", 0.49), ("x", 1.0), ("2", None)],
                               "listing_id string, sentiment_vader double")
    got = {r["listing_id"]: r["positive_rate"] for r in exposure.positive_rate(df).collect()}
    assert got == {"1": 1 / 3, "2": 0.0}
    facts = {r["listing_id"]: (r["review_count"], r["positive_rate"]) for r in exposure.review_facts(df).collect()}
    assert facts == {"1": (3, 1 / 3), "2": (1, 0.0)}


@pytest.mark.parametrize("counts,hidden", [([1, 2, 3, 4], {1, 2}), ([1, 2, 3], {1}), ([2, 2, 2], set())])
def test_low_exposure(spark, counts, hidden):
    df = spark.createDataFrame([(str(i), c) for i, c in enumerate(counts)], "listing_id string, review_count bigint")
    got = {r["review_count"] for r in exposure.low_exposure(df).filter("is_hidden = 1").collect()}
    assert got == hidden


def _signals(spark):
    # id, hidden, rate, price, predicted, test
    cases = [
        ("1", 1, 0.9, 85.0, 100.0, 1),     # on the price boundary: counts
        ("2", 1, 0.75, 50.0, 100.0, 1),    # on the rate boundary: does not
        ("3", 0, 0.9, 50.0, 100.0, 1), ("4", 1, 0.9, 50.0, 100.0, 0), ("5", 1, 0.9, 86.0, 100.0, 1),
        ("9007199254740993", 1, 1.0, 20.0, 100.0, 1), ("9007199254740992", 0, 1.0, 20.0, 100.0, 1),
    ]
    flags = spark.createDataFrame([(c[0], c[1]) for c in cases] + [("77", 1)], "listing_id string, is_hidden int")
    rates = spark.createDataFrame([(c[0], c[2]) for c in cases], "listing_id string, positive_rate double")
    predictions = spark.createDataFrame([(c[0], c[3], c[4], c[5]) for c in cases],
                                        "id string, price_clean double, predicted_price double, in_test_set int")
    return flags, rates, predictions


def test_find_gems(spark):
    found = fn.find_gems(*_signals(spark)).collect()
    assert [r["listing_id"] for r in found] == ["9007199254740993", "1"]
    assert found[1]["discount_pct"] == 1 - 85.0 / 100.0
    assert found[0].asDict().keys() == {"listing_id", "is_hidden", "positive_rate", "price_clean",
                                        "predicted_price", "discount_pct", "in_test_set"}


def test_published_discounts(spark):
    """Price and prediction of three published finds give their discounts."""
    cases = [("1314863", 20.0, 99.98085906052208, 0.7999617107921301),
             ("1348401543407999020", 20.0, 93.38923961813153, 0.7858425651415519),
             ("9671847", 72.0, 292.6348117624253, 0.7539595526370493)]
    joined = spark.createDataFrame([(i, 1, 1.0, p, q, 1) for i, p, q, _ in cases],
                                   "listing_id string, is_hidden int, positive_rate double, price_clean double, "
                                   "predicted_price double, in_test_set int")
    got = {r["listing_id"]: r["discount_pct"] for r in fn.select_gems(joined).collect()}
    assert got == {i: d for i, _, _, d in cases}


def test_funnel(spark):
    joined = fn.join_signals(*_signals(spark))
    table = fn.funnel(joined).orderBy("ord").collect()
    counts = [r["n"] for r in table]
    assert counts == [7, 5, 4, 3, 2] and counts == sorted(counts, reverse=True)
    assert table[0]["retention_pct"] is None and table[4]["retention_pct"] == pytest.approx(200 / 3)
    assert table[1]["pct_of_base"] == pytest.approx(500 / 7)


def test_funnel_retention_of_published_counts(spark):
    """22943 -> 10898 -> 2766 -> 564 -> 453, as shares of the stage before."""
    published = [22943, 10898, 2766, 564, 453]
    df = spark.range(published[0])
    stages = [(f"s{n}", F.col("id") < n) for n in published[1:]]
    got = [r["retention_pct"] for r in fn.funnel(df, stages).orderBy("ord").collect()][1:]
    assert [round(v, 1) for v in got] == [47.5, 25.4, 20.4, 80.3]


def test_feature_guards(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "size double, price_clean double")
    with pytest.raises(ValueError, match="missing"):
        pricing.check_features(df, ["size", "rooms"])
    with pytest.raises(ValueError, match="excluded"):
        pricing.check_features(df, ["size", "price_clean"])
    with pytest.raises(ValueError, match="neither"):
        pricing.with_label(df.select("size"))


def test_metrics(spark):
    rng = np.random.default_rng(3)
    price, guess = rng.lognormal(4, 1, 500), rng.lognormal(4, 1, 500)
    test = (rng.random(500) < 0.8).astype(int)
    df = spark.createDataFrame(
        [(float(p), float(np.log(p)), float(np.log(g)), float(g), int(t)) for p, g, t in zip(price, guess, test)],
        "price_clean double, log_price double, predicted_log_price double, predicted_price double, in_test_set int")
    got = {r["split"]: r for r in pricing.price_metrics(df).collect()}
    for split, mask in (("test", test == 1), ("train", test == 0), ("all", test >= 0)):
        p, g = price[mask], guess[mask]
        assert got[split]["n"] == mask.sum()
        assert got[split]["rmse_log"] == pytest.approx(np.sqrt(np.mean((np.log(p) - np.log(g)) ** 2)))
        assert got[split]["rmse"] == pytest.approx(np.sqrt(np.mean((p - g) ** 2)))
        assert got[split]["mae"] == pytest.approx(np.mean(np.abs(p - g)))
        assert got[split]["mape_pct"] == pytest.approx(np.mean(np.abs(p - g) / p) * 100)
        assert got[split]["exp_rmse_log"] == pytest.approx(np.exp(got[split]["rmse_log"]))
    assert got["all"]["gap_to_all"] == 0.0
    off = pricing.off_view(df, (20.0, 200.0)).first()
    p, g = price[test == 1], guess[test == 1]
    outside = (p < 20) | (p > 200) | (g < 20) | (g > 200)
    assert (off["n"], off["n_outside"]) == (len(p), outside.sum())


def _homes(spark, n=4000):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(n):
        kind = ["Entire home", "Private room", "Hotel room"][rng.integers(3)]
        beds = float(rng.integers(1, 6))
        log_price = 3 + 0.3 * beds + (0.5 if kind == "Entire home" else 0) + rng.normal(0, 0.1)
        rows.append((str(10**18 + i), kind, None if i % 9 == 0 else beds, float(rng.random()),
                     None if i % 50 == 0 else f"type{rng.integers(30)}", float(np.exp(log_price))))
    return spark.createDataFrame(
        rows, "id string, room_type string, beds double, noise double, property_type string, price_clean double")


def test_tree(spark, tmp_path):
    from valuescout.plans.pricing import fair_price
    from pyspark.ml import PipelineModel
    from valuescout.sources.sinks import save_model
    found = fair_price(_homes(spark), ["beds", "noise"], ["room_type", "property_type"])
    metrics = {r["split"]: r for r in found.metrics.collect()}
    assert metrics["all"]["n"] == 4000 and metrics["test"]["rmse_log"] < 0.25
    assert found.size["depth"] <= 8
    # 2 numbers, 3 room types and 15 + "Other" property types, first level left out
    assert found.size["features"] == 2 + 2 + 15
    top = found.importances.orderBy("rank").collect()
    assert top[0]["feature"] == "beds"
    assert not any(r["feature"].endswith("_Entire home") for r in top)
    row = found.predictions.first()
    assert row["residual"] == pytest.approx(row["price_clean"] - np.exp(row["predicted_log_price"]))
    save_model(found.model, str(tmp_path / "model"))
    again = pricing.fair_price_score(PipelineModel.load(str(tmp_path / "model")), found.prepared)
    a = {r["id"]: r["predicted_log_price"] for r in again.collect()}
    b = {r["id"]: r["predicted_log_price"] for r in found.predictions.collect()}
    assert a == b
    unfilled = found.prepared.filter(F.col("beds").isNull() | F.col("property_type").isNull())
    assert unfilled.count() == 0


def test_cv_prefers_enough_depth(spark):
    split = pricing.train_test_flag(_homes(spark))
    prepared = pricing.prepare_features(split, ["beds", "noise"], ["room_type"], fold="property_type", fit_on="train")
    scores = pricing.cross_validate(prepared, ["beds", "noise"], ["room_type"], depths=(1, 5), leaves=(20,), folds=3)
    by_depth = {r["max_depth"]: r["rmse_log"] for r in scores.collect()}
    assert by_depth[5] < by_depth[1]
    report = pricing.overfit_report(prepared, ["beds", "noise"], ["room_type"], [("small", 5, 20), ("big", 20, 1)])
    rmse = {(r["tree"], r["split"]): r["rmse_log"] for r in report.collect()}
    assert rmse["big", "train"] < rmse["small", "train"] and rmse["big", "test"] > rmse["small", "test"]
