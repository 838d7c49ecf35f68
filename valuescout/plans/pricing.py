"""Cleaned listings -> fair price per listing."""

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from valuescout.constants import PRICE_CATEGORICAL_FEATURES, PRICE_NUMERIC_FEATURES
from valuescout.operators import pricing as ops
from valuescout.session import cut_lineage


@dataclass
class FairPrice:
    model: PipelineModel
    prepared: DataFrame
    predictions: DataFrame
    metrics: DataFrame
    importances: DataFrame
    size: dict


def fair_price(
    listings: DataFrame,
    numeric=PRICE_NUMERIC_FEATURES,
    categorical=PRICE_CATEGORICAL_FEATURES,
    fold="property_type",
    fit_on="all",
    **tree,
) -> FairPrice:
    """Split, prepare, fit on the training rows, score every row (runs jobs).

    The prepared table is written once to the checkpoint folder: encoders, one
    pass per tree level and the scoring all read it.
    """
    split = ops.train_test_flag(ops.with_label(listings))
    prepared = ops.prepare_features(split, numeric, categorical, fold=fold, fit_on=fit_on)
    prepared = cut_lineage(prepared)
    model = ops.fair_price_fit(prepared, numeric, categorical, **tree)
    predictions = ops.fair_price_score(model, prepared)
    return FairPrice(
        model,
        prepared,
        predictions,
        ops.price_metrics(predictions),
        ops.importances(model, prepared),
        ops.tree_size(model),
    )
