"""The fair-price model: features, tree, scoring and error metrics."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window, functions as F

from valuescout.constants import (
    PRICE_CATEGORICAL_FEATURES,
    PRICE_EXCLUDED,
    PRICE_NUMERIC_FEATURES,
    PRICE_VIEW,
    PROPERTY_TYPES_KEPT,
    SPLIT_SEED,
    TRAIN_BUCKETS,
    TREE_MAX_DEPTH,
    TREE_MIN_LEAF,
)
from valuescout.functions.ids import hash_bucket, in_test_set
from valuescout.functions.values import log_price
from valuescout.operators import deep_tree
from valuescout.operators.quantiles import median_impute
from valuescout.operators.rows import fold_top_n
from valuescout.session import written_table

_MAX_BINS = 256
_DENSE_DEPTH = 12


def check_features(df: DataFrame, features, excluded=PRICE_EXCLUDED):
    """Raise if a feature is missing, or is one of the excluded columns."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    leaked = [c for c in features if c in set(excluded)]
    if leaked:
        raise ValueError(f"excluded columns among the features: {leaked}")


def with_label(df: DataFrame) -> DataFrame:
    """Make sure `log_price` exists."""
    if "log_price" in df.columns:
        return df
    if "price_clean" not in df.columns:
        raise ValueError("neither log_price nor price_clean is present")
    return df.withColumn("log_price", log_price("price_clean"))


def train_test_flag(df: DataFrame, key="id", seed=SPLIT_SEED, buckets=TRAIN_BUCKETS):
    """Add `in_test_set`: about four in five rows, chosen by the id alone."""
    return df.withColumn("in_test_set", in_test_set(key, seed, buckets))


def prepare_features(
    df: DataFrame,
    numeric=PRICE_NUMERIC_FEATURES,
    categorical=PRICE_CATEGORICAL_FEATURES,
    fold="property_type",
    keep=PROPERTY_TYPES_KEPT,
    fit_on="all",
) -> DataFrame:
    """Label, numbers with their gaps filled by the median (of all rows, or of
    the training rows with `fit_on="train"`), rare levels folded, no NULL level."""
    numeric, categorical = list(numeric), list(categorical)
    check_features(df, numeric + categorical)
    df = with_label(df)
    df = df.withColumns({c: F.col(c).try_cast("double") for c in numeric})
    sample = df.filter(F.col("in_test_set") == 0) if fit_on == "train" else None
    df = median_impute(df, numeric, sample)
    if fold in categorical:
        df = fold_top_n(df, fold, keep)
    return df.fillna("Unknown", subset=categorical)


def one_hot_stages(categorical):
    """Indicator vectors that leave out the alphabetically first level."""
    indexed = [f"{c}_index" for c in categorical]
    coded = [f"{c}_onehot" for c in categorical]
    return [
        StringIndexer(
            inputCols=list(categorical),
            outputCols=indexed,
            stringOrderType="alphabetDesc",
        ),
        OneHotEncoder(inputCols=indexed, outputCols=coded, dropLast=True),
    ], coded


def one_hot(df: DataFrame, columns) -> DataFrame:
    """Adds `<c>_onehot`, an array of 0 and 1 per level in descending order, the
    alphabetically first level left out; fits the stages of the tree's pipeline
    (runs a job). Every row stays, also those of the first level."""
    stages, coded = one_hot_stages(list(columns))
    encoded = Pipeline(stages=stages).fit(df).transform(df)
    return encoded.select(*df.columns, *[vector_to_array(c).alias(c) for c in coded])


def _indexed(df: DataFrame, stages, categorical) -> PipelineModel:
    """Fit the stages on the levels that occur: in their alphabetical order how
    often one occurs does not matter (runs jobs)."""
    return Pipeline(stages=stages).fit(df.select(*categorical).distinct() if categorical else df)


def tree_pipeline(
    numeric=PRICE_NUMERIC_FEATURES,
    categorical=PRICE_CATEGORICAL_FEATURES,
    max_depth=TREE_MAX_DEPTH,
    min_leaf=TREE_MIN_LEAF,
    label="log_price",
    seed=SPLIT_SEED,
) -> Pipeline:
    stages, coded = one_hot_stages(list(categorical)) if categorical else ([], [])
    assembler = VectorAssembler(inputCols=[*numeric, *coded], outputCol="features")
    tree = DecisionTreeRegressor(
        featuresCol="features",
        labelCol=label,
        predictionCol="predicted_log_price",
        maxDepth=max_depth,
        minInstancesPerNode=min_leaf,
        maxBins=_MAX_BINS,
        seed=seed,
    )
    return Pipeline(stages=[*stages, assembler, tree])


def fair_price_fit(prepared: DataFrame, numeric, categorical, **tree) -> PipelineModel:
    """Fit on the training rows only (runs jobs). Levels are learnt from all
    rows, so that a level seen only in the test rows keeps its column."""
    stages = tree_pipeline(numeric, categorical, **tree).getStages()
    encoders = _indexed(prepared, stages[:-1], categorical)
    train = encoders.transform(prepared.filter(F.col("in_test_set") == 0))
    return PipelineModel([*encoders.stages, stages[-1].fit(train)])


def fair_price_score(model: PipelineModel, prepared: DataFrame, key="id") -> DataFrame:
    """(id, price_clean, log_price, predicted_log_price, predicted_price,
    residual, in_test_set) for every row."""
    scored = model.transform(prepared)
    predicted = F.exp("predicted_log_price")
    return scored.select(
        F.col(key).alias("id"),
        "price_clean",
        "log_price",
        "predicted_log_price",
        predicted.alias("predicted_price"),
        (F.col("price_clean") - predicted).alias("residual"),
        "in_test_set",
    )


def mean_price_by(df: DataFrame, group, key="id") -> DataFrame:
    """The same predictions table from a one-split model: the geometric mean
    price of the training rows in the listing's group. One row per group is
    copied to all tasks once its size is known at run time."""
    fitted = (
        df.filter(F.col("in_test_set") == 0)
        .groupBy(group)
        .agg(F.avg("log_price").alias("predicted_log_price"))
    )
    predicted = F.exp("predicted_log_price")
    return df.join(fitted, group).select(
        F.col(key).alias("id"),
        "price_clean",
        "log_price",
        "predicted_log_price",
        predicted.alias("predicted_price"),
        (F.col("price_clean") - predicted).alias("residual"),
        "in_test_set",
    )


def price_metrics(predictions: DataFrame) -> DataFrame:
    """One row per split (`test`, `train`, `all`): n, rmse_log, exp_rmse_log,
    rmse, mae, mape_pct and the gap in rmse_log to the `all` row."""
    log_error = F.col("log_price") - F.col("predicted_log_price")
    error = F.col("price_clean") - F.col("predicted_price")
    per_split = predictions.groupBy("in_test_set").agg(
        F.count("*").alias("n"),
        F.sum(log_error * log_error).alias("sq_log"),
        F.sum(error * error).alias("sq"),
        F.sum(F.abs(error)).alias("ab"),
        F.sum(F.abs(error) / F.col("price_clean")).alias("rel"),
    )
    # At most three rows from here on.
    own = F.when(F.col("in_test_set") == 1, "test").otherwise("train")
    both = per_split.withColumn("split", F.explode(F.array(own, F.lit("all"))))
    totals = both.groupBy("split").agg(*[F.sum(c).alias(c) for c in ("n", "sq_log", "sq", "ab", "rel")])
    rmse_log = F.sqrt(F.col("sq_log") / F.col("n"))
    table = totals.select(
        "split",
        "n",
        rmse_log.alias("rmse_log"),
        F.exp(rmse_log).alias("exp_rmse_log"),
        F.sqrt(F.col("sq") / F.col("n")).alias("rmse"),
        (F.col("ab") / F.col("n")).alias("mae"),
        (F.col("rel") * 100 / F.col("n")).alias("mape_pct"),
    )
    # a window over these rows: a scalar subquery would go through the predictions again
    overall = F.max(F.when(F.col("split") == "all", F.col("rmse_log"))).over(Window.partitionBy(F.lit(0)))
    return table.withColumn("gap_to_all", F.col("rmse_log") - overall)


def off_view(predictions: DataFrame, view=PRICE_VIEW) -> DataFrame:
    """(n, n_outside, pct_outside): test rows whose price or prediction falls
    outside the plotting range."""
    low, high = view
    outside = ~F.col("price_clean").between(low, high) | ~F.col("predicted_price").between(low, high)
    return predictions.filter(F.col("in_test_set") == 1).agg(
        F.count("*").alias("n"),
        F.count_if(outside).alias("n_outside"),
        (F.avg(outside.cast("double")) * 100).alias("pct_outside"),
    )


def feature_names(model: PipelineModel, scored: DataFrame) -> list[str]:
    """Names of the vector slots, from the column's own metadata."""
    groups = scored.schema["features"].metadata["ml_attr"]["attrs"]
    slots = sorted((a["idx"], a["name"]) for attrs in groups.values() for a in attrs)
    return [name for _, name in slots]


def importances(model: PipelineModel, prepared: DataFrame, top=15) -> DataFrame:
    """(rank, feature, importance), the `top` largest."""
    names = feature_names(model, model.transform(prepared.limit(0)))
    weights = model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(names, weights.tolist()), key=lambda r: (-r[1], r[0]))[:top]
    ranked = [(i, name, weight) for i, (name, weight) in enumerate(rows, start=1)]
    return prepared.sparkSession.createDataFrame(
        ranked, "rank int, feature string, importance double"
    )


def tree_size(model: PipelineModel) -> dict:
    tree = model.stages[-1]
    return {"depth": tree.depth, "leaves": (tree.numNodes + 1) // 2, "features": tree.numFeatures}


def cross_validate(
    prepared: DataFrame, numeric, categorical, depths, leaves, folds=5, key="id", parallelism=4
) -> DataFrame:
    """(max_depth, min_leaf, rmse_log): mean over folds of the training rows;
    folds come from a hash of the id (runs jobs)."""
    train = prepared.filter(F.col("in_test_set") == 0)
    train = train.withColumn("_fold", hash_bucket(key, SPLIT_SEED + 1, folds))
    pipeline = tree_pipeline(numeric, categorical)
    *encode, tree = pipeline.getStages()
    encoded = Pipeline(stages=encode).fit(train).transform(train)
    encoded = encoded.select("features", "log_price", "_fold").persist()
    grid = (
        ParamGridBuilder()
        .addGrid(tree.maxDepth, list(depths))
        .addGrid(tree.minInstancesPerNode, list(leaves))
        .build()
    )
    search = CrossValidator(
        estimator=tree,
        estimatorParamMaps=grid,
        evaluator=RegressionEvaluator(
            labelCol="log_price", predictionCol="predicted_log_price", metricName="rmse"
        ),
        numFolds=folds,
        foldCol="_fold",
        parallelism=parallelism,
    )
    scores = search.fit(encoded).avgMetrics
    encoded.unpersist()
    rows = [
        (g[tree.maxDepth], g[tree.minInstancesPerNode], float(s)) for g, s in zip(grid, scores)
    ]
    return prepared.sparkSession.createDataFrame(
        rows, "max_depth int, min_leaf int, rmse_log double"
    )


def deep_tree_scores(prepared: DataFrame, numeric, categorical, max_depth, min_leaf, **limits) -> DataFrame:
    """(price_clean, log_price, in_test_set, predicted_log_price, predicted_price,
    _leaves) from a tree too deep for one model in memory (runs jobs)."""
    train = prepared.filter(F.col("in_test_set") == 0)
    # levels are learnt from all rows, as for the other trees
    indexers = one_hot_stages(list(categorical))[0][:1] if categorical else []
    assembler = VectorAssembler(inputCols=list(numeric), outputCol="_numbers")
    fitted = _indexed(prepared, [*indexers, assembler], categorical)
    coded = fitted.transform(prepared).filter(F.col("_numbers").isNotNull())
    coded = deep_tree.binned(coded, numeric, deep_tree.thresholds(train, list(numeric), _MAX_BINS))
    codes, ordered = [f"_x{i}" for i in range(len(numeric))], [True] * len(numeric)
    if categorical:
        for c, levels in zip(categorical, fitted.stages[0].labelsArray):
            # the last level has no indicator of its own
            level = F.col(f"{c}_index").cast("int")
            coded = coded.withColumn(f"_level_{c}", F.when(level < len(levels) - 1, level).otherwise(-1))
            codes.append(f"_level_{c}")
            ordered.append(False)
    scored = deep_tree.fit_and_score(
        coded.select("price_clean", "log_price", "in_test_set", *codes),
        codes, ordered, "log_price", ["price_clean", "log_price"], max_depth, min_leaf, **limits,
    )
    return scored.withColumn("predicted_price", F.exp("predicted_log_price"))


def overfit_report(prepared: DataFrame, numeric, categorical, settings) -> DataFrame:
    """Error metrics by split for several (name, max_depth, min_leaf) settings.

    Spark's tree counts every bin for every node and is one object in memory;
    deeper ones than `_DENSE_DEPTH` are grown below their big nodes in tasks.
    """
    reports = []
    for name, depth, leaf in settings:
        if depth <= _DENSE_DEPTH:
            model = fair_price_fit(prepared, numeric, categorical, max_depth=depth, min_leaf=leaf)
            scores = price_metrics(fair_price_score(model, prepared))
            leaves = tree_size(model)["leaves"]
        else:
            scored = written_table(deep_tree_scores(prepared, numeric, categorical, depth, leaf))
            scores = price_metrics(scored.filter(F.col("in_test_set").isNotNull()))
            leaves = scored.agg(F.sum("_leaves")).first()[0]
        reports.append(
            scores.select(F.lit(name).alias("tree"), F.lit(leaves).alias("leaves"), *scores.columns)
        )
    out = reports[0]
    for more in reports[1:]:
        out = out.unionByName(more)
    return out
