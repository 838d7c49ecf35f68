"""Per-listing review facts and the two flags derived from them."""

from pyspark.sql import DataFrame, functions as F

from valuescout.constants import POSITIVE_THRESHOLD
from valuescout.functions.values import nan_to_null
from valuescout.operators.quantiles import count_median
from valuescout.operators.rows import keep_valid_ids


def positive(score, threshold=POSITIVE_THRESHOLD):
    """1.0 for a score at or above the threshold; unscored rows count as 0."""
    return F.when(nan_to_null(score) >= threshold, 1.0).otherwise(0.0)


def review_counts(reviews: DataFrame, key="listing_id") -> DataFrame:
    """(key, review_count) over valid ids."""
    return (
        keep_valid_ids(reviews.select(key), key)
        .groupBy(key)
        .agg(F.count("*").alias("review_count"))
    )


def positive_rate(
    scored: DataFrame, key="listing_id", score="sentiment_vader", threshold=POSITIVE_THRESHOLD
) -> DataFrame:
    """(key, positive_rate) over valid ids."""
    rows = keep_valid_ids(scored.select(key, score), key)
    return rows.groupBy(key).agg(F.avg(positive(F.col(score), threshold)).alias("positive_rate"))


def review_facts(
    scored: DataFrame,
    key="listing_id",
    score="sentiment_vader",
    threshold=POSITIVE_THRESHOLD,
    count=None,
) -> DataFrame:
    """(key, review_count, positive_rate): both facts from one shuffle. Rows
    that stand for several reviews say how many in column `count`."""
    number = F.lit(1) if count is None else F.col(count)
    rows = keep_valid_ids(scored.select(key, score, number.cast("bigint").alias("_n")), key)
    liked = F.sum(positive(F.col(score), threshold) * F.col("_n"))
    return rows.groupBy(key).agg(
        F.sum("_n").alias("review_count"), (liked / F.sum("_n")).alias("positive_rate")
    )


def low_exposure(counts: DataFrame, count="review_count", name="is_hidden") -> DataFrame:
    """Add 0/1: fewer reviews than the median listing (strictly)."""
    median = count_median(counts, count).scalar()
    return counts.withColumn(name, (F.col(count) < median).cast("int"))
