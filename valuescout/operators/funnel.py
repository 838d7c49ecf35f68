"""Intersecting the criteria, and counting what each one removes."""

from pyspark.sql import DataFrame, Window, functions as F

from valuescout.constants import MIN_DISCOUNT, MIN_POSITIVE_RATE


def join_signals(flags: DataFrame, rates: DataFrame, predictions: DataFrame) -> DataFrame:
    """Listings present in all three sources; every side has one row per id."""
    predicted = predictions.withColumnRenamed("id", "listing_id")
    return flags.join(rates, "listing_id").join(predicted, "listing_id")


def criteria(min_rate=MIN_POSITIVE_RATE, min_discount=MIN_DISCOUNT):
    """The conditions in order, each (name, Column)."""
    return [
        ("low exposure", F.col("is_hidden") == 1),
        ("well reviewed", F.col("positive_rate") > min_rate),
        ("underpriced", F.col("price_clean") <= F.col("predicted_price") * (1 - min_discount)),
        ("out of sample", F.col("in_test_set") == 1),
    ]


def select_gems(joined: DataFrame, min_rate=MIN_POSITIVE_RATE, min_discount=MIN_DISCOUNT):
    """Listings that meet every criterion, with their discount, unordered."""
    for _, condition in criteria(min_rate, min_discount):
        joined = joined.filter(condition)
    return joined.select(
        "listing_id",
        "is_hidden",
        "positive_rate",
        "price_clean",
        "predicted_price",
        (1 - F.col("price_clean") / F.col("predicted_price")).alias("discount_pct"),
        "in_test_set",
    )


def find_gems(
    flags, rates, predictions, min_rate=MIN_POSITIVE_RATE, min_discount=MIN_DISCOUNT
) -> DataFrame:
    """Biggest discount first, ties by id."""
    found = select_gems(join_signals(flags, rates, predictions), min_rate, min_discount)
    return found.orderBy(F.desc("discount_pct"), "listing_id")


def funnel(joined: DataFrame, stages=None) -> DataFrame:
    """(ord, stage, n, pct_of_base, retention_pct), one pass over the data.

    `retention_pct` is the share of the stage before, NULL for the first.
    """
    stages = criteria() if stages is None else stages
    passed, counts = F.lit(True), [F.count("*").alias("_c0")]
    for i, (_, condition) in enumerate(stages, start=1):
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(passed).alias(f"_c{i}"))
    names = ["evaluable", *[name for name, _ in stages]]
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("ord"), F.lit(name).alias("stage"), F.col(f"_c{i}").alias("n")
            )
            for i, name in enumerate(names)
        ]
    )
    table = joined.agg(*counts).select("_c0", F.inline(cells))
    before = F.lag("n").over(Window.partitionBy("_c0").orderBy("ord"))
    return table.select(
        "ord",
        "stage",
        "n",
        (F.col("n") * 100.0 / F.nullif(F.col("_c0"), F.lit(0))).alias("pct_of_base"),
        (F.col("n") * 100.0 / F.nullif(before, F.lit(0))).alias("retention_pct"),
    )
