"""Raw listing export -> typed, priced, reviewed listings."""

from pyspark.sql import DataFrame, functions as F

from valuescout.constants import AMENITY_PATTERNS, LISTING_COLUMNS, NUMERIC_COLUMNS
from valuescout.functions.amenities import amenities_count, amenity_flags, parse_amenities
from valuescout.functions.values import (
    log_price,
    parse_bathrooms,
    parse_price,
    tenure_years,
    to_date,
    to_number,
    truthy,
)
from valuescout.operators.rows import dedupe_first, distinct_ids, keep_members, missing_rates

DERIVED = ("amenities_count", "bathrooms_num", "host_years", *AMENITY_PATTERNS)


def price_listings(df: DataFrame) -> DataFrame:
    """Add `price_clean` and `log_price`, keep rows with a positive price."""
    df = df.withColumn("price_clean", parse_price("price")).filter(F.col("price_clean") > 0)
    return df.withColumn("log_price", log_price("price_clean"))


def derive_features(df: DataFrame, patterns=AMENITY_PATTERNS) -> DataFrame:
    """Amenity counts and flags, bathrooms, tenure, 0/1 flags, dates, numbers."""
    df = df.withColumn("_labels", parse_amenities("amenities"))
    df = df.withColumn("bathrooms_num", parse_bathrooms("bathrooms", "bathrooms_text"))
    flags = [
        truthy("host_is_superhost").alias("host_is_superhost_flag"),
        truthy("instant_bookable").alias("instant_bookable_flag"),
    ]
    df = df.select(
        "*",
        amenities_count("_labels").alias("amenities_count"),
        *amenity_flags("_labels", patterns),
        tenure_years("host_since", "last_scraped").alias("host_years"),
        *flags,
    ).drop("_labels")
    typed = {c: to_number(c) for c in NUMERIC_COLUMNS}
    typed |= {c: to_date(c) for c in ("first_review", "last_review")}
    return df.withColumns(typed)


def clean_listings(raw: DataFrame, reviews: DataFrame, order=None) -> DataFrame:
    """One row per listing that has a price and at least one cleaned review.

    `order` names the column that ranks duplicate rows of one id; without it
    their other columns do, so that one row per id is left in any case. Price
    test and semi join come before the feature work, which then runs on
    survivors.
    """
    if order is None:
        rest = [c for c in raw.columns if c != "id"]
        raw = dedupe_first(raw.withColumn("_order", F.struct(*rest)), "id", "_order")
    else:
        raw = dedupe_first(raw, "id", order)
    reviewed = distinct_ids(reviews, "listing_id").withColumnRenamed("listing_id", "id")
    kept = keep_members(price_listings(raw), reviewed, "id")
    return derive_features(kept).select(*LISTING_COLUMNS)


def listing_report(cleaned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(number of neighbourhoods), (missing rate per derived column)."""
    areas = cleaned.agg(F.countDistinct("neighbourhood_cleansed").alias("n_neighbourhoods"))
    return areas, missing_rates(cleaned, DERIVED)
