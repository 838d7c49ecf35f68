"""Explicit schemas: ids are strings everywhere and nothing is inferred."""

from pyspark.sql import types as T

from valuescout.constants import LISTING_COLUMNS

# The raw listing columns that are read; the export has more.
RAW_LISTING_COLUMNS = (
    "id", "name", "host_id", "host_name", "latitude", "longitude",
    "neighbourhood_cleansed", "property_type", "room_type", "accommodates",
    "bedrooms", "beds", "bathrooms", "bathrooms_text", "amenities",
    "minimum_nights", "maximum_nights", "instant_bookable", "host_since",
    "host_is_superhost", "host_identity_verified",
    "host_total_listings_count", "calculated_host_listings_count", "price",
    "number_of_reviews", "number_of_reviews_ltm", "reviews_per_month",
    "review_scores_rating", "review_scores_location", "review_scores_value",
    "first_review", "last_review", "availability_365", "last_scraped",
)


def text_schema(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _schema(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# The columns of the tables that the stages hand on, and their types.
_S, _D, _I = T.StringType(), T.DoubleType(), T.IntegerType()

RAW_REVIEWS = text_schema(("listing_id", "id", "date", "reviewer_id", "reviewer_name", "comments"))

SCORED_REVIEWS = _schema(
    listing_id=_S, id=_S, date=T.DateType(), reviewer_id=_S, reviewer_name=_S,
    comments=_S, comments_clean=_S, sentiment_vader=_D,
)
POSITIVE_RATE = _schema(listing_id=_S, positive_rate=_D)
HIDDEN_FLAG = _schema(listing_id=_S, is_hidden=_I)
PREDICTIONS = _schema(
    id=_S, price_clean=_D, log_price=_D, predicted_log_price=_D, predicted_price=_D,
    residual=_D, in_test_set=_I,
)
FINDS = _schema(
    listing_id=_S, is_hidden=_I, positive_rate=_D, price_clean=_D, predicted_price=_D,
    discount_pct=_D, in_test_set=_I,
)

# The text columns of cleaned listings.
_TEXT = {
    "id", "name", "host_id", "host_name", "neighbourhood_cleansed", "property_type",
    "room_type", "bathrooms_text", "instant_bookable", "host_since", "host_is_superhost",
    "host_identity_verified", "price",
}
_DATE = {"first_review", "last_review"}


def _listing_type(name):
    if name in _TEXT:
        return T.StringType()
    if name in _DATE:
        return T.DateType()
    if name == "amenities_count" or name.startswith("has_") or name.endswith("_flag"):
        return T.IntegerType()
    return T.DoubleType()


CLEAN_LISTINGS = T.StructType([T.StructField(c, _listing_type(c)) for c in LISTING_COLUMNS])
