"""What reviewers of two groups of listings say."""

from pyspark.sql import DataFrame, functions as F

from valuescout.operators import phrases as ops
from valuescout.operators.exposure import review_counts
from valuescout.operators.langid import keep_language, langid_model
from valuescout.operators.rows import keep_valid_ids, split_groups


def in_language(
    reviews: DataFrame, profile: DataFrame | None, language="en", text="comments_clean"
) -> DataFrame:
    """Reviews with a valid listing id; with a language `profile` only those
    found to be in `language` (runs one small job)."""
    reviews = keep_valid_ids(reviews, "listing_id")
    return reviews if profile is None else keep_language(reviews, text, langid_model(profile), language)


def group_phrases(
    reviews: DataFrame, ids: DataFrame, tag_dict, lemma_dict, review_key="id", text="comments_clean"
) -> DataFrame:
    """(group, phrase, count) for listings in `ids` ("in") and all others
    ("out"), from one pass over the reviews."""
    grouped = split_groups(reviews, ids, "listing_id", spread_by=review_key)
    return ops.phrase_counts(grouped, "group", text, tag_dict, lemma_dict)


def contrast_phrases(
    reviews: DataFrame,
    ids: DataFrame,
    tag_dict: DataFrame,
    lemma_dict: DataFrame,
    review_key="id",
    text="comments_clean",
    profile: DataFrame | None = None,
    language="en",
    top=10,
) -> DataFrame:
    """(group, phrase, count, rank): the most frequent phrases of each group."""
    spoken = in_language(reviews, profile, language, text)
    counts = group_phrases(spoken, ids, tag_dict, lemma_dict, review_key, text)
    return ops.top_phrases(counts, "group", top)


def group_sizes(reviews: DataFrame, ids: DataFrame) -> DataFrame:
    """(group, n_reviews), counted per listing before the groups are known."""
    grouped = split_groups(review_counts(reviews), ids, "listing_id")
    return grouped.groupBy("group").agg(F.sum("review_count").alias("n_reviews"))
