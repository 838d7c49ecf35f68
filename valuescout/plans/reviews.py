"""Raw reviews -> cleaned -> scored -> per-listing facts."""

from pyspark.sql import DataFrame, functions as F

from valuescout.constants import POSITIVE_THRESHOLD
from valuescout.functions.text import looks_english, meaningful, normalize_text
from valuescout.functions.values import in_year, to_date
from valuescout.operators.exposure import low_exposure, review_facts
from valuescout.operators.rows import audit, evaluate_once
from valuescout.operators.sentiment import add_score


def _steps(year):
    return [
        (f"dated {year}", in_year("date", year)),
        ("meaningful text", meaningful("comments_clean")),
        ("looks English", looks_english("comments_clean")),
    ]


def clean_reviews(df: DataFrame, year, date="date", text="comments") -> DataFrame:
    """Reviews of one year with readable English text, plus `comments_clean`.

    The same function serves batch and stream: filters and projections only.
    The cheap date test comes first, so the text is touched for few rows.
    """
    df = df.withColumn(date, to_date(date)).filter(in_year(date, year))
    df = evaluate_once(df, "comments_clean", normalize_text(text))
    return df.filter(meaningful("comments_clean")).filter(looks_english("comments_clean"))


def cleaning_audit(df: DataFrame, year, date="date", text="comments") -> DataFrame:
    """(ord, step, n_rows, n_dropped) of `clean_reviews`."""
    dated = df.select(to_date(date).alias("date"), text)
    wanted = F.when(in_year("date", year), normalize_text(text))
    prepared = evaluate_once(dated, "comments_clean", wanted)
    return audit(prepared, _steps(year))


def score_reviews(cleaned: DataFrame, lexicon, text="comments_clean") -> DataFrame:
    """Cleaned reviews with `sentiment_vader` right after the text."""
    return add_score(cleaned, text, lexicon)


def listing_facts(scored: DataFrame, listing="listing_id", threshold=POSITIVE_THRESHOLD) -> DataFrame:
    """(listing_id, review_count, positive_rate, is_hidden) of scored reviews:
    only ids and scores are shuffled, never the text."""
    return low_exposure(review_facts(scored, listing, "sentiment_vader", threshold))


def exposure_and_rate(facts: DataFrame):
    """The two per-listing tables that the search for gems takes."""
    flags = facts.select("listing_id", F.col("is_hidden"))
    rates = facts.select("listing_id", F.col("positive_rate"))
    return flags, rates
