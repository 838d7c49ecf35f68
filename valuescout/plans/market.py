"""The whole study: two raw CSV exports in, result tables out."""

from pyspark.sql import SparkSession, functions as F

from valuescout.constants import CLOUD_PHRASES, CLUSTER_VARIABLES, FINAL_K, MIN_DISCOUNT, MIN_POSITIVE_RATE, TOP_PHRASES
from valuescout.dictionaries import LOCATION_THEME, lemma_dictionary, sentiment_lexicon, tag_dictionary
from valuescout.operators.funnel import criteria, funnel, join_signals, select_gems
from valuescout.operators.profile import cluster_z
from valuescout.operators.segments import cluster_means
from valuescout.operators.phrases import phrase_ratio, phrase_weights, theme_share, top_phrases
from valuescout.plans.listings import clean_listings, listing_report
from valuescout.plans.phrases import group_phrases, group_sizes, in_language
from valuescout.plans.pricing import fair_price
from valuescout.plans.reviews import clean_reviews, exposure_and_rate, listing_facts, score_reviews
from valuescout.plans.segments import enrich, profile_segments, segment, validate_segments
from valuescout.session import spread
from valuescout.sources.csv import clean_na, scan_csv_text, with_file_order
from valuescout.sources.schemas import RAW_LISTING_COLUMNS
from valuescout.sources.sinks import save_model, write_csv, write_table
from valuescout.sources.split_csv import scan_csv_split


def run_market(
    spark: SparkSession,
    listings_path,
    reviews_path,
    out,
    year=2025,
    lexicon=None,
    tag_dict=None,
    lemma_dict=None,
    min_rate=MIN_POSITIVE_RATE,
    min_discount=MIN_DISCOUNT,
    segment_settings=None,
    tree=None,
    language_profile=None,
    language="en",
    multiline=True,
):
    """Every stage is written as a table under `out`, and the next one reads
    that table: a lost executor never repeats more than one stage.

    `language_profile` (see `langid_fit`) keeps the reviews found to be in
    `language` for the phrases; without one all reviews count. Where no cell
    of the exports breaks a line, `multiline=False` saves the search for the
    ends of records.
    """
    lexicon = sentiment_lexicon(spark) if lexicon is None else lexicon
    tag_dict = tag_dictionary(spark) if tag_dict is None else tag_dict
    lemma_dict = lemma_dictionary(spark) if lemma_dict is None else lemma_dict

    def stage(df, name):
        write_table(df, f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    columns = ["listing_id", "id", "date", "comments"]
    if multiline:
        raw_reviews = scan_csv_split(spark, reviews_path, columns)
    else:
        raw_reviews = spread(scan_csv_text(spark, reviews_path, columns, multiline=False))
    reviews = stage(clean_reviews(raw_reviews, year), "reviews_clean")
    scored = stage(score_reviews(reviews, lexicon), "reviews_scored")
    facts = stage(listing_facts(scored), "listing_facts")

    if multiline:
        raw = scan_csv_split(spark, listings_path, RAW_LISTING_COLUMNS, order="_file_order")
    else:
        raw = spark.read.option("header", True).option("escape", '"').csv(listings_path)
        raw = clean_na(with_file_order(raw).select(*RAW_LISTING_COLUMNS, "_file_order"))
    listings = stage(clean_listings(raw, reviews, "_file_order"), "listings_clean")
    areas, missing = listing_report(listings)
    write_table(areas, f"{out}/listing_areas")
    write_table(missing, f"{out}/listing_missing")

    price = fair_price(listings, **(tree or {}))
    predictions = stage(price.predictions, "predictions")
    write_table(price.metrics, f"{out}/price_metrics")
    write_table(price.importances, f"{out}/importances")
    save_model(price.model, f"{out}/price_model")

    joined = join_signals(*exposure_and_rate(facts), predictions)
    gems = stage(select_gems(joined, min_rate, min_discount), "gems")
    write_csv(gems.orderBy(F.desc("discount_pct"), "listing_id"), f"{out}/gems_csv")
    write_table(funnel(joined, criteria(min_rate, min_discount)), f"{out}/funnel")

    found = segment(enrich(gems, listings, predictions), **(segment_settings or {}))
    write_table(found.elbow, f"{out}/elbow")
    write_table(found.centroids, f"{out}/centroids")
    for k, assigned in found.assignments.items():
        write_table(assigned, f"{out}/assignments_k{k}")
        write_table(cluster_means(spark.read.parquet(f"{out}/assignments_k{k}"), CLUSTER_VARIABLES), f"{out}/means_k{k}")
    chosen = FINAL_K if FINAL_K in found.assignments else max(found.assignments)
    assigned = stage(found.assignments[chosen], "assignments")
    write_table(cluster_z(assigned, CLUSTER_VARIABLES), f"{out}/cluster_z")
    write_table(validate_segments(assigned), f"{out}/external_validation")
    write_table(profile_segments(found, chosen), f"{out}/profile")

    spoken = in_language(reviews, language_profile, language)
    spoken = stage(spoken, "reviews_spoken") if language_profile is not None else spoken
    counts = stage(group_phrases(spoken, gems, tag_dict, lemma_dict), "phrase_counts")
    write_table(top_phrases(counts, "group", TOP_PHRASES), f"{out}/phrases")
    write_table(phrase_weights(counts, "group", CLOUD_PHRASES), f"{out}/phrase_weights")
    sizes = group_sizes(spoken, gems)
    write_table(phrase_ratio(counts, sizes, "group", "in", "out"), f"{out}/phrase_ratio")
    write_table(theme_share(counts, "group", LOCATION_THEME), f"{out}/theme_share")
