"""Column lists, word lists, patterns and default thresholds.

Everything here is a default for some parameter; callers may pass their own.
"""

# Text tokens that count as a missing value in a CSV cell.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Amenity flag -> pattern, matched case-insensitively per label.
AMENITY_PATTERNS = {
    "has_wifi": r"wifi",
    "has_kitchen": r"kitchen",
    "has_air_conditioning": r"air conditioning",
    "has_tv": r"\btv\b|hdtv",
    "has_elevator": r"elevator",
    "has_washer": r"\bwasher\b",
    "has_dishwasher": r"dishwasher",
    "has_free_parking": r"free .*parking",
}

# Spellings of "true" in a text flag.
TRUTHY = ("t", "true", "yes", "1")

# Common words, one of which marks a text as English.
COMMON_ENGLISH_WORDS = (
    "the", "and", "is", "in", "it", "this", "that", "was", "for", "with",
    "room", "place", "great", "host", "nice", "good", "very", "clean",
    "helpful", "stay", "location",
)

# Nouns and adjectives that carry no meaning in this domain.
DOMAIN_NOISE_WORDS = (
    "rome", "roma", "italy", "italian", "apartment", "apt", "flat", "host",
    "hosts", "stay", "stayed", "airbnb", "room", "rooms", "place", "trip",
    "vacation", "holiday",
)

# English function words that never belong to a phrase.
ENGLISH_STOPWORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you",
    "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "her", "hers", "herself", "it", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this",
    "that", "these", "those", "am", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "having", "do", "does", "did", "doing",
    "a", "an", "the", "and", "but", "if", "or", "because", "as", "until",
    "while", "of", "at", "by", "for", "with", "about", "against", "between",
    "into", "through", "during", "before", "after", "above", "below", "to",
    "from", "up", "down", "in", "out", "on", "off", "over", "under", "again",
    "further", "then", "once", "here", "there", "when", "where", "why", "how",
    "all", "any", "both", "each", "few", "more", "most", "other", "some",
    "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too",
    "very", "s", "t", "can", "will", "just", "don", "should", "now", "d",
    "ll", "m", "o", "re", "ve", "y", "ain", "aren", "couldn", "didn",
    "doesn", "hadn", "hasn", "haven", "isn", "ma", "mightn", "mustn",
    "needn", "shan", "shouldn", "wasn", "weren", "won", "wouldn",
)

# Raw listing columns that must become numbers.
NUMERIC_COLUMNS = (
    "latitude", "longitude", "accommodates", "bedrooms", "beds", "bathrooms",
    "minimum_nights", "maximum_nights", "host_total_listings_count",
    "calculated_host_listings_count", "number_of_reviews",
    "number_of_reviews_ltm", "reviews_per_month", "review_scores_rating",
    "review_scores_location", "review_scores_value", "availability_365",
)

# Column order of the cleaned listings table.
LISTING_COLUMNS = (
    "id", "name", "host_id", "host_name",
    "latitude", "longitude", "neighbourhood_cleansed",
    "property_type", "room_type", "accommodates", "bedrooms", "beds",
    "bathrooms", "bathrooms_text", "bathrooms_num", "amenities_count",
    *AMENITY_PATTERNS,
    "minimum_nights", "maximum_nights", "instant_bookable",
    "instant_bookable_flag",
    "host_since", "host_years", "host_is_superhost", "host_is_superhost_flag",
    "host_identity_verified", "host_total_listings_count",
    "calculated_host_listings_count",
    "price", "price_clean", "log_price",
    "number_of_reviews", "number_of_reviews_ltm", "reviews_per_month",
    "review_scores_rating", "review_scores_location", "review_scores_value",
    "first_review", "last_review", "availability_365",
)

# Features of the fair-price model, all structural.
PRICE_NUMERIC_FEATURES = (
    "accommodates", "bedrooms", "beds", "bathrooms_num", "amenities_count",
    *AMENITY_PATTERNS,
    "latitude", "longitude", "minimum_nights", "maximum_nights",
    "instant_bookable_flag", "host_years", "host_is_superhost_flag",
    "calculated_host_listings_count",
)
PRICE_CATEGORICAL_FEATURES = ("room_type", "neighbourhood_cleansed", "property_type")

# Popularity and price columns that may never become features.
PRICE_EXCLUDED = (
    "review_scores_rating", "review_scores_accuracy",
    "review_scores_cleanliness", "review_scores_checkin",
    "review_scores_communication", "review_scores_location",
    "review_scores_value", "number_of_reviews", "number_of_reviews_ltm",
    "number_of_reviews_l30d", "number_of_reviews_ly", "reviews_per_month",
    "first_review", "last_review", "estimated_occupancy_l365d",
    "estimated_revenue_l365d", "availability_30", "availability_60",
    "availability_90", "availability_365", "price", "price_clean",
    "log_price",
)

# Segmentation variables, profile variables, external variables.
CLUSTER_VARIABLES = ("latitude", "longitude", "accommodates", "bedrooms", "amenities_count")
PROFILE_VARIABLES = ("room_type", "neighbourhood_cleansed", "number_of_reviews", "property_type")
EXTERNAL_VARIABLES = ("price_tertile", "room_type", "discount_tertile")

# Default thresholds and model settings.
POSITIVE_THRESHOLD = 0.5
MIN_POSITIVE_RATE = 0.75
MIN_DISCOUNT = 0.15
PROPERTY_TYPES_KEPT = 15
TREE_MAX_DEPTH = 8
TREE_MIN_LEAF = 20
SPLIT_SEED = 42
TRAIN_BUCKETS = 5
CLUSTER_KS = (1, 2, 3, 4, 5, 6, 7)
FINAL_K = 4
KMEANS_RESTARTS = 10
KMEANS_MAX_ITER = 300
KMEANS_TOL = 1e-4
BASELINE_SHUFFLES = 1000
Z_CAP = 1.5
PRICE_VIEW = (20.0, 2000.0)
TOP_PHRASES = 10
CLOUD_PHRASES = 100
