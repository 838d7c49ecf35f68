"""Small default dictionaries, as DataFrames.

Each one is only a starting point: every operator takes the dictionary as an
input table, so a full lexicon can be passed instead. As local tables their size
is known to the planner, which copies small ones to all tasks; others are joined
by shuffle.
"""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Word -> valence on the -4..4 scale of rated sentiment lexicons.
VALENCE = {
    "amazing": 2.8, "awesome": 3.1, "beautiful": 2.9, "best": 3.2,
    "brilliant": 2.8, "charming": 2.8, "clean": 1.7, "comfortable": 1.6,
    "convenient": 1.4, "cozy": 1.7, "delightful": 2.8, "easy": 1.9,
    "enjoy": 2.2, "enjoyed": 2.3, "excellent": 2.7, "fantastic": 2.6,
    "fine": 0.8, "friendly": 2.2, "fun": 2.3, "generous": 2.3, "good": 1.9,
    "great": 3.1, "happy": 2.7, "helpful": 1.8, "kind": 2.4, "like": 1.5,
    "love": 3.2, "loved": 2.9, "lovely": 2.8, "nice": 1.8, "outstanding": 3.0,
    "perfect": 2.7, "perfectly": 3.2, "pleasant": 2.3, "recommend": 1.5,
    "recommended": 0.8, "relaxing": 2.2, "safe": 1.9, "satisfied": 1.8,
    "spacious": 1.2, "spectacular": 2.6, "spotless": 1.6, "stunning": 1.6,
    "super": 2.9, "superb": 3.1, "thank": 1.5, "thanks": 1.9, "warm": 0.9,
    "welcome": 2.0, "welcoming": 1.9, "wonderful": 2.7, "worth": 0.9,
    "annoying": -1.7, "avoid": -1.2, "awful": -2.0, "bad": -2.5,
    "broken": -2.1, "complain": -1.5, "damp": -0.8, "dangerous": -2.1,
    "dirty": -1.9, "disappointed": -2.1, "disappointing": -2.2,
    "disgusting": -2.4, "fake": -2.1, "filthy": -2.3, "gross": -2.1,
    "hate": -2.7, "horrible": -2.5, "idiot": -2.3, "lack": -1.3, "lost": -1.3,
    "mess": -1.5, "mistake": -1.4, "noisy": -0.7, "nightmare": -2.3,
    "pathetic": -2.7, "poor": -2.1, "problem": -1.7, "problems": -1.7,
    "rude": -2.0, "sad": -2.1, "scam": -2.7, "smelly": -1.4, "stupid": -2.4,
    "terrible": -2.1, "trash": -1.5, "ugly": -2.3, "uncomfortable": -1.6,
    "unfortunately": -1.4, "unpleasant": -2.1, "unsafe": -1.9,
    "useless": -1.8, "worst": -3.1, "worthless": -1.9, "wrong": -2.1,
}

# Degree words; 1 strengthens what follows, -1 weakens it.
DEGREE = {
    "absolutely": 1, "amazingly": 1, "completely": 1, "especially": 1,
    "exceptionally": 1, "extremely": 1, "highly": 1, "incredibly": 1,
    "more": 1, "most": 1, "particularly": 1, "quite": 1, "really": 1,
    "remarkably": 1, "so": 1, "totally": 1, "truly": 1, "unbelievably": 1,
    "very": 1, "almost": -1, "barely": -1, "hardly": -1, "less": -1,
    "little": -1, "marginally": -1, "partly": -1, "scarcely": -1,
    "slightly": -1, "somewhat": -1,
}

# Words that turn the sentiment of what follows.
NEGATORS = (
    "ain't", "aren't", "can't", "cannot", "couldn't", "didn't", "doesn't",
    "don't", "hadn't", "hasn't", "haven't", "isn't", "neither", "never",
    "no", "nobody", "none", "nor", "not", "nothing", "nowhere", "shouldn't",
    "wasn't", "weren't", "without", "won't", "wouldn't",
)

# Word -> tag. Words not listed are tagged by their ending.
ADJECTIVES = (
    "amazing", "authentic", "bad", "beautiful", "best", "better", "big",
    "bright", "central", "charming", "cheap", "clean", "close", "clear",
    "comfortable", "convenient", "cool", "cosy", "cozy", "dirty", "easy",
    "excellent", "fantastic", "friendly", "full", "fresh", "good", "great",
    "helpful", "high", "hot", "huge", "ideal", "kind", "large", "little",
    "local", "long", "lovely", "main", "many", "modern", "near", "new",
    "nice", "noisy", "old", "perfect", "pleasant", "public", "quick", "quiet",
    "responsive", "safe", "short", "small", "special", "strategic", "super",
    "sweet", "tiny", "warm", "wonderful", "worst",
)
NOUNS = (
    "access", "advice", "air", "airport", "area", "attraction", "balcony",
    "bathroom", "bed", "bedroom", "breakfast", "building", "bus", "check",
    "city", "coffee", "communication", "distance", "door", "experience",
    "family", "floor", "food", "home", "hospitality", "house", "kitchen",
    "location", "market", "metro", "minute", "morning", "neighborhood",
    "neighbourhood", "night", "noise", "parking", "people", "person", "price",
    "restaurant", "service", "shop", "shower", "space", "spot", "station",
    "stop", "store", "street", "supermarket", "terrace", "thing", "time",
    "tip", "train", "transport", "transportation", "value", "view", "walk",
    "water", "way", "week", "window", "wine",
)
OTHERS = (
    "also", "always", "around", "arrived", "asked", "came", "could", "even",
    "ever", "every", "everything", "felt", "found", "gave", "get", "give",
    "given", "got", "however", "just", "know", "left", "liked", "made",
    "make", "many", "may", "might", "much", "must", "need", "never", "often",
    "quite", "really", "said", "see", "shall", "since", "something", "still",
    "take", "though", "told", "took", "two", "three", "use", "used", "want",
    "went", "without", "would", "yet",
)

# Endings that tell the tag of an unlisted word, first hit wins.
ENDINGS = (
    ("ly", "OTHER"), ("ed", "OTHER"),
    ("ble", "ADJ"), ("ful", "ADJ"), ("ous", "ADJ"), ("ive", "ADJ"),
    ("tion", "NOUN"), ("ness", "NOUN"), ("ment", "NOUN"), ("ing", "NOUN"),
)

# Irregular base forms, (word, tag) -> lemma.
LEMMAS = {
    ("better", "ADJ"): "good", ("best", "ADJ"): "best",
    ("bigger", "ADJ"): "big", ("biggest", "ADJ"): "big",
    ("cheaper", "ADJ"): "cheap", ("closer", "ADJ"): "close",
    ("easier", "ADJ"): "easy", ("larger", "ADJ"): "large",
    ("nicer", "ADJ"): "nice", ("smaller", "ADJ"): "small",
    ("worse", "ADJ"): "bad", ("worst", "ADJ"): "bad",
    ("children", "NOUN"): "child", ("feet", "NOUN"): "foot",
    ("knives", "NOUN"): "knife", ("lives", "NOUN"): "life",
    ("men", "NOUN"): "man", ("people", "NOUN"): "people",
    ("wives", "NOUN"): "wife", ("women", "NOUN"): "woman",
    ("buses", "NOUN"): "bus", ("news", "NOUN"): "news",
    ("stairs", "NOUN"): "stair", ("towels", "NOUN"): "towel",
}

# Words that mark a phrase as being about the location.
LOCATION_THEME = (
    "access", "area", "attraction", "bus", "center", "centre", "city",
    "distance", "location", "metro", "neighborhood", "neighbourhood",
    "station", "street", "transport", "transportation", "walk",
)


def tag_rows(adjectives=ADJECTIVES, nouns=NOUNS, others=OTHERS):
    """(word, tag); a word in several lists takes the first."""
    tags = {}
    for words, tag in ((adjectives, "ADJ"), (nouns, "NOUN"), (others, "OTHER")):
        for word in words:
            tags.setdefault(word, tag)
    return list(tags.items())


def lemma_rows(lemmas=LEMMAS):
    return [(word, tag, lemma) for (word, tag), lemma in lemmas.items()]


def _local(spark, rows, names) -> DataFrame:
    """A table the planner knows the size of, unlike one built from a list."""
    return spark.createDataFrame(pa.table(dict(zip(names, map(list, zip(*rows))))))


def sentiment_lexicon(spark: SparkSession) -> DataFrame:
    return _local(spark, VALENCE.items(), ("word", "valence"))


def tag_dictionary(spark: SparkSession) -> DataFrame:
    return _local(spark, tag_rows(), ("word", "tag"))


def lemma_dictionary(spark: SparkSession) -> DataFrame:
    return _local(spark, lemma_rows(), ("word", "tag", "lemma"))
