import math
import re

from valuescout.dictionaries import DEGREE, NEGATORS, VALENCE, sentiment_lexicon
from valuescout.operators.sentiment import add_score

TEXTS = [
    "Great place!", "The place was good.", "The place was not good.", "VERY good, really clean",
    "The GOOD host", "GOOD HOST", "Nice room but terrible smell", "slightly dirty", "", "   ", None,
    "no hits here", "Isn't it great?? Is it? Really???", "good good good!!!!!!!!", "never really very bad",
    "but good", "extremely extremely extremely wonderful", "It's a butler, good",
    "I would not say it was the best stay BUT we loved the perfect location",
]


def expected(text):
    """The published rules, word by word."""
    text = text or ""
    words = re.findall(r"[A-Za-z']+", text)
    lower = [w.lower() for w in words]
    mixed = re.search("[a-z]", text) is not None
    but = lower.index("but") if "but" in lower else None
    total = 0.0
    for i, word in enumerate(lower):
        if word not in VALENCE:
            continue
        sign = 1 if VALENCE[word] > 0 else -1
        score = VALENCE[word]
        if mixed and len(word) > 1 and words[i].isupper():
            score += 0.733 * sign
        negations = 0
        for distance, weight in ((1, 1.0), (2, 0.95), (3, 0.9)):
            if i - distance >= 0:
                before = lower[i - distance]
                score += DEGREE.get(before, 0) * 0.293 * weight * sign
                negations += before in NEGATORS
        score *= (-0.74) ** negations
        if but is not None:
            score *= 0.5 if i < but else 1.5
        total += score
    asks = text.count("?")
    stress = min(text.count("!"), 4) * 0.292 + (0 if asks < 2 else asks * 0.18 if asks <= 3 else 0.96)
    total += stress * (total > 0) - stress * (total < 0)
    return total / math.sqrt(total * total + 15)


def test_rules(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").repartition(3)
    got = {r["id"]: r["sentiment_vader"] for r in
           add_score(df, "text", sentiment_lexicon(spark)).collect()}
    assert set(got) == set(range(len(TEXTS)))
    for i, text in enumerate(TEXTS):
        assert abs(got[i] - expected(text)) <= 5.1e-5, (text, got[i], expected(text))
    assert got[TEXTS.index("")] == 0.0 and got[TEXTS.index("no hits here")] == 0.0


def test_column_order(spark):
    df = spark.createDataFrame([(1, "a", "good", "z"), (2, "b", None, "z")], "id int, x string, t string, y string")
    scored = add_score(df, "t", sentiment_lexicon(spark))
    assert scored.columns == ["id", "x", "t", "sentiment_vader", "y"]
    assert {r["id"]: r["sentiment_vader"] > 0 for r in scored.collect()} == {1: True, 2: False}


def test_words_stay_whole_texts(spark):
    """A hit at the very end of a long text counts."""
    df = spark.createDataFrame([(1, "word " * 50000 + "wonderful")], "id int, t string")
    score = add_score(df, "t", sentiment_lexicon(spark)).first()["sentiment_vader"]
    assert score > 0.5


def test_copies_are_counted(spark):
    """Copies of one review, more than a third of all rows, each count."""
    from valuescout.operators.exposure import review_facts
    rows = [("7", "1", "good place")] * 40 + [("7", "2", "bad"), ("7", "3", ""), ("8", "4", "good"), ("8", "4", "bad")]
    df = spark.createDataFrame(rows, "listing_id string, id string, t string").repartition(5)
    scores = add_score(df, "t", sentiment_lexicon(spark)).cache()
    good = [r for r in scores.collect() if r["t"] == "good place"]
    assert scores.count() == 44 and len(good) == 40
    assert all(round(r["sentiment_vader"] - expected("good place"), 4) == 0 for r in good)
    facts = {r["listing_id"]: (r["review_count"], r["positive_rate"])
             for r in review_facts(scores, threshold=0.4).collect()}
    assert facts == {"7": (42, 40 / 42), "8": (2, 0.5)}


def test_scores_are_made_in_place(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = add_score(df, "text", sentiment_lexicon(spark))._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan") :]
    assert "Exchange" not in physical and "Join" not in physical and "Python" not in physical


def test_a_near_word_of_the_lexicon_neither_strengthens_nor_negates(spark):
    df = spark.createDataFrame([(1, "not good"), (2, "very good"), (3, "good")], "id int, t string")
    full = spark.createDataFrame([("good", 1.9), ("not", 0.0), ("very", 0.0)], "word string, valence double")
    got = {r["id"]: r["sentiment_vader"] for r in add_score(df, "t", full).collect()}
    assert got[1] == got[2] == got[3] > 0
    few = {r["id"]: r["sentiment_vader"] for r in add_score(df, "t", full.filter("word = 'good'")).collect()}
    assert few[1] < 0 < few[3] < few[2]
