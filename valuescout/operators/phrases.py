"""Adjective-noun phrases: tagging, windows, counts, contrasts."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from valuescout.constants import CLOUD_PHRASES, DOMAIN_NOISE_WORDS, ENGLISH_STOPWORDS, TOP_PHRASES
from valuescout.dictionaries import ENDINGS
from valuescout.functions.text import tokens, valid_word

STOPWORDS = (*ENGLISH_STOPWORDS, *DOMAIN_NOISE_WORDS)


def ending_tag(word: Column, endings=ENDINGS, default="NOUN") -> Column:
    """Tag of a word that no dictionary lists; marks are never part of a phrase."""
    tag = F.when(~word.rlike("[a-z]"), "OTHER")
    for ending, value in endings:
        tag = tag.when(word.endswith(ending), value)
    return tag.otherwise(default)


def noun_lemma(word: Column) -> Column:
    """Regular plurals to singular; short words and -ss, -us, -is stay."""
    stay = (F.length(word) < 4) | word.rlike("(ss|us|is)$") | ~word.endswith("s")
    return (
        F.when(stay, word)
        .when(word.endswith("ies"), F.concat(F.regexp_replace(word, "ies$", ""), F.lit("y")))
        .when(word.rlike("(ss|x|z|ch|sh)es$"), F.regexp_replace(word, "es$", ""))
        .otherwise(F.regexp_replace(word, "s$", ""))
    )


def word_table(tag_dict: DataFrame, lemma_dict: DataFrame) -> DataFrame:
    """(word, tag, adj_lemma, noun_lemma): one row per listed word."""
    none = F.lit(None).cast("string")
    tags = tag_dict.select("word", "tag", none.alias("a"), none.alias("n"))
    lemmas = lemma_dict.select(
        "word",
        none.alias("tag"),
        F.when(F.col("tag") == "ADJ", F.col("lemma")).alias("a"),
        F.when(F.col("tag") == "NOUN", F.col("lemma")).alias("n"),
    )
    both = tags.unionByName(lemmas).groupBy("word")
    return both.agg(
        F.max("tag").alias("tag"), F.max("a").alias("adj_lemma"), F.max("n").alias("noun_lemma")
    )


def tag_tokens(df: DataFrame, keys, text, tag_dict: DataFrame) -> DataFrame:
    """(keys, pos, token, tag) for every token of every text."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    laid_out = df.select(*keys, F.posexplode(tokens(text)).alias("pos", "token"))
    word = F.lower("token")
    joined = laid_out.withColumn("_w", word).join(
        tag_dict.select(F.col("word").alias("_w"), "tag"), "_w", "left"
    )
    tag = F.coalesce("tag", ending_tag(F.col("_w")))
    return joined.select(*keys, "pos", "token", tag.alias("tag"))


def lemmatize(df: DataFrame, lemma_dict: DataFrame, word="token", tag="tag") -> DataFrame:
    """Add `lemma`: the listed base form, else the regular singular of nouns."""
    listed = lemma_dict.select(
        F.col("word").alias("_w"), F.col("tag").alias("_t"), F.col("lemma").alias("_l")
    )
    lower = F.lower(word)
    joined = df.join(listed, (lower == F.col("_w")) & (F.col(tag) == F.col("_t")), "left")
    regular = F.when(F.col(tag) == "NOUN", noun_lemma(lower)).otherwise(lower)
    return joined.withColumn("lemma", F.coalesce("_l", regular)).drop("_w", "_t", "_l")


def phrase_windows(df: DataFrame, by, text, stopwords=STOPWORDS) -> DataFrame:
    """(by, w1, w2, w3): every adjacent pair of valid words, with the next word
    if that is valid too (else NULL). Rows are laid out from the token list of
    one text, so nothing is shuffled and no window function is needed."""
    by = [by] if isinstance(by, str) else list(by)
    listed = df.select(*by, tokens(text).alias("_t"))
    size = F.size("_t")
    shifted = [
        F.slice("_t", i + 1, F.greatest(size - i, F.lit(0))).alias(f"w{i + 1}") for i in range(3)
    ]
    laid_out = listed.select(*by, F.inline(F.arrays_zip(*shifted)))
    lower = laid_out.select(*by, *[F.lower(c).alias(c) for c in ("w1", "w2", "w3")])
    third = F.when(valid_word("w3", stopwords), F.col("w3"))
    return lower.filter(valid_word("w1", stopwords) & valid_word("w2", stopwords)).select(
        *by, "w1", "w2", third.alias("w3")
    )


def _phrases_in(windows: DataFrame, keep, tag_dict, lemma_dict) -> DataFrame:
    """(keep, phrase): the pair and the triple of each window that are phrases."""
    listed = word_table(tag_dict, lemma_dict)
    for i in (1, 2, 3):
        side = listed.select(
            F.col("word").alias(f"w{i}"),
            F.col("tag").alias(f"t{i}"),
            F.col("adj_lemma").alias(f"a{i}"),
            F.col("noun_lemma").alias(f"n{i}"),
        )
        windows = windows.join(side, f"w{i}", "left")
        word = F.col(f"w{i}")
        tag = F.when(word.isNotNull(), F.coalesce(f"t{i}", ending_tag(word)))
        windows = windows.withColumn(f"t{i}", tag)
        if i == 2:
            windows = windows.filter(
                F.col("t1").isin("ADJ", "NOUN") & F.col("t2").isin("ADJ", "NOUN")
            )

    def lemma(i):
        word = F.col(f"w{i}")
        as_noun = F.coalesce(f"n{i}", noun_lemma(word))
        return F.when(F.col(f"t{i}") == "ADJ", F.coalesce(f"a{i}", word)).otherwise(as_noun)

    def phrase(n):
        tags = [F.col(f"t{i}") for i in range(1, n + 1)]
        has = [reduce(lambda a, b: a | b, [t == kind for t in tags]) for kind in ("ADJ", "NOUN")]
        fits = reduce(lambda a, b: a & b, [t.isin("ADJ", "NOUN") for t in tags])
        return F.when(fits & has[0] & has[1], F.concat_ws(" ", *[lemma(i) for i in range(1, n + 1)]))

    found = windows.select(*keep, F.explode(F.array(phrase(2), phrase(3))).alias("phrase"))
    return found.filter(F.col("phrase").isNotNull())


def phrases(df: DataFrame, by, text, tag_dict, lemma_dict, stopwords=STOPWORDS) -> DataFrame:
    """(by, phrase): one row per occurrence of two or three adjacent adjectives
    and nouns with at least one of each; a triple also gives its pairs."""
    by = [by] if isinstance(by, str) else list(by)
    return _phrases_in(phrase_windows(df, by, text, stopwords), by, tag_dict, lemma_dict)


def phrase_counts(df, by, text, tag_dict, lemma_dict, stopwords=STOPWORDS) -> DataFrame:
    """(by, phrase, count).

    Windows of words are counted first, next to the texts and then over all of
    them; what is tagged, looked up and joined into a phrase is each distinct
    window once, however often it was written.
    """
    by = [by] if isinstance(by, str) else list(by)
    windows = phrase_windows(df, by, text, stopwords)
    counted = windows.groupBy(*by, "w1", "w2", "w3").agg(F.count("*").alias("count"))
    found = _phrases_in(counted, [*by, "count"], tag_dict, lemma_dict)
    return found.groupBy(*by, "phrase").agg(F.sum("count").alias("count"))


def tagged_counts(df: DataFrame, by, text, tag_dict, lemma_dict) -> DataFrame:
    """(by, lemma, tag, n): how often each base form occurs per group.

    Tokens are counted first; the distinct ones are tagged and lemmatised.
    """
    by = [by] if isinstance(by, str) else list(by)
    laid_out = df.select(*by, F.explode(tokens(text)).alias("token"))
    counted = laid_out.groupBy(*by, F.lower("token").alias("word")).agg(F.count("*").alias("n"))
    joined = counted.join(word_table(tag_dict, lemma_dict), "word", "left")
    tag = F.coalesce("tag", ending_tag(F.col("word")))
    tagged = joined.withColumn("tag", tag)
    lemma = (
        F.when(F.col("tag") == "ADJ", F.coalesce("adj_lemma", "word"))
        .when(F.col("tag") == "NOUN", F.coalesce("noun_lemma", noun_lemma(F.col("word"))))
        .otherwise(F.col("word"))
    )
    return tagged.groupBy(*by, lemma.alias("lemma"), "tag").agg(F.sum("n").alias("n"))


def top_phrases(counts: DataFrame, by, n=TOP_PHRASES) -> DataFrame:
    """The `n` most frequent phrases per group, ties alphabetical."""
    best = Window.partitionBy(by).orderBy(F.desc("count"), "phrase")
    ranked = counts.withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= n)


def phrase_weights(counts: DataFrame, by, n=CLOUD_PHRASES) -> DataFrame:
    """(by, phrase, count, weight): top phrases with their count relative to
    the most frequent one."""
    top = top_phrases(counts, by, n)
    most = F.max("count").over(Window.partitionBy(by))
    return top.select(by, "phrase", "count", (F.col("count") / most).alias("weight"))


def phrase_ratio(counts: DataFrame, sizes: DataFrame, by, first, second, n=50) -> DataFrame:
    """(phrase, per_k_a, per_k_b, ratio) for the phrases that are in the top
    `n` of both groups; `sizes` has (by, n_reviews)."""
    top = top_phrases(counts, by, n).join(sizes, by)
    per_k = F.col("count") * 1000.0 / F.col("n_reviews")
    both = top.groupBy("phrase").agg(
        F.max(F.when(F.col(by) == first, per_k)).alias("per_k_a"),
        F.max(F.when(F.col(by) == second, per_k)).alias("per_k_b"),
    )
    shared = both.filter(F.col("per_k_a").isNotNull() & F.col("per_k_b").isNotNull())
    return shared.withColumn("ratio", F.col("per_k_a") / F.col("per_k_b"))


def theme_share(counts: DataFrame, by, theme, n=50) -> DataFrame:
    """(by, n_occurrences, theme_pct): share of the top `n` phrases'
    occurrences that contain a theme word."""
    about = F.arrays_overlap(F.split("phrase", " "), F.array(*[F.lit(w) for w in theme]))
    return (
        top_phrases(counts, by, n)
        .groupBy(by)
        .agg(
            F.sum("count").alias("n_occurrences"),
            (F.sum(F.when(about, F.col("count")).otherwise(0)) * 100.0 / F.sum("count")).alias(
                "theme_pct"
            ),
        )
    )
