"""Language identification from character n-gram profiles (Cavnar & Trenkle
1994) with naive Bayes scoring."""

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window, functions as F

from valuescout.operators.rows import evaluate_once

GRAM_SIZES = (1, 2, 3)
PROFILE_SIZE = 400
_MAX_PROFILE_ROWS = 200_000
_BLOCK = 1 << 18  # read by nothing since texts are scored whole; a test still sets it


def letters_only(c) -> Column:
    """Lower-case words between single blanks, a blank at both ends."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.lower(F.coalesce(c, F.lit("")))
    return F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), r"\P{L}+", " ")


def grams(c, sizes=GRAM_SIZES) -> Column:
    """Every overlapping n-gram of the whole text, found in one sweep per size
    by a look-ahead; blanks alone are left out."""
    text = letters_only(c)
    found = [
        F.regexp_extract_all(text, F.lit(rf"(?=(.{{{n}}}))" if n > 1 else r"(\p{L})"), F.lit(1))
        for n in sizes
    ]
    return F.concat(*found)


def _windows(text, longest) -> Column:
    """The longest n-gram from each letter or blank on; marks that no text has
    fill up the last ones."""
    padded = F.concat(letters_only(text), F.lit("#" * (longest - 1)))
    return F.regexp_extract_all(padded, F.lit(rf"(?=(.{{{longest}}}))"), F.lit(1))


def gram_counts(df: DataFrame, text, by, sizes=GRAM_SIZES) -> DataFrame:
    """(by, gram, n) over all texts, the n-grams of `grams`.

    Only the longest n-gram from each letter on is laid out and counted; the
    shorter ones are its beginnings, so they come from the few distinct ones.
    """
    counted = df.select(by, F.explode(_windows(text, max(sizes))).alias("_w")).groupBy(by, "_w").agg(F.count("*").alias("n"))
    beginnings = F.array(*[F.substring("_w", F.lit(1), F.lit(n)) for n in sizes])
    found = counted.select(by, F.explode(beginnings).alias("gram"), "n")
    found = found.filter((F.col("gram") != " ") & ~F.contains("gram", F.lit("#")))
    return found.groupBy(by, "gram").agg(F.sum("n").alias("n"))


def langid_fit(df: DataFrame, text, lang, size=PROFILE_SIZE, sizes=GRAM_SIZES) -> DataFrame:
    """(lang, gram, n, share): the most frequent n-grams per language, ties by
    n-gram; `share` is among the grams kept. `size` is the published method's
    parameter: rarer n-grams are no part of a profile."""
    labelled = df.filter(F.col(lang).isNotNull()).withColumn("lang", F.col(lang))
    counts = gram_counts(labelled, text, "lang", sizes)
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    kept = counts.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= size)
    total = F.sum("n").over(Window.partitionBy("lang"))
    return kept.withColumn("share", F.col("n") / total).drop("_r")


@dataclass
class LanguageModel:
    """`weights`: a row per language, a column per n-gram of the vocabulary."""

    languages: list
    vocabulary: list
    weights: np.ndarray


def langid_model(profile: DataFrame, smoothing=0.5) -> LanguageModel:
    """Naive Bayes with equal priors over the n-grams of a profile (runs jobs).

    The profile is a capped number of n-grams per language; it becomes the
    vocabulary and one training row per language.
    """
    rows = profile.select("lang", "gram", "n").limit(_MAX_PROFILE_ROWS + 1).collect()
    if len(rows) > _MAX_PROFILE_ROWS:
        raise ValueError("the profile is too big for a vocabulary")
    languages = sorted({r["lang"] for r in rows})
    vocabulary = sorted({r["gram"] for r in rows})
    slot = {gram: i for i, gram in enumerate(vocabulary)}
    counts = {lang: {} for lang in languages}
    for r in rows:
        counts[r["lang"]][slot[r["gram"]]] = float(r["n"])
    train = profile.sparkSession.createDataFrame(
        [(float(i), Vectors.sparse(len(slot), counts[lang])) for i, lang in enumerate(languages)],
        ["label", "_counts"],
    )
    bayes = NaiveBayes(smoothing=smoothing, featuresCol="_counts").fit(train)
    return LanguageModel(languages, vocabulary, bayes.theta.toArray())


def _cumulated(model: LanguageModel, sizes):
    """(n-grams, weights): those a text can show as its longest at a place, each
    with the weights of all its known beginnings."""
    # half a letter is no letter alone
    slot = {gram: i for i, gram in enumerate(model.vocabulary) if len(gram) in sizes and gram != "?"}
    weights = np.zeros((len(model.languages), len(slot)))
    for i, gram in enumerate(slot):
        for n in sizes:
            if n <= len(gram) and gram[:n] in slot:
                weights[:, i] += model.weights[:, slot[gram[:n]]]
    return list(slot), weights


def langid_score(
    df: DataFrame, text, model: LanguageModel, sizes=GRAM_SIZES, name="lang_found"
) -> DataFrame:
    """Add the most likely language of every text, NULL for texts without a
    known n-gram. Texts are scored where they lie: no shuffle, no Python.

    One sweep lays out the longest n-gram from each letter on, of which the longest
    known beginning is kept. It stands for its own beginnings: its probability is
    the product of theirs, and a last slot that no text has fills up the sums, so
    that naive Bayes takes the products as they are (runs a job). N-grams and
    language are made once per row: a filter on the language reads the column and
    does not take the scoring along to the scan.
    """
    known, weights = _cumulated(model, sizes)
    if not known:
        return df.withColumn(name, F.lit(None).cast("string"))
    shares = np.exp(weights)
    filler = 2 * shares.sum(axis=1).max() - shares.sum(axis=1)
    train = [(float(i), Vectors.dense([*row, rest])) for i, (row, rest) in enumerate(zip(shares, filler))]
    bayes = NaiveBayes(
        smoothing=0.0,
        featuresCol="_counts",
        rawPredictionCol="",  # only the language is asked for
        probabilityCol="",
        predictionCol="_found",
    ).fit(df.sparkSession.createDataFrame(train, ["label", "_counts"]))
    counter = CountVectorizerModel.from_vocabulary([*known, "#"], inputCol="_grams", outputCol="_counts")
    longest = max(sizes)

    def kept(window):
        found = F.lit(None).cast("string")
        for n in sorted(sizes):
            begin = window if n == longest else F.substring(window, F.lit(1), F.lit(n))
            found = F.when(begin.isin([gram for gram in known if len(gram) == n]), begin).otherwise(found)
        return found

    laid_out = evaluate_once(df, "_grams", F.array_compact(F.transform(_windows(text, longest), kept)))
    scored = bayes.transform(counter.transform(laid_out))
    listed = F.array(*[F.lit(lang) for lang in model.languages])
    language = F.when(F.size("_grams") > 0, F.get(listed, F.col("_found").cast("int")))
    return evaluate_once(scored, name, language).select(*df.columns, name)


def keep_language(df: DataFrame, text, model, wanted="en", sizes=GRAM_SIZES) -> DataFrame:
    """Rows whose text is most likely in the `wanted` language."""
    scored = langid_score(df, text, model, sizes, "_language")
    return scored.filter(F.col("_language") == wanted).drop("_language")
