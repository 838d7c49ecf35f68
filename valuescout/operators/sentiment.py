"""Lexicon-and-rule sentiment (Hutto & Gilbert, ICWSM 2014) as a column."""

from pyspark.sql import Column, DataFrame, functions as F

from valuescout.dictionaries import DEGREE, NEGATORS
from valuescout.functions.text import words
from valuescout.operators.rows import evaluate_once

# The empirical constants of the published rule set.
DEGREE_STEP = 0.293
CAPS_STEP = 0.733
NEGATION_FACTOR = -0.74
DISTANCE_WEIGHTS = (1.0, 0.95, 0.9)
BUT_BEFORE, BUT_AFTER = 0.5, 1.5
EXCLAMATION_STEP, EXCLAMATION_MAX = 0.292, 4
QUESTION_STEP, QUESTION_MAX, QUESTION_CAP = 0.18, 3, 0.96
NORMALISER = 15.0

# Entries of a lexicon travel with the plan; published ones have under 10,000.
MAX_ENTRIES = 50_000


def lexicon_entries(lexicon: DataFrame) -> dict:
    """{word: valence}, read once; refuses more than fit in a plan."""
    rows = lexicon.select("word", "valence").limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"a lexicon has {MAX_ENTRIES} entries at most")
    return {r["word"]: float(r["valence"]) for r in rows if r["word"]}


def _lookup(entries):
    """Column function from a word to its valence or NULL: a literal array of
    small maps, the word's hash picks the map."""
    slots = max(1, len(entries) // 4)
    spark_hash = F.pmod(F.xxhash64("word"), F.lit(slots)).cast("int")
    parts = [{"": 0.0} for _ in range(slots)]

    def build(spark):
        rows = spark.createDataFrame([(w,) for w in entries] or [("",)], "word string")
        for r in rows.select("word", spark_hash.alias("slot")).collect():
            if r["word"]:
                parts[r["slot"]][r["word"]] = entries[r["word"]]
        maps = [F.map_from_arrays(F.array(*map(F.lit, m)), F.array(*map(F.lit, m.values()))) for m in parts]
        table = F.array(*maps)
        return lambda word: F.try_element_at(F.get(table, F.pmod(F.xxhash64(word), F.lit(slots)).cast("int")), word)

    return build


def sentiment(spark, text, entries, degree=DEGREE, negators=NEGATORS) -> Column:
    """Score in -1..1 of a text column, computed where the text lies.

    Each word is looked up, and a hit is adjusted by the three words before it
    unless they are in the lexicon themselves: degree words strengthen or
    weaken it, negators turn it. Blank texts score 0.
    """
    valence_of = _lookup(entries)(spark)
    up, down = ([w for w, sign in degree.items() if sign * way > 0] for way in (1, -1))
    body = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))

    def adjusted(listed):
        def one(word, i):
            valence = F.get(listed["valence"], i)
            sign = F.signum(valence)
            form = F.get(listed["form"], i)
            # Capitals stress a word only where the text has small letters too.
            caps = listed["mixed"] & (F.length(form) > 1) & form.rlike("^[A-Z']+$")
            score = valence + F.when(caps, CAPS_STEP).otherwise(0.0) * sign
            negations = F.lit(0)
            for back, weight in enumerate(DISTANCE_WEIGHTS, start=1):
                near = F.coalesce(F.get(listed["word"], i - back), F.lit(""))
                plain = F.get(listed["valence"], i - back).isNull()
                step = F.when(near.isin(*up), 1.0).when(near.isin(*down), -1.0).otherwise(0.0)
                score = score + F.when(plain, step).otherwise(0.0) * DEGREE_STEP * weight * sign
                negations = negations + (plain & near.isin(*negators)).cast("int")
            score = score * F.pow(F.lit(NEGATION_FACTOR), negations)
            before = i + 1 < listed["but"]
            place = F.when(listed["but"] == 0, 1.0).when(before, BUT_BEFORE).otherwise(BUT_AFTER)
            return F.when(valence.isNull(), 0.0).otherwise(score * place)

        return F.aggregate(F.transform(listed["word"], one), F.lit(0.0), lambda total, x: total + x)

    # Arrays of one element let each step refer to the last one by name.
    def told(line):
        valence = F.transform(line["word"], valence_of)
        but = F.array_position(line["word"], F.lit("but"))
        fields = [line["form"].alias("form"), line["word"].alias("word"), line["mixed"].alias("mixed")]
        return F.struct(*fields, valence.alias("valence"), but.alias("but"))

    forms = F.transform(F.array(words(body)), lambda w: F.struct(w.alias("form"), F.transform(w, F.lower).alias("word"), body.rlike("[a-z]").alias("mixed")))
    total = F.transform(F.transform(forms, told), adjusted)

    def stressed(s):
        bang = F.length(body) - F.length(F.replace(body, F.lit("!"), F.lit("")))
        ask = F.length(body) - F.length(F.replace(body, F.lit("?"), F.lit("")))
        asks = F.when(ask < 2, 0.0).when(ask <= QUESTION_MAX, ask * QUESTION_STEP).otherwise(QUESTION_CAP)
        return s + F.signum(s) * (F.least(bang, F.lit(EXCLAMATION_MAX)) * EXCLAMATION_STEP + asks)

    scored = F.transform(F.transform(total, stressed), lambda s: F.round(s / F.sqrt(s * s + NORMALISER), 4))
    return F.get(scored, 0)


def add_score(
    df: DataFrame, text, lexicon: DataFrame, name="sentiment_vader", degree=DEGREE, negators=NEGATORS
) -> DataFrame:
    """Put the score column right after the text. Rows stay where they are,
    also those that are alike; nothing is shuffled or joined."""
    at = df.columns.index(text) + 1
    score = sentiment(df.sparkSession, text, lexicon_entries(lexicon), degree, negators)
    scored = evaluate_once(df, name, score)
    return scored.select(*df.columns[:at], name, *df.columns[at:])
