"""Queries over review text: cleaning, sentiment, language, phrases."""

from pyspark.sql import functions as F

from valuescout.catalogue.tables import SQL_BUCKET, table
from valuescout.constants import COMMON_ENGLISH_WORDS
from valuescout.dictionaries import (
    DEGREE,
    ENDINGS,
    NEGATORS,
    VALENCE,
    lemma_dictionary,
    lemma_rows,
    sentiment_lexicon,
    tag_dictionary,
    tag_rows,
)
from valuescout.functions import text as tx
from valuescout.functions.ids import hash_bucket, valid_id
from valuescout.operators import exposure, phrases as ph
from valuescout.operators.langid import keep_language, langid_fit, langid_model, langid_score
from valuescout.operators.rows import keep_valid_ids, split_groups
from valuescout.operators.sentiment import add_score
from valuescout.plans.reviews import clean_reviews, cleaning_audit, score_reviews
from valuescout.session import spread, written_table

YEAR = 2025


def _documents(spark, sf_dir, *columns):
    return spread(table(spark, sf_dir, "documents").select(*columns))

# What white space means in the SQL twins; RE2 knows no vertical tab in \s.
_WS = r"\s\x0b\p{Z}\x{1c}-\x{1f}\x{85}"


def _sql_normalized(c):
    plain = f"translate({c}, chr(10) || chr(13) || chr(9), '   ')"
    unlinked = f"regexp_replace({plain}, '(?i)https?://[^{_WS}]+|www\\.[^{_WS}]+', ' ', 'g')"
    untagged = f"regexp_replace({unlinked}, '<[^>]+>', ' ', 'g')"
    return f"trim(regexp_replace({untagged}, '[{_WS}]+', ' ', 'g'))"


def _quoted(words):
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _sql_english(c):
    words = f"regexp_extract_all(lower({c}), '[a-z'']+')"
    latin = f"length(regexp_replace(lower({c}), '[^a-z]+', '', 'g'))"
    letters = f"length(regexp_replace(lower({c}), '\\P{{L}}+', '', 'g'))"
    plain = f"len(list_filter({words}[1:5], lambda w: regexp_matches(w, '^[a-z]'))) = 5"
    common = f"list_has_any({words}, [{_quoted(COMMON_ENGLISH_WORDS)}])"
    return f"(len({words}) > 0 AND {latin} * 5 >= {letters} * 4 AND ({common} OR {plain}))"


def normalized(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", tx.normalize_text("html").alias("text_clean")
    )


def meaningful(spark, sf_dir):
    """Every word-like piece of a page address, and whether it has a letter."""
    pieces = table(spark, sf_dir, "pages").select(
        "page_id", F.posexplode(F.split("url", "[/.?=&-]+")).alias("pos", "piece")
    )
    return pieces.withColumn("meaningful", tx.meaningful("piece").cast("int"))


MEANINGFUL = """
WITH pieces AS (
  SELECT page_id, unnest(list) AS piece, CAST(generate_subscripts(list, 1) - 1 AS INTEGER) AS pos
  FROM (SELECT page_id, regexp_split_to_array(url, '[/.?=&-]+') AS list FROM pages))
SELECT page_id, pos, piece, CAST(regexp_matches(piece, '[A-Za-z]') AS INTEGER) AS meaningful FROM pieces"""


def looks_english(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "lang", "text")
    return docs.select("doc_id", "lang", tx.looks_english("text").cast("int").alias("english"))


def _dated_reviews(spark, sf_dir):
    """Documents as raw reviews; the text length picks a day of two years."""
    docs = _documents(spark, sf_dir, "doc_id", "source", "lang", "text", "n_chars")
    day = F.date_add(F.lit("2024-07-01").cast("date"), (F.col("n_chars") % 700).cast("int"))
    return docs.select(
        F.col("doc_id").alias("id"),
        F.regexp_extract("source", "^src([0-9]+)$", 1).alias("listing_id"),
        F.when(F.col("lang") == "es", "n/a").otherwise(day.cast("string")).alias("date"),
        F.col("text").alias("comments"),
    )


_SQL_REVIEWS = f"""
raw AS (
  SELECT doc_id AS id, regexp_extract(source, '^src([0-9]+)$', 1) AS listing_id,
         CASE WHEN lang <> 'es' THEN DATE '2024-07-01' + CAST(n_chars % 700 AS INTEGER) END AS date,
         text, {_sql_normalized("text")} AS comments_clean
  FROM documents),
steps AS (
  SELECT *, coalesce(year(date) = {YEAR}, false) AS in_year,
         regexp_matches(comments_clean, '[A-Za-z]') AS has_text,
         {_sql_english("comments_clean")} AS english
  FROM raw)"""


def reviews_clean(spark, sf_dir):
    cleaned = clean_reviews(_dated_reviews(spark, sf_dir), YEAR)
    return cleaned.select("id", "listing_id", "date", "comments_clean")


REVIEWS_CLEAN = f"""
WITH {_SQL_REVIEWS}
SELECT id, listing_id, date, comments_clean FROM steps WHERE in_year AND has_text AND english"""


def audit_reviews(spark, sf_dir):
    return cleaning_audit(_dated_reviews(spark, sf_dir), YEAR)


AUDIT_REVIEWS = f"""
WITH {_SQL_REVIEWS},
counts AS (
  SELECT [count(*), count(*) FILTER (WHERE in_year), count(*) FILTER (WHERE in_year AND has_text),
          count(*) FILTER (WHERE in_year AND has_text AND english)] AS ns FROM steps)
SELECT CAST(i AS INTEGER) AS ord,
       ['rows in', 'dated {YEAR}', 'meaningful text', 'looks English'][i + 1] AS step,
       ns[i + 1] AS n_rows, ns[greatest(i, 1)] - ns[i + 1] AS n_dropped
FROM counts, range(0, 4) t(i)"""


def sentiment_scores(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "text")
    return add_score(docs, "text", sentiment_lexicon(spark)).drop("text")


def reviews_scored(spark, sf_dir):
    """All columns of the cleaned reviews, the score right after the text."""
    return score_reviews(reviews_clean(spark, sf_dir), sentiment_lexicon(spark))


_UP = _quoted(w for w, s in DEGREE.items() if s > 0)
_DOWN = _quoted(w for w, s in DEGREE.items() if s < 0)


def _sql_degree(word):
    known = f"{word} IN (SELECT word FROM lexicon)"
    return f"(CASE WHEN {known} THEN 0.0 WHEN {word} IN ({_UP}) THEN 1.0 WHEN {word} IN ({_DOWN}) THEN -1.0 ELSE 0.0 END)"


def _sql_negates(word):
    return f"CAST({word} IN ({_quoted(NEGATORS)}) AND {word} NOT IN (SELECT word FROM lexicon) AS INTEGER)"


_SQL_SENTIMENT = f"""
lexicon(word, valence) AS (VALUES {", ".join(f"('{w}', {v}::DOUBLE)" for w, v in VALENCE.items())}),
listed AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z'']+') AS list,
         regexp_matches(text, '[a-z]') AS mixed,
         least(length(text) - length(replace(text, '!', '')), 4) AS bang,
         length(text) - length(replace(text, '?', '')) AS ask
  FROM documents),
words AS (
  SELECT doc_id, mixed, unnest(list) AS form, generate_subscripts(list, 1) AS pos FROM listed),
context AS (
  SELECT doc_id, mixed, form, pos, lower(form) AS word,
         coalesce(lower(lag(form, 1) OVER w), '') AS p1, coalesce(lower(lag(form, 2) OVER w), '') AS p2,
         coalesce(lower(lag(form, 3) OVER w), '') AS p3,
         min(CASE WHEN lower(form) = 'but' THEN pos END) OVER (PARTITION BY doc_id) AS but
  FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
hits AS (
  SELECT doc_id,
         (valence + sign(valence) * (
            CASE WHEN mixed AND length(form) > 1 AND regexp_matches(form, '^[A-Z'']+$') THEN 0.733 ELSE 0.0 END
            + 0.293 * {_sql_degree("p1")} + 0.293 * 0.95 * {_sql_degree("p2")} + 0.293 * 0.9 * {_sql_degree("p3")}))
         * pow(-0.74, {_sql_negates("p1")} + {_sql_negates("p2")} + {_sql_negates("p3")})
         * CASE WHEN but IS NULL THEN 1.0 WHEN pos < but THEN 0.5 ELSE 1.5 END AS s
  FROM context JOIN lexicon USING (word)),
sums AS (
  SELECT l.doc_id, any_value(bang) AS bang, any_value(ask) AS ask, coalesce(sum(CAST(s AS DOUBLE)), 0.0) AS s
  FROM listed l LEFT JOIN hits h ON l.doc_id = h.doc_id GROUP BY l.doc_id),
stressed AS (
  SELECT doc_id, CAST(s + sign(s) * (bang * 0.292
           + CASE WHEN ask < 2 THEN 0.0 WHEN ask <= 3 THEN ask * 0.18 ELSE 0.96 END) AS DOUBLE) AS s
  FROM sums),
scores AS (
  SELECT doc_id, round(s / sqrt(s * s + 15), 4) AS sentiment_vader FROM stressed)"""


REVIEWS_SCORED = f"""
WITH {_SQL_REVIEWS},
cleaned AS (SELECT id, listing_id, date, comments_clean FROM steps WHERE in_year AND has_text AND english),
{_SQL_SENTIMENT.replace("SELECT doc_id, text, regexp", "SELECT id AS doc_id, comments_clean AS text, regexp").replace("FROM documents)", "FROM (SELECT id, comments_clean, comments_clean AS text FROM cleaned))")}
SELECT id, listing_id, date, comments_clean, sentiment_vader FROM cleaned JOIN scores ON id = doc_id"""


def sentiment_by_group(spark, sf_dir):
    """Mean score and positive rate of toxic, other and unlabelled texts."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = sentiment_scores(spark, sf_dir).join(labels, "doc_id", "left")
    return scored.groupBy("toxic").agg(
        F.count("*").alias("n"),
        F.round(F.avg("sentiment_vader"), 6).alias("mean_sentiment"),
        F.round(F.avg(exposure.positive(F.col("sentiment_vader"))), 6).alias("positive_rate"),
    )


SENTIMENT_BY_GROUP = f"""
WITH {_SQL_SENTIMENT}
SELECT toxic, count(*) AS n, round(avg(sentiment_vader), 6) AS mean_sentiment,
       round(avg(CASE WHEN sentiment_vader >= 0.5 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS positive_rate
FROM scores LEFT JOIN labels USING (doc_id) GROUP BY toxic"""


def _profile(spark, sf_dir):
    return langid_fit(_documents(spark, sf_dir, "text", "lang"), "text", "lang")


def langid_profile(spark, sf_dir):
    return _profile(spark, sf_dir).withColumn("share", F.round("share", 6))


_SQL_GRAMS = r"""
texts AS (
  SELECT doc_id, lang,
         regexp_extract_all(regexp_replace(' ' || lower(text) || ' ', '\P{L}+', ' ', 'g'), '.') AS c
  FROM documents),
grams AS (
  SELECT doc_id, lang, unnest(list_concat(
           list_filter(c, lambda x: x <> ' '),
           list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1]),
           list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]))) AS gram
  FROM texts),
profile AS (
  SELECT *, n / sum(n) OVER (PARTITION BY lang) AS share
  FROM (SELECT lang, gram, count(*) AS n FROM grams GROUP BY lang, gram
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, gram) <= 400))"""

_SQL_LANGID = f"""{_SQL_GRAMS},
vocabulary AS (SELECT DISTINCT gram FROM profile),
totals AS (SELECT lang, sum(n) AS total FROM profile GROUP BY lang),
weights AS (
  SELECT v.gram, t.lang,
         ln((coalesce(p.n, 0) + 0.5) / (total + 0.5 * (SELECT count(*) FROM vocabulary))) AS w
  FROM vocabulary v CROSS JOIN totals t LEFT JOIN profile p ON p.gram = v.gram AND p.lang = t.lang),
counted AS (SELECT doc_id, gram, count(*) AS n FROM grams GROUP BY doc_id, gram),
scored AS (
  SELECT doc_id, w.lang, sum(c.n * w) AS s FROM counted c JOIN weights w USING (gram) GROUP BY doc_id, w.lang),
found AS (
  SELECT doc_id, lang AS lang_found FROM scored
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) = 1)"""


def langid_confusion(spark, sf_dir):
    """Given and found languages, apart for texts the profile has not seen."""
    docs = _documents(spark, sf_dir, "doc_id", "lang", "text").withColumn("held_out", hash_bucket("doc_id"))
    docs = docs.withColumn("held_out", (F.col("held_out") == 0).cast("int"))
    profile = langid_fit(docs.filter(F.col("held_out") == 0), "text", "lang")
    scored = langid_score(docs, "text", langid_model(profile))
    return scored.groupBy("held_out", "lang", "lang_found").agg(F.count("*").alias("n"))


_HELD_OUT = SQL_BUCKET.format(id="doc_id", seed=42, n=5)
LANGID_CONFUSION = f"""
WITH {_SQL_LANGID.replace("FROM grams GROUP BY lang, gram", f"FROM grams WHERE {_HELD_OUT} <> 0 GROUP BY lang, gram")}
SELECT CAST({_HELD_OUT} = 0 AS INTEGER) AS held_out, d.lang, lang_found, count(*) AS n
FROM documents d LEFT JOIN found USING (doc_id) GROUP BY ALL"""


def english_only(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "lang", "text", "n_chars")
    kept = keep_language(docs, "text", langid_model(_profile(spark, sf_dir)), "en")
    return kept.select("doc_id", "lang", "n_chars")


ENGLISH_ONLY = f"""
WITH {_SQL_LANGID}
SELECT doc_id, lang, n_chars FROM documents JOIN found USING (doc_id) WHERE lang_found = 'en'"""


def _grouped_reviews(spark, sf_dir, language=None):
    """Documents, labelled by whether their source is little rated: its number
    of labelled texts is below the median source's. With a language only the
    texts found to be in it."""
    docs = table(spark, sf_dir, "documents")
    listing = valid_id(F.regexp_extract("source", "^src([0-9]+)$", 1)).alias("listing_id")
    reviews = docs.select(F.col("doc_id").alias("id"), listing)
    rated = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    flags = exposure.low_exposure(exposure.review_counts(reviews.join(rated, "id")))
    hidden = flags.filter(F.col("is_hidden") == 1)
    texts = keep_valid_ids(spread(docs).select(F.col("doc_id").alias("id"), listing, "text"), "listing_id")
    if language is not None:
        texts = keep_language(texts, "text", langid_model(_profile(spark, sf_dir)), language)
    return split_groups(texts, hidden, "listing_id", "group", "hidden", "other", "id")


_SQL_GROUPS = """
reviews AS (
  SELECT doc_id AS id, regexp_extract(source, '^src([0-9]+)$', 1) AS listing_id, text, lang
  FROM documents WHERE regexp_matches(source, '^src[0-9]+$')),
exposure AS (
  SELECT listing_id, count(*) AS n FROM reviews JOIN labels ON id = doc_id GROUP BY listing_id),
hidden AS (SELECT listing_id FROM exposure WHERE n < (SELECT median(n) FROM exposure)),
grouped AS (
  SELECT id, listing_id, text,
         CASE WHEN listing_id IN (SELECT listing_id FROM hidden) THEN 'hidden' ELSE 'other' END AS "group"
  FROM reviews)"""

_SQL_ENGLISH_GROUPS = f"""{_SQL_LANGID}, {_SQL_GROUPS.replace("FROM reviews)", "FROM reviews JOIN found ON id = doc_id WHERE lang_found = 'en')")}"""


def split(spark, sf_dir):
    return _grouped_reviews(spark, sf_dir).select("id", "listing_id", "group")


def token_counts(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "text").select("doc_id", tx.tokens("text").alias("t"))
    return docs.select("doc_id", F.posexplode("t").alias("pos", "token"))


TOKENS = """
SELECT doc_id, unnest(t) AS token, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos
FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z'']+|[.,!?;:]') AS t FROM documents)"""


def _sql_tag(word, listed):
    endings = " ".join(f"WHEN {word} LIKE '%{e}' THEN '{t}'" for e, t in ENDINGS)
    return (
        f"coalesce({listed}, CASE WHEN NOT regexp_matches({word}, '[a-z]') THEN 'OTHER' "
        f"{endings} ELSE 'NOUN' END)"
    )


_SQL_TAGS = f"tags(word, tag) AS (VALUES {', '.join(f'({_quoted(r)})' for r in tag_rows())})"
_SQL_LEMMAS = (
    f"lemmas(word, tag, lemma) AS (VALUES {', '.join(f'({_quoted(r)})' for r in lemma_rows())})"
)


def _sql_lemma(word, tag, listed):
    noun = (
        f"CASE WHEN length({word}) < 4 OR regexp_matches({word}, '(ss|us|is)$') OR {word} NOT LIKE '%s' THEN {word} "
        f"WHEN {word} LIKE '%ies' THEN left({word}, -3) || 'y' "
        f"WHEN regexp_matches({word}, '(ss|x|z|ch|sh)es$') THEN left({word}, -2) "
        f"ELSE left({word}, -1) END"
    )
    return f"coalesce({listed}, CASE WHEN {tag} = 'NOUN' THEN {noun} ELSE {word} END)"


def tagged_counts(spark, sf_dir):
    """How often each (lemma, tag) occurs per group."""
    grouped = _grouped_reviews(spark, sf_dir)
    return ph.tagged_counts(grouped, "group", "text", tag_dictionary(spark), lemma_dictionary(spark))


TAGGED_COUNTS = f"""
WITH {_SQL_GROUPS}, {_SQL_TAGS}, {_SQL_LEMMAS},
tokens AS (
  SELECT "group", lower(unnest(regexp_extract_all(text, '[A-Za-z'']+|[.,!?;:]'))) AS w FROM grouped),
tagged AS (
  SELECT "group", w, {_sql_tag("w", "tag")} AS tag FROM tokens LEFT JOIN tags ON w = word),
based AS (
  SELECT "group", t.tag, {_sql_lemma("w", "t.tag", "lemma")} AS lemma
  FROM tagged t LEFT JOIN lemmas l ON w = word AND t.tag = l.tag)
SELECT "group", lemma, tag, count(*) AS n FROM based GROUP BY ALL"""


def phrase_windows(spark, sf_dir):
    found = ph.phrase_windows(_grouped_reviews(spark, sf_dir), "group", "text")
    return found.groupBy("group", "w1", "w2").agg(
        F.count("*").alias("n"), F.count("w3").alias("n_triples")
    )


_VALID = f"regexp_matches({{0}}, '^[a-z]+$') AND length({{0}}) > 2 AND {{0}} NOT IN ({_quoted(ph.STOPWORDS)})"
_SQL_LAID = f"""
listed AS (
  SELECT "group", list_transform(regexp_extract_all(text, '[A-Za-z'']+|[.,!?;:]'), lambda x: lower(x)) AS t
  FROM grouped),
laid AS (
  SELECT "group", unnest(t) AS w1, unnest(list_concat(t[2:], [NULL])) AS w2,
         unnest(list_concat(t[3:], [NULL, NULL])) AS w3x FROM listed WHERE len(t) >= 2),
windows AS (
  SELECT "group", w1, w2, CASE WHEN {_VALID.format("w3x")} THEN w3x END AS w3
  FROM laid WHERE {_VALID.format("w1")} AND {_VALID.format("w2")})"""
_SQL_WINDOWS = f"{_SQL_GROUPS}, {_SQL_LAID}"

PHRASE_WINDOWS = f"""
WITH {_SQL_WINDOWS}
SELECT "group", w1, w2, count(*) AS n, count(w3) AS n_triples FROM windows GROUP BY ALL"""


_SQL_PHRASES = f"""{_SQL_ENGLISH_GROUPS}, {_SQL_LAID}, {_SQL_TAGS}, {_SQL_LEMMAS},
distinct_words AS (
  SELECT w1 AS w FROM windows UNION SELECT w2 FROM windows UNION SELECT w3 FROM windows WHERE w3 IS NOT NULL),
tagged AS (
  SELECT w, {_sql_tag("w", "tag")} AS tag FROM distinct_words LEFT JOIN tags ON w = word),
based AS (
  SELECT w, t.tag, {_sql_lemma("w", "t.tag", "lemma")} AS lemma
  FROM tagged t LEFT JOIN lemmas l ON w = word AND t.tag = l.tag),
marked AS (
  SELECT "group", b1.tag AS t1, b2.tag AS t2, b3.tag AS t3, b1.lemma AS l1, b2.lemma AS l2, b3.lemma AS l3
  FROM windows JOIN based b1 ON w1 = b1.w JOIN based b2 ON w2 = b2.w LEFT JOIN based b3 ON w3 = b3.w),
phrases AS (
  SELECT "group", l1 || ' ' || l2 AS phrase FROM marked
  WHERE t1 IN ('ADJ', 'NOUN') AND t2 IN ('ADJ', 'NOUN') AND t1 <> t2
  UNION ALL
  SELECT "group", l1 || ' ' || l2 || ' ' || l3 FROM marked
  WHERE t1 IN ('ADJ', 'NOUN') AND t2 IN ('ADJ', 'NOUN') AND t3 IN ('ADJ', 'NOUN')
    AND NOT (t1 = t2 AND t2 = t3)),
counts AS (SELECT "group", phrase, count(*) AS count FROM phrases GROUP BY ALL),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY "group" ORDER BY count DESC, phrase) AS INTEGER) AS rank
  FROM counts)"""


def _counts(spark, sf_dir, grouped=None):
    grouped = grouped or _grouped_reviews(spark, sf_dir, "en")
    return ph.phrase_counts(grouped, "group", "text", tag_dictionary(spark), lemma_dictionary(spark))


def phrases_top(spark, sf_dir):
    return ph.top_phrases(_counts(spark, sf_dir), "group", 10)


def phrases_weight(spark, sf_dir):
    weights = ph.phrase_weights(_counts(spark, sf_dir), "group", 100)
    return weights.withColumn("weight", F.round("weight", 6))


# Word endings that stand for a theme in the invented prose.
THEME = ("thing", "tion", "ing", "tioning", "tionble", "ness", "thble", "inble", "erble")


def theme_share(spark, sf_dir):
    shares = ph.theme_share(_counts(spark, sf_dir), "group", THEME, 50)
    return shares.withColumn("theme_pct", F.round("theme_pct", 6))


THEME_SHARE = f"""
WITH {_SQL_PHRASES}
SELECT "group", CAST(sum(count) AS BIGINT) AS n_occurrences,
       round(100.0::DOUBLE * sum(CASE WHEN list_has_any(string_split(phrase, ' '), [{_quoted(THEME)}])
                                      THEN count ELSE 0 END) / sum(count), 6) AS theme_pct
FROM ranked WHERE rank <= 50 GROUP BY "group\""""


# Invented words repeat less than real ones, so more phrases are compared.
TOP_SHARED = 500


def phrase_ratio(spark, sf_dir):
    # counted and sized from one scoring
    grouped = written_table(_grouped_reviews(spark, sf_dir, "en").select("group", "text"))
    sizes = grouped.groupBy("group").agg(F.count("*").alias("n_reviews"))
    ratio = ph.phrase_ratio(_counts(spark, sf_dir, grouped), sizes, "group", "hidden", "other", TOP_SHARED)
    return ratio.withColumns({c: F.round(c, 6) for c in ("per_k_a", "per_k_b", "ratio")})


PHRASE_RATIO = f"""
WITH {_SQL_PHRASES},
per_k AS (
  SELECT r."group", phrase, count * 1000.0::DOUBLE / n_reviews AS per_k
  FROM ranked r JOIN (SELECT "group", count(*) AS n_reviews FROM grouped GROUP BY "group") USING ("group")
  WHERE rank <= {TOP_SHARED})
SELECT phrase, round(a.per_k, 6) AS per_k_a, round(b.per_k, 6) AS per_k_b,
       round(a.per_k / b.per_k, 6) AS ratio
FROM per_k a JOIN per_k b USING (phrase) WHERE a."group" = 'hidden' AND b."group" = 'other'"""

QUERIES = {
    "normalize_text": normalized,
    "meaningful": meaningful,
    "looks_english": looks_english,
    "reviews_clean": reviews_clean,
    "audit_reviews": audit_reviews,
    "sentiment_scores": sentiment_scores,
    "reviews_scored": reviews_scored,
    "sentiment_by_group": sentiment_by_group,
    "langid_profile": langid_profile,
    "langid_confusion": langid_confusion,
    "english_only": english_only,
    "split_groups": split,
    "tokens": token_counts,
    "tagged_counts": tagged_counts,
    "phrase_windows": phrase_windows,
    "phrases_top": phrases_top,
    "phrases_weight": phrases_weight,
    "phrase_ratio": phrase_ratio,
    "theme_share": theme_share,
}

ORACLES = {
    "normalize_text": f"SELECT page_id, {_sql_normalized('html')} AS text_clean FROM pages",
    "meaningful": MEANINGFUL,
    "looks_english": f"SELECT doc_id, lang, CAST({_sql_english('text')} AS INTEGER) AS english FROM documents",
    "reviews_clean": REVIEWS_CLEAN,
    "audit_reviews": AUDIT_REVIEWS,
    "reviews_scored": REVIEWS_SCORED,
    "sentiment_scores": f"WITH {_SQL_SENTIMENT} SELECT doc_id, sentiment_vader FROM scores",
    "sentiment_by_group": SENTIMENT_BY_GROUP,
    "langid_profile": f"WITH {_SQL_GRAMS} SELECT lang, gram, n, round(share, 6) AS share FROM profile",
    "langid_confusion": LANGID_CONFUSION,
    "english_only": ENGLISH_ONLY,
    "split_groups": f'WITH {_SQL_GROUPS} SELECT id, listing_id, "group" FROM grouped',
    "tokens": TOKENS,
    "tagged_counts": TAGGED_COUNTS,
    "phrase_windows": PHRASE_WINDOWS,
    "phrases_top": f'WITH {_SQL_PHRASES} SELECT "group", phrase, count, rank FROM ranked WHERE rank <= 10',
    "phrases_weight": f"""WITH {_SQL_PHRASES}
SELECT "group", phrase, count, round(count / max(count) OVER (PARTITION BY "group"), 6) AS weight
FROM ranked WHERE rank <= 100""",
    "phrase_ratio": PHRASE_RATIO,
    "theme_share": THEME_SHARE,
}
