"""Review text: cleaning, language heuristics, tokens."""

from pyspark.sql import Column, functions as F

from valuescout.constants import COMMON_ENGLISH_WORDS
from valuescout.functions.values import SPACE, _col

# What counts as a link, a tag, a word and a phrase token.
_URL = rf"(?iu)https?://[^{SPACE}]+|www\.[^{SPACE}]+"
_TAG = r"<[^>]+>"
WORD = r"[A-Za-z']+"
TOKEN = r"[A-Za-z']+|[.,!?;:]"


def normalize_text(c) -> Column:
    """One line of plain text: links go first (they swallow a tag stuck to
    them), then tags, then runs of white space."""
    text = F.coalesce(_col(c), F.lit(""))
    text = F.translate(text, "\n\r\t", "   ")
    text = F.regexp_replace(text, _URL, " ")
    text = F.regexp_replace(text, _TAG, " ")
    return F.trim(F.regexp_replace(text, rf"[{SPACE}]+", " "))


def meaningful(c) -> Column:
    """Has a Latin letter; punctuation, digits and emoji alone do not count."""
    return F.coalesce(_col(c).rlike("[A-Za-z]"), F.lit(False))


def looks_english(c, words=COMMON_ENGLISH_WORDS) -> Column:
    """Mostly a-z letters, and either a common word or five plain words."""
    common = r"(?<![a-z'])(?:" + "|".join(words) + r")(?![a-z'])"

    def verdict(text):
        latin = F.length(F.regexp_replace(text, "[^a-z]+", ""))
        letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
        five_words = text.rlike(r"^[^a-z']*(?:[a-z][a-z']*[^a-z']+){4}[a-z]")
        return (text.rlike(common) | five_words) & (latin * 5 >= letters * 4)

    # The lambda binds the lower-cased text, which is so made once per row.
    return F.coalesce(F.transform(F.array(F.lower(_col(c))), verdict)[0], F.lit(False))


def tokens(c) -> Column:
    """Words and sentence punctuation, in order; punctuation blocks phrases."""
    return F.regexp_extract_all(_col(c), F.lit(TOKEN), F.lit(0))


def words(c) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(WORD), F.lit(0))


def valid_word(c, stopwords) -> Column:
    """Lower-case letters only, longer than two, not a stop word."""
    c = _col(c)
    return c.rlike("^[a-z]+$") & (F.length(c) > 2) & ~c.isin(*stopwords)
