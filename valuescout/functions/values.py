"""Tolerant parsing of the text cells of a raw export."""

from pyspark.sql import Column, functions as F

from valuescout.constants import NA_TOKENS, TRUTHY

# White space as Unicode-aware text tools see it; Java's \s alone is ASCII.
SPACE = r"\s\p{Z}\x1c-\x1f\x85"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_LEADING_NUMBER = rf"^[{SPACE}]*([0-9]+(?:\.[0-9]+)?)"


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(_col(c), rf"^[{SPACE}]+|[{SPACE}]+$", "")


def null_if_na(c, tokens=NA_TOKENS) -> Column:
    """NULL for cells that spell a missing value."""
    c = _col(c)
    return F.when(~c.isin(*tokens), c)


def to_number(c) -> Column:
    """Plain decimal or scientific notation to double, anything else to NULL."""
    text = strip(c)
    return F.when(text.rlike(_NUMBER), text).try_cast("double")


def parse_price(c) -> Column:
    """`$1,234.00`, `€85`, `1 200` -> double; unreadable -> NULL."""
    return to_number(F.translate(_col(c), "€$, ", ""))


def log_price(c) -> Column:
    """Natural log; zero, negative and missing prices give NULL."""
    c = _col(c)
    return F.ln(F.when(c > 0, c))


def parse_bathrooms(number, text) -> Column:
    """The number if readable, else the leading number of the text, else 0.5
    for a half-bath, else NULL."""
    text = _col(text)
    leading = F.nullif(F.regexp_extract(text, _LEADING_NUMBER, 1), F.lit(""))
    half = F.when(F.lower(text).contains("half"), F.lit(0.5))
    return F.coalesce(parse_price(number), leading.try_cast("double"), half)


def truthy(c) -> Column:
    """0/1 flag, never NULL."""
    hit = F.lower(strip(c)).isin(*TRUTHY)
    return F.coalesce(hit, F.lit(False)).cast("int")


def to_date(c) -> Column:
    """Date or NULL."""
    return _col(c).try_cast("date")


def tenure_years(start, end) -> Column:
    """Whole days between two text dates, in years of 365.25 days."""
    days = F.datediff(to_date(end), to_date(start)).cast("double")
    return days / F.lit(365.25).cast("double")


def in_year(c, year) -> Column:
    """`c` falls in `year`, as a half-open range so that scans can skip."""
    c = _col(c)
    return (c >= F.lit(f"{year:04d}-01-01")) & (c < F.lit(f"{year + 1:04d}-01-01"))


def nan_to_null(c) -> Column:
    """NaN sorts above every number in Spark; scores must use NULL instead."""
    c = _col(c)
    return F.when(~F.isnan(c), c)
