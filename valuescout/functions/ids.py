"""Business keys stay strings: 19 digits do not survive a double."""

from pyspark.sql import Column, functions as F

from valuescout.functions.values import _col, strip


def valid_id(c) -> Column:
    """The id without blanks or a trailing `.0`; NULL unless all digits."""
    text = F.regexp_replace(strip(c), r"\.0$", "")
    return F.when(text.rlike("^[0-9]+$"), text)


def hash_bucket(c, seed=42, buckets=5) -> Column:
    """Bucket of an id, the same on every run and under any partitioning."""
    digest = F.md5(F.concat(_col(c).cast("string"), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def in_test_set(c, seed=42, buckets=5) -> Column:
    """1 for the four in five ids held out of training, 0 for the rest."""
    return (hash_bucket(c, seed, buckets) != 0).cast("int")
