"""Amenity labels kept as a JSON array in a text cell."""

from pyspark.sql import Column, functions as F

from valuescout.constants import AMENITY_PATTERNS
from valuescout.functions.values import _col, strip


def parse_amenities(c) -> Column:
    """The labels; empty for anything that is not a JSON list."""
    text = strip(c)
    bracketed = F.when(text.startswith("[") & text.endswith("]"), text)
    return F.coalesce(
        F.from_json(bracketed, "array<string>"), F.array().cast("array<string>")
    )


def amenities_count(labels) -> Column:
    return F.size(_col(labels))


def amenity_flags(labels, patterns=AMENITY_PATTERNS) -> list[Column]:
    """One 0/1 column per pattern.

    The labels are laid out one per line and searched as one text: `.` stops
    at a line end, so no match spans two labels, and the search stays a plain
    compiled expression instead of a lambda per label and flag.
    """
    lines = F.array_join(_col(labels), "\n")
    return [
        F.coalesce(lines.rlike(f"(?iUd){pattern}"), F.lit(False)).cast("int").alias(name)
        for name, pattern in patterns.items()
    ]
