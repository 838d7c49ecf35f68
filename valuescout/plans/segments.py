"""Gems -> segments -> validation and profile."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from valuescout.constants import (
    BASELINE_SHUFFLES,
    CLUSTER_KS,
    CLUSTER_VARIABLES,
    EXTERNAL_VARIABLES,
    FINAL_K,
    PROFILE_VARIABLES,
)
from valuescout.operators import segments as ops
from valuescout.operators.profile import full_profile
from valuescout.operators.quantiles import tertile
from valuescout.operators.rows import drop_missing
from valuescout.operators.validation import external_validation
from valuescout.session import cut_lineage


_BINNED = {"price": "price_clean", "discount": "discount_pct"}


@dataclass
class Segments:
    solutions: list
    sse: DataFrame
    elbow: DataFrame
    centroids: DataFrame
    assignments: dict


def enrich(
    gems: DataFrame,
    listings: DataFrame,
    predictions: DataFrame,
    variables=CLUSTER_VARIABLES,
    profile=PROFILE_VARIABLES,
) -> DataFrame:
    """Gems with the attributes that describe them; no gem is lost."""
    attributes = listings.withColumnRenamed("id", "listing_id").select(
        "listing_id", *variables, *profile
    )
    residuals = predictions.withColumnRenamed("id", "listing_id").select("listing_id", "residual")
    return gems.join(attributes, "listing_id", "left").join(residuals, "listing_id", "left")


def segment(df: DataFrame, variables=CLUSTER_VARIABLES, ks=CLUSTER_KS, **settings) -> Segments:
    """K-means for every k on standardised variables (runs jobs); rows with a
    missing variable are left out. `assignments[k]` adds `cluster`, `dist2`."""
    scaled = cut_lineage(ops.standardize(drop_missing(df, variables), variables))
    columns = [f"z_{c}" for c in variables]
    solutions = ops.kmeans_sweep(scaled, columns, ks, **settings)
    sse = ops.sse_table(df.sparkSession, solutions)
    return Segments(
        solutions,
        sse,
        ops.elbow(sse.select("k", "sse")),
        ops.centroid_table(scaled, variables, solutions),
        {s.k: ops.assign(scaled, list(enumerate(s.centers)), columns) for s in solutions},
    )


def validate_segments(
    assigned: DataFrame, variables=EXTERNAL_VARIABLES, shuffles=BASELINE_SHUFFLES
) -> DataFrame:
    """Agreement with price, room type and discount, against chance."""
    binned = {f"{name}_tertile": column for name, column in _BINNED.items()}
    wanted = {name: column for name, column in binned.items() if name in variables}
    if wanted:
        assigned = tertile(assigned, wanted)
    return external_validation(assigned, "cluster", variables, shuffles)


def profile_segments(segments: Segments, k=FINAL_K) -> DataFrame:
    return full_profile(segments.assignments[k])
