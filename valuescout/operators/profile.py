"""What the segments look like: means, mixes, top categories, z-scores."""

from pyspark.sql import DataFrame, Window, functions as F

from valuescout.constants import Z_CAP

# Profile columns as (output name, input column, factor).
PROFILE_MEANS = (
    ("mean_latitude", "latitude", 1),
    ("mean_longitude", "longitude", 1),
    ("mean_accommodates", "accommodates", 1),
    ("mean_bedrooms", "bedrooms", 1),
    ("mean_amenities_count", "amenities_count", 1),
    ("mean_price_clean", "price_clean", 1),
    ("mean_predicted_price", "predicted_price", 1),
    ("mean_residual_price", "residual", 1),
    ("mean_discount_pct", "discount_pct", 100),
    ("mean_positive_rate_pct", "positive_rate", 100),
    ("mean_number_of_reviews", "number_of_reviews", 1),
)


def cluster_profile(df: DataFrame, means=PROFILE_MEANS, cluster="cluster") -> DataFrame:
    """(cluster, n_listings, one mean per entry)."""
    return df.groupBy(cluster).agg(
        F.count("*").alias("n_listings"),
        *[(F.avg(c) * factor).alias(name) for name, c, factor in means],
    )


def category_mix(df: DataFrame, category, cluster="cluster") -> DataFrame:
    """(cluster, category, n, pct): share of each category, one decimal."""
    counts = (
        df.filter(F.col(category).isNotNull())
        .groupBy(cluster, F.col(category).alias("category"))
        .agg(F.count("*").alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy(cluster))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / total, 1))


def top_per_group(df: DataFrame, category, n=3, cluster="cluster") -> DataFrame:
    """(cluster, category, n, rank): the most frequent categories, ties by name.
    Ranking is over counts, one row per category."""
    counts = (
        df.filter(F.col(category).isNotNull())
        .groupBy(cluster, F.col(category).alias("category"))
        .agg(F.count("*").alias("n"))
    )
    best = Window.partitionBy(cluster).orderBy(F.desc("n"), "category")
    return counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def as_map(table: DataFrame, value, order, name, cluster="cluster") -> DataFrame:
    """Long (cluster, category, value) rows as one map cell per cluster, in
    descending `order`."""
    entry = F.struct((-F.col(order)).alias("o"), F.col("category"), F.col(value).alias("v"))
    entries = F.sort_array(F.collect_list(entry))
    pairs = F.transform(entries, lambda e: F.struct(e["category"], e["v"]))
    return table.groupBy(cluster).agg(F.map_from_entries(pairs).alias(name))


def full_profile(df: DataFrame, means=PROFILE_MEANS, cluster="cluster") -> DataFrame:
    """`cluster_profile` plus the room-type mix and top neighbourhoods as maps."""
    mix = as_map(category_mix(df, "room_type", cluster), "pct", "n", "room_type_distribution_pct", cluster)
    top = as_map(top_per_group(df, "neighbourhood_cleansed", 3, cluster), "n", "n", "top_neighbourhoods", cluster)
    return cluster_profile(df, means, cluster).join(mix, cluster, "left").join(top, cluster, "left")


def cluster_z(df: DataFrame, columns, cap=Z_CAP, cluster="cluster") -> DataFrame:
    """(cluster, variable, n, mean, z, z_clipped, clipped): distance of the
    cluster mean from the overall mean in overall sample standard deviations.

    The data is read once: overall moments are combined from the clusters'.
    """
    cells = F.array(
        *[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("_v")) for c in columns]
    )
    per_cluster = (
        df.select(cluster, F.inline(cells))
        .groupBy("variable", cluster)
        .agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.var_pop("_v").alias("_var"))
    )
    whole = Window.partitionBy("variable")
    total = F.sum("n").over(whole)
    overall = F.sum(F.col("n") * F.col("mean")).over(whole) / total
    shift = F.col("mean") - F.col("_overall")
    table = per_cluster.withColumn("_n", total).withColumn("_overall", overall)
    spread = F.sum(F.col("n") * (F.col("_var") + shift * shift)).over(whole) / (F.col("_n") - 1)
    z = shift / F.sqrt(F.nullif(F.col("_spread"), F.lit(0.0)))
    return (
        table.withColumn("_spread", spread)
        .withColumn("z", z)
        .select(
            cluster,
            "variable",
            "n",
            "mean",
            "z",
            F.greatest(F.least(F.col("z"), F.lit(cap)), F.lit(-cap)).alias("z_clipped"),
            F.coalesce((F.abs("z") > cap).cast("int"), F.lit(0)).alias("clipped"),
        )
    )
