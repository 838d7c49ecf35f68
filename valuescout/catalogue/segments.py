"""Queries over segments: scaling, assignment, elbow, validation, profiles."""

from pyspark.sql import functions as F

from valuescout.catalogue.tables import SQL_SEGMENTS, segment_inputs, table
from valuescout.operators import profile as pr, segments as sg, validation as vd
from valuescout.operators.quantiles import tertile
from valuescout.session import cut_lineage

# Listing signals that play the segmentation variables.
VARIABLES = ("price_clean", "review_count", "positive_rate", "discount_pct", "residual")
EXTERNALS = ("price_tertile", "room_type", "discount_tertile", "neighbourhood_cleansed")
KS = (1, 2, 3, 4, 5, 6, 7)


def _rounded(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


def standardize(spark, sf_dir):
    scaled = sg.standardize(segment_inputs(spark, sf_dir), VARIABLES)
    names = [f"z_{c}" for c in VARIABLES]
    return _rounded(scaled.select("listing_id", *names), *names)


STANDARDIZE = f"""
WITH {SQL_SEGMENTS}
SELECT listing_id, {", ".join(
    f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS z_{c}" for c in VARIABLES)}
FROM segments"""


def _label_centers(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    means = sg.vector_means(vectors, "label", "embedding")
    return vectors, sg.collect_vector_centers(means, "label")


def cluster_means(spark, sf_dir):
    means = sg.vector_means(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return _rounded(means, "mean")


CLUSTER_MEANS = """
SELECT label, CAST(i - 1 AS INTEGER) AS position, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean
FROM embeddings, range(1, 65) t(i) GROUP BY label, i"""


def assign_sse(spark, sf_dir):
    """Every vector to the nearest of the label means."""
    vectors, centers = _label_centers(spark, sf_dir)
    return _rounded(sg.assign_sse(sg.assign_vectors(vectors, centers, "embedding")), "sse", places=4)


ASSIGN_SSE = """
WITH means AS (
  SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m
  FROM embeddings, range(1, 65) t(i) GROUP BY label, i),
centers AS (SELECT label AS cluster, list(m ORDER BY i) AS c FROM means GROUP BY label),
nearest AS (
  SELECT vec_id, cluster,
         list_sum(list_transform(range(1, 65), lambda i: (embedding[i] - c[i]) * (embedding[i] - c[i]))) AS dist2
  FROM embeddings, centers
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist2, cluster) = 1)
SELECT cluster, count(*) AS n, round(sum(dist2), 4) AS sse FROM nearest GROUP BY cluster"""


def kmeans_step(spark, sf_dir):
    """One K-means pass from the label means: new centres and the SSE."""
    vectors, centers = _label_centers(spark, sf_dir)
    names = [f"e{i}" for i in range(64)]
    flat = vectors.select(*[F.col("embedding")[i].alias(n) for i, n in enumerate(names)])
    return _rounded(sg.kmeans_pass(flat, names, centers), "center", "sse", places=4)


KMEANS_STEP = f"""
{ASSIGN_SSE[: ASSIGN_SSE.index("SELECT cluster, count(*)")]},
cost AS (SELECT sum(dist2) AS sse FROM nearest)
SELECT CAST(cluster AS INTEGER) AS cluster, CAST(i - 1 AS INTEGER) AS position,
       round(avg(CAST(embedding[i] AS DOUBLE)), 4) AS center, round(any_value(sse), 4) AS sse
FROM nearest JOIN embeddings USING (vec_id), range(1, 65) t(i), cost GROUP BY cluster, i"""


def silhouette_given(spark, sf_dir):
    return _rounded(sg.silhouette_of(table(spark, sf_dir, "embeddings"), "embedding", "label"), "silhouette")


SILHOUETTE_GIVEN = """
WITH points AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
sums AS (SELECT label, i, sum(v[i]) AS y FROM points, range(1, 65) t(i) GROUP BY label, i),
groups AS (SELECT label, list(y ORDER BY i) AS y FROM sums GROUP BY label),
sizes AS (
  SELECT label, count(*) AS n, sum(list_sum(list_transform(v, lambda x: x * x))) AS psi FROM points GROUP BY label),
totals AS (
  SELECT vec_id, p.label AS own, g.label AS other, n,
         n * list_sum(list_transform(v, lambda x: x * x)) + psi
         - 2 * list_sum(list_transform(range(1, 65), lambda i: v[i] * y[i])) AS total
  FROM points p, groups g JOIN sizes s ON g.label = s.label),
gaps AS (
  SELECT vec_id, max(CASE WHEN own = other THEN CASE WHEN n > 1 THEN total / (n - 1) END END) AS a,
         min(CASE WHEN own <> other THEN total / n END) AS b
  FROM totals GROUP BY vec_id)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM gaps"""


def assign_regions(spark, sf_dir):
    """Every listing to the nearest of the region means, in two dimensions."""
    inputs = segment_inputs(spark, sf_dir).select(
        "listing_id", F.col("cluster").alias("region"), "positive_rate", "discount_pct"
    )
    axes = ["positive_rate", "discount_pct"]
    means = inputs.groupBy("region").agg(*[F.avg(c).alias(c) for c in axes])
    centers = sg.collect_centers(means, axes, "region")
    assigned = sg.assign(inputs, centers, axes)
    return _rounded(assigned.select("listing_id", "region", "cluster", "dist2"), "dist2")


ASSIGN = f"""
WITH {SQL_SEGMENTS},
centers AS (
  SELECT cluster AS region, avg(positive_rate) AS a, avg(discount_pct) AS b FROM segments GROUP BY cluster)
SELECT listing_id, s.cluster AS region, c.region AS cluster,
       round(pow(positive_rate - a, 2) + pow(discount_pct - b, 2), 6) AS dist2
FROM segments s, centers c
QUALIFY row_number() OVER (PARTITION BY listing_id
  ORDER BY pow(positive_rate - a, 2) + pow(discount_pct - b, 2), c.region) = 1"""


def _partitions(spark, sf_dir):
    """Nested partitions of the listings: 1 group, then by room type, nation."""
    inputs = segment_inputs(spark, sf_dir)
    parts = {1: F.lit("all")}
    parts[2] = (F.col("price_clean") > F.col("predicted_price")).cast("string")
    parts[3] = F.col("cluster").cast("string")
    parts[4] = F.col("room_type")
    parts[5] = F.col("neighbourhood_cleansed")
    marked = inputs.withColumns({f"_g{k}": g for k, g in parts.items()})
    return marked, {k: f"_g{k}" for k in parts}


def elbow_table(spark, sf_dir):
    marked, parts = _partitions(spark, sf_dir)
    sse = sg.partition_sse(marked, ["positive_rate", "discount_pct"], parts)
    curve = sg.elbow(sse)
    return _rounded(curve, "sse", "gain_pct", "removed_pct", "second_diff", places=4)


ELBOW_TABLE = f"""
WITH {SQL_SEGMENTS},
cells AS (
  SELECT k, positive_rate AS a, discount_pct AS b,
         CASE k WHEN 1 THEN 'all' WHEN 2 THEN CAST(price_clean > predicted_price AS VARCHAR)
                WHEN 3 THEN CAST(cluster AS VARCHAR) WHEN 4 THEN room_type ELSE neighbourhood_cleansed END AS g
  FROM segments, range(1, 6) t(k)),
spread AS (SELECT k, g, count(*) * (var_pop(a) + var_pop(b)) AS s FROM cells GROUP BY k, g),
sse AS (SELECT CAST(k AS INTEGER) AS k, sum(s) AS sse FROM spread GROUP BY k),
curve AS (
  SELECT k, sse, (lag(sse) OVER w - sse) / lag(sse) OVER w * 100 AS gain_pct,
         (first(sse) OVER w - sse) / first(sse) OVER w * 100 AS removed_pct,
         lag(sse) OVER w - 2 * sse + lead(sse) OVER w AS second_diff
  FROM sse WINDOW w AS (ORDER BY k))
SELECT k, round(sse, 4) AS sse, round(gain_pct, 4) AS gain_pct, round(removed_pct, 4) AS removed_pct,
       round(second_diff, 4) AS second_diff,
       CAST(coalesce(second_diff = max(second_diff) OVER (), false) AS INTEGER) AS is_elbow
FROM curve"""


def _external(spark, sf_dir):
    """Inputs with their tertiles; written once, as three passes read them."""
    inputs = cut_lineage(segment_inputs(spark, sf_dir))
    return tertile(inputs, {"price_tertile": "price_clean", "discount_tertile": "discount_pct"})


_SQL_EXTERNAL = f"""{SQL_SEGMENTS},
edges AS (
  SELECT quantile_cont(price_clean, [1/3, 2/3]) AS p, quantile_cont(discount_pct, [1/3, 2/3]) AS d
  FROM segments),
external AS (
  SELECT s.*,
         CASE WHEN price_clean <= p[1] THEN 'low' WHEN price_clean <= p[2] THEN 'mid' ELSE 'high' END AS price_tertile,
         CASE WHEN discount_pct <= d[1] THEN 'low' WHEN discount_pct <= d[2] THEN 'mid' ELSE 'high' END AS discount_tertile
  FROM segments s, edges),
tables AS ({" UNION ALL ".join(
    f"SELECT '{v}' AS external_variable, cluster, CAST({v} AS VARCHAR) AS class, count(*) AS n "
    f"FROM external GROUP BY ALL" for v in EXTERNALS)})"""


def tertiles(spark, sf_dir):
    return _external(spark, sf_dir).select("listing_id", "price_tertile", "discount_tertile")


def crosstab(spark, sf_dir):
    return vd.crosstabs(_external(spark, sf_dir), "cluster", EXTERNALS)


def purity(spark, sf_dir):
    found = vd.agreement(crosstab(spark, sf_dir))
    return _rounded(found.select("external_variable", "n_classes", "n", "purity"), "purity")


PURITY = f"""
WITH {_SQL_EXTERNAL},
tops AS (SELECT external_variable, cluster, max(n) AS top, sum(n) AS s FROM tables GROUP BY ALL),
classes AS (SELECT external_variable, count(DISTINCT class) AS n_classes FROM tables GROUP BY ALL)
SELECT external_variable, n_classes, CAST(sum(s) AS BIGINT) AS n, round(sum(top) / sum(s), 6) AS purity
FROM tops JOIN classes USING (external_variable) GROUP BY ALL"""


def norm_entropy(spark, sf_dir):
    found = vd.agreement(crosstab(spark, sf_dir))
    return _rounded(found.select("external_variable", "normalized_entropy"), "normalized_entropy")


NORM_ENTROPY = f"""
WITH {_SQL_EXTERNAL},
shares AS (
  SELECT external_variable, cluster, n, n / sum(n) OVER (PARTITION BY external_variable, cluster) AS p,
         count(DISTINCT class) OVER (PARTITION BY external_variable) AS k
  FROM tables)
SELECT external_variable, round(sum(-n * ln(p)) / sum(n) / ln(max(k)), 6) AS normalized_entropy
FROM shares GROUP BY external_variable"""


def perm_baseline(spark, sf_dir):
    return vd.perm_baseline(cut_lineage(crosstab(spark, sf_dir)))


def external_validation(spark, sf_dir):
    return vd.external_validation(_external(spark, sf_dir), "cluster", EXTERNALS)


def external_observed(spark, sf_dir):
    """The observed half of the validation table, read off the table itself."""
    found = external_validation(spark, sf_dir)
    return _rounded(found.select("external_variable", "n_classes", "purity", "normalized_entropy"), "purity", "normalized_entropy")


EXTERNAL_OBSERVED = f"""
WITH {_SQL_EXTERNAL},
per_cluster AS (
  SELECT external_variable, cluster, sum(n) AS s, max(n) AS top, sum(n * ln(n)) AS nlnn
  FROM tables GROUP BY external_variable, cluster),
classes AS (SELECT external_variable, count(DISTINCT class) AS n_classes FROM tables GROUP BY external_variable)
SELECT external_variable, n_classes, round(CAST(sum(top) AS DOUBLE) / sum(s), 6) AS purity,
       round((sum(s * ln(s)) - sum(nlnn)) / sum(s) / nullif(ln(n_classes), 0), 6) AS normalized_entropy
FROM per_cluster JOIN classes USING (external_variable) GROUP BY external_variable, n_classes"""


MEANS = (
    ("mean_price_clean", "price_clean", 1),
    ("mean_predicted_price", "predicted_price", 1),
    ("mean_residual_price", "residual", 1),
    ("mean_discount_pct", "discount_pct", 100),
    ("mean_positive_rate_pct", "positive_rate", 100),
    ("mean_number_of_reviews", "review_count", 1),
)


def cluster_profile(spark, sf_dir):
    found = pr.cluster_profile(segment_inputs(spark, sf_dir), MEANS)
    return _rounded(found, *[name for name, _, _ in MEANS], places=4)


CLUSTER_PROFILE = f"""
WITH {SQL_SEGMENTS}
SELECT cluster, count(*) AS n_listings,
       {", ".join(f"round(avg({c}) * {f}, 4) AS {name}" for name, c, f in MEANS)}
FROM segments GROUP BY cluster"""


def room_mix(spark, sf_dir):
    return pr.category_mix(segment_inputs(spark, sf_dir), "room_type")


ROOM_MIX = f"""
WITH {SQL_SEGMENTS}
SELECT cluster, room_type AS category, count(*) AS n,
       round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY cluster), 1) AS pct
FROM segments GROUP BY cluster, room_type"""


def top_neigh(spark, sf_dir):
    return pr.top_per_group(segment_inputs(spark, sf_dir), "neighbourhood_cleansed", 3)


TOP_NEIGH = f"""
WITH {SQL_SEGMENTS}
SELECT cluster, neighbourhood_cleansed AS category, count(*) AS n,
       CAST(row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, neighbourhood_cleansed) AS INTEGER) AS rank
FROM segments GROUP BY cluster, neighbourhood_cleansed QUALIFY rank <= 3"""


def cluster_z(spark, sf_dir):
    # Two hundredths of a deviation is already far for regions drawn at random.
    found = pr.cluster_z(segment_inputs(spark, sf_dir), VARIABLES, cap=0.02)
    return _rounded(found, "mean", "z", "z_clipped", places=4)


CLUSTER_Z = f"""
WITH {SQL_SEGMENTS},
cells AS ({" UNION ALL ".join(
    f"SELECT cluster, '{c}' AS variable, CAST({c} AS DOUBLE) AS v FROM segments" for c in VARIABLES)}),
overall AS (SELECT variable, avg(v) AS m, stddev_samp(v) AS s FROM cells GROUP BY variable),
z AS (
  SELECT cluster, variable, count(*) AS n, avg(v) AS mean, (avg(v) - any_value(m)) / any_value(s) AS z
  FROM cells JOIN overall USING (variable) GROUP BY cluster, variable)
SELECT cluster, variable, n, round(mean, 4) AS mean, round(z, 4) AS z,
       round(greatest(least(z, 0.02::DOUBLE), -0.02::DOUBLE), 4) AS z_clipped,
       CAST(abs(z) > 0.02 AS INTEGER) AS clipped
FROM z"""


def _sweep(spark, sf_dir, ks=KS):
    """Scaled listing signals and the best K-means solution per k."""
    scaled = cut_lineage(sg.standardize(segment_inputs(spark, sf_dir), VARIABLES))
    columns = [f"z_{c}" for c in VARIABLES]
    return scaled, columns, sg.kmeans_sweep(scaled, columns, ks)


def kmeans_sweep(spark, sf_dir):
    """SSE per k with gains, and the sizes of the clusters found."""
    scaled, columns, solutions = _sweep(spark, sf_dir)
    curve = sg.elbow(sg.sse_table(spark, solutions).select("k", "sse"))
    labels = [
        F.struct(
            F.lit(s.k).alias("k"),
            sg.nearest(list(enumerate(s.centers)), columns)["cluster"].alias("cluster"),
        )
        for s in solutions
    ]
    sizes = scaled.select(F.inline(F.array(*labels))).groupBy("k", "cluster").agg(
        F.count("*").alias("n")
    )
    listed = sizes.groupBy("k").agg(F.sort_array(F.collect_list("n"), asc=False).alias("sizes"))
    return curve.join(listed, "k")


def kmeans_centroids(spark, sf_dir):
    scaled, _, solutions = _sweep(spark, sf_dir, (4,))
    return sg.centroid_table(scaled, VARIABLES, solutions)


def silhouette(spark, sf_dir):
    scaled, columns, solutions = _sweep(spark, sf_dir, (2, 3, 4, 5, 6))
    return sg.silhouette(scaled, columns, solutions)


QUERIES = {
    "standardize": standardize,
    "cluster_means": cluster_means,
    "assign_sse": assign_sse,
    "assign": assign_regions,
    "elbow_table": elbow_table,
    "tertiles": tertiles,
    "crosstab": crosstab,
    "purity": purity,
    "norm_entropy": norm_entropy,
    "perm_baseline": perm_baseline,
    "external_validation": external_validation,
    "external_observed": external_observed,
    "cluster_profile": cluster_profile,
    "room_mix": room_mix,
    "top_neigh": top_neigh,
    "cluster_z": cluster_z,
    "kmeans_step": kmeans_step,
    "silhouette_given": silhouette_given,
    "kmeans_sweep": kmeans_sweep,
    "kmeans_centroids": kmeans_centroids,
    "silhouette": silhouette,
}

ORACLES = {
    "kmeans_step": KMEANS_STEP,
    "silhouette_given": SILHOUETTE_GIVEN,
    "standardize": STANDARDIZE,
    "cluster_means": CLUSTER_MEANS,
    "assign_sse": ASSIGN_SSE,
    "assign": ASSIGN,
    "elbow_table": ELBOW_TABLE,
    "tertiles": f"WITH {_SQL_EXTERNAL} SELECT listing_id, price_tertile, discount_tertile FROM external",
    "crosstab": f"WITH {_SQL_EXTERNAL} SELECT * FROM tables",
    "purity": PURITY,
    "norm_entropy": NORM_ENTROPY,
    "external_observed": EXTERNAL_OBSERVED,
    "cluster_profile": CLUSTER_PROFILE,
    "room_mix": ROOM_MIX,
    "top_neigh": TOP_NEIGH,
    "cluster_z": CLUSTER_Z,
}
