"""K-means segmentation: scaling, sweep over k, assignment, elbow, silhouette."""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from valuescout.constants import (
    CLUSTER_KS,
    KMEANS_MAX_ITER,
    KMEANS_RESTARTS,
    KMEANS_TOL,
    SPLIT_SEED,
)

# Centres travel with the plan, so their number is checked.
_MAX_CENTRE_VALUES = 1_000_000
_MAX_LITERALS = 512
# seeding: rounds over all rows, and candidates drawn per round and centre
_SEEDING_ROUNDS = 4
_OVERSAMPLING = 4


def scaling(df: DataFrame, columns) -> DataFrame:
    """One row: `<c>_mean` and `<c>_std` (population) per column."""
    stats = []
    for c in columns:
        stats += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return df.agg(*stats)


def standardize(df: DataFrame, columns, prefix="z_") -> DataFrame:
    """Add `z_<c>`: distance from the mean in population standard deviations
    (a constant column gives 0)."""
    stats = scaling(df, columns)
    packed = stats.select(F.struct(*stats.columns)).scalar()
    spread = {c: F.col(f"_scaling.{c}_std") for c in columns}
    return (
        df.withColumn("_scaling", packed)
        .withColumns(
            {
                f"{prefix}{c}": (F.col(c) - F.col(f"_scaling.{c}_mean"))
                / F.when(spread[c] > 0, spread[c]).otherwise(1.0)
                for c in columns
            }
        )
        .drop("_scaling")
    )


@dataclass
class Solution:
    """The best restart for one k; `centers` are in the units of the input.

    `left_out` counts the rows with a missing value, which take no part.
    """

    k: int
    sse: float
    iterations: int
    centers: list
    left_out: int = 0


def kmeans_sweep(
    df: DataFrame,
    columns,
    ks=CLUSTER_KS,
    restarts=KMEANS_RESTARTS,
    max_iter=KMEANS_MAX_ITER,
    tol=KMEANS_TOL,
    seed=SPLIT_SEED,
) -> list[Solution]:
    """Best of `restarts` k-means|| starts for every k (runs jobs).

    Rows with a null or NaN are left out and counted.

    All starts of all k move together: one pass over the persisted rows gives
    every cluster its new centre, so the data is read once per iteration and
    not once per iteration and start. A task folds its rows into one partial
    sum per centre before the shuffle; centres that settled leave the pass.
    A start has settled when its centres move by less than `tol` times the
    mean variance (squared distances, summed over the centres).
    """
    given = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull() & ~F.isnan(c)
    rows = given.filter(complete).persist()
    try:
        n, *variances = rows.agg(F.count("*"), *[F.var_pop(c) for c in columns]).first()
        if not n:
            raise ValueError("no rows to cluster")
        left_out = given.filter(~complete).count()
        still = tol * float(np.mean(variances))
        starts = [(k, start) for k in ks for start in range(restarts if k > 1 else 1)]
        active = _seeds(rows, columns, starts, seed)
        settled = {}
        for iteration in range(1, max_iter + 1):
            moved = _advance(rows, columns, active)
            for task, (centers, _) in moved.items():
                shift = float(((centers - active[task]) ** 2).sum())
                active[task] = centers
                if shift <= still:
                    settled[task] = (active.pop(task), iteration)
            if not active:
                break
        settled |= {task: (centers, max_iter) for task, centers in active.items()}
        costs = _advance(rows, columns, {task: centers for task, (centers, _) in settled.items()})
    finally:
        rows.unpersist()
    best = {}
    for (k, _), (centers, iterations), cost in (
        (task, settled[task], costs[task][1]) for task in sorted(settled)
    ):
        if k not in best or cost < best[k].sse:
            best[k] = Solution(k, cost, iterations, centers.tolist(), left_out)
    return [best[k] for k in sorted(best)]


def _seeds(rows, columns, starts, seed):
    """Starting centres per (k, start), by k-means|| over all rows.

    The first candidate of a start is the row that a hash draws. In each round
    every row becomes a candidate with a probability in proportion to its
    squared distance from the candidates so far (Bahmani et al. 2012); at the
    end each candidate counts as many rows as are nearest to it, and weighted
    k-means++ picks the k centres among them. All starts share each pass. Draws
    are hashes of the row's values, so partitions do not matter; only
    candidates and their weights reach the driver, a few per centre.
    """
    drawn = rows.withColumn("_hash", F.xxhash64(*columns))
    values = ", ".join(f"v{i} double" for i in range(len(columns)))

    def uniform(hashes, salt):
        mixed = (hashes.view("uint64") ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return (mixed ^ (mixed >> np.uint64(29))) / 2.0**64

    def salts(number):
        return np.random.default_rng([seed, number]).integers(0, 1 << 63, len(starts))

    def rows_of(start, points):
        frame = {f"v{i}": points[:, i] for i in range(points.shape[1])}
        return pd.DataFrame({"start": start, **frame})

    def least(batches):
        salt, best = salts(0), {}
        for batch in batches:
            points, hashes = batch[columns].to_numpy(dtype="float64"), batch["_hash"].to_numpy()
            for s in range(len(starts)) if len(points) else ():
                draw = uniform(hashes, salt[s])
                at = draw.argmin()
                best[s] = min(best.get(s, (2.0,)), (draw[at], *points[at]))
        for s, (draw, *point) in best.items():
            yield rows_of(s, np.array([point])).assign(draw=draw)

    firsts = drawn.mapInPandas(least, f"start int, {values}, draw double")
    point = F.struct("draw", *[f"v{i}" for i in range(len(columns))])
    firsts = firsts.groupBy("start").agg(F.min(point).alias("p")).toPandas()
    found = {s: np.array([p[1:]], dtype="float64") for s, p in zip(firsts["start"], firsts["p"])}

    def distance(points, candidates):
        return ((points[:, None, :] - candidates[None]) ** 2).sum(axis=2)

    def measured(costs, number):
        """Costs per start; and, once costs are known, the round's draws."""

        def one(batches):
            total, salt = np.zeros(len(starts)), salts(number)
            for batch in batches:
                points, hashes = batch[columns].to_numpy(dtype="float64"), batch["_hash"].to_numpy()
                for s, (k, _) in enumerate(starts):
                    gap = distance(points, found[s]).min(axis=1)
                    total[s] += gap.sum()
                    if costs is not None and costs[s] > 0:
                        hit = uniform(hashes, salt[s]) < _OVERSAMPLING * k * gap / costs[s]
                        if hit.any():
                            yield rows_of(s, np.unique(points[hit], axis=0)).assign(cost=0.0)
            none = np.full((len(starts), len(columns)), np.nan)
            yield rows_of(np.arange(len(starts)), none).assign(cost=total)

        out = drawn.mapInPandas(one, f"start int, {values}, cost double")
        return out.groupBy("start", *[f"v{i}" for i in range(len(columns))]).agg(F.sum("cost").alias("cost")).toPandas()

    costs = None
    for number in range(1, _SEEDING_ROUNDS + 2):
        table = measured(costs, number)
        points = table[[f"v{i}" for i in range(len(columns))]].to_numpy(dtype="float64")
        drawn_rows = ~np.isnan(points).any(axis=1)
        costs = np.zeros(len(starts))
        costs[table["start"].to_numpy()[~drawn_rows]] = table["cost"].to_numpy()[~drawn_rows]
        for s in found:
            mine = points[drawn_rows & (table["start"].to_numpy() == s)]
            found[s] = np.unique(np.vstack([found[s], mine]), axis=0)

    def weighed(batches):
        total = {s: np.zeros(len(c)) for s, c in found.items()}
        for batch in batches:
            points = batch[columns].to_numpy(dtype="float64")
            for s, candidates in found.items():
                nearest = distance(points, candidates).argmin(axis=1)
                total[s] += np.bincount(nearest, minlength=len(candidates))
        for s, n in total.items():
            yield pd.DataFrame({"start": s, "candidate": np.arange(len(n)), "n": n})

    weights = drawn.mapInPandas(weighed, "start int, candidate int, n double")
    weights = weights.groupBy("start", "candidate").agg(F.sum("n").alias("n")).toPandas().sort_values("candidate")
    out = {}
    for s, (k, start) in enumerate(starts):
        n = weights.loc[weights["start"] == s, "n"].to_numpy()
        out[k, start] = _plus_plus(found[s], n, k, np.random.default_rng([seed, k, start]))
    return out


def _plus_plus(points, counts, k, rng):
    """Each next centre is drawn in proportion to the squared distance from
    the centres so far (Arthur & Vassilvitskii 2007), by weight of the points."""
    centers = [points[rng.choice(len(points), p=counts / counts.sum())]]
    nearest = ((points - centers[0]) ** 2).sum(axis=1)
    while len(centers) < k:
        total = (nearest * counts).sum()
        weights = nearest * counts / total if total > 0 else None
        centers.append(points[rng.choice(len(points), p=weights)])
        nearest = np.minimum(nearest, ((points - centers[-1]) ** 2).sum(axis=1))
    return np.array(centers)


def _advance(rows, columns, models):
    """One pass: {model: (new centres, sse of the old ones)}."""
    flat = np.vstack(list(models.values()))
    ends = np.cumsum([len(c) for c in models.values()])
    spans = [(int(e - len(c)), int(e)) for e, c in zip(ends, models.values())]
    sums = [f"s{i}" for i in range(len(columns))]

    def fold(batches):
        n, sse = np.zeros(len(flat)), np.zeros(len(flat))
        total = np.zeros(flat.shape)
        for batch in batches:
            points = batch.to_numpy(dtype="float64")
            rough = (flat * flat).sum(axis=1) - 2.0 * points @ flat.T
            for low, high in spans:
                nearest = rough[:, low:high].argmin(axis=1)
                member = (nearest[:, None] == np.arange(high - low)).astype("float64")
                gap = points - flat[low + nearest]
                n[low:high] += member.sum(axis=0)
                total[low:high] += member.T @ points
                sse[low:high] += member.T @ (gap * gap).sum(axis=1)
        partial = {"center": np.arange(len(flat)), "n": n, "sse": sse}
        yield pd.DataFrame(partial | {s: total[:, i] for i, s in enumerate(sums)})

    schema = "center int, n double, sse double, " + ", ".join(f"{s} double" for s in sums)
    partials = rows.mapInPandas(fold, schema)
    names = ["n", "sse", *sums]
    folded = partials.groupBy("center").agg(*[F.sum(c).alias(c) for c in names])
    table = folded.toPandas().sort_values("center")[names].to_numpy()
    moved = {}
    for task, (low, high) in zip(models, spans):
        n, cost, total = table[low:high, 0], table[low:high, 1].sum(), table[low:high, 2:]
        kept = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], flat[low:high])
        moved[task] = (kept, float(cost))
    return moved


def kmeans_pass(df: DataFrame, columns, centers) -> DataFrame:
    """(cluster, position, center, sse): one pass of the sweep from the given
    [(cluster, [values])]; `sse` is that of the whole assignment before."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    start = np.array([values for _, values in centers], dtype="float64")
    moved, cost = _advance(rows, list(columns), {0: start})[0]
    cells = [
        (int(cluster), i, float(v), cost)
        for (cluster, _), center in zip(centers, moved)
        for i, v in enumerate(center)
    ]
    return df.sparkSession.createDataFrame(cells, "cluster int, position int, center double, sse double")


def silhouette_of(df: DataFrame, column, cluster) -> DataFrame:
    """(silhouette): squared Euclidean silhouette of given clusters (runs a
    job); `column` holds a vector as an array."""
    vectors = df.select(
        F.col(cluster).cast("double").alias("prediction"),
        array_to_vector(F.col(column).cast("array<double>")).alias("features"),
    )
    score = ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(vectors)
    return df.sparkSession.createDataFrame([(float(score),)], "silhouette double")


def sse_table(spark, solutions) -> DataFrame:
    return spark.createDataFrame(
        [(s.k, float(s.sse), s.iterations) for s in solutions], "k int, sse double, iterations int"
    )


def centroid_table(df: DataFrame, columns, solutions, prefix="z_") -> DataFrame:
    """(k, cluster, <columns>): centres of standardised columns, back in the
    original units of `columns` as found in `df`."""
    rows = [
        (s.k, i, [float(v) for v in center])
        for s in solutions
        for i, center in enumerate(s.centers)
    ]
    table = df.sparkSession.createDataFrame(rows, "k int, cluster int, z array<double>")
    stats = scaling(df, columns)
    packed = stats.select(F.struct(*stats.columns)).scalar()
    values = []
    for i, c in enumerate(columns, start=1):
        spread = F.col(f"_scaling.{c}_std")
        scale = F.when(spread > 0, spread).otherwise(1.0)
        values.append((F.element_at("z", i) * scale + F.col(f"_scaling.{c}_mean")).alias(c))
    return table.withColumn("_scaling", packed).select("k", "cluster", *values)


def collect_centers(centroids: DataFrame, columns, cluster="cluster"):
    """Centres as [(cluster, [values])]; refuses more than fit in a plan."""
    rows = centroids.select(cluster, *columns).limit(_MAX_CENTRE_VALUES + 1).collect()
    if len(rows) * len(columns) > _MAX_CENTRE_VALUES:
        raise ValueError("too many centroids to copy to every task")
    return sorted((r[0], [float(v) for v in r[1:]]) for r in rows)


def nearest(centers, columns):
    """Struct (dist2, cluster) of the nearest of [(cluster, [values])], ties to
    the lower id."""
    distances = []
    for cluster, center in centers:
        dist2 = F.lit(0.0)
        for c, v in zip(columns, center):
            step = F.col(c) - F.lit(float(v))
            dist2 = dist2 + step * step
        distances.append(F.struct(dist2.alias("dist2"), F.lit(cluster).alias("cluster")))
    return F.array_min(F.array(*distances))


def assign(df: DataFrame, centers, columns) -> DataFrame:
    """Add `cluster` (nearest centre) and `dist2`.

    `centers` is [(cluster, [values])]; the distances are plain arithmetic on
    the scanned columns, so rows neither shuffle nor leave the JVM. Where the
    centres have more than a few hundred values, they do not become literals
    of the plan (see `assign_vectors`).
    """
    if len(centers) * len(columns) > _MAX_LITERALS:
        vectors = df.withColumn("_vector", F.array(*[F.col(c).cast("double") for c in columns]))
        return assign_vectors(vectors, centers, "_vector").drop("_vector")
    return (
        df.withColumn("_nearest", nearest(centers, columns))
        .withColumn("cluster", F.col("_nearest.cluster"))
        .withColumn("dist2", F.col("_nearest.dist2"))
        .drop("_nearest")
    )


def assign_vectors(df: DataFrame, centers, column) -> DataFrame:
    """`assign` for one array column with many dimensions: Arrow batches and a
    matrix product per batch instead of thousands of generated terms."""
    ids = np.array([cluster for cluster, _ in centers], dtype="int32")
    matrix = np.array([center for _, center in centers], dtype="float64")

    @F.pandas_udf("cluster int, dist2 double")
    def closest(vectors: pd.Series) -> pd.DataFrame:
        points = np.stack(vectors.to_numpy()).astype("float64")
        rough = -2.0 * points @ matrix.T + (matrix * matrix).sum(axis=1)
        best = rough.argmin(axis=1)
        gap = points - matrix[best]
        return pd.DataFrame({"cluster": ids[best], "dist2": (gap * gap).sum(axis=1)})

    return (
        df.withColumn("_nearest", closest(column))
        .withColumn("cluster", F.col("_nearest.cluster"))
        .withColumn("dist2", F.col("_nearest.dist2"))
        .drop("_nearest")
    )


def vector_means(df: DataFrame, group, column) -> DataFrame:
    """(group, position, mean): the mean vector per group in long form.

    A task adds whole vectors and sends one per group; only the means are laid
    out by position. Vectors that are null or hold a null take no part.
    """
    whole = F.col(column).isNotNull() & F.forall(column, lambda v: v.isNotNull())
    vectors = df.filter(whole).select(group, array_to_vector(F.col(column).cast("array<double>")).alias("_v"))
    means = vectors.groupBy(group).agg(Summarizer.mean(F.col("_v")).alias("_mean"))
    return means.select(group, F.posexplode(vector_to_array("_mean")).alias("position", "mean"))


def collect_vector_centers(means: DataFrame, group):
    """[(group, [values])] from `vector_means`; size checked."""
    rows = means.limit(_MAX_CENTRE_VALUES + 1).collect()
    if len(rows) > _MAX_CENTRE_VALUES:
        raise ValueError("too many centroids to copy to every task")
    centers = {}
    for row in sorted(rows, key=lambda r: (r[group], r["position"])):
        centers.setdefault(row[group], []).append(row["mean"])
    return sorted(centers.items())


def assign_sse(assigned: DataFrame) -> DataFrame:
    """(cluster, n, sse) of an assignment."""
    return assigned.groupBy("cluster").agg(
        F.count("*").alias("n"), F.sum("dist2").alias("sse")
    )


def cluster_means(df: DataFrame, columns, cluster="cluster") -> DataFrame:
    """(cluster, n, mean of every column)."""
    return df.groupBy(cluster).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in columns]
    )


def elbow(sse: DataFrame) -> DataFrame:
    """(k, sse, gain_pct, removed_pct, second_diff, is_elbow) from (k, sse).

    The window spans the handful of k values, never the data.
    """
    by_k = Window.partitionBy(F.lit(1)).orderBy("k")
    whole = Window.partitionBy(F.lit(1))
    before, after = F.lag("sse").over(by_k), F.lead("sse").over(by_k)
    first = F.first("sse").over(by_k)
    table = sse.select(
        "k",
        "sse",
        ((before - F.col("sse")) / before * 100).alias("gain_pct"),
        ((first - F.col("sse")) / first * 100).alias("removed_pct"),
        (before - 2 * F.col("sse") + after).alias("second_diff"),
    )
    peak = F.max("second_diff").over(whole)
    return table.withColumn(
        "is_elbow", F.coalesce(F.col("second_diff") == peak, F.lit(False)).cast("int")
    )


def partition_sse(df: DataFrame, columns, parts) -> DataFrame:
    """(k, sse): within-group spread for several given partitions at once;
    `parts` maps k to the column that holds its group."""
    cells = F.array(
        *[F.struct(F.lit(k).alias("k"), F.col(g).alias("_g")) for k, g in parts.items()]
    )
    spread = F.lit(0.0)
    for c in columns:
        spread = spread + F.var_pop(c) * F.count(c)
    groups = df.select(*columns, F.inline(cells)).groupBy("k", "_g").agg(spread.alias("_sse"))
    return groups.groupBy("k").agg(F.sum("_sse").alias("sse"))


def silhouette(df: DataFrame, columns, solutions) -> DataFrame:
    """(k, silhouette) with squared Euclidean distance, for every k above 1.

    The mean squared distance of a row from a cluster follows from the
    cluster's size, its sum of vectors and its sum of squared lengths. One pass
    adds these up for all clusters of all k (a job), a second one scores every
    row for all k.
    """
    solutions = [s for s in solutions if s.k > 1]
    spark = df.sparkSession
    if not solutions:
        return spark.createDataFrame([], "k int, silhouette double")
    values = [F.col(c).cast("double") for c in columns]
    length = sum((v * v for v in values), F.lit(0.0))
    found = [nearest(list(enumerate(s.centers)), columns)["cluster"].alias(f"_c{s.k}") for s in solutions]
    rows = df.select(*[v.alias(f"_v{i}") for i, v in enumerate(values)], length.alias("_length"), *found)
    labels = F.array(*[F.struct(F.lit(s.k).alias("k"), F.col(f"_c{s.k}").alias("cluster")) for s in solutions])
    sums = [F.sum(f"_v{i}") for i in range(len(values))]
    laid_out = rows.select("*", F.inline(labels))
    stats = laid_out.groupBy("k", "cluster").agg(F.count("*").alias("n"), F.sum("_length").alias("length"), F.array(*sums).alias("sums"))
    clusters = {}
    for r in sorted(stats.collect()):
        clusters.setdefault(r["k"], []).append(r)

    def score(k):
        own, away, size = F.lit(None).cast("double"), [], F.lit(None).cast("long")
        for r in clusters[k]:
            mean = [v / r["n"] for v in r["sums"]]
            dot = sum((F.col(f"_v{i}") * F.lit(v) for i, v in enumerate(mean)), F.lit(0.0))
            distance = F.col("_length") + F.lit(r["length"] / r["n"]) - 2 * dot
            here = F.col(f"_c{k}") == r["cluster"]
            own = F.when(here, distance * (r["n"] / max(r["n"] - 1, 1))).otherwise(own)
            size = F.when(here, F.lit(r["n"])).otherwise(size)
            away.append(F.when(~here, distance))
        other = F.array_min(F.array_compact(F.array(*away)))
        far = F.greatest(own, other)
        return F.when((size == 1) | other.isNull() | (far <= 0), 0.0).otherwise((other - own) / far)

    means = rows.agg(*[F.avg(score(s.k)).alias(f"_s{s.k}") for s in solutions])
    cells = F.array(*[F.struct(F.lit(s.k).alias("k"), F.col(f"_s{s.k}").alias("silhouette")) for s in solutions])
    return means.select(F.inline(cells))
