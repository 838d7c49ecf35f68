"""Do segments agree with variables they never saw, beyond chance?"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from valuescout.constants import BASELINE_SHUFFLES, SPLIT_SEED
from valuescout.session import cut_lineage


def crosstab_long(df: DataFrame, cluster, variable) -> DataFrame:
    """(cluster, class, n); rows without a class are left out."""
    rows = df.filter(F.col(variable).isNotNull() & F.col(cluster).isNotNull())
    return rows.groupBy(F.col(cluster).alias("cluster"), F.col(variable).alias("class")).agg(
        F.count("*").alias("n")
    )


def crosstabs(df: DataFrame, cluster, variables) -> DataFrame:
    """(external_variable, cluster, class, n) for all variables in one pass."""
    cells = F.array(
        *[
            F.struct(F.lit(v).alias("external_variable"), F.col(v).cast("string").alias("class"))
            for v in variables
        ]
    )
    return (
        df.select(F.col(cluster).alias("cluster"), F.inline(cells))
        .filter(F.col("class").isNotNull() & F.col("cluster").isNotNull())
        .groupBy("external_variable", "cluster", "class")
        .agg(F.count("*").alias("n"))
    )


def agreement(tables: DataFrame) -> DataFrame:
    """(external_variable, n_classes, n, purity, normalized_entropy).

    With s the size of a cluster and n its class counts, the size-weighted
    entropy is sum(s ln s) - sum(n ln n) over the number of rows, so one pass
    over the contingency table is enough. One class gives NULL entropy.
    """
    n = F.col("n").cast("double")
    per_cluster = tables.groupBy("external_variable", "cluster").agg(
        F.sum("n").alias("s"), F.max("n").alias("top"), F.sum(n * F.ln(n)).alias("nlnn")
    )
    s = F.col("s").cast("double")
    per_variable = per_cluster.groupBy("external_variable").agg(
        F.sum("s").alias("n"),
        (F.sum("top") / F.sum("s")).alias("purity"),
        ((F.sum(s * F.ln(s)) - F.sum("nlnn")) / F.sum("s")).alias("_entropy"),
    )
    classes = tables.groupBy("external_variable").agg(F.countDistinct("class").alias("n_classes"))
    spread = F.nullif(F.ln(F.col("n_classes").cast("double")), F.lit(0.0))
    return per_variable.join(classes, "external_variable").select(
        "external_variable",
        "n_classes",
        "n",
        "purity",
        (F.col("_entropy") / spread).alias("normalized_entropy"),
    )


def purity(table: DataFrame) -> DataFrame:
    """One row from (cluster, class, n): share of rows in their cluster's
    biggest class."""
    named = table.withColumn("external_variable", F.lit("class"))
    return agreement(named).select("purity")


def norm_entropy(table: DataFrame) -> DataFrame:
    """One row from (cluster, class, n): 0 for pure clusters, 1 for clusters
    that mirror a uniform class mix."""
    named = table.withColumn("external_variable", F.lit("class"))
    return agreement(named).select("normalized_entropy")


def perm_baseline(tables: DataFrame, shuffles=BASELINE_SHUFFLES, seed=SPLIT_SEED) -> DataFrame:
    """(external_variable, purity_random_baseline, entropy_random_baseline):
    means over random relabellings that keep cluster sizes and class totals.

    Shuffling labels and counting again gives a random table with the same
    margins, so tables are drawn from the margins directly. Classes are the
    leaves of a tree whose branches are digits of their hashes. From the root
    on, each node deals its rows, so many of each cluster, to its branches;
    what a branch gets is a row of its own, and a leaf adds its part to the
    figures of its shuffle. No row holds more classes than a node has
    branches, whatever their number. A node's draws have a seed of its own,
    so the result does not depend on partitions.
    """
    key = "external_variable"
    by_cluster = tables.groupBy(key, "cluster").agg(F.sum("n").alias("n"))
    by_class = tables.groupBy(key, F.xxhash64("class").alias("code")).agg(F.sum("n").alias("n"))
    # one entry per cluster
    sizes = by_cluster.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("cluster", "n"))), lambda c: c["n"]).alias("left")
    )
    # A fixed number of tasks: by its few bytes the plan would end up in one.
    tasks = min(shuffles, tables.sparkSession.sparkContext.defaultParallelism)
    draws = sizes.select(
        key, F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))).alias("shuffle"), F.lit(0).cast("long").alias("node"), "left"
    ).repartition(tasks, key, "shuffle")

    def node(digits):
        return F.shiftrightunsigned("code", 64 - _DIGIT_BITS * digits) if digits else F.lit(0).cast("long")

    kinds = f"{key} string, shuffle int, "
    for digits in range(_DIGITS + 1):
        branch = F.col("code") if digits == _DIGITS else node(digits + 1)
        branches = by_class.groupBy(key, node(digits).alias("node"), branch.alias("branch")).agg(F.sum("n").alias("n"))
        branches = branches.groupBy(key, "node").agg(F.sort_array(F.collect_list(F.struct("branch", "n"))).alias("branches"))
        met = draws.join(F.broadcast(branches) if digits == 0 else branches, [key, "node"])
        met = met.select(key, "shuffle", "node", "left", F.col("branches.branch").alias("branch"), F.col("branches.n").alias("n"))
        if digits < _DIGITS:
            draws = met.mapInPandas(lambda b: _dealt(b, seed), f"{kinds} node long, left array<long>")
        else:
            leaves = met.mapInPandas(lambda b: _leaf_sums(b, seed), f"{kinds} cluster int, top long, nlnn double")

    found = leaves.groupBy(key, "shuffle", "cluster").agg(F.max("top").alias("top"), F.sum("nlnn").alias("nlnn"))
    found = found.groupBy(key, "shuffle").agg(F.sum("top").alias("top"), F.sum("nlnn").alias("nlnn"))
    size = F.col("n").cast("double")
    margins = by_cluster.groupBy(key).agg(F.sum("n").alias("rows"), F.sum(size * F.ln(size)).alias("slns"))
    classes = by_class.groupBy(key).agg(F.count("*").alias("classes"))
    found = found.join(F.broadcast(margins.join(classes, key)), key)
    spread = F.nullif(F.ln(F.col("classes").cast("double")), F.lit(0.0))
    return found.groupBy(key).agg(
        F.avg(F.col("top") / F.col("rows")).alias("purity_random_baseline"),
        F.avg((F.col("slns") - F.col("nlnn")) / F.col("rows") / spread).alias("entropy_random_baseline"),
    )


# a node has at most 2 ** 10 branches, down to a million nodes
_DIGIT_BITS, _DIGITS = 10, 2


def _allotted(row, seed):
    """(branch, rows of each cluster) for the branches of a node."""
    left, branches = np.asarray(row.left, "int64"), list(zip(row.branch, row.n))
    rng = np.random.default_rng([seed, int(row.shuffle), int(row.node) & 0xFFFFFFFFFFFFFFFF]) if len(branches) > 1 else None
    for branch, n in branches[:-1]:
        part = _draw(rng, left, int(n))
        left = left - part
        yield branch, part
    yield branches[-1][0], left


def _dealt(batches, seed):
    for batch in batches:
        out = [
            (row.external_variable, row.shuffle, branch, part)
            for row in batch.itertuples(index=False)
            for branch, part in _allotted(row, seed)
        ]
        yield pd.DataFrame(out, columns=["external_variable", "shuffle", "node", "left"])


def _leaf_sums(batches, seed):
    """Per leaf and cluster: rows of the largest class, and the sum of n ln n."""
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            table = np.array([part for _, part in _allotted(row, seed)], dtype="float64")
            logs = (table * np.log(np.where(table > 0, table, 1.0))).sum(axis=0)
            cells = enumerate(zip(table.max(axis=0).tolist(), logs.tolist()))
            out += [(row.external_variable, row.shuffle, i, int(top), nlnn) for i, (top, nlnn) in cells]
        yield pd.DataFrame(out, columns=["external_variable", "shuffle", "cluster", "top", "nlnn"])


def _draw(rng, left, size):
    """How many of each kind are among `size` rows drawn from `left`; one
    sampler for populations of any size, as numpy's ends at 10**9."""
    row, rest = np.zeros_like(left), int(left.sum())
    for i, total in enumerate(left[:-1].tolist()):
        rest -= total
        row[i] = _hypergeometric(rng, total, rest, size)
        size -= int(row[i])
    row[-1] = size
    return row


def _hypergeometric(rng, good, bad, size):
    """One draw by inversion over mean +- 12 standard deviations; what lies
    beyond is below the resolution of a double."""
    low, high = max(0, size - bad), min(good, size)
    if low == high:
        return low
    n, p = good + bad, good / (good + bad)
    sd = np.sqrt(size * p * (1 - p) * max(n - size, 1) / max(n - 1, 1))
    first = max(low, int(size * p - 12 * sd) - 1)
    last = min(high, int(size * p + 12 * sd) + 1)
    x = np.arange(first, last, dtype="float64")
    ratio = np.log(good - x) + np.log(size - x) - np.log(x + 1) - np.log(bad - size + x + 1)
    weights = np.concatenate([[0.0], np.cumsum(ratio)])
    mass = np.cumsum(np.exp(weights - weights.max()))
    return first + int(np.searchsorted(mass, rng.random() * mass[-1]))


def external_validation(
    df: DataFrame, cluster, variables, shuffles=BASELINE_SHUFFLES, seed=SPLIT_SEED
) -> DataFrame:
    """One row per variable: n_classes, purity, its random baseline, the lift,
    normalised entropy and its random baseline. The contingency tables are
    written once (a job), as every figure is read off them."""
    tables = cut_lineage(crosstabs(df, cluster, variables))
    found = agreement(tables).drop("n")
    return found.join(perm_baseline(tables, shuffles, seed), "external_variable").select(
        "external_variable",
        "n_classes",
        "purity",
        "purity_random_baseline",
        (F.col("purity") - F.col("purity_random_baseline")).alias("purity_lift"),
        "normalized_entropy",
        "entropy_random_baseline",
    )
