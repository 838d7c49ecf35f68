"""Regression trees whose thresholds are chosen among all values.

A tree grows level by level, one job each. For every open node and feature the
distinct values are sorted with the number and the sum of the labels up to
each; the split with the least squared error wins. No values are binned, and
the depth is limited only if asked for.

Sorting is spread: values are cut into ranges by their leading digits
(`ordered_code`), ranges are added up first, and each range is sorted by itself
on top of what lies before it. So no task holds all values of a feature.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from valuescout.functions.order import ordered_code
from valuescout.session import cut_lineage

MAX_NODES = 100_000  # of a level; they pass through the driver and are copied to all tasks
_RANGE_BITS = 28  # sign, exponent and 16 bits of the mantissa
# labels are added up as decimals, so that no sum depends on the order of the rows
LABEL = "decimal(28,12)"
_LEVELS_PER_CUT = 4


@dataclass
class Node:
    """`feature` is a position among the features, None for a leaf; rows with a
    value above the threshold go to node 2 * number + 1, others to 2 * number."""

    number: int
    n: int
    mean: float
    feature: int | None = None
    threshold: float | None = None
    gain: float = 0.0

    @property
    def depth(self):
        return self.number.bit_length() - 1


@dataclass
class ExactTree:
    features: list
    nodes: list

    @property
    def depth(self):
        return max((node.depth for node in self.nodes), default=0)

    @property
    def leaves(self):
        return sum(node.feature is None for node in self.nodes)

    def importances(self):
        """Share of the error that the splits on each feature take away."""
        total = sum(node.gain for node in self.nodes)
        found = dict.fromkeys(self.features, 0.0)
        for node in self.nodes:
            if node.feature is not None:
                found[self.features[node.feature]] += node.gain / total
        return found


def level_splits(rows: DataFrame, min_leaf=1) -> DataFrame:
    """(_node, n, s, gain, feature, threshold) for rows (_node, _x, _y): totals
    of every node and its best split, NULL where none lessens the error."""
    cells = rows.select("_node", "_y", F.posexplode("_x").alias("_f", "_v"))
    values = cells.groupBy("_node", "_f", "_v").agg(F.count("*").alias("_n"), F.sum("_y").alias("_s"))
    values = values.withColumn("_range", F.shiftright(ordered_code("_v"), 64 - _RANGE_BITS))

    ranges = values.groupBy("_node", "_f", "_range").agg(
        F.sum("_n").alias("_rn"), F.sum("_s").alias("_rs"), F.min("_v").alias("_least")
    )
    feature = Window.partitionBy("_node", "_f")
    before = feature.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        "_node",
        "_f",
        "_range",
        F.coalesce(F.sum("_rn").over(before), F.lit(0)).alias("_bn"),
        F.coalesce(F.sum("_rs").over(before), F.lit(0)).alias("_bs"),
        F.sum("_rn").over(feature).alias("_tn"),
        F.sum("_rs").over(feature).alias("_ts"),
        F.lead("_least").over(feature.orderBy("_range")).alias("_onward"),
    )
    inside = Window.partitionBy("_node", "_f", "_range").orderBy("_v")
    placed = values.join(ranges, ["_node", "_f", "_range"])
    upto = placed.select(
        "_node",
        "_f",
        "_v",
        "_tn",
        F.col("_ts").cast("double").alias("_ts"),
        (F.col("_bn") + F.sum("_n").over(inside)).alias("_ln"),
        (F.col("_bs") + F.sum("_s").over(inside)).cast("double").alias("_ls"),
        F.coalesce(F.lead("_v").over(inside), F.col("_onward")).alias("_next"),
    )
    right_n, right_s = F.col("_tn") - F.col("_ln"), F.col("_ts") - F.col("_ls")
    # the squared error that a split takes away, from the distance of the two means
    apart = F.col("_ls") / F.col("_ln") - right_s / F.nullif(right_n, F.lit(0))
    gain = F.round(F.col("_ln") * right_n / F.col("_tn") * apart * apart, 6)
    fits = F.col("_next").isNotNull() & (F.col("_ln") >= min_leaf) & (right_n >= min_leaf) & (gain > 0)
    # the greatest gain; ties go to the first feature, then to the least value
    split = F.struct(
        gain.alias("gain"), (-F.col("_f")).alias("f"), (-F.col("_v")).alias("v"), ((F.col("_v") + F.col("_next")) / 2).alias("t")
    )
    best = upto.groupBy("_node").agg(
        F.max("_tn").alias("n"), F.max("_ts").alias("s"), F.max(F.when(fits, split)).alias("best")
    )
    return best.select("_node", "n", "s", "best.gain", (-F.col("best.f")).alias("feature"), F.col("best.t").alias("threshold"))


def grow(df: DataFrame, label, features, max_depth=None, min_leaf=1) -> ExactTree:
    """Fit a tree (runs a job per level); rows with a missing label or feature
    take no part. Without `max_depth` it grows until no split lessens the
    squared error."""
    features = list(features)
    x = F.array(*[F.col(c).cast("double") for c in features])
    rows = df.select(F.lit(1).cast("long").alias("_node"), x.alias("_x"), F.col(label).cast(LABEL).alias("_y"))
    rows = rows.filter(F.col("_y").isNotNull() & F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v)))
    rows = cut_lineage(rows)
    nodes, depth = [], 0
    while True:
        found = level_splits(rows, min_leaf).limit(MAX_NODES + 1).collect()
        if len(found) > MAX_NODES:
            raise ValueError(f"more than {MAX_NODES} nodes in a level")
        level = []
        for r in sorted(found):
            node = Node(r["_node"], r["n"], r["s"] / r["n"])
            if r["feature"] is not None and (max_depth is None or depth < max_depth):
                node.feature, node.threshold, node.gain = r["feature"], r["threshold"], r["gain"]
                level.append(node)
            nodes.append(node)
        if not level:
            return ExactTree(features, nodes)
        depth += 1
        rows = _step(rows, level).filter("_open").select("_node", "_x", "_y")
        if depth % _LEVELS_PER_CUT == 0:
            rows = cut_lineage(rows)


def _step(rows: DataFrame, splits) -> DataFrame:
    """Send rows of the nodes in `splits` to their children; `_open` marks them."""
    table = [(s.number, s.feature, s.threshold) for s in splits]
    table = rows.sparkSession.createDataFrame(table, "_node long, _f int, _t double")
    joined = rows.join(F.broadcast(table), "_node", "left")
    above = F.coalesce((F.get("_x", F.col("_f")) > F.col("_t")).cast("long"), F.lit(0))
    open_ = F.col("_f").isNotNull()
    moved = F.when(open_, F.col("_node") * 2 + above).otherwise(F.col("_node"))
    return joined.withColumn("_open", open_).withColumn("_node", moved).drop("_f", "_t")


def predict(df: DataFrame, tree: ExactTree, name="prediction", node="node") -> DataFrame:
    """Add the number and the mean of the leaf that a row falls into; a missing
    value goes to the lower side."""
    x = F.array(*[F.col(c).cast("double") for c in tree.features])
    root = next((n for n in tree.nodes if n.number == 1), None)
    if root is None or root.feature is None:
        mean = F.lit(None if root is None else root.mean).cast("double")
        return df.select(*df.columns, F.lit(1).cast("long").alias(node), mean.alias(name))
    # all rows are at the root, so its split needs no join
    above = F.coalesce((F.col("_x")[root.feature] > root.threshold).cast("long"), F.lit(0))
    placed = df.select(*df.columns, x.alias("_x")).withColumn("_node", above + 2)
    by_depth = {}
    for n in tree.nodes:
        if n.feature is not None and n is not root:
            by_depth.setdefault(n.depth, []).append(n)
    for depth in sorted(by_depth):
        placed = _step(placed, by_depth[depth]).drop("_open")
    means = [(n.number, n.mean) for n in tree.nodes if n.feature is None]
    leaves = df.sparkSession.createDataFrame(means, "_node long, _mean double")
    joined = placed.join(F.broadcast(leaves), "_node", "left")
    return joined.select(*df.columns, F.col("_node").alias(node), F.col("_mean").alias(name))


def node_table(spark, tree: ExactTree) -> DataFrame:
    """(node, depth, n, mean, feature, threshold, gain), leaves included."""
    rows = [
        (n.number, n.depth, n.n, n.mean, None if n.feature is None else tree.features[n.feature], n.threshold, n.gain)
        for n in tree.nodes
    ]
    return spark.createDataFrame(rows, "node long, depth int, n long, mean double, feature string, threshold double, gain double")
