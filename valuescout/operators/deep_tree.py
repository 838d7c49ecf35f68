"""Regression trees of many levels over binned features.

Spark's own tree keeps one counter per node, feature and bin, whether or not a
row falls into it, and gives the whole tree to every task. Here nodes with many
rows are split level by level: the coded training rows are written once, a level
is one sweep over them in which each task adds up its rows by node and bin, and
only these sums are shuffled. The rows of a smaller node are sent to one task,
which grows everything below it and scores what falls into it. No task holds the
training rows of more than one such node, and nothing below it leaves the task.

Bins and splits are those of Spark's tree: numbers are cut at up to 255
thresholds, a level of a category is split from the rest, the greatest loss of
variance wins, ties go to the first feature and the lowest threshold. Labels are
added up as whole numbers, so that no sum depends on the order of the rows.
"""

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from valuescout.operators.quantiles import exact_quantiles
from valuescout.session import written_table

NODE_ROWS = 1 << 16  # training rows of a node that one task takes
MAX_VALUES = 1 << 16  # distinct numbers of a feature that pass through the driver
MAX_CELLS = 1 << 22  # counters that a task holds at once
_LABEL_BITS = 36

# executors need no copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def thresholds(train: DataFrame, numeric, max_bins=256) -> list[list[float]]:
    """Per number the cuts between its bins: all midpoints if they are few, else
    those next to equal shares of the rows (runs jobs)."""
    cells = train.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in numeric])).alias("_f", "_v"))
    counts = cells.groupBy("_f", "_v").agg(F.count("*").alias("_n"))
    sizes = {r["_f"]: r["n"] for r in counts.groupBy("_f").agg(F.count("*").alias("n")).collect()}
    few = [f for f, n in sizes.items() if n <= MAX_VALUES]
    listed = {f: [] for f in few}
    for r in counts.filter(F.col("_f").isin(few)).collect():
        listed[r["_f"]].append((r["_v"], r["_n"]))
    found = {f: _cuts(sorted(values), max_bins) for f, values in listed.items()}
    many = [f for f in sizes if f not in listed]
    if many:
        shares = [i / max_bins for i in range(1, max_bins)]
        for r in exact_quantiles(train, [numeric[f] for f in many], shares).collect():
            found.setdefault(numeric.index(r["column"]), set()).add(r["value"])
    return [sorted(found.get(f, ())) for f in range(len(numeric))]


def _cuts(values, max_bins):
    middles = [(a + b) / 2 for (a, _), (b, _) in zip(values, values[1:])]
    if len(middles) < max_bins:
        return middles
    stride = sum(n for _, n in values) / max_bins
    cuts, upto, target = [], values[0][1], stride
    for (_, n), middle in zip(values[1:], middles):
        before, upto = upto, upto + n
        if abs(before - target) < abs(upto - target):
            cuts.append(middle)
            target += stride
    return cuts


def binned(df: DataFrame, numeric, cuts) -> DataFrame:
    """Add `_x<i>`: the number of cuts below each number."""
    for i, (c, at) in enumerate(zip(numeric, cuts)):
        if not at:
            df = df.withColumn(f"_x{i}", F.lit(0))
            continue
        # Bucketizer counts the borders up to a value; here a value on a cut lies below it
        borders = [-np.inf, *[0.0 - t for t in reversed(at)], np.inf]
        above = Bucketizer(splits=borders, inputCol="_below", outputCol="_above")
        df = above.transform(df.withColumn("_below", F.lit(0.0) - F.col(c)))
        df = df.withColumn(f"_x{i}", (F.lit(len(at)) - F.col("_above")).cast("int")).drop("_below", "_above")
    return df


def _gains(node, n, s, totals_n, totals_s, min_leaf):
    """Loss of squared error when n rows with the sum s are split from their node."""
    rest_n, rest_s = totals_n[node] - n, totals_s[node] - s
    fits = (n >= min_leaf) & (rest_n >= min_leaf)
    apart = s / n - rest_s / np.maximum(rest_n, 1)
    return np.where(fits, (n * rest_n) / totals_n[node].astype(float) * apart * apart, 0.0)


def _best(column, ordered, node, code, n, s, totals_n, totals_s, best, min_leaf):
    """Improve `best` (gain, column, cut per node) by the splits of one column,
    whose cells are sorted by node and code."""
    if not len(node):
        return
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    if ordered:
        size = np.diff(np.r_[first, len(node)])
        up_n, up_s = np.cumsum(n), np.cumsum(s)
        n = up_n - np.repeat(up_n[first] - n[first], size)
        s = up_s - np.repeat(up_s[first] - s[first], size)
    gain = _gains(node, n, s, totals_n, totals_s, min_leaf)
    top = np.maximum.reduceat(gain, first)
    at = np.flatnonzero(gain == np.repeat(top, np.diff(np.r_[first, len(node)])))
    at = at[np.r_[True, node[at][1:] != node[at][:-1]]]
    at = at[gain[at] > best[0][node[at]]]
    best[0][node[at]], best[1][node[at]], best[2][node[at]] = gain[at], column, code[at]


def grow(x, y, ordered, levels, min_leaf):
    """(column, cut, child, mean) per node, the root first, for codes `x` (rows by
    columns) and whole labels `y`. Leaves have column -1; rows go to `child` or,
    above an ordered cut or in the level of the cut, to the next one."""
    column, cut, child, mean = [], [], [], []
    rows, node, depth, known = np.arange(len(y)), np.zeros(len(y), np.int64), 0, 0
    while len(rows):
        # rows are sorted by node
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        m, label = len(first), y[rows]
        totals_n, totals_s = np.diff(np.r_[first, len(rows)]), np.add.reduceat(label, first)
        best = np.zeros(m), np.full(m, -1, np.int64), np.zeros(m, np.int64)
        pure = np.maximum.reduceat(label, first) == np.minimum.reduceat(label, first)
        if depth < levels:
            mixed = np.flatnonzero(~pure[node])
            for j, is_ordered in enumerate(ordered):
                codes = x[rows[mixed], j].astype(np.int64)
                here = mixed if is_ordered else mixed[codes >= 0]
                codes = codes if is_ordered else codes[codes >= 0]
                width = int(codes.max(initial=0)) + 1
                key = node[here] * width + codes
                order = np.argsort(key, kind="stable")
                key, here = key[order], here[order]
                if not len(key):
                    continue
                cells = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                n, s = np.diff(np.r_[cells, len(key)]), np.add.reduceat(label[here], cells)
                _best(j, is_ordered, key[cells] // width, key[cells] % width, n, s, totals_n, totals_s, best, min_leaf)
        split = best[1] >= 0
        children = np.where(split, known + m + 2 * (np.cumsum(split) - 1), -1)
        known += m
        for out, values in zip((column, cut, child, mean), (best[1], best[2], children, totals_s / totals_n)):
            out.append(values)
        stay = split[node]
        rows, node = rows[stay], node[stay]
        side = _right(x[rows], best[1][node], best[2][node], ordered)
        node = (children[node] - known) + side
        order = np.argsort(node, kind="stable")
        rows, node, depth = rows[order], node[order], depth + 1
    return tuple(np.concatenate(a) if a else np.zeros(0) for a in (column, cut, child, mean))


def _right(x, column, cut, ordered):
    codes = x[np.arange(len(x)), column]
    return np.where(np.asarray(ordered)[column], codes > cut, codes == cut).astype(np.int64)


def place(x, tree, ordered):
    """The leaf of each row."""
    column, cut, child, _ = tree
    at, open_ = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(open_):
        open_ = open_[column[at[open_]] >= 0]
        node = at[open_]
        at[open_] = child[node] + _right(x[open_], column[node], cut[node], ordered)
    return at


def _node_of(tree, ordered):
    """Codes -> the node of the tree."""

    def run(*codes: pa.Array) -> pa.Array:
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in codes])
        return pa.array(place(x, tree, ordered), pa.int64())

    return run


def _count(tree, level, columns, ordered, widths):
    """(_node, _f, _code, _n, _s): rows and labels of the nodes `level` by code."""
    slot = np.full(len(tree[0]), -1, np.int64)
    slot[level] = np.arange(len(level))
    begins = np.cumsum([0, *[w * len(level) for w in widths]])

    def run(frames):
        n, s = np.zeros(begins[-1], np.int64), np.zeros(begins[-1], np.int64)
        for frame in frames:
            x = frame[columns].to_numpy()
            node = slot[place(x, tree, ordered)]
            here = np.flatnonzero(node >= 0)
            node, label = node[here], frame["_y"].to_numpy()[here]
            for j, width in enumerate(widths):
                cell = begins[j] + node * width + (x[here, j] + 1)
                np.add.at(n, cell, 1)
                np.add.at(s, cell, label)
        for j, width in enumerate(widths):
            cell = np.flatnonzero(n[begins[j] : begins[j + 1]])
            counted, added = n[begins[j] + cell], s[begins[j] + cell]
            yield pd.DataFrame({"_node": level[cell // width], "_f": j, "_code": cell % width - 1, "_n": counted, "_s": added})

    return run


def _split_cells(ordered, min_leaf):
    """The best split of a node from its counters, and what lies beyond the cut."""

    def best_split(cells):
        cells = cells.sort_values(["_f", "_code"])
        f, code = cells["_f"].to_numpy(), cells["_code"].to_numpy(np.int64)
        n, s = cells["_n"].to_numpy(np.int64), cells["_s"].to_numpy(np.int64)
        whole = f == 0
        totals = np.array([n[whole].sum()]), np.array([s[whole].sum()])
        best = np.zeros(1), np.full(1, -1, np.int64), np.zeros(1, np.int64)
        for j, is_ordered in enumerate(ordered):
            here = (f == j) & (code >= 0)
            _best(j, is_ordered, np.zeros(here.sum(), np.int64), code[here], n[here], s[here], *totals, best, min_leaf)
        column, cut = int(best[1][0]), int(best[2][0])
        beyond = (f == column) & (code > cut if column >= 0 and ordered[column] else code == cut)
        sums = {"_n": totals[0], "_s": totals[1], "_above_n": n[beyond].sum(), "_above_s": s[beyond].sum()}
        return pd.DataFrame({"_node": cells["_node"].iloc[:1], "_f": column, "_cut": cut} | sums)

    return best_split


_SPLIT = "_node long, _f int, _cut int, _n long, _s long, _above_n long, _above_s long"


def _top(train: DataFrame, columns, ordered, widths, n_rows, max_depth, min_leaf, node_rows):
    """(tree, depth per node, leaves that stay leaves): the nodes of more than
    `node_rows` training rows and their children (runs a job per level)."""
    column, cut, child, mean, depth = [-1], [0], [-1], [0.0], [0]
    level, closed = [0] if n_rows > node_rows else [], []

    def arrays():
        return np.array(column), np.array(cut), np.array(child), np.array(mean)

    while level:
        found = []
        step = max(1, MAX_CELLS // sum(widths))
        for i in range(0, len(level), step):
            count = _count(arrays(), np.array(level[i : i + step]), columns, ordered, widths)
            cells = train.mapInPandas(count, "_node long, _f int, _code int, _n long, _s long")
            cells = cells.groupBy("_node", "_f", "_code").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
            found += cells.groupBy("_node").applyInPandas(_split_cells(ordered, min_leaf), _SPLIT).collect()
        level = []
        for r in sorted(found):
            node = r["_node"]
            mean[node] = r["_s"] / r["_n"]
            if r["_f"] < 0 or depth[node] == max_depth:
                closed.append(node)
                continue
            column[node], cut[node], child[node] = r["_f"], r["_cut"], len(column)
            for n, s in ((r["_n"] - r["_above_n"], r["_s"] - r["_above_s"]), (r["_above_n"], r["_above_s"])):
                for values, value in zip((column, cut, child, mean, depth), (-1, 0, -1, s / n, depth[node] + 1)):
                    values.append(value)
                if depth[-1] == max_depth:
                    closed.append(len(depth) - 1)
                elif n > node_rows:
                    level.append(len(depth) - 1)
    return arrays(), depth, closed


def _finish(columns, ordered, depth, max_depth, min_leaf, scale):
    """Grow and score node by node; the training rows of a node come first."""

    def scored(frame, tree, n_leaves=0):
        leaf = place(frame[columns].to_numpy(), tree, ordered)
        counted = np.zeros(len(frame), np.int64)
        counted[:1] = n_leaves
        out = frame.drop(columns=[*columns, "_node", "_y"])
        return out.assign(predicted_log_price=tree[3][leaf] / scale, _leaves=counted)

    def fitted(held, node):
        train = pd.concat(held)
        tree = grow(train[columns].to_numpy(), train["_y"].to_numpy(np.int64), ordered, max_depth - depth[node], min_leaf)
        return tree, scored(train, tree, int((tree[0] < 0).sum()))

    def run(frames):
        held, tree, current = [], None, None
        for frame in frames:
            nodes = frame["_node"].to_numpy()
            borders = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]]) if len(nodes) else []
            for lo, hi in zip(borders, [*borders[1:], len(nodes)]):
                piece = frame.iloc[lo:hi]
                if nodes[lo] != current:
                    if held:
                        yield fitted(held, current)[1]
                    held, tree, current = [], None, nodes[lo]
                train = piece["in_test_set"].to_numpy() == 0
                if train.any():
                    held.append(piece[train])
                if not train.all():
                    if held:
                        tree, out = fitted(held, current)
                        held = []
                        yield out
                    yield scored(piece[~train], tree)
        if held:
            yield fitted(held, current)[1]

    return run


def fit_and_score(df: DataFrame, codes, ordered, label, keep, max_depth, min_leaf=1, node_rows=NODE_ROWS) -> DataFrame:
    """(keep, in_test_set, predicted_log_price, _leaves) for every row of `df`,
    from a tree grown on its training rows (runs a job per level of big nodes).

    `codes` names the columns with the bin or level of each feature, `ordered`
    tells bins from levels; level -1 is no level of its own. The sum of `_leaves`
    is the number of leaves.
    """
    x = [f"_x{i}" for i in range(len(codes))]
    spark, train = df.sparkSession, F.col("in_test_set") == 0
    missing = F.raise_error("a training row has no label").cast("double")
    label = F.when(train & (F.col(label).isNull() | F.isnan(label)), missing).otherwise(F.col(label))
    codes = {name: F.col(c).cast("int") for c, name in zip(codes, x)}
    widest = [F.max(code).alias(name) for name, code in codes.items()]
    size = df.filter(train).agg(F.count("*").alias("n"), F.max(F.abs(label)).alias("most"), *widest).first()
    if not size["n"]:
        raise ValueError("no training rows")
    # sums of all labels stay below 2 ** 62
    bits = min(_LABEL_BITS, 61 - int(np.ceil(np.log2(max(size["n"] * (size["most"] + 1), 2)))))
    scale = 2.0**bits
    y = F.when(train, F.round(label * scale).cast("long")).alias("_y")
    rows = df.select(*keep, "in_test_set", y, *[code.alias(name) for name, code in codes.items()])
    coded = rows.filter(train).select("_y", *x)
    if size["n"] > node_rows:
        coded = written_table(coded)
    tree, depth, closed = _top(coded, x, ordered, [size[c] + 2 for c in x], size["n"], max_depth, min_leaf, node_rows)
    rows = rows.withColumn("_node", F.arrow_udf(_node_of(tree, ordered), "long")(*x))
    plain = [*keep, "in_test_set"]
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in plain)
    run = _finish(x, ordered, depth, max_depth, min_leaf, scale)
    rest = rows.filter(~F.col("_node").isin(closed)) if closed else rows
    rest = rest.repartition("_node").sortWithinPartitions("_node", "in_test_set")
    below = rest.mapInPandas(run, f"{fields}, predicted_log_price double, _leaves long")
    below = below.select(*plain, "predicted_log_price", "_leaves")
    if not closed:
        return below
    # what no split divides needs no task of its own
    means = spark.createDataFrame([(node, float(tree[3][node] / scale)) for node in closed], "_node long, predicted_log_price double")
    leaf = F.lit(0).cast("long").alias("_leaves")
    at_once = rows.join(F.broadcast(means), "_node").select(*plain, "predicted_log_price", leaf)
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in plain]
    marker = spark.createDataFrame([(len(closed),)], "_leaves long")
    marker = marker.select(*none, F.lit(None).cast("double").alias("predicted_log_price"), "_leaves")
    return below.unionByName(at_once).unionByName(marker)
