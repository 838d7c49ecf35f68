"""Approximate nearest neighbours by inner product with a projection forest.

Each tree halves a bounded sample by random projections, down to cells. All
vectors are dealt to one cell per tree. A query ranks the cells of all trees
in one priority queue, nearest bound first, and takes cells until it has seen
enough vectors; those are scored exactly. How many are enough is fitted on the
sample: the share of vectors that finds the wanted part of the true
neighbours there.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from valuescout.session import cut_lineage

SAMPLE_VALUES = 1 << 20
TREES = 8
DEPTH = 7
TARGET = 0.97
_TRIALS = 128
_SLACK = 1e-9


def scores(queries, vectors):
    """Inner products of rows, summed in the order of the components."""
    total = np.zeros(len(queries))
    for d in range(queries.shape[1]):
        total += queries[:, d] * vectors[:, d]
    return total


def _per_id(near, ids):
    """Scores reduced to the best of each id, along the last axis."""
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.append(True, ids[order][1:] != ids[order][:-1])) if len(ids) else order
    return np.maximum.reduceat(near[..., order], first, axis=-1) if len(first) < len(ids) else near


class Forest:
    """Complete binary trees of random projections, and when to stop."""

    def __init__(self, sample, ids, trees=TREES, depth=DEPTH, target=TARGET, k=20):
        rng = np.random.Generator(np.random.PCG64(17))
        self.depth = max(0, min(depth, int(np.log2(max(1, len(sample) // 8)))))
        self.trees, self.k = trees, k
        self.cells = 1 << self.depth
        inner = self.cells - 1
        self.plane = np.zeros((trees, inner, sample.shape[1]))
        self.cut = np.zeros((trees, inner))
        for t in range(trees):
            rows = {0: np.arange(len(sample))}
            for node in range(inner):
                mine = rows.pop(node)
                if len(mine) > 1:
                    a, b = sample[rng.choice(mine, 2, replace=False)]
                    away = a - b
                    size = np.sqrt(away @ away)
                    self.plane[t, node] = away / size if size else 0
                    self.cut[t, node] = np.median(sample[mine] @ self.plane[t, node])
                right = sample[mine] @ self.plane[t, node] > self.cut[t, node]
                rows[2 * node + 1], rows[2 * node + 2] = mine[~right], mine[right]
        self.sample, self.ids = sample, ids
        self.home = self.place(sample)
        self.share = self._fitted(target)

    def _margins(self, vectors):
        flat = self.plane.reshape(-1, vectors.shape[1])
        return (vectors @ flat.T).reshape(len(vectors), self.trees, -1) - self.cut

    def place(self, vectors):
        """The cell of each vector in each tree, numbered through all trees."""
        margin = self._margins(vectors) if self.depth else np.zeros((len(vectors), self.trees, 1))
        at = np.zeros((len(vectors), self.trees), np.int64)
        row, tree = np.ogrid[: len(vectors), : self.trees]
        for _ in range(self.depth):
            at = 2 * at + 1 + (margin[row, tree, at] > 0)
        return at - (self.cells - 1) + np.arange(self.trees) * self.cells

    def bounds(self, queries):
        """Sum of squared margins on the way to each cell of each tree."""
        margin = self._margins(queries) if self.depth else None
        bound = np.zeros((len(queries), self.trees, 1))
        for level in range(self.depth):
            here = margin[:, :, (1 << level) - 1 : (1 << (level + 1)) - 1]
            wrong = here**2
            both = np.stack([bound + np.where(here > 0, wrong, 0), bound + np.where(here > 0, 0, wrong)], axis=3)
            bound = both.reshape(len(queries), self.trees, -1)
        return bound.reshape(len(queries), -1)

    def probes(self, bound, sizes, budget):
        """Cells in the order of the shared queue until the budget is spent."""
        queue = list(zip(bound.tolist(), range(len(bound))))
        heapq.heapify(queue)
        taken, seen = [], 0
        while queue and seen < budget:
            cell = heapq.heappop(queue)[1]
            if sizes[cell]:
                taken.append(cell)
                seen += sizes[cell]
        return taken

    def _fitted(self, target):
        """Least share of vectors to look at for the target on the sample."""
        n = len(self.sample)
        trial = np.arange(n)[:: max(1, n // _TRIALS)][:_TRIALS]
        sizes = np.bincount(self.home.ravel(), minlength=self.trees * self.cells)
        spent = []
        for q, bound in zip(trial, self.bounds(self.sample[trial])):
            near = self.sample @ self.sample[q]
            near[self.ids == self.ids[q]] = -np.inf
            best = np.argsort(-near, kind="stable")
            best = best[np.isfinite(near[best])]
            best = best[np.sort(np.unique(self.ids[best], return_index=True)[1])[: self.k]]
            order = np.argsort(bound, kind="stable")
            upto = np.zeros(len(order))
            upto[order] = np.cumsum(sizes[order])
            spent.append(upto[self.home[best]].min(axis=1))
        spent = np.sort(np.concatenate(spent)) if spent else np.zeros(0)
        return float(spent[int(np.ceil(target * len(spent))) - 1] / n) if len(spent) else float(self.trees)


def _array(column):
    """A list column as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(np.float64)


def _homes(batches, forest, blocks, parts):
    """A row per vector, tree and block of queries, with its cell and block."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch["vec_id"].to_numpy()
        home = forest.place(_array(batch["vec"]))
        block = (ids[:, None] * 7919 % 1_000_003) % blocks[home] if blocks is not None else np.zeros_like(home)
        repeat = parts[home].ravel() if parts is not None else np.ones(home.size, np.int64)
        row = np.repeat(np.repeat(np.arange(len(ids)), forest.trees), repeat)
        part = np.arange(len(row)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
        columns = [np.repeat(home.ravel(), repeat), np.repeat(block.ravel(), repeat), part]
        arrays = [pa.array(c.astype(np.int32)) for c in columns]
        for at in range(0, len(row), 8192):
            cut = slice(at, at + 8192)
            yield pa.RecordBatch.from_arrays(
                [*(a[cut] for a in arrays), pa.array(ids[row[cut]]), batch["vec"].take(pa.array(row[cut]))],
                ["cell", "block", "part", "vec_id", "vec"],
            )


def _cells(batches, forest):
    for batch in batches:
        if batch.num_rows:
            cells, counts = np.unique(forest.place(_array(batch["vec"])), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(counts)], ["cell", "n"])


def _probed(batches, forest, sizes, budget):
    """The cells each query takes, and a score that the k-th found reaches."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            ids, vectors = part["vec_id"].to_numpy(), _array(part["vec"])
            taken, least = [], []
            for i, q, bound in zip(ids, vectors, forest.bounds(vectors)):
                cells = forest.probes(bound, sizes, budget)
                seen = np.zeros(len(sizes), bool)
                seen[cells] = True
                found = seen[forest.home].any(axis=1) & (forest.ids != i)
                near = _per_id(forest.sample[found] @ q, forest.ids[found])
                taken.append(cells)
                least.append(np.partition(near, -forest.k)[-forest.k] if len(near) >= forest.k else -np.inf)
            yield pa.RecordBatch.from_arrays(
                [part["vec_id"], part["vec"], pa.array(taken, pa.list_(pa.int32())), pa.array(np.array(least))],
                ["vec_id", "vec", "cells", "least"],
            )


def _asked(batches, blocks, parts):
    """A row per query, cell and block of vectors."""
    for batch in batches:
        for i, vec, cells, least in zip(*(batch[c].to_pylist() for c in ("vec_id", "vec", "cells", "least"))):
            cells = np.array(cells, np.int64)
            repeat = blocks[cells]
            cell = np.repeat(cells, repeat)
            block = np.arange(len(cell)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
            part = (i * 7919 % 1_000_003) % parts[cell]
            n = len(cell)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c.astype(np.int32)) for c in (cell, block, part)), pa.array([i] * n, pa.int64()), pa.array([vec] * n, pa.list_(pa.float64())), pa.array([least] * n, pa.float64())],
                ["cell", "block", "part", "query_id", "vec", "least"],
            )


def _nearest(vectors, queries, k):
    """The best k of one block for each of its queries, scored exactly."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    if not vectors.num_rows or not queries.num_rows:
        return schema.empty_table()
    v, q = _array(vectors["vec"]), _array(queries["vec"])
    ids, asked = vectors["vec_id"].to_numpy(), queries["query_id"].to_numpy()
    rough = q @ v.T
    rough[asked[:, None] == ids[None, :]] = -np.inf
    least = queries["least"].to_numpy()
    near = _per_id(rough, ids)
    if near.shape[1] > k:
        least = np.maximum(least, np.partition(near, -k, axis=1)[:, -k])
    slack = _SLACK * (1 + np.abs(rough[np.isfinite(rough)]).max(initial=0))
    row, column = np.nonzero((rough >= least[:, None] - slack) & np.isfinite(rough))
    exact = scores(q[row], v[column])
    order = np.lexsort((-exact, ids[column], row))
    row, column, exact = row[order], column[order], exact[order]
    new = np.ones(len(row), bool)  # the best row of each id
    new[1:] = (row[1:] != row[:-1]) | (ids[column[1:]] != ids[column[:-1]])
    row, column, exact = row[new], column[new], exact[new]
    order = np.lexsort((ids[column], -exact, row))
    row, column, exact = row[order], column[order], exact[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    best = nth < k
    return pa.table([asked[row[best]], ids[column[best]], exact[best]], schema=schema)


def nearest(vectors: DataFrame, queries, k=20, id_col="vec_id", vector_col="embedding", trees=TREES, target=TARGET) -> DataFrame:
    """The k rows with the largest inner product found for each query row.

    `queries` is a condition on the input that picks the query rows; every
    other row is a candidate. Returns query_id, rank, vec_id, score; ties go
    to the smaller id. The forest is fitted on a sample of SAMPLE_VALUES
    numbers at most, chosen by a hash of the id; every row is indexed. Cells
    with many vectors or queries are cut into blocks of bounded size.

    Defined cases: null ids and vectors that are null, empty, all zero, hold a
    null or non-finite component, or have another length than most of the
    sample take no part; rows that share an id are one candidate, the best of
    them counts, and none of them answers a query of that id; with k
    candidates or fewer all are returned; an empty table gives an empty
    result; columns not named are ignored, whatever they are called.
    """
    vec = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"), queries.alias("asks"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    common = lengths.orderBy(F.col("rows").desc(), "n").first()
    if common is None:
        return rows.selectExpr("vec_id AS query_id", "1 AS rank", "vec_id", "0D AS score")
    size, total = common
    rows = rows.filter(F.size("vec") == size)
    limit = max(64, SAMPLE_VALUES // size)
    chosen = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(min(1.0, limit / total) * (1 << 30))
    sample = sorted(rows.filter(chosen).select("vec_id", "vec").limit(2 * limit).collect()) or [rows.select("vec_id", "vec").first()]
    forest = Forest(np.array([r["vec"] for r in sample]), np.array([r["vec_id"] for r in sample]), trees, target=target, k=k)

    plain = rows.select("vec_id", "vec")
    sizes = np.zeros(forest.trees * forest.cells, np.int64)
    counted = plain.mapInArrow(lambda b: _cells(b, forest), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    for r in counted.collect():
        sizes[r["cell"]] = r["n"]
    budget = max(forest.share * total, forest.trees * (k + 1))
    block = max(256, 2 * total // forest.cells)
    blocks = np.maximum(1, -(-sizes // min(block, 8192)))

    asking = rows.filter("asks").select("vec_id", "vec")
    found = "vec_id long, vec array<double>, cells array<int>, least double"
    asking = cut_lineage(asking.mapInArrow(lambda b: _probed(b, forest, sizes, budget), found))
    probes = np.zeros(len(sizes), np.int64)
    for r in asking.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        probes[r["cell"]] = r["n"]
    parts = np.maximum(1, -(-probes // 4096))

    keys = "cell int, block int, part int"
    dealt = plain.mapInArrow(lambda b: _homes(b, forest, blocks, parts), f"{keys}, vec_id long, vec array<double>")
    asked = asking.mapInArrow(lambda b: _asked(b, blocks, parts), f"{keys}, query_id long, vec array<double>, least double")
    by = ("cell", "block", "part")
    scored = dealt.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(
        lambda v, q: _nearest(v, q, k), "query_id long, vec_id long, score double"
    )
    scored = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op3_neighbours(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 20 == 0)


def brute_force(ids, vectors, queries, k=20):
    """Exact neighbours, for small tables in tests."""
    out = []
    for i, q in zip(ids, vectors):
        if queries(i):
            s = scores(np.tile(q, (len(ids), 1)), vectors)
            best = sorted((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != i)[:k]
            out += [(i, rank + 1, v, -x) for rank, (x, v) in enumerate(best)]
    return out
