"""Connected components of a table of links, by alternating stars.

Large star: every node sends its greater neighbours to the least of all its
neighbours. Small star: every node sends its smaller neighbours and itself to
the least of them. Repeated until nothing hangs on a hanging node, each component is a star
around its least node; long chains take a logarithmic number of rounds.
"""

from pyspark.sql import DataFrame, functions as F

from valuescout.session import cut_lineage


_ROWS_PER_TASK = 500_000


def _least(edges, written):
    """Least neighbour per node; written out, so that a node with very many
    neighbours can be split in the join that follows."""
    return written(edges.groupBy("u").agg(F.min("v").alias("least")).withColumnRenamed("u", "node"))


def _large_star(edges, written):
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_least(both, written), F.col("u") == F.col("node"))
    least = F.least("u", "least")
    return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), least.alias("v"))


def _small_star(edges, written):
    # u is the greater end of each edge here
    joined = edges.join(_least(edges, written), F.col("u") == F.col("node"))
    moved = joined.filter(F.col("v") != F.col("least")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    own = joined.filter(F.col("v") == F.col("least")).select("u", "v")
    return moved.union(own)


def _settled(edges, written):
    """Whether every node hangs on one node only, which hangs on none."""
    nodes = written(edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("u", "node"))
    twice = nodes.filter("n > 1").select("node")
    chained = edges.join(nodes, F.col("v") == F.col("node"), "left_semi").select("v")
    return twice.union(chained).isEmpty()


def components(links: DataFrame, a="a", b="b") -> DataFrame:
    """node and component (its least node) for all nodes that have a link.

    Links are few next to the documents they come from, so each round is
    written by as many tasks as their number asks for.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = cut_lineage(edges)
    tasks = max(8, edges.count() // _ROWS_PER_TASK)

    def written(df):
        return cut_lineage(df.coalesce(tasks))

    edges = edges.coalesce(tasks)
    while not _settled(edges, written):
        large = written(_large_star(edges, written).distinct())
        edges = written(_small_star(large, written).distinct())
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
