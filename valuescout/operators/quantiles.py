"""Exact quantiles without one task holding every distinct value."""

from pyspark.sql import DataFrame, Window, functions as F

from valuescout.functions.order import ordered_code

# Four digits of 16 bits: a task sorts at most 65,536 counters of a bucket.
DIGIT_BITS = 16
_ROUNDS = 64 // DIGIT_BITS


def _histogram(values: DataFrame, wanted: DataFrame | None, digits: int) -> DataFrame:
    """(_c, _bucket, _wants, _prefix, _n, _v): rows per prefix of `digits`
    digits, inside the buckets that `wanted` names (all rows at first)."""
    prefix = F.shiftright("_code", 64 - DIGIT_BITS * digits)
    if "_n" not in values.columns:  # rows not counted by value
        values = values.withColumn("_n", F.lit(1))
    if wanted is None:
        inside = values.select("_c", "_v", "_n", F.lit(0).alias("_bucket"), F.lit(None).cast(_WANTS).alias("_wants"), prefix.alias("_prefix"))
    else:
        # two rows per column and probability at most, so always small enough to copy
        inside = (
            values.withColumn("_bucket", F.shiftright("_code", 64 - DIGIT_BITS * (digits - 1)))
            .join(F.broadcast(wanted), ["_c", "_bucket"])
            .select("_c", "_v", "_n", "_bucket", "_wants", prefix.alias("_prefix"))
        )
    return inside.groupBy("_c", "_bucket", "_wants", "_prefix").agg(F.sum("_n").alias("_n"), F.max("_v").alias("_v"))


_WANTS = "array<struct<p:int,side:int,rank:bigint,total:bigint>>"


def exact_quantiles(df: DataFrame, columns, probabilities) -> DataFrame:
    """(column, probability, value): linear interpolation between the two
    nearest ranks, NULLs ignored.

    Radix selection: the numbers are read as whole numbers in the same order
    (`ordered_code`). Equal numbers are counted first, so that `df` is computed
    once and a code made once per number; the rounds read what that shuffle wrote.
    Each round counts the rows per next digit inside the buckets that hold a wanted rank, and goes on with the digits in which the
    ranks fall; after the last digit a bucket is one value. All is one plan,
    the same for any number of rows; no task sorts more than the counters of
    one bucket, no value is compared with others of its bucket.
    """
    columns, probabilities = list(columns), [float(p) for p in probabilities]
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v"))
            for i, c in enumerate(columns)
        ]
    )
    values = df.select(F.inline(cells)).filter(F.col("_v").isNotNull())
    values = values.groupBy("_c", "_v").agg(F.count("*").alias("_n"))
    # never null, else each join would test that by computing the code once more
    values = values.withColumn("_code", F.coalesce(ordered_code("_v"), F.lit(0)))

    def ranks(total):
        wants = []
        for i, p in enumerate(probabilities):
            rank = F.lit(p) * (total - 1)
            for side, place in enumerate((F.floor(rank), F.ceil(rank))):
                fields = F.lit(i), F.lit(side), place, total
                wants.append(F.struct(*[x.alias(n) for x, n in zip(fields, ("p", "side", "rank", "total"))]))
        return F.array(*wants).cast(_WANTS)

    wanted = None
    for digits in range(1, _ROUNDS + 1):
        counted = _histogram(values, wanted, digits)
        bucket = Window.partitionBy("_c", "_bucket")
        upto = F.sum("_n").over(bucket.orderBy("_prefix"))
        counted = counted.withColumn("_before", upto - F.col("_n"))
        if wanted is None:
            counted = counted.withColumn("_wants", ranks(F.sum("_n").over(bucket)))
        here = F.filter("_wants", lambda w: (w["rank"] >= F.col("_before")) & (w["rank"] < F.col("_before") + F.col("_n")))
        rest = F.transform(here, lambda w: w.withField("rank", w["rank"] - F.col("_before")))
        wanted = counted.select("_c", F.col("_prefix").alias("_bucket"), rest.alias("_wants"), "_v")
        wanted = wanted.filter(F.size("_wants") > 0)
        wanted = wanted if digits == _ROUNDS else wanted.drop("_v")

    picked = wanted.select("_c", "_v", F.inline("_wants")).groupBy("_c", "p")
    low, high = (F.max(F.when(F.col("side") == side, F.col("_v"))) for side in (0, 1))
    picked = picked.agg(low.alias("low"), high.alias("high"), F.max("total").alias("total"))
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("_c") + 1)
    probability = F.element_at(F.array(*[F.lit(p) for p in probabilities]), F.col("p") + 1)
    rank = probability * (F.col("total") - 1)
    between = F.col("low") + (rank - F.floor(rank)) * (F.col("high") - F.col("low"))
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between).alias("value")
    return picked.select(name.alias("column"), probability.alias("probability"), value)


def exact_medians(df: DataFrame, columns) -> DataFrame:
    """One row with the exact median of every column (NULL if all missing)."""
    found = exact_quantiles(df, columns, [0.5])
    return found.agg(
        *[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns]
    )


def count_median(df: DataFrame, column) -> DataFrame:
    """One row, one column: exact median of an integer count.

    Counts repeat heavily, so the value histogram that the last task merges
    stays small: distinct counts grow with the square root of what was counted.
    """
    histogram = df.groupBy(column).agg(F.count("*").alias("_n"))
    return histogram.agg(F.percentile(column, 0.5, F.col("_n")).alias("median"))


def median_impute(df: DataFrame, columns, fit_on: DataFrame | None = None) -> DataFrame:
    """Fill missing numbers with the exact median, over all rows by default."""
    columns = list(columns)
    medians = exact_medians(df if fit_on is None else fit_on, columns)
    packed = medians.select(F.struct(*columns)).scalar()
    filled = df.withColumn("_medians", packed)
    return filled.select(
        *[
            F.coalesce(F.col(c).cast("double"), F.col(f"_medians.{c}")).alias(c)
            if c in columns
            else F.col(c)
            for c in df.columns
        ]
    )


def tertile(df: DataFrame, columns, labels=("low", "mid", "high")) -> DataFrame:
    """Add one label column per entry of `columns` (name -> numeric column):
    three bins at the interpolated 1/3 and 2/3 quantiles, closed on the right.
    Equal edges are an error, as no balanced split exists then."""
    sources = list(dict.fromkeys(columns.values()))
    cuts = exact_quantiles(df, sources, [0.0, 1 / 3, 2 / 3, 1.0])
    listed = [F.sort_array(F.collect_list(F.when(F.col("column") == c, F.col("value")))) for c in sources]
    edges = cuts.agg(F.array(*listed).alias("edges")).scalar()
    binned = {}
    for name, column in columns.items():
        at = F.element_at("_edges", sources.index(column) + 1)
        edge = [F.element_at(at, i) for i in range(1, 5)]
        clash = (edge[0] >= edge[1]) | (edge[1] >= edge[2]) | (edge[2] >= edge[3])
        value = F.col(column)
        binned[name] = (
            F.when(value.isNull(), F.lit(None).cast("string"))
            .when(clash, F.raise_error(f"equal tertile edges in {column}").cast("string"))
            .when(value <= edge[1], labels[0])
            .when(value <= edge[2], labels[1])
            .otherwise(labels[2])
        )
    return df.withColumn("_edges", edges).withColumns(binned).drop("_edges")
