"""Row-level operators: ids, first-of-key, membership, folding, missing cells."""

from pyspark.sql import DataFrame, functions as F

from valuescout.functions.ids import valid_id


# Tables up to this many rows may be copied to every task.
SMALL_ROWS = 500_000


SALTS = 16


def keep_valid_ids(df: DataFrame, key) -> DataFrame:
    """Normalise `key` and drop the rows whose id is corrupt."""
    return df.withColumn(key, valid_id(key)).filter(F.col(key).isNotNull())


def evaluate_once(df: DataFrame, name, value) -> DataFrame:
    """Add a costly column that later filters read.

    The optimizer would put a plain column's expression into each filter and
    compute it again there; it leaves the output of a one-row generator alone.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def distinct_ids(df: DataFrame, key) -> DataFrame:
    """The valid ids, once each; only `key` is read from the source."""
    return keep_valid_ids(df.select(key), key).distinct()


def dedupe_first(df: DataFrame, keys, order) -> DataFrame:
    """First row of every key by `order` (a column that ranks rows).

    An aggregate rather than a ranked window: every task keeps one row per key
    before the shuffle, so a key that holds a third of the rows is no hot spot.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)


def keep_members(df: DataFrame, ids: DataFrame, key) -> DataFrame:
    """Rows whose key is among `ids`."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def member_flag(df: DataFrame, ids: DataFrame, key, name, spread_by=None, rows=SMALL_ROWS):
    """0/1 column: is the key among `ids`? No row is lost or doubled.

    For wide rows or hot keys name a column that differs within a key, such as
    the review id, in `spread_by`. The ids are then counted: a small set is
    copied to all tasks, and for a big one each key is spread over several
    tasks, which all get that key's id.
    """
    marked = ids.select(key).distinct().withColumn("_member", F.lit(1))
    on = [key]
    if spread_by is not None and marked.count() <= rows:
        marked = F.broadcast(marked)
    elif spread_by is not None:
        on = [key, "_salt"]
        marked = marked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        df = df.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    joined = df.join(marked, on, "left")
    return joined.withColumn(name, F.coalesce("_member", F.lit(0))).drop("_member", "_salt")


def split_groups(
    df: DataFrame, ids: DataFrame, key, name="group", inside="in", outside="out", spread_by=None
):
    """Label rows by membership, so both groups go through one plan."""
    flagged = member_flag(df, ids, key, "_inside", spread_by)
    label = F.when(F.col("_inside") == 1, inside).otherwise(outside)
    return flagged.withColumn(name, label).drop("_inside")


def top_values(df: DataFrame, column, n) -> DataFrame:
    """The `n` most frequent values, ties by value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(n)


def fold_top_n(df: DataFrame, column, n, other="Other") -> DataFrame:
    """Keep the `n` most frequent values, everything else becomes `other`.

    The broadcast side has at most `n` rows by construction.
    """
    kept = top_values(df, column, n).select(F.col(column), F.lit(1).alias("_kept"))
    joined = df.join(F.broadcast(kept), column, "left")
    folded = F.when(F.col("_kept").isNotNull(), F.col(column)).otherwise(other)
    return joined.withColumn(column, folded).drop("_kept").select(*df.columns)


def drop_missing(df: DataFrame, columns) -> DataFrame:
    return df.dropna(subset=list(columns))


def missing_rates(df: DataFrame, columns) -> DataFrame:
    """(column, n_missing, pct_missing), one pass over the data."""
    counts = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"_m{i}") for i, c in enumerate(columns)],
    )
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("n_missing"))
            for i, c in enumerate(columns)
        ]
    )
    rate = F.col("n_missing") * 100.0 / F.nullif(F.col("_rows"), F.lit(0))
    return (
        counts.select("_rows", F.inline(cells))
        .select("column", "n_missing", rate.alias("pct_missing"))
    )


def audit(df: DataFrame, steps) -> DataFrame:
    """Rows left after each (name, condition) step, all steps in one pass:
    (ord, step, n_rows, n_dropped)."""
    passed, counts = F.lit(True), [F.count("*").alias("_c0")]
    for i, (_, condition) in enumerate(steps, start=1):
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(passed).alias(f"_c{i}"))
    names = ["rows in", *[name for name, _ in steps]]
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("ord"),
                F.lit(name).alias("step"),
                F.col(f"_c{i}").alias("n_rows"),
                (F.col(f"_c{max(i - 1, 0)}") - F.col(f"_c{i}")).alias("n_dropped"),
            )
            for i, name in enumerate(names)
        ]
    )
    return df.agg(*counts).select(F.inline(cells))
