"""Mixing sources to target weights without sorting documents.

Every document has a hash. A source is taken up to a threshold of that hash,
found by nested histograms: sizes are summed by source and hash bucket, the
bucket in which the budget ends is cut into smaller ones, and so on; only
documents of that bucket are counted again. Sources with a budget above their
size are taken whole, as often as it fits, and once more up to a threshold.
Thresholds are nested: a greater budget takes a superset.
"""

from pyspark.sql import DataFrame, Window, functions as F

from valuescout.session import cut_lineage

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
HASH_BITS = 60
STEP_BITS = 10


def hash_of(id_col, text_col):
    """60 bits from the id and the text, the same in every engine."""
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def word_count(text_col):
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most=MOST_COPIES) -> DataFrame:
    """Targets per source from columns source and source_size.

    Sources by code point, null last, get the weights in turn. Targets share
    the sum of all sizes by weight; a source is capped at `most` times its
    size and the rest shared by the others. Sorted by cap per weight, capped
    sources come first, so two running sums give every target at once. There
    is a row per source here, not per document.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    sources = sizes.withColumn("place", place).withColumn("weight", weight.cast("double"))
    cap = F.col("source_size") * F.lit(float(most))
    by_cap = Window.orderBy(cap / F.col("weight"), "place")
    earlier = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(earlier), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    sources = sources.select("source", "source_size", "weight", cap.alias("cap"), (left / open_weight).alias("level"))
    capped = F.col("cap") <= F.col("weight") * F.col("level")
    level = F.max(F.when(~capped, F.col("level"))).over(everything)
    return sources.select(
        "source",
        "source_size",
        F.when(capped, F.col("cap")).otherwise(F.col("weight") * level).alias("target"),
    )


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Whole copies and the hash bound of the last, partial one, per source.

    `sized` has source, size and hash; `targets` what `source_targets` gives.
    A level narrows each source to one bucket of 2**STEP_BITS; histograms have
    that many rows per source at most.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = targets.select(
        "source",
        "source_size",
        "target",
        whole.cast("long").alias("whole"),
        F.greatest(F.lit(0.0), F.col("target") - whole * F.col("source_size")).alias("budget"),
        F.lit(0).cast("long").alias("prefix"),
        F.lit(0).cast("long").alias("below"),
        F.lit(True).alias("open"),
    )
    for level in range(HASH_BITS // STEP_BITS):
        rest = HASH_BITS - STEP_BITS * (level + 1)
        bucket = F.shiftright(F.col("hash"), rest)
        inside = sized.join(
            state.filter("open").select(F.col("source").alias("s"), "prefix"),
            F.col("source").eqNullSafe(F.col("s")) & (F.shiftright(F.col("hash"), rest + STEP_BITS) == F.col("prefix")),
        )
        histogram = inside.groupBy("s", bucket.alias("bucket")).agg(F.sum("size").alias("total"))
        run = Window.partitionBy("s").orderBy("bucket")
        histogram = histogram.withColumn("upto", F.sum("total").over(run))
        around = state.filter("open").join(histogram, F.col("source").eqNullSafe(F.col("s")))
        over = F.col("below") + F.col("upto") > F.col("budget")
        ends = around.filter(over).groupBy("s").agg(F.min_by(F.struct("bucket", "total", "upto"), "bucket").alias("cut"))
        state = cut_lineage(
            state.join(ends, F.col("source").eqNullSafe(F.col("s")) & F.col("open"), "left").select(
                "source",
                "source_size",
                "target",
                "whole",
                "budget",
                F.coalesce(F.col("cut.bucket"), F.col("prefix")).alias("prefix"),
                (F.col("below") + F.coalesce(F.col("cut.upto") - F.col("cut.total"), F.lit(0))).alias("below"),
                (F.col("open") & F.col("cut").isNotNull()).alias("open"),
                F.col("cut.total").alias("last"),
            )
        )
    # the last bucket holds one hash: its documents come in if that is nearer
    nearer = F.col("below") + F.col("last") - F.col("budget") < F.col("budget") - F.col("below")
    bound = F.when(~F.col("open"), F.lit(1 << HASH_BITS)).otherwise(F.col("prefix") + F.when(nearer, 1).otherwise(0))
    bound = F.when(F.col("budget") > 0, bound).otherwise(F.lit(0))
    return state.select("source", "source_size", "target", "whole", bound.cast("long").alias("bound"))


def mix_sources(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, carry=()) -> DataFrame:
    """How often each document enters the mix, decided where it lies.

    Returns id, source, rest (a struct of the columns named in `carry`), size
    (words), source_size, target (of the source), copies and taken (size times
    copies). Sizes are counted once into a narrow table; texts are not moved.

    Defined cases: a null or blank text has size 0; null is a source of its
    own, the last; documents with the same id and text share a hash and enter
    alike; a source without words has target 0; an empty table gives an empty
    result; columns not named are ignored, whatever they are called.
    """
    size = word_count(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("none")]).alias("rest"),
        size.alias("size"),
        hash_of(id_col, text_col).alias("hash"),
    )
    sized = cut_lineage(rows.select("source", "size", "hash"))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    found = thresholds(sized, targets).withColumnRenamed("source", "s")
    copies = F.col("whole") + (F.col("hash") < F.col("bound")).cast("long")
    mixed = rows.join(found, F.col("source").eqNullSafe(F.col("s")))
    return mixed.select("id", "source", "rest", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def op2_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


_WEIGHT = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END"
SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS hash
  FROM documents
), sources AS (
  SELECT source, source_size, {_WEIGHT} AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)
), levels AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
         (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER earlier, 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level
  FROM sources
  WINDOW earlier AS (ORDER BY 3.0::DOUBLE * source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size,
         CASE WHEN cap <= weight * level THEN cap
              ELSE weight * max(CASE WHEN cap > weight * level THEN level END) OVER () END AS target
  FROM levels
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets
), run AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.whole,
         greatest(0, b.target - b.whole * b.source_size) AS budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.hash) AS tied
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (whole + CASE WHEN budget > 0 AND (upto <= budget OR (upto - tied <= budget AND upto - budget < budget - (upto - tied)))
                             THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
"""
