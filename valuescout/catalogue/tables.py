"""The given tables in the roles of listings, reviews and predictions.

Each adapter has its SQL twin next to it, for the side-by-side check.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from valuescout.functions.values import log_price
from valuescout.operators.exposure import low_exposure, review_facts
from valuescout.operators.pricing import mean_price_by, train_test_flag

POSITIVE_VALUE = 150000
MIN_RATE = 0.5


def table(spark: SparkSession, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark, sf_dir):
    """All orders: the order value plays the review score."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("listing_id"),
        F.col("o_totalprice").alias("score"),
    )


def facts(spark, sf_dir):
    found = review_facts(reviews(spark, sf_dir), "listing_id", "score", POSITIVE_VALUE)
    return low_exposure(found)


def customers(spark, sf_dir):
    """All customers as listings, where the price does not matter."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_mktsegment").alias("room_type"),
        F.col("c_nationkey").alias("nation"),
    )


def listings(spark, sf_dir):
    """Customers with a positive balance: the balance plays the price."""
    priced = table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 0)
    return priced.select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_acctbal").alias("price_clean"),
        log_price("c_acctbal").alias("log_price"),
        F.col("c_mktsegment").alias("room_type"),
        F.col("c_nationkey").alias("nation"),
    )


def predictions(spark, sf_dir):
    return mean_price_by(train_test_flag(listings(spark, sf_dir)), "room_type")


def with_nation(spark, sf_dir, df, key="nation"):
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias(key),
        F.col("n_name").alias("neighbourhood_cleansed"),
        F.col("n_regionkey").alias("cluster"),
    )
    return df.join(nation, key)


def segment_inputs(spark, sf_dir):
    """One row per listing with all signals; the region plays the cluster."""
    joined = facts(spark, sf_dir).join(
        predictions(spark, sf_dir).withColumnRenamed("id", "listing_id"), "listing_id"
    )
    described = listings(spark, sf_dir).select(
        F.col("id").alias("listing_id"), "room_type", "nation"
    )
    discount = 1 - F.col("price_clean") / F.col("predicted_price")
    full = joined.join(described, "listing_id").withColumn("discount_pct", discount)
    return with_nation(spark, sf_dir, full)


# The same adapters in SQL.
SQL_REVIEWS = """
reviews AS (
  SELECT CAST(o_custkey AS VARCHAR) AS listing_id, o_totalprice AS score
  FROM orders)"""

SQL_FACTS = f"""{SQL_REVIEWS},
counts AS (
  SELECT listing_id, count(*) AS review_count,
         avg(CASE WHEN score >= {POSITIVE_VALUE} THEN 1.0::DOUBLE ELSE 0.0 END) AS positive_rate
  FROM reviews GROUP BY listing_id),
facts AS (
  SELECT *, CAST(review_count < (SELECT median(review_count) FROM counts) AS INTEGER) AS is_hidden
  FROM counts)"""

SQL_CUSTOMERS = """
customers AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS room_type, c_nationkey AS nation FROM customer)"""

SQL_LISTINGS = """
listings AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_acctbal AS price_clean, ln(c_acctbal) AS log_price,
         c_mktsegment AS room_type, c_nationkey AS nation
  FROM customer WHERE c_acctbal > 0)"""

SQL_BUCKET = "CAST('0x' || substr(md5({id} || ':{seed}'), 1, 8) AS BIGINT) % {n}"

SQL_PREDICTIONS = f"""{SQL_LISTINGS},
split AS (
  SELECT *, CAST({SQL_BUCKET.format(id="id", seed=42, n=5)} <> 0 AS INTEGER) AS in_test_set
  FROM listings),
fitted AS (
  SELECT room_type, avg(log_price) AS predicted_log_price
  FROM split WHERE in_test_set = 0 GROUP BY room_type),
predictions AS (
  SELECT id, price_clean, log_price, predicted_log_price,
         exp(predicted_log_price) AS predicted_price,
         price_clean - exp(predicted_log_price) AS residual, in_test_set
  FROM split JOIN fitted USING (room_type))"""

SQL_JOINED = f"""{SQL_FACTS},{SQL_PREDICTIONS},
joined AS (
  SELECT f.listing_id, is_hidden, positive_rate, review_count, price_clean, log_price,
         predicted_log_price, predicted_price, residual, in_test_set
  FROM facts f JOIN predictions p ON f.listing_id = p.id)"""

SQL_GEMS = f"""{SQL_JOINED},
gems AS (
  SELECT listing_id, is_hidden, positive_rate, price_clean, predicted_price,
         1 - price_clean / predicted_price AS discount_pct, in_test_set
  FROM joined
  WHERE is_hidden = 1 AND positive_rate > {MIN_RATE}
    AND price_clean <= predicted_price * (1 - 0.15) AND in_test_set = 1)"""

SQL_SEGMENTS = f"""{SQL_JOINED},
segments AS (
  SELECT j.*, 1 - price_clean / predicted_price AS discount_pct, l.room_type,
         n_name AS neighbourhood_cleansed, n_regionkey AS cluster
  FROM joined j JOIN (SELECT id, room_type, nation FROM listings) l ON j.listing_id = l.id
  JOIN nation ON nation = n_nationkey)"""
