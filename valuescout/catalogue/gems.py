"""Queries over exposure, prices and the search for gems."""

from pyspark.sql import functions as F

from valuescout.catalogue.tables import (
    MIN_RATE,
    POSITIVE_VALUE,
    SQL_BUCKET,
    SQL_CUSTOMERS,
    SQL_FACTS,
    SQL_GEMS,
    SQL_JOINED,
    SQL_LISTINGS,
    SQL_PREDICTIONS,
    SQL_REVIEWS,
    customers,
    facts,
    listings,
    predictions,
    reviews,
    table,
    with_nation,
)
from valuescout.operators import exposure, funnel as fn, pricing
from valuescout.operators.quantiles import median_impute

VIEW = (1000.0, 9000.0)


def _rounded(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


def review_counts(spark, sf_dir):
    return exposure.review_counts(reviews(spark, sf_dir))


def hidden_flag(spark, sf_dir):
    counts = exposure.review_counts(reviews(spark, sf_dir))
    return exposure.low_exposure(counts).select("listing_id", "is_hidden")


def positive_rate(spark, sf_dir):
    rates = exposure.positive_rate(reviews(spark, sf_dir), "listing_id", "score", POSITIVE_VALUE)
    return _rounded(rates, "positive_rate")


def listing_facts(spark, sf_dir):
    return _rounded(facts(spark, sf_dir), "positive_rate")


def train_test_split(spark, sf_dir):
    return pricing.train_test_flag(customers(spark, sf_dir)).select("id", "in_test_set")


def imputed(spark, sf_dir):
    """Customers without recent reviews and without credit get the medians."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("listing_id"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("price_clean"),
    )
    described = customers.join(
        facts(spark, sf_dir).select("listing_id", "review_count"), "listing_id", "left"
    )
    return _rounded(median_impute(described, ["price_clean", "review_count"]), "price_clean")


MEDIAN_IMPUTE = f"""
WITH {SQL_FACTS},
described AS (
  SELECT CAST(c_custkey AS VARCHAR) AS listing_id,
         CASE WHEN c_acctbal > 0 THEN c_acctbal END AS price_clean, review_count
  FROM customer LEFT JOIN facts ON CAST(c_custkey AS VARCHAR) = facts.listing_id)
SELECT listing_id,
       round(coalesce(price_clean, (SELECT median(price_clean) FROM described)), 6) AS price_clean,
       CAST(coalesce(review_count, (SELECT median(review_count) FROM described)) AS DOUBLE) AS review_count
FROM described"""


def one_hot(spark, sf_dir):
    """All customers: what the tree's pipeline makes of the segment."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("room_type"))
    coded = pricing.one_hot(customers, ["room_type"])
    return coded.select("id", F.array_join(F.transform("room_type_onehot", lambda x: x.cast("int").cast("string")), "").alias("bits"))


ONE_HOT = """
WITH levels AS (
  SELECT DISTINCT c_mktsegment AS level FROM customer
  WHERE c_mktsegment <> (SELECT min(c_mktsegment) FROM customer))
SELECT c_custkey AS id, string_agg(CASE WHEN c_mktsegment = level THEN '1' ELSE '0' END, '' ORDER BY level DESC) AS bits
FROM customer, levels GROUP BY c_custkey"""


def price_metrics(spark, sf_dir):
    metrics = pricing.price_metrics(predictions(spark, sf_dir))
    return _rounded(metrics, *[c for c in metrics.columns if c not in ("split", "n")], places=4)


PRICE_METRICS = f"""
WITH {SQL_PREDICTIONS},
rows AS (
  SELECT CASE WHEN in_test_set = 1 THEN 'test' ELSE 'train' END AS split, * FROM predictions
  UNION ALL SELECT 'all' AS split, * FROM predictions),
metrics AS (
  SELECT split, count(*) AS n,
         sqrt(avg(pow(log_price - predicted_log_price, 2))) AS rmse_log,
         sqrt(avg(pow(residual, 2))) AS rmse, avg(abs(residual)) AS mae,
         avg(abs(residual) / price_clean) * 100 AS mape_pct
  FROM rows GROUP BY split)
SELECT split, n, round(rmse_log, 4) AS rmse_log, round(exp(rmse_log), 4) AS exp_rmse_log,
       round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(mape_pct, 4) AS mape_pct,
       round(rmse_log - (SELECT rmse_log FROM metrics WHERE split = 'all'), 4) AS gap_to_all
FROM metrics"""


def off_view(spark, sf_dir):
    return _rounded(pricing.off_view(predictions(spark, sf_dir), VIEW), "pct_outside")


_SQL_OUTSIDE = f"(price_clean NOT BETWEEN {VIEW[0]} AND {VIEW[1]} OR predicted_price NOT BETWEEN {VIEW[0]} AND {VIEW[1]})"
OFF_VIEW = f"""
WITH {SQL_PREDICTIONS}
SELECT count(*) AS n, count(*) FILTER (WHERE {_SQL_OUTSIDE}) AS n_outside,
       round(avg(CASE WHEN {_SQL_OUTSIDE} THEN 1.0::DOUBLE ELSE 0.0 END) * 100, 6) AS pct_outside
FROM predictions WHERE in_test_set = 1"""


def joined(spark, sf_dir):
    """Evaluable listings with every signal."""
    known = facts(spark, sf_dir)
    return known.join(predictions(spark, sf_dir).withColumnRenamed("id", "listing_id"), "listing_id")


def gems_join(spark, sf_dir):
    known = facts(spark, sf_dir)
    flags, rates = known.select("listing_id", "is_hidden"), known.select("listing_id", "positive_rate")
    signals = fn.join_signals(flags, rates, predictions(spark, sf_dir))
    return _rounded(
        signals, "positive_rate", "log_price", "predicted_log_price", "predicted_price", "residual"
    )


GEMS_JOIN = f"""
WITH {SQL_JOINED}
SELECT listing_id, is_hidden, round(positive_rate, 6) AS positive_rate, price_clean,
       round(log_price, 6) AS log_price, round(predicted_log_price, 6) AS predicted_log_price,
       round(predicted_price, 6) AS predicted_price, round(residual, 6) AS residual, in_test_set
FROM joined"""


def _found(spark, sf_dir):
    return fn.select_gems(joined(spark, sf_dir), MIN_RATE)


def gems(spark, sf_dir):
    found = _found(spark, sf_dir).orderBy(F.desc("discount_pct"), "listing_id")
    return _rounded(found, "positive_rate", "predicted_price", "discount_pct")


_SQL_ROUNDED_GEMS = """
SELECT listing_id, is_hidden, round(positive_rate, 6) AS positive_rate, price_clean,
       round(predicted_price, 6) AS predicted_price, round(discount_pct, 6) AS discount_pct, in_test_set
FROM gems ORDER BY gems.discount_pct DESC, listing_id"""
GEMS = f"WITH {SQL_GEMS}{_SQL_ROUNDED_GEMS}"


def gems_top10(spark, sf_dir):
    return gems(spark, sf_dir).limit(10)


STAGES = ("evaluable", "low exposure", "well reviewed", "underpriced", "out of sample")


def funnel(spark, sf_dir):
    table_ = fn.funnel(joined(spark, sf_dir), fn.criteria(MIN_RATE))
    return table_.select("ord", "stage", "n", F.round("pct_of_base", 6).alias("pct_of_base"))


_SQL_FUNNEL = f"""{SQL_JOINED},
flags AS (
  SELECT is_hidden = 1 AS a, is_hidden = 1 AND positive_rate > {MIN_RATE} AS b,
         is_hidden = 1 AND positive_rate > {MIN_RATE}
           AND price_clean <= predicted_price * (1 - 0.15) AS c, in_test_set = 1 AS t
  FROM joined),
tally AS (
  SELECT [count(*), count(*) FILTER (WHERE a), count(*) FILTER (WHERE b),
          count(*) FILTER (WHERE c), count(*) FILTER (WHERE c AND t)] AS ns FROM flags),
stages AS (
  SELECT CAST(i AS INTEGER) AS ord, [{", ".join(f"'{s}'" for s in STAGES)}][i + 1] AS stage,
         ns[i + 1] AS n, ns[1] AS base, CASE WHEN i > 0 THEN ns[i] END AS before
  FROM tally, range(0, 5) t(i))"""
FUNNEL = f"""
WITH {_SQL_FUNNEL}
SELECT ord, stage, n, round(n * 100.0::DOUBLE / base, 6) AS pct_of_base FROM stages"""


def funnel_retention(spark, sf_dir):
    table_ = fn.funnel(joined(spark, sf_dir), fn.criteria(MIN_RATE))
    return table_.select("ord", "stage", F.round("retention_pct", 6).alias("retention_pct"))


FUNNEL_RETENTION = f"""
WITH {_SQL_FUNNEL}
SELECT ord, stage, round(n * 100.0::DOUBLE / before, 6) AS retention_pct FROM stages"""


def gems_enrich(spark, sf_dir):
    described = with_nation(spark, sf_dir, listings(spark, sf_dir)).select(
        F.col("id").alias("listing_id"), "room_type", "neighbourhood_cleansed"
    )
    residuals = predictions(spark, sf_dir).select(
        F.col("id").alias("listing_id"), F.round("residual", 6).alias("residual")
    )
    found = _found(spark, sf_dir).select(
        "listing_id", "price_clean", F.round("discount_pct", 6).alias("discount_pct")
    )
    return found.join(described, "listing_id", "left").join(residuals, "listing_id", "left")


GEMS_ENRICH = f"""
WITH {SQL_GEMS}
SELECT g.listing_id, g.price_clean, round(discount_pct, 6) AS discount_pct, l.room_type,
       n_name AS neighbourhood_cleansed, round(p.residual, 6) AS residual
FROM gems g
LEFT JOIN listings l ON g.listing_id = l.id LEFT JOIN nation ON l.nation = n_nationkey
LEFT JOIN predictions p ON g.listing_id = p.id"""

QUERIES = {
    "review_counts": review_counts,
    "hidden_flag": hidden_flag,
    "positive_rate": positive_rate,
    "listing_facts": listing_facts,
    "train_test_split": train_test_split,
    "median_impute": imputed,
    "one_hot": one_hot,
    "price_metrics": price_metrics,
    "off_view": off_view,
    "gems_join": gems_join,
    "gems": gems,
    "gems_top10": gems_top10,
    "funnel": funnel,
    "funnel_retention": funnel_retention,
    "gems_enrich": gems_enrich,
}

ORACLES = {
    "review_counts": f"WITH {SQL_REVIEWS} SELECT listing_id, count(*) AS review_count FROM reviews GROUP BY listing_id",
    "hidden_flag": f"WITH {SQL_FACTS} SELECT listing_id, is_hidden FROM facts",
    "positive_rate": f"WITH {SQL_FACTS} SELECT listing_id, round(positive_rate, 6) AS positive_rate FROM facts",
    "listing_facts": f"""WITH {SQL_FACTS}
SELECT listing_id, review_count, round(positive_rate, 6) AS positive_rate, is_hidden FROM facts""",
    "train_test_split": f"""
WITH {SQL_CUSTOMERS}
SELECT id, CAST({SQL_BUCKET.format(id="id", seed=42, n=5)} <> 0 AS INTEGER) AS in_test_set FROM customers""",
    "median_impute": MEDIAN_IMPUTE,
    "one_hot": ONE_HOT,
    "price_metrics": PRICE_METRICS,
    "off_view": OFF_VIEW,
    "gems_join": GEMS_JOIN,
    "gems": GEMS,
    "gems_top10": f"{GEMS} LIMIT 10",
    "funnel": FUNNEL,
    "funnel_retention": FUNNEL_RETENTION,
    "gems_enrich": GEMS_ENRICH,
}
