"""Queries that train models. Trees over all thresholds have SQL twins, the others
are checked by quality bounds."""

from pyspark.sql import functions as F

from valuescout.catalogue.tables import MIN_RATE, SQL_BUCKET, SQL_FACTS, SQL_LISTINGS, facts, listings, table
from valuescout.functions.values import log_price
from valuescout.operators import exact_tree, funnel, pricing
from valuescout.plans.pricing import fair_price
from valuescout.session import cut_lineage, spread

NUMERIC = ("quantity", "discount", "tax", "size", "ship_days")
CATEGORICAL = ("brand", "type", "name")


def _offers(spark, sf_dir):
    """Order lines priced by quantity, list price and discount; the list price
    is not a feature and returned lines have no known quantity."""
    lines = spread(table(spark, sf_dir, "lineitem"))
    parts = table(spark, sf_dir, "part")
    price = F.col("l_quantity") * F.col("p_retailprice") * (1 - F.col("l_discount"))
    joined = lines.join(parts, lines.l_partkey == parts.p_partkey)
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        price.alias("price_clean"),
        log_price(price).alias("log_price"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("p_size").alias("size"),
        F.datediff("l_shipdate", F.lit("1995-01-01")).alias("ship_days"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("type"),
        F.col("p_name").alias("name"),
    )


def _fit(spark, sf_dir):
    return fair_price(_offers(spark, sf_dir), NUMERIC, CATEGORICAL, fold="name")


def _prepared(spark, sf_dir):
    split = pricing.train_test_flag(_offers(spark, sf_dir))
    return cut_lineage(pricing.prepare_features(split, NUMERIC, CATEGORICAL, fold="name"))


def price_tree(spark, sf_dir):
    """Tree size and error metrics per split."""
    found = _fit(spark, sf_dir)
    size = [F.lit(v).alias(name) for name, v in found.size.items()]
    return found.metrics.select(*found.metrics.columns, *size)


def price_predictions(spark, sf_dir):
    return _fit(spark, sf_dir).predictions


def importances(spark, sf_dir):
    return _fit(spark, sf_dir).importances


def price_cv(spark, sf_dir):
    prepared = _prepared(spark, sf_dir)
    return pricing.cross_validate(prepared, NUMERIC, CATEGORICAL, depths=(4, 8), leaves=(20, 100))


def price_overfit(spark, sf_dir):
    """The chosen tree next to the deepest one that Spark grows (30 levels)."""
    settings = [("constrained", 8, 20), ("unconstrained", 30, 1)]
    return pricing.overfit_report(_prepared(spark, sf_dir), NUMERIC, CATEGORICAL, settings)


EXACT_NUMERIC = ("quantity", "discount", "tax", "size", "ship_days")


def _grown(spark, sf_dir, max_depth, min_leaf):
    offers = pricing.train_test_flag(_offers(spark, sf_dir))
    prepared = cut_lineage(pricing.prepare_features(offers, EXACT_NUMERIC, ()))
    train = prepared.filter(F.col("in_test_set") == 0)
    return prepared, exact_tree.grow(train, "log_price", EXACT_NUMERIC, max_depth, min_leaf)


def _nodes(spark, tree):
    rounded = {c: F.round(c, 6) for c in ("mean", "threshold", "gain")}
    return exact_tree.node_table(spark, tree).withColumns(rounded)


def price_stump(spark, sf_dir):
    """The best split of all training rows over all thresholds of all numbers."""
    return _nodes(spark, _grown(spark, sf_dir, 1, 20)[1])


def price_tree3(spark, sf_dir):
    """Three levels of such splits."""
    return _nodes(spark, _grown(spark, sf_dir, 3, 20)[1])


def price_tree3_metrics(spark, sf_dir):
    """How well those leaves predict the prices of training and test rows."""
    prepared, tree = _grown(spark, sf_dir, 3, 20)
    scored = exact_tree.predict(prepared, tree, "predicted_log_price")
    scored = scored.withColumn("predicted_price", F.exp("predicted_log_price"))
    found = pricing.price_metrics(scored)
    return found.select("split", "n", *[F.round(c, 6).alias(c) for c in found.columns if c not in ("split", "n")])


_SQL_OFFERS = f"""
offers AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id,
         l_quantity * p_retailprice * (1 - l_discount) AS price_clean,
         CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS quantity,
         l_discount AS discount, l_tax AS tax, p_size AS size, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS ship_days
  FROM lineitem JOIN part ON l_partkey = p_partkey),
prepared AS (
  SELECT id, price_clean, ln(CASE WHEN price_clean > 0 THEN price_clean END) AS log_price,
         CAST({SQL_BUCKET.format(id="id", seed=42, n=5)} <> 0 AS INTEGER) AS in_test_set,
         [CAST(coalesce(quantity, (SELECT median(quantity) FROM offers)) AS DOUBLE),
          CAST(coalesce(discount, (SELECT median(discount) FROM offers)) AS DOUBLE),
          CAST(coalesce(tax, (SELECT median(tax) FROM offers)) AS DOUBLE),
          CAST(coalesce(size, (SELECT median(size) FROM offers)) AS DOUBLE),
          CAST(coalesce(ship_days, (SELECT median(ship_days) FROM offers)) AS DOUBLE)] AS x
  FROM offers),
rows0 AS (
  SELECT CAST(1 AS BIGINT) AS node, x, CAST(log_price AS DECIMAL(28,12)) AS y FROM prepared
  WHERE in_test_set = 0 AND log_price IS NOT NULL)"""


def sql_tree(levels, min_leaf, features):
    """CTEs `rows0` (node, x, y) -> `nodes`: the same search level by level."""
    steps, tables = [], []
    for i in range(levels + 1):
        steps.append(f"""
totals{i} AS (
  SELECT node, count(*) AS n, CAST(sum(y) AS DOUBLE) / count(*) AS mean FROM rows{i} GROUP BY node)""")
        if i == levels:
            tables.append(f"SELECT node, n, mean, NULL AS f, NULL AS t, 0.0 AS gain FROM totals{i}")
            break
        steps.append(f"""
cells{i} AS (
  SELECT node, f, v, count(*) AS n, sum(y) AS s
  FROM (SELECT node, y, unnest(range({len(features)})) AS f, unnest(x) AS v FROM rows{i}) GROUP BY node, f, v),
upto{i} AS (
  SELECT node, f, v, sum(n) OVER w AS ln, CAST(sum(s) OVER w AS DOUBLE) AS ls,
         sum(n) OVER (PARTITION BY node, f) AS tn, CAST(sum(s) OVER (PARTITION BY node, f) AS DOUBLE) AS ts,
         lead(v) OVER w AS onward
  FROM cells{i} WINDOW w AS (PARTITION BY node, f ORDER BY v)),
best{i} AS (
  SELECT *, round(ln * (tn - ln) / CAST(tn AS DOUBLE) * (ls / ln - (ts - ls) / (tn - ln)) ** 2, 6) AS gain
  FROM upto{i} WHERE onward IS NOT NULL AND ln >= {min_leaf} AND tn - ln >= {min_leaf}
  QUALIFY gain > 0 AND row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v) = 1),
rows{i + 1} AS (
  SELECT 2 * node + CAST(x[f + 1] > (v + onward) / 2 AS BIGINT) AS node, x, y FROM rows{i} JOIN best{i} USING (node))""")
        tables.append(f"SELECT node, n, mean, f, (v + onward) / 2 AS t, coalesce(gain, 0.0) AS gain FROM totals{i} LEFT JOIN (SELECT node, f, v, onward, gain FROM best{i}) USING (node)")
    names = ", ".join(f"'{c}'" for c in features)
    steps.append(f"""
nodes AS (
  SELECT node, CAST(floor(log2(node)) AS INTEGER) AS depth, n, mean, ([{names}])[f + 1] AS feature, t AS threshold, gain, f
  FROM ({' UNION ALL '.join(tables)}))""")
    return ",".join(steps)


def _sql_nodes(levels):
    return f"""
WITH {_SQL_OFFERS},{sql_tree(levels, 20, EXACT_NUMERIC)}
SELECT node, depth, n, round(mean, 6) AS mean, feature, round(threshold, 6) AS threshold, round(gain, 6) AS gain FROM nodes"""


def sql_placed(table, levels):
    """CTE `placed`: the rows of `table`, which have an x, with their leaf of `nodes`."""
    steps = [f"at0 AS (SELECT *, CAST(1 AS BIGINT) AS node FROM {table})"]
    for i in range(levels):
        steps.append(
            f"at{i + 1} AS (SELECT a.* REPLACE (CASE WHEN f IS NULL THEN a.node "
            f"ELSE 2 * a.node + CAST(x[f + 1] > threshold AS BIGINT) END AS node) FROM at{i} a LEFT JOIN nodes n ON a.node = n.node)"
        )
    steps.append(f"placed AS (SELECT * FROM at{levels})")
    return ", ".join(steps)


PRICE_TREE3_METRICS = f"""
WITH {_SQL_OFFERS},{sql_tree(3, 20, EXACT_NUMERIC)}, {sql_placed("prepared", 3)},
scored AS (
  SELECT p.*, mean AS predicted_log, exp(mean) AS predicted FROM placed p JOIN nodes USING (node)),
twice AS (SELECT CASE WHEN in_test_set = 1 THEN 'test' ELSE 'train' END AS split, * FROM scored
         UNION ALL SELECT 'all' AS split, * FROM scored),
found AS (
  SELECT split, count(*) AS n, sqrt(avg((log_price - predicted_log) ** 2)) AS rmse_log, sqrt(avg((price_clean - predicted) ** 2)) AS rmse,
         avg(abs(price_clean - predicted)) AS mae, avg(abs(price_clean - predicted) / price_clean) * 100 AS mape_pct
  FROM twice GROUP BY split)
SELECT split, n, round(rmse_log, 6) AS rmse_log, round(exp(rmse_log), 6) AS exp_rmse_log, round(rmse, 6) AS rmse, round(mae, 6) AS mae,
       round(mape_pct, 6) AS mape_pct, round(rmse_log - (SELECT rmse_log FROM found WHERE split = 'all'), 6) AS gap_to_all
FROM found"""


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_GEM_FEATURES = ("nation", *SEGMENTS[1:])


def gems_tree(spark, sf_dir):
    """The search for gems with the fair price of a tree fitted on the training
    rows: nation and market segment, all splits tried, three levels."""
    split = pricing.train_test_flag(listings(spark, sf_dir))
    split = split.withColumns({c: (F.col("room_type") == c).cast("double") for c in SEGMENTS[1:]})
    split = cut_lineage(split.withColumn("nation", F.col("nation").cast("double")))
    tree = exact_tree.grow(split.filter(F.col("in_test_set") == 0), "log_price", _GEM_FEATURES, 3, 5)
    scored = exact_tree.predict(split, tree, "predicted_log_price")
    predicted = F.exp("predicted_log_price")
    priced = scored.select(
        "id",
        "price_clean",
        "log_price",
        "predicted_log_price",
        predicted.alias("predicted_price"),
        (F.col("price_clean") - predicted).alias("residual"),
        "in_test_set",
    )
    known = facts(spark, sf_dir)
    flags, rates = known.select("listing_id", "is_hidden"), known.select("listing_id", "positive_rate")
    found = funnel.select_gems(funnel.join_signals(flags, rates, priced), MIN_RATE, 0.15)
    rounded = found.withColumns({c: F.round(c, 6) for c in ("positive_rate", "predicted_price", "discount_pct")})
    return rounded.orderBy(F.desc("discount_pct"), "listing_id")


GEMS_TREE = f"""
WITH {SQL_FACTS},{SQL_LISTINGS},
prepared AS (
  SELECT id, price_clean, log_price, CAST({SQL_BUCKET.format(id="id", seed=42, n=5)} <> 0 AS INTEGER) AS in_test_set,
         [CAST(nation AS DOUBLE), {", ".join(f"CAST(room_type = '{c}' AS DOUBLE)" for c in SEGMENTS[1:])}] AS x
  FROM listings),
rows0 AS (SELECT CAST(1 AS BIGINT) AS node, x, CAST(log_price AS DECIMAL(28,12)) AS y FROM prepared WHERE in_test_set = 0),
{sql_tree(3, 5, _GEM_FEATURES)}, {sql_placed("prepared", 3)},
predictions AS (
  SELECT id, price_clean, exp(mean) AS predicted_price, in_test_set FROM placed JOIN nodes USING (node))
SELECT listing_id, is_hidden, round(positive_rate, 6) AS positive_rate, price_clean, round(predicted_price, 6) AS predicted_price,
       round(1 - price_clean / predicted_price, 6) AS discount_pct, in_test_set
FROM facts JOIN predictions ON listing_id = id
WHERE is_hidden = 1 AND positive_rate > {MIN_RATE} AND price_clean <= predicted_price * (1 - 0.15) AND in_test_set = 1"""


QUERIES = {
    "gems_tree": gems_tree,
    "price_stump": price_stump,
    "price_tree3": price_tree3,
    "price_tree3_metrics": price_tree3_metrics,
    "price_tree": price_tree,
    "price_predictions": price_predictions,
    "importances": importances,
    "price_cv": price_cv,
    "price_overfit": price_overfit,
}

ORACLES = {
    "gems_tree": GEMS_TREE,
    "price_stump": _sql_nodes(1),
    "price_tree3": _sql_nodes(3),
    "price_tree3_metrics": PRICE_TREE3_METRICS,
}
