"""Queries over scans, ids, cleaning and audits."""

from pyspark.sql import functions as F, types as T

from valuescout.catalogue.tables import (
    SQL_CUSTOMERS,
    SQL_FACTS,
    SQL_LISTINGS,
    SQL_REVIEWS,
    customers,
    facts,
    listings,
    reviews,
    table,
)
from valuescout.constants import AMENITY_PATTERNS, NA_TOKENS
from valuescout.functions.amenities import amenities_count, amenity_flags, parse_amenities
from valuescout.functions.values import (
    in_year,
    log_price,
    parse_bathrooms,
    parse_price,
    tenure_years,
    to_number,
    truthy,
)
from valuescout.operators.rows import (
    dedupe_first,
    distinct_ids,
    drop_missing,
    fold_top_n,
    keep_members,
    keep_valid_ids,
    member_flag,
    missing_rates,
)
from valuescout.session import scratch_folder
from valuescout.sources.csv import REJECT, clean_na, parse_lines
from valuescout.sources.sinks import write_csv
from valuescout.sources.split_csv import scan_csv_split


def scan_clean_na(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "N/A")
        .when(F.col("c_mktsegment") == "MACHINERY", "")
        .when(F.col("c_mktsegment") == "FURNITURE", "nan")
        .otherwise(F.col("c_name"))
        .alias("name"),
        F.when(F.col("c_acctbal") <= 0, "None").otherwise(F.col("c_mktsegment")).alias("segment"),
    )
    return clean_na(raw)


_TOKENS = ", ".join(f"'{t}'" for t in NA_TOKENS)
SCAN_CLEAN_NA = f"""
WITH raw AS (
  SELECT c_custkey AS id,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'N/A' WHEN 'MACHINERY' THEN ''
              WHEN 'FURNITURE' THEN 'nan' ELSE c_name END AS name,
         CASE WHEN c_acctbal <= 0 THEN 'None' ELSE c_mktsegment END AS segment
  FROM customer)
SELECT id, CASE WHEN name NOT IN ({_TOKENS}) THEN name END AS name,
       CASE WHEN segment NOT IN ({_TOKENS}) THEN segment END AS segment
FROM raw"""


def scan_split(spark, sf_dir):
    """The documents written as CSV, line breaks and quotes in their cells, and
    read back in blocks of their files."""
    docs = table(spark, sf_dir, "documents")
    path = scratch_folder(spark)
    write_csv(docs.select(F.col("doc_id").alias("id"), "lang", "source", "text"), path)
    back = scan_csv_split(spark, path)
    return back.select("id", "lang", "source", F.length("text").alias("length"), F.md5(F.col("text").cast("binary")).alias("md5"))


SCAN_SPLIT = f"""
SELECT CAST(doc_id AS VARCHAR) AS id, lang, source, CAST(length(t) AS INTEGER) AS length, md5(t) AS md5
FROM (SELECT *, CASE WHEN text NOT IN ({_TOKENS}) THEN text END AS t FROM documents)"""


def scan_rejects(spark, sf_dir):
    """Orders as CSV lines, finished ones with a broken date."""
    schema = T.StructType.fromDDL("key bigint, priority string, day date")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    lines = table(spark, sf_dir, "orders").select(
        "o_orderstatus",
        F.concat_ws(
            ",",
            F.col("o_orderkey").cast("string"),
            F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"')),
            F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("on "), day)).otherwise(day),
        ).alias("line"),
    )
    return parse_lines(lines, "line", schema).groupBy("o_orderstatus").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(f"row.{REJECT}").isNotNull()).alias("n_rejected"),
        F.max("row.day").alias("last_day"),
    )


SCAN_REJECTS = """
SELECT o_orderstatus, count(*) AS n_rows,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS n_rejected,
       CAST(max(CASE WHEN o_orderstatus <> 'F' THEN o_orderdate END) AS DATE) AS last_day
FROM orders GROUP BY o_orderstatus"""


def _dirty_ids(spark, sf_dir):
    key = F.col("o_custkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("  "), key, F.lit(".0 ")))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(key, F.lit("x")))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit(None).cast("string"))
        .otherwise(key)
        .alias("listing_id"),
    )


_SQL_CLEAN_IDS = """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS listing_id FROM orders
WHERE o_orderpriority NOT IN ('2-HIGH', '3-MEDIUM')"""


def valid_ids(spark, sf_dir):
    return keep_valid_ids(_dirty_ids(spark, sf_dir), "listing_id")


def distinct_id_set(spark, sf_dir):
    return distinct_ids(_dirty_ids(spark, sf_dir), "listing_id")


def parsed_prices(spark, sf_dir):
    money = F.format_number("c_acctbal", 2)
    plain = F.col("c_acctbal").cast("string")
    raw = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.concat(F.lit("$"), money))
        .when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("€ "), money))
        .when(F.col("c_mktsegment") == "FURNITURE", F.concat(F.lit(" \t"), plain, F.lit(" ")))
        .when(F.col("c_mktsegment") == "MACHINERY", F.concat(plain, F.lit("d")))
        .otherwise(plain)
        .alias("text"),
    )
    return raw.select("id", parse_price("text").alias("price"))


PARSE_PRICE = """
SELECT c_custkey AS id, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_acctbal END AS price
FROM customer"""


def bathrooms(spark, sf_dir):
    size = F.col("p_size").cast("string")
    raw = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(F.col("p_type") == "MEDIUM", size)
        .when(F.col("p_type") == "STANDARD", "n/a")
        .alias("number"),
        F.when(F.col("p_type") == "LARGE", "Shared half-bath")
        .when(F.col("p_type") == "PROMO", "Private")
        .when(F.col("p_type") == "SMALL", F.concat(F.lit(" "), size, F.lit(".5 baths")))
        .when(F.col("p_type") == "STANDARD", F.concat(size, F.lit(" shared baths")))
        .alias("text"),
    )
    return raw.select("p_partkey", parse_bathrooms("number", "text").alias("bathrooms_num"))


BATHROOMS = """
SELECT p_partkey,
       CASE WHEN p_type IN ('MEDIUM', 'STANDARD') THEN CAST(p_size AS DOUBLE)
            WHEN p_type = 'SMALL' THEN p_size + 0.5::DOUBLE
            WHEN p_type = 'LARGE' THEN 0.5::DOUBLE END AS bathrooms_num
FROM part"""


def truthy_flags(spark, sf_dir):
    spelled = (
        F.when(F.col("o_orderpriority") == "1-URGENT", " TRUE ")
        .when(F.col("o_orderpriority") == "2-HIGH", "t")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "Yes")
        .when(F.col("o_orderpriority") == "5-LOW", "f")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", truthy(spelled).alias("flag"))


TRUTHY_FLAGS = """
SELECT o_orderkey,
       CAST(o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS INTEGER) AS flag
FROM orders"""


def tenure(spark, sf_dir):
    start = F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    years = tenure_years(start, F.lit("2001-08-02"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.round(years, 6).alias("host_years")
    )


TENURE = """
SELECT o_orderkey,
       CASE WHEN o_orderstatus <> 'P'
            THEN round(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') / 365.25::DOUBLE, 6)
       END AS host_years
FROM orders"""


def numeric_cast(spark, sf_dir):
    flag = F.col("l_returnflag")
    raw = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.when(flag == "R", "n.a.").otherwise(F.col("l_quantity").cast("string")).alias("quantity"),
        F.when(flag == "A", "1_0").otherwise(F.col("l_tax").cast("string")).alias("tax"),
    )
    return raw.withColumns({c: to_number(c) for c in ("quantity", "tax")})


NUMERIC_CAST = """
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS quantity,
       CASE WHEN l_returnflag <> 'A' THEN l_tax END AS tax
FROM lineitem"""


def price_filter(spark, sf_dir):
    priced = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("price_clean")
    )
    return priced.filter(F.col("price_clean") > 0).withColumn(
        "log_price", F.round(log_price("price_clean"), 6)
    )


PRICE_FILTER = """
SELECT c_custkey AS id, c_acctbal AS price_clean, round(ln(c_acctbal), 6) AS log_price
FROM customer WHERE c_acctbal > 0"""


def first_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn(
        "_order", F.struct("o_orderdate", "o_orderkey")
    )
    return dedupe_first(orders, "o_custkey", "_order").drop("_order")


DEDUPE_FIRST = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1"""


def listings_semi(spark, sf_dir):
    reviewed = distinct_ids(reviews(spark, sf_dir), "listing_id").withColumnRenamed("listing_id", "id")
    return keep_members(listings(spark, sf_dir), reviewed, "id").select("id", "price_clean", "room_type")


LISTINGS_SEMI = f"""
WITH {SQL_REVIEWS},{SQL_LISTINGS}
SELECT id, price_clean, room_type FROM listings
WHERE id IN (SELECT listing_id FROM reviews)"""


def year_filter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter(in_year("o_orderdate", 1998))
    return orders.select("o_orderkey", "o_custkey", "o_orderdate")


YEAR_FILTER = """
SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE year(o_orderdate) = 1998"""


# The second word of a part name, as an amenity label.
_LABELS = {
    "ring": "Wifi", "gear": "HDTV with Netflix", "bolt": "Dishwasher", "rod": "Washer",
    "plate": "Free street parking", "anvil": "Paid parking off premises",
    "gizmo": "Central air conditioning", "widget": "Kitchen",
}


def _label_json(spark, sf_dir):
    """Part labels as JSON lists, some cut short or wrapped in an object, and
    the JSON objects of the events, which are no lists at all."""
    noun = F.substring_index("p_name", " ", -1)
    label = F.lit(None).cast("string")
    for word, text in _LABELS.items():
        label = F.when(noun == word, text).otherwise(label)
    as_list = F.to_json(F.array(label, F.col("p_name"), F.initcap("p_type")))
    parts = table(spark, sf_dir, "part").withColumn("j", as_list).select(
        F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("key"),
        F.when(F.col("p_type") == "PROMO", F.expr("substr(j, 1, length(j) - 2)"))
        .when(F.col("p_type") == "LARGE", F.concat(F.lit('{"k": '), F.col("j"), F.lit("}")))
        .otherwise(F.col("j"))
        .alias("amenities"),
    )
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("key"),
        F.col("props").alias("amenities"),
    )
    return parts.unionByName(events)


_SQL_LABELS = f"""
labels AS (
  SELECT p_partkey, p_type NOT IN ('PROMO', 'LARGE') AS listed,
         list_filter([CASE split_part(p_name, ' ', 2)
            {" ".join(f"WHEN '{w}' THEN '{t}'" for w, t in _LABELS.items())} END,
           p_name, p_type], lambda x: x IS NOT NULL) AS items
  FROM part)"""


def amenities(spark, sf_dir):
    raw = _label_json(spark, sf_dir)
    return raw.select("key", amenities_count(parse_amenities("amenities")).alias("amenities_count"))


AMENITIES = f"""
WITH {_SQL_LABELS}
SELECT 'part ' || p_partkey AS key, CAST(CASE WHEN listed THEN 3 ELSE 0 END AS INTEGER) AS amenities_count
FROM labels
UNION ALL
SELECT 'event ' || event_id, CAST(0 AS INTEGER) FROM events"""


def flagged_amenities(spark, sf_dir):
    raw = _label_json(spark, sf_dir).withColumn("labels", parse_amenities("amenities"))
    return raw.select("key", *amenity_flags("labels"))


_SQL_FLAGS = ",\n       ".join(
    f"CAST(listed AND len(list_filter(items, lambda x: regexp_matches(x, '(?i){p}'))) > 0 AS INTEGER) AS {name}"
    for name, p in AMENITY_PATTERNS.items()
)
AMENITY_FLAGS = f"""
WITH {_SQL_LABELS}
SELECT 'part ' || p_partkey AS key,
       {_SQL_FLAGS}
FROM labels
UNION ALL
SELECT 'event ' || event_id, {", ".join("CAST(0 AS INTEGER)" for _ in AMENITY_PATTERNS)} FROM events"""


def _listing_facts(spark, sf_dir):
    """All customers with their review facts; those without reviews have none."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("listing_id"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("price_clean"),
        "c_mktsegment",
        "c_nationkey",
    )
    return customers.join(facts(spark, sf_dir), "listing_id", "left")


_SQL_LISTING_FACTS = f"""{SQL_FACTS},
described AS (
  SELECT CAST(c_custkey AS VARCHAR) AS listing_id,
         CASE WHEN c_acctbal > 0 THEN c_acctbal END AS price_clean, c_mktsegment, c_nationkey,
         review_count, positive_rate, is_hidden
  FROM customer LEFT JOIN facts ON CAST(c_custkey AS VARCHAR) = facts.listing_id)"""

_FACT_COLUMNS = ("price_clean", "c_mktsegment", "review_count", "positive_rate", "is_hidden")


def missing(spark, sf_dir):
    rates = missing_rates(_listing_facts(spark, sf_dir), _FACT_COLUMNS)
    return rates.withColumn("pct_missing", F.round("pct_missing", 6))


MISSING_RATES = f"""
WITH {_SQL_LISTING_FACTS}
{" UNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS n_missing, "
    f"round(100.0::DOUBLE * count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) AS pct_missing FROM described"
    for c in _FACT_COLUMNS)}"""


def distinct_neigh(spark, sf_dir):
    return customers(spark, sf_dir).groupBy("room_type").agg(
        F.count("*").alias("n"), F.countDistinct("nation").alias("n_neighbourhoods")
    )


DISTINCT_NEIGH = f"""
WITH {SQL_CUSTOMERS}
SELECT room_type, count(*) AS n, count(DISTINCT nation) AS n_neighbourhoods
FROM customers GROUP BY room_type"""


def complete_rows(spark, sf_dir):
    kept = drop_missing(_listing_facts(spark, sf_dir), ("price_clean", "review_count"))
    return kept.select("listing_id", "price_clean", "review_count")


DROP_MISSING = f"""
WITH {_SQL_LISTING_FACTS}
SELECT listing_id, price_clean, review_count FROM described
WHERE price_clean IS NOT NULL AND review_count IS NOT NULL"""


def top_n_other(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return fold_top_n(parts, "p_name", 15)


TOP_N_OTHER = """
WITH top AS (
  SELECT p_name FROM part GROUP BY p_name ORDER BY count(*) DESC, p_name LIMIT 15)
SELECT p_partkey, CASE WHEN p_name IN (SELECT p_name FROM top) THEN p_name ELSE 'Other' END AS p_name
FROM part"""


def reviewed_flag(spark, sf_dir):
    ids = reviews(spark, sf_dir).withColumnRenamed("listing_id", "id")
    return member_flag(customers(spark, sf_dir).select("id", "room_type"), ids, "id", "is_reviewed")


MEMBER_FLAG = f"""
WITH {SQL_REVIEWS},{SQL_CUSTOMERS}
SELECT id, room_type, CAST(id IN (SELECT listing_id FROM reviews) AS INTEGER) AS is_reviewed
FROM customers"""

QUERIES = {
    "scan_clean_na": scan_clean_na,
    "scan_split": scan_split,
    "scan_rejects": scan_rejects,
    "valid_ids": valid_ids,
    "distinct_ids": distinct_id_set,
    "parse_price": parsed_prices,
    "bathrooms": bathrooms,
    "truthy_flags": truthy_flags,
    "tenure_years": tenure,
    "numeric_cast": numeric_cast,
    "price_filter": price_filter,
    "dedupe_first": first_orders,
    "listings_semi": listings_semi,
    "year_filter": year_filter,
    "amenities": amenities,
    "amenity_flags": flagged_amenities,
    "missing_rates": missing,
    "distinct_neigh": distinct_neigh,
    "drop_missing": complete_rows,
    "top_n_other": top_n_other,
    "member_flag": reviewed_flag,
}

ORACLES = {
    "scan_clean_na": SCAN_CLEAN_NA,
    "scan_split": SCAN_SPLIT,
    "scan_rejects": SCAN_REJECTS,
    "valid_ids": _SQL_CLEAN_IDS,
    "distinct_ids": f"SELECT DISTINCT listing_id FROM ({_SQL_CLEAN_IDS})",
    "parse_price": PARSE_PRICE,
    "bathrooms": BATHROOMS,
    "truthy_flags": TRUTHY_FLAGS,
    "tenure_years": TENURE,
    "numeric_cast": NUMERIC_CAST,
    "price_filter": PRICE_FILTER,
    "dedupe_first": DEDUPE_FIRST,
    "listings_semi": LISTINGS_SEMI,
    "year_filter": YEAR_FILTER,
    "amenities": AMENITIES,
    "amenity_flags": AMENITY_FLAGS,
    "missing_rates": MISSING_RATES,
    "distinct_neigh": DISTINCT_NEIGH,
    "drop_missing": DROP_MISSING,
    "top_n_other": TOP_N_OTHER,
    "member_flag": MEMBER_FLAG,
}
