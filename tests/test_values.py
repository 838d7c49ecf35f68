import math

from pyspark.sql import functions as F

from valuescout.functions.amenities import amenities_count, amenity_flags, parse_amenities
from valuescout.functions.ids import hash_bucket, in_test_set, valid_id
from valuescout.functions.values import (
    in_year, log_price, null_if_na, parse_bathrooms, parse_price, tenure_years, to_date,
    to_number, truthy,
)


def test_parse_price(rows):
    cases = {
        "$1,234.00": 1234.0, "€85": 85.0, " 90 ": 90.0, "1 200": 1200.0, "$0.00": 0.0,
        "-5": -5.0, "": None, "N/A": None, "abc": None, "1d": None, "1e3": 1000.0, ".5": 0.5,
        "inf": None, "nan": None, "\t7\n": 7.0, "1.2.3": None, None: None,
    }
    assert rows(list(cases), "t string", parse_price("t")) == list(cases.values())


def test_parse_bathrooms(rows):
    cases = [
        (("1.0", "1 bath"), 1.0), ((None, "1.5 baths"), 1.5), ((None, "Half-bath"), 0.5),
        ((None, "Shared half-bath"), 0.5), ((None, "2 shared baths"), 2.0),
        ((None, "0 baths"), 0.0), ((None, "Private"), None), ((None, None), None),
        (("x", " 3 baths"), 3.0),
    ]
    got = rows([c for c, _ in cases], "n string, t string", parse_bathrooms("n", "t"))
    assert got == [want for _, want in cases]


def test_truthy(rows):
    values = ["t", " TRUE ", "yes", "1", "f", "", None, "no", "0"]
    assert rows(values, "t string", truthy("t")) == [1, 1, 1, 1, 0, 0, 0, 0, 0]


def test_valid_id(rows):
    cases = {
        " 123 ": "123", "123.0": "123", "1396931645129879378": "1396931645129879378",
        "9007199254740993": "9007199254740993", "12a": None, "": None, None: None, "1.5": None,
    }
    assert rows(list(cases), "t string", valid_id("t")) == list(cases.values())


def test_na_tokens(rows):
    values = ["NA", "N/A", "null", "None", "nan", "", "x", " NA", None]
    assert rows(values, "t string", null_if_na("t")) == [None] * 6 + ["x", " NA", None]


def test_log_price(rows):
    got = rows([math.e, 0.0, -1.0, None], "p double", log_price("p"))
    assert math.isclose(got[0], 1.0) and got[1:] == [None] * 3


def test_dates(rows):
    got = rows([("2024-09-15", "2025-09-15"), ("x", "2025-09-15"), (None, None)],
               "a string, b string", tenure_years("a", "b"))
    assert got == [365 / 365.25, None, None]
    assert rows(["2025-13-01", "2025-02-03"], "d string", to_date("d").cast("string")) == [None, "2025-02-03"]
    inside = in_year(to_date("d"), 2025)
    assert rows(["2024-12-31", "2025-01-01", "2025-12-31", "2026-01-01"], "d string", inside) == [
        False, True, True, False]


def test_to_number(rows):
    assert rows(["1_0", "1e400x", " 5 ", "+2.", None], "t string", to_number("t")) == [None, None, 5.0, 2.0, None]


def test_amenities(spark):
    cases = [
        ('["Wifi","HDTV with Netflix","Dishwasher"]', 3, {"has_wifi", "has_tv", "has_dishwasher"}),
        ('["Free street parking","Washer"]', 2, {"has_free_parking", "has_washer"}),
        ('["Paid parking off premises"]', 1, set()),
        ('["Wifi","Wifi"]', 2, {"has_wifi"}),
        ('["Free","parking"]', 2, set()),
        ('["Pool TV","Elevator","AIR CONDITIONING","Kitchenette"]', 4,
         {"has_tv", "has_elevator", "has_air_conditioning", "has_kitchen"}),
        ('{"k": 69}', 0, set()), ("not json", 0, set()), ('["a"', 0, set()), (None, 0, set()), ("[]", 0, set()),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, a string")
    df = df.withColumn("l", parse_amenities("a"))
    for row in df.select("i", amenities_count("l").alias("n"), *amenity_flags("l")).collect():
        _, n, flags = cases[row["i"]]
        assert row["n"] == n
        assert {f for f in row.asDict() if f.startswith("has_") and row[f] == 1} == flags


def test_split_is_stable(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("id"))
    one = df.select(F.sum(in_test_set("id")).alias("n")).first()["n"]
    two = df.repartition(17).select(F.sum(in_test_set("id")).alias("n")).first()["n"]
    assert one == two and 15700 < one < 16300
    assert df.select(hash_bucket("id", 42, 5).alias("b")).distinct().count() == 5
