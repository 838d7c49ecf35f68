from pyspark.sql import functions as F, types as T

from valuescout.operators.rows import dedupe_first
from valuescout.sources import csv as src, schemas, sinks


def _write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding) if isinstance(text, str) else text)
    return str(path)


def test_text_scan(spark, tmp_path):
    path = _write(tmp_path / "a.csv", 'id,name,price\n9007199254740993,"Two\nlines, ""quoted""",NA\n2,nan,"$1,200.00"\n')
    df = src.scan_csv_text(spark, path)
    assert [f.dataType for f in df.schema.fields] == [T.StringType()] * 3
    got = {r["id"]: (r["name"], r["price"]) for r in df.collect()}
    assert got == {"9007199254740993": ('Two\nlines, "quoted"', None), "2": (None, "$1,200.00")}
    one = src.scan_csv_text(spark, path, ["id"])
    assert one.columns == ["id"] and sorted(r["id"] for r in one.collect()) == ["2", "9007199254740993"]


def test_typed_scan(spark, tmp_path):
    path = _write(tmp_path / "p.csv", "listing_id,extra,positive_rate\n1396931645129879378,x,0.5\n3,y,oops\n")
    got = src.scan_csv_typed(spark, path, schemas.POSITIVE_RATE).collect()
    assert sorted((r["listing_id"], r["positive_rate"]) for r in got) == [("1396931645129879378", 0.5), ("3", None)]


def test_tolerant_scan(spark, tmp_path):
    path = _write(tmp_path / "t.csv", "k,v\n1,2.5\nbad line\n3,x\n4,NA\n")
    schema = T.StructType.fromDDL("k string, v double")
    kept = src.scan_csv_tolerant(spark, path, schema, multiline=False)
    assert [r["k"] for r in kept.collect()] == ["1"]
    every = src.scan_csv_tolerant(spark, path, schema, multiline=False, keep_rejects=True).cache()
    assert every.count() == 4
    assert every.filter(F.col(src.REJECT).isNotNull()).count() == 3


def test_broken_bytes_do_not_stop_the_scan(spark, tmp_path):
    path = _write(tmp_path / "b.csv", b"id,name\n1,caf\xff\n2,ok\n")
    got = {r["id"]: r["name"] for r in src.scan_csv_text(spark, path).collect()}
    assert got["2"] == "ok" and got["1"].startswith("caf")


def test_first_row_of_the_file_wins(spark, tmp_path):
    lines = "".join(f"{i % 50},{i}\n" for i in range(5000))
    path = _write(tmp_path / "d.csv", "id,v\n" + lines)
    raw = spark.read.option("header", True).csv(path)
    out = dedupe_first(src.with_file_order(raw), "id", "_file_order")
    assert {r["id"]: r["v"] for r in out.collect()} == {str(i): str(i) for i in range(50)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "b",\nc', {"x": 1.5})], "id string, t string, m map<string,double>")
    sinks.write_csv(df, str(tmp_path / "csv"))
    back = src.scan_csv_text(spark, str(tmp_path / "csv")).first()
    assert (back["id"], back["t"], back["m"]) == ("1", 'a "b",\nc', '{"x":1.5}')
    sinks.write_table(df, str(tmp_path / "t"))
    sinks.append_table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    sinks.write_table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
