"""Multi-line CSV read in blocks, against the reader that takes whole files."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from valuescout.constants import NA_TOKENS
from valuescout.sources import csv as src, sinks
from valuescout.sources.split_csv import csv_records, scan_csv_split


@pytest.fixture
def blocks(spark):
    """Set the size of a block for one test."""
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(k) for k in keys]

    def of(size):
        for k in keys:
            spark.conf.set(k, str(size))

    yield of
    for k, v in zip(keys, old):
        spark.conf.set(k, v)


def write(path, rows, rng=None, end="\n", last=True):
    """Rows as CSV; cells are quoted where they must be, others by chance."""
    def cell(text):
        if any(c in text for c in '",\r\n') or (rng and rng.random() < 0.3):
            return '"' + text.replace('"', '""') + '"'
        return text

    body = end.join(",".join(map(cell, row)) for row in rows) + (end if last else "")
    path.write_bytes(body.encode())
    return str(path)


def same(spark, path, n_rows=None):
    ours, theirs = scan_csv_split(spark, path), src.scan_csv_text(spark, path)
    assert ours.columns == theirs.columns
    found = sorted(map(repr, map(tuple, ours.collect())))
    assert found == sorted(map(repr, map(tuple, theirs.collect())))
    assert n_rows is None or len(found) == n_rows


@pytest.mark.parametrize("size", [7, 64, 999, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_any_block_size(spark, blocks, tmp_path, size, end):
    rng = random.Random(size)
    parts = ["a", "é中", '"', '""', ",", "\n", "\n\n", "\r\n", " ", "x" * 40, "12", "NA", "don't", "😀"]
    rows = [["id", "text", "more, or \"less\"\nof it"]]
    for i in range(120):
        rows.append([str(i), "".join(rng.choices(parts, k=rng.randint(0, 9))), rng.choice(["", "nan", "y", "a\nb", '"q"'])])
    path = write(tmp_path / "a.csv", rows, rng, end, last=size != 64)
    blocks(size)
    with open(path, newline="", encoding="utf-8") as file:
        names, *cells = csv.reader(file)
    missing = set(NA_TOKENS)
    df = scan_csv_split(spark, path)
    assert df.columns == names and len(cells) == 120
    plain = [tuple(None if c in missing else c for c in row) for row in cells]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, plain))
    if end == "\n":  # the other reader keeps a carriage return in the last cell
        same(spark, path, 120)


def test_several_files_and_a_record_over_many_blocks(spark, blocks, tmp_path):
    rows = [["id", "text"], ["1", "short"], ["2", "\n".join(f'line "{i}", and more' for i in range(400))], ["3", "after\nthat"]]
    for name, extra in (("a.csv", []), ("b.csv", [["4", "only here"]]), ("c.csv", [["5", "x\n" * 300]])):
        write(tmp_path / name, rows + extra)
    blocks(200)
    same(spark, str(tmp_path), 11)


def test_plain_lines_and_no_rows(spark, blocks, tmp_path):
    blocks(64)
    same(spark, write(tmp_path / "p.csv", [["k", "v"]] + [[str(i), f"v{i}"] for i in range(500)]), 500)
    same(spark, write(tmp_path / "h.csv", [["k", "v"]]), 0)


def test_pruned_columns_and_short_rows(spark, blocks, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('a,b,c\n1,"x\ny"\n2,p,q\n\n3,NA,"z"\n')
    blocks(5)
    got = {r["a"]: r["b"] for r in scan_csv_split(spark, str(path), ["a", "b"]).collect()}
    assert got == {"1": "x\ny", "2": "p", "3": None}
    same(spark, str(path))


def test_broken_bytes(spark, blocks, tmp_path):
    (tmp_path / "b.csv").write_bytes(b'id,name\n1,"caf\xff\n"\n2,ok\n')
    blocks(6)
    got = {r["id"]: r["name"] for r in scan_csv_split(spark, str(tmp_path / "b.csv")).collect()}
    assert got["2"] == "ok" and got["1"].startswith("caf") and len(got) == 2


def test_a_quote_that_is_never_closed(spark, blocks, tmp_path):
    (tmp_path / "q.csv").write_text('id,name\n1,ok\n2,"open\n3,swallowed\n')
    blocks(9)
    got = [r["id"] for r in scan_csv_split(spark, str(tmp_path / "q.csv")).collect()]
    assert got[:1] == ["1"] and "3" not in got


def test_one_file_is_read_by_many_tasks(spark, blocks, tmp_path):
    """A single file of some MB; no task sees more than a block and a record."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").cast("string"), "text")
    sinks.write_csv(docs.coalesce(1), str(tmp_path / "docs"))
    blocks(128 << 10)
    files = spark.read.text(str(tmp_path / "docs"))
    records = csv_records(spark, str(tmp_path / "docs"))
    assert len(files.inputFiles()) == 1 and files.rdd.getNumPartitions() >= 12
    assert records.filter("_head").count() == 1
    within = records.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(within) >= 12 and max(r["count"] for r in within) < docs.count() / 4
    found = scan_csv_split(spark, str(tmp_path / "docs")).filter("doc_id is not null")
    plain = src.clean_na(docs)
    assert found.exceptAll(plain).count() == plain.exceptAll(found).count() == 0
