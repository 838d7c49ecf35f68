"""CSV with line breaks inside cells, read by many tasks per file.

A reader that allows line breaks in quoted cells reads a file from its first
byte, in one task. Here files are read as lines, in blocks as usual, and quotes
tell how lines make up records: a line begins a record if the number of quotes
before it in its file is even. One pass adds up the quotes of each block; a
prefix sum over blocks tells which ones begin inside a record. Lines of records
that lie within a block are put together where they are read; only the few
records that cross a border are shuffled and stitched.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from valuescout.sources.csv import _reader, clean_na

_BLOCK = ["_file", "_block"]
_PLACE = ["_file", "_block", "_at", "_head"]


def _lines(spark, path) -> DataFrame:
    """(_file, _block, _at, _line, _odd): lines in the order of `_at` within
    their block, and whether they have an odd number of quotes."""
    text = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("_line") - F.length(F.replace("_line", F.lit('"')))
    return text.select(
        F.xxhash64("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        F.col("value").alias("_line"),
    ).withColumn("_odd", quotes % 2 == 1)


def _blocks(lines: DataFrame) -> DataFrame:
    """One row per block: whether it begins and ends inside a record, the
    places that close the first and open the last one of these, and the block
    in which the record that reaches in was begun."""
    odd = F.when(F.col("_odd"), F.col("_at"))
    counted = lines.groupBy(*_BLOCK).agg(
        F.min("_at").alias("_first"),
        F.min(odd).alias("_close"),
        F.max(odd).alias("_open"),
        F.count_if("_odd").alias("_n"),
    )
    order = Window.partitionBy("_file").orderBy("_block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    quotes = F.coalesce(F.sum("_n").over(before), F.lit(0))
    begun = F.last(F.when(F.col("_n") > 0, F.col("_block")), ignorenulls=True).over(before)
    return counted.select(
        *_BLOCK,
        "_first",
        "_close",
        "_open",
        (quotes % 2 == 1).alias("_inside"),
        ((quotes + F.col("_n")) % 2 == 1).alias("_ends_inside"),
        begun.alias("_begun"),
    )


def _records(batches):
    """Records from lines that begin and end outside of one; each has the
    place of its first line."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = (pa.concat_tables([rest, table]) if rest is not None else table).combine_chunks()
        inside = np.cumsum(pc.count_substring(table["_line"], '"').to_numpy() & 1) & 1
        if not len(inside):
            continue
        edge = np.flatnonzero(np.append(0, inside[:-1]) == 0)
        stop = len(inside) if inside[-1] == 0 else edge[-1]
        rest = table.slice(stop)
        yield from _joined(table.slice(0, stop), edge[edge < stop])
    if rest is not None and rest.num_rows:
        yield from _joined(rest, np.zeros(1, np.int64))


def _joined(table, starts):
    """One row per start: its lines up to the next start as one text."""
    if not len(starts):
        return
    lines = table["_line"].combine_chunks()
    lines = lines.chunk(0) if isinstance(lines, pa.ChunkedArray) else lines
    offsets = pa.array(np.append(starts, len(lines)).astype(np.int32))
    text = pc.binary_join(pa.ListArray.from_arrays(offsets, lines), pa.scalar(b"\n", pa.binary()))
    first = table.select(_PLACE).take(pa.array(starts)).combine_chunks()
    yield pa.RecordBatch.from_arrays([text, *(first[c].combine_chunks() for c in _PLACE)], ["_record", *_PLACE])


def csv_records(spark: SparkSession, path) -> DataFrame:
    """(_record, _file, _block, _at, _head): the text of each record of all
    files and where it begins; the first one of each file is its head. Blank
    lines are no records."""
    lines = _lines(spark, path)
    # one row of a few numbers per block of input
    placed = lines.join(F.broadcast(_blocks(lines)), _BLOCK)
    reaches_in = F.col("_inside") & (F.col("_close").isNull() | (F.col("_at") <= F.col("_close")))
    reaches_out = F.col("_ends_inside") & (F.col("_at") >= F.col("_open"))
    head = (F.col("_block") == 0) & (F.col("_at") == F.col("_first"))
    line = F.col("_line").cast("binary").alias("_line")

    within = placed.filter(~F.coalesce(reaches_in, F.lit(False)) & ~F.coalesce(reaches_out, F.lit(False)))
    within = within.select(line, "_file", "_block", "_at", head.alias("_head"))
    within = within.mapInArrow(_records, "_record binary, _file long, _block long, _at long, _head boolean")

    torn = placed.select(
        "_file",
        F.when(reaches_in, F.col("_begun")).when(reaches_out, F.col("_block")).alias("_owner"),
        F.struct("_block", "_at", line, head.alias("_head")).alias("_part"),
    ).filter(F.col("_owner").isNotNull())
    torn = torn.groupBy("_file", "_owner").agg(F.array_sort(F.collect_list("_part")).alias("_parts"))
    texts = F.transform("_parts", lambda p: p["_line"].cast("string"))
    first = F.col("_parts")[0]
    torn = torn.select(F.array_join(texts, "\n").cast("binary").alias("_record"), "_file", *[first[c].alias(c) for c in _PLACE[1:]])

    record = F.regexp_replace(F.col("_record").cast("string"), r"\r\z", "")
    both = within.union(torn).select(record.alias("_record"), *_PLACE)
    return both.filter(F.col("_record") != "")


def scan_csv_split(spark: SparkSession, path, columns=None, order=None) -> DataFrame:
    """`scan_csv_text` for big files with line breaks in quoted cells.

    Every cell as text, missing-value tokens as NULL, files split among tasks
    at any place. Cells that hold a quote must be quoted, with the quote
    doubled, as all writers of such files do: a lone quote inside an unquoted
    cell would be taken for the beginning of a quoted one. All files have the
    same columns in the same order. The lines are read three times, once each
    to count quotes, for the records within blocks, and for those across.

    `order` names a further column that sorts the rows of a file as they stand
    in it (see `with_file_order`).
    """
    names = _reader(spark, True).option("inferSchema", False).csv(path).columns
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    rows = csv_records(spark, path).filter(~F.col("_head"))
    cells = F.from_csv("_record", schema, {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"})
    place = [F.struct(F.col("_file").alias("file"), F.col("_block").alias("block"), F.col("_at").alias("row")).alias("_place")]
    df = rows.select(cells.alias("_cells"), *place)
    chosen = [F.col(f"_cells.`{c}`").alias(c) for c in (names if columns is None else columns)]
    ordered = [F.col("_place").alias(order)] if order else []
    return clean_na(df.select(*chosen, *ordered))
