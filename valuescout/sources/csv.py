"""CSV readers: text, typed and tolerant."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from valuescout.constants import NA_TOKENS
from valuescout.functions.values import null_if_na

REJECT = "_rejected_line"


def clean_na(df: DataFrame, columns=None, tokens=NA_TOKENS) -> DataFrame:
    """Missing-value spellings become NULL in the text columns."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    chosen = text if columns is None else text & set(columns)
    return df.select(
        *[null_if_na(F.col(c), tokens).alias(c) if c in chosen else F.col(c) for c in df.columns]
    )


def _reader(spark, multiline, charset="UTF-8"):
    return (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("encoding", charset)
        .option("escape", '"')
        .option("multiLine", multiline)
    )


def scan_csv_text(spark: SparkSession, path, columns=None, multiline=True) -> DataFrame:
    """Every cell as text, missing-value tokens as NULL.

    Quoted line breaks need `multiline`, which reads one file per task: give
    big exports as many files, or turn it off where no cell breaks a line.
    Cells are only parsed for the `columns` asked for.
    """
    df = _reader(spark, multiline).option("inferSchema", False).csv(path)
    if columns is not None:
        df = df.select(*columns)
    return clean_na(df)


def scan_csv_typed(spark, path, schema: T.StructType, multiline=True) -> DataFrame:
    """Columns picked by name and cast to `schema`; a bad cell becomes NULL."""
    df = scan_csv_text(spark, path, schema.fieldNames(), multiline)
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def scan_csv_tolerant(spark, path, schema: T.StructType, multiline=True, keep_rejects=False):
    """Lines that do not fit `schema` are skipped, or kept in `_rejected_line`."""
    reader = _reader(spark, multiline).option("enforceSchema", True)
    if not keep_rejects:
        return clean_na(reader.schema(schema).option("mode", "DROPMALFORMED").csv(path))
    wide = T.StructType([*schema.fields, T.StructField(REJECT, T.StringType())])
    reader = reader.schema(wide).option("mode", "PERMISSIVE")
    df = reader.option("columnNameOfCorruptRecord", REJECT).csv(path)
    return clean_na(df, schema.fieldNames())


def parse_lines(df: DataFrame, line, schema: T.StructType, out="row") -> DataFrame:
    """Lines already in a column: `out` is the parsed struct, with the whole
    line in `_rejected_line` where it does not fit."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = F.from_csv(
        F.col(line),
        f"{ddl}, `{REJECT}` string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECT, "escape": '"'},
    )
    return df.withColumn(out, parsed)


def with_file_order(df: DataFrame, name="_file_order") -> DataFrame:
    """Where a scanned row stood in its input: file, block, place in block.

    Call it directly on a scan. The running id alone does not follow file
    order, since Spark packs the biggest blocks first; within one block it does.
    """
    return df.withColumn(
        name,
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ),
    )
