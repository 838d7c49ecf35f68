"""Writers; Parquet is the hand-off between stages, CSV the export."""

from pyspark.sql import DataFrame, functions as F, types as T


def write_table(df: DataFrame, path, mode="overwrite", partition_by=()):
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def _flat(df):
    """Nested cells as JSON text: CSV has no maps, lists or structs."""
    nested = (T.MapType, T.ArrayType, T.StructType)
    return df.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def write_csv(df: DataFrame, path, mode="overwrite", quote_all=True):
    """Header, UTF-8, doubled quotes; one file per partition."""
    (
        _flat(df).write.mode(mode)
        .option("header", True)
        .option("quoteAll", quote_all)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def append_table(df: DataFrame, path):
    write_table(df, path, mode="append")


def save_model(model, path):
    model.write().overwrite().save(path)
