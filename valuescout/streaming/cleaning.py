"""Incremental cleaning: new export files in, cleaned rows and ids appended."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from valuescout.functions.ids import valid_id
from valuescout.plans.reviews import clean_reviews
from valuescout.sources.csv import clean_na

_POLL_SECONDS = 0.05


def review_stream(spark: SparkSession, folder, schema, files_per_batch=100, multiline=True) -> DataFrame:
    """CSV files as they arrive; each batch takes a bounded number of files.

    Files whose cells break no line may be split with `multiline=False`; big
    ones with such cells are read once and for all by `scan_csv_split`.
    """
    raw = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("multiLine", multiline)
        .option("escape", '"')
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(folder)
    )
    return clean_na(raw)


def clean_stream(raw: DataFrame, year) -> DataFrame:
    """The batch cleaning step, with rows in and rows kept observed per batch."""
    counted = raw.observe("rows_in", F.count(F.lit(1)).alias("n"))
    return clean_reviews(counted, year).observe("rows_kept", F.count(F.lit(1)).alias("n"))


# The ids seen so far live on the executors' disks, at most so much of them in
# memory; a commit uploads what has changed to the checkpoint folder.
_STATE = "spark.sql.streaming.stateStore"
STATE_MEMORY_MB = 512
STATE_SETTINGS = {
    f"{_STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STATE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STATE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STATE}.rocksdb.maxMemoryUsageMB": str(STATE_MEMORY_MB),
}


def keep_state_on_disk(spark: SparkSession):
    """Streams that are started from now on keep their state so."""
    for name, value in STATE_SETTINGS.items():
        spark.conf.set(name, value)


def distinct_id_stream(cleaned: DataFrame, key="listing_id") -> DataFrame:
    """Every valid id the first time it is seen. The state is one short string
    per id, partitioned by id and kept on disk."""
    keep_state_on_disk(cleaned.sparkSession)
    ids = cleaned.select(valid_id(key).alias(key)).filter(F.col(key).isNotNull())
    return ids.dropDuplicates([key])


def append_available(df: DataFrame, out, checkpoint) -> dict:
    """Process what has arrived, append it to Parquet, then stop.

    The file sink and its checkpoint make each batch appear once, also after a
    restart. Returns the observed counts, summed over the batches of this run.
    They are added up while the query runs, as Spark keeps the last progress
    records only; a batch that was missed is an error, not a smaller count.
    """
    query = (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    totals, last = {}, None

    def add_up():
        nonlocal last
        for progress in query.recentProgress:
            if last is not None and progress.batchId <= last:
                continue
            if last is not None and progress.batchId > last + 1:
                raise RuntimeError(f"no counts of the batches after {last}")
            for name, row in progress.observedMetrics.items():
                totals[name] = totals.get(name, 0) + (row["n"] or 0)
            last = progress.batchId

    while not query.awaitTermination(_POLL_SECONDS):
        add_up()
    add_up()
    return totals
