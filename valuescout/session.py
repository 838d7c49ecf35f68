"""Session helpers: lineage cuts go to the shared folder the cluster names."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app="valuescout", cpus="*", memory="8g"):
    """A local session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _ensure_checkpoint_dir(spark):
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
        folder = tempfile.mkdtemp(prefix="valuescout-checkpoint-")
    sc.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` once to reliable storage and go on from there (an action).

    Used where several jobs read one expensive result: a lost executor then
    costs a re-read of the files, not a re-run of everything upstream.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written_table(df: DataFrame) -> DataFrame:
    """Write `df` as a compressed columnar table beside the checkpoints (an action).

    For results that are read several times and are too big for a checkpoint,
    which is not compressed and is read with all its columns.
    """
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def scratch_folder(spark) -> str:
    """A new name beside the checkpoints, which all executors share."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"


# Files are written with row groups of about this size, and only a whole row
# group can be read by a task of its own.
ROW_GROUP_BYTES = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly work on a scan with few row groups.

    A table of a few files or row groups is read by a few tasks, and whatever
    follows without a shuffle stays in them. Where there is at least one for
    each core, as in any big table, the scan is left as it is. Meant for plain
    scans: files and bytes come from their listing, no job runs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if max(files, size // ROW_GROUP_BYTES) < cores else df
