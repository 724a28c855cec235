"""Session helpers: settings every operator relies on, and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BY_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
GUESSED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def configure(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings the operators assume (all are per-session SQL settings)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Stored timestamps are UTC wall-clock values; reading them as instants keeps comparisons with instants pushed down.
    spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    measured_only(spark)
    # Page and text stages are heavy on processors for their bytes: small inputs still spread over the cores.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    # Rows handed to Python at once: a batch of long pages stays within tens of megabytes.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    # Shuffle files go with the execution that wrote them, so that a chain of stored steps never holds more than one step's.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    # Joins are dealt by all their keys, until a query stores tables by page (``checkpointed_pages``).
    spark.conf.set(BY_ALL_KEYS, "true")
    return spark


def measured_only(spark: SparkSession) -> None:
    """Joins send to all tasks only what a shuffle has measured, not what a plan guesses.

    Compressed files and rows that an explode makes are guessed up to a hundred times too small, and the driver holds every table
    that is sent.
    """
    spark.conf.set(GUESSED, "-1")
    spark.conf.set(MEASURED, "1m")


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and streaming state, as named by ``spark.checkpoint.dir``.

    Without that setting only a session whose executors are threads of the driver gets a folder of its own; any other
    fails early, because a machine-local folder would not survive the loss of an executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is not None:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="feedlake-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage: write the rows to the shared folder and read them back.

    Parquet holds the repeated urls and positions in a fraction of the space of ``DataFrame.checkpoint``, and later steps read
    only the columns they use.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, "checkpoint")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed_pages(df: DataFrame, by: str = "page_id", dealt: bool = False) -> DataFrame:
    """As ``checkpointed``, with the rows of one page (or of one ``by``) in one bucket of ``spark.sql.shuffle.partitions``.

    Joins, windows and aggregates by page, whatever further keys they have, then read the buckets and shuffle nothing: a page is bounded,
    so is its share of a bucket. ``dealt`` says that tasks already hold whole buckets, as those that made pages out of such a
    table do; the rows are stored where they are.
    """
    spark = df.sparkSession
    spark.conf.set(BY_ALL_KEYS, "false")
    name = f"feedlake_{uuid.uuid4().hex}"
    rows = df if dealt else deal(df, by)
    rows.write.bucketBy(_buckets(spark), by).option("compression", "zstd").option("path", fresh_folder(spark, "checkpoint")).saveAsTable(name, format="parquet")
    return spark.table(name)


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def deal(df: DataFrame, by: str) -> DataFrame:
    """Rows in the buckets of ``checkpointed_pages``: one shuffle for all that follows by the same column."""
    return df.repartition(_buckets(df.sparkSession), by)


def discard(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    context = spark.sparkContext
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to all tasks, before much work is done for each: a small file or a single row group is read by one task,
    however many rows it holds."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
