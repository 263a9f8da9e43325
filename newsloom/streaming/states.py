"""Current flags of documents over a stream of log rows."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom import schemas
from newsloom.operators.state import KEY, current_flags
from newsloom.streaming.runs import batch_path, run_name


ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # Commit what changed instead of the whole store.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the time of a block; a stream keeps those it was started with."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def stream_status(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New files of a status log, as a stream."""
    reader = spark.readStream.schema(schemas.STATUS_LOG)
    return reader.option("maxFilesPerTrigger", files_per_batch).parquet(path)


def follow_flags(
    log: DataFrame, out: str, checkpoint: str, partitions: int | None = None
) -> StreamingQuery:
    """Keep the flags of every document up to date.

    The aggregation state of the stream holds one small row per document, on disk rather
    than in memory because documents are many.  ``partitions`` is the number of state
    partitions (default: ``spark.sql.shuffle.partitions``); the first start fixes it.  Each
    batch writes the documents it changed to a folder of its run and number, and
    ``read_flags`` takes the newest.
    """
    run = run_name(log.sparkSession, checkpoint)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_path(out, run, batch_id))

    wanted = dict(ON_DISK)
    if partitions is not None:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    with settings(log.sparkSession, wanted):
        return (
            current_flags(log)
            .writeStream.outputMode("update")
            .foreachBatch(write_batch)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def read_flags(spark: SparkSession, out: str) -> DataFrame:
    """The flags written last for each document, by run and batch."""
    flags = ["is_empty", "is_retrieved", "parsed", "should_rescrape"]
    written = spark.read.option("basePath", out).parquet(out)
    newest = F.max(F.struct("run", "batch", *flags)).alias("_newest")
    return written.groupBy(*KEY).agg(newest).select(
        *KEY, *[F.col("_newest")[flag].alias(flag) for flag in flags]
    )


def compact_flags(spark: SparkSession, out: str, target: str) -> None:
    """Write the newest flags of each document as one run at ``target``, which ``read_flags``
    reads in place of the whole history; later runs may go on writing there."""
    newest = read_flags(spark, out)
    newest.write.mode("overwrite").parquet(batch_path(target, "0", 0))
