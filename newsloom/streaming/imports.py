"""Importing seed files as they are dropped, each document once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom import schemas
from newsloom.operators.key_filter import KEY, SCHEMA, filter_of, maybe_known, merged
from newsloom.operators.ledger import new_documents
from newsloom.session import cut_lineage, path_exists
from newsloom.streaming.runs import batch_path, run_name


FILTERS = "_filters"


def import_seeds(
    seed: DataFrame, work_path: str, checkpoint: str, known: DataFrame | None = None
) -> StreamingQuery:
    """Append the new documents of a seed stream to the work table, and stop at the end.

    The file source's checkpoint remembers which files were imported.  Documents that are in
    the work table already (or in ``known``) are left out, so files may overlap.  Run and batch
    number are part of the path: a repeated batch replaces its own rows and is not compared with
    them, and another run into the same table is.

    Earlier rows are read only for keys that the Bloom filters beside the table do not rule out:
    a batch of new documents reads none. A batch adds its keys to the filters before it writes its
    rows, so the filters never lack a row; after a failure they may hold keys without one, which
    are then looked up in vain.
    """
    schema = f"{schemas.WORK_ITEM}, run STRING, batch BIGINT"
    run = run_name(seed.sparkSession, checkpoint)
    ensure_filters(seed.sparkSession, work_path)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["dataset", "doc_id"])
        if known is not None:
            fresh = new_documents(fresh, known)
        if path_exists(spark, work_path):
            fresh = cut_lineage(maybe_known(fresh, read_filters(spark, work_path, batch)))
            possible = fresh.where("maybe_known").select("dataset", "doc_id")
            if not possible.isEmpty():
                reader = spark.read.schema(schema).option("basePath", work_path)
                earlier = reader.parquet(work_path).where(
                    (F.col("run") != run) | (F.col("batch") < batch_id)
                )
                # Folders of other datasets are pruned at run time.
                touched = F.broadcast(possible.select("dataset").distinct())
                earlier = earlier.join(touched, "dataset", "left_semi")
                known_keys = possible.join(earlier.select("dataset", "doc_id"), KEY, "left_semi")
                fresh = new_documents(fresh, known_keys)
            fresh = fresh.drop("maybe_known")
        filters = batch_path(filter_path(work_path), run, batch_id)
        filter_of(fresh).write.mode("overwrite").partitionBy("dataset").parquet(filters)
        target = batch_path(work_path, run, batch_id)
        fresh.write.mode("overwrite").partitionBy("dataset").parquet(target)

    return (
        seed.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def filter_path(work_path: str) -> str:
    return f"{work_path.rstrip('/')}{FILTERS}"


def ensure_filters(spark: SparkSession, work_path: str) -> None:
    """Filters for a table that has none, as older imports left it: made of its keys, and put in
    place whole by a rename."""
    path = filter_path(work_path)
    if path_exists(spark, path) or not path_exists(spark, work_path):
        return
    staged = f"{path}-{uuid.uuid4().hex}"
    keys = spark.read.schema(schemas.WORK_ITEM).parquet(work_path)
    filter_of(keys).write.partitionBy("dataset").parquet(batch_path(staged, "0", 0))
    file_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    source = file_path(staged)
    files = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(source, file_path(path))


def read_filters(spark: SparkSession, work_path: str, batch: DataFrame) -> DataFrame:
    """The filters of the datasets a batch touches."""
    path = filter_path(work_path)
    rows = spark.read.schema(f"{SCHEMA}, run STRING, batch BIGINT").option("basePath", path).parquet(path)
    touched = F.broadcast(batch.select("dataset").distinct())
    return rows.join(touched, "dataset", "left_semi").select("dataset", "word", "bits")


def compact_filters(spark: SparkSession, work_path: str, target: str) -> None:
    """Merge the filters of all batches into one at ``target`` (a path like ``work_path``)."""
    path = filter_path(work_path)
    rows = spark.read.schema(f"{SCHEMA}, run STRING, batch BIGINT").option("basePath", path).parquet(path)
    out = batch_path(filter_path(target), "0", 0)
    merged(rows).write.mode("overwrite").partitionBy("dataset").parquet(out)
