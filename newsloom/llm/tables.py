"""Reading tables, shared storage and bucket pruning for the corpus operators."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import shared_folder

# Bound of a broadcast set of buckets: so many rows of eight bytes at most, whatever the input.
PRUNE_BUCKETS = 1 << 20


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the storage that every executor reaches."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(table: DataFrame, name: str) -> DataFrame:
    """Write a table to shared storage and read it back: computed once, and no lost executor
    can lose it."""
    spark = table.sparkSession
    path = new_folder(spark, name)
    table.write.parquet(path)
    out = spark.read.schema(table.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, and the shuffle files of plans that are
    done."""
    for table in tables:
        delete_folder(table.sparkSession, table.stored_at)
    if tables:
        forget_shuffles(tables[0].sparkSession)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done: it does so when the driver's
    garbage is collected, which a large heap puts off until disks are full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``new_folder`` named, through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PRUNE_BUCKETS)).cast("int")


def prune(table: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``table`` whose key may occur in ``wanted`` (same column name).

    Only hash buckets are broadcast, at most PRUNE_BUCKETS of them; a join on the key itself
    must follow. It saves moving texts nobody asked for, and loses nothing."""
    buckets = wanted.select(bucket_of(F.col(key)).alias("_bucket")).distinct()
    return (
        table.withColumn("_bucket", bucket_of(F.col(key)))
        .join(F.broadcast(buckets), "_bucket", "left_semi")
        .drop("_bucket")
    )


def without(table: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows of ``table`` whose key is not in ``gone``; rows without a key stay.

    Rows whose bucket holds no such key are passed on as they are; only the others are joined."""
    buckets = gone.select(bucket_of(F.col(key)).alias("_bucket")).distinct()
    # A row travels as one value, so that no name of its columns can clash.
    rows = table.select(
        F.struct("*").alias("row"), F.col(key).alias("_key"), bucket_of(F.col(key)).alias("_bucket")
    )
    clean = rows.join(F.broadcast(buckets), "_bucket", "left_anti")
    met = rows.join(F.broadcast(buckets), "_bucket", "left_semi").join(
        gone.select(F.col(key).alias("_key")), "_key", "left_anti"
    )
    return met.select("row.*").union(clean.select("row.*"))


def keyed(table: DataFrame) -> DataFrame:
    """(row, _key): every row with a 64-bit key of its own; rows equal in id and text share it.

    An id that occurs once is the key itself. Rows without an id, and all in a hash bucket with an
    id that occurs more than once, have a negative hash of id and text instead."""
    ids = table.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).count()
    repeated = ids.where("count > 1").select(bucket_of(F.col("_id")).alias("_bucket")).distinct()
    repeated = stored(repeated, "repeated-ids").withColumn("_hashed", F.lit(True))
    hashed = F.xxhash64("row.doc_id", "row.text").bitwiseOR(F.lit(-(1 << 63)))
    known = F.col("row.doc_id").isNotNull() & F.col("_hashed").isNull()
    return (
        table.select(F.struct("*").alias("row"), bucket_of(F.col("doc_id")).alias("_bucket"))
        .join(F.broadcast(repeated), "_bucket", "left")
        .select("row", F.when(known, F.col("row.doc_id").cast("bigint")).otherwise(hashed).alias("_key"))
    )


def one_row_each(rows: DataFrame) -> DataFrame:
    """One of the rows (row, _key) of each key; only keys that occur twice move their rows."""
    counts = rows.groupBy("_key").count().where("count > 1").select("_key")
    twice = stored(counts, "equal-rows")
    buckets = twice.select(bucket_of(F.col("_key")).alias("_bucket")).distinct()
    met = rows.withColumn("_bucket", bucket_of(F.col("_key")))
    alone = met.join(F.broadcast(buckets), "_bucket", "left_anti").select("row", "_key")
    equal = met.join(F.broadcast(buckets), "_bucket", "left_semi").select("row", "_key")
    return alone.union(equal.dropDuplicates(["_key"]))
