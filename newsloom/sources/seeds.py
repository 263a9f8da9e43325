"""Seed lists: CSV files with a header and the columns identifier and URL, in this order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import schemas


def _reader(reader):
    return reader.schema(schemas.SEED).option("header", True).option("enforceSchema", True)


def read_seed(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Seed of one dataset as work items; columns count by position, not by name."""
    return as_work_items(_reader(spark.read).csv(path), F.lit(dataset))


def stream_seed(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Seed files dropped into ``folder/dataset=<name>/``, as a stream of work items."""
    reader = spark.readStream.schema(f"{schemas.SEED}, dataset STRING").option("header", True)
    seed = reader.option("maxFilesPerTrigger", files_per_batch).csv(folder)
    return as_work_items(seed, F.col("dataset"))


def parse_seed_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Seed rows from CSV lines held in a column."""
    row = F.from_csv(F.col(column), schemas.SEED)
    others = [c for c in lines.columns if c != column]
    return lines.select(*others, row.alias("_row")).select(
        *others, F.col("_row.id").alias("id"), F.col("_row.url").alias("url")
    )


def as_work_items(seed: DataFrame, dataset) -> DataFrame:
    return seed.select(dataset.alias("dataset"), F.col("id").alias("doc_id"), "url")
