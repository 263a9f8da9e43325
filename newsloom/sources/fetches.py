"""Fetch results as a table in buckets of the document, so that choosing and fetching contents
does not move their bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 200


def save_fetches(results: DataFrame, name: str, buckets: int = BUCKETS) -> DataFrame:
    """Store fetch results as table ``name`` of the catalog and return it. Rows are dealt by
    bucket first, so that each bucket is one file."""
    keys = ["dataset", "doc_id"]
    dealt = results.repartition(buckets, *keys)
    dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).saveAsTable(name)
    return results.sparkSession.table(name)


def load_fetches(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
