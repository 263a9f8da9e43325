"""Archive-index answers stored as text files, as a table and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom import schemas
from newsloom.operators.captures import parse_index_lines
from newsloom.session import short_listings
from newsloom.sources.text_files import NO_VALUE
from newsloom.streaming.runs import batch_path, run_name, write_rows

LINES = "value STRING"


def _plain(text: Column) -> Column:
    """A text without its %XX."""
    decoded = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    return F.when(text.contains("%"), F.coalesce(decoded, text)).otherwise(text)


def _folder_key(key: str) -> Column:
    """The value that the folders of a line's file name for a key; null if none does."""
    # The path is a URI, and in it values are escaped once more.
    value = _plain(F.regexp_extract(_plain(F.col("_metadata.file_path")), f"^.*/{key}=([^/]*)/", 1))
    return F.when(~value.isin("", NO_VALUE), value)


def _captures(lines: DataFrame) -> DataFrame:
    return parse_index_lines(
        lines.select(F.col("dataset").cast("string"), F.col("doc_id").cast("int"), "value")
    )


def read_index_files(spark: SparkSession, folder: str) -> DataFrame:
    """Captures from files ``folder/dataset=<name>/doc_id=<id>/...``, one capture a line."""
    return _captures(spark.read.text(folder))


def stream_index_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Captures of new index files, as a stream; files are cut into splits like any text.

    Keys are taken from each file's path: Spark's own search for them compares all folders in the
    driver, in time that grows with the square of their number.
    """
    short_listings(spark)
    lines = (
        spark.readStream.format("text")
        .schema(LINES)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("maxCachedFiles", 10 * files_per_batch)
        .load(folder)
    )
    return _captures(
        lines.select("value", _folder_key("dataset").alias("dataset"), _folder_key("doc_id").alias("doc_id"))
    )


def drain_index(captures: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the captures of a stream of index files to the capture table, batch by batch, and
    stop at its end. A repeated batch replaces itself."""
    run = run_name(captures.sparkSession, checkpoint)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        write_rows(batch, batch_path(out, run, batch_id))

    return (
        captures.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_drained_captures(spark: SparkSession, out: str) -> DataFrame:
    """The capture table that ``drain_index`` writes."""
    columns = [name for name in spark.createDataFrame([], schemas.ARCHIVE_CAPTURE).columns]
    return spark.read.option("basePath", out).parquet(out).select(
        *[F.col(name).cast("int") if name == "doc_id" else F.col(name).cast("string") for name in columns]
    )
