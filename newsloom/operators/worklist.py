"""What is to be done: pending documents, parse-ready documents, chunks, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom.operators.lookup import fits_broadcast
from newsloom.operators.ranking import integer_block, row_numbers


def is_pending() -> Column:
    """Flags of a document that still has to be fetched."""
    return ~F.col("is_empty") & ~F.col("is_retrieved") & ~F.col("should_rescrape")


def is_parse_ready() -> Column:
    """Flags of a document that was fetched and has to be parsed."""
    return (
        ~F.col("is_empty")
        & F.col("is_retrieved")
        & ~F.col("parsed")
        & ~F.col("should_rescrape")
    )


def pending(work: DataFrame, dataset: str | None = None) -> DataFrame:
    """Keys and URLs still to be fetched, of one dataset or of all."""
    chosen = work if dataset is None else work.where(F.col("dataset") == dataset)
    return chosen.where(is_pending()).select("dataset", "doc_id", "url")


def parse_ready(work: DataFrame, dataset: str | None = None) -> DataFrame:
    """Keys and URLs still to be parsed; payloads are joined later, by key."""
    chosen = work if dataset is None else work.where(F.col("dataset") == dataset)
    return chosen.where(is_parse_ready()).select("dataset", "doc_id", "url")


def newest_parse_ready(work: DataFrame, dataset: str, limit: int = fv.PARSE_BATCH) -> DataFrame:
    """The next batch to parse: the highest identifiers of a dataset."""
    return parse_ready(work, dataset).orderBy(F.desc("doc_id")).limit(limit)


def with_payload(worklist: DataFrame, payload: DataFrame) -> DataFrame:
    """Fetch the payloads of a worklist with one join instead of one lookup per row.

    A worklist that was measured to be small is sent to the payloads, which then stay where
    they are; only a large one makes both sides move.  Documents without a payload come with
    NULL views, so that the parse job sees them; only keys are compared to find them.
    """
    key = ["dataset", "doc_id"]
    blobs = payload.select(*key, "raw", "reader")
    wanted = F.broadcast(worklist) if fits_broadcast(worklist) else worklist
    missing = worklist.join(payload.select(*key), key, "left_anti").withColumns(
        {view: F.lit(None).cast("binary") for view in ("raw", "reader")}
    )
    return blobs.join(wanted, key).unionByName(missing)


def shuffle_key(seed: int) -> Column:
    """Repeatable random order: 32 bits of a digest of seed and key, as INT."""
    digest = F.md5(
        F.concat_ws(":", F.lit(seed), F.col("dataset"), F.col("doc_id")).cast("binary")
    )
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") - F.lit(1 << 31)).cast("int")


def shuffled(worklist: DataFrame, seed: int) -> DataFrame:
    """Worklist in a seeded random order (a total sort; use ``chunks`` to only group)."""
    return worklist.orderBy(shuffle_key(seed), "dataset", "doc_id")


def chunks(worklist: DataFrame, size: int = fv.CHUNK_SIZE, seed: int | None = None) -> DataFrame:
    """Add ``chunk_no``: consecutive slices of ``size`` documents per dataset, from 0.

    The slices follow ``doc_id``, or a seeded random order if a seed is given.
    """
    key = F.col("doc_id") if seed is None else shuffle_key(seed)
    keyed = worklist.withColumn("_key", key.cast("int"))
    numbered = row_numbers(
        keyed, ["dataset"], ["_key", "doc_id"], integer_block(F.col("_key")), "_row_no"
    )
    return numbered.withColumn("chunk_no", F.floor((F.col("_row_no") - 1) / F.lit(size))).drop(
        "_key", "_row_no"
    )
