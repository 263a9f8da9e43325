"""State of documents, from an append-only log.

Nothing is updated in place: every transition is a row, and the current flags are an
aggregate over the log that is reduced on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fv

KEY = ["dataset", "doc_id"]
FETCH_STATES = [fv.PENDING, fv.RETRIEVED, fv.FAILED]
STATES = [fv.PENDING, fv.RETRIEVED, fv.FAILED, fv.RESCRAPE, fv.PARSED]


def flag_aggregates() -> list[Column]:
    """The four flags of a document.

    Fetch states overwrite each other, so the last one counts; ``parsed`` and
    ``should_rescrape`` stay set once written.  Time ties are broken by ``seq``.
    """
    fetched = F.col("state").isin(FETCH_STATES)
    moment = F.struct("event_time", "seq", "state")
    last = F.max(F.when(fetched, moment))["state"]
    return [
        F.coalesce(last == fv.FAILED, F.lit(False)).alias("is_empty"),
        F.coalesce(last.isin(fv.RETRIEVED, fv.FAILED), F.lit(False)).alias("is_retrieved"),
        F.coalesce(F.bool_or(F.col("state") == fv.PARSED), F.lit(False)).alias("parsed"),
        F.coalesce(F.bool_or(F.col("state") == fv.RESCRAPE), F.lit(False)).alias(
            "should_rescrape"
        ),
    ]


def current_flags(log: DataFrame) -> DataFrame:
    return log.groupBy(*KEY).agg(*flag_aggregates())


def state_name() -> Column:
    """One name for the four flags; what was parsed or has to be fetched again says so."""
    return (
        F.when(F.col("parsed"), fv.PARSED)
        .when(F.col("should_rescrape"), fv.RESCRAPE)
        .when(F.col("is_retrieved") & F.col("is_empty"), fv.FAILED)
        .when(F.col("is_retrieved"), fv.RETRIEVED)
        .otherwise(fv.PENDING)
    )


def latest_entry(log: DataFrame) -> DataFrame:
    """The last log row of each document."""
    last = F.max(F.struct("event_time", "seq", "state"))
    return log.groupBy(*KEY).agg(last.alias("_last")).select(*KEY, "_last.*")


def with_flags(work: DataFrame, log: DataFrame) -> DataFrame:
    """Work items with their flags; items the log does not know yet are pending."""
    flags = ["is_empty", "is_retrieved", "parsed", "should_rescrape"]
    joined = work.join(current_flags(log), KEY, "left")
    return joined.withColumns({flag: F.coalesce(flag, F.lit(False)) for flag in flags})


def transitions(table: DataFrame, state: Column, event_time: Column, seq: Column) -> DataFrame:
    """Log rows that move the documents of a table to a state."""
    return table.select(
        *KEY,
        seq.cast("bigint").alias("seq"),
        event_time.cast("timestamp_ntz").alias("event_time"),
        state.alias("state"),
    )


def snapshot(log: DataFrame) -> DataFrame:
    """Compacted log with the same flags: per document the last fetch state and one row
    each for having been parsed and having been sent back."""
    kind = F.when(F.col("state").isin(FETCH_STATES), F.lit("FETCH")).otherwise(F.col("state"))
    last = F.max(F.struct("event_time", "seq", "state"))
    return (
        log.groupBy(*KEY, kind.alias("_kind"))
        .agg(last.alias("_last"))
        .select(*KEY, "_last.seq", "_last.event_time", "_last.state")
    )
