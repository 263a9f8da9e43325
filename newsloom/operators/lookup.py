"""Joining large tables with lookup tables whose keys may be very frequent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
# A key with more facts than this is split; NULL keys are spread over so many salts.
HOT_ROWS = 2_000_000
FREE_SALTS = 4_096


def measure(table: DataFrame, *more: Column):
    """Rows and bytes of a table (``n``, ``bytes``), and further aggregates: one row."""
    row_bytes = F.octet_length(F.to_json(F.struct(*table.columns)))
    return table.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(row_bytes), F.lit(0)).alias("bytes"),
        *more,
    ).first()


def is_small(size) -> bool:
    """Whether a measurement is within the bounds of a broadcast."""
    return size["n"] <= MAX_BROADCAST_ROWS and size["bytes"] <= MAX_BROADCAST_BYTES


def fits_broadcast(table: DataFrame) -> bool:
    """Whether a lookup table, or one it is reduced from, was measured to be small."""
    return is_small(measure(table))


def join_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "left",
    spread_by: list[str | Column] = ("dataset", "doc_id"),
    fits: bool | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``facts`` joined with ``lookup`` on equal columns: inner, left, semi or anti.

    A lookup table that was measured to be small is broadcast, so the facts do not move
    (``fits`` passes on an earlier measurement).  Otherwise both sides are shuffled by key,
    and keys with more than ``hot_rows`` facts are split, see ``join_split``.
    """
    if fits is None:
        fits = fits_broadcast(lookup)
    if fits:
        return facts.join(F.broadcast(lookup), on, how)
    return join_split(facts, lookup, on, how, spread_by, hot_rows)


def join_split(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str,
    spread_by: list[str | Column],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Shuffle join in which frequent keys are spread over many tasks.

    Facts are counted per key first (reduced on the map side).  A hot key gets one salt per
    ``hot_rows`` facts; its facts are spread over the salts by ``spread_by`` (columns that
    tell rows apart) and only its lookup rows are repeated.  The list of hot keys is
    broadcast only if it was measured to be small.  Facts without a key match nothing and are
    spread freely.
    """
    counts = facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    salts = F.ceil(F.col("_n") / F.lit(hot_rows)).alias("_salts")
    hot = counts.where(F.col("_n") > hot_rows).select(*on, salts)
    if fits_broadcast(hot):
        hot = F.broadcast(hot)

    keyless = F.lit(False)
    for name in on:
        keyless = keyless | F.col(name).isNull()
    ways = F.when(keyless, F.lit(FREE_SALTS)).otherwise(F.coalesce("_salts", F.lit(1)))
    salted = facts.join(hot, on, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread_by), ways)
    )
    last = F.coalesce("_salts", F.lit(1)).cast("bigint") - 1
    repeated = lookup.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), last))
    )
    return (
        salted.drop("_salts")
        .join(repeated.drop("_salts"), [*on, "_salt"], how)
        .drop("_salt")
    )
