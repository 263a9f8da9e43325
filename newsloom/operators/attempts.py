"""Reducing logs of fetch attempts to the answer that counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fv


def pick_try(attempts: DataFrame, key: list[str], tries: int = fv.INDEX_TRIES) -> DataFrame:
    """Of up to ``tries`` numbered tries: the first with status 200, else the last answer.

    A try that failed has no ``http_status``.  Keys without any answer get
    ``timed_out = true``.  Needs ``attempt`` and ``http_status``.
    """
    seen = F.when(F.col("attempt") <= tries, F.col("attempt"))
    answered = F.when(F.col("http_status").isNotNull(), seen)
    first_good = F.min(F.when(F.col("http_status") == 200, seen)).alias("_first_good")
    last_answer = F.max(F.struct(answered.alias("attempt"), F.col("http_status")))
    picked = attempts.groupBy(*key).agg(first_good, last_answer.alias("_last"))
    good = F.col("_first_good").isNotNull()
    return picked.select(
        *key,
        F.coalesce("_first_good", "_last.attempt").alias("attempt"),
        F.when(good, 200).when(F.col("_last.attempt").isNotNull(), F.col("_last.http_status"))
        .alias("http_status"),
        F.coalesce(F.col("_first_good"), F.col("_last.attempt")).isNull().alias("timed_out"),
    )


def pick_variant(results: DataFrame, key: list[str]) -> DataFrame:
    """The first protocol variant that was fetched without an error (its content may be
    empty); NULL if all failed.  Needs ``variant_no`` and ``error``."""
    working = F.when(F.col("error").isNull(), F.col("variant_no"))
    return results.groupBy(*key).agg(F.min(working).alias("variant_no"))


def pick_index_variant(results: DataFrame, key: list[str]) -> DataFrame:
    """Variant whose index answer is used: the first with captures, unless an earlier one
    was answered with a status other than 200, which ends the search.

    Needs ``variant_no``, ``http_status`` and ``n_captures``.
    """
    stopping = F.min(F.when(F.col("http_status") != 200, F.col("variant_no"))).alias("_stop")
    filled = F.min(F.when(F.col("n_captures") > 0, F.col("variant_no"))).alias("_filled")
    reached = F.col("_stop").isNull() | (F.col("_filled") < F.col("_stop"))
    return (
        results.groupBy(*key)
        .agg(stopping, filled)
        .select(*key, F.when(reached, F.col("_filled")).alias("variant_no"))
    )
