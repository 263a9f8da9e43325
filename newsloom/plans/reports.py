"""Counts and funnels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom.operators.ranking import integer_block, running_total
from newsloom.operators.state import STATES, current_flags, state_name


def worklist_counts(worklist: DataFrame) -> DataFrame:
    return worklist.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_urls"))


def state_counts(log: DataFrame) -> DataFrame:
    """Documents per dataset and state, with subtotals (NULL means all)."""
    states = current_flags(log).withColumn("state", state_name())
    return states.rollup("dataset", "state").agg(F.count(F.lit(1)).alias("n_docs"))


def state_funnel(log: DataFrame) -> DataFrame:
    """One row per dataset, one column per state."""
    states = current_flags(log).withColumn("state", state_name())
    counts = [
        F.count_if(F.col("state") == state).alias(f"n_{state.lower()}") for state in STATES
    ]
    return states.groupBy("dataset").agg(*counts)


def parsed_progress(parsed: DataFrame, batch: str = "batch_no") -> DataFrame:
    """Documents parsed per batch and so far; documents without content do not count."""
    counted = F.count_if(F.col("content_kind") != fv.NONE)
    per_batch = parsed.groupBy("dataset", batch).agg(counted.alias("n_parsed"))
    return running_total(
        per_batch,
        ["dataset"],
        [batch],
        integer_block(F.col(batch)),
        F.col("n_parsed"),
        "n_parsed_so_far",
    )
