"""Importing each dataset once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom.operators.lookup import join_lookup

STAGES = [fv.CAPTURE_STAGE, fv.WORK_STAGE]


def imported_datasets(ledger: DataFrame) -> DataFrame:
    """Datasets whose import is complete: both stages are in the ledger."""
    both = F.bool_or(F.col("stage") == STAGES[0]) & F.bool_or(F.col("stage") == STAGES[1])
    return ledger.groupBy("dataset").agg(both.alias("_done")).where("_done").select("dataset")


def stage_datasets(ledger: DataFrame, stage: str) -> DataFrame:
    return ledger.where(F.col("stage") == stage).select("dataset").distinct()


def already_imported(seed: DataFrame, ledger: DataFrame) -> DataFrame:
    """Seed rows of datasets that were imported before."""
    return join_lookup(seed, imported_datasets(ledger), ["dataset"], "left_semi")


def to_import(seed: DataFrame, ledger: DataFrame, stage: str | None = None) -> DataFrame:
    """Seed rows of datasets that were not imported yet, wholly or for one stage."""
    done = imported_datasets(ledger) if stage is None else stage_datasets(ledger, stage)
    return join_lookup(seed, done, ["dataset"], "left_anti")


def new_documents(seed: DataFrame, work: DataFrame) -> DataFrame:
    """Seed rows whose document is not in the work table: a stopped import can be repeated."""
    return seed.join(work.select("dataset", "doc_id"), ["dataset", "doc_id"], "left_anti")


def ledger_entries(seed: DataFrame) -> DataFrame:
    """Ledger rows to write after the datasets of a seed were imported."""
    stages = F.explode(F.array(*[F.lit(stage) for stage in STAGES])).alias("stage")
    return seed.select("dataset").distinct().select("dataset", stages)


def import_counts(seed: DataFrame) -> DataFrame:
    """Rows written per dataset and stage."""
    counted = seed.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"))
    stages = F.explode(F.array(*[F.lit(stage) for stage in STAGES])).alias("stage")
    return counted.select("dataset", stages, "n_rows")
