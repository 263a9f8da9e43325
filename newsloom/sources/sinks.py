"""Writers of the engine's tables: append-only, partitioned by dataset.

Every writer takes the whole change as a DataFrame; one write is one atomic commit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom import schemas
from newsloom.operators.state import transitions
from newsloom.sources.tables import save_table


def append_articles(articles: DataFrame, path: str) -> None:
    save_table(articles.select(*schemas.ARTICLE_COLUMNS), path, partition_by=["dataset"])


def append_captures(captures: DataFrame, path: str) -> None:
    columns = ["dataset", "doc_id", *fv.CAPTURE_FIELDS]
    save_table(captures.select(*columns), path, partition_by=["dataset"])


def append_work(work: DataFrame, path: str) -> None:
    save_table(work.select("dataset", "doc_id", "url"), path, partition_by=["dataset"])


def append_payload(outcomes: DataFrame, path: str) -> None:
    """Payloads of retrieved documents; ``content_kind`` is a partition, so that jobs on
    files do not read pages.  Failed documents have no payload."""
    kept = outcomes.where(F.col("state") == fv.RETRIEVED)
    columns = ["dataset", "doc_id", "url", "content_kind", "raw", "reader"]
    save_table(kept.select(*columns), path, partition_by=["dataset", "content_kind"])


def append_status(changes: DataFrame, path: str, event_time: Column, seq: Column) -> None:
    """Log the ``state`` of each row of a table."""
    rows = transitions(changes, F.col("state"), event_time, seq)
    save_table(rows, path, partition_by=["dataset"])


def append_ledger(entries: DataFrame, path: str) -> None:
    save_table(entries.select("dataset", "stage"), path)
