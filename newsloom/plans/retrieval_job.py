"""The retrieval job from the pending worklist to written payloads and states.

A batch takes work that is pending, chooses among its fetch results, and commits payloads and
states together: readers see both or neither, and a batch that is repeated after a crash changes
nothing that was written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom import schemas
from newsloom.operators.state import transitions, with_flags
from newsloom.operators.worklist import is_pending
from newsloom.plans.retrieval import choose, outcomes, with_content
from newsloom.session import cut_lineage
from newsloom.sources.batches import BatchStore


def open_work(work: DataFrame, store: BatchStore) -> DataFrame:
    """Work items that are still to be fetched, by the states committed so far."""
    log = store.read("status", schemas.STATUS_LOG)
    return with_flags(work, log).where(is_pending()).select(*work.columns)


def run_batch(
    store: BatchStore,
    batch: str,
    work: DataFrame,
    plan: DataFrame,
    results: DataFrame,
    event_time: Column,
    seq: Column,
    index_errors: DataFrame | None = None,
    compatible: bool = False,
    contents: DataFrame | None = None,
) -> bool:
    """Decide one batch of work and commit it; False if the batch was committed before.

    ``work`` holds the batch's documents. States go by thin rows alone; only the documents that
    are kept meet their bytes again. ``contents``: bytes apart from ``results``, see
    ``retrieval.judged``."""
    if store.is_committed(batch):
        return False
    chosen = choose(plan, results, compatible, contents)
    decided = cut_lineage(outcomes(work, chosen, index_errors, thin=True))
    kept = with_content(decided.where(F.col("state") == fv.RETRIEVED), results, contents)
    tables = {
        "payload": kept.select("dataset", "doc_id", "url", "content_kind", "raw", "reader"),
        "status": transitions(decided, F.col("state"), event_time, seq),
    }
    return store.commit(batch, tables, {"payload": ["dataset", "content_kind"], "status": ["dataset"]})


def payloads(store: BatchStore) -> DataFrame:
    """Payloads of all committed batches."""
    return store.read("payload", schemas.PAYLOAD)


def states(store: BatchStore) -> DataFrame:
    """The status log of all committed batches."""
    return store.read("status", schemas.STATUS_LOG)
