"""States, worklists, imports, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import tables as tb
from newsloom.catalog.registry import query
from newsloom.catalog.tables import with_tables
from newsloom.operators import ledger, state, worklist
from newsloom.plans import reports

_LOG = ["status_log", "flags"]


def flagged_work(spark, folder):
    log = tb.status_log(spark, folder)
    return state.with_flags(tb.log_work(log), log)


@query(
    with_tables(
        _LOG,
        "SELECT dataset, doc_id, is_empty, is_retrieved, parsed, should_rescrape FROM flags",
    )
)
def latest_state(spark, folder):
    """WIN-2, JOIN-5: flags of every document from the log."""
    return state.current_flags(tb.status_log(spark, folder))


@query(
    with_tables(
        ["status_log"],
        """
SELECT dataset, doc_id, event_time, seq, state
FROM (SELECT *, row_number() OVER (PARTITION BY dataset, doc_id
        ORDER BY event_time DESC, seq DESC) AS n FROM status_log) WHERE n = 1""",
    )
)
def latest_entry(spark, folder):
    """WIN-2: the last log row of every document."""
    return state.latest_entry(tb.status_log(spark, folder))


@query(
    with_tables(
        _LOG,
        "SELECT dataset, doc_id, is_empty, is_retrieved, parsed, should_rescrape FROM flags",
    )
)
def log_snapshot(spark, folder):
    """JOIN-5: a compacted log has the same flags."""
    return state.current_flags(state.snapshot(tb.status_log(spark, folder)))


@query(
    with_tables(
        _LOG,
        "SELECT dataset, doc_id, url FROM flags WHERE is_empty = false AND is_retrieved = false "
        "AND should_rescrape = false",
    )
)
def worklist_pending(spark, folder):
    """SRC-2, FLT-1, STM-2: documents still to be fetched."""
    return worklist.pending(flagged_work(spark, folder))


@query(
    with_tables(
        _LOG,
        "SELECT dataset, doc_id, url FROM flags WHERE is_empty = false AND is_retrieved = true "
        "AND parsed = false AND should_rescrape = false",
    )
)
def worklist_parse(spark, folder):
    """FLT-2: documents still to be parsed."""
    return worklist.parse_ready(flagged_work(spark, folder))


@query(
    with_tables(
        _LOG,
        "SELECT dataset, doc_id, url FROM flags WHERE is_empty = false AND is_retrieved = true "
        "AND parsed = false AND should_rescrape = false AND dataset = 'daily' "
        "ORDER BY doc_id DESC LIMIT 500",
    )
)
def worklist_top500(spark, folder):
    """SRC-3, SORT-2: the next batch to parse."""
    return worklist.newest_parse_ready(flagged_work(spark, folder), "daily")


@query(
    with_tables(
        [*_LOG, "raw_pages"],
        """
SELECT f.dataset, f.doc_id, md5(r.html) AS raw_digest, octet_length(encode(d.text)) AS reader_bytes
FROM flags f LEFT JOIN raw_pages r ON r.dataset = f.dataset AND r.doc_id = f.doc_id
LEFT JOIN documents d ON d.doc_id = r.doc_id
WHERE NOT is_empty AND is_retrieved AND NOT parsed AND NOT should_rescrape""",
    )
)
def payload_lookup(spark, folder):
    """SRC-4, JOIN-4, PRJ-1: payloads of a worklist by one join."""
    ready = worklist.parse_ready(flagged_work(spark, folder))
    raw = tb.raw_pages(spark, folder).select(
        "dataset", "doc_id", F.encode("html", "UTF-8").alias("raw")
    )
    reader = tb.table(spark, folder, "documents").select(
        tb.dataset_of(F.col("doc_id")).alias("dataset"),
        F.col("doc_id").cast("int").alias("doc_id"),
        F.encode("text", "UTF-8").alias("reader"),
    )
    payload = raw.join(reader, ["dataset", "doc_id"])
    return worklist.with_payload(ready, payload).select(
        "dataset",
        "doc_id",
        F.md5("raw").alias("raw_digest"),
        F.octet_length("reader").cast("bigint").alias("reader_bytes"),
    )


@query(
    with_tables(
        ["seed"],
        "SELECT dataset, doc_id, (row_number() OVER (PARTITION BY dataset ORDER BY doc_id) - 1) "
        "// 15 AS chunk_no FROM seed",
    )
)
def chunk_assign(spark, folder):
    """WIN-3: slices of fifteen in order."""
    return worklist.chunks(tb.seed(spark, folder)).select("dataset", "doc_id", "chunk_no")


@query(
    with_tables(
        ["seed"],
        """
SELECT dataset, doc_id, (row_number() OVER (PARTITION BY dataset
  ORDER BY left(md5('7:' || dataset || ':' || doc_id), 8), doc_id) - 1) // 15 AS chunk_no
FROM seed""",
    )
)
def chunk_shuffled(spark, folder):
    """WIN-3, SORT-3: slices of fifteen in a seeded random order."""
    return worklist.chunks(tb.seed(spark, folder), seed=7).select("dataset", "doc_id", "chunk_no")


@query(with_tables(["seed"], "SELECT dataset, doc_id, url FROM seed"))
def random_order(spark, folder):
    """SORT-3: the worklist in a seeded random order (row order is not compared)."""
    return worklist.shuffled(tb.seed(spark, folder), 7)


@query(
    with_tables(
        _LOG,
        "SELECT dataset, count(*) AS n_urls FROM flags WHERE NOT is_empty AND NOT is_retrieved "
        "AND NOT should_rescrape GROUP BY dataset",
    )
)
def worklist_count(spark, folder):
    """AGG-1."""
    return reports.worklist_counts(worklist.pending(flagged_work(spark, folder)))


@query(
    with_tables(
        [*_LOG, "states"],
        "SELECT dataset, state, count(*) AS n_docs FROM states GROUP BY ROLLUP (dataset, state)",
    )
)
def state_rollup(spark, folder):
    """AGG-5: documents by dataset and state, with subtotals."""
    return reports.state_counts(tb.status_log(spark, folder))


@query(
    with_tables(
        [*_LOG, "states"],
        """
SELECT dataset, count(*) FILTER (WHERE state = 'PENDING') AS n_pending,
       count(*) FILTER (WHERE state = 'RETRIEVED') AS n_retrieved,
       count(*) FILTER (WHERE state = 'FAILED') AS n_failed,
       count(*) FILTER (WHERE state = 'RESCRAPE') AS n_rescrape,
       count(*) FILTER (WHERE state = 'PARSED') AS n_parsed
FROM states GROUP BY dataset""",
    )
)
def state_funnel(spark, folder):
    """AGG-5: one column per state."""
    return reports.state_funnel(tb.status_log(spark, folder))


@query(
    with_tables(
        ["seed"],
        """
SELECT dataset, batch_no, n_parsed,
       CAST(sum(n_parsed) OVER (PARTITION BY dataset ORDER BY batch_no) AS BIGINT)
         AS n_parsed_so_far
FROM (SELECT dataset, doc_id // 500 AS batch_no, count(*) FILTER (WHERE doc_id % 5 <> 0) AS n_parsed
      FROM seed GROUP BY ALL)""",
    )
)
def parsed_running_total(spark, folder):
    """AGG-4: parsed documents per batch of 500 and so far."""
    kind = F.when(F.col("doc_id") % 5 == 0, "NONE").otherwise("RAW")
    batch = F.floor(F.col("doc_id") / 500).cast("int")
    parsed = tb.seed(spark, folder).select(
        "dataset", kind.alias("content_kind"), batch.alias("batch_no")
    )
    return reports.parsed_progress(parsed)


_DONE = (
    "SELECT dataset FROM ledger GROUP BY dataset HAVING count(DISTINCT stage) "
    "FILTER (WHERE stage IN ('raw_new', 'web_archive_new')) = 2"
)


@query(
    with_tables(
        ["seed", "ledger"], f"SELECT dataset, doc_id, url FROM seed WHERE dataset IN ({_DONE})"
    )
)
def ledger_exists(spark, folder):
    """JOIN-3: seed rows of datasets that were imported before."""
    return ledger.already_imported(tb.seed(spark, folder), tb.ledger(spark, folder))


@query(
    with_tables(
        ["seed", "ledger"], f"SELECT dataset, doc_id, url FROM seed WHERE dataset NOT IN ({_DONE})"
    )
)
def import_antijoin(spark, folder):
    """SET-1, SNK-5, STM-3: seed rows still to be imported."""
    return ledger.to_import(tb.seed(spark, folder), tb.ledger(spark, folder))


@query(
    with_tables(
        ["seed", "ledger"],
        """
SELECT dataset, 'web_archive_new' AS stage, count(*) AS n_rows FROM seed
WHERE dataset NOT IN (SELECT dataset FROM ledger WHERE stage = 'web_archive_new') GROUP BY dataset
UNION ALL
SELECT dataset, 'raw_new', count(*) FROM seed
WHERE dataset NOT IN (SELECT dataset FROM ledger WHERE stage = 'raw_new') GROUP BY dataset""",
    )
)
def import_counts(spark, folder):
    """AGG-2, JOIN-3: rows to write per dataset and stage, each stage checked by itself."""
    seed, entries = tb.seed(spark, folder), tb.ledger(spark, folder)
    per_stage = [
        ledger.import_counts(ledger.to_import(seed, entries, stage)).where(F.col("stage") == stage)
        for stage in ledger.STAGES
    ]
    return per_stage[0].unionByName(per_stage[1])


@query(
    with_tables(
        ["seed", "status_log"],
        """
SELECT dataset, doc_id, url FROM seed
WHERE NOT EXISTS (SELECT 1 FROM status_log l
                  WHERE l.dataset = seed.dataset AND l.doc_id = seed.doc_id
                    AND l.state = 'PARSED')""",
    )
)
def import_new_documents(spark, folder):
    """SET-1: seed rows whose document is not known yet."""
    known = tb.status_log(spark, folder).where(F.col("state") == "PARSED")
    return ledger.new_documents(tb.seed(spark, folder), known).select("dataset", "doc_id", "url")

