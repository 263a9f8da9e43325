"""The retrieval plan and its outcome."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsloom.catalog import sql_parts as sp
from newsloom.catalog import tables as tb
from newsloom.catalog.quality_queries import READER_REJECTED
from newsloom.catalog.registry import query
from newsloom.catalog.tables import CTES, with_tables
from newsloom.catalog.url_queries import policed_seed
from newsloom.plans import retrieval
from newsloom.plans import retrieval_job as job
from newsloom.session import cut_lineage, shared_folder
from newsloom.sources.batches import BatchStore

_WORK = ["seed", "suffixes", "hosts", "split", "policy", "work"]
_UNUSABLE = "('401','508','403','502','402','405','429','520','500','409','404','-')"

# The work table holds URLs without leading slash, as the Spark side feeds them.
CTES["variants"] = """
  SELECT dataset, doc_id, url, method, is_file, unnest(v) AS variant,
         CAST(unnest(range(1, len(v) + 1)) AS INTEGER) AS variant_no
  FROM (SELECT dataset, doc_id, ltrim(url, '/') AS url, method, contains(url, '.pdf') AS is_file,
               CASE WHEN contains(url, 'http') THEN [url]
                    ELSE ['http://' || ltrim(url, '/'), 'https://' || ltrim(url, '/')] END AS v
        FROM work)"""
CTES["index_errors"] = "SELECT dataset, doc_id FROM work WHERE length(domain) % 4 = 1"
CTES["plan"] = f"""
  SELECT dataset, doc_id, 1 AS stage_rank, '' AS statuscode, '' AS "timestamp", variant_no,
         'PDF' AS view, variant AS location
  FROM variants WHERE is_file AND variant_no = 1
  UNION ALL
  SELECT v.dataset, v.doc_id, 0, '', '', v.variant_no, 'RAW', replace(t.template, '{{url}}', variant)
  FROM variants v JOIN templates t USING (method) WHERE NOT is_file
  UNION ALL
  SELECT DISTINCT c.dataset, c.doc_id, 1, c.statuscode, c."timestamp", 1, 'BOTH',
         'https://web.archive.org/web/' || c."timestamp" || '/' || c.original
  FROM captures c JOIN work w ON w.dataset = c.dataset AND w.doc_id = c.doc_id
  WHERE NOT contains(w.url, '.pdf') AND c.statuscode NOT IN {_UNUSABLE}
    AND NOT EXISTS (SELECT 1 FROM index_errors e
                    WHERE e.dataset = c.dataset AND e.doc_id = c.doc_id)
  UNION ALL
  SELECT v.dataset, v.doc_id, 2, '', '', v.variant_no, 'BOTH', variant
  FROM variants v WHERE NOT is_file
    AND NOT EXISTS (SELECT 1 FROM index_errors e
                    WHERE e.dataset = v.dataset AND e.doc_id = v.doc_id)"""
_MARKED = "replace(html, '<title>', '<title>Error 404: ')"
CTES["gated_pages"] = f"""
  SELECT CAST(page_id AS INTEGER) AS doc_id, NOT {sp.rejected('html')} AS good,
         NOT {sp.rejected(_MARKED)} AS marked_good,
         NOT ({sp.bad_title('html')} OR {sp.bad_body('html')}) AS file_good,
         NOT ({sp.bad_title(_MARKED)} OR {sp.bad_body(_MARKED)}) AS marked_file_good
  FROM pages"""
CTES["gated_readers"] = f"""
  SELECT CAST(doc_id AS INTEGER) AS doc_id, NOT {READER_REJECTED} AS good FROM documents"""
CTES["results"] = """
  SELECT *, CASE WHEN (n + attempt) % 5 = 1 THEN 'no answer' END AS error,
         CASE WHEN n % 4 = 0 THEN 503 ELSE 200 END AS http_status,
         CASE WHEN view = 'PDF' AND n % 2 = 0 THEN true
              WHEN view = 'PDF' AND marked THEN marked_file_good WHEN view = 'PDF' THEN file_good
              WHEN marked THEN marked_good ELSE good END AS raw_ok,
         n % 2 = 0 AND view = 'BOTH' AND reader_good AS reader_ok
  FROM (SELECT p.*, g.* EXCLUDE (doc_id), r.good AS reader_good, attempt,
               length(location) + p.doc_id + variant_no AS n,
               (length(location) + p.doc_id + variant_no + attempt) % 3 = 1 AS marked
        FROM plan p JOIN gated_pages g ON g.doc_id = p.doc_id JOIN gated_readers r ON r.doc_id = p.doc_id,
        attempts_made)"""
CTES["attempts_made"] = "SELECT 1 AS attempt"
CTES["more_attempts"] = "SELECT unnest([1, 2, 3]) AS attempt"
CTES["tried"] = """
  SELECT *, raw_ok OR reader_ok AS accepted FROM results
  WHERE error IS NULL AND (view <> 'PDF' OR http_status = 200)"""
CTES["stage_first"] = """
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset, doc_id, stage_rank
      ORDER BY statuscode, "timestamp", variant_no, NOT accepted, attempt, location) AS place
    FROM tried WHERE stage_rank <> 1 OR accepted)
  WHERE place = 1 AND accepted"""
CTES["chosen"] = """
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset, doc_id ORDER BY stage_rank) AS pick
    FROM stage_first) WHERE pick = 1"""
_PLAN = [*_WORK, "templates", "captures", "index_errors", "variants", "plan"]


def _index_errors(work):
    return work.where(F.length("domain") % 4 == 1).select("dataset", "doc_id")


def _plan(spark, folder):
    """Work table and plan.  Both feed several steps, so they are stored in between, as a
    fetcher would need them anyway."""
    work = cut_lineage(policed_seed(spark, folder))
    plan = retrieval.fetch_plan(
        work, tb.captures(spark, folder), tb.templates(spark), _index_errors(work)
    )
    return work, cut_lineage(plan)


def _results(spark, folder, plan, attempts=1):
    """A fetch result per planned location and attempt: the document's page, or that page under an
    error title, and its simplified page; some fetches end in an error, some files are no text."""
    number = F.length("location") + F.col("doc_id") + F.col("variant_no")
    pages = tb.table(spark, folder, "pages").select(
        F.col("page_id").cast("int").alias("doc_id"), F.col("html").alias("_page")
    )
    readers = tb.reader_pages(spark, folder).select("doc_id", F.col("html").alias("_reader"))
    tried = (
        plan.join(pages, "doc_id")
        .join(readers, "doc_id")
        .withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(attempts))))
    )
    attempt = F.col("attempt")
    marked = F.replace("_page", F.lit("<title>"), F.lit("<title>Error 404: "))
    sent = F.encode(F.when((number + attempt) % 3 == 1, marked).otherwise(F.col("_page")), "UTF-8")
    no_text = (F.col("view") == "PDF") & (number % 2 == 0)
    return tried.select(
        "dataset",
        "doc_id",
        "location",
        "attempt",
        F.when(number % 4 == 0, 503).otherwise(200).alias("http_status"),
        F.when((number + attempt) % 5 == 1, "no answer").alias("error"),
        F.when(no_text, F.concat(F.lit(b"\xff\xfe"), sent)).otherwise(sent).alias("raw"),
        F.encode(F.when(number % 2 == 0, F.col("_reader")).otherwise(F.lit("")), "UTF-8").alias("reader"),
    )


def _fetched(spark, folder, plan, attempts=1):
    """The same fetches as thin rows, and what they brought: each page, as it was sent, once per
    document. Its rows are spread over all cores, as judging a page costs more than its bytes tell."""
    number = F.length("location") + F.col("doc_id") + F.col("variant_no")
    attempt = F.col("attempt")
    pages = tb.table(spark, folder, "pages").select(
        F.col("page_id").cast("int").alias("doc_id"), F.col("html").alias("_page")
    )
    readers = tb.reader_pages(spark, folder).select("doc_id", F.col("html").alias("_reader"))
    marked = F.when((number + attempt) % 3 == 1, 1).otherwise(0)
    no_text = F.when((F.col("view") == "PDF") & (number % 2 == 0), 2).otherwise(0)
    has_reader = F.when(number % 2 == 0, 4).otherwise(0)
    results = (
        plan.join(pages.select("doc_id"), "doc_id", "left_semi")
        .join(readers.select("doc_id"), "doc_id", "left_semi")
        .withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(attempts))))
        .select(
            "dataset",
            "doc_id",
            "location",
            "attempt",
            F.when(number % 4 == 0, 503).otherwise(200).alias("http_status"),
            F.when((number + attempt) % 5 == 1, "no answer").alias("error"),
            (marked + no_text + has_reader).alias("content"),
        )
    )
    content = F.col("content")
    error_page = F.replace("_page", F.lit("<title>"), F.lit("<title>Error 404: "))
    sent = F.encode(F.when(content % 2 == 1, error_page).otherwise(F.col("_page")), "UTF-8")
    brought = results.where("error IS NULL").select("dataset", "doc_id", "content").distinct()
    contents = (
        brought.repartition(4 * spark.sparkContext.defaultParallelism, "doc_id")
        .join(pages, "doc_id")
        .join(readers, "doc_id")
        .select(
            "dataset",
            "doc_id",
            "content",
            F.when(content.bitwiseAND(2) > 0, F.concat(F.lit(b"\xff\xfe"), sent)).otherwise(sent).alias("raw"),
            F.encode(F.when(content >= 4, F.col("_reader")).otherwise(F.lit("")), "UTF-8").alias("reader"),
        )
    )
    return results, contents


_FETCHED = [*_PLAN, "gated_pages", "gated_readers", "attempts_made", "results"]


@query(
    with_tables(
        _PLAN,
        'SELECT dataset, doc_id, stage_rank, statuscode, "timestamp", variant_no, view, location '
        "FROM plan",
    )
)
def fetch_plan(spark, folder):
    """PLN-1..5, SET-3, SET-2: all locations to try, in stages."""
    return _plan(spark, folder)[1].drop("is_redirect")


@query(
    with_tables(
        _PLAN,
        """
SELECT v.dataset, v.doc_id, v.variant_no,
       'http://web.archive.org/cdx/search/cdx?url=' || v.variant AS location
FROM variants v WHERE NOT v.is_file AND NOT EXISTS (
  SELECT 1 FROM captures c WHERE c.dataset = v.dataset AND c.doc_id = v.doc_id)""",
    )
)
def index_plan(spark, folder):
    """PLN-7: index queries still to be made."""
    work = policed_seed(spark, folder)
    return retrieval.index_plan(work, tb.captures(spark, folder)).withColumn(
        "variant_no", F.col("variant_no").cast("int")
    )


@query(
    with_tables(
        _FETCHED,
        "SELECT view, stage_rank, error IS NULL AS fetched, count(*) AS n_locations FROM results "
        "GROUP BY ALL",
    )
)
def plan_results(spark, folder):
    """JOIN-8: planned locations with what was fetched for them."""
    plan = _plan(spark, folder)[1]
    results = _results(spark, folder, plan)
    joined = plan.join(results, ["dataset", "doc_id", "location"], "left")
    return joined.groupBy("view", "stage_rank", F.col("error").isNull().alias("fetched")).agg(
        F.count(F.lit(1)).alias("n_locations")
    )


@query(
    with_tables(
        [*_FETCHED, "tried", "stage_first", "chosen"],
        """
SELECT w.dataset, w.doc_id, c.stage_rank, c.location,
       CASE WHEN c.location IS NOT NULL THEN 'RETRIEVED' WHEN e.doc_id IS NOT NULL
            THEN 'INDEX_ERROR' ELSE 'FAILED' END AS state,
       CASE WHEN c.location IS NULL THEN 'NONE' WHEN c.view = 'PDF' THEN 'PDF'
            WHEN c.raw_ok AND c.reader_ok THEN 'BOTH' WHEN c.raw_ok THEN 'RAW'
            ELSE 'READER' END AS content_kind
FROM work w LEFT JOIN chosen c ON c.dataset = w.dataset AND c.doc_id = w.doc_id
LEFT JOIN index_errors e ON e.dataset = w.dataset AND e.doc_id = w.doc_id""",
    )
)
def retrieval_outcome(spark, folder):
    """PLN-6, WIN-1, QA-8, QA-9, QA-10, FLT-9, FLT-11, SNK-2, SNK-3: what is kept."""
    work, plan = _plan(spark, folder)
    results, contents = _fetched(spark, folder, plan)
    chosen = retrieval.choose(plan, results, contents=contents)
    kept = retrieval.outcomes(work, chosen, _index_errors(work))
    return kept.select("dataset", "doc_id", "stage_rank", "location", "state", "content_kind")


@query(
    with_tables(
        [*_FETCHED, "tried", "stage_first", "chosen"],
        """
SELECT w.dataset, count(*) AS n_docs,
       count(*) FILTER (WHERE c.stage_rank = 0) AS n_gated,
       count(*) FILTER (WHERE c.stage_rank = 1) AS n_archived,
       count(*) FILTER (WHERE c.stage_rank = 2) AS n_live,
       count(*) FILTER (WHERE c.location IS NULL) AS n_without
FROM work w LEFT JOIN chosen c ON c.dataset = w.dataset AND c.doc_id = w.doc_id
GROUP BY w.dataset""",
    )
)
def retrieval_report(spark, folder):
    """PLN-2, AGG-1: where the content of each dataset came from."""
    work, plan = _plan(spark, folder)
    results, contents = _fetched(spark, folder, plan)
    chosen = retrieval.choose(plan, results, contents=contents)
    kept = retrieval.outcomes(work, chosen, _index_errors(work))
    stage = F.col("stage_rank")
    return kept.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(stage == 0).alias("n_gated"),
        F.count_if(stage == 1).alias("n_archived"),
        F.count_if(stage == 2).alias("n_live"),
        F.count_if(stage.isNull()).alias("n_without"),
    )


def _with_retries() -> str:
    names = [{"attempts_made": "more_attempts"}.get(name, name) for name in _FETCHED]
    sql = with_tables(
        [*names, "tried", "stage_first", "chosen"],
        "SELECT dataset, doc_id, stage_rank, location, attempt, raw_ok, reader_ok FROM chosen",
    )
    return sql.replace("attempts_made", "more_attempts")


@query(_with_retries())
def retrieval_retries(spark, folder):
    """WIN-5, PLN-6: of three tries of each location the first that passes the gate."""
    plan = _plan(spark, folder)[1]
    results, contents = _fetched(spark, folder, plan, attempts=3)
    return retrieval.choose(plan, results, contents=contents).select(
        "dataset", "doc_id", "stage_rank", "location", "attempt", "raw_ok", "reader_ok"
    )


@query(
    with_tables(
        [*_FETCHED, "tried", "stage_first", "chosen"],
        f"""
SELECT w.dataset, w.doc_id,
       CASE WHEN c.location IS NOT NULL THEN 'RETRIEVED' WHEN e.doc_id IS NOT NULL
            THEN 'INDEX_ERROR' ELSE 'FAILED' END AS state,
       CASE WHEN c.location IS NULL THEN NULL WHEN c.view = 'PDF' THEN 'PDF'
            WHEN c.raw_ok AND c.reader_ok THEN 'BOTH' WHEN c.raw_ok THEN 'RAW'
            ELSE 'READER' END AS content_kind,
       CASE WHEN c.location IS NULL THEN NULL WHEN NOT c.raw_ok THEN 0
            ELSE octet_length(encode(CASE WHEN marked THEN {_MARKED} ELSE html END))
                 + CASE WHEN c.view = 'PDF' AND n % 2 = 0 THEN 2 ELSE 0 END END AS raw_bytes,
       c.reader_ok AS has_reader
FROM work w LEFT JOIN chosen c ON c.dataset = w.dataset AND c.doc_id = w.doc_id
LEFT JOIN index_errors e ON e.dataset = w.dataset AND e.doc_id = w.doc_id
LEFT JOIN pages p ON p.page_id = w.doc_id""",
    )
)
def retrieval_job(spark, folder):
    """SNK-2, SNK-3, PLN-2, FLT-1: two batches of work, one of them run again, written and read
    back: states and payloads of all documents."""
    work, plan = _plan(spark, folder)
    results, contents = _fetched(spark, folder, plan)
    store = BatchStore(spark, f"{shared_folder(spark).rstrip('/')}/retrieval-{uuid.uuid4().hex}")
    moment = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    for batch, part in (("a", 0), ("b", 1), ("a", 0)):
        todo = job.open_work(work, store).where(F.col("doc_id") % 2 == part)
        planned = plan.join(todo.select("dataset", "doc_id"), ["dataset", "doc_id"], "left_semi")
        job.run_batch(
            store, batch, todo, planned, results, moment, F.col("doc_id"), _index_errors(work),
            contents=contents,
        )
    payload = job.payloads(store)
    return job.states(store).join(payload, ["dataset", "doc_id"], "left").select(
        "dataset",
        "doc_id",
        "state",
        "content_kind",
        F.octet_length("raw").cast("bigint").alias("raw_bytes"),
        (F.octet_length("reader") > 0).alias("has_reader"),
    )


@query(
    """
WITH hops AS (SELECT page_id, CASE WHEN page_id % 12 = 2 THEN NULL WHEN page_id % 4 = 0 THEN page_id + 3
  WHEN page_id % 4 = 1 THEN page_id + 2 ELSE page_id END AS final FROM pages)
SELECT h.page_id, coalesce(md5(p.html), md5('')) AS reader FROM hops h LEFT JOIN pages p ON p.page_id = h.final"""
)
def reader_redirects(spark, folder):
    """URL-7, URL-8, PLN-6: simplified views that redirect, once or twice, and where they end."""
    number = F.col("page_id")
    link = F.when(number % 12 == 2, "").when(
        number % 4 < 2, F.concat(F.lit('<a href="u'), (number + number % 4 + 1).cast("string"), F.lit('">on</a>'))
    )
    notice = F.concat(F.lit('<p>Redirecting to...</p><div class="content">'), link, F.lit("</div>"))
    results = tb.table(spark, folder, "pages").select(
        tb.dataset_of(number).alias("dataset"),
        number.cast("int").alias("doc_id"),
        F.concat(F.lit("u"), number.cast("string")).alias("location"),
        F.lit(200).alias("http_status"),
        F.lit(None).cast("string").alias("error"),
        F.lit(b"").alias("raw"),
        F.encode(F.coalesce(notice, F.col("html")), "UTF-8").alias("reader"),
    )
    return retrieval.follow_readers(results).select(
        F.col("doc_id").cast("bigint").alias("page_id"), F.md5("reader").alias("reader")
    )
