"""DDL of every table the engine reads or writes.

A document is identified by ``(dataset, doc_id)`` everywhere.  Large blobs live in
``payload`` only, so scans of the state tables never touch them.
"""

SEED = "id INT, url STRING"

WORK_ITEM = "dataset STRING, doc_id INT, url STRING"

DOMAIN_POLICY = (
    "id INT, subdomain STRING, domain STRING, suffix STRING, method STRING, checked BOOLEAN"
)

ROUTE_TEMPLATE = "method STRING, template STRING"

PUBLIC_SUFFIX = "suffix STRING"

ARCHIVE_CAPTURE = (
    "dataset STRING, doc_id INT, urlkey STRING, timestamp STRING, original STRING, "
    "mimetype STRING, statuscode STRING, digest STRING, length STRING"
)

FETCH_ATTEMPT = (
    "dataset STRING, doc_id INT, location STRING, variant_no INT, attempt INT, "
    "http_status INT, error STRING, raw BINARY, reader BINARY"
)

PAYLOAD = "dataset STRING, doc_id INT, url STRING, content_kind STRING, raw BINARY, reader BINARY"

STATUS_LOG = "dataset STRING, doc_id INT, seq BIGINT, event_time TIMESTAMP_NTZ, state STRING"

INGEST_LEDGER = "dataset STRING, stage STRING"

PDF_META = "dataset STRING, doc_id INT, title STRING, creation_date STRING"

PDF_PAGE = "dataset STRING, doc_id INT, page_no INT, text STRING"

REDIRECT_EDGE = "from_url STRING, to_url STRING"

ARTICLE = (
    "dataset STRING, doc_id INT, title STRING, body STRING, publish_date TIMESTAMP_NTZ, "
    "authors ARRAY<STRING>, language STRING, top_image_url STRING, "
    "media_urls ARRAY<STRING>, is_empty BOOLEAN"
)

DEAD_LETTER = "dataset STRING, doc_id INT, step STRING, error STRING"

DOC_KEY = ["dataset", "doc_id"]

ARTICLE_COLUMNS = [
    "dataset",
    "doc_id",
    "title",
    "body",
    "publish_date",
    "authors",
    "language",
    "top_image_url",
    "media_urls",
    "is_empty",
]
