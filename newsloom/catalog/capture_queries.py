"""Archive captures and fetch attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import tables as tb
from newsloom.catalog.registry import query
from newsloom.catalog.tables import with_tables
from newsloom.functions.index_udtf import register_archive_lines
from newsloom.operators import attempts, captures

_UNUSABLE = "('401','508','403','502','402','405','429','520','500','409','404','-')"
_FIELDS = (
    "string_split(value, ' ')[1] AS urlkey, string_split(value, ' ')[2] AS \"timestamp\", "
    "string_split(value, ' ')[3] AS original, string_split(value, ' ')[4] AS mimetype, "
    "string_split(value, ' ')[5] AS statuscode, string_split(value, ' ')[6] AS digest, "
    "string_split(value, ' ')[7] AS length"
)


@query(
    with_tables(
        ["index_lines"],
        f"SELECT doc_id, {_FIELDS} FROM index_lines WHERE len(string_split(value, ' ')) = 7",
    )
)
def capture_parse(spark, folder):
    """SRC-6, FLT-5: index lines to captures."""
    return captures.parse_index_lines(tb.index_lines(spark, folder))


@query(
    with_tables(
        ["index_lines"],
        f"SELECT doc_id, {_FIELDS} FROM index_lines WHERE len(string_split(value, ' ')) = 7",
    )
)
def capture_parse_lateral(spark, folder):
    """UDF-2: the same, with the table function and a lateral join."""
    register_archive_lines(spark)
    tb.index_lines(spark, folder).createOrReplaceTempView("index_lines_of_events")
    return spark.sql(
        "SELECT doc_id, c.* FROM index_lines_of_events, LATERAL archive_lines(value) AS c"
    )


@query(
    with_tables(
        ["captures"],
        "SELECT statuscode, count(*) AS n_captures, "
        "statuscode IN ('308','301','307','302','303') AS is_redirect "
        f"FROM captures WHERE statuscode NOT IN {_UNUSABLE} GROUP BY statuscode",
    )
)
def capture_filter(spark, folder):
    """FLT-3, FLT-4, SET-4: usable captures by status."""
    usable = captures.usable_captures(tb.captures(spark, folder))
    return (
        usable.groupBy("statuscode")
        .agg(F.count(F.lit(1)).alias("n_captures"))
        .withColumn("is_redirect", captures.is_redirect(F.col("statuscode")))
    )


@query(
    with_tables(
        ["captures"],
        """
SELECT dataset, doc_id, statuscode, "timestamp", original, count(*) AS copies,
       CAST(sum(count(*)) OVER (PARTITION BY dataset, doc_id ORDER BY statuscode, "timestamp",
         original, urlkey, mimetype, digest, length) AS BIGINT) AS place,
       'https://web.archive.org/web/' || "timestamp" || '/' || original AS location
FROM captures
GROUP BY dataset, doc_id, statuscode, "timestamp", original, urlkey, mimetype, digest, length""",
    )
)
def capture_order(spark, folder):
    """SORT-1, URL-2: captures in the order they would be tried."""
    return captures.ordered_captures(tb.captures(spark, folder)).select(
        "dataset", "doc_id", "statuscode", "timestamp", "original", "copies", "place", "location"
    )


@query(
    with_tables(
        ["captures"],
        "SELECT dataset, doc_id, count(*) AS n_captures FROM captures GROUP BY dataset, doc_id",
    )
)
def captures_per_doc(spark, folder):
    """AGG-3."""
    return captures.captures_per_document(tb.captures(spark, folder))


@query(
    with_tables(
        ["captures"],
        f"""
SELECT dataset, doc_id, statuscode, "timestamp",
       'https://web.archive.org/web/' || "timestamp" || '/' || original AS location
FROM (SELECT *, row_number() OVER (PARTITION BY dataset, doc_id
        ORDER BY statuscode, "timestamp", original) AS place
      FROM captures WHERE statuscode NOT IN {_UNUSABLE})
WHERE place = 1""",
    )
)
def first_usable(spark, folder):
    """WIN-1, SORT-4: the capture to try first."""
    return captures.first_usable(tb.captures(spark, folder))


@query(
    with_tables(
        ["captures"],
        """
SELECT dataset, doc_id, statuscode, substr("timestamp", 1, 6) AS month, count(*) AS n_distinct,
       CAST(sum(copies) AS BIGINT) AS n_captures,
       string_agg(statuscode || ' ' || "timestamp" || ' ' || original || ' ' || copies, ','
         ORDER BY statuscode, "timestamp", original, urlkey, mimetype, digest, length) AS cell
FROM (SELECT dataset, doc_id, statuscode, "timestamp", original, urlkey, mimetype, digest, length,
             count(*) AS copies FROM captures GROUP BY ALL)
GROUP BY dataset, doc_id, statuscode, substr("timestamp", 1, 6)""",
    )
)
def captures_collect(spark, folder):
    """AGG-7, SNK-4: captures of a document as a sorted array cell."""
    cells = captures.capture_cells(tb.captures(spark, folder))
    shown = F.transform(
        "captures",
        lambda c: F.concat_ws(
            " ", c["statuscode"], c["timestamp"], c["original"], c["copies"].cast("string")
        ),
    )
    total = F.aggregate("captures", F.lit(0).cast("bigint"), lambda n, c: n + c["copies"])
    return cells.select(
        "dataset",
        "doc_id",
        "statuscode",
        "month",
        F.size("captures").cast("bigint").alias("n_distinct"),
        total.alias("n_captures"),
        F.array_join(shown, ",").alias("cell"),
    )


@query(
    with_tables(
        ["seed", "captures"],
        """
SELECT s.dataset, s.doc_id, count(c.doc_id) AS n_captures, count(c.doc_id) > 0 AS cached
FROM seed s LEFT JOIN captures c ON s.dataset = c.dataset AND s.doc_id = c.doc_id
GROUP BY s.dataset, s.doc_id""",
    )
)
def capture_cache(spark, folder):
    """JOIN-2: which documents have captures on file."""
    found = captures.cached_documents(tb.seed(spark, folder), tb.captures(spark, folder))
    return found.select("dataset", "doc_id", "n_captures", "cached")


@query(
    with_tables(
        ["attempts"],
        """
SELECT doc_id, coalesce(min(attempt) FILTER (WHERE http_status = 200), max(attempt)) AS attempt,
       coalesce(min(http_status) FILTER (WHERE http_status = 200),
                arg_max(http_status, attempt)) AS http_status,
       false AS timed_out
FROM attempts WHERE attempt <= 5 AND http_status IS NOT NULL GROUP BY doc_id
UNION ALL
SELECT doc_id, NULL, NULL, true FROM attempts GROUP BY doc_id
HAVING count(*) FILTER (WHERE attempt <= 5 AND http_status IS NOT NULL) = 0""",
    )
)
def retry_pick(spark, folder):
    """WIN-5: which of up to five tries counts."""
    return attempts.pick_try(tb.attempts(spark, folder), ["doc_id"])


@query(
    with_tables(
        ["variant_results"],
        """
SELECT doc_id,
       CAST(min(variant_no) FILTER (WHERE error IS NULL) AS INTEGER) AS page_variant,
       CAST(CASE WHEN max(CASE WHEN variant_no = 1 AND http_status <> 200 THEN 1 ELSE 0 END) = 1
                   THEN NULL
                 WHEN max(CASE WHEN variant_no = 1 AND n_captures > 0 THEN 1 ELSE 0 END) = 1 THEN 1
                 WHEN max(CASE WHEN variant_no = 2 AND http_status = 200 AND n_captures > 0
                          THEN 1 ELSE 0 END) = 1 THEN 2 END AS INTEGER) AS index_variant
FROM variant_results GROUP BY doc_id""",
    )
)
def protocol_pick(spark, folder):
    """WIN-4: which protocol variant counts, for pages and for index answers."""
    results = tb.variant_results(spark, folder)
    pages = attempts.pick_variant(results, ["doc_id"])
    indexes = attempts.pick_index_variant(results, ["doc_id"])
    return pages.withColumnRenamed("variant_no", "page_variant").join(
        indexes.withColumnRenamed("variant_no", "index_variant"), "doc_id"
    )
