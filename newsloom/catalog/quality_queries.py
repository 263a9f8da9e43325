"""The page-quality gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import sql_parts as sp
from newsloom.catalog import tables as tb
from newsloom.catalog.registry import query
from newsloom.catalog.tables import with_tables
from newsloom.functions import html as page
from newsloom.functions import text as tx
from newsloom.functions.html_fields import html_fields
from newsloom.operators import phrases, quality


@query(
    with_tables(
        ["raw_pages"],
        f"SELECT doc_id, len({sp.titles('html')}) AS n_titles, "
        f"array_to_string({sp.titles('html')}, '|') AS titles FROM raw_pages",
    )
)
def title_extract(spark, folder):
    """QA-1: texts of all title elements."""
    found = tb.raw_pages(spark, folder).select("doc_id", page.titles(F.col("html")).alias("t"))
    return found.select(
        "doc_id",
        F.size("t").cast("bigint").alias("n_titles"),
        F.array_join("t", "|").alias("titles"),
    )


@query(
    with_tables(
        ["raw_pages"],
        f"SELECT doc_id, {sp.bad_title('html')} AS bad_title, {sp.bad_body('html')} AS bad_body, "
        f"{sp.rejected('html')} AS rejected FROM raw_pages",
    )
)
def page_quality(spark, folder):
    """QA-1, QA-2, QA-4, QA-6."""
    html = F.col("html")
    return tb.raw_pages(spark, folder).select(
        "doc_id",
        quality.is_bad_title(html).alias("bad_title"),
        quality.is_bad_raw_body(html).alias("bad_body"),
        quality.is_rejected_raw(html).alias("rejected"),
    )


@query(
    with_tables(
        ["raw_pages"],
        f"SELECT dataset, {sp.rejected('html')} AS rejected, count(*) AS n_pages "
        "FROM raw_pages GROUP BY ALL",
    )
)
def rejected_pages(spark, folder):
    """QA-6: rejected pages per dataset."""
    rejected = quality.is_rejected_raw(F.col("html"))
    return (
        tb.raw_pages(spark, folder)
        .groupBy("dataset", rejected.alias("rejected"))
        .agg(F.count(F.lit(1)).alias("n_pages"))
    )


@query(f"SELECT page_id, {sp.visible('html')} AS text FROM pages")
def html_text(spark, folder):
    """EXT-1."""
    return tb.table(spark, folder, "pages").select(
        "page_id", page.visible_text(F.col("html")).alias("text")
    )


_READER_BAD = (
    "doc_id % 13 = 0"
)


READER_REJECTED = (
    f"({_READER_BAD} OR (doc_id % 7 <> 0 AND (regexp_matches({sp.quality_body('text')}, "
    f"{sp.quoted(sp.BODY_ERROR)}, 'i') OR contains(text, 'Sed ut perspiciatis'))))"
)


@query(f"SELECT CAST(doc_id AS INTEGER) AS doc_id, {READER_REJECTED} AS rejected FROM documents")
def reader_quality(spark, folder):
    """QA-3, QA-5, QA-7: simplified pages, read by the one-pass function."""
    pages = tb.reader_pages(spark, folder)
    fielded = pages.withColumn("fields", html_fields(F.col("html")))
    return fielded.select(
        "doc_id", quality.is_rejected_reader(F.col("html"), F.col("fields")).alias("rejected")
    )


@query(
    with_tables(
        ["raw_pages"],
        f"""
SELECT p.doc_id, CASE WHEN {sp.rejected('p.html')} THEN '' ELSE p.html END AS raw,
       d.doc_id IS NOT NULL AND d.doc_id % 13 <> 0 AND NOT (d.doc_id % 7 <> 0
         AND (regexp_matches({sp.quality_body('d.text')}, {sp.quoted(sp.BODY_ERROR)}, 'i')
              OR contains(d.text, 'Sed ut perspiciatis'))) AS reader_kept
FROM raw_pages p LEFT JOIN documents d ON d.doc_id = p.doc_id""",
    )
)
def view_blanking(spark, folder):
    """QA-8: each view is blanked on its own."""
    raw = tb.raw_pages(spark, folder).select("dataset", "doc_id", F.col("html").alias("raw"))
    reader = tb.reader_pages(spark, folder).select(
        "dataset", "doc_id", F.col("html").alias("reader")
    )
    gated = quality.gate_views(raw.join(reader, ["dataset", "doc_id"], "left"))
    return gated.select("doc_id", "raw", (F.col("reader") != "").alias("reader_kept"))


@query(
    with_tables(
        ["raw_pages"],
        f"""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN octet_length(encode(html)) + 2
                    WHEN doc_id % 3 = 1 THEN octet_length(encode(html)) + 1
                    WHEN {sp.bad_title('html')} OR {sp.bad_body('html')} THEN 0
                    ELSE octet_length(encode(html)) END AS n_bytes
FROM raw_pages""",
    )
)
def pdf_sanitize(spark, folder):
    """QA-9: bytes that are no text pass, readable error pages do not."""
    data = tx.encode_utf8(F.col("html"))
    mixed = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(b"\xff\xfe"), data))
        .when(F.col("doc_id") % 3 == 1, F.concat(data, F.lit(b"\xff")))
        .otherwise(data)
    )
    return (
        tb.raw_pages(spark, folder)
        .select("doc_id", mixed.alias("data"))
        .select(
            "doc_id",
            F.octet_length(quality.sanitize_pdf(F.col("data"))).cast("bigint").alias("n_bytes"),
        )
    )


def many_phrases(spark):
    """The built-in phrases and ten thousand more, which no page holds."""
    added = spark.range(10_000).select(
        F.when(F.col("id") % 2 == 0, "title").otherwise("body").alias("scope"),
        F.concat(F.lit("page qz"), F.col("id"), F.lit(" not found zq#")).alias("phrase"),
        F.lit("blank").alias("start_anchor"),
        F.lit("blank").alias("end_anchor"),
    )
    return spark.createDataFrame(phrases.built_in(), phrases.SCHEMA).union(added)


@query(
    with_tables(
        ["raw_pages"],
        f"SELECT doc_id, {sp.bad_title('html')} AS bad_title, {sp.bad_body('html')} AS bad_body, "
        f"{sp.rejected('html')} AS rejected FROM raw_pages",
    )
)
def phrase_gate(spark, folder):
    """QA-1, QA-2, QA-4, QA-6 with a table of ten thousand phrases."""
    gate = phrases.PhraseGate(spark, many_phrases(spark))
    html = F.col("html")
    return tb.raw_pages(spark, folder).select(
        "doc_id",
        gate.is_bad_title(html).alias("bad_title"),
        gate.is_bad_raw_body(html).alias("bad_body"),
        gate.is_rejected_raw(html).alias("rejected"),
    )
