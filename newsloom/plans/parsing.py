"""The parse job: from stored payloads to articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom import schemas
from newsloom.functions import text as tx
from newsloom.functions import urls
from newsloom.functions.language import guess_language
from newsloom.operators.extract import with_raw_article, with_reader_article
from newsloom.operators.lookup import fits_broadcast, join_lookup
from newsloom.operators.merge import is_empty_article, merged_fields
from newsloom.operators.pdf import pdf_articles
from newsloom.plans.retrieval import content_kind

KEY = ["dataset", "doc_id"]
ARTICLE_FIELDS = [
    "title", "body", "publish_date", "authors", "language", "top_image_url", "media_urls",
]


def prepared_pages(payload: DataFrame) -> DataFrame:
    """The documents that are no files: views decoded and cleaned, ``content_kind`` set.

    Bytes that are no valid text are noted in ``decode_error``.
    """
    decoded = payload.where(~urls.is_pdf(F.col("url"))).select(
        *KEY,
        "url",
        "raw",
        "reader",
        tx.decode_utf8(F.col("raw")).alias("_raw"),
        tx.decode_utf8(F.col("reader")).alias("_reader"),
    )
    bad_raw = F.col("raw").isNotNull() & F.col("_raw").isNull()
    bad_reader = F.col("reader").isNotNull() & F.col("_reader").isNull()
    cleaned = decoded.select(
        *KEY,
        "url",
        F.coalesce(tx.preprocess_html(F.col("_raw")), F.lit("")).alias("raw"),
        F.coalesce(tx.preprocess_html(F.col("_reader")), F.lit("")).alias("reader"),
        (bad_raw | bad_reader).alias("decode_error"),
    )
    kind = content_kind(F.lit(""), F.col("raw"), F.col("reader"))
    return cleaned.withColumn("content_kind", kind)


def file_documents(payload: DataFrame) -> DataFrame:
    """Keys of the documents that are files.  A stored ``content_kind`` spares the blobs."""
    if "content_kind" in payload.columns:
        has_file = F.col("content_kind") == fv.PDF
    else:
        has_file = ~tx.is_empty_payload(F.col("raw"))
    kind = F.when(has_file, fv.PDF).otherwise(fv.NONE)
    return payload.where(urls.is_pdf(F.col("url"))).select(*KEY, kind.alias("content_kind"))


def parse_payload(
    payload: DataFrame,
    pdf_meta: DataFrame | None = None,
    pdf_pages: DataFrame | None = None,
    as_of: Column | None = None,
    stop_words: dict[str, str] | None = None,
    part_of_files: bool = False,
) -> DataFrame:
    """Articles of all documents, plus ``content_kind``, ``error`` and ``date_error``.

    Pages are parsed where they lie, without a shuffle; only files are joined with their
    extracted page texts.  A document without content still gives an (empty) row.  A row
    with ``error`` belongs to the dead letters.  A date that cannot be read costs the date only:
    ``date_error`` names it where no other source gave one.

    The language of an article is that of the view its body comes from, so it is guessed
    once, from the final body.

    ``part_of_files``: the payload holds few of the files whose page texts are given (a batch of
    a stream, say); only the texts of these are put together.
    """
    pages = with_reader_article(
        with_raw_article(prepared_pages(payload), as_of=as_of, with_language=False),
        as_of=as_of,
        with_language=False,
    )
    raw, reader = F.col("raw_article"), F.col("reader_article")
    merged = merged_fields(raw, reader)
    kind = F.col("content_kind")
    chosen = {
        name: F.when(kind == fv.BOTH, merged[name])
        .when(kind == fv.RAW, raw[name])
        .when(kind == fv.READER, reader[name])
        for name in ARTICLE_FIELDS
    }
    problem = F.coalesce(
        F.when(F.col("decode_error"), F.lit("payload is not valid UTF-8")),
        F.col("reader_article_problem"),
    )
    undated = F.coalesce("raw_article_date_problem", "reader_article_date_problem")
    articles = pages.select(
        *KEY,
        "content_kind",
        *[c.alias(n) for n, c in chosen.items()],
        problem.alias("error"),
        F.when(chosen["publish_date"].isNull(), undated).alias("date_error"),
    )
    if pdf_meta is not None and pdf_pages is not None:
        files = file_documents(payload)
        if part_of_files:
            fits = fits_broadcast(files)
            pdf_meta, pdf_pages = (
                join_lookup(table, files.select(*KEY), KEY, "left_semi", KEY, fits)
                for table in (pdf_meta, pdf_pages)
            )
        read = files.join(pdf_articles(pdf_meta, pdf_pages, with_language=False), KEY, "left")
        is_file = F.col("content_kind") == fv.PDF
        missing = F.when(
            is_file & F.col("pdf_article").isNull(), F.lit("no extracted page texts")
        )
        articles = articles.unionByName(
            read.select(
                *KEY,
                "content_kind",
                *[F.when(is_file, F.col("pdf_article")[n]).alias(n) for n in ARTICLE_FIELDS],
                missing.alias("error"),
                F.when(is_file, F.col("pdf_article_date_problem")).alias("date_error"),
            )
        )
    empty = is_empty_article({name: F.col(name) for name in ARTICLE_FIELDS})
    language = F.when(F.col("content_kind") != fv.NONE, guess_language(F.col("body"), stop_words))
    return articles.withColumns({"is_empty": empty, "language": language})


def article_rows(parsed: DataFrame) -> DataFrame:
    """Rows of the article table, in its column order; failed documents are left out."""
    return parsed.where(F.col("error").isNull()).select(*schemas.ARTICLE_COLUMNS)


def dead_letters(parsed: DataFrame, step: str = "parse") -> DataFrame:
    """Documents that could not be parsed, with the reason; they leave the worklist."""
    return parsed.where(F.col("error").isNotNull()).select(
        *KEY, F.lit(step).alias("step"), "error"
    )


def date_errors(parsed: DataFrame) -> DataFrame:
    """Written articles that have no date because theirs could not be read, with its text."""
    named = parsed.where(F.col("error").isNull() & F.col("date_error").isNotNull())
    return named.select(*KEY, "date_error")


def parse_states(kind: Column) -> Column:
    """States to log for a written article, in order."""
    return F.when(kind == fv.NONE, F.array(F.lit(fv.RESCRAPE), F.lit(fv.PARSED))).otherwise(
        F.array(F.lit(fv.PARSED))
    )


def parse_transitions(parsed: DataFrame) -> DataFrame:
    """States to log: RESCRAPE for documents without content, and PARSED for all written."""
    written = parsed.where(F.col("error").isNull())
    return written.select(*KEY, F.explode(parse_states(F.col("content_kind"))).alias("state"))
