"""Articles from document files whose page texts were extracted beforehand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.functions.dates import pdf_creation_date
from newsloom.operators.extract import language_or_none, unreadable_date
from newsloom.operators.ranking import integer_block

KEY = ["dataset", "doc_id"]
BLOCK_BITS = 10


def _join(pages: DataFrame, key: list[str], order: str) -> DataFrame:
    text = F.expr(f"listagg(text, '') WITHIN GROUP (ORDER BY {order}, text)")
    return pages.groupBy(*key).agg(text.alias("text"))


def joined_pages(pages: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Texts of all pages of a document in page order, as one text.

    Pages are joined per block of page numbers first, so that sorting and joining the pages of
    one document is the work of many tasks.  What is left for one task is to put the block texts
    into the one string that is the result.
    """
    blocked = pages.withColumn("_block", integer_block(F.col("page_no"), block_bits))
    return _join(_join(blocked, [*KEY, "_block"], "page_no"), KEY, "_block")


def pdf_articles(
    meta: DataFrame,
    pages: DataFrame,
    stop_words: dict[str, str] | None = None,
    with_language: bool = True,
) -> DataFrame:
    """Title, body, date and language of each document file, as struct ``pdf_article``."""
    return (
        meta.join(joined_pages(pages), KEY, "full")
        .withColumns(
            {
                "_title": tx.remove_nul(tx.tidy_title(F.coalesce("title", F.lit("")))),
                "_body": tx.remove_nul(tx.tidy_body(F.coalesce("text", F.lit("")))),
                "_date": pdf_creation_date(F.col("creation_date")),
            }
        )
        .withColumn("_body", tx.valid_or_null(F.col("_body")))
        .select(
            *KEY,
            F.struct(
                tx.valid_or_null(F.col("_title")).alias("title"),
                F.col("_body").alias("body"),
                F.col("_date").alias("publish_date"),
                F.lit(None).cast("array<string>").alias("authors"),
                language_or_none(F.col("_body"), stop_words, with_language).alias("language"),
                F.lit(None).cast("string").alias("top_image_url"),
                F.lit(None).cast("array<string>").alias("media_urls"),
            ).alias("pdf_article"),
            unreadable_date(F.col("creation_date"), F.col("_date")).alias("pdf_article_date_problem"),
        )
    )
