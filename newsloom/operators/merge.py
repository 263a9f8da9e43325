"""Merging the raw and the simplified view of a document, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = (
    "title STRING, body STRING, publish_date TIMESTAMP_NTZ, authors ARRAY<STRING>, "
    "language STRING, top_image_url STRING, media_urls ARRAY<STRING>"
)


def is_empty_article(article: dict[str, Column]) -> Column:
    """True where every field is absent; the language does not count."""
    names = ["title", "body", "publish_date", "authors", "top_image_url", "media_urls"]
    empty = F.lit(True)
    for name in names:
        empty = empty & article[name].isNull()
    return empty


def merged_fields(raw: Column, reader: Column) -> dict[str, Column]:
    """Fields of the merged article from two article structs.

    Title, body, language and authors come from the simplified view, the rest from the raw
    one; what is absent there comes from the other.  Without a simplified body, title and
    language come from the raw view along with the body.
    """
    no_body = reader["body"].isNull()
    return {
        "title": F.when(no_body, raw["title"]).otherwise(F.coalesce(reader["title"], raw["title"])),
        "body": F.coalesce(reader["body"], raw["body"]),
        "publish_date": F.coalesce(raw["publish_date"], reader["publish_date"]),
        "authors": F.coalesce(reader["authors"], raw["authors"]),
        "language": F.when(no_body, raw["language"]).otherwise(
            F.coalesce(reader["language"], raw["language"])
        ),
        "top_image_url": F.coalesce(raw["top_image_url"], reader["top_image_url"]),
        "media_urls": F.coalesce(raw["media_urls"], reader["media_urls"]),
    }


def merge_views(table: DataFrame, raw: str = "raw_article", reader: str = "reader_article") -> DataFrame:
    """Replace two article structs by the merged fields and ``is_empty``."""
    fields = merged_fields(F.col(raw), F.col(reader))
    merged = table.withColumns(fields)
    flag = is_empty_article({name: F.col(name) for name in fields})
    return merged.withColumn("is_empty", flag).drop(
        raw,
        reader,
        *[f"{name}{what}" for name in (raw, reader) for what in ("_problem", "_date_problem")],
    )


def join_views(raw: DataFrame, reader: DataFrame, key: list[str] = ("dataset", "doc_id")) -> DataFrame:
    """Bring views kept in different tables together; a document may have either or both."""
    return raw.join(reader, list(key), "full")
