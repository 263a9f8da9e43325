"""From page sources to article fields, one struct per view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import blocks, structured
from newsloom.functions import html as page
from newsloom.functions import text as tx
from newsloom.functions.arrays import first_item, null_if_blank, null_if_no_items
from newsloom.functions.authors import detect_authors
from newsloom.functions.dates import date_error, parse_date
from newsloom.functions.html_fields import html_fields
from newsloom.functions.language import guess_language

# ---- fixed values: names a page may give its fields -----------------------------------
DATE_NAMES = [
    "article:published_time",
    "og:published_time",
    "datePublished",
    "publishdate",
    "pubdate",
    "DC.date.issued",
    "date",
]
AUTHOR_NAMES = ["author", "article:author", "byl", "dc.creator"]
URL_DATE = r"/((?:19|20)[0-9]{2})[/\-](0?[1-9]|1[0-2])[/\-](0?[1-9]|[12][0-9]|3[01])(?:/|\-|$)"


def raw_title(html: Column, tags: Column) -> Column:
    """``og:title``, else the title element, else the first heading; not yet tidy."""
    return F.coalesce(
        page.meta_content(tags, "og:title"),
        null_if_blank(page.decode_entities(first_item(page.titles(html)))),
        null_if_blank(page.heading(html)),
    )


def url_date(url: Column) -> Column:
    """A date spelled in the path of a URL, as ``yyyy-M-d``; NULL if there is none."""
    parts = [F.regexp_extract(url, URL_DATE, i) for i in (1, 2, 3)]
    return F.when(url.rlike(URL_DATE), F.concat_ws("-", *parts))


def raw_dates(html: Column, tags: Column, url: Column, item: Column) -> Column:
    """Texts of the publish date: meta tags, then JSON-LD, then ``<time datetime>``, then the URL."""
    times = F.when(
        html.contains("<time") | html.contains("<TIME"),
        page.attribute_values(html, page.TIME, page.DATETIME),
    )
    none = F.array().cast("array<string>")
    parts = [page.meta_contents(tags, *DATE_NAMES), item["published"], times, F.array(url_date(url))]
    found = F.concat(*(F.coalesce(part, none) for part in parts))
    return F.filter(found, lambda text: text.isNotNull())


def first_date(texts: Column, as_of: Column | None) -> Column:
    """The first of the texts that can be read as a date; most pages have a first one that can."""
    first = parse_date(F.try_element_at(texts, F.lit(1)), as_of)
    later = F.transform(F.slice(texts, 2, F.greatest(F.size(texts) - 1, F.lit(0))), lambda text: parse_date(text, as_of))
    later = F.try_element_at(F.filter(later, lambda moment: moment.isNotNull()), F.lit(1))
    return F.coalesce(first, F.when(F.size(texts) > 1, later))


def raw_byline(tags: Column, item: Column | None = None) -> Column:
    """All author tags of a page, else the authors of its JSON-LD, as one byline."""
    tagged = F.nullif(F.array_join(page.meta_contents(tags, *AUTHOR_NAMES), "; "), F.lit(""))
    if item is None:
        return tagged
    return F.coalesce(tagged, F.nullif(F.array_join(item["authors"], "; "), F.lit("")))


def raw_image(html: Column, tags: Column, item: Column) -> Column:
    """``og:image``, else the image of the JSON-LD, else the first image of the page."""
    return F.coalesce(page.meta_content(tags, "og:image"), item["image"], page.first_image(html))


def raw_body(clean: Column, region: Column) -> Column:
    """Text of the best run of blocks; a page without one gives the text of its region."""
    return F.coalesce(page.decode_entities(blocks.main_text(clean)), page.region_text(region))


def unreadable_date(text: Column, parsed: Column) -> Column:
    """What is wrong with a date that was given but not understood; else NULL."""
    return F.when(date_error(text, parsed), F.concat(F.lit("unreadable date: "), text))


def language_or_none(
    body: Column, stop_words: dict[str, str] | None, wanted: bool
) -> Column:
    return guess_language(body, stop_words) if wanted else F.lit(None).cast("string")


def with_raw_article(
    table: DataFrame,
    html: str = "raw",
    url: str = "url",
    name: str = "raw_article",
    as_of: Column | None = None,
    stop_words: dict[str, str] | None = None,
    with_language: bool = True,
) -> DataFrame:
    """Add the article struct of a raw page (NULL fields where the page has none), and
    ``<name>_date_problem`` if it has dates but none that can be read.

    Row by row inside the JVM.  Steps are separate projections so that nothing costly is
    computed twice; the problem stands by itself so that a filter on it needs no article.
    """
    source = null_if_blank(F.col(html))
    return (
        table.withColumn("_html", source)
        .withColumns(
            {
                "_tags": page.meta_tags(F.col("_html")),
                "_clean": page.without_furniture(F.col("_html")),
                "_item": structured.fields(F.col("_html")),
            }
        )
        .withColumns(
            {
                "_region": page.article_region(F.col("_clean")),
                "_title": tx.tidy_title(raw_title(F.col("_html"), F.col("_tags"))),
                "_dates": raw_dates(F.col("_html"), F.col("_tags"), F.col(url), F.col("_item")),
                "_byline": raw_byline(F.col("_tags"), F.col("_item")),
                "_image": raw_image(F.col("_html"), F.col("_tags"), F.col("_item")),
                "_media": page.media(F.col("_html")),
            }
        )
        .withColumns(
            {
                "_body": tx.tidy_body(raw_body(F.col("_clean"), F.col("_region"))),
                "_date": first_date(F.col("_dates"), as_of),
            }
        )
        .withColumn("_body", tx.valid_or_null(F.col("_body")))
        .withColumn(
            name,
            F.when(
                F.col("_html").isNotNull(),
                F.struct(
                    tx.valid_or_null(F.col("_title")).alias("title"),
                    F.col("_body").alias("body"),
                    F.col("_date").alias("publish_date"),
                    detect_authors(F.col("_byline")).alias("authors"),
                    language_or_none(F.col("_body"), stop_words, with_language).alias("language"),
                    null_if_blank(F.col("_image")).alias("top_image_url"),
                    null_if_no_items(F.col("_media")).alias("media_urls"),
                ),
            ),
        )
        .withColumn(
            f"{name}_date_problem",
            unreadable_date(F.try_element_at("_dates", F.lit(1)), F.col("_date")),
        )
        .drop(
            "_html", "_tags", "_clean", "_item", "_region", "_title", "_body", "_dates", "_byline",
            "_image", "_media", "_date",
        )
    )


def with_reader_article(
    table: DataFrame,
    html: str = "reader",
    name: str = "reader_article",
    as_of: Column | None = None,
    stop_words: dict[str, str] | None = None,
    with_language: bool = True,
) -> DataFrame:
    """Add the article struct of a simplified page, from one pass over its source,
    ``<name>_problem`` if it could not be read, and ``<name>_date_problem``.

    Absent title, credits or body make NULL fields and never fail the document.
    """
    fields = F.col("_fields")
    return (
        table.withColumn("_fields", html_fields(null_if_blank(F.col(html))))
        .withColumns(
            {
                "_title": tx.tidy_title(fields["reader_title"]),
                "_body": tx.tidy_body(fields["reader_body"]),
                "_date_text": null_if_blank(fields["reader_time"]),
            }
        )
        .withColumns(
            {
                "_body": tx.valid_or_null(F.col("_body")),
                "_date": parse_date(F.col("_date_text"), as_of),
            }
        )
        .withColumn(
            name,
            F.when(
                fields.isNotNull(),
                F.struct(
                    tx.valid_or_null(F.col("_title")).alias("title"),
                    F.col("_body").alias("body"),
                    F.col("_date").alias("publish_date"),
                    detect_authors(fields["reader_credits"]).alias("authors"),
                    language_or_none(F.col("_body"), stop_words, with_language).alias("language"),
                    null_if_blank(fields["reader_image"]).alias("top_image_url"),
                    F.lit(None).cast("array<string>").alias("media_urls"),
                ),
            ),
        )
        .withColumns(
            {
                f"{name}_problem": fields["error"],
                f"{name}_date_problem": unreadable_date(F.col("_date_text"), F.col("_date")),
            }
        )
        .drop("_fields", "_title", "_body", "_date_text", "_date")
    )
