"""From pages and files to articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import sql_parts as sp
from newsloom.catalog import tables as tb
from newsloom.catalog.registry import query
from newsloom.catalog.tables import CTES, with_tables
from newsloom.functions import html as page
from newsloom.functions import text as tx
from newsloom.functions.authors import detect_authors
from newsloom.functions.html_fields import html_fields
from newsloom.operators.extract import raw_byline, with_raw_article, with_reader_article
from newsloom.operators.merge import is_empty_article, join_views, merge_views
from newsloom.operators.pdf import pdf_articles
from newsloom.plans.parsing import (
    ARTICLE_FIELDS,
    article_rows,
    date_errors,
    dead_letters,
    parse_payload,
    parse_states,
)
from newsloom.plans.retrieval import content_kind

KEY = ["dataset", "doc_id"]


def flat(table, column):
    """An article struct as plain columns that compare well."""
    item = F.col(column)
    return table.select(
        *KEY,
        *[
            F.array_join(item[n], "/").alias(n) if n in ("authors", "media_urls")
            else item[n].alias(n)
            for n in ARTICLE_FIELDS
        ],
    )


def _language(text: str) -> str:
    scores = sp.language(text)
    top = "greatest(" + ", ".join(expression for _, expression in scores) + ")"
    cases = " ".join(f"WHEN {expression} = {top} THEN '{code}'" for code, expression in scores)
    return (
        f"CASE WHEN coalesce({text}, '') = '' THEN 'unknown' WHEN {top} > 0 THEN CASE {cases} END "
        f"{sp.script_cases(text)} ELSE 'unknown' END"
    )


# -- raw views ------------------------------------------------------------------------------

_TAGS = (
    '<meta name="author" content="By Ada Vale and Ben de Ruy, Cleo Min"><meta content="/top/'
)


def meta_pages(spark, folder):
    """Pages with meta tags, an image and players, in changing places."""
    number = F.col("page_id")
    tags = F.concat(
        F.lit(_TAGS),
        number.cast("string"),
        F.lit('.jpg" property="og:image"><meta property="article:published_time" content="2024-0'),
        (number % 9 + 1).cast("string"),
        F.lit('-07T08:09:10+01:00"><meta charset="utf-8">'),
    )
    player = F.concat(
        F.lit('<article><iframe width="1" src="https://www.youtube.com/embed/'),
        number.cast("string"),
        F.lit('"></iframe><iframe src="/local"></iframe>'),
    )
    tagged = F.when(
        number % 2 == 0, F.replace("html", F.lit('<meta charset="utf-8">'), tags)
    ).otherwise(F.col("html"))
    played = F.when(number % 3 == 0, F.replace(tagged, F.lit("<article>"), player)).otherwise(tagged)
    return tb.table(spark, folder, "pages").select(
        tb.dataset_of(number).alias("dataset"),
        number.cast("int").alias("doc_id"),
        "url",
        played.alias("html"),
    )


_CLEAN = sp.preprocess("html")
CTES["cleaned"] = f"""
  SELECT {tb._dataset_sql('page_id')} AS dataset, CAST(page_id AS INTEGER) AS doc_id, url,
         {_CLEAN} AS html FROM pages"""
CTES["raw_text"] = f"""
  SELECT dataset, doc_id, url, {sp.tidy_title(sp.decode_entities(sp.titles('html') + '[1]'))} AS title,
         {sp.tidy(sp.main_text('html'))} AS body FROM cleaned"""
CTES["raw_article"] = f"""
  SELECT dataset, doc_id, url, CASE WHEN {sp.valid('title')} THEN title END AS title,
         CASE WHEN {sp.valid('body')} THEN body END AS body,
         CASE WHEN doc_id % 2 = 0 THEN make_timestamp(2024, doc_id % 9 + 1, 7, 8, 9, 10.0) END
           AS publish_date,
         CASE WHEN doc_id % 2 = 0 THEN ['Ada Vale', 'Ben de Ruy', 'Cleo Min'] END AS authors,
         {_language('body')} AS language,
         CASE WHEN doc_id % 2 = 0 THEN '/top/' || doc_id || '.jpg' END AS top_image_url,
         CASE WHEN doc_id % 3 = 0 THEN ['https://www.youtube.com/embed/' || doc_id, '/local'] END AS media_urls
  FROM raw_text"""
_FLAT = (
    "dataset, doc_id, title, body, publish_date, array_to_string(authors, '/') AS authors, "
    "language, top_image_url, array_to_string(media_urls, '/') AS media_urls"
)
_RAW = ["cleaned", "raw_text", "raw_article"]


def raw_articles_of(spark, folder):
    cleaned = meta_pages(spark, folder).withColumn("raw", tx.preprocess_html(F.col("html")))
    return with_raw_article(cleaned.drop("html"))


@query(with_tables(_RAW, f"SELECT {_FLAT} FROM raw_article"))
def raw_articles(spark, folder):
    """EXT-8..12: all fields of raw pages."""
    return flat(raw_articles_of(spark, folder), "raw_article")


@query(
    "SELECT page_id, " + sp.visible("regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 'is')")
    + f" AS heading, {sp.main_text('html')} AS body FROM pages"
)
def page_parts(spark, folder):
    """EXT-8: headings and article text."""
    return (
        tb.table(spark, folder, "pages")
        .withColumn("clean", page.without_furniture(F.col("html")))
        .select(
            "page_id",
            page.heading(F.col("html")).alias("heading"),
            page.region_text(page.article_region(F.col("clean"))).alias("body"),
        )
    )


# -- simplified views -----------------------------------------------------------------------

CTES["reader_text"] = f"""
  SELECT {tb._dataset_sql('doc_id')} AS dataset, CAST(doc_id AS INTEGER) AS doc_id, source, text,
         CASE WHEN doc_id % 7 <> 0
              THEN {sp.tidy("text || CASE WHEN doc_id % 4 <> 0 THEN 'then' ELSE '' END")} END AS body
  FROM documents"""


def _reader_sql(body: str, ampersand: str) -> str:
    names = f"'Ada Vale/Ben de Ruy {ampersand} Carl Oak'"
    return f"""
  SELECT dataset, doc_id, 'Story ' || doc_id || ' of ''' || source || '''' AS title,
         CASE WHEN {sp.valid(body)} THEN {body} END AS body,
         CASE WHEN doc_id % 7 <> 0 AND doc_id % 4 <> 0
              THEN make_timestamp(2024, doc_id % 9 + 1, 10 + doc_id % 10, 10, 20, 30.0) END
           AS publish_date,
         CASE WHEN doc_id % 5 <> 0 THEN {{authors}} END AS authors,
         {_language(f"(CASE WHEN {sp.valid(body)} THEN {body} END)")} AS language,
         CASE WHEN doc_id % 7 <> 0 AND doc_id % 3 <> 0 THEN '/img/' || doc_id || '.png' END
           AS top_image_url,
         CAST(NULL AS VARCHAR[]) AS media_urls
  FROM reader_text"""


# The byline cuts at "and" and at "&".
CTES["reader_article"] = _reader_sql("body", "&").replace("{authors}", "['Ada Vale', 'Ben de Ruy', 'Carl Oak']")


@query(with_tables(["reader_text", "reader_article"], f"SELECT {_FLAT} FROM reader_article"))
def reader_articles(spark, folder):
    """EXT-2..7, DATE-1, ARR-2, ARR-3: all fields of simplified pages."""
    pages = tb.reader_pages(spark, folder).withColumnRenamed("html", "reader")
    return flat(with_reader_article(pages), "reader_article")


@query(
    "SELECT CAST(doc_id AS INTEGER) AS doc_id, true AS has_content, CASE WHEN doc_id % 7 = 0 THEN 'none' "
    "ELSE text || CASE WHEN doc_id % 4 <> 0 THEN 'then' ELSE '' END END AS content_text, "
    "'' AS first_link FROM documents"
)
def reader_content(spark, folder):
    """UDF-1, URL-7: content box and first link of simplified pages."""
    pages = tb.reader_pages(spark, folder).withColumn("f", html_fields(F.col("html")))
    return pages.select("doc_id", "f.has_content", "f.content_text", "f.first_link")


# -- merging --------------------------------------------------------------------------------

CTES["merged"] = """
  SELECT coalesce(r.dataset, s.dataset) AS dataset, coalesce(r.doc_id, s.doc_id) AS doc_id,
         CASE WHEN s.body IS NULL THEN r.title ELSE coalesce(s.title, r.title) END AS title,
         coalesce(s.body, r.body) AS body,
         coalesce(r.publish_date, s.publish_date) AS publish_date,
         coalesce(s.authors, r.authors) AS authors,
         CASE WHEN s.body IS NULL THEN r.language ELSE coalesce(s.language, r.language) END
           AS language,
         coalesce(r.top_image_url, s.top_image_url) AS top_image_url,
         coalesce(r.media_urls, s.media_urls) AS media_urls
  FROM raw_article r FULL JOIN reader_article s ON r.dataset = s.dataset AND r.doc_id = s.doc_id"""
_EMPTY = (
    "(title IS NULL AND body IS NULL AND publish_date IS NULL AND authors IS NULL "
    "AND top_image_url IS NULL AND media_urls IS NULL) AS is_empty"
)


def _views(spark, folder):
    raw = raw_articles_of(spark, folder).select(*KEY, "raw_article")
    reader = with_reader_article(
        tb.reader_pages(spark, folder).withColumnRenamed("html", "reader")
    ).select(*KEY, "reader_article")
    return join_views(raw, reader)


@query(
    with_tables(
        [*_RAW, "reader_text", "reader_article", "merged"], f"SELECT {_FLAT}, {_EMPTY} FROM merged"
    )
)
def merge_fields(spark, folder):
    """MRG-1..3, JOIN-7: two views of each document merged field by field."""
    return merge_views(_views(spark, folder)).select(
        *KEY,
        "title",
        "body",
        "publish_date",
        F.array_join("authors", "/").alias("authors"),
        "language",
        "top_image_url",
        F.array_join("media_urls", "/").alias("media_urls"),
        "is_empty",
    )


@query(
    with_tables(
        [*_RAW, "reader_text", "reader_article", "merged"],
        f"SELECT is_empty, count(*) AS n_docs FROM (SELECT {_EMPTY} FROM "
        "(SELECT * REPLACE (CASE WHEN doc_id % 2 = 0 THEN title END AS title, "
        "CASE WHEN doc_id % 2 = 0 THEN body END AS body) FROM merged)) GROUP BY is_empty",
    )
)
def empty_article(spark, folder):
    """FLT-12: articles without any field (the language does not count)."""
    merged = merge_views(_views(spark, folder)).drop("is_empty")
    keep = F.col("doc_id") % 2 == 0
    blanked = merged.withColumns(
        {"title": F.when(keep, F.col("title")), "body": F.when(keep, F.col("body"))}
    )
    fields = {name: F.col(name) for name in ARTICLE_FIELDS}
    return blanked.groupBy(is_empty_article(fields).alias("is_empty")).agg(
        F.count(F.lit(1)).alias("n_docs")
    )


# -- files ----------------------------------------------------------------------------------

CTES["pdf_text"] = f"""
  SELECT m.dataset, m.doc_id, {sp.tidy_title("coalesce(m.title, '')")} AS title, m.creation_date,
         {sp.tidy('p.text')} AS body
  FROM pdf_meta m
  JOIN (SELECT dataset, doc_id, string_agg(text, '' ORDER BY page_no) AS text FROM pdf_pages
        GROUP BY dataset, doc_id) p ON m.dataset = p.dataset AND m.doc_id = p.doc_id"""
CTES["pdf_article"] = f"""
  SELECT dataset, doc_id, CASE WHEN {sp.valid('title')} THEN title END AS title,
         CASE WHEN {sp.valid('body')} THEN body END AS body,
         CASE WHEN creation_date <> ''
              THEN strptime(substr(creation_date, 3, 14), '%Y%m%d%H%M%S') END AS publish_date,
         CAST(NULL AS VARCHAR[]) AS authors, {_language('body')} AS language,
         CAST(NULL AS VARCHAR) AS top_image_url, CAST(NULL AS VARCHAR[]) AS media_urls
  FROM pdf_text"""
_FILES = ["pdf_pages", "pdf_meta", "pdf_text", "pdf_article"]


@query(with_tables(_FILES, f"SELECT {_FLAT} FROM pdf_article"))
def pdf_articles_of(spark, folder):
    """EXT-14, AGG-6, DATE-4, STR-j: articles of document files."""
    return flat(
        pdf_articles(tb.pdf_meta(spark, folder), tb.pdf_pages(spark, folder)), "pdf_article"
    )


# -- the whole parse job ----------------------------------------------------------------------


def payload(spark, folder):
    """Payloads of all kinds: both views, one of them, files, nothing, broken bytes."""
    number = F.col("doc_id")
    raw = meta_pages(spark, folder).select(*KEY, "url", F.col("html").alias("raw_html"))
    reader = tb.reader_pages(spark, folder).select(*KEY, F.col("html").alias("reader_html"))
    joined = raw.join(reader, KEY, "full")
    is_file = number % 10 == 4
    raw_bytes = (
        F.when(number % 11 == 5, F.lit(""))
        .otherwise(F.coalesce("raw_html", F.lit("")))
        .cast("binary")
    )
    raw_bytes = F.when(number % 100 == 99, F.lit(b"\xff\xff")).otherwise(raw_bytes)
    reader_bytes = (
        F.when((number % 6 == 1) | is_file, F.lit(""))
        .otherwise(F.coalesce("reader_html", F.lit("")))
        .cast("binary")
    )
    url = F.coalesce("url", F.lit("http://site.test/page"))
    filled = joined.select(
        *KEY,
        F.when(is_file, F.concat(url, F.lit(".pdf"))).otherwise(url).alias("url"),
        raw_bytes.alias("raw"),
        reader_bytes.alias("reader"),
    )
    kind = content_kind(F.col("url"), F.col("raw"), F.col("reader"))
    return filled.withColumn("content_kind", kind)


# In this job both views are cleaned before they are read, so "&amp;" reads "and".
CTES["reader_clean"] = f"""
  SELECT dataset, doc_id, source,
         CASE WHEN doc_id % 7 <> 0 THEN {sp.tidy(
             "replace(text, '&', 'and') || CASE WHEN doc_id % 4 <> 0 THEN 'then' ELSE '' END"
         )} END AS body
  FROM reader_text"""
CTES["reader_parsed"] = (
    _reader_sql("body", "and")
    .replace("{authors}", "['Ada Vale', 'Ben de Ruy', 'Carl Oak']")
    .replace("FROM reader_text", "FROM reader_clean")
)
CTES["kinds"] = """
  SELECT coalesce(r.dataset, s.dataset) AS dataset, coalesce(r.doc_id, s.doc_id) AS doc_id,
         coalesce(r.doc_id, s.doc_id) % 100 = 99 AS broken,
         coalesce(r.doc_id, s.doc_id) % 10 = 4 AS is_file,
         r.doc_id IS NOT NULL AND coalesce(r.doc_id, s.doc_id) % 11 <> 5 AS has_raw,
         s.doc_id IS NOT NULL AND coalesce(r.doc_id, s.doc_id) % 6 <> 1
           AND coalesce(r.doc_id, s.doc_id) % 10 <> 4 AS has_reader
  FROM raw_article r FULL JOIN reader_parsed s ON r.dataset = s.dataset AND r.doc_id = s.doc_id"""
CTES["views"] = """
  SELECT k.dataset, k.doc_id, k.broken,
         CASE WHEN k.is_file AND k.has_raw THEN 'PDF' WHEN k.is_file THEN 'NONE'
              WHEN k.has_raw AND k.has_reader THEN 'BOTH' WHEN k.has_raw THEN 'RAW'
              WHEN k.has_reader THEN 'READER' ELSE 'NONE' END AS kind,
         CASE WHEN k.is_file AND k.has_raw THEN p WHEN NOT k.is_file AND k.has_raw THEN r END AS a,
         CASE WHEN k.has_reader THEN s END AS b, p.doc_id IS NULL AS no_pages
  FROM kinds k
  LEFT JOIN (SELECT dataset, doc_id, title, body, publish_date, authors, language, top_image_url,
                    media_urls FROM raw_article) r
    ON r.dataset = k.dataset AND r.doc_id = k.doc_id
  LEFT JOIN reader_parsed s ON s.dataset = k.dataset AND s.doc_id = k.doc_id
  LEFT JOIN pdf_article p ON p.dataset = k.dataset AND p.doc_id = k.doc_id"""
CTES["parsed"] = """
  SELECT dataset, doc_id, kind,
         CASE WHEN b.body IS NULL AND a IS NOT NULL THEN a.title ELSE coalesce(b.title, a.title) END
           AS title,
         coalesce(b.body, a.body) AS body,
         coalesce(a.publish_date, b.publish_date) AS publish_date,
         coalesce(b.authors, a.authors) AS authors,
         CASE WHEN b.body IS NULL AND a IS NOT NULL THEN a.language
              ELSE coalesce(b.language, a.language) END AS language,
         coalesce(a.top_image_url, b.top_image_url) AS top_image_url,
         coalesce(a.media_urls, b.media_urls) AS media_urls
  FROM views WHERE NOT broken AND NOT (kind = 'PDF' AND no_pages)"""
_PARSE = [
    *_RAW, "reader_text", "reader_clean", "reader_parsed", *_FILES, "kinds", "views", "parsed",
]


def parsed(spark, folder):
    return parse_payload(
        payload(spark, folder), tb.pdf_meta(spark, folder), tb.pdf_pages(spark, folder)
    )


def flat_rows(articles):
    return articles.withColumns(
        {c: F.array_join(c, "/") for c in ("authors", "media_urls")}
    )


@query(with_tables(_PARSE, f"SELECT {_FLAT}, {_EMPTY} FROM parsed"))
def parse_job(spark, folder):
    """EXT-15, MRG-3, MRG-4, FLT-11, PRJ-2: articles of all kinds of payloads."""
    return flat_rows(article_rows(parsed(spark, folder)))


@query(
    with_tables(
        _PARSE,
        """
SELECT dataset, doc_id, 'parse' AS step,
       CASE WHEN kind = 'PDF' AND no_pages THEN 'no extracted page texts'
            ELSE 'payload is not valid UTF-8' END AS error
FROM views WHERE (broken AND kind <> 'PDF') OR (kind = 'PDF' AND no_pages)""",
    )
)
def parse_failures(spark, folder):
    """STM-5: documents that could not be parsed, with the reason."""
    return dead_letters(parsed(spark, folder))


@query(
    with_tables(
        _PARSE,
        """
SELECT kind AS content_kind, count(*) AS n_docs,
       count(*) FILTER (WHERE kind = 'NONE') AS n_rescrape, count(*) AS n_parsed
FROM parsed GROUP BY kind""",
    )
)
def parse_log(spark, folder):
    """MRG-4, AGG-4, PLN-6: log entries of the parse job by kind of content."""
    written = parsed(spark, folder).where(F.col("error").isNull())
    states = written.select(
        "content_kind", F.explode(parse_states(F.col("content_kind"))).alias("state")
    )
    return states.groupBy("content_kind").agg(
        F.count_if(F.col("state") == "PARSED").alias("n_docs"),
        F.count_if(F.col("state") == "RESCRAPE").alias("n_rescrape"),
        F.count_if(F.col("state") == "PARSED").alias("n_parsed"),
    )


_HAS_RAW = "(has_raw OR broken)"


@query(
    with_tables(
        [*_RAW, "reader_text", "reader_clean", "reader_parsed", "kinds"],
        f"""
SELECT CASE WHEN is_file AND {_HAS_RAW} THEN 'PDF' WHEN is_file THEN 'NONE'
            WHEN {_HAS_RAW} AND has_reader THEN 'BOTH' WHEN {_HAS_RAW} THEN 'RAW'
            WHEN has_reader THEN 'READER' ELSE 'NONE' END AS content_kind,
       NOT {_HAS_RAW} AS raw_empty, NOT has_reader AS reader_empty,
       NOT {_HAS_RAW} AND NOT has_reader AS both_empty, count(*) AS n_docs
FROM kinds GROUP BY ALL""",
    )
)
def content_kinds(spark, folder):
    """FLT-8, FLT-9, FLT-11: documents by what is stored of them."""
    raw, reader = F.col("raw"), F.col("reader")
    return (
        payload(spark, folder)
        .groupBy(
            "content_kind",
            tx.is_empty_payload(raw).alias("raw_empty"),
            tx.is_empty_payload(reader).alias("reader_empty"),
            tx.both_empty(raw, reader).alias("both_empty"),
        )
        .agg(F.count(F.lit(1)).alias("n_docs"))
    )


@query(
    with_tables(
        _PARSE,
        f"SELECT dataset, count(*) AS n_rows, count(title) AS n_titles, count(body) AS n_bodies, "
        "count(publish_date) AS n_dates, count(authors) AS n_authors, count(language) AS n_languages, "
        "count(top_image_url) AS n_images, count(media_urls) AS n_media, "
        f"count(*) FILTER (WHERE is_empty) AS n_empty FROM (SELECT *, {_EMPTY} FROM parsed) "
        "GROUP BY dataset",
    )
)
def article_coverage(spark, folder):
    """PRJ-2, AGG-1: how complete the articles of each dataset are."""
    names = {
        "title": "n_titles", "body": "n_bodies", "publish_date": "n_dates", "authors": "n_authors",
        "language": "n_languages", "top_image_url": "n_images", "media_urls": "n_media",
    }
    counts = [F.count(column).alias(name) for column, name in names.items()]
    return article_rows(parsed(spark, folder)).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_rows"), *counts, F.count_if("is_empty").alias("n_empty")
    )


@query(
    with_tables(
        ["reader_text"],
        """
SELECT dataset, doc_id, 'unreadable date: soon, no. ' || doc_id AS date_error
FROM reader_text WHERE doc_id % 7 <> 0 AND doc_id % 4 <> 0 AND doc_id % 3 = 0""",
    )
)
def article_date_errors(spark, folder):
    """DATE-1, STM-5: a date that cannot be read costs the date, not the article."""
    pages = tb.reader_pages(spark, folder)
    soon = F.concat(F.lit('datetime="soon, no. '), F.col("doc_id").cast("string"), F.lit('"'))
    spoilt = F.when(
        F.col("doc_id") % 3 == 0, F.regexp_replace("html", F.lit('datetime="[^"]*"'), soon)
    ).otherwise(F.col("html"))
    stored = pages.select(
        *KEY, F.lit("http://site.test/page").alias("url"),
        F.lit(b"").alias("raw"), F.encode(spoilt, "UTF-8").alias("reader"),
    )
    return date_errors(parse_payload(stored))


@query(
    "SELECT page_id, 'It''s page ' || page_id || ' of \"' || (page_id % 5) || '\" & café' AS title, "
    "'/i' || page_id || '.png?a=1&b=2' AS image, 'Ana Vale/Ben de Ruy/Cleo Min Lopez Garcia Perez' "
    "AS authors FROM pages"
)
def meta_values(spark, folder):
    """EXT-8, EXT-10, EXT-12: values in either quotes or none, entities, several author tags."""
    number = F.col("page_id").cast("string")
    tags = F.concat(
        F.lit('<meta property="og:title" content="It\'s page '), number, F.lit(" of &quot;"),
        (F.col("page_id") % 5).cast("string"), F.lit("&quot; &amp; caf&eacute;\"><meta property='og:image' content=/i"),
        number, F.lit(".png?a=1&amp;b=&#x32;><meta name=author content='Ana Vale'>"),
        F.lit('<meta content="Ben de Ruy and Cleo Min Lopez Garcia Perez" name="author">'),
    )
    tagged = F.replace("html", F.lit('<meta charset="utf-8">'), tags)
    return (
        tb.table(spark, folder, "pages")
        .select("page_id", page.meta_tags(tagged).alias("tags"))
        .select(
            "page_id",
            page.meta_content(F.col("tags"), "og:title").alias("title"),
            page.meta_content(F.col("tags"), "og:image").alias("image"),
            F.array_join(detect_authors(raw_byline(F.col("tags"))), "/").alias("authors"),
        )
    )
