"""Main texts of pages with menus, cards and ads; JSON-LD; learned languages; dates by host.

The pages are built from whole texts and pages of the tables, so what must come out is known."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import sql_parts as sp
from newsloom.catalog import tables as tb
from newsloom.catalog.registry import query
from newsloom.functions import dates, structured
from newsloom.functions import html as page
from newsloom.functions import text as tx
from newsloom.operators import languages, names
from newsloom.operators.date_order import host_order, with_dates
from newsloom.operators.extract import raw_body, with_raw_article
from newsloom.sources.tables import spread

# -- main text ------------------------------------------------------------------------------

MENU = (
    '<div class="menu"><ul><li><a href="/a">Home page</a></li>'
    '<li><a href="/b" title="x > y">All the news</a></li></ul></div>'
)
CARD = (
    '<div class="card"><a href="/c"><h3>Another story</h3>'
    "<div>What else you may want to read today</div></a></div>"
)
AD = '<div class="ad">Buy now and save</div>'
SECOND = "<article><h2>More</h2><p>.</p></article>"
# What the menu costs a run that goes on behind it.
MENU_TOLL = 80


def story_pages(spark, folder):
    """One page for each document, its lines as paragraphs: articles that are doubled or absent,
    with menus, cards and ads around and inside."""
    paragraphs = F.array_join(
        F.transform(
            F.split("text", "\n"),
            lambda x: F.concat(
                F.lit("<p>"),
                F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                F.lit("</p>"),
            ),
        ),
        "",
    )
    story = F.concat(F.lit("<h1>T</h1>"), F.col("story"))
    shapes = [
        [MENU, "<article>", story, "</article>", CARD],
        ["<article>", story, "</article>", AD, SECOND],
        [MENU, '<div class="story">', story, "</div>", CARD, AD],
        ["<article>", story, MENU, F.col("story"), "</article>"],
        ["<article>", story, CARD, AD, "</article>", MENU],
        [MENU, "<div><article>", story, CARD, "</article></div>", AD, SECOND],
    ]
    html = F.lit(None).cast("string")
    for k, parts in enumerate(shapes):
        parts = [F.lit(x) if isinstance(x, str) else x for x in ["<html><body>", *parts, "</body></html>"]]
        html = F.when(F.col("doc_id") % 6 == k, F.concat(*parts)).otherwise(html)
    return (
        tb.table(spark, folder, "documents")
        .withColumn("story", F.when(F.col("text").isNotNull(), paragraphs))
        .select("doc_id", html.alias("html"))
    )


_LINE_CHARS = (
    "list_sum(list_transform(string_split(text, chr(10)), lambda x: "
    "length(trim(replace(replace(x, '&', '&amp;'), '<', '&lt;')))))"
)


@query(
    f"""
SELECT doc_id, CASE WHEN text IS NULL THEN NULL
  WHEN chars = 0 THEN CASE doc_id % 6 WHEN 0 THEN '' WHEN 3 THEN 'Home page All the news'
    WHEN 1 THEN '.' WHEN 5 THEN '.'
    ELSE 'Another story What else you may want to read today Buy now and save' END
  WHEN doc_id % 6 = 3 AND chars > {MENU_TOLL} THEN {sp.tidy("text || ' ' || text")}
  ELSE {sp.tidy("text")} END AS body
FROM (SELECT *, {_LINE_CHARS} AS chars FROM documents)"""
)
def main_body(spark, folder):
    """EXT-8: the best run of blocks, without menus, cards, ads and second articles."""
    clean = page.without_furniture(F.col("html"))
    return (
        story_pages(spark, folder)
        .withColumn("clean", clean)
        .select(
            "doc_id",
            tx.tidy_body(raw_body(F.col("clean"), page.article_region(F.col("clean")))).alias("body"),
        )
    )


# -- JSON-LD --------------------------------------------------------------------------------


def tagged_pages(spark, folder):
    """Pages with JSON-LD: one item, a graph, broken, none, and two scripts with lists."""
    number = F.col("page_id").cast("string")
    month = (F.col("page_id") % 9 + 1).cast("string")

    def script(*parts):
        return F.concat(
            F.lit('<script type="application/ld+json">'),
            *(F.lit(x) if isinstance(x, str) else x for x in parts),
            F.lit("</script>"),
        )

    one = script(
        '{"@context": "https://schema.org", "@type": "NewsArticle", "headline": "Story ', number,
        '", "datePublished": "2024-0', month, '-07T08:09:10+01:00", "author": {"@type": "Person", '
        '"name": "Ada Vale"}, "image": ["/i/', number, '.jpg", "/other.jpg"]}',
    )
    graph = script(
        '{"@graph": [{"@type": "Organization", "name": "Paper", "headline": "none"}, {"@type": ["Thing", '
        '"Article"], "headline": "Story ', number, '", "author": [{"name": "Ada Vale"}, "Ben de Ruy", '
        '{"name": ["Cleo Min"]}], "image": {"url": "/g/', number, '.jpg"}}]}',
    )
    broken = script('{"@type": "NewsArticle", "headline": "x", "author": "Ada Vale"')
    two = F.concat(
        script('[{"@type": "WebSite", "headline": "no"}, 7, null]'),
        script('[{"@type": "BlogPosting", "headline": "Story ', number, '", "dateCreated": "2024-0', month, '-09"}]'),
    )
    which = F.col("page_id") % 5
    scripts = (
        F.when(which == 0, one).when(which == 1, graph).when(which == 2, broken).when(which == 4, two)
    )
    html = F.replace(
        "html", F.lit("</head>"), F.concat(F.coalesce(scripts, F.lit("")), F.lit("</head>"))
    )
    return tb.table(spark, folder, "pages").select("page_id", "url", html.alias("html"))


@query(
    """
SELECT page_id, CASE WHEN page_id % 5 IN (0, 1, 4) THEN 'Story ' || page_id END AS headline,
       CASE page_id % 5 WHEN 0 THEN '2024-0' || (page_id % 9 + 1) || '-07T08:09:10+01:00'
            WHEN 4 THEN '2024-0' || (page_id % 9 + 1) || '-09' END AS published,
       CASE page_id % 5 WHEN 0 THEN 'Ada Vale' WHEN 1 THEN 'Ada Vale/Ben de Ruy/Cleo Min' END AS authors,
       CASE page_id % 5 WHEN 0 THEN '/i/' || page_id || '.jpg' WHEN 1 THEN '/g/' || page_id || '.jpg' END AS image
FROM pages"""
)
def structured_data(spark, folder):
    """EXT-9, EXT-11, EXT-12: article fields of JSON-LD scripts."""
    return (
        tagged_pages(spark, folder)
        .withColumn("item", structured.fields(F.col("html")))
        .select(
            "page_id",
            "item.headline",
            F.try_element_at("item.published", F.lit(1)).alias("published"),
            F.array_join("item.authors", "/").alias("authors"),
            "item.image",
        )
    )


@query(
    """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN make_timestamp(2024, page_id % 9 + 1, 7, 8, 9, 10.0)
            WHEN 4 THEN make_timestamp(2024, page_id % 9 + 1, 9, 0, 0, 0.0) END AS publish_date,
       CASE page_id % 5 WHEN 0 THEN 'Ada Vale' WHEN 1 THEN 'Ada Vale/Ben de Ruy/Cleo Min' END AS authors,
       CASE page_id % 5 WHEN 0 THEN '/i/' || page_id || '.jpg' WHEN 1 THEN '/g/' || page_id || '.jpg' END
         AS top_image_url
FROM pages"""
)
def structured_articles(spark, folder):
    """EXT-9..12: raw articles whose date, authors and image only the JSON-LD gives."""
    article = F.col("raw_article")
    return with_raw_article(tagged_pages(spark, folder), html="html", with_language=False).select(
        "page_id",
        article["publish_date"].alias("publish_date"),
        F.array_join(article["authors"], "/").alias("authors"),
        article["top_image_url"].alias("top_image_url"),
    )


# -- languages ------------------------------------------------------------------------------

FOLDS = 5
_RUNS = f"""
  SELECT {{keep}}, substr(w, i, {languages.LENGTH}) AS run FROM (SELECT {{keep}}, w,
    unnest(range(1, length(w) - {languages.LENGTH - 2})) AS i FROM (SELECT {{keep}}, ' ' || w || ' ' AS w
    FROM (SELECT {{keep}}, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\\p{{{{L}}}}]+'))) AS w
    FROM documents WHERE {{where}}) WHERE w <> ''))"""


def _profiles_sql() -> str:
    learned = _RUNS.replace("{keep}", "lang, doc_id").replace("{{L}}", "L")
    learned = learned.replace("{where}", f"doc_id % {FOLDS} <> 0 AND lang IS NOT NULL")
    asked = _RUNS.replace("{keep}", "doc_id").replace("{{L}}", "L").replace("{where}", "text IS NOT NULL")
    return f"""
WITH counts AS (SELECT lang, run, count(*) AS n FROM ({learned}) GROUP BY lang, run),
placed AS (SELECT lang, run, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, encode(run)) AS place,
  sum(n) OVER (PARTITION BY lang) AS total FROM counts),
profiles AS (SELECT lang, run, ln((n + 0.5) / total) - ln(0.5::DOUBLE / total) AS weight FROM placed
  WHERE place <= {languages.SIZE}),
scores AS (SELECT doc_id, p.lang, sum(weight) AS score FROM ({asked}) JOIN profiles p USING (run) GROUP BY doc_id, p.lang),
best AS (SELECT doc_id, first(lang ORDER BY score DESC, lang) AS guessed FROM scores GROUP BY doc_id)
SELECT doc_id, lang, doc_id % {FOLDS} = 0 AS held_out, coalesce(guessed, 'unknown') AS guessed
FROM documents LEFT JOIN best USING (doc_id)"""


@query(_profiles_sql())
def language_profiles(spark, folder):
    """EXT-13: languages guessed by profiles that four fifths of the documents teach."""
    documents = tb.table(spark, folder, "documents")
    learned = languages.learn(documents.where(F.col("doc_id") % FOLDS != 0), "text", "lang")
    guessed = languages.guess(documents, ["doc_id"], "text", learned).select("doc_id", "guessed")
    return documents.select(
        "doc_id", "lang", (F.col("doc_id") % FOLDS == 0).alias("held_out")
    ).join(guessed, "doc_id")


# -- dates ----------------------------------------------------------------------------------

_ENGLISH, _GERMAN, _FRENCH, _SPANISH, _ITALIAN, _PORTUGUESE, _DUTCH = (
    line.split() for line in dates.MONTHS.strip().splitlines()
)


def _month(names, written=None):
    """The name of the month of ``ts``; ``written`` maps plain names to their spelling."""
    spelled = [(written or {}).get(name, name) for name in names]
    return F.element_at(F.array(*map(F.lit, spelled)), F.month("ts"))


@query(
    """
SELECT event_id,
       CASE event_id % 12
         WHEN 0 THEN date_trunc('minute', ts) WHEN 1 THEN date_trunc('second', ts)
         WHEN 2 THEN date_trunc('day', ts) WHEN 3 THEN date_trunc('minute', ts)
         WHEN 4 THEN date_trunc('day', ts) WHEN 5 THEN date_trunc('minute', ts)
         WHEN 6 THEN date_trunc('day', ts) WHEN 7 THEN date_trunc('hour', ts)
         WHEN 8 THEN date_trunc('day', ts) WHEN 9 THEN date_trunc('minute', ts) END::TIMESTAMP AS published,
       event_id % 12 >= 10 AS unreadable
FROM events"""
)
def date_grammar(spark, folder):
    """DATE-1: months and weekdays of several languages, ordinals, half days, zones, compact
    times; unknown words and days that do not exist give NULL."""
    day, year = F.date_format("ts", "d"), F.date_format("ts", "yyyy")
    german = {"marz": "März", "januar": "Januar"}
    french = {"fevrier": "février", "aout": "août", "decembre": "décembre"}
    spelled = [
        F.concat(F.date_format("ts", "EEEE, MMMM d"), F.lit("th, "), F.date_format("ts", "yyyy 'at' h:mm"),
                 F.when(F.hour("ts") < 12, F.lit(" a.m. EST")).otherwise(F.lit(" p.m. EST"))),
        F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"),
        F.concat(day, F.lit(". "), _month(_GERMAN, german), F.lit(" "), year),
        F.concat(F.lit("lundi "), day, F.lit(" "), _month(_FRENCH, french), F.lit(" "), year, F.lit(" à "),
                 F.date_format("ts", "HH'h'mm")),
        F.concat(day, F.lit(" de "), _month(_SPANISH), F.lit(" de "), year),
        F.concat(F.lit("Sonntag, den "), day, F.lit(". "), F.substr(_month(_GERMAN), F.lit(1), F.lit(3)), F.lit(". "),
                 year, F.lit(" um "), F.date_format("ts", "HH:mm"), F.lit(" Uhr")),
        F.concat(_month(_ITALIAN), F.lit(" "), day, F.lit(", "), year),
        F.concat(year, F.lit(" "), F.date_format("ts", "MMM d, h"), F.date_format("ts", "a")),
        F.concat(day, F.lit(" "), _month(_PORTUGUESE), F.lit(" "), F.date_format("ts", "yy")),
        F.concat(F.lit("zo. "), day, F.lit(" "), _month(_DUTCH), F.lit(" "), F.date_format("ts", "yyyy HH:mm 'CEST'")),
        F.concat(F.lit("posted "), day, F.lit(" "), _month(_ENGLISH), F.lit(" "), year),
        F.concat(F.lit("32 "), _month(_ENGLISH), F.lit(" "), year),
    ]
    text = F.lit(None).cast("string")
    for k, form in enumerate(spelled):
        text = F.when(F.col("event_id") % len(spelled) == k, form).otherwise(text)
    return (
        spread(tb.table(spark, folder, "events"), "event_id")
        .select("event_id", text.alias("text"))
        .withColumn("published", dates.parse_date(F.col("text")))
        .select(
            "event_id", "published", dates.date_error(F.col("text"), F.col("published")).alias("unreadable")
        )
    )


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)"
_DATED = f"""(SELECT page_id, {_HOST} AS host, 1 + page_id % 12 AS m, 1 + page_id * 7 % 28 AS d FROM pages)"""
_WRITTEN = f"(SELECT *, length(host) % 2 = 0 AS by_day FROM {_DATED})"
_VOTES = f"""(SELECT host, count(*) FILTER (by_day AND d > 12) AS day_votes,
  count(*) FILTER (NOT by_day AND d > 12) AS month_votes FROM {_WRITTEN} WHERE d > 12 GROUP BY host)"""


def dated_pages(spark, folder):
    """Pages with numeric dates; hosts with names of even length write the day first."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1)
    month, day = F.col("page_id") % 12 + 1, F.col("page_id") * 7 % 28 + 1
    by_day = F.length(host) % 2 == 0
    text = F.format_string("%d/%d/2024", F.when(by_day, day).otherwise(month), F.when(by_day, month).otherwise(day))
    return tb.table(spark, folder, "pages").select("page_id", host.alias("host"), text.alias("date"))


@query(f"SELECT host, day_votes, month_votes, day_votes > month_votes AS day_first FROM {_VOTES}")
def date_order_votes(spark, folder):
    """DATE-1: what the dates of a host say about the order of day and month."""
    return host_order(dated_pages(spark, folder), "host", "date")


@query(
    f"""
SELECT page_id, CASE WHEN by_day AND NOT coalesce(day_votes > month_votes, false) AND d <= 12
  THEN make_timestamp(2024, d, m, 0, 0, 0.0) ELSE make_timestamp(2024, m, d, 0, 0, 0.0) END AS published
FROM {_WRITTEN} LEFT JOIN {_VOTES} USING (host)"""
)
def dates_by_host(spark, folder):
    """DATE-1: numeric dates read in the order that their host writes."""
    pages = dated_pages(spark, folder)
    return with_dates(pages, "host", "date", "published", spread_by=["page_id"]).select("page_id", "published")


# -- persons --------------------------------------------------------------------------------

_NAMES = ["Ada Vale", "Dan Ash", "Eva Lind", "Finn Moor"]


@query(
    f"""
SELECT page_id, CASE page_id % 5 WHEN 0 THEN [{', '.join(map(repr, _NAMES))}][page_id // 5 % 4 + 1]
  WHEN 1 THEN 'Ben Oak/Cleo Min' WHEN 2 THEN 'Jane Doe/John Roe' END AS authors FROM pages"""
)
def byline_persons(spark, folder):
    """AGG-8, EXT-12: persons of bylines; offices and papers are told by how the documents write
    their words and by the company they keep."""
    number = F.col("page_id")
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.floor(number / 5) % 4 + 1).cast("int"))
    byline = (
        F.when(number % 5 == 0, F.concat(F.lit("By "), name, F.lit(", Staff Writer")))
        .when(number % 5 == 1, "Ben Oak and Cleo Min, New York Times")
        .when(number % 5 == 2, "Jane Doe with John Roe")
        .when(number % 5 == 3, "New York Times")
        .otherwise("Staff Writer")
    )
    bylines = tb.table(spark, folder, "pages").select("page_id", byline.alias("byline"))
    told = F.concat("text", F.lit("\n it says so, the staff writer of the new times is, it says, in York"))
    words = names.word_case(tb.table(spark, folder, "documents").select(told.alias("text")), "text")
    return names.persons(bylines, ["page_id"], "byline", words).select(
        "page_id", F.array_join("authors", "/").alias("authors")
    )
