"""Cleaning of texts, dates, arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import sql_parts as sp
from newsloom.catalog import tables as tb
from newsloom.catalog.registry import query
from newsloom.catalog.tables import with_tables
from newsloom.functions import arrays, authors, dates
from newsloom.functions import html as page
from newsloom.functions import text as tx
from newsloom.functions.language import guess_language
from newsloom.operators.pdf import joined_pages


@query(f"SELECT doc_id, {sp.tidy('text')} AS body FROM documents")
def tidy_body(spark, folder):
    """STR-a, STR-c."""
    return tb.table(spark, folder, "documents").select(
        "doc_id", tx.tidy_body(F.col("text")).alias("body")
    )


@query(
    f"SELECT page_id, {sp.tidy_title('t')} AS title "
    f"FROM (SELECT page_id, replace({sp.titles('html')}[1], ' ', '_ ') AS t FROM pages)"
)
def tidy_title(spark, folder):
    """STR-b."""
    title = F.replace(arrays.first_item(page.titles(F.col("html"))), F.lit(" "), F.lit("_ "))
    return tb.table(spark, folder, "pages").select(
        "page_id", tx.tidy_title(title).alias("title")
    )


@query(f"SELECT page_id, {sp.preprocess('html')} AS html FROM pages")
def entity_strip(spark, folder):
    """STR-d, STR-e, STR-f."""
    return tb.table(spark, folder, "pages").select(
        "page_id", tx.preprocess_html(F.col("html")).alias("html")
    )


_BANNER = (
    "<p>The Wayback Machine - https://web.archive.org/web/20240101/x</p>"
)


@query(
    f"SELECT page_id, {sp.preprocess(chr(39) + _BANNER + chr(39) + ' || html')} AS html FROM pages"
)
def banner_strip(spark, folder):
    """STR-e: the archive's banner goes, the page stays."""
    html = F.concat(F.lit(_BANNER), F.col("html"))
    return tb.table(spark, folder, "pages").select(
        "page_id", tx.preprocess_html(html).alias("html")
    )


@query(
    f"SELECT doc_id, {sp.quality_title('text')} AS as_title, {sp.quality_body('text')} AS as_body "
    "FROM documents"
)
def quality_forms(spark, folder):
    """STR-g, STR-h: the forms error phrases are matched against."""
    return tb.table(spark, folder, "documents").select(
        "doc_id",
        tx.quality_title(F.col("text")).alias("as_title"),
        tx.quality_body(F.col("text")).alias("as_body"),
    )


@query(
    "SELECT page_id, octet_length(encode(html)) AS n_bytes, md5(html) AS digest, html AS decoded, "
    "false AS is_empty FROM pages"
)
def payload_scan(spark, folder):
    """SRC-7, STR-i, FLT-8: texts to bytes and back."""
    data = tx.encode_utf8(F.col("html"))
    return (
        tb.table(spark, folder, "pages")
        .select("page_id", data.alias("data"))
        .select(
            "page_id",
            F.octet_length("data").cast("bigint").alias("n_bytes"),
            F.md5("data").alias("digest"),
            tx.decode_utf8(F.col("data")).alias("decoded"),
            tx.is_empty_payload(F.col("data")).alias("is_empty"),
        )
    )


@query(
    "SELECT item_id, text AS cleaned FROM benchmark"
)
def nul_removal(spark, folder):
    """STR-j: texts with NUL characters put in, taken out again."""
    dirty = F.concat(F.lit("\x00"), F.replace("text", F.lit(" "), F.lit(" \x00")))
    return tb.table(spark, folder, "benchmark").select(
        "item_id", tx.remove_nul(dirty).alias("cleaned")
    )


@query(
    "SELECT doc_id, doc_id % 5 > 1 AND coalesce(text <> '' AND NOT contains(text, 'Sed ut perspiciatis'), false) "
    "AS valid FROM documents"
)
def valid_text(spark, folder):
    """FLT-10: absent and empty texts, and those with filler before or behind, are not valid."""
    number = F.col("doc_id")
    text = (
        F.when(number % 5 == 0, F.concat(F.lit("Sed ut perspiciatis "), F.coalesce("text", F.lit(""))))
        .when(number % 5 == 1, F.concat(F.coalesce("text", F.lit("")), F.lit(" Sed ut perspiciatis unde")))
        .otherwise(F.col("text"))
    )
    return tb.table(spark, folder, "documents").select(
        "doc_id", tx.is_valid_text(text).alias("valid")
    )


@query(
    "SELECT event_id, make_timestamp(CAST(epoch(date_trunc('second', ts)) AS BIGINT) * 1000000) "
    "AS published, event_id % 2 = 1 AS in_millis, true AS is_epoch FROM events"
)
def date_epoch(spark, folder):
    """DATE-1, DATE-2, DATE-3: epochs in seconds and in milliseconds."""
    second = F.unix_seconds(F.date_trunc("second", "ts").cast("timestamp"))
    number = F.when(F.col("event_id") % 2 == 1, second * 1000).otherwise(second)
    text = F.concat(F.lit(" "), number.cast("string"))
    as_of = F.lit("2024-06-01 00:00:00").cast("timestamp")
    return (
        tb.table(spark, folder, "events")
        .select("event_id", text.alias("text"))
        .select(
            "event_id",
            dates.parse_date(F.col("text"), as_of).alias("published"),
            dates.is_in_millis(F.col("text").try_cast("bigint"), as_of).alias("in_millis"),
            dates.is_epoch(F.col("text")).alias("is_epoch"),
        )
    )


@query(
    """
SELECT event_id,
       CASE event_id % 8
         WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts)
         WHEN 2 THEN date_trunc('minute', ts) WHEN 3 THEN date_trunc('day', ts)
         WHEN 4 THEN date_trunc('day', ts) WHEN 5 THEN date_trunc('second', ts)
         WHEN 6 THEN date_trunc('day', ts) END::TIMESTAMP AS published,
       event_id % 8 = 7 AS unreadable
FROM events"""
)
def date_spelled(spark, folder):
    """DATE-1: written dates; offsets are dropped, what is no date stays NULL."""
    number = F.col("event_id")
    spelled = F.concat(
        F.when(number % 8 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
        .when(number % 8 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"))
        .when(number % 8 == 2, F.date_format("ts", "MMMM d, yyyy HH:mm"))
        .when(number % 8 == 3, F.date_format("ts", "yyyy/MM/dd"))
        .when(number % 8 == 4, F.date_format("ts", "yyyyMMdd"))
        .when(number % 8 == 5, F.date_format("ts", "'Mon, 'd MMM yyyy HH:mm:ss' GMT'"))
        .when(number % 8 == 6, F.date_format("ts", "M/d/yyyy"))
        .otherwise(F.lit("soon")),
    )
    return (
        tb.table(spark, folder, "events")
        .select("event_id", spelled.alias("text"))
        .withColumn("published", dates.parse_date(F.col("text")))
        .select(
            "event_id",
            "published",
            dates.date_error(F.col("text"), F.col("published")).alias("unreadable"),
        )
    )


@query(
    """
SELECT event_id,
       CASE event_id % 7
         WHEN 0 THEN date_trunc('minute', ts) WHEN 1 THEN date_trunc('second', ts)
         WHEN 2 THEN CASE WHEN day(ts) > 12 THEN date_trunc('day', ts)
                          ELSE make_timestamp(year(ts), day(ts), month(ts), 0, 0, 0.0) END
         WHEN 4 THEN date_trunc('day', ts) WHEN 5 THEN date_trunc('second', ts)
         END::TIMESTAMP AS published,
       event_id % 7 IN (3, 6) AS unreadable
FROM events"""
)
def date_edge_cases(spark, folder):
    """DATE-1: half days, zone names, day or month first, short months, ordinals, fourteen
    digits; epochs beyond every year and hours beyond the day give NULL, not an exception."""
    number = F.col("event_id")
    month = F.when(F.month("ts") == 9, F.lit("Sept")).otherwise(F.date_format("ts", "MMM"))
    spelled = (
        F.when(number % 7 == 0, F.date_format("ts", "MMM d, yyyy h:mm a"))
        .when(number % 7 == 1, F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" EST")))
        .when(number % 7 == 2, F.date_format("ts", "d.M.yyyy"))
        .when(
            number % 7 == 3,
            F.concat(F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"), F.lit("000000000")),
        )
        .when(
            number % 7 == 4,
            F.concat(month, F.lit(". "), F.date_format("ts", "d"), F.lit("th "), F.date_format("ts", "yyyy")),
        )
        .when(number % 7 == 5, F.date_format("ts", "yyyyMMddHHmmss"))
        .otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(" 25:61")))
    )
    return (
        tb.table(spark, folder, "events")
        .select("event_id", spelled.alias("text"))
        .withColumn("published", dates.parse_date(F.col("text")))
        .select(
            "event_id",
            "published",
            dates.date_error(F.col("text"), F.col("published")).alias("unreadable"),
        )
    )


@query(
    "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN date_trunc('second', ts)::TIMESTAMP END "
    "AS published FROM events"
)
def pdf_date(spark, folder):
    """DATE-4: creation dates of files."""
    number = F.col("event_id")
    value = (
        F.when(number % 4 == 0, F.date_format("ts", "'D:'yyyyMMddHHmmss'Z'"))
        .when(number % 4 == 1, F.date_format("ts", "'D:'yyyyMMddHHmmss'+01''00'"))
        .when(number % 4 == 2, F.lit(""))
    )
    return tb.table(spark, folder, "events").select(
        "event_id", dates.pdf_creation_date(value).alias("published")
    )


_PARTICLES = (
    "van von der den de del della dei di da das do dos du des la le las los el al bin bint ibn ben "
    "ter ten zu zum zur af av och st"
).split()
_PIECES = (
    "list_filter(regexp_split_to_array(text, "
    "'\\s*[,;|&\\n]\\s*|\\s+(?:and|with|und|mit|et|avec|y|con)\\s+'), lambda p: regexp_matches(p, "
    + sp.quoted(
        r"^(?:\p{Lu}[\p{L}\p{M}.'’\-]*|" + "|".join(_PARTICLES) + r")(?: (?:\p{Lu}[\p{L}\p{M}.'’\-]*|"
        + "|".join(_PARTICLES) + r"))* \p{Lu}[\p{L}\p{M}.'’\-]*$"
        r"|^[\p{Lo}\p{M}]+(?:[ ·・][\p{Lo}\p{M}]+)*$"
    )
    + "))"
)


@query(
    f"SELECT doc_id, array_to_string(nullif({_PIECES}, []), '/') AS names, "
    f"len({_PIECES}) AS n_names FROM documents"
)
def author_rule(spark, folder):
    """EXT-12, AGG-8, ARR-1, STR-k: names by the byline rule, over whole texts."""
    named = tb.table(spark, folder, "documents").select(
        "doc_id", authors.byline_names(F.col("text")).alias("found")
    )
    return named.select(
        "doc_id",
        F.array_join(arrays.null_if_no_items(F.col("found")), "/").alias("names"),
        F.size("found").cast("bigint").alias("n_names"),
    )


def _language_sql() -> str:
    scores = sp.language("text")
    columns = ", ".join(f"{expression} AS s_{code}" for code, expression in scores)
    top = "greatest(" + ", ".join(f"s_{code}" for code, _ in scores) + ")"
    cases = " ".join(f"WHEN s_{code} = {top} THEN '{code}'" for code, _ in scores)
    return (
        f"SELECT doc_id, lang, CASE WHEN {top} > 0 THEN CASE {cases} END "
        f"{sp.script_cases('text')} ELSE 'unknown' END AS guessed "
        f"FROM (SELECT doc_id, lang, text, {columns} FROM documents)"
    )


@query(_language_sql())
def language_guess(spark, folder):
    """EXT-13."""
    return tb.table(spark, folder, "documents").select(
        "doc_id", "lang", guess_language(F.col("text")).alias("guessed")
    )


@query(
    f"SELECT lang, guessed, count(*) AS n_docs FROM ({_language_sql()}) GROUP BY lang, guessed"
)
def language_confusion(spark, folder):
    """EXT-13: guessed against given languages."""
    guessed = language_guess(spark, folder)
    return guessed.groupBy("lang", "guessed").agg(F.count(F.lit(1)).alias("n_docs"))


@query(
    with_tables(
        ["pdf_pages"],
        "SELECT dataset, doc_id, string_agg(text, '' ORDER BY page_no) AS text "
        "FROM pdf_pages GROUP BY dataset, doc_id",
    )
)
def pdf_concat(spark, folder):
    """AGG-6: page texts in page order."""
    return joined_pages(tb.pdf_pages(spark, folder))
