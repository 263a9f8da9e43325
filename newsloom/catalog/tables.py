"""The engine's tables, derived from the shared test tables; whole tables, every row.

``CTES`` holds the same derivations in SQL; ``with_tables`` puts those a query needs in
front of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.sources.tables import spread

SUFFIXES = ["com", "net", "org", "example.com", "example.net", "example.org"]
TEMPLATES = [
    ("12ft_ladder", "https://first.route.test/{url}"),
    ("remove_paywall", "https://second.route.test/?page={url}"),
]
EMPTY_BODY = "<body><p></p></body>"

CTES: dict[str, str] = {}


def with_tables(names: list[str], body: str) -> str:
    """SQL of a query preceded by the derived tables it names (in order of dependence)."""
    return "WITH " + ",\n".join(f"{name} AS ({CTES[name]})" for name in names) + "\n" + body


TEXT_TABLES = {"pages": "page_id", "documents": "doc_id", "conversations": "conv_id"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows, TEXT_TABLES[name]) if name in TEXT_TABLES else rows


def dataset_of(number: Column) -> Column:
    """Half of all documents share one dataset."""
    return F.when(number % 2 == 0, F.lit("daily")).otherwise(
        F.concat(F.lit("weekly"), (number % 3).cast("string"))
    )


def _dataset_sql(number: str) -> str:
    return f"CASE WHEN {number} % 2 = 0 THEN 'daily' ELSE 'weekly' || ({number} % 3) END"


# -- seeds and policies ------------------------------------------------------------------


def seed(spark: SparkSession, folder: str) -> DataFrame:
    """Work items with all shapes of URLs: no scheme, leading slash, document files."""
    number, url = F.col("page_id"), F.col("url")
    bare = F.when(number % 2 == 0, F.regexp_replace(url, "^https?://", "")).otherwise(url)
    slashed = F.when(number % 6 == 0, F.concat(F.lit("/"), bare)).otherwise(bare)
    filed = F.when(number % 10 == 0, F.concat(slashed, F.lit(".pdf"))).otherwise(slashed)
    return table(spark, folder, "pages").select(
        dataset_of(number).alias("dataset"), number.cast("int").alias("doc_id"), filed.alias("url")
    )


CTES["seed"] = f"""
  SELECT {_dataset_sql('page_id')} AS dataset, CAST(page_id AS INTEGER) AS doc_id,
         CASE WHEN page_id % 6 = 0 THEN '/' ELSE '' END
         || CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '^https?://', '') ELSE url END
         || CASE WHEN page_id % 10 = 0 THEN '.pdf' ELSE '' END AS url
  FROM pages"""


def suffixes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in SUFFIXES], "suffix STRING")


CTES["suffixes"] = "SELECT unnest([" + ", ".join(f"'{s}'" for s in SUFFIXES) + "]) AS suffix"

CTES["hosts"] = """
  SELECT dataset, doc_id, url,
         split_part(split_part(split_part(
           regexp_replace(ltrim(url, '/'), '^https?://', ''), '/', 1), '?', 1), '#', 1) AS host
  FROM seed"""

CTES["split"] = """
  SELECT h.dataset, h.doc_id, h.url, h.host, s.suffix,
         string_split(left(h.host, length(h.host) - length(s.suffix) - 1), '.')[-1] AS domain,
         array_to_string(list_slice(
           string_split(left(h.host, length(h.host) - length(s.suffix) - 1), '.'), 1, -2), '.')
           AS subdomain
  FROM hosts h
  JOIN (SELECT host, arg_max(suffix, length(suffix)) AS suffix
        FROM (SELECT DISTINCT host FROM hosts) d JOIN suffixes s
          ON ends_with(d.host, '.' || s.suffix)
        GROUP BY host) s USING (host)"""


def clean_seed(spark: SparkSession, folder: str) -> DataFrame:
    """Seed without the leading slashes, which hide the host from a URL splitter."""
    return seed(spark, folder).withColumn("url", F.regexp_replace("url", "^/", ""))


def policy(split_seed: DataFrame) -> DataFrame:
    """A policy for most domains, chosen by the length of the label."""
    size = F.length("domain") % 6
    method = (
        F.when(size == 0, "no_method")
        .when(size == 1, "not_possible")
        .when(size == 2, "pending")
        .when(size == 3, "12ft_ladder")
        .otherwise("remove_paywall")
    )
    return (
        split_seed.where(size < 5)
        .groupBy("domain")
        .agg(F.min("doc_id").alias("id"))
        .select(
            "id",
            F.lit("").alias("subdomain"),
            "domain",
            F.lit("com").alias("suffix"),
            method.alias("method"),
            F.lit(True).alias("checked"),
        )
    )


CTES["policy"] = """
  SELECT min(doc_id) AS id, '' AS subdomain, domain, 'com' AS suffix,
         CASE length(domain) % 6 WHEN 0 THEN 'no_method' WHEN 1 THEN 'not_possible'
              WHEN 2 THEN 'pending' WHEN 3 THEN '12ft_ladder' ELSE 'remove_paywall' END AS method,
         true AS checked
  FROM split WHERE length(domain) % 6 < 5 GROUP BY domain"""


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "method STRING, template STRING")


CTES["templates"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', '{t}')" for m, t in TEMPLATES
) + ") AS t(method, template)"

CTES["work"] = """
  SELECT s.dataset, s.doc_id, s.url, s.domain, p.method
  FROM split s LEFT JOIN policy p USING (domain)"""


# -- archive captures ---------------------------------------------------------------------


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """One capture per event; a document per user, and all hours and statuses."""
    number = F.col("event_id")
    status = (
        F.when(F.col("event_type") == "view", "200")
        .when(F.col("event_type") == "click", "301")
        .when(F.col("event_type") == "error", "404")
        .when(F.col("event_type") == "purchase", "500")
        .otherwise("-")
    )
    return table(spark, folder, "events").select(
        dataset_of(F.col("user_id")).alias("dataset"),
        F.col("user_id").cast("int").alias("doc_id"),
        F.concat(F.lit("key"), (number % 7).cast("string")).alias("urlkey"),
        F.date_format("ts", "yyyyMMddHHmmss").alias("timestamp"),
        F.concat(F.lit("http://site.test/"), (number % 5).cast("string")).alias("original"),
        F.lit("text/html").alias("mimetype"),
        status.alias("statuscode"),
        F.concat(F.lit("D"), (number % 50).cast("string")).alias("digest"),
        (number % 1000).cast("string").alias("length"),
    )


CTES["captures"] = f"""
  SELECT {_dataset_sql('user_id')} AS dataset, CAST(user_id AS INTEGER) AS doc_id,
         'key' || (event_id % 7) AS urlkey, strftime(ts, '%Y%m%d%H%M%S') AS "timestamp",
         'http://site.test/' || (event_id % 5) AS original, 'text/html' AS mimetype,
         CASE event_type WHEN 'view' THEN '200' WHEN 'click' THEN '301' WHEN 'error' THEN '404'
              WHEN 'purchase' THEN '500' ELSE '-' END AS statuscode,
         'D' || (event_id % 50) AS digest, CAST(event_id % 1000 AS VARCHAR) AS length
  FROM events"""


def index_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Captures as index lines; every fifth lacks a field, every eleventh has one too many."""
    rows = table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    number = F.col("event_id")
    fields = [
        F.concat(F.lit("key"), (number % 7).cast("string")),
        F.date_format("ts", "yyyyMMddHHmmss"),
        F.lit("http://site.test/"),
        F.lit("text/html"),
        F.lit("200"),
        F.col("event_type"),
    ]
    last = (
        F.when(number % 5 == 0, F.lit(""))
        .when(number % 11 == 0, F.lit(" 12 34"))
        .otherwise(F.lit(" 12"))
    )
    return rows.select(
        F.col("user_id").cast("int").alias("doc_id"),
        F.concat(F.concat_ws(" ", *fields), last).alias("value"),
    )


CTES["index_lines"] = """
  SELECT CAST(user_id AS INTEGER) AS doc_id,
         concat_ws(' ', 'key' || (event_id % 7), strftime(ts, '%Y%m%d%H%M%S'),
                   'http://site.test/', 'text/html', '200', event_type)
         || CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 11 = 0 THEN ' 12 34'
                 ELSE ' 12' END AS value
  FROM events"""


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Logs of up to seven tries per document; errors have no status."""
    number = F.col("event_id")
    status = (
        F.when(F.col("event_type") == "view", 200)
        .when(F.col("event_type") == "click", 503)
        .when(F.col("event_type") == "purchase", 404)
        .when(F.col("event_type") == "signup", 500)
    )
    return table(spark, folder, "events").select(
        F.floor(number / 7).cast("int").alias("doc_id"),
        (number % 7 + 1).cast("int").alias("attempt"),
        status.alias("http_status"),
    )


CTES["attempts"] = """
  SELECT CAST(event_id // 7 AS INTEGER) AS doc_id, CAST(event_id % 7 + 1 AS INTEGER) AS attempt,
         CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 503 WHEN 'purchase' THEN 404
              WHEN 'signup' THEN 500 END AS http_status
  FROM events"""


def variant_results(spark: SparkSession, folder: str) -> DataFrame:
    """Results for the two variants of each document."""
    number, kind = F.col("event_id"), F.col("event_type")
    return table(spark, folder, "events").select(
        F.floor(number / 2).cast("int").alias("doc_id"),
        (number % 2 + 1).cast("int").alias("variant_no"),
        F.when(kind == "error", "no answer").alias("error"),
        F.when(kind == "purchase", 503).otherwise(200).alias("http_status"),
        (F.floor("value") % 3).cast("int").alias("n_captures"),
    )


CTES["variant_results"] = """
  SELECT CAST(event_id // 2 AS INTEGER) AS doc_id, CAST(event_id % 2 + 1 AS INTEGER) AS variant_no,
         CASE WHEN event_type = 'error' THEN 'no answer' END AS error,
         CASE WHEN event_type = 'purchase' THEN 503 ELSE 200 END AS http_status,
         CAST(floor(value) AS INTEGER) % 3 AS n_captures
  FROM events"""


# -- states -------------------------------------------------------------------------------


def status_log(spark: SparkSession, folder: str) -> DataFrame:
    """Four events per document; times are cut to the day so that ``seq`` has to decide."""
    number, kind = F.col("event_id"), F.col("event_type")
    doc = F.floor(number / 4)
    state = (
        F.when(kind == "signup", "PENDING")
        .when(kind == "view", "RETRIEVED")
        .when(kind == "error", "FAILED")
        .when((kind == "click") & (F.col("value") > 20), "PARSED")
        .when((kind == "purchase") & (F.col("value") > 40), "RESCRAPE")
        .otherwise("RETRIEVED")
    )
    return table(spark, folder, "events").select(
        dataset_of(doc).alias("dataset"),
        doc.cast("int").alias("doc_id"),
        number.alias("seq"),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("event_time"),
        state.alias("state"),
    )


CTES["status_log"] = f"""
  SELECT {_dataset_sql('(event_id // 4)')} AS dataset, CAST(event_id // 4 AS INTEGER) AS doc_id,
         event_id AS seq, CAST(date_trunc('day', ts) AS TIMESTAMP) AS event_time,
         CASE WHEN event_type = 'signup' THEN 'PENDING' WHEN event_type = 'view' THEN 'RETRIEVED'
              WHEN event_type = 'error' THEN 'FAILED'
              WHEN event_type = 'click' AND value > 20 THEN 'PARSED'
              WHEN event_type = 'purchase' AND value > 40 THEN 'RESCRAPE'
              ELSE 'RETRIEVED' END AS state
  FROM events"""


def log_work(log: DataFrame) -> DataFrame:
    """The documents of a log as work items."""
    url = F.concat(F.lit("https://site.test/"), F.col("doc_id").cast("string"))
    return log.select("dataset", "doc_id").distinct().withColumn("url", url)


# Flags by ordered scans of the log, one per flag.
CTES["flags"] = """
  SELECT dataset, doc_id, 'https://site.test/' || doc_id AS url,
         coalesce(last(state ORDER BY event_time, seq)
           FILTER (WHERE state IN ('PENDING', 'RETRIEVED', 'FAILED')) = 'FAILED', false) AS is_empty,
         coalesce(last(state ORDER BY event_time, seq)
           FILTER (WHERE state IN ('PENDING', 'RETRIEVED', 'FAILED'))
             IN ('RETRIEVED', 'FAILED'), false) AS is_retrieved,
         count(*) FILTER (WHERE state = 'PARSED') > 0 AS parsed,
         count(*) FILTER (WHERE state = 'RESCRAPE') > 0 AS should_rescrape
  FROM status_log GROUP BY dataset, doc_id"""

CTES["states"] = """
  SELECT dataset, doc_id,
         CASE WHEN parsed THEN 'PARSED' WHEN should_rescrape THEN 'RESCRAPE'
              WHEN is_empty THEN 'FAILED' WHEN is_retrieved THEN 'RETRIEVED'
              ELSE 'PENDING' END AS state
  FROM flags"""


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger rows found in the events: both stages, one stage or none, by dataset."""
    user = F.col("user_id")
    stage = F.when(user % 2 == 0, "raw_new").otherwise("web_archive_new")
    name = F.when(user % 4 < 2, "daily").when(user % 4 == 3, "weekly1").otherwise("older")
    return (
        table(spark, folder, "events")
        .select(name.alias("dataset"), stage.alias("stage"))
        .distinct()
    )


CTES["ledger"] = """
  SELECT DISTINCT CASE WHEN user_id % 4 < 2 THEN 'daily' WHEN user_id % 4 = 3 THEN 'weekly1'
                       ELSE 'older' END AS dataset,
         CASE WHEN user_id % 2 = 0 THEN 'raw_new' ELSE 'web_archive_new' END AS stage
  FROM events"""


# -- page views ---------------------------------------------------------------------------


def raw_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with error titles and bodies mixed in."""
    number, html = F.col("page_id"), F.col("html")
    changed = (
        F.when(number % 9 == 0, F.replace(html, F.lit("<title>"), F.lit("<title>Error 404: ")))
        .when(number % 9 == 1, F.replace(html, F.lit("<title>"), F.lit("<title>Page not found | ")))
        .when(number % 9 == 2, F.replace(html, F.lit("</title>"), F.lit(" please log in</title>")))
        .when(
            number % 9 == 3,
            F.replace(html, F.lit("</h1>"), F.lit("</h1> The page you’re looking for is not here. ")),
        )
        .when(number % 9 == 4, F.replace(html, F.lit("<nav>"), F.lit("<svg><title></title></svg>")))
        .when(number % 9 == 5, F.concat(html, F.lit(EMPTY_BODY)))
        .when(
            number % 9 == 6,
            F.concat(html, F.lit("<a href='https://web.archive.org'>Server error</a></body>")),
        )
        .otherwise(html)
    )
    return table(spark, folder, "pages").select(
        dataset_of(number).alias("dataset"),
        number.cast("int").alias("doc_id"),
        "url",
        changed.alias("html"),
    )


CTES["raw_pages"] = f"""
  SELECT {_dataset_sql('page_id')} AS dataset, CAST(page_id AS INTEGER) AS doc_id, url,
         CASE page_id % 9
           WHEN 0 THEN replace(html, '<title>', '<title>Error 404: ')
           WHEN 1 THEN replace(html, '<title>', '<title>Page not found | ')
           WHEN 2 THEN replace(html, '</title>', ' please log in</title>')
           WHEN 3 THEN replace(html, '</h1>', '</h1> The page you’re looking for is not here. ')
           WHEN 4 THEN replace(html, '<nav>', '<svg><title></title></svg>')
           WHEN 5 THEN html || '{EMPTY_BODY}'
           WHEN 6 THEN html || '<a href=''https://web.archive.org''>Server error</a></body>'
           ELSE html END AS html
  FROM pages"""


def reader_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Simplified pages around the texts of all documents; some lack parts."""
    number = F.col("doc_id")
    text = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    title = F.concat(F.lit("Story_"), number.cast("string"), F.lit("  of “"), "source", F.lit("”"))
    byline = F.concat(
        F.lit('<div class="credits reader-credits">By Ada Vale, '), "source",
        F.lit(" and Ben de Ruy &amp; Carl Oak</div>"),
    )
    stamp = F.concat(
        F.lit('<time datetime="2024-0'), (number % 9 + 1).cast("string"),
        F.lit('-1'), (number % 10).cast("string"), F.lit('T10:20:30+02:00">then</time>'),
    )
    picture = F.concat(F.lit('<img src="/img/'), number.cast("string"), F.lit('.png">'))
    body = F.concat(
        F.lit('<div class="moz-reader-content  reader-show-element"><div><p>'), text,
        F.lit("</p></div>"),
        F.when(number % 4 != 0, stamp).otherwise(F.lit("")),
        F.when(number % 3 != 0, picture).otherwise(F.lit("")),
        F.lit("</div>"),
    )
    html = F.concat(
        F.lit("<html><head><title>"),
        F.when(number % 13 == 0, F.lit("Server error")).otherwise("source"),
        F.lit('</title></head><body><div class="header"><h1 class="wide reader-title">'),
        title,
        F.lit("</h1>"),
        F.when(number % 5 != 0, byline).otherwise(F.lit("")),
        F.lit('</div><hr><div class="content">'),
        F.when(number % 7 != 0, body).otherwise(F.lit("<p>none")),
        F.lit("</div><script>var x = '<p>';</script></body></html>"),
    )
    return table(spark, folder, "documents").select(
        dataset_of(number).alias("dataset"), number.cast("int").alias("doc_id"),
        html.alias("html"),
    )


# -- files ---------------------------------------------------------------------------------


def pdf_pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(
        dataset_of(F.col("conv_id")).alias("dataset"),
        F.col("conv_id").cast("int").alias("doc_id"),
        F.col("turn").cast("int").alias("page_no"),
        "text",
    )


CTES["pdf_pages"] = f"""
  SELECT {_dataset_sql('conv_id')} AS dataset, CAST(conv_id AS INTEGER) AS doc_id,
         CAST(turn AS INTEGER) AS page_no, text
  FROM conversations"""


def pdf_meta(spark: SparkSession, folder: str) -> DataFrame:
    """Titles and creation dates per conversation; some are empty or absent."""
    number = F.col("conv_id")
    title = F.when(number % 4 != 0, F.concat(F.lit(" Report_"), number.cast("string"), F.lit("\x00")))
    created = (
        F.when(number % 3 == 0, F.lit(""))
        .when(
            number % 3 == 1,
            F.concat(
                F.lit("D:202301"), F.lpad((number % 28 + 1).cast("string"), 2, "0"),
                F.lit("124530+01'00'"),
            ),
        )
    )
    return (
        table(spark, folder, "conversations")
        .groupBy("conv_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            dataset_of(number).alias("dataset"), number.cast("int").alias("doc_id"),
            title.alias("title"), created.alias("creation_date"),
        )
    )


CTES["pdf_meta"] = f"""
  SELECT DISTINCT {_dataset_sql('conv_id')} AS dataset, CAST(conv_id AS INTEGER) AS doc_id,
         CASE WHEN conv_id % 4 <> 0 THEN ' Report_' || conv_id END AS title,
         CASE conv_id % 3 WHEN 0 THEN ''
              WHEN 1 THEN 'D:202301' || lpad(CAST(conv_id % 28 + 1 AS VARCHAR), 2, '0')
                          || '124530+01''00''' END AS creation_date
  FROM conversations"""


# -- redirects -----------------------------------------------------------------------------


def redirect_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that point to their neighbours (chains, loops) or all to one place."""
    number = F.col("page_id")
    path = F.concat(F.lit("u"), number.cast("string"))
    target = (
        F.when((number % 3 == 0) & (F.floor(number / 50) % 2 == 0), F.lit("home"))
        .when(number % 40 == 20, F.concat(F.lit("u"), (number - 10).cast("string")))
        .when(number % 47 == 1, F.lit(""))
        .otherwise(F.concat(F.lit("u"), (number + 1).cast("string")))
    )
    moved = ~((number % 38 == 5) | (number % 40 == 10))
    loop = number % 40 == 10
    return (
        table(spark, folder, "pages")
        .where(moved | loop)
        .select(
            path.alias("from_url"),
            F.when(loop, F.concat(F.lit("u"), (number + 10).cast("string")))
            .otherwise(target)
            .alias("to_url"),
        )
    )


CTES["edges"] = """
  SELECT 'u' || page_id AS from_url,
         CASE WHEN page_id % 40 = 10 THEN 'u' || (page_id + 10)
              WHEN page_id % 3 = 0 AND (page_id // 50) % 2 = 0 THEN 'home'
              WHEN page_id % 40 = 20 THEN 'u' || (page_id - 10)
              WHEN page_id % 47 = 1 THEN ''
              ELSE 'u' || (page_id + 1) END AS to_url
  FROM pages WHERE NOT (page_id % 38 = 5) OR page_id % 40 = 10"""
