"""URLs, domains, policies, redirects."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import tables as tb
from newsloom.catalog.registry import query
from newsloom.catalog.tables import with_tables
from newsloom.functions import urls
from newsloom.operators.domains import split_domains
from newsloom.operators.policy import is_free, route_label, with_method
from newsloom.operators.redirects import redirect_edges, resolve_redirects
from newsloom.sources.seeds import parse_seed_lines
from newsloom.sources.tables import parse_policy_dump


@query(
    with_tables(
        ["seed"],
        """
SELECT doc_id, unnest(v) AS variant, unnest(range(1, len(v) + 1)) AS variant_no
FROM (SELECT doc_id, CASE WHEN contains(url, 'http') THEN [url]
        ELSE ['http://' || ltrim(url, '/'), 'https://' || ltrim(url, '/')] END AS v FROM seed)""",
    )
)
def url_variants(spark, folder):
    """URL-1, SET-2: one or two addresses per URL."""
    variants = F.posexplode(urls.url_variants(F.col("url"))).alias("position", "variant")
    return tb.seed(spark, folder).select("doc_id", variants).select(
        "doc_id", "variant", (F.col("position") + 1).cast("bigint").alias("variant_no")
    )


@query(
    with_tables(
        ["seed"],
        """
SELECT doc_id, 'http://web.archive.org/cdx/search/cdx?url=' || url AS index_url,
       'about:reader?url=' || url AS reader_url, contains(url, '.pdf') AS is_pdf,
       'https://web.archive.org/web/20240102030405/' || url AS capture_url
FROM seed""",
    )
)
def url_addresses(spark, folder):
    """URL-2, URL-3, URL-4, FLT-6: addresses derived from a URL."""
    url = F.col("url")
    return tb.seed(spark, folder).select(
        "doc_id",
        urls.index_url(url).alias("index_url"),
        urls.reader_url(url).alias("reader_url"),
        urls.is_pdf(url).alias("is_pdf"),
        urls.capture_url(F.lit("20240102030405"), url).alias("capture_url"),
    )


def split_seed(spark, folder):
    return split_domains(tb.clean_seed(spark, folder), tb.suffixes(spark))


@query(
    with_tables(
        ["seed", "suffixes", "hosts", "split"],
        "SELECT dataset, doc_id, host, subdomain, domain, suffix FROM split",
    )
)
def host_split(spark, folder):
    """JOIN-6, URL-6: subdomain, domain label and public suffix, longest suffix first."""
    return split_seed(spark, folder).select(
        "dataset", "doc_id", "host", "subdomain", "domain", "suffix"
    )


def policed_seed(spark, folder):
    split = split_seed(spark, folder)
    return with_method(split, tb.policy(split))


@query(
    with_tables(
        ["seed", "suffixes", "hosts", "split", "policy", "work"],
        "SELECT dataset, doc_id, domain, method FROM work",
    )
)
def domain_policy_join(spark, folder):
    """JOIN-1: the policy of each document's domain."""
    return policed_seed(spark, folder).select("dataset", "doc_id", "domain", "method")


@query(
    with_tables(
        ["seed", "suffixes", "hosts", "split", "policy", "work"],
        """
SELECT CASE WHEN method IS NULL THEN 'UNKNOWN'
            WHEN method = '12ft_ladder' OR method = 'remove_paywall' THEN 'GATED'
            ELSE 'FREE' END AS route,
       coalesce(method NOT IN ('12ft_ladder', 'remove_paywall'), true) AS free,
       count(*) AS n_docs
FROM work GROUP BY ALL""",
    )
)
def route_labels(spark, folder):
    """FLT-7, PLN-1: documents per route."""
    method = F.col("method")
    return (
        policed_seed(spark, folder)
        .groupBy(route_label(method).alias("route"), is_free(method).alias("free"))
        .agg(F.count(F.lit(1)).alias("n_docs"))
    )


@query(
    with_tables(
        ["seed", "suffixes", "hosts", "split", "policy", "work", "templates"],
        "SELECT w.doc_id, replace(t.template, '{url}', ltrim(w.url, '/')) AS location "
        "FROM work w JOIN templates t USING (method)",
    )
)
def policy_locations(spark, folder):
    """URL-5: policy locations from the caller's templates."""
    routed = policed_seed(spark, folder).join(tb.templates(spark), "method")
    location = urls.render_route(F.col("template"), F.col("url"))
    return routed.select("doc_id", location.alias("location"))


@query(
    with_tables(
        ["seed", "suffixes", "hosts", "split", "policy"],
        "SELECT id, subdomain, domain, suffix, method, checked FROM policy",
    )
)
def policy_load(spark, folder):
    """SRC-5: policies read back from the INSERT lines of a dump."""
    policy = tb.policy(split_seed(spark, folder))
    text = [
        F.concat(F.lit("'"), F.col(c), F.lit("'"))
        for c in ("subdomain", "domain", "suffix", "method")
    ]
    values = F.concat_ws(", ", F.col("id").cast("string"), *text, F.col("checked").cast("string"))
    line = F.concat(F.lit("INSERT INTO dbo.url_domain VALUES ("), values, F.lit(");"))
    return parse_policy_dump(policy.select(line.alias("value")))


@query(with_tables(["seed"], "SELECT doc_id AS id, url FROM seed"))
def seed_scan(spark, folder):
    """SRC-1: seed rows from CSV lines."""
    line = F.to_csv(F.struct("doc_id", "url"))
    return parse_seed_lines(tb.seed(spark, folder).select(line.alias("value")))


@query(
    "WITH RECURSIVE "
    + "edges AS ("
    + tb.CTES["edges"]
    + """),
walk AS (
  SELECT from_url, to_url, CAST(1 AS BIGINT) AS hops FROM edges
  UNION ALL
  SELECT w.from_url, e.to_url, w.hops + 1 FROM walk w JOIN edges e ON w.to_url = e.from_url
  WHERE w.hops <= 64),
ends AS (
  SELECT w.from_url, w.to_url, w.hops FROM walk w
  WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.from_url = w.to_url))
SELECT 'u' || p.page_id AS url,
       CASE WHEN x.from_url IS NULL THEN 'u' || p.page_id
            ELSE coalesce(n.to_url, '') END AS final_url,
       CASE WHEN x.from_url IS NULL THEN 0 ELSE n.hops END AS hops
FROM pages p
LEFT JOIN edges x ON x.from_url = 'u' || p.page_id
LEFT JOIN ends n ON n.from_url = 'u' || p.page_id"""
)
def redirect_resolve(spark, folder):
    """URL-8: ends of redirect chains; loops end nowhere."""
    name = F.concat(F.lit("u"), F.col("page_id").cast("string"))
    starts = tb.table(spark, folder, "pages").select(name.alias("url"))
    edges = tb.redirect_edges(spark, folder)
    return resolve_redirects(starts, edges, spread_by=["url"])


@query(
    "SELECT url AS from_url, CASE WHEN page_id % 3 = 0 THEN '/to/' || page_id ELSE '' END AS to_url "
    "FROM pages WHERE page_id % 3 < 2"
)
def redirect_targets(spark, folder):
    """URL-7, URL-8: targets named by simplified pages that redirect; others are no edges. Notices
    stand before whole pages."""
    number = F.col("page_id")
    notice = F.lit("<html><body><p>Redirecting to...</p>")
    link = F.concat(
        F.lit('<div class="content"><p><a href="/to/'), number.cast("string"),
        F.lit('">here</a> or <a href="/elsewhere">there</a></p></div>'),
    )
    html = (
        F.when(number % 3 == 0, F.concat(notice, link, F.col("html")))
        .when(number % 3 == 1, F.concat(notice, F.lit('<div class="content">nowhere</div>'), F.col("html")))
        .otherwise(F.col("html"))
    )
    pages = tb.table(spark, folder, "pages").select("url", html.alias("reader"))
    return redirect_edges(pages)
