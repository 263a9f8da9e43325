"""Functions on URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom import fixed_values as fv


def is_pdf(url: Column) -> Column:
    """True where ``.pdf`` (lower case) occurs anywhere in the URL."""
    return url.contains(fv.PDF_MARK)


def without_leading_slash(url: Column) -> Column:
    """Drop one leading slash."""
    return F.when(url.startswith("/"), url.substr(F.lit(2), F.length(url))).otherwise(url)


def url_variants(url: Column, strict_scheme: bool = False) -> Column:
    """The addresses to try for a URL: itself if it names a protocol, else http and https.

    By default any ``http`` in the URL counts as a protocol; ``strict_scheme`` asks for
    ``http://`` or ``https://`` at the start.  An empty URL gives an empty array.
    """
    if strict_scheme:
        has_scheme = F.lower(url).startswith("http://") | F.lower(url).startswith("https://")
    else:
        has_scheme = url.contains("http")
    bare = without_leading_slash(url)
    both = F.array(F.concat(F.lit("http://"), bare), F.concat(F.lit("https://"), bare))
    nothing = F.array().cast("array<string>")
    return (
        F.when(F.coalesce(url, F.lit("")) == "", nothing)
        .when(has_scheme, F.array(url))
        .otherwise(both)
    )


def capture_url(timestamp: Column, original: Column) -> Column:
    """Address of an archived copy."""
    return F.concat(F.lit(fv.CAPTURE_URL_PREFIX), timestamp, F.lit("/"), original)


def index_url(url: Column) -> Column:
    """Address of the archive-index query of a URL."""
    return F.concat(F.lit(fv.INDEX_URL_PREFIX), url)


def reader_url(url: Column) -> Column:
    """Address of the simplified reader view of a URL."""
    return F.concat(F.lit(fv.READER_URL_PREFIX), url)


def render_route(template: Column, url: Column) -> Column:
    """Put a URL into a route template at ``{url}``; NULL where there is no template."""
    return F.replace(template, F.lit("{url}"), url)


def host(url: Column) -> Column:
    """Host of a URL with or without scheme: no user part, no port, no trailing dots."""
    rest = F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.\-]*:)?//", "")
    authority = F.regexp_extract(rest, r"^[^/?#]*", 0)
    name = F.regexp_replace(authority, r"^.*@|:[0-9]*$", "")
    return F.rtrim(name, F.lit("."))


def is_ip_address(host_name: Column) -> Column:
    return host_name.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$|^\[[0-9A-Fa-f:.]+\]$")
