"""Article fields from the JSON-LD scripts of a page, read as VARIANT.

All ``application/ld+json`` scripts count, in page order; a script may hold one item, a list, or
a ``@graph`` of items. Each field is taken from the first article item that has it. A script that
is not JSON gives nothing, and never fails the page.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.arrays import first_item, let

# ---- fixed values: patterns, and item types that are articles --------------------------
SCRIPT = (
    r"(?is)<script\s[^>]*type\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>"
    r"(.*?)</script\s*>"
)
MARK = "ld+json"
ARTICLE_TYPE = r"(?:Article|BlogPosting|Report|Posting)\"?(?:[,\]]|$)"
# --------------------------------------------------------------------------------------

FIELDS = "struct<headline: string, published: array<string>, authors: array<string>, image: string>"


def _list(item: Column, path: str) -> Column:
    """What is at a path as a list: a list as it is, one value as a list of one, nothing as none."""
    one = F.try_variant_get(item, path, "variant")
    return F.coalesce(
        F.try_variant_get(item, path, "array<variant>"),
        F.when(one.isNotNull(), F.array(one)),
        F.array().cast("array<variant>"),
    )


def _text(item: Column, path: str = "$") -> Column:
    """A string at a path; NULL for anything else."""
    one = F.try_variant_get(item, path, "variant")
    kind = F.schema_of_variant(one)
    return F.when(kind == "STRING", F.try_variant_get(item, path, "string"))


def items(html: Column) -> Column:
    """All items of the page's scripts, as an array of VARIANT."""
    scripts = F.transform(F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(1)), F.try_parse_json)
    listed = F.flatten(
        F.transform(F.filter(scripts, lambda script: script.isNotNull()), lambda script: _list(script, "$"))
    )
    return F.flatten(
        F.transform(
            listed,
            lambda item: F.when(
                F.try_variant_get(item, "$['@graph']", "variant").isNotNull(), _list(item, "$['@graph']")
            ).otherwise(F.array(item)),
        )
    )


def is_article(item: Column) -> Column:
    kind = F.try_variant_get(item, "$['@type']", "string")
    return F.coalesce(kind.rlike(ARTICLE_TYPE), F.lit(False))


def _names(item: Column) -> Column:
    """Author names: strings, or the names of objects, one or a list of them."""

    def of(author: Column) -> Column:
        listed = _list(author, "$.name")
        own = F.array(_text(author))
        return F.concat(F.transform(listed, lambda name: _text(name)), own)

    names = F.flatten(F.transform(_list(item, "$.author"), of))
    return F.filter(F.transform(names, F.btrim), lambda name: name != "")


def _image(item: Column) -> Column:
    """Address of the first image: a string, or the ``url`` of an object."""
    first = first_item(_list(item, "$.image"))
    return F.nullif(F.coalesce(_text(first), _text(first, "$.url")), F.lit(""))


def fields(html: Column) -> Column:
    """(headline, published, authors, image); NULL for a page without such scripts. Dates are all
    that article items give, best first: those of publication, then of creation."""

    def read(found: Column) -> Column:

        def all_of(name: str) -> Column:
            return F.transform(found, lambda item: F.nullif(_text(item, f"$.{name}"), F.lit("")))

        dates = all_of("datePublished"), all_of("dateCreated")
        authors = F.filter(F.transform(found, _names), lambda names: F.size(names) > 0)
        images = F.transform(found, _image)
        return F.struct(
            first_item(F.array_compact(all_of("headline"))).alias("headline"),
            F.array_compact(F.concat(*dates)).alias("published"),
            first_item(authors).alias("authors"),
            first_item(F.array_compact(images)).alias("image"),
        )

    articles = F.filter(items(html), is_article)
    return F.when(html.contains(MARK), let(articles, read))
