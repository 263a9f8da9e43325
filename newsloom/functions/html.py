"""Reading page sources with JVM regular expressions.

These cover what can be told without a tree: titles, bodies, visible text, meta tags,
headings, paragraphs, images and media.  Patterns avoid look-around and back-references
and spell out the blank class, so they mean the same in other engines.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.arrays import let

# ---- fixed values: patterns ----------------------------------------------------------
TITLES = r"(?is)<title[^>]*>(.*?)</title>"
BODIES = r"(?is)<body[^>]*>(.*?)</body>"
HEADING = r"(?is)<h1[^>]*>(.*?)</h1>"
# Rest of a tag: quoted values may hold ">"; a tag with an odd quote ends at the first ">".
TAG_REST = r"(?:[^>\"']*+(?:(?:\"[^\"<]*+\"|'[^'<]*+')[^>\"']*+)*+>|[^>]*>)"
META = r"(?is)<meta\s" + TAG_REST
IMAGE = r"(?is)<img\s" + TAG_REST
MEDIA = r"(?is)<(?:iframe|embed|video|source)\s" + TAG_REST
TIME = r"(?is)<time\s" + TAG_REST
ARTICLE = r"(?is)<article[^>]*>(.*)</article>"
# An attribute's value ends at the quote sign that opened it; without one, at a blank.
VALUE = r"\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
NAME = r"(?i)\s(?:name|property|itemprop)\s*=\s*[\"']?([^\"'\s/>]+)"
CONTENT = r"(?is)\scontent" + VALUE
SOURCE = r"(?is)\ssrc" + VALUE
DATETIME = r"(?is)\sdatetime" + VALUE
CODE = (
    r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
    r"|<template\b.*?(?:</template\s*>|\z)|<!--.*?(?:-->|\z)"
)
TAG = r"(?s)</?[A-Za-z!?][^>]*>"
FURNITURE = (
    r"(?is)<nav\b.*?</nav\s*>|<header\b.*?</header\s*>|<footer\b.*?</footer\s*>"
    r"|<aside\b.*?</aside\s*>|<figure\b.*?</figure\s*>|<form\b.*?</form\s*>"
)
BEFORE_FIRST_PARAGRAPH = r"(?is)^.*?<p(?:\s[^>]*)?>"
NO_ADDRESS = r"(?i)^\s*(?:about|javascript|data|blob):|^\s*#"
ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
# --------------------------------------------------------------------------------------

# Named entities as the standard library has them; a blank that must not break is a blank.
NAMED = {name[:-1]: value for name, value in html5.items() if name.endswith(";")} | {"nbsp": " "}


def titles(html: Column) -> Column:
    """Texts of all title elements, those inside drawings too."""
    return F.regexp_extract_all(html, F.lit(TITLES), F.lit(1))


def bodies(html: Column) -> Column:
    """Contents of all closed body elements."""
    return F.regexp_extract_all(html, F.lit(BODIES), F.lit(1))


def _character(name: Column) -> Column:
    """What an entity stands for (name without ``&`` and ``;``); NULL if there is no such."""
    digits = F.substring(name, 2, 8)
    number = F.when(
        F.lower(F.substring(name, 1, 2)) == "#x", F.conv(F.substring(name, 3, 8), 16, 10)
    ).otherwise(digits)
    code = number.try_cast("int")
    known = (code.between(1, 0xD7FF)) | code.between(0xE000, 0x10FFFF)
    bytes_of = F.unhex(F.lpad(F.hex(F.when(known, code)), 8, "0"))
    named = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")
    return F.when(F.substring(name, 1, 1) == "#", F.decode(bytes_of, "UTF-32")).otherwise(
        F.try_element_at(named, name)
    )


def _decoded(piece: Column) -> Column:
    """A piece of text that followed an ampersand."""
    name = F.regexp_extract(piece, ENTITY, 1)
    character = F.when(name != "", let(name, _character))
    rest = F.substring(piece, F.length(name) + 2, F.length(piece))
    return F.coalesce(F.concat(character, rest), F.concat(F.lit("&"), piece))


def decode_entities(text: Column) -> Column:
    """Decode named and numeric entities, each once; what is none stays as it is."""

    def decode(whole: Column) -> Column:
        pieces = F.split(whole, "&", -1)
        tail = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda piece: let(piece, _decoded))
        return F.when(
            whole.contains("&"), F.concat(F.element_at(pieces, 1), F.array_join(tail, ""))
        ).otherwise(whole)

    return let(text, decode)


def visible_text(html: Column, between_tags: str = "") -> Column:
    """Text without code, comments and tags.  ``between_tags`` replaces each tag."""
    without_code = F.regexp_replace(html, CODE, "")
    return decode_entities(F.regexp_replace(without_code, TAG, between_tags))


def heading(html: Column) -> Column:
    """Text of the first ``<h1>``; empty if there is none."""
    return visible_text(F.regexp_extract(html, HEADING, 1))


def raw_attribute(tag: Column, pattern: str) -> Column:
    """Value of an attribute as it is written, without its quotes; empty if the tag has none."""
    value = F.regexp_extract(tag, pattern, 1)
    quoted = value.startswith('"') | value.startswith("'")
    return F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def attribute(tag: Column, pattern: str) -> Column:
    """Decoded value of an attribute; empty if the tag has none."""
    return decode_entities(raw_attribute(tag, pattern))


def meta_tags(html: Column) -> Column:
    """All meta tags as (names, content), names in lower case, contents as they are written."""
    return F.transform(
        F.regexp_extract_all(html, F.lit(META), F.lit(0)),
        lambda tag: F.struct(
            F.regexp_extract_all(F.lower(tag), F.lit(NAME), F.lit(1)).alias("names"),
            raw_attribute(tag, CONTENT).alias("content"),
        ),
    )


def _named(tags: Column, names: tuple[str, ...]) -> Column:
    wanted = F.array(*(F.lit(name.lower()) for name in names))
    return F.filter(tags, lambda tag: (tag["content"] != "") & F.arrays_overlap(tag["names"], wanted))


def meta_contents(tags: Column, *names: str) -> Column:
    """Contents of all meta tags that have one of the names, in page order, empty ones not."""
    return F.transform(_named(tags, names), lambda tag: decode_entities(tag["content"]))


def meta_content(tags: Column, *names: str) -> Column:
    """Content of the first meta tag that has one of the names; NULL if none has."""
    return decode_entities(F.try_element_at(_named(tags, names), F.lit(1))["content"])


def attribute_values(html: Column, element: str, pattern: str) -> Column:
    """Non-empty values of an attribute over all matching elements, in page order."""
    values = F.transform(
        F.regexp_extract_all(html, F.lit(element), F.lit(0)), lambda tag: attribute(tag, pattern)
    )
    return F.filter(values, lambda value: value != "")


def images(html: Column) -> Column:
    return attribute_values(html, IMAGE, SOURCE)


def first_image(html: Column) -> Column:
    """Source of the first image that has one; NULL if none has. Only that one is decoded."""
    sources = F.transform(
        F.regexp_extract_all(html, F.lit(IMAGE), F.lit(0)), lambda tag: raw_attribute(tag, SOURCE)
    )
    return decode_entities(F.try_element_at(F.filter(sources, lambda source: source != ""), F.lit(1)))


def media(html: Column) -> Column:
    """Sources of embedded players and videos, of the page's own host too."""
    sources = attribute_values(html, MEDIA, SOURCE)
    return F.array_distinct(F.filter(sources, lambda source: ~source.rlike(NO_ADDRESS)))


def without_furniture(html: Column) -> Column:
    """Page source without code, comments, navigation and the like."""
    return F.regexp_replace(F.regexp_replace(html, CODE, ""), FURNITURE, "")


def article_region(clean: Column) -> Column:
    """The ``<article>`` element if there is one, else the first body, else everything."""
    article = F.nullif(F.regexp_extract(clean, ARTICLE, 1), F.lit(""))
    body = F.nullif(F.regexp_extract(clean, BODIES, 1), F.lit(""))
    return F.coalesce(article, body, clean)


def region_text(region: Column) -> Column:
    """Text of a region from its first paragraph on (from its beginning if it has none)."""
    from_paragraph = F.regexp_replace(region, BEFORE_FIRST_PARAGRAPH, "")
    return decode_entities(F.regexp_replace(from_paragraph, TAG, " "))
