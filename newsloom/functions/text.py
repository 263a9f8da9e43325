"""Cleaning of titles, bodies and page sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom import fixed_values as fv


# Runs, and single characters only where they change: most of a text is left alone.
PUNCTUATION = "[.,:|\n ]{2,}|[.,:|\n]"


def collapse_spaces(text: Column) -> Column:
    """Runs of spaces become one space (other blanks stay)."""
    return F.regexp_replace(text, "  +", " ")


def strip_blanks(text: Column) -> Column:
    """Drop blanks of every kind from both ends; ``trim`` alone drops only spaces."""
    return F.btrim(text, F.lit(fv.BLANKS))


def tidied(text: Column, as_space: str) -> Column:
    """Given characters read as spaces, every quote or apostrophe form (double quotes
    included) as ``'``; single spaces; no outer blanks.

    One pass maps all characters: a character class of so many scripts is several times
    slower.
    """
    for escaped in fv.ESCAPED_APOSTROPHES:
        text = F.replace(text, F.lit(escaped), F.lit("'"))
    source, target = as_space + fv.APOSTROPHES, " " * len(as_space) + "'" * len(fv.APOSTROPHES)
    return strip_blanks(collapse_spaces(F.translate(text, source, target)))


def tidy_text(text: Column) -> Column:
    """One line, single spaces, no outer blanks, plain apostrophes."""
    return tidied(text, "\n\t")


def tidy_title(title: Column) -> Column:
    """``tidy_text`` with underscores read as spaces."""
    return tidied(title, "\n\t_")


def tidy_body(body: Column) -> Column:
    return tidy_text(body)


def remove_nul(text: Column) -> Column:
    """Drop NUL characters."""
    return F.replace(text, F.lit("\x00"), F.lit(""))


def is_valid_text(text: Column) -> Column:
    """True for a text that is there, is not empty and is no lorem filler; never NULL."""
    return F.coalesce((text != "") & ~text.contains(fv.LOREM_MARK), F.lit(False))


def valid_or_null(text: Column) -> Column:
    return F.when(is_valid_text(text), text)


def strip_entities(html: Column) -> Column:
    """``&amp;`` becomes ``and``; other entities of up to five characters become a space."""
    spelled = F.replace(html, F.lit("&amp;"), F.lit("and"))
    return F.regexp_replace(spelled, fv.SHORT_ENTITY, " ")


def strip_archive_banner(html: Column) -> Column:
    """Remove the paragraph an archive puts on top of printed copies."""
    return F.regexp_replace(html, fv.ARCHIVE_BANNER, "")


def preprocess_html(html: Column) -> Column:
    """Clean a page source before extraction."""
    return strip_archive_banner(strip_entities(html))


def quality_title(title: Column) -> Column:
    """Form of a title the error phrases are matched against (ends are not trimmed)."""
    plain = F.replace(F.replace(title, F.lit("’"), F.lit("'")), F.lit(".0"), F.lit(" "))
    return F.regexp_replace(plain, PUNCTUATION, " ")


def quality_body(text: Column) -> Column:
    """Form of a body the error phrases are matched against (ends are not trimmed)."""
    return F.regexp_replace(F.replace(text, F.lit("’"), F.lit("'")), PUNCTUATION, " ")


def decode_utf8(data: Column) -> Column:
    """Bytes as text; NULL where they are not valid UTF-8."""
    return F.try_validate_utf8(data.cast("string"))


def encode_utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def is_empty_payload(data: Column) -> Column:
    """True for NULL or zero bytes; works on text and on binary columns."""
    return F.coalesce(F.octet_length(data), F.lit(0)) == 0


def both_empty(raw: Column, reader: Column) -> Column:
    return is_empty_payload(raw) & is_empty_payload(reader)
