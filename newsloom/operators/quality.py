"""The page-quality gate: which fetched views are articles and which are error pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom.functions import html as page
from newsloom.functions import text as tx
from newsloom.functions.arrays import let
from newsloom.functions.html_fields import html_fields

# Blanks of every kind; engines differ in what their short form covers.
BLANK = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]"


def _alternatives(phrases: list[str]) -> str:
    return "|".join(phrase.lower().replace(".", "[^\\n]").replace("?", "\\?") for phrase in phrases)


def title_pattern(compatible: bool = False) -> str:
    """Pattern over lower-cased tidy titles, built from the phrase list.

    A phrase has to stand between blanks or ends.  ``compatible`` keeps a slip of older
    rules: a few phrases then count only if a blank follows.
    """
    late = fv.TITLE_PHRASES_BEFORE_BLANK if compatible else []
    usual = [p for p in fv.TITLE_PHRASES if p not in late]
    inner = f"(?:{_alternatives(usual)}|{'|'.join(fv.TITLE_NUMBERS)})(?:{BLANK}|\\z)"
    if late:
        inner = f"(?:{inner}|(?:{_alternatives(late)}){BLANK})"
    return rf"\A{fv.TITLE_WHOLE}\z|(?:\A|{BLANK}){inner}"


def body_pattern(compatible: bool = False) -> str:
    """Pattern over lower-cased tidy body texts; see ``title_pattern``."""
    late = fv.BODY_PHRASES_BEFORE_BLANK if compatible else []
    usual = [p for p in fv.BODY_PHRASES if p not in late]
    if compatible:
        usual = [p for p in usual if p != fv.BODY_PARKED]
    inner = f"(?:{_alternatives(usual)})(?:{BLANK}|\\z)"
    if late:
        inner = f"(?:{inner}|(?:{_alternatives(late)}){BLANK})"
    sign_up = fv.BODY_SIGN_UP.lower()
    if compatible:
        sign_up = f"{sign_up}{BLANK}"
    else:
        sign_up = sign_up.replace("?", "\\??") + f"(?:{BLANK}|\\z)"
    return rf"{sign_up}|(?:\A|{BLANK}){inner}"


def is_bad_title(html: Column, compatible: bool = False) -> Column:
    """No title, an empty one, or one that names an error; titles of drawings count."""
    pattern = title_pattern(compatible)
    titles = page.titles(html)

    def bad(title: Column) -> Column:
        return (title == "") | F.lower(tx.quality_title(title)).rlike(pattern)

    return let(titles, lambda found: (F.size(found) == 0) | F.exists(found, bad))


def is_bad_body_text(text: Column, compatible: bool = False) -> Column:
    return F.lower(tx.quality_body(text)).rlike(body_pattern(compatible))


def is_bad_raw_body(html: Column, compatible: bool = False) -> Column:
    """No closed body, one without text, or one that names an error.

    Copies that mention the archive are taken to have good bodies.
    """
    texts = F.transform(page.bodies(html), lambda body: page.visible_text(body))
    archived = html.contains(fv.ARCHIVE_HOST_MARK)

    def bad(found: Column) -> Column:
        wrong = F.exists(found, lambda text: (text == "") | is_bad_body_text(text, compatible))
        return (F.size(found) == 0) | (~archived & wrong)

    return let(texts, bad)


def is_error_page(html: Column, compatible: bool = False) -> Column:
    """Raw view of an error page."""
    return is_bad_title(html, compatible) | is_bad_raw_body(html, compatible)


def no_permission_mark(compatible: bool = False) -> str:
    return fv.NO_PERMISSION_DOUBLED if compatible else fv.NO_PERMISSION


def is_rejected_raw(html: Column, compatible: bool = False) -> Column:
    """Raw view that must not be stored.  The cheap marker tests come first."""
    return (
        html.contains(fv.NOT_ARCHIVED)
        | html.contains(fv.EXCLUDED)
        | html.contains(no_permission_mark(compatible))
        | is_error_page(html, compatible)
    )


def is_bad_reader_body(fields: Column, compatible: bool = False) -> Column:
    """Simplified view without content box, with an error phrase or with filler text.

    An empty text is allowed.  ``fields`` is the struct made by ``html_fields``.
    """
    text = F.coalesce(fields["content_text"], F.lit(""))
    return (
        ~F.coalesce(fields["has_content"], F.lit(False))
        | is_bad_body_text(text, compatible)
        | tx.quality_body(text).contains(fv.LOREM_MARK)
    )


def is_rejected_reader(html: Column, fields: Column, compatible: bool = False) -> Column:
    """Simplified view that must not be stored."""
    return (
        html.contains(fv.READER_LOADING_ERROR)
        | html.contains(no_permission_mark(compatible))
        | html.contains(fv.READER_ARCHIVE_LOGO)
        | is_bad_title(html, compatible)
        | is_bad_reader_body(fields, compatible)
    )


def gate_views(
    table: DataFrame,
    raw: str = "raw",
    reader: str = "reader",
    compatible: bool = False,
) -> DataFrame:
    """Blank each view that is empty or rejected, one independently of the other.

    Works on text columns.  Simplified views are read once, and only where there is one.
    """
    raw_html, reader_html = F.col(raw), F.col(reader)
    fielded = table.withColumn("_fields", html_fields(F.nullif(reader_html, F.lit(""))))
    bad_raw = tx.is_empty_payload(raw_html) | is_rejected_raw(raw_html, compatible)
    bad_reader = tx.is_empty_payload(reader_html) | is_rejected_reader(
        reader_html, F.col("_fields"), compatible
    )
    return (
        fielded.withColumn("_bad_raw", bad_raw)
        .withColumn("_bad_reader", bad_reader)
        .withColumn(raw, F.when(F.col("_bad_raw"), F.lit("")).otherwise(raw_html))
        .withColumn(reader, F.when(F.col("_bad_reader"), F.lit("")).otherwise(reader_html))
        .drop("_fields", "_bad_raw", "_bad_reader")
    )


def sanitize_pdf(data: Column, compatible: bool = False) -> Column:
    """Bytes of a document file; dropped where they are readable text without an article.

    Real files are not valid UTF-8 and pass; an HTML error page sent instead does not.
    """
    as_text = tx.decode_utf8(data)
    is_text_error = F.coalesce(is_error_page(as_text, compatible), F.lit(False))
    nothing = F.lit(b"").cast("binary")
    return F.when(data.isNull() | is_text_error, nothing).otherwise(data)
