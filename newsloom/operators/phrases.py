"""The quality gate with a caller's table of error phrases.

All phrases are found in one pass by an Aho-Corasick automaton, so ten thousand phrases cost what
fifty do; the built-in lists go through regular expressions of the JVM instead
(``operators.quality``), which is cheaper for few.

A phrase row is (scope, phrase, start_anchor, end_anchor). Scope is ``title`` or ``body``. In a
phrase ``.`` stands for any character but a line end and ``#`` for a digit; case does not count.
Anchors say what has to stand before and behind: ``blank`` (a blank or the end of the text),
``blank_only`` (a blank), ``end`` (the end of the text) or ``any``.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom.functions import html as page
from newsloom.functions import text as tx
from newsloom.operators.quality import no_permission_mark

SCHEMA = "scope STRING, phrase STRING, start_anchor STRING, end_anchor STRING"
ANCHORS = ["blank", "blank_only", "end", "any"]
# Bounds of a phrase table, which goes to every executor.
MOST_PHRASES = 1_000_000
MOST_CHARACTERS = 64 * 1024 * 1024

# The blanks of ``quality.BLANK``.
BLANKS = frozenset(
    {*"\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85"}
    | {chr(c) for c in range(0x3001) if unicodedata.category(chr(c)).startswith("Z")}
)
# One automaton per phrase list in a worker.
_finders: dict[str, Callable[[str], bool]] = {}


def built_in() -> list[tuple[str, str, str, str]]:
    """The built-in phrases as rows of such a table."""
    numbers = [n.replace("[0-9]{2}", "##").replace("[^\\n]", ".") for n in fv.TITLE_NUMBERS]
    rows = [("title", p, "blank", "blank") for p in [*fv.TITLE_PHRASES, *numbers]]
    rows.append(("title", fv.TITLE_WHOLE, "end", "end"))
    rows += [("body", p, "blank", "blank") for p in fv.BODY_PHRASES]
    return rows + [("body", p, "any", "blank") for p in (fv.BODY_SIGN_UP, fv.BODY_SIGN_UP.replace("?", ""))]


def _key(phrase: str) -> tuple[str, int]:
    """The longest run of plain characters of a phrase and where it begins."""
    best, start = "", 0
    at = 0
    for run in phrase.replace("#", ".").split("."):
        if len(run) > len(best):
            best, start = run, at
        at += len(run) + 1
    return best, start


def _fits(text: str, at: int, phrase: str) -> bool:
    if at < 0 or at + len(phrase) > len(text):
        return False
    for a, b in zip(text[at : at + len(phrase)], phrase):
        if a != b and not (b == "." and a != "\n") and not (b == "#" and "0" <= a <= "9"):
            return False
    return True


def _stands(text: str, at: int, anchor: str) -> bool:
    """Whether what is next to a phrase is what its anchor asks for; ``at`` may lie outside."""
    outside = at < 0 or at >= len(text)
    if anchor == "any":
        return True
    if anchor == "end":
        return outside
    if outside:
        return anchor == "blank"
    return text[at] in BLANKS


def finder(rows: list[tuple[str, str, str]]) -> Callable[[str], bool]:
    """A function that tells whether a lower-case text holds one of the phrases (phrase,
    start_anchor, end_anchor)."""
    import ahocorasick

    by_key: dict[str, list[tuple[str, int, str, str]]] = {}
    for phrase, before, behind in rows:
        phrase = phrase.lower()
        key, start = _key(phrase)
        if not key:
            raise ValueError(f"a phrase without a plain character: {phrase!r}")
        by_key.setdefault(key, []).append((phrase, start, before, behind))
    if not by_key:
        return lambda text: False
    automaton = ahocorasick.Automaton()
    for key, found in by_key.items():
        automaton.add_word(key, (len(key), found))
    automaton.make_automaton()

    def holds(text: str) -> bool:
        for last, (length, phrases) in automaton.iter(text):
            for phrase, start, before, behind in phrases:
                at = last - length + 1 - start
                if (
                    _fits(text, at, phrase)
                    and _stands(text, at - 1, before)
                    and _stands(text, at + len(phrase), behind)
                ):
                    return True
        return False

    return holds


class PhraseGate:
    """Phrases of a table, broadcast once, and the gate's questions asked with them."""

    def __init__(self, spark: SparkSession, phrases: DataFrame):
        size = phrases.agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("phrase")), F.lit(0)).alias("chars")
        ).first()
        if size["n"] > MOST_PHRASES or size["chars"] > MOST_CHARACTERS:
            raise ValueError(f"{size['n']} phrases of {size['chars']} characters are too many to broadcast")
        rows = [tuple(r) for r in phrases.select("scope", "phrase", "start_anchor", "end_anchor").collect()]
        for _, phrase, before, behind in rows:
            if not phrase or before not in ANCHORS or behind not in ANCHORS:
                raise ValueError(f"not a phrase: {(phrase, before, behind)!r}")
        self._holds = {scope: _holds_any(spark, [r[1:] for r in rows if r[0] == scope]) for scope in ("title", "body")}

    def is_bad_title(self, html: Column) -> Column:
        """No title, an empty one, or one with a phrase; titles of drawings count."""

        def bad(found: Column) -> Column:
            forms = F.transform(found, lambda title: F.lower(tx.quality_title(title)))
            return (F.size(found) == 0) | F.exists(found, lambda title: title == "") | self._holds["title"](forms)

        return bad(page.titles(html))

    def is_bad_raw_body(self, html: Column) -> Column:
        """No closed body, one without text, or one with a phrase; see ``quality``."""
        texts = F.transform(page.bodies(html), lambda body: page.visible_text(body))
        forms = F.transform(texts, lambda text: F.lower(tx.quality_body(text)))
        wrong = F.exists(texts, lambda text: text == "") | self._holds["body"](forms)
        return (F.size(texts) == 0) | (~html.contains(fv.ARCHIVE_HOST_MARK) & wrong)

    def is_rejected_raw(self, html: Column, compatible: bool = False) -> Column:
        """Raw view that must not be stored."""
        return (
            html.contains(fv.NOT_ARCHIVED)
            | html.contains(fv.EXCLUDED)
            | html.contains(no_permission_mark(compatible))
            | self.is_bad_title(html)
            | self.is_bad_raw_body(html)
        )


def _holds_any(spark: SparkSession, rows: list[tuple[str, str, str]]) -> Callable[[Column], Column]:
    """Column function: whether one of an array of lower-case texts holds a phrase."""
    shared = spark.sparkContext.broadcast(rows)
    name = uuid.uuid4().hex

    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        find = _finders.get(name)
        if find is None:
            find = _finders[name] = finder(shared.value)
        return texts.map(lambda found: found is not None and any(find(t) for t in found if t is not None))

    return holds
