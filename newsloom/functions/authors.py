"""Author names from a byline.

A rule, all in expressions: drop a leading "by", cut at separators, keep the pieces
that look like a person's name: two or more words, capitalised or particles, the last one
capitalised; or words of a script without case.  Order and repeats are
kept.  ``model_authors`` plugs in a named-entity model of the user's choice instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.arrays import null_if_no_items

# ---- fixed values: patterns ----------------------------------------------------------
LEAD_IN = r"^\s*(?:[Bb]y|BY|[Vv]on|VON|[Pp]ar|PAR|[Pp]or|POR)\s+"
SEPARATOR = r"\s*[,;|&\n]\s*|\s+(?:and|with|und|mit|et|avec|y|con)\s+"
PARTICLE = (
    "(?:van|von|der|den|de|del|della|dei|di|da|das|do|dos|du|des|la|le|las|los|el|al|bin|bint|ibn"
    "|ben|ter|ten|zu|zum|zur|af|av|och|st)"
)
CAPITALISED = r"\p{Lu}[\p{L}\p{M}.'’\-]*+"
# Repeated groups are possessive: nothing they take is given back, and Java matches them in a loop.
# Otherwise it calls itself for each word, and a long piece overflows the stack of its task.
NAME = (
    rf"^(?:(?:{CAPITALISED}|{PARTICLE}) )++{CAPITALISED}$"
    r"|^[\p{Lo}\p{M}]++(?:[ ·・][\p{Lo}\p{M}]++)*+$"
)
# --------------------------------------------------------------------------------------


def byline_names(byline: Column) -> Column:
    """All names of a byline, as an array that may be empty."""
    pieces = F.split(F.regexp_replace(byline, LEAD_IN, ""), SEPARATOR)
    return F.filter(pieces, lambda piece: piece.rlike(NAME))


def detect_authors(byline: Column) -> Column:
    """Names of a byline; NULL where there are none."""
    return null_if_no_items(byline_names(byline))


def model_authors(load_model: Callable[[], Callable[[str], list[str]]]):
    """UDF over a user's model: ``load_model`` runs once per worker and returns a function
    from a text to the names found in it."""

    @F.pandas_udf("array<string>")
    def names(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = load_model()
        for batch in batches:
            found = [None if text is None else list(find(text)) or None for text in batch]
            yield pd.Series(found, index=batch.index, dtype=object)

    return names
