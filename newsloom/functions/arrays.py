"""Small helpers on arrays and optional strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_if_no_items(items: Column) -> Column:
    """An empty array counts as absent."""
    return F.when(F.size(items) > 0, items)


def null_if_blank(text: Column) -> Column:
    """An empty string counts as absent."""
    return F.nullif(text, F.lit(""))


def first_item(items: Column) -> Column:
    """First element or NULL."""
    return F.try_element_at(items, F.lit(1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]
