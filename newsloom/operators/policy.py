"""Domain policies: which route a document takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom.operators.lookup import fits_broadcast, join_lookup


def is_free(method: Column) -> Column:
    """True unless the method is a gated one; every other label counts as free."""
    return F.coalesce(~method.isin(fv.GATED_METHODS), F.lit(True))


def route_label(method: Column) -> Column:
    """``UNKNOWN`` for domains without a policy, else ``FREE`` or ``GATED``."""
    return (
        F.when(method.isNull(), F.lit("UNKNOWN"))
        .when(is_free(method), F.lit("FREE"))
        .otherwise(F.lit("GATED"))
    )


def with_method(
    documents: DataFrame,
    policy: DataFrame,
    normalize_case: bool = False,
    match_suffix: bool = False,
    spread_by: list[str] = ("dataset", "doc_id"),
) -> DataFrame:
    """Add the ``method`` of each document's ``domain``; NULL where there is no policy.

    By default only the domain label has to be equal, case and all; ``match_suffix`` asks
    for an equal public suffix too.
    """
    label = F.lower("domain") if normalize_case else F.col("domain")
    keys = {"_domain": label}
    if match_suffix:
        keys["_suffix"] = F.lower("suffix") if normalize_case else F.col("suffix")
    methods = policy.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(
        F.min_by("method", "id").alias("method")
    )
    fits = fits_broadcast(policy.select("id", "domain", "suffix", "method"))
    return join_lookup(
        documents.withColumns(keys), methods, list(keys), "left", spread_by, fits=fits
    ).drop(*keys)
