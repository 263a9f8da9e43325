"""Splitting hosts into subdomain, registered domain label and public suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import urls
from newsloom.operators.lookup import is_small, join_lookup, measure


def suffix_rules(suffixes: DataFrame) -> DataFrame:
    """Suffix list as one row per base name.

    The list may hold wildcard rules (``*.ck``) and exceptions to them (``!www.ck``).
    """
    rule = F.lower(F.col("suffix"))
    base = F.regexp_replace(rule, r"^(\*\.|!)", "")
    return suffixes.groupBy(base.alias("base")).agg(
        F.bool_or(~rule.rlike(r"^(\*\.|!)")).alias("plain"),
        F.bool_or(rule.startswith("*.")).alias("wild"),
        F.bool_or(rule.startswith("!")).alias("except"),
    )


def split_domains(
    table: DataFrame,
    suffixes: DataFrame,
    url_column: str = "url",
    spread_by: list[str] = ("dataset", "doc_id"),
) -> DataFrame:
    """Add ``host, subdomain, domain, suffix`` to a table of URLs; host case is kept.

    The longest rule that matches the end of the host wins.  Each possible length is one
    map-side lookup, so no URL is exploded, grouped or moved.  Addresses and hosts without
    a known suffix are their own domain.
    """
    rules = suffix_rules(suffixes)
    # One measurement of the list gives an upper bound of the rules and of their length.
    size = measure(suffixes, F.max(F.size(F.split("suffix", r"\."))).alias("labels"))
    fits = is_small(size)
    max_labels = size["labels"] or 1
    result = table.withColumn("host", urls.host(F.col(url_column)))
    result = result.withColumn("_labels", F.split("host", r"\."))
    labels = F.col("_labels")
    count = F.size(labels)
    lengths = []
    for n in range(1, max_labels + 1):
        key = F.when(
            count >= n,
            F.lower(F.array_join(F.slice(labels, F.greatest(count - n + 1, F.lit(1)), n), ".")),
        )
        found = rules.select(
            F.col("base").alias(f"_base{n}"),
            F.col("plain").alias(f"_plain{n}"),
            F.col("wild").alias(f"_wild{n}"),
            F.col("except").alias(f"_except{n}"),
        )
        result = join_lookup(
            result.withColumn(f"_base{n}", key),
            found,
            [f"_base{n}"],
            "left",
            spread_by,
            fits=fits,
        )
        # Labels taken by the suffix if a rule with this base applies.
        lengths.append(F.when(F.col(f"_plain{n}"), n))
        lengths.append(F.when(F.col(f"_wild{n}") & (count > n), n + 1))
    longest = F.coalesce(F.greatest(*lengths), F.lit(0))
    excepted = F.coalesce(
        *[F.when(F.col(f"_except{n}"), n - 1) for n in range(1, max_labels + 1)]
    )
    size = F.when(urls.is_ip_address(F.col("host")), 0).otherwise(F.coalesce(excepted, longest))
    result = result.withColumn("_size", size)
    is_address = urls.is_ip_address(F.col("host"))
    rest = count - F.col("_size")

    def joined(start, length):
        return F.array_join(
            F.slice(labels, start, F.greatest(length, F.lit(0))), "."
        )

    result = (
        result.withColumn(
            "suffix", joined(F.greatest(rest, F.lit(0)) + 1, F.col("_size"))
        )
        .withColumn(
            "domain",
            F.when(is_address, F.col("host"))
            .when(rest > 0, F.try_element_at(labels, F.greatest(rest, F.lit(1))))
            .otherwise(F.lit("")),
        )
        .withColumn(
            "subdomain", F.when(is_address, F.lit("")).otherwise(joined(F.lit(1), rest - 1))
        )
    )
    helpers = [c for c in result.columns if c.startswith("_")]
    return result.drop(*helpers)
