"""Day or month first: the dates of a host decide for each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.dates import order_votes, parse_date
from newsloom.operators.lookup import join_lookup


def host_order(table: DataFrame, host: str, date: str) -> DataFrame:
    """(host, day_votes, month_votes, day_first): what the host's unambiguous numeric dates say;
    hosts without such a date are left out. Dates are reduced on the map side."""
    day, month = order_votes(F.col(date))
    votes = table.select(F.col(host).alias("host"), day.alias("day"), month.alias("month"))
    return (
        votes.where((F.col("day") | F.col("month")) & F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.count_if("day").alias("day_votes"), F.count_if("month").alias("month_votes"))
        .withColumn("day_first", F.col("day_votes") > F.col("month_votes"))
    )


def with_dates(
    table: DataFrame,
    host: str,
    date: str,
    name: str = "publish_date",
    as_of: Column | None = None,
    spread_by: list[str] = ("dataset", "doc_id"),
) -> DataFrame:
    """``table`` with ``name``, the date read as the host writes dates; a host that never tells
    has the month first. The lookup of hosts is measured before it is broadcast."""
    order = host_order(table, host, date).select(
        F.col("host").alias(host), F.col("day_first").alias("_day_first")
    )
    return (
        join_lookup(table, order, [host], "left", spread_by)
        .withColumn(name, parse_date(F.col(date), as_of, F.col("_day_first")))
        .drop("_day_first")
    )
