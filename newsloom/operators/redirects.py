"""Following redirects between pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom.functions.html_fields import html_fields
from newsloom.operators.lookup import join_lookup
from newsloom.session import cut_lineage


def is_redirecting(html: Column) -> Column:
    return html.contains(fv.REDIRECTING_MARK)


def redirect_edges(pages: DataFrame, url: str = "url", html: str = "reader") -> DataFrame:
    """One edge per redirecting page; ``to_url`` is empty if the page names no target.

    Only pages with the marker are read.  A page listed twice counts once.
    """
    fields = html_fields(F.col(html))
    return (
        pages.where(is_redirecting(F.col(html)))
        .select(F.col(url).alias("from_url"), fields.alias("_fields"))
        .select("from_url", F.coalesce("_fields.first_link", F.lit("")).alias("to_url"))
        .groupBy("from_url")
        .agg(F.min("to_url").alias("to_url"))
    )


def chain_ends(edges: DataFrame) -> DataFrame:
    """For every edge the end of its chain: ``from_url, final_url, hops``.

    ``edges`` has at most one row per ``from_url``.  A chain whose last page names no
    target ends in ``''``; one that runs into a loop never ends and gets ``''`` too, with
    ``hops`` NULL.

    Each round doubles the length of all jumps, so a chain of any length takes a
    logarithmic number of rounds.  As long as an unfinished chain is not a loop, a round
    finishes some; when a round finishes none, only loops are left.  Popular targets are
    spread over many tasks.  The jumps are measured anew each round, as targets may get longer.
    """
    edges = cut_lineage(edges)  # read several times below
    sources = edges.select(F.col("from_url").alias("to_url"), F.lit(True).alias("_goes_on"))
    jumps = join_lookup(edges, sources, ["to_url"], "left", ["from_url"]).select(
        "from_url",
        "to_url",
        F.lit(1).cast("bigint").alias("hops"),
        F.col("_goes_on").isNull().alias("done"),
    )
    jumps = cut_lineage(jumps)
    open_before = None
    open_now = jumps.where(~F.col("done")).count()
    while open_now and open_now != open_before:
        onward = jumps.select(
            F.col("from_url").alias("to_url"),
            F.col("to_url").alias("_to"),
            F.col("hops").alias("_hops"),
            F.col("done").alias("_done"),
        )
        # Finished jumps meet nothing here and stay as they are.
        further = join_lookup(jumps, onward, ["to_url"], "left", ["from_url"])
        jumps = cut_lineage(
            further.select(
                "from_url",
                F.coalesce("_to", "to_url").alias("to_url"),
                (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
                F.coalesce("_done", "done").alias("done"),
            )
        )
        open_before, open_now = open_now, jumps.where(~F.col("done")).count()
    return jumps.select(
        "from_url",
        F.when(F.col("done"), F.col("to_url")).otherwise(F.lit("")).alias("final_url"),
        F.when(F.col("done"), F.col("hops")).alias("hops"),
    )


def resolve_redirects(
    documents: DataFrame,
    edges: DataFrame,
    url: str = "url",
    spread_by: list[str] = ("dataset", "doc_id"),
) -> DataFrame:
    """Add ``final_url`` and ``hops`` to a table of URLs; many rows may share a URL."""
    ends = chain_ends(edges).withColumnRenamed("from_url", url).withColumn("_moved", F.lit(True))
    joined = join_lookup(documents, ends, [url], "left", spread_by)
    moved = F.coalesce("_moved", F.lit(False))
    return joined.withColumns(
        {
            "final_url": F.when(moved, F.col("final_url")).otherwise(F.col(url)),
            "hops": F.when(moved, F.col("hops")).otherwise(F.lit(0).cast("bigint")),
        }
    ).drop("_moved")
