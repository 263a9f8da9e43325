"""Archive captures: parsing index answers, choosing and ordering copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom.functions import urls
from newsloom.operators.ranking import running_total


def parse_index_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Index lines as captures: seven fields between single spaces; other lines are dropped."""
    fields = F.col("_fields")
    named = [fields[i].alias(name) for i, name in enumerate(fv.CAPTURE_FIELDS)]
    others = [c for c in lines.columns if c != column]
    return (
        lines.withColumn("_fields", F.split(F.col(column), " ", -1))
        .where(F.size("_fields") == len(fv.CAPTURE_FIELDS))
        .select(*others, *named)
    )


def parse_index_answers(answers: DataFrame, column: str = "body") -> DataFrame:
    """Whole index answers (one text per document) as captures."""
    others = [c for c in answers.columns if c != column]
    lines = answers.select(*others, F.explode(F.split(F.col(column), "\n", -1)).alias("value"))
    return parse_index_lines(lines)


def is_usable(statuscode: Column, allowed: list[str] | None = None) -> Column:
    """Status is worth a try: not on the list of unusable ones, or on ``allowed`` if given."""
    return statuscode.isin(allowed) if allowed else ~statuscode.isin(fv.UNUSABLE_STATUS)


def is_redirect(statuscode: Column) -> Column:
    return statuscode.isin(fv.REDIRECT_STATUS)


def usable_captures(captures: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    return captures.where(is_usable(F.col("statuscode"), allowed))


def capture_order() -> list[Column]:
    """Order of trying copies: status, then time, both compared as text.

    The remaining fields only make the order total.
    """
    names = ["statuscode", "timestamp", "original", "urlkey", "mimetype", "digest", "length"]
    return [F.col(name) for name in names]


def distinct_captures(captures: DataFrame) -> DataFrame:
    """Equal captures of a document as one row with their number, ``copies``."""
    return captures.groupBy("dataset", "doc_id", *fv.CAPTURE_FIELDS).agg(
        F.count(F.lit(1)).alias("copies")
    )


def ordered_captures(captures: DataFrame) -> DataFrame:
    """Distinct captures with address and place in the order of trying.

    ``place`` is the position of the last of the copies.  A document may have any number
    of captures: it is cut into blocks of one status and one hour.
    """
    distinct = distinct_captures(captures)
    block = F.struct("statuscode", F.substring("timestamp", 1, 10))
    placed = running_total(
        distinct, ["dataset", "doc_id"], capture_order(), block, F.col("copies"), "place"
    )
    return placed.withColumn("location", urls.capture_url(F.col("timestamp"), F.col("original")))


def first_usable(captures: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """The capture to try first, per document; reduced on the map side."""
    best = F.min(F.struct(*capture_order())).alias("_best")
    return (
        usable_captures(captures, allowed)
        .groupBy("dataset", "doc_id")
        .agg(best)
        .select(
            "dataset",
            "doc_id",
            F.col("_best.statuscode").alias("statuscode"),
            F.col("_best.timestamp").alias("timestamp"),
            urls.capture_url(F.col("_best.timestamp"), F.col("_best.original")).alias("location"),
        )
    )


def captures_per_document(captures: DataFrame) -> DataFrame:
    return captures.groupBy("dataset", "doc_id").agg(F.count(F.lit(1)).alias("n_captures"))


def cached_documents(work: DataFrame, captures: DataFrame) -> DataFrame:
    """Work items with the number of captures on file and whether there are any."""
    counted = work.join(captures_per_document(captures), ["dataset", "doc_id"], "left")
    n = F.coalesce("n_captures", F.lit(0))
    return counted.withColumn("n_captures", n).withColumn("cached", F.col("n_captures") > 0)


def capture_cells(captures: DataFrame) -> DataFrame:
    """Captures of a document as sorted array cells, one per status and month.

    Equal captures are counted first and kept once, with ``copies``.  The cut is a rule of the
    data alone, so the cells are the same at any size; read by status and month, they are in
    the order of trying.
    """
    item = F.struct(*capture_order(), F.col("copies"))
    month = F.substring("timestamp", 1, 6).alias("month")
    return (
        distinct_captures(captures)
        .groupBy("dataset", "doc_id", "statuscode", month)
        .agg(F.array_sort(F.collect_list(item)).alias("captures"))
    )
