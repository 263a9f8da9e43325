"""Token counts as rollups that are maintained by deltas.

Changes come in batches of rows (op, doc_id, source, lang, tokenizer, tokens, seq, docs): insert,
delete, revise (a new count, source or language), or single (of equal documents one is left);
``docs`` is the number of equal documents the
row stands for, each with that many tokens. A batch is turned into signed rows: minus
what its documents counted so far, plus what they count now. The signed rows are stored, as is
their sum by source, language and tokenizer version; totals are the sum of these sums.

Commits are idempotent: a batch is written under a fresh name and becomes visible by one small
commit file that names it. A batch id that is committed is not applied again; a batch that failed
half-way was never visible.

Defined cases: within a batch the last change of a document and tokenizer wins, by seq, then
by tokens, source, language and op; an
insert of a known document is a revision; deleting or revising an unknown one: delete does
nothing, revise inserts; a null count is 0; without ``docs`` a row is one document; null ids are
one document (``counted`` gives rows without an id, or with a repeated one, keys of their own);
null sources or languages are groups of their own; an empty batch commits nothing but its id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.arrays import frugal
from newsloom.llm.tables import keyed, new_folder
from newsloom.llm.tokens import Encoder

GROUPS = ("source", "lang", "tokenizer")
SIGNED = "doc_id bigint, source string, lang string, tokenizer string, docs bigint, tokens bigint"
SUMS = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


class Rollup:
    """Totals kept in a folder of shared storage."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _commits(self) -> dict[str, str]:
        """Committed batch ids and the folders of their rows."""
        try:
            rows = self.spark.read.schema("batch string, path string").json(
                f"{self.folder}/commits"
            ).collect()  # one row per batch
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return {}
            raise
        return {row["batch"]: row["path"] for row in rows}

    def _read(self, part: str, schema: str) -> DataFrame:
        paths = [f"{path}/{part}" for path in self._commits().values()]
        reader = self.spark.read.schema(schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch once; False if it was committed before."""
        if batch in self._commits():
            return False
        path = new_folder(self.spark, "counts")
        order = F.struct("seq", "tokens", "source", "lang", "op")
        if "docs" not in changes.columns:
            changes = changes.withColumn("docs", F.lit(1))
        last = changes.groupBy("doc_id", "tokenizer").agg(
            F.max_by(F.struct("op", "source", "lang", "tokens", "docs"), order).alias("to")
        )
        before = (
            self._read("signed", SIGNED)
            .groupBy("doc_id", "source", "lang", "tokenizer")
            .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            .where("docs <> 0")
        )
        named = before.select(
            F.col("doc_id").alias("was_id"), F.col("tokenizer").alias("was_tokenizer"),
            F.struct("source", "lang", "docs", "tokens").alias("was"),
        )
        met = last.join(
            named,
            F.col("doc_id").eqNullSafe(F.col("was_id"))
            & F.col("tokenizer").eqNullSafe(F.col("was_tokenizer")),
            "left",
        )
        minus = F.struct(
            F.col("was.source").alias("source"), F.col("was.lang").alias("lang"),
            (-F.col("was.docs")).alias("docs"), (-F.col("was.tokens")).alias("tokens"),
        )
        plus = F.struct(
            F.col("to.source").alias("source"), F.col("to.lang").alias("lang"),
            F.col("to.docs").cast("bigint").alias("docs"),
            (F.coalesce("to.tokens", F.lit(0)) * F.col("to.docs")).cast("bigint").alias("tokens"),
        )
        one = F.struct(
            F.col("was.source").alias("source"), F.col("was.lang").alias("lang"),
            F.lit(1).cast("bigint").alias("docs"),
            F.floor(F.col("was.tokens") / F.col("was.docs")).alias("tokens"),
        )
        known = F.col("was").isNotNull()
        after = F.when(F.col("to.op") == "single", F.when(known, one)).when(
            F.col("to.op") != "delete", plus
        )
        both = F.array(F.when(known, minus), after)
        signed = met.select(
            "doc_id", "tokenizer", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x")
        ).select("doc_id", "x.source", "x.lang", "tokenizer", "x.docs", "x.tokens")
        signed.write.parquet(f"{path}/signed")
        written = self.spark.read.schema(SIGNED).parquet(f"{path}/signed")
        sums = written.groupBy(*GROUPS).agg(
            F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")
        )
        sums.write.parquet(f"{path}/sums")
        commit = json.dumps({"batch": batch, "path": path})
        self.spark.range(1).select(F.lit(commit).alias("value")).coalesce(1).write.mode("append").text(
            f"{self.folder}/commits"
        )
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) over all committed batches."""
        sums = self._read("sums", SUMS).groupBy(*GROUPS)
        return sums.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where(
            "docs <> 0 OR tokens <> 0"
        )


def keyed_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, id, source, lang, text): ``doc_id`` is a key of the row; rows equal in id and text
    share it."""
    return keyed(documents).select(
        F.col("_key").alias("doc_id"), F.col("row.doc_id").alias("id"), "row.source", "row.lang", "row.text"
    )


def _merged(rows: DataFrame) -> DataFrame:
    """One row per key, with the number of equal documents behind it; of different sources or
    languages under one key the last ones count."""
    return rows.groupBy("doc_id").agg(
        F.max(F.struct("source", "lang", "tokens")).alias("last"), F.count("*").alias("docs")
    ).select("doc_id", "last.*", "docs")


def estimated(documents: DataFrame) -> DataFrame:
    """(doc_id, source, lang, tokens, docs): a token for every four bytes."""
    tokens = F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / 4).cast("bigint")
    return _merged(keyed_documents(documents).withColumn("tokens", tokens))


def counted(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, source, lang, tokens, docs) by the tokenizer file at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(path)
        for batch in batches:
            counts = [len(ids) for ids in encoder.each(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["doc_id", "source", "lang"]).columns,
                 pa.array(np.array(counts, np.int64))],
                ["doc_id", "source", "lang", "tokens"],
            )

    rows = keyed_documents(documents).select("doc_id", "source", "lang", "text")
    return _merged(
        rows.mapInArrow(frugal(run), "doc_id bigint, source string, lang string, tokens bigint")
    )


def changes(rows: DataFrame, op: str, tokenizer: str) -> DataFrame:
    """Rows (doc_id, source, lang, tokens, docs) as changes of one kind."""
    return rows.select(
        F.lit(op).alias("op"), "doc_id", "source", "lang",
        F.lit(tokenizer).alias("tokenizer"), "tokens", F.lit(0).alias("seq"), "docs",
    )


def later_copies(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Documents whose text an earlier one has too (by id, those without one last); texts are told
    by two 64-bit hashes. As changes (op, doc_id, ...): copies are deleted, and of documents equal
    in id and text that come first one is left."""
    text = F.coalesce("text", F.lit(""))
    rows = keyed_documents(documents).select(
        "doc_id", "id", "source", "lang", F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g")
    )
    rows = rows.groupBy("doc_id", "h", "g").agg(
        F.max(F.struct("source", "lang")).alias("last"), F.min("id").alias("id"), F.count("*").alias("docs")
    )
    place = F.struct(F.col("id").isNull().alias("none"), "id", "doc_id")
    firsts = rows.groupBy("h", "g").agg(F.min(place).alias("first"), F.sum("docs").alias("n"))
    is_first = F.col("doc_id") == F.col("first.doc_id")
    return (
        rows.join(firsts.where("n > 1"), ["h", "g"])
        .where(~is_first | (F.col("docs") > 1))
        .select(
            F.when(is_first, "single").otherwise("delete").alias("op"), "doc_id", "last.*",
            F.lit(tokenizer).alias("tokenizer"), F.lit(0).cast("bigint").alias("tokens"), F.lit(0).alias("seq"),
        )
    )
