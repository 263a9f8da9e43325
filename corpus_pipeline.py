"""The corpus pipeline: quality rules, line dedup, near-duplicate documents, mixing, packing.

``STAGES`` lists the stages; each takes (spark, docs, sf_dir) and works on all that its
predecessor kept. All but the last return the columns of documents. ``run`` applies them in
order, each result stored before the next reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import line_dedup, mixing, ngram_join, packing, quality_rules, tokens
from newsloom.llm.tables import keyed, one_row_each, read, stored, without


# Rows that go to Python together: whole texts of documents, on both sides of the pipe.
ARROW_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python and back in small batches, so that a task holds few of them at a time.
    The setting is the session's and stays, as stages are carried out after they return."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept."""
    small_batches(spark)
    forest = quality_rules.fit_rules(docs, read(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, forest)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier lines repeat; a document that loses all its words
    goes. ``n_chars`` follows the text where lines went."""
    changed = F.size("removed_lines") > 0
    row = F.col("document")
    new = {name: row[name] for name in docs.columns}
    new["text"] = F.when(changed, F.col("kept_text")).otherwise(row["text"])
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        length = F.char_length("kept_text").cast(kind)
        new["n_chars"] = F.when(changed, length).otherwise(row["n_chars"])
    empty = changed & ~F.col("kept_text").rlike("[^\\x20\\x09-\\x0D]")
    lines = line_dedup.remove_lines(docs).where(~empty)
    return lines.select(*(column.alias(name) for name, column in new.items()))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates. Rows are told
    by keys, so texts that share an id, or have none, are documents of their own; of rows equal in
    id and text one stays, save those without words, which are no duplicates of anything."""
    small_batches(spark)
    rows = keyed(docs)
    texts = rows.select(F.col("_key").alias("doc_id"), "row.text")
    groups = ngram_join.linked_components(texts, size=5, percent=80).where("n_shingles > 0")
    ids = rows.select("_key", F.col("row.doc_id").alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_key")).alias("first")
    members = stored(
        groups.select(F.col("doc_id").alias("_key"), "component_id").distinct().join(ids.distinct(), "_key"),
        "near-groups",
    )
    firsts = members.groupBy("component_id").agg(first, F.count("*").alias("n")).where("n > 1")
    gone = members.join(firsts, "component_id").where("_key <> first._key").select("_key")
    kept = without(rows, "_key", stored(gone.distinct(), "near-copies"))
    wordless = ~F.coalesce(F.col("row.text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    return (
        one_row_each(kept.where(~wordless)).union(kept.where(wordless)).select("row.*")
    )


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics meet their target shares; rows are
    drawn each by its own key."""
    topics = mixing.embedding_topics(read(spark, sf_dir, "embeddings"))
    rows = keyed(docs)
    weighed = rows.select("_key", "row.doc_id", "row.source", "row.lang", "row.text")
    drawn = mixing.mix(weighed, topics, capped=True, key="_key").where("NOT kept")
    return without(rows, "_key", stored(drawn.select("_key").distinct(), "left-out")).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids and their place in the training sequences."""
    small_batches(spark)
    return packing.pack(docs, tokens.default_path(), with_ids=True)


STAGES = [
    ("quality_rules", good_documents),
    ("line_dedup", fresh_lines),
    ("ngram_jaccard", one_of_each),
    ("mixing", mixed),
    ("packing", packed),
]

#: Trees fitted to labels and byte-pair encoding are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
