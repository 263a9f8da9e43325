"""The registered queries of this folder: one per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import (
    line_dedup,
    merkle,
    mixing,
    ngram_join,
    packing,
    quality_rules,
    site_quality,
    suffix_index,
    token_counts,
    tokens,
    top_k,
    toxicity,
    tree_search,
    vector_codes,
)
from newsloom.llm.tables import new_folder, read

TWINS: dict[str, str] = {
    "op7_mixing": mixing.twin_sql(),
    "op11_merkle_manifest": merkle.twin_sql(),
    "op13_vector_codes": vector_codes.twin_sql(),
}


def op1_top_k_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = top_k.scaled(read(spark, folder, "embeddings"))
    return top_k.top_k(vectors, F.col("vec_id") % 100 == 0, k=10)


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"), tokens.default_path())


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Load with estimates, revise to exact counts (twice: the second does nothing), take out
    later exact copies; the totals."""
    documents = read(spark, folder, "documents")
    version = "word_bpe_49k"
    rollup = token_counts.Rollup(spark, new_folder(spark, "rollup"))
    rollup.apply("load", token_counts.changes(token_counts.estimated(documents), "insert", version))
    exact = token_counts.counted(documents, tokens.default_path())
    for _ in range(2):
        rollup.apply("count", token_counts.changes(exact, "revise", version))
    rollup.apply("copies", token_counts.later_copies(documents, version))
    return rollup.totals()


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Hosts are the sources; the sections of a host are its languages."""
    path = F.concat_ws("/", "source", "lang")
    documents = read(spark, folder, "documents")
    return site_quality.classify(documents, read(spark, folder, "labels"), F.col("source"), path)


def op5_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.linked_components(read(spark, folder, "documents"), size=4, percent=85)


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_index.digest(suffix_index.remove_repeats(read(spark, folder, "documents")))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    topics = mixing.embedding_topics(read(spark, folder, "embeddings"))
    mixed = mixing.mix(read(spark, folder, "documents"), topics)
    return mixed.withColumn("probability", F.round("probability", 6))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    return toxicity.score(documents, toxicity.train(documents, read(spark, folder, "labels")))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    forest = quality_rules.fit_rules(documents, read(spark, folder, "labels"))
    return quality_rules.judge(documents, forest)


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    return line_dedup.digest(line_dedup.remove_lines(documents, short=True))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verified(read(spark, folder, "documents"))


def op12_tree_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = tree_search.usable(read(spark, folder, "embeddings"))
    return tree_search.search(vectors, F.col("vec_id") % 100 == 0, k=10)


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress(read(spark, folder, "embeddings"))


QUERIES = {
    "op1_top_k_search": op1_top_k_search,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_token_counts": op3_token_counts,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_quality_rules": op9_quality_rules,
    "op10_line_dedup": op10_line_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_tree_search": op12_tree_search,
    "op13_vector_codes": op13_vector_codes,
}
