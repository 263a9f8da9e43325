"""Bloom filters over document keys, kept as a table.

A filter is a set of 64-bit words per dataset. A key sets BITS bits of one word, so a filter is
made, merged and asked by plain expressions: adding keys is a grouped OR, asking is a join on the
word. A key whose bits are not all set was never added; one whose bits are may have been. WORDS
bounds a dataset's filter; beyond some four keys a word more keys are taken for known, which costs
time and never a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["dataset", "doc_id"]
WORDS = 1 << 22
BITS = 4
SCHEMA = "dataset STRING, word INT, bits BIGINT"


def _hash(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), F.col("dataset"), F.col("doc_id").cast("bigint"))


def word_of_key(words: int = WORDS) -> Column:
    return F.pmod(_hash(0), F.lit(words)).cast("int")


def bits_of_key() -> Column:
    """The bits a key sets in its word: six bits of a hash name each."""
    one = F.lit(1).cast("bigint")
    places = [F.shiftrightunsigned(_hash(1), 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(BITS)]
    bits = F.lit(0).cast("bigint")
    for place in places:
        bits = bits.bitwiseOR(F.call_function("shiftleft", one, place))
    return bits


def filter_of(keys: DataFrame, words: int = WORDS) -> DataFrame:
    """The filter of a table's keys (dataset, word, bits)."""
    rows = keys.select("dataset", word_of_key(words).alias("word"), bits_of_key().alias("bits"))
    return merged(rows)


def merged(filters: DataFrame) -> DataFrame:
    """Filters, or parts of them, as one."""
    return filters.groupBy("dataset", "word").agg(F.bit_or("bits").alias("bits"))


def maybe_known(keys: DataFrame, filters: DataFrame, words: int = WORDS) -> DataFrame:
    """Keys with ``maybe_known``: false for those that no filter has."""
    asked = keys.withColumns({"word": word_of_key(words), "_bits": bits_of_key()})
    met = asked.join(merged(filters), ["dataset", "word"], "left")
    there = F.col("bits").bitwiseAND(F.col("_bits")) == F.col("_bits")
    return met.withColumn("maybe_known", F.coalesce(there, F.lit(False))).drop("word", "bits", "_bits")
