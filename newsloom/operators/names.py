"""Persons among the pieces of bylines, told from offices and papers by corpus statistics.

The byline rule (``functions.authors``) takes what looks like a name. Two statistics tell what
only looks like one:

- how words are written inside sentences: ``Staff``, ``Writer``, ``New`` and ``Times`` occur in
  small letters in running text, names seldom do;
- the company a piece keeps: an office stands behind many different names.

A piece is no person if at least half of its words are common ones, or if one is and the piece
mostly stands behind others, of whom there are several. Both statistics are grouped sums, reduced
on the map side; only words that occur in bylines are looked up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.authors import byline_names
from newsloom.operators.lookup import join_lookup

# A word is common if it was met so often inside sentences, mostly in small letters.
LEAST_WORDS = 5
# An office: so many bylines, that share of them not in the first place, so many companions.
LEAST_BYLINES, BEHIND, COMPANIONS = 5, 0.8, 3
# Words behind a small letter or a comma and a blank: not the first of a sentence.
INSIDE = r"(?<=[\p{Ll},] )\p{L}+"


def word_case(texts: DataFrame, text: str) -> DataFrame:
    """(word, n, small): how often a word occurs inside sentences, and how often in small letters."""
    words = texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(INSIDE), F.lit(0))).alias("_word"))
    return words.groupBy(F.lower("_word").alias("word")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_word") == F.lower("_word")).alias("small")
    )


def pieces(bylines: DataFrame, key: list[str], byline: str) -> DataFrame:
    """(key..., at, piece, others): the pieces of each byline that look like names, in order."""
    found = bylines.select(*key, byline_names(F.col(byline)).alias("_found"))
    return found.select(*key, F.posexplode("_found").alias("at", "piece"), F.col("_found").alias("others"))


def common_share(found: DataFrame, words: DataFrame) -> DataFrame:
    """(piece, common): the share of a piece's words that are common ones."""
    parts = found.select("piece").distinct().select(
        "piece", F.explode(F.split(F.lower("piece"), " ")).alias("word")
    )
    common = words.where((F.col("n") >= LEAST_WORDS) & (2 * F.col("small") > F.col("n"))).select("word")
    common = join_lookup(common, parts.select("word").distinct(), ["word"], "left_semi", ["word"])
    marked = join_lookup(parts, common.withColumn("_common", F.lit(1)), ["word"], "left", ["piece"])
    return marked.groupBy("piece").agg(
        (F.count("_common") / F.count(F.lit(1))).alias("common")
    )


def company(found: DataFrame) -> DataFrame:
    """(piece, bylines, behind, companions): in how many bylines a piece stands, the share of them in
    which it is not the first, and how many different pieces it stands with."""
    other = F.explode_outer(F.array_except("others", F.array("piece")))
    pairs = found.select("piece", other.alias("other")).distinct()
    companions = pairs.groupBy("piece").agg(F.count("other").alias("companions"))
    counts = found.groupBy("piece").agg(
        F.count(F.lit(1)).alias("bylines"), F.avg((F.col("at") > 0).cast("double")).alias("behind")
    )
    return counts.join(companions, "piece")


def not_persons(found: DataFrame, words: DataFrame) -> DataFrame:
    """Pieces that are offices, papers and the like."""
    facts = common_share(found, words).join(company(found), "piece")
    office = (
        (F.col("common") > 0)
        & (F.col("bylines") >= LEAST_BYLINES)
        & (F.col("behind") >= BEHIND)
        & (F.col("companions") >= COMPANIONS)
    )
    return facts.where((F.col("common") >= 0.5) | office).select("piece")


def persons(bylines: DataFrame, key: list[str], byline: str, words: DataFrame) -> DataFrame:
    """(key..., authors): the persons of each byline, in order; NULL where there are none."""
    found = pieces(bylines, key, byline)
    kept = join_lookup(found, not_persons(found, words), ["piece"], "left_anti", key)
    ordered = F.array_sort(F.collect_list(F.struct("at", "piece")))
    authors = kept.groupBy(*key).agg(F.transform(ordered, lambda one: one["piece"]).alias("authors"))
    return bylines.select(*key).join(authors, key, "left")
