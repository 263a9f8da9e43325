"""Languages by character n-gram profiles that are learned from labelled texts.

A profile is one grouped aggregation: how often each run of LENGTH characters occurs in the
distinct words of a language's texts. Each language keeps its SIZE most frequent runs, so the
profiles have a bound whatever they are learned from, and are broadcast. A text's score for
a language is the sum of its runs' logarithmic shares; runs beyond the profiles weigh nothing.

Guessing moves no texts: runs are exploded, looked up and summed on the map side, and one small
row per text is left for each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom import fixed_values as fv

LENGTH = 3
SIZE = 600


def runs(table: DataFrame, keep: list[str], text: str) -> DataFrame:
    """Rows (keep..., run): all runs of LENGTH characters of the distinct words of a text, words
    with a blank before and behind."""
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))
    padded = F.concat(F.lit(" "), F.col("_word"), F.lit(" "))
    return (
        table.select(*keep, F.explode(words).alias("_word"))
        .where("_word <> ''")
        .select(*keep, padded.alias("_word"))
        .select(*keep, "_word", F.explode(F.sequence(F.lit(1), F.length("_word") - LENGTH + 1)).alias("_at"))
        .select(*keep, F.substr("_word", F.col("_at"), F.lit(LENGTH)).alias("run"))
    )


def learn(table: DataFrame, text: str, language: str, size: int = SIZE) -> DataFrame:
    """(language, run, weight): the profiles of all languages in ``table``."""
    named = table.where(F.col(language).isNotNull() & F.col(text).isNotNull())
    counts = (
        runs(named.select(F.col(language).alias("language"), text), ["language"], text)
        .groupBy("language", "run")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Per language, not per text: as many rows as a language has different runs.
    place = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "run"))
    top = counts.withColumn("place", place).where(F.col("place") <= size)
    total = F.sum("n").over(Window.partitionBy("language"))
    # Of a run that a profile lacks, half an occurrence is assumed.
    share = F.log((F.col("n") + 0.5) / total) - F.log(F.lit(0.5) / total)
    return top.select("language", "run", share.alias("weight"))


def guess(table: DataFrame, key: list[str], text: str, profiles: DataFrame) -> DataFrame:
    """(key..., guessed, lead): the best language of each text, ``unknown`` where no run is known;
    ``lead`` is how far it is ahead of the second one, per run."""
    languages = sorted(row["language"] for row in profiles.select("language").distinct().collect())
    best: Column = F.lit(fv.UNKNOWN_LANGUAGE)
    lead: Column = F.lit(None).cast("double")
    weights = profiles.groupBy("run").pivot("language", languages).agg(F.max("weight"))
    found = runs(table, key, text).join(F.broadcast(weights), "run")
    sums = found.groupBy(*key).agg(
        *(F.coalesce(F.sum(F.col(f"`{name}`")), F.lit(0.0)).alias(f"_s{k}") for k, name in enumerate(languages)),
        F.count(F.lit(1)).alias("_runs"),
    )
    if languages:
        scores = F.array(*(
            F.struct(F.col(f"_s{k}").alias("score"), F.lit(-k).alias("place"), F.lit(name).alias("language"))
            for k, name in enumerate(languages)
        ))
        ranked = F.sort_array(scores, asc=False)
        best = ranked[0]["language"]
        if len(languages) > 1:
            lead = (ranked[0]["score"] - ranked[1]["score"]) / F.col("_runs")
    sums = sums.select(*key, best.alias("guessed"), lead.alias("lead"))
    return table.select(*key).join(sums, key, "left").withColumn(
        "guessed", F.coalesce("guessed", F.lit(fv.UNKNOWN_LANGUAGE))
    )
