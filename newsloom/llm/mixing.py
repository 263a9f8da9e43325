"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked in turn to target marginals of each
dimension; every document is then kept with its cell's calibrated probability, by a draw that
depends on its id and a seed alone. Cells stay a table: each rake is a grouped sum and a join.

Targets are given as tables (value, share), or follow from the data: shares to the power POWER,
which lifts rare values and lowers common ones. Probabilities are the raked weight over the
tokens present, times one factor that brings the expected number of tokens to KEEP of all, each at
most 1. Where probabilities meet that bound, the clipped rest no longer has the target shares.

With ``capped``, raking knows the bound: cells that reach it keep their tokens, the open ones are
raked to what is left, and so on until the marginals stop moving. A value that has fewer tokens
than its target asks for is kept whole, and what it lacks goes to the other values in proportion
to their targets. ``shares`` puts target and expected share of each value side by side.

Defined cases: a null or empty text has no words, weighs 0 and is kept with its cell's
probability; null sources, languages and topics count as ''; a null id draws as ''; rows with the
same id have the same draw; values without a target share get 0; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.tables import forget, stored

DIMENSIONS = ("source", "lang", "topic")
POWER = 0.5
ROUNDS = 8
KEEP = 0.6
FILL_STEPS = 8
# Raking under the bound stops when no dimension is off by more than STILL of the kept tokens.
CAPPED_ROUNDS = 40
STILL = 1e-3
SEED = 20240301
SPACE = "[\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    words = F.size(F.array_remove(F.split(text, SPACE), ""))
    return F.when(text.isNull(), 0).otherwise(words).cast("bigint")


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / float(1 << 32)


def smoothed(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """(dimension, share): the shares of the data to a power, summing to 1."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("sum"))
    total = sums.agg(F.sum(F.pow("sum", F.lit(power)))).first()[0] or 1.0
    return sums.select(dimension, (F.pow("sum", F.lit(power)) / total).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """Cells with ``weight``: the tokens of each after raking to the targets."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    cells = cells.withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(rounds):
        for dimension, target in targets.items():
            sums = cells.groupBy(dimension).agg(F.sum("weight").alias("sum"))
            factor = sums.join(target, dimension, "left").select(
                dimension,
                F.when(F.col("sum") > 0, F.coalesce("share", F.lit(0.0)) * total / F.col("sum"))
                .otherwise(0.0)
                .alias("factor"),
            )
            cells = cells.join(factor, dimension).withColumn(
                "weight", F.col("weight") * F.col("factor")
            ).drop("factor")
        cells = stored(cells, "raked")
    return cells


def calibrate(cells: DataFrame, keep: float = KEEP) -> DataFrame:
    """Cells with ``probability``; the expected kept tokens are ``keep`` of all, or as near as
    probabilities of at most 1 allow."""
    rate = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0)
    cells = cells.withColumn("rate", rate)
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    factor = keep
    for _ in range(FILL_STEPS):
        full = F.col("rate") * factor >= 1
        row = cells.agg(
            F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("full"),
            F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("rate"))).alias("open"),
        ).first()
        if not row["open"]:
            break
        factor = max(0.0, keep * total - row["full"]) / row["open"]
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("rate") * factor))


def aims(
    cells: DataFrame, targets: dict[str, DataFrame], keep: float
) -> tuple[DataFrame, float]:
    """(dimension, value, aim): the tokens to keep of each value, at most those it has; and the
    share of all tokens to keep, which is lower than ``keep`` if values with a target lack them."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    parts, reach = [], keep
    for dimension, target in targets.items():
        sums = cells.groupBy(dimension).agg(F.sum("tokens").alias("tokens"))
        part = stored(
            sums.join(target, dimension, "left").select(
                F.lit(dimension).alias("dimension"),
                F.col(dimension).alias("value"),
                "tokens",
                (F.coalesce("share", F.lit(0.0)) * total).alias("weight"),
            ),
            "aims",
        )
        there = part.where("weight > 0").agg(F.sum("tokens")).first()[0] or 0
        reach = min(reach, there / total if total else keep)
        parts.append(part)
    out = None
    for part in parts:
        aim = calibrate(part, reach).select(
            "dimension", "value", (F.col("tokens") * F.col("probability")).alias("aim")
        )
        out = aim if out is None else out.union(aim)
    return stored(out, "aims"), reach


def rake_capped(
    cells: DataFrame, targets: dict[str, DataFrame], keep: float = KEEP, rounds: int = CAPPED_ROUNDS
) -> DataFrame:
    """Cells with ``probability``: raked so that the expected kept tokens of each value meet its
    aim with no probability above 1."""
    aim, reach = aims(cells, targets, keep)
    size = float(cells.agg(F.sum("tokens")).first()[0] or 0) * reach
    cells = cells.withColumn("rate", F.lit(float(reach)))
    for dimension in targets:
        wanted = aim.where(F.col("dimension") == dimension).select(
            F.col("value").alias(dimension), F.col("aim").alias(f"aim_{dimension}")
        )
        cells = cells.join(wanted, dimension)
    cells = stored(cells, "raked")
    at = F.array(
        *(
            F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"), F.col(f"aim_{d}").alias("aim"))
            for d in targets
        )
    )
    kept = F.col("tokens") * F.least(F.lit(1.0), F.col("rate"))
    full = F.col("rate") >= 1
    for _ in range(rounds):
        last = cells
        # Sums in windows: a round is one short plan, and the driver keeps little of it.
        for dimension in targets:
            same = Window.partitionBy(dimension)
            wanted = F.col(f"aim_{dimension}")
            cells = cells.withColumns(
                {
                    "full": F.sum(F.when(full, F.col("tokens")).otherwise(0)).over(same).cast("double"),
                    "open": F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("rate"))).over(same),
                }
            )
            # What is left of the aim beside the full cells, over the open ones. Downwards, full
            # cells may open again, so that a step to nothing or below is held back.
            present = F.col("full") + F.col("open")
            step = F.when(F.col("open") > 0, (wanted - F.col("full")) / F.col("open"))
            factor = (
                F.when(present <= 0, 1.0)
                .when(wanted >= present, F.coalesce(step, F.lit(1.0)))
                .otherwise(F.greatest(step, wanted / present / 2))
            )
            cells = cells.withColumn("rate", F.col("rate") * factor).drop("full", "open")
        cells = stored(cells, "raked")
        forget(last)
        off = (
            cells.select(F.explode(at).alias("at"), kept.alias("kept"))
            .groupBy("at")
            .agg(F.sum("kept").alias("kept"))
            .agg(F.max(F.abs(F.col("kept") - F.col("at.aim"))))
            .first()[0]
        )
        if not off or off <= STILL * size:
            break
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("rate")))


def shares(mixed: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """(dimension, value, target, expected): target and expected share of the kept tokens, from
    the rows of ``mix``."""
    cells = stored(
        mixed.groupBy(*DIMENSIONS).agg(
            F.sum("tokens").alias("tokens"),
            F.sum(F.col("tokens") * F.col("probability")).alias("kept"),
        ),
        "shares",
    )
    if targets is None:
        targets = {d: smoothed(cells, d, POWER) for d in DIMENSIONS}
    total = cells.agg(F.sum("kept")).first()[0] or 1.0
    out = None
    for dimension, target in targets.items():
        kept = cells.groupBy(dimension).agg((F.sum("kept") / total).alias("expected"))
        part = kept.join(target, dimension, "full").select(
            F.lit(dimension).alias("dimension"),
            F.col(dimension).alias("value"),
            F.coalesce("share", F.lit(0.0)).alias("target"),
            F.coalesce("expected", F.lit(0.0)).alias("expected"),
        )
        out = part if out is None else out.union(part)
    return out


def mix(
    documents: DataFrame,
    topics: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    keep: float = KEEP,
    seed: int = SEED,
    capped: bool = False,
    key: str = "doc_id",
) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, probability, kept) per document; ``capped`` rakes
    under the bound of the probabilities instead of clipping them afterwards. Draws depend on the
    column ``key``, which is returned too.

    ``topics`` has (doc_id, topic), one row per id; documents without one have the topic ''."""
    names = list(dict.fromkeys(["doc_id", key]))
    measured = documents.select(
        *names,
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        word_count(F.col("text")).alias("tokens"),
    )
    measured = stored(
        measured.join(topics.where("doc_id IS NOT NULL"), "doc_id", "left").withColumn(
            "topic", F.coalesce("topic", F.lit(""))
        ),
        "measured",
    )
    cells = stored(measured.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    if targets is None:
        targets = {d: stored(smoothed(cells, d, POWER), "targets") for d in DIMENSIONS}
    if capped:
        chances = rake_capped(cells, targets, keep)
    else:
        chances = calibrate(rake(cells, targets), keep)
    chances = chances.select(*DIMENSIONS, "probability")
    return (
        measured.join(chances, list(DIMENSIONS))
        .withColumn("kept", draw(F.col(key), seed) < F.col("probability"))
        .select(*names, *DIMENSIONS, "tokens", "probability", "kept")
    )


def embedding_topics(embeddings: DataFrame) -> DataFrame:
    """(doc_id, topic): the cluster label of the document's embedding."""
    known = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    return known.groupBy(F.col("vec_id").alias("doc_id")).agg(
        F.min("label").cast("string").alias("topic")
    )


def twin_sql() -> str:
    """The same as one statement, rounds unrolled."""
    key = "source, lang, topic"
    parts = [
        "topics AS (SELECT vec_id AS doc_id, CAST(min(label) AS VARCHAR) AS topic FROM embeddings"
        " WHERE vec_id IS NOT NULL AND label IS NOT NULL GROUP BY vec_id)",
        "measured AS (SELECT d.doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,"
        " coalesce(topic, '') AS topic, coalesce(len(regexp_extract_all(text,"
        " '[^\\x20\\x09-\\x0D]+')), 0) AS tokens FROM documents d LEFT JOIN topics USING (doc_id))",
        f"cells0 AS (SELECT {key}, sum(tokens)::DOUBLE AS tokens, sum(tokens)::DOUBLE AS weight"
        f" FROM measured GROUP BY {key})",
    ]
    for d in DIMENSIONS:
        parts.append(
            f"t_{d} AS (SELECT {d}, pow(sum(tokens), {POWER}) / sum(pow(sum(tokens), {POWER}))"
            f" OVER () AS share FROM cells0 GROUP BY {d})"
        )
    step = 0
    for _ in range(ROUNDS):
        for d in DIMENSIONS:
            parts.append(
                f"cells{step + 1} AS (SELECT {key}, tokens, CASE WHEN sum(weight) OVER (PARTITION BY"
                f" {d}) > 0 THEN weight * share * (SELECT sum(tokens) FROM cells0) / sum(weight) OVER"
                f" (PARTITION BY {d}) ELSE 0 END AS weight FROM cells{step} JOIN t_{d} USING ({d}))"
            )
            step += 1
    parts.append(
        f"rates AS (SELECT {key}, tokens, CASE WHEN tokens > 0 THEN weight / tokens ELSE 1 END AS"
        f" rate FROM cells{step})"
    )
    parts.append(f"f0 AS (SELECT {KEEP}::DOUBLE AS f)")
    for k in range(FILL_STEPS):
        parts.append(
            f"f{k + 1} AS (SELECT CASE WHEN sum(CASE WHEN rate * f >= 1 THEN 0 ELSE tokens * rate END)"
            f" > 0 THEN greatest(0, {KEEP} * sum(tokens) - sum(CASE WHEN rate * f >= 1 THEN tokens"
            " ELSE 0 END)) / sum(CASE WHEN rate * f >= 1 THEN 0 ELSE tokens * rate END) ELSE any_value(f)"
            f" END AS f FROM rates, f{k})"
        )
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT m.doc_id, m.source, m.lang, m.topic, m.tokens,"
        " round(least(1.0, rate * f), 6) AS probability,"
        f" ('0x' || substr(md5('{SEED}:' || coalesce(CAST(m.doc_id AS VARCHAR), '')), 1, 8))::BIGINT"
        " / 4294967296.0 < least(1.0, rate * f) AS kept"
        f" FROM measured m JOIN rates r USING ({key}), f{FILL_STEPS}"
    )
