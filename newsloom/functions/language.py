"""Language of a text: by its script where most letters are not Latin, else by counting frequent
short words; row by row, without a shuffle. ``operators.languages`` learns profiles instead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom.functions.arrays import let


def words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}]+")


def best_language(found: Column, stop_words: dict[str, str]) -> Column:
    """Language with the most known words; of equally good ones the alphabetically first."""
    known_to_any = sorted(set(" ".join(stop_words.values()).split()))
    return let(
        F.filter(found, lambda word: word.isin(known_to_any)),
        lambda kept: most_hits(kept, stop_words),
    )


def most_hits(found: Column, stop_words: dict[str, str]) -> Column:
    ranked = []
    for place, language in enumerate(sorted(stop_words)):
        known = sorted(set(stop_words[language].split()))
        hits = F.size(F.filter(found, lambda word: word.isin(known)))
        ranked.append(
            F.struct(hits.alias("hits"), F.lit(-place).alias("place"), F.lit(language).alias("language"))
        )
    best = F.array_max(F.array(*ranked))
    return F.when(best["hits"] > 0, best["language"])


# Signs that are written beside a script's own letters: Japanese mixes three scripts.
BESIDE = {"ja": ["Hiragana", "Katakana", "Han"]}


def _letters(text: Column, scripts: list[str]) -> Column:
    kept = "".join(rf"\p{{Is{script}}}" for script in scripts)
    return F.length(F.regexp_replace(text, f"[^{kept}]+", ""))


def script_language(text: Column) -> Column:
    """Language of a text of which most letters are of a script of its own; NULL for the Latin
    script. The script with the most letters counts."""

    def of_others(others: Column) -> Column:
        shares = []
        for place, (script, language) in enumerate(fv.SCRIPT_LANGUAGES):
            own = _letters(others, [script])
            count = F.when(own > 1, _letters(others, BESIDE.get(language, [script]))).otherwise(0)
            shares.append(
                F.struct(count.alias("n"), F.lit(-place).alias("place"), F.lit(language).alias("language"))
            )
        best = F.array_max(F.array(*shares))
        return F.when(best["n"] > 0, best["language"])

    # Most texts end here: nothing but Latin letters.
    others = F.regexp_replace(text, r"[\p{IsLatin}\P{L}]+", "")
    latin = F.length(F.regexp_replace(text, r"\P{IsLatin}+", ""))
    most = let(others, lambda others: F.when(F.length(others) > latin, of_others(others)))
    return F.when(text.rlike(r"[^\p{IsLatin}\P{L}]{2}"), most)


def guess_language(text: Column, stop_words: dict[str, str] | None = None) -> Column:
    """Two-letter code of the best language; ``unknown`` for no text and no clue."""
    stop_words = fv.STOP_WORDS if stop_words is None else stop_words
    best = let(words(text), lambda found: best_language(found, stop_words))
    return F.coalesce(script_language(text), best, F.lit(fv.UNKNOWN_LANGUAGE))
