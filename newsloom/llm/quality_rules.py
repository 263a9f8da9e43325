"""Quality rules: document statistics, a fixed base rule, and gradient-boosted trees.

The statistics of a text are exact counts over all of it. The base rule rejects texts of fewer
than MIN_WORDS words and texts in which over REPEAT_PERCENT of the words lie in repeated windows.
The rest is judged by trees fitted to labelled documents; the probability of "good" may only fall
with the shares of symbols, repeats, repeated lines, shouting and table bars.

Defined cases: a null text counts as empty (no words, so the base rule rejects it); a null id is
carried through; repeated rows are judged each on its own; without labels of both classes the
trees have no verdict and only the base rule decides; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.arrays import (
    Piece,
    Rolling,
    frugal,
    gram_hashes,
    mix,
    per_text,
    pieces,
    words,
)
from newsloom.llm.boosted_trees import Forest, fit

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
# Bound of the labelled rows that the trees are fitted to (about; chosen by a hash of the id).
TRAIN_ROWS = 20_000
THRESHOLD = 0.5

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Feature name and whether "good" may rise (+1) or only fall (-1) with it; 0: free.
FEATURES = {
    "log_words": 0,
    "chars_per_word": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "bars_per_word": -1,
    "shouts_per_word": -1,
    "words_per_line": 0,
    "distinct_share": 0,
}


def _repeated(keys: np.ndarray) -> np.ndarray:
    """For each key whether it occurs twice or more."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(keys), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.zeros(len(keys), bool)
    out[order] = twice
    return out


def _distinct_per_text(keys: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    _, first = np.unique(keys, return_index=True)
    return np.bincount(owner[first], minlength=texts)


def statistics(piece: Piece) -> dict[str, np.ndarray]:
    """The counts of the contract and the features of the trees, by text."""
    data, offsets, texts = piece.data, piece.offsets, len(piece)
    found = words(piece)
    rolling = Rolling(data)
    hashes = rolling.hashes(found.starts, found.ends)
    owner, counts = found.owner, found.counts
    salt = mix(np.arange(1, texts + 1, dtype=np.uint64))

    def bytes_where(mask: np.ndarray) -> np.ndarray:
        return per_text(mask, offsets)

    letters = (data & 0xC0) != 0x80
    point_sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(letters, out=point_sums[1:])
    chars = per_text(point_sums[found.ends] - point_sums[found.starts], found.first)

    breaks = np.flatnonzero(data == 0x0A)
    line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line_owner = np.searchsorted(offsets, line_starts, "right") - 1
    inside = (line_owner < texts) & (line_starts < offsets[np.minimum(line_owner, texts - 1) + 1])
    line_starts, line_owner = line_starts[inside], line_owner[inside]
    next_break = np.append(breaks, len(data))[np.searchsorted(breaks, line_starts)]
    line_ends = np.minimum(next_break, offsets[line_owner + 1])
    wordy = np.searchsorted(found.starts, line_ends) > np.searchsorted(found.starts, line_starts)
    line_starts, line_ends, line_owner = line_starts[wordy], line_ends[wordy], line_owner[wordy]
    lines = np.bincount(line_owner, minlength=texts)
    line_keys = rolling.hashes(line_starts, line_ends) ^ salt[line_owner]
    dup_lines = lines - _distinct_per_text(line_keys, line_owner, texts)

    grams = gram_hashes(hashes, WINDOW)
    whole = owner[: len(grams)] == owner[len(owner) - len(grams) :]
    at = np.flatnonzero(whole)
    twice = at[_repeated(grams[at] ^ salt[owner[at]])]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, np.minimum(twice + WINDOW, len(hashes)), -1)
    repeats = per_text(np.cumsum(cover[:-1]) > 0, found.first)

    out = {
        "n_words": counts.astype(np.int64),
        "word_chars": chars,
        "n_symbols": bytes_where(SYMBOL[data]),
        "n_dup_lines": dup_lines.astype(np.int64),
        "n_repeat_words": repeats,
    }
    n = np.maximum(counts, 1)
    out["x"] = np.column_stack([
        np.log1p(counts),
        chars / n,
        out["n_symbols"] / n,
        dup_lines / np.maximum(lines, 1),
        repeats / n,
        bytes_where((data >= 65) & (data <= 90)) / np.maximum(chars, 1),
        bytes_where((data >= 48) & (data <= 57)) / np.maximum(chars, 1),
        bytes_where(data == ord("|")) / n,
        bytes_where(data == ord("!")) / n,
        np.log1p(counts / np.maximum(lines, 1)),
        _distinct_per_text(hashes ^ salt[owner], owner, texts) / n,
    ])
    return out


def base_failed(found: dict[str, np.ndarray]) -> np.ndarray:
    return (found["n_words"] < MIN_WORDS) | (
        100 * found["n_repeat_words"] > REPEAT_PERCENT * found["n_words"]
    )


def training_table(
    documents: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS
) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of about ``rows`` labelled documents, chosen by a hash of the id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max(label).cast("double").alias("_label"))
    count = known.count()
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(max(count, 1)))
    sample = known.where(spread < rows).limit(2 * rows)
    chosen = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    width = len(FEATURES)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                x = statistics(piece)["x"]
                y = batch.column("_label").slice(piece.first, len(piece))
                flat = pa.array(x.ravel(), pa.float64())
                lists = pa.FixedSizeListArray.from_arrays(flat, width).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([lists, y], ["x", "y"])

    table = chosen.mapInArrow(frugal(measure), "x array<double>, y double").toArrow()
    x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return x.reshape(-1, width), table.column("y").to_numpy()


def fit_rules(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Forest | None:
    """None where the labels do not hold both classes."""
    x, y = training_table(documents, labels, rows=rows)
    if len(set(y.tolist())) < 2:
        return None
    return fit(x, y, np.array(list(FEATURES.values())))


def verdicts(found: dict[str, np.ndarray], forest: Forest | None) -> tuple[np.ndarray, ...]:
    """base_failed, the trees' probability of "good", kept."""
    failed = base_failed(found)
    good = np.ones(len(failed)) if forest is None else forest.probabilities(found["x"])
    return failed, good, ~failed & (good >= THRESHOLD)


def judge(documents: DataFrame, forest: Forest | None) -> DataFrame:
    """One row per document: its counts and the verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                found = statistics(piece)
                failed, good, kept = verdicts(found, forest)
                ids = batch.column("doc_id").slice(piece.first, len(piece))
                columns = [ids, *(pa.array(found[name]) for name in COUNTS)]
                columns += [pa.array(failed), pa.array(good), pa.array(kept)]
                names = ["doc_id", *COUNTS, "base_failed", "good", "kept"]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{name} bigint" for name in COUNTS)
    return documents.select("doc_id", "text").mapInArrow(
        frugal(run), f"doc_id {kind}, {counts}, base_failed boolean, good double, kept boolean"
    )


def keep_good(documents: DataFrame, forest: Forest | None) -> DataFrame:
    """The documents that pass, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = [
                verdicts(statistics(piece), forest)[2] for piece in pieces(batch.column("text"))
            ]
            if masks:
                yield batch.filter(pa.array(np.concatenate(masks)))

    return documents.mapInArrow(frugal(run), documents.schema)
