"""Toxicity: learned terms, also misspelled, weighed by the words around them.

The lexicon is learned from labelled documents: words and word beginnings that toxic documents
hold far more often than others. All words of every text are read by the lexicon's trie
intersected with Levenshtein automata. A word close to a term that clean documents use is not a
misspelling. Each match is split, by the window of words around it, into abuse and quotation
(inside quotes, after a verb of saying), and a logistic model over the summed weights gives the
score; its weights start from priors, under which quotation counts less.

Only the texts and the labels of documents outside the held-out fold (crc32 of the id, modulo 5,
is 0) are learned from; at most about TRAIN_ROWS labelled documents are used.

Defined cases: null and empty texts have no match and get the score of that; a null id counts as
held out; without labels of both classes the lexicon is empty and every score is the share of
toxic labels (0.0 without any); repeated rows are scored each on its own; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.lexicon_automaton import Lexicon

# Bound (about) of the labelled documents that are learned from, chosen by a hash of the id.
TRAIN_ROWS = 20_000
# Bound of the lexicon, and of the close words whose counts are kept.
LEXICON = 2_000
STEM_SIZES = (4, 5, 6)
# A unit is taken if its counts are this surprising (G statistic), and this much likelier in
# toxic documents.
SURPRISE = 30.0
LIFT = 8.0
# Words around a match that decide whether it is a quotation.
WINDOW = 6
QUOTES = "\"“”„«»‚‘’"
EDGES = ".,;:!?()[]{}<>…" + QUOTES + "'"
# Verbs of saying, in the languages of the corpus.
SAYING = frozenset(
    "said says wrote called quoted dit écrit appelle sagte schrieb nannte dijo escribió llamó".split()
)
# Distinct raw words remembered as free of matches in each worker.
CLEAN_WORDS = 400_000


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(True))


def _surprise(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """G statistic of a of n_a against b of n_b."""
    share = (a + b) / (n_a + n_b)

    def part(count, expected):
        return np.where(count > 0, count * np.log(np.maximum(count, 1e-9) / expected), 0)

    return 2 * (part(a, n_a * share) + part(b, n_b * share))


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    term_weights: list[float] = field(default_factory=list)
    stem_weights: list[float] = field(default_factory=list)
    close_weights: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(6))


class Reader:
    """Finds the matches of a model in texts."""

    def __init__(self, model: Model):
        self.model = model
        self.lexicon = Lexicon(model.terms, model.stems)
        self.clean: set[str] = set()
        self.matched: dict[str, tuple[float, bool, str]] = {}

    def _judge(self, raw: str) -> tuple[float, bool, str] | None:
        """Weight, whether misspelled, and the word itself."""
        word = raw.strip(EDGES)
        found = self.lexicon.match(word) if word else None
        if found is None:
            return None
        kind, number, errors = found
        if kind == "stem":
            return self.model.stem_weights[number], False, word
        weight = self.model.term_weights[number]
        if errors:
            weight = self.model.close_weights.get(word, weight / (1 + errors))
            if weight <= 0:
                return None
        return weight, errors > 0, word

    def matches(self, words: list[str]) -> set[str]:
        fresh = set(words)
        fresh.difference_update(self.clean)
        found = set()
        for raw in fresh:
            if raw not in self.matched:
                judged = self._judge(raw)
                if judged is None:
                    self.clean.add(raw)
                    continue
                self.matched[raw] = judged
            found.add(raw)
        if len(self.clean) > CLEAN_WORDS:
            self.clean.clear()
        if len(self.matched) > CLEAN_WORDS:
            self.matched.clear()
        return found

    @staticmethod
    def quoted(words: list[str], at: int) -> float:
        """How far the words around one speak for a quotation: 0 to 1."""
        before, after = words[max(0, at - WINDOW) : at], words[at + 1 : at + 1 + WINDOW]
        own = words[at]
        opened = own[0] in QUOTES or any(w[0] in QUOTES for w in before)
        opened &= not any(w.rstrip(".,;:!?")[-1:] in QUOTES and w[0] not in QUOTES for w in before if w)
        closed = own.rstrip(".,;:!?")[-1:] in QUOTES or any(
            w.rstrip(".,;:!?")[-1:] in QUOTES for w in after if w.rstrip(".,;:!?")
        )
        score = 0.7 if opened and closed and own.rstrip(".,;:!?") else 0.0
        if any(w.strip(EDGES) in SAYING for w in before + after):
            score += 0.3
        return score

    def features(self, text: str | None) -> tuple[list[float], tuple[int, int, int]]:
        """Sums of weights (abuse, quotation; exact and misspelled), and the counts of terms,
        misspellings and quotations."""
        words = (text or "").lower().split()
        found = self.matches(words)
        sums = [0.0, 0.0, 0.0, 0.0]
        counts = [0, 0, 0]
        if found:
            best: dict[str, list[float]] = {}
            for at, raw in enumerate(words):
                if raw not in found:
                    continue
                weight, close, word = self.matched.get(raw) or self._judge(raw)
                quote = self.quoted(words, at)
                counts[0] += 1
                counts[1] += close
                counts[2] += quote >= 0.5
                now = best.setdefault(word, [0.0, 0.0, 0.0, 0.0])
                now[2 * close] = max(now[2 * close], weight * (1 - quote))
                now[2 * close + 1] = max(now[2 * close + 1], weight * quote)
            # A few distinct words decide; a long list adds little.
            for k in range(4):
                sums[k] = sum(sorted((v[k] for v in best.values()), reverse=True)[:4])
        hits = counts[0] / (len(words) + 20)
        return [1.0, *sums, math.log1p(100 * hits)], tuple(counts)


PRIOR = np.array([-3.0, 1.0, 0.2, 1.0, 0.2, 0.0])


def _fit_weights(x: np.ndarray, y: np.ndarray, spread: float = 1.0) -> np.ndarray:
    """Logistic regression with Gaussian priors around PRIOR, by Newton's method."""
    weights = PRIOR.copy()
    precision = np.eye(len(PRIOR)) / spread**2
    precision[0, 0] = 0.01
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (y - p) - precision @ (weights - PRIOR)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + precision
        step = np.linalg.solve(hessian, gradient)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def _units(words: set[str]) -> set[str]:
    """Whole words (as they are) and beginnings (with a trailing star)."""
    out = set(words)
    for size in STEM_SIZES:
        out.update(w[:size] + "*" for w in words if len(w) > size)
    return out


def _training(documents: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic) of about ``rows`` labelled documents outside the held-out fold."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("_toxic")
    )
    count = known.count()
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(max(count, 1)))
    sample = known.where(spread < rows).limit(2 * rows)
    texts = documents.select("doc_id", "text").where(~held_out(F.col("doc_id")))
    return texts.join(F.broadcast(sample), "doc_id").select("text", "_toxic")


def _unit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    seen = [0, 0]
    for batch in batches:
        texts, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for text, toxic in zip(texts, marks, strict=True):
            words = {w.strip(EDGES) for w in set((text or "").lower().split())} - {""}
            counts[toxic].update(_units(words))
            seen[toxic] += 1
    names = list(counts[1])
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(["", *names], pa.string()),
            pa.array([seen[1], *(counts[1][u] for u in names)], pa.int64()),
            pa.array([seen[0], *(counts[0][u] for u in names)], pa.int64()),
        ],
        ["unit", "toxic", "clean"],
    )
    only = [u for u in counts[0] if u not in counts[1]]
    for first in range(0, len(only), 100_000):
        some = only[first : first + 100_000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(some, pa.string()),
                pa.array([0] * len(some), pa.int64()),
                pa.array([counts[0][u] for u in some], pa.int64()),
            ],
            ["unit", "toxic", "clean"],
        )


def _lexicon(units: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> Model:
    """Units that stand out; a beginning makes the longer ones under it superfluous unless they
    are clearly better."""
    model = Model()
    if not units:
        return model
    names = [u for u, _, _ in units]
    a = np.array([t for _, t, _ in units], float)
    b = np.array([c for _, _, c in units], float)
    lift = ((a + 0.5) / (n_toxic + 1)) / ((b + 0.5) / (n_clean + 1))
    good = (_surprise(a, b, n_toxic, n_clean) >= SURPRISE) & (lift >= LIFT)
    ranked = sorted((k for k in np.flatnonzero(good)), key=lambda k: (len(names[k].rstrip("*")), names[k]))
    taken: dict[str, float] = {}
    for k in ranked:
        name, weight = names[k], float(np.log(lift[k]))
        word = name.rstrip("*")
        above = [taken.get(word[:size] + "*", 0.0) for size in STEM_SIZES if size <= len(word)]
        if name.endswith("*"):
            # A beginning that mostly stands for one whole word is left to that word.
            whole = next((a[j] for j in _longer(names, word) if good[j]), 0)
            if whole >= 0.9 * a[k] or weight < max(above, default=0.0) + 0.5:
                continue
        elif weight < max(above, default=0.0) + 0.5:
            continue
        taken[name] = weight
    best = sorted(taken.items(), key=lambda item: (-item[1], item[0]))[:LEXICON]
    for name, weight in best:
        if name.endswith("*"):
            model.stems.append(name[:-1])
            model.stem_weights.append(weight)
        else:
            model.terms.append(name)
            model.term_weights.append(weight)
    return model


def _longer(names: list[str], stem: str) -> list[int]:
    return [
        k for k, name in enumerate(names) if not name.endswith("*") and name.startswith(stem)
    ]


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    sample = _training(documents, labels, rows)
    counted = (
        sample.mapInArrow(_unit_counts, "unit string, toxic bigint, clean bigint")
        .groupBy("unit")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    frequent = counted.where("unit = '' OR toxic >= 4").where(
        f"unit = '' OR toxic + 0.5 >= {LIFT} * 0.02 * (clean + 0.5)"
    )
    units = [tuple(r) for r in frequent.orderBy(F.desc("toxic"), "unit").limit(50 * LEXICON).collect()]
    n_toxic = sum(t for u, t, _ in units if not u)
    n_clean = sum(c for u, _, c in units if not u)
    if not n_toxic or not n_clean:
        share = 0.0 if not n_toxic else 1.0
        return Model(weights=np.array([40.0 * (2 * share - 1), 0, 0, 0, 0, 0]))
    model = _lexicon([u for u in units if u[0]], n_toxic, n_clean)

    def close_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words near a term, with the documents of each class that hold them."""
        reader = Reader(model)
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            texts, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for text, toxic in zip(texts, marks, strict=True):
                found = reader.matches((text or "").lower().split())
                judged = {reader.matched[raw][1:] for raw in found if raw in reader.matched}
                counts[toxic].update(word for close, word in judged if close)
        names = sorted(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.string()),
                pa.array([counts[1][w] for w in names], pa.int64()),
                pa.array([counts[0][w] for w in names], pa.int64()),
            ],
            ["unit", "toxic", "clean"],
        )

    close = (
        sample.mapInArrow(close_words, "unit string, toxic bigint, clean bigint")
        .groupBy("unit")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where("clean > 0")
        .orderBy(F.desc("clean"), "unit")
        .limit(10 * LEXICON)
        .collect()
    )
    for word, a, b in close:
        lift = ((a + 0.5) / (n_toxic + 1)) / ((b + 0.5) / (n_clean + 1))
        model.close_weights[word] = float(np.log(lift)) if lift >= LIFT else 0.0

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            x = [reader.features(t)[0] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "y"]
            )

    table = sample.mapInArrow(measure, "x array<double>, y int").toArrow()
    x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    model.weights = _fit_weights(x.reshape(-1, len(PRIOR)), table.column("y").to_numpy())
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, and the counts of matches, misspellings, quotations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            xs, counts = [], []
            for value in batch.column("text"):
                x, count = reader.features(value.as_py())
                xs.append(x)
                counts.append(count)
            margins = np.array(xs).reshape(-1, len(PRIOR)) @ model.weights
            scores = 1 / (1 + np.exp(-np.clip(margins, -40, 40)))
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(scores)]
            columns.append(pa.array((scores >= 0.5).astype(np.int32)))
            table = np.array(counts, np.int64).reshape(-1, 3)
            columns += [pa.array(table[:, k].copy()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                columns,
                ["doc_id", "held_out", "score", "predicted", "n_terms", "n_misspelled", "n_quoted"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        run,
        f"doc_id {kind}, held_out boolean, score double, predicted int, n_terms bigint, "
        "n_misspelled bigint, n_quoted bigint",
    )
