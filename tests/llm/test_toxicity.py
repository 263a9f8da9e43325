import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import toxicity
from newsloom.llm.lexicon_automaton import Lexicon, allowed_errors


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


TERMS = ["abab", "ababa", "babbab", "abbaabbab", "cabcabcabc"]
LEXICON = Lexicon(TERMS, [])


@given(st.text("abc", max_size=12))
@settings(max_examples=400, deadline=None)
def test_automaton_equals_distance(word):
    near = [
        (distance(word, t), k) for k, t in enumerate(TERMS) if distance(word, t) <= allowed_errors(t)
    ]
    found = LEXICON.match(word)
    assert (found is None) == (not near)
    if near:
        assert (found[2], found[1]) == min(near)


def test_stems():
    lexicon = Lexicon(["moron"], ["lowei"])
    assert lexicon.match("loweiung") == ("stem", 0, 0)
    assert lexicon.match("moran") == ("term", 0, 1)
    assert lexicon.match("slowei") is None


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    plain = ["table", "house", "green", "window", "walking", "station", "often", "under"]
    rows, marks = [], []
    for k in range(400):
        words = [rng.choice(plain) for _ in range(rng.randint(15, 60))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["zorgfool", "blapnit"]))
        rows.append((k, " ".join(words)))
        marks.append((k, int(toxic)))
    rows += [
        (1001, " ".join(plain) + " you zorgfoool " + " ".join(plain)),
        (1002, " ".join(plain) + ' he said "zorgfool" and ' + " ".join(plain)),
        (1003, " ".join(plain) + " zorgfool " + " ".join(plain)),
        (1004, None), (1005, ""), (None, "zorgfool blapnit"),
    ]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    return documents, spark.createDataFrame(marks, "doc_id bigint, toxic int")


@pytest.fixture(scope="module")
def scored(corpus):
    documents, labels = corpus
    model = toxicity.train(documents, labels)
    return {r["doc_id"]: r for r in toxicity.score(documents, model).collect()}, labels


def test_held_out_accuracy(scored):
    rows, labels = scored
    held = [r for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    right = sum(rows[r["doc_id"]]["predicted"] == r["toxic"] for r in held)
    assert len(held) > 40 and right >= 0.95 * len(held)


def test_misspelled_and_quoted(scored):
    rows, _ = scored
    assert rows[1001]["n_misspelled"] == 1
    assert rows[1002]["n_quoted"] == 1 and rows[1003]["n_quoted"] == 0
    assert rows[1002]["score"] < rows[1003]["score"]
    assert rows[1004]["score"] == rows[1005]["score"] < 0.5
    assert rows[None]["held_out"] is True


def test_labels_of_one_class_and_no_rows(corpus, nothing):
    documents, labels = corpus
    one = toxicity.train(documents, labels.where("toxic = 0"))
    assert toxicity.score(documents, one).where("predicted = 1").count() == 0
    none = toxicity.train(documents, labels.limit(0))
    assert toxicity.score(documents, none).count() == documents.count()
    assert toxicity.score(nothing, none).count() == 0
