"""Error phrases from a table: equal to the patterns of the built-in lists, whatever is added."""

import random
import re

import pytest
from pyspark.sql import functions as F

from newsloom.operators import phrases, quality


def test_finder_equals_patterns():
    """Random texts around phrases, against the patterns built from the same lists."""
    rng = random.Random(2)
    lists = {"title": quality.title_pattern(), "body": quality.body_pattern()}
    for scope, pattern in lists.items():
        python = pattern.replace("\\p{Z}", " \\u00a0\\u2003\\u3000").replace("\\x{0B}", "\\x0b")
        python = re.sub(r"\\x\{(..)\}", r"\\x\1", python).replace("\\z", "\\Z")
        rows = [r[1:] for r in phrases.built_in() if r[0] == scope]
        find = phrases.finder(rows)
        found = 0
        for _ in range(4000):
            phrase = rng.choice(rows)[0].lower().replace("#", str(rng.randrange(10))).replace(".", rng.choice("x \n"))
            text = rng.choice(["", "a", " ", "a ", "\u00a0", "x\n"]) + phrase + rng.choice(["", "b", " ", " b", "\u3000", "."])
            if rng.random() < 0.2:
                text = text.replace(rng.choice(text), "y", 1)
            assert find(text) == bool(re.search(python, text)), (scope, text)
            found += find(text)
        assert 1000 < found < 3900


def test_anchors():
    find = phrases.finder([
        ("Foo.#", "blank", "blank"), ("bar", "any", "end"), ("baz", "end", "any"), ("qux", "blank", "blank_only"),
        ("fo", "blank", "blank"),
    ])
    assert find("foo-7") and find("x foo 1 y") and not find("foo\n1") and not find("foo-x") and not find("xfoo-7")
    assert find("xbar") and not find("bar ") and find("bazaar") and not find(" baz")
    assert find("qux ") and not find("qux") and find("a fo") and not find("foo")
    assert not phrases.finder([])("anything")
    with pytest.raises(ValueError):
        phrases.finder([("..", "any", "any")])


def test_callers_phrases_and_bounds(spark, monkeypatch):
    rows = [("title", "gone fishing", "blank", "blank"), ("body", "nothing to see", "any", "any")]
    gate = phrases.PhraseGate(spark, spark.createDataFrame(rows, phrases.SCHEMA))
    pages = [
        "<title>Gone Fishing</title><body>a</body>", "<title>x</title><body>Nothing to see, really</body>",
        "<title>404</title><body>a</body>", "<title></title><body>a</body>", "<body>a</body>",
        "<title>x</title><body></body>", "<title>x</title>", None,
    ]
    frame = spark.createDataFrame([(k, h) for k, h in enumerate(pages)], "k int, html string")
    got = {r["k"]: (r["t"], r["b"]) for r in frame.select(
        "k", gate.is_bad_title(F.col("html")).alias("t"), gate.is_bad_raw_body(F.col("html")).alias("b")
    ).collect()}
    assert [got[k] for k in range(7)] == [
        (True, False), (False, True), (False, False), (True, False), (True, False), (False, True), (False, True)
    ]
    monkeypatch.setattr(phrases, "MOST_PHRASES", 1)
    with pytest.raises(ValueError):
        phrases.PhraseGate(spark, spark.createDataFrame(rows, phrases.SCHEMA))
    with pytest.raises(ValueError):
        phrases.PhraseGate(spark, spark.createDataFrame([("title", "x", "near", "any")], phrases.SCHEMA))
