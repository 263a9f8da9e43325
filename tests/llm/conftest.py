import random

import pytest


def word(rng):
    return "".join(rng.choice(["an", "the", "ing", "ré", "sch", "ción", "O", "un"]) for _ in range(rng.randint(1, 3)))


def sentence(rng, words):
    return " ".join(word(rng) for _ in range(words))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, shared lines, odd and empty ones."""
    rng = random.Random(7)
    base = [sentence(rng, rng.randint(30, 90)) for _ in range(12)]
    passage = sentence(rng, 70)
    line = sentence(rng, 14)
    out = list(base)
    out += base[:3]
    for k in range(12):
        words = base[k % 4].split(" ")
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(len(words))] = word(rng)
        out.append(" ".join(words))
    out += [f"{sentence(rng, 9)} {passage} {sentence(rng, 11)}" for _ in range(5)]
    out += [f"{sentence(rng, 12)}\n{line}\n{sentence(rng, 9)}\n{line} {word(rng)}" for _ in range(4)]
    out += ["x" * 700, "abcz" * 120, sentence(rng, 3), "Two Words", "two words", "one", " \n\t ", "", None]
    out += ["\n".join([sentence(rng, 8)] * 5), "№ ½ ² Å 日本語 " + sentence(rng, 12)]
    return out


CLASHES = {"n": 1, "sig": 2, "key": 3, "row": 4, "token": 5, "text_a": 6, "bucket": 7, "_key": 8,
           "kept": 9, "part": 10, "x": 11}


@pytest.fixture(scope="session")
def documents(spark, texts):
    """Documents with null ids and columns, a repeated row, and columns whose names clash."""
    rows = [
        (k, t, ["en", "de", None][k % 3], [f"src{k % 4}", None][k % 7 == 6], len(t or ""))
        for k, t in enumerate(texts)
    ]
    rows += [rows[4], (None, texts[1], None, None, None), (None, None, "en", "src0", 0)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    frame = spark.createDataFrame(rows, schema).repartition(3)
    for name, value in CLASHES.items():
        from pyspark.sql import functions as F

        frame = frame.withColumn(name, F.lit(value))
    return frame


@pytest.fixture(scope="session")
def labels(spark, texts):
    rows = [(k, k % 2, (k // 2) % 2) for k in range(len(texts))] + [(None, 1, 1), (1, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)
