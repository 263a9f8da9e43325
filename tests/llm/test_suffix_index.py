import random

import numpy as np
import pyarrow as pa
import pytest

from brute import repeats
from newsloom.llm import suffix_index


def rows_of(frame):
    return {row["doc_id"]: tuple(row)[1:] for row in frame.collect()}


@pytest.mark.parametrize("length, seed, batches", [(60, 12, 4), (200, 40, 3)])
def test_equals_brute_force(spark, length, seed, batches):
    rng = random.Random(length)
    letters = "ab é" if length < 100 else "abcdef g"
    base = "".join(rng.choice(letters) for _ in range(2500))
    texts = [None, "", "z" * 900, "abcabd" * 150, "short"]
    for _ in range(25):
        at = rng.randrange(2000)
        text = base[at : at + rng.randint(1, 500)]
        text += "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        texts.append(text + base[at // 2 : at // 2 + rng.randint(1, 400)])
    texts += texts[5:7]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = rows_of(suffix_index.digest(suffix_index.remove_repeats(frame, length, seed, batches)))
    assert got == dict(enumerate(repeats(texts, length)))


def test_repeated_rows_and_null_ids(documents, texts):
    got = suffix_index.digest(suffix_index.remove_repeats(documents, 100, 20, 2)).collect()
    extra = [texts[4], texts[1], None]
    want = repeats(texts + extra, 100)
    keyed = sorted((row for row in got), key=str)
    ids = list(range(len(texts))) + [4, None, None]
    assert keyed == sorted(
        (type(got[0])(i, *w) for i, w in zip(ids, want)), key=str
    )


def test_long_text_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(suffix_index, "STRETCH", 64)
    rng = random.Random(1)
    part = "".join(rng.choice("abcdefgh") for _ in range(500))
    texts = [part + "x" + part[:300], part[100:400], "y" * 300]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = rows_of(suffix_index.digest(suffix_index.remove_repeats(frame, 100, 20, 1)))
    assert got == dict(enumerate(repeats(texts, 100)))


def test_crowds_are_dealt_out(spark, texts, monkeypatch):
    monkeypatch.setattr(suffix_index, "CROWD", 1)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    got = rows_of(suffix_index.digest(suffix_index.remove_repeats(frame, 100, 20, 2)))
    assert got == dict(enumerate(repeats(texts, 100)))


def test_merges_write_one_file_a_bucket(spark, texts):
    index = suffix_index.SuffixIndex(spark, 60, 12, buckets=5)
    frame = spark.createDataFrame(list(enumerate(texts)), "key bigint, text string")
    for part in range(2):
        index.add(frame.where(f"key % 2 = {part}"))
    (level, (name, _)), = index.levels.items()
    assert level == 1
    files = spark.table(name).inputFiles()
    assert 0 < len(files) <= 5


def test_windows_without_any_repeat():
    bodies = pa.table({
        "seed": pa.array([1, 1], pa.int64()), "key": pa.array([7, 8], pa.int64()),
        "lo": pa.array([0, 0], pa.int32()), "known": [False, False], "data": [b"abcdefghi", b"jklmnopqr"],
    })
    assert suffix_index.repeated_windows(bodies, 8).num_rows == 0
    assert suffix_index.repeated_windows(bodies.slice(0, 0), 8).num_rows == 0
    assert suffix_index.covered(np.zeros(0, int), np.zeros(0, int))[0].size == 0


def test_empty_table(nothing):
    assert suffix_index.remove_repeats(nothing).count() == 0
