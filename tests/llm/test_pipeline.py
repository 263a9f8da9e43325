"""Every stage of the pipeline against plain Python on its own input."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brute import components, counts, lines_gone, shingles, similar
from newsloom.llm.tables import stored
from newsloom.llm.tokens import Encoder, default_path

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], FOLDER), name))
    return [frame.toPandas() for frame in out]


def test_columns(stages):
    assert all(list(frame.columns) == list(stages[0].columns) for frame in stages[:-1])


def test_quality_rules(stages):
    before, after = stages[0].set_index("doc_id"), stages[1].set_index("doc_id")
    assert set(after.index) <= set(before.index)
    for k, text in after.text.items():
        n, _, _, _, repeated = counts(text)
        assert n >= 10 and 100 * repeated <= 20 * n and text == before.text[k]
    assert len(after) > 0.7 * len(before)


def test_line_dedup(stages):
    before = stages[1].sort_values("doc_id")
    want = {}
    rows = list(zip(before.doc_id, before.text))
    for (k, text), gone in zip(rows, lines_gone(rows), strict=True):
        kept = "\n".join(x for j, x in enumerate(text.split("\n")) if j not in gone)
        if not gone or re.search(r"[^\x20\x09-\x0D]", kept):
            want[k] = kept
    assert dict(zip(stages[2].doc_id, stages[2].text)) == want
    assert all(len(t) == n for t, n in zip(stages[2].text, stages[2].n_chars))


def test_near_duplicates(stages):
    before = stages[2]
    sets = {k: shingles(t, 5) for k, t in zip(before.doc_id, before.text)}
    groups = components(sorted(sets), lambda a, b: similar(sets[a], sets[b], 80))
    assert set(stages[3].doc_id) == set(groups.values())


def test_mixing(stages):
    before, after = stages[3].set_index("doc_id"), stages[4].set_index("doc_id")
    assert set(after.index) < set(before.index)
    assert all(after.text[k] == before.text[k] for k in after.index)


def test_packing(stages):
    encoder = Encoder.at(default_path())
    texts = stages[4].set_index("doc_id").text
    pieces = stages[5].sort_values(["doc_id", "piece"])
    for k, rows in pieces.groupby("doc_id"):
        ids = [i for row in rows.ids for i in row]
        assert ids == [*encoder.ids(texts[k]).tolist(), 0]
    assert set(pieces.doc_id) == set(texts.index)
    assert (pieces.groupby("sequence_id").length.sum() <= 2048).all()


def run_stages(spark, docs):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], FOLDER), name))
    return out


def test_odd_rows(spark, documents):
    """Null ids, repeated rows and clashing names go through; each stage keeps columns."""
    frames = run_stages(spark, documents.withColumn("kept_text", F.lit("mine")))
    assert all(frame.columns == frames[0].columns for frame in frames[:-1])
    assert all(r["kept_text"] == "mine" for r in frames[3].select("kept_text").collect())
    assert frames[3].count() > 0


def test_rows_that_share_ids(spark):
    """Decisions hold for rows, not for ids: which rows stay."""
    rng = random.Random(3)
    a, b, c, d = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(4))
    near_c = c.rsplit(" ", 1)[0] + " changed"
    rows = [
        (3, a), (7, a), (7, b), (None, c), (None, near_c), (9, near_c), (None, d), (None, d), (11, "x"), (11, "x"),
        (None, None), (None, None),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(*row, "en", "s", 1) for row in rows], schema).repartition(3)
    kept = corpus_pipeline.one_of_each(spark, docs, FOLDER).collect()
    got = sorted(((r["doc_id"], r["text"]) for r in kept), key=repr)
    assert got == sorted([(3, a), (7, b), (9, near_c), (None, d), (11, "x"), (None, None), (None, None)], key=repr)
    # Two texts under one id are drawn apart, and what is drawn is a row.
    many = [(k % 2, f"{a} {k}") for k in range(40)] + [(None, f"{b} {k}") for k in range(40)]
    docs = spark.createDataFrame([(*row, "en", "s", 1) for row in many], schema)
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.mixed(spark, docs, FOLDER).collect()]
    assert set(left) < set(many) and len(set(left)) == len(left)
    assert {i for i, _ in left} == {0, 1, None}


def test_empty_table(spark, nothing):
    frames = run_stages(spark, nothing)
    assert [frame.count() for frame in frames] == [0] * len(frames)
