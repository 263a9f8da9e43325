import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import top_k

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, asked, k):
    whole = [
        (i, np.floor(1024 * np.array(v, np.float32).astype(np.float64)).astype(np.int64))
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    width = max((len(v) for _, v in whole), default=0)
    whole = [(i, np.pad(v, (0, width - len(v)))) for i, v in whole]
    out = []
    for i, v in {i: v for i, v in whole if asked(i)}.items():
        best = sorted((-int(v @ w), j) for j, w in whole if j != i)[:k]
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("clustered", [True, False])
def test_equals_brute_force(spark, clustered, monkeypatch):
    monkeypatch.setattr(top_k, "BLOCK", 40)
    monkeypatch.setattr(top_k, "GROUP", 7)
    monkeypatch.setattr(top_k, "LEAF", 8)
    rng = np.random.default_rng(3)
    points = rng.normal(size=(300, 6)) * 0.2
    if clustered:
        points = points * 0.05 + rng.normal(size=(6, 6))[rng.integers(0, 6, 300)]
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    rows += [(1000 + i, points[0].tolist()) for i in range(60)]  # one very common vector
    rows += [(2000, None), (2001, [0.1, None]), (2002, [float("nan")]), (2003, [float("inf"), 1.0])]
    rows += [(None, points[1].tolist()), (2010, []), (2020, [0.5, -0.25])]
    frame = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).withColumn("cell", F.lit("x"))
    got = top_k.top_k(top_k.scaled(frame), F.col("vec_id") % 10 == 0, 5).collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda i: i % 10 == 0, 5)


def test_few_rows_and_none(spark):
    frame = spark.createDataFrame([(0, [0.5], 0), (1, [0.25], 0)], SCHEMA)
    got = top_k.top_k(top_k.scaled(frame), F.lit(True), 10).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 512 * 256), (1, 1, 0, 512 * 256)]
    assert top_k.top_k(top_k.scaled(frame.limit(0)), F.lit(True), 10).count() == 0


def test_products_do_not_overflow():
    big = np.array([[2**62, 2**62]])
    assert top_k.products(big, big)[0, 0] == 2**63 - 1
    assert top_k.products(big, -big)[0, 0] == -(2**63)
