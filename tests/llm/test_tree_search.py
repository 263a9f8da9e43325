import math

import numpy as np
import pytest

from newsloom.llm import queries, tree_search
from pyspark.sql import functions as F

SCHEMA = "vec_id bigint, embedding array<float>, label int, leaf int, block int, v string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x", 4) for r in rows], SCHEMA).repartition(3)


def true_neighbours(rows, query_of, k):
    rows = [
        (i, v) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    width = max((len(v) for _, v in rows), default=0)
    points = np.array([list(v) + [0.0] * (width - len(v)) for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    out = {}
    for n, (i, v) in enumerate(rows):
        if query_of(i):
            far = np.sqrt(((points - points[n]) ** 2).sum(1))
            order = [m for m in np.lexsort((ids, far)) if ids[m] != i][:k]
            out[(i, tuple(v))] = [(int(ids[m]), far[m]) for m in order]
    return out


def clusters(count, width=12, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, width)) * 4
    points = centres[rng.integers(0, 9, count)] + rng.normal(size=(count, width))
    return [(k, [float(np.float32(x)) for x in p]) for k, p in enumerate(points)]


def run(table, **more):
    found = tree_search.search(tree_search.usable(table), F.col("vec_id") % 10 == 0, **more).collect()
    out = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def odd_rows():
    rows = clusters(400)
    rows += [(1000 + k, rows[7][1]) for k in range(150)]  # one very common vector
    rows += [rows[20], rows[33]]  # repeated rows
    return rows + [(2000, None), (2010, [0.0] * 12), (2020, [math.nan] * 12), (2030, [None, 1.0]),
                   (2040, [math.inf]), (2050, []), (None, rows[0][1]), (2060, [1.0, 2.0])]


def test_all_leaves_equal_brute_force(spark, monkeypatch):
    """With all leaves visited the search is exact, in many blocks and groups too."""
    rows = odd_rows()
    want = {i: v for (i, _), v in true_neighbours(rows, lambda i: i % 10 == 0, 10).items()}
    for block, group in ((8192, 4096), (20, 7)):
        monkeypatch.setattr(tree_search, "BLOCK", block)
        monkeypatch.setattr(tree_search, "GROUP", group)
        got = run(frame(spark, rows), visits=10**6)
        assert set(got) == set(want)
        for i, found in got.items():
            assert [r for r, _, _ in found] == list(range(1, 11))
            assert [v for _, v, _ in found] == [v for v, _ in want[i]]
            assert np.allclose([s for _, _, s in found], [s for _, s in want[i]], rtol=1e-12)


def test_calibrated_recall(spark, monkeypatch):
    monkeypatch.setattr(tree_search, "LEAF", 16)
    rows = clusters(3000)
    want = true_neighbours(rows, lambda i: i % 10 == 0, 10)
    got = run(frame(spark, rows))
    met = sum(len({v for v, _ in near} & {v for _, v, _ in got[i]}) for (i, _), near in want.items())
    assert met >= 0.95 * sum(map(len, want.values()))


def test_visits_widen_until_the_target():
    assert tree_search.leaves_for([0] * 9 + [4], 6, 0.9) == 1
    assert tree_search.leaves_for([0] * 9 + [4], 6, 0.95) == 5
    assert tree_search.leaves_for([], 6, 0.95) == 1


def test_best_bin_first():
    """Leaves come in the order in which a sorted list of open nodes would give them."""
    points = np.array([v for _, v in clusters(600)])
    tree = tree_search.Tree(points, branch=4, leaf=10)
    query = points[3]
    order = tree.visits(query, tree.leaves)
    assert sorted(order) == list(range(tree.leaves)) and tree.visits(query, 3) == order[:3]
    open_nodes, want = [(0.0, tree.root)], []
    while open_nodes:
        open_nodes.sort(key=lambda x: x[0])
        _, node = open_nodes.pop(0)
        if node.centres is None:
            want.append(node.leaf)
        else:
            open_nodes += zip(((node.centres - query) ** 2).sum(1), node.children)
    assert order == want


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query_recall(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    want = true_neighbours(rows, lambda i: i % 100 == 0, 10)
    got = {}
    for r in queries.op12_tree_search(spark, folder).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    met = total = 0
    for (i, _), near in want.items():
        assert len(got[i]) == len(near)
        total += len(near)
        for v, far in near:
            if v in got[i]:
                met += 1
                assert math.isclose(got[i][v], far, rel_tol=1e-12)
    assert met >= 0.9 * total


def test_few_and_no_rows(spark):
    assert run(frame(spark, [])) == {}
    assert run(frame(spark, [(0, None)])) == {}
    assert run(frame(spark, [(0, [1.0, 2.0])])) == {}
    assert run(frame(spark, [(0, [1.0]), (3, [4.0])])) == {0: [(1, 3, 3.0)]}
