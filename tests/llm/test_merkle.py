import collections
import hashlib
import zlib

import pytest

from newsloom.llm import merkle
from pyspark.sql import functions as F


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def levels(nodes, fan):
    out = [nodes]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([h(*last[k : k + fan]) for k in range(0, len(last), fan)])
    return out


def steps(tree, place, fan):
    out = []
    for level in tree[:-1]:
        start = place - place % fan
        out.append(("".join(level[start:place]), "".join(level[place + 1 : start + fan])))
        place //= fan
    return out


def brute(rows, fan):
    """Every row's (doc_id, leaf, subroot, root, proof, folded root, verified)."""
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row["source"]].append((leaf(row, row["text"]), row))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for name in order:
        groups[name].sort(key=lambda x: (x[1]["doc_id"] is not None, x[1]["doc_id"] or 0, x[0]))
    trees = {name: levels([x[0] for x in groups[name]], fan) for name in order}
    top = levels([trees[name][-1][0] for name in order], fan)
    root = top[-1][0]
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = []
    for n, name in enumerate(order):
        for k, (digest, row) in enumerate(groups[name]):
            path = steps(trees[name], k, fan) + steps(top, n, fan)
            node = digest
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0:
                node = leaf(row, None if row["text"] is None else row["text"].translate(lower))
            for left, right in path:
                node = h(left, node, right)
            proof = h(*(left + right for left, right in path))
            out.append((row["doc_id"], digest, trees[name][-1][0], root, proof, node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fan", [16, 2])
def test_equals_brute_force(documents, monkeypatch, fan):
    """With a fan of 2 the same rows make many rounds."""
    monkeypatch.setattr(merkle, "FAN", fan)
    monkeypatch.setattr(merkle, "BLOCK", fan * fan)
    got = sorted((tuple(r) for r in merkle.verified(documents).collect()), key=repr)
    want = brute(documents.collect(), fan)
    assert got == want
    assert {row[-1] for row in got} == {True, False}


def test_hundreds_of_sources_and_leaves(spark):
    rows = spark.range(700).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") < 350, F.lit("hot")).otherwise(F.concat(F.lit("é"), F.col("id"))).alias("source"),
        F.lit(None).cast("string").alias("lang"),
        F.lit(3).alias("n_chars"),
        F.concat(F.lit("Aé"), F.col("id") % 3).alias("text"),
    )
    got = sorted((tuple(r) for r in merkle.verified(rows).collect()), key=repr)
    assert got == brute(rows.collect(), 16)


def test_equal_rows_without_id(spark):
    """Equal leaves may take any order; the set of results is the same."""
    rows = spark.createDataFrame(
        [(None, "a", "en", 1, "x")] * 20 + [(3, None, "en", 1, "x")],
        "doc_id bigint, source string, lang string, n_chars bigint, text string",
    )
    got = sorted((tuple(r) for r in merkle.verified(rows.repartition(3)).collect()), key=repr)
    assert got == brute(rows.collect(), 16)


def test_one_leaf_is_the_root(spark):
    row = spark.createDataFrame(
        [(5, "a", "en", 1, "x")], "doc_id bigint, source string, lang string, n_chars bigint, text string"
    )
    (got,) = merkle.verified(row).collect()
    assert got["leaf"] == got["subroot"] == got["root"] and got["proof_sha256"] == h("")


def test_manifest_carries_columns(documents):
    leaves = documents.select("doc_id", "source", "n", "kept",
                              merkle.leaf(F.col("doc_id"), F.col("text")).alias("leaf"))
    rows = merkle.manifest(leaves, carry=["kept", "n"]).collect()
    assert len(rows) == documents.count()
    assert all(r["carried"]["kept"] == 9 and r["carried"]["n"] == 1 for r in rows)
    for row in rows:
        node = row["leaf"]
        for step in row["path"]:
            node = h(step["left"], node, step["right"])
        assert node == row["root"]


def test_empty_table(nothing):
    assert merkle.verified(nothing).count() == 0


def test_no_python_in_the_plan(documents):
    plan = merkle.verified(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
