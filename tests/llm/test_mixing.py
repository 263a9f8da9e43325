import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newsloom.llm import components, mixing, queries, tables


def test_equals_twin(spark):
    folder = "/root/testdata/sf0.001"
    got = queries.op7_mixing(spark, folder).toPandas().sort_values("doc_id", ignore_index=True)
    connection = duckdb.connect()
    for name in ("documents", "embeddings"):
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = connection.sql(queries.TWINS["op7_mixing"]).df().sort_values("doc_id", ignore_index=True)
    assert (got[want.columns] == want).all().all()


def test_marginals_are_met(spark):
    rows = [(s, l, t, 10 * i + 5) for i, (s, l, t) in enumerate(
        (s, l, t) for s in "abc" for l in "xy" for t in "12")]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens bigint")
    target = {
        "source": spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "source string, share double"),
        "lang": spark.createDataFrame([("x", 0.6), ("y", 0.4)], "lang string, share double"),
        "topic": spark.createDataFrame([("1", 0.5), ("2", 0.5)], "topic string, share double"),
    }
    raked = mixing.rake(cells, target, 20)
    total = sum(r[3] for r in rows)
    for dimension, shares in target.items():
        got = raked.groupBy(dimension).agg(F.sum("weight").alias("w")).join(shares, dimension)
        for row in got.collect():
            assert row["w"] / total == pytest.approx(row["share"], abs=1e-6)
    kept = mixing.calibrate(raked, 0.4).agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0]
    assert kept == pytest.approx(0.4 * total, rel=1e-3)


def test_odd_rows(spark, documents, nothing):
    topics = spark.createDataFrame([(1, "7"), (None, "8")], "doc_id bigint, topic string")
    rows = mixing.mix(documents, topics).collect()
    assert len(rows) == documents.count()
    assert all(0 <= r["probability"] <= 1 and r["kept"] is not None for r in rows)
    assert {r["kept"] for r in rows if r["doc_id"] == 4} != {True, False}
    assert mixing.mix(nothing, topics).count() == 0


def _expected(rows, column):
    """Expected kept shares, summed in plain Python."""
    sums = {}
    for row in rows:
        sums[row[column]] = sums.get(row[column], 0) + row["tokens"] * row["probability"]
    total = sum(sums.values())
    return {value: kept / total for value, kept in sums.items()}, total


def test_kept_shares_meet_targets_under_the_bound(spark):
    """Targets that can be met with 0.6 of the tokens, but not by clipping."""
    cells = [(s, l, t) for s in "abc" for l in "xy" for t in "12"]
    rows = [(i, "w " * (10 * i + 5), s, l) for i, (s, l, _) in enumerate(cells)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    topics = spark.createDataFrame([(i, c[2]) for i, c in enumerate(cells)], "doc_id bigint, topic string")
    want = {"source": {"a": 0.18, "b": 0.42, "c": 0.4}, "lang": {"x": 0.6, "y": 0.4}, "topic": {"1": 0.5, "2": 0.5}}
    targets = {d: spark.createDataFrame(list(v.items()), f"{d} string, share double") for d, v in want.items()}
    got = mixing.mix(documents, topics, targets, capped=True).collect()
    assert all(0 <= r["probability"] <= 1 for r in got)
    for dimension, shares in want.items():
        shares_got, total = _expected(got, dimension)
        assert shares_got == pytest.approx(shares, abs=3e-3)
        assert total == pytest.approx(0.6 * 720, rel=3e-3)
    clipped, _ = _expected(mixing.mix(documents, topics, targets).collect(), "source")
    assert abs(clipped["a"] - 0.18) > 3e-3


def test_values_short_of_tokens_are_kept_whole(spark):
    rows = [(1, "w " * 10, "rare", "x"), (2, "w " * 60, "b", "x"), (3, "w " * 30, "c", "x")]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id bigint, topic string")
    targets = {
        "source": spark.createDataFrame([("rare", 0.5), ("b", 0.3), ("c", 0.2)], "source string, share double"),
        "lang": spark.createDataFrame([("x", 1.0)], "lang string, share double"),
        "topic": spark.createDataFrame([("", 1.0)], "topic string, share double"),
    }
    mixed = mixing.mix(documents, none, targets, capped=True)
    kept = {r["source"]: r["tokens"] * r["probability"] for r in mixed.collect()}
    assert kept == pytest.approx({"rare": 10, "b": 30, "c": 20}, rel=2e-3)
    shown = {r["value"]: r for r in mixing.shares(mixed, targets).where("dimension = 'source'").collect()}
    assert shown["rare"]["target"] == 0.5
    assert shown["rare"]["expected"] == pytest.approx(1 / 6, rel=3e-3)


def test_pipeline_rakes_under_the_bound(spark):
    folder = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    topics = mixing.embedding_topics(spark.read.parquet(f"{folder}/embeddings.parquet"))
    want = mixing.mix(documents, topics, capped=True).where("kept").select("doc_id").collect()
    got = corpus_pipeline.mixed(spark, documents, folder).select("doc_id").collect()
    assert sorted(got) == sorted(want)
    rows = mixing.mix(documents, topics).where("kept").select("doc_id").collect()
    assert sorted(got) != sorted(rows)


def test_rounds_leave_one_table(spark, monkeypatch):
    """Tables of earlier rounds go, here and in the search of components."""
    there = set()

    def tracked(table, name):
        out = tables.stored(table, name)
        if name in ("raked", "edges"):
            there.add(out.stored_at)
        return out

    def dropped(*gone):
        there.difference_update(table.stored_at for table in gone)
        tables.forget(*gone)

    for module in (mixing, components):
        monkeypatch.setattr(module, "stored", tracked)
        monkeypatch.setattr(module, "forget", dropped, raising=False)
    rows = [("a", "x", "1", 10), ("a", "y", "1", 30), ("b", "x", "1", 20), ("b", "y", "1", 5)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens bigint")
    targets = {d: mixing.smoothed(cells, d, mixing.POWER) for d in mixing.DIMENSIONS}
    assert mixing.rake_capped(cells, targets).count() == 4 and len(there) == 1
    there.clear()
    edges = spark.createDataFrame([(k, k + 1) for k in range(9)], "a bigint, b bigint")
    found = components.components(edges).collect()
    assert {r["component"] for r in found} == {0} and len({r["id"] for r in found}) == 10
    assert len(there) == 1
