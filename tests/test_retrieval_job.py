"""Choice on thin rows, and batches that commit payloads and states together."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.plans import retrieval, retrieval_job
from newsloom.sources.batches import BatchStore
from newsloom.sources.fetches import load_fetches, save_fetches

GOOD = "<html><head><title>{0}</title></head><body><p>Text of {0}</p></body></html>"


@pytest.fixture
def job(spark):
    work = spark.createDataFrame(
        [("d", k, f"http://x.com/{k}", None) for k in range(1, 7)],
        schemas.WORK_ITEM + ", method STRING",
    )
    captures = spark.createDataFrame([], schemas.ARCHIVE_CAPTURE)
    templates = spark.createDataFrame([], schemas.ROUTE_TEMPLATE)
    plan = retrieval.fetch_plan(work, captures, templates)
    rows = [("d", k, f"http://x.com/{k}", 1, 1, 200, None, GOOD.format(k).encode(), b"") for k in range(1, 5)]
    rows += [("d", 5, "http://x.com/5", 1, 1, 200, None, GOOD.format("404").encode(), b"")]
    rows += [("d", 4, "http://x.com/4", 1, 2, 200, None, GOOD.format("later").encode(), b"")]
    return work, plan, spark.createDataFrame(rows, schemas.FETCH_ATTEMPT)


def read_back(store):
    payload = {r["doc_id"]: bytes(r["raw"]).decode() for r in retrieval_job.payloads(store).collect()}
    states = sorted((r["doc_id"], r["state"]) for r in retrieval_job.states(store).collect())
    return payload, states


def run(store, batch, work, job):
    _, plan, results = job
    moment = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return retrieval_job.run_batch(store, batch, work, plan, results, moment, F.col("doc_id"))


def test_batches_are_read_back(spark, job, tmp_path):
    work = job[0]
    store = BatchStore(spark, str(tmp_path / "store"))
    assert read_back(store) == ({}, [])
    assert run(store, "a", work.where("doc_id < 4"), job)
    assert not run(store, "a", work.where("doc_id < 4"), job)  # a repeat changes nothing
    left = retrieval_job.open_work(work, store)
    assert sorted(r["doc_id"] for r in left.collect()) == [4, 5, 6] and left.columns == work.columns
    assert run(store, "b", left, job)
    payload, states = read_back(store)
    assert payload == {k: GOOD.format(k) for k in range(1, 5)}
    assert states == [(k, "RETRIEVED") for k in range(1, 5)] + [(5, "FAILED"), (6, "FAILED")]
    assert retrieval_job.open_work(work, store).count() == 0
    row = retrieval_job.states(store).first()
    assert row["event_time"] == dt.datetime(2024, 1, 1)


def test_death_between_the_writes(spark, job, tmp_path, monkeypatch):
    """A writer that dies after the payloads, or after both tables, has written nothing."""
    store = BatchStore(spark, str(tmp_path / "store"))
    assert run(store, "a", job[0].where("doc_id = 1"), job)
    before = read_back(store)
    write = BatchStore.write

    def die_after_payload(self, tables, partition_by):
        write(self, {"payload": tables["payload"]}, partition_by)
        raise RuntimeError("lost")

    def die_before_publishing(self, batch, manifest):
        raise RuntimeError("lost")

    for name, death in (("write", die_after_payload), ("publish", die_before_publishing)):
        with monkeypatch.context() as patch:
            patch.setattr(BatchStore, name, death)
            with pytest.raises(RuntimeError):
                run(store, "b", job[0].where("doc_id = 2"), job)
        assert read_back(store) == before
    assert run(store, "b", job[0].where("doc_id = 2"), job)
    assert sorted(read_back(store)[0]) == [1, 2]


def test_one_of_two_writers_wins(spark, tmp_path):
    store = BatchStore(spark, str(tmp_path / "store"))
    table = spark.range(3)
    first, second = store.write({"t": table}, {}), store.write({"t": table}, {})
    assert store.publish("x", first) and not store.publish("x", second)
    assert store.read("t", "id BIGINT").count() == 3 and list(store.manifests()) == ["x"]
    # A manifest that is not finished does not count.
    (tmp_path / "store" / "commits" / "y.json").write_text('{"run": "half')
    assert store.read("t", "id BIGINT").count() == 3
    with pytest.raises(ValueError):
        store.is_committed("../x")


def test_blobs_stay_where_they_are(spark, job):
    """With fetches in buckets no exchange, sort or aggregate sees a blob."""
    work, plan, results = job
    save_fetches(results, "fetches_of_test", 4)
    try:
        fetches = load_fetches(spark, "fetches_of_test")
        chosen = retrieval.choose(plan, fetches)
        small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            kept = retrieval.with_content(chosen, fetches)
            rows = {r["doc_id"]: bytes(r["raw"]).decode() for r in kept.collect()}
            text = kept._jdf.queryExecution().explainString(
                spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
            )
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
        assert rows == {k: GOOD.format(k) for k in range(1, 5)}
        steps = [part for part in text.split("\n\n") if part.startswith("(")]
        moved = [p for p in steps if p.split(") ", 1)[1].startswith(("Exchange", "Sort", "HashAggregate", "SortAggregate", "ObjectHash"))]
        assert moved and not any("raw#" in p or "reader#" in p for p in moved)
    finally:
        spark.sql("DROP TABLE IF EXISTS fetches_of_test")


def test_redirecting_reader_views(spark):
    notice = '<p>Redirecting to...</p><div class="content">{0}</div>'
    link = '<a href="{0}">x</a>'
    views = {
        "a": notice.format(link.format("b")), "b": notice.format(link.format("c")), "c": "the end",
        "d": notice.format(""), "e": notice.format(link.format("nowhere")),
        "f": notice.format(link.format("g")), "g": notice.format(link.format("f")), "h": "as it is",
    }
    rows = [("d", k, u, 1, 1, 200, None, b"", v.encode()) for k, (u, v) in enumerate(views.items())]
    rows.append(("d", 20, "i", 1, 1, 200, None, b"", None))
    got = retrieval.follow_readers(spark.createDataFrame(rows, schemas.FETCH_ATTEMPT)).collect()
    ends = {r["location"]: r["reader"] and bytes(r["reader"]).decode() for r in got}
    assert {k: v or "" for k, v in ends.items()} == {
        "a": "the end", "b": "the end", "c": "the end", "d": "", "e": "", "f": "", "g": "", "h": "as it is", "i": "",
    }


def test_equal_bytes_are_judged_once(spark, job, monkeypatch):
    """Fetches that point to contents apart are chosen and filled like fetches with bytes."""
    _, plan, results = job
    bodies = {1: GOOD.format(1).encode(), 2: GOOD.format("404").encode(), 3: b"\xff\xfe file"}
    tries = [("d", k, f"http://x.com/{k}", t, 200, None, 1 if t > k else 2) for k in range(1, 5) for t in range(1, 9)]
    tries += [("d", 5, "http://x.com/5", 1, 200, "no answer", 1)]
    thin = spark.createDataFrame(
        tries, "dataset STRING, doc_id INT, location STRING, attempt INT, http_status INT, error STRING, content INT"
    )
    found = spark.createDataFrame(list(bodies.items()), "content INT, raw BINARY").withColumn("reader", F.lit(b""))
    contents = thin.where("error IS NULL").select("dataset", "doc_id", "content").distinct().join(found, "content")
    whole = thin.join(found, "content")
    seen, usual = [], retrieval.gate_views
    monkeypatch.setattr(retrieval, "gate_views", lambda table, *a: seen.append(table.count()) or usual(table, *a))
    want = retrieval.choose(plan, whole)
    got = retrieval.choose(plan, thin, contents=contents)
    assert seen == [32, 8]
    assert sorted(want.collect()) == sorted(got.collect()) and want.count() == 4
    order = ["doc_id", "attempt"]
    kept = retrieval.with_content(want, whole).orderBy(order).collect()
    assert kept == retrieval.with_content(got, thin, contents).orderBy(order).collect() and len(kept) == 4
