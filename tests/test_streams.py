"""Bloom filters beside the work table, and legal transitions over a stream."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.catalog import QUERIES, stream_queries
from newsloom.operators import key_filter
from newsloom.sources import index_files, payloads, seeds, text_files
from newsloom.streaming import imports
from newsloom.streaming.states import stream_status
from newsloom.streaming.transitions import follow_transitions, illegal, read_verdicts


def test_filter_never_loses_a_key(spark):
    known = spark.range(0, 3000).select(F.lit("d").alias("dataset"), F.col("id").cast("int").alias("doc_id"))
    filters = key_filter.filter_of(known, words=1 << 10)
    asked = spark.range(0, 9000).select(
        F.when(F.col("id") < 6000, "d").otherwise("e").alias("dataset"), (F.col("id") % 6000).cast("int").alias("doc_id")
    )
    rows = key_filter.maybe_known(asked, filters, words=1 << 10).collect()
    assert len(rows) == 9000 and all(r["maybe_known"] for r in rows if r["dataset"] == "d" and r["doc_id"] < 3000)
    assert not any(r["maybe_known"] for r in rows if r["dataset"] == "e")
    false = sum(r["maybe_known"] for r in rows if r["dataset"] == "d" and r["doc_id"] >= 3000)
    assert false < 600  # three keys a word
    halves = key_filter.filter_of(known.where("doc_id % 2 = 0"), 1 << 10).union(
        key_filter.filter_of(known.where("doc_id % 2 = 1"), 1 << 10)
    )
    assert sorted(key_filter.merged(halves).collect()) == sorted(filters.collect())


@pytest.fixture
def drop(spark, tmp_path):
    folder = str(tmp_path / "drop")
    os.makedirs(f"{folder}/dataset=d")

    def put(name, rows):
        with open(f"{folder}/dataset=d/{name}", "w") as file:
            file.write("id,url\n" + "".join(f"{k},{u}\n" for k, u in rows))

    return folder, put


def run_import(spark, folder, tmp_path, checkpoint="checkpoint"):
    work = str(tmp_path / "work")
    imports.import_seeds(seeds.stream_seed(spark, folder), work, str(tmp_path / checkpoint)).awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(work).select("doc_id", "url").collect())


def test_new_keys_read_no_earlier_rows(spark, tmp_path, drop, monkeypatch):
    folder, put = drop
    asked = []
    usual = imports.new_documents
    monkeypatch.setattr(imports, "new_documents", lambda *a: asked.append(1) or usual(*a))
    put("1.csv", [(k, "a") for k in range(50)])
    assert len(run_import(spark, folder, tmp_path)) == 50
    put("2.csv", [(k, "b") for k in range(1000, 1050)])
    assert len(run_import(spark, folder, tmp_path)) == 100
    assert not asked  # nothing was compared with the table
    put("3.csv", [(k, "c") for k in (3, 1001, 2000)])
    assert run_import(spark, folder, tmp_path)[-1] == (2000, "c") and asked
    rows = run_import(spark, folder, tmp_path, "another")
    assert len(rows) == 101


def test_a_table_without_filters_gets_them(spark, tmp_path, drop):
    folder, put = drop
    old = spark.createDataFrame([("d", 1, "old"), ("d", 2, "old")], schemas.WORK_ITEM)
    old.write.partitionBy("dataset").parquet(str(tmp_path / "work/run=0/batch=0"))
    put("1.csv", [(2, "new"), (3, "new")])
    assert run_import(spark, folder, tmp_path) == [(1, "old"), (2, "old"), (3, "new")]
    imports.compact_filters(spark, str(tmp_path / "work"), str(tmp_path / "small"))
    assert spark.read.parquet(str(tmp_path / "small_filters")).count() <= 3


def test_a_repeated_batch_keeps_its_rows(spark, tmp_path, drop):
    """A batch whose filter was written, but not its rows, is written when it comes again."""
    folder, put = drop
    put("1.csv", [(1, "a"), (2, "b")])
    work = str(tmp_path / "work")
    lost = spark.createDataFrame([("d", 1), ("d", 2)], "dataset STRING, doc_id INT")
    key_filter.filter_of(lost).write.partitionBy("dataset").parquet(f"{work}_filters/run=0/batch=0")
    assert run_import(spark, folder, tmp_path) == [(1, "a"), (2, "b")]


def log_rows(spark, rows):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [("d", doc, seq, start + dt.timedelta(hours=hours), state) for seq, (doc, hours, state) in enumerate(rows)],
        schemas.STATUS_LOG,
    ).coalesce(1)


def test_transitions(spark, tmp_path):
    rows = [
        (1, 0, "PENDING"), (1, 1, "RETRIEVED"), (1, 2, "PARSED"), (1, 3, "RETRIEVED"), (1, 4, "RESCRAPE"),
        (2, 0, "PARSED"), (2, 1, "PENDING"), (2, 2, "PENDING"), (2, 3, "FAILED"),
        (3, 0, "PENDING"),  # never fetched
        (4, 0, "PENDING"), (4, 30, "RETRIEVED"),  # too late, as the next row shows
    ] + [(5, k, ("PENDING", "FAILED")[k % 2]) for k in range(10)] + [(5, 10, "PENDING"), (6, 100, "NONSENSE")]
    source, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "checkpoint"))
    log = log_rows(spark, rows)
    for part in ("event_time < '2024-01-01 02:30:00'", "event_time >= '2024-01-01 02:30:00'"):
        log.where(part).write.mode("append").parquet(source)
        follow_transitions(
            stream_status(spark, source, 1), out, checkpoint, expiry_days=1, partitions=2
        ).awaitTermination()
    got = sorted((r["doc_id"], r["seq"], r["state"], r["was"], r["legal"], r["fails"]) for r in read_verdicts(spark, out).collect())
    by_doc = {}
    for doc, *rest in got:
        by_doc.setdefault(doc, []).append(tuple(rest))
    assert [(s, ok) for _, s, _, ok, _ in by_doc[1]] == [
        ("PENDING", True), ("RETRIEVED", True), ("PARSED", True), ("RETRIEVED", False), ("RESCRAPE", True)
    ]
    assert [(s, ok, n) for _, s, _, ok, n in by_doc[2]] == [
        ("PARSED", False, 0), ("PENDING", True, 0), ("PENDING", False, 0), ("FAILED", True, 1)
    ]
    assert [(s, ok, n) for _, s, _, ok, n in by_doc[3]] == [("EXPIRED", True, 1), ("PENDING", True, 0)]
    assert sorted((s, w, ok, n) for _, s, w, ok, n in by_doc[4]) == [
        ("EXPIRED", "PENDING", True, 1), ("PENDING", "", True, 0), ("RETRIEVED", "FAILED", False, 1)
    ]
    assert [ok for _, _, _, ok, _ in by_doc[5]] == [True] * 10 + [False]
    assert [ok for _, _, _, ok, _ in by_doc[6]] == [False]
    letters = illegal(read_verdicts(spark, out)).collect()
    assert len(letters) == 6 and letters[0]["step"] == "transition"


def test_files_are_drained(spark, tmp_path):
    """Views of a document that come in different batches meet; document files are raw views."""
    folder, out, checkpoint = (str(tmp_path / n) for n in ("files", "out", "checkpoint"))

    def put(name, data):
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as file:
            file.write(data)

    def drained():
        payloads.drain_files(payloads.stream_payload_files(spark, folder, 1), out, checkpoint).awaitTermination()
        rows = payloads.read_drained_files(spark, out).collect()
        return {(r["dataset"], r["doc_id"]): (r["raw"] and bytes(r["raw"]), r["reader"] and bytes(r["reader"])) for r in rows}

    put("d/1.raw", b"<p>")
    put("d/2.pdf", b"%PDF\xff")
    put("d/notes.txt", b"no view")
    assert drained() == {("d", 1): (b"<p>", None), ("d", 2): (b"%PDF\xff", None)}
    put("d/1.reader", b"r")
    put("e/1.reader", b"s")
    assert drained() == {("d", 1): (b"<p>", b"r"), ("d", 2): (b"%PDF\xff", None), ("e", 1): (None, b"s")}
    got = {(r["dataset"], r["doc_id"]): bytes(r["raw"] or b"") for r in payloads.read_payload_files(spark, folder).collect()}
    assert got == {("d", 1): b"<p>", ("d", 2): b"%PDF\xff", ("e", 1): b""}


def test_folders_of_files_are_listed_by_few_tasks(spark, tmp_path):
    """Forty folders with a file each: streams list them by a few tasks per core, not one each."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    tasks = 4 * spark.sparkContext.defaultParallelism
    for k in range(40):
        os.makedirs(f"{tmp_path}/in/dataset=d/doc_id={k}")
        (tmp_path / f"in/dataset=d/doc_id={k}/a.txt").write_text("a b c d e f g")
    for stream in (payloads.stream_payload_files, index_files.stream_index_files):
        before = spark.conf.get(name)
        spark.conf.set(name, "10000")
        try:
            stream(spark, str(tmp_path / "in"))
            assert int(spark.conf.get(name)) == tasks
        finally:
            spark.conf.set(name, before)


def below(folder):
    """Texts of the files below a folder by their places, without the files that readers skip."""
    found = {}
    for place, _, names in os.walk(folder):
        for name in names:
            if name[0] not in "._":
                with open(f"{place}/{name}", "rb") as file:
                    found.setdefault(os.path.relpath(place, folder), []).append(file.read())
    return found


def test_a_file_for_each_key_as_spark_writes_it(spark, tmp_path, monkeypatch):
    """Tasks write the same files as Spark's writer, repeated keys and keys of all kinds included,
    and leave nothing beside them."""
    names = ["d", "a b", "a+b", "a%2Bb", "ü/ö=:x", "100%", "q?#[x]^", "", None, "007", "'\"*\\\\"]
    rows = [(name, k, f"line {k}\r é") for k, name in enumerate(names)]
    rows += [("d", 0, "line 0\r é"), ("d", None, "x"), (None, None, ""), ("d", -3, None), ("e", 1, None), ("e", 1, None)]
    table = spark.createDataFrame(rows, "dataset STRING, doc_id INT, value STRING")
    text_files.write_text_files(table, f"{tmp_path}/own", ["dataset", "doc_id"], 3)
    text_files.write_text_files(table.where("false"), f"{tmp_path}/none", ["dataset", "doc_id"], 3)
    monkeypatch.setattr(text_files, "local_path", lambda spark, path: None)
    text_files.write_text_files(table, f"{tmp_path}/spark", ["dataset", "doc_id"], 3)
    own = below(f"{tmp_path}/own")
    assert own == below(f"{tmp_path}/spark") and len(own) == len(names) + 4
    assert own["dataset=d/doc_id=0"] == ["line 0\r é\nline 0\r é\n".encode()] and own["dataset=e/doc_id=1"] == [b"\n\n"]
    assert os.listdir(f"{tmp_path}/none") == []
    assert {len(files) for _, _, files in os.walk(f"{tmp_path}/own")} == {0, 1}


def test_a_file_of_many_batches_of_rows(spark, tmp_path):
    """Lines of one key that come in several Arrow batches are one file."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10")
    try:
        rows = spark.range(95).selectExpr("'d' AS dataset", "id % 2 AS doc_id", "'x' AS value")
        text_files.write_text_files(rows, f"{tmp_path}/own", ["dataset", "doc_id"], 1)
    finally:
        spark.conf.set(name, before)
    assert below(f"{tmp_path}/own") == {"dataset=d/doc_id=0": [b"x\n" * 48], "dataset=d/doc_id=1": [b"x\n" * 47]}


def test_many_small_files_become_few(spark, tmp_path):
    """Three hundred files of one dataset, drained in a batch, are stored as a file a core at most."""
    cores = spark.sparkContext.defaultParallelism
    for k in range(300):
        place = f"{tmp_path}/in/dataset=d/doc_id={k}"
        os.makedirs(place)
        with open(f"{place}/a.raw", "w") as file:
            file.write(f"k {k} u m 200 d 1")
    pattern = "dataset=([^/]+)/doc_id=([0-9]+)/a[.](raw)$"
    views = payloads.stream_payload_files(spark, f"{tmp_path}/in", pattern=pattern)
    captures = index_files.stream_index_files(spark, f"{tmp_path}/in")
    for drain, stream in ((payloads.drain_files, views), (index_files.drain_index, captures)):
        out = f"{tmp_path}/{drain.__name__}"
        drain(stream, out, f"{out}-checkpoint").awaitTermination()
        assert 1 <= sum(map(len, below(out).values())) <= cores
        assert spark.read.parquet(out).select("doc_id").distinct().count() == 300


def test_keys_of_index_files_come_from_their_paths(spark, tmp_path):
    """Answers in folders of different depths, which Spark's own search for keys refuses."""
    for place in ("dataset=d/doc_id=1", "2024/dataset=d/doc_id=2", "2024/05/dataset=a%2Fb é%25/doc_id=-3",
                  "dataset=__HIVE_DEFAULT_PARTITION__/doc_id=__HIVE_DEFAULT_PARTITION__", "notes"):
        os.makedirs(f"{tmp_path}/in+100% %41/{place}")
        with open(f"{tmp_path}/in+100% %41/{place}/a.txt", "w") as file:
            file.write("k 2020 u m 200 d 1\n")
    stream = index_files.stream_index_files(spark, f"{tmp_path}/in+100% %41")
    index_files.drain_index(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    rows = index_files.read_drained_captures(spark, f"{tmp_path}/out").collect()
    assert sorted((str(r["dataset"]), r["doc_id"] or 0) for r in rows) == [
        ("None", 0), ("None", 0), ("a/b é%", -3), ("d", 1), ("d", 2)
    ]


def test_index_files_are_drained(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("index", "out", "checkpoint"))

    def put(doc, name, text):
        path = f"{folder}/dataset=d/doc_id={doc}"
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/{name}", "w") as file:
            file.write(text)

    def drained():
        stream = index_files.stream_index_files(spark, folder)
        index_files.drain_index(stream, out, checkpoint).awaitTermination()
        rows = index_files.read_drained_captures(spark, out).collect()
        return sorted((r["dataset"], r["doc_id"], r["timestamp"]) for r in rows)

    put(1, "a.txt", "k 2020 u m 200 d 1\nshort line\nk 2021 u m 200 d 1\n")
    assert drained() == [("d", 1, "2020"), ("d", 1, "2021")]
    put(1, "b.txt", "k 2022 u m 200 d 1 2\n")
    put(2, "a.txt", "k 2023 u m - d 1")
    assert drained() == [("d", 1, "2020"), ("d", 1, "2021"), ("d", 2, "2023")] == drained()


def test_work_of_few_files_goes_to_all_cores(spark, tmp_path, monkeypatch):
    """Events of one file are read as dates by all cores; a drained payload has a file per core in
    each batch."""
    cores = spark.sparkContext.defaultParallelism
    events = spark.range(40).selectExpr("id AS event_id", "timestamp'2024-03-05 10:20:30' + make_dt_interval(id) AS ts")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    dates = QUERIES["date_grammar"](spark, str(tmp_path))
    assert dates.rdd.getNumPartitions() >= cores and dates.count() == 40

    class Seen(Exception):
        pass

    def seen(spark, path, files_per_batch):
        raise Seen(len([f for f in os.listdir(path.removeprefix("file:")) if f.endswith(".parquet")]), files_per_batch)

    rows = spark.range(4000).select(
        F.lit("d").alias("dataset"), F.col("id").cast("int").alias("doc_id"), F.lit("u").alias("url"),
        F.lit("RAW").alias("content_kind"), F.lit(b"").alias("raw"), F.lit(b"").alias("reader"),
    )
    monkeypatch.setattr(stream_queries, "payload", lambda spark, folder: rows)
    for name in ("pdf_meta", "pdf_pages"):
        monkeypatch.setattr(stream_queries.tb, name, lambda spark, folder: None)
    monkeypatch.setattr(stream_queries, "stream_payload", seen)
    with pytest.raises(Seen) as found:
        QUERIES["drain_articles"](spark, str(tmp_path))
    files, batch = found.value.args
    assert files >= 2 * cores and batch >= cores
