"""Whole jobs: retrieval, parsing, storage, streams."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.operators.ledger import new_documents
from newsloom.operators.state import current_flags
from newsloom.plans import parsing, reports, retrieval
from newsloom.sources import index_files, payloads, seeds, sinks, tables
from newsloom.streaming.drain import drain, stream_payload
from newsloom.streaming.imports import import_seeds
from newsloom.streaming.states import follow_flags, read_flags, stream_status


def rows(frame, *order):
    return [tuple(row) for row in frame.orderBy(*(order or frame.columns)).collect()]


def page(title="Story", body="Text of the story"):
    return f"<html><head><title>{title}</title></head><body><p>{body}</p></body></html>"


def reader(text="Reader text", title="Reader title", extra=""):
    return (
        f'<html><head><title>t</title></head><body><h1 class="reader-title">{title}</h1>{extra}'
        f'<div class="content"><div class="moz-reader-content reader-show-element">{text}</div></div>'
        "</body></html>"
    )


# -- retrieval ---------------------------------------------------------------------------------

WORK = [
    ("d", 1, "free.com/a", "no_method"),
    ("d", 2, "gate.com/a", "12ft_ladder"),
    ("d", 3, "https://x.com/file.pdf", "12ft_ladder"),
    ("d", 4, "unknown.com", None),
    ("d", 5, "other.com", "remove_paywall"),
    ("d", 6, "broken.com", "no_method"),
]


@pytest.fixture
def plan_tables(spark):
    work = spark.createDataFrame(WORK, "dataset STRING, doc_id INT, url STRING, method STRING")
    captures = spark.createDataFrame(
        [
            ("d", 1, "k", "2021", "http://free.com/a", "t", "301", "D", "1"),
            ("d", 1, "k", "2022", "http://free.com/a", "t", "200", "D", "1"),
            ("d", 1, "k", "2022", "http://free.com/a", "t", "200", "E", "1"),
            ("d", 1, "k", "2020", "http://free.com/a", "t", "404", "D", "1"),
            ("d", 6, "k", "2020", "http://broken.com", "t", "200", "D", "1"),
        ],
        schemas.ARCHIVE_CAPTURE,
    )
    templates = spark.createDataFrame([("12ft_ladder", "https://r.test/{url}")], schemas.ROUTE_TEMPLATE)
    errors = spark.createDataFrame([("d", 6)], "dataset STRING, doc_id INT")
    return work, captures, templates, errors


def test_fetch_plan(plan_tables):
    plan = retrieval.fetch_plan(*plan_tables)
    got = rows(
        plan.select("doc_id", "stage_rank", "statuscode", "variant_no", "view", "location", "is_redirect")
    )
    web = "https://web.archive.org/web"
    assert got == [
        (1, 1, "200", 1, "BOTH", f"{web}/2022/http://free.com/a", False),
        (1, 1, "301", 1, "BOTH", f"{web}/2021/http://free.com/a", True),
        (1, 2, "", 1, "BOTH", "http://free.com/a", False),
        (1, 2, "", 2, "BOTH", "https://free.com/a", False),
        (2, 0, "", 1, "RAW", "https://r.test/http://gate.com/a", False),
        (2, 0, "", 2, "RAW", "https://r.test/https://gate.com/a", False),
        (2, 2, "", 1, "BOTH", "http://gate.com/a", False),
        (2, 2, "", 2, "BOTH", "https://gate.com/a", False),
        (3, 1, "", 1, "PDF", "https://x.com/file.pdf", False),
        (4, 2, "", 1, "BOTH", "http://unknown.com", False),
        (4, 2, "", 2, "BOTH", "https://unknown.com", False),
        (5, 2, "", 1, "BOTH", "http://other.com", False),
        (5, 2, "", 2, "BOTH", "https://other.com", False),
    ]


def test_index_plan(plan_tables):
    work, captures, _, _ = plan_tables
    got = retrieval.index_plan(work, captures)
    assert [r[1] for r in rows(got.select("dataset", "doc_id", "variant_no"))] == [2, 2, 4, 4, 5, 5]


def result(doc, location, raw="", reader_view="", error=None, status=200):
    return ("d", doc, location, status, error, raw.encode() if isinstance(raw, str) else raw,
            reader_view.encode())


RESULT = (
    "dataset STRING, doc_id INT, location STRING, http_status INT, error STRING, raw BINARY, "
    "reader BINARY"
)


def outcome_of(spark, plan_tables, results):
    work, captures, templates, errors = plan_tables
    plan = retrieval.fetch_plan(work, captures, templates, errors)
    chosen = retrieval.choose_content(plan, spark.createDataFrame(results, RESULT))
    kept = retrieval.outcomes(work, chosen, errors)
    return {r["doc_id"]: r for r in kept.collect()}


def test_a_good_second_try_counts(spark, plan_tables):
    work, captures, templates, errors = plan_tables
    tries = [
        (*result(4, "http://unknown.com", page("404")), 1),
        (*result(4, "http://unknown.com", page("Good")), 2),
        (*result(4, "http://unknown.com", page("Later")), 3),
    ]
    plan = retrieval.fetch_plan(work, captures, templates, errors)
    chosen = retrieval.choose_content(plan, spark.createDataFrame(tries, RESULT + ", attempt INT"))
    assert [bytes(r["raw"]).decode() for r in chosen.collect()] == [page("Good")]


def test_outcomes(spark, plan_tables):
    web = "https://web.archive.org/web"
    got = outcome_of(
        spark,
        plan_tables,
        [
            # The first copy is an error page, the second passes; the live page is not needed.
            result(1, f"{web}/2022/http://free.com/a", page("404")),
            result(1, f"{web}/2021/http://free.com/a", page("Old"), reader()),
            result(1, "http://free.com/a", page("Live")),
            # The gated location fails; live: the first variant without error counts.
            result(2, "https://r.test/http://gate.com/a", page("Access denied")),
            result(2, "https://r.test/https://gate.com/a", page("Good")),
            result(2, "http://gate.com/a", page("x"), error="reader view failed"),
            result(2, "https://gate.com/a", page("404"), reader()),
            result(3, "https://x.com/file.pdf", b"%PDF\xff"),
            # Fetched, rejected, and the other variant is not asked.
            result(4, "http://unknown.com", page("404")),
            result(4, "https://unknown.com", page("Good")),
        ],
    )
    assert (got[1]["state"], got[1]["stage_rank"], got[1]["content_kind"]) == ("RETRIEVED", 1, "BOTH")
    assert bytes(got[1]["raw"]).decode() == page("Old")
    assert (got[2]["stage_rank"], got[2]["content_kind"]) == (2, "READER")
    assert bytes(got[2]["raw"]) == b""
    assert (got[3]["content_kind"], bytes(got[3]["raw"])) == ("PDF", b"%PDF\xff")
    assert (got[4]["state"], bytes(got[4]["raw"]), got[4]["content_kind"]) == ("FAILED", b"", "NONE")
    assert got[5]["state"] == "FAILED"
    assert got[6]["state"] == "INDEX_ERROR"


def test_gated_location_keeps_raw_view_only(spark, plan_tables):
    got = outcome_of(
        spark, plan_tables, [result(2, "https://r.test/http://gate.com/a", page("Good"), reader())]
    )
    assert (got[2]["stage_rank"], got[2]["content_kind"], bytes(got[2]["reader"])) == (0, "RAW", b"")


def test_file_needs_status_200(spark, plan_tables):
    got = outcome_of(
        spark, plan_tables, [result(3, "https://x.com/file.pdf", b"%PDF\xff", status=404)]
    )
    assert got[3]["state"] == "FAILED"


# -- parsing -----------------------------------------------------------------------------------

CREDITS = '<div class="credits reader-credits">By Ada Vale</div>'


def payload_rows():
    return [
        ("d", 1, "http://a/x", page().encode(), reader("The cat and the dog", extra=CREDITS).encode()),
        ("d", 2, "http://a/2023/04/05/x", page(body="El perro y los gatos").encode(), b""),
        ("d", 3, "http://a/x", b"", reader().encode()),
        ("d", 4, "http://a/x.pdf", b"%PDF", b""),
        ("d", 5, "http://a/x", b"", b""),
        ("d", 6, "http://a/x", b"\xff", b""),
        ("d", 7, "http://a/x", page().encode(), reader('<time datetime="soon"></time>x').encode()),
        ("d", 8, "http://a/y.pdf", b"%PDF", b""),
        ("d", 9, "http://a/z.pdf", b"", b""),
        ("e", 1, "http://a/x", page("Sed ut perspiciatis").encode(), b""),
    ]


PAYLOAD_IN = "dataset STRING, doc_id INT, url STRING, raw BINARY, reader BINARY"


@pytest.fixture
def parsed(spark):
    payload = payloads.with_kind(spark.createDataFrame(payload_rows(), PAYLOAD_IN))
    meta = spark.createDataFrame([("d", 4, "A_report", "D:20230101124530Z")], schemas.PDF_META)
    pages = spark.createDataFrame([("d", 4, 2, "dogs"), ("d", 4, 1, "cats and ")], schemas.PDF_PAGE)
    return parsing.parse_payload(payload, meta, pages)


def test_parse(parsed):
    got = {(r["dataset"], r["doc_id"]): r for r in parsed.collect()}
    first = got["d", 1]
    assert (first["title"], first["body"], first["language"]) == ("Reader title", "The cat and the dog", "en")
    assert first["authors"] == ["Ada Vale"] and first["content_kind"] == "BOTH"
    second = got["d", 2]
    assert (second["title"], second["language"]) == ("Story", "es")
    assert second["publish_date"] == dt.datetime(2023, 4, 5)
    assert got["d", 3]["body"] == "Reader text"
    assert (got["d", 4]["title"], got["d", 4]["body"]) == ("A report", "cats and dogs")
    assert got["d", 4]["publish_date"] == dt.datetime(2023, 1, 1, 12, 45, 30)
    assert got["d", 5]["is_empty"] and got["d", 5]["language"] is None
    assert got["d", 6]["error"] == "payload is not valid UTF-8"
    assert (got["d", 7]["error"], got["d", 7]["date_error"]) == (None, "unreadable date: soon")
    assert got["d", 7]["publish_date"] is None and not got["d", 7]["is_empty"]
    assert got["d", 8]["error"] == "no extracted page texts"
    assert (got["d", 9]["content_kind"], got["d", 9]["is_empty"]) == ("NONE", True)
    assert got["e", 1]["title"] is None and got["e", 1]["body"] == "Text of the story"


def test_parse_outputs(parsed):
    articles = parsing.article_rows(parsed)
    assert articles.columns == schemas.ARTICLE_COLUMNS
    assert sorted(r["doc_id"] for r in articles.collect()) == [1, 1, 2, 3, 4, 5, 7, 9]
    assert [r[1] for r in rows(parsing.dead_letters(parsed))] == [6, 8]
    assert rows(parsing.date_errors(parsed)) == [("d", 7, "unreadable date: soon")]
    states = parsing.parse_transitions(parsed)
    assert [r[1] for r in rows(states.where("state = 'RESCRAPE'"))] == [5, 9]
    assert states.where("state = 'PARSED'").count() == 8
    total = reports.parsed_progress(
        parsed.where("error IS NULL").select("dataset", "content_kind", F.lit(0).alias("batch_no"))
    )
    assert rows(total.select("dataset", "n_parsed_so_far")) == [("d", 5), ("e", 1)]


def test_pages_are_parsed_without_shuffle_and_once(spark):
    payload = payloads.with_kind(spark.createDataFrame(payload_rows(), PAYLOAD_IN))
    plan = parsing.article_rows(parsing.parse_payload(payload))._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert "Exchange" not in text and text.count("ArrowEvalPython") == 1


# -- storage -----------------------------------------------------------------------------------


def test_seed_file(spark, tmp_path):
    (tmp_path / "s.csv").write_text('number,address\n1,www.a.com/x\n2,"b.com/y,z"\n')
    got = seeds.read_seed(spark, str(tmp_path / "s.csv"), "d")
    assert rows(got) == [("d", 1, "www.a.com/x"), ("d", 2, "b.com/y,z")]


def test_policy_dump(spark, tmp_path):
    (tmp_path / "p.sql").write_text(
        "--\nSET x = 0;\nINSERT INTO dbo.url_domain VALUES (1, 'www', 'o''neil', 'com', 'no_method', true);\n"
        "INSERT INTO dbo.url_domain VALUES (2, '', 'b', '', 'pending', false);\n"
    )
    got = tables.load_policy(spark, str(tmp_path / "p.sql"), "dump")
    assert rows(got) == [
        (1, "www", "o'neil", "com", "no_method", True), (2, "", "b", "", "pending", False),
    ]


def test_index_files(spark, tmp_path):
    folder = tmp_path / "dataset=d" / "doc_id=3"
    os.makedirs(folder)
    (folder / "a.txt").write_text("k 2020 http://x t 200 D 1\nbad line\n")
    got = index_files.read_index_files(spark, str(tmp_path))
    assert rows(got) == [("d", 3, "k", "2020", "http://x", "t", "200", "D", "1")]


def test_payload_files(spark, tmp_path):
    os.makedirs(tmp_path / "d")
    (tmp_path / "d" / "1.raw").write_bytes(b"\xff")
    (tmp_path / "d" / "1.reader").write_bytes(b"r")
    (tmp_path / "d" / "2.raw").write_bytes(b"x")
    got = payloads.read_payload_files(spark, str(tmp_path))
    assert [(r["doc_id"], bytes(r["raw"]), r["reader"]) for r in got.orderBy("doc_id").collect()] == [
        (1, b"\xff", bytearray(b"r")), (2, b"x", None),
    ]


@pytest.mark.parametrize("source_format", ["parquet", "orc", "json"])
def test_tables_in_formats(spark, tmp_path, source_format):
    frame = spark.createDataFrame([("d", 1, "u")], schemas.WORK_ITEM)
    path = str(tmp_path / "t")
    tables.save_table(frame, path, source_format, partition_by=["dataset"])
    tables.save_table(frame, path, source_format, partition_by=["dataset"])
    got = tables.load_table(spark, path, source_format, schemas.WORK_ITEM)
    assert rows(got) == [("d", 1, "u")] * 2


def test_sinks(spark, tmp_path, plan_tables, parsed):
    outcome = spark.createDataFrame(
        [("d", 1, "u", "RETRIEVED", "RAW", b"x", b""), ("d", 2, "u", "FAILED", "NONE", b"", b"")],
        "dataset STRING, doc_id INT, url STRING, state STRING, content_kind STRING, raw BINARY, "
        "reader BINARY",
    )
    sinks.append_payload(outcome, str(tmp_path / "payload"))
    stored = spark.read.schema(schemas.PAYLOAD).parquet(str(tmp_path / "payload"))
    assert [(r["doc_id"], r["content_kind"]) for r in stored.collect()] == [(1, "RAW")]
    moment = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    sinks.append_status(outcome, str(tmp_path / "log"), moment, F.lit(1))
    log = spark.read.schema(schemas.STATUS_LOG).parquet(str(tmp_path / "log"))
    assert rows(current_flags(log), "doc_id")[1][2:4] == (True, True)
    sinks.append_captures(plan_tables[1], str(tmp_path / "captures"))
    assert spark.read.parquet(str(tmp_path / "captures")).count() == 5
    sinks.append_work(plan_tables[0], str(tmp_path / "work"))
    sinks.append_articles(parsing.article_rows(parsed), str(tmp_path / "articles"))
    articles = spark.read.parquet(str(tmp_path / "articles"))
    assert articles.count() == 8 and set(articles.columns) == set(schemas.ARTICLE_COLUMNS)
    entries = spark.createDataFrame([("d", "raw_new")], schemas.INGEST_LEDGER)
    sinks.append_ledger(entries, str(tmp_path / "ledger"))
    assert rows(spark.read.parquet(str(tmp_path / "ledger"))) == [("d", "raw_new")]


def test_repeated_import_adds_nothing(spark, tmp_path):
    seed = spark.createDataFrame([("d", 1, "u"), ("d", 2, "u")], schemas.WORK_ITEM)
    path = str(tmp_path / "work")
    sinks.append_work(seed.limit(1), path)
    for _ in range(2):
        known = spark.read.schema(schemas.WORK_ITEM).parquet(path).cache()
        known.count()
        sinks.append_work(new_documents(seed, known), path)
        known.unpersist()
    assert spark.read.parquet(path).count() == 2


# -- streams -----------------------------------------------------------------------------------


def test_drain_and_resume(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("payload", "out", "checkpoint"))
    payload = payloads.with_kind(spark.createDataFrame(payload_rows(), PAYLOAD_IN))

    def run():
        drain(stream_payload(spark, source, 1), out, checkpoint).awaitTermination()
        return spark.read.parquet(f"{out}/articles").count()

    batch = parsing.article_rows(parsing.parse_payload(payload))
    payload.where("doc_id < 5").repartition(2).write.parquet(source)
    assert run() == batch.where("doc_id < 5").count()
    # Nothing new: nothing happens.
    assert run() == batch.where("doc_id < 5").count()
    payload.where("doc_id >= 5").write.mode("append").parquet(source)
    run()
    got = spark.read.parquet(f"{out}/articles").drop("run", "batch")
    key = ["dataset", "doc_id"]
    assert rows(got.select(*key, "title", "body"), *key) == rows(batch.select(*key, "title", "body"), *key)
    dead = spark.read.parquet(f"{out}/dead_letters")
    assert sorted(r["doc_id"] for r in dead.collect()) == [6]
    log = spark.read.parquet(f"{out}/status_log")
    assert log.where("state = 'PARSED'").count() == batch.count()


def test_stream_of_states(spark, tmp_path):
    log = spark.createDataFrame(
        [("d", i % 5, i, s) for i, s in enumerate(["PENDING", "RETRIEVED", "FAILED", "PARSED"] * 5)],
        "dataset STRING, doc_id INT, seq BIGINT, state STRING",
    ).withColumn("event_time", F.lit("2024-01-01").cast("timestamp_ntz"))
    source, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "checkpoint"))
    log.repartition(4).write.parquet(source)
    follow_flags(stream_status(spark, source, 1), out, checkpoint).awaitTermination()
    assert rows(read_flags(spark, out)) == rows(current_flags(log))
    more = log.limit(1).withColumns({"seq": F.lit(99).cast("bigint"), "state": F.lit("RESCRAPE")})
    more.write.mode("append").parquet(source)
    follow_flags(stream_status(spark, source, 1), out, checkpoint).awaitTermination()
    assert rows(read_flags(spark, out)) == rows(current_flags(log.unionByName(more)))


def test_stream_of_seeds(spark, tmp_path):
    drop, work, checkpoint = (str(tmp_path / n) for n in ("drop", "work", "checkpoint"))
    os.makedirs(f"{drop}/dataset=d")
    os.makedirs(f"{drop}/dataset=e")

    def put(name, text):
        with open(f"{drop}/{name}", "w") as file:
            file.write("id,url\n" + text)

    def run():
        import_seeds(seeds.stream_seed(spark, drop), work, checkpoint).awaitTermination()
        return rows(spark.read.parquet(work).select("dataset", "doc_id", "url"))

    put("dataset=d/1.csv", "1,a.com\n2,b.com\n1,a.com\n")
    put("dataset=e/1.csv", "1,a.com\n")
    first = [("d", 1, "a.com"), ("d", 2, "b.com"), ("e", 1, "a.com")]
    assert run() == first
    assert run() == first
    put("dataset=d/2.csv", "2,b.com\n3,c.com\n")
    assert run() == sorted(first + [("d", 3, "c.com")])
