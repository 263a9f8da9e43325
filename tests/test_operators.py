"""DataFrame operators: joins, ranking, captures, attempts, states, merging, redirects."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom.functions.index_udtf import register_archive_lines
from newsloom.operators import (
    attempts,
    captures,
    ledger,
    merge,
    pdf,
    ranking,
    redirects,
    state,
    worklist,
)
from newsloom.operators.domains import split_domains
from newsloom.operators.lookup import join_lookup, join_split
from newsloom.operators.policy import route_label, with_method


def rows(frame, *order):
    return [tuple(row) for row in frame.orderBy(*(order or frame.columns)).collect()]


# -- joins -----------------------------------------------------------------------------------


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_split_join_equals_plain_join(spark, how):
    # A third of all facts share one key, and a third have none.
    keys = ["hot"] * 400 + [None] * 400 + [f"k{i % 90}" for i in range(400)]
    facts = spark.createDataFrame([("d", i, k) for i, k in enumerate(keys)],
                                  "dataset STRING, doc_id INT, k STRING")
    lookup = spark.createDataFrame(
        [("hot", 1), (None, 9)] + [(f"k{i}", i) for i in range(0, 90, 2)], "k STRING, v INT"
    )
    split = join_split(facts, lookup, ["k"], how, ["dataset", "doc_id"], hot_rows=20)
    plain = facts.join(lookup, ["k"], how)
    assert sorted(split.columns) == sorted(plain.columns)
    columns = sorted(plain.columns)
    key = repr
    assert sorted(map(tuple, split.select(columns).collect()), key=key) == sorted(
        map(tuple, plain.select(columns).collect()), key=key
    )


def test_hot_keys_are_spread(spark):
    facts = spark.range(5000).select(
        F.lit("d").alias("dataset"), F.col("id").cast("int").alias("doc_id"), F.lit("hot").alias("k")
    )
    lookup = spark.createDataFrame([("hot", 1)], "k STRING, v INT")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        joined = join_split(facts, lookup, ["k"], "left", ["dataset", "doc_id"], hot_rows=100)
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
        assert sum(row["count"] for row in sizes) == 5000
        assert max(row["count"] for row in sizes) < 3000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_small_lookup_is_broadcast(spark):
    facts = spark.range(10).select(F.col("id").cast("string").alias("dataset"), F.col("id").alias("doc_id"))
    plan = join_lookup(facts, spark.createDataFrame([("d", 1)], "dataset STRING, v INT"), ["dataset"])
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString()


def test_domains(spark):
    suffixes = spark.createDataFrame(
        [(s,) for s in ["com", "uk", "co.uk", "example.com", "*.ck", "!www.ck"]], "suffix STRING"
    )
    urls = [
        "http://www.Guardian.co.uk/x", "https://a.b.example.com", "news.com", "com", "http://10.0.0.1/x",
        "foo.bar.ck", "www.ck", "unknown.zzz", "a.www.ck",
    ]
    work = spark.createDataFrame([("d", i, u) for i, u in enumerate(urls)],
                                 "dataset STRING, doc_id INT, url STRING")
    got = split_domains(work, suffixes).select("doc_id", "subdomain", "domain", "suffix")
    assert rows(got, "doc_id") == [
        (0, "www", "Guardian", "co.uk"),
        (1, "a", "b", "example.com"),
        (2, "", "news", "com"),
        (3, "", "", "com"),
        (4, "", "10.0.0.1", ""),
        (5, "", "foo", "bar.ck"),
        (6, "", "www", "ck"),
        (7, "unknown", "zzz", ""),
        (8, "a", "www", "ck"),
    ]


def test_policy(spark):
    docs = spark.createDataFrame(
        [("d", 1, "Times", "com"), ("d", 2, "times", "fr"), ("d", 3, "gone", "com"), ("d", 4, "gate", "com")],
        "dataset STRING, doc_id INT, domain STRING, suffix STRING",
    )
    policy = spark.createDataFrame(
        [(1, "", "times", "com", "no_method", True), (2, "", "gate", "com", "12ft_ladder", True)],
        "id INT, subdomain STRING, domain STRING, suffix STRING, method STRING, checked BOOLEAN",
    )
    label = route_label(F.col("method")).alias("route")
    assert rows(with_method(docs, policy).select("doc_id", label)) == [
        (1, "UNKNOWN"), (2, "FREE"), (3, "UNKNOWN"), (4, "GATED"),
    ]
    assert rows(with_method(docs, policy, normalize_case=True).select("doc_id", label))[0] == (1, "FREE")
    strict = with_method(docs, policy, normalize_case=True, match_suffix=True)
    assert rows(strict.select("doc_id", label))[:2] == [(1, "FREE"), (2, "UNKNOWN")]


# -- ranking and worklists ---------------------------------------------------------------------


@pytest.mark.parametrize("partitions", [1, 7])
def test_row_numbers_match_brute_force(spark, partitions):
    rng = random.Random(1)
    ids = rng.sample(range(-500_000, 5_000_000), 3000)
    data = [("big" if i % 3 else "small", doc) for i, doc in enumerate(ids)]
    frame = spark.createDataFrame(data, "dataset STRING, doc_id INT").repartition(partitions)
    got = ranking.row_numbers(
        frame, ["dataset"], ["doc_id"], ranking.integer_block(F.col("doc_id"))
    )
    expected = []
    for name in ("big", "small"):
        for n, doc in enumerate(sorted(d for s, d in data if s == name), 1):
            expected.append((name, doc, n))
    assert rows(got.select("dataset", "doc_id", "row_no"), "dataset", "row_no") == expected


def test_chunks(spark):
    work = spark.createDataFrame([("d", i) for i in range(31)], "dataset STRING, doc_id INT")
    ordered = {r["doc_id"]: r["chunk_no"] for r in worklist.chunks(work).collect()}
    assert ordered == {i: i // 15 for i in range(31)}
    one = {r["doc_id"]: r["chunk_no"] for r in worklist.chunks(work, seed=1).collect()}
    again = {r["doc_id"]: r["chunk_no"] for r in worklist.chunks(work.repartition(5), seed=1).collect()}
    other = {r["doc_id"]: r["chunk_no"] for r in worklist.chunks(work, seed=2).collect()}
    assert one == again != other
    sizes = sorted(list(one.values()).count(c) for c in set(one.values()))
    assert sizes == [1, 15, 15]
    shuffled = [r["doc_id"] for r in worklist.shuffled(work, 1).collect()]
    assert [one[d] for d in shuffled] == sorted(one.values())


def test_no_single_partition_window(spark):
    work = spark.createDataFrame([("d", i) for i in range(31)], "dataset STRING, doc_id INT")
    plan = worklist.chunks(work)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


# -- captures ----------------------------------------------------------------------------------


def capture_table(spark, items):
    data = [("d", doc, "k", ts, f"http://x/{o}", "text/html", status, "D", "1")
            for doc, ts, o, status in items]
    return spark.createDataFrame(
        data,
        "dataset STRING, doc_id INT, urlkey STRING, timestamp STRING, original STRING, "
        "mimetype STRING, statuscode STRING, digest STRING, length STRING",
    )


LINES = "k 20200101000000 http://x text/html 200 D 1\nsix fields only here d x\n\na b c d e f g h\n"


def test_index_answers(spark):
    answers = spark.createDataFrame([("d", 1, LINES), ("d", 2, "")], "dataset STRING, doc_id INT, body STRING")
    got = captures.parse_index_answers(answers)
    assert [tuple(r) for r in got.collect()] == [
        ("d", 1, "k", "20200101000000", "http://x", "text/html", "200", "D", "1")
    ]
    register_archive_lines(spark, "archive_lines_test")
    answers.createOrReplaceTempView("answers")
    lateral = spark.sql("SELECT dataset, doc_id, c.* FROM answers, LATERAL archive_lines_test(body) c")
    assert rows(lateral) == rows(got)


def test_capture_order_and_choice(spark):
    table = capture_table(spark, [
        (1, "2022", "a", "301"), (1, "2021", "b", "200"), (1, "2020", "c", "404"),
        (1, "2023", "d", "-"), (1, "2021", "b", "200"), (2, "2020", "e", "500"),
    ])
    placed = captures.ordered_captures(table).where("doc_id = 1")
    assert rows(placed.select("place", "statuscode", "timestamp", "copies"), "place") == [
        (1, "-", "2023", 1), (3, "200", "2021", 2), (4, "301", "2022", 1), (5, "404", "2020", 1),
    ]
    best = captures.first_usable(table)
    assert rows(best.select("doc_id", "location")) == [
        (1, "https://web.archive.org/web/2021/http://x/b")
    ]
    assert captures.usable_captures(table, ["200"]).count() == 2


def test_cells_are_cut_by_status_and_month(spark):
    items = [(1, f"{200001 + i // 9}{i % 9 + 10}", "a", "200") for i in range(300)]
    items += [(2, "20010101", "a", "200")] * 40
    got = captures.capture_cells(capture_table(spark, items)).select(
        "doc_id", "statuscode", "month", F.explode("captures").alias("c")
    )
    collected = got.select("doc_id", "month", "c.timestamp", "c.copies").collect()
    assert sorted(r["timestamp"] for r in collected if r["doc_id"] == 1) == sorted(i[1] for i in items[:300])
    assert all(r["timestamp"].startswith(r["month"]) for r in collected)
    assert [(r["month"], r["copies"]) for r in collected if r["doc_id"] == 2] == [("200101", 40)]


def test_cached(spark):
    work = spark.createDataFrame([("d", 1), ("d", 3)], "dataset STRING, doc_id INT")
    table = capture_table(spark, [(1, "2022", "a", "301"), (1, "2021", "b", "200")])
    got = captures.cached_documents(work, table)
    assert rows(got) == [("d", 1, 2, True), ("d", 3, 0, False)]


def test_tries(spark):
    log = [(1, 1, 503), (1, 2, None), (1, 3, 200), (1, 4, 200), (2, 1, 503), (2, 2, 500), (2, 3, None),
           (3, 1, None), (4, 6, 200), (4, 1, 404)]
    table = spark.createDataFrame(log, "doc_id INT, attempt INT, http_status INT")
    assert rows(attempts.pick_try(table, ["doc_id"]), "doc_id") == [
        (1, 3, 200, False), (2, 2, 500, False), (3, None, None, True), (4, 1, 404, False),
    ]


def test_variants(spark):
    data = [
        (1, 1, "boom", 200, 0), (1, 2, None, 200, 3), (2, 1, None, 503, 0), (2, 2, None, 200, 3),
        (3, 1, "x", 200, 0), (3, 2, "y", 200, 0), (4, 1, None, 200, 2), (4, 2, None, 503, 0),
    ]
    table = spark.createDataFrame(
        data, "doc_id INT, variant_no INT, error STRING, http_status INT, n_captures INT"
    )
    assert rows(attempts.pick_variant(table, ["doc_id"])) == [(1, 2), (2, 1), (3, None), (4, 1)]
    assert rows(attempts.pick_index_variant(table, ["doc_id"])) == [(1, 2), (2, None), (3, None), (4, 1)]


# -- states -------------------------------------------------------------------------------------


def log_table(spark, events):
    data = [(ds, doc, seq, f"2024-01-{day:02d} 00:00:00", s) for ds, doc, seq, day, s in events]
    return spark.createDataFrame(
        data, "dataset STRING, doc_id INT, seq BIGINT, event_time STRING, state STRING"
    ).withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))


EVENTS = [
    ("a", 1, 1, 1, "PENDING"), ("a", 1, 2, 2, "RETRIEVED"), ("a", 1, 3, 3, "PARSED"),
    ("b", 1, 1, 1, "PENDING"),
    ("a", 2, 1, 1, "RETRIEVED"), ("a", 2, 2, 1, "FAILED"),
    ("a", 3, 2, 1, "RETRIEVED"), ("a", 3, 1, 1, "FAILED"),
    ("a", 4, 1, 1, "RETRIEVED"), ("a", 4, 2, 2, "RESCRAPE"), ("a", 4, 3, 3, "PARSED"),
    ("a", 5, 1, 1, "INDEX_ERROR"),
]


def test_flags(spark):
    log = log_table(spark, EVENTS)
    expected = [
        ("a", 1, False, True, True, False),
        ("a", 2, True, True, False, False),
        ("a", 3, False, True, False, False),
        ("a", 4, False, True, True, True),
        ("a", 5, False, False, False, False),
        ("b", 1, False, False, False, False),
    ]
    assert rows(state.current_flags(log), "dataset", "doc_id") == expected
    # Compacting, repeating and reordering the log change nothing.
    assert rows(state.current_flags(state.snapshot(log)), "dataset", "doc_id") == expected
    assert rows(state.current_flags(log.union(log).repartition(5)), "dataset", "doc_id") == expected
    names = state.current_flags(log).select("doc_id", state.state_name().alias("s"), "dataset")
    assert [r[1] for r in rows(names, "dataset", "doc_id")] == [
        "PARSED", "FAILED", "RETRIEVED", "PARSED", "PENDING", "PENDING",
    ]


def test_worklists(spark):
    log = log_table(spark, EVENTS)
    work = spark.createDataFrame(
        [("a", i, f"u{i}") for i in range(1, 7)] + [("b", 1, "v")],
        "dataset STRING, doc_id INT, url STRING",
    )
    flagged = state.with_flags(work, log)
    assert rows(worklist.pending(flagged)) == [("a", 5, "u5"), ("a", 6, "u6"), ("b", 1, "v")]
    assert rows(worklist.pending(flagged, "b")) == [("b", 1, "v")]
    assert rows(worklist.parse_ready(flagged)) == [("a", 3, "u3")]
    assert rows(worklist.newest_parse_ready(flagged, "a")) == [("a", 3, "u3")]


def test_import_once(spark):
    seed = spark.createDataFrame(
        [("x", 1, "u"), ("y", 1, "u"), ("z", 1, "u")], "dataset STRING, doc_id INT, url STRING"
    )
    entries = spark.createDataFrame(
        [("x", fv.WORK_STAGE), ("x", fv.CAPTURE_STAGE), ("y", fv.WORK_STAGE)],
        "dataset STRING, stage STRING",
    )
    assert [r[0] for r in rows(ledger.already_imported(seed, entries))] == ["x"]
    left = ledger.to_import(seed, entries)
    assert [r[0] for r in rows(left)] == ["y", "z"]
    assert [r[0] for r in rows(ledger.to_import(seed, entries, fv.WORK_STAGE))] == ["z"]
    # A second import finds everything in the ledger.
    after = entries.unionByName(ledger.ledger_entries(left))
    assert ledger.to_import(seed, after).count() == 0
    known = spark.createDataFrame([("x", 1), ("y", 2)], "dataset STRING, doc_id INT")
    assert [r[0] for r in rows(ledger.new_documents(seed, known))] == ["y", "z"]


# -- articles ------------------------------------------------------------------------------------

ART = (
    "struct<title:string,body:string,publish_date:timestamp_ntz,authors:array<string>,"
    "language:string,top_image_url:string,media_urls:array<string>>"
)


def test_merge(spark):
    def art(title=None, body=None, language=None, authors=None, image=None, media=None):
        return (title, body, None, authors, language, image, media)

    data = [
        (1, art("R", "rb", "en", ["A"], "i", ["m"]), art("S", "sb", "fr", ["B"], "j")),
        (2, art("R", "rb", "en"), art("S", None, "unknown")),
        (3, art("R", None, "unknown"), art(None, "sb", "fr")),
        (4, art(None, None, "unknown"), art(None, None, "unknown")),
        (5, None, art("S", "sb", "fr", None, "j")),
        (6, art("R", "rb", "en", ["A"]), None),
    ]
    frame = spark.createDataFrame(data, f"i INT, raw_article {ART}, reader_article {ART}")
    got = merge.merge_views(frame).orderBy("i").collect()
    assert [(r["title"], r["body"], r["language"], r["authors"], r["top_image_url"], r["media_urls"],
             r["is_empty"]) for r in got] == [
        ("S", "sb", "fr", ["B"], "i", ["m"], False),
        # Without a simplified body, title and language are the raw ones.
        ("R", "rb", "en", None, None, None, False),
        ("R", "sb", "fr", None, None, None, False),
        # A language alone is no article.
        (None, None, "unknown", None, None, None, True),
        ("S", "sb", "fr", None, "j", None, False),
        ("R", "rb", "en", ["A"], None, None, False),
    ]


def test_pdf_pages_in_order(spark):
    pages = spark.createDataFrame(
        [("d", 1, 10, "c"), ("d", 1, 2, "b "), ("d", 1, 1, "a "), ("d", 1, 3, ""), ("d", 2, 1, "")],
        "dataset STRING, doc_id INT, page_no INT, text STRING",
    )
    meta = spark.createDataFrame(
        [("d", 1, "My_title\x00", "D:20230101124530Z"), ("d", 3, None, "junk")],
        "dataset STRING, doc_id INT, title STRING, creation_date STRING",
    )
    got = pdf.pdf_articles(meta, pages).orderBy("doc_id").collect()
    first = got[0]["pdf_article"]
    assert (first["title"], first["body"], str(first["publish_date"])) == (
        "My title", "a b c", "2023-01-01 12:45:30",
    )
    assert got[1]["pdf_article"]["body"] is None and got[1]["pdf_article"]["language"] == "unknown"
    assert got[2]["pdf_article_date_problem"] == "unreadable date: junk"


def test_pdf_with_many_pages(spark):
    pages = spark.createDataFrame(
        [("d", doc, n, f"<{n}>") for doc, size in ((1, 50), (2, 3)) for n in range(size)],
        "dataset STRING, doc_id INT, page_no INT, text STRING",
    ).repartition(4)
    blocked = rows(pdf.joined_pages(pages, block_bits=2))
    assert blocked == rows(pdf.joined_pages(pages))
    assert blocked[0] == ("d", 1, "".join(f"<{n}>" for n in range(50)))


# -- redirects ---------------------------------------------------------------------------------


def test_redirect_edges(spark):
    page = '<p>Redirecting to...</p><div class="content"><a href="{}">x</a></div>'
    pages = spark.createDataFrame(
        [("a", page.format("b")), ("b", "plain"), ("c", "Redirecting to... <div class='content'></div>")],
        "url STRING, reader STRING",
    )
    assert rows(redirects.redirect_edges(pages)) == [("a", "b"), ("c", "")]


def test_redirect_chains(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(40)]
    loop = [("l1", "l2"), ("l2", "l3"), ("l3", "l1"), ("into", "l2")]
    hot = [(f"h{i}", "n38") for i in range(50)]
    edges = spark.createDataFrame(chain + loop + hot + [("e", "")], "from_url STRING, to_url STRING")
    got = {r["from_url"]: (r["final_url"], r["hops"]) for r in redirects.chain_ends(edges).collect()}
    assert got["n0"] == ("n40", 40) and got["n39"] == ("n40", 1)
    assert got["h7"] == ("n40", 3) and got["e"] == ("", 1)
    assert all(got[name] == ("", None) for name in ("l1", "l2", "l3", "into"))
    docs = spark.createDataFrame([("d", 1, "n0"), ("d", 2, "stays"), ("d", 3, "l1")],
                                 "dataset STRING, doc_id INT, url STRING")
    resolved = redirects.resolve_redirects(docs, edges)
    assert rows(resolved.select("doc_id", "final_url", "hops")) == [
        (1, "n40", 40), (2, "stays", 0), (3, "", None),
    ]
