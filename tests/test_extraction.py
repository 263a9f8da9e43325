"""Blocks, JSON-LD, language profiles, dates by host."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsloom.functions import blocks, dates, structured
from newsloom.functions import html as page
from newsloom.functions.language import guess_language
from newsloom.operators import languages, names
from newsloom.operators.date_order import host_order, with_dates
from newsloom.operators.extract import raw_body, with_raw_article

LONG = "A sentence of the story that is long enough to count as text. " * 3


def best(values, htmls):
    return values(lambda h: F.btrim(F.regexp_replace(blocks.main_text(h), " +", " ")), "STRING", htmls)


def test_block_table(values):
    html = '<div>a<p title="x > y">b <a href="/">link</a></p><a href="/c"><h3>in</h3></a></div>'
    (rows,) = values(blocks.blocks, "STRING", [html])
    assert [(r["tag"], r["chars"], r["links"]) for r in rows] == [
        ("", 0, 0), ("div", 1, 0), ("p", 7, 6), ("/p", 0, 0), ("h3", 2, 0), ("/h3", 0, 0), ("/div", 0, 0),
    ]
    assert rows[3]["opens"] and rows[5]["closes"]


def test_menus_cards_and_ads_stay_out(values):
    menu = '<ul><li><a href="/a">Politics and more</a></li><li><a href="/b">Sports</a></li></ul>'
    card = '<div class="c"><a href="/x"><div><p>A teaser that is linked as a whole, text and all.</p></div></a></div>'
    ad = '<div class="ad">Buy now</div>'
    story = f"<h1>T</h1><p>{LONG}</p><p>{LONG}</p>"
    text = " ".join([LONG.strip()] * 2)
    htmls = [
        f"<body>{menu}<article>{story}</article>{card}{ad}</body>",
        f"<body>{menu}<div>{story}</div>{card}{ad}</body>",
        f"<body><article>{story}{card}{ad}</article><article><p>{LONG}</p></article></body>",
        f"<body><article><p>{LONG}{LONG}</p>{ad}{card}<h2>Then</h2><p>{LONG}</p></article></body>",
    ]
    got = best(values, htmls)
    assert got[:3] == [text] * 3
    # What stands inside is left out, headings stay.
    assert got[3] == f"{LONG}{LONG.strip()} Then {LONG.strip()}"


def test_two_articles_are_not_joined(values):
    html = f"<article><p>{LONG}</p></article><div>ad</div><article><p>{LONG}{LONG}</p></article>"
    assert best(values, [html]) == [(LONG * 2).strip()]


def test_pages_without_blocks(values):
    clean = [None, "", "text alone", "<body><div>Short text</div></body>", "<p></p>"]
    got = values(lambda h: raw_body(h, page.article_region(h)), "STRING", clean)
    assert [x if x is None else x.strip() for x in got] == [None, "", "text alone", "Short text", ""]


def test_quoted_signs_in_tags(values):
    html = '<meta property="og:title" content="A &gt; B > C"><meta name=odd content="x><meta name="n" content="N">'
    tags = lambda h: page.meta_tags(h)
    assert values(lambda h: page.meta_content(tags(h), "og:title"), "STRING", [html]) == ["A > B > C"]
    assert values(lambda h: page.meta_content(tags(h), "n"), "STRING", [html]) == ["N"]
    img = '<img alt="a > b" src="/i.png"><video src="/v.mp4"></video><iframe src="about:blank"></iframe>'
    assert values(page.first_image, "STRING", [img]) == ["/i.png"]
    assert values(page.media, "STRING", [img]) == [["/v.mp4"]]


def ld(*scripts):
    return "".join(f'<script type="application/ld+json">{s}</script>' for s in scripts)


def test_structured_data(values):
    htmls = [
        ld('{"@type":"NewsArticle","headline":"H","datePublished":"2024-01-02","author":"Ada Vale"}'),
        ld('{"@graph":[{"@type":"Person","name":"No"},{"@type":["Article"],"author":[{"name":"A B"},"C D",'
           '{"name":["E F"]},{"url":"x"},7]}]}'),
        ld("{broken", '[{"@type":"BlogPosting","dateCreated":"2023","image":{"url":"/u"}}]'),
        ld('{"@type":"WebSite","headline":"no"}', "null", "[]", "7", '{"headline":"untyped"}'),
        "<p>none</p>", None,
        ld('{"@type":"Article","headline":7,"author":null,"image":[]}'),
    ]
    got = values(structured.fields, "STRING", htmls)
    assert tuple(got[0]) == ("H", ["2024-01-02"], ["Ada Vale"], None)
    assert tuple(got[1]) == (None, [], ["A B", "C D", "E F"], None)
    assert tuple(got[2]) == (None, ["2023"], None, "/u")
    assert tuple(got[3]) == (None, [], None, None)
    assert got[4:6] == [None, None]
    assert tuple(got[6]) == (None, [], None, None)


def test_raw_article_from_structured_data(spark):
    html = (
        "<html><head>" + ld('{"@type":"Article","author":{"name":"Ada Vale"},"datePublished":"5 janvier 2024"}')
        + f"</head><body><article><p>{LONG}</p></article></body></html>"
    )
    frame = spark.createDataFrame([(html, "http://x/")], "raw string, url string")
    (got,) = with_raw_article(frame).collect()
    assert got["raw_article"]["authors"] == ["Ada Vale"]
    assert got["raw_article"]["publish_date"] == dt.datetime(2024, 1, 5)


@pytest.mark.parametrize("text, want", [
    ("Thursday, January 4th, 2024 at 10:20 p.m. EST", dt.datetime(2024, 1, 4, 22, 20)),
    ("20240101T102030Z", dt.datetime(2024, 1, 1, 10, 20, 30)),
    ("20240101T1020+02:00", dt.datetime(2024, 1, 1, 10, 20)),
    ("4. März 2024", dt.datetime(2024, 3, 4)),
    ("5 janvier 2024", dt.datetime(2024, 1, 5)),
    ("mar. 5 févr. 2024 à 9h05", dt.datetime(2024, 2, 5, 9, 5)),
    ("mar 2 abr 2024", dt.datetime(2024, 4, 2)),
    ("1er août 2023", dt.datetime(2023, 8, 1)),
    ("12 de diciembre de 2023", dt.datetime(2023, 12, 12)),
    ("3 maggio 2024", dt.datetime(2024, 5, 3)),
    ("Do., 7. Dez. 2023, 18:30 Uhr", dt.datetime(2023, 12, 7, 18, 30)),
    ("2024 Jan 4", dt.datetime(2024, 1, 4)),
    ("Jan 4 99", dt.datetime(1999, 1, 4)),
    ("10 p.m. 4 Jan 2024", dt.datetime(2024, 1, 4, 22)),
    ("2024-01-04 10:20 CEST", dt.datetime(2024, 1, 4, 10, 20)),
    ("Mon 1/2/2024", dt.datetime(2024, 1, 2)),
    ("10:20 5 MAR 2024", dt.datetime(2024, 3, 5, 10, 20)),
    ("2024-02-30", None), ("jui 4 2024", None), ("January 2024", None), ("soon", None), ("4 foo 2024", None),
    ("2024-01-04T24:00:00", None), ("31 April 2024", None), ("5 января 2024", None), ("", None), (None, None),
])
def test_date_grammar(values, text, want):
    assert values(dates.parse_date, "STRING", [text]) == [want]


def test_hosts_decide_day_or_month(spark):
    rows = [
        ("a", "13/01/2024"), ("a", "14.01.2024"), ("a", "01/13/2024"), ("a", "02/03/2024"),
        ("b", "02/13/2024"), ("b", "02/03/2024"), ("c", "02/03/2024"), (None, "25/03/2024"), ("a", "x"), ("b", None),
    ]
    table = spark.createDataFrame(rows, "host string, date string")
    votes = {r["host"]: (r["day_votes"], r["month_votes"], r["day_first"]) for r in host_order(table, "host", "date").collect()}
    assert votes == {"a": (2, 1, True), "b": (0, 1, False)}
    got = {
        (r["host"], r["date"]): r["publish_date"]
        for r in with_dates(table, "host", "date", spread_by=["date"]).collect()
    }
    assert got["a", "02/03/2024"] == dt.datetime(2024, 3, 2)
    assert got["b", "02/03/2024"] == got["c", "02/03/2024"] == dt.datetime(2024, 2, 3)
    assert got["a", "01/13/2024"] == dt.datetime(2024, 1, 13)
    assert got[None, "25/03/2024"] == dt.datetime(2024, 3, 25)
    assert got["a", "x"] is None and got["b", None] is None and len(got) == len(rows)


def test_scripts_and_more_languages(values):
    got = values(guess_language, "STRING", [
        "Это новости о выставке de la art", "Это новости", "これは新しい記事です", "新しい", "这是新闻", "Τα νέα της ημέρας of the day",
        "Het is een verhaal over de stad en het land, dat niet kort is", "To nie jest tak, jak było przez lata",
        "Byl to jeho dům, protože už není pouze on", "och det är inte så att han", "Det er ikke så godt og jeg var der", "", None, "xyz",
    ])
    assert got == ["ru", "ru", "ja", "ja", "zh", "el", "nl", "pl", "cs", "sv", "da", "unknown", "unknown", "unknown"]


def test_language_profiles_on_held_out_documents(spark):
    """Accuracy on documents that the profiles have not seen, and on words never seen whole."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learned = languages.learn(documents.where("doc_id % 5 <> 0"), "text", "lang").cache()
    counts = {r["language"]: r["count"] for r in learned.groupBy("language").count().collect()}
    assert set(counts) == {"de", "en", "es", "fr"} and max(counts.values()) <= languages.SIZE
    held_out = documents.where("doc_id % 5 = 0")
    got = languages.guess(held_out, ["doc_id"], "text", learned).join(documents, "doc_id").collect()
    assert len(got) == held_out.count()
    assert sum(r["guessed"] == r["lang"] for r in got) >= 0.97 * len(got)


def test_language_profiles_of_odd_texts(spark):
    table = spark.createDataFrame(
        [(1, "aaa aab", "x"), (2, "zzz zzy", "y"), (3, None, "x"), (4, "abc", None)], "id int, text string, lang string"
    )
    learned = languages.learn(table, "text", "lang")
    ask = spark.createDataFrame([(1, "aa"), (2, "ZZZ"), (3, "日本"), (4, ""), (5, None)], "id int, text string")
    got = {r["id"]: r["guessed"] for r in languages.guess(ask, ["id"], "text", learned).collect()}
    assert got == {1: "x", 2: "y", 3: "unknown", 4: "unknown", 5: "unknown"}
    none = languages.learn(table.limit(0), "text", "lang")
    assert {r["guessed"] for r in languages.guess(ask, ["id"], "text", none).collect()} == {"unknown"}


def test_persons_of_bylines(spark):
    text = "We met, with staff writer and staff, new times, new writer, at the times of new staff. " * 3
    words = names.word_case(spark.createDataFrame([(text,), (None,), ("York, in York, so York",)], "text string"), "text")
    counts = {r["word"]: (r["n"], r["small"]) for r in words.collect()}
    assert counts["staff"][0] >= 5 and counts["york"] == (2, 0) and "we" not in counts
    rows = [
        (1, "By Jane Doe, Staff Writer"), (2, "John Roe, Staff Writer"), (3, "New York Times"), (4, "Jane Doe with John Roe"),
        (5, "Rose Staff"), (6, None), (7, ""), (8, "John Roe and Jane Doe"),
    ]
    bylines = spark.createDataFrame(rows, "id int, byline string")
    got = {r["id"]: r["authors"] for r in names.persons(bylines, ["id"], "byline", words).collect()}
    assert got == {
        1: ["Jane Doe"], 2: ["John Roe"], 3: None, 4: ["Jane Doe", "John Roe"], 5: None, 6: None, 7: None,
        8: ["John Roe", "Jane Doe"],
    }


def test_offices_by_their_company(spark):
    """One common word is enough for a piece that stands behind many different names."""
    words = spark.createDataFrame([("desk", 9, 9)], "word string, n bigint, small bigint")
    rows = [(k, f"{first} Vale, Reuters Sports Desk") for k, first in enumerate(["Ada", "Ben", "Cleo", "Dan", "Eva"])]
    rows += [(10 + k, "Ada Vale, Ben Long Desk") for k in range(5)]
    bylines = spark.createDataFrame(rows, "id int, byline string")
    got = {r["id"]: r["authors"] for r in names.persons(bylines, ["id"], "byline", words).collect()}
    assert all(len(got[k]) == 1 for k in range(5)) and got[10] == ["Ada Vale", "Ben Long Desk"]
