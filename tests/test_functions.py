"""Column functions on hand-written inputs."""

import datetime as dt

from pyspark.sql import functions as F

from newsloom.functions import arrays, authors, dates, html_fields, urls
from newsloom.functions import html as page
from newsloom.functions import text as tx
from newsloom.functions.html_fields import read_page
from newsloom.functions.language import guess_language


def test_url_variants(values):
    got = values(
        urls.url_variants, "STRING", ["a.com/x", "/a.com", "https://a.com", "a.com/?u=http", "", None]
    )
    assert got == [
        ["http://a.com/x", "https://a.com/x"],
        ["http://a.com", "https://a.com"],
        ["https://a.com"],
        ["a.com/?u=http"],
        [],
        [],
    ]


def test_url_variants_strict(values):
    got = values(lambda u: urls.url_variants(u, True), "STRING", ["a.com/?u=http", "HTTPS://a.com"])
    assert got == [["http://a.com/?u=http", "https://a.com/?u=http"], ["HTTPS://a.com"]]


def test_is_pdf(values):
    got = values(urls.is_pdf, "STRING", ["a.pdf", "a.pdf?x", "a.PDF", "a.pdfs/", "apdf"])
    assert got == [True, True, False, True, False]


def test_host(values):
    got = values(
        urls.host,
        "STRING",
        [
            "http://User:pw@Www.Example.com:8080/a?b#c",
            "example.com/x",
            "//example.com",
            "example.com.",
            "http://example.com?x=/a@b",
            "http://1.2.3.4:80/",
        ],
    )
    assert got == [
        "Www.Example.com", "example.com", "example.com", "example.com", "example.com", "1.2.3.4",
    ]


def test_tidy_text(values):
    got = values(
        tx.tidy_text, "STRING",
        [" a\tb\n\nc  d ", "it&#39;s #39;x “y” `z` ’", "", None, " a\r"],
    )
    assert got == ["a b c d", "it's 'x 'y' 'z' '", "", None, "a"]


def test_tidy_is_idempotent(values):
    texts = [" a\t b\n", "x_y  __z", "“q” ’ ", " \n "]
    for function in (tx.tidy_text, tx.tidy_title):
        once = values(function, "STRING", texts)
        assert values(function, "STRING", once) == once


def test_tidy_title(values):
    assert values(tx.tidy_title, "STRING", ["_a__b_ c_"]) == ["a b c"]


def test_entities_and_banner(values):
    got = values(
        tx.preprocess_html,
        "STRING",
        [
            "A &amp; B &copy; &middot; &#8217;x",
            "<p>The Wayback Machine - https://web.archive.org/web/1/x</p><p>y</p>",
            "<p>The Wayback Machine - https://web.archive.org/web/1\n</p>",
        ],
    )
    # An entity of six characters stays, one of five or fewer goes.
    assert got == [
        "A and B   &middot;  x",
        "<p>y</p>",
        "<p>The Wayback Machine - https://web.archive.org/web/1\n</p>",
    ]


def test_quality_forms(values):
    assert values(tx.quality_title, "STRING", [" a,b:c|d\ne’f 404.0 g.h "]) == [
        " a b c d e'f 404 g h "
    ]
    assert values(tx.quality_body, "STRING", ["a.0,b"]) == ["a 0 b"]


def test_valid_text(values):
    got = values(tx.is_valid_text, "STRING", ["a", "", None, "x Sed ut perspiciatis y"])
    assert got == [True, False, False, False]


def test_decode(values):
    assert values(tx.decode_utf8, "BINARY", [b"\xc3\xa9", b"\xff", b"", None]) == [
        "é", None, "", None,
    ]
    assert values(tx.is_empty_payload, "BINARY", [b"", None, b"x"]) == [True, True, False]


def test_remove_nul(values):
    assert values(tx.remove_nul, "STRING", ["a\x00b\x00"]) == ["ab"]


AS_OF = dt.datetime(2024, 6, 1)


def test_parse_date(values):
    as_of = F.lit("2024-06-01 00:00:00").cast("timestamp")
    cases = {
        "2023-01-02T03:04:05+02:00": dt.datetime(2023, 1, 2, 3, 4, 5),
        "2023-01-02T03:04:05.123Z": dt.datetime(2023, 1, 2, 3, 4, 5),
        "1672531200": dt.datetime(2023, 1, 1),
        " 1672531200 ": dt.datetime(2023, 1, 1),
        "1672531200000": dt.datetime(2023, 1, 1),
        "20230101": dt.datetime(2023, 1, 1),
        "Tue, 03 Jan 2023 04:05:06 GMT": dt.datetime(2023, 1, 3, 4, 5, 6),
        "January 5, 2023": dt.datetime(2023, 1, 5),
        "May 5, 2023 10:11": dt.datetime(2023, 5, 5, 10, 11),
        "5 March 2023": dt.datetime(2023, 3, 5),
        "1/2/2023": dt.datetime(2023, 1, 2),
        "Jan 4, 2024 10:20 PM": dt.datetime(2024, 1, 4, 22, 20),
        "12:05 a.m. Jan. 4th, 2024": dt.datetime(2024, 1, 4, 0, 5),
        "2024-01-05 10:20 EST": dt.datetime(2024, 1, 5, 10, 20),
        "2024-01-05T10:20+0100": dt.datetime(2024, 1, 5, 10, 20),
        "04.01.2024": dt.datetime(2024, 4, 1),
        "24.01.2024 7:08": dt.datetime(2024, 1, 24, 7, 8),
        "31/12/2023": dt.datetime(2023, 12, 31),
        "Sept. 3, 2023": dt.datetime(2023, 9, 3),
        "03-MAR-2023": dt.datetime(2023, 3, 3),
        "Wednesday, 1 February 2023 at 3:04pm": dt.datetime(2023, 2, 1, 15, 4),
        "20240101123045": dt.datetime(2024, 1, 1, 12, 30, 45),
        "1700000000000000000": None,
        "20240101123045123": None,
        "-99999999999999": None,
        "2024-01-05 25:20": None,
        "2024-13-05": None,
        "2023/02/03 04:05:06": dt.datetime(2023, 2, 3, 4, 5, 6),
        "": None,
        "soon": None,
        "2023-02-31": None,
        None: None,
    }
    got = values(lambda d: dates.parse_date(d, as_of), "STRING", list(cases))
    assert got == list(cases.values())


def test_is_epoch(values):
    got = values(dates.is_epoch, "STRING", ["12", "20230101", " 123456789 ", "1.5", "x", None])
    assert got == [True, False, True, False, False, False]


def test_pdf_date(values):
    got = values(
        dates.pdf_creation_date, "STRING", ["D:20230101124530Z", "", None, "D:2023", "x", "D:20240105", "D:202401051245+01'00'"]
    )
    assert got == [
        dt.datetime(2023, 1, 1, 12, 45, 30), None, None, dt.datetime(2023, 1, 1), None,
        dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 5, 12, 45),
    ]


def test_array_helpers(values):
    assert values(arrays.null_if_no_items, "ARRAY<STRING>", [[], ["a"], None]) == [None, ["a"], None]
    assert values(arrays.null_if_blank, "STRING", ["", "a", None]) == [None, "a", None]
    assert values(arrays.first_item, "ARRAY<STRING>", [[], ["a", "b"]]) == [None, "a"]


def test_authors(values):
    got = values(
        authors.detect_authors,
        "STRING",
        ["By Ada Vale and Ben Oak, staff", "staff writer", "", None, "Ada Vale, Ada Vale", "Élan D'Or"],
    )
    assert got == [
        ["Ada Vale", "Ben Oak"], None, None, None, ["Ada Vale", "Ada Vale"], ["Élan D'Or"],
    ]


def test_authors_of_long_pieces(values):
    # One piece of many words, once a name and once not, and words of a script without case.
    words = "Ada " * 20_000
    got = values(authors.detect_authors, "STRING", [words + "Vale", words + "1", "村上 " * 20_000 + "春樹"])
    assert got == [[words + "Vale"], None, ["村上 " * 20_000 + "春樹"]]


def test_author_model(values):
    def load():
        return lambda text: [word for word in text.split() if word.istitle()]

    got = values(authors.model_authors(load), "STRING", ["ada Vale", "none", None])
    assert got == [["Vale"], None, None]


def test_language(values):
    got = values(
        guess_language,
        "STRING",
        [
            "The cat and the dog of this house",
            "Le chat et les chiens dans une maison",
            "Der Hund und die Katze sind nicht im Haus",
            "El perro y los gatos de una casa",
            "Il cane e la gatta sono in una casa",
            "新闻报道", "ニュース", "뉴스", "новости",
            "xyzzy",
            "",
            None,
        ],
    )
    assert got == [
        "en", "fr", "de", "es", "it", "zh", "ja", "ko", "ru", "unknown", "unknown", "unknown",
    ]


def test_visible_text(values):
    got = values(
        page.visible_text,
        "STRING",
        [
            "<p>a<b>b</b></p><!-- c --><script>d('<p>')</script>&amp;&lt;",
            "x<style>p{}</style>y 1 < 2",
            "<p></p>",
            "a<script>unclosed",
        ],
    )
    assert got == ["ab&<", "xy 1 < 2", "", "a"]


def test_meta_and_media(values):
    html = (
        '<meta charset="u"><meta content="T" property="og:title"><meta name=\'author\' '
        'content=\'Ada\'><iframe src="https://www.youtube.com/embed/1"></iframe>'
        '<iframe src="/x"></iframe><img alt="" src="/a.png"><img src="/b.png">'
    )
    assert values(lambda h: page.meta_content(page.meta_tags(h), "og:title"), "STRING", [html]) == ["T"]
    assert values(lambda h: page.meta_content(page.meta_tags(h), "author"), "STRING", [html]) == ["Ada"]
    assert values(lambda h: page.meta_content(page.meta_tags(h), "none"), "STRING", [html]) == [None]
    assert values(page.media, "STRING", [html]) == [["https://www.youtube.com/embed/1", "/x"]]
    assert values(page.images, "STRING", [html]) == [["/a.png", "/b.png"]]


READER = (
    '<html><body><h1 class="big reader-title">T &amp; U</h1>'
    '<div class="credits  reader-credits">By Ada</div>'
    '<div class="content"><div class="moz-reader-content reader-show-element"><div>a<br>b</div>'
    '<time datetime="2023-01-02">x</time><time datetime="z"></time><img src="/i.png"><img src="/j">'
    "<script>no</script></div>tail<a href='/go'>l</a><a href='/2'>m</a></div>after</body></html>"
)


def test_read_page():
    fields = read_page(READER)
    assert fields["reader_title"] == "T & U"
    assert fields["reader_body"] == "abx"
    assert fields["reader_credits"] == "By Ada"
    assert fields["reader_time"] == "2023-01-02"
    assert fields["reader_image"] == "/i.png"
    assert fields["has_content"] is True
    assert fields["content_text"] == "abxtaillm"
    assert fields["first_link"] == "/go"


def test_read_page_gaps():
    bare = read_page("<p>nothing")
    assert bare["has_content"] is False and bare["first_link"] is None
    assert bare["reader_title"] is None and bare["reader_body"] is None
    assert read_page('<span class="content">x</span>')["first_link"] == ""
    assert read_page('<span class="content">x</span>')["has_content"] is False
    assert read_page(None) is None
    # Unclosed elements end with the element around them.
    nested = read_page('<div><p class="reader-title">a<b>b</div>c')
    assert nested["reader_title"] == "ab"
    # Both class names, in this order, and nothing else make a body.
    assert read_page('<div class="reader-show-element moz-reader-content">x</div>')["reader_body"] is None
    # Times and images outside the body do not count.
    outside = read_page('<time datetime="1"></time><img src="a">' + READER)
    assert outside["reader_time"] == "2023-01-02" and outside["reader_image"] == "/i.png"


def test_reader_pages_leave_python_in_slices(monkeypatch):
    """Only a slice's fields are held as Python's own, and a page that comes again is read once."""
    page = '<div class="content">{}<p>text</p></div>'
    pages = [page.format(k) for k in range(6)] + [page.format(5)] * 40 + [None, ""]
    want = [html_fields.read_page(p) for p in pages]
    read, slices = [], []
    usual, array = html_fields.read_page, html_fields.pa.array
    monkeypatch.setattr(html_fields, "SLICE_CHARS", 100)
    monkeypatch.setattr(html_fields, "read_page", lambda html: read.append(html) or usual(html))
    monkeypatch.setattr(html_fields.pa, "array", lambda rows, **kind: slices.append(len(rows)) or array(rows, **kind))
    got = html_fields._read_pages(array(pages)).to_pylist()
    assert [None if g is None else {k: v for k, v in g.items() if v is not None} for g in got] == [
        None if w is None else {k: v for k, v in w.items() if v is not None} for w in want
    ]
    assert len(slices) > 2 and len(read) < 12
    assert html_fields._read_pages(array([], type="string")).to_pylist() == []
