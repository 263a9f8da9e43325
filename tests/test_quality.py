"""The page-quality gate."""

import pytest
from pyspark.sql import functions as F

from newsloom.operators import quality


def doc(title="A story", body="Some text"):
    return f"<html><head><title>{title}</title></head><body>{body}</body></html>"


BAD_TITLES = [
    "Error 404 - Site", "Page not found", "error", "500", "Site: page not found", "404.0 x",
    "the page you’re looking for is not here", "Please log in", "Access denied", "PAGE MISSING",
    "a|server error|b", "",
]
GOOD_TITLES = ["A story", "The errors of 1404 men", "Error in court", "page not founded", "login"]


@pytest.mark.parametrize("compatible", [False, True])
def test_titles(values, compatible):
    def check(html):
        return quality.is_bad_title(html, compatible)

    bad = values(check, "STRING", [doc(t) for t in BAD_TITLES])
    expected = [not (compatible and t in ("Please log in", "Access denied")) for t in BAD_TITLES]
    assert bad == expected
    assert not any(values(check, "STRING", [doc(t) for t in GOOD_TITLES]))


def test_titles_anywhere(values):
    pages = [
        "<body>no title</body>",
        doc(body="<svg><title>404</title></svg> text"),
        "<TITLE lang='x'>ok\nok</TITLE>",
    ]
    assert values(quality.is_bad_title, "STRING", pages) == [True, True, False]


def test_title_followed_by_blank_in_compatible_mode(values):
    check = lambda html: quality.is_bad_title(html, True)
    assert values(check, "STRING", [doc("please log in "), doc("please log in")]) == [True, False]


def test_raw_bodies(values):
    cases = {
        doc(): False,
        "<title>x</title><body>never closed": True,
        doc(body="<p></p><script>x</script>"): True,
        doc(body=" "): False,
        doc(body="<p>Sorry: page</p><p> not found.</p>"): True,
        doc(body="web.archive page not found"): False,
        doc(body="Don&#39;t have an account? Sign up"): True,
        doc(body="This domain is parked free, courtesy of GoDaddy.com"): True,
        doc(body="too many requests"): True,
        doc(body="404"): False,
        doc(body="ok") + "<body>server error</body>": True,
    }
    assert values(quality.is_bad_raw_body, "STRING", list(cases)) == list(cases.values())


def test_raw_bodies_compatible(values):
    check = lambda html: quality.is_bad_raw_body(html, True)
    cases = {
        doc(body="too many requests"): False,
        doc(body="too many requests now"): True,
        doc(body="xDon't have an account Sign up now"): True,
        doc(body="Don't have an account? Sign up now"): False,
        doc(body="is parked free, courtesy of godaddy.com now"): False,
    }
    assert values(check, "STRING", list(cases)) == list(cases.values())


def test_raw_markers(values):
    cases = {
        doc(body="The Wayback Machine has not archived that URL."): True,
        doc(body="This URL has been excluded from the Wayback Machine."): True,
        doc(body="You don't have permission to access / here"): True,
        doc(): False,
    }
    assert values(quality.is_rejected_raw, "STRING", list(cases)) == list(cases.values())


CONTENT = '<title>x</title><body><div class="content">{}</div></body>'


def test_gate(spark):
    rows = [
        (1, doc(), CONTENT.format("fine")),
        (2, doc("404"), CONTENT.format("")),
        (3, doc(), "<title>x</title><p>no content box"),
        (4, "", CONTENT.format("Sed ut perspiciatis")),
        (5, None, CONTENT.format("Fallo al cargar el articulo")),
        (6, doc(), CONTENT.format("page not found")),
        (7, doc(), '<title id="reader-title">Internet Archive logo</title>' + CONTENT.format("x")),
        (8, doc(), ""),
    ]
    frame = spark.createDataFrame(rows, "i INT, raw STRING, reader STRING")
    got = {
        row["i"]: (row["raw"] != "", row["reader"] != "")
        for row in quality.gate_views(frame).collect()
    }
    assert got == {
        1: (True, True),
        2: (False, True),
        3: (True, False),
        4: (False, False),
        5: (False, False),
        6: (True, False),
        7: (True, False),
        8: (True, False),
    }


def test_pages_are_read_once(spark):
    frame = spark.createDataFrame([(1, doc(), CONTENT)], "i INT, raw STRING, reader STRING")
    gated = quality.gate_views(frame).where((F.col("raw") != "") | (F.col("reader") != ""))
    plan = gated._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_sanitize_pdf(values):
    got = values(
        quality.sanitize_pdf, "BINARY", [b"%PDF\xff", doc("404").encode(), doc().encode(), b"text", None]
    )
    assert [bytes(x) for x in got] == [b"%PDF\xff", b"", doc().encode(), b"", b""]
