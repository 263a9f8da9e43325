"""The one Python function of the engine: a single pass over a simplified page.

Reader views need nesting ("everything inside this element"), which expressions cannot
tell, so their fields come from an Arrow UDF over the standard library's tokenizer.
Spark partitions the pages and bounds the batches by bytes.
"""

from __future__ import annotations

import ctypes
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom import fixed_values as fv

_TEXTS_AND_FLAGS = [
    ("reader_title", T.StringType(), pa.string()),
    ("reader_body", T.StringType(), pa.string()),
    ("reader_time", T.StringType(), pa.string()),
    ("reader_credits", T.StringType(), pa.string()),
    ("reader_image", T.StringType(), pa.string()),
    ("has_content", T.BooleanType(), pa.bool_()),
    ("content_text", T.StringType(), pa.string()),
    ("has_link_box", T.BooleanType(), pa.bool_()),
    ("first_link", T.StringType(), pa.string()),
    ("error", T.StringType(), pa.string()),
]
FIELDS = T.StructType([T.StructField(name, kind) for name, kind, _ in _TEXTS_AND_FLAGS])
_ARROW_TYPE = pa.struct([(name, kind) for name, _, kind in _TEXTS_AND_FLAGS])
_NO_END_TAG = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_NOT_TEXT = frozenset(["script", "style", "template"])
# After so many characters of pages their fields are handed over to Arrow.
SLICE_CHARS = 1 << 20


class _Region:
    """An element of interest: open from its start tag until the stack falls below it."""

    def __init__(self):
        self.depth = None
        self.done = False
        self.text = []

    @property
    def is_open(self):
        return self.depth is not None and not self.done

    @property
    def found(self):
        return self.depth is not None

    def value(self):
        return "".join(self.text) if self.found else None


class _ReaderPage(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = []
        self.open_tags = Counter()
        self.title, self.body, self.credits = _Region(), _Region(), _Region()
        self.content, self.link_box = _Region(), _Region()
        self.regions = [self.title, self.body, self.credits, self.content, self.link_box]
        self.time = self.image = self.link = None
        self.saw_time = self.saw_image = self.saw_link = False

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        classes = (values.get("class") or "").split()
        whole = " ".join(classes)
        wanted = [
            (self.title, fv.READER_TITLE_CLASS in classes),
            (self.body, whole == fv.READER_BODY_CLASS),
            (self.credits, whole == fv.READER_CREDITS_CLASS),
            (self.content, tag == "div" and fv.READER_CONTENT_CLASS in classes),
            (self.link_box, fv.READER_CONTENT_CLASS in classes),
        ]
        if tag == "time" and self.body.is_open and not self.saw_time:
            self.saw_time, self.time = True, values.get("datetime")
        if tag == "img" and self.body.is_open and not self.saw_image:
            self.saw_image, self.image = True, values.get("src")
        if tag == "a" and self.link_box.is_open and not self.saw_link:
            self.saw_link, self.link = True, values.get("href")
        for region, matches in wanted:
            if matches and not region.found:
                region.depth = len(self.stack)
                region.done = tag in _NO_END_TAG
        if tag not in _NO_END_TAG:
            self.stack.append(tag)
            self.open_tags[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _NO_END_TAG:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.open_tags[tag]:
            return
        closed = None
        while closed != tag:
            closed = self.stack.pop()
            self.open_tags[closed] -= 1
        for region in self.regions:
            if region.is_open and len(self.stack) <= region.depth:
                region.done = True

    def handle_data(self, data):
        if any(self.open_tags[tag] for tag in _NOT_TEXT):
            return
        for region in self.regions:
            if region.is_open:
                region.text.append(data)


def read_page(html: str | None) -> dict | None:
    """Fields of one page; a page that cannot be read yields only ``error``."""
    if html is None:
        return None
    page = _ReaderPage()
    try:
        page.feed(html)
        page.close()
    except Exception as problem:
        return {"error": f"{type(problem).__name__}: {problem}"}
    if page.link_box.found:
        link = page.link if page.saw_link else ""
    else:
        link = None
    return {
        "reader_title": page.title.value(),
        "reader_body": page.body.value(),
        "reader_time": page.time,
        "reader_credits": page.credits.value(),
        "reader_image": page.image,
        "has_content": page.content.found,
        "content_text": page.content.value(),
        "has_link_box": page.link_box.found,
        "first_link": link,
    }


def _give_back() -> None:
    """Return what Arrow and the C library hold but do not use to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def _read_pages(pages: pa.Array) -> pa.Array:
    """Fields of a batch of pages, slice by slice: only the texts of one slice are Python's own at a
    time. Pages that come again in a slice are read once."""
    done, rows, read, held = [], [], {}, 0
    for page in pages:
        html = page.as_py()
        if html not in read:
            read[html] = read_page(html)
            held += len(html or "")
        rows.append(read[html])
        if held >= SLICE_CHARS:
            done.append(pa.array(rows, type=_ARROW_TYPE))
            rows, read, held = [], {}, 0
    done.append(pa.array(rows, type=_ARROW_TYPE))
    fields = pa.concat_arrays(done)
    del done, rows, read
    _give_back()
    return fields


# The function is deterministic.  Saying otherwise keeps filters on its results above it;
# pushed below, they would read every page a second time.
html_fields = F.arrow_udf(_read_pages, FIELDS).asNondeterministic()
