"""The main text of a page: its blocks, and the best-scoring contiguous run of them.

A page is cut at the tags of block elements. Each block has its tag, its text, the length of the
text and how much of it is link text, all from compiled expressions. One pass over the blocks
of a page then finds the run of the highest total score (as for the largest sum of a subarray):

- a paragraph scores its length, less three times its link text;
- other blocks score the same less a fixed toll, so that menus, cards, captions and buttons count
  against a run;
- text that is nested deeper or less deep than the beginning of its run pays a toll by level;
- no block costs a run more than a small amount, so that a few cards do not end it;
- headings count nothing, and no run begins or ends with one;
- an article's beginning and end break every run, and runs inside articles win over others.

Blocks of negative score inside the best run are left out. A page without any run of positive
score has no main text by this rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.arrays import let
from newsloom.functions.html import TAG_REST

# ---- fixed values: patterns, tags and scores -------------------------------------------
BLOCK_TAG = (
    r"(?is)<(/?)(p|div|section|article|main|ul|ol|li|dl|dt|dd|table|tr|td|th|h[1-6]|blockquote|pre"
    r"|address)(?=[\s/>])" + TAG_REST
)
TAG = r"(?s)</?[A-Za-z!?]" + TAG_REST
WHOLE_LINK = r"(?is)<a\s[^>]*>.*?</a\s*>"
LINK_OPENS = r"(?i)<a\s"
LINK_CLOSES = r"(?i)</a\s*>"
PARAGRAPHS = ["p", "blockquote", "pre"]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
CONTAINERS = ["div", "section", "main", "ul", "ol", "table"]
BREAKS = ["article", "/article"]
LINK_WEIGHT = 3
TOLL = 120
DEPTH_TOLL = 150
MOST_COST = 40
# Signs that no page holds: they stand before and after the name of a block's tag.
BEFORE, AFTER = "\x01", "\x02"
# --------------------------------------------------------------------------------------


def _block(piece: Column) -> Column:
    """Tag, text, length, link text, and whether a link stays open behind or closes first."""
    inner = F.substring_index(piece, AFTER, -1)
    tag = F.lower(F.substring_index(piece, AFTER, 1))

    def measured(inner: Column) -> Column:
        has_link = inner.rlike(r"(?i)</?a[\s>]")
        unlinked = F.when(has_link, F.regexp_replace(inner, WHOLE_LINK, " ")).otherwise(inner)
        text = F.regexp_replace(inner, TAG, " ")
        chars = F.length(F.btrim(text))
        free = F.length(F.btrim(F.regexp_replace(unlinked, TAG, " ")))
        return F.struct(
            tag.alias("tag"),
            text.alias("text"),
            chars.alias("chars"),
            F.when(has_link, F.greatest(chars - free, F.lit(0))).otherwise(0).alias("links"),
            (has_link & unlinked.rlike(LINK_OPENS)).alias("opens"),
            (has_link & unlinked.rlike(LINK_CLOSES)).alias("closes"),
        )

    return let(inner, measured)


def blocks(html: Column) -> Column:
    """The blocks of a page source, in order: array of (tag, text, chars, links, opens, closes);
    the tag is the one before the text, with ``/`` if it closes."""
    marked = F.regexp_replace(html, BLOCK_TAG, f"{BEFORE}$1$2{AFTER}")
    pieces = F.split(F.concat(F.lit(BEFORE + AFTER), marked), BEFORE, -1)
    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), _block)


def _start() -> Column:
    zero, none = F.lit(0), F.array().cast("array<int>")
    run = F.struct(zero.alias("score"), zero.alias("first"), zero.alias("last"),
                   zero.alias("inside"), none.alias("left_out"))
    return F.struct(
        zero.alias("at"),  # blocks seen
        zero.alias("depth"),
        zero.alias("article"),  # open articles
        F.lit(False).alias("link"),  # a link is open
        zero.alias("level"),  # depth at the beginning of the run
        run.alias("run"),
        run.alias("best"),
    )


def _step(state: Column, block: Column) -> Column:
    tag = block["tag"]
    at = state["at"] + 1
    depth = (
        F.when(tag.isin(CONTAINERS), state["depth"] + 1)
        .when(tag.isin([f"/{name}" for name in CONTAINERS]), F.greatest(state["depth"] - 1, F.lit(0)))
        .otherwise(state["depth"])
    )
    article = (
        F.when(tag == "article", state["article"] + 1)
        .when(tag == "/article", F.greatest(state["article"] - 1, F.lit(0)))
        .otherwise(state["article"])
    )
    run = state["run"]
    broken = tag.isin(BREAKS)
    open_run = (run["score"] > 0) & ~broken
    links = F.when(state["link"], block["chars"]).otherwise(block["links"])
    plain = block["chars"] - LINK_WEIGHT * links
    away = F.when(open_run, F.abs(depth - state["level"]) * DEPTH_TOLL).otherwise(0)
    score = (
        F.when((block["chars"] == 0) | tag.isin(HEADINGS), 0)
        .when(tag.isin(PARAGRAPHS), F.greatest(plain - away, F.lit(-MOST_COST)))
        .otherwise(F.greatest(plain - away - TOLL, F.lit(-MOST_COST)))
    )

    def with_score(score: Column) -> Column:
        total = F.when(open_run, run["score"]).otherwise(0) + score
        none = F.array().cast("array<int>")
        kept = F.when(open_run, run["left_out"]).otherwise(none)
        new = F.when(
            total > 0,
            F.struct(
                total.alias("score"),
                F.when(open_run, run["first"]).otherwise(at).alias("first"),
                at.alias("last"),
                F.least(article, F.lit(1)).alias("inside"),
                F.when(open_run & (score < 0), F.concat(kept, F.array(at))).otherwise(kept).alias("left_out"),
            ),
        ).otherwise(_start()["run"])

        def chosen(new: Column) -> Column:
            best = state["best"]
            gains = (score > 0) & (
                (new["inside"] > best["inside"])
                | ((new["inside"] == best["inside"]) & (new["score"] > best["score"]))
            )
            return F.struct(
                at.alias("at"),
                depth.alias("depth"),
                article.alias("article"),
                (block["opens"] | (state["link"] & ~block["closes"])).alias("link"),
                F.when(open_run, state["level"]).otherwise(depth).alias("level"),
                new.alias("run"),
                F.when(gains, new).otherwise(best).alias("best"),
            )

        return let(new, chosen)

    return let(score, with_score)


def best_run(found: Column) -> Column:
    """The run of the highest score: (score, first, last, inside, left_out), numbered from 1; a
    score of 0 means there is none."""
    return F.aggregate(found, _start(), _step, lambda state: state["best"])


def run_text(found: Column, run: Column) -> Column:
    """Text of a run's blocks, those left out excepted; NULL if there is no run."""
    numbers = F.array_except(F.sequence(run["first"], run["last"]), run["left_out"])
    texts = F.transform(numbers, lambda n: F.element_at(found, n)["text"])
    return F.when(run["score"] > 0, F.array_join(texts, " "))


def main_text(html: Column) -> Column:
    """Undecoded main text of a page source without code; NULL if no run of blocks has one."""
    return let(blocks(html), lambda found: let(best_run(found), lambda run: run_text(found, run)))
