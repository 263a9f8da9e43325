"""Named queries; importing the modules registers them."""

from newsloom.catalog import (  # noqa: F401
    article_queries,
    capture_queries,
    extraction_queries,
    plan_queries,
    quality_queries,
    state_queries,
    stream_queries,
    text_queries,
    url_queries,
)
from newsloom.catalog.registry import QUERIES, TWINS

__all__ = ["QUERIES", "TWINS"]
