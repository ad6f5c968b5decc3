"""Crawl table to documents: one narrow pass, no shuffle.

Every step works inside the row of its page, so the plan is scan and projections only: it
scales with the number of input splits, no key can be hot, and a lost task redoes one split.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from pagepress import config
from pagepress.functions.cleaners import clean_markdown
from pagepress.functions.content import with_main_content
from pagepress.functions.elements import absolutize_links, strip_elements, stripper
from pagepress.functions.flight import flight_html
from pagepress.functions.formatting import (
    cap_words, document_body, format_document, metadata_header,
)
from pagepress.functions.markdown import with_markdown
from pagepress.functions.metadata import with_metadata
from pagepress.functions.text import column_of, memo, word_count
from pagepress.functions.urls import normalize_url


def html_to_markdown(
    df: DataFrame, html: str, out: str = "markdown", max_alt_text: int | None = None
) -> DataFrame:
    """Render an HTML column and run all cleaners."""
    # One working name for every caller, so that the expressions are put together only once.
    df = clean_markdown(with_markdown(df, html, "__md"), "__md", max_alt_text)
    return df.withColumn(out, F.col("__md")).drop("__md")


@memo
def _fallback_input(html: str, md: str, min_words: int, min_heading: int, min_body: int) -> Column:
    return F.when(
        word_count(F.col(md)) < min_words,
        F.nullif(flight_html(F.col(html), min_heading, min_body), F.lit("")),
    )


def with_sparse_fallback(
    df: DataFrame,
    html: str = "html",
    md: str = "markdown",
    min_words: int = config.MIN_WORDS,
    min_heading: int = 1,
    min_body: int = 1,
) -> DataFrame:
    """Replace a short result by the markdown of the page's flight data, if it has any.

    The page's own result stays beside it as ``page_`` and the column's name. Flight texts of any
    length count unless a least length is given.

    The fallback input is NULL for all other pages, and every step passes NULL through, so
    the second rendering costs next to nothing for them.
    """
    df = df.withColumn(f"page_{md}", F.col(md))
    df = df.withColumn("__flight", _fallback_input(html, md, min_words, min_heading, min_body))
    df = html_to_markdown(df, "__flight", "__flight_md")
    return df.withColumn(md, F.coalesce(F.col("__flight_md"), F.col(md))).drop(
        "__flight", "__flight_md"
    )


def extract(
    df: DataFrame,
    url: str = "url_key",
    html: str = "html",
    max_html_chars: int | None = None,
    max_words: int | None = None,
    max_alt_text: int | None = None,
    min_words: int | None = None,
    min_heading: int = 1,
    min_body: int = 1,
    exclude: Iterable[str] | None = None,
) -> DataFrame:
    """Add ``title, description, metadata, markdown, page_markdown`` to pages with a normalized URL.

    Pages, texts and alt texts are kept whole unless a limit is given. ``markdown`` is the flight
    text of a page of fewer than ``min_words`` words that has any (by default never); ``page_markdown``
    is the text of the page itself in any case. ``exclude`` lists selectors of elements that are not
    content, instead of those in ``config``.
    """
    df = with_metadata(df, html, url)
    df = with_main_content(df, html, "__content", max_html_chars)
    strip = strip_elements if exclude is None else stripper(tuple(exclude))
    df = df.withColumn("__content", column_of(strip, "__content"))
    df = df.withColumn("__content", column_of(absolutize_links, "__content", url))
    df = html_to_markdown(df, "__content", max_alt_text=max_alt_text).drop("__content")
    if min_words is not None:
        df = with_sparse_fallback(df, html, "markdown", min_words, min_heading, min_body)
    else:
        df = df.withColumn("page_markdown", F.col("markdown"))
    return df if max_words is None else df.withColumn("markdown", cap_words(F.col("markdown"), max_words))


@memo
def _document(url: str) -> Column:
    header = metadata_header(F.col(url), F.col("title"), F.col("description"), F.col("metadata"))
    return format_document(header, F.col("__body"))


def format_rows(df: DataFrame, url: str = "url_key") -> DataFrame:
    """Add ``document``: metadata header, word count and body."""
    df = df.withColumn("__body", document_body(F.col("markdown")))
    return df.withColumn("document", _document(url)).drop("__body")


def page_documents(pages: DataFrame, **options) -> DataFrame:
    """``page_id, url, html`` in; ``page_id, url_key, title, description, metadata, markdown,
    page_markdown, document`` out. ``options`` are those of :func:`extract`; by default nothing is cut."""
    keyed = pages.select("page_id", column_of(normalize_url, "url").alias("url_key"), "html")
    return format_rows(extract(keyed, **options)).drop("html")
