"""The composed job: crawl responses in, a document or an error for each row out.

Like the documents themselves this is one narrow pass without a shuffle, and both outcomes are
written by one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagepress.plans.documents import extract, format_rows
from pagepress.functions.text import column_of
from pagepress.functions.urls import normalize_url
from pagepress.sources.pages import with_errors

NO_BODY = "No page was received"
UNREADABLE = "The page could not be read"


def crawl_documents(crawl: DataFrame, **options) -> DataFrame:
    """``page_id, url, status, content_type, html`` in; the columns of documents and ``error`` out.

    Every input row comes out once. A row has either a ``document`` or an ``error``: a missing URL, a
    bad response, a missing body, or a page that gives no document. Nothing is extracted from rows
    that have an error already. ``options`` are those of ``extract``.
    """
    rows = with_errors(crawl).withColumn(
        "error", F.coalesce(F.col("error"), F.when(F.col("html").isNull(), NO_BODY))
    )
    good = F.col("error").isNull()
    keyed = rows.select(
        "page_id",
        F.col("url").alias("crawl_url"),
        F.when(good, F.col("url")).alias("url"),
        F.when(good, F.col("html")).alias("html"),
        "error",
    ).withColumn("url_key", column_of(normalize_url, "url"))
    done = format_rows(extract(keyed, **options)).withColumn("document", F.when(good, F.col("document")))
    return done.select(
        "page_id", F.col("crawl_url").alias("url"), "url_key",
        *(F.when(good, F.col(c)).alias(c) for c in ("title", "description", "metadata", "markdown", "page_markdown")),
        "document",
        F.coalesce(F.col("error"), F.when(F.col("document").isNull(), UNREADABLE)).alias("error"),
    )


def write_crawl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One job for both sinks: documents under ``failed=false``, error rows under ``failed=true``."""
    rows.withColumn("failed", F.col("error").isNotNull()).write.mode(mode).partitionBy("failed").parquet(path)
