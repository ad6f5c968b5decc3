"""Crawl-table sources, row filters and the document sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagepress import config

PAGE_SCHEMA = "page_id bigint, url string, html string"


def scan_pages(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Batch scan of a crawl table; unused columns are never read.

    Rows stay where the scan reads them unless the caller asks for a number of partitions, as for
    a table in few large row groups, since rendering a page costs far more than moving it once.
    """
    pages = spark.read.parquet(path).select("page_id", "url", "html")
    return pages if partitions is None else pages.repartition(partitions)


def stream_pages(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return (
        spark.readStream.schema(PAGE_SCHEMA)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )


def fetch_error(status: Column, content_type: Column) -> Column:
    """Why a crawl row is no document, NULL when it is one."""
    kind = F.coalesce(content_type, F.lit(""))
    return F.when(
        ~F.coalesce(status, F.lit(0)).between(200, 299),
        F.concat(F.lit("HTTP "), F.coalesce(status, F.lit(0)).cast("string")),
    ).when(
        ~kind.rlike("|".join(config.ACCEPTED_CONTENT_TYPES)),
        F.concat(F.lit("Unsupported content type: "), kind),
    )


def url_error(url: Column) -> Column:
    return F.when(F.length(F.coalesce(url, F.lit(""))) == 0, "Missing URL")


def with_errors(df: DataFrame) -> DataFrame:
    """Add a nullable ``error`` column; a missing URL comes before a bad response."""
    return df.withColumn(
        "error",
        F.coalesce(url_error(F.col("url")), fetch_error(F.col("status"), F.col("content_type"))),
    )


def accepted(df: DataFrame) -> DataFrame:
    return df.where(fetch_error(F.col("status"), F.col("content_type")).isNull())


def write_documents(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    documents.write.mode(mode).parquet(path)
