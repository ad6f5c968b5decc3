"""Crawl stream to documents and error rows, and a snapshot table kept up to date by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagepress.operators.snapshots import latest_per_key, read_deltas, read_version, upsert, write_version
from pagepress.plans.crawl import crawl_documents, write_crawl
from pagepress.plans.documents import page_documents


def document_stream(pages: DataFrame) -> DataFrame:
    """Rendering is stateless and row by row, so the batch plan is the streaming plan."""
    return page_documents(pages)


def crawl_batch(root: str, **options):
    """A ``foreachBatch`` function that writes the documents and the error rows of a batch of responses.

    Batch ``n`` has the folder ``batch=n``, in which one job writes both; running it again replaces what
    it wrote, so every response has one row however often a batch is repeated. Reading ``root`` gives
    ``batch`` and ``failed`` as columns that prune. ``options`` are those of ``extract``.
    """

    def run(responses: DataFrame, batch: int) -> None:
        write_crawl(crawl_documents(responses, **options), f"{root}/batch={batch}", "overwrite")

    return run


def _written(spark: SparkSession, root: str, kind: str) -> list[int]:
    """Numbers of the completely written versions or deltas, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    numbers = []
    for entry in fs.listStatus(path) if fs.exists(path) else []:
        name = entry.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
        if name.startswith(f"{kind}=") and fs.exists(done):
            numbers.append(int(name.split("=")[1]))
    return sorted(numbers)


def latest_version(spark: SparkSession, root: str, before: int | None = None) -> int:
    """Highest completely written version (below ``before``, if given); -1 if there is none."""
    return max((v for v in _written(spark, root, "version") if before is None or v < before), default=-1)


def current_snapshots(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """The snapshot table as of all batches (below ``before``, if given); None if there is none.

    That is the last version with the deltas after it. Keys without a delta are read as they are.
    """
    base = latest_version(spark, root, before)
    later = [n for n in _written(spark, root, "delta") if n > base and (before is None or n < before)]
    if not later:
        return None if base < 0 else read_version(spark, root, base)
    recent = read_deltas(spark, root, later)
    return recent if base < 0 else upsert(read_version(spark, root, base), recent)


def upsert_batch(root: str, now: int | None = None, merge_every: int = 1):
    """A ``foreachBatch`` function that writes batch ``n`` of documents to the table.

    Every ``merge_every``-th batch writes the whole table as version ``n``; those between write their
    own rows only, as delta ``n``, so a batch costs what it brings. Both are built from what batches
    before ``n`` left, so a batch that is run again after a failure writes the same once more. What is
    not read any more is deleted by :func:`expire_versions`.
    """

    def run(documents: DataFrame, batch: int) -> None:
        spark = documents.sparkSession
        created = F.col("created_at") if "created_at" in documents.columns else F.lit(now)
        new = latest_per_key(
            documents.select(
                "url_key", "document", created.cast("long").alias("created_at"), "page_id"
            ),
            "url_key",
            F.col("created_at").desc(),
            F.col("page_id").desc(),
        ).drop("page_id")
        if (batch + 1) % merge_every:
            write_version(new, root, batch, "delta")
            return
        if current_snapshots(spark, root, before=batch) is None:
            write_version(new, root, batch)
            return
        # The new documents are read three times below: written first, they are rendered once.
        write_version(new, root, batch, "delta")
        new = read_deltas(spark, root, [batch])
        write_version(upsert(current_snapshots(spark, root, before=batch), new), root, batch)

    return run


def expire_versions(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete all but the last ``keep`` versions, and the deltas that these hold; names what it deleted.

    At least two versions stay, as the last batch may be run again and is then built from the one before.
    Only folders that were completely written count and go. Readers of an older version lose it, so
    ``keep`` has to cover the longest of them.
    """
    if keep < 2:
        raise ValueError("the last batch may be run again, so at least two versions have to stay")
    versions = _written(spark, root, "version")
    if len(versions) <= keep:
        return []
    oldest = versions[-keep]
    gone = [f"version={n}" for n in versions if n < oldest]
    gone += [f"delta={n}" for n in _written(spark, root, "delta") if n <= oldest]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone
