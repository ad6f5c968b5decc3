"""Snapshot table of documents: keyed dedup, lookup with time-to-live, upsert.

Keys can be hot (one URL may have a third of all rows). Every dedup is a ``row_number() = 1``,
for which Spark keeps only the best row per key in each map task before it shuffles, and page
bodies are joined back by ``page_id``, which is unique.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pagepress import config

HOT_ROWS = 1_000_000  # a key with fewer rows is no burden for one task
HOT_SHARE = 1000
SALTS = 200


def latest_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in this order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") == 1).drop("__rank")


def dedup_pages(
    pages: DataFrame, key: str = "url_key", time: str = "created_at", tie: str = "page_id"
) -> DataFrame:
    """Last write per key; only the narrow columns take part in the ranking."""
    winners = latest_per_key(
        pages.select(key, time, tie), key, F.col(time).desc(), F.col(tie).desc()
    ).select(tie)
    return pages.join(winners, tie, "left_semi")


def is_fresh(created_at: Column, now: Column, ttl: int = config.SNAPSHOT_TTL_SECONDS) -> Column:
    return created_at > now - ttl


def fresh(snapshots: DataFrame, now: int, ttl: int = config.SNAPSHOT_TTL_SECONDS) -> DataFrame:
    return snapshots.where(is_fresh(F.col("created_at"), F.lit(now), ttl))


def hot_keys(rows: DataFrame, key: str, least_rows: int = HOT_ROWS) -> list[int]:
    """Hashes of the keys with ``least_rows`` rows or more and over one in ``HOT_SHARE`` of all rows.

    Fewer than ``HOT_SHARE`` keys can have such a part, so the most frequent ones hold them all. Rows are
    counted before they are shuffled.
    """
    counted = rows.groupBy(F.xxhash64(key).alias("h")).agg(F.count("*").alias("n"))
    first = counted.orderBy(F.col("n").desc()).limit(HOT_SHARE).where(F.col("n") >= least_rows).collect()
    total = rows.count() if first else 0
    return sorted(r["h"] for r in first if r["n"] * HOT_SHARE > total)


def lookup(
    requests: DataFrame,
    snapshots: DataFrame,
    now: int,
    ttl: int = config.SNAPSHOT_TTL_SECONDS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Requests with the fresh ``document`` of their key and a ``HIT`` or ``MISS`` label.

    The snapshot table has one row per key, so a hot request key cannot multiply rows. Requests of hot
    keys are spread over ``SALTS`` parts by a hash of the whole row, and the one snapshot row of such a
    key is repeated for each part. Which keys are hot changes the plan only.
    """
    stored = fresh(snapshots, now, ttl).select("url_key", "document", F.lit(True).alias("__hit"))
    hot = hot_keys(requests, "url_key", hot_rows)
    on, asked = ["url_key"], requests
    if hot:
        is_hot, on = F.xxhash64("url_key").isin(hot), ["url_key", "__salt"]
        part = F.pmod(F.xxhash64(*requests.columns), F.lit(SALTS)).cast("int")
        asked = requests.withColumn("__salt", F.when(is_hot, part).otherwise(0))
        last = F.when(is_hot, SALTS - 1).otherwise(0)
        stored = stored.withColumn("__salt", F.explode(F.sequence(F.lit(0), last)))
    return asked.join(stored, on, "left").select(
        *requests.columns, "document", F.when(F.col("__hit"), "HIT").otherwise("MISS").alias("cache")
    )


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """New version of the snapshot table: of equal keys the later write wins, then the new one.

    Rows whose key has no new write are taken over as they are, so they are not shuffled if Spark finds
    the new keys small enough to broadcast.
    """
    columns = ["url_key", "document", "created_at"]
    keys = new.select(F.col("url_key").alias("__key"))
    same = F.col("url_key").eqNullSafe(F.col("__key"))
    both = (
        old.join(keys, same, "left_semi")
        .select(*columns, F.lit(0).alias("__new"))
        .unionByName(new.select(*columns, F.lit(1).alias("__new")))
    )
    winners = latest_per_key(both, "url_key", F.col("created_at").desc(), F.col("__new").desc())
    return old.join(keys, same, "left_anti").select(*columns).unionByName(winners.select(*columns))


def stale_pages(
    pages: DataFrame, snapshots: DataFrame, now: int, ttl: int = config.SNAPSHOT_TTL_SECONDS
) -> DataFrame:
    """Pages whose key has no fresh snapshot, one page (the highest id) per key.

    Ranking and the join with the snapshots run on keys alone. The last join brings the bodies: it
    reads ``html`` of all pages, and shuffles it by ``page_id`` unless the ids left are few enough
    to be broadcast.
    """
    keys = latest_per_key(
        pages.select("url_key", "page_id"), "url_key", F.col("page_id").desc()
    )
    todo = keys.join(fresh(snapshots, now, ttl).select("url_key"), "url_key", "left_anti")
    return pages.join(todo.select("page_id"), "page_id", "left_semi")


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/version={version}")


def write_version(snapshots: DataFrame, root: str, version: int, kind: str = "version") -> None:
    """A version is written once and never changed; repeating a failed run replaces it."""
    snapshots.write.mode("overwrite").parquet(f"{root}/{kind}={version}")


def read_deltas(spark: SparkSession, root: str, numbers: list[int]) -> DataFrame:
    """Of each key the latest of these deltas' writes; of equal times the one of the later delta."""
    parts = [
        spark.read.parquet(f"{root}/delta={n}").withColumn("__delta", F.lit(n)) for n in numbers
    ]
    order = (F.col("created_at").desc(), F.col("__delta").desc())
    return latest_per_key(reduce(DataFrame.unionByName, parts), "url_key", *order).drop("__delta")
