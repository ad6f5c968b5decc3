"""Anchored windows over a request log: throttle counts and cache hits over time.

The first request of a key opens a window; requests up to ``length`` seconds later belong to
it; the next one opens a new window. Each window depends on the one before, so a key is a chain
and the plain solution sends a key to one task. Here the work is split so that no step ever
holds more than one time block of one key:

1. count rows per (key, second), with map-side combine;
2. per (key, block): where would a chain that enters here leave the block? A chain can only
   enter at one of the seconds within ``length`` of the block start, or at the first second
   behind them, so this is a short table;
3. per key: walk these tables in block order, which gives each block's entry;
4. per (key, block): mark the windows from the known entry;
5. join back on (key, second).

A block covers a fixed stretch of time, so its size is bounded by its number of seconds, however
many requests a key has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pagepress import config
from pagepress.functions.text import trim

BLOCK_SECONDS = 86400  # bounds the arrays of a block, whatever the window's length
_KEYS = ["__null", "__key"]
_KEY_SCHEMA = "__null boolean, __key string"


def client_key(first: Column, second: Column) -> Column:
    """First header, else the first comma part of the second, trimmed, else ``unknown``."""
    return F.coalesce(first, trim(F.get(F.split(second, ","), F.lit(0))), F.lit("unknown"))


def without_exempt(log: DataFrame, path: str = "path") -> DataFrame:
    return log.where(~F.coalesce(F.col(path).isin("/", "/ok"), F.lit(False)))


def _chain_exits(seconds: np.ndarray, length: int) -> np.ndarray:
    """For every second, the last window start of a chain that starts there."""
    n = len(seconds)
    jump = np.searchsorted(seconds, seconds + length, side="right")
    last = np.where(jump >= n, np.arange(n), jump)
    for _ in range(max(1, int(n).bit_length())):
        nxt = last[last]
        if np.array_equal(nxt, last):
            break
        last = nxt
    return seconds[last]


def _exit_tables(length: int, block: int):
    def run(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in groups:
            entries, exits = [], []
            for number, seconds in zip(pdf["__block"], pdf["seconds"]):
                s = np.asarray(seconds, dtype="int64")
                # Entries: the seconds a running window can reach into, and the next one.
                reach = np.searchsorted(s, number * block + length, side="left") + 1
                entries.append(s[:reach])
                exits.append(_chain_exits(s, length)[:reach])
            yield pd.DataFrame(
                {
                    "__null": pdf["__null"],
                    "__key": pdf["__key"],
                    "__block": pdf["__block"],
                    "entries": entries,
                    "exits": exits,
                }
            )

    return run


def _window_starts(length: int):
    def run(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in groups:
            starts_all = []
            for entry, seconds in zip(pdf["entry"], pdf["seconds"]):
                s = np.asarray(seconds, dtype="int64")
                starts = np.empty(len(s), dtype="int64")
                i, current = 0, None if pd.isna(entry) else int(entry)
                while i < len(s):
                    if current is None or s[i] - current > length:
                        current = int(s[i])
                    j = int(np.searchsorted(s, current + length, side="right"))
                    starts[i:j] = current
                    i = j
                starts_all.append(starts)
            yield pd.DataFrame(
                {
                    "__null": pdf["__null"],
                    "__key": pdf["__key"],
                    "seconds": pdf["seconds"],
                    "starts": starts_all,
                }
            )

    return run


def _keyed(log: DataFrame, key: str, second: str) -> DataFrame:
    """The log with ``_KEYS``, which are never null, so that plain equality joins them everywhere.

    All steps then agree on one hash partitioning of (key, second). Keys are texts or integers.
    """
    return log.withColumns(
        {
            "__null": F.col(key).isNull(),
            "__key": F.coalesce(F.col(key).cast("string"), F.lit("")),
            "__second": F.col(second).cast("long"),
        }
    )


def _chained(per_second: DataFrame, length: int, block: int) -> DataFrame:
    """``_KEYS, __second, window_start`` of chains that start with the first second of each key."""
    # Never null, lest a filter on it keeps the two uses of the blocks from sharing one shuffle.
    number = F.coalesce(F.floor(F.col("__second") / block), F.lit(0).cast("long"))
    blocks = (
        per_second.withColumn("__block", number)
        .groupBy(*_KEYS, "__block")
        .agg(F.array_sort(F.collect_list("__second")).alias("seconds"))
    )
    tables = blocks.mapInPandas(
        _exit_tables(length, block),
        f"{_KEY_SCHEMA}, __block bigint, entries array<bigint>, exits array<bigint>",
    )

    def walk(acc: Column, b: Column) -> Column:
        # The first second of the block that the running window does not cover enters it.
        at = F.when(acc["last"].isNull(), F.lit(1)).otherwise(
            F.size(F.filter(b["entries"], lambda e: e - acc["last"] <= length)) + 1
        )
        last = F.coalesce(F.try_element_at(b["exits"], at), acc["last"])
        return F.struct(
            last.alias("last"),
            F.concat(
                acc["out"],
                F.array(F.struct(b["__block"].alias("__block"), acc["last"].alias("entry"))),
            ).alias("out"),
        )

    start = F.struct(
        F.lit(None).cast("bigint").alias("last"),
        F.array().cast("array<struct<__block:bigint,entry:bigint>>").alias("out"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("__block", "entries", "exits")))
    entries = (
        tables.groupBy(*_KEYS)
        .agg(F.aggregate(ordered, start, walk)["out"].alias("out"))
        .select(*_KEYS, F.inline("out"))
    )
    marked = blocks.join(entries, [*_KEYS, "__block"]).select(*_KEYS, "seconds", "entry").mapInPandas(
        _window_starts(length), f"{_KEY_SCHEMA}, seconds array<bigint>, starts array<bigint>"
    )
    return marked.select(*_KEYS, F.inline(F.arrays_zip("seconds", "starts"))).select(
        *_KEYS, F.col("seconds").alias("__second"), F.col("starts").alias("window_start")
    )


def _windows(
    keyed: DataFrame, length: int, block_seconds: int | None, open_windows: DataFrame | None
) -> DataFrame:
    """``_KEYS, __second, window_start, n, before`` of a keyed log."""
    per_second = (
        keyed.where(F.col("__second").isNotNull())
        .groupBy(*_KEYS, "__second")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    block = block_seconds or BLOCK_SECONDS
    if open_windows is None:
        counted = per_second.join(_chained(per_second, length, block), [*_KEYS, "__second"])
        counted = counted.withColumn("__carried", F.lit(0).cast("long"))
    else:
        # Seconds up to the end of the open window belong to it, late ones too; the rest are new chains.
        met = per_second.join(open_windows, _KEYS, "left")
        inside = F.coalesce(F.col("__second") <= F.col("__open") + length, F.lit(False))
        free = met.where(~inside).select(*_KEYS, "__second", "n")
        counted = (
            free.join(_chained(free, length, block), [*_KEYS, "__second"])
            .withColumn("__carried", F.lit(0).cast("long"))
            .unionByName(
                met.where(inside).select(
                    *_KEYS, "__second", "n", F.col("__open").alias("window_start"), "__carried"
                )
            )
        )
    in_window = Window.partitionBy(*_KEYS, "window_start").orderBy("__second")
    before = F.sum("n").over(in_window) - F.col("n") + F.col("__carried")
    return counted.withColumn("before", before).select(
        *_KEYS, "__second", "window_start", "n", "before"
    )


def anchored_windows(
    log: DataFrame, key: str, second: str, length: int, block_seconds: int | None = None
) -> DataFrame:
    """``key, second, window_start, n, before`` per distinct second of a key.

    ``n`` is the number of rows of that second and ``before`` the number of earlier rows in the
    same window. Rows without a second are in no window.
    """
    own = F.when(~F.col("__null"), F.col("__key")).cast(log.schema[key].dataType)
    return _windows(_keyed(log, key, second), length, block_seconds, None).select(
        own.alias(key), F.col("__second").alias(second), "window_start", "n", "before"
    )


def _numbered(keyed: DataFrame, windows: DataFrame, order: list[str]) -> DataFrame:
    """Every row with its ``window_start`` and running ``request_count``."""
    rank = F.row_number().over(Window.partitionBy(*_KEYS, "__second").orderBy(*order))
    return (
        keyed.withColumn("__rank", rank)
        .join(windows.drop("n"), [*_KEYS, "__second"], "left")
        .withColumn("request_count", F.col("before") + F.col("__rank"))
        .drop(*_KEYS, "__second", "__rank", "before")
    )


def anchored_counts(
    log: DataFrame, key: str, second: str, order: list[str], length: int,
    block_seconds: int | None = None,
) -> DataFrame:
    """Every log row with its ``window_start`` and its running ``request_count``.

    Rows of one second are numbered in ``order``; only (key, second) groups are sorted, so a
    hot key spreads over as many groups as it has seconds. Whole log rows are shuffled once. A row
    without a second keeps nulls in both columns.
    """
    keyed = _keyed(log, key, second)
    return _numbered(keyed, _windows(keyed, length, block_seconds, None), order)


OPEN_SCHEMA = f"{_KEY_SCHEMA}, __open bigint, __carried bigint"


def continue_windows(
    log: DataFrame, open_windows: DataFrame, key: str, second: str, order: list[str], length: int,
    keep_seconds: int,
) -> tuple[DataFrame, DataFrame]:
    """Counts of a further piece of a log, and the open windows behind it.

    ``open_windows`` (``OPEN_SCHEMA``) holds the last window and its count, a row for each key. A
    row that comes late counts in the window that is open now, as it would on arrival. Windows that
    closed more than ``keep_seconds`` before the latest second of the piece are forgotten.
    """
    keyed = _keyed(log, key, second)
    windows = _windows(keyed, length, None, open_windows)
    last = windows.select(*_KEYS, F.col("window_start").alias("__open"), (F.col("before") + F.col("n")).alias("__carried"))
    latest = windows.agg(F.max("__second").alias("__latest"))
    kept = (
        last.unionByName(open_windows)
        .groupBy(*_KEYS)
        .agg(F.max(F.struct("__open", "__carried")).alias("w"))
        .select(*_KEYS, "w.*")
        .join(F.broadcast(latest))  # one row
        .where(F.coalesce(F.col("__open") + length + keep_seconds >= F.col("__latest"), F.lit(True)))
        .drop("__latest")
    )
    return _numbered(keyed, windows, order), kept


def throttle_decision(
    count: Column,
    limit: int = config.THROTTLE_LIMIT,
    window: int = config.THROTTLE_WINDOW_SECONDS,
) -> tuple[Column, Column]:
    """``(rejected, retry_after)`` for a running count."""
    rejected = (count > limit).cast("int")
    return rejected, F.when(count > limit, F.lit(window)).cast("long")


def throttle_flags(
    log: DataFrame, key: str, second: str, order: list[str],
    limit: int = config.THROTTLE_LIMIT,
    window: int = config.THROTTLE_WINDOW_SECONDS,
) -> DataFrame:
    counted = anchored_counts(log, key, second, order, window)
    rejected, retry_after = throttle_decision(F.col("request_count"), limit, window)
    return counted.withColumns({"rejected": rejected, "retry_after": retry_after})


def cache_hits(
    log: DataFrame, key: str, second: str, order: list[str], ttl: int = config.SNAPSHOT_TTL_SECONDS
) -> DataFrame:
    """Label each request: the first of an anchored window is a miss, the others hit.

    An entry is stale at age ``ttl``, a window lasts to its length inclusive: one second less.
    """
    counted = anchored_counts(log, key, second, order, ttl - 1)
    return counted.withColumn(
        "cache", F.when(F.col("request_count") == 1, "MISS").otherwise("HIT")
    )
