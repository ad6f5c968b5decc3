"""The throttle as a stream: each micro-batch is answered by the batch plan, from the windows left open.

Rows of a trigger may come in any order and partitions; they are counted per (key, second) first, so
a hot client is spread like in the batch plan. What is carried is one window and its count for each
client. Every request gets an answer: a late one counts in the window that is open when it comes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from pagepress import config
from pagepress.operators.snapshots import read_version, write_version
from pagepress.operators.throttle import OPEN_SCHEMA, continue_windows, throttle_decision
from pagepress.streaming.documents import latest_version


def throttle_batch(
    root: str,
    limit: int = config.THROTTLE_LIMIT,
    window: int = config.THROTTLE_WINDOW_SECONDS,
    keep_seconds: int = 86400,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over ``request_id, client, ts``.

    Batch ``n`` writes its answers as ``root/answers/version=n`` and then the open windows as
    ``root/open/version=n``, built from those of the batch before; a batch that is run again after
    a failure starts from the same windows and replaces its own answers.
    """

    def run(requests: DataFrame, batch: int) -> None:
        spark = requests.sparkSession
        log = requests.select(
            "request_id", "client", F.unix_seconds(F.col("ts").cast("timestamp")).alias("second")
        )
        base = latest_version(spark, f"{root}/open", before=batch)
        before = (
            spark.createDataFrame([], OPEN_SCHEMA) if base < 0 else read_version(spark, f"{root}/open", base)
        )
        counted, still_open = continue_windows(
            log, before, "client", "second", ["request_id"], window, keep_seconds
        )
        rejected, retry_after = throttle_decision(F.col("request_count"), limit, window)
        answers = counted.withColumns({"rejected": rejected, "retry_after": retry_after})
        write_version(answers, f"{root}/answers", batch)
        write_version(still_open, f"{root}/open", batch)

    return run
