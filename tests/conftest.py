import os
import sys

import pytest
from pyspark.sql import SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """Apply a Column function to texts, all in one job, and return the results in order."""

    def run(fn, *texts):
        rows = [(i, *(t if isinstance(t, tuple) else (t,))) for i, t in enumerate(texts)]
        width = len(rows[0]) - 1
        names = [f"c{j}" for j in range(width)]
        df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} string" for n in names))
        # A repartition keeps the optimizer from folding the expression over a local table.
        out = df.repartition(2).select("i", fn(*[F.col(n) for n in names]).alias("o"))
        return [r.o for r in sorted(out.collect(), key=lambda r: r.i)]

    return run
