"""Snapshots, throttle, streams."""

import os
import random

import pytest
from pyspark.sql import functions as F

from pagepress.operators import snapshots, throttle
from pagepress.plans.crawl import crawl_documents, write_crawl
from pagepress.sources.pages import stream_pages, with_errors
from pagepress.streaming.documents import (
    crawl_batch, current_snapshots, document_stream, expire_versions, latest_version, upsert_batch,
)
from pagepress.streaming.throttle import throttle_batch

NOW = 100000


def snaps(spark, *rows):
    return spark.createDataFrame(rows, "url_key string, document string, created_at long")


def test_errors(spark):
    rows = [("u", 200, "text/html"), ("", 200, "text/html"), ("u", 404, "text/html"), ("u", 200, None), ("u", 200, "TEXT/HTML")]
    df = with_errors(spark.createDataFrame(rows, "url string, status int, content_type string"))
    assert [r.error for r in df.collect()] == [
        None, "Missing URL", "HTTP 404", "Unsupported content type: ", "Unsupported content type: TEXT/HTML",
    ]


def test_crawl_rows_end_as_documents_or_errors(spark, tmp_path):
    page = "<html><head><title>T</title></head><body><article><h1>One</h1><p>text</p></article></body></html>"
    rows = [
        (1, "e.com/a", 200, "text/html", page), (2, None, 200, "text/html", page), (3, "e.com/c", 404, "text/html", page),
        (4, "e.com/d", 200, "image/png", page), (5, "e.com/e", 200, "text/html", None), (6, "e.com/f", 200, "text/html", ""),
        (6, "e.com/f", 200, "text/html", ""),
    ]
    crawl = spark.createDataFrame(rows, "page_id long, url string, status int, content_type string, html string")
    write_crawl(crawl_documents(crawl), str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 7
    assert {r.page_id: r.error for r in out.where("failed = 'true'").collect()} == {
        2: "Missing URL", 3: "HTTP 404", 4: "Unsupported content type: image/png", 5: "No page was received",
    }
    good = {r.page_id: r for r in out.where("failed = 'false'").collect()}
    assert set(good) == {1, 6} and "# One" in good[1].document and good[1].url_key == "https://e.com/a"
    assert crawl_documents(crawl.limit(0)).collect() == []
    assert "Exchange" not in crawl_documents(crawl)._jdf.queryExecution().executedPlan().toString()


def test_ttl_edges(spark):
    table = snaps(spark, ("a", "A", NOW - 3599), ("b", "B", NOW - 3600))
    requests = spark.createDataFrame([("a",), ("b",), ("c",)], "url_key string")
    got = {r.url_key: (r.document, r.cache) for r in snapshots.lookup(requests, table, NOW).collect()}
    assert got == {"a": ("A", "HIT"), "b": (None, "MISS"), "c": (None, "MISS")}


def test_upsert_and_stale(spark):
    old = snaps(spark, ("a", "A", 1), ("b", "B", 5))
    new = snaps(spark, ("b", "B2", 5), ("c", "C", 2), ("a", "late", 0))
    got = {tuple(r) for r in snapshots.upsert(old, new).collect()}
    assert got == {("a", "A", 1), ("b", "B2", 5), ("c", "C", 2)}
    pages = spark.createDataFrame(
        [(1, "a"), (2, "b"), (3, "b"), (4, "d")], "page_id long, url_key string"
    ).withColumn("html", F.lit("x"))
    todo = snapshots.stale_pages(pages, snaps(spark, ("a", "A", NOW)), NOW)
    assert sorted(r.page_id for r in todo.collect()) == [3, 4]


def test_upsert_keeps_untouched_rows_off_the_shuffle(spark):
    old = spark.range(1000).selectExpr("string(id) url_key", "'d' document", "id created_at").unionByName(
        snaps(spark, (None, "none", 1))
    )
    new = snaps(spark, ("7", "later", 9), ("8", "late", 3), (None, "newer", 2), ("x", "new", 1))
    merged = snapshots.upsert(old, new)
    got = {r.url_key: (r.document, r.created_at) for r in merged.collect()}
    assert merged.count() == len(got) == 1002
    assert got["7"] == ("later", 9) and got["8"] == ("d", 8) and got[None] == ("newer", 2) and got["x"] == ("new", 1)
    anti = snapshots.upsert(old, new)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in anti and "LeftSemi" in anti


def test_lookup_spreads_a_hot_key(spark):
    requests = spark.range(900).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, None)
        .otherwise(F.col("id").cast("string")).alias("url_key"),
    )
    table = snaps(spark, ("hot", "H", NOW), ("2", "two", NOW), ("5", "old", 1))
    assert len(snapshots.hot_keys(requests, "url_key", 200)) == 2
    assert snapshots.hot_keys(requests, "url_key") == [] and snapshots.hot_keys(requests.limit(0), "url_key", 1) == []
    plain, spread = (
        snapshots.lookup(requests, table, NOW, hot_rows=n).select("id", "url_key", "document", "cache")
        for n in (snapshots.HOT_ROWS, 200)
    )
    assert sorted(plain.collect()) == sorted(spread.collect())
    assert spread.where("cache = 'HIT'").count() == 301
    assert "__salt" in spread._jdf.queryExecution().optimizedPlan().toString()


def test_deltas_between_versions(spark, tmp_path):
    root, columns = str(tmp_path / "snap"), "page_id long, url_key string, document string, created_at long"
    write = upsert_batch(root, merge_every=3)
    batches = [
        [(1, "a", "a0", 10), (2, "b", "b0", 10)], [(3, "a", "a1", 10), (4, "c", "c1", 5)], [(5, "b", "b2", 9)],
        [(6, "c", "c3", 6)], [(7, "d", "d4", 1), (8, "d", "d4 last", 1), (9, "a", "a4 early", 2)],
    ]
    assert current_snapshots(spark, root) is None
    model = {}
    for n, rows in enumerate(batches):
        for _, key, document, created in rows:
            if key not in model or created >= model[key][1]:
                model[key] = (document, created)
        for _ in range(2):  # a batch that is run again changes nothing
            write(spark.createDataFrame(rows, columns), n)
            table = current_snapshots(spark, root).collect()
            assert len(table) == len(model) and {r.url_key: (r.document, r.created_at) for r in table} == model
    assert latest_version(spark, root) == 2


def test_dedup_with_a_hot_key(spark):
    pages = spark.range(3000).select(
        F.col("id").alias("page_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("url_key"),
        (F.col("id") % 10).alias("created_at"),
    )
    kept = snapshots.dedup_pages(pages)
    assert kept.count() == 2001
    assert kept.where("url_key = 'hot'").collect()[0].page_id == 2979
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def model(rows, length):
    state, out = {}, {}
    for rid, key, second in sorted(rows, key=lambda r: (r[2], r[0])):
        start, count = state.get(key, (None, 0))
        if start is None or second - start > length:
            start, count = second, 0
        state[key] = (start, count + 1)
        out[rid] = (start, count + 1)
    return out


def test_anchored_counts_against_the_model(spark):
    rng = random.Random(3)
    # A third of all requests come from one key, and many share a second.
    rows = [
        (i, rng.choice(["hot", *(f"k{j}" for j in range(8)), "hot", "hot", None]), rng.randrange(-500, 4000))
        for i in range(3000)
    ]
    df = spark.createDataFrame(rows, "id long, key string, second long")
    for length, block in ((60, None), (60, 64), (60, 1000), (7, 50), (500, 300)):
        got = {
            r.id: (r.window_start, r.request_count)
            for r in throttle.anchored_counts(df, "key", "second", ["id"], length, block).collect()
        }
        assert got == model(rows, length), (length, block)


def test_window_edges(spark):
    df = spark.createDataFrame([(0, "a", 0), (1, "a", 60), (2, "b", 0), (3, "b", 61)], "id long, key string, second long")
    got = {r.id: r.request_count for r in throttle.throttle_flags(df, "key", "second", ["id"]).collect()}
    assert got == {0: 1, 1: 2, 2: 1, 3: 1}
    df = spark.createDataFrame([(0, "a", 0), (1, "a", 3599), (2, "b", 0), (3, "b", 3600)], "id long, key string, second long")
    got = {r.id: r.cache for r in throttle.cache_hits(df, "key", "second", ["id"]).collect()}
    assert got == {0: "MISS", 1: "HIT", 2: "MISS", 3: "MISS"}


def test_client_key(spark):
    rows = [("x", "y"), (None, " y , z"), (None, None), ("", "y"), (None, "")]
    df = spark.createDataFrame(rows, "h1 string, h2 string")
    got = [r.c for r in df.select(throttle.client_key(F.col("h1"), F.col("h2")).alias("c")).collect()]
    assert got == ["x", "y", "unknown", "", ""]


def run_throttle(spark, tmp_path):
    requests = (
        spark.readStream.schema("request_id long, client string, ts timestamp")
        .option("maxFilesPerTrigger", 4)
        .parquet(str(tmp_path / "in"))
    )
    query = (
        requests.writeStream.foreachBatch(throttle_batch(str(tmp_path / "out")))
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    answers = spark.read.parquet(str(tmp_path / "out" / "answers")).collect()
    return {r.request_id: (r.window_start, r.request_count, r.rejected) for r in answers}


def add_requests(spark, tmp_path, rows):
    spark.createDataFrame(rows, "request_id long, client string, second long").repartition(4).select(
        "request_id", "client", F.timestamp_seconds("second").alias("ts")
    ).write.mode("append").parquet(str(tmp_path / "in"))


def test_throttle_stream_equals_batch(spark, tmp_path):
    """Rows of a trigger are unsorted and in four files; one client has far over 10,000 of them."""
    rng = random.Random(5)
    times = sorted(rng.randrange(0, 1500) for _ in range(36000))
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", "b", None]), t) for i, t in enumerate(times)]
    for part in range(2):
        chunk = rows[part * 18000 : part * 18000 + 18000]
        rng.shuffle(chunk)
        add_requests(spark, tmp_path, chunk)
        got = run_throttle(spark, tmp_path)
    assert got == {k: (s, n, int(n > 10)) for k, (s, n) in model(rows, 60).items()}


def test_throttle_stream_answers_late_rows(spark, tmp_path):
    add_requests(spark, tmp_path, [(1, "a", 5000), (2, "a", 5010)])
    run_throttle(spark, tmp_path)
    add_requests(spark, tmp_path, [(3, "a", 7), (4, "a", 5060), (5, "a", 5061), (6, "b", 7)])
    got = {k: (s, n) for k, (s, n, _) in run_throttle(spark, tmp_path).items()}
    assert got == {1: (5000, 1), 2: (5000, 2), 3: (5000, 3), 4: (5000, 4), 5: (5061, 1), 6: (7, 1)}


def test_throttle_plan(spark):
    """Whole log rows are shuffled once, for the ranks; all other exchanges carry counts."""
    log = spark.range(100).selectExpr("id", "string(id % 3) key", "id second", "repeat('x', 50) body")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = throttle.anchored_counts(log, "key", "second", ["id"], 10)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    lines = [line.lstrip(" :+-") for line in plan.splitlines()]
    assert sum(line.startswith("Exchange hashpartitioning") for line in lines) <= 8, plan
    assert sum(line.startswith("ReusedExchange") for line in lines) >= 1, plan


def test_rows_without_a_second(spark):
    df = spark.createDataFrame([(0, "a", None), (1, "a", 5), (2, None, None)], "id long, key string, second long")
    got = {r.id: r.request_count for r in throttle.anchored_counts(df, "key", "second", ["id"], 60).collect()}
    assert got == {0: None, 1: 1, 2: None}


def test_document_stream_upserts(spark, tmp_path):
    page = "<article><h1>{}</h1></article>"
    for n, rows in enumerate([[(1, "e.com", page.format("one")), (2, "f.com", page.format("two"))], [(3, "http://E.com/", page.format("new"))]]):
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in")
        )
        query = (
            document_stream(stream_pages(spark, str(tmp_path / "in")))
            .writeStream.foreachBatch(upsert_batch(str(tmp_path / "snap"), now=NOW + n))
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        query.awaitTermination(240)
    last = latest_version(spark, str(tmp_path / "snap"))
    table = {r.url_key: (r.created_at, r.document) for r in snapshots.read_version(spark, str(tmp_path / "snap"), last).collect()}
    assert set(table) == {"https://e.com/", "https://f.com/"}
    assert table["https://e.com/"][0] == NOW + 1 and "# new" in table["https://e.com/"][1]
    assert table["https://f.com/"][0] == NOW
    # Running the last batch again gives the same version.
    again = spark.createDataFrame([(3, "https://e.com/", "doc")], "page_id long, url_key string, document string")
    upsert_batch(str(tmp_path / "snap"), now=NOW + 1)(again, last)
    assert latest_version(spark, str(tmp_path / "snap")) == last
    assert snapshots.read_version(spark, str(tmp_path / "snap"), last).count() == 2


def test_crawl_stream_writes_each_response_once(spark, tmp_path):
    schema = "page_id long, url string, status int, content_type string, html string"
    page = "<article><h1>One</h1></article>"
    write, root = crawl_batch(str(tmp_path / "out")), str(tmp_path / "out")
    for rows in [[(1, "e.com/a", 200, "text/html", page), (2, None, 200, "text/html", page)], [(3, "e.com/c", 404, "text/html", page)]]:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = (
            spark.readStream.schema(schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(write)
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        query.awaitTermination(240)
    got = lambda: sorted((r.batch, r.page_id, r.error) for r in spark.read.parquet(root).collect())
    want = [(0, 1, None), (0, 2, "Missing URL"), (1, 3, "HTTP 404")]
    assert got() == want
    write(spark.createDataFrame([(3, "e.com/c", 404, "text/html", page)], schema), 1)
    assert got() == want


def test_expired_versions_leave_what_the_last_batch_needs(spark, tmp_path):
    root = str(tmp_path / "snap")
    assert expire_versions(spark, root) == []
    write = upsert_batch(root, merge_every=2)
    batches = [snaps(spark, (f"k{n % 3}", f"d{n}", n), ("x", f"x{n}", n)).withColumn("page_id", F.lit(n)) for n in range(7)]
    for n, rows in enumerate(batches):
        write(rows, n)
    whole = {tuple(r) for r in current_snapshots(spark, root).collect()}
    assert whole == {("x", "x6", 6), ("k0", "d6", 6), ("k1", "d4", 4), ("k2", "d5", 5)}
    gone = expire_versions(spark, root)
    assert "version=1" in gone and {"delta=0", "delta=2"} <= set(gone)
    assert {tuple(r) for r in current_snapshots(spark, root).collect()} == whole
    write(batches[6], 6)
    write(batches[5], 5)
    assert {tuple(r) for r in current_snapshots(spark, root).collect()} == whole
    assert "version=3" in os.listdir(root) and expire_versions(spark, root) == []
    with pytest.raises(ValueError):
        expire_versions(spark, root, keep=1)
