"""The shape of the plans that matter at scale."""

from pyspark.sql import functions as F

from catalog.queries import QUERIES
from pagepress.functions.urls import normalize_url
from pagepress.operators import snapshots
from pagepress.plans.documents import page_documents
from pagepress.sources.pages import scan_pages

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_need_no_shuffle(spark):
    text = plan(page_documents(scan_pages(spark, f"{SF}/pages.parquet")))
    for node in ("Exchange", "Join", "Python", "Sort"):
        assert node not in text


def test_url_jobs_do_not_read_html(spark):
    pages = scan_pages(spark, f"{SF}/pages.parquet")
    text = plan(pages.select("page_id", normalize_url(F.col("url")).alias("url_key")))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in text


def test_filters_reach_the_scan(spark):
    df = snapshots.fresh(
        spark.read.parquet(f"{SF}/pages.parquet").withColumnRenamed("page_id", "created_at"), 5000
    )
    assert "GreaterThan(page_id,1400)" in plan(df).replace("created_at", "page_id")


def test_no_query_uses_cross_joins(spark):
    for name in ("incremental_documents", "snapshot_lookup", "throttle_flags", "exclude_rules", "dedup_pages"):
        text = plan(QUERIES[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_own_text_stays_beside_the_fallback(spark):
    html = '<article><h1>own</h1></article><script>self.__next_f.push([1,"{\\"children\\":\\"short\\"}"])</script>'
    df = spark.createDataFrame([(1, "e.com", html)], "page_id long, url string, html string")
    row = page_documents(df, min_words=50).collect()[0]
    assert row.page_markdown == "# own" and row.markdown == "short"
    assert page_documents(df).collect()[0].markdown == "# own"
