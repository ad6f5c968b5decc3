"""One query per operator. Each takes ``(spark, sf_dir)`` and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalog import derived as inputs
from catalog.derived import table
from pagepress import config
from pagepress.functions import cleaners as clean
from pagepress.functions import content, elements, flight, formatting, metadata
from pagepress.functions.markdown import fenced_code, inline_code, with_markdown
from pagepress.functions.text import column_of, trim, word_count
from pagepress.functions.urls import normalize_url, split_url, with_scheme
from pagepress.operators import snapshots, throttle
from pagepress.plans import crawl as crawl_jobs, documents as plans
from pagepress.sources.pages import accepted, scan_pages, url_error, with_errors

Query = Callable[[SparkSession, str], DataFrame]

NOW = 1704082200  # fixed clock: snapshots of pages above id 190 are fresh
EVENT_WINDOW = 21600
HTML_CAP = 1000
WORD_CAP = 100
FALLBACK = {
    "min_words": config.MIN_WORDS, "min_heading": config.FLIGHT_MIN_HEADING, "min_body": config.FLIGHT_MIN_BODY,
}


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_pages(spark, f"{sf_dir}/pages.parquet", spark.sparkContext.defaultParallelism)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input; the ones with whole texts or pages are dealt out like the page table."""
    df = inputs.derived(spark, sf_dir, name)
    return df.repartition(spark.sparkContext.defaultParallelism) if name in ("d_md", "d_flight", "d_rich", "d_html") else df


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).withColumn("url_key", column_of(normalize_url, "url"))


def _column(name: str, out: str, fn: Callable[[Column], Column], source: str, key: str = "k") -> Query:
    """Query that applies one Column function to a derived input."""
    return lambda spark, sf: derived(spark, sf, source).select(key, column_of(fn, name).alias(out))


def _page_column(out: str, fn: Callable[[Column], Column]) -> Query:
    return lambda spark, sf: _pages(spark, sf).select("page_id", column_of(fn, "html").alias(out))


def _head(c: str = "html") -> Column:
    return metadata.head_slice(F.col(c))


def _flight_document(html: Column) -> Column:
    return flight.flight_html(html, config.FLIGHT_MIN_HEADING, config.FLIGHT_MIN_BODY)


# Selectors other than the built-in ones, two of them of several conditions.
OWN_SELECTORS = ("nav", "h2#references", "code.language-sql", "[role=note]", "p.language-sql")


def page_scan(spark, sf):
    return scan_pages(spark, f"{sf}/pages.parquet").select(
        "page_id", "url", F.length("html").cast("long").alias("html_chars")
    )


def accept_filter(spark, sf):
    return accepted(derived(spark, sf, "d_crawl")).select("k", "url")


def url_guard(spark, sf):
    return derived(spark, sf, "d_crawl").select("k", url_error(F.col("url")).alias("error"))


def error_rows(spark, sf):
    return with_errors(derived(spark, sf, "d_crawl")).where("error is not null").select("k", "error")


def url_parts(spark, sf):
    part = split_url(with_scheme(F.col("url")))
    return (
        _pages(spark, sf)
        .select("page_id", part.alias("p"))
        .select("page_id", "p.scheme", "p.host", "p.port", "p.path", "p.query", "p.fragment")
    )


def url_hosts(spark, sf):
    """Hosts in numeric, percent-encoded, full-width and international spellings; one key for one page."""
    return (
        derived(spark, sf, "d_host")
        .select("k", normalize_url(F.col("url")).alias("url_key"), split_url(F.col("url")).alias("p"))
        .select("k", "url_key", "p.host")
    )


def url_tracking(spark, sf):
    """Tracking parameters found and dropped, per page."""
    names = F.transform(
        F.split(F.regexp_replace(F.col("p.query"), r"\A\?", ""), "&"),
        lambda q: F.regexp_extract(q, r"\A([^=]*)", 1),
    )
    return (
        _keyed(spark, sf)
        .select("page_id", "url_key", split_url(F.col("url")).alias("p"))
        .select(
            "page_id",
            F.coalesce(
                F.size(F.filter(names, lambda n: n.isin(config.TRACKING_PARAMS))), F.lit(0)
            ).cast("long").alias("dropped"),
            F.contains(F.col("url_key"), F.lit("?")).cast("int").alias("query_left"),
        )
    )


def url_ports(spark, sf):
    return derived(spark, sf, "d_url").select(
        "k", F.regexp_extract(normalize_url(F.col("url")), r"\Ahttps://([^/?]*)", 1).alias("authority")
    )


def dedup_pages(spark, sf):
    pages = derived(spark, sf, "d_snapshot").select(
        F.col("k").alias("page_id"), column_of(normalize_url, "url").alias("url_key"), "created_at"
    )
    # Every seventh page is crawled again as the one before it, so that keys do collide.
    again = pages.where("page_id % 7 = 0").select(
        (F.col("page_id") + 1000000).alias("page_id"), "url_key", (F.col("created_at") + 30).alias("created_at")
    )
    return snapshots.dedup_pages(pages.unionByName(again)).select("url_key", "page_id", "created_at")


def resolve_links(spark, sf):
    return elements.link_table(_keyed(spark, sf)).select(
        "page_id", F.col("pos").cast("long").alias("pos"), "tag", "href", "target"
    )


def absolute_links(spark, sf):
    return _keyed(spark, sf).select(
        "page_id", column_of(elements.absolutize_links, "html", "url_key").alias("html")
    )


def canonical_mismatch(spark, sf):
    return (
        derived(spark, sf, "d_canonical")
        .select("k", "url", metadata.canonical(_head(), F.col("url")).alias("canonical"))
        .withColumn("differs", F.coalesce(F.col("canonical") != F.col("url"), F.lit(False)).cast("int"))
        .drop("url")
    )


def meta_tags(spark, sf):
    head = derived(spark, sf, "d_head").select("k", _head().alias("h"))
    return head.select(
        "k",
        *[
            metadata.meta(F.col("h"), name).alias(name.replace(":", "_"))
            for name in ("og:title", "description", "author", "og:site_name", "keywords")
        ],
    )


def meta_keywords(spark, sf):
    return derived(spark, sf, "d_head").select(
        "k", F.array_join(metadata.keywords(_head()), "|").alias("keywords")
    )


def meta_struct(spark, sf):
    heads = derived(spark, sf, "d_head").withColumn("url_key", F.lit("https://h.example.com/"))
    lds = derived(spark, sf, "d_jsonld").withColumn("url_key", F.lit("https://h.example.com/"))
    both = heads.unionByName(lds.withColumn("k", -F.col("k") - 1))
    return metadata.with_metadata(both).select(
        "k",
        "title",
        "description",
        F.col("metadata.title").alias("meta_title"),
        F.col("metadata.author").alias("author"),
        F.col("metadata.language").alias("language"),
        F.col("metadata.og_site_name").alias("site"),
        F.col("metadata.date_published").alias("published"),
        F.col("metadata.publisher").alias("publisher"),
        F.col("metadata.image").alias("image"),
    )


def jsonld_fields(spark, sf):
    return (
        derived(spark, sf, "d_jsonld")
        .select("k", metadata.jsonld_fields(metadata.jsonld_text(F.col("html"))).alias("j"))
        .select("k", "j.author", "j.date_published", "j.publisher", "j.image")
    )


def jsonld_graph(spark, sf):
    node = metadata.jsonld_node(metadata.jsonld_text(F.col("html")))
    return derived(spark, sf, "d_jsonld").select(
        "k", F.try_variant_get(node, '$["@type"]', "string").alias("type")
    )


def main_content(spark, sf):
    return content.with_main_content(_pages(spark, sf)).select("page_id", "content")


def container_extract(spark, sf):
    pages = _pages(spark, sf).select(F.col("page_id").alias("k"), "html")
    nested = derived(spark, sf, "d_nested").select((-F.col("k") - 1).alias("k"), "html")
    return pages.unionByName(nested).select(
        "k", content.extract_container(F.col("html")).alias("content")
    )


def _token_rows(spark, sf):
    return elements.token_table(_pages(spark, sf), "html")


def html_tokens(spark, sf):
    return _token_rows(spark, sf).select(
        "page_id",
        F.col("pos").cast("long").alias("pos"),
        "kind",
        "tag",
        F.coalesce(
            F.array_join(
                F.transform("attrs", lambda a: F.concat(a["name"], F.lit("="), F.coalesce(a["value"], F.lit("")))),
                "|",
            ),
            F.lit(""),
        ).alias("attrs"),
        "text",
    )


def raw_tokens(spark, sf):
    """Tokens around elements whose body holds no tags."""
    return elements.token_table(derived(spark, sf, "d_raw"), "html", "k").select(
        "k", F.col("pos").cast("long").alias("pos"), "kind", "tag", "text"
    )


def exclude_rules(spark, sf):
    """How often each rule of the exclusion table hits over all pages and derived pages.

    The rule table has a fixed size, so it is broadcast.
    """
    rules = spark.createDataFrame(config.exclude_rules(), "kind string, name string, value string")
    html = _pages(spark, sf).select("page_id", "html").unionByName(
        derived(spark, sf, "d_html").select(F.col("k").alias("page_id"), "html")
    )
    tags = elements.token_table(html, "html").where(F.col("kind").isin("open", "raw"))

    def marks(kind: str, names: Column, values: Column | None = None) -> Column:
        return F.transform(
            names,
            lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name"), (values if values is not None else F.lit(None).cast("string")).alias("value")),
        )

    none = F.array().cast("array<string>")
    classes = F.coalesce(F.split(elements.attribute(F.col("attrs"), "class"), r"\s+"), none)
    ids = F.array_compact(F.array(elements.attribute(F.col("attrs"), "id")))
    attrs = F.transform(
        F.coalesce("attrs", F.array().cast("array<struct<name:string,value:string>>")),
        lambda a: F.struct(F.lit("attr").alias("kind"), a["name"].alias("name"), a["value"].alias("value")),
    )
    hits = (
        tags.select(
            F.explode(
                F.concat(
                    marks("tag", F.array("tag")), marks("class", F.array_distinct(classes)), marks("id", ids), attrs
                )
            ).alias("m")
        )
        .select("m.*")
        .alias("h")
        .join(
            F.broadcast(rules).alias("r"),
            (F.col("h.kind") == F.col("r.kind"))
            & (F.col("h.name") == F.col("r.name"))
            & (F.col("r.value").isNull() | (F.col("h.value") == F.col("r.value"))),
        )
        .groupBy("r.kind", "r.name", "r.value")
        .agg(F.count(F.lit(1)).alias("hits"))
    )
    return (
        rules.alias("r")
        .join(
            hits.alias("n"),
            (F.col("r.kind") == F.col("n.kind"))
            & (F.col("r.name") == F.col("n.name"))
            & F.col("r.value").eqNullSafe(F.col("n.value")),
            "left",
        )
        .select("r.kind", "r.name", "r.value", F.coalesce("n.hits", F.lit(0)).cast("long").alias("hits"))
    )


def match_tag(spark, sf):
    return _token_rows(spark, sf).where(
        F.col("kind").isin("open", "raw") & elements.matches_tag(F.col("tag"))
    ).select("page_id", F.col("pos").cast("long").alias("pos"), "tag")


def match_class(spark, sf):
    return _token_rows(spark, sf).where(
        (F.col("kind") == "open") & elements.matches_class(F.col("attrs"))
    ).select("page_id", F.col("pos").cast("long").alias("pos"), "tag")


def _derived_tokens(spark, sf):
    return elements.token_table(derived(spark, sf, "d_html"), "html", "k").where("kind = 'open'")


def match_id(spark, sf):
    return _derived_tokens(spark, sf).where(elements.matches_id(F.col("attrs"))).select(
        "k", F.col("pos").cast("long").alias("pos"), "tag"
    )


def match_attr(spark, sf):
    return _derived_tokens(spark, sf).where(elements.matches_attribute(F.col("attrs"))).select(
        "k", F.col("pos").cast("long").alias("pos"), "tag"
    )


def render_markdown(spark, sf):
    return with_markdown(_pages(spark, sf), "html").select("page_id", "markdown")


def render_blocks(spark, sf):
    return with_markdown(derived(spark, sf, "d_rich"), "html").select("k", "markdown")


def inline_code_query(spark, sf):
    """All code elements without attributes, in order."""
    texts = F.regexp_extract_all("html", F.lit(r"<code>([^<]*)</code>"), F.lit(1))
    return derived(spark, sf, "d_html").select("k", F.posexplode(texts).alias("pos", "t")).select(
        "k", F.col("pos").cast("long").alias("pos"), inline_code(F.col("t")).alias("code")
    )


def fenced_code_query(spark, sf):
    """All code blocks, in order."""
    found = F.regexp_extract_all("html", F.lit(r"<pre><code[^>]*>[^<]*</code>"), F.lit(0))
    return derived(spark, sf, "d_html").select("k", F.posexplode(found).alias("pos", "b")).select(
        "k",
        F.col("pos").cast("long").alias("pos"),
        fenced_code(
            F.regexp_extract("b", r"<pre><code[^>]*>([^<]*)</code>", 1),
            F.regexp_extract("b", r'language-([^"\s]+)', 1),
        ).alias("code"),
    )


def render_code(spark, sf):
    return with_markdown(derived(spark, sf, "d_html"), "html").select("k", "markdown")


def clean_markdown(spark, sf):
    renamed = derived(spark, sf, "d_md").withColumnRenamed("md", "markdown")
    return clean.clean_markdown(renamed, max_alt_text=config.MAX_ALT_TEXT)


def flight_pages(spark, sf):
    return derived(spark, sf, "d_flight").where(flight.has_flight(F.col("html"))).select("k")


def flight_payloads(spark, sf):
    return derived(spark, sf, "d_flight").select(
        "k", F.posexplode(flight.payloads(F.col("html"))).alias("pos", "payload")
    ).withColumn("pos", F.col("pos").cast("long"))


def flight_text(spark, sf):
    return derived(spark, sf, "d_flight").where(flight.has_flight(F.col("html"))).select(
        "k", flight.flight_text(flight.payloads(F.col("html"))).alias("text")
    )


def _flight_elements(spark, sf, kind: int):
    text = flight.flight_text(flight.payloads(F.col("html")))
    parts = flight.elements(text, config.FLIGHT_MIN_HEADING, config.FLIGHT_MIN_BODY)
    return (
        derived(spark, sf, "d_flight").where(flight.has_flight(F.col("html")))
        .select("k", F.inline(F.filter(parts, lambda e: e["kind"] == kind)))
    )


def flight_headings(spark, sf):
    return _flight_elements(spark, sf, 0).select("k", "level", "text")


def flight_body(spark, sf):
    return _flight_elements(spark, sf, 1).select("k", "text")


def sparse_fallback(spark, sf):
    df = content.with_main_content(derived(spark, sf, "d_flight"), "html", "content")
    df = plans.html_to_markdown(df, "content")
    return plans.with_sparse_fallback(df, **FALLBACK).select("k", "markdown")


def word_count_query(spark, sf):
    return table(spark, sf, "documents").select("doc_id", word_count(F.col("text")).alias("words"))


def word_cap(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", formatting.cap_words(F.col("text"), WORD_CAP).alias("capped")
    )


def metadata_header(spark, sf):
    base = derived(spark, sf, "d_head").withColumn(
        "url_key", F.concat(F.lit("https://h.example.com/"), F.col("k").cast("string"))
    )
    return metadata.with_metadata(base).select(
        "k",
        formatting.metadata_header(
            F.col("url_key"), F.col("title"), F.col("description"), F.col("metadata")
        ).alias("header"),
    )


def format_document(spark, sf):
    docs = table(spark, sf, "documents")
    header = F.concat(F.lit("URL Source: "), F.col("source"))
    return docs.select(
        "doc_id", formatting.format_document(header, formatting.document_body(F.col("text"))).alias("document")
    )


def empty_body(spark, sf):
    md = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", formatting.document_body(md).alias("body")
    ).select("doc_id", "body", word_count(F.col("body")).alias("words"))


def page_documents(spark, sf):
    return plans.page_documents(_pages(spark, sf)).select(
        "page_id", "url_key", "title", "description", F.col("metadata.language").alias("language"), "markdown", "document"
    )


def crawl_documents(spark, sf):
    """Pages as crawl responses, some of them bad, to documents and error rows."""
    crawl = _pages(spark, sf).withColumns({
        "status": F.when(F.col("page_id") % 7 == 0, 503).otherwise(200),
        "content_type": F.when(F.col("page_id") % 5 == 0, "image/png").otherwise("text/html"),
        "url": F.when(F.col("page_id") % 11 != 0, F.col("url")),
        "html": F.when(F.col("page_id") % 3 != 0, F.col("html")),
    })
    return crawl_jobs.crawl_documents(crawl).select("page_id", "url_key", "document", "error")


def _snapshots(spark, sf):
    """A snapshot table that covers the pages with an even id."""
    stored = derived(spark, sf, "d_snapshot").where("k % 2 = 0").select(
        column_of(normalize_url, "url").alias("url_key"),
        F.concat(F.lit("doc "), F.col("k").cast("string")).alias("document"),
        "created_at",
        F.col("k").alias("page_id"),
    )
    return snapshots.latest_per_key(
        stored, "url_key", F.col("created_at").desc(), F.col("page_id").desc()
    ).drop("page_id")


def snapshot_lookup(spark, sf):
    requests = derived(spark, sf, "d_snapshot").select(
        F.col("k").alias("page_id"), column_of(normalize_url, "url").alias("url_key")
    )
    return snapshots.lookup(requests, _snapshots(spark, sf), NOW).select(
        "page_id", "url_key", "document", "cache"
    )


def snapshot_upsert(spark, sf):
    new = derived(spark, sf, "d_snapshot").where("k % 3 = 0").select(
        column_of(normalize_url, "url").alias("url_key"),
        F.concat(F.lit("new "), F.col("k").cast("string")).alias("document"),
        F.lit(NOW).cast("long").alias("created_at"),
        F.col("k").alias("page_id"),
    )
    new = snapshots.latest_per_key(new, "url_key", F.col("page_id").desc()).drop("page_id")
    return snapshots.upsert(_snapshots(spark, sf), new)


def incremental_documents(spark, sf):
    todo = snapshots.stale_pages(_keyed(spark, sf), _snapshots(spark, sf), NOW)
    done = plans.format_rows(plans.extract(todo.select("page_id", "url_key", "html"))).select(
        "url_key", "document", F.lit(NOW).cast("long").alias("created_at")
    )
    return snapshots.upsert(_snapshots(spark, sf), done)


def _events(spark, sf):
    # ``ts`` has no zone; its seconds count as UTC whatever the zone of the session is.
    utc = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    return table(spark, sf, "events").select("event_id", "event_type", F.unix_seconds(utc).alias("second"))


def cache_hits(spark, sf):
    return throttle.cache_hits(_events(spark, sf), "event_type", "second", ["event_id"]).select(
        "event_id", "event_type", "window_start", "cache"
    )


def anchored_counts(spark, sf):
    return throttle.anchored_counts(
        _events(spark, sf), "event_type", "second", ["event_id"], EVENT_WINDOW
    ).select("event_id", "event_type", "window_start", F.col("request_count").cast("long").alias("request_count"))


def throttle_flags(spark, sf):
    return throttle.throttle_flags(
        _events(spark, sf), "event_type", "second", ["event_id"], window=EVENT_WINDOW
    ).select("event_id", "rejected", "retry_after")


def client_key(spark, sf):
    return derived(spark, sf, "d_log").select(
        "k", throttle.client_key(F.col("h1"), F.col("h2")).alias("client")
    )


def exempt_filter(spark, sf):
    return throttle.without_exempt(derived(spark, sf, "d_log")).select("k", "path")


QUERIES: dict[str, Query] = {
    "page_scan": page_scan,
    "accept_filter": accept_filter,
    "url_guard": url_guard,
    "error_rows": error_rows,
    "url_scheme": _column("url", "url", with_scheme, "d_url"),
    "url_parts": url_parts,
    "url_hosts": url_hosts,
    "normalize_url": lambda spark, sf: _keyed(spark, sf).select("page_id", "url_key"),
    "url_ports": url_ports,
    "url_tracking": url_tracking,
    "url_param_sort": _column("url", "url_key", normalize_url, "d_url"),
    "dedup_pages": dedup_pages,
    "resolve_links": resolve_links,
    "absolute_links": absolute_links,
    "canonical_mismatch": canonical_mismatch,
    "head_slice": _page_column("head", lambda h: metadata.head_slice(h, config.HEAD_FALLBACK_CHARS)),
    "meta_tags": meta_tags,
    "page_title": lambda spark, sf: _pages(spark, sf).select(
        "page_id", metadata.page_title(_head()).alias("title")
    ),
    "page_description": _column("html", "description", lambda h: metadata.page_description(metadata.head_slice(h)), "d_head"),
    "meta_struct": meta_struct,
    "page_language": lambda spark, sf: _pages(spark, sf).select(
        "page_id", metadata.language(_head()).alias("language")
    ),
    "meta_keywords": meta_keywords,
    "jsonld_fields": jsonld_fields,
    "jsonld_graph": jsonld_graph,
    "container_extract": container_extract,
    "footer_cut": _column("html", "content", content.cut_footer, "d_html"),
    "html_cap": _page_column("content", lambda h: content.cap_html(h, HTML_CAP)),
    "main_content": main_content,
    "html_tokens": html_tokens,
    "raw_tokens": raw_tokens,
    "exclude_rules": exclude_rules,
    "match_tag": match_tag,
    "match_class": match_class,
    "match_id": match_id,
    "match_attr": match_attr,
    "strip_elements": _page_column("html", elements.strip_elements),
    "strip_derived": _column("html", "html", elements.strip_elements, "d_html"),
    "strip_custom": _column("html", "html", elements.stripper(OWN_SELECTORS), "d_html"),
    "strip_raw": _column("html", "html", elements.strip_elements, "d_raw"),
    "render_markdown": render_markdown,
    "render_blocks": render_blocks,
    "render_code": render_code,
    "inline_code": inline_code_query,
    "fenced_code": fenced_code_query,
    "multiline_links": _column("md", "md", clean.escape_newlines_in_links, "d_md"),
    "nav_links": _column("md", "md", clean.remove_navigation_links, "d_md"),
    "nav_phrases": _column("md", "md", clean.remove_navigation_phrases, "d_md"),
    "blank_lines": _column("md", "md", clean.remove_blank_lines, "d_md"),
    "empty_links": _column("md", "md", clean.remove_empty_links, "d_md"),
    "strip_links": _column("md", "md", clean.strip_inline_links, "d_md"),
    "edit_markers": _column("md", "md", clean.remove_edit_markers, "d_md"),
    "table_cleanup": _column("md", "md", clean.clean_tables, "d_md"),
    "alt_text": _column("md", "md", clean.shorten_alt_text, "d_md"),
    "dup_headings": _column("md", "md", clean.collapse_headings, "d_md"),
    "code_fences": _column("md", "md", clean.fix_code_fences, "d_md"),
    "unescape_md": _column("md", "md", clean.unescape, "d_md"),
    "newline_runs": _column("md", "md", clean.collapse_newlines, "d_md"),
    "clean_markdown": clean_markdown,
    "flight_pages": flight_pages,
    "flight_payloads": flight_payloads,
    "flight_text": flight_text,
    "flight_headings": flight_headings,
    "flight_body": flight_body,
    "flight_document": _column("html", "html", _flight_document, "d_flight"),
    "sparse_fallback": sparse_fallback,
    "word_count": word_count_query,
    "word_cap": word_cap,
    "metadata_header": metadata_header,
    "format_document": format_document,
    "empty_body": empty_body,
    "page_documents": page_documents,
    "crawl_documents": crawl_documents,
    "js_trim": _column("s", "s", trim, "d_space"),
    "snapshot_lookup": snapshot_lookup,
    "cache_hits": cache_hits,
    "snapshot_upsert": snapshot_upsert,
    "incremental_documents": incremental_documents,
    "client_key": client_key,
    "exempt_filter": exempt_filter,
    "anchored_counts": anchored_counts,
    "throttle_flags": throttle_flags,
}
