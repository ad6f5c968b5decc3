"""Long and broken pages: no pattern may recurse once per character or per repetition."""

import time

from pyspark.sql import functions as F

from pagepress import config
from pagepress.functions.cleaners import remove_empty_links, strip_inline_links
from pagepress.functions.elements import strip_elements
from pagepress.functions.flight import flight_html
from pagepress.functions.metadata import canonical, jsonld_text, language, page_title, title_tag
from pagepress.functions.urls import resolve_url
from pagepress.plans.documents import page_documents

PUSH = '<script>self.__next_f.push([1,"{}"])</script>'


def test_long_broken_pages(spark):
    n = 8000
    bodies = [
        "<a " + "x" * (8 * n),
        "<a " + "x=y " * n + "href='/q'>t</a>",
        "<a href=\"" + "z" * (8 * n),
        "<br>" * n + "end",
        "<div>" * n + "deep" + "</div>" * n,
        "<blockquote>" * 2000 + "q" + "</blockquote>" * 2000,
        "<ul><li>" * 2000 + "i",
        "<b>" * n + "b",
        "<p>one [two\n" * n,
        "<table>" + "<tr><td>a<td>b" * 5000,
        "&amp;" * n + "&#65;" * n,
        "<nav>" * n + "n",
        '<p class="ad">x</p>' * 5000 + "kept",
        "<pre><code>" + "``` \n" * n + "</code></pre>",
        "<!-- " + "-" * (8 * n),
        "a" + " " * (8 * n) + "b",
        "<h2>t</h2>" * 5000,
    ]
    rows = [(i, "e.com", b) for i, b in enumerate(bodies)]
    rows.append((len(rows), "e.com", PUSH.format('{\\"children\\":\\"' + "w " * 4 * n + '\\"}' * 1)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    start = time.time()
    got = {r.page_id: r.markdown for r in page_documents(df, min_words=config.MIN_WORDS).collect()}
    assert len(got) == len(rows)
    assert time.time() - start < 120
    assert got[1] == "t" and got[3] == "end" and got[4] == "deep" and got[7] == "b"
    assert got[10] == "&" * n + "A" * n
    assert got[11] == "" and got[12] == "kept"
    assert got[15] == "a b" and got[16] == "## t"
    assert got[len(rows) - 1].split() == ["w"] * 4 * n or "truncated" in got[len(rows) - 1]


def test_long_links(spark):
    long = "a" * 1_000_000
    bodies = [
        f'<main><a href="/{long}">t</a></main>',
        f'<main><a href="{long}/{long}?q">t</a><p>kept</p></main>',
        f'<main><img src="/{long}" alt="x"><p>kept</p></main>',
        f'<head><link rel="canonical" href="/{long}"></head><main><p>kept</p></main>',
        f'<main><a href="/{long}<p>open</p></main>',
    ]
    df = spark.createDataFrame([(i, "e.com", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    got = {r.page_id: r for r in page_documents(df.repartition(5)).collect()}
    assert got[0].markdown == "t" and got[1].markdown.endswith("kept") and got[2].markdown.endswith("kept")
    assert got[3].metadata.canonical == "https://e.com/" + long
    paths = spark.createDataFrame([("/" + "ab/c.d" * 100_000,), ("/" + long,)], "r string").repartition(2)
    out = paths.select("r", resolve_url(F.col("r"), F.lit("https://e.com/p")).alias("o")).collect()
    assert all(r.o == "https://e.com" + r.r for r in out)


def test_nothing_is_cut(spark):
    words = " ".join(f"w{i}" for i in range(60_000))
    bodies = [f"<main><p>{words}</p></main>", f"<HEAD>{'x' * 20_000}<title>T</title></HEAD><main><p>{words}</p></main>",
              f'<main><p>{words}</p><img src="/i" alt="{"a" * 500}"></main>']
    df = spark.createDataFrame([(i, "e.com", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    got = {r.page_id: r for r in page_documents(df).collect()}
    assert all(got[i].markdown.split()[:60_000] == words.split() for i in range(3))
    assert got[1].title == "T" and "a" * 500 in got[2].markdown
    capped = page_documents(df, max_words=100).filter("page_id = 0").collect()[0]
    assert "truncated at 100 words" in capped.markdown


def test_stray_quotes(spark):
    bodies = [
        "<main><img alt=Bob's photo><p>It's kept?</p></main>",
        '<main><p class="x"">It says "hi" to all</p></main>',
        '<main><a title="a > b" href="/q">t</a></main>',
    ]
    df = spark.createDataFrame([(i, "e.com", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    got = {r.page_id: r.markdown for r in page_documents(df).collect()}
    assert "It's kept?" in got[0] and got[1] == 'It says "hi" to all' and got[2] == "t"


def test_brackets_take_linear_time(spark):
    def seconds(n):
        texts = ["[x" * n, "[x](" * n, "[](" * n, "[a](b" * n + ")", "[a](b) " * n]
        df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
        start = time.time()
        out = df.select("t", strip_inline_links(F.col("t")).alias("s"), remove_empty_links(F.col("t")).alias("e")).collect()
        assert {r.t: r.s for r in out}["[a](b) " * n] == "a " * n
        return time.time() - start

    seconds(10)
    assert seconds(40_000) < 10


def seconds_of(spark, fn, text):
    df = spark.createDataFrame([(text,)], "h string").repartition(1)
    df.limit(0).select(fn(F.col("h"))).collect()
    start = time.time()
    out = df.select(fn(F.col("h")).alias("o")).collect()[0].o
    return time.time() - start, out


def test_unclosed_tags_take_linear_time(spark):
    """Patterns that looked for a tag's end from each start took over a minute for 22,000 characters."""
    base = F.lit("https://e.com/p")
    n = 1_000_000
    for fn, unit, before, after, wanted in (
        (lambda h: canonical(h, base), '<link rel="canonical" ', "", "", None),
        (lambda h: canonical(h, base), '<link rel="canonical" ', "", '><link rel="canonical" href="/c">', "https://e.com/c"),
        (page_title, '<meta name="x" ', "", '><meta property="og:title" content="T > U">', "T > U"),
        (title_tag, "<title ", "", ">T</title>", "T"),
        (language, "<html ", "", 'lang="de">', "de"),
        (jsonld_text, '<script type="application/ld+json" ', "", "", None),
        (jsonld_text, '<script type="application/ld+json" ', "", ">{}</script>", "{}"),
        (jsonld_text, '<script type="application/ld+json">', "", "", None),
        (flight_html, "<script>", "__next_f", "", ""),
        (flight_html, "<script ", "__next_f", "</script>", ""),
    ):
        took, got = seconds_of(spark, fn, before + unit * (n // len(unit)) + after)
        assert got == wanted and took < 20, unit


def test_element_removal_takes_linear_time(spark):
    for unit, before, after, wanted in (
        ("<b>", "<nav>x</nav>", "", None), ("<nav>x</nav>", "a", "b", "ab"), ("<div>", "<nav>x</nav>", "</div>", None),
    ):
        many = unit * (200_000 // len(unit))
        took, got = seconds_of(spark, strip_elements, before + many + after)
        assert got == (many + after if wanted is None else wanted) and took < 30, unit


def test_dot_segments_take_linear_time(spark):
    base = F.lit("https://e.com/p")
    for path, wanted in (
        ("/a" * 100_000 + "/..", "/a" * 99_999 + "/"), ("/x" + "/.." * 100_000 + "/b/./c/.", "/b/c/"), ("/a/b/%2e%2E/../c" * 20_000, "/c" * 20_000),
    ):
        took, got = seconds_of(spark, lambda h: resolve_url(h, base), path)
        assert got == "https://e.com" + wanted and took < 30


def test_nested_removal(apply):
    got = apply(
        strip_elements,
        "<div>a<nav>b<div>c</div>d</nav>e</div>f",
        "<div>a<nav>b</div>c",  # ended from outside
        "<p>a<nav>b</p>c</nav>d",
        "<nav>a</b>b<nav>c</nav>d</nav>e",
        "<i><i><i>a<nav>b</i>c</i>d",
        "a<nav>b",
    )
    assert got == ["<div>ae</div>f", "<div>a</div>c", "<p>a</p>c</nav>d", "e", "<i><i><i>a</i>c</i>d", "a"]


def test_broken_heads(apply):
    """Attributes in any order and case, values over ">", and runs of tags that are not closed."""
    titles = {
        '<meta content="a > b" property="og:title">': "a > b",
        '<META PROPERTY=\'OG:TITLE\' CONTENT=\'a\'>': "a",
        '<meta name="x"><meta name="og:title" <meta content="b">': "b",
        '<meta property="og:title" content="a" content="b">': "b",
        '<meta property="og:title" content=""><meta property="og:title" content="z"><title>T</title>': "T",
        "<title <title a>b</title>": "b",
        "<title>a<title>b</title>": "b",
    }
    assert apply(page_title, *titles) == list(titles.values())
    links = {
        '<link rel="canonical" href="/a"><link rel="canonical" href="/b">': "https://e.com/a",
        '<link href="/a" rel="canonical"><link rel="canonical" title="x" href="/b">': "https://e.com/b",
        '<link rel="icon" href="/a" rel="canonical" href="/c" href="/d">': "https://e.com/d",
    }
    assert apply(lambda h: canonical(h, F.lit("https://e.com/p")), *links) == list(links.values())
