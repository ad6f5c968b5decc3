from pyspark.sql import functions as F

from pagepress.functions.flight import flight_html
from pagepress.functions.formatting import cap_words, document_body, format_document, metadata_header
from pagepress.functions.markdown import decode_entities, fenced_code, inline_code, with_markdown
from pagepress.functions.text import scan_strings
from pagepress.plans.documents import page_documents


def render(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "i int, h string").repartition(2)
    return [r.markdown for r in sorted(with_markdown(df, "h").collect(), key=lambda r: r.i)]


def test_render(spark):
    cases = {
        "": "",
        "<h1> A  b</h1>\n<p>x</p>": "# A b\n\nx",
        "<p>a<b>b </b>c <em>d</em></p>": "a**b** c _d_",
        "<p><b>open</p><p>x</p>": "open\n\nx",
        "<b></b>x": "x",
        "a<br>b<br></p>c": "a  \nb\n\nc",
        "<ul><li>a<li>b</ul>c": "- a\n- b\n\nc",
        "<ol start=3><li>a</li><li>b<ul><li>c</li></ul></li><li>d</li></ol>": "3. a\n4. b\n   - c\n5. d",
        '<a href="u">t</a> <a>n</a> <a href="v(1)">w</a>': "[t](u) n [w](v%281%29)",
        '<a href="https://e.com/">https://e.com/</a>': "<https://e.com/>",
        '<img src="s" alt="a b"><img alt="x"><img src="data:y">': "![a b](s)",
        "<table><tr><td>a<p>b</p></td><td></td></tr><tr><td>c</td><td>d</td></tr></table>": "| a b | |\n| --- | --- |\n| c | d |",
        "<blockquote>a<blockquote>b</blockquote></blockquote>c": "> a\n\n>> b\n\nc",
        "x<hr>y": "x\n\n---\n\ny",
        "<pre><code class='language-py'>a  &lt;b&gt;\n\n  c\n</code></pre>": "```py\na  <b>\n\n  c\n```",
        "<p><code>a\n b</code></p>": "`a b`",
        "<!-- c --><script>z</script>k": "k",
        "5 < 6 &amp; 7 > 2": "5 < 6 & 7 > 2",
    }
    assert render(spark, *cases) == list(cases.values())


def test_code(apply):
    assert apply(inline_code, "x", "", "a`b", "`a", " a ", "  ", "a``b`c") == [
        "`x`", "", "``a`b``", "`` `a ``", "`  a  `", "`  `", "``a``b`c``",
    ]
    assert apply(fenced_code, ("a\n", "sql"), ("```x\n````\nb", "")) == [
        "```sql\na\n```", "`````\n```x\n````\nb\n`````",
    ]


def test_entities(apply):
    cases = {
        "&amp;lt; &eacute;&#233;&#xE9; &hellip;": "&lt; ééé …",
        "&nosuch; &copy 1 &ampx; & b": "&nosuch; © 1 &x; & b",
        "&#0;&#128;&#x1F600;&#xD800;": "�€\U0001f600�",
        "&NotEqualTilde;": "≂̸",
    }
    assert apply(decode_entities, *cases) == list(cases.values())


def test_scan_over_many_chunks(apply):
    def running(c):
        return scan_strings(
            F.split(c, ","), F.lit(0), lambda s, i: s + i.cast("int"), lambda i, b, a: F.concat(a.cast("string"), F.lit(";"))
        )

    n = 1000
    expected = "".join(f"{k * (k + 1) // 2};" for k in range(1, n + 1))
    assert apply(running, ",".join(str(k) for k in range(1, n + 1))) == [expected]


PUSH = '<script>self.__next_f.push([1,"{}"])</script>'


def test_flight(apply):
    body = "word " * 10
    page = (
        "<script>self.__next_f=[]</script>"
        + PUSH.format('1:{\\"as\\":\\"h2\\",\\"children\\":\\"Title one\\"}')
        + PUSH.format(f'{{\\"children\\":\\"{body}\\"}}{{\\"children\\":\\"{body}\\"}}')
        + PUSH.format('{\\"children\\":\\"$' + body + '\\"}{\\"children\\":\\"short\\"}')
    )
    big = PUSH.format('{\\"children\\":\\"' + "x" * 100000 + '\\"}')
    outs = apply(flight_html, "<p>no</p>", page, big, "<script>self.__next_f=[]</script>")
    assert outs == ["", f"<h2>Title one</h2>\n<p>{body.strip()}</p>", "<p>" + "x" * 100000 + "</p>", ""]


def test_words(apply):
    assert apply(cap_words, "Hello world. Short.") == ["Hello world. Short."]
    (out,) = apply(cap_words, " ".join(["word"] * 15000))
    assert "Content truncated at 10,000 words" in out and len(out.split()) < 11000
    assert apply(lambda c: cap_words(c, 2), "a  b", "a b\nc") == [
        "a  b", "a b\n\n---\n*Content truncated at 2 words.*",
    ]


FIELDS = "language author og_site_name canonical og_type date_published date_modified publisher".split()


def header(url, title, description, *values):
    fields = [v.alias(n) for n, v in zip(FIELDS, values)]
    meta = F.struct(*fields, F.when(values[0] != "", F.array(F.lit("k1"), F.lit("k2"))).alias("keywords"))
    return metadata_header(url, title, description, meta)


def test_header(apply):
    u = "https://e.com/"
    assert apply(
        header,
        (u, "T", "D", "en", "A", "S", "https://e.com/c", "article", "2024-01-15", "2024-06-20", "P"),
        (u, "", "", "", None, "", u, "", "", "", ""),
    ) == [
        "Title: T\nDescription: D\nURL Source: https://e.com/\nLanguage: en\nAuthor: A\nSite Name: S\n"
        "Canonical URL: https://e.com/c\nContent Type: article\nPublished: 2024-01-15\nModified: 2024-06-20\n"
        "Publisher: P\nKeywords: k1, k2",
        "URL Source: https://e.com/",
    ]


def test_format(apply):
    assert apply(lambda h, b: format_document(h, document_body(b)), ("H", "two words"), ("H", "")) == [
        "H\nWord Count: 2\n\n---\n\ntwo words",
        "H\nWord Count: 8\n\n---\n\nNo content could be extracted from this URL.",
    ]


def test_whole_page(spark):
    html = (
        '<html lang="en"><head><title>T</title><meta name="description" content="D"></head><body><nav>n</nav>'
        '<main><h1>Head</h1><h1>Head</h1><p>See <a href="/x">this</a>[1] <span class="ad">buy</span>now.</p>'
        '<pre><code class="language-sh">npm i</code></pre><h2 id="references">R</h2></main></body></html>'
    )
    flight = '<html><article><h1>x</h1></article>' + PUSH.format(
        '{\\"children\\":\\"' + "enough text " * 5 + '\\"}'
    )
    df = spark.createDataFrame(
        [(1, "http://E.com/p/?utm_source=q", html), (2, "e.com", flight), (3, "f.com", "<main></main>")],
        "page_id long, url string, html string",
    ).repartition(2)
    rows = {r.page_id: r for r in page_documents(df, min_words=50).collect()}
    assert rows[1].document == (
        "Title: T\nDescription: D\nURL Source: https://e.com/p/\nLanguage: en\nWord Count: 9\n\n---\n\n"
        "# Head\nSee this now.\n```sh\nnpm i\n```"
    ).replace("e.com/p/", "e.com/p")
    assert rows[2].markdown == ("enough text " * 5).strip()
    assert rows[3].document.endswith("No content could be extracted from this URL.")
