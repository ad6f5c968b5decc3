import random

import pytest
from pyspark.sql import functions as F

from pagepress import config
from pagepress.functions import content as c
from pagepress.functions import elements as e

ARTICLE = """<html><body><header><nav>Top links</nav></header><main id="content"><article>
<h1>River boats</h1><p>Born on 4 May 1901.</p><h2>Early years</h2><p>Text.</p>
<h2 id="see_also">See also</h2><p>List of boats</p><h2 id="references">References</h2>
<ol class="references"><li>Citation one</li></ol><h2 id="external_links">External links</h2>
<ul><li><a href="https://x.example/">Boat database</a></li></ul></article></main>
<footer>Bottom line</footer></body></html>"""


def main(html):
    return c.cap_html(c.cut_footer(c.extract_container(html)))


def test_article_and_footer(apply):
    (out,) = apply(main, ARTICLE)
    for text in ("River boats", "Early years", "4 May 1901"):
        assert text in out
    for text in ("Top links", "Bottom line", "List of boats", "Citation one", "Boat database"):
        assert text not in out


def test_containers(apply):
    pages = [
        "<p>a</p>",
        "x<ARTICLE><article>1</article>2</ARTICLE>3",
        "<article>open<main>m</main>",
        "<mainframe><main>z</main></main>w",
        "</article><article>a</article><article>b</article>",
    ]
    assert apply(c.extract_container, *pages) == [
        "<p>a</p>", "<ARTICLE><article>1</article>2</ARTICLE>", "<main>m</main>",
        "<mainframe><main>z</main></main>", "<article>a</article>",
    ]


def test_footer_marks(apply):
    pages = ['a<hr>b<p ID="Notes">c', "a<h2 id='notes'>c", 'a<p id="notes2">', 'a<p id="notes">', '<h2 id="notes">x']
    assert apply(c.cut_footer, *pages) == ["a", pages[1], pages[2], "a<p ", "<h2 "]


def test_cap(apply):
    big = "<div>" + "<p>word </p>" * 50000 + "</div>"
    (out,) = apply(c.cap_html, big)
    assert len(out) <= 256001 and out.endswith(">")
    assert apply(lambda h: c.cap_html(h, 5), "abcdefgh", "<b>defgh", "abcde>gh", "<b>de") == [
        "abcde", "<b>", "abcde>", "<b>de",
    ]


def test_tokens_cover_the_input(apply):
    texts = [
        ARTICLE, "a < b <3 <p x='>'>y</p> & <", '<script>if (a<b) "</p>"</script>t<!-- <p> -->', "<style>x",
        '<a href="foo>bar<p>', "<!doctype html><P/>",
    ]
    joined = lambda h: F.array_join(F.transform(e.tokens(h), lambda t: t["text"]), "")
    assert apply(joined, *texts) == texts


def test_attributes(apply):
    def attrs(h):
        return F.to_json(e.tokens(h)[0]["attrs"])

    assert apply(attrs, """<a HREF=x class='a b' hidden data-x="1>2" class="no">""") == [
        '[{"name":"href","value":"x"},{"name":"class","value":"a b"},{"name":"hidden"},{"name":"data-x","value":"1>2"}]'
    ]


def test_strip(apply):
    cases = {
        "<p>a</p><nav><nav>x</nav>y</nav>b": "<p>a</p>b",
        '<div class="x ad">z<div>q</div></div>t': "t",
        '<div class="AD">keep</div>': '<div class="AD">keep</div>',
        '<p id="toc">z</p>k': "k",
        '<i role="note">z</i><i role="x">k</i>': '<i role="x">k</i>',
        "<span hidden>z</span>k": "k",
        '<b aria-hidden="true">z</b><b aria-hidden="false">k</b>': '<b aria-hidden="false">k</b>',
        '<img class="ad">k': "k",
        "<ul><li class=ad>z<li>y</ul>k": "<ul></ul>k",
        "a<nav>z": "a",
        "<div><nav>z</div>k": "<div></div>k",
        "<script>'<nav>'</script>k<svg><path/><g></g></svg>m": "km",
        "</nav>k": "</nav>k",
    }
    assert apply(e.strip_elements, *cases) == list(cases.values())


def test_own_selectors(apply):
    strip = e.stripper(("div.ad.big", "P", "[data-x='1 2'][hidden]", "i#a"))
    cases = {
        "<div class='big x ad'>z</div><div class=ad>k</div>": "<div class=ad>k</div>",
        "<p>z</p><nav>k</nav>": "<nav>k</nav>",
        '<b data-x="1 2" hidden>z</b><b hidden>k</b><b data-x="1 2">k</b>': '<b hidden>k</b><b data-x="1 2">k</b>',
        "<i id=a>z</i><b id=a>k</b>": "<b id=a>k</b>",
        "<textarea class='ad big'><p></textarea>": "<textarea class='ad big'><p></textarea>",
    }
    assert apply(strip, *cases) == list(cases.values())
    assert apply(e.stripper(()), "<nav>k</nav>") == ["<nav>k</nav>"]


@pytest.mark.parametrize("text", ["", "a b", "a>b", ".", "a[x", "#a b", ".ad,nav", "[x~=y]", "*"])
def test_what_is_no_selector(text):
    with pytest.raises(ValueError):
        config.selector(text)


def test_bodies_without_tags(apply):
    cases = {
        "<textarea><nav>code sample</nav></textarea><title>a <nav> b</title>": None,
        "<xmp><div hidden></xmp><nav>z</nav>k": "<xmp><div hidden></xmp>k",
        "<noembed><aside></noembed><NOFRAMES><aside></NoFrames >k": None,
        "<textarea class=ad><p></textarea>k": "k",
        "<titles><nav>z</nav></titles>": "<titles></titles>",
        "<title><nav>": None,
        "<svg><title/><nav>z</nav></svg>a<nav>z</nav>k": "ak",
        "<svg/><textarea><nav></textarea>k": "<textarea><nav></textarea>k",
        "<math><title/><mi>x</mi></math><p>k</p><nav>z</nav>": "<math><title/><mi>x</mi></math><p>k</p>",
        "<script>'<svg>'</script><textarea><nav></textarea>": "<textarea><nav></textarea>",
        "<math><title/>a<nav>z": "<math><title/>a",
    }
    assert apply(e.strip_elements, *cases) == [html if kept is None else kept for html, kept in cases.items()]


def test_no_text_outside_excluded_elements_is_lost(apply):
    draw = random.Random(3)
    names = [*e.RAW_TAGS, "svg", "math", "p", "b", "i"]
    marks = [f"<{n}>" for n in names] + [f"</{n}>" for n in names] + [f"<{n}/>" for n in names] + ["<", "</", "<!--", "-->", "x y", "'", '"']
    pages = ["".join(draw.choices(marks, k=30)) for _ in range(150)]
    joined = lambda h: F.array_join(F.transform(e.tokens(h), lambda t: t["text"]), "")
    assert apply(joined, *pages) == pages


def test_links(apply):
    base = "https://e.com/a/"
    cases = {
        '<a href="x">t</a><a href="#f">u</a>': '<a href="https://e.com/a/x">t</a><a href="#f">u</a>',
        "<img alt='q' src=/i.png>": "<img alt='q' src=\"https://e.com/i.png\">",
        '<img src="data:x"><a href="mailto:m">n</a>': '<img src="data:x"><a href="mailto:m">n</a>',
        '<a data-href="y" href="z">t</a>': '<a data-href="y" href="https://e.com/a/z">t</a>',
    }
    assert apply(e.absolutize_links, *[(h, base) for h in cases]) == list(cases.values())
