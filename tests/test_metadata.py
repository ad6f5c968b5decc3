from pagepress.functions import metadata as m


def test_meta_orders_and_quotes(apply):
    heads = [
        '<meta name="description" content="A b">',
        "<META content='x' property='description'/>",
        '<meta name="description" content="it\'s">',
        '<meta name="descriptions" content="no">',
        '<meta name="description" content=""><meta name="description" content="second">',
    ]
    assert apply(lambda h: m.meta(h, "description"), *heads) == ["A b", "x", "it", "", ""]


def test_title_precedence(apply):
    heads = [
        '<title>t</title><meta property="og:title" content="og">',
        '<title>t</title><meta name="twitter:title" content="tw">',
        "<title>  t \n</title>",
        "<p>",
    ]
    assert apply(m.page_title, *heads) == ["og", "tw", "t", ""]


def test_head_slice(apply):
    assert apply(m.head_slice, "<HEAD>x</HEAD>" + "a" * 10001) == ["<HEAD>x</HEAD>" + "a" * 10001]
    assert apply(lambda c: m.head_slice(c, 10000), "<head>x</head>y", "</head>z", "a" * 10001) == [
        "<head>x", "</head>z", "a" * 10000,
    ]


def test_canonical(apply):
    base = "https://e.com/p"
    pages = [
        '<link rel="canonical" href="/q">',
        '<link href="/q" rel="canonical">',
        '<link rel="canonical" href="http://a b/">',
    ]
    assert apply(m.canonical, *[(p, base) for p in pages]) == ["https://e.com/q", None, "http://a b/"]


def test_jsonld(apply):
    def ld(body):
        return f'<script type="application/ld+json">{body}</script>'

    def author(h):
        return m.jsonld_fields(m.jsonld_text(h))["author"]

    assert apply(
        author,
        ld('{"author":"A"}'),
        ld('{"author":{"name":"B"}}'),
        ld('{"author":[{"name":"C"}]}'),
        ld('{"@graph":[{"@type":"Person","author":"no"},{"@type":"NewsArticle","author":"D"}],"author":"W"}'),
        ld('{"@graph":[{"@type":["Article"],"author":"no"}],"author":"W"}'),
        ld("{bad") + ld('{"author":"second"}'),
        "<p>none</p>",
    ) == ["A", "B", None, "D", "W", None, None]
