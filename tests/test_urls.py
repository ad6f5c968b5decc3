import random

from pagepress.functions.hosts import MAX_LABEL, canonical_host, punycode
from pagepress.functions.urls import normalize_url, resolve_url


def test_normalize(apply):
    cases = {
        "http://Ex.COM:80/a/../b/?b=2&a=1&utm_source=x#f": "https://ex.com/b/?a=1&b=2",
        "example.com": "https://example.com/",
        "httpbin.org/x": "httpbin.org/x",
        "httpbin.org:80/x/": "httpbin.org:80/x",
        "https://e.com:8080/p/": "https://e.com:8080/p",
        "https://e.com:443": "https://e.com/",
        "https://e.com:80/": "https://e.com/",
        "http://[::1]:443/x/": "https://[::1]/x",
        "https://u:p@E.com/é x?q=é b~*-._": "https://u:p@e.com/%C3%A9%20x?q=%C3%A9+b%7E*-._",
        "http://h h/x": "http://h h/x",
        "https://e.com:99999/": "https://e.com:99999/",
        "e.com?a": "https://e.com/?a=",
        "e.com?": "https://e.com/",
        "e.com/p/?a=1": "https://e.com/p/?a=1",
        "e.com/x?UTM_SOURCE=2&utm_id=3": "https://e.com/x?UTM_SOURCE=2&utm_id=3",
        "e.com/x?utm%5Fsource=1": "https://e.com/x",
        "e.com/?b=100%&a=%zz&&=v&a=0": "https://e.com/?=v&a=%25zz&a=0&b=100%25",
        "e.com/?z=1&a=2&a=1": "https://e.com/?a=2&a=1&z=1",
        "": "https://",
    }
    assert apply(normalize_url, *cases) == list(cases.values())


def test_normalize_is_idempotent(apply):
    urls = ["http://A.com/x?b=1&a=%20", "b.org//", "https://c.net/ü?q=a+b", "d.io/%7Ex/"]
    once = apply(normalize_url, *urls)
    assert apply(normalize_url, *once)[:1] == once[:1]
    assert apply(normalize_url, *once)[2:] == once[2:]


def test_resolve(apply):
    base = "https://e.com/a/b?x=1"
    cases = {
        "/The": "https://e.com/The",
        "c": "https://e.com/a/c",
        "../c": "https://e.com/c",
        "./c/./d": "https://e.com/a/c/d",
        "..": "https://e.com/",
        "?q": "https://e.com/a/b?q",
        "#f": "https://e.com/a/b?x=1#f",
        "": "https://e.com/a/b?x=1",
        "//H.com/x": "https://h.com/x",
        "http://Z.com": "http://z.com/",
        "https:foo": "https://e.com/a/foo",
        "mailto:a@b": "mailto:a@b",
        "JavaScript:x": "javascript:x",
        "/é,": "https://e.com/%C3%A9,",
        "\\x": "https://e.com/x",
        "http://a b/": None,
    }
    assert apply(resolve_url, *[(c, base) for c in cases]) == list(cases.values())


def test_punycode_equals_the_codec(apply):
    draw = random.Random(5)
    signs = "abcxyz-019" + "äéßñłжЯש書日本語例ก\u0301😀𝒳"
    labels = ["".join(draw.choices(signs, k=draw.choice((1, 2, 3, 8, 20, 63)))) for _ in range(200)]
    labels += ["bücher", "ü", "üü", "aüaü", "書" * 60, "a" * 50 + "ü" * 13, "\U0010ffff", "\x80"]
    labels = [l for l in labels if not l.isascii()]
    assert apply(punycode, *labels) == [l.encode("punycode").decode() for l in labels]


def test_hosts(apply):
    cases = {
        "Bücher.Example": "xn--bcher-kva.example",
        "b%C3%BCcher.example": "xn--bcher-kva.example",
        "ｅｘ．Ａ。b｡c": "ex.a.b.c",
        "a\u00adb.com": "ab.com",
        "\u200b": None,
        "%41b.com": "ab.com",
        "a%2fb.com": None,
        "a%zz.com": None,
        "a%ff.com": None,
        "a+b.com": "a+b.com",
        "[::1]": "[::1]",
        "127.1": "127.0.0.1",
        "0x7f.1": "127.0.0.1",
        "017700000001": "127.0.0.1",
        "2130706433": "127.0.0.1",
        "1.2.3.4.": "1.2.3.4",
        "１.2.3.4": "1.2.3.4",
        "0x": "0.0.0.0",
        "4294967296": None,
        "1.2.3.256": None,
        "1.256.3.4": None,
        "1.2.3.4.5": None,
        "1..2": None,
        "09": None,
        "a.9": None,
        "0x100000000": None,
        "9" * 400: None,
        "a.0xg": "a.0xg",
        "1.a": "1.a",
        "ü" * (MAX_LABEL + 1): None,
        "..": "..",
    }
    assert apply(canonical_host, *cases) == list(cases.values())


def test_spellings_of_one_page_have_one_key(apply):
    groups = [
        ["http://BÜCHER.de/x/", "https://b%c3%bccher.DE/x", "https://xn--bcher-kva.de/x#f", "ｂücher。de/x"],
        ["http://127.0.0.1/", "http://0x7f000001", "http://2130706433:80/", "http://127.1"],
    ]
    for urls in groups:
        assert len(set(apply(normalize_url, *urls))) == 1
