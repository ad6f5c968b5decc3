"""HTML text to markdown, by string rewriting inside the row of the page.

Contract: headings ``#``, ``-`` bullets and ``1.`` items (three spaces of indent per level),
``**``/``_``/``~~`` around closed inline elements (an element that is never closed leaves no
mark), ``[text](href)``, ``<href>`` when text and href are equal, ``![alt](src)``, pipe tables
with a divider after the first row, ``> `` quotes, ``---`` rules, two spaces and a newline for a
break inside a block, fenced and inline code. Text is not escaped.

While a page is being rewritten, characters that must survive the whitespace rules are held
as Unicode noncharacters, which never occur in interchanged text.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame, functions as F

from pagepress.functions.elements import _ATTRS, BEFORE_ATTR
from pagepress.functions.text import column_of, let, replace_many, scan_strings

# Held characters: space, newline, "<", ">", heading mark, gap behind a bullet, start of an item,
# start of a list.
_SP, _NL, _LT, _GT, _H, _GAP, _ITEM, _LIST = (chr(0xFDD0 + i) for i in range(8))
_HELD = _SP + _NL + _LT + _GT + _H + _GAP + _ITEM + _LIST

_BLOCK = (
    "address|article|aside|blockquote|body|caption|center|dd|details|dialog|dir|div|dl|dt|fieldset|"
    "figcaption|figure|footer|form|frameset|head|header|hgroup|html|legend|li|main|menu|nav|noscript|ol|"
    "optgroup|option|p|pre|section|select|summary|table|tbody|td|tfoot|th|thead|title|tr|ul"
)


def _inside(tags: str) -> str:
    """Content without a tag of these names, linear and without recursion."""
    return rf"[^<]*+(?:<(?!/?(?:{tags})\b)[^<]*+)*+"


# --- code ---------------------------------------------------------------------


def inline_code(content: Column) -> Column:
    """Back-tick code: the delimiter grows with every equal run inside."""

    def build(text: Column) -> Column:
        runs = F.regexp_extract_all(text, F.lit("`+"), F.lit(0))
        fence = F.aggregate(
            runs, F.lit("`"), lambda d, run: F.when(run == d, F.concat(d, F.lit("`"))).otherwise(d)
        )
        pad = F.when(content.rlike(r"\A`|\A .*?[^ ].* \z|`\z"), " ").otherwise("")
        return F.concat(fence, pad, text, pad, fence)

    return F.when(content == "", "").otherwise(
        let(F.regexp_replace(content, r"\r?\n|\r", " "), build)
    )


def fenced_code(text: Column, language: Column) -> Column:
    """Fenced block; the fence outgrows every fence at a line start inside."""
    runs = F.regexp_extract_all(text, F.lit(r"(?m)^`{3,}"), F.lit(0))
    longest = F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))
    return let(
        F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1)),
        lambda fence: F.concat(
            fence, language, F.lit("\n"), F.regexp_replace(text, r"\n\z", ""), F.lit("\n"), fence
        ),
    )


def _hold(c: Column) -> Column:
    return F.translate(F.replace(c, F.lit("\t"), F.lit(_SP)), " \n", _SP + _NL)


def _strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?is)<(?:/?[a-z]{_ATTRS}>|!--.*?-->)", "")


_FENCE_OPEN = rf"(?is)\A<pre\b{_ATTRS}>(<code\b{_ATTRS}>)({_inside('code|pre')})</code\s*></pre\s*>"
_CODE_OPEN = rf"(?is)\A<code\b{_ATTRS}>({_inside('code')})</code\s*>"


def _fenced(html: Column) -> Column:
    def block(piece: Column) -> Column:
        def part(i: int) -> Column:
            return F.regexp_extract(piece, _FENCE_OPEN, i)

        language = F.regexp_extract(
            F.regexp_extract(part(1), r"""(?is)\sclass\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", 1),
            r"""language-([^\s"']+)""",
            1,
        )
        code = _hold(fenced_code(_strip_tags(part(2)), language))
        return F.when(
            piece.rlike(_FENCE_OPEN),
            F.concat(
                F.lit("<div>"), code, F.lit("</div>"), F.substr(piece, F.length(part(0)) + 1)
            ),
        ).otherwise(piece)

    pieces = F.split(html, r"(?is)(?=<pre\b[^>]*><code\b)")
    return F.when(
        html.rlike(r"<[pP][rR][eE]\b[^>]*><[cC][oO][dD][eE]\b"), F.array_join(F.transform(pieces, block), "")
    ).otherwise(html)


def _inline(html: Column) -> Column:
    def block(piece: Column) -> Column:
        text = F.regexp_replace(_strip_tags(F.regexp_extract(piece, _CODE_OPEN, 1)), r"[ \t\r\n\f]+", " ")
        return F.when(
            piece.rlike(_CODE_OPEN),
            F.concat(
                _hold(let(text, inline_code)),
                F.substr(piece, F.length(F.regexp_extract(piece, _CODE_OPEN, 0)) + 1),
            ),
        ).otherwise(piece)

    pieces = F.split(html, r"(?i)(?=<code\b)")
    return F.when(
        html.rlike(r"<[cC][oO][dD][eE]\b"), F.array_join(F.transform(pieces, block), "")
    ).otherwise(html)


# --- blocks -------------------------------------------------------------------


def _lists(html: Column) -> Column:
    """Bullets and numbers from a stack of open lists, innermost first."""
    mark = r"(?is)\A<(/?(?:ul|ol|li))\b[^>]*>"

    def name(piece: Column) -> Column:
        return F.lower(F.regexp_extract(piece, mark, 1))

    def advance(stack: Column, piece: Column) -> Column:
        start = F.regexp_extract(piece, r"""(?is)\A<ol\b[^>]*?\sstart\s*=\s*["']?(\d{1,9})""", 1)
        top = F.get(stack, F.lit(0))
        return let(
            name(piece),
            lambda n: F.when(
                n.isin("ul", "ol"),
                F.concat(
                    F.array(
                        F.struct(
                            (n == "ol").alias("numbered"),
                            F.when(start == "", 0).otherwise(start.cast("int") - 1).alias("n"),
                        )
                    ),
                    stack,
                ),
            )
            .when(n.isin("/ul", "/ol"), F.slice(stack, F.lit(2), F.greatest(F.size(stack), F.lit(1))))
            .when(
                (n == "li") & (F.size(stack) > 0),
                F.concat(
                    F.array(F.struct(top["numbered"].alias("numbered"), (top["n"] + 1).alias("n"))),
                    F.slice(stack, F.lit(2), F.size(stack)),
                ),
            )
            .otherwise(stack),
        )

    def emit(piece: Column, before: Column, after: Column) -> Column:
        top = F.get(after, F.lit(0))
        rest = F.regexp_replace(piece, mark, "")
        bullet = F.when(top["numbered"], F.concat(top["n"].cast("string"), F.lit("."))).otherwise("-")
        indent = F.repeat(F.lit(_SP * 3), F.greatest(F.size(after) - 1, F.lit(0)))
        return let(
            name(piece),
            lambda n: F.when(n == "", piece)
            .when(n == "li", F.concat(F.lit(_ITEM), indent, bullet, F.lit(_GAP), rest))
            .when(n == "/li", F.concat(F.lit("\n"), rest))
            .when(n.isin("ul", "ol"), F.concat(F.when(F.size(before) == 0, _LIST).otherwise("\n"), rest))
            .otherwise(F.concat(F.when(F.size(after) == 0, "\n\n").otherwise("\n"), rest)),
        )

    pieces = F.split(html, r"(?i)(?=</?(?:ul|ol|li)\b[^>]*>)")
    start = F.array().cast("array<struct<numbered:boolean,n:int>>")
    return F.when(html.rlike(r"<[lL][iI]\b"), scan_strings(pieces, start, advance, emit)).otherwise(html)


def _tables(html: Column) -> Column:
    """Pipe rows; blocks and breaks inside a cell become spaces."""

    def row(piece: Column, previous: Column) -> Column:
        body = F.regexp_extract(
            piece, r"(?is)\A<tr\b[^>]*>(.*?)(?=</tr|</table|</tbody|</thead|</tfoot|\z)", 1
        )
        rest = F.regexp_replace(
            piece, r"(?is)\A<tr\b[^>]*>.*?(?:</tr\s*>|(?=</table|</tbody|</thead|</tfoot)|\z)", ""
        )
        cells = F.transform(
            F.slice(
                F.split(body, r"(?i)<t[dh]\b[^>]*>"), F.lit(2),
                F.size(F.split(body, r"(?i)<t[dh]\b[^>]*>")),
            ),
            lambda c: F.trim(
                F.regexp_replace(c, rf"(?i)</?(?:{_BLOCK}|br|h[1-6])\b[^>]*>|\s+", " ")
            ),
        )
        first = previous.rlike(r"(?is)<table\b(?:(?!<table\b|</table).)*+\z")
        return let(
            cells,
            lambda cs: F.when(F.size(cs) == 0, F.concat(F.lit("\n"), rest)).otherwise(
                F.concat(
                    F.lit("\n| "),
                    F.array_join(cs, " | "),
                    F.lit(" |"),
                    F.when(first, F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.size(cs)))).otherwise(""),
                    rest,
                )
            ),
        )

    def rows(pieces: Column) -> Column:
        return F.array_join(
            F.transform(
                pieces,
                lambda p, i: F.when(
                    p.rlike(r"(?i)\A<tr\b"), row(p, F.coalesce(F.get(pieces, i - 1), F.lit("")))
                ).otherwise(p),
            ),
            "",
        )

    return F.when(
        html.rlike(r"<[tT][rR]\b"), let(F.split(html, r"(?i)(?=<tr\b)"), rows)
    ).otherwise(html)


def _quotes(text: Column) -> Column:
    """Prefix the lines of a quote by one ``>`` per level; runs when other blocks are lines."""
    mark = r"(?is)\A<(/?)blockquote\b[^>]*>"

    def depth_after(depth: Column, piece: Column) -> Column:
        return (
            F.when(piece.rlike(r"(?i)\A<blockquote"), depth + 1)
            .when(piece.rlike(r"(?i)\A</blockquote"), F.greatest(depth - 1, F.lit(0)))
            .otherwise(depth)
        )

    def emit(piece: Column, _: Column, depth: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(piece, mark, ""), r"\A[ \n]+|[ \n]+\z", "")
        prefix = F.concat(F.repeat(F.lit(_GT), depth), F.lit(_SP))
        lined = F.regexp_replace(
            F.concat(prefix, F.regexp_replace(body, r"\n[\n ]*", "\n")), F.lit("\n"), F.concat(F.lit("\n"), prefix)
        )
        return F.when(
            depth > 0, F.concat(F.lit("\n\n"), F.when(body != "", lined).otherwise(""), F.lit("\n\n"))
        ).otherwise(F.concat(F.lit("\n\n"), F.regexp_replace(piece, mark, "")))

    pieces = F.split(text, r"(?i)(?=</?blockquote\b[^>]*>)")
    return F.when(
        text.rlike(r"<[bB][lL][oO][cC][kK][qQ][uU][oO][tT][eE]\b"), scan_strings(pieces, F.lit(0), depth_after, emit)
    ).otherwise(text)


# --- inlines ------------------------------------------------------------------


def _images(html: Column) -> Column:
    tag = rf"(?is)\A<img\b{_ATTRS}>"

    def value(piece: Column, name: str) -> Column:
        raw = F.regexp_extract(
            F.regexp_extract(piece, tag, 0),
            rf"""(?is)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)""",
            1,
        )
        return F.regexp_replace(raw, r"""(?s)\A(["'])(.*)\1\z""", "$2")

    def image(piece: Column) -> Column:
        rest = F.substr(piece, F.length(F.regexp_extract(piece, tag, 0)) + 1)
        return F.when(
            piece.rlike(tag),
            let(
                value(piece, "src"),
                lambda src: F.when((src == "") | src.rlike(r"(?i)\Adata:"), rest).otherwise(
                    F.concat(F.lit("!["), value(piece, "alt"), F.lit("]("), src, F.lit(")"), rest)
                ),
            ),
        ).otherwise(piece)

    pieces = F.split(html, r"(?i)(?=<img\b)")
    return F.when(
        html.rlike(r"<[iI][mM][gG]\b"), F.array_join(F.transform(pieces, image), "")
    ).otherwise(html)


def _encode_link_targets(html: Column) -> Column:
    """Parentheses in an href would end the markdown link early."""
    pieces = F.split(html, r"(?i)(?=<a\b)")

    def encode(piece: Column) -> Column:
        tag = F.regexp_extract(piece, rf"(?is)\A<a\b{_ATTRS}>", 0)
        return F.concat(
            F.replace(F.replace(tag, F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29")),
            F.substr(piece, F.length(tag) + 1),
        )

    return F.when(
        html.rlike(r"""(?i)<a\b[^>]*\shref\s*=\s*["']?[^"'>]*[()]"""),
        F.array_join(F.transform(pieces, encode), ""),
    ).otherwise(html)


def _links(html: Column) -> Column:
    href = r"""(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    head = rf"(?is)<a\b{BEFORE_ATTR.format(name='href')}"
    tail = _ATTRS + ">"
    same = F.regexp_replace(html, rf'{head}\s*"([^"]+)"{tail}\1</a\s*>', f"{_LT}$1{_GT}")
    linked = F.regexp_replace(same, rf"{head}\s*{href}{tail}({_inside('a')})</a\s*>", "[$4]($1$2$3)")
    empty = F.regexp_replace(linked, r"\[([^\[\]]*)\]\(\)", "$1")
    return F.when(html.rlike(r"<[aA]\b"), empty).otherwise(html)


def _emphasis(html: Column) -> Column:
    names = "b|strong|em|i|del|s|strike"
    out = F.regexp_replace(html, rf"(?i)(<(?:{names})(?:\s[^>]*)?>) +", " $1")
    out = F.regexp_replace(out, rf"(?i) +(</(?:{names})\s*>)", "$1 ")
    for tags, sign in (("b|strong", "**"), ("em|i", "_"), ("del|s|strike", "~~")):
        out = F.regexp_replace(
            out,
            rf"(?i)<(?:{tags})(?:\s[^>]*)?>(?!</)({_inside(tags)})</(?:{tags})\s*>",
            f"{sign}$1{sign}",
        )
    return F.when(html.rlike(rf"</(?i:{names})\s*>"), out).otherwise(html)


# --- entities -----------------------------------------------------------------

# The standard library's HTML table as one text, "\nname\tchars\n": a lookup is one search.
_NAMED = "\n" + "\n".join(
    f"{name[:-1]}\t{chars}"
    for name, chars in html5.items()
    if name.endswith(";") and chars not in "\n\t"
) + "\n"
# Names that also count without a semicolon, longest first.
_BARE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
_C1 = "".join(bytes([b]).decode("cp1252", errors="replace") for b in range(128, 160))
_ENTITY = rf"\A&(?:#(\d{{1,7}})(?:;|(?!\d))|#[xX]([0-9a-fA-F]{{1,6}})(?:;|(?![0-9a-fA-F]))|([a-zA-Z][a-zA-Z0-9]*);)"


def decode_entities(c: Column) -> Column:
    """Named and numeric character references to characters; unknown names stay."""

    def char(code: Column) -> Column:
        utf32 = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return (
            F.when(code.between(128, 159), F.substr(F.lit(_C1), code - 127, F.lit(1)))
            .when(
                (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "\ufffd"
            )
            .otherwise(utf32)
        )

    def named(name: Column) -> Column:
        at = F.instr(F.lit(_NAMED), F.concat(F.lit("\n"), name, F.lit("\t")))
        return let(
            at,
            lambda i: F.when(
                i > 0,
                F.regexp_extract(
                    F.substr(F.lit(_NAMED), i + F.length(name) + 2, F.lit(3)), r"\A([^\n]*)", 1
                ),
            ),
        )

    def one(piece: Column) -> Column:
        def part(i: int) -> Column:
            return F.regexp_extract(piece, _ENTITY, i)

        def rest(n: Column) -> Column:
            return F.substr(piece, n + 1)

        bare = F.regexp_extract(piece, rf"\A&({_BARE})", 1)
        other = let(
            F.struct(*[part(i).alias(f"g{i}") for i in range(4)]),
            lambda g: F.coalesce(
                F.concat(
                    F.when(g["g1"] != "", char(g["g1"].cast("int")))
                    .when(g["g2"] != "", char(F.conv(g["g2"], 16, 10).cast("int")))
                    .when(g["g3"] != "", named(g["g3"])),
                    rest(F.length(g["g0"])),
                ),
                F.concat(named(F.nullif(bare, F.lit(""))), rest(F.length(bare) + 1)),
                piece,
            ),
        )
        return (
            F.when(~F.startswith(piece, F.lit("&")), piece)
            .when(F.startswith(piece, F.lit("&amp;")), F.concat(F.lit("&"), rest(F.lit(5))))
            .when(F.startswith(piece, F.lit("&lt;")), F.concat(F.lit("<"), rest(F.lit(4))))
            .when(F.startswith(piece, F.lit("&gt;")), F.concat(F.lit(">"), rest(F.lit(4))))
            .when(F.startswith(piece, F.lit("&quot;")), F.concat(F.lit('"'), rest(F.lit(6))))
            .when(F.startswith(piece, F.lit("&nbsp;")), F.concat(F.lit("\u00a0"), rest(F.lit(6))))
            .when(F.startswith(piece, F.lit("&Tab;")), F.concat(F.lit("\t"), rest(F.lit(5))))
            .when(F.startswith(piece, F.lit("&NewLine;")), F.concat(F.lit("\n"), rest(F.lit(9))))
            .otherwise(other)
        )

    pieces = F.split(c, r"(?=&[#a-zA-Z])")
    return F.when(c.rlike(r"&[#a-zA-Z]"), F.array_join(F.transform(pieces, one), "")).otherwise(c)


# --- the whole ----------------------------------------------------------------


def _if_has(text: Column, needles: list[str], then: Column) -> Column:
    """``then`` where the text holds one of the substrings, else the text as it is."""
    found = F.contains(text, F.lit(needles[0]))
    for needle in needles[1:]:
        found = found | F.contains(text, F.lit(needle))
    return F.when(found, then).otherwise(text)


def _drop_held(html: Column) -> Column:
    return F.when(html.rlike(f"[{_SP}-{_LIST}]"), F.translate(html, _HELD, "")).otherwise(html)


def _drop_invisible(html: Column) -> Column:
    return F.regexp_replace(
        html,
        rf"(?is)<(?:!--.*?(?:-->|\z)|[!?][^>]*>|(script|style)\b{_ATTRS}>{_inside('script|style')}(?:</\1[^>]*>|\z))",
        "",
    )


def _collapse_space(html: Column) -> Column:
    return F.regexp_replace(html, r"[\t\r\n\f][ \t\r\n\f]*| [ \t\r\n\f]+", " ")


def _headings(html: Column) -> Column:
    out = F.regexp_replace(html, r"<[hH]([1-6])(?:\s[^>]*)?> *", f"\n\n{_H}$1")
    out = F.regexp_replace(out, r"</[hH][1-6]\s*>", "\n\n")
    for level in range(1, 7):
        out = F.replace(out, F.lit(f"{_H}{level}"), F.lit("#" * level + _SP))
    return F.when(html.rlike(r"<[hH][1-6]"), out).otherwise(html)


def _blocks(html: Column) -> Column:
    out = F.regexp_replace(html, r"<[bB][rR]\b[^>]*>", _SP + _SP + _NL)
    out = F.regexp_replace(out, r"<[hH][rR]\b[^>]*>", "\n\n---\n\n")
    return F.regexp_replace(out, rf"</?(?i:(?!blockquote)(?:{_BLOCK}))(?:[\s/][^>]*)?>", "\n\n")


def _tidy_lines(text: Column) -> Column:
    # The lookbehind keeps a long run of spaces from being tried once per space.
    return F.regexp_replace(_strip_tags(text), r"(?<! ) *+\n *", "\n")


def _tidy_breaks(text: Column) -> Column:
    """A break at the end of a block disappears."""
    out = F.regexp_replace(text, rf"(?<! ) *+({_SP}{_SP}{_NL}) *", "$1")
    return _if_has(text, [_NL], F.regexp_replace(out, rf"(?<!{_NL})(?:{_SP}{_SP}{_NL})++(?=\n|\z)", ""))


def _tidy_items(text: Column) -> Column:
    out = F.regexp_replace(text, rf"(?<![ \n])[ \n]*+{_LIST}[ \n]*{_ITEM}?", "\n\n")
    out = F.regexp_replace(out, rf"(?<![ \n])[ \n]*+{_ITEM}", "\n")
    return _if_has(text, [_GAP, _LIST], F.regexp_replace(out, rf"{_GAP}[ \n]*", _SP))


def _tidy_spaces(text: Column) -> Column:
    return _if_has(text, ["  "], F.regexp_replace(text, r" {2,}", " "))


def _release(text: Column) -> Column:
    out = F.btrim(F.regexp_replace(text, r"\n{3,}", "\n\n"), F.lit(" \n"))
    return replace_many(out, [(_SP, " "), (_NL, "\n"), (_LT, "<"), (_GT, ">")])


RENDER_STEPS = [
    _drop_held, _drop_invisible, _fenced, _inline, _collapse_space, _images, _encode_link_targets,
    _links, _emphasis, _tables, _lists, _headings, _blocks, _quotes, _tidy_lines, _tidy_breaks,
    _tidy_items, _tidy_spaces, _release, decode_entities,
]


def with_markdown(df: DataFrame, html: str, out: str = "markdown") -> DataFrame:
    """Add the raw markdown of an HTML column; ``""`` stays ``""``, NULL stays NULL."""
    df = df.withColumn(out, F.col(html))
    for step in RENDER_STEPS:
        df = df.withColumn(out, column_of(step, out))
    return df
