"""Tokens of an HTML text, element rules, element removal and link rewriting.

A page stays one row. Its tokens are an array inside the row, so none of this needs a
shuffle; :func:`token_table` explodes the same array for users who want rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import cache

from pyspark.sql import Column, DataFrame, functions as F

from pagepress import config
from pagepress.functions.text import WS, let, scan_strings
from pagepress.functions.urls import resolve_url

# Attributes inside a tag: quoted values may hold ">". A quote opens a value only right after "=";
# elsewhere it is an ordinary character. Possessive, so that long tags neither backtrack nor recurse.
_ATTRS = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
# Elements whose body holds no tags.
RAW_TAGS = ["script", "style", "iframe", "textarea", "title", "xmp", "noembed", "noframes", "noscript"]
_RAW = "|".join(RAW_TAGS)


def _token_pattern(raw: str, foreign: str = "(?!)") -> str:
    """Text, comments and tags; an element with one of these names is one token up to its close."""
    return (
        r"[^<]++"
        r"|<(?:"
        r"(?s:!--.*?(?:-->|\z))"
        r"|[!?][^>]*+>?"
        rf"|(?i:({raw})(?=[\s/>]){_ATTRS}>[^<]*+(?:<(?!/\1[\s/>])[^<]*+)*+(?:</\1[^>]*+>|\z))"
        rf"|(?i:({foreign})(?=[\s/>]){_ATTRS}(?<!/)>[^<]*+(?:<(?!/\2[\s/>])[^<]*+)*+(?:</\2[^>]*+>|\z))"
        rf"|/?[a-zA-Z]{_ATTRS}>"
        r"|/?[a-zA-Z][^>]*+>"
        r")"
        r"|<"
    )


_TOKEN = _token_pattern(_RAW)
# Inside svg and math no body is raw, and "/>" closes. Such a part is taken whole first, then for itself.
_FOREIGN = r"<(?i:svg|math)(?=[\s/>])"
_TOKEN_OR_FOREIGN = _token_pattern(_RAW, "svg|math")
_FOREIGN_TOKEN = _token_pattern("(?!)")
_ATTR = r"""(?s)([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?"""

# Elements without content in HTML.
VOID_TAGS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
    "track", "wbr",
]


def _attributes(tag_text: Column) -> Column:
    """``array<struct<name,value>>`` of a tag, first one wins; value NULL when absent."""
    inner = F.regexp_replace(tag_text, r"\A<[a-zA-Z][^\s/>]*|/?>\z", "")
    texts = F.regexp_extract_all(inner, F.lit(_ATTR), F.lit(0))
    pairs = F.transform(
        texts,
        lambda t: F.struct(
            F.lower(F.regexp_extract(t, _ATTR, 1)).alias("name"),
            F.when(
                t.contains("="),
                F.regexp_replace(F.regexp_extract(t, _ATTR, 2), r"""(?s)\A(["'])(.*)\1\z""", "$2"),
            ).alias("value"),
        ),
    )
    return let(
        pairs,
        lambda ps: F.filter(
            ps, lambda p, i: F.array_position(F.transform(ps, lambda q: q["name"]), p["name"]) == i + 1
        ),
    )


def tokens(html: Column) -> Column:
    """``array<struct<kind, tag, attrs, text>>``; the texts joined give back the input.

    Kinds: ``text``, ``open``, ``close``, ``raw`` (an element of ``RAW_TAGS`` with its body),
    ``comment`` (also doctype). A foreign part (svg, math) ends at the first close tag of its name.
    """

    def token(t: Column) -> Column:
        second = F.substr(t, F.lit(2), F.lit(1))
        kind = (
            F.when(~F.startswith(t, F.lit("<")), "text")
            .when(second == "/", F.when(t.rlike(r"\A</[a-zA-Z]"), "close").otherwise("text"))
            .when(second.isin("!", "?"), "comment")
            .when(t.rlike(rf"(?i)\A<(?:{_RAW})(?=[\s/>]){_ATTRS}>[\s\S]"), "raw")
            .when(t.rlike(r"\A<[a-zA-Z]"), "open")
            .otherwise("text")
        )
        tag = F.when(
            F.startswith(t, F.lit("<")),
            F.nullif(F.lower(F.regexp_extract(t, r"\A</?([a-zA-Z][^\s/>]*)", 1)), F.lit("")),
        )
        attrs = F.when(
            t.rlike(r"\A<[a-zA-Z][^\s/>]*[\s/]"),
            _attributes(F.regexp_extract(t, rf"\A<[a-zA-Z]{_ATTRS}>|\A<[a-zA-Z][^>]*+>", 0)),
        )
        return F.struct(kind.alias("kind"), tag.alias("tag"), attrs.alias("attrs"), t.alias("text"))

    def parts(pattern: str, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    inside = F.flatten(
        F.transform(
            parts(_TOKEN_OR_FOREIGN, html),
            lambda t: F.when(t.rlike(r"\A" + _FOREIGN), parts(_FOREIGN_TOKEN, t)).otherwise(F.array(t)),
        )
    )
    return F.transform(F.when(html.rlike(_FOREIGN), inside).otherwise(parts(_TOKEN, html)), token)


def token_table(df: DataFrame, html: str = "content", key: str = "page_id") -> DataFrame:
    """One row per token: ``key, pos, kind, tag, attrs, text``."""
    return df.select(key, F.posexplode(tokens(F.col(html))).alias("pos", "t")).select(
        key, "pos", "t.*"
    )


Rules = tuple[tuple[config.Condition, ...], ...]
DEFAULT_RULES: Rules = tuple((rule,) for rule in config.exclude_rules())


def rules_of(selectors: Iterable[str]) -> Rules:
    """Selectors as rules; an element is excluded if it meets all conditions of one of them."""
    return tuple(dict.fromkeys(config.selector(s) for s in selectors))


def _simple(kind: str, rules: Rules) -> list[config.Condition]:
    return [rule[0] for rule in rules if len(rule) == 1 and rule[0][0] == kind]


def _names(kind: str, rules: Rules) -> list[str]:
    return [name for _, name, _ in _simple(kind, rules)]


def attribute(attrs: Column, name: str) -> Column:
    return F.get(F.filter(attrs, lambda a: a["name"] == name), F.lit(0))["value"]


def matches_tag(tag: Column, rules: Rules = DEFAULT_RULES) -> Column:
    return F.coalesce(tag.isin(_names("tag", rules)), F.lit(False))


def matches_class(attrs: Column, rules: Rules = DEFAULT_RULES) -> Column:
    names = _names("class", rules)
    classes = F.split(attribute(attrs, "class"), f"[{WS}]+")
    return F.coalesce(F.arrays_overlap(classes, F.array(*map(F.lit, names))), F.lit(False)) if names else F.lit(False)


def matches_id(attrs: Column, rules: Rules = DEFAULT_RULES) -> Column:
    return F.coalesce(attribute(attrs, "id").isin(_names("id", rules)), F.lit(False))


def matches_attribute(attrs: Column, rules: Rules = DEFAULT_RULES) -> Column:
    wanted: dict[str, list[str | None]] = {}
    for _, name, value in _simple("attr", rules):
        wanted.setdefault(name, []).append(value)

    def hit(a: Column) -> Column:
        found = F.lit(False)
        for name, values in wanted.items():
            same = a["name"] == name
            found = found | (same if None in values else same & a["value"].isin(values))
        return F.coalesce(found, F.lit(False))

    return F.coalesce(F.exists(attrs, hit), F.lit(False)) if wanted else F.lit(False)


def _matches_all(token: Column, rule: tuple[config.Condition, ...]) -> Column:
    """A rule of several conditions, each taken as a rule of its own."""
    met = F.lit(True)
    for condition in rule:
        met = met & _matches_one(token, ((condition,),), condition[0])
    return met


def _matches_one(token: Column, rules: Rules, kind: str) -> Column:
    if kind == "tag":
        return matches_tag(token["tag"], rules)
    return {"class": matches_class, "id": matches_id, "attr": matches_attribute}[kind](token["attrs"], rules)


def is_excluded(token: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """Does a rule match this opening (or raw) token?"""
    attributes = _matches_one(token, rules, "class") | _matches_one(token, rules, "id") | _matches_one(token, rules, "attr")
    for rule in rules:
        if len(rule) > 1:
            attributes = attributes | _matches_all(token, rule)
    return F.when(
        token["kind"].isin("open", "raw"),
        matches_tag(token["tag"], rules) | F.when(F.size(token["attrs"]) > 0, attributes).otherwise(False),
    ).otherwise(False)


def _may_match(html: Column, rules: Rules) -> Column:
    """Could any rule match? Looks for the tags and attribute names of the rules."""
    conditions = [c for rule in rules for c in rule]
    tags = dict.fromkeys(re.escape(name) for kind, name, _ in conditions if kind == "tag")
    attrs = dict.fromkeys(re.escape(name if kind == "attr" else kind) for kind, name, _ in conditions if kind != "tag")
    marks = [rf"<(?:{'|'.join(tags)})\b"] * bool(tags) + [rf"[\s/\"'](?:{'|'.join(attrs)})\b"] * bool(attrs)
    return html.rlike(f"(?i:{'|'.join(marks)})") if marks else F.lit(False)


def _open_tags(stack: Column) -> Column:
    return F.aggregate(stack, F.lit(0), lambda n, run: n + run["n"])


def _push(stack: Column, tag: Column) -> Column:
    """The stack with one more tag. It holds runs of equal tags, innermost first, as each step copies it."""
    head = F.get(stack, F.lit(0))
    run = lambda n: F.array(F.struct(tag.alias("tag"), n.alias("n")))
    return F.when(head["tag"] == tag, F.concat(run(head["n"] + 1), F.slice(stack, F.lit(2), F.size(stack)))).otherwise(
        F.concat(run(F.lit(1)), stack)
    )


def _pop(stack: Column, tag: Column) -> Column:
    """The stack without the innermost tag of this name and those inside it; NULL if there is none."""
    place = F.array_position(F.transform(stack, lambda run: run["tag"]), tag).cast("int")

    def behind(at: Column) -> Column:
        left = F.slice(stack, at + 1, F.size(stack))
        n = F.get(stack, at - 1)["n"]
        return F.when(at == 0, None).when(n == 1, left).otherwise(
            F.concat(F.array(F.struct(tag.alias("tag"), (n - 1).alias("n"))), left)
        )

    return let(place, behind)


def _advance(state: Column, t: Column) -> Column:
    """The state behind a token: the stack of open tags and, while removing, the depth at which that began.

    A close tag ends the innermost open tag of its name with all inside it, so an excluded element without a
    close ends with the innermost enclosing element that has one.
    """

    def of(stack: Column, removed_at: Column) -> Column:
        return F.struct(stack.alias("stack"), removed_at.alias("removed_at"))

    def closed(left: Column) -> Column:
        ends = (state["removed_at"] > 0) & (_open_tags(left) < state["removed_at"])
        return F.when(left.isNull(), state).otherwise(of(left, F.when(ends, 0).otherwise(state["removed_at"])))

    begins = t["excluded"] & (state["removed_at"] == 0)
    depth = F.when(begins, _open_tags(state["stack"]) + 1).otherwise(state["removed_at"])
    return (
        F.when(t["role"] == "close", let(_pop(state["stack"], t["tag"]), closed))
        .when(t["role"] == "open", of(_push(state["stack"], t["tag"]), depth))
        .otherwise(state)
    )


def _emitted(t: Column, before: Column, after: Column) -> Column:
    """The token's text, unless it lies in an excluded element or is its tag."""
    removing = before["removed_at"] > 0
    # An enclosing element's close ends the removal and stays; the element's own close goes.
    ended_from_outside = (after["removed_at"] == 0) & (_open_tags(after["stack"]) + 1 < before["removed_at"])
    return F.when(removing, F.when(ended_from_outside, t["text"]).otherwise("")).when(t["excluded"], "").otherwise(t["text"])


def _roles(toks: Column, foreign: Column, rules: Rules) -> Column:
    """``array<struct<role, tag, excluded, text>>``: open and close for tags that matter to the stack.

    Tags that are never closed end nothing, and closes of tags that are never opened nothing either.
    """

    def names(kind: str) -> Column:
        return F.array_distinct(F.transform(F.filter(toks, lambda t: t["kind"] == kind), lambda t: t["tag"]))

    def of(closes: Column, opens: Column) -> Column:
        def role(t: Column) -> Column:
            empty = t["tag"].isin(VOID_TAGS) | (foreign & F.endswith(t["text"], F.lit("/>")))
            excluded = is_excluded(t, rules)
            return F.struct(
                F.when((t["kind"] == "close") & F.array_contains(opens, t["tag"]), "close")
                .when((t["kind"] == "open") & ~empty & (excluded | F.array_contains(closes, t["tag"])), "open")
                .otherwise("other")
                .alias("role"),
                t["tag"].alias("tag"),
                excluded.alias("excluded"),
                t["text"].alias("text"),
            )

        return F.transform(toks, role)

    return let(names("close"), lambda closes: let(names("open"), lambda opens: of(closes, opens)))


def _strip(toks: Column, rules: Rules) -> Column:
    """Text without the excluded elements; NULL when none is there."""
    # Only inside svg or math does "/>" close an element. Looked up once, not per token.
    foreign = F.exists(toks, lambda t: (t["kind"] == "open") & t["tag"].isin("svg", "math"))
    start = F.struct(F.array().cast("array<struct<tag:string,n:int>>").alias("stack"), F.lit(0).alias("removed_at"))
    return let(
        let(foreign, lambda f: _roles(toks, f, rules)),
        lambda ts: F.when(F.exists(ts, lambda t: t["excluded"]), scan_strings(ts, start, _advance, _emitted)),
    )


def strip_elements(html: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """Remove every element that a rule matches, with all its contents."""
    kept = F.coalesce(let(tokens(html), lambda toks: _strip(toks, rules)), html)
    return F.when(_may_match(html, rules), kept).otherwise(html)


@cache
def stripper(selectors: tuple[str, ...]) -> Callable[[Column], Column]:
    """:func:`strip_elements` for other selectors; the same function for the same selectors."""
    rules = rules_of(selectors)
    return lambda html: strip_elements(html, rules)


# Up to the wanted attribute; every loop is possessive, so a long tag cannot exhaust the stack.
BEFORE_ATTR = r"""(?:[^>=\s]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|\s++(?!{name}\s*=))*+\s++{name}\s*="""
_LINK = (
    rf"(?is)\A(<(?:(?:a|link)(?=[\s/]){BEFORE_ATTR.format(name='href')}|img(?=[\s/]){BEFORE_ATTR.format(name='src')})\s*)"
    r"""("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
)


def absolutize_links(html: Column, base: Column) -> Column:
    """Make ``href`` of a and link and ``src`` of img absolute; leave what has no absolute form."""
    pieces = F.split(html, r"(?=<(?i:a|img|link)[\s/])")

    def rewrite(piece: Column) -> Column:
        parts = F.struct(
            F.regexp_extract(piece, _LINK, 1).alias("head"),
            F.regexp_extract(piece, _LINK, 2).alias("raw"),
        )

        def with_target(p: Column) -> Column:
            value = F.regexp_replace(p["raw"], r"""(?s)\A(["'])(.*)\1\z""", "$2")
            skip = F.when(p["head"].rlike(r"(?i)\A<img"), value.rlike(r"\Adata:")).otherwise(
                value.rlike(r"\A(?:#|mailto:)")
            )
            return F.when((p["head"] == "") | (value == "") | skip, piece).otherwise(
                F.coalesce(
                    F.concat(
                        p["head"],
                        F.lit('"'),
                        resolve_url(value, base),
                        F.lit('"'),
                        F.substr(piece, F.length(p["head"]) + F.length(p["raw"]) + 1),
                    ),
                    piece,
                )
            )

        return F.when(F.startswith(piece, F.lit("<")), let(parts, with_target)).otherwise(piece)

    return F.when(
        html.rlike(r"<(?i:a|img|link)[\s/]"), F.array_join(F.transform(pieces, rewrite), "")
    ).otherwise(html)


def link_table(
    df: DataFrame, html: str = "html", base: str = "url_key", key: str = "page_id"
) -> DataFrame:
    """One row per link: ``key, pos, tag, href, target`` with the absolute target."""
    links = F.filter(
        F.transform(
            tokens(F.col(html)),
            lambda t, i: F.struct(
                i.alias("pos"),
                t["tag"].alias("tag"),
                F.when(t["tag"] == "img", attribute(t["attrs"], "src"))
                .otherwise(attribute(t["attrs"], "href"))
                .alias("href"),
                (t["kind"] == "open").alias("is_open"),
            ),
        ),
        lambda l: l["is_open"] & l["tag"].isin("a", "img", "link") & (l["href"] != ""),
    )
    skipped = F.when(F.col("tag") == "img", F.col("href").rlike(r"\Adata:")).otherwise(
        F.col("href").rlike(r"\A(?:#|mailto:)")
    )
    return (
        df.select(key, F.col(base).alias("__base"), F.explode(links).alias("l"))
        .select(key, "__base", "l.pos", "l.tag", "l.href")
        .select(
            key,
            "pos",
            "tag",
            "href",
            F.when(skipped, F.col("href"))
            .otherwise(F.coalesce(resolve_url(F.col("href"), F.col("__base")), F.col("href")))
            .alias("target"),
        )
    )
