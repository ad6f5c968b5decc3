"""Page metadata from the head of a page and from its first JSON-LD script."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from pagepress import config
from pagepress.functions.text import blank_to_null, first_text, let, memo, trim
from pagepress.functions.urls import resolve_url

# Tags of a kind from their name up to ">", values of the attribute that is wanted going over a ">" in them. The
# loop takes every character once, also where no tag is ever closed: a run of broken tags is one tag.
_TAG = r"""(?i)<{tag}(?:[^>{first}]++|{attr}=["'][^"']*+["']|[^>])*+"""
# --- Fixed values: which tags and attributes carry metadata -------------------
_META_TAG = _TAG.format(tag="meta", first="cC", attr="content")
_META_ATTR = r"""(?i)(?:name|property|content)=["'][^"']*+["']"""
_LANGUAGE_TAG = _TAG.format(tag="html", first="lL", attr="lang")
_LANGUAGE_ATTR = r"""(?i)lang=["'][^"']++["']"""
_LINK_TAG = _TAG.format(tag="link", first="hH", attr="href")
_LINK_ATTR = r"""(?i)rel=["']canonical["']|href=["'][^"']*+["']"""
_TITLE_TAG = r"(?i)<title[^>]*+(?:>[^<]*+(?:</title>)?+)?+"
_SCRIPT_TAG = r"(?i)<script[^>]*+>?+"
_JSONLD_TYPE = r"""(?i)\A<script[^>]+type=["']application/ld\+json["']"""
_VALUE = r"""=["']([^"']*)"""


def head_slice(html: Column, fallback_chars: int | None = None) -> Column:
    """Text before the first ``</head>``, else the whole page, or its start if a limit is given."""
    end = F.locate("</head>", html)
    rest = html if fallback_chars is None else F.left(html, F.lit(fallback_chars))
    return F.when(end > 1, F.left(html, (end - 1))).otherwise(rest)


def _last_value(attrs: Column) -> Column:
    """Value of the last attribute in reach: a value that goes over a ``>`` ends the tag. NULL if there is none."""
    return let(
        F.coalesce(F.get(F.filter(attrs, lambda a: a.contains(">")), F.lit(0)), F.try_element_at(attrs, F.lit(-1))),
        lambda a: F.regexp_extract(a, _VALUE, 1),
    )


def meta_pairs(head: Column) -> Column:
    """``array<struct<name, value>>`` of all meta tags in order, names in lower case.

    One pass finds the tags and one over each tag its attributes; all names are looked up in the result.
    """

    def pairs(attrs: Column) -> Column:
        is_content = lambda a: a.rlike(r"(?i)\Acontent")
        return let(
            _last_value(F.filter(attrs, is_content)),
            lambda value: F.when(
                value.isNotNull(),
                F.transform(
                    F.filter(attrs, lambda a: ~is_content(a)),
                    lambda a: F.struct(F.lower(F.regexp_extract(a, _VALUE, 1)).alias("name"), value.alias("value")),
                ),
            ),
        )

    found = F.transform(
        F.regexp_extract_all(head, F.lit(_META_TAG), F.lit(0)),
        lambda tag: let(F.regexp_extract_all(tag, F.lit(_META_ATTR), F.lit(0)), pairs),
    )
    return F.flatten(F.filter(found, lambda ps: ps.isNotNull()))


def pick(pairs: Column, name: str) -> Column:
    """Value of the first pair with this name; ``""`` if there is none."""
    return F.coalesce(F.get(F.filter(pairs, lambda p: p["name"] == name), F.lit(0))["value"], F.lit(""))


def meta(head: Column, name: str) -> Column:
    """Content of the first meta tag with this name or property; ``""`` if there is none."""
    return pick(meta_pairs(head), name)


def title_tag(head: Column) -> Column:
    closed = F.filter(F.regexp_extract_all(head, F.lit(_TITLE_TAG), F.lit(0)), lambda t: t.rlike(r"(?i)</title>\z"))
    first = F.coalesce(F.get(closed, F.lit(0)), F.lit(""))
    return trim(F.regexp_extract(first, r"\A[^>]*+>([^<]*+)<", 1))


def page_title(head: Column) -> Column:
    return let(
        meta_pairs(head),
        lambda ps: F.coalesce(first_text(pick(ps, "og:title"), pick(ps, "twitter:title"), title_tag(head)), F.lit("")),
    )


def page_description(head: Column) -> Column:
    return let(
        meta_pairs(head),
        lambda ps: F.coalesce(first_text(pick(ps, "description"), pick(ps, "og:description")), F.lit("")),
    )


def _first_of_tags(text: Column, tag: str, of: Callable[[Column], Column]) -> Column:
    """What ``of`` gives for the first tag for which it is not NULL."""
    found = F.transform(F.regexp_extract_all(text, F.lit(tag), F.lit(0)), of)
    return F.get(F.filter(found, lambda v: v.isNotNull()), F.lit(0))


def language(head: Column) -> Column:
    return _first_of_tags(
        head, _LANGUAGE_TAG, lambda tag: let(F.regexp_extract_all(tag, F.lit(_LANGUAGE_ATTR), F.lit(0)), _last_value)
    )


def _canonical_of(attrs: Column) -> Column:
    """The last href behind a rel attribute, unless an href before it has ended the tag."""
    is_rel = lambda a: a.rlike(r"(?i)\Arel")
    rel = F.array_position(F.transform(attrs, is_rel), F.lit(True)).cast("int")
    behind = F.filter(F.slice(attrs, rel, F.size(attrs)), lambda a: ~is_rel(a))
    ended = F.exists(F.slice(attrs, F.lit(1), rel), lambda a: a.contains(">"))
    return F.when((rel > 0) & ~ended, _last_value(behind))


def canonical(head: Column, base_url: Column) -> Column:
    """Canonical link made absolute; as written when it cannot be resolved."""
    found = _first_of_tags(
        head, _LINK_TAG, lambda tag: let(F.regexp_extract_all(tag, F.lit(_LINK_ATTR), F.lit(0)), _canonical_of)
    )
    return let(
        blank_to_null(found),
        lambda href: F.when(href.isNotNull(), F.coalesce(resolve_url(href, base_url), href)),
    )


def keywords(head: Column) -> Column:
    return _keywords_of(meta(head, "keywords"))


def _keywords_of(content: Column) -> Column:
    return let(
        blank_to_null(content),
        lambda kw: F.filter(F.transform(F.split(kw, ","), trim), lambda k: k != ""),
    )


def jsonld_text(html: Column) -> Column:
    """Body of the first JSON-LD script of the whole page, NULL if there is none."""
    tags = F.regexp_extract_all(html, F.lit(_SCRIPT_TAG), F.lit(0))
    first = F.get(F.filter(tags, lambda t: F.endswith(t, F.lit(">")) & t.rlike(_JSONLD_TYPE)), F.lit(0))

    def body(tag: Column) -> Column:
        # The tag's text stands nowhere before it: what held it there would have been the first such tag.
        rest = F.substr(html, F.position(tag, html) + F.length(tag))
        return let(F.split(rest, "(?i)</script>", 2), lambda parts: F.when(F.size(parts) > 1, parts[0]))

    return F.when(html.rlike("(?i)application/ld\\+json"), blank_to_null(let(first, body)))


def _name_of(node: Column, field: str, nested: str) -> Column:
    """A text field, or the nested text of an object field; anything else is absent."""
    return let(
        F.try_variant_get(node, f"$.{field}", "variant"),
        lambda v: blank_to_null(
            F.when(F.schema_of_variant(v) == "STRING", v.try_cast("string")).otherwise(
                F.try_variant_get(v, f"$.{nested}", "string")
            )
        ),
    )


def jsonld_node(text: Column) -> Column:
    """Parsed JSON-LD: the first article-like item of ``@graph``, else the whole value."""

    def pick(data: Column) -> Column:
        items = F.try_variant_get(data, '$["@graph"]', "array<variant>")
        typed = F.filter(
            items,
            lambda i: (F.schema_of_variant(F.try_variant_get(i, '$["@type"]', "variant")) == "STRING")
            & F.try_variant_get(i, '$["@type"]', "string").isin(config.JSONLD_GRAPH_TYPES),
        )
        return F.coalesce(F.get(typed, F.lit(0)), data)

    return let(F.try_parse_json(text), pick)


def jsonld_fields(text: Column) -> Column:
    """Struct of the five JSON-LD fields; every field is NULL when the text does not parse."""
    return let(
        jsonld_node(text),
        lambda node: F.struct(
            _name_of(node, "author", "name").alias("author"),
            blank_to_null(F.try_variant_get(node, "$.datePublished", "string")).alias("date_published"),
            blank_to_null(F.try_variant_get(node, "$.dateModified", "string")).alias("date_modified"),
            _name_of(node, "publisher", "name").alias("publisher"),
            _name_of(node, "image", "url").alias("image"),
        ),
    )


@memo
def _head_columns(html: str) -> dict[str, Column]:
    return {"__head": head_slice(F.col(html)), "__ld_text": jsonld_text(F.col(html))}


@memo
def _tag_columns() -> dict[str, Column]:
    head = F.col("__head")
    return {
        "__ld": jsonld_fields(F.col("__ld_text")),
        "__meta": meta_pairs(head),
        "__tag_title": blank_to_null(title_tag(head)),
    }


@memo
def _metadata_columns(url: str) -> dict[str, Column]:
    head, ld = F.col("__head"), F.col("__ld")

    def own(name: str) -> Column:
        return blank_to_null(pick(F.col("__meta"), name))

    return {
        "title": F.coalesce(
            own("og:title"),
            own("twitter:title"),
            F.col("__tag_title"),
            F.lit(""),
        ),
        "description": F.coalesce(
            own("description"), own("og:description"), F.lit("")
        ),
        "metadata": F.struct(
            F.coalesce(own("og:title"), F.col("__tag_title")).alias("title"),
            own("description").alias("description"),
            language(head).alias("language"),
            canonical(head, F.col(url)).alias("canonical"),
            F.coalesce(own("author"), ld["author"]).alias("author"),
            _keywords_of(pick(F.col("__meta"), "keywords")).alias("keywords"),
            own("og:type").alias("og_type"),
            own("og:site_name").alias("og_site_name"),
            ld["date_published"].alias("date_published"),
            ld["date_modified"].alias("date_modified"),
            ld["publisher"].alias("publisher"),
            F.coalesce(own("og:image"), ld["image"]).alias("image"),
        ),
    }


def with_metadata(df: DataFrame, html: str = "html", url: str = "url_key") -> DataFrame:
    """Add ``title``, ``description`` and a ``metadata`` struct to a page table."""
    return (
        df.withColumns(_head_columns(html))
        .withColumns(_tag_columns())
        .withColumns(_metadata_columns(url))
        .drop("__head", "__ld", "__ld_text", "__meta", "__tag_title")
    )
