"""URL normalization and resolution as Column expressions.

Covered: special-scheme parsing, host case, default ports, dot segments, percent-encoding,
host names in all their spellings (see :mod:`pagepress.functions.hosts`), form re-serialization of the
query.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagepress import config
from pagepress.functions.hosts import canonical_host
from pagepress.functions.text import let, scan_strings

# Characters that the URL Standard percent-encodes in each part.
_CONTROL = r"\x00-\x1F\x7F-\x{10FFFF}"
_PATH_SET = _CONTROL + r' "#<>?^`{}'
_QUERY_SET = _CONTROL + r""" "#<>'"""
_FRAGMENT_SET = _CONTROL + r' "<>`'

_SPECIAL = r"(?is)\A(https?):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?\z"
_OTHER = r"(?s)\A([a-zA-Z][a-zA-Z0-9+.\-]*):([^?#]*)(\?[^#]*)?(#.*)?\z"
_DOT_SEGMENT = r"(?i)(?:^|/)(?:\.|%2e){1,2}(?:/|$)"


def _clean(c: Column) -> Column:
    """What a URL parser ignores: control characters around, tabs and newlines inside."""
    return F.regexp_replace(F.regexp_replace(c, r"\A[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\n\r]", "")


def _percent_encode(c: Column, charset: str) -> Column:
    runs = F.regexp_extract_all(c, F.lit(f"[{charset}]+|[^{charset}]+"), F.lit(0))
    encoded = F.transform(
        runs,
        lambda r: F.when(
            r.rlike(rf"\A[{charset}]"), F.replace(F.url_encode(r), F.lit("+"), F.lit("%20"))
        ).otherwise(r),
    )
    return F.when(c.rlike(f"[{charset}]"), F.array_join(encoded, "")).otherwise(c)


def _resolve_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments of an absolute path."""
    dots = F.transform(
        F.split(F.substr(path, F.lit(2)), "/"),
        lambda s: F.when(s.rlike(r"(?i)\A(?:\.|%2e)\z"), ".")
        .when(s.rlike(r"(?i)\A(?:\.|%2e){2}\z"), "..")
        .otherwise(s),
    )

    # From the right, so that the state is the number of segments still to be dropped. Text is put together
    # backwards and turned round once.
    def join(segments: Column) -> Column:
        is_dot = lambda segment: segment.isin(".", "..")
        kept = scan_strings(
            F.reverse(segments),
            F.lit(0),
            lambda pending, segment: F.when(segment == ".", pending)
            .when(segment == "..", pending + 1)
            .otherwise(F.greatest(pending - 1, F.lit(0))),
            lambda segment, pending, _: F.when(is_dot(segment) | (pending > 0), "").otherwise(
                F.reverse(F.concat(F.lit("/"), segment))
            ),
        )
        return F.concat(F.reverse(kept), F.when(is_dot(F.element_at(segments, -1)), "/").otherwise(""))

    return F.when(path.rlike(_DOT_SEGMENT), let(dots, join)).otherwise(path)


def _path(raw: Column) -> Column:
    slashed = F.translate(raw, "\\", "/")
    rooted = F.when(F.startswith(slashed, F.lit("/")), slashed).otherwise(F.concat(F.lit("/"), slashed))
    return _percent_encode_let(rooted)


def _percent_encode_let(rooted: Column) -> Column:
    return let(rooted, lambda p: let(_resolve_dots(p), lambda q: _percent_encode(q, _PATH_SET)))


def split_url(c: Column) -> Column:
    """Struct ``(scheme, auth, host, port, path, query, fragment)`` of an http(s) URL, or NULL.

    ``query`` and ``fragment`` keep their leading mark and are NULL when absent.
    """

    def build(u: Column) -> Column:
        def part(i: int) -> Column:
            return F.regexp_extract(u, _SPECIAL, i)

        def hosted(authority: Column) -> Column:
            at = F.regexp_extract(authority, r"(?s)\A(.*@)", 1)
            return let(
                F.struct(at.alias("auth"), F.substr(authority, F.length(at) + 1).alias("hp")),
                lambda a: let(
                    F.struct(
                        F.lower(part(1)).alias("scheme"),
                        a["auth"].alias("auth"),
                        canonical_host(F.regexp_extract(a["hp"], r"\A(\[[^\]]*\]|[^:]*)", 1)).alias("host"),
                        F.regexp_replace(
                            F.regexp_extract(a["hp"], r":([^:\]]*)\z", 1), r"\A0+(?=\d)", ""
                        ).alias("port"),
                        a["hp"].rlike(r"\A(?:\[[0-9a-fA-F:.]+\]|[^:\[\]]+)(?::\d*)?\z").alias("ok"),
                    ),
                    lambda h: F.when(
                        h["ok"]
                        & h["host"].isNotNull()
                        & F.when(h["port"] == "", True)
                        .when(F.length(h["port"]) <= 5, h["port"].cast("int") <= 65535)
                        .otherwise(False),
                        F.struct(
                            h["scheme"].alias("scheme"),
                            h["auth"].alias("auth"),
                            h["host"].alias("host"),
                            F.when(
                                ((h["scheme"] == "http") & (h["port"] == "80"))
                                | ((h["scheme"] == "https") & (h["port"] == "443")),
                                "",
                            )
                            .otherwise(h["port"])
                            .alias("port"),
                            _path(part(3)).alias("path"),
                            F.nullif(part(4), F.lit("")).alias("query"),
                            F.nullif(part(5), F.lit("")).alias("fragment"),
                        ),
                    ),
                ),
            )

        return F.when(u.rlike(_SPECIAL), let(part(2), hosted))

    return let(_clean(c), build)


def _authority(p: Column) -> Column:
    return F.concat(
        p["auth"], p["host"], F.when(p["port"] != "", F.concat(F.lit(":"), p["port"])).otherwise("")
    )


def _form_decode(c: Column) -> Column:
    """Percent-decode; a ``%`` without two hex digits stands for itself."""
    return F.url_decode(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25"))


def form_query(query: Column) -> Column:
    """Drop tracking parameters, sort by name (stable), re-serialize; ``""`` if none is left."""
    pairs = F.transform(
        F.filter(F.split(F.regexp_replace(query, r"\A\?", ""), "&"), lambda p: p != ""),
        lambda p, i: F.struct(
            _form_decode(F.regexp_extract(p, r"(?s)\A([^=]*)", 1)).alias("name"),
            i.alias("at"),
            _form_decode(F.regexp_extract(p, r"(?s)\A[^=]*=(.*)", 1)).alias("value"),
        ),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~p["name"].isin(config.TRACKING_PARAMS)))
    text = F.array_join(
        F.transform(
            kept, lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"]))
        ),
        "&",
    )
    return F.when(query.isNull(), "").otherwise(
        let(text, lambda t: F.when(t == "", "").otherwise(F.concat(F.lit("?"), t)))
    )


def with_scheme(c: Column) -> Column:
    """Prefix ``https://`` unless the text starts with lower-case ``http``."""
    return F.when(F.startswith(c, F.lit("http")), c).otherwise(F.concat(F.lit("https://"), c))


def normalize_url(c: Column) -> Column:
    """Cache key of a URL: https, lower-case host, no default port, no fragment, no tracking
    parameters, sorted query, one trailing slash less. Unparsable input comes back as it is
    (with its scheme)."""

    def build(raw: Column) -> Column:
        def serialize(p: Column) -> Column:
            head = F.concat(
                F.lit("https://"),
                p["auth"],
                p["host"],
                F.when((p["port"] == "") | p["port"].isin("80", "443"), "").otherwise(
                    F.concat(F.lit(":"), p["port"])
                ),
            )
            return let(
                F.concat(head, p["path"], form_query(p["query"])),
                lambda u: F.when(
                    F.endswith(u, F.lit("/")) & (p["path"] != "/"), F.left(u, F.length(u) - 1)
                ).otherwise(u),
            )

        def opaque(u: Column) -> Column:
            # A scheme such as "http-x:" keeps itself and its path; only query and fragment change.
            text = let(
                F.concat(
                    F.lower(F.regexp_extract(u, _OTHER, 1)),
                    F.lit(":"),
                    F.regexp_extract(u, _OTHER, 2),
                    form_query(F.nullif(F.regexp_extract(u, _OTHER, 3), F.lit(""))),
                ),
                lambda t: F.when(F.endswith(t, F.lit("/")), F.left(t, F.length(t) - 1)).otherwise(t),
            )
            return F.when(u.rlike(_OTHER) & ~u.rlike(r"(?i)\Ahttps?:"), text)

        return F.coalesce(let(split_url(raw), serialize), let(_clean(raw), opaque), raw)

    return let(with_scheme(c), build)


def _absolute(p: Column) -> Column:
    return F.concat(
        p["scheme"],
        F.lit("://"),
        _authority(p),
        p["path"],
        F.coalesce(_percent_encode(p["query"], _QUERY_SET), F.lit("")),
        F.coalesce(_percent_encode(p["fragment"], _FRAGMENT_SET), F.lit("")),
    )


# Possessive, as a link may have any length and a greedy loop over alternatives recurses for each character.
_PLAIN_PATH = r"\A/(?!/)(?:[A-Za-z0-9_~\-]++|/(?!\.)|(?<!/)\.)*+\z"


def resolve_url(reference: Column, base: Column) -> Column:
    """Absolute form of ``reference`` against a normalized page URL, or NULL if it has none."""
    origin = F.regexp_extract(base, r"\A([a-z]+://[^/?#]*)", 1)
    base_path = F.regexp_extract(base, r"\A[a-z]+://[^/?#]*([^?#]*)", 1)
    base_query = F.regexp_extract(base, r"\A[^?#]*(\?[^#]*)?", 1)
    folder = F.regexp_extract(base_path, r"(?s)\A(.*/)", 1)

    scheme = F.regexp_extract(base, r"\A([a-z]+):", 1)

    def full(s: Column) -> Column:
        """The reference as an absolute http(s) URL that still has to be cleaned up."""
        return (
            F.when(s.rlike(r"(?i)\Ahttps?:"), s)
            .when(s.rlike(r"\A[/\\]{2}"), F.concat(scheme, F.lit(":"), s))
            .when(F.startswith(s, F.lit("?")), F.concat(origin, base_path, s))
            .when((s == "") | F.startswith(s, F.lit("#")), F.concat(origin, base_path, base_query, s))
            .when(s.rlike(r"\A[/\\]"), F.concat(origin, s))
            .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), s))
        )

    def build(r: Column) -> Column:
        # "https:foo" without slashes is relative when the page has the same scheme.
        same_scheme = F.lower(F.regexp_extract(r, r"(?i)\A(https?):(?![/\\])", 1)) == scheme
        return let(
            F.when(same_scheme, F.regexp_replace(r, r"(?i)\Ahttps?:", "")).otherwise(r),
            lambda s: F.when(s.rlike(_PLAIN_PATH), F.concat(origin, s))
            .when(
                s.rlike(r"\A[a-zA-Z][a-zA-Z0-9+.\-]*:") & ~s.rlike(r"(?i)\Ahttps?:"),
                F.concat(
                    F.lower(F.regexp_extract(s, r"\A([^:]*:)", 1)),
                    F.regexp_extract(s, r"(?s)\A[^:]*:(.*)", 1),
                ),
            )
            .otherwise(let(split_url(full(s)), _absolute)),
        )

    return F.when(base.rlike(r"\Ahttps?://"), let(_clean(reference), build))
