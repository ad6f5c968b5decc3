"""Fallback text from the flight data that script-rendered pages embed."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagepress import config
from pagepress.functions.text import let, replace_many, trim

MARK = "__next_f"

# --- Fixed values: what counts as a payload, a heading and a body text --------
_SCRIPT, _SCRIPT_END = r"(?i)<script", r"(?i)</script>"
_PUSH = r'self\.__next_f\.push\(\[1,"([^"\\]*+(?:\\.[^"\\]*+)*+)"\]\)'
_HEADING = r'"as"\s*:\s*"(h[1-6])"[^}]*?"children"\s*:\s*"([^"]{%d,})"'
_BODY = r'"children"\s*:\s*"([^"]{%d,})"'
_TEXT_ESCAPES = [("\\\\n", "\n"), ('\\\\"', '"'), ('\\"', '"'), ("\\\\", "\\")]
_CLEAN_ESCAPES = [("\\n", " "), ("\\t", " "), ('\\"', '"'), ("\\\\", "\\")]


def has_flight(html: Column) -> Column:
    return F.contains(html, F.lit(MARK))


def payloads(html: Column) -> Column:
    """All pushed payloads in order; NULL for pages without the mark."""
    # Text up to each close; a script's body begins behind the tag that opens first in it.
    ended = let(F.split(html, _SCRIPT_END), lambda parts: F.slice(parts, F.lit(1), F.size(parts) - 1))

    def body(part: Column) -> Column:
        return let(
            F.get(F.split(part, _SCRIPT, 2), F.lit(1)),
            lambda rest: let(F.position(F.lit(">"), rest), lambda at: F.when(at > 0, F.substr(rest, at + 1))),
        )

    scripts = F.filter(F.transform(F.filter(ended, has_flight), body), lambda s: F.coalesce(has_flight(s), F.lit(False)))
    pushed = F.transform(scripts, lambda s: F.regexp_extract_all(s, F.lit(_PUSH), F.lit(1)))
    return F.when(has_flight(html), F.flatten(pushed))


def flight_text(pushed: Column) -> Column:
    return replace_many(F.array_join(pushed, "\n"), _TEXT_ESCAPES)


def clean_text(c: Column) -> Column:
    return trim(replace_many(c, _CLEAN_ESCAPES))


def elements(
    text: Column,
    min_heading: int = config.FLIGHT_MIN_HEADING,
    min_body: int = config.FLIGHT_MIN_BODY,
) -> Column:
    """``array<struct<at, kind, level, text>>`` of headings (kind 0) and bodies (kind 1).

    One pattern finds both in text order. A body inside a heading's span could only be that
    heading's own text, which is never kept twice, so the shared scan loses nothing. Of equal
    texts a heading wins over a body, then the first one. Shorter texts than the least lengths are
    left out.
    """
    found = F.transform(
        F.regexp_extract_all(text, F.lit(f"{_HEADING}|{_BODY}" % (min_heading, min_body)), F.lit(0)),
        lambda m, i: F.struct(
            clean_text(F.regexp_extract(m, r'"([^"]*)"\z', 1)).alias("text"),
            F.when(F.startswith(m, F.lit('"as"')), 0).otherwise(1).alias("kind"),
            i.alias("at"),
            F.regexp_extract(m, r'\A"as"\s*:\s*"(h[1-6])"', 1).alias("level"),
        ),
    )
    usable = F.filter(
        found,
        lambda e: (e["text"] != "")
        & (
            (e["kind"] == 0)
            | ~(
                F.contains(e["text"], F.lit("{"))
                | F.contains(e["text"], F.lit("function"))
                | F.contains(e["text"], F.lit("/_next/"))
                | F.startswith(e["text"], F.lit("$"))
            )
        ),
    )
    return let(
        F.array_sort(usable),
        lambda es: F.array_sort(
            F.transform(
                F.filter(
                    es, lambda e, i: (i == 0) | (F.get(es, i - 1)["text"] != e["text"])
                ),
                lambda e: F.struct(
                    e["at"].alias("at"), e["kind"].alias("kind"), e["level"].alias("level"),
                    e["text"].alias("text"),
                ),
            )
        ),
    )


def flight_html(
    html: Column,
    min_heading: int = config.FLIGHT_MIN_HEADING,
    min_body: int = config.FLIGHT_MIN_BODY,
) -> Column:
    """Small HTML document rebuilt from the flight data; ``""`` if there is none."""

    def wrap(e: Column) -> Column:
        tag = F.when(e["kind"] == 0, e["level"]).otherwise("p")
        return F.concat(F.lit("<"), tag, F.lit(">"), e["text"], F.lit("</"), tag, F.lit(">"))

    found = elements(flight_text(payloads(html)), min_heading, min_body)
    built = F.array_join(F.transform(found, wrap), "\n")
    return F.when(has_flight(html), F.coalesce(built, F.lit(""))).otherwise("")
