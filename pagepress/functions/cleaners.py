"""The eleven markdown cleaners, each a Column-to-Column expression.

Patterns are literals so that Spark compiles them once. Line starts and ends are written as
lookarounds over the four ECMAScript line terminators, because the Java multi-line anchors
treat a final newline differently.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from pagepress import config
from pagepress.functions.text import NON_SPACE, SPACE, WS, WS_IN_LINE, column_of, let, scan_strings, trim, trim_end

_EOL = r"[\n\r\x{2028}\x{2029}]"
_LINE_START = rf"(?:\A|(?<={_EOL}))"
_LINE_END = rf"(?:\z|(?={_EOL}))"


def escape_newlines_in_links(md: Column) -> Column:
    """Put a backslash before every newline inside square brackets (depth never below 0)."""
    pieces = F.split(md, r"(?=[\[\]])")

    def depth_after(depth: Column, piece: Column) -> Column:
        first = F.left(piece, F.lit(1))
        return F.when(first == "[", depth + 1).when(first == "]", F.greatest(depth - 1, F.lit(0))).otherwise(depth)

    scanned = scan_strings(
        pieces,
        F.lit(0),
        depth_after,
        lambda piece, _, depth: F.when(
            depth > 0, F.replace(piece, F.lit("\n"), F.lit("\\\n"))
        ).otherwise(piece),
    )
    # Brackets that open and close on one line cannot matter.
    open_left = F.contains(md, F.lit("[")) & F.contains(
        F.regexp_replace(md, r"\[[^\[\]\n]*+\]", ""), F.lit("[")
    )
    return F.when(open_left, scanned).otherwise(md)


def _link_pattern(texts: list[str]) -> str:
    return r"(?i)\[(?:%s)\]\(#[^)]*\)" % "|".join(texts)


def _phrase_pattern(phrases: list[str]) -> str:
    r"""Phrases between line ends or runs of spaces and marks.

    A line start is itself behind a character of such a run, so it only matters at the very
    start and right behind the previous match, which is what ``\G`` asks for.
    """
    glue = rf"[{WS}*_#\-]"
    options = "|".join(p.replace(" ", glue + "*") for p in phrases)
    initials = "".join(sorted({p[0] for p in phrases}))
    return (
        rf"(?i)(?:\G(?:\A|(?<={_EOL}))|(?<!{glue}){glue}++)(?=[{initials}])(?:{options})(?:{_LINE_END}|{glue}++)"
    )


def _up_to_last_paren(md: Column, change: Callable[[Column], Column]) -> Column:
    """Change a text up to its last ``)``; what follows cannot hold a link's end.

    A pattern that looks for the closing mark then always finds one, so it never runs to the end of
    the text from every opening mark.
    """
    return let(
        F.substring_index(md, ")", -1),
        lambda tail: F.concat(change(F.left(md, F.length(md) - F.length(tail))), tail),
    )


def remove_navigation_links(md: Column) -> Column:
    def change(out: Column) -> Column:
        for texts in (config.SKIP_LINK_TEXTS, config.TOP_LINK_TEXTS):
            out = F.regexp_replace(out, _link_pattern(texts), "")
        return out

    return F.when(F.contains(md, F.lit("](#")), _up_to_last_paren(md, change)).otherwise(md)


def _replace_phrases(md: Column, phrases: list[str]) -> Column:
    # Every phrase holds its longest word, so a text without any of these words has no phrase.
    needed = list(dict.fromkeys(max(p.split(" "), key=len) for p in phrases))
    replaced = F.regexp_replace(md, _phrase_pattern(phrases), "\n")

    def has_word(low: Column) -> Column:
        found = F.contains(low, F.lit(needed[0]))
        for word in needed[1:]:
            found = found | F.contains(low, F.lit(word))
        return found

    return F.when(let(F.lower(md), has_word), replaced).otherwise(md)


def remove_navigation_phrases(md: Column) -> Column:
    return let(remove_page_phrases(md), remove_copy_phrases)


def remove_page_phrases(md: Column) -> Column:
    return _replace_phrases(md, config.NAVIGATION_PHRASES)


def remove_copy_phrases(md: Column) -> Column:
    return _replace_phrases(md, config.COPY_PHRASES)


def remove_blank_lines(md: Column) -> Column:
    """Drop blank lines; what follows the last newline stays.

    Lines are taken apart where only ``\\n`` ends a line, the usual case; the pattern covers
    the other line terminators.
    """
    lines = F.split(md, "\n")
    kept = let(
        lines,
        lambda ls: F.array_join(
            F.filter(ls, lambda line, i: (trim(line) != "") | (i == F.size(ls) - 1)), "\n"
        ),
    )
    other = F.contains(md, F.lit("\r")) | F.contains(md, F.lit("\u2028")) | F.contains(md, F.lit("\u2029"))
    return F.when(
        other, F.regexp_replace(md, rf"\A{SPACE}*[\r\n]|({_EOL}){SPACE}*[\r\n]", "$1")
    ).otherwise(kept)


def remove_navigation_aids(md: Column) -> Column:
    """Links, phrases and blank lines in one expression, for use on its own."""
    links = let(md, remove_navigation_links)
    return let(let(let(links, remove_page_phrases), remove_copy_phrases), remove_blank_lines)


def remove_empty_links(md: Column) -> Column:
    def change(head: Column) -> Column:
        return F.regexp_replace(head, rf"\[{SPACE}*+\]\([^)]*+\)", "")

    return F.when(F.contains(md, F.lit("](")), _up_to_last_paren(md, change)).otherwise(md)


def strip_inline_links(md: Column) -> Column:
    """Links, and images too, become their text.

    If a bracket gives no link, no bracket up to its closing mark does, so the second alternative
    takes that whole run at once.
    """

    def change(head: Column) -> Column:
        return F.regexp_replace(head, r"\[([^\]]++)\]\([^)]++\)|(\[[^\]]*+)", "$1$2")

    return F.when(F.contains(md, F.lit("](")), _up_to_last_paren(md, change)).otherwise(md)


def remove_edit_markers(md: Column) -> Column:
    edit = "|".join(config.EDIT_MARKERS)
    cite = "|".join(m.replace("?", r"\?") for m in config.CITATION_MARKERS)
    out = F.regexp_replace(md, rf"\[{SPACE}*(?:{edit}){SPACE}*\]", "")
    out = F.regexp_replace(out, rf"(?i)\[{SPACE}*(?:{cite}){SPACE}*\]", "")
    out = F.regexp_replace(out, r"\[\d{1,3}\]", "")
    return F.when(F.contains(md, F.lit("[")), out).otherwise(md)


def clean_tables(md: Column) -> Column:
    """Drop divider and empty table lines; unwrap rows that are more than 70 % empty."""

    def row(line: Column, text: Column) -> Column:
        ends = F.endswith(text, F.lit("|"))
        parts = F.transform(F.split(text, r"\|"), trim)

        def judge(p: Column) -> Column:
            cells = F.slice(
                p, F.lit(2), F.greatest(F.size(p) - F.when(ends, 2).otherwise(1), F.lit(0))
            )
            full = F.filter(cells, lambda c: c != "")
            sparse = (F.size(cells) > 2) & (
                (F.size(cells) - F.size(full)) / F.size(cells) > F.lit(0.7)
            )
            return (
                F.when(F.size(full) == 0, F.lit(None).cast("string"))
                .when(sparse, F.array_join(full, " "))
                .otherwise(line)
            )

        return let(parts, judge)

    def clean(line: Column) -> Column:
        return F.when(~F.contains(line, F.lit("|")), line).otherwise(
            let(
                trim(line),
                lambda t: F.when(t.rlike(rf"\A[|{WS}\-:]*\z"), F.lit(None).cast("string"))
                .when(F.startswith(t, F.lit("|")) | F.endswith(t, F.lit("|")), row(line, t))
                .otherwise(line),
            )
        )

    return F.when(
        F.contains(md, F.lit("|")), F.array_join(F.transform(F.split(md, "\n"), clean), "\n")
    ).otherwise(md)


def shorten_alt_text(md: Column, limit: int = config.MAX_ALT_TEXT) -> Column:
    image = rf"!\[[^\]]{{{limit + 1},}}\]\([^)]+\)"
    pieces = F.regexp_extract_all(md, F.lit(rf"{image}|[^!]+|!"), F.lit(0))

    def shorten(piece: Column) -> Column:
        short = F.concat(
            F.lit("!["),
            trim(F.substr(piece, F.lit(3), F.lit(limit - 3))),
            F.lit("..."),
            F.regexp_extract(piece, r"\A!\[[^\]]*(\]\([^)]+\))\z", 1),
        )
        return F.when(piece.rlike(rf"\A{image}\z"), short).otherwise(piece)

    return F.when(F.contains(md, F.lit("![")) & md.rlike(image), F.array_join(F.transform(pieces, shorten), "")).otherwise(md)


def collapse_headings(md: Column) -> Column:
    """Drop a heading that repeats the previous one with only blank lines between.

    Equality is transitive, so each non-blank line is compared with its neighbour only: the
    text is split in front of non-blank lines, and blank lines stay with the line before.
    """
    pieces = F.split(md, rf"\n(?=[{WS_IN_LINE}]*{NON_SPACE})")

    def key(piece: Column) -> Column:
        line = F.regexp_extract(piece, r"\A([^\n]*)", 1)
        return trim(F.regexp_extract(line, rf"\A(#{{1,6}}{SPACE}+[^\n\r\x{{2028}}\x{{2029}}]+)\z", 1))

    def collapse(ps: Column) -> Column:
        return let(
            F.transform(ps, key),
            lambda keys: F.array_join(
                F.transform(
                    ps,
                    lambda p, i: F.when(
                        (i > 0)
                        & (F.get(keys, i) != "")
                        & (F.get(keys, i) == F.get(keys, i - 1)),
                        # Keep only the blank lines behind the dropped heading, if any.
                        F.when(F.contains(p, F.lit("\n")), F.regexp_replace(p, r"\A[^\n]*\n", "")),
                    ).otherwise(p),
                ),
                "\n",
            ),
        )

    return F.when(F.contains(md, F.lit("#")), let(pieces, collapse)).otherwise(md)


def fix_code_fences(md: Column) -> Column:
    """Move a stray language name or file path in front of a bare fence into the fence.

    Only the last non-blank line before a fence matters, so the text is split at the fences and
    just those lines are looked at. Blank lines between name and fence go too.
    """
    lang = "|".join(config.CODE_LANGUAGES)
    name = rf"{_LINE_START}(?:[\w\-./]+\.)?({lang})\z"

    def before_fence(piece: Column) -> Column:
        def move(text: Column) -> Column:
            line = F.substring_index(text, "\n", -1)
            found = F.struct(
                F.regexp_extract(line, name, 0).alias("name"),
                F.regexp_extract(line, name, 1).alias("lang"),
            )
            return let(
                found,
                lambda m: F.when(m["name"] == "", F.concat(piece, F.lit("```\n"))).otherwise(
                    F.concat(
                        F.left(text, F.length(text) - F.length(m["name"])),
                        F.lit("```"), m["lang"], F.lit("\n"),
                    )
                ),
            )

        return let(trim_end(piece), move)

    fixed = let(
        F.split(md, "```\n"),
        lambda ps: F.array_join(
            F.transform(
                ps, lambda p, i: F.when(i == F.size(ps) - 1, p).otherwise(before_fence(p))
            ),
            "",
        ),
    )
    return F.when(F.contains(md, F.lit("```\n")), fixed).otherwise(md)


def unescape(md: Column) -> Column:
    marks = "".join(re.escape(ch) for ch in config.UNESCAPED_PUNCTUATION)
    return F.when(
        F.contains(md, F.lit("\\")), F.regexp_replace(md, rf"\\([{marks}])", "$1")
    ).otherwise(md)


def collapse_newlines(md: Column) -> Column:
    return F.when(
        F.contains(md, F.lit("\n\n\n")), F.regexp_replace(md, r"\n{3,}", "\n\n")
    ).otherwise(md)


# The fixed order. Most cleaners look for a plain substring first, which is far cheaper than a
# pattern that finds nothing.
CLEANERS = [
    escape_newlines_in_links,
    remove_navigation_links,
    remove_page_phrases,
    remove_copy_phrases,
    remove_blank_lines,
    remove_empty_links,
    strip_inline_links,
    remove_edit_markers,
    clean_tables,
    shorten_alt_text,
    collapse_headings,
    fix_code_fences,
    unescape,
    collapse_newlines,
    trim,
]


def clean_markdown(df: DataFrame, md: str = "markdown", max_alt_text: int | None = None) -> DataFrame:
    """All cleaners in order on one column; alt texts are cut only if a limit is given."""
    for cleaner in CLEANERS:
        if cleaner is not shorten_alt_text:
            df = df.withColumn(md, column_of(cleaner, md))
        elif max_alt_text is not None:
            df = df.withColumn(md, shorten_alt_text(F.col(md), max_alt_text))
    return df
