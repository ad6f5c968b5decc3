"""Shared string helpers. Everything here is a Column-to-Column expression."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, functions as F

# Fixed value: the whitespace set of ECMAScript `\s`, spelled out because the Java `\s` is ASCII
# only. For use inside a character class. The rare part sits behind one range check, so that
# ordinary letters are turned down after two comparisons.
_RARE = (
    r"[\x{1680}-\x{FEFF}&&"
    r"[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]"
)
WS = rf"\t\n\x0B\f\r \x{{A0}}{_RARE}"
WS_IN_LINE = rf"\t\x0B\f\r \x{{A0}}{_RARE}"
SPACE = f"[{WS}]"
NON_SPACE = rf"(?!{SPACE})[\s\S]"


def memo(build: Callable) -> Callable:
    """Keep what ``build`` returns for the same (hashable) arguments.

    An unresolved expression over column names can be used in any number of plans. Putting a
    large one together takes a call into the JVM per node, so that is done once per session.
    """
    kept: dict = {}

    @wraps(build)
    def wrapped(*args):
        key = (id(SparkContext._gateway), args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return wrapped


@memo
def column_of(fn: Callable[..., Column], *names: str) -> Column:
    """``fn`` applied to the columns with these names, built once."""
    return fn(*[F.col(name) for name in names])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    A fold over nothing, whose result is ``value``: unlike a transform it makes no deep copy of it, which
    would take time in proportion to all that a state holds.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


_WS_CHARS = (
    "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def trim(c: Column) -> Column:
    """Strip the whole whitespace set at both ends."""
    return F.btrim(c, F.lit(_WS_CHARS))


def trim_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(_WS_CHARS))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_text(*cs: Column) -> Column:
    """First argument that is neither NULL nor empty, else NULL."""
    return F.coalesce(*[blank_to_null(c) for c in cs])


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def last_index(c: Column, needle: str, upto: Column) -> Column:
    """1-based start of the last ``needle`` that starts at or before ``upto``; 0 if none."""
    window = F.left(c, (upto + len(needle) - 1).cast("int"))
    at = F.locate(needle[::-1], F.reverse(window))
    return F.when(at > 0, F.length(window) - at - len(needle) + 2).otherwise(0)


def replace_many(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Plain, ordered replacements."""
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def scan_strings(
    items: Column,
    state: Column,
    advance: Callable[[Column, Column], Column],
    emit: Callable[[Column, Column, Column], Column],
    chunk: int = 64,
) -> Column:
    """Concatenate ``emit(item, state_before, state_after)`` over an array, carrying a state.

    Items are folded in chunks and each chunk is joined to one string, so that the growing
    result is copied once per chunk and not once per item.
    """
    empty = F.array().cast("array<string>")

    def step(acc: Column, item: Column) -> Column:
        return let(
            advance(acc["state"], item),
            lambda after: F.struct(
                after.alias("state"),
                F.concat(acc["out"], F.array(emit(item, acc["state"], after))).alias("out"),
            ),
        )

    def run(all_items: Column) -> Column:
        def fold(acc: Column, start: Column) -> Column:
            return let(
                F.aggregate(
                    F.slice(all_items, start, F.lit(chunk)),
                    F.struct(acc["state"].alias("state"), empty.alias("out")),
                    step,
                ),
                lambda part: F.struct(
                    part["state"].alias("state"),
                    F.concat(acc["out"], F.array(F.array_join(part["out"], ""))).alias("out"),
                ),
            )

        starts = F.sequence(F.lit(1), F.greatest(F.size(all_items), F.lit(1)), F.lit(chunk))
        first = F.struct(state.alias("state"), empty.alias("out"))
        return F.array_join(F.aggregate(starts, first, fold)["out"], "")

    return let(items, run)
