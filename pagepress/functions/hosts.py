"""Host names as a URL parser serializes them, as Column expressions.

A host is percent-decoded, mapped (letter case, full-width forms, ideographic full stops, invisible
characters) and each label that is not ASCII becomes punycode; a host whose last label is a number
is an IPv4 address in any of its spellings. Not covered: composing decomposed characters (NFC), which
no built-in function does, and checking labels that already are punycode. A label of over
``MAX_LABEL`` code points, four times what DNS allows, has no punycode here, so its host is invalid.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagepress.functions.text import let

MAX_LABEL = 255
_NOT_ASCII = r"[^\x00-\x7F]"
_ENDS_IN_NUMBER = r"(?:\A|\.)(?:[0-9]+|0x[0-9a-f]*)\.?\z"
# Characters that no host may hold.
_FORBIDDEN = r"[\x00-\x20#/:<>?@\[\\\]^|%\x7F]"
# Full-width ASCII by its offset, then other full stops; what follows is left out of a host.
_MAPPED = "".join(chr(0xFEE0 + c) for c in range(0x21, 0x7F)) + "。｡"
_TO = "".join(map(chr, range(0x21, 0x7F))) + ".."
_IGNORED = "\u00ad\u200b\u2060\ufeff"

# The parameters of punycode.
_BASE, _T_MIN, _T_MAX, _SKEW, _DAMP, _BIAS, _FIRST = 36, 1, 26, 38, 700, 72, 128
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    """The bias behind a number: how large the next one is expected to be."""
    limit = (_BASE - _T_MIN) * _T_MAX // 2
    halved = F.when(first, F.floor(delta / _DAMP)).otherwise(F.floor(delta / 2))
    state = lambda d, k: F.struct(d.cast("long").alias("d"), k.cast("int").alias("k"))
    return let(
        halved,
        lambda d: F.aggregate(
            # A step divides by 35, so twelve are enough for any long.
            F.sequence(F.lit(1), F.lit(12)),
            state(d + F.floor(d / points), F.lit(0)),
            lambda s, _: F.when(s["d"] > limit, state(F.floor(s["d"] / (_BASE - _T_MIN)), s["k"] + _BASE)).otherwise(s),
            lambda s: (s["k"] + F.floor(_BASE * s["d"] / (s["d"] + _SKEW))).cast("int"),
        ),
    )


def _number(delta: Column, bias: Column) -> Column:
    """A number in digits of growing weight; the first digit below its threshold ends it."""
    state = lambda left, out: F.struct(left.cast("long").alias("left"), out.alias("out"))
    digit = lambda d: F.substr(F.lit(_DIGITS), d.cast("int") + 1, F.lit(1))

    def step(s: Column, k: Column) -> Column:
        def at(t: Column) -> Column:
            more = s["left"] - t
            return (
                F.when(s["left"] < 0, s)
                .when(more < 0, state(F.lit(-1), F.concat(s["out"], digit(s["left"]))))
                .otherwise(state(F.floor(more / (_BASE - t)), F.concat(s["out"], digit(t + more % (_BASE - t)))))
            )

        return let(F.least(F.greatest(k - bias, F.lit(_T_MIN)), F.lit(_T_MAX)), at)

    places = F.sequence(F.lit(_BASE), F.lit(12 * _BASE), F.lit(_BASE))
    return F.aggregate(places, state(delta, F.lit("")), step, lambda s: s["out"])


def punycode(label: Column) -> Column:
    """Punycode of a label: its ASCII characters, then the others by code point and place."""

    def encode(points: Column) -> Column:
        below = lambda part, n: F.size(F.filter(part, lambda c: c < n))
        behind = lambda at: F.slice(points, at + 2, F.size(points))
        basic = F.regexp_replace(label, _NOT_ASCII, "")
        others = F.array_sort(
            F.filter(
                F.transform(points, lambda c, i: F.struct(c.alias("c"), i.alias("at"))), lambda p: p["c"] >= _FIRST
            )
        )

        def state(c, at, done, bias, out) -> Column:
            return F.struct(
                c.alias("c"), at.alias("at"), done.alias("done"), bias.cast("int").alias("bias"), out.alias("out")
            )

        def step(s: Column, p: Column) -> Column:
            # Characters passed since the last one written; a new code point passes all that are left once more.
            rounds = (p["c"] - s["c"] - 1).cast("long") * (s["done"] + 1)
            ended = (s["at"] < F.size(points)).cast("int")
            delta = F.when(
                p["c"] == s["c"], below(F.slice(points, s["at"] + 2, p["at"] - s["at"] - 1), p["c"])
            ).otherwise(ended + rounds + below(behind(s["at"]), s["c"]) + below(F.slice(points, F.lit(1), p["at"]), p["c"]))
            return let(
                delta.cast("long"),
                lambda d: state(
                    p["c"],
                    p["at"],
                    s["done"] + 1,
                    _adapted(d, s["done"] + 1, s["done"] == F.length(basic)),
                    F.concat(s["out"], _number(d, s["bias"])),
                ),
            )

        # As if the code point before the first one had been written behind the end.
        start = state(
            F.lit(_FIRST - 1),
            F.size(points),
            F.length(basic),
            F.lit(_BIAS),
            F.when(basic == "", "").otherwise(F.concat(basic, F.lit("-"))),
        )
        return F.aggregate(others, start, step, lambda s: s["out"])

    return let(F.transform(F.regexp_extract_all(label, F.lit("(?s)."), F.lit(0)), F.ascii), encode)


def _ascii_labels(host: Column) -> Column:
    """The host with punycode for labels that need it; NULL if one is too long."""
    labels = F.transform(
        F.split(host, r"\."),
        lambda l: F.when(~l.rlike(_NOT_ASCII), l).when(
            F.length(l) <= MAX_LABEL, F.concat(F.lit("xn--"), punycode(l))
        ),
    )
    return let(labels, lambda ls: F.when(~F.exists(ls, lambda l: l.isNull()), F.array_join(ls, ".")))


def ipv4(host: Column) -> Column:
    """Dotted form of one to four numbers in decimal, octal (0..) or hexadecimal (0x..), else NULL."""

    def value(part: Column) -> Column:
        def read(lead: str, most: int, base: int) -> Column:
            digits = F.regexp_replace(part, lead, "")
            return F.when(F.length(digits) <= most, F.conv(F.concat(F.lit("0"), digits), base, 10).cast("long"))

        return (
            F.when(part.rlike(r"\A0x[0-9a-f]*+\z"), read(r"\A0x0*+", 8, 16))
            .when(part.rlike(r"\A0[0-7]*+\z"), read(r"\A0++", 11, 8))
            .when(part.rlike(r"\A[1-9][0-9]{0,9}\z"), F.try_to_number(part, F.lit("9999999999")).cast("long"))
        )

    def dotted(values: Column) -> Column:
        n = F.size(values)
        lead, last = F.slice(values, F.lit(1), n - 1), F.element_at(values, -1)
        room = F.get(F.array(*[F.lit(256**left).cast("long") for left in (4, 3, 2, 1)]), n - 1)
        valid = (n <= 4) & ~F.exists(lead, lambda v: v.isNull() | (v > 255)) & F.coalesce(last < room, F.lit(False))
        total = F.aggregate(lead, F.lit(0).cast("long"), lambda sum_, v: sum_ * 256 + v) * room + last
        return F.when(
            valid,
            let(total, lambda t: F.concat_ws(".", *[F.shiftright(t, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])),
        )

    return let(F.transform(F.split(F.regexp_replace(host, r"\.\z", ""), r"\."), value), dotted)


def canonical_host(raw: Column) -> Column:
    """The host as it is serialized, or NULL where a URL with it cannot be parsed."""
    escaped = F.replace(F.regexp_replace(raw, r"%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    mapped = F.when(
        raw.rlike(rf"%|{_NOT_ASCII}"),
        F.lower(F.translate(F.try_url_decode(escaped), _MAPPED + _IGNORED, _TO)),
    ).otherwise(F.lower(raw))

    def finished(host: Column) -> Column:
        return F.when((host == "") | host.rlike(_FORBIDDEN) | host.rlike("\ufffd"), None).when(
            host.rlike(_ENDS_IN_NUMBER), ipv4(host)
        ).otherwise(host)

    return F.when(F.startswith(raw, F.lit("[")), F.lower(raw)).otherwise(
        let(
            mapped,
            lambda m: let(F.when(m.rlike("\ufffd"), None).when(m.rlike(_NOT_ASCII), _ascii_labels(m)).otherwise(m), finished),
        )
    )
