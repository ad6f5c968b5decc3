"""Narrowing a page to its main content, all inside the row of the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagepress import config
from pagepress.functions.text import column_of, last_index, let


def container(html: Column, tag: str) -> Column:
    """From the first ``<tag`` to its matching close, nesting-aware; NULL if there is none.

    The page is split in front of every opening and closing mark, so one pass with a scalar
    state (depth, pieces taken) finds the close; no piece is copied on the way.
    """

    def measure(pieces: Column) -> Column:
        def fold(acc: Column, piece: Column) -> Column:
            is_open = piece.rlike(rf"(?i)\A<{tag}")
            is_close = piece.rlike(rf"(?i)\A</{tag}>")
            depth = acc["depth"] + F.when(is_open, 1).when(is_close, -1).otherwise(0)
            return F.when(acc["close"] > 0, acc).otherwise(
                F.struct(
                    (acc["at"] + 1).alias("at"),
                    F.greatest(depth, F.lit(0)).alias("depth"),
                    F.when((acc["open"] == 0) & is_open, acc["at"] + 1)
                    .otherwise(acc["open"])
                    .alias("open"),
                    F.when((acc["depth"] == 1) & is_close, acc["at"] + 1).otherwise(0).alias("close"),
                )
            )

        zero = F.lit(0)
        state = F.aggregate(
            pieces,
            F.struct(zero.alias("at"), zero.alias("depth"), zero.alias("open"), zero.alias("close")),
            fold,
        )
        return let(
            state,
            lambda s: F.when(
                s["close"] > 0,
                F.concat(
                    F.array_join(F.slice(pieces, s["open"], s["close"] - s["open"]), ""),
                    F.left(F.element_at(pieces, s["close"]), F.lit(len(tag) + 3)),
                ),
            ),
        )

    return F.when(
        html.rlike(f"<(?i:{tag})"), let(F.split(html, rf"(?=<(?i:/?{tag}))"), measure)
    )


def extract_container(html: Column) -> Column:
    """First balanced container by priority, else the whole page."""
    return F.coalesce(*[container(html, tag) for tag in config.CONTAINER_TAGS], html)


def cut_footer(html: Column) -> Column:
    """Cut at the earliest footer id, moved back to the last ``<h`` before it."""
    ids = "|".join(config.FOOTER_IDS)
    # A mark at the very first character does not count, hence the lookbehind.
    parts = F.split(html, rf'[iI](?<!\A.)[dD]="(?i:{ids})"', 2)

    def back_to_heading(before: Column) -> Column:
        at = last_index(F.translate(before, "H", "h"), "<h", F.length(before))
        return let(at, lambda i: F.when(i > 1, F.left(before, i - 1)).otherwise(before))

    return let(
        parts, lambda p: F.when(F.size(p) > 1, back_to_heading(p[0])).otherwise(p[0])
    )


def cap_html(html: Column, cap: int = config.MAX_HTML_CHARS) -> Column:
    """Cut an over-long text just after the last ``>`` at or before index ``cap``."""
    return F.when(
        F.length(html) > cap,
        let(
            last_index(html, ">", F.lit(cap + 1)),
            lambda at: F.left(html, F.when(at > 1, at).otherwise(F.lit(cap))),
        ),
    ).otherwise(html)


def with_main_content(
    df: DataFrame, html: str = "html", out: str = "content", cap: int | None = None
) -> DataFrame:
    """Container and footer cut in one go; pages are whole unless a size cap is asked for."""
    df = df.withColumn(out, column_of(extract_container, html))
    df = df.withColumn(out, column_of(cut_footer, out))
    return df if cap is None else df.withColumn(out, cap_html(F.col(out), cap))
