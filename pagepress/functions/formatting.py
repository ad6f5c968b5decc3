"""Word cap, metadata header and the final document text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagepress import config
from pagepress.functions.text import SPACE, blank_to_null, let, word_count


def cap_words(md: Column, cap: int = config.MAX_WORDS) -> Column:
    """Over ``cap`` words: the first ``cap`` joined by single spaces, and a note."""
    note = f"\n\n---\n*Content truncated at {cap:,} words.*"
    capped = let(
        F.split(md, f"{SPACE}+"),
        lambda ws: F.when(
            F.size(ws) > cap,
            F.concat(F.array_join(F.slice(ws, F.lit(1), F.lit(cap)), " "), F.lit(note)),
        ).otherwise(md),
    )
    # More than ``cap`` pieces need ``cap`` separators and the words between them.
    return F.when(F.length(md) >= 2 * cap - 1, capped).otherwise(md)


def metadata_header(url: Column, title: Column, description: Column, metadata: Column) -> Column:
    """Header lines in fixed order; absent or empty fields leave no line."""

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), blank_to_null(value))

    canonical = metadata["canonical"]
    return F.concat_ws(
        "\n",
        line("Title", title),
        line("Description", description),
        F.concat(F.lit("URL Source: "), url),
        line("Language", metadata["language"]),
        line("Author", metadata["author"]),
        line("Site Name", metadata["og_site_name"]),
        F.when(canonical != url, line("Canonical URL", canonical)),
        line("Content Type", metadata["og_type"]),
        line("Published", metadata["date_published"]),
        line("Modified", metadata["date_modified"]),
        line("Publisher", metadata["publisher"]),
        line("Keywords", F.array_join(metadata["keywords"], ", ")),
    )


def document_body(md: Column) -> Column:
    return F.coalesce(blank_to_null(md), F.lit(config.EMPTY_BODY))


def format_document(header: Column, body: Column) -> Column:
    return F.concat(
        header,
        F.lit("\nWord Count: "),
        word_count(body).cast("string"),
        F.lit("\n\n---\n\n"),
        body,
    )
