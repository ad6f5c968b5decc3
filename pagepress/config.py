"""Word lists, selectors and limits the results depend on."""

from __future__ import annotations

import re

# --- Fixed values: numeric limits -------------------------------------------
MAX_HTML_CHARS = 256000
MAX_WORDS = 10000
MIN_WORDS = 50
FLIGHT_MIN_HEADING = 3
FLIGHT_MIN_BODY = 40
SNAPSHOT_TTL_SECONDS = 3600
THROTTLE_LIMIT = 10
THROTTLE_WINDOW_SECONDS = 60
MAX_ALT_TEXT = 120
HEAD_FALLBACK_CHARS = 10000

# --- Fixed values: URLs -----------------------------------------------------
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "ref",
]

# --- Fixed values: crawl rows -----------------------------------------------
ACCEPTED_CONTENT_TYPES = ["html", "text", "xml"]
EMPTY_BODY = "No content could be extracted from this URL."
JSONLD_GRAPH_TYPES = ["Article", "WebPage", "BlogPosting", "NewsArticle"]

# --- Fixed values: content narrowing ----------------------------------------
CONTAINER_TAGS = ["article", "main"]
FOOTER_IDS = [
    "references", "external_links", "external-links", "further_reading",
    "further-reading", "bibliography", "footnotes", "notes", "see_also",
    "see-also", "citations", "sources", "endnotes", "works_cited", "works-cited",
]

# --- Fixed values: elements that are not content ----------------------------
EXCLUDE_SELECTORS = {
    "tags": ["header", "footer", "nav", "aside", "style", "script", "noscript", "iframe", "svg"],
    "aria": [
        '[role="navigation"]', '[role="banner"]', '[role="contentinfo"]',
        '[role="complementary"]', '[role="search"]', '[role="dialog"]',
        '[role="alert"]', '[role="note"]', '[aria-hidden="true"]', "[hidden]",
    ],
    "navigation": [
        ".header", ".navbar", "#header", "#navbar", ".navigation", "#nav", ".menu",
        "#menu", ".breadcrumbs", "#breadcrumbs", ".visually-hidden",
    ],
    "footers": [".footer", "#footer", ".footer-links", ".footer-nav", ".site-footer"],
    "sidebars": [".sidebar", "#sidebar", ".side-bar"],
    "popups": [".modal", ".popup", ".overlay", ".dialog", ".drawer", ".banner", ".toast"],
    "ads": [
        ".ad", ".ads", ".advertisement", ".advertising", ".sponsor", ".promotion",
        ".promo", ".advert", "#ad",
    ],
    "social": [
        ".social", ".social-media", ".social-links", "#social", ".share", "#share", ".sharing",
    ],
    "comments": [".comments", ".comment-section"],
    "cookies": [".cookie", ".cookie-banner", ".consent"],
    "search": [".search", "#search", "#search-form"],
    "widgets": [
        ".widget", "#widget", ".theme-switcher", ".lang-selector", ".skip-link",
        ".skip-to-content",
    ],
    "pagination": [".pagination", ".pager", ".toolbar"],
    "toc": [
        ".toc", ".table-of-contents", "#toc", ".on-this-page", "#on-this-page",
        ".docs-toolbar", ".docs-edit-link",
    ],
    "feedback": [".feedback", ".was-this-helpful"],
    "back_to_top": [".back-to-top", "#back-to-top", ".scroll-to-top", ".return-to-top"],
    "newsletter": [".newsletter", ".announcement"],
    "references": [
        ".reflist", ".references", ".reference", ".mw-references-wrap", ".citation",
        ".cite-backlink", ".noprint",
    ],
    "infoboxes": [
        ".infobox", ".infobox_v2", ".infobox_v3", ".sidebar", ".sidebar-content", ".vcard",
        ".geo", ".hatnote", ".ambox", ".tmbox", ".ombox", ".navbox", ".navbox-inner",
        ".catlinks", "#catlinks", ".mw-editsection",
    ],
}

# --- Fixed values: markdown cleaning ----------------------------------------
SKIP_LINK_TEXTS = ["Skip to Content"]
TOP_LINK_TEXTS = ["Return to top", "Back to top", "Scroll to top", "Go to top", "Top"]
NAVIGATION_PHRASES = [
    "skip to content", "return to top", "back to top", "scroll to top", "go to top", "top",
    "previous page", "next page", "jump to", "back to home", "home",
]
COPY_PHRASES = [
    "copy page", "copy page content", "copy page content to clipboard", "copy to clipboard",
    "share this page", "share on", "print this page", "download pdf", "report an issue",
    "improve this page", "edit this page",
]
EDIT_MARKERS = ["edit", "Edit"]
CITATION_MARKERS = [
    "citation needed", "clarification needed", "when?", "who?", "by whom?", "dubious",
]
CODE_LANGUAGES = (
    "ts tsx js jsx typescript javascript python py java c cpp csharp cs go rust ruby php html "
    "css scss sass less json xml yaml yml bash sh shell zsh sql swift kotlin dart r scala perl "
    "powershell ps1 graphql markdown md toml ini dockerfile vue svelte astro hcl terraform lua "
    "elixir elm haskell ocaml fsharp clojure groovy console diff text"
).split()
UNESCAPED_PUNCTUATION = ".,:;!?'\"()[]{}|\\*_~`#>+-"


Condition = tuple[str, str, str | None]  # kind (tag, class, id, attr), name, value
_SIMPLE = re.compile(r"""([.#]?)([A-Za-z0-9_-]+)|\[\s*([^\s=\]~|^$*]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\]\s]*)\s*)?\]""")


def selector(text: str) -> tuple[Condition, ...]:
    """The conditions of a selector without combinators, such as ``nav``, ``.ad`` or ``div#x[role=note]``."""
    conditions: list[Condition] = []
    at = 0
    for found in _SIMPLE.finditer(text):
        mark, name, attr, value = found.groups()
        if found.start() != at or (name and not mark and at):
            break
        at = found.end()
        if attr:
            conditions.append(("attr", attr.lower(), value.strip("\"'") if value else None))
        elif mark:
            conditions.append(("class" if mark == "." else "id", name, None))
        else:
            conditions.append(("tag", name.lower(), None))
    if at != len(text) or not conditions:
        raise ValueError(f"not a selector of one element: {text!r}")
    return tuple(conditions)


def exclude_rules() -> list[Condition]:
    """The selectors above, of one condition each, as distinct rows."""
    return list(dict.fromkeys(selector(s)[0] for group in EXCLUDE_SELECTORS.values() for s in group))
