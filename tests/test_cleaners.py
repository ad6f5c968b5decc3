import random

from pagepress.functions import cleaners as c


def test_golden(apply):
    def one(fn, text):
        return apply(fn, text)[0]

    assert "[Line 1\nLine 2]" not in one(c.escape_newlines_in_links, "[Line 1\nLine 2](https://e.com)")
    out = one(c.remove_navigation_aids, "[Skip to content](#main)\nReal content here.")
    assert "Skip to content" not in out and "Real content here" in out
    assert "Back to top" not in one(c.remove_navigation_aids, "Content here.\n[Back to top](#top)")
    out = one(c.remove_empty_links, "Before [](https://e.com) after [  ](x)")
    assert out == "Before  after "
    assert "Content" in one(c.clean_tables, "| Header |\n| --- |\n|  |\n| Content |")
    assert one(c.collapse_headings, "## Title\n\n## Title\n\nContent").count("## Title") == 1
    assert "javascript" in one(c.fix_code_fences, "```javascript\nconsole.log('hello');\n```")
    assert one(c.collapse_newlines, "Line 1\n\n\n\n\nLine 2") == "Line 1\n\nLine 2"
    assert one(c.collapse_newlines, "Line 1\n\nLine 2") == "Line 1\n\nLine 2"
    assert one(c.strip_inline_links, "[Some Name](https://e.org/wiki/N) is here.") == "Some Name is here."
    assert one(c.strip_inline_links, "[A](url1) and [B](url2) are friends.") == "A and B are friends."
    assert one(c.strip_inline_links, "![Alt text](image.png)") == "!Alt text"
    assert one(c.remove_edit_markers, "## Early life [edit]\nx") == "## Early life \nx"
    assert one(c.remove_edit_markers, "won 14 awards[1] in 100 films[2].") == "won 14 awards in 100 films."
    assert one(c.remove_edit_markers, "a[Citation Needed] b[by whom?] c[1234]") == "a b c[1234]"
    assert one(c.unescape, "In 1959\\. Khan\\'s a\\, b") == "In 1959. Khan's a, b"
    assert one(c.unescape, "Normal \\n text") == "Normal \\n text"


def test_alt_text(apply):
    fit, long = "![" + "a" * 120 + "](i.png)", "![" + "a" * 121 + "](i.png)"
    assert apply(c.shorten_alt_text, fit, long, "x! " + long + "!") == [
        fit, "![" + "a" * 117 + "...](i.png)", "x! ![" + "a" * 117 + "...](i.png)!",
    ]


def test_phrases(apply):
    cases = {
        "go home now": "go\nnow",
        "stop topic homely": "stop topic homely",
        "top\nhome\nx": "\n\n\nx",
        "# Back  to *top* #": "\n",
        "a top home b": "a\nhome b",
        "x\ntop \nhome": "x\n\n",
    }
    assert apply(c.remove_navigation_phrases, *cases) == list(cases.values())


def test_blank_lines(apply):
    cases = {"a\n\n \nb": "a\nb", "\n\na\n": "a\n", "a\n  b": "a\n  b", "a\n\n": "a\n", " \na": "a"}
    assert apply(c.remove_blank_lines, *cases) == list(cases.values())


def test_tables(apply):
    cases = {
        "| a | b |\n| --- | :-: |\nx": "| a | b |\nx",
        "| | | | z |": "z",
        "| | | |": None,
        "text |": None,
        "a | b": "a | b",
        "|": None,
        "| a": "| a",
    }
    assert apply(c.clean_tables, *cases) == [v if v is not None else "" for v in cases.values()]


def test_fences(apply):
    cases = {
        "sql\n```\nx": "```sql\nx",
        "py\n\n```\nx": "```py\nx",
        "src/a.ts\n```\nx": "```ts\nx",
        "pytest\n```\nx": "pytest\n```\nx",
        "a sql\n```\nx": "a sql\n```\nx",
    }
    assert apply(c.fix_code_fences, *cases) == list(cases.values())


def bracket_model(md):
    depth, out = 0, []
    for ch in md:
        depth = depth + 1 if ch == "[" else max(0, depth - 1) if ch == "]" else depth
        out.append("\\\n" if depth and ch == "\n" else ch)
    return "".join(out)


def heading_model(md):
    out, last = [], ""
    for line in md.split("\n"):
        text = line.strip()
        level = len(text) - len(text.lstrip("#"))
        if line.startswith("#") and 1 <= level <= 6 and text[level : level + 1] == " ":
            if text == last:
                continue
            last = text
        elif text:
            last = ""
        out.append(line)
    return "\n".join(out)


def test_against_sequential_models(apply):
    rng = random.Random(7)
    brackets = ["".join(rng.choice("[]\n\nab") for _ in range(rng.randrange(400))) for _ in range(300)]
    assert apply(c.escape_newlines_in_links, *brackets) == [bracket_model(t) for t in brackets]
    lines = ["# a", "# a", "## a", "", "", " ", "x"]
    heads = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(12))) for _ in range(300)]
    assert apply(c.collapse_headings, *heads) == [heading_model(t) for t in heads]


def test_idempotent(apply):
    texts = ["a\n\n\n\nb [](x) [[](y)](z)", "\n \nq\n\n"]
    for fn in (c.remove_blank_lines, c.collapse_newlines):
        once = apply(fn, *texts)
        assert apply(fn, *once) == once
