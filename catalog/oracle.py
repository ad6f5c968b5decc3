"""The same results in DuckDB SQL, written on its own terms: windows over exploded tokens where
the engine uses arrays inside a row, RE2 patterns where it uses Java ones."""

from __future__ import annotations

from catalog.derived import duck
from catalog.queries import EVENT_WINDOW, HTML_CAP, NOW, WORD_CAP
from pagepress import config

# Fixed value: the whitespace set, in RE2 spelling.
_W = (
    r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)


def q(text: str) -> str:
    """SQL string literal; control characters through ``chr``."""
    parts = [f"'{p}'" for p in text.replace("'", "''").split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def rx(text: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({text}, {q(pattern)}, {q(to)}, '{flags}')"


def names(values: list[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def array(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def trim(x: str) -> str:
    return rx(x, f"^[{_W}]+|[{_W}]+$")


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(f'[{_W}]+')}), lambda w: w <> '')"


def with_steps(steps: list[tuple[str, str]], final: str) -> str:
    return "with " + ",\n".join(f"{n} as ({s})" for n, s in steps) + "\n" + final


# --- URLs ------------------------------------------------------------------------


def scheme(u: str) -> str:
    return f"case when starts_with({u}, 'http') then {u} else 'https://' || {u} end"


def _encode(x: str) -> str:
    return f"replace(replace(replace(url_encode({x}), '%20', '+'), '~', '%7E'), '%2A', '*')"


def normalized(url: str) -> str:
    """Scalar subquery-free normalization of the URLs that occur in the test tables."""
    raw = scheme(url)
    auth = f"lower(regexp_extract({raw}, '(?i)^https?://([^/?#]*)', 1))"
    path = f"regexp_extract({raw}, '(?i)^https?://[^/?#]*([^?#]*)', 1)"
    query = f"regexp_extract({raw}, '^[^?#]*\\?([^#]*)', 1)"
    pairs = (
        f"list_filter(list_transform(list_filter(string_split({query}, '&'), lambda p: p <> ''), lambda p, i: "
        "{'n': url_decode(replace(regexp_extract(p, '^([^=]*)', 1), '+', ' ')), 'i': i, "
        "'v': url_decode(replace(regexp_extract(p, '^[^=]*=(.*)', 1), '+', ' '))}), "
        f"lambda s: s.n not in {names(config.TRACKING_PARAMS)})"
    )
    text = (
        f"array_to_string(list_transform(list_sort({pairs}), lambda s: {_encode('s.n')} || '=' || {_encode('s.v')}), '&')"
    )
    base = (
        f"'https://' || regexp_replace({auth}, ':(80|443)$', '') || "
        f"case when {path} = '' then '/' else {path} end"
    )
    return (
        f"case when {text} <> '' then {base} || '?' || {text} "
        f"when {path} not in ('', '/') and ends_with({path}, '/') then left({base}, length({base}) - 1) "
        f"else {base} end"
    )


# Numbers as addresses by arithmetic. An international label here has one character that is not ASCII, behind
# k % 8 letters; its punycode is the number (code point - 128) * (letters + 1) + place in at most four digits.
_HOSTS = r"""
with parts as (
  select c_custkey k, c_custkey % 7 as form, c_custkey % 8 as place,
    unicode(lower(substr('ÀÉÖßñабвгдЖзий書日本語例ł', cast(1 + c_custkey % 20 as int), 1))) as point,
    case c_custkey % 7 when 2 then 10 * 16777216 + c_custkey % 16777216 else 3232235520 + c_custkey % 1000000 end as address
  from customer
),
digits as (
  select *, (point - 128) * (place + 2) + place as q0, (q0 - 1) // 35 as q1, (q1 - 1) // 35 as q2, (q2 - 26) // 10 as q3,
    'abcdefghijklmnopqrstuvwxyz0123456789' as a from parts
),
hosts as (
  select k, form, case
    when form in (0, 1, 2) then concat_ws('.', address // 16777216, address // 65536 % 256, address // 256 % 256, address % 256)
    when form in (3, 4) then 'ex.example.com'
    when form = 6 then concat('xn--', substr('abcdefgh', 1, place), 'x-', substr(a, 2 + (q0 - 1) % 35, 1),
      case when q1 < 1 then 'a' else substr(a, 2 + (q1 - 1) % 35, 1) ||
        case when q2 < 26 then substr(a, q2 + 1, 1) else substr(a, 27 + (q2 - 26) % 10, 1) || substr(a, q3 + 1, 1) end end,
      '.example') end as host
  from digits
)
select k, host, case when form = 5 then 'http://1.2.3.' || (256 + k) || '/' else 'https://' || host ||
  case form when 2 then '/x' when 3 then '/' || k when 4 then '/' || k else '/' end end as url_key
from hosts
"""

# --- tokens ----------------------------------------------------------------------

_RAW = "script style iframe textarea title xmp noembed noframes noscript".split()
# A title that closes itself stands in svg only, in these inputs.
_TOKEN = (
    r"(?is)<!--.*?-->|<title/>|"
    + "|".join(rf"<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>" for tag in _RAW)
    + r"|<[!?][^>]*>|</?[a-z][^>]*>|[^<]+|<"
)
_TAG = r"(?i)^</?([a-z][^\s/>]*)"


def token_rows(source: str, key: str) -> str:
    """``key, pos, kind, tag, text`` rows; 0-based positions."""
    return (
        f"select {key}, pos - 1 as pos, text, case when text like '<!%' then 'comment' "
        f"when regexp_matches(text, '(?is)^<({'|'.join(_RAW)})[\\s>].') then 'raw' when regexp_matches(text, '(?i)^</[a-z]') then 'close' "
        f"when regexp_matches(text, '(?i)^<[a-z]') then 'open' else 'text' end as kind, "
        f"nullif(lower(regexp_extract(text, {q(_TAG)}, 1)), '') as tag "
        f"from (select {key}, unnest(regexp_extract_all(html, {q(_TOKEN)})) as text, "
        f"generate_subscripts(regexp_extract_all(html, {q(_TOKEN)}), 1) as pos from {source})"
    )


_RULES = {
    kind: [name for k, name, _ in config.exclude_rules() if k == kind] for kind in ("tag", "class", "id")
}


def _excluded(text: str = "text", tag: str = "tag") -> str:
    cls = f"regexp_split_to_array(regexp_extract({text}, '\\sclass=\"([^\"]*)\"', 1), '\\s+')"
    roles = [v for k, n, v in config.exclude_rules() if n == "role"]
    return (
        f"({tag} in {names(_RULES['tag'])} or list_has_any({cls}, {array(_RULES['class'])}) "
        f"or regexp_extract({text}, '\\sid=\"([^\"]*)\"', 1) in {names(_RULES['id'])} "
        f"or regexp_extract({text}, '\\srole=\"([^\"]*)\"', 1) in {names(roles)} "
        f"or regexp_matches({text}, '\\saria-hidden=\"true\"') or regexp_matches({text}, '\\shidden\\b'))"
    )


def stripped(source: str, key: str) -> list[tuple[str, str]]:
    """Steps that end in ``stripped(key, html)``."""
    return [
        ("tok", token_rows(source, key)),
        (
            "leveled",
            f"select *, sum(case when kind = 'open' and not ends_with(text, '/>') then 1 when kind = 'close' then -1 else 0 end) "
            f"over (partition by {key}, tag order by pos) as lvl from tok where tag is not null",
        ),
        (
            "starts",
            f"select {key}, pos, case when ends_with(text, '/>') then 'raw' else kind end as kind, tag, lvl from leveled where kind in ('open', 'raw') and "
            + _excluded("regexp_extract(text, '^<[^>]*>')"),
        ),
        (
            "ranges",
            f"select s.{key}, s.pos as a, case when any_value(s.kind) = 'raw' then s.pos else "
            f"coalesce(min(e.pos), 1000000000) end as b from starts s left join leveled e on e.{key} = s.{key} "
            f"and e.tag = s.tag and e.pos > s.pos and e.kind = 'close' and e.lvl = s.lvl - 1 group by s.{key}, s.pos",
        ),
        (
            "kept",
            f"select t.* from tok t where not exists (select 1 from ranges r where r.{key} = t.{key} "
            f"and t.pos between r.a and r.b)",
        ),
        (
            "stripped",
            f"select s.{key}, coalesce(string_agg(k.text, '' order by k.pos), '') as html from {source} s "
            f"left join kept k on k.{key} = s.{key} group by s.{key}",
        ),
    ]


# --- content ---------------------------------------------------------------------


def container_steps(source: str, key: str, tag: str, out: str) -> list[tuple[str, str]]:
    """Nesting-aware container by running depth over the pieces between marks."""
    p = f"{out}_p"
    mark = f"(?i)(<{tag}|</{tag}>)"
    split = f"string_split({rx('html', mark, chr(1) + chr(92) + '1')}, chr(1))".replace(
        f"'{chr(1)}{chr(92)}1'", "chr(1) || '\\1'"
    )
    return [
        (
            f"{p}1",
            f"select {key}, unnest({split}) as piece, generate_subscripts({split}, 1) as i from {source}",
        ),
        (
            f"{p}2",
            f"select *, case when lower(left(piece, {len(tag) + 1})) = '<{tag}' then 1 "
            f"when lower(left(piece, {len(tag) + 3})) = '</{tag}>' then -1 else 0 end as d, "
            f"min(case when lower(left(piece, {len(tag) + 1})) = '<{tag}' then i end) over (partition by {key}) as first "
            f"from {p}1",
        ),
        (
            f"{p}3",
            f"select *, sum(d) over (partition by {key} order by i) as depth from {p}2 where i >= first",
        ),
        (
            f"{p}4",
            f"select *, min(case when depth = 0 and d = -1 then i end) over (partition by {key}) as closing from {p}3",
        ),
        (
            out,
            f"select {key}, string_agg(case when i < closing then piece else left(piece, {len(tag) + 3}) end, '' order by i) as part "
            f"from {p}4 where i <= closing group by {key}",
        ),
    ]


def contained(source: str, key: str) -> list[tuple[str, str]]:
    return (
        container_steps(source, key, "article", "art")
        + container_steps(source, key, "main", "mai")
        + [
            (
                "contained",
                f"select s.{key}, coalesce(a.part, m.part, s.html) as html from {source} s "
                f"left join art a on a.{key} = s.{key} left join mai m on m.{key} = s.{key}",
            )
        ]
    )


def footer_cut(html: str) -> str:
    marks = ", ".join(f"strpos(lower({html}), 'id=\"{i}\"')" for i in config.FOOTER_IDS)
    cut = f"list_min(list_filter([{marks}], lambda p: p > 1))"
    before = f"left({html}, {cut} - 1)"
    back = f"strpos(reverse(lower({before})), 'h<')"
    at = f"(length({before}) - {back})"
    return (
        f"case when {cut} is null then {html} when {back} > 0 and {at} > 1 "
        f"then left({before}, {at} - 1) else {before} end"
    )


def html_cap(html: str, cap: int) -> str:
    head = f"left({html}, {cap} + 1)"
    back = f"strpos(reverse({head}), '>')"
    return (
        f"case when length({html}) <= {cap} then {html} when {back} > 0 and {back} <= {cap} "
        f"then left({head}, length({head}) - {back} + 1) else left({html}, {cap}) end"
    )


# --- markdown --------------------------------------------------------------------

_BLOCK = (
    "html|head|body|title|nav|ul|article|main|h[1-6]|p|div|footer|pre|span_never|table|tr|td|th|section|header|aside"
)


def rendered(html: str) -> str:
    """Rendering of the markup that occurs in pages, derived flight text and single-level lists."""
    x = rx(html, r"<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<![^>]*>", "", "gis")
    x = rx(x, r"[ \t\r\n\f]+", " ")
    x = rx(x, r'<a href="([^"]*)">([^<]*)</a>', r"[\2](\1)", "gi")
    for n in range(1, 7):
        x = rx(x, f"<h{n}> *", "\n\n" + "#" * n + " ", "gi")
    x = rx(x, r"(?:</li> *)?<li[^>]*> *", "\n- ", "gi")
    x = f"replace({x}, '<br>', chr(1))"
    x = rx(x, rf"</?(?:{_BLOCK})(?:\s[^>]*)?>", "\n\n", "gi")
    x = rx(x, r"</?[a-z][^>]*>", "", "gi")
    x = rx(x, r" *\n *", "\n")
    x = f"regexp_replace({x}, '( *\\x01 *)+(\\n|$)', '\\2', 'g')"
    x = f"regexp_replace({x}, ' *\\x01 *', '  ' || chr(10), 'g')"
    x = rx(x, r"(#|-) {2,}", r"\1 ")
    x = rx(x, r"\n{3,}", "\n\n")
    x = rx(x, r"^[ \n]+|[ \n]+$", "")
    for entity, char in (("&quot", '"'), ("&copy", "\u00a9"), ("&middot", "\u00b7"), ("&lt", "<"), ("&gt", ">"), ("&amp", "&")):
        x = rx(x, entity + ";?", char)
    return x


def navigation_links(x: str) -> str:
    for texts in (config.SKIP_LINK_TEXTS, config.TOP_LINK_TEXTS):
        x = rx(x, r"\[(?:%s)\]\(#[^)]*\)" % "|".join(texts), "", "gi")
    return x


def navigation_phrases(x: str) -> str:
    glue = rf"[{_W}*_#\-]"
    for phrases in (config.NAVIGATION_PHRASES, config.COPY_PHRASES):
        pattern = "|".join(
            rf"(?:^|{glue}+){p.replace(' ', glue + '*')}(?:$|{glue}+)" for p in phrases
        )
        x = rx(x, f"(?im){pattern}", "\n")
    return x


def blank_lines(x: str) -> str:
    return rx(x, rf"(?m)^[{_W}]*[\r\n]")


def empty_links(x: str) -> str:
    return rx(x, rf"\[[{_W}]*\]\([^)]*\)")


def strip_links(x: str) -> str:
    return rx(x, r"\[([^\]]+)\]\([^)]+\)", r"\1")


def edit_markers(x: str) -> str:
    cite = "|".join(m.replace("?", r"\?") for m in config.CITATION_MARKERS)
    x = rx(x, rf"\[[{_W}]*(?:{'|'.join(config.EDIT_MARKERS)})[{_W}]*\]")
    x = rx(x, rf"\[[{_W}]*(?:{cite})[{_W}]*\]", "", "gi")
    return rx(x, r"\[[0-9]{1,3}\]")


def alt_text(x: str) -> str:
    pattern = r"!\[[^\]]{121,}\]\([^)]+\)"
    short = (
        f"'![' || {trim('left(substr(p, 3), 117)')} || '...' || regexp_extract(p, {q(r'(\]\([^)]+\))$')}, 1)"
    )
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, {q(pattern + '|[^!]+|!')}), "
        f"lambda p: case when regexp_matches(p, {q('^' + pattern + '$')}) then {short} else p end), '')"
    )


def code_fences(x: str) -> str:
    lang = "|".join(config.CODE_LANGUAGES)
    path = rf"(?:[\w\-./]+\.)?({lang})(?:\b|$)"
    for middle in (rf"({lang})\n", rf"({lang})\n\n", rf"{path}\n", rf"{path}\n\n", rf"{path}[{_W}]*"):
        x = rx(x, rf"(?m)^{middle}```\n", "```\\1\n")
    return x


def unescape(x: str) -> str:
    marks = "".join("\\" + ch for ch in config.UNESCAPED_PUNCTUATION)
    return rx(x, rf"\\([{marks}])", r"\1")


def newline_runs(x: str) -> str:
    return rx(x, r"\n{3,}", "\n\n")


def column_step(src: str, key: str, md: str, expr: str) -> str:
    return f"select {key}, {expr} as {md} from {src}"


def multiline_steps(src: str, key: str, md: str, out: str) -> list[tuple[str, str]]:
    """Clamped depth as running sum minus running minimum."""
    pieces = f"regexp_extract_all({md}, '[\\[\\]]|[^\\[\\]]+')"
    return [
        (f"{out}_1", f"select {key}, unnest({pieces}) as p, generate_subscripts({pieces}, 1) as i from {src}"),
        (
            f"{out}_2",
            f"select *, sum(case p when '[' then 1 when ']' then -1 else 0 end) over (partition by {key} order by i) as s from {out}_1",
        ),
        (
            f"{out}_3",
            f"select *, s - least(0, min(s) over (partition by {key} order by i)) as depth from {out}_2",
        ),
        (
            out,
            f"select s.{key}, coalesce(string_agg(case when depth > 0 then replace(p, chr(10), chr(92) || chr(10)) else p end, '' order by i), '') as {md} "
            f"from {src} s left join {out}_3 t on t.{key} = s.{key} group by s.{key}",
        ),
    ]


def _lines(src: str, key: str, md: str, out: str) -> tuple[str, str]:
    split = f"string_split({md}, chr(10))"
    return (out, f"select {key}, unnest({split}) as line, generate_subscripts({split}, 1) as i from {src}")


def _unlines(src: str, lines: str, key: str, md: str, out: str) -> tuple[str, str]:
    return (
        out,
        f"select s.{key}, coalesce(string_agg(line, chr(10) order by i), '') as {md} from {src} s "
        f"left join {lines} t on t.{key} = s.{key} group by s.{key}",
    )


def table_steps(src: str, key: str, md: str, out: str) -> list[tuple[str, str]]:
    return [
        _lines(src, key, md, f"{out}_1"),
        (f"{out}_2", f"select *, {trim('line')} as t from {out}_1"),
        (
            f"{out}_3",
            f"select *, list_transform(string_split(t, '|'), lambda c: {trim('c')}) as parts from {out}_2",
        ),
        (
            f"{out}_4",
            f"select *, parts[2:len(parts) - case when ends_with(t, '|') then 1 else 0 end] as cells from {out}_3",
        ),
        (f"{out}_5", f"select *, list_filter(cells, lambda c: c <> '') as filled from {out}_4"),
        (
            f"{out}_6",
            f"select {key}, i, case when not (starts_with(t, '|') or ends_with(t, '|')) then line "
            f"when len(cells) > 2 and (len(cells) - len(filled))::double / len(cells) > 0.7::double then array_to_string(filled, ' ') "
            f"else line end as line from {out}_5 where not (contains(t, '|') and regexp_matches(t, {q(rf'^[|{_W}\-:]*$')})) "
            f"and not ((starts_with(t, '|') or ends_with(t, '|')) and len(filled) = 0)",
        ),
        _unlines(src, f"{out}_6", key, md, out),
    ]


def heading_steps(src: str, key: str, md: str, out: str) -> list[tuple[str, str]]:
    return [
        _lines(src, key, md, f"{out}_1"),
        (
            f"{out}_2",
            f"select *, {trim('line')} = '' as blank, case when regexp_matches(line, {q(rf'^#{{1,6}}[{_W}]+[^\r\n]+$')}) "
            f"then {trim('line')} end as h from {out}_1",
        ),
        (
            f"{out}_3",
            f"select {key}, i, h, lag(h) over (partition by {key} order by i) as before from {out}_2 where not blank",
        ),
        (
            f"{out}_4",
            f"select l.* from {out}_2 l left join {out}_3 n on n.{key} = l.{key} and n.i = l.i "
            f"where not coalesce(n.h = n.before, false)",
        ),
        _unlines(src, f"{out}_4", key, md, out),
    ]


def cleaning(src: str, key: str, md: str, out: str) -> list[tuple[str, str]]:
    """All eleven cleaners and the trim, ending in ``out(key, md)``."""
    steps = multiline_steps(src, key, md, f"{out}a")
    x = strip_links(empty_links("x"))
    nav = blank_lines(navigation_phrases(navigation_links(md)))
    steps.append((f"{out}b", f"select {key}, {nav} as x from {out}a"))
    steps.append((f"{out}c", f"select {key}, {edit_markers(x)} as {md} from {out}b"))
    steps += table_steps(f"{out}c", key, md, f"{out}d")
    steps.append((f"{out}e", column_step(f"{out}d", key, md, alt_text(md))))
    steps += heading_steps(f"{out}e", key, md, f"{out}f")
    steps.append((f"{out}g", column_step(f"{out}f", key, md, code_fences(md))))
    steps.append((out, column_step(f"{out}g", key, md, trim(newline_runs(unescape(md))))))
    return steps


# --- flight ----------------------------------------------------------------------

_PUSH = r'self\.__next_f\.push\(\[1,"((?:[^"\\]|\\.)*)"\]\)'


def flight_steps(source: str) -> list[tuple[str, str]]:
    """Steps ending in ``texts(k, text)`` and ``parts(k, kind, place, level, text)``."""
    text = "array_to_string(list(payload order by pos), chr(10))"
    for old, new in (("\\\\n", "chr(10)"), ('\\\\"', "chr(34)"), ('\\"', "chr(34)"), ("\\\\", "chr(92)")):
        text = f"replace({text}, {q(old)}, {new})"
    heading = r'"as"\s*:\s*"h[1-6]"[^}]*?"children"\s*:\s*"[^"]{3,}"'
    body = r'"children"\s*:\s*"[^"]{40,}"'

    def cleaned(m: str) -> str:
        x = f"regexp_extract({m}, {q('"([^"]*)"$')}, 1)"
        for old, new in (("\\n", "' '"), ("\\t", "' '"), ('\\"', "chr(34)"), ("\\\\", "chr(92)")):
            x = f"replace({x}, {q(old)}, {new})"
        return trim(x)

    return [
        ("marked", f"select k, html from {source} where contains(html, '__next_f')"),
        (
            "payloads",
            f"select k, unnest(regexp_extract_all(html, {q(_PUSH)}, 1)) as payload, "
            f"generate_subscripts(regexp_extract_all(html, {q(_PUSH)}, 1), 1) - 1 as pos from marked",
        ),
        ("texts", f"select k, {text} as text from payloads group by k"),
        (
            "found",
            f"select k, 0 as kind, unnest(regexp_extract_all(text, {q(heading)})) as m, text from texts union all "
            f"select k, 1 as kind, unnest(regexp_extract_all(text, {q(body)})) as m, text from texts",
        ),
        (
            "placed",
            f"select k, kind, m, strpos(text, m) as place, regexp_extract(m, '^\"as\"\\s*:\\s*\"(h[1-6])\"', 1) as level, "
            f"{cleaned('m')} as text from found",
        ),
        (
            "usable",
            "select * from placed where text <> '' and (kind = 0 or not (contains(text, '{') or contains(text, 'function') "
            "or contains(text, '/_next/') or starts_with(text, '$')))",
        ),
        (
            "parts",
            "select k, kind, place, level, text from usable qualify row_number() over (partition by k, text order by kind, place) = 1",
        ),
    ]


_FLIGHT_HTML = (
    "select d.k, coalesce(string_agg(case when p.kind = 0 then '<' || level || '>' || text || '</' || level || '>' "
    "else '<p>' || text || '</p>' end, chr(10) order by place), '') as html from {source} d left join parts p on p.k = d.k group by d.k"
)


# --- metadata ----------------------------------------------------------------------


def meta(head: str, name: str) -> str:
    p = (
        f"""(?i)<meta[^>]+(?:name|property)=["']{name}["'][^>]+content=["']([^"']*?)["']"""
        f"""|<meta[^>]+content=["']([^"']*?)["'][^>]+(?:name|property)=["']{name}["']"""
    )
    return f"(regexp_extract({head}, {q(p)}, 1) || regexp_extract({head}, {q(p)}, 2))"


def head(html: str) -> str:
    return (
        f"case when strpos({html}, '</head>') > 1 then left({html}, strpos({html}, '</head>') - 1) else left({html}, 10000) end"
    )


def title_tag(h: str) -> str:
    return trim(f"regexp_extract({h}, '(?i)<title[^>]*>([^<]*)</title>', 1)")


_LD = """try_cast(regexp_extract(html, '(?is)<script[^>]+type=["'']application/ld\\+json["''][^>]*>(.*?)</script>', 1) as json)"""
_LD_STEPS = [
    ("ld", f"select k, {_LD} as j from {duck('d_jsonld')}"),
    (
        "node",
        "select k, case when json_type(j, '$.\"@graph\"') = 'ARRAY' then coalesce(list_filter(cast(j->'$.\"@graph\"' as json[]), "
        "lambda x: json_type(x, '$.\"@type\"') = 'VARCHAR' and x->>'$.\"@type\"' in "
        f"{names(config.JSONLD_GRAPH_TYPES)})[1], j) else j end as n from ld",
    ),
]


def _ld_name(field: str, nested: str) -> str:
    return (
        f"nullif(case when json_type(n, '$.{field}') = 'VARCHAR' then n->>'$.{field}' else n->>'$.{nested}' end, '')"
    )


_LD_FIELDS = (
    f"select k, {_ld_name('author', 'author.name')} as author, nullif(n->>'$.datePublished', '') as date_published, "
    f"{_ld_name('publisher', 'publisher.name')} as publisher, {_ld_name('image', 'image.url')} as image from node"
)

_HEAD_COLUMNS = (
    f"select k, h, nullif({meta('h', 'og:title')}, '') as og_title, nullif({title_tag('h')}, '') as tag_title, "
    f"nullif({meta('h', 'description')}, '') as descr, nullif({meta('h', 'author')}, '') as author, "
    f"nullif({meta('h', 'og:site_name')}, '') as site, {meta('h', 'keywords')} as kw, "
    f"""nullif(regexp_extract(h, '(?i)<html[^>]+lang=["'']([^"'']+)["'']', 1), '') as language """
    f"from (select k, {head('html')} as h from {duck('d_head')})"
)


# --- snapshots and throttle ----------------------------------------------------------

_EVENTS = "select event_id, event_type, cast(floor(epoch(ts)) as bigint) as second from events"


def anchored(length: int) -> list[tuple[str, str]]:
    """Windows by recursion over the distinct seconds of a key."""
    return [
        ("ev", _EVENTS),
        ("secs", "select distinct event_type, second from ev"),
        (
            "starts",
            "select event_type, min(second) as s from secs group by event_type union all "
            "select t.event_type, (select min(x.second) from secs x where x.event_type = t.event_type "
            f"and x.second > t.s + {length}) from starts t where t.s is not null",
        ),
        (
            "counted",
            "select e.event_id, e.event_type, w.s as window_start, row_number() over (partition by e.event_type, w.s "
            "order by e.second, e.event_id) as request_count from ev e asof join (select * from starts where s is not null) w "
            "on w.event_type = e.event_type and w.s <= e.second",
        ),
    ]


def recursive(steps: list[tuple[str, str]], final: str) -> str:
    return with_steps(steps, final).replace("with ", "with recursive ", 1)


_SNAP = duck("d_snapshot")
_KEYED = f"select k as page_id, {normalized('url')} as url_key, created_at from {_SNAP}"
_STORED = (
    "select url_key, 'doc ' || page_id as document, created_at from keyed where page_id % 2 = 0 "
    "qualify row_number() over (partition by url_key order by created_at desc, page_id desc) = 1"
)


def _document_steps(source: str) -> list[tuple[str, str]]:
    """From ``source(page_id, url_key, html)`` to ``documents`` for the given pages."""
    header = (
        "concat_ws(chr(10), 'Title: ' || nullif(title, ''), 'URL Source: ' || url_key, 'Language: ' || language)"
    )
    word = f"len({words('body')})"
    return (
        [("src", f"select page_id, html from {source}")]
        + contained("src", "page_id")
        + [
            ("narrowed", f"select page_id, {html_cap(footer_cut('html'), config.MAX_HTML_CHARS)} as html from contained"),
        ]
        + stripped("narrowed", "page_id")
        + [("raw", f"select page_id, {rendered('html')} as markdown from stripped")]
        + cleaning("raw", "page_id", "markdown", "cl")
        + [
            (
                "heads",
                f"select page_id, {title_tag('h')} as title, regexp_extract(h, '(?i)<html[^>]+lang=\"([^\"]+)\"', 1) as language "
                f"from (select page_id, {head('html')} as h from {source})",
            ),
            (
                "bodied",
                "select s.page_id, s.url_key, h.title, '' as description, nullif(h.language, '') as language, c.markdown, "
                f"coalesce(nullif(c.markdown, ''), {q(config.EMPTY_BODY)}) as body from {source} s "
                "join heads h on h.page_id = s.page_id join cl c on c.page_id = s.page_id",
            ),
            (
                "documents_out",
                f"select page_id, url_key, title, description, language, markdown, {header} || chr(10) || 'Word Count: ' || {word} "
                "|| chr(10) || chr(10) || '---' || chr(10) || chr(10) || body as document from bodied",
            ),
        ]
    )


_KEYED_PAGES = ("keyed_pages", f"select page_id, {normalized('url')} as url_key, html from pages")


def _md(expr: str) -> str:
    return f"select k, {expr} as md from {duck('d_md')}"


def build() -> dict[str, str]:
    md_src = [("src", f"select * from {duck('d_md')}")]
    html_src = [("src", f"select * from {duck('d_html')}")]
    flight_src = [("src", f"select * from {duck('d_flight')}")]
    page_tok = [("tok", token_rows("pages", "page_id"))]
    html_tok = html_src + [("tok", token_rows("src", "k"))]
    roles = [v for _, n, v in config.exclude_rules() if n == "role"]
    inline = "regexp_extract_all(html, '<code>([^<]*)</code>', 1)"
    blocks = "regexp_extract_all(html, '<pre><code[^>]*>([^<]*)</code>', 1)"

    def every(found: str) -> str:
        """A row for each item of a list, with its place from 0."""
        return f"(select k, unnest(range(len(l))) as pos, unnest(l) as t from (select k, {found} as l from {duck('d_html')}))"

    ld = with_steps(_LD_STEPS, _LD_FIELDS)
    out = {
        "page_scan": "select page_id, url, length(html)::bigint as html_chars from pages",
        "accept_filter": f"select k, url from {duck('d_crawl')} where status between 200 and 299 and "
        "regexp_matches(coalesce(content_type, ''), 'html|text|xml')",
        "url_guard": f"select k, case when url = '' then 'Missing URL' end as error from {duck('d_crawl')}",
        "error_rows": "select * from (select k, case when url = '' then 'Missing URL' when status not between 200 and 299 then "
        "'HTTP ' || status when not regexp_matches(coalesce(content_type, ''), 'html|text|xml') then "
        f"'Unsupported content type: ' || coalesce(content_type, '') end as error from {duck('d_crawl')}) where error is not null",
        "url_scheme": f"select k, {scheme('url')} as url from {duck('d_url')}",
        "url_parts": "select page_id, regexp_extract(url, '^(\\w+):', 1) as scheme, lower(regexp_extract(url, '^\\w+://([^/?#]*)', 1)) as host, "
        "'' as port, regexp_extract(url, '^\\w+://[^/?#]*([^?#]*)', 1) as path, nullif(regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1), '') as query, "
        "nullif(regexp_extract(url, '(#.*)$', 1), '') as fragment from pages",
        "normalize_url": f"select page_id, {normalized('url')} as url_key from pages",
        "url_ports": f"select k, regexp_extract({normalized('url')}, '^https://([^/?]*)', 1) as authority from {duck('d_url')}",
        "url_hosts": _HOSTS,
        "url_tracking": "select page_id, len(regexp_extract_all(url, '[?&](?:"
        + "|".join(config.TRACKING_PARAMS)
        + f")(?:=|&|#|$)'))::bigint as dropped, contains({normalized('url')}, '?')::int as query_left from pages",
        "url_param_sort": f"select k, {normalized('url')} as url_key from {duck('d_url')}",
        "dedup_pages": with_steps(
            [
                ("keyed", _KEYED),
                (
                    "crawled",
                    "select * from keyed union all select page_id + 1000000, url_key, created_at + 30 from keyed where page_id % 7 = 0",
                ),
            ],
            "select url_key, page_id, created_at from crawled "
            "qualify row_number() over (partition by url_key order by created_at desc, page_id desc) = 1",
        ),
        "resolve_links": with_steps(
            page_tok
            + [
                (
                    "links",
                    "select t.page_id, t.pos, t.tag, regexp_extract(t.text, ' href=\"([^\"]*)\"', 1) as href, p.url from tok t "
                    "join pages p on p.page_id = t.page_id where t.kind = 'open' and t.tag = 'a'",
                )
            ],
            "select page_id, pos::bigint as pos, tag, href, 'https://' || lower(regexp_extract(url, '^\\w+://([^/?#]*)', 1)) || "
            "replace(replace(replace(replace(url_encode(href), '%2F', '/'), '%2C', ','), '%3B', ';'), '%27', '''') as target from links where href <> ''",
        ),
        "canonical_mismatch": "select k, c as canonical, coalesce(c <> url, false)::int as differs from (select k, url, case k % 4 "
        "when 0 then 'https://h.example.com/s/' || k when 1 then 'https://h.example.com/main/x' end as c "
        f"from {duck('d_canonical')})",
        "head_slice": f"select page_id, {head('html')} as head from pages",
        "meta_tags": "select k, "
        + ", ".join(
            f"{meta('h', n)} as {n.replace(':', '_')}"
            for n in ("og:title", "description", "author", "og:site_name", "keywords")
        )
        + f" from (select k, {head('html')} as h from {duck('d_head')})",
        "page_title": f"select page_id, {title_tag(head('html'))} as title from pages",
        "page_description": f"select k, {meta(head('html'), 'description')} as description from {duck('d_head')}",
        "meta_struct": with_steps(
            _LD_STEPS + [("f", _LD_FIELDS), ("hd", _HEAD_COLUMNS)],
            "select k, coalesce(og_title, tag_title, '') as title, coalesce(descr, '') as description, coalesce(og_title, tag_title) as meta_title, "
            "author, language, site, null::varchar as published, null::varchar as publisher, null::varchar as image from hd union all "
            "select -k - 1, '', '', null, author, null, null, date_published, publisher, image from f",
        ),
        "page_language": "select page_id, nullif(regexp_extract(html, '<html[^>]+lang=\"([^\"]+)\"', 1), '') as language from pages",
        "meta_keywords": f"select k, array_to_string(list_filter(list_transform(string_split(kw, ','), lambda w: {trim('w')}), lambda w: w <> ''), '|') as keywords "
        f"from ({_HEAD_COLUMNS})",
        "jsonld_fields": ld,
        "jsonld_graph": with_steps(_LD_STEPS, "select k, case when json_type(n, '$.\"@type\"') = 'VARCHAR' then n->>'$.\"@type\"' end as type from node"),
        "container_extract": with_steps(
            [("src", f"select page_id as k, html from pages union all select -k - 1, html from {duck('d_nested')}")]
            + contained("src", "k"),
            "select k, html as content from contained",
        ),
        "footer_cut": f"select k, {footer_cut('html')} as content from {duck('d_html')}",
        "html_cap": f"select page_id, {html_cap('html', HTML_CAP)} as content from pages",
        "main_content": with_steps(
            contained("pages", "page_id"),
            f"select page_id, {html_cap(footer_cut('html'), config.MAX_HTML_CHARS)} as content from contained",
        ),
        "html_tokens": with_steps(
            page_tok,
            "select page_id, pos::bigint as pos, kind, tag, case when kind in ('open', 'raw') then array_to_string(list_transform("
            "regexp_extract_all(regexp_extract(text, '^<[^>]*>'), '\\s([a-z]+=\"[^\"]*\")', 1), lambda a: replace(a, '\"', '')), '|') else '' end as attrs, text from tok",
        ),
        "raw_tokens": with_steps(
            [("src", f"select * from {duck('d_raw')}"), ("tok", token_rows("src", "k"))],
            "select k, pos::bigint as pos, kind, tag, text from tok",
        ),
        "exclude_rules": with_steps(
            [
                ("rules", "select * from (values " + ", ".join(
                    f"({q(k)}, {q(n)}, {q(v) if v else 'null::varchar'})" for k, n, v in config.exclude_rules()
                ) + ") as r(kind, name, value)"),
                ("src", f"select page_id as k, html from pages union all select -k - 1, html from {duck('d_html')}"),
                ("tok", token_rows("src", "k")),
                ("tags", "select *, regexp_extract(text, '^<[^>]*>') as t from tok where kind in ('open', 'raw')"),
                (
                    "marks",
                    "select 'tag' as kind, tag as name, null::varchar as value from tags union all "
                    "select 'class', unnest(list_distinct(regexp_split_to_array(regexp_extract(t, '\\sclass=\"([^\"]*)\"', 1), '\\s+'))), null from tags union all "
                    "select 'id', regexp_extract(t, '\\sid=\"([^\"]*)\"', 1), null from tags union all "
                    "select 'attr', 'role', regexp_extract(t, '\\srole=\"([^\"]*)\"', 1) from tags union all "
                    "select 'attr', 'hidden', null from tags where regexp_matches(t, '\\shidden\\b')",
                ),
            ],
            "select r.kind, r.name, r.value, count(m.kind)::bigint as hits from rules r left join marks m on m.kind = r.kind and m.name = r.name "
            "and (r.value is null or m.value = r.value) group by r.kind, r.name, r.value",
        ),
        "match_tag": with_steps(page_tok, f"select page_id, pos::bigint as pos, tag from tok where kind in ('open', 'raw') and tag in {names(_RULES['tag'])}"),
        "match_class": with_steps(
            page_tok,
            "select page_id, pos::bigint as pos, tag from tok where kind = 'open' and list_has_any(regexp_split_to_array("
            f"regexp_extract(text, '\\sclass=\"([^\"]*)\"', 1), '\\s+'), {array(_RULES['class'])})",
        ),
        "match_id": with_steps(html_tok, f"select k, pos::bigint as pos, tag from tok where kind = 'open' and regexp_extract(text, '\\sid=\"([^\"]*)\"', 1) in {names(_RULES['id'])}"),
        "match_attr": with_steps(
            html_tok,
            "select k, pos::bigint as pos, tag from tok where kind = 'open' and (regexp_extract(text, '\\srole=\"([^\"]*)\"', 1) in "
            f"{names(roles)} or regexp_matches(text, '\\shidden\\b'))",
        ),
        "strip_elements": with_steps(stripped("pages", "page_id"), "select page_id, html from stripped"),
        "strip_derived": with_steps(html_src + stripped("src", "k"), "select k, html from stripped"),
        "strip_custom": "select k, "
        + rx("html", r'<nav [^>]*>n</nav>|<i role="note">r</i>|<code class="x language-sql">[^<]*</code>|<h2 id="references">T</h2>')
        + f" as html from {duck('d_html')}",
        "strip_raw": with_steps(
            [("src", f"select * from {duck('d_raw')}"), *stripped("src", "k")], "select k, html from stripped"
        ),
        "render_markdown": f"select page_id, {rendered('html')} as markdown from pages",
        "render_blocks": "select c_custkey as k, "
        + "replace(replace(" + q(
            "## {n} & co\n\na **bold** and _it alic_, ~~no~~  \nnext\n\n- one\n- two\n   1. x\n   2. y [link](/l)\n\n"
            "unclosed\n\n![pic](i.png)\n\n| h | k |\n| --- | --- |\n| {m} | 2 |\n\n---\n\n> q1\n> q2\n\n\u00a9 \u00e9\u263a <x>"
        ) + ", '{n}', c_name), '{m}', c_mktsegment) as markdown from customer",
        "render_code": "select c_custkey as k, c_name || " + q("\n\nin\n\nh\n\nn\n\n_r_\n\n```sql\nselect 1\n  from t\n```\n\n")
        + " || case when c_custkey % 3 = 0 then '``` a`b`` ```' else '``a`b``' end || " + q("\n\n## T\n\ntail") + " as markdown from customer",
        "inline_code": "select k, pos, case when ends_with(t, '`') then '``` ' || t || ' ```' else '``' || t || '``' end as code from " + every(inline),
        "fenced_code": "select k, pos, '```sql' || chr(10) || rtrim(t, chr(10)) || chr(10) || '```' as code from " + every(blocks),
        "multiline_links": with_steps(md_src + multiline_steps("src", "k", "md", "done"), "select k, md from done"),
        "nav_links": _md(navigation_links("md")),
        "nav_phrases": _md(navigation_phrases("md")),
        "blank_lines": _md(blank_lines("md")),
        "empty_links": _md(empty_links("md")),
        "strip_links": _md(strip_links("md")),
        "edit_markers": _md(edit_markers("md")),
        "table_cleanup": with_steps(md_src + table_steps("src", "k", "md", "done"), "select k, md from done"),
        "alt_text": _md(alt_text("md")),
        "dup_headings": with_steps(md_src + heading_steps("src", "k", "md", "done"), "select k, md from done"),
        "code_fences": _md(code_fences("md")),
        "unescape_md": _md(unescape("md")),
        "newline_runs": _md(newline_runs("md")),
        "clean_markdown": with_steps(
            [("src", f"select k, md as markdown from {duck('d_md')}")] + cleaning("src", "k", "markdown", "done"),
            "select k, markdown from done",
        ),
        "flight_pages": f"select k from {duck('d_flight')} where html like '%\\_\\_next\\_f%' escape '\\'",
        "flight_payloads": with_steps(flight_src + flight_steps("src"), "select k, pos::bigint as pos, payload from payloads"),
        "flight_text": with_steps(flight_src + flight_steps("src"), "select k, text from texts"),
        "flight_headings": with_steps(flight_src + flight_steps("src"), "select k, level, text from parts where kind = 0"),
        "flight_body": with_steps(flight_src + flight_steps("src"), "select k, text from parts where kind = 1"),
        "flight_document": with_steps(flight_src + flight_steps("src"), _FLIGHT_HTML.format(source="src")),
        "sparse_fallback": with_steps(
            flight_src
            + flight_steps("src")
            + [
                ("rebuilt", _FLIGHT_HTML.format(source="src")),
                ("raw", f"select k, case when html = '' then null else {rendered('html')} end as markdown from rebuilt"),
                ("raw2", "select k, markdown from raw where markdown is not null"),
            ]
            + cleaning("raw2", "k", "markdown", "done"),
            "select s.k, coalesce(d.markdown, '# ' || regexp_extract(s.html, '<h1>([^<]*)', 1)) as markdown from src s left join done d on d.k = s.k",
        ),
        "word_count": f"select doc_id, len({words('text')})::bigint as words from documents",
        "word_cap": "select doc_id, case when len(w) > {c} then array_to_string(w[1:{c}], ' ') || {note} else text end as capped from "
        "(select doc_id, text, regexp_split_to_array(text, {p}) as w from documents)".format(
            c=WORD_CAP, p=q(f"[{_W}]+"), note=q(f"\n\n---\n*Content truncated at {WORD_CAP} words.*")
        ),
        "metadata_header": "select k, concat_ws(chr(10), 'Title: ' || coalesce(og_title, tag_title), 'Description: ' || descr, "
        "'URL Source: https://h.example.com/' || k, 'Language: ' || language, 'Author: ' || author, 'Site Name: ' || site, "
        f"'Keywords: ' || array_to_string(list_filter(list_transform(string_split(kw, ','), lambda w: {trim('w')}), lambda w: w <> ''), ', ')) as header "
        f"from ({_HEAD_COLUMNS})",
        "format_document": f"select doc_id, 'URL Source: ' || source || chr(10) || 'Word Count: ' || len({words('body')}) || chr(10) || chr(10) || '---' "
        f"|| chr(10) || chr(10) || body as document from (select doc_id, source, coalesce(nullif(text, ''), {q(config.EMPTY_BODY)}) as body from documents)",
        "empty_body": f"select doc_id, body, len({words('body')})::bigint as words from (select doc_id, case when doc_id % 3 = 0 or text = '' then "
        f"{q(config.EMPTY_BODY)} else text end as body from documents)",
        "page_documents": with_steps(
            [_KEYED_PAGES] + _document_steps("keyed_pages"),
            "select page_id, url_key, title, description, language, markdown, document from documents_out",
        ),
        "crawl_documents": with_steps(
            [_KEYED_PAGES] + _document_steps("keyed_pages"),
            "select p.page_id, case when e.error is null then d.url_key end as url_key, case when e.error is null then d.document end as document, "
            "e.error from pages p join (select page_id, case when page_id % 11 = 0 or coalesce(url, '') = '' then 'Missing URL' "
            "when page_id % 7 = 0 then 'HTTP 503' when page_id % 5 = 0 then 'Unsupported content type: image/png' "
            "when page_id % 3 = 0 or html is null then 'No page was received' end as error from pages) e on e.page_id = p.page_id "
            "left join documents_out d on d.page_id = p.page_id",
        ),
        "js_trim": f"select k, {trim('s')} as s from {duck('d_space')}",
        "snapshot_lookup": with_steps(
            [("keyed", _KEYED), ("stored", _STORED)],
            "select k.page_id, k.url_key, s.document, case when s.url_key is null then 'MISS' else 'HIT' end as cache from keyed k "
            f"left join stored s on s.url_key = k.url_key and s.created_at > {NOW} - 3600",
        ),
        "snapshot_upsert": with_steps(
            [
                ("keyed", _KEYED),
                ("stored", _STORED),
                (
                    "fresh",
                    f"select url_key, 'new ' || max(page_id) as document, {NOW}::bigint as created_at from keyed where page_id % 3 = 0 group by url_key",
                ),
            ],
            "select * from stored where url_key not in (select url_key from fresh) union all select * from fresh",
        ),
        "incremental_documents": with_steps(
            [
                ("keyed", _KEYED),
                ("stored", _STORED),
                _KEYED_PAGES,
                (
                    "todo",
                    "select * from keyed_pages where url_key not in (select url_key from stored where created_at > "
                    f"{NOW} - 3600) qualify row_number() over (partition by url_key order by page_id desc) = 1",
                ),
            ]
            + _document_steps("todo"),
            "select url_key, document, created_at from stored where url_key not in (select url_key from todo) union all "
            f"select url_key, document, {NOW}::bigint from documents_out",
        ),
        "cache_hits": recursive(
            anchored(config.SNAPSHOT_TTL_SECONDS - 1),
            "select event_id, event_type, window_start, case when request_count = 1 then 'MISS' else 'HIT' end as cache from counted",
        ),
        "anchored_counts": recursive(anchored(EVENT_WINDOW), "select * from counted"),
        "throttle_flags": recursive(
            anchored(EVENT_WINDOW),
            f"select event_id, (request_count > 10)::int as rejected, case when request_count > 10 then {EVENT_WINDOW}::bigint end as retry_after from counted",
        ),
        "client_key": f"select k, coalesce(h1, {trim('string_split(h2, chr(44))[1]')}, 'unknown') as client from {duck('d_log')}",
        "exempt_filter": f"select k, path from {duck('d_log')} where path not in ('/', '/ok')",
    }
    out["absolute_links"] = (
        "with h as (select page_id, html, 'https://' || lower(regexp_extract(url, '^\\w+://([^/?#]*)', 1)) as origin, "
        "string_split(replace(html, '<a href=\"', chr(1)), chr(1)) as parts from pages) select page_id, "
        "parts[1] || coalesce(array_to_string(list_transform(parts[2:], lambda p: '<a href=\"' || origin || "
        "replace(replace(replace(replace(url_encode(regexp_extract(p, '^([^\"]*)', 1)), '%2F', '/'), '%2C', ','), '%3B', ';'), '%27', '''') || "
        "regexp_replace(p, '^[^\"]*', '')), ''), '') as html from h"
    )
    return out


ORACLE: dict[str, str] = build()
