"""Inputs derived from the given tables, in SQL that Spark and DuckDB both run.

The raw pages hold no meta tags, JSON-LD, tables, code or flight data, so these inputs put
such markup around the columns of other tables. All of them grow with their table. Quotes,
backslashes and newlines are written with ``chr``: the engines read escapes differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_Q = "chr(34)"
_B = "chr(92)"
_N = "chr(10)"


def _attr(name: str, value: str) -> str:
    """SQL pieces of ``name="value"`` for use inside ``concat``."""
    return f"'{name}=', {_Q}, {value}, {_Q}"


DERIVED = {
    "d_crawl": """
select o_orderkey k,
  case when o_orderkey % 11 = 0 then '' else concat('https://h.example.com/', cast(o_orderkey as string)) end url,
  cast(case when o_orderkey % 7 = 0 then 404 else 200 end as int) status,
  case o_orderkey % 4 when 0 then 'text/html' when 1 then 'application/xhtml+xml' when 2 then 'image/png'
    else cast(null as string) end content_type
from {orders}""",
    "d_url": """
select p_partkey k, concat(
  case p_partkey % 4 when 0 then 'http://' when 1 then 'https://' when 2 then '' else 'HTTPBIN.org.' end,
  'Ex.Example.COM', case p_partkey % 3 when 0 then ':80' when 1 then ':8080' else '' end, '/p/',
  cast(p_size as string), case when p_partkey % 5 = 0 then '/' else '' end,
  case when p_partkey % 10 = 0 then '' else concat('?b=2&utm_source=x&a=', cast(p_partkey % 9 as string),
    case when p_partkey % 2 = 0 then '&ref=y&c' else '&t=a b~*&utm_id=1' end) end, '#f') url
from {part}""",
    "d_head": f"""
select p_partkey k, concat('<html ', {_attr('lang', "'en'")}, '><head><title> ', p_name, ' </title>',
  case when p_partkey % 2 = 0
    then concat('<meta ', {_attr('property', "'og:title'")}, ' ', {_attr('content', 'p_brand')}, '>')
    else concat('<meta ', {_attr('content', 'p_brand')}, ' ', {_attr('name', "'description'")}, '>') end,
  case when p_partkey % 3 = 0
    then concat('<META ', {_attr('name', "'Author'")}, ' ', {_attr('content', 'p_brand')}, '/>') else '' end,
  case when p_partkey % 5 = 0
    then concat('<meta ', {_attr('property', "'og:site_name'")}, ' ', {_attr('content', 'p_type')}, '>')
    else '' end,
  '<meta ', {_attr('name', "'keywords'")}, ' ', {_attr('content', "concat(p_type, ', x,,')")},
  '></head><body></body></html>') html
from {{part}}""",
    "d_jsonld": f"""
select s_suppkey k, concat('<script ', {_attr('type', "'application/ld+json'")}, '>', case s_suppkey % 4
  when 0 then concat('{{{{', {_Q}, 'author', {_Q}, ':', {_Q}, s_name, {_Q}, ',', {_Q}, 'datePublished', {_Q}, ':',
    {_Q}, '2024-01-15', {_Q}, ',', {_Q}, 'image', {_Q}, ':[', {_Q}, 'i.png', {_Q}, ']}}}}')
  when 1 then concat('{{{{', {_Q}, '@graph', {_Q}, ':[{{{{', {_Q}, '@type', {_Q}, ':[', {_Q}, 'Article', {_Q}, '],',
    {_Q}, 'author', {_Q}, ':', {_Q}, 'no', {_Q}, '}}}},{{{{', {_Q}, '@type', {_Q}, ':', {_Q}, 'Article', {_Q}, ',',
    {_Q}, 'author', {_Q}, ':{{{{', {_Q}, 'name', {_Q}, ':', {_Q}, s_name, {_Q}, '}}}},', {_Q}, 'publisher', {_Q}, ':',
    {_Q}, s_name, {_Q}, '}}}}]}}}}')
  when 2 then concat('{{{{', {_Q}, '@graph', {_Q}, ':[],', {_Q}, 'image', {_Q}, ':{{{{', {_Q}, 'url', {_Q}, ':', {_Q},
    s_name, {_Q}, '}}}}}}}}')
  else '{{{{bad' end, '</script>') html
from {{supplier}}""",
    "d_canonical": f"""
select s_suppkey k, concat('https://h.example.com/s/', cast(s_suppkey as string)) url,
  concat('<html><head>', case s_suppkey % 4
    when 0 then concat('<link ', {_attr('rel', "'canonical'")}, ' ',
      {_attr('href', "concat('https://H.example.com/s/', cast(s_suppkey as string))")}, '>')
    when 1 then concat('<link ', {_attr('rel', "'canonical'")}, ' ', {_attr('href', "'../main/./x'")}, '>')
    when 2 then concat('<link ', {_attr('href', "'/y'")}, ' ', {_attr('rel', "'canonical'")}, '>')
    else '' end, '</head></html>') html
from {{supplier}}""",
    "d_md": f"""
select doc_id k, concat('# ', source, {_N}, '# ', source, {_N}, {_N}, {_N}, 'go home now [', lang,
  '](u) ![alt](v) [](w) x[1][citation needed]', {_B}, '.', {_N}, '[Back to top](#t) edit this page', {_N},
  '| a | b |', {_N}, '| --- | --- |', {_N}, '| | | | z |', {_N}, '| | |', {_N}, 'text |', {_N}, 'sql', {_N},
  '```', {_N}, 'select 1', {_N}, '```', {_N}, '![', repeat('a', cast(100 + doc_id % 40 as int)), '](i.png)',
  {_N}, {_N}, {_N}, {_N}, text, {_N}, '[open', {_N}, 'end [x]', {_N}, 'last') md
from {{documents}}""",
    "d_flight": f"""
select doc_id k, concat('<article><h1>', source, '</h1></article>', case when doc_id % 7 = 0 then '' else concat(
  '<script>self.__next_f=[]</script><script>self.__next_f.push([1,', {_Q}, '4:{{{{', {_B}, {_Q}, 'as', {_B}, {_Q}, ':',
  {_B}, {_Q}, 'h2', {_B}, {_Q}, ',', {_B}, {_Q}, 'children', {_B}, {_Q}, ':', {_B}, {_Q}, source, {_B}, {_Q},
  '}}}}{{{{', {_B}, {_Q}, 'children', {_B}, {_Q}, ':', {_B}, {_Q},
  replace(replace(replace(replace(text, {_B}, ''), {_Q}, ''), '<', ''), {_N}, concat({_B}, {_B}, 'n')), {_B}, {_Q},
  '}}}}', {_Q}, '])</script><script>self.__next_f.push([1,', {_Q}, '5:{{{{', {_B}, {_Q}, 'as', {_B}, {_Q}, ':', {_B},
  {_Q}, 'h3', {_B}, {_Q}, ',', {_B}, {_Q}, 'children', {_B}, {_Q}, ':', {_B}, {_Q}, source, {_B}, {_Q}, '}}}}{{{{',
  {_B}, {_Q}, 'children', {_B}, {_Q}, ':', {_B}, {_Q}, repeat('function ', 6), {_B}, {_Q}, '}}}}', {_Q},
  '])</script>') end) html
from {{documents}}""",
    "d_log": """
select event_id k, ts, case when event_id % 5 = 0 then cast(null as string) else event_type end h1,
  case when event_id % 10 = 0 then cast(null as string) else concat(' ', event_type, ' ,proxy') end h2,
  case event_id % 6 when 0 then '/' when 1 then '/ok' else '/x' end path
from {events}""",
    "d_html": f"""
select c_custkey k, concat('<main><p>', c_name, '</p><div ', {_attr('id', "'toc'")},
  '><div>in</div></div><span hidden>h</span><nav ', {_attr('role', "'search'")}, '>n</nav><i ',
  {_attr('role', "'note'")}, '>r</i><pre><code ', {_attr('class', "'x language-sql'")}, '>select 1', {_N}, '  from t', {_N},
  '</code></pre><code>a`b', case when c_custkey % 3 = 0 then '``' else '' end, '</code><h2 ',
  {_attr('id', "case when c_custkey % 2 = 0 then 'references' else 'intro' end")},
  '>T</h2><p>tail</p></main>') html
from {{customer}}""",
    "d_nested": f"""
select c_custkey k, concat('<body></article>', case c_custkey % 4
  when 0 then concat('<ARTICLE ', {_attr('class', "'a'")}, '>', c_name, '<article>in</article>out</article>x')
  when 1 then concat('<article>open<main>', c_name, '</main>y')
  when 2 then concat('<mainframe>', c_name, '<main>z</main></main>after')
  else c_name end, '</body>') html
from {{customer}}""",
    "d_rich": f"""
select c_custkey k, concat('<h2>', c_name, ' &amp; co</h2><p>a <b> bold </b> and <i>it', {_N}, 'alic</i>, <del>no</del><br>next</p>',
  '<ul><li><p>one</p></li><li>two<ol><li>x</li><li>y <a ', {_attr('href', "'/l'")}, '>link</a></li></ol></li></ul>',
  '<p><b>unclosed</p><img ', {_attr('alt', "'pic'")}, ' ', {_attr('src', "'i.png'")}, '><table><tr><th>h</th><th>k</th></tr><tr><td>',
  c_mktsegment, '</td><td>2</td></tr></table><hr><blockquote><p>q1</p><p>q2</p></blockquote>&copy; &#233;&#x263A; &lt;x&gt;') html
from {{customer}}""",
    "d_raw": f"""
select c_custkey k, concat('<title>a <nav> ', c_name, '</title>', case c_custkey % 4
  when 0 then concat('<textarea rows=2><nav>', c_mktsegment, '</nav> sample</TEXTAREA ><nav>menu</nav>')
  when 1 then concat('<textarea ', {_attr('class', "'ad'")}, '><p>', c_mktsegment, '</p></textarea><p>p</p>')
  when 2 then concat('<svg><title/><path/><g>x</g></svg><xmp><div hidden>', c_mktsegment, '</xmp>')
  else concat('<svg/><noembed><aside>', c_mktsegment, '</noembed><math><mi>m</mi></math>') end,
  '<p>tail</p>') html
from {{customer}}""",
    "d_host": """
select c_custkey k, case c_custkey % 7
  when 0 then concat('http://', cast(3232235520 + c_custkey % 1000000 as string), '/')
  when 1 then concat('http://0x', lower(hex(3232235520 + c_custkey % 1000000)), ':80')
  when 2 then concat('http://10.', cast(c_custkey % 16777216 as string), '/x')
  when 3 then concat('https://%45x%2Eexample.COM/', cast(c_custkey as string))
  when 4 then concat('https://ＥＸ。example.com/', cast(c_custkey as string))
  when 5 then concat('http://1.2.3.', cast(256 + c_custkey as string), '/')
  else concat('http://', substr('abcdefgh', 1, cast(c_custkey % 8 as int)),
    substr('ÀÉÖßñабвгдЖзий書日本語例ł', cast(1 + c_custkey % 20 as int), 1), 'x.Example/') end url
from {customer}""",
    "d_space": """
select c_custkey k, concat('\u00a0 ', chr(9), c_name, '\u2003', c_mktsegment, chr(10), '\u3000\ufeff') s
from {customer}""",
    "d_snapshot": "select page_id k, url, 1704067200 + page_id * 60 created_at from {pages}",
}

_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(name: str) -> str:
    """The derived input as a DuckDB subquery."""
    return "(" + DERIVED[name].format(**{t: t for t in _TABLES}) + ")"


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(
        DERIVED[name].format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in _TABLES})
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
