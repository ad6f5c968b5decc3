"""A Merkle manifest of a dataset: a digest for every row, group and the whole, with a proof for every row.

A row's leaf is H (lowercase hex SHA-256) of its fields, each ``-`` if null, else byte count, ``:`` and
value. Leaves of a group stand by key; every ``FAN`` consecutive nodes become their H until one is left, and
the groups' subroots, in order of group, become the root the same way. A proof is the sibling digests from
leaf to root.

1. Rank. Narrow rows (keys and digests, no texts) are dealt out by range of group and key, so a group that
   holds most rows lies in many partitions. A row's rank is its place in its partition and group, plus the
   group's rows in earlier partitions: a table of one row for each partition and group.
2. Rollup. The rank's lowest digits address a row in a block of ``FAN ** DIGITS`` leaves. Blocks are
   shuffled once; the digit columns are then grouped away from the last to the first, children nested as
   structs under their node, and no grouping after the first needs a shuffle. A block is the most that one
   row holds, however large the group.
3. Blocks' nodes are the next round's leaves, a thousandth or so in number, until each group is one node;
   then the groups' subroots are leaves of one last tree. Each round's result is written to the shared
   checkpoint folder. A node's path from its block up comes back to it by block number, one row a block.
4. A transform over the nested structs gives each leaf its siblings on each level, and an explode makes rows
   again; no join brings digests to leaves.

Null keys come first. Rows with equal key and equal fields are equal leaves, each with a place of its own;
rows with equal keys and different fields are ordered by leaf. Null groups are a group, the first. An empty
table gives an empty manifest. Extra columns are no part of a leaf; they are dropped, also if their names
are those of results. Texts of any length are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagepress.llm.common import cut, partitions

FAN = 8
DIGITS = 4
BLOCK = FAN**DIGITS
SMALL = 8192
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field_text(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field_text, values)), 256)


def _ranked(rows: DataFrame, group: str, key: str) -> DataFrame:
    """The rows with ``rank`` in their group, from 0, by key and leaf, and ``total``, the group's rows."""
    order = [F.col(group).asc_nulls_first(), F.col(key).asc_nulls_first(), F.col("leaf")]
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    # The number is a function of partition and place; the checkpoint fixes both.
    placed = cut(dealt.withColumn("place", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("place", 33))
    shares = placed.groupBy(F.col(group).alias("_group"), F.col("part").alias("_part")).agg(
        F.min("place").alias("first"), F.count("*").alias("n")
    )
    # One row for each partition a group lies in: in the window a group has as many rows as there are partitions.
    before = "sum(n) over (partition by _group order by _part rows between unbounded preceding and 1 preceding)"
    shares = shares.selectExpr("_group", "_part", "first", f"coalesce({before}, 0) as before", "sum(n) over (partition by _group) as total")
    met = F.col(group).eqNullSafe(F.col("_group")) & (F.col("part") == F.col("_part"))
    ranked = placed.join(_bounded(shares), met).withColumn("rank", F.col("place") - F.col("first") + F.col("before"))
    return ranked.drop("_group", "_part", "part", "place", "first", "before")


def _rollup(leaves: DataFrame, group: str) -> DataFrame:
    """One row for each group and block: ``node``, its digest, and ``kids``, the nested nodes below.

    A node is struct(digit, digest, kids), a leaf's kids are what the row carries. A level that a small group
    has no need of passes its only node on.
    """
    digit = [F.pmod(F.floor(F.col("rank") / FAN**k), F.lit(FAN)).cast("int").alias(f"d{k}") for k in range(DIGITS)]
    carried = [c for c in leaves.columns if c not in (group, "rank", "total", "leaf")]
    rows = leaves.select(
        group, "total", F.floor(F.col("rank") / BLOCK).alias("block"), *digit,
        F.col("leaf").alias("digest"), F.struct(*carried).alias("kids"),
    )
    rows = rows.repartition(group, "block")
    for k in range(DIGITS):
        above = [f"d{j}" for j in range(k + 1, DIGITS)]
        run = F.array_sort(F.collect_list(F.struct(F.col(f"d{k}").alias("digit"), "digest", "kids")))
        rows = rows.groupBy(group, "total", "block", *above).agg(run.alias("run"))
        joined = F.sha2(F.array_join(F.transform("run", lambda c: c.digest), ""), 256)
        digest = F.when(F.col("total") > FAN**k, joined).otherwise(F.col("run")[0]["digest"])
        rows = rows.select(group, "total", "block", *above, digest.alias("digest"), F.col("run").alias("kids"))
    return rows.withColumnRenamed("digest", "node")


def _beside(run: Column, digit: Column, left: bool) -> Column:
    side = F.filter(run, lambda c: c.digit < digit if left else c.digit > digit)
    return F.array_join(F.transform(side, lambda c: c.digest), "")


def _bounded(table: DataFrame) -> DataFrame:
    """The table, marked for broadcast if it is counted to have ``SMALL`` rows at most (of some KB each)."""
    return F.broadcast(table) if table.count() <= SMALL else table


def _paths(blocks: DataFrame, group: str, upper: DataFrame) -> DataFrame:
    """A row for each leaf of the blocks: what it carries, ``root`` and ``path``.

    ``upper`` has for each block's node the root and the path.
    """

    def below(run: Column, level: int, path: Column) -> Column:
        def of(child: Column) -> Column:
            step = F.struct(_beside(run, child.digit, True).alias("left"), _beside(run, child.digit, False).alias("right"))
            # A level that the group has no need of is no part of the path.
            longer = F.when(F.col("total") > FAN**level, F.concat(F.array(step), path)).otherwise(path)
            if level == 0:
                return F.struct(child.kids.alias("row"), longer.alias("path"))
            # An array of one, so that the path is put together once for all that is below.
            return F.flatten(F.transform(F.array(longer), lambda p: below(child.kids, level - 1, p)))

        return F.transform(run, of) if level == 0 else F.flatten(F.transform(run, of))

    upper = _bounded(upper)
    met = blocks.join(upper, blocks[group].eqNullSafe(upper["_group"]) & (blocks["block"] == upper["_block"]))
    leaves = met.select(group, "root", F.explode(below(F.col("kids"), DIGITS - 1, F.col("upper"))).alias("leaf"))
    return leaves.select(group, "root", "leaf.row.*", "leaf.path")


def _climb(leaves: DataFrame, group: str) -> list[DataFrame]:
    """Blocks of each round, from the leaves up, for rows with ``rank`` and ``total``; in the last a group is one row."""
    rounds = [cut(_rollup(leaves, group))]
    while rounds[-1].agg(F.max("block")).collect()[0][0]:
        nodes = rounds[-1].select(
            group, F.col("block").alias("rank"), F.ceil(F.col("total") / BLOCK).alias("total"),
            F.col("node").alias("leaf"), F.col("block").alias("below"),
        )
        rounds.append(cut(_rollup(nodes, group)))
    return rounds


def _descend(rounds: list[DataFrame], group: str, above: DataFrame) -> DataFrame:
    """What the leaves carry, with ``root`` and ``path``. ``above`` has those of each group's last node."""
    upper = above.withColumn("_block", F.lit(0).cast("long"))
    for blocks in reversed(rounds[1:]):
        found = _paths(blocks, group, upper)
        upper = found.select(F.col(group).alias("_group"), F.col("below").alias("_block"), "root", F.col("path").alias("upper"))
    return _paths(rounds[0], group, upper)


def manifest(
    rows: DataFrame, *, key: str = "doc_id", group: str = "lang", fields: list[str] | None = None, claim: Column | None = None
) -> DataFrame:
    """``key``, ``leaf``, ``claimed``, ``subroot``, ``root`` and ``path`` of each row.

    ``path`` has the left and right siblings on each level, from the leaf up to the root. ``claim`` is the
    digest that a holder of the row presents, by default the leaf; :func:`fold` it along the path.
    """
    own = leaf(*(F.col(f) for f in fields or FIELDS))
    narrow = cut(rows.select(
        F.col(group).alias("_of"), F.col(key).alias("_key"), own.alias("leaf"), (own if claim is None else claim).alias("claimed")
    ))
    ranked = _ranked(narrow, "_of", "_key").withColumn("_leaf", F.col("leaf"))
    rounds = _climb(ranked, "_of")
    subroots = rounds[-1].select(F.lit(0).alias("_all"), F.col("_of").alias("_name"), F.col("node").alias("leaf"))
    tops = _climb(_ranked(subroots, "_all", "_name").withColumn("_subroot", F.col("leaf")), "_all")
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    whole = tops[-1].select(F.col("_all").alias("_group"), F.col("node").alias("root"), nothing.alias("upper"))
    above = _descend(tops, "_all", whole).select(F.col("_name").alias("_group"), "_subroot", "root", F.col("path").alias("upper"))
    named = cut(above)
    found = _descend(rounds, "_of", named.drop("_subroot"))
    subroot = _bounded(named.select("_group", F.col("_subroot").alias("subroot")))
    found = found.join(subroot, found["_of"].eqNullSafe(subroot["_group"]))
    return found.select(F.col("_key").alias(key), F.col("_leaf").alias("leaf"), "claimed", "subroot", "root", "path")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, start, lambda acc, s: F.sha2(F.concat(s.left, acc, s.right), 256))


def siblings(path: Column) -> Column:
    """All sibling digests, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s.left, s.right)), "")


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(text, _UPPER, _LOWER)


# Trees by level in a recursive query. crc32 of the decimal id goes bit by bit: eight steps for each byte, whose
# value enters with the first.
_TREE = """
select {g} g, rank - 1 i, 0 lv, leaf d, n from {rows}
union all
select g, i // 8, lv + 1, sha256(string_agg(d, '' order by i)), (any_value(n) + 7) // 8 from {name} where n > 1 group by g, i // 8, lv
"""
_RUN = """
select s.lv, s.g, o.i, string_agg(s.d, '' order by s.i) filter (where s.i < o.i) l, string_agg(s.d, '' order by s.i) filter (where s.i > o.i) r
from {name} o join {name} s on s.g is not distinct from o.g and s.lv = o.lv and s.i // 8 = o.i // 8
where o.n > 1 group by all
"""
ORACLE_SQL = f"""
with recursive f as (
  select doc_id, lang, concat(
    coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-')) head, text
  from documents
),
leaves as (
  select doc_id, lang, sha256(concat(head, coalesce(strlen(text) || ':' || text, '-'))) leaf,
    sha256(concat(head, coalesce(strlen(text) || ':' || translate(text, '{_UPPER}', '{_LOWER}'), '-'))) low,
    xor(list_reduce(list_concat([cast(4294967295 as bigint)], flatten(list_transform(range(1, 1 + length(coalesce(cast(doc_id as varchar), ''))),
      lambda k: [cast(ascii(substr(cast(doc_id as varchar), cast(k as int), 1)) as bigint), 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) crc
  from f
),
ranked as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) rank, count(*) over (partition by lang) n from leaves
),
nodes as ({_TREE.format(g="lang", rows="ranked", name="nodes")}),
tops as (
  select 0 z, g lang, d leaf, row_number() over (order by g nulls first) rank, count(*) over () n from nodes where n = 1
),
top_nodes as ({_TREE.format(g="z", rows="tops", name="top_nodes")}),
low_runs as ({_RUN.format(name="nodes")}),
top_runs as ({_RUN.format(name="top_nodes")}),
steps as (
  select k.doc_id, k.leaf, k.lang, k.rank, s.lv, coalesce(s.l, '') l, coalesce(s.r, '') r
  from ranked k join low_runs s on s.g is not distinct from k.lang and s.i = (k.rank - 1) // cast(pow(8, s.lv) as bigint)
  union all
  select k.doc_id, k.leaf, k.lang, k.rank, 100 + s.lv, coalesce(s.l, ''), coalesce(s.r, '')
  from ranked k join tops t on t.lang is not distinct from k.lang
  join top_runs s on s.i = (t.rank - 1) // cast(pow(8, s.lv) as bigint)
),
paths as (
  select lang, rank, list([l, r] order by lv) p, string_agg(l || r, '' order by lv) said from steps group by all
),
folded as (
  select k.*, coalesce(said, '') said, list_reduce(
    list_concat([[case when crc % 3 = 0 then low else leaf end, '']], coalesce(p, [])), lambda a, s: [sha256(s[1] || a[1] || s[2]), ''])[1] f
  from ranked k left join paths o on o.rank = k.rank and o.lang is not distinct from k.lang
)
select doc_id, k.leaf, t.leaf subroot, (select d from top_nodes where n = 1) root, sha256(said) proof_sha256, f folded_root,
  f = (select d from top_nodes where n = 1) verified
from folded k join tops t on t.lang is not distinct from k.lang
"""
