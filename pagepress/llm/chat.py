"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation becomes one string, a turn after the other:

    <|turn|>ROLE newline TEXT </s> newline

``ROLE`` is URL-encoded. Texts may hold anything, also control strings of this or of common templates.
``parse`` is the deterministic reader of the grammar: it splits at the end mark, takes role and text
apart and undoes escapes; the grammar admits no control string inside a text. The formatter renders
texts as they are, parses what it has rendered and compares the turns with the source. Conversations
that the grammar rejects or that do not come back alike have their texts escaped and are parsed and
compared again, until all are identical; one pass is enough, as ``unescape(escape(t)) = t`` for every
text and an escaped text holds no control string.

Escape: after the first character of a control string, and of what already looks like an escaped one,
a backslash is put in. Undoing it takes one backslash out at the same places.

A conversation's turns are gathered in one row, since its text is one value. Turns are taken in order
of turn number, then role, then text; null turn numbers come first, null texts are empty, null roles
are the empty role. Rows are never dropped; rows without a ``conv_id`` form one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagepress.functions.text import scan_strings

OPEN, CLOSE = "<|turn|>", "</s>\n"
TRAINED_ROLE = "assistant"
# Control strings of this template and of common chat templates, after their first character.
# No tail holds a first character, so escaping one control string does not change another's tail.
_TAILS = r"(?=/?s>|/?SYS>>|/?INST\]|\|[a-z_]{1,32}\|>)"
_ROUNDS = 2


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[]\\*+)" + _TAILS, r"$1\\")


def has_control(text: Column) -> Column:
    return F.rlike(text, F.lit(r"[<\[]" + _TAILS))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[]\\*)\\" + _TAILS, "$1")


def render(turns: Column) -> Column:
    """One string from an array of (role, text)."""
    said = F.transform(
        turns, lambda t: F.concat(F.lit(OPEN), F.url_encode(t.role), F.lit("\n"), t.text, F.lit(CLOSE))
    )
    return F.array_join(said, "")


def pieces(formatted: Column) -> Column:
    """The rendered turns without their end marks: (role, text as it stands)."""
    parts = F.filter(F.split(formatted, r"</s>\n"), lambda p: F.length(p) > 0)
    head = lambda p: F.substring_index(p, "\n", 1)
    return F.transform(
        parts,
        lambda p: F.struct(
            F.try_url_decode(F.substr(head(p), F.lit(len(OPEN) + 1))).alias("role"),
            F.substr(p, F.length(head(p)) + 2).alias("text"),
        ),
    )


def parse(formatted: Column) -> Column:
    """Array of (role, text): what was formatted."""
    return F.transform(pieces(formatted), lambda p: F.struct(p.role.alias("role"), unescape(p.text).alias("text")))


def format_conversations(rows: DataFrame, by: str = "conv_id") -> DataFrame:
    """``conv_id``, ``formatted``, ``loss_mask``, ``escaped`` and ``identical`` for each conversation.

    ``loss_mask`` lists run lengths in code points (chars, loss) that add up to the whole string; loss is
    on for the texts of the assistant. ``escaped`` counts the rounds of escaping the conversation took.
    """
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    turns = F.sort_array(F.collect_list(F.struct(F.col("turn"), role.alias("role"), text.alias("text"))))
    gathered = rows.groupBy(F.col(by).alias("conv_id")).agg(turns.alias("_rows"))
    plain = F.transform("_rows", lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))
    state = gathered.select("conv_id", plain.alias("_source")).withColumns({"_said": F.col("_source"), "escaped": F.lit(0)})
    for round_no in range(_ROUNDS + 1):
        state = state.withColumn("formatted", render(F.col("_said")))
        alike = F.coalesce(parse(F.col("formatted")) == F.col("_source"), F.lit(False))
        clean = ~F.exists(pieces(F.col("formatted")), lambda p: has_control(p.text))
        state = state.withColumn("identical", alike & clean)
        if round_no < _ROUNDS:
            again = F.transform("_said", lambda t: F.struct(t.role.alias("role"), escape(t.text).alias("text")))
            state = state.withColumns(
                {
                    "_said": F.when(F.col("identical"), F.col("_said")).otherwise(again),
                    "escaped": F.col("escaped") + F.when(F.col("identical"), 0).otherwise(1),
                }
            )
    runs = F.transform(
        pieces(F.col("formatted")),
        lambda p: F.array(
            F.struct((F.length(F.url_encode(p.role)) + len(OPEN) + 1).alias("chars"), F.lit(False).alias("loss")),
            F.struct(F.length(p.text).alias("chars"), (p.role == TRAINED_ROLE).alias("loss")),
            F.struct(F.lit(len(CLOSE)).alias("chars"), F.lit(False).alias("loss")),
        ),
    )
    return state.select("conv_id", "formatted", F.flatten(runs).alias("loss_mask"), "escaped", "identical")


def under_mask(formatted: Column, loss_mask: Column) -> Column:
    """The parts of a formatted string that the mask has loss on for, each unescaped, in order."""
    return scan_strings(
        loss_mask,
        F.lit(1),
        lambda at, run: at + run["chars"],
        lambda run, at, _: F.when(run["loss"], unescape(F.substr(formatted, at, run["chars"]))).otherwise(""),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """Read back from the formatted strings: turns by the grammar, and the text under the loss mask, unescaped."""
    turns = parse(F.col("formatted"))
    listed = F.array_join(F.transform("_turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.col("_loss")
    read = {"_turns": turns, "_loss": under_mask(F.col("formatted"), F.col("loss_mask"))}
    return formatted.withColumns(read).select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(listed, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
        "identical",
    )


# Digests of the source; the length of the formatted string from the same escapes and marks.
ORACLE_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as who, coalesce(text, '') as said from conversations
  union all
  select -7, t, case t when 0 then 'user' else 'assistant' end, '</s>[INST] ok [/INST]' from (values (0), (1)) v(t)
),
marked as (
  select *, len(regexp_extract_all(said, '[<\[]\\*(/?s>|/?SYS>>|/?INST\]|\|[a-z_]{1,32}\|>)')) controls,
    regexp_matches(said, '[<\[]\\*(/?s>|/?SYS>>|/?INST\]|\|[a-z_]{1,32}\|>)') conflict
  from rows
),
conversation as (
  select conv_id, bool_or(conflict) conflict, count(*) n_turns,
    string_agg(who || chr(10) || said || chr(10), '' order by turn, who, said) turns,
    coalesce(string_agg(said, '' order by turn, who, said) filter (where who = 'assistant'), '') loss,
    sum(len('<|turn|>' || url_encode(who) || chr(10) || said || '</s>' || chr(10))) plain, sum(controls) controls
  from marked group by conv_id
)
select conv_id, n_turns, sha256(turns) turns_sha256, len(loss) loss_chars, sha256(loss) loss_sha256,
  cast(plain + case when conflict then controls else 0 end as bigint) formatted_chars,
  cast(conflict as int) escaped, true identical
from conversation
"""
