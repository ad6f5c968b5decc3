"""Line dedup: an exact set-similarity join over the token sets of lines, in DataFrame functions only.

A line (texts are split at line feeds) is removed if an earlier line, in order of doc_id, hash of the
text and line number, has a token set with Jaccard similarity of 0.8 or more, equal lines included.
Whether that earlier line itself stays does not matter. Tokens are runs of characters other than space
and tab to carriage return; lines without tokens always stay.

Steps, each over all lines:

1. Equal lines. Occurrences meet by hash of the line (two times 64 bits); all but the first go. What
   follows works on distinct lines.
2. Rarity. Words are counted by hash into ``BUCKETS`` counters, a table of fixed size. The counts, in steps
   of a quarter power of two, order all tokens, rare ones first; a shared counter can only make a rare word
   look common, and any one order of all tokens keeps the join exact.
3. Groups of near copies. Under each of three keys, pairs of min-hashes, every line is compared with the
   earliest line of the key only. That is linear, however large a group, and settles nearly all of a large
   group's lines. A line settled here needs no further search; it still serves as an earlier line.
4. All other lines. A line of n tokens has a prefix of n - ceil(0.8 n) + 1 rarest tokens. Two similar
   lines share one; at their first shared token the positions bound the overlap (positional filter,
   which holds the length filter), and parity maps of the sets bound the difference from below: 64 bits,
   which sets of ``LONG`` tokens fill, so that two such sets are also compared in 256.
5. Candidates are verified by the Jaccard similarity of the tokens themselves.

Decisions are line numbers, kept as bits for each document. They are joined to the documents, as a
broadcast if counted to be small, else by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagepress.llm.common import cut

BUCKETS = 1 << 16
LONG = 80
BROADCAST_BYTES = 32 << 20
_SPACE = r"[\x20\x09-\x0D]+"
_FLIP = 0x5A5A5A5A5A5A5A5A


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))


def _small(table: DataFrame, bytes_a_row: int, items: Column) -> DataFrame:
    """The table, marked for broadcast if its counted size is small."""
    found = table.agg(F.count("*").alias("rows"), F.coalesce(F.sum(items), F.lit(0)).alias("items")).collect()[0]
    return F.broadcast(table) if bytes_a_row * found["rows"] + 8 * found["items"] <= BROADCAST_BYTES else table


def _by_document(places: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line_no) to ``gone`` for each document: a bit for each line number, in longs."""
    word, bit = F.floor(F.col("line_no") / 64).cast("int"), (F.col("line_no") % 64).cast("int")
    set_bit = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    words = places.groupBy("doc_id", "text_hash", word.alias("word")).agg(F.bit_or(set_bit).alias("bits"))
    mapped = words.groupBy("doc_id", "text_hash").agg(
        F.max("word").alias("last"), F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("by_word")
    )
    dense = F.transform(F.sequence(F.lit(0), "last"), lambda w: F.coalesce(F.element_at("by_word", w), F.lit(0).cast("long")))
    return cut(mapped.select("doc_id", "text_hash", dense.alias("gone")))


def _attach(docs: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """The documents with the table's bits, null where it has none."""
    side = _small(table, 96, F.size("gone")).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("gone").alias(name)
    )
    met = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_hash").eqNullSafe(F.col("_hash"))
    return docs.join(side, met, "left").drop("_id", "_hash")


def _marked(bits: str, line_no: Column) -> Column:
    """Whether a line's bit is set."""
    word = F.get(F.col(bits), F.floor(line_no / 64).cast("int"))
    return F.coalesce(F.getbit(word, (line_no % 64).cast("int")) == 1, F.lit(False))


def _lines(docs: DataFrame, bits: str = "gone", *extra: str) -> DataFrame:
    """A row for each line with tokens whose bit is not set."""
    rows = docs.select("doc_id", "text_hash", bits, *extra, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    kept = rows.filter(~_marked(bits, F.col("line_no")) & F.rlike("line", F.lit(r"[^\x20\x09-\x0D]")))
    return kept if bits in extra else kept.drop(bits)


def _words(line: Column) -> Column:
    """Tokens of a line that has some, repeats included. Splitting at single spaces is the faster way, if it is one."""
    other = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for space in ("  ", "\t", "\n", "\x0b", "\x0c", "\r"):
        other |= F.contains(line, F.lit(space))
    return F.when(other, F.split(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), _SPACE)).otherwise(F.split(line, " "))


def _tokens(line: Column) -> Column:
    return F.array_distinct(_words(line))


def _rarity(docs: DataFrame) -> Column:
    """Rank of a counter, four times the logarithm of its count: a literal of fixed size."""
    words = docs.select(F.explode(_words(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("word"))
    counted = words.groupBy(F.xxhash64("word").bitwiseAND(BUCKETS - 1).cast("int").alias("bucket")).count()
    step = F.least(F.floor(4 * F.log2("count")), F.lit(127)).cast("int")
    rank = [0] * BUCKETS
    for r in counted.groupBy(step.alias("step")).agg(F.collect_list("bucket").alias("buckets")).collect():
        for bucket in r["buckets"]:
            rank[bucket] = r["step"]
    return F.from_json(F.lit("[" + ",".join(map(str, rank)) + "]"), "array<int>")


def _parity(numbers: Column) -> Column:
    """Which numbers, by their last six bits, come an odd number of times: a map of 64 bits."""
    one = F.lit(1).cast("long")
    flip = lambda acc, t: acc.bitwiseXOR(F.call_function("shiftleft", one, t.bitwiseAND(63).cast("int")))
    return F.aggregate(numbers, F.lit(0).cast("long"), flip)


def _with_sets(lines: DataFrame, rank: Column) -> DataFrame:
    """Lines with ``h`` (hash of the line), ``n`` tokens, ``sorted`` token numbers by rarity, parity map ``bits``.

    ``bits1`` to ``bits3`` are quarters of a map of 256 bits, null below ``LONG`` tokens. ``bits`` is the
    exclusive or of all four, so the fourth quarter follows from it.
    """

    def number(token: Column) -> Column:
        h = F.xxhash64(token)
        place = F.get(rank, h.bitwiseAND(BUCKETS - 1).cast("int")).cast("long")
        return F.shiftleft(place, 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    numbered = lines.withColumn("sorted", F.sort_array(F.array_distinct(F.transform(_words(F.col("line")), number))))

    def quarter(i: int) -> Column:
        own = F.filter("sorted", lambda t: t.bitwiseAND(192) == 64 * i)
        return F.when(F.size("sorted") >= LONG, _parity(own))

    return numbered.select(
        *(c for c in lines.columns if c != "line"),
        F.xxhash64("line").alias("h"),
        F.size("sorted").alias("n"),
        "sorted",
        _parity(F.col("sorted")).alias("bits"),
        *(quarter(i).alias(f"bits{i}") for i in (1, 2, 3)),
    )


def _possible(nx: Column, ny: Column, bits_x: Column, bits_y: Column) -> Column:
    """No proof against a Jaccard of 0.8: lengths, and tokens that differ, of which there may be (nx + ny) / 9."""
    lengths = 5 * F.least(nx, ny) >= 4 * F.greatest(nx, ny)
    return lengths & (9 * F.bit_count(bits_x.bitwiseXOR(bits_y)) <= nx + ny)


def _possible_long(nx: Column, ny: Column) -> Column:
    """The same by all 256 bits, of lines ``x_`` and ``y_`` that both have them."""
    quarters = [F.col(f"x_bits{i}").bitwiseXOR(F.col(f"y_bits{i}")) for i in (1, 2, 3)]
    last = F.col("x_bits").bitwiseXOR(F.col("y_bits"))
    for q in quarters:
        last = last.bitwiseXOR(q)
    differ = F.bit_count(last)
    for q in quarters:
        differ += F.bit_count(q)
    return (F.least(nx, ny) < LONG) | (9 * differ <= nx + ny)


def _repeats(docs: DataFrame) -> DataFrame:
    """All occurrences of equal lines but the first."""
    rows = _lines(docs.withColumn("gone", F.lit(None).cast("array<bigint>")))
    place = F.struct("doc_id", "text_hash", "line_no")
    marked = rows.select(F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"), place.alias("place"))
    firsts = marked.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = firsts.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "first")
    met = marked.join(firsts, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")))
    return met.filter("place > first").select("place.*")


def _hub_candidates(lines: DataFrame) -> DataFrame:
    """Pairs (later, earlier) of line hashes: each line with the earliest line under each of three keys.

    A key is two of three hashes: the least, the largest and another least hash of the tokens. Pairs that
    share no key, or whose words with repeats are too many or too different, are left to the exact search,
    and so is the order of lines whose documents have one id. A key's rows pass through one task in order, which
    keeps the first of them only.
    """
    hashed = lines.select(
        "doc_id", "line_no", F.xxhash64("line").alias("h"),
        F.transform(_words(F.col("line")), lambda t: F.xxhash64(t)).alias("_hashes"),
    )
    flipped = F.transform("_hashes", lambda t: t.bitwiseXOR(F.lit(_FLIP)))
    keyed = hashed.select(
        "doc_id", "line_no", "h", F.size("_hashes").alias("words"), _parity(F.col("_hashes")).alias("bits"),
        F.array_min("_hashes").alias("k1"), F.array_max("_hashes").alias("k2"), F.array_min(flipped).alias("k3"),
    )
    keys = F.array(*(F.xxhash64(F.lit(i), F.col(f"k{i}"), F.col(f"k{i % 3 + 1}")) for i in (1, 2, 3)))
    rows = keyed.select("doc_id", "line_no", "h", "words", "bits", F.explode(keys).alias("key"))
    order = Window.partitionBy("key").orderBy("doc_id", "line_no", "h").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumn("hub", F.first(F.struct("h", "words", "bits")).over(order))
    near = _possible(F.col("words"), F.col("hub.words"), F.col("bits"), F.col("hub.bits"))
    return met.filter((F.col("h") != F.col("hub.h")) & near).select(
        F.col("h").alias("later"), F.col("hub.h").alias("earlier")
    )


def _prefix_candidates(sets: DataFrame) -> DataFrame:
    """Pairs of line hashes that share a prefix token within the filters; the later line is not settled.

    Settled lines have their token number negative, which rules them out as the later line. That is said
    in the join, not in a filter, so that both sides are the same shuffle.
    """
    n = F.col("n")
    prefix = F.slice("sorted", F.lit(1), (n - F.floor((4 * n + 4) / 5) + 1).cast("int"))
    rows = sets.select(
        F.posexplode(prefix).alias("at", "token"), "h", "bits", "bits1", "bits2", "bits3",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("doc"),
        F.when(F.col("settled"), -n).otherwise(n).alias("n"),
    ).filter("token is not null")
    x = rows.select(*(F.col(c).alias(f"x_{c}") for c in rows.columns))
    y = rows.select(*(F.col(c).alias(f"y_{c}") for c in rows.columns))
    nx, ny = F.abs("x_n"), F.col("y_n")
    shared = 1 + F.least(nx - F.col("x_at") - 1, ny - F.col("y_at") - 1)
    met = x.join(
        y,
        (F.col("x_token") == F.col("y_token")) & (nx * ny > 0) & (F.col("x_h") != F.col("y_h"))
        & (F.col("x_doc") <= F.col("y_doc")) & (9 * shared >= 4 * (nx + ny))
        & _possible(nx, ny, F.col("x_bits"), F.col("y_bits")) & _possible_long(nx, ny),
    )
    return met.select(F.col("y_h").alias("later"), F.col("x_h").alias("earlier"))


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Places of the lines that an earlier line matches, by the tokens themselves."""
    pairs = cut(pairs.distinct())
    wanted = pairs.select(F.col("later").alias("_h")).unionByName(pairs.select(F.col("earlier").alias("_h"))).distinct()
    side = _small(cut(wanted), 32, F.lit(0))
    rows = _lines(docs).withColumn("h", F.xxhash64("line"))
    found = rows.join(side, F.col("h") == F.col("_h"), "left_semi").select(
        "h", F.struct("doc_id", "text_hash", "line_no").alias("place"), "line"
    )
    found = cut(found)
    y = found.select(F.col("h").alias("later"), F.col("place").alias("y_place"), F.col("line").alias("y_line"))
    x = found.select(F.col("h").alias("earlier"), F.col("place").alias("x_place"), F.col("line").alias("x_line"))
    both = pairs.join(y, "later").join(x, "earlier").filter("x_place < y_place")
    tx, ty = _tokens(F.col("x_line")), _tokens(F.col("y_line"))
    good = 9 * F.size(F.array_intersect(tx, ty)) >= 4 * (F.size(tx) + F.size(ty))
    return both.filter(good).select("y_place.*").distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``gone`` (a bit for each line number) of the lines to remove, for each document with any."""
    texts = _keyed(docs)
    repeats = _by_document(_repeats(texts))
    distinct = _attach(texts, repeats, "gone")
    rank = _rarity(texts)
    settled = _by_document(_verified(_hub_candidates(_lines(distinct)), distinct))
    flagged = _attach(distinct, settled, "settled_bits")
    rows = _lines(flagged, "gone", "settled_bits").withColumn("settled", _marked("settled_bits", F.col("line_no")))
    found = _verified(_prefix_candidates(_with_sets(rows.drop("settled_bits"), rank)), distinct)
    every = _places(repeats).unionByName(_places(settled)).unionByName(found)
    return _by_document(every)


def _places(table: DataFrame) -> DataFrame:
    last = F.size("gone") * 64 - 1
    rows = table.select("doc_id", "text_hash", "gone", F.explode(F.sequence(F.lit(0), last)).alias("line_no"))
    return rows.filter(_marked("gone", F.col("line_no"))).drop("gone")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with the remaining lines as ``text``; ``n_chars``, if there, is counted anew.

    All rows and further columns stay; a text whose lines are all removed is empty, a null text stays
    null. Rows that agree in doc_id and text are one document: the same lines go from each. A null
    doc_id comes first in order. ``removed`` tells how many lines went; it and ``text_hash`` replace
    columns of these names.
    """
    kept = docs.drop("removed", "text_hash")
    keyed = kept.withColumn("text_hash", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    joined = _attach(keyed, removed_lines(kept), "_gone")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~_marked("_gone", i)), "\n")
    removed = F.aggregate("_gone", F.lit(0), lambda acc, w: acc + F.bit_count(w))
    out = joined.withColumn("text", F.when(F.col("_gone").isNotNull(), left).otherwise(F.col("text")))
    out = out.withColumn("removed", F.coalesce(removed, F.lit(0)).cast("long")).drop("_gone")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out
