"""SimHash near-dedup: fingerprints, and links at few differing bits by a generalised pigeonhole.

Fingerprint. Each shingle of three words has an XXH64; a bit is set if it is set in over half of them.

Links. Equal fingerprints form one class. The 64 bits are grouped into m partitions. If the thresholds
t_i (-1: not probed) have sum(t_i + 1) = max_bits + 1, two fingerprints that differ in at most max_bits
bits differ in at most t_i bits in some partition. Correlated bits go into the same partition, as they
then spoil one partition's selectivity instead of all. For every m, dynamic programming over the
partitions picks the thresholds with the least estimated cost: candidate pairs, and keys to probe. The
estimate uses, for each partition, mean and variance of the number of differing bits, from counts of
all pairs of bits over all fingerprints (64 x 64 numbers, whatever the corpus). The plan changes the
cost only: every choice finds every link.

Probes. Each class gives an index key for a probed partition, and as probes all keys within the
partition's threshold. They meet in a join that checks the whole distance, so only links leave it.
"""

from __future__ import annotations

from itertools import combinations
from itertools import repeat as same
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pagepress.llm.common import cut, ddl, text_bytes
from pagepress.llm.components import components

BITS = 64
SHINGLE, MAX_BITS = 3, 3
PROBE_COST = 4.0  # cost of a probe key, in candidate pairs
BLOCK = 1 << 15  # shingles whose bits are laid out at a time


def shingles(text: bytes, size: int = SHINGLE) -> list[bytes]:
    words = text.lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Lower-cases A-Z; words are runs of other than white space; no words: zero."""
    parts = shingles(text, size)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(parts), BLOCK):
        some = parts[i : i + BLOCK]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, some, same(42)), np.uint64, len(some))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(parts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The rows with ``fp``, the fingerprint as a signed long. A null text has no words."""
    kept = docs.drop("fp")
    rows = kept.withColumn("_bytes", text_bytes())

    def run(batches):
        for batch in batches:
            found = [fingerprint(v.as_buffer().to_pybytes(), size) for v in batch.column("_bytes")]
            signed = pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())
            at = batch.schema.get_field_index("_bytes")
            columns = [signed if i == at else c for i, c in enumerate(batch.columns)]
            names = ["fp" if i == at else n for i, n in enumerate(batch.schema.names)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, f"{ddl(kept)}, fp bigint")


def bit_counts(classes: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j both set, for all i and j."""

    def run(batches):
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(values, axis=1, bitorder="little").astype(np.float64)
            total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BITS * BITS)), pa.array(total.reshape(-1))], names=["place", "n"]
        )

    out = np.zeros(BITS * BITS, np.int64)
    counted = classes.select("fp").mapInArrow(run, "place bigint, n bigint").groupBy("place")
    for r in counted.agg(F.sum("n").alias("n")).collect():
        out[r["place"]] = r["n"]
    return out.reshape(BITS, BITS)


def _difference(both: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of two random fingerprints: chance that a bit differs, and covariance of two bits' differing."""
    p11 = both / max(n, 1)
    one = np.diag(p11)
    p10 = one[:, None] - p11
    p01 = one[None, :] - p11
    p00 = 1 - one[:, None] - one[None, :] + p11
    differs = 2 * one * (1 - one)
    return differs, 2 * (p11 * p00 + p10 * p01) - differs[:, None] * differs[None, :]


def group_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Partitions of near equal width; each is filled with the bits most correlated to those it has."""
    _, cov = _difference(both, n)
    strength, free, out = np.abs(cov), list(range(BITS)), []
    for k in range(parts):
        width = (BITS - sum(map(len, out))) // (parts - k)
        first = max(free, key=lambda b: (strength[b, free].sum() - strength[b, b], -b))
        group = [first]
        free.remove(first)
        while len(group) < width:
            best = max(free, key=lambda b: (strength[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def _within(group: list[int], differs: np.ndarray, cov: np.ndarray, most: int) -> float:
    """Estimated chance that two fingerprints differ in at most ``most`` bits of a group."""
    if most < 0:
        return 0.0
    chance = np.ones(1)
    for b in group:
        chance = np.convolve(chance, [1 - differs[b], differs[b]])
    plain = float(chance[: most + 1].sum())
    mean, var = differs[group].sum(), cov[np.ix_(group, group)].sum()
    normal = 0.5 * (1 + erf((most + 0.5 - mean) / sqrt(2 * max(var, 1e-9))))
    independent = float((differs[group] * (1 - differs[group])).sum())
    return max(plain, normal) if var > 1.2 * independent else plain


def plan(both: np.ndarray, n: int, max_bits: int = MAX_BITS) -> list[tuple[list[int], int]]:
    """Partitions to probe with their thresholds."""
    differs, cov = _difference(both, n)
    best_cost, best = float("inf"), []
    for parts in range(1, max_bits + 2):
        groups = group_bits(both, n, parts)
        # cheapest[s]: cost and thresholds of the groups so far whose sum of t_i + 1 is s.
        cheapest = {0: (0.0, [])}
        for group in groups:
            grown: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, chosen) in cheapest.items():
                for more in range(max_bits + 2 - used):
                    t = more - 1
                    keys = sum(comb(len(group), e) for e in range(t + 1)) + (t >= 0)
                    added = n * n / 2 * _within(group, differs, cov, t) + PROBE_COST * n * keys
                    if used + more not in grown or cost + added < grown[used + more][0]:
                        grown[used + more] = (cost + added, [*chosen, t])
            cheapest = grown
        cost, chosen = cheapest[max_bits + 1]
        if cost < best_cost:
            best_cost, best = cost, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]
    return best


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def _keys(chosen: list[tuple[list[int], int]], probing: bool) -> Column:
    """Array of (partition, key): a class's own keys, or all keys within each partition's threshold."""
    def of(no: int, group: list[int], most: int) -> Column:
        own = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in group))))
        flips = [sum(1 << b for b in some) for e in range(most + 1 if probing else 1) for some in combinations(group, e)]
        flipped = F.from_json(F.lit("[" + ",".join(str(_signed(f)) for f in flips) + "]"), "array<bigint>")
        return F.transform(flipped, lambda f: F.struct(F.lit(no).alias("part"), own.bitwiseXOR(f).alias("key")))

    return F.flatten(F.array(*(of(no, group, most) for no, (group, most) in enumerate(chosen))))


def links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b) of class nodes whose fingerprints differ in at most ``max_bits`` bits."""
    n = classes.count()
    chosen = plan(bit_counts(classes), n, max_bits)
    side = lambda probing, fp, node: (
        classes.withColumn("_k", F.explode(_keys(chosen, probing)))
        .select(F.col("_k.part").alias(f"part_{fp}"), F.col("_k.key").alias(f"key_{fp}"), F.col("fp").alias(fp),
                F.col("node").alias(node))
    )
    close = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= max_bits
    met = side(True, "x", "a").join(
        side(False, "y", "b"),
        (F.col("part_x") == F.col("part_y")) & (F.col("key_x") == F.col("key_y")) & (F.col("x") < F.col("y")) & close,
    )
    return met.select("a", "b").distinct()


def groups(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest doc_id reachable over links, itself included.

    Rows with equal ids stay; a row without an id has the component of its fingerprint. A fingerprint
    that only rows without an id have links with nothing, and its component is null.
    """
    prints = cut(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), size).select("doc_id", "fp"))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(links(classes.filter("node is not null"), max_bits))
    named = classes.join(found, "node", "left").select(
        F.col("fp").alias("_fp"), F.coalesce("component", "node").alias("component_id")
    )
    return prints.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each group: the one with the smallest id; of rows that repeat it, the smallest text.

    Rows without an id all stay, since they cannot be told apart.
    """
    named = groups(docs, size, max_bits)
    kept = named.filter("doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct()
    columns = docs.columns
    unnamed = docs.filter("doc_id is null")
    once = docs.join(kept, F.col("doc_id").cast("long") == F.col("_id"), "left_semi")
    first = once.groupBy("doc_id").agg(F.min_by(F.struct(*columns), F.coalesce(F.col("text"), F.lit(""))).alias("_row"))
    return first.select("_row.*").unionByName(unnamed.select(columns))
