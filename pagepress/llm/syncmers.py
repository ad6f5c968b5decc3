"""Document fingerprints from closed syncmers.

A k-mer (here ``K`` code points) is a closed syncmer if the smallest hash among its inner substrings
of ``S`` code points lies at its first or last place. That depends on the k-mer alone, not on what
stands around it: a passage has the same anchors wherever it stands, and an edit moves none beyond
the k-mers it touches. Any ``2 * K - S - 1`` code points hold an anchor, so gaps are below 256.

A fingerprint is the text's anchors in order, ten hex digits each: the distance from the anchor
before (two digits) and the hash of the k-mer (eight digits). A text without anchors has one whose
hash is that of the whole text; the empty text has the empty fingerprint.

Likeness of two fingerprints is positional: the longest common chain of anchors, in order, as a share
of both (2 * chain / (a + b)); two empty fingerprints have likeness 1.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from pagepress.llm.common import ddl, partitions, text_or_empty

K, S = 32, 8
CHUNK = 1_000_000  # code points worked on at a time; chunks overlap, so the size does not show
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_ANCHOR = np.dtype([("gap", "u1"), ("hash", ">u4")])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MULTIPLIER
    return x ^ (x >> np.uint64(29))


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _anchors_of_chunk(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inner = points[: len(points) - S + 1].astype(np.uint64)
    for j in range(1, S):
        inner = inner * _MULTIPLIER + points[j : len(points) - S + 1 + j]
    inner = _mix(inner)
    window = K - S + 1
    least = _window_min(inner, window)
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[window - 1 :] == least))
    whole = inner[at]
    for j in range(S, K, S):
        whole = _mix(whole + inner[at + j])
    return at, (whole >> np.uint64(32)).astype(np.uint32)


def anchors(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers among code points, in order."""
    if len(points) < K:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    if len(points) <= CHUNK:
        return _anchors_of_chunk(points)
    found = []
    for start in range(0, len(points) - K + 1, CHUNK):
        at, hashes = _anchors_of_chunk(points[start : start + CHUNK + K - 1])
        found.append((at + start, hashes))
    return np.concatenate([a for a, _ in found]), np.concatenate([h for _, h in found])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def encode_anchors(at: np.ndarray, hashes: np.ndarray, text: str) -> str:
    if not text:
        return ""
    if not len(at):
        whole = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
        at, hashes = np.zeros(1, np.int64), np.frombuffer(whole[:4], ">u4")
    out = np.empty(len(at), _ANCHOR)
    out["gap"] = np.diff(at, prepend=0)
    out["hash"] = hashes
    return out.tobytes().hex()


def decode_anchors(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes that a fingerprint holds."""
    raw = np.frombuffer(bytes.fromhex(fingerprint), _ANCHOR)
    return np.cumsum(raw["gap"].astype(np.int64)), raw["hash"].astype(np.uint32)


def fingerprint(text: str) -> str:
    return encode_anchors(*anchors(code_points(text)), text)


def chain(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common chain of two hash sequences.

    Common ends are taken off first. In between, the n-th occurrence of a hash on one side may match
    only its n-th occurrence on the other; the longest ascending chain of such matches counts.
    """
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[:n] != b[:n])
    head = int(differs[0]) if len(differs) else n
    a, b, n = a[head:], b[head:], n - head
    differs = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differs[0]) if len(differs) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b) or not len(common := np.intersect1d(a, b)):
        return head + tail
    at: dict[tuple[int, int], int] = {}
    for i in np.flatnonzero(np.isin(b, common)).tolist():
        key, n = int(b[i]), 0
        while (key, n) in at:
            n += 1
        at[key, n] = i
    seen: dict[int, int] = {}
    ends: list[int] = []
    for h in a[np.isin(a, common)].tolist():
        n = seen.get(h, 0)
        seen[h] = n + 1
        place = at.get((h, n))
        if place is not None:
            slot = bisect_left(ends, place)
            ends[slot : slot + 1] = [place]
    return head + tail + len(ends)


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    left, right = decode_anchors(a)[1], decode_anchors(b)[1]
    return 2 * chain(left, right) / (len(left) + len(right))


def fingerprints(docs: DataFrame) -> DataFrame:
    """The rows with ``fingerprint``. Null texts count as empty; further columns are kept."""
    frame = docs.drop("fingerprint")

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            prints = pa.array([fingerprint(t or "") for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], names=[*batch.schema.names, "fingerprint"])

    return frame.mapInArrow(run, f"{ddl(frame)}, fingerprint string")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprint every text, its edited text, and compare with the next document's.

    The next document is the one with the next lower ``doc_id`` (after the last: the first); null ids
    come last, rows with equal ids follow each other by text. The edited text has its last
    floor(n_chars / 3) code points replaced by as many from the start of the next document.

    Ids are cut into ranges of about equal row counts, found from the ids alone. The lowest rows of
    a range need the highest row of the range below, so that row is sent along as a copy: whole texts
    are shuffled once, and no task holds more than its ranges. Only range bounds reach the driver,
    one number for each range. Rows stream through a task in order, one text and its successor at a
    time. The anchors of the edited text are those of its two parts, plus those that span the joint.
    """
    ranges = 4 * partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    keyed = rows.withColumn("_place", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))))
    steps = [i / ranges for i in range(1, ranges)]
    bounds = keyed.filter("doc_id is not null").approxQuantile("_place", steps, 0.2 / ranges)
    inner = sorted({b for b in bounds if np.isfinite(b)})
    if inner:
        splits = [float("-inf"), *inner, float("inf")]
        keyed = Bucketizer(splits=splits, inputCol="_place", outputCol="_bucket").transform(keyed)
        ranged = keyed.select("doc_id", "text", F.col("_bucket").cast("int").alias("range"))
    else:
        ranged = keyed.select("doc_id", "text", F.lit(0).alias("range"))
    tops = ranged.groupBy("range").agg(F.max("doc_id").alias("top")).orderBy("range").collect()
    if not tops:
        return _stream(ranged.withColumn("copy", F.lit(False)))
    # A range's highest row goes to the range above as well; that of the highest to the lowest.
    used = [r["range"] for r in tops]
    send = {r["range"]: (used[(i + 1) % len(used)], r["top"]) for i, r in enumerate(tops)}
    target, top = _lookup({k: v[0] for k, v in send.items()}), _lookup({k: v[1] for k, v in send.items()})
    is_top = F.col("doc_id").eqNullSafe(top)
    own = F.struct(F.col("range"), F.lit(False).alias("copy"))
    sent = F.struct(target.alias("range"), F.lit(True).alias("copy"))
    placed = ranged.withColumn("_to", F.explode(F.when(is_top, F.array(own, sent)).otherwise(F.array(own))))
    return _stream(placed.select("doc_id", "text", "_to.range", "_to.copy"))


def _lookup(values: dict[int, int | None]) -> Column:
    """Value of a range: one number for each range, as a literal array."""
    listed = ",".join("" if (v := values.get(i)) is None else str(v) for i in range(max(values) + 1))
    return F.get(F.split(F.lit(listed), ","), F.col("range")).try_cast("long")


OUT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _stream(placed: DataFrame) -> DataFrame:
    placed = placed.select(F.col("range").cast("int").alias("range"), "copy", "doc_id", "text")
    spread = placed.repartition(partitions(placed.sparkSession), "range")
    ordered = spread.sortWithinPartitions("range", "copy", F.desc_nulls_last("doc_id"), "text")
    return ordered.mapInArrow(_compare_neighbours, OUT)


class _Row:
    def __init__(self, range_no: int, copy: bool, doc_id: int | None, text: str):
        self.range, self.copy, self.doc_id, self.text = range_no, copy, doc_id, text
        self.points = code_points(text)
        self.at, self.hashes = anchors(self.points)
        self.print = encode_anchors(self.at, self.hashes, text)


def _compare(row: _Row, following: _Row) -> tuple:
    n = len(row.points)
    swapped = min(n // 3, len(following.points))
    keep = n - n // 3
    edited = row.text[:keep] + following.text[:swapped]
    lo, hi = max(0, keep - K + 1), min(swapped, K - 1)
    joint_at, joint_hashes = anchors(np.concatenate([row.points[lo:keep], following.points[:hi]]))
    spans = (joint_at + lo < keep) & (joint_at + lo + K > keep)
    before, after = row.at + K <= keep, following.at + K <= swapped
    at = np.concatenate([row.at[before], joint_at[spans] + lo, following.at[after] + keep])
    hashes = np.concatenate([row.hashes[before], joint_hashes[spans], following.hashes[after]])
    edited_print = encode_anchors(at, hashes, edited)
    return (
        row.doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        row.print, edited_print, likeness(row.print, edited_print), likeness(row.print, following.print),
    )


def _compare_neighbours(batches) -> Iterator[pa.RecordBatch]:
    """Rows in order; a row is answered when its successor has been read. Copies only follow."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    last: _Row | None = None
    for batch in batches:
        out: list[tuple] = []
        for fields in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            row = _Row(*fields)
            if last is not None and last.range == row.range and not last.copy:
                out.append(_compare(last, row))
            last = row
        columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
        )
