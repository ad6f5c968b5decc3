"""Hard-negative mining over STR-packed R-trees.

Vectors of integers are packed by sort-tile-recursive order: label first, then slabs of one coordinate, and
within a slab by a second one, dealt out by range into tiles of about ``TILE`` rows. A tile's task packs its
rows on, coordinate after coordinate, into leaves of ``LEAF`` and nodes of ``NODE``; each node holds its
minimum bounding box and range of labels. With an anchor a, a box gives an interval for the inner product:
coordinate by coordinate the lesser and the greater of a * low and a * high.

Anchors search a tile by a best-first queue on upper bounds. A box is left out if its interval meets no score
window that is still open, if its labels are not wanted, or if its upper bound is strictly below the k-th best
of every window it meets; ties stay in, as the smaller id wins. Each tile returns its own first k for each
window, and Spark keeps the first k of these.

Positives are a search with one open window among rows of the anchor's label; each positive's score then
opens a window for rows of other labels. Anchors are a stated query set: they meet all tiles in blocks of
``BLOCK``, and one task holds one tile and one block. That work is proportional to rows times anchors; what
the boxes rule out is not multiplied. A group of equal vectors is split among tiles by id.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Of rows with one
id that with the smallest label, then vector, counts. Vectors of another length than an anchor's are not
compared with it. An empty table gives no rows. Further columns play no part. Components are 64-bit integers,
larger ones the largest such; a score beyond 64 bits raises an error.
"""

from __future__ import annotations

from heapq import heappop, heappush
from math import ceil, isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pagepress.llm.common import cut

TILE = 8192
LEAF = 32
NODE = 16
BLOCK = 2048  # anchors in a block, about
SMALL = 100_000  # rows of two numbers that are broadcast
_EXACT = float(1 << 53)


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id``, ``label`` and ``q`` (each component floor(scale * x)) of the rows that take part."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(sound, F.lit(False))
    )
    rows = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("q"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("row")).select("vec_id", "row.label", "row.q")


def pack(points: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Order of the rows in which consecutive runs of ``LEAF`` are compact: sort-tile-recursive."""
    order = np.lexsort((labels,))
    # Labels are runs of their own; within a label the coordinates of widest spread split first.
    out = []
    starts = np.flatnonzero(np.r_[True, labels[order][1:] != labels[order][:-1]])
    for run in np.split(order, starts[1:]):
        out.append(_tiled(points, run, np.argsort(-points[run].std(axis=0), kind="stable")))
    return np.concatenate(out)


def _tiled(points: np.ndarray, run: np.ndarray, coordinates: np.ndarray) -> np.ndarray:
    leaves = ceil(len(run) / LEAF)
    if leaves <= 1 or not len(coordinates):
        return run
    run = run[np.argsort(points[run, coordinates[0]], kind="stable")]
    slabs = max(2, isqrt(leaves))
    size = ceil(leaves / slabs) * LEAF
    return np.concatenate([_tiled(points, run[i : i + size], coordinates[1:]) for i in range(0, len(run), size)])


class Tree:
    """Boxes of a tile, level by level: the first level's boxes are over rows, each further one's over boxes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, points: np.ndarray):
        order = pack(points, labels)
        self.ids, self.labels, self.points = ids[order], labels[order], points[order]
        self.levels = []
        low = high = self.points
        first = last = self.labels
        fan = LEAF
        while True:
            at = np.arange(0, len(low), fan)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            first, last = np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)
            self.levels.append((low, high, first, last))
            if len(at) == 1:
                break
            fan = NODE
        self.reach = np.maximum(np.abs(low[0]), np.abs(high[0])).astype(object)

    def search(self, anchor: np.ndarray, own_id: int, label: int, same: bool, windows: list[tuple], k: int):
        """For each window (low, high) the first ``k`` (score, id), best first and smaller id first among equals."""
        exact = sum(abs(int(a)) * int(r) for a, r in zip(anchor, self.reach, strict=True))
        kind = np.float64 if exact < _EXACT else object
        up, down = np.maximum(anchor, 0).astype(kind), np.minimum(anchor, 0).astype(kind)
        whole = anchor.astype(kind)
        found: list[list[tuple]] = [[] for _ in windows]
        kth = [None] * len(windows)

        def bounds(level: int, part: slice):
            low, high, first, last = (side[part] for side in self.levels[level])
            fits = (first <= label) & (last >= label) if same else (first != label) | (last != label)
            return low.astype(kind) @ up + high.astype(kind) @ down, high.astype(kind) @ up + low.astype(kind) @ down, fits

        def wanted(least, most) -> bool:
            return any(
                most >= lo and least <= hi and (kth[w] is None or min(most, hi) >= kth[w]) for w, (lo, hi) in enumerate(windows)
            )

        queue: list[tuple] = []

        def enter(level: int, part: slice) -> None:
            least, most, fits = bounds(level, part)
            for i in np.flatnonzero(fits).tolist():
                if wanted(least[i], most[i]):
                    heappush(queue, (-most[i], level, part.start + i, least[i]))

        top = len(self.levels) - 1
        enter(top, slice(0, 1))
        while queue:
            most, level, at, least = heappop(queue)
            if not wanted(least, -most):
                continue
            if level:
                enter(level - 1, slice(at * NODE, min((at + 1) * NODE, len(self.levels[level - 1][0]))))
                continue
            part = slice(at * LEAF, (at + 1) * LEAF)
            ids, labels = self.ids[part], self.labels[part]
            fits = ((labels == label) == same) & (ids != own_id)
            scores = (self.points[part].astype(kind) @ whole)[fits]
            ids = ids[fits]
            for w, (lo, hi) in enumerate(windows):
                good = (scores >= lo) & (scores <= hi)
                if kth[w] is not None:
                    good &= scores >= kth[w]
                if not good.any():
                    continue
                rows = [(-int(s), int(i)) for s, i in zip(scores[good].tolist(), ids[good].tolist(), strict=True)]
                found[w] = sorted(found[w] + rows)[:k]
                if len(found[w]) == k:
                    kth[w] = -found[w][-1][0]
        return [[(-s, i) for s, i in rows] for rows in found]


def tiles(rows: DataFrame) -> DataFrame:
    """The rows with ``tile``, in sort-tile-recursive order; written to the shared checkpoint folder."""
    rows = cut(rows)
    n = rows.count()
    many = max(1, ceil(n / TILE))
    # Slabs of the first coordinate by its quantiles: one number for each slab.
    edges = rows.select(F.get("q", F.lit(0)).cast("double").alias("x")).approxQuantile("x", [i / isqrt(many) for i in range(1, isqrt(many))], 0.01) if many > 3 else []
    slab = sum((F.when(F.get("q", F.lit(0)) > edge, 1).otherwise(0) for edge in edges), F.lit(0))
    order = ["label", slab, F.get("q", F.lit(1)), "vec_id"]
    dealt = rows.repartitionByRange(many, *order).withColumn("tile", F.spark_partition_id())
    return cut(dealt)


def _meet(tiled: DataFrame, asked: DataFrame, same: bool, k: int) -> DataFrame:
    """``anchor_id``, ``asked`` (the window), ``score``, ``found`` of each tile's first k.

    ``asked`` has ``vec_id``, ``label``, ``q`` and ``windows``. Both sides are dealt out by (tile, block of
    anchors); only tiles that hold a wanted label are sent an anchor.
    """
    asked = cut(asked)
    blocks = max(1, ceil(asked.count() / BLOCK))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    queries = asked.withColumn("block", block)
    if same:
        holds = cut(tiled.select(F.col("label").alias("_label"), "tile").distinct())
        holds = F.broadcast(holds) if holds.count() <= SMALL else holds
        queries = queries.join(holds, F.col("label") == F.col("_label")).drop("_label")
    else:
        last = tiled.agg(F.coalesce(F.max("tile"), F.lit(0))).collect()[0][0]
        queries = queries.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(last))))
    queries = queries.select(
        F.col("vec_id").alias("anchor_id"), F.col("label").alias("own"), F.col("q").alias("a"), "windows",
        F.col("tile").alias("_tile"), F.col("block").alias("_block"),
    )
    stored = tiled.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(rows) and len(anchors):
            sizes = rows["q"].map(len)
            for dim, part in rows.groupby(sizes):
                part = part.sort_values("vec_id")
                tree = Tree(part["vec_id"].to_numpy(), part["label"].to_numpy(), np.stack(part["q"].to_list()).reshape(len(part), dim))
                for a in anchors.itertuples():
                    if len(a.a) != dim:
                        continue
                    windows = [(float("-inf"), float("inf"))] if a.windows is None else [(w["low"], w["high"]) for w in a.windows]
                    for w, hits in enumerate(tree.search(np.asarray(a.a), a.anchor_id, a.own, same, windows, k)):
                        out.extend((a.anchor_id, w, score, found) for score, found in hits)
        return pd.DataFrame(out, columns=["anchor_id", "asked", "score", "found"]).astype("int64")

    met = stored.groupBy("tile", "block").cogroup(queries.groupBy("_tile", "_block"))
    return met.applyInPandas(search, "anchor_id bigint, asked bigint, score bigint, found bigint")


def _first(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("anchor_id", "asked").orderBy(F.col("score").desc(), "found")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, *, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id``, ``label`` and ``q`` (integers), ``anchors`` says which rows ask. A positive is
    one of the anchor's first rows of its own label; its negatives are the first rows of other labels with a
    score from ``low`` to ``high`` percent of the positive's. Equal scores go by the smaller id.
    """
    tiled = tiles(vectors)
    asking = tiled.filter(anchors).drop("tile")
    window_type = "array<struct<low:bigint,high:bigint>>"
    own = cut(_first(_meet(tiled, asking.withColumn("windows", F.lit(None).cast(window_type)), True, positives), positives))
    # The integers from low % to high % of the score: of a negative score there are none.
    least = F.ceil(F.col("score") * low / F.lit(100).cast("decimal(3,0)")).cast("long")
    most = F.floor(F.col("score") * high / F.lit(100).cast("decimal(3,0)")).cast("long")
    opened = own.filter(least <= most).withColumn("w", F.struct("rank", "found", "score", least.alias("low"), most.alias("high")))
    opened = cut(opened.groupBy(F.col("anchor_id").alias("_anchor")).agg(F.array_sort(F.collect_list("w")).alias("w")))
    again = asking.join(opened, F.col("vec_id") == F.col("_anchor"))
    windows = F.transform("w", lambda w: F.struct(w.low.alias("low"), w.high.alias("high")))
    hits = _first(_meet(tiled, again.select("vec_id", "label", "q", windows.alias("windows")), False, negatives), negatives)
    named = hits.join(opened, F.col("anchor_id") == F.col("_anchor")).withColumn("p", F.get("w", F.col("asked").cast("int")))
    return named.select(
        "anchor_id", F.col("p.found").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )


ORACLE_SQL = """
with v as (
  select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
  select a.vec_id a, b.vec_id b, a.label = b.label same, cast(list_inner_product(a.q, b.q) as bigint) s
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)
),
positives as (
  select a, b p, s ps from scored where same
  qualify row_number() over (partition by a order by s desc, b) <= 5
),
ranked as (
  select p.a, p.p, p.ps, n.b, n.s, row_number() over (partition by p.a, p.p order by n.s desc, n.b) r
  from positives p join scored n on n.a = p.a and not n.same and 30 * ps <= 100 * n.s and 100 * n.s <= 90 * ps
)
select a anchor_id, p positive_id, cast(r as int) rank, b negative_id, ps positive_score, s negative_score
from ranked where r <= 10
"""
