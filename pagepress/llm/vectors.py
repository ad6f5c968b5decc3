"""Embedding near-dedup by int8 tile products with rigorous error bounds.

Equal vectors form one class first, so copies cost nothing. Classes are dealt into tiles of bounded
size by a hash of their id, and every pair of tiles is one task's matrix product over int8 values. Each
unit vector v is s * q + e with integers q in -127..127; with |e| known for both sides, the cosine lies
within |e_u| + |e_v| * (1 + |e_u|) of the integer product, so pairs whose upper bound is below the
threshold are ruled out for certain, and only the others are computed again in double precision.

A tile pair gives back a number of links for each vector, and for its linked vectors one edge each to
the smallest of their group in the tile, never all pairs; the edges' components are those of the links.
The products are quadratic in the number of distinct vectors: the method compares all of them.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pagepress.llm.common import cut
from pagepress.llm.components import components

THRESHOLD = 0.95
TILE = 2048  # classes in a tile, about
STRIP = 512  # rows of a product held at a time
_EXACT = 1024  # so many int8 products add up exactly in single precision
_SLACK = 1e-9  # covers rounding in the bounds themselves


def unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first, so that squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def quantise(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, and the norms of the errors."""
    scale = np.abs(units).max(axis=1) / 127
    q = np.rint(units / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((units - q * scale[:, None]) ** 2).sum(axis=1))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of int8 rows; single precision adds them exactly in blocks of columns."""
    total = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], _EXACT):
        total += a[:, i : i + _EXACT].astype(np.float32) @ b[:, i : i + _EXACT].astype(np.float32).T
    return total


def linked(u: np.ndarray, v: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs of unit vectors with cosine of ``threshold`` at least; i < j if ``same``."""
    (qu, su, eu), (qv, sv, ev) = quantise(u), quantise(v)
    left, right = [], []
    for i in range(0, len(u), STRIP):
        part = slice(i, min(i + STRIP, len(u)))
        upper = _products(qu[part], qv) * su[part, None] * sv[None, :]
        upper += eu[part, None] + ev[None, :] * (1 + eu[part, None]) + _SLACK
        a, b = np.nonzero(upper >= threshold)
        a = a + i
        if same:
            a, b = a[a < b], b[a < b]
        for k in range(0, len(a), 65536):
            x, y = a[k : k + 65536], b[k : k + 65536]
            good = np.einsum("ij,ij->i", u[x], v[y]) >= threshold
            left.append(x[good])
            right.append(y[good])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row it is connected to."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            return label


def valid(column: str = "embedding"):
    """Not null, not zero, all components finite numbers."""
    c = F.col(column)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for every row with a ``vec_id``.

    Vectors that are null, zero or not finite link with nothing, and so do vectors of different length.
    Rows with equal ids count as vectors of their own. Rows without an id are left out.
    """
    rows = vectors.filter("vec_id is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")
    )
    rows = rows.withColumn("v", F.when(valid("v"), F.col("v")))
    classes = cut(rows.filter("v is not null").groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")))
    tiles = max(1, ceil(classes.count() / TILE))
    tile = F.pmod(F.xxhash64("node"), F.lit(tiles)).cast("int")
    dealt = classes.select("node", "n", "v", F.size("v").alias("dim"), tile.alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other"))
    paired = dealt.select(
        "dim", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "node", "n", "v"
    )

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node", kind="stable")
        lo, hi = part["lo"].iloc[0], part["hi"].iloc[0]
        at_a = np.flatnonzero(part["tile"].to_numpy() == lo)
        at_b = at_a if lo == hi else np.flatnonzero(part["tile"].to_numpy() == hi)
        nodes, sizes = part["node"].to_numpy(), part["n"].to_numpy()
        out = {"node": [], "links": [], "root": []}
        if len(at_a) and len(at_b):
            units = unit(np.stack(part["v"].to_list()))
            i, j = linked(units[at_a], units[at_b], threshold, lo == hi)
            i, j = at_a[i], at_b[j]
            links = np.zeros(len(part), np.int64)
            np.add.at(links, i, sizes[j])
            np.add.at(links, j, sizes[i])
            touched = np.flatnonzero(links)
            out = {"node": nodes[touched], "links": links[touched], "root": nodes[forest(len(part), i, j)[touched]]}
        return pd.DataFrame(out).astype("int64")

    found = cut(paired.groupBy("dim", "lo", "hi").applyInPandas(compare, "node bigint, links bigint, root bigint"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classed = classes.join(links, "node", "left").join(named, "node", "left").select(
        F.col("v").alias("_v"),
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("_links"),
        F.coalesce("component", "node").alias("_component"),
    )
    joined = rows.join(classed, F.col("v") == F.col("_v"), "left")
    component = F.coalesce(F.col("_component"), F.col("vec_id"))
    return joined.select(
        "vec_id",
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )


# Links by the plain definition; reachability by walking to ever smaller labels.
ORACLE_SQL = """
with recursive v as (
  select vec_id, cast(embedding as double[]) e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links as (
  select a.vec_id a, b.vec_id b from v a join v b on a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.95
),
walk as (
  select vec_id a, vec_id b from embeddings where vec_id is not null
  union
  select w.a, l.b from walk w join links l on w.b = l.a
)
select e.vec_id, (select count(*) from links l where l.a = e.vec_id) n_links, c.component_id,
  e.vec_id = c.component_id kept
from embeddings e join (select a, min(b) component_id from walk group by a) c on c.a = e.vec_id
"""
