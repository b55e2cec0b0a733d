"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, stash

#: Alternations after which something is wrong: the count needed grows with the logarithm of the vertices.
MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges point from the larger end u to the smaller v. large: every neighbour above a vertex moves to the
    vertex's least neighbour; else every vertex hands its smaller neighbours to the least of them. The least is
    found by a partial aggregate, so that a vertex with very many neighbours is never one task's work."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        handed = edges.join(least, "u")
        moved = handed.select(F.col("v").alias("u"), F.col("m").alias("v")).union(handed.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every vertex of some edge other than itself, root the least vertex reachable. Vertices are
    longs. Null ends and loops are ignored; repeated and two-way edges count once; no edges give no rows. The result is
    a stash, the caller's to drop."""
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = stash(e, "edges")
    sign = None
    for _ in range(MOST_ROUNDS):
        step = stash(_star(_star(e, True), False), "edges")
        drop_stash(e)
        e = step
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == sign or not now[0]:
            break
        sign = now
    else:
        raise RuntimeError("components did not settle")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    nodes = stash(nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct(), "components")
    drop_stash(e)
    return nodes


def forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (vertex, least vertex of its part) that join what the links (i, j) join: no more of them than vertices."""
    nodes, at = np.unique(np.concatenate((i, j)), return_inverse=True)
    x, y = at[: len(i)], at[len(i) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    out = label != np.arange(len(nodes))
    return nodes[out], nodes[label[out]]
