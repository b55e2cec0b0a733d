"""Boosted trees on pairwise ranking gradients: a group's rows stay one row of the table all along."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.scratch import drop_stash, stash


@dataclass(frozen=True)
class Node:
    """A split (feature, the largest value that goes left, left and right node) or, with feature -1, a leaf's value."""

    feature: int
    value: float
    left: int = 0
    right: int = 0


@dataclass
class RankingTrees:
    """Trees over named features, whose values times rate add up to a score."""

    features: list[str]
    rate: float
    trees: list[list[Node]]

    def score(self) -> Column:
        """The score of a row of features; nulls count as the least values."""
        own = [F.coalesce(F.col(f).cast("double"), F.lit(float("-inf"))) for f in self.features]
        return F.lit(self.rate) * sum((_value(tree, lambda f: own[f]) for tree in self.trees), F.lit(0.0))


def _value(tree: list[Node], of, at: int = 0) -> Column:
    node = tree[at]
    if node.feature < 0:
        return F.lit(float(node.value))
    return F.when(of(node.feature) <= F.lit(node.value), _value(tree, of, node.left)).otherwise(_value(tree, of, node.right))


def _place(tree: list[Node], of, at: int = 0) -> Column:
    """The leaf that a row falls to."""
    node = tree[at]
    if node.feature < 0:
        return F.lit(at)
    return F.when(of(node.feature) <= F.lit(node.value), _place(tree, of, node.left)).otherwise(_place(tree, of, node.right))


#: Of each member of a group in the order of scores: what NDCG would gain if it and another changed places, times how
#: likely the model has the two the wrong way round, summed over the others; and the second derivative.
GRADIENTS = """transform(ranked, a -> named_struct('x', a.x,
    'g', aggregate(ranked, 0D, (t, b) -> t + CASE WHEN a.target > b.target THEN abs(a.d - b.d) / (1 + exp(a.s - b.s)) WHEN a.target < b.target THEN -abs(a.d - b.d) / (1 + exp(b.s - a.s)) ELSE 0D END) * w / ideal,
    'h', aggregate(ranked, 0D, (t, b) -> t + CASE WHEN a.target <> b.target THEN abs(a.d - b.d) / (2 + exp(a.s - b.s) + exp(b.s - a.s)) ELSE 0D END) * w / ideal))"""
RANKED = """transform(array_sort(members, (a, b) -> CASE WHEN a.s > b.s THEN -1 WHEN a.s < b.s THEN 1 WHEN a.place < b.place THEN -1 ELSE 1 END),
    (m, i) -> named_struct('target', m.target, 'x', m.x, 's', m.s, 'd', 1 / log2(i + 2D)))"""


def bin_cuts(frame: DataFrame, features: list[str], bins: int, times: str | None = None) -> list[list[float]]:
    """Cuts of each feature into about equally many rows; values up to a cut stand left of it. times: the column that says how
    many rows a row stands for."""
    if times is not None:
        each = frame.select(F.col(times).alias("n"), F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("f", "value"))
        held = each.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("f", "value").agg(F.sum("n").alias("n"))
        own = Window.partitionBy("f")
        up_to = F.sum("n").over(own.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
        held = held.withColumns({"up_to": up_to, "of_all": F.sum("n").over(own)})
        # a share's cut is the least value that so many rows lie up to
        first = F.floor((F.col("up_to") - F.col("n")) * bins / F.col("of_all")) + 1
        cuts = held.where((first < bins) & (F.col("up_to") * bins >= first * F.col("of_all"))).select("f", "value").collect()
        return [sorted({r["value"] for r in cuts if r["f"] == i} or {0.0}) for i in range(len(features))]
    shares = [i / bins for i in range(1, bins)]
    row = frame.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 10_000).alias(str(i)) for i, f in enumerate(features)]).first()
    return [sorted(set(row[i] or [0.0])) for i in range(len(features))]


def fit_ranker(frame: DataFrame, features: list[str], rounds: int = 20, depth: int = 3, rate: float = 0.1, bins: int = 32, ridge: float = 1.0) -> RankingTrees:
    """Trees fitted on a ranking frame (group_id, place, target of 0 or 1, features; see learning.ranking_frame) to order each
    group's positives first, by gradients of NDCG.

    A group, which the catalog bounds, is one row with its members in an array, so gradients and new scores are
    projections without a shuffle; a level of a tree is one small sum over (node, feature, bin). Groups alike in
    places, targets and bins are one, w times as heavy. Groups of one class
    say nothing and are left out; without others there are no trees, and scores are 0. Equal scores of a group stand in
    the order of place. Null features count as the least values.
    """
    def bin_of(f: str, own: list[float]) -> Column:
        """How many cuts the value lies above."""
        return F.size(F.filter(F.array(*[F.lit(c) for c in own]), lambda c: F.coalesce(F.col(f).cast("double") > c, F.lit(False))))

    def raised(tree: list[Node]) -> Column:
        """The members with the tree's values added to their scores."""
        return F.transform("members", lambda m: F.struct(m["place"].alias("place"), m["target"].alias("target"), m["x"].alias("x"), (m["s"] + rate * _value(tree, lambda f: m["x"][f])).alias("s")))

    cuts = bin_cuts(frame, features, bins)
    binned = [bin_of(f, own) for f, own in zip(features, cuts, strict=True)]
    member = F.struct("place", "target", F.array(*binned).alias("x"), F.lit(0.0).alias("s"))
    groups = frame.groupBy("group_id").agg(F.collect_list(member).alias("members"), F.sum("target").alias("positives"), F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("positives").cast("int")), F.lit(0.0), lambda a, r: a + 1.0 / F.log2(r + 1.0))
    groups = stash(groups.where("positives > 0 and positives < n").groupBy(F.array_sort("members").alias("members"), ideal.alias("ideal")).agg(F.count("*").alias("w")), "groups")
    trees: list[list[Node]] = []
    for _ in range(rounds):
        rows = groups.select(F.expr(RANKED).alias("ranked"), "ideal", "w").select(F.inline(F.expr(GRADIENTS)))
        rows = stash(rows, "gradients")
        tree = _grow(rows, len(features), cuts, depth, ridge)
        drop_stash(rows)
        if not tree:
            break
        trees.append(tree)
        step = stash(groups.select(raised(tree).alias("members"), "ideal", "w"), "groups")
        drop_stash(groups)
        groups = step
    drop_stash(groups)
    # Bins become the values they are cut at: bin b or less is a value up to cut b.
    raw = [[Node(n.feature, n.value if n.feature < 0 else cuts[n.feature][int(n.value)], n.left, n.right) for n in tree] for tree in trees]
    return RankingTrees(features, rate, raw)


def _grow(rows: DataFrame, n_features: int, cuts: list[list[float]], depth: int, ridge: float) -> list[Node]:
    """A tree over bins; [] if there are no rows. The sums that come to the driver are nodes x features x bins."""
    tree = [Node(-1, 0.0)]
    open_ = {0}
    for level in range(depth + 1):
        at = _place(tree, lambda f: F.col("x")[f])
        sums = rows.select(at.alias("node"), "g", "h", F.posexplode("x").alias("f", "bin")).groupBy("node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        if not sums:
            return []
        per: dict[int, np.ndarray] = {k: np.zeros((2, n_features, max(map(len, cuts)) + 1)) for k in open_}
        for r in sums:
            if r["node"] in per:
                per[r["node"]][:, r["f"], r["bin"]] = r["g"], r["h"]
        for k in sorted(open_):
            g, h = per[k]
            all_g, all_h = g[0].sum(), h[0].sum()
            tree[k] = Node(-1, all_g / (all_h + ridge))
            left_g, left_h = g.cumsum(axis=1), h.cumsum(axis=1)
            gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
            for f, own in enumerate(cuts):
                gain[f, len(own) :] = 0.0
            f, b = np.unravel_index(int(gain.argmax()), gain.shape)
            open_.discard(k)
            if level < depth and gain[f, b] > 1e-9:
                tree[k] = Node(int(f), float(b), len(tree), len(tree) + 1)
                open_ |= {len(tree), len(tree) + 1}
                tree += [Node(-1, 0.0), Node(-1, 0.0)]
        if not open_:
            break
    return tree
