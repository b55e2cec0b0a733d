"""Histogram boosting on blocks of binned rows: logistic or ranking gradients, several runs (the
folds of a cross-validation) grown together, and early stopping on what a run holds out.

A block is one row of a table: up to BLOCK rows as bytes, one bin a feature. A job a level of a tree sums up the
gradients of all runs' open nodes by (run, node, feature, bin), task by task and then over tasks, and the driver, which sees
nothing but these sums, places the splits. Of two sibling nodes only the lighter is summed up; the other is what is left of
their parent. What the trees have made of the rows' scores is written with the blocks every few trees."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.exprs import patient_fold
from quillon.sources.scratch import drop_stash, stash

from .learning import ALIKE
from .ranker import bin_cuts

#: Rows of a block, at least: a ranking group is never cut.
BLOCK = 8192
#: Tasks whose sums the driver adds up itself; more are added up by tasks first.
FEW_TASKS = 16
#: Blocks that one task grows all trees on, without a job a level; more are a job's each.
ALONE = 1
#: Cells of pairs that ranking gradients hold at a time.
PAIRS = 1 << 21


@dataclass(frozen=True)
class Settings:
    """rounds trees of depth levels; a leaf is rate x sum of gradients / (sum of second derivatives + ridge), and a side of a
    split has second derivatives of least_weight at least. rows and columns: the shares that a tree is grown on. patience: a
    run stops when that many trees have not bettered what it holds out (None: never). k: of the NDCG that is held out.
    between: trees after which scores are written."""

    objective: str = "logistic"
    rounds: int = 200
    depth: int = 6
    rate: float = 0.1
    ridge: float = 1.0
    least_weight: float = 1.0
    rows: float = 1.0
    columns: float = 1.0
    patience: int | None = None
    k: int = 10
    seed: int = 1
    bins: int = 32
    between: int = 20


@dataclass
class Tree:
    """Nodes by number: feature (-1: a leaf), the last bin that goes left, both children, and a leaf's value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, at: int, feature: int, bin_: int, values: tuple[float, float]) -> tuple[int, int]:
        n = len(self.feature)
        self.feature[at], self.bin[at], self.left[at], self.right[at] = feature, bin_, n, n + 1
        for column, new in ((self.feature, (-1, -1)), (self.bin, (0, 0)), (self.left, (0, 0)), (self.right, (0, 0)), (self.value, values)):
            column += new
        return n, n + 1

    def place(self, x: np.ndarray) -> np.ndarray:
        """The node that each row of x (features x rows, bins) falls to."""
        feature, cut, left, right = (np.array(c) for c in (self.feature, self.bin, self.left, self.right))
        at, row = np.zeros(x.shape[1], np.int64), np.arange(x.shape[1])
        while (inner := feature[at] >= 0).any():
            at = np.where(inner, np.where(x[feature[at], row] <= cut[at], left[at], right[at]), at)
        return at

    def values(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.place(x)]


@dataclass
class Booster:
    """Trees whose values add up to a score. held_out: what was measured on the rows left out, after each tree that was
    grown (NDCG, or minus the log loss); trees are those up to the best of these."""

    features: list[str]
    cuts: list[list[float]]
    trees: list[Tree]
    held_out: list[float]


def logistic(s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and second derivatives of the log loss."""
    p = 1 / (1 + np.exp(-s))
    return y - p, p * (1 - p)


def _padded(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of groups of these sizes in (groups x longest), and where there is a row."""
    there = np.arange(sizes.max()) < sizes[:, None]
    at = np.zeros(there.shape, np.int64)
    at[there] = np.arange(sizes.sum())
    return at, there


def _ranks(s: np.ndarray, there: np.ndarray) -> np.ndarray:
    """A row's place in its group by score from above, equal scores as they stand; rows that are not there come last."""
    order = np.argsort(np.where(there, -s, np.inf), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(s.shape[1])[None, :].repeat(len(s), 0), 1)
    return rank


def _group_parts(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, slice]]:
    """Groups in portions of bounded pairs, with their rows."""
    starts = np.concatenate([[0], np.cumsum(sizes)])
    k = 0
    while k < len(sizes):
        longest = np.maximum.accumulate(sizes[k:])
        end = k + max(1, int((longest.astype(np.int64) ** 2 * np.arange(1, len(longest) + 1) <= PAIRS).sum()))
        yield sizes[k:end], slice(starts[k], starts[end])
        k = end


def ndcg_gradients(s: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of a group: what NDCG would gain if it and another of the other class changed places, times how likely the
    scores have the two the wrong way round, over all others; and the second derivatives. 0 in groups of one class."""
    g, h = np.zeros((2, len(s)))
    for own, rows in _group_parts(sizes):
        at, there = _padded(own)
        sp, yp = s[rows][at], y[rows][at] * there
        discount = np.where(there, 1 / np.log2(_ranks(sp, there) + 2.0), 0.0)
        positives = yp.sum(axis=1).astype(np.int64)
        ideal = np.concatenate([[1.0], np.cumsum(1 / np.log2(np.arange(own.max()) + 2.0))])[positives]
        differ = ((yp[:, :, None] > yp[:, None, :]) & there[:, None, :]) | ((yp[:, :, None] < yp[:, None, :]) & there[:, :, None])
        differ &= there[:, :, None] & there[:, None, :]
        weight = np.where(differ, np.abs(discount[:, :, None] - discount[:, None, :]), 0.0) / ideal[:, None, None]
        better = np.where(yp[:, :, None] > yp[:, None, :], 1.0, -1.0)
        wrong = 1 / (1 + np.exp(better * (sp[:, :, None] - sp[:, None, :])))
        g[rows] = (better * weight * wrong).sum(axis=2)[there]
        h[rows] = (weight * wrong * (1 - wrong)).sum(axis=2)[there]
    return g, h


def ndcg_sum(s: np.ndarray, y: np.ndarray, sizes: np.ndarray, k: int, weights: np.ndarray | None = None) -> tuple[float, int]:
    """The sum of NDCG at k over groups with a positive, and their number; a group counts as often as its weight says."""
    total, n, first = 0.0, 0, 0
    weights = np.ones(len(sizes), np.int64) if weights is None else weights
    for own, rows in _group_parts(sizes):
        w, first = weights[first : first + len(own)], first + len(own)
        at, there = _padded(own)
        sp, yp = s[rows][at], y[rows][at] * there
        rank, positives = _ranks(sp, there), yp.sum(axis=1).astype(np.int64)
        gained = (yp * np.where(rank < k, 1 / np.log2(rank + 2.0), 0.0)).sum(axis=1)
        ideal = np.concatenate([[1.0], np.cumsum(1 / np.log2(np.arange(max(k, 1)) + 2.0))])[np.minimum(positives, k)]
        total += float((w * gained / ideal)[positives > 0].sum())
        n += int(w[positives > 0].sum())
    return total, n


def binned(columns: list[np.ndarray], cuts: list[list[float]]) -> np.ndarray:
    """How many cuts each value lies above (features x rows); a null (NaN here comes from none) counts as the least."""
    return np.stack([np.where(np.isnan(c), 0, np.searchsorted(own, c)) for c, own in zip(columns, cuts, strict=True)]).astype(np.uint8)


def best_split(sums: np.ndarray, cuts: list[list[float]], s: Settings, allowed: np.ndarray) -> tuple[float, int, int]:
    """(gain, feature, bin) of a node's sums (features x bins x 2); of gains equal to nine places the first feature and bin."""
    g, h = sums[:, :, 0], sums[:, :, 1]
    left_g, left_h = g.cumsum(axis=1), h.cumsum(axis=1)
    all_g, all_h = left_g[:, -1:], left_h[:, -1:]
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + s.ridge) + right_g**2 / (right_h + s.ridge) - all_g**2 / (all_h + s.ridge)
    ends = np.arange(g.shape[1])[None, :] < np.array([len(c) for c in cuts])[:, None]
    gain = np.where(ends & allowed[:, None] & (left_h >= s.least_weight) & (right_h >= s.least_weight), np.round(gain, 9), 0.0)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[f, b]), int(f), int(b)


class _Block:
    """One row of the table of blocks."""

    def __init__(self, row: dict, n_features: int) -> None:
        self.id, n = row["block"], row["n"]
        self.x = np.frombuffer(row["x"], np.uint8).reshape(n_features, n)
        self.y = np.frombuffer(row["y"], np.uint8).astype(float)
        self.fold = np.frombuffer(row["fold"], np.int8)
        self.sizes = np.frombuffer(row["sizes"], np.int32).astype(np.int64)
        self.w = np.frombuffer(row["w"], np.int64)
        self.s = np.frombuffer(row["s"], np.float64).reshape(-1, n)

    def scores(self, run: int, trees: list[Tree]) -> np.ndarray:
        return sum((t.values(self.x) for t in trees), self.s[run])


BLOCK_SCHEMA = "block long, n int, x binary, y binary, fold binary, sizes binary, w binary, s binary"


def make_blocks(frame: DataFrame, features: list[str], cuts: list[list[float]], runs: int, objective: str) -> DataFrame:
    """The table of blocks of a frame (group_id, place, target of 0 or 1, fold, features), scores at 0, written. Groups (for
    ranking; otherwise rows) that are alike in bins, targets and fold, in the order of place, are one, with their number in
    w (a number a row): they have the same scores and gradients in every tree. A row's ALIKE says how many it stands for."""

    def as_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[4:]]
            x = binned(columns, cuts) if features else np.zeros((0, batch.num_rows), np.uint8)
            rows = pa.array([r.tobytes() for r in np.ascontiguousarray(x.T)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], rows], ["key", "target", "fold", "times", "x"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, n = TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            nonlocal number, held, n
            x, y, fold = (np.concatenate([np.frombuffer(v, np.uint8) for r in held for v in r["m"][c]] or [np.zeros(0, np.uint8)]) if c == "x" else np.array([v for r in held for v in r["m"][c]], np.int64) for c in ("x", "target", "fold"))
            sizes = np.array([len(r["m"]["target"]) for r in held], np.int32)
            w = np.repeat(np.array([r["w"] for r in held], np.int64), sizes)
            row = (number, n, np.ascontiguousarray(x.reshape(n, len(features)).T).tobytes(), y.astype(np.uint8).tobytes(), fold.astype(np.int8).tobytes(), sizes.tobytes(), w.tobytes(), np.zeros((runs, n)).tobytes())
            number, held, n = number + 1, [], 0
            return pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, row, strict=True))], _ARROW)

        for batch in batches:
            for r in batch.to_pylist():
                held.append(r)
                n += len(r["m"]["target"])
                if n >= BLOCK:
                    yield out()
        if held:
            yield out()

    ranking = objective != "logistic"
    key = F.struct("group_id", "place") if ranking else F.lit(0)
    own = frame.select(key.alias("key"), F.col("target").cast("int").alias("target"), F.coalesce(F.col("fold").cast("int"), F.lit(-1)).alias("fold"), (F.col(ALIKE) if ALIKE in frame.columns else F.lit(1)).cast("long").alias("times"), *[F.nanvl(F.col(f).cast("double"), F.lit(float("inf"))).alias(f"f{i}") for i, f in enumerate(features)])
    kind = own.schema["key"].dataType.simpleString()
    bins = own.mapInArrow(as_bins, f"key {kind}, target int, fold int, times long, x binary")
    if ranking:
        rows = bins.groupBy("key.group_id").agg(F.array_sort(F.collect_list(F.struct("key.place", "target", "fold", "x"))).alias("all"), F.max("times").alias("times"))
        groups = rows.select(F.struct(*[F.col("all").getField(c).alias(c) for c in ("target", "fold", "x")]).alias("m"), "times")
    else:
        groups = bins.select(F.struct(*[F.array(c).alias(c) for c in ("target", "fold", "x")]).alias("m"), "times")
    return stash(groups.groupBy("m").agg(F.sum("times").alias("w")).sortWithinPartitions("m").mapInArrow(pack, BLOCK_SCHEMA), "blocks")


_ARROW = pa.schema([("block", pa.int64()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("x", "y", "fold", "sizes", "w", "s")]])


def _block_sums(rows: Iterable[dict], n_features: int, n_bins: int, s: Settings, folds: int, pending: list[list[Tree]], growing: list[Tree], wanted: dict[int, list[int]], number: int, measure: bool) -> dict[tuple[int, int], np.ndarray]:
    """By (run, node): the sums of gradients over the blocks' rows (features x bins x 2); by (run, -1): the held-out measure's sum
    and count. pending: trees of each run that are not in the blocks' scores yet."""
    total: dict[tuple[int, int], np.ndarray] = {}

    def add(key: tuple[int, int], value: np.ndarray) -> None:
        total[key] = total[key] + value if key in total else value

    for row in rows:
        b = _Block(row, n_features)
        # Of w rows that are alike each is drawn by itself, so how many are is a binomial number.
        weight = np.random.default_rng((s.seed, number, b.id)).binomial(b.w, s.rows) if s.rows < 1 else b.w
        for run, nodes in wanted.items():
            score = b.scores(run, pending[run])
            out = b.fold == run if folds else np.zeros(len(b.y), bool)
            if measure and folds:
                if s.objective == "logistic":
                    loss = np.logaddexp(0, np.where(b.y > 0, -score, score))[out]
                    add((run, -1), np.array([-(loss * b.w[out]).sum(), b.w[out].sum()]))
                else:
                    firsts = np.concatenate([[0], np.cumsum(b.sizes)[:-1]])
                    own = out[firsts]
                    add((run, -1), np.array(ndcg_sum(score[out], b.y[out], b.sizes[own], s.k, b.w[firsts][own])) if own.any() else np.zeros(2))
            g, h = logistic(score, b.y) if s.objective == "logistic" else ndcg_gradients(score, b.y, b.sizes)
            slot = np.full(len(growing[run].feature), -1)
            slot[nodes] = np.arange(len(nodes))
            at = slot[growing[run].place(b.x)]
            at_ = np.flatnonzero((at >= 0) & ~out & (weight > 0))
            g, h = g * weight, h * weight
            sums = np.zeros((len(nodes), n_features, n_bins, 2))
            base, g, h = at[at_] * n_bins, g[at_], h[at_]
            for f in range(n_features):
                cell = base + b.x[f, at_]
                for k, v in enumerate((g, h)):
                    sums[:, f, :, k] = np.bincount(cell, v, len(nodes) * n_bins).reshape(len(nodes), n_bins)
            for k, node in enumerate(nodes):
                add((run, node), sums[k])
    return total


def _sums(blocks: DataFrame, tasks: int, n_features: int, n_bins: int, s: Settings, folds: int, pending: list[list[Tree]], growing: list[Tree], wanted: dict[int, list[int]], number: int, measure: bool) -> dict[tuple[int, int], np.ndarray]:
    """_block_sums of a table, a job."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _rows_of(_block_sums((row for batch in batches for row in batch.to_pylist()), n_features, n_bins, s, folds, pending, growing, wanted, number, measure))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                key, value = (r["run"], r["node"]), np.frombuffer(r["sums"])
                total[key] = total[key] + value if key in total else value
        yield _rows_of(total)

    parts = blocks.mapInArrow(part, "run int, node int, sums binary")
    if tasks > FEW_TASKS:
        parts = parts.repartition(max(1, round(tasks**0.5)), "run", "node").mapInArrow(added, "run int, node int, sums binary")
    out: dict[tuple[int, int], np.ndarray] = {}
    for r in parts.collect():
        key, value = (r["run"], r["node"]), np.frombuffer(r["sums"])
        value = value if r["node"] < 0 else value.reshape(n_features, n_bins, 2)
        out[key] = out[key] + value if key in out else value
    return out


def _rows_of(total: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    keys = list(total)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k].tobytes() for k in keys], pa.binary())], ["run", "node", "sums"])


def _raised(row: dict, n_features: int, pending: list[list[Tree]]) -> dict:
    b = _Block(row, n_features)
    return row | {"s": np.stack([b.scores(run, trees) for run, trees in enumerate(pending)]).tobytes()}


class _Jobs:
    """Blocks as a table: sums and scores are jobs."""

    def __init__(self, blocks: DataFrame, tasks: int, n_features: int) -> None:
        self.blocks, self.tasks, self.n = blocks, tasks, n_features

    def sums(self, *args) -> dict[tuple[int, int], np.ndarray]:
        return _sums(self.blocks, self.tasks, self.n, *args)

    def raise_scores(self, pending: list[list[Tree]]) -> None:
        step = _scored(self.blocks, self.n, pending).persist()
        drop_stash(self.blocks.unpersist())
        self.blocks = step


class _Rows:
    """The blocks that a task has."""

    def __init__(self, rows: list[dict], n_features: int) -> None:
        self.rows, self.n = rows, n_features

    def sums(self, *args) -> dict[tuple[int, int], np.ndarray]:
        return _block_sums(self.rows, self.n, *args)

    def raise_scores(self, pending: list[list[Tree]]) -> None:
        self.rows = [_raised(row, self.n, pending) for row in self.rows]


def _scored(blocks: DataFrame, n_features: int, pending: list[list[Tree]]) -> DataFrame:
    """The blocks with the pending trees in their scores, written."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([_raised(row, n_features, pending)], _ARROW)

    return stash(blocks.mapInArrow(put, BLOCK_SCHEMA), "blocks")


def _grow(table: _Jobs | _Rows, n_features: int, n_bins: int, cuts: list[list[float]], s: Settings, folds: int) -> tuple[list[list[Tree]], list[list[float]]]:
    """Every run's trees, and what was measured on the rows left out."""
    runs = max(1, folds)
    trees: list[list[Tree]] = [[] for _ in range(runs)]
    measured: list[list[float]] = [[] for _ in range(runs)]
    pending: list[list[Tree]] = [[] for _ in range(runs)]
    going = set(range(runs))

    def note(sums: dict[tuple[int, int], np.ndarray]) -> None:
        for run in sorted(going):
            if (run, -1) in sums:
                total, n = sums[run, -1]
                measured[run].append(float(total / n) if n else 0.0)
                if s.patience is not None and len(measured[run]) - 1 - int(np.argmax(measured[run])) >= s.patience:
                    going.discard(run)

    for number in range(s.rounds):
        growing = [Tree() for _ in range(runs)]
        of: dict[tuple[int, int], np.ndarray] = {}
        open_ = {run: [0] for run in sorted(going)}
        weight: dict[tuple[int, int], float] = {}
        parent: dict[tuple[int, int], int] = {}
        for level in range(s.depth):
            # of each pair of siblings the lighter is summed up
            lighter = {run: nodes if level == 0 else [min(nodes[k : k + 2], key=lambda n, r=run: (weight[r, n], n)) for k in range(0, len(nodes), 2)] for run, nodes in open_.items()}
            sums = table.sums(n_bins, s, folds, pending, growing, lighter, number, level == 0)
            if level == 0:
                note(sums)
                open_ = {run: nodes for run, nodes in open_.items() if run in going}
            for run, nodes in open_.items():
                for n in lighter[run]:
                    of[run, n] = sums.get((run, n), np.zeros((n_features, n_bins, 2)))
                for n in nodes:
                    if (run, n) not in of:  # siblings are an odd number and the even one after it
                        of[run, n] = of[run, parent[run, n]] - of[run, n + 1 if n % 2 else n - 1]
            weight, parent = {}, {}
            after: dict[int, list[int]] = {}
            for run, nodes in open_.items():
                allowed = _columns(s, run, number, n_features)
                for n in nodes:
                    gain, f, b = best_split(of[run, n], cuts, s, allowed) if n_features else (0.0, 0, 0)
                    if gain <= 0:
                        continue
                    left = of[run, n][f, : b + 1].sum(axis=0)
                    right = of[run, n][f].sum(axis=0) - left
                    children = growing[run].split(n, f, b, tuple(s.rate * float(x[0] / (x[1] + s.ridge)) for x in (left, right)))
                    for child, own in zip(children, (left, right), strict=True):
                        weight[run, child], parent[run, child] = float(own[1]), n
                    after.setdefault(run, []).extend(children)
            open_ = after
            if not open_:
                break
        for run in sorted(going):
            if len(growing[run].feature) == 1:
                going.discard(run)  # no split is worth it, and none will be
            else:
                trees[run].append(growing[run])
                pending[run].append(growing[run])
        if not going:
            break
        if max(map(len, pending)) >= s.between:
            table.raise_scores(pending)
            pending = [[] for _ in range(runs)]
    if folds and (ends := {run: [0] for run in sorted(going)}):
        note(table.sums(n_bins, s, folds, pending, [Tree() for _ in range(runs)], ends, s.rounds, True))
    return trees, measured


def fit(frame: DataFrame, features: list[str], settings: Settings = Settings(), folds: int = 0, cuts: list[list[float]] | None = None) -> list[Booster]:
    """Boosters on a frame (group_id, place, target of 0 or 1, features, and with folds their number in fold): one on all
    rows or, with folds, one for each fold on the rows of the others, measured on its own. A job a level serves all runs.

    Null features count as the least values and NaN as the largest. cuts default to about equally many rows a bin. With
    patience a run's trees end with the best measure (the first of equals; no tree at all may be best). For ranking,
    groups must lie in one fold; those of one class say nothing. A run without rows has no trees; rows without a fold
    belong to all runs and are measured by none. Equal frames in equal
    partitions give equal trees; other partitions differ by rounding (and, where rows < 1, by what is drawn).
    """
    if settings.objective not in ("logistic", "ndcg"):
        raise ValueError(f"no objective {settings.objective}")
    s, runs = settings, max(1, folds)
    held = frame if folds else frame.withColumn("fold", F.lit(-1))
    if cuts is None:
        cuts = bin_cuts(frame, features, s.bins, ALIKE if ALIKE in frame.columns else None) if features else []
    n_features, n_bins = len(features), max([len(c) for c in cuts], default=0) + 1
    if n_bins > 256:
        raise ValueError("at most 255 cuts a feature")
    blocks = make_blocks(held, features, cuts, runs, s.objective).persist()  # the files are there if an executor is lost
    count = blocks.count()
    if 0 < count <= ALONE:

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [row for batch in batches for row in batch.to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_grow(_Rows(rows, n_features), n_features, n_bins, cuts, s, folds))], pa.binary())], ["grown"])

        trees, measured = pickle.loads(blocks.coalesce(1).mapInArrow(alone, "grown binary").first()[0])
    else:
        table = _Jobs(blocks, blocks.rdd.getNumPartitions(), n_features)
        trees, measured = _grow(table, n_features, n_bins, cuts, s, folds)
        blocks = table.blocks
    drop_stash(blocks.unpersist())
    best = [int(np.argmax(m)) if s.patience is not None and m else len(t) for m, t in zip(measured, trees, strict=True)]
    return [Booster(features, cuts, t[:n], m) for t, n, m in zip(trees, best, measured, strict=True)]


def _columns(s: Settings, run: int, number: int, n: int) -> np.ndarray:
    """Which features a tree may split by."""
    out = np.ones(n, bool)
    if s.columns < 1 and n:
        out[:] = False
        out[np.random.default_rng((s.seed, run, number)).permutation(n)[: max(1, round(s.columns * n))]] = True
    return out


def score(rows: DataFrame, boosters: list[Booster], fold: Column | None = None, probability: bool = False, name: str = "score") -> DataFrame:
    """rows with their score by the booster of their fold (the first where fold is not given; null where there is none such).
    With probability, the score of a logistic booster is turned into one. A column of that name is replaced."""
    kept = [c for c in rows.columns if c.lower() != name.lower()]
    features = boosters[0].features

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k = batch.num_rows, len(kept)
            own = [batch.column(k + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))]
            at = np.nan_to_num(batch.column(k + len(features)).to_numpy(zero_copy_only=False).astype(float), nan=-1).astype(int)
            out = np.zeros(n)
            for run, booster in enumerate(boosters):
                if (mine := at == run).any():
                    x = binned([c[mine] for c in own], booster.cuts) if features else np.zeros((0, int(mine.sum())), np.uint8)
                    out[mine] = sum((t.values(x) for t in booster.trees), np.zeros(int(mine.sum())))
            values = 1 / (1 + np.exp(-out)) if probability else out
            result = pa.array(values, mask=(at < 0) | (at >= len(boosters)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], result], [*kept, name])

    which = F.lit(0) if fold is None else fold.cast("int")
    held = rows.select(*kept, *[F.nanvl(F.col(f).cast("double"), F.lit(float("inf"))).alias(f"__f{i}") for i, f in enumerate(features)], which.alias("__run"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields)
    return held.mapInArrow(put, f"{fields}, `{name}` double")


def out_of_fold(rows: DataFrame, features: list[str], settings: Settings, folds: int, seed: int, fit_on: DataFrame | None = None, cuts: list[list[float]] | None = None, name: str = "score") -> tuple[DataFrame, list[Booster]]:
    """Rows (patient_id, group_id, candidate_rank, candidate, label, features) with fold and score (called name), each
    scored by the booster of the other patients' rows; and the boosters. fit_on: the rows to fit on (a sample, say), rows by
    default. Rows may be those of learning.alike_groups. Rows that one model has scored can be scored by the next as they stand; nothing has to be joined."""
    folded = lambda df: df.withColumn("fold", patient_fold(F.col("patient_id"), seed, folds))
    order = F.struct(F.col("candidate_rank").isNull(), "candidate_rank", F.col("candidate").isNull(), "candidate")
    own = folded(rows if fit_on is None else fit_on).select("group_id", order.alias("place"), F.col("label").cast("int").alias("target"), "fold", *[c for c in (rows if fit_on is None else fit_on).columns if c == ALIKE], *features)
    boosters = fit(own, features, settings, folds, cuts)
    return score(folded(rows), boosters, F.col("fold"), settings.objective == "logistic", name), boosters
