from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import boosting, fusion, learning, ranker, training
from quillon.operators.boosting import Settings
from quillon.plans import models

SCHEMA = "group_id string, place int, target int, fold int, a double, b double, c int"


def table(seed=1, groups=60, most=9, folds=3):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        for p in range(rng.randrange(1, most)):
            a, b, c = rng.choice((None, float("nan"), *[rng.random() for _ in range(9)])), rng.randrange(5) / 2.0, rng.choice((None, 1, 2, 3))
            right = (0 if a is None or math.isnan(a) else a) + (c or 0) / 3 + rng.random()
            rows.append((f"g{g:03}", p, int(right > 1.3), g % folds, a, b, c))
    return rows


def bins(rows, cuts):
    out = []
    for r in rows:
        own = []
        for v, cut in zip(r[4:], cuts, strict=True):
            own.append(0 if v is None else len(cut) if math.isnan(v) else sum(x < v for x in cut))
        out.append(own)
    return out


def gradients(rows, s, objective):
    """(g, h) of each row, one pair at a time."""
    if objective == "logistic":
        p = [1 / (1 + math.exp(-x)) for x in s]
        return [r[2] - q for r, q in zip(rows, p, strict=True)], [q * (1 - q) for q in p]
    g, h = [0.0] * len(rows), [0.0] * len(rows)
    for name in {r[0] for r in rows}:
        own = sorted((i for i, r in enumerate(rows) if r[0] == name), key=lambda i: (-s[i], rows[i][1]))
        ideal = sum(1 / math.log2(k + 2) for k in range(sum(rows[i][2] for i in own)))
        for x, i in enumerate(own):
            for y, j in enumerate(own):
                if rows[i][2] > rows[j][2]:
                    w = abs(1 / math.log2(x + 2) - 1 / math.log2(y + 2)) / ideal
                    q = 1 / (1 + math.exp(s[i] - s[j]))
                    g[i], g[j] = g[i] + w * q, g[j] - w * q
                    h[i], h[j] = h[i] + w * q * (1 - q), h[j] + w * q * (1 - q)
    return g, h


def measure(rows, s, objective, k):
    if objective == "logistic":
        return -sum(math.log(1 + math.exp(-x if r[2] else x)) for r, x in zip(rows, s, strict=True)) / len(rows)
    got = []
    for name in sorted({r[0] for r in rows}):
        own = sorted((i for i, r in enumerate(rows) if r[0] == name), key=lambda i: (-s[i], rows[i][1]))
        n = sum(rows[i][2] for i in own)
        if n:
            got.append(sum(rows[i][2] / math.log2(x + 2) for x, i in enumerate(own[:k])) / sum(1 / math.log2(x + 2) for x in range(min(n, k))))
    return sum(got) / len(got)


def plain(rows, cuts, st, run=None):
    """One run, every node's sums made from its rows: the scores of all rows after each tree, and the held-out measures."""
    x = bins(rows, cuts)
    train = [i for i, r in enumerate(rows) if run is None or r[3] != run]
    rest = [i for i, r in enumerate(rows) if run is not None and r[3] == run]
    s, history, measures = [0.0] * len(rows), [[0.0] * len(rows)], []
    note = lambda: measures.append(measure([rows[i] for i in rest], [s[i] for i in rest], st.objective, st.k)) if rest else None
    note()
    for _ in range(st.rounds):
        g, h = gradients(rows, s, st.objective)
        value = [0.0] * len(rows)
        split = False
        nodes = [list(range(len(rows)))]
        for _ in range(st.depth):
            after = []
            for node in nodes:
                own = [i for i in node if i in set(train)]
                gs, hs = sum(g[i] for i in own), sum(h[i] for i in own)
                best = (0.0, None)
                for f, cut in enumerate(cuts):
                    for b in range(len(cut)):
                        lg, lh = sum(g[i] for i in own if x[i][f] <= b), sum(h[i] for i in own if x[i][f] <= b)
                        gain = round(lg**2 / (lh + st.ridge) + (gs - lg) ** 2 / (hs - lh + st.ridge) - gs**2 / (hs + st.ridge), 9)
                        if lh >= st.least_weight and hs - lh >= st.least_weight and gain > best[0]:
                            best = (gain, (f, b))
                if best[1]:
                    split = True
                    f, b = best[1]
                    for side in ([i for i in node if x[i][f] <= b], [i for i in node if x[i][f] > b]):
                        mine = [i for i in side if i in set(train)]
                        for i in side:
                            value[i] = st.rate * sum(g[j] for j in mine) / (sum(h[j] for j in mine) + st.ridge)
                        after.append(side)
            nodes = after
        if not split:
            break
        s = [a + b for a, b in zip(s, value, strict=True)]
        history.append(s)
        note()
        if st.patience is not None and len(measures) - 1 - int(np.argmax(measures)) >= st.patience:
            break
    return history, measures


def scored(df, boosters, fold=None):
    return {(r.group_id, r.place): r.score for r in boosting.score(df, boosters, fold).collect()}


CUTS = [[0.2, 0.5, 0.8], [0.0, 0.5, 1.5], [1.0, 2.0]]


@pytest.mark.parametrize("objective", ["logistic", "ndcg"])
@pytest.mark.parametrize("parts", [1, 5])
def test_trees_equal_plain_ones(spark, monkeypatch, objective, parts):
    monkeypatch.setattr(boosting, "FEW_TASKS", 2)
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    st = Settings(objective, rounds=5, depth=3, rate=0.3, least_weight=0.05, between=2)
    (booster,) = boosting.fit(df, ["a", "b", "c"], st, cuts=CUTS)
    want = plain(rows, CUTS, st)[0][-1]
    got = scored(df, [booster])
    assert len(booster.trees) == 5 and booster.held_out == []
    assert all(math.isclose(got[r[0], r[1]], w, abs_tol=1e-9) for r, w in zip(rows, want, strict=True))


@pytest.mark.parametrize("objective", ["logistic", "ndcg"])
def test_folds_stop_where_plain_ones_do(spark, objective):
    """Noise is learned soon, so more rounds hurt: each fold's trees end with its best measure."""
    rows = table(7)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    st = Settings(objective, rounds=12, depth=3, rate=0.6, least_weight=0.02, patience=3, between=4, k=3)
    boosters = boosting.fit(df, ["a", "b", "c"], st, 3, CUTS)
    got, lengths = scored(df, boosters, F.col("fold")), []
    for run, booster in enumerate(boosters):
        history, measures = plain(rows, CUTS, st, run)
        assert np.allclose(booster.held_out, measures, atol=1e-9)
        assert len(booster.trees) == int(np.argmax(measures))
        lengths.append((len(booster.trees), len(measures) - 1))
        assert all(math.isclose(got[r[0], r[1]], history[len(booster.trees)][i], abs_tol=1e-9) for i, r in enumerate(rows) if r[3] == run)
    assert any(best < grown for best, grown in lengths) and any(grown < 12 for _, grown in lengths)


def test_odd_frames(spark):
    none = spark.createDataFrame([], SCHEMA)
    st = Settings(rounds=2, depth=2)
    assert [b.trees for b in boosting.fit(none, ["a", "c"], st, 2)] == [[], []]
    assert boosting.fit(none.drop("fold"), ["a"], Settings("ndcg", rounds=2))[0].trees == []
    one_class = spark.createDataFrame([(f"g{k}", 1, 1, 0, float(k), 0.0, k) for k in range(9)], SCHEMA)
    assert boosting.fit(one_class, ["a"], Settings("ndcg", rounds=2))[0].trees == []
    assert boosting.fit(one_class, [], st)[0].trees == []
    rows = table(3, 20)
    df = spark.createDataFrame([(*r[:3], None if r[0] == "g001" else 0, *r[4:]) for r in rows], SCHEMA)
    boosters = boosting.fit(df, ["a", "b"], Settings(rounds=2, depth=2, least_weight=0.0), 2)
    assert len(boosters) == 2 and len(boosters[1].trees) == 2
    got = boosting.score(df.withColumn("Score", F.lit(5)), boosters, F.col("fold"))
    assert got.columns.count("score") == 1 and "Score" not in got.columns
    assert {r.score is None for r in got.where("fold is null").collect()} == {True}
    with pytest.raises(ValueError, match="objective"):
        boosting.fit(df, ["a"], Settings("other"))


def test_blocks_keep_groups_whole(spark, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK", 16)
    rows = table(5, 80)
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    sizes = {}
    for b in boosting.make_blocks(df, ["a", "b", "c"], CUTS, 1, "ndcg").collect():
        own = np.frombuffer(b.sizes, np.int32)
        assert own.sum() == b.n and len(b.x) == 3 * b.n
        for n in own.tolist():
            sizes[n] = sizes.get(n, 0) + 1
    want = {}
    for g in {r[0] for r in rows}:
        n = sum(r[0] == g for r in rows)
        want[n] = want.get(n, 0) + 1
    assert sizes == want


def test_shares_of_rows_and_columns_repeat(spark):
    df = spark.createDataFrame(table(2, 40), SCHEMA).coalesce(1)
    st = Settings(rounds=3, depth=2, rows=0.7, columns=0.7, least_weight=0.0)
    one, two = (boosting.fit(df, ["a", "b", "c"], st, cuts=CUTS)[0].trees for _ in range(2))
    assert one == two and one != boosting.fit(df, ["a", "b", "c"], Settings(rounds=3, depth=2, least_weight=0.0), cuts=CUTS)[0].trees
    assert {f for t in one for f in t.feature if f >= 0}


def test_large_groups_go_in_portions(monkeypatch):
    rng = np.random.default_rng(4)
    sizes = np.array([1, 30, 2, 0, 17, 5])
    s, y = rng.normal(size=sizes.sum()), rng.integers(0, 2, sizes.sum()).astype(float)
    whole = boosting.ndcg_gradients(s, y, sizes), boosting.ndcg_sum(s, y, sizes, 3)
    monkeypatch.setattr(boosting, "PAIRS", 50)
    parts = boosting.ndcg_gradients(s, y, sizes), boosting.ndcg_sum(s, y, sizes, 3)
    assert np.allclose(whole[0], parts[0]) and np.allclose(whole[1], parts[1])


@pytest.mark.parametrize("objective", ["logistic", "ndcg"])
def test_equal_groups_are_one(spark, objective):
    """Blocks grow with what differs, not with rows, and trees are those of all rows."""
    rows = table(9, 30)
    many = [(f"{r[0]}-{k}", *r[1:]) for k in range(4) for r in rows]
    df = spark.createDataFrame(many, SCHEMA).repartition(3)
    st = Settings(objective, rounds=3, depth=2, rate=0.3, least_weight=0.05)
    held = boosting.make_blocks(df, ["a", "b", "c"], CUTS, 1, objective).collect()
    assert sum(b.n for b in held) <= len(rows) and sum(int(np.frombuffer(b.w, np.int64).sum()) for b in held) == len(many)
    (booster,) = boosting.fit(df, ["a", "b", "c"], st, cuts=CUTS)
    got, want = scored(df, [booster]), plain(many, CUTS, st)[0][-1]
    assert all(math.isclose(got[r[0], r[1]], w, abs_tol=1e-9) for r, w in zip(many, want, strict=True))


@pytest.mark.parametrize("alone", [0, 1])
def test_one_task_grows_the_trees_that_jobs_grow(spark, monkeypatch, alone):
    monkeypatch.setattr(boosting, "ALONE", alone)
    rows, st = table(4), Settings("ndcg", rounds=4, depth=2, rate=0.3, least_weight=0.05, between=2)
    (booster,) = boosting.fit(spark.createDataFrame(rows, SCHEMA), ["a", "b", "c"], st, cuts=CUTS)
    want = plain(rows, CUTS, st)[0][-1]
    assert all(math.isclose(got, w, abs_tol=1e-9) for got, w in zip([x[1] for x in sorted(scored(spark.createDataFrame(rows, SCHEMA), [booster]).items())], want, strict=True))


def test_two_models_score_rows_without_a_join(spark):
    """All rows of the smaller side of a join went through the driver as a broadcast: rows are now scored twice as they stand."""
    df = spark.createDataFrame(table(6), SCHEMA).selectExpr("'dev' source", "'train' split", "group_id", "'x' condition", "'c' || place candidate", "place candidate_rank", "group_id stay_id", "group_id patient_id", "target = 1 label", "nanvl(a, 2) a", "b", "c")
    names, settings = ["a", "b", "c"], (Settings("ndcg", rounds=3, depth=2, rate=0.3, least_weight=0.05), Settings(rounds=3, depth=2, rate=0.3, least_weight=0.05))
    both = models._both_scores(df, names, settings)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    got = {(r.group_id, r.candidate): (r.other_score, r.reference_score) for r in both.collect()}
    own = [{(r.group_id, r.candidate): r.score for r in boosting.out_of_fold(df, names, s, models.FOLDS, models.FOLD_SEED)[0].collect()} for s in settings]
    assert len(got) == df.count() and all(np.allclose(v, [x[k] for x in own]) for k, v in got.items()) and len({v for v in got.values()}) > 3


def test_alike_groups_stand_for_all(spark):
    """Groups alike in condition, fold and labels are one before they have features: cuts, trees, scores and the grid of weights
    are those of all groups."""
    rng = random.Random(12)
    value = {(c, k): (rng.random(), rng.randrange(5)) for c in "xyz" for k in range(3)}
    rows = [("dev", "train", c, s, s % 23, f"{s}|{c}", [(f"m{k}", k + 1, rng.random() < value[c, k][0], None) for k in range(3)]) for s in range(400) for c in rng.choice("xyz")]
    groups = spark.createDataFrame(rows, "source string, split string, condition string, stay_id long, patient_id long, group_id string, members array<struct<candidate: string, candidate_rank: long, label: boolean, label_events: long>>").repartition(3)
    features = spark.createDataFrame([(c, f"m{k}", *v) for (c, k), v in value.items()], "condition string, candidate string, a double, b long")
    alike = learning.alike_groups(groups, models.FOLD_SEED, models.FOLDS)
    assert alike.count() <= 3 * 3 * 8 and alike.agg(F.sum(learning.ALIKE)).first()[0] == 400
    every, few = (training.group_rows(g).join(features, ["condition", "candidate"]).cache() for g in (groups, alike))
    assert few.select("group_id").distinct().count() == alike.count()
    names = ["candidate_rank", "a", "b"]
    for bins in (3, 8, 40):
        assert ranker.bin_cuts(few, names, bins, learning.ALIKE) == ranker.bin_cuts(every, names, bins)
    settings = (Settings("ndcg", rounds=4, depth=2, rate=0.3, least_weight=0.05), Settings(rounds=4, depth=2, rate=0.3, least_weight=0.05))
    (one, many) = ([boosting.out_of_fold(rows, names, s, models.FOLDS, models.FOLD_SEED) for s in settings] for rows in (few, every))
    for (a, boosters), (b, want) in zip(one, many, strict=True):
        assert all(np.allclose(x.held_out, y.held_out, atol=1e-9) for x, y in zip(boosters, want, strict=True))
        scores = [{(r.condition, r.candidate, r.fold): r.score for r in df.collect()} for df in (a, b)]
        assert scores[0].keys() == scores[1].keys() and all(math.isclose(v, scores[1][k], abs_tol=1e-9) for k, v in scores[0].items())
    grids = [sorted(map(tuple, fusion.rank_grid(models._both_scores(rows, names, settings), 2).collect())) for rows in (few, every)]
    assert len(grids[0]) == 21 and all(np.allclose(a[2:], b[2:], atol=2e-6) and a[:2] == b[:2] for a, b in zip(*grids, strict=True))
