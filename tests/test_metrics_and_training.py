from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import exprs
from quillon.operators import features, fusion, learning, metrics, ranker, training

SCORE_FIELDS = "baseline string, source string, split string, stay_id long, group_id string, condition string, candidate string, candidate_rank long, label boolean, score double"


def frame(spark, rows):
    """rows: (group, candidate, label, score)."""
    return spark.createDataFrame([("b", "dev", "train", 1, g, "c", c, k, y, s) for k, (g, c, y, s) in enumerate(rows, 1)], SCORE_FIELDS)


def plain_ranking(rows, k):
    groups = {}
    for place, (g, c, y, s) in enumerate(rows, 1):
        groups.setdefault(g, []).append((-s, place, c, y))
    out = []
    for own in groups.values():
        ys = [y for *_, y in sorted(own)]
        if any(ys):
            hits = sum(ys[:k])
            dcg = sum(1 / math.log2(i + 2) for i, y in enumerate(ys[:k]) if y)
            ideal = sum(1 / math.log2(i + 2) for i in range(min(k, sum(ys))))
            out.append((hits / min(k, len(ys)), hits / sum(ys), float(hits > 0), dcg / ideal, next((1 / (i + 1) for i, y in enumerate(ys[:k]) if y), 0.0)))
    return [round(sum(x) / len(out), 6) for x in zip(*out, strict=True)] if out else [None] * 5


@pytest.mark.parametrize("k", [1, 2, 5])
def test_ranking_metrics_by_hand(spark, k):
    rows = [("g1", "a", True, 0.2), ("g1", "b", False, 0.9), ("g1", "c", True, 0.2), ("g2", "a", False, 0.5), ("g2", "b", True, 0.5), ("g3", "a", False, 0.9), ("g4", "a", True, 0.1)]
    r = metrics.ranking_metrics(frame(spark, rows), k).first()
    assert r.groups == 3 and [r.precision, r.recall, r.hit, r.ndcg, r.mrr] == plain_ranking(rows, k)


def test_ranking_metrics_without_positives(spark):
    r = metrics.ranking_metrics(frame(spark, [("g", "a", False, 1.0)]), 5).first()
    assert r.groups == 0 and r.ndcg is None and metrics.ranking_metrics(frame(spark, []), 5).count() == 0


def plain_rows(rows, bins=10):
    ys, ss = [y for *_, y, _ in rows], [s for *_, s in rows]
    p, n = sum(ys), len(ys) - sum(ys)
    if not p or not n:
        return [None] * 4
    pairs = sum((a > b) + 0.5 * (a == b) for a, y in zip(ss, ys, strict=True) if y for b, z in zip(ss, ys, strict=True) if not z)
    brier = sum((s - y) ** 2 for s, y in zip(ss, ys, strict=True)) / len(ys)
    cells = {}
    for s, y in zip(ss, ys, strict=True):
        cells.setdefault(min(bins - 1, math.floor(bins * min(1, max(0, s)))), []).append((s, y))
    ece = sum(abs(sum(y for _, y in c) - sum(s for s, _ in c)) for c in cells.values()) / len(ys)
    order = sorted(range(len(rows)), key=lambda i: -ss[i])
    seen = ap = 0
    for place, i in enumerate(order, 1):
        if ys[i]:
            seen += 1
            ap += seen / place
    return [round(x, 6) for x in (ap / p, pairs / (p * n), brier, ece)]


def test_row_metrics_by_hand(spark):
    rows = [("g", str(k), k % 3 == 0, (k * 37 % 50) / 50) for k in range(40)]
    r = metrics.row_metrics(frame(spark, rows)).first()
    assert [r.average_precision, r.roc_auc, r.brier, r.calibration_error] == plain_rows(rows)
    tied = [("g", str(k), k < 5, 0.5) for k in range(10)]
    r = metrics.row_metrics(frame(spark, tied)).first()
    assert r.roc_auc == 0.5 and r.average_precision is not None
    one = metrics.row_metrics(frame(spark, [("g", "a", True, 0.3), ("g", "b", True, 1.5)])).first()
    assert one.row_count == 2 and one.roc_auc is None and one.brier is None


def test_small_cells_are_suppressed(spark):
    rows = [("g1", "a", True, 0.2), ("g2", "a", True, 0.2)]
    shown = metrics.condition_metrics(frame(spark, rows), 5, 2).first()
    hidden = metrics.condition_metrics(frame(spark, rows), 5, 3).first()
    assert shown.hit == 1.0 and shown.status == "reported" and hidden.hit is None and hidden.groups == 2


def test_eligibility_and_label_window_borders(spark):
    ends = spark.createDataFrame([(1, None), (2, 23.9), (3, 24.0), (4, 47.9), (5, 48.0)], "stay_id long, end_hours double")
    got = {r.stay_id: r.eligibility for r in training.decision_times(ends).collect()}
    assert got == {1: "missing_observation_end", 2: "censored_before_prediction", 3: "censored_before_label_window", 4: "censored_before_label_window", 5: "eligible_primary"}
    events = spark.createDataFrame([(1, "m", 24.0), (1, "m", 24.1), (1, "m", 48.0), (1, "m", 48.1), (1, "m", None), (1, None, 30.0)], "stay_id long, candidate string, hours double")
    assert [tuple(r) for r in training.label_events(events).collect()] == [(1, "m", 2, 24.1)]


def test_catalog_is_fitted_on_training_stays_only(spark):
    stays = spark.createDataFrame([(1, "dev", "train", "c"), (2, "dev", "train", "c"), (3, "dev", "test", "c"), (4, "external", "external", "c")], "stay_id long, source string, split string, condition string")
    labels = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (1, "b", 9), (2, "d", 9), (3, "held_out", 5), (4, "far", 5)], "stay_id long, candidate string, events long")
    rows = training.candidate_catalog(stays, labels, 2).orderBy("candidate_rank").collect()
    assert [(r.candidate, r.stays, r.candidate_rank) for r in rows] == [("a", 2, 1), ("b", 1, 2)]
    pcm = training.ranking_rows(stays, training.candidate_catalog(stays, labels, 2), labels)
    assert pcm.count() == 8 and pcm.where("label").count() == 3
    out = {r.split: r.out_of_catalog for r in training.out_of_catalog(stays, training.candidate_catalog(stays, labels, 2), labels).collect()}
    assert out == {"train": 1, "test": 1, "external": 1}


def test_scores_of_unseen_candidates_are_zero(spark):
    rows = spark.createDataFrame([("dev", "train", 1, "1|c", "c", "a", 1, True), ("dev", "train", 1, "1|c", "c", "b", 2, False), ("dev", "test", 2, "2|d", "d", "a", 1, True)], "source string, split string, stay_id long, group_id string, condition string, candidate string, candidate_rank long, label boolean")
    got = {(r.baseline, r.group_id, r.candidate): r.score for r in metrics.baseline_scores(rows).collect()}
    assert got["condition_popularity", "1|c", "a"] == 1.0 and got["condition_popularity", "2|d", "a"] == 0.0 and got["global_popularity", "2|d", "a"] == 1.0 and got["global_popularity", "1|c", "b"] == 0.0
    assert all(0 <= got["random", g, c] <= 1 for b, g, c in got if b == "random")
    assert all(r.score == 0 for r in metrics.baseline_scores(rows.where("split = 'test'")).where("baseline <> 'random'").collect())


def test_negatives_are_capped_in_positive_groups_only(spark):
    rows = [("g1", f"n{k:02}", k == 3) for k in range(15)] + [("g2", "x", False)]
    df = spark.createDataFrame(rows, "group_id string, candidate string, label boolean")
    out = learning.capped_negatives(df, 1, 5, 10).collect()
    assert len(out) == 11 and sum(r.label for r in out) == 1 and {r.group_id for r in out} == {"g1"}
    assert {r.candidate for r in out} == {r.candidate for r in learning.capped_negatives(df.repartition(3), 1, 5, 10).collect()}


def test_patients_stay_in_one_fold_and_split(spark):
    df = spark.range(300).select((F.col("id") % 50).alias("patient_id"))
    folds = df.select("patient_id", exprs.patient_fold(F.col("patient_id"), 7, 5).alias("fold")).distinct()
    assert folds.count() == 50 and folds.select("fold").distinct().count() == 5
    with pytest.raises(ValueError):
        exprs.patient_fold(F.col("patient_id"), 7, 1)


def test_fusion_weight_and_gates(spark):
    rows = [("g1", "a", True, 0.1), ("g1", "b", False, 0.9), ("g2", "a", True, 0.2), ("g2", "b", False, 0.8)]
    pairs = frame(spark, rows).drop("baseline").withColumnRenamed("score", "reference_score").withColumn("other_score", F.col("label").cast("double"))
    grid = fusion.fusion_grid(pairs, 1)
    assert grid.count() == 21 and fusion.select_weight(grid) == 0.5 and fusion.select_rank_weight(pairs, 1) == 1.0
    flat = fusion.fusion_grid(pairs.withColumn("other_score", F.col("reference_score")), 1)
    assert fusion.select_weight(flat) == 0.5
    base = {"ndcg": 0.37, "mrr": 0.48, "hit": 0.85}
    assert fusion.gate({"ndcg": 0.375, "mrr": 0.475, "hit": 0.85}, base)["decision"] == "promote"
    assert fusion.gate({"ndcg": 0.374, "mrr": 0.48, "hit": 0.85}, base)["decision"] == "keep_reference"
    assert fusion.gate({"ndcg": 0.4, "mrr": 0.46, "hit": 0.85}, base)["decision"] == "keep_reference"
    assert fusion.gate({"ndcg": None}, base)["delta"]["ndcg"] is None
    assert fusion.select_best([{"name": "b", "ndcg": 0.3, "mrr": 0.2, "hit": 0.1}, {"name": "a", "ndcg": 0.3, "mrr": 0.2, "hit": 0.1}, {"name": "c", "ndcg": None}])["name"] == "a"


def test_models_learn_an_obvious_signal(spark):
    rows = [(f"p{k % 40}", "dev", "train", k, f"g{k}", "c", c, r, (c == "a") == (k % 2 == 0), float(k % 2 == 0) if c == "a" else float(k % 2), "x" if k % 3 else None) for k in range(160) for r, c in enumerate("ab", 1)]
    df = spark.createDataFrame(rows, "patient_id string, source string, split string, stay_id long, group_id string, condition string, candidate string, candidate_rank long, label boolean, signal double, kind string")
    df = df.withColumn("signal", F.when(F.col("stay_id") % 10 > 0, F.col("signal")))
    spec = learning.feature_spec(df)
    assert spec == learning.FeatureSpec(["candidate_rank", "signal"], ["condition", "kind"])
    prep = learning.Preprocessor.fit(df, spec)
    models = {"linear": learning.fit_linear(df, prep), "trees": learning.fit_trees(df, prep, 3, 2), "pairs": learning.fit_pairwise_ranker(df, prep)}
    got = {r.baseline: r.ndcg for r in metrics.ranking_metrics(learning.model_scores(df, prep, models), 1).collect()}
    assert all(v > 0.9 for v in got.values()) and set(got) == {"linear", "trees", "pairs"}
    assert learning.cross_validated(df, spec, learning.fit_linear, 2, 3, 1).first().ndcg > 0.9


def test_models_of_rows_that_are_alike(spark):
    """Copies are one row with a weight, in fits as in fills and scales, and what is fitted is that of all rows."""
    from pyspark.ml.classification import LogisticRegression

    kinds = [(1.0, "x", True, 90), (1.0, "x", False, 30), (2.5, "y", True, 3), (None, "y", False, 200), (7.0, None, False, 11), (7.0, "x", True, 1)]
    rows = [(a, k, y) for a, k, y, n in kinds for _ in range(n)]
    df = spark.createDataFrame(rows, "a double, kind string, label boolean")
    spec = learning.FeatureSpec(["a"], ["kind"])
    alike = learning.alike_rows(df, spec)
    assert sorted(r[learning.ALIKE] for r in alike.collect()) == [1, 3, 11, 30, 90, 200]
    assert learning.alike_rows(alike, spec) is alike
    held = [a for a, _, _ in rows if a is not None]
    filled = np.array([np.median(held) if a is None else a for a, _, _ in rows])
    for prep in (learning.Preprocessor.fit(df, spec), learning.Preprocessor.fit(alike)):
        assert prep.fills == {"a": np.median(held)}
        assert prep.means["a"] == pytest.approx(filled.mean()) and prep.deviations["a"] == pytest.approx(filled.std(ddof=1))
    got = prep.transform(df).select("a", "kind", "features").distinct().collect()
    for r in got:  # kinds by their numbers (y, x, missing), one place for unknown ones, the scaled number
        want = [r.kind == "y", r.kind == "x", r.kind is None, 0, ((np.median(held) if r.a is None else r.a) - filled.mean()) / filled.std(ddof=1)]
        assert r.features.toArray() == pytest.approx([float(v) for v in want])
    whole = prep.transform(df).withColumn("target", F.col("label").cast("double"))
    want = LogisticRegression(labelCol="target", regParam=0.05, maxIter=50).fit(whole)
    for train in (df, alike):
        model = learning.fit_linear(train, prep, 0.05)
        assert model.coefficients.toArray() == pytest.approx(want.coefficients.toArray(), abs=1e-4) and model.intercept == pytest.approx(want.intercept, abs=1e-4)
    trees = [[r.probability.toArray() for r in learning.fit_trees(train, prep, 4, 3).transform(whole).select("features", "probability").distinct().orderBy(F.col("features").cast("string")).collect()] for train in (df, alike)]
    assert np.allclose(*trees)
    assert learning.fit_trees(alike, prep, 1, 1).trees[0].numNodes == 3


def plain_ranking_trees(x, y, group, rounds, depth, rate, ridge, cuts):
    """The ranker's algorithm over arrays; scores by row."""
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    s = np.zeros(len(y))
    for _ in range(rounds):
        g, h = np.zeros(len(y)), np.zeros(len(y))
        for k in np.unique(group):
            rows = np.flatnonzero(group == k)
            order = rows[np.lexsort((rows, -s[rows]))]
            d = 1 / np.log2(np.arange(len(order)) + 2.0)
            ideal = d[: int(y[rows].sum())].sum()
            for a, i in enumerate(order):
                for b, j in enumerate(order):
                    if y[i] > y[j]:
                        w, p = abs(d[a] - d[b]) / ideal, 1 / (1 + np.exp(s[i] - s[j]))
                        g[i] += w * p
                        g[j] -= w * p
                        h[i] += w * p * (1 - p)
                        h[j] += w * p * (1 - p)

        def grow(rows, level, g=g, h=h):
            best, pick = 1e-9, None
            total = g[rows].sum() ** 2 / (h[rows].sum() + ridge)
            for f in range(x.shape[1] if level < depth else 0):
                for b in range(len(cuts[f])):
                    left = rows[binned[rows, f] <= b]
                    right = rows[binned[rows, f] > b]
                    gain = g[left].sum() ** 2 / (h[left].sum() + ridge) + g[right].sum() ** 2 / (h[right].sum() + ridge) - total
                    if gain > best + 1e-12:
                        best, pick = gain, (left, right)
            if pick is None:
                s[rows] += rate * g[rows].sum() / (h[rows].sum() + ridge)
            else:
                grow(pick[0], level + 1)
                grow(pick[1], level + 1)

        grow(np.arange(len(y)), 0)
    return s


def test_ranker_equals_plain_trees(spark):
    rng = np.random.default_rng(6)
    group = np.repeat(np.arange(50), 6)
    x = np.round(rng.standard_normal((300, 3)), 1)
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.standard_normal(300) > 0.8).astype(int)
    y[group == 7] = 0
    rows = [(str(k), i, int(t), *map(float, v)) for i, (k, t, v) in enumerate(zip(group, y, x, strict=True))]
    frame = spark.createDataFrame(rows, "group_id string, place long, target int, a double, b double, c double")
    model = ranker.fit_ranker(frame, ["a", "b", "c"], rounds=4, depth=2, rate=0.3, bins=8)
    cuts = ranker.bin_cuts(frame, ["a", "b", "c"], 8)
    fine = np.isin(group, [k for k in range(50) if 0 < y[group == k].sum() < 6])
    want = plain_ranking_trees(x[fine], y[fine], group[fine], 4, 2, 0.3, 1.0, cuts)
    got = {r.place: r.s for r in frame.select("place", model.score().alias("s")).collect()}
    assert len(model.trees) == 4 and np.allclose([got[i] for i in np.flatnonzero(fine)], want, atol=1e-9)
    assert ranker.fit_ranker(frame.where("target = 0"), ["a"], rounds=2).trees == []
    odd = frame.withColumn("a", F.when(F.col("place") % 5 > 0, F.col("a")))
    assert ranker.fit_ranker(odd, ["a", "b"], rounds=1, depth=1).score() is not None


def test_tokens_called_like_columns_leave_them(spark):
    stays = spark.createDataFrame([(1, "x", "y"), (2, "x", "y")], "stay_id long, lab string, cells string")
    events = spark.createDataFrame([(1, 1, "lab", 2.0, 3.0), (1, 2, "a.b", 1.0, 4.0)], "stay_id long, event_id long, token string, value double, hours double")
    out = features.wide_features(stays, features.token_statistics(events), ["lab", "a.b"], "f", ("count", "mean"))
    assert out.columns[:3] == stays.columns and {r.stay_id: (r.lab, r.cells, r.f_lab_count, r.f_lab_mean) for r in out.collect()} == {1: ("x", "y", 1, 2.0), 2: ("x", "y", 0, None)}
    held = features.presence(stays, events, "token", ["lab", "cells"], "p")
    assert {r.stay_id: (r.lab, r.cells, r.p_lab_present, r.p_cells_present) for r in held.collect()} == {1: ("x", "y", 1, 0), 2: ("x", "y", 0, 0)}


@pytest.mark.parametrize("kind", ["few", "one", "many", "odd"])
def test_row_metrics_over_ranges_equal_brute_force(spark, kind):
    """Equal scores over several ranges, slices of one class, ranges of several slices."""
    rng = random.Random(9)
    rows = []
    for name, n in (("a", 400), ("b", 3), ("c", 150), ("d", 1)):
        for k in range(n):
            score = {"few": rng.choice((0.1, 0.5, 0.5001, 0.9)), "one": 0.5, "many": rng.random(), "odd": rng.choice((-3.0, 0.0, 1.0, 7.5, rng.random()))}[kind]
            rows.append((name, "dev", "train", k, f"g{k % 40}", "cond", f"m{rng.randrange(6)}", rng.choice((None, 1, 2, 3)), name == "a" and rng.random() < 0.3 or name == "c" and k % 2 == 0, score))
    df = spark.createDataFrame(rows, "baseline string, source string, split string, stay_id long, group_id string, condition string, candidate string, candidate_rank int, label boolean, score double")
    got = {r.baseline: r for r in metrics.row_metrics(df.repartition(7)).collect()}
    for name in "abcd":
        own = [r for r in rows if r[0] == name]
        y, s = [int(r[8]) for r in own], [r[9] for r in own]
        assert (got[name].row_count, got[name].positives) == (len(own), sum(y))
        if 0 < sum(y) < len(own):
            wins = sum((a > b) + (a == b) / 2 for a, i in zip(s, y, strict=True) if i for b, j in zip(s, y, strict=True) if not j)
            assert math.isclose(got[name].roc_auc, wins / sum(y) / (len(own) - sum(y)), abs_tol=2e-6)
            assert math.isclose(got[name].brier, sum((a - b) ** 2 for a, b in zip(s, y, strict=True)) / len(own), abs_tol=2e-6)
            bin_of = [min(9, int(10 * max(0, min(1, a)))) for a in s]
            gap = sum(abs(sum(y[i] - s[i] for i in range(len(own)) if bin_of[i] == b)) for b in range(10))
            assert math.isclose(got[name].calibration_error, gap / len(own), abs_tol=2e-6)
            if kind == "many":  # without ties the order is the score's alone
                order = sorted(range(len(own)), key=lambda i: -s[i])
                ap = sum(sum(y[j] for j in order[: k + 1]) / (k + 1) for k, i in enumerate(order) if y[i]) / sum(y)
                assert math.isclose(got[name].average_precision, ap, abs_tol=2e-6)
        else:
            assert got[name].roc_auc is None and got[name].average_precision is None


def test_row_metrics_read_scores_by_one_shuffle(spark):
    df = spark.range(10).selectExpr("'a' baseline", "'d' source", "'t' split", "'g' group_id", "'c' candidate", "1 candidate_rank", "id % 2 = 0 label", "id / 10 score")
    plan = metrics._placed(df, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange") == 1


def test_fusion_grid_equals_ranking_metrics_of_each_weight(spark):
    rng = random.Random(11)
    rows = []
    for g in range(60):
        for c in range(rng.randrange(1, 9)):
            rows.append(("dev", "test" if g % 3 else "train", f"g{g}", "cond", f"m{c}" if c else None, g, rng.choice((None, 1, 2)), rng.random() < 0.3 and g % 5 > 0, rng.choice((0.0, 0.2, rng.random())), rng.choice((0.1, rng.random()))))
    rows.append(("ext", "external", "gx", "cond", "m1", 1, 1, False, 0.1, 0.2))
    df = spark.createDataFrame(rows, "source string, split string, group_id string, condition string, candidate string, stay_id int, candidate_rank int, label boolean, reference_score double, other_score double")
    weights = [0.0, 0.3, 1.0]
    got = {(r.source, r.split, r.weight): (r.groups, r.precision, r.recall, r.hit, r.ndcg, r.mrr) for r in fusion.fusion_grid(df, 3, weights).collect()}
    want = {}
    for w in weights:
        own = df.selectExpr("*", f"(1.0D - {w}D) * reference_score + {w}D * other_score as score", "'w' as baseline")
        for r in metrics.ranking_metrics(own, 3).collect():
            want[r.source, r.split, w] = (r.groups, r.precision, r.recall, r.hit, r.ndcg, r.mrr)
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert all(a == b or math.isclose(a, b, abs_tol=1.5e-6) for a, b in zip(got[key], values, strict=True)), key
    chosen = fusion.marked_weight(fusion.fusion_grid(df, 3, weights)).where("chosen").collect()
    assert {(r.source, r.split) for r in chosen} == {("dev", "test"), ("dev", "train")}


def test_groups_in_rows_say_what_stacked_rows_say(spark):
    """No key with few values deals rows out, and metrics of groups that stand in one row move sums alone."""
    import random

    from quillon.operators import fusion

    rng = random.Random(3)
    stays = spark.createDataFrame([(k, k % 7, "dev" if k % 4 else "external", ("train", "validation")[k % 2], "ab"[k % 3 > 0]) for k in range(60)] + [(1, 1, "dev", "validation", "b")], "stay_id long, patient_id long, source string, split string, condition string")
    labels = spark.createDataFrame([(k, f"c{x}", 1 + x) for k in range(60) for x in sorted({rng.randrange(6) for _ in range(k % 4)})], "stay_id long, candidate string, events long")
    held = training.stay_labels(stays, labels).cache()
    catalog = training.candidate_catalog(stays, labels, 4).select("condition", "candidate", "stays", "events", "candidate_rank")
    own = training.held_catalog(held, 4).cache()
    assert sorted(map(tuple, own.drop("pair_rows").select(*catalog.columns).collect())) == sorted(map(tuple, catalog.collect()))
    groups = metrics.drawn_scores(training.ranking_groups(held, metrics.popularity(own), metrics.POPULARITY), 5).cache()
    rows = stays.join(catalog, "condition").select(*stays.columns, "candidate", "candidate_rank").join(labels, ["stay_id", "candidate"], "left").withColumns({"group_id": F.concat("stay_id", F.lit("|"), "condition"), "label": F.col("events").isNotNull()})
    want = metrics.baseline_scores(rows, 5).cache()
    same = lambda a, b: sorted(map(str, map(tuple, a.select(*b.columns).collect()))) == sorted(map(str, map(tuple, b.collect())))
    assert same(metrics.stacked_scores(groups), want)
    want, groups = want.where("stay_id <> 1"), groups.where("stay_id <> 1")
    assert same(metrics.grouped_metrics(groups, 2), metrics.ranking_metrics(want, 2))
    assert same(metrics.grouped_condition_metrics(groups, 2, 5), metrics.condition_metrics(want, 2, 5))
    assert same(fusion.group_places(groups, metrics.BASELINES), fusion.rank_normalised(want, "score", ("baseline", "group_id")).select("baseline", "group_id", "candidate", "score"))
    assert metrics.grouped_metrics(groups.where(F.lit(False)), 2).count() == 0


@pytest.mark.parametrize("ranges", [1, 7])
def test_row_metrics_of_groups_say_what_those_of_rows_say(spark, monkeypatch, ranges):
    """Scores that the catalog gives are counted in sorted groups, and only drawn scores are sorted as rows; runs of equal
    scores go over conditions, hash classes and batches, and slices lack one class."""
    monkeypatch.setattr(metrics, "RANGES", ranges)
    monkeypatch.setattr(metrics, "TIE_CLASSES", 5)
    rng = random.Random(8)
    catalog = [(f"cond{c}", f"m{rng.randrange(4)}{k}", k + 1, rng.choice((0.1, 0.25)), rng.choice((0.0, 0.25, 1.0))) for c in range(3) for k in range(c + 2)]
    of = {c: [r for r in catalog if r[0] == c] for c in {r[0] for r in catalog}}
    groups = []
    for g in range(300):
        c, split = f"cond{rng.randrange(3)}", rng.choice(("train", "train", "test", "none", "all"))
        label = {"none": 0.0, "all": 1.0}.get(split, 0.3)
        groups.append(("dev" if g % 4 else "ext", split, g, c, f"{g}|{c}", [(r[1], r[2], rng.random() < label) for r in of[c]]))
    catalog = spark.createDataFrame(catalog, f"condition string, candidate string, candidate_rank long, {metrics.POPULARITY[0]} double, {metrics.POPULARITY[1]} double")
    groups = spark.createDataFrame(groups, "source string, split string, stay_id long, condition string, group_id string, members array<struct<candidate: string, candidate_rank: long, label: boolean>>").repartition(3)
    rows = groups.select("source", "split", "stay_id", "group_id", "condition", F.inline("members")).join(catalog, ["condition", "candidate", "candidate_rank"])
    rows = rows.withColumn("random", metrics._drawn(3, F.col("candidate")))
    stacked = rows.select(*metrics.SCORED, F.inline(F.array(*[F.struct(F.lit(n).alias("baseline"), F.col(n).alias("score")) for n in metrics.BASELINES])))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        got = sorted(map(tuple, metrics.grouped_row_metrics(groups, catalog, seed=3).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 24 and got == sorted(map(tuple, metrics.row_metrics(stacked).collect()))
    assert metrics.grouped_row_metrics(groups.where("false"), catalog).count() == 0
