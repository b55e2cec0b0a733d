from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import mixing, rabitq

VECTORS = "vec_id long, embedding array<float>, label int, key string, dim int"


def brute(rows, threshold=0.98):
    def fine(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    near = [[] for _ in range(n)]
    for i in range(n):
        for j in range(n):
            (_, v, p), (_, w, q) = rows[i][:3], rows[j][:3]
            if i != j and p == q and fine(v, p) and fine(w, q) and len(v) == len(w):
                x, y = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    near[i].append(j)
    label = [math.inf if r[0] is None else r[0] for r in rows]
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in near[i])]) for i in range(n)]
    return [(r[0], len(near[i]), None if label[i] == math.inf else label[i], r[0] is not None and r[0] == label[i]) for i, r in enumerate(rows)]


def clusters(n, seed, dim=32):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    out = []
    for k in range(n):
        v = centres[k % 12] + rng.standard_normal(dim) * rng.choice([0.02, 0.1, 0.15, 1.0])
        out.append((k, v.astype(np.float32).tolist(), k % 3, "x", 1))
    return out


def test_vectors_equal_brute_force(spark, monkeypatch):
    rows = clusters(150, 1)
    nan = float("nan")
    rows += [(200, None, 1, "", 1), (201, [0.0] * 32, 1, "", 1), (202, [nan] * 32, 1, "", 1), (203, rows[0][1], None, "", 1), (204, rows[0][1], 0, "", 1), (204, rows[0][1], 0, "", 1), (None, rows[0][1], 0, "", 1), (205, [], 0, "", 1), (206, [None, 1.0], 0, "", 1), (207, [1.0, 2.0], 0, "", 1), (208, [2.0, 4.0], 0, "", 1), (None, [5.0] * 7, 2, "", 1), (209, [float("inf"), 1.0], 0, "", 1)]
    out = rabitq.near_vectors(spark.createDataFrame(rows, VECTORS))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(brute(rows), key=repr)
    assert rabitq.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_vectors_go_by_rows_not_by_ids(spark):
    """One id with several vectors, in one label and in two; nulls; lengths near the ends of double precision."""
    e = lambda k, d=0.01: [1.0 if i == k else d for i in range(8)]
    rows = [(5, e(0), 1, "", 1), (5, e(1), 1, "", 1), (7, e(0, 0.011), 1, "", 1), (8, e(1, 0.011), 1, "", 1), (5, e(2), 2, "", 1), (9, e(2, 0.012), 2, "", 1), (None, e(3), 2, "", 1), (None, e(3, 0.013), 2, "", 1), (6, e(0), 2, "", 1)]
    rows += [(20 + k, [x * scale for x in e(4, 0.01 + k / 1000)], 3, "", 1) for k, scale in enumerate((1e200, 1e-200, 1e-3))]
    schema = VECTORS.replace("array<float>", "array<double>")
    got = sorted((tuple(r) for r in rabitq.near_vectors(spark.createDataFrame(rows, schema)).collect()), key=repr)
    links = {0: [2], 1: [3], 2: [0], 3: [1], 4: [5], 5: [4], 6: [7], 7: [6], 8: [], 9: [10, 11], 10: [9, 11], 11: [9, 10]}
    label = {k: min([x for x in (r[0], *(rows[j][0] for j in links[k])) if x is not None], default=None) for k, r in enumerate(rows)}
    assert got == sorted(((r[0], len(links[k]), label[k], r[0] is not None and r[0] == label[k]) for k, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("dim", [1, 7, 64, 100])
def test_bounds_lose_no_pair(dim):
    rng = np.random.default_rng(dim)
    v = rng.standard_normal((400, dim))
    w = v + rng.standard_normal((400, dim)) * rng.choice([0.01, 0.1, 0.19], (400, 1)) * np.abs(v).mean()

    def coded(x):
        own, factor, turned = rabitq.encode(x)
        planes, low, step, error = rabitq.rounded(turned)
        return rabitq.Codes(rabitq.words_of(own > 0), planes, factor, low, step, error)

    a, b = coded(v), coded(w)
    cosine = rabitq.unit_rows(v) @ rabitq.unit_rows(w).T >= 0.98
    hit_a, hit_b = rabitq.possible(a, b, dim, 0.98, False)
    assert (hit_a >= cosine.any(axis=1)).all() and (hit_b >= cosine.any(axis=0)).all()


def test_no_miss_compares_all(spark, monkeypatch):
    monkeypatch.setattr(rabitq, "CHUNK", 16)
    rows = clusters(300, 5)
    out = rabitq.near_vectors(spark.createDataFrame(rows, VECTORS), miss=0.0)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(brute(rows), key=repr)


def test_bands_and_chunks_reach_the_recall(spark, monkeypatch):
    monkeypatch.setattr(rabitq, "CHUNK", 16)
    rows = clusters(900, 2)
    want = {r[0]: r for r in brute(rows)}
    assert rabitq.bands(300, 0.98, 1e-4)[0] > 3
    got = {r.vec_id: tuple(r) for r in rabitq.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()}
    true, found = sum(r[1] for r in want.values()), sum(r[1] for r in got.values())
    assert found <= true and found >= 0.99 * true
    assert all(got[k][1] <= want[k][1] for k in want)


def test_estimates_are_unbiased():
    rng = np.random.default_rng(0)
    v = rng.standard_normal((400, 64))
    code, factor, turned = rabitq.encode(v)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    error = (code @ turned.T / factor[:, None] - unit @ unit.T)[~np.eye(400, dtype=bool)]
    assert abs(error.mean()) < 0.002 and 0.05 < error.std() < 0.15


def sizes_of(docs):
    import re

    return [(r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.source) for r in docs.select("doc_id", "text", "source").collect()]


def shared(sizes, share, weights, most):
    left, target, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        total = sum(weights[k] for k in open_)
        over = {k for k in open_ if left * weights[k] / total > most * sizes[k]}
        if not over:
            for k in open_:
                target[k] = left * weights[k] / total
            break
        for k in over:
            target[k] = most * sizes[k]
        left -= sum(target[k] for k in over)
        open_ -= over
    return target


@pytest.mark.parametrize("which", ["odd_docs", "small_docs"])
def test_mix_meets_its_targets(request, which):
    docs = request.getfixturevalue(which)
    rows = sizes_of(docs)
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = [sum(n for _, n, s in rows if s == x) for x in sources]
    want = dict(zip(sources, shared(size, 1.5, [(5, 2, 1)[k % 3] for k in range(len(sources))], 2.0), strict=True))
    out, blocks = mixing.mix(docs, block=32)
    out = out.collect()
    assert sorted((r.doc_id, r.size, r.source) for r in out if r.doc_id is not None and r.source is not None) == sorted(r for r in rows if r[0] is not None and r[2] is not None)
    for s in sources:
        taken = sum(r.taken for r in out if r.source == s)
        assert taken == math.floor(want[s] + 1e-6) or abs(taken - want[s]) < 1
        assert all(abs(r.target - want[s]) < 1e-6 * (1 + want[s]) for r in out if r.source == s)
    assert all(0 <= r.taken <= 2 * r.size for r in out)
    assert sorted(tuple(r)[0:8] for r in mixing.mix(docs, block=32)[0].where("doc_id is not null and source is not null").drop("row").collect()) == sorted(tuple(x for k, x in enumerate(r) if k != 1) for r in out if r.doc_id is not None and r.source is not None)
    slots = sorted(r.slot for r in blocks.select("slot").distinct().collect())
    assert slots == list(range(len(slots)))
    lengths = [r.n for r in blocks.groupBy("slot", "source").agg(F.sum(F.col("high") - F.col("low")).alias("n")).collect()]
    assert max(lengths) <= 64


def test_schedule_is_low_discrepancy(spark):
    targets = spark.createDataFrame([("a", 600.0), ("b", 300.0), ("c", 100.0), (None, 24.0)], "source string, target double").withColumns({"source_size": F.lit(1), "docs": F.lit(1)})
    rows = mixing.schedule(targets, 1).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(1024))
    for upto in (64, 256, 1000):
        for source, share in (("a", 600), ("b", 300), ("c", 100), (None, 24)):
            assert abs(sum(r.source == source for r in rows[:upto]) - share * upto / 1024) <= 5
    for source in ("a", "b", "c", None):
        assert [r["rank"] for r in rows if r.source == source] == list(range(sum(r.source == source for r in rows)))


def test_mixed_documents_are_what_is_taken(odd_docs, no_docs):
    out = mixing.mixed_documents(odd_docs, block=32)
    assert out.columns == odd_docs.columns
    taken = sum(n for _, n, _ in sizes_of(out))
    assert taken == mixing.mix(odd_docs, block=32)[0].agg(F.sum("taken")).first()[0]
    assert mixing.mixed_documents(no_docs).count() == 0 and mixing.mix(no_docs)[0].count() == 0


def test_labels_of_any_type(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(4, 8))
    rows = [(k, "ab"[k % 2] if k < 10 else None, (base[k % 2 + 2 * (k % 3 == 0)] + rng.normal(scale=1e-3, size=8)).tolist()) for k in range(14)]
    by_text = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    by_number = by_text.withColumn("label", F.when(F.col("label") == "a", 1).when(F.col("label") == "b", 2))
    as_double = by_number.withColumn("label", F.col("label").cast("double"))
    want = sorted(tuple(r) for r in rabitq.near_vectors(by_number).collect())
    assert any(r[1] for r in want)
    for df in (by_text, as_double):
        assert sorted(tuple(r) for r in rabitq.near_vectors(df).collect()) == want
