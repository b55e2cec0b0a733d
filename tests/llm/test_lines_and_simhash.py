from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import components, lines, simhash

WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def kept_lines(rows, min_docs=3, min_chars=20):
    held = defaultdict(set)
    for k, t in rows:
        for x in (t or "").split("\n"):
            if k is not None and len(key(x)) >= min_chars:
                held[key(x)].add(k)
    out = []
    for k, t in rows:
        own = (t or "").split("\n")
        gone = [k is not None and len(held[key(x)]) >= min_docs and max(held[key(x)]) != k for x in own]
        out.append((k, len(own), sum(gone), "\n".join(x for x, g in zip(own, gone, strict=True) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("which", ["odd_docs", "small_docs", "no_docs"])
def test_line_dedup_equals_brute_force(request, which):
    docs = request.getfixturevalue(which)
    out = lines.dedup_lines(docs, batches=5, fanout=2).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted((tuple(r) for r in out), key=repr) == kept_lines([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("batches", [1, 2, 9])
def test_line_dedup_does_not_depend_on_its_batches(odd_docs, batches):
    out = lines.dedup_lines(odd_docs, batches=batches, fanout=3).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted((tuple(r) for r in out), key=repr) == kept_lines([(r.doc_id, r.text) for r in odd_docs.collect()])


def test_line_dedup_keeps_other_columns_and_replaces_its_own(odd_docs):
    docs = odd_docs.withColumns({"n_lines": F.lit("x"), "key": F.lit(1), "batch": F.lit(2), "last_doc": F.lit(None)})
    out = lines.dedup_lines(docs)
    assert set(out.columns) == {*docs.columns, "n_dropped"}
    assert out.count() == docs.count() and dict(out.dtypes)["n_lines"] == "bigint"


def test_line_runs_compact_by_levels(spark):
    store = lines.LineRuns(spark, buckets=4, fanout=2)
    for k in range(5):
        store.add(spark.createDataFrame([(k, b"all"), (k, b"own%d" % k), (k, b"all")], "doc_id long, key binary"))
    assert [len(level) for level in store.levels] == [1, 0, 1]
    merged = {bytes(r.key): (r.n_docs, r.last_doc) for r in store.merged().collect()}
    assert merged[b"all"] == (5, 4) and merged[b"own2"] == (1, 2) and len(merged) == 6
    new = store.unseen(spark.createDataFrame([(9, b"all"), (9, b"new")], "doc_id long, key binary")).collect()
    assert [bytes(r.key) for r in new] == [b"new"]


def test_dedup_batch_by_batch(spark):
    store = lines.LineRuns(spark, buckets=4)
    text = "a line of over twenty characters"
    first = lines.dedup_batch(store, spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"))
    again = lines.dedup_batch(store, spark.createDataFrame([(3, text + "\nanother line of over twenty characters")], "doc_id long, text string"))
    assert first.count() == 2 and again.count() == 1


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    own = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reachable(ids, near):
    label = np.array(ids, float)
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("which", ["odd_docs", "small_docs", "no_docs"])
def test_simhash_equals_brute_force(request, which):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = sorted((tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "fp", "component_id").collect()), key=repr)
    fp = np.array([plain_fingerprint(t) for _, t in rows], np.uint64)
    near = [np.flatnonzero(np.bitwise_count(fp ^ f) <= 3) for f in fp]
    label = reachable([np.inf if k is None else k for k, _ in rows], near) if rows else []
    want = [(k, int(f.view(np.int64)), None if c == np.inf else int(c)) for (k, _), f, c in zip(rows, fp, label, strict=True)]
    assert out == sorted(want, key=repr)


def test_spark_and_the_operator_hash_alike(spark):
    row = spark.sql("SELECT xxhash64('the cat sat') AS h").first()
    assert row.h == np.array([simhash.fingerprint(b"The cat\nsat")], np.uint64).view(np.int64)[0]


@pytest.mark.parametrize(("bits", "budget"), [(16, 2), (28, 3), (64, 3), (64, 5)])
def test_trie_join_equals_all_pairs(bits, budget):
    rng = np.random.default_rng(bits + budget)
    base = rng.integers(0, 1 << min(bits, 62), 40).astype(np.uint64)
    x = np.unique(base[rng.integers(0, 40, 900)] ^ (np.uint64(1) << rng.integers(0, bits, 900).astype(np.uint64)))
    a, b = x[::2], x[1::2]
    for p, q in ((x, x), (a, b)):
        got = [set(zip(i.tolist(), j.tolist(), strict=True)) for i, j in simhash.trie_join(p, q, bits, budget, 0)]
        got = set().union(*got)
        i, j = np.nonzero(np.bitwise_count(p[:, None] ^ q[None, :]) <= budget)
        assert got == {(s, t) for s, t in zip(i.tolist(), j.tolist(), strict=True) if p is not q or s < t}


def test_nodes_in_parts_lose_no_link(spark):
    rng = np.random.default_rng(3)
    x = np.unique(rng.integers(0, 300, 250) << 40)
    codes = spark.createDataFrame([(int(v), int(v)) for v in x], "key long, code long")
    links = simhash.near_links(codes, 3, most=20)
    got = {r.node: r.root for r in components.connected_components(links).collect()}
    near = [np.flatnonzero(np.bitwise_count(x.astype(np.uint64) ^ np.uint64(v)) <= 3) for v in x]
    label = reachable(x, near)
    assert {int(v): int(c) for v, c, n in zip(x, label, near, strict=True) if len(n) > 1} == got


def test_components_of_a_path_a_star_and_odd_edges(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(1000, 1300)] + [(5, 5), (None, 3), (2, None), (1000, 7), (1000, 7)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 7 for k in (7, *range(1000, 1300))}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_groups_find_what_is_similar(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{k}" for k in range(5000)]
    rows, pairs = [], []
    for k in range(60):
        words = list(rng.choice(vocabulary, 300))
        other = words.copy()
        for at in rng.choice(300, 4, replace=False):
            other[at] = "changed"
        a, b = ({tuple(w[i : i + 5]) for i in range(296)} for w in (words, other))
        pairs.append(len(a & b) / len(a | b))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    assert min(pairs) > 0.8
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * k] == 2 * k for k in range(60))
    assert sum(got[2 * k + 1] == 2 * k for k in range(60)) >= 57


def test_similar_groups_of_odd_rows(odd_docs, no_docs):
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(odd_docs).collect()}
    assert got[24] == 0 and got[29] == 23 and got[21] == got[22] == got[20] == 20 and got[26] == 26 and None not in got
    assert simhash.similar_groups(no_docs).count() == 0


def test_digest_of_kept_lines(small_docs, spark, sf_dir):
    from quillon.llm import queries

    rows = {r.doc_id: r.kept_sha256 for r in queries.op7_line_dedup(spark, sf_dir).collect()}
    want = {k: hashlib.sha256(t.encode()).hexdigest() for k, _, _, t in kept_lines([(r.doc_id, r.text) for r in small_docs.collect()])}
    assert rows == want


def near_pair(shared, own, tag):
    """Two texts of `shared` common and `own` own five-word shingles each: blocks of words apart from each other."""
    block = [f"{tag}{k}" for k in range(shared + 4)]
    return [" ".join([*block, *(f"{tag}{side}{k}" for k in range(own))]) for side in "ab"]


def plain_groups(rows):
    import re

    def shingles(text):
        w = re.findall(r"[a-z0-9]+", text.lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(t) for _, t in rows]
    near = [np.array([k for k, b in enumerate(sets) if len(a & b) >= 0.8 * len(a | b)]) for a in sets]
    return {k: int(c) for (k, _), c in zip(rows, reachable([k for k, _ in rows], near), strict=True)}


def test_similar_groups_go_by_the_exact_similarity(spark):
    texts = []
    # Similarity shared / (shared + 2 own): 0.7, 0.75, just under 0.8, 0.8 and 0.9.
    for shared, own in ((70, 15), (30, 5), (159, 20), (160, 20), (90, 5)):
        for k in range(12):
            texts += near_pair(shared, own, f"s{shared}x{k}y")
    passage = " ".join(f"passage{k}" for k in range(20))
    for k in range(8):  # one passage ten times over beside 150 own words
        texts += [" ".join([*[passage] * 10, *(f"p{k}{side}{i}" for i in range(150))]) for side in "ab"]
    for k in range(8):  # one shingle forty times over
        texts += [" ".join([*["again and again and again"] * 40, *(f"q{k}{side}{i}" for i in range(60))]) for side in "ab"]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_groups(rows)
    assert all(got[k] == k for k in want if want[k] == k)
    assert sum(got[k] != c for k, c in want.items()) <= 1


@pytest.mark.parametrize("part_rows", [3, 10, 1000])
def test_verified_links_of_large_groups_equal_all_pairs(spark, part_rows):
    rng = np.random.default_rng(part_rows)
    base, rows = [f"w{k}" for k in range(60)], []
    for k in range(60):  # a chain that drifts, some far away
        words = base.copy()
        words[: k % 30] = [f"d{i}" for i in range(k % 30)]
        if k % 3 == 0:
            words[40:50] = [f"r{k // 6}x{i}" for i in range(10)]
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [simhash.shingle_set(t.encode(), 5) for _, t in rows]
    keys = {simhash.set_key(s): k for k, s in reversed(list(enumerate(sets)))}
    members = spark.createDataFrame([(key, k, len(sets[k]), 7) for key, k in keys.items()], "key long, least long, size long, root long")
    links = simhash.verified_links(docs, members, 5, 0.8, part_rows=part_rows).collect()
    want = plain_groups(rows)
    label = {k: k for k in keys.values()}
    for r in links:
        a, b = label[keys[r.a]], label[keys[r.b]]
        label = {k: min(a, b) if c in (a, b) else c for k, c in label.items()}
    assert label == {k: want[k] for k in label} and len(set(label.values())) > 1


@pytest.mark.parametrize(("bits", "budget"), [(28, 3), (64, 3), (32, 3), (64, 5)])
def test_some_rotation_meets_every_pair_within_the_budget(bits, budget):
    rng = np.random.default_rng(bits * budget)
    mask, turns = np.uint64((1 << bits) - 1), budget + 1
    top = bits // turns
    for k in range(300):
        a = np.uint64(rng.integers(0, 1 << min(bits, 62)))
        b = a
        for bit in rng.choice(bits, 1 + k % (budget + 1), replace=False):
            b ^= np.uint64(1 << int(bit))
        met = False
        for t in range(turns):
            by = np.uint64(t * bits // turns)
            pair = np.array([a, b], np.uint64)
            pair = np.sort(((pair << by) | (pair >> (np.uint64(bits) - by))) & mask if by else pair)
            if pair[0] >> np.uint64(bits - top) == pair[1] >> np.uint64(bits - top):
                met |= bool(list(simhash.trie_join(pair, pair, bits, budget, top, np.zeros(2, int), True)))
        assert met == (1 + k % (budget + 1) <= budget)


def test_wide_codes_in_parts_equal_all_pairs(spark):
    rng = np.random.default_rng(9)
    centres = rng.integers(0, 1 << 62, (5, 4)).astype(np.uint64)
    wide = [centres[k % 5] ^ np.packbits(rng.random((4, 64)) < rng.choice([0, 0.02, 0.3]), axis=1).view(np.uint64).ravel() for k in range(160)]
    rows = [(k, (k % 5) << 40 | (k % 2) << int(rng.integers(0, 48)), w.tobytes()) for k, w in enumerate(wide)]
    codes = spark.createDataFrame(rows, "key long, code long, wide binary")
    near = [np.array([j for j in range(160) if bin(rows[i][1] ^ rows[j][1]).count("1") <= 3 and np.bitwise_count(wide[i] ^ wide[j]).sum() <= 40]) for i in range(160)]
    label = reachable(range(160), near)
    for most in (8, 1 << 17):
        got = {r.node: r.root for r in components.connected_components(simhash.near_links(codes, 3, 48, 40, most=most)).collect()}
        assert got == {k: int(c) for k, (c, n) in enumerate(zip(label, near, strict=True)) if len(n) > 1}


def test_line_dedup_of_clashing_names_leaves_nothing_behind(spark, odd_docs):
    before = {t.name for t in spark.catalog.listTables()}
    conf = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = odd_docs.withColumns({c: F.lit(1) for c in ("id", "drops", "__id", "__drops", "ID_1")})
    out = lines.dedup_lines(docs)
    assert out.count() == docs.count() and set(docs.columns) <= set(out.columns)
    assert {t.name for t in spark.catalog.listTables()} == before and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == conf


def test_scratch_is_deleted(spark, no_docs):
    import os

    from quillon.llm import common

    simhash.near_duplicates(no_docs).count()
    folder = common.shared_folder(spark).removeprefix("file:")
    assert os.listdir(folder)
    held = sorted(os.listdir(folder))
    frame = common.stash(spark.range(5), "five")
    assert len(os.listdir(folder)) == len(held) + 1
    common.drop_stash(frame)
    assert sorted(os.listdir(folder)) == held
