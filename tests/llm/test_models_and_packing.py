from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillon.llm import licenses, packing, quality, queries, tokens, urls


def pieces_are_whole(rows, docs, tokenizer, limit=1024):
    """rows: of op5's pieces. Every id in one piece, sequences gapless, padding only short of a power of two."""
    want = sorted((repr(k), [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for k, t in docs)
    assert sum(r.length for r in rows) == sum(len(i) for _, i in want)
    by = {}
    for r in rows:
        by.setdefault(repr(r.doc_id), []).append(r)
    for key, ids in want:
        own = sorted(by[key], key=lambda r: r.start)
        at = 0
        for r in own:
            if len(own) > 1 and sum(k == key for k, _ in want) > 1:
                continue
            assert r.start == at and r.doc_tokens == len(ids) and zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= limit and at & (at - 1) == 0


@pytest.mark.parametrize("which", ["odd_docs", "small_docs", "no_docs"])
def test_packing_is_exact(request, which):
    docs = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    pieces_are_whole(packing.pack_documents(docs, packing.public_bpe).collect(), [(r.doc_id, r.text) for r in docs.collect()], tokenizer)


@given(st.text(max_size=200))
@settings(max_examples=200, deadline=None)
def test_ranks_give_the_tokenizer_s_ids(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    assert packing.public_bpe()(text) == tokenizer.encode(text, add_special_tokens=False).ids


@given(st.lists(st.tuples(st.integers(0, 100), st.integers(1, 4), st.integers(0, 80)), max_size=60))
@settings(max_examples=80, deadline=None)
def test_bins_keep_all_limits(examples):
    limits = packing.Limits(tokens=100, segments=6, loss=80)
    bins = packing.pack_group(np.array(examples, np.int64).reshape(-1, 3), limits, False)
    assert sorted(x for b in bins for x, _ in b) == list(range(len(examples)))
    for b in bins:
        assert (np.array([examples[x] for x, _ in b]).sum(axis=0) <= (100, 6, 80)).all()


def test_examples_are_packed_whole_and_refused_beyond(spark):
    rows = [(k, 10 + k % 90, 1 + k % 3, k % 70) for k in range(500)] + [(1000, None, None, None)]
    frame = spark.createDataFrame(rows, "example_id long, tokens long, segments long, loss long")
    limits = packing.Limits(100, 8, 80, group=64)
    out = packing.pack_examples(frame, limits)
    assert out.count() == 501
    sums = frame.join(out, "example_id").groupBy("sequence_id").agg(*[F.sum(c).alias(c) for c in ("tokens", "segments", "loss")])
    assert sums.where("tokens > 100 or segments > 8 or loss > 80").count() == 0
    lower = max(sum(r[1] or 0 for r in rows) / 100, sum(r[3] or 0 for r in rows) / 80)
    assert sums.count() <= 1.35 * lower
    with pytest.raises(Exception, match="exceeds the limits"):
        packing.pack_examples(spark.createDataFrame([(1, 101, 1, 1)], frame.schema), limits).collect()


def test_conversations_are_packed_under_three_limits(spark):
    folder = "/root/testdata/sf0.01"
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
        a, b, c = want.get(r.conv_id, (0, 0, 0))
        want[r.conv_id] = (a + n, b + 1, c + n * (r.role == "assistant"))
    rows = queries.QUERIES["packed_conversations"](spark, folder).collect()
    assert {r.conv_id: (r.tokens, r.segments, r.loss) for r in rows} == want and len(rows) == len(want)
    limits, sums = queries.CONVERSATIONS, {}
    for r in rows:
        sums.setdefault(r.sequence_id, []).append((r.tokens, r.segments, r.loss))
    totals = [np.array(s).sum(axis=0) for s in sums.values()]
    assert all((t <= (limits.tokens, limits.segments, limits.loss)).all() or len(s) == 1 for t, s in zip(totals, sums.values(), strict=True))
    lower = max(sum(w[0] for w in want.values()) / limits.tokens, sum(w[2] for w in want.values()) / limits.loss)
    assert len(sums) <= 1.25 * lower + 1


def test_odd_conversations(spark):
    rows = [(1, "assistant", "a b"), (1, None, None), (None, "user", "x"), (2, "assistant", "word " * 3000), (3, "user", ""), (3, "user", "")]
    frame = spark.createDataFrame(rows, "conv_id long, role string, text string")
    examples = packing.instruction_examples(frame.withColumn("tokens", F.lit("x")), packing.json_bpe)
    got = {r.example_id: (r.tokens, r.segments, r.loss) for r in examples.collect()}
    assert got == {1: (4, 2, 3), 2: (got[2][0], 1, got[2][0]), 3: (2, 2, 0)} and got[2][0] > 3000
    placed = {r.example_id: r.sequence_id for r in packing.pack_examples(examples, packing.Limits(1024, 8, 1024), alone=True).collect()}
    assert len(placed) == 3 and placed[2] not in (placed[1], placed[3])
    assert packing.pack_examples(examples.limit(0)).count() == 0 and packing.instruction_examples(frame.limit(0), packing.json_bpe).count() == 0


def test_token_hashes_by_window(monkeypatch):
    text = ("The QUICK brown-fox é2 " * 500).encode()
    whole = tokens.token_hashes(text, True)
    monkeypatch.setattr(tokens, "WINDOW", 64)
    assert (tokens.token_hashes(text, True) == whole).all()
    assert len(tokens.token_hashes(b"x" * 500)) == 1 and len(tokens.token_hashes(b"")) == 0
    assert tokens.token_hashes(b"Ab ab AB")[0] == tokens.token_hashes(b"ab")[0]


def test_model_equals_brute_force(small_docs, spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_ratio(small_docs, labels)
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    target, raw = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    rows = [(r.doc_id, (r.text or "").encode()) for r in small_docs.collect()]
    for k, t in rows:
        own = re.findall(rb"[0-9a-z\x80-\xff]+|[!-/:-@\[-`{-~]+", t.lower())
        h = np.array([tokens.token_hashes(x, True)[0] for x in own], np.uint64)
        grams = [h, tokens.chain(h, 2)] if len(h) > 1 else [h]
        for n, g in enumerate(grams):
            mixed = tokens.mix(g) if n == 0 else g
            b = np.bincount((mixed >> np.uint64(33)).astype(int) % quality.BUCKETS, minlength=quality.BUCKETS)
            raw += b
            target += b * (k in good)
    want = np.log((target + quality.SMOOTH) / (raw * target.sum() / raw.sum() + quality.SMOOTH))
    assert np.allclose(model.log_ratio, want)


def test_resampling_keeps_the_largest_keys(odd_docs, no_docs, small_docs, spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.resample(small_docs, labels, keep=50).collect()
    order = sorted(rows, key=lambda r: (-r.key, r.doc_id))
    assert {r.doc_id for r in order[:50]} == {r.doc_id for r in rows if r.kept}
    own = spark.createDataFrame([(0, 1, 0), (24, 1, 0), (20, 0, 0), (None, 1, None), (1, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.resample(odd_docs.withColumn("kept", F.lit("x")).withColumn("key", F.lit(1)), own).collect()
    assert len(out) == odd_docs.count() and all(r.log_ratio is not None for r in out)
    assert quality.kept_documents(odd_docs, own.limit(0)).count() == odd_docs.count()
    assert quality.resample(no_docs, own).count() == 0


def test_inclusion_follows_the_weights_and_seeds_matter(small_docs, spark, sf_dir):
    weights = {3: 4.0, 8: 2.0, 11: 1.0, None: 1.0, 70: 0.5}
    total, counts, n = sum(weights.values()), dict.fromkeys(weights, 0), 6000
    for seed in range(n):
        keys = {k: math.log(w) + quality.gumbel(k, seed) for k, w in weights.items()}
        for k in sorted(keys, key=keys.get)[-2:]:
            counts[k] += 1
    for k, w in weights.items():  # two draws without replacement
        want = w / total + sum(v / total * w / (total - v) for other, v in weights.items() if other != k)
        assert abs(counts[k] / n - want) < 0.02
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = [{r.doc_id for r in quality.resample(small_docs, labels, keep=100, seed=seed).where("kept").collect()} for seed in (1, 2, 1)]
    assert kept[0] == kept[2] != kept[1] and all(len(k) == 100 for k in kept)


def test_top_k_with_ties_and_refinement(spark, monkeypatch):
    monkeypatch.setattr(quality, "RANKED", 5)
    rng = np.random.default_rng(0)
    for keys in (rng.standard_normal(3000), np.repeat([1.0, 2.0, 2.0, 3.0], 200), np.concatenate((rng.standard_normal(500) * 1e-9, [1e9, -1e9])), np.ones(40)):
        frame = spark.createDataFrame([(k, float(x)) for k, x in enumerate(keys)], "doc_id long, key double")
        order = sorted(range(len(keys)), key=lambda k: (-keys[k], k))
        for k in (0, 1, 7, len(keys) // 2, len(keys) - 1, len(keys)):
            assert {r.doc_id for r in quality.top_k(frame, k).where("kept").collect()} == set(order[:k])


def test_classifier_tells_junk_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = quality.resample(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    good, bad = out.where("quality = 1"), out.where("quality = 0")
    assert good.where("kept").count() >= 0.97 * good.count() and bad.where("kept").count() <= 0.15 * bad.count()


def rule_of(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules_equal_brute_force(spark, sf_dir):
    odd = [None, "", "no scheme/x", "http://", "://x.org/", "HTTP://A.Example.ORG/en/1x?q=1#f", "http://org/", "http://borg/", "http://x.com/de", "http://x.com/de/?a&b", "ftp://example.org?x://y.com/de/", "http://éÉ.COM/fr/", "http://a.example.org/es/" + "9" * 5000, "http://x://y.org/", "https://com/fr/#"]
    rows = [(k, u, "x", 1, "y") for k, u in enumerate(odd)] + [(3, None, "x", 1, "y"), (None, "http://a.org/", "x", 1, "y")]
    frame = spark.createDataFrame(rows, "page_id long, url string, host string, length long, verdict string")
    for pages in (frame, spark.read.parquet(f"{sf_dir}/pages.parquet")):
        own = {}
        for r in pages.collect():
            own.setdefault(r.page_id, set()).add(rule_of(r.url))
        out = urls.url_verdicts(pages).collect()
        assert len(out) == pages.count()
        for r in out:
            found = [w for w in own[r.page_id] if w[:3] == (r.host, r.path, r.rule)]
            assert found and r.verdict == (found[0][3] or ("block" if r.score >= 0.5 else "allow"))
    assert urls.url_verdicts(frame.limit(0)).count() == 0


def test_trees_tell_held_out_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    host, path = urls.host_and_path(F.col("url"))
    held = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, fixed = urls.fitting_rule(F.col("host"), F.col("path"))
    held = urls.url_features(held.withColumns({"rule": rule, "fixed": fixed})).where("fixed is not null").withColumn("y", (F.col("fixed") == "block").cast("int"))
    train, test = held.where("page_id % 4 <> 0"), held.where("page_id % 4 = 0")
    suffix, tail = urls.rates(train, "suffix"), urls.rates(train, "tail")
    model = urls.fit_trees(urls.with_rates(train, suffix, tail).toPandas(), (suffix[1], 0.0, tail[1]))
    rows = urls.with_rates(test, suffix, tail).toPandas()
    said = model.probability(rows[list(urls.FEATURES)].to_numpy(float)) >= 0.5
    assert (said == rows["y"].to_numpy(bool)).mean() > 0.9


def test_entropy_and_other_features(spark):
    import math
    from collections import Counter

    url = "https://www.a-b.example.com/x/yy/9?q=1&r=2#top"
    row = urls.url_features(spark.createDataFrame([(url,)], "url string").withColumns(dict(zip(("host", "path"), urls.host_and_path(F.col("url")), strict=True)))).first()
    want = -sum(n / len(url) * math.log2(n / len(url)) for n in Counter(url).values())
    assert row.entropy == pytest.approx(want) and (row.depth, row.parameters, row.labels, row.hyphens, row.fragment, row.suffix) == (3, 2, 4, 1, 1, "example.com")


def plain_alignment(template, text):
    """The whole table, without a band."""
    best, score = 0, np.zeros((len(template) + 1, len(text) + 1), int)
    for i in range(1, len(template) + 1):
        for j in range(1, len(text) + 1):
            score[i, j] = max(0, score[i - 1, j - 1] + (2 if template[i - 1] == text[j - 1] else -1), score[i - 1, j] - 1, score[i, j - 1] - 1)
            best = max(best, score[i, j])
    return best


@given(st.lists(st.integers(0, 5), min_size=1, max_size=14), st.lists(st.integers(0, 5), min_size=1, max_size=20))
@settings(max_examples=150, deadline=None)
def test_banded_alignment_equals_the_whole_table(template, text):
    a, b = np.array(template, np.uint64), np.array(text, np.uint64)
    equal, i, p, j, q = licenses.align(a, b, band=20)
    assert 0 <= i <= p <= len(a) and 0 <= j <= q <= len(b) and (equal > 0) == bool(set(template) & set(text))
    if equal:
        assert plain_alignment(template[i:p], text[j:q]) == plain_alignment(template, text)


def test_winnowing_keeps_one_of_each_window():
    grams = np.random.default_rng(0).integers(0, 50, 300).astype(np.uint64)
    places = licenses.winnow(grams, 4)
    assert all(any(k <= p < k + 4 for p in places) for k in range(297)) and len(licenses.winnow(grams[:2], 4)) == 1


def test_licenses_found_with_their_spans(spark, odd_docs, no_docs):
    mit = licenses.TEMPLATES["mit"]
    changed = mit.replace("free of charge", "at no cost").replace("sublicense, ", "")
    text = f"É intro. {licenses.TEMPLATES['mit-notice']}\n{changed} tail {licenses.TEMPLATES['mit-notice']}"
    far = "word " * 300_000 + licenses.TEMPLATES["gpl-3.0-notice"]
    rows = [(1, text, 0), (2, None, 0), (3, far, 0), (3, far, 0), (4, "Licensed under the", 0)]
    out = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, coverage long")).collect()
    assert sorted((r.doc_id, r.template) for r in out) == [(1, "mit"), (1, "mit-notice"), (1, "mit-notice"), (3, "gpl-3.0-notice"), (3, "gpl-3.0-notice")]
    whole = next(r for r in out if r.template == "mit")
    assert 0.9 < whole.coverage < 1 and text.encode()[whole.start_byte : whole.end_byte].decode() == changed.rstrip(".")
    assert licenses.scan_licenses(odd_docs).count() == 0 and licenses.scan_licenses(no_docs).count() == 0


def test_licenses_equal_plain_search(small_docs):
    names = ("apache-2.0-notice", "gpl-3.0-notice", "mit-notice", "cc-by-nc-4.0-notice")
    out = licenses.scan_licenses(small_docs).collect()
    for n in names:
        assert sum(r.template == n for r in out) == sum(r.text.count(licenses.TEMPLATES[n]) for r in small_docs.collect())


def test_pipeline_stages_in_order(spark, odd_docs, no_docs, sf_dir):
    for docs in (odd_docs, no_docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            if name != "pack":
                assert docs.columns == corpus_pipeline.COLUMNS
        rows = docs.collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert rows and all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    assert tokenizer.decode([int(x) for x in np.frombuffer(rows[0].ids, "<u4")[:20]])


def test_pipeline_keeps_one_of_each_copy(spark, sf_dir):
    base = "The river runs past old mills and over stones where children once caught silver fish in nets of reed."
    rows = [(k, f"{base} {k % 2}", "en", "s", 1) for k in range(4)] + [(9, "Another text altogether about the price of bread in small towns.", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()) == [0, 9]


def test_packing_gives_the_json_s_added_tokens(spark, sf_dir):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n\ny", "<|endoftext| >", "it's <|endoftext|>'s  \n", "<|<|endoftext|>", ""]
    assert packing.json_bpe()(texts[0]) == [64, 220, 50256, 275]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces_are_whole(packing.pack_documents(docs, packing.json_bpe).collect(), list(enumerate(texts)), tokenizer)
    of = docs.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    pieces_are_whole(corpus_pipeline.pack_sequences(spark, of, sf_dir).collect(), list(enumerate(texts)), tokenizer)


@given(st.lists(st.one_of(st.text(max_size=20), st.just("<|endoftext|>"), st.sampled_from([" ", "\n", "<|", "'s"])), max_size=12))
@settings(max_examples=200, deadline=None)
def test_added_tokens_split_texts_as_the_tokenizer_does(parts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.json_bpe()("".join(parts)) == tokenizer.encode("".join(parts), add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["mit-notice", "cc-by-4.0-notice"])
def test_licenses_repeated_at_any_distance_are_all_found(name):
    index, notice = licenses.Index.of(licenses.TEMPLATES), licenses.TEMPLATES[name]
    size = len(licenses.words(notice.encode())[0])
    for distance in range(size, size + 3 * licenses.BAND + 1):
        for times in (2, 10):
            text = " ".join(f"{' '.join(f'z{k}y{i}' for i in range(distance - size))} {notice}" for k in range(times))
            got = [(r[6], r[7]) for r in licenses.matches(text.encode(), index) if r[0] == name]
            assert got == [(k * distance + distance - size, (k + 1) * distance) for k in range(times)]


def test_rows_that_share_an_id_or_have_none_are_kept_by_their_own_text(spark):
    """Junk under a clean row's id, junk and clean rows without ids, and repeated rows."""
    rng = random.Random(8)
    clean = lambda: " ".join(rng.choice("the river runs along old town where people walk home after work every day".split()) for _ in range(60))
    junk = lambda: " ".join(rng.choice("$$$ click %% buy!! free## win cash>>> now@@".split()) for _ in range(60))
    rows = [(k, clean()) for k in range(60)] + [(100 + k, junk()) for k in range(60)]
    odd = [(0, junk()), (None, junk()), (None, junk()), (None, clean()), (None, clean()), (7, rows[7][1])]
    docs = spark.createDataFrame([(k, t, True) for k, t in rows + odd], "doc_id long, text string, kept boolean")
    labels = spark.createDataFrame([(k, int(k < 100)) for k, _ in rows], "doc_id long, quality int")
    kept = [(r.doc_id, r.text) for r in quality.kept_documents(docs, labels).collect()]
    junk_texts = {t for k, t in rows + odd if "click" in t or "$$$" in t}
    assert not any(t in junk_texts for _, t in kept)
    assert sum(k is None for k, _ in kept) == 2 and sum(k == 7 for k, _ in kept) == 2 and sum(k == 0 for k, _ in kept) == 1
    assert len(kept) >= 60
