from __future__ import annotations

import math

import duckdb
import pytest

import corpus_pipeline
from quillon.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf_dir)
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    key = lambda names, r: repr([x if not isinstance(x, float) or not math.isnan(x) else None for _, x in sorted(zip(names, r, strict=True))])
    assert sorted(key(columns, r) for r in want.fetchall()) == sorted(key(df.columns, tuple(r)) for r in df.collect())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs_whole(spark, sf_dir, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    n = queries.QUERIES[name](spark, sf_dir).count()
    assert n == {"op1_tiff": docs, "op4_importance": docs, "op6_url_trees": pages, "op8_simhash": docs}.get(name, n) and n > 0


def test_pipeline_keeps_rows_of_null_and_repeated_ids(spark, sf_dir):
    texts = [f"{w} stands alone here in a text of {w} words that no other row of {w} holds" for w in ("one", "two", "three", "four", "five")]
    rows = list(zip((None, None, 3, 3, 4, 4, None), [*texts, texts[4], texts[2]], strict=True))
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()
    assert sorted((r.text, r.doc_id) for r in got if r.doc_id is not None) == sorted(zip(texts[2:], (3, 3, 4), strict=True))
    assert sorted(r.text for r in got if r.doc_id is None) == sorted(texts[:2])


def test_each_stage_equals_brute_force(spark, sf_dir):
    import re
    from collections import Counter

    import numpy as np
    import public_tokenizers
    from pyspark.sql import functions as F
    from test_lines_and_simhash import kept_lines, reachable
    from test_models_and_packing import pieces_are_whole
    from tokenizers import Tokenizer

    from quillon.llm import mixing, quality

    stages = dict(corpus_pipeline.STAGES)
    odd = spark.createDataFrame([(9001, None, "en", "src1", None), (9002, "", "en", None, 0), (9003, "a line that stands in many documents\n" * 3, None, "src2", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*corpus_pipeline.COLUMNS).union(odd)
    rows = docs.collect()
    model = quality.fit_ratio(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = {r.doc_id: model.score((r.text or "").encode()) for r in rows}
    keep = sum(s >= -model.margin for s in score.values())
    key = {k: s * quality.PASSAGE + quality.gumbel(k) for k, s in score.items()}
    want = set(sorted(key, key=lambda k: (-key[k], k))[:keep])
    docs = stages["quality classifier"](spark, docs, sf_dir)
    kept = docs.collect()
    assert {r.doc_id for r in kept} == want and {(r.doc_id, r.text, r.source) for r in kept} <= {(r.doc_id, r.text, r.source) for r in rows}

    want_lines = {k: t for k, _, _, t in kept_lines([(r.doc_id, r.text) for r in kept])}
    docs = stages["line dedup"](spark, docs, sf_dir)
    kept = docs.collect()
    assert {r.doc_id: r.text for r in kept} == want_lines and all(r.n_chars == len(r.text) for r in kept)

    sets = []
    for r in kept:
        words = re.findall(rb"[0-9a-z\x80-\xff]+", r.text.encode().lower())
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    near = [np.array([j for j, b in enumerate(sets) if len(a & b) >= 0.8 * len(a | b)]) for a in sets]
    label = reachable([r.doc_id for r in kept], near)
    docs = stages["simhash near-dedup"](spark, docs, sf_dir)
    left = docs.collect()
    assert {r.doc_id for r in left} == {int(c) for c in label} and {(r.doc_id, r.text) for r in left} <= {(r.doc_id, r.text) for r in kept}

    taken = {r.doc_id: r.taken for r in mixing.mix(docs)[0].collect()}
    words_of = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text) for r in left}
    docs = stages["mix sources"](spark, docs, sf_dir)
    mixed, uses = docs.collect(), Counter()
    for r in mixed:
        own = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        uses[r.doc_id] += len(own)
        assert any(words_of[r.doc_id][i : i + len(own)] == own for i in range(len(words_of[r.doc_id]) - len(own) + 1))
    assert uses == Counter({k: n for k, n in taken.items() if n})

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = stages["pack"](spark, docs, sf_dir).withColumn("doc_id", F.col("doc_id")).collect()
    pieces_are_whole(packed, [(r.doc_id, r.text) for r in mixed], tokenizer)
