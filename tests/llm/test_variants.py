from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from quillon.llm import variants


def counted(rows, least_length=5, least_count=3, every=None):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if every:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                if h % every == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least_length and k >= least_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def forms(n, factor=2.0):
    others = {w: [o for o in n if near(w, o)] for w in n}
    form = {w: min(o, key=lambda x: (-n[x], x)) if o else None for w, o in others.items()}
    form = {w: f if f and n[f] >= factor * n[w] else None for w, f in form.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(others[w]), n[form[w]] if form[w] else None))
    return out


def rows_of(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


@pytest.mark.parametrize("every", [None, 3, 97])
def test_documents_equal_brute_force(spark, odd_docs, every):
    more = spark.createDataFrame([(40, "Spelling spelling speling SPELLING spelling spelingg spelingg spelingg speling speling"), (None, "Größe größe grösse Größe éÉÈè×÷ éÉÈè×÷ éÉÈè×÷ éÉÈè×÷é éÉÈè×÷é éÉÈè×÷é")], "doc_id long, text string")
    df = odd_docs.select("doc_id", "text").union(more).withColumn("word", odd_docs_word()).withColumn("n", odd_docs_word())
    want = counted([(r.doc_id, r.text) for r in df.collect()], every=every)
    got = {r.word: r.n for r in variants.word_counts(df, typo_every=every).collect()}
    assert got == want and len(want) > 5
    assert sorted(map(repr, rows_of(variants.spelling_variants(df, typo_every=every)))) == sorted(map(repr, forms(want)))


def odd_docs_word():
    from pyspark.sql import functions as F

    return F.lit("clash")


@pytest.mark.parametrize("short", [256, 0])
def test_random_words_equal_brute_force(spark, monkeypatch, short):
    """Few letters: anagrams, runs of one letter and words within one edit are many, and so are long chains of forms."""
    monkeypatch.setattr(variants, "SHORT", short)
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 8))) for _ in range(400)} | {"a" * k for k in range(1, 12)} | {"ÿ" * 40, "ÿ" * 41, "x" + "ÿ" * 40}
    n = {w: rng.choice((1, 2, 3, 5, 8, 16, 40, 100)) for w in words} | {"a" * k: 2**k for k in range(1, 12)}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    pairs = sorted((r.word, r.other, r.n, r.other_n) for r in variants.near_words(df).collect())
    assert pairs == sorted((a, b, n[a], n[b]) for a in n for b in n if near(a, b))
    for factor in (2.0, 1.5):
        assert sorted(map(repr, rows_of(variants.variant_forms(df, factor)))) == sorted(map(repr, forms(n, factor)))


def test_a_very_long_word_and_odd_rows(spark):
    long = "ÿ" * 200_000
    df = spark.createDataFrame([(long, 3), (long + "a", 9), (None, 3), ("", 4), ("b", None), ("c", 1)], "word string, n long")
    got = {(r.word or "")[-2:]: (r.n, r.n_near, r.form_n) for r in variants.variant_forms(df).collect()}
    assert got == {"ÿÿ": (3, 1, 9), "ÿa": (9, 1, None), "": (4, 0, None), "c": (1, 0, None)}
    with pytest.raises(ValueError, match="factor"):
        variants.variant_forms(df, 1.0)


def test_no_rows_give_none(spark, no_docs):
    assert variants.spelling_variants(no_docs).count() == 0


def test_counts_of_whole_documents(spark, small_docs):
    want = {r.word: r.n for r in variants.word_counts(small_docs).collect()}
    assert want == counted([(r.doc_id, r.text) for r in small_docs.collect()])
