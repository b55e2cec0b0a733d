from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import middles


def units(text, unit):
    if unit == "chars":
        return list(text)
    if unit == "words":
        return re.findall(r"^[ \t\n\x0b\x0c\r]+|[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*", text)
    return re.findall(r"[^\n]*\n|[^\n]+$", text)


def by_hand(doc_id, text, unit="chars", seed=1, plain=10, spm=20, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    own = units(text, unit)
    a, b = sorted((h[0] % (len(own) + 1), h[1] % (len(own) + 1)))
    if not text or any(m in text for m in marks) or h[2] % 100 >= 100 - plain:
        return len(own), "plain", None, None, text
    prefix, middle, suffix = "".join(own[:a]), "".join(own[a:b]), "".join(own[b:])
    p, s, m = marks
    if h[3] % 100 < spm:
        return len(own), "spm", a, b - a, s + suffix + p + prefix + m + middle
    return len(own), "psm", a, b - a, p + prefix + s + suffix + m + middle


def check(df, rows, **kind):
    options = {"unit": kind.get("unit", "chars"), "seed": kind.get("seed", 1), "plain": kind.get("plain", 10), "suffix_first": kind.get("spm", 20), "sentinels": kind.get("marks", middles.SENTINELS)}
    got = middles.restore_text(middles.fill_in_middle(df, **options), sentinels=options["sentinels"]).collect()
    assert sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output, r.restored) for r in got))) == sorted(map(repr, ((k, *by_hand(k, t, **kind), t or "") for k, t in rows)))


@pytest.mark.parametrize("kind", [{}, {"unit": "words"}, {"unit": "lines"}, {"seed": 7, "plain": 0, "spm": 100}, {"unit": "words", "plain": 0, "marks": ("<fim_prefix>", "<fim_suffix>", "<fim_middle>")}])
def test_forms_equal_brute_force(spark, odd_docs, small_docs, kind):
    more = spark.createDataFrame([(100, "has <S> inside"), (101, "<P"), (102, "P><S"), (103, "<<<>>>" * 5), (104, "éß\U0001f600" * 40), (105, "\n\n"), (106, "  a  b\n c ")], "doc_id long, text string")
    df = odd_docs.union(small_docs.select(odd_docs.columns)).select("doc_id", "text", F.lit(1).alias("restored"), F.lit("x").alias("form")).unionByName(more.withColumns({"restored": F.lit(1), "form": F.lit("x")}))
    check(df, [(r.doc_id, r.text) for r in df.collect()], **kind)


def test_all_forms_occur_and_no_rows_give_none(spark, no_docs, small_docs):
    assert {r.form for r in middles.fill_in_middle(small_docs).select("form").distinct().collect()} == {"plain", "psm", "spm"}
    assert middles.restore_text(middles.fill_in_middle(no_docs)).count() == 0


def test_kernel_on_random_bytes_of_text():
    rng = random.Random(5)
    for _ in range(200):
        texts = ["".join(rng.choice("ab \n\té日\U0001f600") for _ in range(rng.choice((0, 0, 1, 5, 30)))) for _ in range(rng.randrange(1, 9))]
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        ends = np.cumsum([0, *(len(t.encode()) for t in texts)])
        first, second = (np.array([rng.randrange(1 << 32) for _ in texts]) for _ in range(2))
        for unit in ("chars", "words", "lines"):
            n, low, middle, a, b = middles.byte_cuts(raw, ends, first, second, unit)
            for k, t in enumerate(texts):
                own = units(t, unit)
                x, y = sorted((first[k] % (len(own) + 1), second[k] % (len(own) + 1)))
                assert (n[k], low[k], middle[k]) == (len(own), x, y - x)
                assert a[k] - ends[k] == len("".join(own[:x]).encode()) and b[k] - ends[k] == len("".join(own[:y]).encode())


def test_portions_hold_all_rows_and_few_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "", "b" * 50, "c", "d" * 9] * 3})
    got = list(middles.portions(batch, 0, 20))
    assert [t for b in got for t in b.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column(0).to_pylist()) <= 20 for b in got)


@pytest.mark.parametrize("marks", [("", "<S>", "<M>"), ("<P>", "<P>", "<M>"), ("<P>", "a<P>b", "<M>"), ("ab", "bc", "<M>"), ("aba", "<S>", "<M>")])
def test_marks_that_could_be_mistaken_are_refused(marks):
    with pytest.raises(ValueError, match="sentinels"):
        middles.check_sentinels(marks)


def test_outputs_that_are_not_as_their_form_says_fail(spark):
    df = spark.createDataFrame([(1, "psm", "<S>x<P>y<M>z")], "doc_id long, form string, output string")
    with pytest.raises(Exception, match="sentinels"):
        middles.restore_text(df).collect()
    odd = spark.createDataFrame([(1, None, "a"), (2, "psm", None), (3, "other", "a"), (4, "plain", "a")], "doc_id long, form string, output string")
    assert {r.doc_id: r.restored for r in middles.restore_text(odd).collect()} == {1: None, 2: None, 3: None, 4: "a"}
