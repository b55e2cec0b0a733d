from __future__ import annotations

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import idcoder, queries, tokenfiles


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def blocks_of(seed, kind, n, longest):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.integers(1, longest + 1, n))[::-1].copy()
    if kind == "random":
        ids = rng.integers(0, 1 << 16, (n, longest))
    elif kind == "one":
        ids = np.full((n, longest), 65535)
    elif kind == "zipf":
        ids = np.minimum(rng.zipf(1.2, (n, longest)), 65535)
    else:  # a few sentences again and again
        sentence = rng.integers(0, 1 << 16, 37)
        ids = np.tile(sentence, (n, longest // 37 + 1))[:, :longest]
        ids[rng.random(ids.shape) < 0.02] = 7
    ids[np.arange(longest)[None, :] >= lengths[:, None]] = 0
    return ids, lengths


@pytest.mark.parametrize("kind", ["random", "one", "zipf", "sentences"])
@pytest.mark.parametrize(("n", "longest"), [(1, 1), (1, 500), (7, 17), (40, 700)])
def test_blocks_come_back(kind, n, longest):
    ids, lengths = blocks_of(n * longest, kind, n, longest)
    raw = idcoder.encode(ids, lengths)
    assert (idcoder.decode(raw, lengths) == ids[:, : lengths[0]]).all()
    bits = 8 * sum(map(len, raw)) / lengths.sum()
    if longest == 700:
        assert bits < {"random": 17.5, "one": 0.4, "zipf": 10, "sentences": 4}[kind]


def test_blocks_stand_alone():
    """A block's bytes don't depend on those beside it."""
    ids, lengths = blocks_of(5, "zipf", 9, 300)
    whole = idcoder.encode(ids, lengths)
    for k in range(9):
        assert idcoder.encode(ids[k : k + 1, : lengths[k]], lengths[k : k + 1]) == [whole[k]]
        assert (idcoder.decode([whole[k]], lengths[k : k + 1])[0] == ids[k, : lengths[k]]).all()


def test_carries_go_on(monkeypatch):
    """Long runs of one id between rare ones bring the low end near its top."""
    rng = np.random.default_rng(2)
    for seed in range(20):
        ids = np.where(rng.random((50, 400)) < 0.03, rng.integers(0, 1 << 16, (50, 400)), seed)
        lengths = np.full(50, 400)
        assert (idcoder.decode(idcoder.encode(ids, lengths), lengths) == ids).all()


def test_no_blocks_and_large_ids():
    assert idcoder.decode([], np.zeros(0, np.int64)).shape == (0, 0)
    with pytest.raises(ValueError, match="16 bits"):
        idcoder.encode(np.array([[1 << 16]]), np.array([1]))


def test_each_order_is_used():
    """Ids that only their two forerunners tell, that one tells, and that are frequent but follow anything."""
    rng = np.random.default_rng(1)
    uniform = rng.integers(0, 1 << 16, (20, 2000))
    cost = lambda ids: 8 * sum(map(len, idcoder.encode(ids, np.full(20, 2000)))) / ids.size
    frequent = rng.integers(0, 50, (20, 2000))
    after_one = frequent.copy()
    after_one[:, 1::2] = after_one[:, 0::2] * 17 % 50 + 50
    few = frequent % 8
    two, follow = few.copy(), rng.integers(0, 8, (8, 8))
    for t in range(2, 2000):
        two[:, t] = np.where(rng.random(20) < 0.05, few[:, t], follow[two[:, t - 1], two[:, t - 2]])
    assert 15.5 < cost(uniform) < 18 and cost(frequent) < 7.5
    assert cost(after_one) < 0.7 * cost(frequent) and cost(two) < 0.5 * cost(few)


ODD = ["a", "B", "Z", "É", "é", "İ", "I", "̇", "́", "A", "̊", "ß", "Σ", "ς", "ſ", "Å", "\x01", "\x0b", "\x1c", "\x85", "\xa0", "　", "​", " ", " ", "\n", "'s", "'S", "'LL", "<|endoftext|>", "<|EndOfText|>", "<|", "|>", "1", "٣", "日", "\U0001f600", "ﬁ", "ǅ", ".", "!!", "\x00", "ᄀ", "ᅡ"]


def test_words_give_the_ids_of_whole_texts(tokenizer, small_docs, monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(0, 14))) for _ in range(3000)]
    texts += [r.text or "" for r in small_docs.limit(150).collect()]
    monkeypatch.setattr(tokenfiles, "TOGETHER", 7)
    monkeypatch.setattr(tokenfiles, "REMEMBERED", 3000)
    encode = tokenfiles.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    got = [ids.tolist() for k in range(0, len(texts), 100) for ids in encode([t.encode() for t in texts[k : k + 100]])]
    assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_plain_words_are_cut_into_pieces(tokenizer, monkeypatch):
    """Letters of Latin-1, digits, marks and apostrophes go by pieces; none of these words takes the tokenizer's whole way."""
    rng = random.Random(7)
    signs = [chr(c) for c in [*range(33, 127), *range(192, 215), *range(216, 247), *range(248, 256)]]
    some = ["".join(rng.choice(signs if k % 2 else list("'sSdmltrveéÉß.,19")) for _ in range(rng.randrange(1, 16))) for k in range(4000)]
    words = [w for w in some if "<|" not in w]
    encode = tokenfiles.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for way in ("together", "alone"):
        monkeypatch.setattr(encode, way, None)
    got = [ids.tolist() for ids in encode([w.encode() for w in words])]
    assert got == [e.ids for e in tokenizer.encode_batch(words, add_special_tokens=False)]


def test_words_met_again_stay(monkeypatch):
    """When too many words are remembered, those that were met once go; the others are not encoded anew."""
    monkeypatch.setattr(tokenfiles, "REMEMBERED", 50)
    encode = tokenfiles.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    first = encode(["語 語".encode(), " ".join(f"語{k}" for k in range(60)).encode()])[0]
    new, own = [], encode.together
    monkeypatch.setattr(encode, "together", lambda words: new.extend(words) or own(words))
    again = encode(["語 語".encode()])[0]
    assert again.tolist() == first.tolist() and len(new) == 0 and len(encode.words) == 1


def test_what_is_remembered_stays_small(monkeypatch):
    """The same words again and again take no more room."""
    monkeypatch.setattr(tokenfiles, "REMEMBERED", 50)
    encode = tokenfiles.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    text = " ".join(f"a{k}" for k in range(40)).encode()
    first = encode([text])[0].tolist()
    for _ in range(30):
        assert encode([text])[0].tolist() == first
    assert len(encode.words) == 40 and len(encode.words.met) < 300 and len(encode.words.flat) < 300


def file_of(docs, block=16, lanes=3):
    class Kept(io.BytesIO):
        def close(self):
            pass

    out = Kept()
    writer = tokenfiles.FileWriter(out, block, lanes)
    for doc, ids in docs:
        writer.add(doc, np.array(ids, np.int64))
    writer.close()
    return out.getvalue()


def read(raw, lanes=3):
    return [(doc, at, ids.tolist()) for doc, at, ids in tokenfiles.read_file(pa.BufferReader(raw), len(raw), lanes)]


@pytest.mark.parametrize("lanes", [1, 3, 50])
def test_files_come_back(lanes):
    rng = random.Random(4)
    for sizes in ([], [0], [0, 0, 5], [1] * 40, [200, 0, 3, 47, 48, 1000], [48], [47, 1], [16]):
        docs = [(None if k == 2 else k * 10, [rng.randrange(1 << 16) for _ in range(n)]) for k, n in enumerate(sizes)]
        before = np.cumsum([0, *sizes]).tolist()
        assert read(file_of(docs), lanes) == [(d, at, ids) for (d, ids), at in zip(docs, before, strict=False)]


def test_any_damage_is_found():
    rng = random.Random(6)
    raw = file_of([(k, [rng.randrange(300) for _ in range(60)]) for k in range(5)])
    want = read(raw)
    cases = [b"", raw[:5], raw[:-1], raw[: len(raw) // 2], raw + b"x", raw[:8] + raw]
    for k in range(0, len(raw)):
        cases.append(raw[:k] + bytes([raw[k] ^ (1 << rng.randrange(8))]) + raw[k + 1 :])
    for bad in cases:
        with pytest.raises(tokenfiles.FileError):
            read(bad)
    assert read(raw) == want


def by_hand(tokenizer, rows):
    """rows in order of id, equal ids by the texts' hash."""
    at, out = 0, []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_equals_brute_force(spark, sf_dir, small_docs, tokenizer):
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op13_id_files(spark, sf_dir).collect()]
    assert sorted(got) == by_hand(tokenizer, sorted((r.doc_id, r.text) for r in small_docs.collect()))


def test_odd_rows_and_any_partitions(spark, odd_docs, tokenizer):
    docs = odd_docs.withColumns({"row": F.lit("clash"), "ids": F.lit(1), "start": F.lit(2)})
    ordered = odd_docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).collect()
    want = sorted(by_hand(tokenizer, [(r.doc_id, r.text) for r in ordered]), key=lambda r: r[1])
    for parts in (1, 5):
        got = tokenfiles.store_ids(docs.repartition(parts), tokenfiles.word_bpe).collect()
        assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want


def test_ids_are_read_whole_and_files_roll(spark, small_docs, tokenizer):
    from quillon.llm.common import fresh_path, stash

    files = stash(tokenfiles.write_ids(small_docs, fresh_path(spark, "ids"), tokenfiles.word_bpe, roll=5000), "files")
    assert files.count() > 8 and files.where("n_docs < 1").count() == 0
    whole = {r.doc_id: r.ids for r in tokenfiles.read_ids(files).collect()}
    for r in small_docs.limit(60).collect():
        assert whole[r.doc_id] == [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
    assert len(whole) == small_docs.count()


def test_no_rows_give_none(no_docs):
    assert tokenfiles.store_ids(no_docs, tokenfiles.word_bpe).count() == 0
