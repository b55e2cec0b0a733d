from __future__ import annotations

import base64
import gzip
import hashlib
import io
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import tiff, warc
from quillon.llm.common import fresh_path, stash


@given(st.binary(max_size=6000) | st.binary(max_size=40).map(lambda b: b * 300))
@settings(max_examples=60, deadline=None)
def test_codecs_round_trip(data):
    for kind in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
        assert tiff.decompress(tiff.compress(data, kind), kind, len(data)) == data


def test_codecs_against_published_examples():
    # The PackBits example of Apple's note, and the LZW example of the TIFF 6.0 specification.
    packed = bytes.fromhex("fe aa 02 80 00 2a fd aa 03 80 00 2a 22 f7 aa")
    plain = bytes.fromhex("aa aa aa 80 00 2a aa aa aa aa 80 00 2a 22 aa aa aa aa aa aa aa aa aa aa")
    assert tiff.unpack_bits(packed, len(plain)) == plain and tiff.unpack_bits(b"\x80" + packed, len(plain)) == plain
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    coded = int(bits.ljust(88, "0"), 2).to_bytes(11, "big")
    assert tiff.lzw_decode(coded, 9) == bytes((7, 7, 7, 8, 8, 7, 7, 6, 6)) and tiff.lzw_encode(bytes((7, 7, 7, 8, 8, 7, 7, 6, 6))) == coded


def test_lzw_widens_its_codes_one_early():
    # The decoder's table has 511 entries after the code of place 253, and codes take 10 bits from place 254 on.
    assert tiff._WIDTHS[253] == 9 and tiff._WIDTHS[254] == 10 and tiff._WIDTHS[765] == 10 and tiff._WIDTHS[766] == 11 and tiff._WIDTHS[1790] == 12


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tile", [None, (16, 32), (48, 32)])
@pytest.mark.parametrize("predictor", [1, 2])
def test_pages_of_every_layout(order, tile, predictor):
    rng = np.random.default_rng(0)
    images = [rng.integers(0, 255, (h, w, s)).astype(np.uint8) for h, w, s in ((70, 50, 3), (1, 1, 1), (33, 17, 4))]
    raw = tiff.write_pages([(im, kind, predictor, tile, 16) for im, kind in zip(images, (tiff.LZW, tiff.PACKBITS, tiff.DEFLATE), strict=True)], order)
    pages = list(tiff.read_pages(raw))
    assert [(p.number, p.width, p.height, p.samples) for p in pages] == [(0, 50, 70, 3), (1, 1, 1, 1), (2, 17, 33, 4)]
    assert all(p.data == im.tobytes() for p, im in zip(pages, images, strict=True))


def test_planar_16_bit_and_sub_directories():
    a, b = np.arange(12, dtype="<u2").reshape(3, 4) * 300, np.arange(12, dtype="<u2").reshape(3, 4)
    pixels = a.tobytes() + b.tobytes()

    def directory(at, tags, following):
        return struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, n, v) for t, k, n, v in tags) + struct.pack("<I", following)

    data = 8
    lists = data + len(pixels)
    extra = struct.pack("<HHIIII", 16, 16, data, data + 24, 24, 24)
    first = lists + len(extra)
    tags = [(256, 3, 1, 4), (257, 3, 1, 3), (258, 3, 2, lists), (259, 3, 1, 1), (273, 4, 2, lists + 4), (277, 3, 1, 2), (278, 3, 1, 3), (279, 4, 2, lists + 12), (284, 3, 1, 2)]
    tags[2] = (258, 3, 2, 16 | 16 << 16)
    size = 2 + 12 * 10 + 4
    main = directory(first, [*tags, (330, 4, 1, first + size)], 0)
    sub = directory(first + size, tags, 0)
    raw = b"II" + struct.pack("<HI", 42, first) + pixels + extra + main + sub
    pages = list(tiff.read_pages(raw))
    assert [p.number for p in pages] == [0, 1] and all(p.data == pixels and p.bits == 16 and p.samples == 2 for p in pages)


def single_strip(data, width, height, bits, predictor):
    tags = [(256, 3, 1, width), (257, 3, 1, height), (258, 3, 1, bits), (259, 3, 1, 8), (273, 4, 1, 8), (277, 3, 1, 1), (278, 3, 1, height), (279, 4, 1, len(zlib.compress(data))), (317, 3, 1, predictor)]
    packed = zlib.compress(data)
    return b"II" + struct.pack("<HI", 42, 8 + len(packed)) + packed + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + bytes(4)


def test_floats_and_single_bits():
    rows = np.random.default_rng(1).standard_normal((5, 7)).astype("<f4")
    coded = b""
    for row in rows:
        by_weight = np.ascontiguousarray(row.astype(">f4")).view(np.uint8).reshape(7, 4).T.ravel()
        coded += np.concatenate((by_weight[:1], np.diff(by_weight))).astype(np.uint8).tobytes()
    (page,) = tiff.read_pages(single_strip(coded, 7, 5, 32, 3))
    assert page.data == rows.tobytes()
    bits = np.random.default_rng(2).integers(0, 2, (6, 13)).astype(np.uint8)
    (page,) = tiff.read_pages(single_strip(np.packbits(bits, axis=1).tobytes(), 13, 6, 1, 1))
    assert page.data == bits.tobytes()
    nibbles = np.random.default_rng(3).integers(0, 16, (4, 5)).astype(np.uint8)
    packed = np.pad(nibbles, ((0, 0), (0, 1)))
    (page,) = tiff.read_pages(single_strip((packed[:, ::2] << 4 | packed[:, 1::2]).astype(np.uint8).tobytes(), 5, 4, 4, 1))
    assert page.data == nibbles.tobytes()


def test_pages_with_faults(spark):
    good = tiff.store_text(b"x" * 60_000)
    circle = bytearray(tiff.write_pages([(np.zeros((2, 2, 1), np.uint8), 1, 1, None, 2)]))
    first = struct.unpack_from("<I", circle, 4)[0]
    n = struct.unpack_from("<H", circle, first)[0]
    struct.pack_into("<I", circle, first + 2 + 12 * n, first)
    rows = [(1, good, 5), (2, None, 5), (3, b"", 5), (4, b"II*\0", 5), (5, good[: len(good) - 40], 5), (6, bytes(circle), 5), (None, good, None), (1, good, 5)]
    out = tiff.tiff_pages(spark.createDataFrame(rows, "file_id long, content binary, width long")).collect()
    by = {k: [r for r in out if r.file_id == k] for k in (1, 2, 3, 4, 5, 6, None)}
    assert len(by[1]) == 4 and len(by[None]) == 2 and [r.page for r in by[None]] == [0, 1] and not any(r.error for r in by[1])
    assert all(len(by[k]) == 1 and by[k][0].error for k in (2, 3, 4)) and by[5][-1].error and by[6][0].error is None and "circle" in by[6][1].error
    assert tiff.tiff_pages(spark.createDataFrame([], "file_id long, content binary")).count() == 0


def raw_tiff(tags, data=b"", order="<"):
    """A file of one directory: tags (tag, kind, values)."""
    kinds = {3: "H", 4: "I", 11: "f", 12: "d"}
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0) + data)
    held = []
    for tag, kind, values in tags:
        packed = struct.pack(f"{order}{len(values)}{kinds[kind]}", *values)
        if len(packed) > 4:
            held.append((tag, kind, len(values), struct.pack(order + "I", len(out))))
            out += packed
        else:
            held.append((tag, kind, len(values), packed.ljust(4, b"\0")))
    struct.pack_into(order + "I", out, 4, len(out))
    out += struct.pack(order + "H", len(held)) + b"".join(struct.pack(order + "HHI", *h[:3]) + h[3] for h in held) + bytes(4)
    return bytes(out)


def test_damaged_files_give_error_rows(spark):
    base = {256: (4, [4]), 257: (4, [3]), 258: (3, [8]), 259: (3, [1]), 273: (4, [8]), 277: (3, [1]), 278: (4, [3]), 279: (4, [12])}
    tiled = {k: v for k, v in base.items() if k not in (273, 278, 279)} | {322: (4, [16]), 323: (4, [16]), 324: (4, [8]), 325: (4, [256])}
    made = lambda of, data=bytes(300), **change: raw_tiff([(t, *v) for t, v in sorted((of | {int(k[1:]): v for k, v in change.items()}).items()) if v], data)
    assert next(tiff.read_pages(made(base))).data == bytes(12) and next(tiff.read_pages(made(tiled))).data == bytes(12)
    bad = [
        made(tiled, t322=(4, [0])), made(tiled, t323=(4, [0])), made(tiled, t322=None), made(base, t278=(4, [0])), made(base, t256=(11, [4.0])), made(base, t258=(12, [8.0])), made(base, t256=(4, [])), made(base, t277=(3, [0])),
        made(base, t256=(4, [60000]), t257=(4, [4_000_000_000]), t278=(4, [4_000_000_000])), made(base, t256=(4, [4_000_000_000]), t277=(3, [65535])), made(base, t279=(4, [5])), made(base, t273=(11, [8.0])), made(base, t259=(3, [7])),
        made(base, t284=(3, [3])), made(base, t317=(3, [9])), made(base, t273=(4, [1 << 31])), made(base, t330=(12, [9.5])), made(base, t259=(3, [5])), made(base, t259=(3, [8])), made(base, t258=(3, [8, 16])), made(base)[:-20],
    ]
    rng = np.random.default_rng(4)
    whole = tiff.store_text(b"some text " * 300)
    for _ in range(300):  # bytes changed at random anywhere
        raw = bytearray(whole)
        for at in rng.integers(0, len(raw), 3):
            raw[at] = rng.integers(0, 256)
        bad.append(bytes(raw))
    out = tiff.tiff_pages(spark.createDataFrame(list(enumerate(bad)), "file_id long, content binary")).select("file_id", "error").collect()
    assert {r.file_id for r in out} == set(range(len(bad)))
    assert all(any(r.error for r in out if r.file_id == k) for k in range(21))


@pytest.mark.parametrize("which", ["odd_docs", "small_docs", "no_docs"])
def test_texts_read_back_whole(request, which):
    docs = request.getfixturevalue(which)
    media = tiff.text_media(docs).select("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    kept = {(r.doc_id, r.media_sha256): bytes(r.media) for r in media.collect()}
    out = tiff.page_digests(tiff.tiff_pages(media, "media")).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out), key=repr)
    want = []
    for r in docs.collect():
        raw = (r.text or "").encode()
        pad = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        want.append((r.doc_id, len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:])))
    assert got == sorted(want, key=repr)
    assert all(hashlib.sha256(kept[r.doc_id, r.media_sha256]).hexdigest() == r.media_sha256 and len(kept[r.doc_id, r.media_sha256]) == r.media_bytes for r in out)
    if which == "small_docs":
        kinds = tiff.tiff_pages(media, "media").select("compression", "predictor", "tiled").distinct().count()
        assert kinds == 12


PAGES = "page_id long, url string, html string, digest string, path string"


def test_archives_equal_brute_force(spark):
    long = "<p>é</p>" * 100_000
    rows = [(1, "http://a/1\r\nx: y", "one", "", ""), (2, None, "one", "", ""), (3, "http://a/3", None, None, None), (4, "u", "", "", ""), (9, "u", "one", "", ""), (9, "u", "one", "", ""), (5, "u", long, "", ""), (6, "u", long + "x", "", ""), (None, "u", "one", "", ""), (None, "u", "lonely", "", ""), (7, "u", "two\r\n\r\nWARC/1.1\r\n\r\n", "", ""), (-8, "u", long, "", "")]
    out = warc.archive_pages(spark.createDataFrame(rows, PAGES)).collect()
    last = {}
    for k, _, h, *_ in rows:
        last[h or ""] = max(last.get(h or "", -99), -99 if k is None else k)
    want = []
    for k, _, h, *_ in rows:
        raw, most = (h or "").encode(), last[h or ""]
        again = most > -99 and k != most
        want.append((k, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", most if again else None))
    assert sorted((tuple(r)[:5] for r in out), key=repr) == sorted(want, key=repr)
    assert warc.archive_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_least_bytes_of_a_revisit(spark):
    rows = [(1, "u", "ab", "", ""), (2, "u", "ab", "", ""), (3, "u", "abc", "", ""), (4, "u", "abc", "", "")]
    out = {r.page_id: r.refers_to for r in warc.archive_pages(spark.createDataFrame(rows, PAGES), least_bytes=3).collect()}
    assert out == {1: None, 2: None, 3: 4, 4: None}


def test_normalised_members_stand_alone(spark):
    folder = fresh_path(spark, "warc-test")
    rows = [(k, f"http://h/{k}", "text " * k, "response", None) for k in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string, refers_to long").coalesce(1)
    archives = stash(warc.write_archives(pages, f"{folder}/whole", roll=2000), "a")
    assert archives.count() > 3
    store, base = warc.open_folder(f"{folder}/whole")
    for r in archives.collect():
        raw = store.open_input_stream(r.path, compression=None).read()
        z = zlib.decompressobj(31)
        assert z.decompress(raw).count(b"WARC/1.1\r\n") == r.n_records and z.eof and not z.unused_data
    index = stash(warc.normalise_archives(archives, f"{folder}/members"), "b")
    assert index.count() == 50
    whole = {}
    for r in index.collect():
        raw = whole.setdefault(r.path, store.open_input_stream(r.path, compression=None).read())
        member = gzip.decompress(raw[r.offset : r.offset + r.length])
        assert member.startswith(b"WARC/1.1\r\n") and r.record_id.encode() in member
        lines = store.open_input_stream(r.path + ".idx", compression=None).read().splitlines()
        assert len(lines) == sum(x.path == r.path for x in index.collect())
        break
    again = stash(warc.normalise_archives(index.select("path").distinct(), f"{folder}/again"), "c")
    assert sorted(r.record_id for r in again.collect()) == sorted(r.record_id for r in index.collect())


def test_cut_archives_are_refused():
    raw = gzip.compress(warc.page_record(1, "u", b"x" * 5000, "response", None))
    assert len(list(warc.split_records(warc.inflate(io.BytesIO(raw), 64)))) == 1
    for cut in (len(raw) - 3, len(raw) // 2, 12):
        with pytest.raises(warc.WarcError):
            list(warc.split_records(warc.inflate(io.BytesIO(raw[:cut]), 64)))
    assert list(warc.split_records(warc.inflate(io.BytesIO(b"")))) == []
