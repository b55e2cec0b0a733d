"""TIFF pages: image directories, strips and tiles, PackBits, LZW and deflate, predictors. One row for each page."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_parts, utf8

# Fixed values of the TIFF 6.0 specification.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SUB_IFDS = 284, 317, 322, 323, 324, 325, 330
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
TYPE_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
CLEAR, END, FIRST, MOST_CODES = 256, 257, 258, 4094

#: Bytes that a byte of a segment can decode to, at most (LZW: a table's longest entry for a 9-bit code).
GROWTH = {NONE: 1, PACKBITS: 64, DEFLATE: 1032, OLD_DEFLATE: 1032, LZW: 3641}
#: Bytes of one page, which is one value of a column.
PAGE_BYTES = (1 << 31) - (1 << 20)


class TiffError(ValueError):
    """The bytes are not a TIFF that can be decoded whole."""


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size and at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


_RUN = re.compile(rb"(.)\1{2,127}", re.S)


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(stop: int) -> None:
        for k in range(at, stop, 128):
            part = data[k : min(k + 128, stop)]
            out.append(len(part) - 1)
            out.extend(part)

    for run in _RUN.finditer(data):
        literal(run.start())
        out += bytes((257 - (run.end() - run.start()), run[1][0]))
        at = run.end()
    literal(len(data))
    return bytes(out)


def _code_widths() -> np.ndarray:
    """Bits of the k-th code after a clear code. A decoder has added k - 1 entries before code k (the first adds
    none), and widths grow one code early."""
    entries = FIRST + np.maximum(0, np.arange(MOST_CODES + 4 - FIRST) - 1)
    return 9 + (entries >= 511).astype(np.int64) + (entries >= 1023) + (entries >= 2047)


_WIDTHS = _code_widths()
_ENDS = np.cumsum(_WIDTHS)
_ROOTS = [bytes((k,)) for k in range(256)] + [b"", b""]


def lzw_decode(data: bytes, size: int) -> bytes:
    """The widths after a clear code are known beforehand, so all codes up to the next one are cut out at once."""
    raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.int64)
    out: list[bytes] = []
    made, bit, last = 0, 0, len(data) * 8
    while made < size and bit + 9 <= last:
        ends = bit + _ENDS[: np.searchsorted(_ENDS, last - bit, "right")]
        width = _WIDTHS[: len(ends)]
        start = ends - width
        byte = start >> 3
        word = (raw[byte] << 16) | (raw[byte + 1] << 8) | raw[byte + 2]
        codes = (word >> (24 - (start & 7) - width)) & ((1 << width) - 1)
        stop = np.flatnonzero((codes == CLEAR) | (codes == END))
        n = int(stop[0]) if len(stop) else len(codes)
        entries = _ROOTS.copy()
        add, put = entries.append, out.append
        before = b""
        for code in codes[:n].tolist():
            if code < len(entries):
                now = entries[code]
            elif code == len(entries) and before:
                now = before + before[:1]
            else:
                raise TiffError("an LZW code before its entry")
            if before:
                add(before + now[:1])
            put(now)
            made += len(now)
            before = now
        if not len(stop) or codes[n] == END:
            break
        bit = int(ends[n])
    return b"".join(out)[:size]


def lzw_encode(data: bytes) -> bytes:
    """Codes are found one by one; their widths follow from their places, so they are packed at once."""
    parts: list[list[int]] = [[CLEAR]]
    codes: list[int] = []
    table: dict[int, int] = {}
    free, prefix = FIRST, -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        code = table.get(key)
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        table[key] = free
        free += 1
        prefix = byte
        if free == MOST_CODES:
            codes.append(prefix)
            codes.append(CLEAR)
            parts.append(codes)
            codes, table, free, prefix = [], {}, FIRST, -1
    if prefix >= 0:
        codes.append(prefix)
    parts.append([*codes, END])
    bits = []
    for k, part in enumerate(parts):
        width = np.full(1, 9) if k == 0 else _WIDTHS[: len(part)]
        values = np.array(part, np.int64)
        grid = (values[:, None] >> np.arange(11, -1, -1)) & 1
        bits.append(grid[np.arange(11, -1, -1) < width[:, None]].astype(np.uint8))
    return np.packbits(np.concatenate(bits)).tobytes()


def decompress(data: bytes, kind: int, size: int) -> bytes:
    if kind == NONE:
        out = data[:size]
    elif kind == LZW:
        out = lzw_decode(data, size)
    elif kind in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    elif kind == PACKBITS:
        out = unpack_bits(data, size)[:size]
    else:
        raise TiffError(f"compression {kind}")
    if len(out) != size:
        raise TiffError(f"a segment of {len(out)} bytes in place of {size}")
    return out


def compress(data: bytes, kind: int) -> bytes:
    return {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 6), PACKBITS: pack_bits}[kind](data)


@dataclass
class Page:
    """A directory's image: its samples, pixel by pixel (planes one after the other if it is planar), in the file's byte
    order; samples of less than 8 bits have a byte each."""

    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    segments: int
    data: bytes


def _fields(raw: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    """The tags of the directory at an offset, and the next one's offset."""
    if at + 2 > len(raw):
        raise TiffError("a directory outside the file")
    (n,) = struct.unpack_from(order + "H", raw, at)
    if at + 6 + 12 * n > len(raw):
        raise TiffError("a directory outside the file")
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
        if kind not in TYPE_CODES or not count:
            continue
        where, size = at + 10 + 12 * k, TYPE_BYTES[kind] * count
        if size > 4:
            (where,) = struct.unpack_from(order + "I", raw, where)
        if where + size > len(raw):
            raise TiffError("a tag outside the file")
        tags[tag] = struct.unpack_from(f"{order}{count}{TYPE_CODES[kind]}", raw, where)
    return tags, struct.unpack_from(order + "I", raw, at + 2 + 12 * n)[0]


def _samples(data: bytes, rows: int, columns: int, per: int, bits: int, order: str, predictor: int) -> np.ndarray:
    """The (rows, columns, per) samples of a decompressed segment: of 1, 2 or 4 bits (rows padded to bytes, a sample of
    the result each) or of whole bytes; predictor 2 (differences along a row) or 3 (of floats: differences of their
    bytes, which stand by significance) is undone."""
    if bits < 8:
        if predictor != 1:
            raise TiffError(f"predictor {predictor} of {bits}-bit samples")
        flat = np.unpackbits(np.frombuffer(data, np.uint8).reshape(rows, -1), axis=1)[:, : columns * per * bits]
        return (flat.reshape(rows, columns, per, bits) << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=3, dtype=np.uint8)
    size = bits // 8
    dtype = np.dtype(f"{order}u{size}")
    if predictor == 3:
        whole = np.cumsum(np.frombuffer(data, np.uint8).reshape(rows, -1, per), axis=1, dtype=np.uint8)
        planes = whole.reshape(rows, size, columns * per).transpose(0, 2, 1)
        return np.ascontiguousarray(planes).view(f">u{size}").astype(dtype).reshape(rows, columns, per)
    block = np.frombuffer(data, dtype).reshape(rows, columns, per)
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=dtype.newbyteorder("=")).astype(dtype)
    if predictor != 1:
        raise TiffError(f"predictor {predictor}")
    return block


def read_pages(raw: bytes) -> Iterator[Page]:
    """The pages of a TIFF in the order of its directories, each directory's sub-directories behind it."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or len(raw) < 8 or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise TiffError("no TIFF header")
    todo, seen, number = [struct.unpack_from(order + "I", raw, 4)[0]], set(), 0
    while todo:
        at = todo.pop(0)
        if not at:
            continue
        if not isinstance(at, int) or at < 0:
            raise TiffError("a directory outside the file")
        if at in seen:
            raise TiffError("directories in a circle")
        seen.add(at)
        tags, following = _fields(raw, at, order)
        todo = [*tags.get(SUB_IFDS, ()), following, *todo]
        yield _page(raw, tags, order, number)
        number += 1


def _page(raw: bytes, tags: dict[int, tuple], order: str, number: int) -> Page:
    def one(tag: int, default: int | None = None, most: int = 1 << 32) -> int:
        value = tags.get(tag, (default,))[0]
        if not isinstance(value, int) or not 0 < value <= most:
            raise TiffError(f"tag {tag} is {value}")
        return value

    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1, 65535)
    bits, kind, predictor = one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1, 3)
    if bits not in (1, 2, 4, 8, 16, 32, 64) or len(set(tags.get(BITS, (bits,)))) > 1:
        raise TiffError("samples of a size that is not known")
    if kind not in GROWTH:
        raise TiffError(f"compression {kind}")
    planes, per = (samples, 1) if one(PLANAR, 1, 2) == 2 else (1, samples)
    dtype = np.dtype(f"{order}u{max(1, bits // 8)}")
    tiled = TILE_OFFSETS in tags
    offsets, counts = (tags.get(TILE_OFFSETS), tags.get(TILE_BYTES)) if tiled else (tags.get(STRIP_OFFSETS), tags.get(STRIP_BYTES))
    w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    across, down = -(-width // w), -(-height // h)
    if not offsets or not counts or len(offsets) != planes * across * down or len(counts) != len(offsets):
        raise TiffError("segments that do not cover the image")
    if not all(isinstance(x, int) and x >= 0 for x in (*offsets, *counts)):
        raise TiffError("a segment outside the file")
    # What is claimed is held against what is there before any memory is taken for it.
    if planes * height * width * per * dtype.itemsize > PAGE_BYTES:
        raise TiffError("a page beyond 2 GB")
    line = -(-w * per * bits // 8)
    for k, size in enumerate(counts):
        if (h if tiled else min(h, height - k // across % down * h)) * line > size * GROWTH[kind]:
            raise TiffError("a segment too short for its share of the image")
    image = np.empty((planes, height, width, per), dtype)
    for k, (at, size) in enumerate(zip(offsets, counts, strict=True)):
        if at + size > len(raw):
            raise TiffError("a segment outside the file")
        plane, row, column = k // (across * down), k // across % down * h, k % across * w
        rows = h if tiled else min(h, height - row)
        data = decompress(raw[at : at + size], kind, rows * line)
        block = _samples(data, rows, w, per, bits, order, predictor)
        image[plane, row : row + rows, column : column + w] = block[: height - row, : width - column]
    return Page(number, width, height, samples, bits, kind, predictor, tiled, len(offsets), image.tobytes())


def write_pages(images: list[tuple[np.ndarray, int, int, tuple[int, int] | None, int]], order: str = "<") -> bytes:
    """A TIFF of 8-bit images (rows, columns, samples), each with compression, predictor, tile size (width, height; None:
    strips) and rows of a strip."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image, kind, predictor, tile, strip in images:
        height, width, samples = image.shape
        w, h = tile or (width, strip)
        offsets, counts = [], []
        for row in range(0, height, h):
            for column in range(0, width, w):
                block = image[row : row + h, column : column + w]
                if tile:
                    block = np.pad(block, ((0, h - block.shape[0]), (0, w - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.concatenate((block[:, :1], np.diff(block, axis=1)), axis=1)
                data = compress(np.ascontiguousarray(block).tobytes(), kind)
                offsets.append(len(out))
                counts.append(len(data))
                out += data + bytes(len(data) & 1)
        tags = {WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [8] * samples), COMPRESSION: (3, [kind]), PHOTOMETRIC: (3, [2 if samples == 3 else 1]), SAMPLES: (3, [samples]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor])}
        tags |= {TILE_WIDTH: (4, [w]), TILE_HEIGHT: (4, [h]), TILE_OFFSETS: (4, offsets), TILE_BYTES: (4, counts)} if tile else {STRIP_OFFSETS: (4, offsets), ROWS_PER_STRIP: (4, [h]), STRIP_BYTES: (4, counts)}
        held = {}
        for tag, (kind_, values) in tags.items():
            packed = struct.pack(f"{order}{len(values)}{TYPE_CODES[kind_]}", *values)
            if len(packed) > 4:
                held[tag] = struct.pack(order + "I", len(out))
                out += packed + bytes(len(packed) & 1)
            else:
                held[tag] = packed.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags))
        for tag in sorted(tags):
            out += struct.pack(order + "HHI", tag, tags[tag][0], len(tags[tag][1])) + held[tag]
        link = len(out)
        out += bytes(4)
    return bytes(out)


PAGE_FIELDS = ["page", "width", "height", "samples", "bits", "compression", "predictor", "tiled", "segments", "data", "error"]
PAGE_KINDS = [*[pa.int32()] * 7, pa.bool_(), pa.int32(), pa.binary(), pa.string()]
PAGE_SCHEMA = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, segments int, data binary, error string"
#: Bytes of decoded pages that go into one Arrow batch, about.
PAGES_BYTES = 4 << 20


def tiff_pages(files: DataFrame, content: str = "content") -> DataFrame:
    """A row for each page of each TIFF: files' other columns and page, width, height, samples, bits, compression,
    predictor, tiled, segments, data and error. data holds the samples in file order; a file's pages come one after
    the other, in order, its first being page 0.

    A file that is null, empty, cut off or otherwise no decodable TIFF gives the pages before the fault, then one
    row with the page's number, nulls and the error: no file fails a job. A page is bounded before it is decoded, by
    what its segments can hold and by 2 GB, a column's limit. Repeated rows give their pages again.
    No rows: none. Columns of files with the name of a page's field are replaced.
    """
    kept = [c for c in files.columns if c != content and c not in PAGE_FIELDS]
    held = files.select(*kept, content)
    schema = held.drop(content).schema
    width = len(kept)

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches):
            rows: list[tuple] = []
            of: list[int] = []
            size = 0

            def out(batch: pa.RecordBatch = batch, rows: list = rows, of: list = of) -> pa.RecordBatch:
                own = [c.take(pa.array(of, pa.int64())) for c in batch.columns[:width]]
                fields = zip(*rows, strict=True) if rows else [[]] * len(PAGE_KINDS)
                return pa.RecordBatch.from_arrays([*own, *(pa.array(f, k) for f, k in zip(fields, PAGE_KINDS, strict=True))], [*kept, *PAGE_FIELDS])

            for at, raw in enumerate(batch.column(width)):
                number = 0
                try:
                    for p in read_pages(raw.as_py() or b""):
                        rows.append((p.number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.segments, p.data, None))
                        of.append(at)
                        number, size = p.number + 1, size + len(p.data)
                        if size > PAGES_BYTES:
                            yield out()
                            rows.clear()
                            of.clear()
                            size = 0
                except (TiffError, struct.error, zlib.error, ValueError, OverflowError) as e:
                    rows.append((number, *[None] * 9, str(e)))
                    of.append(at)
            yield out()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return held.mapInArrow(pages, f"{fields}, {PAGE_SCHEMA}" if fields else PAGE_SCHEMA)


#: Bytes of one row of pixels: 64 pixels of three samples.
ROW_BYTES, ROW_PIXELS, PAGE_ROWS, STRIP_ROWS, TILE = 192, 64, 256, 32, (48, 32)
KINDS = (PACKBITS, LZW, DEFLATE)


def store_text(text: bytes) -> bytes:
    """A text as a TIFF: spaces up to whole rows of 64 RGB pixels, pages of at most 256 rows. The payload's checksum
    and the page's number choose compression, predictor and layout, so every kind of page is in use."""
    size = max(1, -(-len(text) // ROW_BYTES)) * ROW_BYTES
    pixels = np.frombuffer(text.ljust(size, b" "), np.uint8).reshape(-1, ROW_PIXELS, 3)
    pick = zlib.crc32(text)
    images = []
    for k, row in enumerate(range(0, len(pixels), PAGE_ROWS)):
        kind, layout = divmod((pick + k) % 12, 4)
        images.append((pixels[row : row + PAGE_ROWS], KINDS[kind], 1 + layout % 2, TILE if layout > 1 else None, STRIP_ROWS))
    return write_pages(images, "<" if pick & 1 else ">")


def text_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text stored as a TIFF. Null text: empty."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_parts(batches, 100):
            texts = utf8(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([store_text(t) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(store, "doc_id long, n_bytes long, media binary")


def page_digests(pages: DataFrame) -> DataFrame:
    """Digests of stored texts from their decoded pages (tiff_pages of doc_id, n_bytes, media_bytes, media_sha256), added
    up page by page as they stream by: the payload read back, and a feature (means and deviations of the three
    channels, in samples). A page with an error fails the job: what is stored must be read back whole."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            done = []
            for row in batch.select(["page", "error", "data", *MEDIA_FIELDS]).to_pylist():
                if row["error"]:
                    raise TiffError(row["error"])
                if row["page"] == 0:
                    done += [own.row()] if own else []
                    own = _Digest([row[f] for f in MEDIA_FIELDS])
                own.add(row["data"])
            yield _digests(done)
        yield _digests([own.row()] if own else [])

    return pages.mapInArrow(digest, DIGEST_SCHEMA)


MEDIA_FIELDS = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]
DIGEST_SCHEMA = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, n_pages long"


class _Digest:
    def __init__(self, media: list) -> None:
        self.media, self.sha, self.size, self.tail, self.pages = media, hashlib.sha256(), 0, b"", 0
        self.total, self.square = np.zeros(3, np.int64), np.zeros(3, np.int64)

    def add(self, data: bytes) -> None:
        self.sha.update(data)
        self.size += len(data)
        self.tail = (self.tail + data[-16:])[-16:]
        p = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int64)
        self.total += p.sum(axis=0)
        self.square += (p * p).sum(axis=0)
        self.pages += 1

    def row(self) -> tuple:
        pixels = self.size / 3
        mean = self.total / pixels
        spread = np.sqrt(np.maximum(0, self.square / pixels - mean**2))
        feature = ",".join(f"{x:.4f}" for x in (*mean, *spread))
        return (*self.media, self.size, self.sha.hexdigest(), zlib.crc32(self.tail), feature, self.pages)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    names = [f.split()[0] for f in DIGEST_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
