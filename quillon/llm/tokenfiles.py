"""Files of token ids: documents in order, their ids in checksummed blocks by the codec of idcoder, an index at the end."""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import idcoder
from .common import LOWER, UPPER, fresh_path, small_parts, stash, utf8
from .warc import open_folder

Encoder = Callable[[list[bytes]], list[np.ndarray]]

#: A file begins and ends with this.
MAGIC = b"QIDS0002"
#: Ids of a block, blocks that are coded side by side, and ids after which a task begins a new file.
BLOCK, LANES, ROLL = 2048, 1024, 1 << 26
#: Words whose ids a worker remembers, words or pieces that are encoded as one text, and texts whose ids are looked up at once.
REMEMBERED, TOGETHER, TEXTS = 600_000, 4_000, 250
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: A code point that is a word of its own, between words that are encoded together.
BETWEEN = "\x01"
#: Words of ASCII and of the letters of Latin-1, which no normal form changes, and the pieces that the tokenizer cuts these
#: into once they are in lower case; a word's first piece takes in the space before it.
PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
PIECES = re.compile(" ?(?:'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ ]+)")


class FileError(ValueError):
    """The bytes are no whole file of ids."""


def _byte_letters() -> dict[int, str]:
    """The code points that byte-level BPE has for bytes: printing ones are their own, the others follow from 256 on."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printing]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


LETTERS = _byte_letters()
#: The same, but for the space between pieces.
SIGNS = "".join(LETTERS.get(b, chr(b)) if b != 32 else " " for b in range(256))


class _Known(dict):
    """Numbers of words, their ids once they have been learned, and how often they were met. A number is a word's place among
    all that were looked up, so some numbers belong to no word."""

    def __init__(self, kind: type) -> None:
        self.flat, self.begins, self.sizes, self.met = np.zeros(0, kind), *np.zeros((3, 0), np.int64)

    def look(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' numbers, and which of them are met for the first time: learn is to be called with these."""
        at = np.arange(len(self.met), len(self.met) + len(words))
        numbers = np.fromiter(map(self.setdefault, words, range(len(self.met), len(self.met) + len(words))), np.int64, len(words))
        return numbers, np.flatnonzero(numbers == at)

    def learn(self, numbers: np.ndarray, fresh: np.ndarray, ids: np.ndarray, sizes: np.ndarray, times: np.ndarray | None = None) -> None:
        """The ids of the fresh words, one after the other, and how many each has; how often all were met."""
        own = np.zeros((2, len(numbers)), np.int64)
        own[:, fresh] = len(self.flat) + np.cumsum(sizes) - sizes, sizes
        self.begins, self.sizes = np.concatenate([self.begins, own[0]]), np.concatenate([self.sizes, own[1]])
        self.flat = np.concatenate([self.flat, ids.astype(self.flat.dtype)])
        self.met = np.concatenate([self.met, np.zeros(len(numbers), np.int64)])
        self.met += np.bincount(numbers, times, len(self.met)).astype(np.int64)

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by their numbers, one after the other, and how many each has."""
        sizes = self.sizes[numbers]
        at = np.repeat(self.begins[numbers] - np.cumsum(sizes) + sizes, sizes)
        at += np.arange(len(at))
        return self.flat[at], sizes

    def forget(self, most: int) -> None:
        """Keeps the words that were met more than once, or more often than that, so that at most `most` stay."""
        words, numbers, times = list(self), np.fromiter(self.values(), np.int64, len(self)), 1
        while (keep := self.met[numbers] > times).sum() > most:
            times *= 2
        numbers = numbers[keep]
        words, (ids, sizes), met = [words[k] for k in np.flatnonzero(keep)], self.ids(numbers), self.met[numbers]
        self.clear()
        self.__init__(self.flat.dtype.type)
        self.learn(*self.look(words), ids, sizes, met)


def _shape(tokenizer: dict) -> tuple:
    """What a tokenizer's file says of its steps before BPE, and of BPE itself."""
    before = tokenizer.get("pre_tokenizer") or {}
    model = {k: v for k, v in tokenizer["model"].items() if k not in ("vocab", "merges")}
    return json.dumps(tokenizer.get("normalizer")), json.dumps(before.get("pretokenizers")), model.get("type"), model.get("end_of_word_suffix"), model.get("dropout"), tokenizer.get("post_processor")


SHAPE = (
    json.dumps({"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}),
    json.dumps([{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]),
    "BPE",
    "</w>",
    None,
    None,
)


class WordEncoder:
    """Ids by a tokenizer that lower-cases and drops white space (word_bpe_49k.json), a word between ASCII white space at a
    time. No token reaches over white space, so a text's ids are its words' ids, and a word that comes again is looked up.
    New words of plain letters, digits and marks are cut into pieces here; the tokenizers library encodes those that are new
    with the same model, split at spaces alone, and the model marks where a piece ends. Other words take the tokenizer's
    whole way, many at a time. Capitals A-Z are folded first, but in words that hold "<|", for added tokens are matched as
    they are written. A model that is not byte-level BPE behind the normal forms and the split that PIECES follows has all
    words take the whole way."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        between = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self.between = between[0] if len(between) == 1 else None
        most = max(self.tokenizer.get_vocab(True).values(), default=0)
        self.kind = np.uint16 if most < 1 << 16 else np.int64
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        vocab = held["model"]["vocab"]
        signs = [LETTERS.get(b, chr(b)) for b in range(256)]
        self.cuts = _shape(held) == SHAPE and all(c in vocab and f"{c}</w>" in vocab for c in signs)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.last = np.zeros(most + 1, bool)
        if self.cuts:
            self.last[[n for token, n in vocab.items() if token.endswith("</w>")]] = True
        self.words, self.pieces = _Known(self.kind), _Known(self.kind)

    def alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and how many each has."""
        own = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in own for i in x], np.int64), np.array([len(x) for x in own], np.int64)

    def together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words without BETWEEN, TOGETHER of them encoded as one text."""
        flat, sizes = [], []
        for k in range(0, len(words), TOGETHER):
            part = words[k : k + TOGETHER]
            (e,) = self.tokenizer.encode_batch_fast([f" {BETWEEN} ".join(part)], add_special_tokens=False)
            ids = np.array(e.ids, np.int64)
            border = ids == self.between
            at = np.flatnonzero(border)
            own = (ids[~border], np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1) if len(at) == len(part) - 1 else self.alone(part)
            flat.append(own[0])
            sizes.append(own[1])
        return np.concatenate(flat), np.concatenate(sizes)

    def by_model(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of pieces of PLAIN words."""
        flat, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(0, len(pieces), TOGETHER):
            part = pieces[k : k + TOGETHER]
            text = " ".join(part)
            (e,) = self.model.encode_batch_fast([text if text.isascii() else text.encode().decode("latin-1").translate(SIGNS)], add_special_tokens=False)
            ids = np.array(e.ids, np.int64)
            at = np.flatnonzero(self.last[ids])
            if len(at) != len(part):
                raise ValueError("the model does not end each piece with a token of its own")
            flat.append(ids)
            sizes.append(np.diff(at, prepend=-1))
        return np.concatenate(flat), np.concatenate(sizes)

    def of_pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of PLAIN words without "<|"."""
        cut = PIECES.findall(f" {' '.join(words)}".lower())
        numbers, fresh = self.pieces.look(cut)
        self.pieces.learn(numbers, fresh, *self.by_model([cut[k] for k in fresh.tolist()]))
        ids, sizes = self.pieces.ids(numbers)
        return ids, np.add.reduceat(sizes, np.flatnonzero([p[0] == " " for p in cut]))

    def ids_of(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and how many each has."""
        words = pa.array(fresh, pa.large_string())
        marked = pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)
        plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False) & ~marked & self.cuts
        odd = marked | pc.match_substring(words, BETWEEN).to_numpy(zero_copy_only=False) | (self.between is None)
        known = _Known(self.kind)  # the words' ids by their way, then by their place
        order, flat, sizes = [], [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        for which, encode in ((plain, self.of_pieces), (~odd & ~plain, self.together), (odd & ~plain, self.alone)):
            which = np.flatnonzero(which)
            if len(which):
                ids, own = encode([fresh[k] for k in which.tolist()])
                for to, x in ((flat, ids), (order, which), (sizes, own)):
                    to.append(x)
        order = np.concatenate([np.zeros(0, np.int64), *order])
        known.learn(np.arange(len(fresh)), order, np.concatenate(flat), np.concatenate(sizes))
        return known.ids(np.arange(len(fresh)))

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        for known in (self.words, self.pieces):
            if max(len(known), len(known.met) // 4) > REMEMBERED:  # numbers without a word take room too
                known.forget(REMEMBERED // 2)
        out: list[np.ndarray] = []
        if not texts:
            return out
        folded = [t.translate(FOLD) if b"<|" not in t else b" ".join(w if b"<|" in w else w.translate(FOLD) for w in t.split()) for t in texts]
        cut = pc.ascii_split_whitespace(pa.array(folded, pa.large_binary()).cast(pa.large_string()))
        own = cut.flatten().dictionary_encode()
        lines = pc.binary_join_element_wise(own.dictionary, *pa.array(["", "\n"], pa.large_string()))  # no word holds white space
        different = lines.buffers()[2].to_pybytes().decode().split("\n")[: len(lines)] if len(lines) else []
        at, words = cut.offsets.to_numpy(), own.indices.to_numpy()
        numbers, fresh = self.words.look(different)
        self.words.learn(numbers, fresh, *self.ids_of([different[k] for k in fresh.tolist()]), np.bincount(words, minlength=len(numbers)))
        for k in range(0, len(texts), TEXTS):
            ends = at[k : k + TEXTS + 1]
            ids, sizes = self.words.ids(numbers[words[ends[0] : ends[-1]]])
            stops = np.append(0, np.cumsum(sizes))[ends - ends[0]].tolist()
            out += [ids[a:b] for a, b in zip(stops, stops[1:], strict=False)]
        return out


_ENCODERS: dict[str, Encoder] = {}


def word_bpe() -> Encoder:
    """The ids that tokenizers gives by word_bpe_49k.json without adding special tokens. A worker keeps one, with the words
    that it has met."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class FileWriter:
    """Writes one file of ids: add documents in order, then close."""

    def __init__(self, out, block: int = BLOCK, lanes: int = LANES) -> None:
        self.out, self.block, self.lanes = out, block, lanes
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.docs: list[tuple[int | None, int]] = []
        self.blocks: list[tuple[int, int, int, int]] = []  # bytes, ids, checksums of ids and of bytes
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.held.append(ids)
        self.n_held, self.n_ids = self.n_held + len(ids), self.n_ids + len(ids)
        if self.n_held >= self.block * self.lanes:
            self.flush(False)

    def flush(self, all_of_it: bool) -> None:
        """Codes whole blocks, `lanes` at a time, and at the end what is left."""
        ids = np.concatenate([np.zeros(0, np.uint16), *self.held])
        group, at = self.block * self.lanes, 0
        while len(ids) - at >= group or (all_of_it and at < len(ids)):
            own = ids[at : at + group]
            at += len(own)
            lengths = np.full(-(-len(own) // self.block), self.block)
            lengths[-1] -= lengths.sum() - len(own)
            rows = np.zeros((len(lengths), self.block), ids.dtype)
            rows.reshape(-1)[: len(own)] = own
            for raw, row, n in zip(idcoder.encode(rows[:, : lengths[0]], lengths), rows, lengths.tolist(), strict=True):
                self.out.write(raw)
                self.blocks.append((len(raw), n, zlib.crc32(row[:n].astype("<u4").tobytes()), zlib.crc32(raw)))
        self.held, self.n_held = [ids[at:]], len(ids) - at

    def close(self) -> None:
        self.flush(True)
        index = zlib.compress(json.dumps({"block": self.block, "blocks": self.blocks, "docs": self.docs}).encode(), 6)
        self.out.write(index + struct.pack("<QI", len(index), zlib.crc32(index)) + MAGIC)
        self.out.close()


def read_file(file, size: int, lanes: int = LANES) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, ids before it, its ids) of a file's documents in order. `lanes` blocks are held at a time, and the document
    that goes over their border. Anything but what FileWriter wrote is a FileError."""
    tail = struct.calcsize("<QI") + len(MAGIC)
    if size < tail + len(MAGIC) or file.read_at(len(MAGIC), 0) != MAGIC or (end := file.read_at(tail, size - tail))[-len(MAGIC) :] != MAGIC:
        raise FileError("no file of ids, or one that is cut off")
    length, crc = struct.unpack("<QI", end[: -len(MAGIC)])
    raw = file.read_at(length, size - tail - length) if length <= size - tail else b""
    if zlib.crc32(raw) != crc:
        raise FileError("the index differs from its checksum")
    index = json.loads(zlib.decompress(raw))
    blocks, docs = index["blocks"], iter(index["docs"])
    if len(MAGIC) + sum(b[0] for b in blocks) != size - tail - length:
        raise FileError("the index does not fit the blocks")
    offset, before, held, n_held = len(MAGIC), 0, [], 0
    doc = next(docs, None)
    for k in range(0, len(blocks) + 1, lanes):
        part = blocks[k : k + lanes]
        if part:
            data = file.read_at(sum(b[0] for b in part), offset)
            offset += len(data)
            cuts = np.cumsum([0, *(b[0] for b in part)])
            lengths = np.array([b[1] for b in part])
            raws = [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            if any(zlib.crc32(raw) != b[3] for raw, b in zip(raws, part, strict=True)):
                raise FileError("a block differs from its checksum")
            rows = idcoder.decode(raws, lengths)
            if any(zlib.crc32(row[: b[1]].astype("<u4").tobytes()) != b[2] for row, b in zip(rows, part, strict=True)):
                raise FileError("a block differs from its checksum")
            own = rows.reshape(-1)[: int(lengths.sum())]
            held.append(own)
            n_held += len(own)
        if doc is not None and n_held >= doc[1]:
            ids, at = np.concatenate([np.zeros(0, np.uint16), *held]), 0
            while doc is not None and n_held - at >= doc[1]:
                yield doc[0], before, ids[at : at + doc[1]]
                at, before = at + doc[1], before + doc[1]
                doc = next(docs, None)
            held, n_held = [ids[at:]], n_held - at
    if doc is not None or n_held:
        raise FileError("the index does not fit the blocks")


def write_ids(docs: DataFrame, folder: str, encode: Callable[[], Encoder], end_id: int = 1, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, roll: int = ROLL) -> DataFrame:
    """Files of the ids of documents in ascending order of their ids: a row (part, number, path, n_docs, n_ids) for each file.
    Files follow each other by part and number. A document's ids are its text's, which encode makes in the worker, and end_id.

    Documents are dealt by ranges of their ids. Rows of one id (null ids come last) are in the order of their texts' hashes,
    and may be dealt over parts, whatever their number, for equal rows are interchangeable; so the order of ids is the same
    however the input is split. A task holds block x LANES ids and one document, and moves a whole file into place.
    Null text: empty, so end_id alone. Ids of 2^16 and more fail the job. No rows: no files that hold documents. Other
    columns don't matter.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        of, (store, base), part = encode(), open_folder(folder), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint16)
        done: list[tuple] = []
        own: FileWriter | None = None

        def close() -> None:
            nonlocal own
            if own is not None:
                own.close()
                path = f"{base}/{name}.ids"
                store.move(f"{base}/.{name}", path)
                done.append((part, len(done), path, len(own.docs), own.n_ids))
                own = None

        for batch in small_parts(batches, 2000):
            texts = utf8(batch.column(1))
            for doc, ids in zip(batch.column(0).to_pylist(), of(texts), strict=True):
                if own is None:
                    name = uuid.uuid4().hex
                    own = FileWriter(store.open_output_stream(f"{base}/.{name}", compression=None), block)
                own.add(doc, np.append(ids, end))
                if own.n_ids >= roll:
                    close()
        close()
        columns = list(zip(*done, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], FILE_FIELDS)

    held = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    dealt = held.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order, "row").drop("row")
    return dealt.sortWithinPartitions(*order).mapInArrow(write, "part long, number long, path string, n_docs long, n_ids long")


FILE_FIELDS = ["part", "number", "path", "n_docs", "n_ids"]


def read_ids(files: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents in files (part, number, path, n_ids), start being the ids of all
    documents before it; with digest ids_crc32 (of the ids as little-endian unsigned 32-bit integers) in place of ids.

    A file is the unit of work; every block is held against its checksum, and a damaged or cut off file fails the job. The
    running sum over files is one small task: a row for each file. A null path gives no rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = open_folder(path.rpartition("/")[0])
                rows: list[tuple] = []
                n = 0
                with store.open_input_file(f"{place}/{path.rpartition('/')[2]}") as file:
                    for doc, before, ids in read_file(file, file.size()):
                        rows.append((doc, base + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.astype(np.int32)))
                        n += len(ids)
                        if len(rows) == 10_000 or (not digest and n > 1 << 20):
                            yield out(rows)
                            rows, n = [], 0
                yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "n_tokens", last])

    last = "ids_crc32" if digest else "ids"
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.where("path is not null").select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("base"))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n, "path").mapInArrow(read, f"doc_id long, start long, n_tokens long, {last} {'long' if digest else 'array<int>'}")


def store_ids(docs: DataFrame, encode: Callable[[], Encoder], end_id: int = 1) -> DataFrame:
    """Writes the documents' ids to files in the shared folder and reads them back: (doc_id, start, n_tokens, ids_crc32)."""
    folder = fresh_path(docs.sparkSession, "ids")
    return read_ids(stash(write_ids(docs, folder, encode, end_id), "files"), digest=True)
