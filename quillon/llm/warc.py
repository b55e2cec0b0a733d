"""WARC archives: a writer of monolithic gzip archives, and the normaliser that turns each into one gzip member a
record with a sidecar offset index."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, drop_stash, fresh_path, small_parts, stash, utf8

READ = 1 << 20
GZIP = 31
#: Digests (of 28 bytes with their page) that repeat, up to which their table is broadcast.
REPEATED = 200_000


def open_folder(url: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder's URL. A task writes straight to the shared store, under a name of its own
    that it moves into place at the end, so that a task that is run again leaves one whole file."""
    if url.startswith("file:"):
        url = "file://" + url.removeprefix("file:").removeprefix("//")
    store, path = fs.FileSystem.from_uri(url)
    store.create_dir(path, recursive=True)
    return store, path


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def clean(value: object) -> str:
    """A header value on one line."""
    return " ".join(str(value).split())


def page_record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """A response, or a revisit: its block is the HTTP header only, which tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Target-URI", clean(url or "")), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    if kind == "revisit":
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return record(headers, http + (payload if kind == "response" else b""))


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    raw: bytes


class WarcError(ValueError):
    """The bytes are no whole WARC record."""


def split_records(chunks: Iterator[bytes]) -> Iterator[Record]:
    """Records of an inflated stream as it comes: memory is bounded by the largest record."""
    held = bytearray()
    ended = False

    def more() -> bool:
        nonlocal ended
        chunk = next(chunks, None)
        if chunk is None:
            ended = True
            return False
        held.extend(chunk)
        return True

    while True:
        while (stop := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise WarcError("a record is cut off in its header")
                return
        lines = held[:stop].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise WarcError("no WARC record")
        headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x)}
        size = int(headers.get("content-length", "0"))
        whole = stop + 4 + size + 4
        while len(held) < whole:
            if not more():
                raise WarcError("a record is cut off in its block")
        if held[whole - 4 : whole] != b"\r\n\r\n":
            raise WarcError("a record does not end where its length says")
        yield Record(headers, bytes(held[stop + 4 : stop + 4 + size]), bytes(held[:whole]))
        del held[:whole]


def inflate(file, read: int = READ) -> Iterator[bytes]:
    """The bytes of a gzip file, of one member or many, in bounded portions."""
    z, fresh = zlib.decompressobj(GZIP), True
    while data := file.read(read):
        while data:
            fresh = False
            if out := z.decompress(data, read):
                yield out
            data = z.unconsumed_tail
            if z.eof:
                data, z, fresh = z.unused_data, zlib.decompressobj(GZIP), True
    if out := z.flush():
        yield out
    if not (fresh or z.eof):
        raise WarcError("a gzip stream is cut off")


def write_archives(records: DataFrame, folder: str, level: int = 1, roll: int = 256 << 20) -> DataFrame:
    """Monolithic gzip archives of (page_id, url, html, record_type, refers_to) rows: a row (path, n_records) for each.
    A task writes its rows as they stream by, into one gzip stream a file, and starts a new file at `roll` bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_folder(folder)
        done: list[tuple[str, int]] = []
        out = z = None
        name, size, n = "", 0, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.write(z.flush())
                out.close()
                path = f"{base}/{name}.warc.gz"
                store.move(f"{base}/.{name}", path)
                done.append((path, n))
                out = None

        for batch in small_parts(batches):
            ids, urls, kinds, to = (batch.column(c).to_pylist() for c in ("page_id", "url", "record_type", "refers_to"))
            for row in zip(ids, urls, utf8(batch.column("html")), kinds, to, strict=True):
                if out is None:
                    name, size, n = uuid.uuid4().hex, 0, 0
                    out, z = store.open_output_stream(f"{base}/.{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, GZIP)
                raw = page_record(*row)
                out.write(z.compress(raw))
                size, n = size + len(raw), n + 1
                if size >= roll:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "n_records"])

    return records.mapInArrow(write, "path string, n_records long")


INDEX_SCHEMA = "path string, offset long, length long, record_type string, record_id string, uri string, digest string, refers_to string"
INDEX_FIELDS = [f.split()[0] for f in INDEX_SCHEMA.split(", ")]


def normalise_archives(archives: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Each gzip archive (path) as an archive of one gzip member a record, with a sidecar index: a row for each record.

    An archive is inflated once, as a stream; every record is deflated as its own member and its offset and length go
    to the index, which is written beside the archive (`.idx`, a JSON line each) and returned. Archives are the unit
    of work. An archive that is already in members, or in some members and some runs, comes out the same; an empty
    one gives an empty archive and no rows. One that is cut off fails the job: no record is lost in silence. A null
    path gives no rows, and a repeated one is written again under another name. Other columns don't matter.
    """

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_folder(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name, offset, rows = uuid.uuid4().hex, 0, []
                target = f"{base}/{name}.warc.gz"
                with store.open_input_stream(path, compression=None) as source, store.open_output_stream(f"{base}/.{name}", compression=None) as out, store.open_output_stream(f"{base}/.{name}.idx", compression=None) as index:
                    for r in split_records(inflate(source)):
                        z = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                        member = z.compress(r.raw) + z.flush()
                        out.write(member)
                        h = r.headers.get
                        row = (target, offset, len(member), h("warc-type"), h("warc-record-id"), h("warc-target-uri"), h("warc-payload-digest"), h("warc-refers-to"))
                        index.write(json.dumps(dict(zip(INDEX_FIELDS, row, strict=True))).encode() + b"\n")
                        offset += len(member)
                        rows.append(row)
                        if len(rows) == 5000:
                            yield _index(rows)
                            rows = []
                store.move(f"{base}/.{name}", target)
                store.move(f"{base}/.{name}.idx", f"{target}.idx")
                yield _index(rows)

    return archives.where("path is not null").select("path").mapInArrow(normalise, INDEX_SCHEMA)


def _index(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], INDEX_FIELDS)


def read_members(index: DataFrame, folder: str) -> DataFrame:
    """index with the record at each (path, offset, length), fetched on its own: http_length, payload (null if the record
    has none) and read_digest, the payload's."""
    names = index.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_folder(folder)
        opened: tuple[str, pa.NativeFile] | None = None
        for part in small_parts(batches):
            length, payload, own = [], [], []
            for path, offset, size in zip(*(part.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                if opened is None or opened[0] != path:
                    if opened:
                        opened[1].close()
                    opened = (path, store.open_input_file(path))
                (r,) = split_records(iter([zlib.decompress(opened[1].read_at(size, offset), GZIP)]))
                head, _, body = r.block.partition(b"\r\n\r\n")
                fields = dict(x.lower().split(b": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)
                response = r.headers.get("warc-type") == "response"
                length.append(int(fields.get(b"content-length", b"0")))
                payload.append(body if response else None)
                own.append(digest(body) if response else None)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(length, pa.int64()), pa.array(payload, pa.binary()), pa.array(own, pa.string())], [*names, "http_length", "payload", "read_digest"])
        if opened:
            opened[1].close()

    return index.mapInArrow(read, f"{INDEX_SCHEMA}, http_length long, payload binary, read_digest string")


def revisit_plan(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with record_type and refers_to: of records with equal payloads of at least
    least_bytes, those of the largest page_id are responses and the others revisit it.

    Null html: an empty payload. Null page_id: smaller than any other; if all of a payload's are null, all are
    responses. Rows repeated with the largest id are all responses.

    Only digests are shuffled to find those that repeat. They are written as a table of their own: up to REPEATED of them
    are broadcast, and only where there are more does Spark join as it sees fit, and html may move.
    """
    payload = F.coalesce("html", F.lit(""))
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    large = F.octet_length(payload) >= least_bytes
    sha = F.unhex(F.sha1(payload.cast("binary")))
    same = held.where(large).groupBy(sha.alias("sha")).agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    same = stash(same.where("n > 1 and last is not null").select("sha", "last"), "repeated")
    few = same.limit(REPEATED + 1).count() <= REPEATED
    out = held.join(F.broadcast(same) if few else same, F.when(large, sha) == F.col("sha"), "left")
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return out.select("page_id", "url", "html", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("last")).alias("refers_to"))


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages to monolithic archives, normalise these, read every member back: a row for each record with page_id,
    payload_bytes, payload_digest, record_type, refers_to, path, offset and length. A response's digest and length are
    those of the payload read back, and must be what its header says; a revisit has them from its header.

    The monolithic archives are deleted once their index is written; the normalised ones, with their sidecars, are the
    product and stay where path says."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    archives = stash(write_archives(revisit_plan(pages, least_bytes), f"{folder}/whole"), "archives")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = stash(normalise_archives(archives.repartition(n, "path"), f"{folder}/members"), "index")
    delete(spark, f"{folder}/whole")
    drop_stash(archives)
    records = read_members(index, f"{folder}/members")
    page = lambda c: F.col(c).substr(F.lit(11), F.length(c) - 11).try_cast("long")
    told = F.substring_index("digest", ":", -1)
    sound = (F.col("record_type") != "response") | ((F.col("read_digest") == told) & (F.octet_length("payload") == F.col("http_length")))
    checked = F.when(sound, told).otherwise(F.raise_error(F.lit("a record read back differs from what was written")))
    return records.select(page("record_id").alias("page_id"), F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"), checked.alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"), "path", "offset", "length")
