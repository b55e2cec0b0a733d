"""What files a store holds and whether they are whole: on any store that Spark lists."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import file_headers, opened

#: Wraps zlib's streams in gzip's.
GZIP = 31
CHUNK = 1 << 20


def files_below(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, length, modified) of every file below root, empty ones too: name is the path below root. Spark lists
    large trees by tasks, on any store, and keeps the list on the driver; contents are not read. Names that begin with _ or .
    are hidden, as everywhere in Spark. Empty files, which its scan passes over, come from that list, without a time. A
    root that is not there is an error of Spark's."""
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    listed = [(unquote(url.replace(":///", ":/", 1) if url.startswith("file:///") else url),) for url in scan.inputFiles()]
    held = spark.createDataFrame(listed, "path string").join(scan, "path", "left").withColumn("length", F.coalesce("length", F.lit(0).cast("long")))
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/") + "/"
    return held.select("path", F.substring_index("path", base, -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def source_inventory(files: DataFrame, expected: DataFrame, checksums: str = "sha256") -> DataFrame:
    """A row for each source (the first part of a name) that has files or is expected (source, name without it): source,
    present, file_count, total_bytes, expected_file_count, missing (its expected names that are not there, sorted) and
    has_checksums (a file has that in its name). Null names are no files. A source's missing names are one array, as
    long as its list of expected names."""
    own = files.where("name is not null").select(F.substring_index("name", "/", 1).alias("source"), F.regexp_replace("name", "^[^/]*/", "").alias("name"), "length")
    there = own.groupBy("source").agg(F.count("*").alias("file_count"), F.sum("length").alias("total_bytes"), F.max(F.contains(F.lower("name"), F.lit(checksums))).alias("has_checksums"))
    named = expected.where("source is not null").select("source", "name").distinct().join(own.select("source", "name", F.lit(True).alias("there")), ["source", "name"], "left")
    wanted = named.groupBy("source").agg(F.count("name").alias("expected_file_count"), F.array_sort(F.collect_list(F.when(F.col("there").isNull(), F.col("name")))).alias("missing"))
    out = there.join(wanted, "source", "full")
    zero, never = F.lit(0).cast("long"), F.lit(False)
    return out.select("source", F.col("file_count").isNotNull().alias("present"), F.coalesce("file_count", zero).alias("file_count"), F.coalesce("total_bytes", zero).alias("total_bytes"), F.coalesce("expected_file_count", zero).alias("expected_file_count"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"), F.coalesce("has_checksums", never).alias("has_checksums"))


def described_files(files: DataFrame) -> DataFrame:
    """S12's file rows: files with their suffix (of the last dots: .csv.gz) and, for CSV files, the cells of their first line;
    other kinds have no header. Tasks read first lines only."""
    suffix = F.nullif(F.regexp_extract(F.lower(F.substring_index("name", "/", -1)), r"(\.[a-z0-9]+(?:\.gz)?)$", 1), F.lit(""))
    return files.withColumn("suffix", suffix).join(file_headers(files), "name", "left")


def gzip_members(chunks: Iterator[bytes]) -> tuple[str, int, int]:
    """(state, members, bytes inflated) of a stored gzip stream: ok; truncated, if it ends within a member or is empty;
    corrupt, if a member's data or checksum is wrong or something else follows one. Zeros may follow the last member."""
    z, fresh, members, n = zlib.decompressobj(GZIP), True, 0, 0
    data = b""
    try:
        for data in chunks:
            while data:
                if fresh:
                    data = data.lstrip(b"\0") if members else data
                    if not data:
                        break
                fresh = False
                n += len(z.decompress(data, CHUNK))
                data = z.unconsumed_tail
                if z.eof:
                    members, data, z, fresh = members + 1, z.unused_data, zlib.decompressobj(GZIP), True
        if not fresh:
            n += len(z.flush())
            return ("ok", members + 1, n) if z.eof else ("truncated", members, n)
    except zlib.error:
        return "corrupt", members, n
    return ("ok" if members else "truncated"), members, n


def gzip_states(files: DataFrame) -> DataFrame:
    """S16 for many files: (name, state, members, inflated_bytes) of each file (path, name): its state by gzip_members; not_gzip
    for a name without .gz, missing for a path that is not there (or null). A file is streamed in portions by one task,
    whatever its size; files are dealt by name."""

    def portions(stream: pa.NativeFile) -> Iterator[bytes]:
        while data := stream.read(CHUNK):
            yield data

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not (name or "").lower().endswith(".gz"):
                    rows.append(("not_gzip", None, None))
                    continue
                try:
                    if path is None:
                        raise FileNotFoundError
                    with opened(path) as stream:
                        rows.append(gzip_members(portions(stream)))
                except FileNotFoundError:
                    rows.append(("missing", None, None))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(1), *[pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)]], ["name", "state", "members", "inflated_bytes"])

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path", "name").repartition(n, "name").mapInArrow(check, "name string, state string, members long, inflated_bytes long")


def put_files(rows: DataFrame, folder: str) -> DataFrame:
    """Each row (name, content) as a file below folder: (name, path, length). A task writes to a name of its own and moves the
    file into place, so that one that is run again leaves one whole file. Null content: an empty file; a null name is
    left out; of repeated names one stays."""
    base_url = folder if not folder.startswith("file:") else "file://" + folder.removeprefix("file:").removeprefix("//")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(base_url)
        for batch in batches:
            lengths, paths = [], []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = f"{base}/{name}"
                store.create_dir(target.rpartition("/")[0], recursive=True)
                own = f"{target.rpartition('/')[0]}/.{uuid.uuid4().hex}"
                with store.open_output_stream(own, compression=None) as out:
                    out.write(content or b"")
                store.move(own, target)
                lengths.append(len(content or b""))
                paths.append(f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string()), pa.array(lengths, pa.int64())], ["name", "path", "length"])

    return rows.where("name is not null").select("name", F.col("content").cast("binary").alias("content")).mapInArrow(put, "name string, path string, length long")
