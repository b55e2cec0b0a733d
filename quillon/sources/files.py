"""Files in and out: text tables, bounded scans, atomic sinks, inventories and integrity."""

from __future__ import annotations

import ast
import csv
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes from which a table must be read with a limit.
LARGE_BYTES = 100 << 20


def header_of(path: str | Path) -> tuple[str, ...] | None:
    """The first row of a CSV file, plain or gzip; () for an empty file, None for another kind of file."""
    path = Path(path)
    names = path.name.lower()
    if not names.endswith((".csv", ".csv.gz")):
        return None
    opener = gzip.open if names.endswith(".gz") else open
    with opener(path, "rt", encoding="utf-8-sig", newline="") as f:
        return tuple(next(csv.reader(f), ()))


def text_schema(columns: Iterable[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def csv_text(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """A CSV file (gzip too) with every column as text. Without columns, Spark reads the header for their names."""
    reader = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').option("multiLine", False)
    return (reader.schema(text_schema(columns)) if columns is not None else reader).csv(path)


def inferred_schema(spark: SparkSession, path: str, sample: float = 1.0) -> T.StructType:
    """The types that a CSV file's values have."""
    return spark.read.option("header", True).option("inferSchema", True).option("samplingRatio", sample).csv(path).schema


def parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """One or many Parquet files or folders, those of write_atomic too, as one table. No path is an error."""
    if not paths:
        raise ValueError("no path")
    return spark.read.parquet(*[current(spark, p) for p in paths])


def bounded(df: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """Some columns of at most `limit` rows; both must be named."""
    if not columns or limit <= 0:
        raise ValueError("a bounded read names its columns and a positive limit")
    return df.select(*columns).limit(limit)


#: The file below a folder of write_atomic that names its current version.
POINTER = "CURRENT"


def _pointer(spark: SparkSession, path: str):
    """The file system of a path, and its pointer."""
    pointer = spark._jvm.org.apache.hadoop.fs.Path(path, POINTER)
    return pointer.getFileSystem(spark._jsc.hadoopConfiguration()), pointer


def current(spark: SparkSession, path: str) -> str:
    """The folder that a path's pointer names; the path itself if it has none."""
    store, pointer = _pointer(spark, path)
    return f"{path}/{spark.read.text(pointer.toString()).first()[0]}" if store.exists(pointer) else path


def write_atomic(df: DataFrame, path: str, partition_by: list[str] | None = None) -> int:
    """Write Parquet so that readers (parquet) see the old table or the new one, whole, at any time, and return
    its rows. Each write is a folder of its own below path; a pointer file, replaced in one step, names the one that
    counts. A failed job leaves the table as it was. The version before stays for readers that have begun; older go."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    store, pointer = _pointer(spark, path)
    before = current(spark, path).rpartition("/")[2] if store.exists(pointer) else None
    folder, name, seen = hadoop.Path(path), f"v-{uuid.uuid4().hex}", Observation()
    try:
        writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/{name}")
        staged = hadoop.Path(path, f"{POINTER}-{name}")
        out = store.create(staged)
        out.write(name.encode())
        out.close()
        rename = spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        how = spark._jvm.java.lang.reflect.Array.newInstance(rename, 1)
        how[0] = spark._jvm.java.lang.Enum.valueOf(rename, "OVERWRITE")
        hadoop.FileContext.getFileContext(folder.toUri(), spark._jsc.hadoopConfiguration()).rename(staged, pointer, how)
    except Exception:
        store.delete(hadoop.Path(path, name), True)
        if before is None:
            store.delete(folder, True)
        raise
    for file in store.listStatus(folder):
        if file.isDirectory() and file.getPath().getName().startswith("v-") and file.getPath().getName() not in (name, before):
            store.delete(file.getPath(), True)
    return seen.get["rows"]


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    """No rows of a schema."""
    return spark.createDataFrame([], schema)


def inside(root: str | Path, relative: str | Path, must_exist: bool = False) -> Path:
    """A path below root; one that leaves it is refused."""
    base = Path(root).resolve()
    path = (base / relative).resolve()
    if not path.is_relative_to(base):
        raise ValueError(f"{relative} leaves the data folder")
    if must_exist and not path.exists():
        raise FileNotFoundError(path)
    return path


def needs_limit(name: str, size: int, listed: Iterable[str] = (), large: int = LARGE_BYTES) -> bool:
    """Whether a table may only be read with a limit."""
    return name in set(listed) or size >= large


def inventory(root: str | Path, expected: dict[str, list[str]]) -> list[dict]:
    """Per source, the files there (size, kind, header) and those missing; contents are not read."""
    out = []
    for source, names in expected.items():
        folder = inside(root, source)
        there = {str(p.relative_to(folder)): p for p in sorted(folder.rglob("*")) if p.is_file()} if folder.exists() else {}
        out.append({
            "source": source,
            "files": [{"path": n, "bytes": p.stat().st_size, "suffix": "".join(p.suffixes), "header": header_of(p)} for n, p in there.items()],
            "missing": sorted(set(names) - set(there)),
            "has_checksums": any("sha256" in n.lower() for n in there),
        })
    return out


def checksums(text: str) -> dict[str, str]:
    """`digest path` lines."""
    rows = (line.split(None, 1) for line in text.splitlines() if line.strip())
    return {path.strip().lstrip("*").removeprefix("./"): digest.lower() for digest, path in rows}


def gzip_state(path: str | Path, chunk: int = 1 << 20) -> tuple[str, int]:
    """Ok, truncated or corrupt, and the bytes read before that."""
    n = 0
    try:
        with gzip.open(path, "rb") as f:
            while data := f.read(chunk):
                n += len(data)
    except EOFError:
        return "truncated", n
    except (OSError, ValueError) as e:
        return ("corrupt", n) if not isinstance(e, FileNotFoundError) else ("missing", 0)
    except Exception as e:  # zlib.error has no common base
        if type(e).__name__ != "error":
            raise
        return "corrupt", n
    return "ok", n


def opened(url: str) -> pa.NativeFile:
    """A stream of a file as it is stored, by its path as Hadoop writes it (file:, or what Arrow knows; not encoded)."""
    if url.startswith("file:"):
        url = "file://" + url.removeprefix("file:").removeprefix("//")
    store, path = fs.FileSystem.from_uri(quote(url, safe="/:@"))
    return store.open_input_stream(path, compression=None)


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, length) of every file below root, empty ones too; contents are not read. name is below root."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    listing, rows = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(folder, True), []
    while listing.hasNext():
        file = listing.next()
        path = file.getPath().toString()
        rows.append((path, path.rpartition(f"{root.rstrip('/')}/")[2], file.getLen()))
    return spark.createDataFrame(rows, "path string, name string, length long")


def file_headers(files: DataFrame) -> DataFrame:
    """S04 for many files: (name, header) of the CSV files, plain or gzip, among files (path, name): the first line's cells,
    none in an empty file. Tasks read the first lines only."""

    def read(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            cells = []
            for path in batch.column("path").to_pylist():
                with opened(path) as raw:
                    text = io.TextIOWrapper(gzip.open(raw) if path.lower().endswith(".gz") else raw, "utf-8-sig", newline="")
                    cells.append(next(csv.reader(text), []))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(cells, pa.list_(pa.string()))], ["name", "header"])

    own = files.where(F.lower("name").rlike(r"\.csv(\.gz)?$"))
    return own.select("path", "name").mapInArrow(read, "name string, header array<string>")


def integrity(spark: SparkSession, root: str, manifest: dict[str, str], chunk: int = 1 << 20) -> DataFrame:
    """A row for each file below root and each listed one: its length, SHA-256, gzip state and status. Tasks stream the
    files in portions, each twice if it is gzip; a file of any size takes no more memory."""

    def check(batches):
        for batch in batches:
            digests, states = [], []
            for path in batch.column("path").to_pylist():
                sha = hashlib.sha256()
                with opened(path) as raw:
                    while data := raw.read(chunk):
                        sha.update(data)
                digests.append(sha.hexdigest())
                state = "not_gzip"
                if path.endswith(".gz"):
                    try:
                        with opened(path) as raw, gzip.open(raw) as f:
                            while f.read(chunk):
                                pass
                        state = "ok"
                    except EOFError:
                        state = "truncated"
                    except (OSError, ValueError, zlib.error):
                        state = "corrupt"
                states.append(state)
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("length"), pa.array(digests, pa.string()), pa.array(states, pa.string())], ["name", "length", "sha256", "gzip_state"])

    files = listed_files(spark, root)
    found = files.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path").mapInArrow(check, "name string, length long, sha256 string, gzip_state string")
    found = found.withColumn("gzip_state", F.when((F.col("length") == 0) & (F.col("gzip_state") != "not_gzip"), "truncated").otherwise(F.col("gzip_state")))
    listed = spark.createDataFrame(sorted(manifest.items()), "name string, expected string")
    out = found.join(listed, "name", "full")
    # The names of statuses.
    status = F.when(F.col("sha256").isNull(), "missing_file").when(F.col("expected").isNull(), "not_listed").when(F.col("sha256") == F.col("expected"), "verified").otherwise("checksum_mismatch")
    return out.select("name", "length", "sha256", "gzip_state", status.alias("status"))


def flexible_table(spark: SparkSession, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """A text table with comma, tab, pipe or semicolon, whose columns may have other names: aliases maps a column to
    the names it may have. A column without any of them is null."""
    first = (spark.read.text(path).limit(1).collect() or [[""]])[0][0]
    mark = max(",\t|;", key=first.count)
    df = spark.read.option("header", True).option("sep", mark).csv(path)
    named = {c.strip().lower(): c for c in df.columns}
    pick = lambda names: next((F.col(f"`{named[n.lower()]}`") for n in names if n.lower() in named), F.lit(None).cast("string"))
    return df.select(*[pick([c, *names]).alias(c) for c, names in aliases.items()])


def rrf(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A pipe-delimited text without header, each line ending in a pipe; every value stays as it is written."""
    parts = F.split("value", r"\|", -1)
    return spark.read.text(path).select(*[F.get(parts, i).alias(c) for i, c in enumerate(columns)])


def dict_literal(spark: SparkSession, text: str, key: str, value: str) -> DataFrame:
    """A Python dict literal as a two-column table."""
    rows = [(str(k), str(v)) for k, v in ast.literal_eval(text).items()]
    return spark.createDataFrame(rows, f"{key} string, {value} string")


def category_csv(spark: SparkSession, path: str) -> DataFrame:
    """Codes with a default category and, where that is blank, the first listed one; quotes are single."""
    raw = spark.read.option("header", True).option("quote", "'").csv(path)
    clean = lambda i: F.nullif(F.trim(F.regexp_replace(F.col(f"`{raw.columns[i]}`"), "[\"']", "")), F.lit(""))
    return raw.select(clean(0).alias("code"), F.coalesce(clean(1), clean(2)).alias("category")).where("code is not null and category is not null")


def single_level_csv(spark: SparkSession, path: str) -> DataFrame:
    """Code, category and label after a note line and a header; blank and zero categories are left out."""
    lines = spark.read.text(path)
    cells = F.from_csv("value", "code string, category string, label string", {"quote": "'"})
    rows = lines.select(cells.alias("r")).select(*[F.trim(F.regexp_replace(f"r.{c}", "[\"']", "")).alias(c) for c in ("code", "category", "label")])
    return rows.where("category is not null and category not in ('', '0') and code <> '' and category rlike '^[0-9]+$'")


def crosswalk_text(spark: SparkSession, path: str) -> DataFrame:
    """Source code, target code and five flags (approximate, no map, combination, scenario, choice) in columns of
    white space; rows without a map are left out."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.get(p, 0).alias("source_code"), F.get(p, 1).alias("target_code"), F.get(p, 2).alias("flags"))
    return rows.where("substring(flags, 2, 1) <> '1'").select("source_code", "target_code", (F.substring("flags", 1, 1) == "1").alias("approximate"))


def range_lookup(facts: DataFrame, key: str, ranges: DataFrame, low: str, high: str, value: str) -> DataFrame:
    """Facts with the value of the range [low, high] that holds their key (of several, the least value), or null. The
    distinct keys meet the ranges, which are few and broadcast only if Spark finds them small."""
    keys = facts.select(F.col(key).alias("__key")).where("__key is not null").distinct()
    own = keys.join(ranges, (F.col("__key") >= F.col(low)) & (F.col("__key") <= F.col(high))).groupBy("__key").agg(F.min(value).alias(value))
    return facts.join(own, F.col(key) == F.col("__key"), "left").drop("__key")
