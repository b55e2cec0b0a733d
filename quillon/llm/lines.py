"""Line dedup over levelled sorted runs of line hashes.

A run is a table (key, n_docs, last_doc), bucketed and sorted by key, that one batch of documents wrote. Runs of a
level are compacted into one run of the next level whenever there are `fanout` of them, so that a lookup meets few
runs. Every bucket of two runs meets in one merge join without a shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, delete, drop_stash, fresh_name, fresh_path, small_parts, stash

RUN_SCHEMA = "key binary, n_docs long, last_doc long"


def line_key(line: str, min_chars: int) -> bytes | None:
    """128-bit hash of the line without white space at its ends, A-Z lower-cased; None if it is too short to count."""
    line = line.strip(WHITE)
    return xxhash.xxh3_128_digest(line.encode().lower()) if len(line) >= min_chars else None


class LineRuns:
    """The runs written so far. Lookups see every batch that was added before."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 4) -> None:
        """buckets: of each run, by default as many as the session's shuffles have partitions, so that a task writes one."""
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def _write(self, rows: DataFrame) -> str:
        """rows are dealt by key into as many partitions as buckets."""
        name = f"line_run_{uuid.uuid4().hex}"
        path = fresh_path(self.spark, name)
        writer = rows.select("key", "n_docs", "last_doc").write.bucketBy(self.buckets, "key").sortBy("key")
        writer.option("path", path).saveAsTable(name)
        self.paths[name] = path
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def merged(self, names: list[str] | None = None) -> DataFrame:
        """Runs (all by default) as one: a key's counts added up, its largest document. The files are read as they
        are: over a union of bucketed tables, Spark 4.1.2 groups each table on its own."""
        names = [n for level in self.levels for n in level] if names is None else names
        if not names:
            return self.spark.createDataFrame([], RUN_SCHEMA)
        rows = self.spark.read.schema(RUN_SCHEMA).parquet(*[self.paths[n] for n in names])
        if len(names) == 1:
            return rows
        return rows.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows whose key no run holds: a merge anti-join with each run."""
        for run in self.runs():
            keys = keys.join(run.hint("merge").select("key"), "key", "left_anti")
        return keys

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch of (doc_id, key) as a run of level 0, then compact full levels. Returned are the batch's lines that
        are not the first of their key: a merge anti-join of the new run with the runs before it tells the keys that no
        earlier batch held, and such a key's first line is the one in its largest document. Documents of one id belong
        in one batch; a key repeated in a document counts once."""
        held = lines.select("key", "doc_id").distinct()
        # Counted in part before the shuffle, so that a line of very many documents is a row a task.
        own = held.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        even = self.buckets == int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = self._write(own if even else own.repartition(self.buckets, "key"))
        first = self.unseen(self.spark.table(name)).select("key", F.col("last_doc").alias("doc_id"))
        repeats = stash(held.join(first, ["key", "doc_id"], "left_anti"), "repeats")
        self.levels[0].append(name)
        self.compact()
        return repeats

    def drop(self, names: list[str] | None = None) -> None:
        """Delete runs (all by default): their tables and their files."""
        for name in [n for level in self.levels for n in level] if names is None else names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, self.paths.pop(name))
        if names is None:
            self.levels = [[]]

    def compact(self) -> None:
        for depth, full in enumerate(self.levels):
            if len(full) >= self.fanout:
                whole = self._write(self.merged(full).repartition(self.buckets, "key"))
                self.drop(full)
                self.levels[depth] = []
                if depth + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[depth + 1].append(whole)


def line_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20) -> DataFrame:
    """(doc_id, key) of each counting line, once a row of docs. Rows without an id give none."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches):
            ids, out = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {line_key(x, min_chars) for x in (t or "").split("\n")} - {None}
                ids += [i] * len(own)
                out += own
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "key"])
                    ids, out = [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "key"])

    held = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return held.mapInArrow(keys, "doc_id long, key binary")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 3, min_chars: int = 20, batches: int = 4, fanout: int = 4, buckets: int | None = None) -> DataFrame:
    """docs with the text's repeated lines taken out, and n_lines (before) and n_dropped.

    A line whose key of at least min_chars code points lies in min_docs documents or more stays only in the largest
    doc_id that holds it. The documents come in batches, those of the largest ids first: each batch writes its run,
    merge-anti-joins it with the runs before it, so that what is left of its lines are repeats of larger documents'
    lines, and levels are compacted as they fill. Whether a repeat goes depends on all batches' counts, so the repeats
    meet the runs once more at the end.

    Null or empty text: one empty line, kept (null becomes empty). Null doc_id: the row stays as it is and counts
    for nothing. Rows of the same id are one document: each drops the same keys. A column named n_lines or
    n_dropped in docs is replaced. No rows: none.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "lines")
    shares = [k / batches for k in range(1, batches)]
    cuts = sorted(set(docs.agg(F.percentile_approx(F.col(doc_id).cast("long"), shares)).first()[0] or [])) if shares else []
    batch_of = sum([(F.col("doc_id") <= c).cast("int") for c in cuts], F.lit(0))
    lines = line_keys(docs, doc_id, text, min_chars).withColumn("batch", batch_of)
    # A file has its batches one after the other, so that a batch's scan reads the pages that hold it.
    lines.sortWithinPartitions("batch").write.parquet(path)
    lines = spark.read.schema("doc_id long, key binary, batch int").parquet(path)
    store = LineRuns(spark, buckets, fanout)
    repeats = [store.add(lines.where(F.col("batch") == batch)) for batch in range(len(cuts) + 1)]
    common = store.merged().where(F.col("n_docs") >= min_docs).select("key")
    own_id, own_keys = fresh_name("id", docs), fresh_name("drops", docs)
    drops = reduce(DataFrame.union, repeats).join(common, "key")
    drops = stash(drops.groupBy(F.col("doc_id").alias(own_id)).agg(F.collect_set("key").alias(own_keys)), "drops")
    store.drop()
    drop_stash(lines, *repeats)
    held = docs.drop("n_lines", "n_dropped")
    width, at = len(held.columns), held.columns.index(text)
    schema = T.StructType([*held.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(parts):
            kept, before, gone = [], [], []
            for t, drop in zip(batch.column(at).to_pylist(), batch.column(width).to_pylist(), strict=True):
                all_lines = (t or "").split("\n")
                if drop:
                    drop = set(drop)
                    stay = [x for x in all_lines if line_key(x, min_chars) not in drop]
                else:
                    stay = all_lines
                kept.append("\n".join(stay))
                before.append(len(all_lines))
                gone.append(len(all_lines) - len(stay))
            columns = [*batch.columns[:width], pa.array(before, pa.int64()), pa.array(gone, pa.int64())]
            columns[at] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    joined = held.join(drops, held[doc_id] == drops[own_id], "left").drop(own_id)
    return joined.mapInArrow(cut, schema)


def dedup_batch(store: LineRuns, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20) -> DataFrame:
    """Incremental use, batch after batch: the (doc_id, key) lines of docs that no earlier batch held. The batch's
    own run is added after the merge anti-join, so a line stays in every document of the batch that first holds it."""
    lines = stash(line_keys(docs, doc_id, text, min_chars), "lines")
    new = stash(store.unseen(lines), "unseen")
    drop_stash(store.add(lines), lines)
    return new
