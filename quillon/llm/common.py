"""Helpers that the corpus operators share: shared-folder tables, whole-text Arrow access, grouped streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.scratch import clear_scratch, delete, drop_stash, fresh_path, shared_folder, stash  # noqa: F401  the operators' own names for them

#: ASCII white space that ends a word in every contract here.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches (of at most 64 MB by Spark's own default) in slices of a few rows: rows are whole texts here, and
    what Python makes of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fresh_name(name: str, *frames: DataFrame) -> str:
    """name, or the first of name_1, name_2 ... that no column of the frames has (in any case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    return next(n for n in (name, *(f"{name}_{k}" for k in range(1, len(taken) + 2))) if n.lower() not in taken)


def hash_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """At most `rows` rows, about those of the least hashes of the keys (all, if there are no more): the same rows in
    every run. A threshold on the hash comes first, so that no task hands on more than its share."""
    total = df.count()
    h = F.pmod(F.xxhash64(*keys), F.lit(1 << 30))
    if total > rows:
        df = df.where(h < int((1 << 30) * min(1.0, 1.05 * rows / total + 20 / total)))
    return df.orderBy(h, *keys).limit(rows)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """A string column's rows as UTF-8; null reads as empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def grouped_rows(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows of equal keys, over batch borders. The input is sorted by the keys within its partition."""
    held: list[pa.RecordBatch] = []
    current: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        start = 0
        rows = list(zip(*columns, strict=True))
        for i, key in enumerate(rows):
            if key != current:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield current, pa.Table.from_batches(held)
                held, start, current = [], i, key
        held.append(batch.slice(start))
    if held:
        yield current, pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups of equal (long or int) keys, of `rows` rows or somewhat more. The input is sorted by the keys
    within its partition."""
    held: list[pa.RecordBatch] = []
    n, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
        new = np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1
        at = int(new[-1]) if len(new) else 0
        if n + at >= rows and (at or tuple(own[0]) != last):
            held.append(batch.slice(0, at))
            yield pa.Table.from_batches(held)
            held, n, batch = [], 0, batch.slice(at)
        held.append(batch)
        n, last = n + batch.num_rows, tuple(own[-1])
    if held:
        yield pa.Table.from_batches(held)
