"""A lock on written tables: a digest of every file, of every table and of all of them, so that a later check
reads again only the files that a listing shows to be others, and names the partitions whose rows differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.inventory import files_below

#: Digests of files that are joined into one digest at a time: a table's leaves are dealt into so many groups.
GROUPS = 256
SUMS = ("rows", "a", "b")


def _sums(df: DataFrame) -> list[Column]:
    """What no order of the rows changes: their number and two sums of row hashes (by position, so names don't matter)."""
    columns = [F.col(f"`{c}`") for c in df.columns if not c.startswith("__")]
    hashed = lambda *more: F.sum(F.xxhash64(*more, *columns).cast("decimal(38,0)"))
    return [F.count("*").alias("rows"), hashed().alias("a"), hashed(F.lit("second")).alias("b")]


def _read_leaves(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """(path, rows, a, b) of the files of a table, or of these of them. Rows are summed up in each task first."""
    df = spark.read.option("basePath", root).parquet(*(paths or [root]))
    held = df.select("*", F.col("_metadata.file_path").alias("__path"))
    return held.groupBy(F.col("__path").alias("path")).agg(*_sums(held))


def _or_none() -> list[Column]:
    """The sums of a file, which has none if it has no rows."""
    return [F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in zip(SUMS, ("long", "decimal(38,0)", "decimal(38,0)"), strict=True)]


def _listed(spark: SparkSession, name: str, root: str) -> DataFrame:
    """A table's data files: leaf is the path below its root, part the folders of that."""
    held = files_below(spark, root)
    return held.select(F.lit(name).alias("table"), "path", F.col("name").alias("leaf"), F.regexp_replace("name", "/?[^/]*$", "").alias("part"), "length", "modified")


def lock_leaves(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """A row for each file of the tables (name: folder of Parquet files): table, leaf, part, length, modified, and what stands
    for its rows: their number and two sums of hashes. Sums of files add up to those of their partition, so a partition
    whose rows were written again to other files is known by them. Write this table; its roots are the lock."""
    parts = []
    for name, root in sorted(tables.items()):
        own = _listed(spark, name, root).join(_read_leaves(spark, root), "path", "left")
        parts.append(own.select("table", "leaf", "part", "length", "modified", *_or_none()))
    return reduce(DataFrame.union, parts)


def lock_roots(leaves: DataFrame, versions: dict[str, str] | None = None) -> DataFrame:
    """(table, files, rows, digest) of each table, and with table null of all tables and the versions (name: value) that the
    lock pins. A table's digest is that of its leaves' in two steps, so no array is longer than its groups or a group."""
    line = F.concat_ws("|", "leaf", *[F.col(c).cast("string") for c in SUMS])
    groups = leaves.groupBy("table", F.pmod(F.xxhash64("leaf"), F.lit(GROUPS)).alias("g")).agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(line))), 256).alias("d"))
    roots = groups.groupBy("table").agg(F.sum("files").alias("files"), F.sum("rows").alias("rows"), F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws("|", F.col("g").cast("string"), "d")))), 256).alias("digest"))
    pinned = F.lit("\n".join(f"{k}={v}" for k, v in sorted((versions or {}).items())))
    whole = roots.agg(F.lit(None).cast("string").alias("table"), F.coalesce(F.sum("files"), F.lit(0).cast("long")).alias("files"), F.coalesce(F.sum("rows"), F.lit(0).cast("long")).alias("rows"), F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws("|", "table", "digest"))), pinned), 256).alias("digest"))
    return roots.union(whole)


def verify_lock(spark: SparkSession, lock: DataFrame, tables: dict[str, str], trust_listing: bool = True) -> DataFrame:
    """(table, leaf, part, expected, found, reread, status) of each file of a lock (lock_leaves) or of the tables now: expected
    and found are structs of rows, a and b. status: unchanged, rewritten (other bytes or time, the same rows), changed,
    missing or added.

    With trust_listing, files of the locked length and time are not read again; the paths of the others go through the
    driver, as Spark's own list of the files to scan does. Without it all are read.
    """
    sums = F.struct(*SUMS)
    parts = []
    for name, root in sorted(tables.items()):
        own = lock.where(F.col("table") == name).select("leaf", F.col("part").alias("old_part"), F.col("length").alias("old_length"), F.col("modified").alias("old_modified"), sums.alias("expected"))
        both = _listed(spark, name, root).join(own, "leaf", "full")
        same = (F.col("length") == F.col("old_length")) & (F.col("modified") == F.col("old_modified"))
        both = both.withColumns({"there": F.col("path").isNotNull(), "locked": F.col("expected").isNotNull(), "same": F.coalesce(same, F.lit(False))})
        both = both.withColumn("again", F.col("there") & ~(F.col("same") & F.lit(trust_listing)))
        again = [r.path for r in both.where("again").select("path").collect()]
        read = _read_leaves(spark, root, again) if again else spark.createDataFrame([], "path string, rows long, a decimal(38,0), b decimal(38,0)")
        out = both.join(read, "path", "left").select(*both.columns, F.struct(*_or_none()).alias("new"))
        found = F.when(F.col("again"), F.col("new")).when(F.col("there"), F.col("expected"))
        # The statuses of files.
        status = F.when(~F.col("there"), "missing").when(~F.col("locked"), "added").when(found != F.col("expected"), "changed").when(F.col("same"), "unchanged").otherwise("rewritten")
        parts.append(out.select(F.lit(name).alias("table"), "leaf", F.coalesce("part", "old_part").alias("part"), "expected", found.alias("found"), F.col("again").alias("reread"), status.alias("status")))
    gone = lock.where(~F.col("table").isin(*tables)).select("table", "leaf", "part", sums.alias("expected"), F.lit(None).cast(parts[0].schema["found"].dataType).alias("found"), F.lit(False).alias("reread"), F.lit("missing").alias("status"))
    return reduce(DataFrame.union, parts, gone)


def differing_parts(verified: DataFrame) -> DataFrame:
    """(table, part, files, reread, expected_rows, found_rows, passed) of each partition of a verified lock: it passes if the
    rows of its files, whichever they are now, are those that were locked."""
    total = lambda side, c: F.coalesce(F.sum(f"{side}.{c}"), F.lit(0).cast("long" if c == "rows" else "decimal(38,0)"))
    same = [total("expected", c) == total("found", c) for c in SUMS]
    return verified.groupBy("table", "part").agg(F.count("*").alias("files"), F.count_if("reread").alias("reread"), total("expected", "rows").alias("expected_rows"), total("found", "rows").alias("found_rows"), reduce(lambda x, y: x & y, same).alias("passed"))


def lock_checks(verified: DataFrame, audits: DataFrame, versions: dict[str, str], pinned: dict[str, str]) -> DataFrame:
    """D46 as a table (check, expected, found, passed): each table's partitions that must not differ, each audit (check, value, passed;
    contract_checks makes them) and each pinned version."""
    tables = differing_parts(verified).groupBy("table").agg(F.count_if(~F.col("passed")).alias("n")).select(F.concat(F.lit("table:"), "table").alias("check"), F.lit("0").alias("expected"), F.col("n").cast("string").alias("found"), (F.col("n") == 0).alias("passed"))
    own = audits.select(F.concat(F.lit("audit:"), "check").alias("check"), F.when(F.col("check") == "row_count", "> 0").otherwise("0").alias("expected"), F.col("value").cast("string").alias("found"), "passed")
    rows = [(f"version:{n}", pinned.get(n), versions.get(n), pinned.get(n) == versions.get(n)) for n in sorted({*pinned, *versions})]
    return tables.union(own).union(verified.sparkSession.createDataFrame(rows, "check string, expected string, found string, passed boolean"))


def preflight_checks(checks: DataFrame, roots: DataFrame, required: list[str]) -> DataFrame:
    """D64 as a table (check, passed): what must hold before anything is fitted: every check of the lock, and of each required
    table that it is locked and has rows. No checks at all do not pass."""
    lock = checks.agg(F.lit("contract_lock").alias("check"), F.coalesce(F.min("passed"), F.lit(False)).alias("passed"))
    need = roots.sparkSession.createDataFrame([(t,) for t in required], "table string").join(roots.select("table", "rows"), "table", "left")
    return lock.union(need.select(F.concat(F.lit("table:"), "table").alias("check"), (F.coalesce("rows", F.lit(0).cast("long")) > 0).alias("passed")))
