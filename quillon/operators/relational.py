"""Key lookups, de-duplication and unions with stated orders."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.scratch import stash


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key tuple, the first in the order (which ends in something unique)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def deduplicate(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key tuple, nulls being equal: the least by the other columns, so the same one every time.
    The least is a partial aggregate, so no key's rows gather in one task."""
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.distinct()
    least = df.groupBy(*keys).agg(F.min(F.struct(*others)).alias("__least"))
    return least.select(*keys, "__least.*").select(*df.columns)


def deduplication_summary(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Rows, distinct key tuples and rows beyond them."""
    per = df.groupBy(by, *[k for k in keys if k != by]).agg(F.count("*").alias("n"))
    return per.groupBy(by).agg(F.sum("n").alias("input_rows"), F.count("*").alias("distinct_rows"), (F.sum("n") - F.count("*")).alias("excess_rows"))


def longest_prefix(facts: DataFrame, code: str, prefixes: DataFrame, prefix: str, value: str) -> DataFrame:
    """Facts with the value of the longest prefix that their code starts with (ties: the least value), or null.

    Codes are joined by equality: each distinct code gives its own leading parts, of the lengths that prefixes have,
    and the longest part that is a prefix wins. Nothing is compared with every prefix.
    """
    table = prefixes.where(F.col(prefix).isNotNull() & (F.col(prefix) != "")).groupBy(F.col(prefix).alias("__lp_part")).agg(F.min(value).alias("__lp_value"))
    lengths = sorted(r[0] for r in table.select(F.length("__lp_part")).distinct().collect())
    if not lengths:
        return facts.withColumn(value, F.lit(None).cast(dict(prefixes.dtypes)[value]))
    codes = facts.select(F.col(code).alias("__lp_code")).where("__lp_code is not null").distinct()
    parts = codes.withColumn("__lp_part", F.explode(F.array(*[F.left("__lp_code", F.lit(n)) for n in lengths]))).distinct()
    best = parts.join(table, "__lp_part").groupBy("__lp_code").agg(F.max_by("__lp_value", F.length("__lp_part")).alias(value))
    return facts.join(best, F.col(code) == F.col("__lp_code"), "left").drop("__lp_code")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys whose nulls are equal."""
    named = right.select(*[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(named, on, how).drop(*[f"__{k}" for k in keys])


def tiered_lookup(facts: DataFrame, tiers: list[tuple[str, list[str], DataFrame]], value: str) -> DataFrame:
    """The value of the first tier that has one for a fact, and the tier's name. A tier is its name, key
    columns and a table of them with the value; of several rows of a key, the least value counts. Facts without a
    match stay, with nulls."""
    held = facts
    for i, (_, keys, table) in enumerate(tiers):
        own = table.where(F.col(value).isNotNull()).groupBy(*[F.col(k).alias(f"__k{i}_{k}") for k in keys]).agg(F.min(value).alias(f"__v{i}"))
        on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__k{i}_{k}") for k in keys])
        held = held.join(own, on, "left").drop(*[f"__k{i}_{k}" for k in keys])
    names = F.lit(None).cast("string")
    for i, (name, _, _) in reversed(list(enumerate(tiers))):
        names = F.when(F.col(f"__v{i}").isNotNull(), name).otherwise(names)
    out = held.withColumns({value: F.coalesce(*[F.col(f"__v{i}") for i in range(len(tiers))]), "matched_by": names})
    return out.drop(*[f"__v{i}" for i in range(len(tiers))])


def fill_unmapped(facts: DataFrame, mapping: DataFrame, key: str, value: str, method: str) -> DataFrame:
    """Facts (value, method) whose value is null get the mapping's, and how; others stay."""
    own = mapping.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min(value).alias("__value"))
    held = facts.join(own, F.col(key) == F.col("__key"), "left")
    fills = F.col(value).isNull() & F.col("__value").isNotNull()
    return held.withColumns({"method": F.when(fills, method).otherwise(F.col("method")), value: F.coalesce(value, "__value")}).drop("__key", "__value")


def union_by_name(tables: list[DataFrame], missing: bool = False) -> DataFrame:
    """All rows of all tables, columns by name. No table is an error."""
    if not tables:
        raise ValueError("nothing to unite")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=missing), tables)


def append_unseen(existing: DataFrame, new: DataFrame, keys: list[str], normal: Callable[[Column], Column] = lambda c: F.lower(F.trim(c))) -> DataFrame:
    """Existing rows, and the first of the new rows of each normalised key that existing lacks."""
    named = [f"__{k}" for k in keys]
    mark = lambda df: df.withColumns({n: F.coalesce(normal(F.col(k).cast("string")), F.lit("")) for n, k in zip(named, keys, strict=True)})
    fresh = mark(new).join(mark(existing).select(*named).distinct(), named, "left_anti")
    fresh = first_per_key(fresh, named, [F.col(c).asc_nulls_last() for c in new.columns])
    return existing.unionByName(fresh.select(*existing.columns))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join whose keys are unique on either side; a repeated key fails the job when it is read."""
    def checked(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(*keys)
        fault = F.raise_error(F.lit(f"a key repeats in the {name} table"))
        return df.withColumn("__n", F.count("*").over(w)).where(F.when(F.col("__n") > 1, fault.cast("boolean")).otherwise(F.lit(True))).drop("__n")

    return checked(left, "left").join(checked(right, "right"), keys)


def slice_rows(df: DataFrame, order: list[Column], start: int, end: int) -> DataFrame:
    """Rows start to end (from 1, both inclusive) in an order."""
    return df.orderBy(*order).offset(start - 1).limit(max(0, end - start + 1))


def row_ids(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A number for each row, without an order and without moving rows."""
    return df.withColumn(name, F.monotonically_increasing_id())


def dense_ids(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Df with a number for each row, from 0 without a gap, in the order of some columns (rows that agree in them come
    in any order). Rows are dealt to partitions by range and written; a row's number is its place there and the sum of
    the partitions before it, so no task sees more than its own partition."""
    held = stash(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ids")
    part, at = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = held.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    base = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__base"))
    return held.withColumn("__part", part).join(base, "__part").withColumn(name, F.col("__base") + at).drop("__part", "__at", "__base")


def unordered_pairs(df: DataFrame, group: str, item: str) -> DataFrame:
    """(group, a, b) for the distinct items a < b that share a group. A group's distinct items are sorted into an
    array once, and each meets those behind it: no self-join, and a group's items are bounded by its vocabulary."""
    items = df.groupBy(group).agg(F.array_sort(F.collect_set(item)).alias("__items")).where(F.size("__items") > 1)
    first = items.select(group, "__items", F.posexplode("__items").alias("__at", "a"))
    rest = F.slice("__items", F.col("__at") + 2, F.size("__items"))
    return first.select(group, "a", F.explode(rest).alias("b"))


def cohort_extract(source: DataFrame, cohort: DataFrame, keys: dict[str, str], columns: list[str], row_filter: Column | None = None) -> DataFrame:
    """Rows of a source table whose trimmed keys are those of a cohort stay, once for each such stay. keys maps
    source columns to cohort columns; blank keys match nothing. The row filter and the column list come first."""
    held = source.where(row_filter) if row_filter is not None else source
    held = held.select(*dict.fromkeys([*columns, *keys]))
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    held = held.withColumns({f"__{i}": text(s) for i, s in enumerate(keys)})
    own = cohort.select("stay_id", *[text(c).alias(f"__c{i}") for i, c in enumerate(keys.values())]).distinct()
    on = reduce(lambda a, b: a & b, [F.col(f"__{i}") == F.col(f"__c{i}") for i in range(len(keys))])
    return held.join(own, on).select("stay_id", *columns)
