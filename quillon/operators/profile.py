"""Table profiles, key checks and gates."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.exprs import nonblank, number


@dataclass(frozen=True)
class ColumnSpec:
    """What a text column should hold: kind text, number or timestamp; numbers may have bounds."""

    name: str
    kind: str = "text"
    low: float | None = None
    high: float | None = None


def profile_columns(df: DataFrame, specs: list[ColumnSpec], approximate: bool = True) -> DataFrame:
    """One pass over the table, then a row for each column: rows, blanks, distinct values, parse failures, least,
    largest and mean number, and numbers out of bounds."""
    aggregates: list[Column] = [F.count("*").alias("rows")]
    for i, s in enumerate(specs):
        c = F.col(s.name).cast("string")
        filled = nonblank(c)
        value = number(c) if s.kind == "number" else F.lit(None).cast("double")
        parsed = {"number": value, "timestamp": c.try_cast("timestamp_ntz")}.get(s.kind, c)
        distinct = F.approx_count_distinct(F.when(filled, c)) if approximate else F.count_distinct(F.when(filled, c))
        outside = reduce(lambda a, b: a | b, [(value < s.low) if s.low is not None else F.lit(False), (value > s.high) if s.high is not None else F.lit(False)])
        aggregates += [F.count_if(~filled).alias(f"blank_{i}"), distinct.alias(f"distinct_{i}"), F.count_if(filled & parsed.isNull()).alias(f"failed_{i}"), F.min(value).alias(f"least_{i}"), F.max(value).alias(f"largest_{i}"), F.round(F.avg(value), 6).alias(f"mean_{i}"), F.count_if(outside).alias(f"outside_{i}")]
    fields = ["blank", "distinct", "failed", "least", "largest", "mean", "outside"]
    one = df.agg(*aggregates)
    parts = [F.struct(F.lit(s.name).alias("column_name"), F.col("rows").alias("row_count"), *[F.col(f"{f}_{i}").alias(f) for f in fields]) for i, s in enumerate(specs)]
    return one.select(F.inline(F.array(*parts)))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of more than one row, their rows, and the rows beyond the first of each."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    many = F.col("n") > 1
    total = lambda c: F.coalesce(F.sum(F.when(many, c)), F.lit(0))
    return n.agg(F.count_if(many).alias("duplicate_groups"), total(F.col("n")).alias("duplicate_rows"), total(F.col("n") - 1).alias("excess_rows"))


def foreign_key(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of the child, null keys, and orphans against the parent's distinct keys."""
    known = parent.select(F.col(parent_key).alias("__key")).where("__key is not null").distinct()
    joined = child.select(key).join(known, F.col(key) == F.col("__key"), "left")
    return joined.agg(F.count("*").alias("row_count"), F.count_if(F.col(key).isNull()).alias("null_keys"), F.count_if(F.col(key).isNotNull() & F.col("__key").isNull()).alias("orphans"))


def schema_rows(df: DataFrame) -> DataFrame:
    """Names and types from the schema alone; no row is read."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position long, column_name string, column_type string")


def one_version(tables: list[DataFrame], column: str, declared: str | None = None, fallback: str | None = None) -> str | None:
    """The version that all tables carry; several, or another than declared, is an error. At most two values
    are fetched."""
    held = [t.select(column).where(F.col(column).isNotNull()) for t in tables if column in t.columns]
    found = [r[0] for r in reduce(DataFrame.union, held).distinct().limit(2).collect()] if held else []
    if len(found) > 1:
        raise ValueError(f"several versions of {column}: {sorted(found)}")
    if found and declared is not None and found[0] != declared:
        raise ValueError(f"{column} is {found[0]}, not {declared}")
    return found[0] if found else declared if declared is not None else fallback


def quality_findings(profile: list[dict], null_rate: float = 0.5) -> list[dict]:
    """What a profile's rows give reason to look at."""
    out = []
    for r in profile:
        n = r["row_count"]
        if not n:
            out.append({"column": r["column_name"], "issue": "empty_table"})
            continue
        if r["blank"] / n >= null_rate:
            out.append({"column": r["column_name"], "issue": "high_null_rate", "rate": r["blank"] / n})
        out += [{"column": r["column_name"], "issue": issue, "rows": r[field]} for field, issue in (("failed", "parse_failures"), ("outside", "out_of_bounds")) if r[field]]
    return out


def findings(profile: DataFrame, null_rate: float = 0.5) -> DataFrame:
    """D59 as a table: (column_name, issue, rows, rate) of what a profile (profile_columns) gives reason to look at."""
    c, n = F.col, F.col("row_count").cast("double")
    one = lambda when, issue, rows: F.when(when, F.struct(F.lit(issue).alias("issue"), rows.cast("long").alias("rows"), F.try_divide(rows.cast("double"), n).alias("rate")))
    some = c("row_count") > 0
    issues = F.array(one(~some, "empty_table", F.lit(0)), one(some & (c("blank") / n >= null_rate), "high_null_rate", c("blank")), one(some & (c("failed") > 0), "parse_failures", c("failed")), one(some & (c("outside") > 0), "out_of_bounds", c("outside")))
    return profile.select("column_name", F.inline(F.array_compact(issues)))


def domain_readiness(tables: dict[str, bool], domains: dict[str, list[str]]) -> dict[str, str]:
    """A domain is ready if all its tables passed, blocked if none did, else partial."""
    out = {}
    for name, needs in domains.items():
        passed = sum(tables.get(t, False) for t in needs)
        out[name] = "ready" if needs and passed == len(needs) else "partial" if passed else "blocked"
    return out


def table_gate(table: str, quality: dict[str, str], integrity: dict[str, str], enforce: bool = True) -> tuple[bool, str]:
    """Whether a table may be extracted, and why not."""
    if not enforce:
        return True, "not_enforced"
    for report, passed, name in ((quality, ("completed", "passed"), "quality"), (integrity, ("verified", "passed"), "integrity")):
        if report.get(table) not in passed:
            return False, f"blocked_by_{name}:{report.get(table, 'missing')}"
    return True, "passed"


def status_counts(results: list[dict]) -> dict[str, int]:
    """A35."""
    return dict(Counter(r["status"] for r in results))
