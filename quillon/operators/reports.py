"""Gates, readiness and column contracts as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contract import SAFE_KINDS, UNSAFE

# The states that pass.
QUALITY_PASSED, INTEGRITY_PASSED = ("completed", "passed"), ("verified", "passed")


def status_counts(results: DataFrame, by: list[str]) -> DataFrame:
    """(column, value, files) of each value of the columns `by` of a report's rows; nulls count as a value."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in by])
    return results.select(F.inline(each)).groupBy("column", "value").agg(F.count("*").alias("files"))


def group_coverage(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of each value of the columns `by` and each kind of group (with a positive, or without one): the groups, their rows
    and their positives. Two groupings, the first by group."""
    per = rows.groupBy(*by, "group_id").agg(F.count("*").alias("n"), F.count_if("label").alias("p"))
    kind = F.when(F.col("p") > 0, "positive").otherwise("zero_positive")
    return per.groupBy(*by, kind.alias("kind")).agg(F.count("*").alias("groups"), F.sum("n").alias("rows"), F.sum("p").alias("positives"))


def table_gates(tables: DataFrame, quality: DataFrame, integrity: DataFrame, enforce: bool = True) -> DataFrame:
    """(table_name, quality, integrity, ready, reason) of each table_name: what the reports (table_name, status) say, the
    least status of several; a table that a report lacks is "missing" in it. Not enforced, all are ready."""
    one = lambda report, name: report.groupBy("table_name").agg(F.min("status").alias(name))
    held = tables.select("table_name").distinct().join(one(quality, "quality"), "table_name", "left").join(one(integrity, "integrity"), "table_name", "left")
    held = held.withColumns({c: F.coalesce(c, F.lit("missing")) for c in ("quality", "integrity")})
    if not enforce:
        return held.withColumns({"ready": F.lit(True), "reason": F.lit("not_enforced")})
    good, whole = F.col("quality").isin(*QUALITY_PASSED), F.col("integrity").isin(*INTEGRITY_PASSED)
    reason = F.when(~good, F.concat(F.lit("blocked_by_quality:"), "quality")).when(~whole, F.concat(F.lit("blocked_by_integrity:"), "integrity")).otherwise("passed")
    return held.withColumns({"ready": good & whole, "reason": reason})


def domain_readiness(domains: DataFrame, tables: DataFrame) -> DataFrame:
    """(domain, tables, passed, status) of each domain, from the tables it needs (domain, table_name) and their gates
    (table_name, ready): ready if all are, blocked if none is, else partial. An unknown table is not ready; a domain that
    needs none (table_name null) is blocked."""
    gates = tables.groupBy("table_name").agg(F.min("ready").alias("ready"))
    held = domains.select("domain", "table_name").distinct().join(gates, "table_name", "left")
    out = held.groupBy("domain").agg(F.count("table_name").alias("tables"), F.count_if(F.coalesce("ready", F.lit(False))).alias("passed"))
    return out.withColumn("status", F.when((F.col("tables") > 0) & (F.col("passed") == F.col("tables")), "ready").when(F.col("passed") > 0, "partial").otherwise("blocked"))


def claim_gate(manifests: DataFrame, required: list[str]) -> DataFrame:
    """One row (claim, faults): whether results on the external source may be claimed, by the manifests (name, status,
    positive_groups): each required one must be there and completed, and the first must have positive groups."""
    need = manifests.sparkSession.createDataFrame([(n, i) for i, n in enumerate(required)], "name string, place int")
    held = need.join(manifests.groupBy("name").agg(F.min("status").alias("status"), F.max("positive_groups").alias("groups"), F.lit(True).alias("there")), "name", "left")
    state = F.when(F.col("there").isNull(), "missing").otherwise(F.coalesce("status", F.lit("unknown")))
    fault = F.when(state != "completed", F.concat("name", F.lit(":"), state)).when((F.col("place") == 0) & (F.coalesce("groups", F.lit(0)) == 0), F.concat("name", F.lit(":no_positive_groups")))
    out = held.agg(F.array_sort(F.collect_list(fault)).alias("faults"))
    return out.select(F.when(F.size("faults") == 0, "allowed").otherwise("blocked").alias("claim"), "faults")


def _unsafe(name: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(name).rlike(p) for p in UNSAFE])


def column_decisions(df: DataFrame, allowed: list[str], requested: list[str] | None = None, dynamic: bool = False) -> DataFrame:
    """(column_name, role, decision) of every column of df and every requested one (all are, by default): projected;
    refused_unsafe, for a name that a model must not see, listed or not; refused_not_listed; absent; or not_requested. With
    dynamic, safe numbers and booleans count as listed. Rows are columns: no data is read."""
    spark = df.sparkSession
    kinds = dict(df.dtypes)
    wanted = set(df.columns) if requested is None else set(requested)
    rows = [(n, kinds.get(n), n in set(allowed), n in wanted) for n in dict.fromkeys([*df.columns, *(requested or [])])]
    held = spark.createDataFrame(rows, "column_name string, kind string, listed boolean, requested boolean")
    name, low = F.col("column_name"), F.lower("column_name")
    # The roles of columns.
    role = F.when(F.startswith(low, F.lit("label")), "label").when(low.isin("source", "split"), "partition").when(low.rlike(UNSAFE[0]), "identifier").when(F.endswith(low, F.lit("_version")), "provenance").when(_unsafe(name), "excluded").otherwise("feature")
    fine = F.col("listed") | (F.lit(dynamic) & F.coalesce(F.col("kind").isin(*SAFE_KINDS), F.lit(False)))
    decision = F.when(F.col("kind").isNull(), "absent").when(~F.col("requested"), "not_requested").when(_unsafe(name), "refused_unsafe").when(fine, "projected").otherwise("refused_not_listed")
    return held.select("column_name", role.alias("role"), decision.alias("decision"))


def projected(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """df's columns that the decisions project, in its own order. As many names as df has columns come to the driver."""
    keep = {r.column_name for r in decisions.where("decision = 'projected'").collect()}
    return df.select(*[c for c in df.columns if c in keep])
