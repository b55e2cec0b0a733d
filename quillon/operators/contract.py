"""What a model may see, and a lock on the data it was trained on."""

from __future__ import annotations

import hashlib
import json
import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of columns that a model must not see: identifiers, raw text and codes, outcomes, times.
UNSAFE = (r"(^|_)(id|uid|uids|key)$", r"(^|_)(text|note|name|raw|code|codes)($|_)", r"(^|_)(expire|death|mortality|outcome|discharge)($|_)", r"(^|_)(time|date|timestamp)$", r"^label")
SAFE_KINDS = ("double", "float", "int", "bigint", "smallint", "boolean")


def is_unsafe(name: str) -> bool:
    """P27."""
    return any(re.search(p, name.lower()) for p in UNSAFE)


def approved_columns(df: DataFrame, allowed: list[str] | None = None, dynamic: bool = False) -> list[str]:
    """Allow-listed columns that the table has, and with dynamic its numeric and boolean columns that are safe."""
    own = [c for c in allowed or [] if c in df.columns and not is_unsafe(c)]
    if dynamic:
        own += [n for n, t in df.dtypes if t in SAFE_KINDS and not is_unsafe(n) and n not in own]
    return own


def checked_columns(df: DataFrame, requested: list[str], allowed: list[str] | None = None, dynamic: bool = False) -> list[str]:
    """The requested columns; one that is not approved is an error."""
    bad = sorted(set(requested) - set(approved_columns(df, allowed, dynamic)))
    if bad:
        raise ValueError(f"columns that are not approved: {bad}")
    return requested


def column_role(name: str) -> str:
    """P29."""
    low = name.lower()
    if low.startswith("label"):
        return "label"
    if low in ("source", "split"):
        return "partition"
    if re.search(UNSAFE[0], low):
        return "identifier"
    if low.endswith("_version"):
        return "provenance"
    return "excluded" if is_unsafe(low) else "feature"


def vocabularies(rows: DataFrame, context: DataFrame, fit: str = "train") -> DataFrame:
    """(vocabulary, token, token_index) of conditions, candidates, context tokens and event types of the fitting
    split, numbered from 0 in text order. A vocabulary is one window's work, as long as it is a vocabulary."""
    own = rows.where(F.col("split") == fit)
    seen = context.join(own.select("stay_id").distinct(), "stay_id", "left_semi")
    parts = [own.select(F.lit("condition").alias("vocabulary"), F.col("condition").alias("token")), own.select(F.lit("candidate"), "candidate"), seen.select(F.lit("context"), F.concat("event_type", F.lit("|"), "token")), seen.select(F.lit("event_type"), "event_type")]
    tokens = reduce(DataFrame.union, parts).where("token is not null").distinct()
    return tokens.withColumn("token_index", (F.row_number().over(Window.partitionBy("vocabulary").orderBy("token")) - 1).cast("long"))


def data_dictionary(tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each column of each table, with its type and role; from schemas alone."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, i, f.name, f.dataType.simpleString(), column_role(f.name)) for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, position long, column_name string, column_type string, role string")


def split_alignment(artifact: DataFrame, manifest: DataFrame, key: str = "patient_id") -> DataFrame:
    """Rows of an artifact whose split is the manifest's, another, or whose key it lacks."""
    own = manifest.select(F.col(key).alias("__key"), F.col("split").alias("__split")).distinct()
    held = artifact.join(own, F.col(key) == F.col("__key"), "left")
    same = F.col("split") == F.col("__split")
    return held.agg(F.count("*").alias("row_count"), F.count_if(F.coalesce(same, F.lit(False))).alias("aligned"), F.count_if(F.coalesce(~same, F.lit(False))).alias("misaligned"), F.count_if(F.col("__key").isNull()).alias("unknown"))


def leakage_audit(events: DataFrame, labels: DataFrame, predict: float, label: float) -> DataFrame:
    """Input events after the prediction or without a time, and labels outside (predict, label]."""
    a = events.agg(F.count_if(F.coalesce(F.col("hours") > predict, F.lit(False))).alias("events_after_prediction"), F.count_if(F.col("hours").isNull()).alias("events_without_time"))
    b = labels.agg(F.count_if(F.coalesce((F.col("first_hours") <= predict) | (F.col("first_hours") > label), F.lit(True))).alias("labels_outside_window"))
    return a.crossJoin(b)


def schema_digest(df: DataFrame) -> str:
    return hashlib.sha256(df.schema.json().encode()).hexdigest()


def content_digest(df: DataFrame) -> str:
    """A digest of a table's rows that no order changes: their number and two sums of row hashes."""
    row = df.select(F.xxhash64(*df.columns).alias("a"), F.xxhash64(F.lit("second"), *df.columns).alias("b")).agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
    return hashlib.sha256("|".join(str(x) for x in row).encode()).hexdigest()


def contract_lock(tables: dict[str, DataFrame], versions: dict[str, str], audits: dict[str, DataFrame], expected: dict | None = None) -> dict:
    """Rows, schemas, contents and versions of the training tables, what the audits found, and one digest of it all.
    An audit is one row (more are an error), whose values must be 0 but for row counts. Against an expected lock, what
    differs is named. operators/lock.py locks tables file by file."""
    faults = []
    for name, df in audits.items():
        found = df.limit(2).collect()
        if len(found) > 1:
            raise ValueError(f"audit {name} has more than one row")
        for row in found:
            faults += [f"{name}:{k}={v}" for k, v in row.asDict().items() if v and k not in ("row_count", "aligned")]
    own = {name: {"rows": df.count(), "schema": schema_digest(df), "content": content_digest(df)} for name, df in sorted(tables.items())}
    lock = {"tables": own, "versions": dict(sorted(versions.items())), "faults": sorted(faults)}
    lock["digest"] = hashlib.sha256(json.dumps(lock, sort_keys=True).encode()).hexdigest()
    differs = []
    if expected is not None:
        differs = [f"table:{n}" for n in sorted({*own, *expected["tables"]}) if own.get(n) != expected["tables"].get(n)]
        differs += [f"version:{n}" for n in sorted({*versions, *expected["versions"]}) if versions.get(n) != expected["versions"].get(n)]
        differs += ["contract_digest_mismatch"] if lock["digest"] != expected["digest"] else []
    return lock | {"differs": differs, "status": "failed" if faults or differs else "passed"}


def contract_checks(rows: DataFrame, manifest: DataFrame, events: DataFrame, labels: DataFrame, predict: float, label: float) -> DataFrame:
    """D46's own checks as a table (check, value, passed): ranking rows there are, their keys unique, their splits the
    manifest's, every group of one patient split, and no input event or label outside its window."""
    counts = lambda df, names: df.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.col(c).cast("long").alias("value")) for n, c in names.items()])))
    keys = rows.groupBy("group_id", "candidate").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("n") > 1).alias("repeated"))
    parts = [
        counts(keys, {"row_count": "rows", "repeated_keys": "repeated"}),
        counts(split_alignment(rows.select("patient_id", "split").distinct(), manifest), {"misaligned_patients": "misaligned", "unknown_patients": "unknown"}),
        counts(leakage_audit(events, labels, predict, label), {n: n for n in ("events_after_prediction", "events_without_time", "labels_outside_window")}),
    ]
    return reduce(DataFrame.union, parts).withColumn("passed", F.when(F.col("check") == "row_count", F.col("value") > 0).otherwise(F.col("value") == 0))


def preflight(lock: dict, required: list[str]) -> list[str]:
    """What forbids fitting: a failed lock, or a table it lacks or that is empty."""
    out = [] if lock.get("status") == "passed" else ["contract_lock_not_passed"]
    return out + [f"missing_or_empty:{t}" for t in required if not lock.get("tables", {}).get(t, {}).get("rows")]


def external_readiness(primary: dict | None, sensitivity: dict | None) -> dict:
    """Whether results on the external source may be claimed: both manifests there, complete and evaluable."""
    faults = [f"{name}:{'missing' if m is None else m.get('status', 'unknown')}" for name, m in (("primary", primary), ("sensitivity", sensitivity)) if m is None or m.get("status") != "completed"]
    faults += ["primary:no_positive_groups"] if primary and not primary.get("positive_groups") else []
    return {"claim": "blocked" if faults else "allowed", "faults": faults}
