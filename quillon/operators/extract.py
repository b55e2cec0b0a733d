"""Source tables cut to a cohort, table by table, behind their gates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from quillon.functions.exprs import with_provenance
from quillon.sources.files import write_atomic

from .profile import table_gate
from .relational import cohort_extract


@dataclass(frozen=True)
class ExtractSpec:
    """A source table: its columns to keep, how its keys are called in the cohort, and which rows count."""

    table: str
    columns: list[str]
    keys: dict[str, str]
    row_filter: Column | None = None
    required: list[str] = field(default_factory=list)


def missing_columns(df: DataFrame, spec: ExtractSpec) -> list[str]:
    """Columns that the spec needs and the table lacks."""
    return [c for c in dict.fromkeys([*spec.columns, *spec.keys, *spec.required]) if c not in df.columns]


def build_extracts(sources: dict[str, DataFrame], cohort: DataFrame, specs: list[ExtractSpec], folder: str, quality: dict[str, str], integrity: dict[str, str], version: str, enforce: bool = True) -> list[dict]:
    """Write each table's cohort rows below folder, and say what became of it: completed with its rows, or skipped with
    the reason, or failed with the error. One table's failure leaves the others be."""
    out = []
    for spec in specs:
        allowed, reason = table_gate(spec.table, quality, integrity, enforce)
        result = {"table": spec.table, "status": "skipped", "reason": reason, "rows": None}
        out.append(result)
        if not allowed:
            continue
        if spec.table not in sources:
            result["reason"] = "missing_source"
            continue
        if lacks := missing_columns(sources[spec.table], spec):
            result |= {"status": "failed", "reason": f"missing_columns:{','.join(lacks)}"}
            continue
        try:
            rows = cohort_extract(sources[spec.table], cohort, spec.keys, spec.columns, spec.row_filter)
            n = write_atomic(with_provenance(rows, extraction_version=version, source_table=spec.table), f"{folder}/{spec.table}")
            result |= {"status": "completed", "rows": n}
        except Exception as e:
            result |= {"status": "failed", "reason": f"{type(e).__name__}: {str(e)[:200]}"}
    return out
