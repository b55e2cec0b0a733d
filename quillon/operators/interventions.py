"""Procedures, treatments, infusions and support in one schema, and the spans that they cover."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.exprs import nonblank, text_token, unit_text

FIELDS = {
    "stay_id": "string", "source_table": "string", "event_id": "string", "start_time": "timestamp", "end_time": "timestamp", "start_offset": "double", "end_offset": "double",
    "code": "string", "code_type": "string", "text": "string", "token": "string", "value_text": "string", "value_numeric": "double", "unit": "string", "normalized_unit": "string", "status": "string",
}


def _rows(df: DataFrame, **fields: Column) -> DataFrame:
    """df as rows of the schema; fields that are not given are null. What cannot be read as a field's type is null."""
    return df.select(*[(fields[n].try_cast(t) if n in fields else F.lit(None).cast(t)).alias(n) for n, t in FIELDS.items()])


def procedure_rows(codes: DataFrame, table: str = "procedures") -> DataFrame:
    """Coded procedures (stay_id, sequence, time, code, version: 10, 9 or another): the token is `icd<version>:procedure:<code>`
    in lower case; a null code or version is an empty one in it."""
    version, code = F.col("version").cast("string"), F.col("code").cast("string")
    # The code types.
    kind = F.when(version == "10", "ICD10PCS").when(version == "9", "ICD9PROC").otherwise("ICD")
    token = F.lower(F.concat(F.lit("icd"), F.coalesce(version, F.lit("")), F.lit(":procedure:"), F.coalesce(code, F.lit(""))))
    return _rows(codes, stay_id=F.col("stay_id"), source_table=F.lit(table), event_id=F.col("sequence"), start_time=F.col("time"), code=code, code_type=kind, token=token, status=F.lit("source_native_code"))


def item_rows(events: DataFrame, labels: DataFrame | None = None, table: str = "procedure_events") -> DataFrame:
    """Events of numbered items (stay_id, event_id, start, end, item, category, description, state, value, unit): the text is the
    item's label in labels (item, label; items compared as trimmed text, of several labels the least), else its category,
    its description or the item itself; the token is the text's normal form."""
    item = F.trim(F.col("item").cast("string"))
    if labels is None:
        held = events.withColumn("__label", F.lit(None).cast("string"))
    else:
        known = labels.where(nonblank(F.col("item").cast("string"))).groupBy(F.trim(F.col("item").cast("string")).alias("__item")).agg(F.min("label").alias("__label"))
        held = events.join(known, item == F.col("__item"), "left")
    text = F.coalesce("__label", "category", "description", F.col("item").cast("string"))
    token = text_token(text)
    status = F.when(token.isNotNull(), "source_native_token").otherwise("unmapped_source_concept")
    return _rows(held, stay_id=F.col("stay_id"), source_table=F.lit(table), event_id=F.col("event_id"), start_time=F.col("start"), end_time=F.col("end"), code=F.col("item"), code_type=F.lit("itemid"), text=text, token=token, value_text=F.col("state"), value_numeric=F.col("value"), unit=F.col("unit"), normalized_unit=unit_text(F.col("unit").cast("string")), status=status)


def text_rows(events: DataFrame, table: str = "treatments") -> DataFrame:
    """Treatments and infusions told by text (stay_id, event_id, offset, text, state; of infusions also rate, which stands for
    the state where there is one, and amount): the token is the text's normal form."""
    own = events.columns
    token = text_token(F.col("text").cast("string"))
    state = F.coalesce(*[F.col(c).cast("string") for c in ("rate", "state") if c in own])
    status = F.when(token.isNotNull(), "source_native_text").otherwise("unmapped_source_concept")
    more = {"value_numeric": F.col("amount")} if "amount" in own else {}
    return _rows(events, stay_id=F.col("stay_id"), source_table=F.lit(table), event_id=F.col("event_id"), start_offset=F.col("offset"), text=F.col("text"), token=token, value_text=state, status=status, **more)


def column_rows(wide: DataFrame, columns: list[str], table: str = "support") -> DataFrame:
    """An event for each of the columns that is not blank in a row (stay_id, event_id), the column's name being its code, text
    and token."""
    each = F.filter(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("said")) for c in columns]), lambda x: nonblank(x["said"]))
    held = wide.select("stay_id", "event_id", F.inline(each))
    name, said = F.col("name"), F.col("said")
    return _rows(held, stay_id=F.col("stay_id"), source_table=F.lit(table), event_id=F.col("event_id"), code=name, code_type=F.lit(table), text=name, token=name, value_text=said, value_numeric=said, status=F.lit("source_native_column"))


def intervention_rows(*parts: DataFrame) -> DataFrame:
    """All of them, by position of the one schema. Rows are neither lost nor repeated."""
    return reduce(DataFrame.union, [p.select(*FIELDS) for p in parts])


def covered_spans(events: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end, events): the spans that events of equal keys cover, those that overlap or touch as one. An end that is
    null or before its start is the start; an event without a start covers nothing. Two windows over one shuffle, by the
    keys (a stay and a token, say), whose events they are bounded by."""
    held = events.where(F.col(start).isNotNull()).select(*keys, F.col(start).alias("start"), F.greatest(F.col(start), F.coalesce(F.col(end), F.col(start))).alias("end"))
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    held = held.withColumn("__new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    held = held.withColumn("__span", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return held.groupBy(*keys, "__span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("events")).drop("__span")


def covered_hours(spans: DataFrame, keys: list[str], until: float | None = None) -> DataFrame:
    """(keys, hours, spans): how long the spans (numbers of hours) last, each up to `until` if that is given."""
    stop = F.col("end") if until is None else F.least("end", F.lit(until))
    return spans.groupBy(*keys).agg(F.sum(F.greatest(stop - F.col("start"), F.lit(0.0))).alias("hours"), F.count("*").alias("spans"))
