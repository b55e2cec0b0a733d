"""Many sources' rows in one vocabulary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.exprs import code_key, first_match, says_true, text_token

from .relational import longest_prefix, tiered_lookup, union_by_name


def _lookup(facts: DataFrame, on: Column, table: DataFrame | None, key: str, value: str, name: str, within: Column | None = None) -> DataFrame:
    """facts with name: the table's value for a key (of several, the least), and name_of: that row's `name`, if the table has
    one (of several, the least that there is); null without a table."""
    if table is None:
        return facts.withColumns({c: F.lit(None).cast("string") for c in (name, f"{name}_of")})
    said = F.col("name").cast("string") if "name" in table.columns else F.lit(None).cast("string")
    least = F.min(F.struct(F.col(value).alias("v"), said.isNull().alias("none"), said.alias("n")))
    own = table.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(key).alias("__k")).agg(least.alias("__v")).select("__k", F.col("__v.v").alias(name), F.col("__v.n").alias(f"{name}_of"))
    condition = on == F.col("__k")
    return facts.join(own, condition if within is None else condition & within, "left").drop("__k")


def condition_rollup(facts: DataFrame, maps: dict[str, DataFrame]) -> DataFrame:
    """Facts (code, version: icd10, icd9 or mixed, text) with a token of the first tier that has one, its level,
    confidence and status; and, apart from that, the project's own token: by code, longest prefix, then text.

    Tiers: 10-codes in `fine` (code, category); 9-codes in `coarse`; 9-codes over their least target in `crosswalk`
    (source_code, target_code, approximate) in `fine`; the chapter of version and three characters in `chapter` (version, category3,
    chapter); a text in `text` (text, token); the code's three characters; the text alone; nothing. Mixed codes are
    both 10- and 9-codes but in no chapter. A missing map is an empty one. No row is lost or repeated. With the token come
    its code and system, the map (mapped_by) and, where that has a column `name`, the name: all of one mapping row.
    """
    key, text = code_key(F.col("code")), text_token(F.col("text"))
    held = facts.withColumns({"__code": key, "__text": text, "__three": F.left(key, F.lit(3))})
    ten, nine = F.col("version").isin("icd10", "mixed"), F.col("version").isin("icd9", "mixed")
    held = _lookup(held, F.col("__code"), maps.get("fine"), "code", "category", "__fine", ten)
    held = _lookup(held, F.col("__code"), maps.get("coarse"), "code", "category", "__coarse", nine)
    walk, fine = maps.get("crosswalk"), maps.get("fine")
    if walk is not None and fine is not None:
        # A code's least target comes first, then that one's category: a target without any leaves the code to the next tier.
        least = walk.where("source_code is not null and target_code is not null").groupBy(F.col("source_code").alias("__k")).agg(F.min(F.struct("target_code", "approximate")).alias("__walk"))
        held = held.join(least, (F.col("__code") == F.col("__k")) & nine, "left").drop("__k")
        held = _lookup(held.withColumn("__rough", F.col("__walk.approximate")), F.col("__walk.target_code"), fine, "code", "category", "__over").drop("__walk")
    else:
        held = held.withColumns({"__over": F.lit(None).cast("string"), "__over_of": F.lit(None).cast("string"), "__rough": F.lit(None).cast("boolean")})
    chapters = maps.get("chapter")
    if chapters is not None:
        chapters = chapters.withColumn("slot", F.concat_ws("|", "version", "category3"))
    held = _lookup(held, F.concat_ws("|", "version", "__three"), chapters, "slot", "chapter", "__chapter")
    held = _lookup(held, F.col("__text"), maps.get("text"), "text", "token", "__said")
    family = F.when(F.col("version") == "icd10", "icd10").when(F.col("version") == "icd9", "icd9").otherwise("icd")
    c = F.col
    # The names of levels, confidences and statuses.
    def say(token: Column, level: str | None, confidence: Column | str | None, status: str, system: Column | str | None = None, code: Column | None = None, name: Column | None = None, by: str | None = None) -> Column:
        own = {"token": token, "level": level, "confidence": confidence, "status": status, "system": system, "mapped_code": code, "mapped_name": name, "mapped_by": by}
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("string").alias(n) for n, v in own.items()])

    of_version = lambda what: F.when(c("version") == "icd10", f"ICD10CM_{what}").when(c("version") == "icd9", f"ICD9CM_{what}").otherwise(f"ICD_{what}")
    none = F.lit(None).cast("string")
    tier = first_match([
        (c("__fine").isNotNull(), say(F.concat(F.lit("ccsr:"), c("__fine")), "ccsr", "exact", "mapped_ccsr", "CCSR", c("__fine"), c("__fine_of"), "fine")),
        (c("__coarse").isNotNull(), say(F.concat(F.lit("ccs:"), c("__coarse")), "ccs", "exact", "mapped_ccs", "CCS", c("__coarse"), c("__coarse_of"), "coarse")),
        (c("__over").isNotNull(), say(F.concat(F.lit("ccsr:"), c("__over")), "ccsr", F.when(c("__rough"), "approximate").otherwise("authoritative_crosswalk"), "mapped_icd_crosswalk", "CCSR", c("__over"), c("__over_of"), "crosswalk")),
        (c("__chapter").isNotNull(), say(F.concat(family, F.lit("chap:"), c("__chapter")), "chapter", "exact", "mapped_chapter", of_version("CHAPTER"), c("__chapter"), c("__chapter_of"), "chapter")),
        (c("__said").isNotNull(), say(c("__said"), "text_mapped", "curated_text", "mapped_text_to_condition", "TEXT_CONDITION", c("__said"), c("__said_of"), "text")),
        (c("__three").isNotNull(), say(F.concat(family, F.lit("cat:"), c("__three")), "category", "fallback_native", "source_native_code", of_version("CATEGORY"), c("__three"), None, "category")),
        (c("__text").isNotNull(), say(none, None, None, "source_native_text")),
    ], say(none, None, None, "unmapped_condition"))
    held = held.withColumn("__tier", tier)
    held = _lookup(held, c("__code"), maps.get("project_code"), "code", "token", "__by_code")
    prefixes = maps.get("project_prefix")
    held = longest_prefix(held, "__code", prefixes.select("prefix", F.col("token").alias("__by_prefix")), "prefix", "__by_prefix") if prefixes is not None else held.withColumn("__by_prefix", none)
    held = _lookup(held, c("__text"), maps.get("project_text"), "text", "token", "__by_text")
    return held.select(*facts.columns, "__tier.*", F.coalesce("__by_code", "__by_prefix", "__by_text").alias("project_token"),
        F.when(c("__by_code").isNotNull(), "code").when(c("__by_prefix").isNotNull(), "prefix").when(c("__by_text").isNotNull(), "text").alias("project_match"))


def medication_rows(orders: DataFrame, tiers: list[tuple[str, list[str], DataFrame]], fields: list[str], cancelled: str | None = "cancelled") -> DataFrame:
    """Orders that were not cancelled, with the fields (concept, ingredient, class and so on) that the first tier which
    has their keys gives them, all of one mapping row (of several the least), its name and a status; unmapped orders stay."""
    if cancelled is not None:
        orders = orders.where(~F.coalesce(says_true(F.col(cancelled)), F.lit(False)))
    packed = [(name, keys, table.select(*keys, F.struct(*fields).alias("__mapped"))) for name, keys, table in tiers]
    out = tiered_lookup(orders, packed, "__mapped")
    some = reduce(lambda a, b: a | b, [F.col(f"__mapped.{f}").isNotNull() for f in fields])
    # The two statuses.
    return out.select(*orders.columns, "__mapped.*", "matched_by", F.when(F.coalesce(some, F.lit(False)), "mapped_rxnorm_or_atc").otherwise("unmapped").alias("mapping_status"))


def lab_rows(events: DataFrame, item: str, items: DataFrame | None = None) -> DataFrame:
    """Events with the label and unit group of their item in items (item, label, category), keys compared as trimmed
    text, of several the least label; nulls without the table."""
    if items is None:
        return events.withColumns({c: F.lit(None).cast("string") for c in ("label", "category")})
    known = items.groupBy(F.trim(F.col("item").cast("string")).alias("__item")).agg(F.min(F.struct("label", "category")).alias("__found"))
    held = events.join(known, F.trim(F.col(item).cast("string")) == F.col("__item"), "left")
    return held.select(*events.columns, "__found.label", "__found.category")


def flag_events(df: DataFrame, ids: list[str], flags: list[str]) -> DataFrame:
    """An event for each support flag (ventilation, dialysis and the like) that says true, the flag's name being its
    token and 1 its value."""
    names = F.filter(F.array(*[F.when(says_true(F.col(f).cast("string")), F.lit(f)) for f in flags]), lambda x: x.isNotNull())
    return df.select(*ids, F.explode(names).alias("token"), F.lit(1.0).alias("value"))


def cancelled_summary(orders: DataFrame, by: str, cancelled: str = "cancelled") -> DataFrame:
    """A11."""
    gone = F.coalesce(says_true(F.col(cancelled)), F.lit(False))
    return orders.groupBy(by).agg(F.count("*").alias("orders"), F.count_if(gone).alias("cancelled"), F.count_if(~gone).alias("retained"))


def to_long(wide: DataFrame, ids: list[str], columns: list[str], name: str = "token", value: str = "value") -> DataFrame:
    """A row for each of the columns that is not blank, its value as text."""
    long = wide.select(*ids, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(ids, columns, name, value)
    return long.where(F.coalesce(F.trim(value) != "", F.lit(False)))


def items_to_tokens(events: DataFrame, item: str, tokens: dict[int, str]) -> DataFrame:
    """Events of the listed items, with their token."""
    pairs = F.create_map(*[F.lit(x) for kv in tokens.items() for x in kv])
    return events.where(F.col(item).isin(*tokens)).withColumn("token", F.try_element_at(pairs, F.col(item)))


EVENT_FIELDS = ("stay_id", "event_type", "token", "value", "hours")


def event_rows(domains: dict[str, tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """The events of several domains in one schema. A domain gives its table and which of its columns each
    field is; a field it lacks is null (conditions have no time)."""
    kinds = {"stay_id": "string", "token": "string", "value": "double", "hours": "double"}
    parts = []
    for kind, (df, fields) in domains.items():
        own = [F.lit(kind).alias("event_type") if f == "event_type" else (F.col(fields[f]) if f in fields else F.lit(None)).cast(kinds[f]).alias(f) for f in EVENT_FIELDS]
        parts.append(df.select(*own))
    return union_by_name(parts)


def counts_by(df: DataFrame, *keys: str, missing: str = "none") -> DataFrame:
    """Rows by keys, null text as `none`."""
    return df.groupBy(*[F.coalesce(F.col(k).cast("string"), F.lit(missing)).alias(k) for k in keys]).agg(F.count("*").alias("row_count"))


def conditional_sums(df: DataFrame, by: str, conditions: dict[str, Column]) -> DataFrame:
    """Rows that meet each condition."""
    return df.groupBy(by).agg(F.count("*").alias("row_count"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()])


def text_review(df: DataFrame, text: str, mapped: list[str]) -> DataFrame:
    """Each text with its rows and its largest mapped fields, the most frequent first."""
    token = text_token(F.col(text))
    return df.where(token.isNotNull()).groupBy(token.alias("text_token")).agg(F.count("*").alias("row_count"), *[F.max(c).alias(c) for c in mapped]).orderBy(F.desc("row_count"), "text_token")


def unit_summary(df: DataFrame, by: str, token: str, value: str, unit: str) -> DataFrame:
    """A10: per group: numeric rows, those with a unit, tokens, and tokens of more than one unit."""
    numeric = F.col(value).isNotNull()
    per = df.groupBy(by, token).agg(F.count_if(numeric).alias("numeric"), F.count_if(numeric & F.col(unit).isNotNull()).alias("with_unit"), F.count_distinct(F.when(numeric, F.col(unit))).alias("units"))
    return per.groupBy(by).agg(F.sum("numeric").alias("numeric_rows"), F.sum("with_unit").alias("rows_with_unit"), F.count("*").alias("tokens"), F.count_if(F.col("units") > 1).alias("tokens_of_many_units"))
