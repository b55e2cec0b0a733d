"""Adult stays of two sources in one schema, and their attrition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.exprs import blank_to_null, number

from .relational import union_by_name

#: Age that stands for a top-coded one.
TOPCODED_AGE = 90.0


def key_of(source: str, *ids: Column) -> Column:
    """A source-qualified text key; null if the id is."""
    return F.concat(F.lit(f"{source}:"), *ids)


def joined_stays(stays: DataFrame, patients: DataFrame, admissions: DataFrame) -> DataFrame:
    """Stays (patient_id, admission_id, stay_id, start, end) with their patient's and admission's columns."""
    return stays.join(patients, "patient_id").join(admissions.drop("patient_id"), "admission_id")


#: The columns of every source's stays, in order.
UNIFIED = {
    "source": "string", "source_version": "string", "patient_uid": "string", "encounter_uid": "string", "stay_uid": "string", "source_patient_id": "string", "source_encounter_id": "string", "source_stay_id": "string",
    "age_years": "double", "age_topcoded": "boolean", "sex": "string", "race_or_ethnicity": "string", "hospital_id": "string", "ward_id": "string", "admission_type": "string", "admission_source": "string",
    "unit_type": "string", "last_unit_type": "string", "stay_type": "string", "stay_sequence": "int", "encounter_start_time": "timestamp_ntz", "encounter_end_time": "timestamp_ntz", "stay_start_time": "timestamp_ntz",
    "stay_end_time": "timestamp_ntz", "stay_start_offset_minutes": "int", "stay_end_offset_minutes": "double", "los_hours": "double", "hospital_expire_flag": "int", "cohort_rule": "string",
}


def unified(df: DataFrame, **made: Column) -> DataFrame:
    """df in the unified columns: those made here, else df's own of the name (text that is no such value: null), else null."""
    pick = lambda c, kind: made[c] if c in made else F.col(c).cast("string") if c in df.columns else F.lit(None)
    return df.select(*[pick(c, kind).try_cast(kind).alias(c) for c, kind in UNIFIED.items()])


def dated_stays(stays: DataFrame, patients: DataFrame, admissions: DataFrame, source: str, adult: float = 18.0, first_only: bool = True, version: str | None = None) -> DataFrame:
    """Stays of the source with calendar times, in the unified columns: adults, and of an admission the first stay by
    time, then by id as text (stay_sequence numbers them). Ages come from the patient (anchor_age), lengths from los_days;
    what else the three tables have under a unified name is taken over."""
    held = joined_stays(stays, patients, admissions).withColumn("age_years", number(F.col("anchor_age").cast("string")))
    order = Window.partitionBy("admission_id").orderBy(F.col("start").try_cast("timestamp_ntz").asc_nulls_last(), F.col("stay_id").cast("string").asc_nulls_last())
    held = held.withColumn("stay_sequence", F.row_number().over(order)).where(F.col("age_years") >= adult)
    held = held.where("stay_sequence = 1") if first_only else held
    text = lambda c: F.col(c).cast("string")
    days = number(text("los_days")) if "los_days" in held.columns else F.lit(None).cast("double")
    return unified(held, source=F.lit(source), source_version=F.lit(version), patient_uid=key_of(source, text("patient_id")), encounter_uid=key_of(source, text("admission_id")), stay_uid=key_of(source, text("stay_id")),
        source_patient_id=text("patient_id"), source_encounter_id=text("admission_id"), source_stay_id=text("stay_id"), age_years=F.col("age_years"), age_topcoded=F.lit(False), stay_sequence=F.col("stay_sequence"),
        stay_start_time=F.col("start"), stay_end_time=F.col("end"), los_hours=days * 24.0, cohort_rule=F.lit(f"adult_icu_stay_first_per_admission={str(first_only).lower()}"))


def offset_stays(stays: DataFrame, source: str, adult: float = 18.0, version: str | None = None) -> DataFrame:
    """Stays of the source with minute offsets, in the unified columns: an age text `> 89` is top-coded; a blank patient
    id and a missing admission fall back to the stay's. stays has patient_id, admission_id, stay_id, age, end_offset; of
    unit_source and admission_source the first that is there is the source of admission. What else it has under a
    unified name is taken over."""
    age = F.trim("age")
    topcoded = F.coalesce(age.startswith(">"), F.lit(False))
    held = stays.withColumns({"age_topcoded": topcoded, "age_years": F.when(topcoded, TOPCODED_AGE).otherwise(number(age))}).where(F.col("age_years") >= adult)
    stay = F.col("stay_id").cast("string")
    patient = F.coalesce(blank_to_null(F.col("patient_id").cast("string")), F.concat(F.lit("unitstay:"), stay))
    admission = F.coalesce(F.col("admission_id").cast("string"), stay)
    came = F.coalesce(*[F.col(c).cast("string") for c in ("unit_source", "admission_source") if c in held.columns], F.lit(None).cast("string"))
    end = F.col("end_offset").cast("double")
    return unified(held, source=F.lit(source), source_version=F.lit(version), patient_uid=key_of(source, patient), encounter_uid=key_of(source, admission), stay_uid=key_of(source, stay), source_patient_id=patient,
        source_encounter_id=admission, source_stay_id=stay, age_years=F.col("age_years"), age_topcoded=F.col("age_topcoded"), admission_source=came, stay_start_offset_minutes=F.lit(0), stay_end_offset_minutes=end,
        los_hours=end / 60.0, cohort_rule=F.lit("adult_unit_stay_age_topcoded_to_90"))


def cohort(*sources: DataFrame) -> DataFrame:
    """All sources' stays, by column name."""
    return union_by_name(list(sources))


def dated_attrition(stays: DataFrame, patients: DataFrame, admissions: DataFrame, adult: float = 18.0) -> DataFrame:
    """Stays, joined stays, adults, and first stays of an admission among the adults' admissions, in one pass."""
    held = joined_stays(stays, patients, admissions).withColumn("age_years", number(F.col("anchor_age").cast("string")))
    grown = F.col("age_years") >= adult
    one = held.agg(F.count("*").alias("joined_stays"), F.count_if(F.coalesce(grown, F.lit(False))).alias("adult_stays"), F.count_distinct(F.when(grown, F.col("admission_id"))).alias("first_adult_stays"))
    return one.withColumn("repeated_stays", F.col("adult_stays") - F.col("first_adult_stays"))


def offset_attrition(stays: DataFrame, adult: float = 18.0) -> DataFrame:
    """Stays, ages that are no number, top-coded ages, adults."""
    age = F.trim("age")
    topcoded = F.coalesce(age.startswith(">"), F.lit(False))
    years = F.when(topcoded, TOPCODED_AGE).otherwise(number(age))
    return stays.agg(F.count("*").alias("stays"), F.count_if(years.isNull()).alias("unparseable_ages"), F.count_if(topcoded).alias("topcoded_ages"), F.count_if(F.coalesce(years >= adult, F.lit(False))).alias("adult_stays"))
