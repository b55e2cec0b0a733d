"""Queries: cohort, harmonised rows, window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import exprs
from quillon.functions.exprs import split_name
from quillon.operators import cohort, features, harmonize, interventions, training

from . import tpch
from .registry import query
from .tpch import SEED, STAYS_SQL, read, with_sql

KINDS = {"view": "lab", "click": "lab", "signup": "vital", "error": "intervention", "purchase": "medication"}
PREDICT, LABEL = 72.0, 144.0


def episodes(spark, d):
    """Events of a user within a week: (stay_id, source, split, event_id, event_type, token, value, hours)."""
    day = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp_ntz"))) / 604800).cast("long")
    hours = (F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp_ntz")) - day * 604800) / 3600.0
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    e = read(spark, d, "events").select("event_id", "user_id", F.concat(F.col("user_id").cast("string"), F.lit("|"), day.cast("string")).alias("stay_id"), F.when(F.col("user_id") % 5 == 0, "external").otherwise("dev").alias("source"), F.try_element_at(kind, "event_type").alias("event_type"), F.col("event_type").alias("token"), F.when(F.col("event_id") % 11 > 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 97 > 0, hours).alias("hours"))
    return e.withColumn("split", split_name(F.col("user_id"), F.col("source"), SEED))


EPISODES = f"""e0 AS (SELECT event_id, user_id, event_type AS token, epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-01') AS s, value AS v FROM events),
    e AS (SELECT event_id, user_id, user_id || '|' || CAST(floor(s / 604800) AS BIGINT) AS stay_id, CASE WHEN user_id % 5 = 0 THEN 'external' ELSE 'dev' END AS source, token,
      CASE token WHEN 'signup' THEN 'vital' WHEN 'error' THEN 'intervention' WHEN 'purchase' THEN 'medication' ELSE 'lab' END AS event_type,
      CASE WHEN event_id % 11 > 0 THEN v END AS value, CASE WHEN event_id % 97 > 0 THEN (s - floor(s / 604800) * 604800) / 3600.0::DOUBLE END AS hours,
      CASE WHEN user_id % 5 = 0 THEN 'external' WHEN b < 8000 THEN 'train' WHEN b < 9000 THEN 'validation' ELSE 'test' END AS split
      FROM (SELECT *, CAST('0x' || substr(md5(user_id || '|{SEED}'), 1, 8) AS UBIGINT) % 10000 AS b FROM e0))"""


@query(with_sql(EPISODES) + "SELECT stay_id, event_id, event_type, round(hours, 9) AS hours, row_number() OVER (PARTITION BY stay_id ORDER BY hours, event_type, event_id) AS position FROM e WHERE hours BETWEEN 0 AND 72 AND event_type <> 'medication'")
def w07_event_sequence(spark, d):
    return features.event_sequence(episodes(spark, d), PREDICT).select("stay_id", "event_id", "event_type", F.round("hours", 9).alias("hours"), "position")


@query(with_sql(EPISODES) + """SELECT stay_id, token, count(*) AS count, 1::BIGINT AS observed, 0::BIGINT AS missing, min(value) AS min, round(avg(value), 9) AS mean, max(value) AS max,
    first(value ORDER BY hours, event_id) FILTER (WHERE value IS NOT NULL) AS first, first(value ORDER BY hours DESC, event_id DESC) FILTER (WHERE value IS NOT NULL) AS last,
    round(first(value ORDER BY hours DESC, event_id DESC) FILTER (WHERE value IS NOT NULL) - first(value ORDER BY hours, event_id) FILTER (WHERE value IS NOT NULL), 9) AS delta,
    CASE WHEN count(value) >= 2 AND NOT isnan(regr_slope(value, hours)) THEN round(regr_slope(value, hours), 6) END AS slope, round(72 - max(hours), 9) AS hours_since_last FROM e WHERE hours BETWEEN 0 AND 72 GROUP BY 1, 2""")
def a12_window_features(spark, d):
    return features.token_statistics(episodes(spark, d), PREDICT).withColumn("slope", F.round("slope", 6)).select("stay_id", "token", *features.STATISTICS)


@query(with_sql(EPISODES, "s AS (SELECT DISTINCT stay_id, source, split FROM e)", "t AS (SELECT stay_id, token, count(*) AS n, max(value) AS m FROM e WHERE hours BETWEEN 0 AND 72 GROUP BY 1, 2)") + """
    SELECT s.*, coalesce(a.n, 0) AS lab_view_count, CASE WHEN a.n IS NULL THEN 1 ELSE 0 END::BIGINT AS lab_view_missing, a.m AS lab_view_max, coalesce(b.n, 0) AS lab_click_count, CASE WHEN b.n IS NULL THEN 1 ELSE 0 END::BIGINT AS lab_click_missing, b.m AS lab_click_max
    FROM s LEFT JOIN t a ON a.stay_id = s.stay_id AND a.token = 'view' LEFT JOIN t b ON b.stay_id = s.stay_id AND b.token = 'click'""")
def j09_wide_features(spark, d):
    e = episodes(spark, d)
    return features.wide_features(e.select("stay_id", "source", "split").distinct(), features.token_statistics(e, PREDICT), ["view", "click"], "lab", ("count", "missing", "max"))


@query(with_sql(EPISODES) + "SELECT stay_id, event_type, count(*) AS events, count(DISTINCT token) AS tokens, count(*) > 0 AS any_event FROM e WHERE hours BETWEEN 0 AND 72 GROUP BY 1, 2")
def a13_domain_counts(spark, d):
    return features.domain_counts(episodes(spark, d), PREDICT)


@query(with_sql(EPISODES) + "SELECT token, count(DISTINCT stay_id) AS stays FROM e WHERE split = 'train' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def k01_topn_tokens(spark, d):
    return features.top_tokens(episodes(spark, d), "token", 3)


@query(with_sql(EPISODES) + "SELECT stay_id, max((token = 'view')::INT) AS token_view_present, max((token = 'error')::INT) AS token_error_present FROM e GROUP BY 1")
def a14_presence(spark, d):
    e = episodes(spark, d)
    return features.presence(e.select("stay_id").distinct(), e, "token", ["view", "error"], "token")


@query(with_sql(EPISODES) + "SELECT source, split, count(*) AS row_count, count(*) FILTER (WHERE token NOT IN ('view', 'error')) AS oov_rows, count(DISTINCT token) FILTER (WHERE token NOT IN ('view', 'error')) AS oov_tokens FROM e GROUP BY 1, 2")
def a15_out_of_vocabulary(spark, d):
    return features.out_of_vocabulary(episodes(spark, d), "token", ["view", "error"])


@query(with_sql(EPISODES) + "SELECT event_type, count(*) AS events, count(*) FILTER (WHERE hours IS NULL) AS without_time, count(*) FILTER (WHERE hours < 0) AS before_start, count(*) FILTER (WHERE hours > 72) AS after_prediction, count(*) FILTER (WHERE event_type = 'medication') AS type_left_out FROM e GROUP BY 1")
def a16_excluded_events(spark, d):
    return features.excluded_events(episodes(spark, d), PREDICT, ("medication",))


@query(with_sql(EPISODES) + """SELECT stay_id, 72.0::DOUBLE AS prediction_hours, 144.0::DOUBLE AS label_end_hours, CASE WHEN t IS NULL THEN 'missing_observation_end' WHEN t < 72 THEN 'censored_before_prediction' WHEN t < 144 THEN 'censored_before_label_window' ELSE 'eligible_primary' END AS eligibility
    FROM (SELECT stay_id, CASE WHEN user_id % 7 > 0 THEN max(hours) END AS t FROM e GROUP BY stay_id, user_id)""")
def d09_decision_times(spark, d):
    ends = episodes(spark, d).groupBy("stay_id", "user_id").agg(F.max("hours").alias("last")).select("stay_id", F.when(F.col("user_id") % 7 > 0, F.col("last")).alias("end_hours"))
    return training.decision_times(ends, PREDICT, LABEL).drop("end_hours")


@query(with_sql(EPISODES) + "SELECT stay_id, 'value:' || token AS candidate, count(*) AS events, round(min(hours), 9) AS first_hours FROM e WHERE hours > 72 AND hours <= 144 AND event_type = 'medication' GROUP BY 1, 2")
def d12_label_events(spark, d):
    own = episodes(spark, d).where("event_type = 'medication'").withColumn("candidate", F.concat(F.lit("value:"), "token"))
    return training.label_events(own, PREDICT, LABEL).withColumn("first_hours", F.round("first_hours", 9))


@query(with_sql(EPISODES) + "SELECT source, count(*) FILTER (WHERE hours > 72 AND hours <= 144) AS in_window, count(*) FILTER (WHERE hours > 72 AND hours <= 144 AND value IS NULL) AS unmapped, count(*) FILTER (WHERE hours IS NULL) AS without_time FROM e WHERE event_type = 'medication' GROUP BY 1")
def a18_label_losses(spark, d):
    return training.label_losses(episodes(spark, d).where("event_type = 'medication'").withColumn("candidate", F.col("value").cast("string")), PREDICT, LABEL)


@query("SELECT source, count(*) AS row_count, count(*) FILTER (WHERE condition IS NULL) AS without_token, count(DISTINCT condition) AS tokens FROM (SELECT CASE WHEN c_nationkey % 5 = 0 THEN 'external' ELSE 'dev' END AS source, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS condition FROM customer) GROUP BY 1")
def a17_condition_coverage(spark, d):
    own = read(spark, d, "customer").select(F.when(F.col("c_nationkey") % 5 == 0, "external").otherwise("dev").alias("source"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).alias("condition"))
    return training.condition_coverage(own)


@query("SELECT DISTINCT o_custkey AS stay_id, o_orderpriority AS condition, o_orderstatus AS level FROM orders WHERE o_orderpriority IS NOT NULL")
def d11_stay_conditions(spark, d):
    own = read(spark, d, "orders").select(F.col("o_custkey").alias("stay_id"), F.col("o_orderpriority").alias("condition"), F.col("o_orderstatus").alias("level"))
    return training.stay_conditions(own, ["stay_id", "condition", "level"])


def _dated(spark, d):
    o = read(spark, d, "orders")
    stays = o.select(F.col("o_orderkey").alias("stay_id"), F.col("o_custkey").alias("patient_id"), F.concat(F.col("o_custkey").cast("string"), F.lit("/"), F.year("o_orderdate").cast("string")).alias("admission_id"), F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("INTERVAL 48 HOURS")).alias("end"), F.lit("2.0").alias("los_days"), F.col("o_orderpriority").alias("unit_type"), F.col("o_orderstatus").alias("last_unit_type"))
    patients = read(spark, d, "customer").where("c_nationkey % 5 > 0").select(F.col("c_custkey").alias("patient_id"), (F.col("c_custkey") % 90).alias("anchor_age"), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("sex"))
    admissions = stays.groupBy("admission_id", "patient_id").agg(F.min("start").alias("encounter_start_time"), F.max("end").alias("encounter_end_time"), (F.count("*") % 2).alias("hospital_expire_flag"))
    return stays, patients, admissions.withColumn("admission_type", F.lit("ward"))


def _offset(spark, d):
    c = read(spark, d, "customer").where("c_nationkey % 5 = 0")
    age = F.when(F.col("c_custkey") % 10 == 0, "> 89").when(F.col("c_custkey") % 10 == 1, "").otherwise((F.col("c_custkey") % 90).cast("string"))
    return c.select(F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey").cast("string")).otherwise(" ").alias("patient_id"), F.col("c_nationkey").alias("admission_id"), F.col("c_custkey").alias("stay_id"), age.alias("age"), F.col("c_acctbal").alias("end_offset"), F.col("c_mktsegment").alias("unit_type"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("unit_source"), F.lit("home").alias("admission_source"), F.col("c_nationkey").alias("ward_id"), (F.col("c_custkey") % 4).cast("string").alias("stay_sequence"))


_COHORT = """s AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, o_custkey || '/' || year(o_orderdate) AS adm, o_orderdate, CAST(c_custkey % 90 AS DOUBLE) AS age FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 5 > 0),
    f AS (SELECT *, row_number() OVER (PARTITION BY adm ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR)) AS rn FROM s),
    t AS (SELECT *, CASE WHEN c_custkey % 10 = 0 THEN 90.0::DOUBLE WHEN c_custkey % 10 = 1 THEN NULL ELSE CAST(c_custkey % 90 AS DOUBLE) END AS age FROM customer WHERE c_nationkey % 5 = 0)"""


@query(with_sql(_COHORT, "adms AS (SELECT adm, min(o_orderdate) AS first, max(o_orderdate) + INTERVAL 48 HOURS AS last, CAST(count(*) % 2 AS INTEGER) AS expired FROM s GROUP BY 1)") + """SELECT 'a' AS source, 'v1' AS source_version, 'a:' || o_custkey AS patient_uid, 'a:' || adm AS encounter_uid, 'a:' || o_orderkey AS stay_uid, CAST(o_custkey AS VARCHAR) AS source_patient_id, adm AS source_encounter_id, CAST(o_orderkey AS VARCHAR) AS source_stay_id,
      age AS age_years, FALSE AS age_topcoded, CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, NULL::VARCHAR AS race_or_ethnicity, NULL::VARCHAR AS hospital_id, NULL::VARCHAR AS ward_id, 'ward' AS admission_type, NULL::VARCHAR AS admission_source, o_orderpriority AS unit_type, o_orderstatus AS last_unit_type,
      NULL::VARCHAR AS stay_type, CAST(rn AS INTEGER) AS stay_sequence, CAST(first AS TIMESTAMP) AS encounter_start_time, CAST(last AS TIMESTAMP) AS encounter_end_time, CAST(o_orderdate AS TIMESTAMP) AS stay_start_time, CAST(o_orderdate + INTERVAL 48 HOURS AS TIMESTAMP) AS stay_end_time, NULL::INTEGER AS stay_start_offset_minutes,
      NULL::DOUBLE AS stay_end_offset_minutes, 48.0::DOUBLE AS los_hours, expired AS hospital_expire_flag, 'adult_icu_stay_first_per_admission=true' AS cohort_rule FROM f JOIN adms USING (adm) WHERE rn = 1 AND age >= 18
    UNION ALL SELECT 'b', 'v2', 'b:' || p, 'b:' || c_nationkey, 'b:' || c_custkey, p, CAST(c_nationkey AS VARCHAR), CAST(c_custkey AS VARCHAR), age, c_custkey % 10 = 0, NULL, NULL, NULL, CAST(c_nationkey AS VARCHAR), NULL, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'home' END, c_mktsegment, NULL, NULL,
      CAST(c_custkey % 4 AS INTEGER), NULL, NULL, NULL, NULL, 0, c_acctbal, c_acctbal / 60.0::DOUBLE, NULL, 'adult_unit_stay_age_topcoded_to_90' FROM (SELECT *, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'unitstay:' || c_custkey END AS p FROM t) WHERE age >= 18""")
def d01_d02_cohort(spark, d):
    return cohort.cohort(cohort.dated_stays(*_dated(spark, d), "a", version="v1"), cohort.offset_stays(_offset(spark, d), "b", version="v2"))


@query(with_sql(_COHORT) + "SELECT count(*) AS joined_stays, count(*) FILTER (WHERE age >= 18) AS adult_stays, count(DISTINCT adm) FILTER (WHERE age >= 18) AS first_adult_stays, count(*) FILTER (WHERE age >= 18) - count(DISTINCT adm) FILTER (WHERE age >= 18) AS repeated_stays FROM s")
def a03_dated_attrition(spark, d):
    return cohort.dated_attrition(*_dated(spark, d))


@query(with_sql(_COHORT) + "SELECT count(*) AS stays, count(*) FILTER (WHERE age IS NULL) AS unparseable_ages, count(*) FILTER (WHERE c_custkey % 10 = 0) AS topcoded_ages, count(*) FILTER (WHERE age >= 18) AS adult_stays FROM t")
def a04_offset_attrition(spark, d):
    return cohort.offset_attrition(_offset(spark, d))


def _conditions(spark, d):
    k = F.col("p_partkey")
    code = F.when(k % 7 == 0, None).otherwise(F.concat(F.element_at(F.array(*[F.lit(x) for x in "ABCDE"]), (k % 5 + 1).cast("int")), (k % 40).cast("string"), F.lit("."), (k % 4).cast("string")))
    version = F.element_at(F.array(F.lit("icd10"), F.lit("icd9"), F.lit("mixed")), (F.col("p_size") % 3 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", code.alias("code"), version.alias("version"), F.when(k % 3 > 0, F.col("p_name")).alias("text"))


_FINE = [(f"{c}{n}{k}", f"F{(n + shift) % 6}") for c, shift in (("a", 3), ("b", 0)) for n in range(0, 40, 3) for k in range(4)]
_COARSE = [(f"{c}{n}{k}".lower(), f"G{n % 5}") for c in "BC" for n in range(0, 40, 4) for k in range(4)]
_WALK = [(f"d{n}{k}", f"a{n}{k}", k % 2 == 0) for n in range(40) for k in range(4)] + [(f"d{n}{k}", target, False) for n in range(40) for k, target in ((0, f"b{n}0"), (1, f"b{n}1"), (3, "9zz"))]
_CHAPTERS = [(v, f"{c}{n}".lower()[:3].ljust(2, "0") if n > 9 else f"{c}{n}{k}".lower(), f"ch{n % 3}") for v in ("icd10", "icd9") for c in "CD" for n in range(5, 25) for k in range(4)]
_CHAPTERS = sorted(set(_CHAPTERS))
_SAID = [("red_widget", "cond:red"), ("blue_bolt", "cond:blue"), ("blue_bolt", "cond:azure")]
_CODES, _HEADS, _TEXTS = [("a30", "p:exact"), ("e41", "p:e41")], [("e", "p:e"), ("e1", "p:e1"), ("e12", "p:e12"), ("a3", "p:a3")], [("small_ring", "p:ring")]


def _values(rows):
    return ", ".join("(" + ", ".join(("TRUE" if x else "FALSE") if isinstance(x, bool) else f"'{x}'" for x in r) + ")" for r in rows)


@query(f"""WITH p AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE substr('ABCDE', 1 + CAST(p_partkey % 5 AS INT), 1) || (p_partkey % 40) || '.' || (p_partkey % 4) END AS code, ['icd10', 'icd9', 'mixed'][1 + p_size % 3] AS version, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS text FROM part),
    f AS (SELECT *, nullif(regexp_replace(lower(trim(code)), '[^a-z0-9]', '', 'g'), '') AS k, nullif(regexp_replace(lower(trim(text)), '[^a-z0-9]+', '_', 'g'), '') AS t FROM p),
    fine AS (SELECT k1, min(c) AS c FROM (VALUES {_values(_FINE)}) v(k1, c) GROUP BY 1), coarse AS (SELECT k1, min(c) AS c FROM (VALUES {_values(_COARSE)}) v(k1, c) GROUP BY 1),
    least AS (SELECT s, min(t) AS t, arg_min(a, (t, a)) AS a FROM (VALUES {_values(_WALK)}) v(s, t, a) GROUP BY 1), walk AS (SELECT s, c, a FROM least JOIN fine ON fine.k1 = least.t),
    chap AS (SELECT v, k3, min(c) AS c FROM (VALUES {_values(_CHAPTERS)}) x(v, k3, c) GROUP BY 1, 2), said AS (SELECT x, min(y) AS y FROM (VALUES {_values(_SAID)}) v(x, y) GROUP BY 1),
    j AS (SELECT f.*, fine.c AS c1, coarse.c AS c2, walk.c AS c3, walk.a AS a3, chap.c AS c4, said.y AS c5, substr(k, 1, 3) AS k3, CASE version WHEN 'mixed' THEN 'icd' ELSE version END AS fam,
      (SELECT min(y) FROM (VALUES {_values(_CODES)}) v(x, y) WHERE x = k) AS pc, (SELECT y FROM (VALUES {_values(_HEADS)}) v(x, y) WHERE starts_with(k, x) ORDER BY length(x) DESC, y LIMIT 1) AS pp, (SELECT min(y) FROM (VALUES {_values(_TEXTS)}) v(x, y) WHERE x = t) AS pt
      FROM f LEFT JOIN fine ON fine.k1 = k AND version <> 'icd9' LEFT JOIN coarse ON coarse.k1 = k AND version <> 'icd10' LEFT JOIN walk ON walk.s = k AND version <> 'icd10' LEFT JOIN chap ON chap.v = version AND chap.k3 = substr(k, 1, 3) LEFT JOIN said ON said.x = t)
    SELECT p_partkey, CASE WHEN c1 IS NOT NULL THEN 'ccsr:' || c1 WHEN c2 IS NOT NULL THEN 'ccs:' || c2 WHEN c3 IS NOT NULL THEN 'ccsr:' || c3 WHEN c4 IS NOT NULL THEN fam || 'chap:' || c4 WHEN c5 IS NOT NULL THEN c5 WHEN k IS NOT NULL THEN fam || 'cat:' || k3 END AS token,
      CASE WHEN c1 IS NOT NULL THEN 'ccsr' WHEN c2 IS NOT NULL THEN 'ccs' WHEN c3 IS NOT NULL THEN 'ccsr' WHEN c4 IS NOT NULL THEN 'chapter' WHEN c5 IS NOT NULL THEN 'text_mapped' WHEN k IS NOT NULL THEN 'category' END AS level,
      CASE WHEN c1 IS NOT NULL OR c2 IS NOT NULL THEN 'exact' WHEN c3 IS NOT NULL THEN CASE WHEN a3 THEN 'approximate' ELSE 'authoritative_crosswalk' END WHEN c4 IS NOT NULL THEN 'exact' WHEN c5 IS NOT NULL THEN 'curated_text' WHEN k IS NOT NULL THEN 'fallback_native' END AS confidence,
      CASE WHEN c1 IS NOT NULL THEN 'mapped_ccsr' WHEN c2 IS NOT NULL THEN 'mapped_ccs' WHEN c3 IS NOT NULL THEN 'mapped_icd_crosswalk' WHEN c4 IS NOT NULL THEN 'mapped_chapter' WHEN c5 IS NOT NULL THEN 'mapped_text_to_condition' WHEN k IS NOT NULL THEN 'source_native_code' WHEN t IS NOT NULL THEN 'source_native_text' ELSE 'unmapped_condition' END AS status,
      coalesce(pc, pp, pt) AS project_token, CASE WHEN pc IS NOT NULL THEN 'code' WHEN pp IS NOT NULL THEN 'prefix' WHEN pt IS NOT NULL THEN 'text' END AS project_match FROM j""")
def d03_rollup_precedence(spark, d):
    make = spark.createDataFrame
    maps = {"fine": make(_FINE, "code string, category string"), "coarse": make(_COARSE, "code string, category string"), "crosswalk": make(_WALK, "source_code string, target_code string, approximate boolean"), "chapter": make(_CHAPTERS, "version string, category3 string, chapter string"), "text": make(_SAID, "text string, token string"),
        "project_code": make(_CODES, "code string, token string"), "project_prefix": make(_HEADS, "prefix string, token string"), "project_text": make(_TEXTS, "text string, token string")}
    return harmonize.condition_rollup(_conditions(spark, d), maps).drop("code", "version", "text", "system", "mapped_code", "mapped_name", "mapped_by")


@query("""WITH f AS (SELECT p_partkey, p_brand, p_name, ['icd10', 'icd9', 'mixed'][1 + p_size % 3] AS version, lower(replace(p_brand, '#', '')) AS k, nullif(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '') AS t FROM part),
    m AS (SELECT lower(replace(p_brand, '#', '')) AS k1, min(p_type) AS c FROM part WHERE p_size < 25 GROUP BY 1),
    fine AS (SELECT m.k1, m.c, min(CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_name END) AS n FROM m JOIN part ON lower(replace(p_brand, '#', '')) = m.k1 AND p_type = m.c AND p_size < 25 GROUP BY 1, 2),
    said AS (SELECT nullif(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '') AS x, 'cond:' || min(p_type) AS y FROM part WHERE p_size > 40 GROUP BY 1)
    SELECT p_partkey, CASE WHEN c IS NOT NULL AND version <> 'icd9' THEN 'CCSR' WHEN y IS NOT NULL THEN 'TEXT_CONDITION' WHEN version = 'icd10' THEN 'ICD10CM_CATEGORY' WHEN version = 'icd9' THEN 'ICD9CM_CATEGORY' ELSE 'ICD_CATEGORY' END AS system,
      CASE WHEN c IS NOT NULL AND version <> 'icd9' THEN c WHEN y IS NOT NULL THEN y ELSE substr(k, 1, 3) END AS mapped_code, CASE WHEN c IS NOT NULL AND version <> 'icd9' THEN n END AS mapped_name,
      CASE WHEN c IS NOT NULL AND version <> 'icd9' THEN 'fine' WHEN y IS NOT NULL THEN 'text' ELSE 'category' END AS mapped_by FROM f LEFT JOIN fine ON k1 = k LEFT JOIN said ON x = t""")
def j04_condition_fields(spark, d):
    """A mapping row's code, name, system and table, by code or text."""
    part = read(spark, d, "part")
    version = F.element_at(F.array(F.lit("icd10"), F.lit("icd9"), F.lit("mixed")), (F.col("p_size") % 3 + 1).cast("int"))
    facts = part.select("p_partkey", F.col("p_brand").alias("code"), version.alias("version"), F.col("p_name").alias("text"))
    fine = part.where("p_size < 25").select(exprs.code_key(F.col("p_brand")).alias("code"), F.col("p_type").alias("category"), F.when(F.col("p_size") % 2 != 0, F.col("p_name")).alias("name"))
    said = part.where("p_size > 40").select(exprs.text_token(F.col("p_name")).alias("text"), F.concat(F.lit("cond:"), "p_type").alias("token"))
    return harmonize.condition_rollup(facts, {"fine": fine, "text": said}).select("p_partkey", "system", "mapped_code", "mapped_name", "mapped_by")


_TOKEN = "nullif(regexp_replace(lower(trim({})), '[^a-z0-9]+', '_', 'g'), '')"


@query(f"""WITH i AS (SELECT CAST(l_suppkey AS VARCHAR) AS item, l.* FROM lineitem l),
    e AS (SELECT CAST(l_orderkey AS VARCHAR) AS stay_id, 'procedures' AS source_table, CAST(l_linenumber AS VARCHAR) AS event_id, CAST(l_partkey AS VARCHAR) AS code, CASE l_linenumber % 3 WHEN 0 THEN 'ICD10PCS' WHEN 1 THEN 'ICD9PROC' ELSE 'ICD' END AS code_type, NULL AS text,
        'icd' || CASE l_linenumber % 3 WHEN 0 THEN '10' WHEN 1 THEN '9' ELSE '' END || ':procedure:' || l_partkey AS token, NULL AS value_text, NULL::DOUBLE AS value_numeric, NULL AS normalized_unit, 'source_native_code' AS status FROM i WHERE l_returnflag = 'R'
      UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'procedure_events', CAST(l_linenumber AS VARCHAR), item, 'itemid', coalesce(s_name, CASE WHEN l_linenumber > 3 THEN l_returnflag || ' flag' END, item), {_TOKEN.format("coalesce(s_name, CASE WHEN l_linenumber > 3 THEN l_returnflag || ' flag' END, item)")}, l_linestatus, l_quantity, 'ml / h', 'source_native_token'
        FROM i LEFT JOIN (SELECT s_suppkey, 'Supplier  no. ' || s_nationkey AS s_name FROM supplier WHERE s_suppkey % 2 = 0) ON s_suppkey = l_suppkey WHERE l_returnflag = 'A'
      UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'infusions', CAST(l_linenumber AS VARCHAR), NULL, NULL, p_name, {_TOKEN.format("p_name")}, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber AS VARCHAR) ELSE l_linestatus END, l_quantity, NULL, 'source_native_text' FROM i JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'N'
      UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'support', CAST(o_custkey AS VARCHAR), n, 'support', n, n, v, CASE WHEN n = 'dialysis' THEN 1 END, NULL, 'source_native_column' FROM (SELECT *, unnest(['vent', 'dialysis']) AS n, unnest([CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE ' ' END, CASE WHEN o_totalprice > 150000 THEN '1' END]) AS v FROM orders) WHERE trim(v) <> '')
    SELECT * FROM e""")
def d07_interventions(spark, d):
    """Procedures, item events, infusions and support flags in one schema."""
    line, text = read(spark, d, "lineitem"), lambda c: F.col(c).cast("string")
    ids = [F.col("l_orderkey").alias("stay_id"), F.col("l_linenumber").alias("event_id")]
    n = F.col("l_linenumber") % 3
    codes = line.where("l_returnflag = 'R'").select(ids[0], F.col("l_linenumber").alias("sequence"), F.lit(None).cast("timestamp").alias("time"), F.col("l_partkey").alias("code"), F.when(n == 0, "10").when(n == 1, "9").alias("version"))
    items = line.where("l_returnflag = 'A'").select(*ids, *[F.lit(None).cast("timestamp").alias(c) for c in ("start", "end")], F.concat(F.lit(" "), "l_suppkey").alias("item"), F.when(F.col("l_linenumber") > 3, F.concat("l_returnflag", F.lit(" flag"))).alias("category"), F.lit(None).cast("string").alias("description"), F.col("l_linestatus").alias("state"), text("l_quantity").alias("value"), F.lit(" ML  /  h").alias("unit"))
    labels = read(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("item"), F.concat(F.lit("Supplier  no. "), "s_nationkey").alias("label"))
    drugs = line.where("l_returnflag = 'N'").join(read(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select(*ids, F.lit(1.5).alias("offset"), F.col("p_name").alias("text"), F.col("l_linestatus").alias("state"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber")).alias("rate"), F.col("l_quantity").alias("amount"))
    support = read(spark, d, "orders").select(F.col("o_orderkey").alias("stay_id"), F.col("o_custkey").alias("event_id"), F.when(F.col("o_orderstatus") == "F", "yes").otherwise(" ").alias("vent"), F.when(F.col("o_totalprice") > 150000, 1).alias("dialysis"))
    out = interventions.intervention_rows(interventions.procedure_rows(codes), interventions.item_rows(items, labels), interventions.text_rows(drugs, "infusions"), interventions.column_rows(support, ["vent", "dialysis"]))
    out = out.withColumns({"code": F.trim("code"), "text": F.trim("text")})
    return out.select("stay_id", "source_table", "event_id", "code", "code_type", "text", "token", "value_text", "value_numeric", "normalized_unit", "status")


@query("""WITH e AS (SELECT l_orderkey, l_returnflag, CAST(l_linenumber * 3 AS DOUBLE) AS s, CASE WHEN l_linenumber = 6 THEN NULL ELSE CAST(l_linenumber * 3 + l_quantity % 9 - 1 AS DOUBLE) END AS t FROM lineitem),
    g AS (SELECT l_orderkey, l_returnflag, s, greatest(s, coalesce(t, s)) AS t FROM e), n AS (SELECT *, coalesce(s > max(t) OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE)::INT AS new FROM g),
    i AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS span FROM n), u AS (SELECT l_orderkey, l_returnflag, span, min(s) AS s, max(t) AS t FROM i GROUP BY 1, 2, 3)
    SELECT l_orderkey, l_returnflag, sum(greatest(least(t, 20.0::DOUBLE) - s, 0)) AS hours, count(*) AS spans FROM u GROUP BY 1, 2""")
def d07_covered_hours(spark, d):
    """How long overlapping infusions last in a stay."""
    start = (F.col("l_linenumber") * 3).cast("double")
    own = read(spark, d, "lineitem").select("l_orderkey", "l_returnflag", start.alias("start"), F.when(F.col("l_linenumber") != 6, start + (F.col("l_quantity") % 9).cast("double") - 1).alias("end"))
    keys = ["l_orderkey", "l_returnflag"]
    return interventions.covered_hours(interventions.covered_spans(own, keys), keys, 20.0)


_LEAST = "min_by(p_type, (p_type, p_brand)) AS drug, min_by(p_brand, (p_type, p_brand)) AS ingredient"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, coalesce(a.drug, b.drug) AS drug, CASE WHEN a.drug IS NOT NULL THEN a.ingredient ELSE b.ingredient END AS ingredient, CASE WHEN a.drug IS NOT NULL THEN 'code' WHEN b.drug IS NOT NULL THEN 'name' END AS matched_by,
    CASE WHEN coalesce(a.drug, b.drug) IS NULL THEN 'unmapped' ELSE 'mapped_rxnorm_or_atc' END AS mapping_status FROM (SELECT * FROM lineitem WHERE l_returnflag <> 'R') JOIN part ON p_partkey = l_partkey
    LEFT JOIN (SELECT p_partkey AS k, {_LEAST} FROM part WHERE p_size < 20 GROUP BY 1) a ON a.k = l_partkey LEFT JOIN (SELECT p_name AS k, {_LEAST} FROM part WHERE p_size > 45 GROUP BY 1) b ON b.k = p_name""")
def d04_medications(spark, d):
    part = read(spark, d, "part")
    orders = read(spark, d, "lineitem").withColumn("cancelled", F.when(F.col("l_returnflag") == "R", "Yes")).join(part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    named = part.withColumns({"drug": F.col("p_type"), "ingredient": F.col("p_brand")})
    fields = ["drug", "ingredient"]
    tiers = [("code", ["l_partkey"], named.where("p_size < 20").select(F.col("p_partkey").alias("l_partkey"), *fields)), ("name", ["p_name"], named.where("p_size > 45").select("p_name", *fields))]
    return harmonize.medication_rows(orders, tiers, fields).select("l_orderkey", "l_linenumber", "l_partkey", *fields, "matched_by", "mapping_status")


@query("""SELECT o.o_orderkey, i.label, i.category, 'known' AS lookup FROM orders o LEFT JOIN (SELECT trim(n_name) AS k, min(n_name) AS label, min_by('r' || n_regionkey, (n_name, 'r' || n_regionkey)) AS category FROM nation WHERE n_nationkey % 3 > 0 GROUP BY 1) i ON i.k = (SELECT max(n_name) FROM nation WHERE n_nationkey = o.o_orderkey % 25)
    UNION ALL SELECT o_orderkey, NULL, NULL, 'none' FROM orders""")
def j03_lab_labels(spark, d):
    nation = read(spark, d, "nation")
    orders = read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 25).alias("n_nationkey")).join(nation.select("n_nationkey", F.concat(F.lit(" "), "n_name").alias("item")), "n_nationkey", "left").select("o_orderkey", "item")
    items = nation.where("n_nationkey % 3 > 0").select(F.concat("n_name", F.lit("  ")).alias("item"), F.col("n_name").alias("label"), F.concat(F.lit("r"), "n_regionkey").alias("category"))
    out = harmonize.lab_rows(orders, "item", items).withColumn("lookup", F.lit("known")).union(harmonize.lab_rows(orders, "item").withColumn("lookup", F.lit("none")))
    return out.drop("item")


@query("SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderstatus = 'F' THEN 'ventilated' END, CASE WHEN o_totalprice > 100000 THEN 'dialysed' END], lambda x: x IS NOT NULL)) AS token, 1.0::DOUBLE AS value FROM orders")
def d07_support_flags(spark, d):
    own = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", " Yes").otherwise("no").alias("ventilated"), (F.col("o_totalprice") > 100000).alias("dialysed"))
    return harmonize.flag_events(own, ["o_orderkey"], ["ventilated", "dialysed"])


@query("SELECT l_linestatus, count(*) AS orders, count(*) FILTER (WHERE l_returnflag = 'R') AS cancelled, count(*) FILTER (WHERE l_returnflag <> 'R') AS retained FROM lineitem GROUP BY 1")
def a11_cancelled_summary(spark, d):
    return harmonize.cancelled_summary(read(spark, d, "lineitem").withColumn("cancelled", F.when(F.col("l_returnflag") == "R", " TRUE ")), "l_linestatus")


@query("SELECT p_partkey, token, value FROM (SELECT p_partkey, 'p_size' AS token, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 'p_brand', CASE WHEN p_size > 10 THEN p_brand ELSE ' ' END FROM part) WHERE trim(value) <> ''")
def d05_unpivot(spark, d):
    part = read(spark, d, "part").withColumn("p_brand", F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise(" "))
    return harmonize.to_long(part, ["p_partkey"], ["p_size", "p_brand"])


@query("SELECT p_partkey, CASE p_size WHEN 1 THEN 'heart_rate' WHEN 2 THEN 'spo2' ELSE 'temperature' END AS token FROM part WHERE p_size IN (1, 2, 7)")
def d06_items_to_tokens(spark, d):
    return harmonize.items_to_tokens(read(spark, d, "part"), "p_size", {1: "heart_rate", 2: "spo2", 7: "temperature"}).select("p_partkey", "token")


@query(with_sql(EPISODES) + "SELECT stay_id, event_type, token, value, hours FROM (SELECT stay_id, 'lab' AS event_type, token, value, round(hours, 9) AS hours FROM e WHERE event_type = 'lab' UNION ALL SELECT stay_id, 'condition', token, NULL, NULL FROM e WHERE event_type = 'vital')")
def d07_d08_event_rows(spark, d):
    e = episodes(spark, d)
    return harmonize.event_rows({"lab": (e.where("event_type = 'lab'").withColumn("hours", F.round("hours", 9)), {"stay_id": "stay_id", "token": "token", "value": "value", "hours": "hours"}), "condition": (e.where("event_type = 'vital'"), {"stay_id": "stay_id", "token": "token"})})


@query("SELECT coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END, 'none') AS level, o_orderpriority, count(*) AS row_count FROM orders GROUP BY 1, 2")
def a06_a07_counts_by(spark, d):
    own = read(spark, d, "orders").withColumn("level", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")))
    return harmonize.counts_by(own, "level", "o_orderpriority")


@query("SELECT o_orderpriority, count(*) AS row_count, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_totalprice > 100000) AS large FROM orders GROUP BY 1")
def a08_conditional_sums(spark, d):
    return harmonize.conditional_sums(read(spark, d, "orders"), "o_orderpriority", {"finished": F.col("o_orderstatus") == "F", "large": F.col("o_totalprice") > 100000})


@query("SELECT nullif(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '') AS text_token, count(*) AS row_count, max(p_type) AS p_type, max(p_brand) AS p_brand FROM part GROUP BY 1")
def a09_text_review(spark, d):
    return harmonize.text_review(read(spark, d, "part"), "p_name", ["p_type", "p_brand"])


@query("SELECT p_type, CAST(sum(n) AS BIGINT) AS numeric_rows, CAST(sum(w) AS BIGINT) AS rows_with_unit, count(*) AS tokens, count(*) FILTER (WHERE u > 1) AS tokens_of_many_units FROM (SELECT p_type, p_brand, count(p_size) AS n, count(*) FILTER (WHERE p_partkey % 3 > 0) AS w, count(DISTINCT CASE WHEN p_partkey % 3 > 0 THEN p_size % 2 END) AS u FROM part GROUP BY 1, 2) GROUP BY 1")
def a10_unit_summary(spark, d):
    own = read(spark, d, "part").withColumn("unit", F.when(F.col("p_partkey") % 3 > 0, F.col("p_size") % 2))
    return harmonize.unit_summary(own, "p_type", "p_brand", "p_size", "unit")


@query(with_sql(STAYS_SQL) + "SELECT condition, stay_id, o_totalprice, round(sum(o_totalprice) OVER (PARTITION BY condition ORDER BY o_totalprice DESC, stay_id ROWS UNBOUNDED PRECEDING), 2) AS running FROM stays WHERE split = 'validation'")
def w09_running_sum(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("condition").orderBy(F.desc("o_totalprice"), "stay_id").rowsBetween(Window.unboundedPreceding, 0)
    return tpch.stays(spark, d).where("split = 'validation'").select("condition", "stay_id", "o_totalprice", F.round(F.sum("o_totalprice").over(w), 2).alias("running"))
