"""The driver's tables as the engine's inputs, in DataFrames and in the SQL of the twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.exprs import split_name

SEED = 20260617
TOP_N = 10
K = 5


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a stay, its customer the patient, the market segment the condition."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("stay_id"), F.col("o_custkey").alias("patient_id"), "o_orderpriority", "o_totalprice", "o_orderdate")
    who = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("patient_id"), F.when(F.col("c_nationkey") % 5 == 0, "external").otherwise("dev").alias("source"), F.concat(F.lit("cond:"), F.lower("c_mktsegment")).alias("condition"))
    who = who.withColumn("split", split_name(F.col("patient_id"), F.col("source"), SEED))
    return orders.join(who, "patient_id")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brands of an order's lines are its candidates. Lines are dealt by stay, as all that follows needs them: few are
    alike, so counting before would save little."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("med:"), "p_brand").alias("candidate"), F.col("p_name").alias("candidate_name"), F.col("p_type").alias("class_code"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("stay_id"), "l_partkey")
    return lines.join(part, "l_partkey").repartition("stay_id").groupBy("stay_id", "candidate").agg(F.count("*").alias("events"), F.min("candidate_name").alias("candidate_name"), F.min("class_code").alias("class_code"))


STAYS_SQL = f"""stays AS MATERIALIZED (SELECT stay_id, patient_id, source, condition, o_orderpriority, o_totalprice, o_orderdate,
      CASE WHEN source = 'external' THEN 'external' WHEN bucket < 8000 THEN 'train' WHEN bucket < 9000 THEN 'validation' ELSE 'test' END AS split
    FROM (SELECT o_orderkey AS stay_id, o_custkey AS patient_id, o_orderpriority, o_totalprice, o_orderdate, CASE WHEN c_nationkey % 5 = 0 THEN 'external' ELSE 'dev' END AS source,
      'cond:' || lower(c_mktsegment) AS condition, CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR) || '|{SEED}'), 1, 8) AS UBIGINT) % 10000 AS bucket
      FROM orders JOIN customer ON o_custkey = c_custkey))"""
LABELS_SQL = "labels AS MATERIALIZED (SELECT l_orderkey AS stay_id, 'med:' || p_brand AS candidate, count(*) AS events, min(p_name) AS candidate_name, min(p_type) AS class_code FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
CATALOG_SQL = f"""catalog AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY stays DESC, events DESC, candidate) AS candidate_rank
    FROM (SELECT condition, candidate, count(DISTINCT stay_id) AS stays, CAST(sum(events) AS BIGINT) AS events, min(candidate_name) AS candidate_name, min(class_code) AS class_code FROM stays JOIN labels USING (stay_id)
      WHERE source = 'dev' AND split = 'train' GROUP BY 1, 2)) WHERE candidate_rank <= {TOP_N})"""
ROWS_SQL = """pcm AS MATERIALIZED (SELECT s.*, c.candidate, c.candidate_rank, l.events AS label_events, s.stay_id || '|' || s.condition AS group_id, l.events IS NOT NULL AS label
    FROM stays s JOIN catalog c USING (condition) LEFT JOIN labels l ON l.stay_id = s.stay_id AND l.candidate = c.candidate)"""
SCORES_SQL = f"""fitting AS (SELECT * FROM pcm WHERE source = 'dev' AND split = 'train' AND label),
    scores AS MATERIALIZED (SELECT source, split, stay_id, group_id, p.condition, p.candidate, candidate_rank, label, baseline,
      CASE baseline WHEN 'random' THEN CAST(CAST('0x' || substr(md5('{SEED}|' || group_id || '|' || p.candidate), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967295.0::DOUBLE
        WHEN 'global_popularity' THEN coalesce(CAST(a.n AS DOUBLE) / (SELECT count(*) FROM fitting), 0) ELSE coalesce(CAST(b.n AS DOUBLE) / d.n, 0) END AS score
      FROM pcm p CROSS JOIN (VALUES ('random'), ('global_popularity'), ('condition_popularity')) v(baseline)
      LEFT JOIN (SELECT candidate, count(*) AS n FROM fitting GROUP BY 1) a ON a.candidate = p.candidate
      LEFT JOIN (SELECT condition, candidate, count(*) AS n FROM fitting GROUP BY 1, 2) b ON b.condition = p.condition AND b.candidate = p.candidate
      LEFT JOIN (SELECT condition, count(*) AS n FROM fitting GROUP BY 1) d ON d.condition = p.condition)"""
RANKED_SQL = """ranked AS (SELECT *, row_number() OVER (PARTITION BY baseline, source, split, group_id ORDER BY score DESC, candidate_rank, candidate) AS place,
      count(*) OVER (PARTITION BY baseline, source, split, group_id) AS size, sum(label::INT) OVER (PARTITION BY baseline, source, split, group_id) AS positives FROM scores)"""


def per_group_sql(k: int) -> str:
    return f"""per AS (SELECT baseline, source, split, condition, group_id, max(positives) AS positives, count(*) FILTER (WHERE label AND place <= {k}) AS hits,
      count(*) FILTER (WHERE label AND place <= {k}) / CAST(least({k}, max(size)) AS DOUBLE) AS precision, count(*) FILTER (WHERE label AND place <= {k}) / CAST(max(positives) AS DOUBLE) AS recall,
      CASE WHEN count(*) FILTER (WHERE label AND place <= {k}) > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit,
      coalesce(sum(CASE WHEN label AND place <= {k} THEN 1.0::DOUBLE / log2(place + 1) END), 0) / (SELECT sum(1.0::DOUBLE / log2(r + 1)) FROM range(1, 1 + CAST(least({k}, max(positives)) AS BIGINT)) t(r)) AS ndcg,
      coalesce(max(CASE WHEN label AND place <= {k} THEN 1.0::DOUBLE / place END), 0) AS rr FROM ranked WHERE positives > 0 GROUP BY 1, 2, 3, 4, 5)"""


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


BASE = (STAYS_SQL, LABELS_SQL, CATALOG_SQL, ROWS_SQL)
