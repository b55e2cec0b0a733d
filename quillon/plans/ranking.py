"""Queries: ranking rows, baselines and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import exprs
from quillon.operators import metrics, training
from quillon.sources.scratch import stash

from . import tpch
from .registry import query
from .tpch import BASE, K, RANKED_SQL, SCORES_SQL, TOP_N, per_group_sql, with_sql


def _catalog(spark, d):
    return training.candidate_catalog(tpch.stays(spark, d), tpch.labels(spark, d), TOP_N)


def _held(spark, d, context=None):
    """Stays with their candidates (and context) in arrays, written once, and their catalog, written too, so that Spark knows
    its size."""
    stays = tpch.stays(spark, d).drop("o_orderpriority", "o_totalprice", "o_orderdate")
    held = stash(training.stay_labels(stays, tpch.labels(spark, d), context), "held")
    return held, stash(training.held_catalog(held, TOP_N), "catalog")


def groups(spark, d, context=None):
    """Ranking groups, a row each. To read them again is to read stays, so they are not written."""
    return training.ranking_groups(*_held(spark, d, context))


def _popular(spark, d):
    """Stays with their candidates, and the catalog with its scores."""
    held, catalog = _held(spark, d)
    return held, stash(metrics.popularity(catalog), "popularity")


def scored_groups(spark, d, drawn=True):
    """Ranking groups whose members have the baselines' scores (the random one only if drawn)."""
    out = training.ranking_groups(*_popular(spark, d), metrics.POPULARITY)
    return metrics.drawn_scores(out, tpch.SEED) if drawn else out


def rows(spark, d):
    return training.group_rows(groups(spark, d))


def scores(spark, d):
    return metrics.stacked_scores(scored_groups(spark, d))


_METRICS = "round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(hit), 6) AS hit, round(avg(ndcg), 6) AS ndcg, round(avg(rr), 6) AS mrr"


def _ranking_sql(k):
    return with_sql(*BASE, SCORES_SQL, RANKED_SQL, per_group_sql(k)) + f"""SELECT s.baseline, s.source, s.split, {k}::BIGINT AS k, count(p.group_id) AS groups, {_METRICS}
      FROM (SELECT DISTINCT baseline, source, split FROM scores) s LEFT JOIN per p USING (baseline, source, split) GROUP BY 1, 2, 3"""


@query(with_sql(*BASE, SCORES_SQL, RANKED_SQL, per_group_sql(K)) + "SELECT split, count(*) AS groups, round(avg(ndcg), 6) AS ndcg FROM per WHERE baseline = 'condition_popularity' GROUP BY split")
def flagship_ndcg(spark, d):
    """Catalog, popularity and NDCG in one plan."""
    own = metrics.group_sums(scored_groups(spark, d, False), K, ("condition_popularity",)).groupBy("split").agg(F.sum("groups").alias("groups"), F.sum("ndcg").alias("ndcg"))
    return own.where("groups > 0").select("split", "groups", F.round(F.col("ndcg") / F.col("groups"), 6).alias("ndcg"))


def _at(k):
    def run(spark, d):
        return metrics.grouped_metrics(scored_groups(spark, d), k)

    run.__name__ = f"d16_ranking_metrics_at_{k}"
    query(_ranking_sql(k))(run)


for _k in (1, 3, 5, 10):
    _at(_k)


@query(with_sql(*BASE) + "SELECT condition, candidate, stays, events, candidate_name, class_code, candidate_rank FROM catalog")
def d13_catalog(spark, d):
    return _catalog(spark, d)


@query(with_sql(*BASE) + "SELECT count(*) AS row_count, count(DISTINCT condition) AS conditions, count(DISTINCT candidate) AS candidates, min(candidate_rank) AS least_rank, max(candidate_rank) AS largest_rank FROM catalog")
def a23_catalog_summary(spark, d):
    return metrics.catalog_summary(_catalog(spark, d))


@query(with_sql(*BASE) + "SELECT source, split, group_id, condition, candidate, candidate_rank, label, label_events FROM pcm")
def j10_candidate_expand(spark, d):
    return rows(spark, d).select("source", "split", "group_id", "condition", "candidate", "candidate_rank", "label", "label_events")


@query(with_sql(*BASE) + """SELECT source, split, count(*) AS positives, count(*) FILTER (WHERE c.candidate IS NULL) AS out_of_catalog
    FROM stays s JOIN labels l USING (stay_id) LEFT JOIN catalog c ON c.condition = s.condition AND c.candidate = l.candidate GROUP BY 1, 2""")
def j11_out_of_catalog(spark, d):
    return training.out_of_catalog(tpch.stays(spark, d), _catalog(spark, d), tpch.labels(spark, d))


@query(with_sql(*BASE, SCORES_SQL) + "SELECT baseline, source, split, group_id, candidate, round(score, 9) AS score FROM scores")
def d14_popularity(spark, d):
    return scores(spark, d).select("baseline", "source", "split", "group_id", "candidate", F.round("score", 9).alias("score"))


@query(with_sql(*BASE, SCORES_SQL, """o AS (SELECT *, row_number() OVER (PARTITION BY baseline, source, split ORDER BY score DESC, candidate_rank, candidate, CAST('0x' || substr(md5(group_id), 1, 8) AS UBIGINT) % 256, group_id) AS nth,
      sum(label::INT) OVER (PARTITION BY baseline, source, split ORDER BY score DESC, candidate_rank, candidate, CAST('0x' || substr(md5(group_id), 1, 8) AS UBIGINT) % 256, group_id ROWS UNBOUNDED PRECEDING) AS seen,
      rank() OVER (PARTITION BY baseline, source, split ORDER BY score) AS low, count(*) OVER (PARTITION BY baseline, source, split, score) AS ties,
      CAST(least(9, floor(10 * greatest(0, least(1, score)))) AS INTEGER) AS bin FROM scores)""",
    """e AS (SELECT baseline, source, split, sum(gap) AS gap FROM (SELECT baseline, source, split, bin, abs(sum(label::INT) - sum(score)) AS gap FROM o GROUP BY ALL) GROUP BY ALL)""",
    """m AS (SELECT baseline, source, split, count(*) AS row_count, CAST(sum(label::INT) AS BIGINT) AS positives, sum(CASE WHEN label THEN CAST(seen AS DOUBLE) / nth END) AS ap,
      sum(CASE WHEN label THEN low + (ties - 1) / 2.0::DOUBLE END) AS ranks, avg((score - label::INT) ** 2) AS brier FROM o GROUP BY ALL)""") + """
    SELECT baseline, source, split, row_count, positives, CASE WHEN positives > 0 AND positives < row_count THEN round(ap / positives, 6) END AS average_precision,
      CASE WHEN positives > 0 AND positives < row_count THEN round((ranks - positives * (positives + 1) / 2.0::DOUBLE) / (CAST(positives AS DOUBLE) * (row_count - positives)), 6) END AS roc_auc,
      CASE WHEN positives > 0 AND positives < row_count THEN round(brier, 6) END AS brier, CASE WHEN positives > 0 AND positives < row_count THEN round(gap / row_count, 6) END AS calibration_error
    FROM m JOIN e USING (baseline, source, split)""")
def d15_row_metrics(spark, d):
    held, popular = _popular(spark, d)
    return metrics.grouped_row_metrics(training.ranking_groups(held, popular), popular, seed=tpch.SEED)


@query(with_sql(*BASE, SCORES_SQL, RANKED_SQL, per_group_sql(K)) + """SELECT s.baseline, s.source, s.split, s.condition, count(p.group_id) AS groups,
      CASE WHEN count(p.group_id) >= 200 THEN round(avg(precision), 6) END AS precision, CASE WHEN count(p.group_id) >= 200 THEN round(avg(recall), 6) END AS recall, CASE WHEN count(p.group_id) >= 200 THEN round(avg(hit), 6) END AS hit,
      CASE WHEN count(p.group_id) >= 200 THEN 'reported' ELSE 'suppressed_low_positive_group_count' END AS status
      FROM (SELECT DISTINCT baseline, source, split, condition FROM scores) s LEFT JOIN per p USING (baseline, source, split, condition) GROUP BY 1, 2, 3, 4""")
def d17_suppressed_metrics(spark, d):
    return metrics.grouped_condition_metrics(scored_groups(spark, d), K, 200)


@query(with_sql(*BASE) + """SELECT source, split, CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(p) AS BIGINT) AS positives, count(*) AS groups, count(*) FILTER (WHERE p > 0) AS positive_groups
    FROM (SELECT source, split, group_id, count(*) AS n, count(*) FILTER (WHERE label) AS p FROM pcm GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def a22_coverage_summary(spark, d):
    return metrics.coverage_summary(rows(spark, d))


@query(with_sql(*BASE, "c AS (SELECT source, split, count(*) FILTER (WHERE p > 0) AS positive_groups FROM (SELECT source, split, group_id, count(*) FILTER (WHERE label) AS p FROM pcm GROUP BY 1, 2, 3) GROUP BY 1, 2)") + "SELECT *, CASE WHEN positive_groups = 0 THEN 'coverage_only' WHEN positive_groups < 1100 THEN 'diagnostic' ELSE 'evaluable' END AS status FROM c")
def d48_evaluability(spark, d):
    return metrics.evaluability(metrics.coverage_summary(rows(spark, d)).select("source", "split", "positive_groups"), 1100)


@query(with_sql(tpch.STAYS_SQL) + "SELECT source, patient_id, split, count(*) AS stays FROM stays GROUP BY 1, 2, 3")
def a19_split_manifest(spark, d):
    return training.split_manifest(tpch.stays(spark, d))


@query(with_sql(tpch.STAYS_SQL) + "SELECT count(*) AS patients, count(*) FILTER (WHERE n > 1) AS patients_in_many_splits FROM (SELECT patient_id, count(DISTINCT split) AS n FROM stays GROUP BY 1)")
def a20_split_integrity(spark, d):
    return training.split_integrity(tpch.stays(spark, d))


@query("""SELECT CAST(sum(n) AS BIGINT) AS row_count, count(*) FILTER (WHERE n > 1) AS duplicate_keys, CAST(sum(lacks) AS BIGINT) AS rows_lacking_fields
    FROM (SELECT l_orderkey, l_linenumber, count(*) AS n, sum((l_shipdate IS NULL OR l_partkey IS NULL)::INT) AS lacks FROM lineitem GROUP BY 1, 2)""")
def a21_cohort_integrity(spark, d):
    return training.cohort_integrity(tpch.read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey"])


@query("""SELECT 'lineitem' AS table_name, count(*) AS row_count, count(*) FILTER (WHERE l_orderkey IS NULL) AS invalid_keys, count(*) FILTER (WHERE o_orderkey IS NULL AND l_orderkey IS NOT NULL) AS orphans FROM lineitem LEFT JOIN (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT') ON l_orderkey = o_orderkey""")
def j12_join_integrity(spark, d):
    orders = tpch.read(spark, d, "orders").where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("key"))
    return training.join_integrity({"lineitem": tpch.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"))}, orders, "key")


@query(with_sql(tpch.STAYS_SQL) + "SELECT DISTINCT patient_id, split, CAST(CAST('0x' || substr(md5('7|' || patient_id), 1, 8) AS UBIGINT) % 5 AS BIGINT) AS fold FROM stays")
def p15_split_and_p17_fold(spark, d):
    return tpch.stays(spark, d).select("patient_id", "split", exprs.patient_fold(F.col("patient_id"), 7, 5).alias("fold")).distinct()


@query(with_sql(*BASE, SCORES_SQL) + "SELECT baseline, source, split, count(*) AS row_count FROM scores WHERE split IN ('train', 'validation') AND source = 'dev' AND condition IN ('cond:building', 'cond:machinery') GROUP BY 1, 2, 3")
def p18_p19_scoring_scope(spark, d):
    own = scores(spark, d).where(exprs.scoring_scope(F.col("source"), F.col("split"), False) & exprs.allowed(F.col("condition"), ["cond:building", "cond:machinery"]))
    return own.groupBy("baseline", "source", "split").agg(F.count("*").alias("row_count"))
