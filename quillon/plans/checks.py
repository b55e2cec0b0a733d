"""Queries: selection, gates, contracts, numbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import exprs
from quillon.operators import contract, fusion, graph, learning, metrics, profile, relational, training

from . import graphs, ranking, records, tpch
from .registry import query
from .tpch import BASE, K, RANKED_SQL, SCORES_SQL, per_group_sql, read, with_sql

_METRICS = "metrics AS (SELECT baseline, source, split, round(avg(ndcg), 6) AS ndcg, round(avg(rr), 6) AS mrr, round(avg(hit), 6) AS hit FROM per GROUP BY ALL)"
_GRID = (*BASE, graphs.RAW_SQL, graphs.fused_sql(), RANKED_SQL, per_group_sql(K), graphs.GRID_SQL)
_NORMAL = """normal AS MATERIALIZED (SELECT * EXCLUDE (score, n, p), CASE WHEN n = 1 THEN 1 ELSE 1 - (p - 1) / CAST(n - 1 AS DOUBLE) END AS score
    FROM (SELECT *, count(*) OVER (PARTITION BY baseline, group_id) AS n, row_number() OVER (PARTITION BY baseline, group_id ORDER BY score DESC, candidate_rank, candidate) AS p FROM raw))"""


@query(with_sql(*_GRID) + "SELECT * FROM grid WHERE split = 'validation' AND ndcg IS NOT NULL ORDER BY ndcg DESC, abs(weight - 0.5), weight LIMIT 1")
def d28_best_weight(spark, d):
    return fusion.best_weight(fusion.fusion_grid(graphs.pairs(spark, d).where("split = 'validation'"), K))


@query(with_sql(*BASE, graphs.RAW_SQL, _NORMAL, graphs.fused_sql(raw="normal"), RANKED_SQL, per_group_sql(K), graphs.GRID_SQL) + "SELECT * FROM grid")
def d34_rank_grid(spark, d):
    return fusion.rank_grid(graphs.pairs(spark, d), K)


@query(with_sql(*BASE, SCORES_SQL, RANKED_SQL, per_group_sql(K), _METRICS, """deltas AS (SELECT c.source, c.split, round(c.ndcg - r.ndcg, 9) AS delta_ndcg, round(c.mrr - r.mrr, 9) AS delta_mrr, round(c.hit - r.hit, 9) AS delta_hit
    FROM metrics c JOIN metrics r USING (source, split) WHERE c.baseline = 'condition_popularity' AND r.baseline = 'random')""") + "SELECT *, CASE WHEN delta_ndcg >= 0.005 AND delta_mrr >= -0.01 AND delta_hit >= -0.01 THEN 'promote' ELSE 'keep_reference' END AS decision FROM deltas")
def d35_gate(spark, d):
    out = fusion.gate_table(metrics.grouped_metrics(ranking.scored_groups(spark, d), K), "condition_popularity", "random")
    return out.withColumns({c: F.round(c, 9) for c in ("delta_ndcg", "delta_mrr", "delta_hit")})


@query(with_sql(*BASE, SCORES_SQL, RANKED_SQL, per_group_sql(K), _METRICS) + "SELECT source, split, baseline FROM (SELECT *, row_number() OVER (PARTITION BY source, split ORDER BY ndcg DESC, mrr DESC NULLS LAST, hit DESC NULLS LAST, baseline) AS n FROM metrics WHERE ndcg IS NOT NULL) WHERE n = 1")
def d33_best_result(spark, d):
    return fusion.best_result(metrics.grouped_metrics(ranking.scored_groups(spark, d), K))


@query(with_sql(*graphs.GRAPH, "b AS (SELECT src_type || '|' || src_id AS a, dst_type || '|' || dst_id AS b FROM big UNION SELECT dst_type || '|' || dst_id, src_type || '|' || src_id FROM big)").replace("WITH ", "WITH RECURSIVE ", 1) + """, r(s, t) AS (SELECT a, a FROM b UNION SELECT r.s, b.b FROM r JOIN b ON r.t = b.a), c AS (SELECT component, count(*) AS n FROM (SELECT s, min(t) AS component FROM r GROUP BY 1) GROUP BY 1)
    SELECT count(*) AS edges, count(*) FILTER (WHERE relation = 'condition_medication') AS pair_edges, (SELECT max(n) FROM c) AS largest_component, CASE WHEN count(*) FILTER (WHERE relation = 'condition_medication') > 0 AND (SELECT max(n) FROM c) >= 2 THEN 'passed' ELSE 'blocked' END AS status FROM big""")
def d24_graph_gate(spark, d):
    e = graphs.strong(graphs.edges(spark, d))
    return graph.gate_row(e, graph.components(e))


@query(with_sql(*BASE) + """SELECT group_id, candidate, row_number() OVER (PARTITION BY group_id ORDER BY candidate_rank, candidate) AS place, count(*) OVER (PARTITION BY group_id) AS group_size, label::INT AS target, candidate_rank AS feature_rank, condition FROM pcm""")
def k05_ranking_frame(spark, d):
    return learning.ranking_frame(ranking.rows(spark, d), ["candidate_rank", "condition"], {"candidate_rank": "feature_rank"})


@query(with_sql(*BASE, records.EPISODES, "m AS (SELECT DISTINCT patient_id, CASE WHEN patient_id % 10 = 0 THEN 'test' ELSE split END AS s FROM stays WHERE patient_id % 7 > 0)", "p AS (SELECT DISTINCT patient_id, split FROM pcm)",
    """v AS (SELECT 'row_count' AS "check", (SELECT count(*) FROM pcm) AS value UNION ALL SELECT 'repeated_keys', (SELECT count(*) FROM (SELECT group_id FROM pcm GROUP BY group_id, candidate HAVING count(*) > 1))
    UNION ALL SELECT 'misaligned_patients', (SELECT count(*) FROM p JOIN m USING (patient_id) WHERE split <> s) UNION ALL SELECT 'unknown_patients', (SELECT count(*) FROM p ANTI JOIN m USING (patient_id))
    UNION ALL SELECT 'events_after_prediction', (SELECT count(*) FROM e WHERE hours > 72) UNION ALL SELECT 'events_without_time', (SELECT count(*) FROM e WHERE hours IS NULL) UNION ALL SELECT 'labels_outside_window', (SELECT count(*) FROM e WHERE token = 'purchase' AND (hours IS NULL OR hours <= 72 OR hours > 144)))""") + """SELECT "check", value, CASE "check" WHEN 'row_count' THEN value > 0 ELSE value = 0 END AS passed FROM v""")
def d46_contract_checks(spark, d):
    rows, e = ranking.rows(spark, d), records.episodes(spark, d)
    manifest = tpch.stays(spark, d).where("patient_id % 7 > 0").select("patient_id", F.when(F.col("patient_id") % 10 == 0, "test").otherwise(F.col("split")).alias("split"))
    return contract.contract_checks(rows, manifest, e, e.where("token = 'purchase'").withColumn("first_hours", F.col("hours")), 72.0, 144.0)


@query("""WITH t AS (SELECT nullif(CASE WHEN p_size % 3 = 0 THEN p_brand ELSE ' ' END, ' ') AS a, CASE WHEN p_size > 40 THEN 'many' ELSE CAST(p_size AS VARCHAR) END AS b FROM part),
    f AS (SELECT 'a' AS column_name, 'high_null_rate' AS issue, count(*) FILTER (WHERE a IS NULL) AS rows, count(*) FILTER (WHERE a IS NULL) / CAST(count(*) AS DOUBLE) AS rate, 0.5 AS least FROM t
      UNION ALL SELECT 'b', 'parse_failures', count(*) FILTER (WHERE b = 'many'), count(*) FILTER (WHERE b = 'many') / CAST(count(*) AS DOUBLE), 0 FROM t
      UNION ALL SELECT 'b', 'out_of_bounds', count(*) FILTER (WHERE b <> 'many' AND CAST(nullif(b, 'many') AS INT) > 30), count(*) FILTER (WHERE b <> 'many' AND CAST(nullif(b, 'many') AS INT) > 30) / CAST(count(*) AS DOUBLE), 0 FROM t)
    SELECT column_name, issue, rows, round(rate, 9) AS rate FROM f WHERE rows > 0 AND rate >= least""")
def d59_findings(spark, d):
    part = read(spark, d, "part").select(F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(" ").alias("a"), F.when(F.col("p_size") > 40, "many").otherwise(F.col("p_size").cast("string")).alias("b"))
    own = profile.profile_columns(part, [profile.ColumnSpec("a"), profile.ColumnSpec("b", "number", 0, 30)], approximate=False)
    return profile.findings(own).withColumn("rate", F.round("rate", 9))


@query("SELECT max('v3') AS version FROM orders")
def a32_one_version(spark, d):
    tables = [read(spark, d, t).withColumn("version", F.lit("v3")) for t in ("orders", "customer")] + [read(spark, d, "nation")]
    return spark.createDataFrame([(profile.one_version(tables, "version", "v3"),)], "version string")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS row_id FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem)")
def w05_w06_dense_ids(spark, d):
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    return relational.dense_ids(lines, ["l_orderkey", "l_linenumber", "l_partkey"]).drop("l_partkey")


@query("SELECT event_id, ts + INTERVAL 36 HOUR AS later, ts + INTERVAL 90 MINUTE AS soon FROM events")
def f10_after_hours(spark, d):
    return read(spark, d, "events").select("event_id", exprs.after_hours(F.col("ts"), 36).alias("later"), exprs.after_hours(F.col("ts"), 1.5).alias("soon"))


@query(with_sql(*BASE, SCORES_SQL) + "SELECT baseline, group_id, candidate, round(score, 9) AS score, CASE WHEN baseline = 'random' THEN 'drawn' END AS note FROM scores WHERE baseline <> 'global_popularity'")
def u04_combined_scores(spark, d):
    own = ranking.scores(spark, d).select("baseline", "group_id", "candidate", F.round("score", 9).alias("score"))
    return relational.union_by_name([own.where("baseline = 'random'").withColumn("note", F.lit("drawn")), own.where("baseline = 'condition_popularity'")], missing=True)


@query(with_sql(*BASE) + "SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS positives FROM (SELECT group_id, count(*) AS n FROM pcm WHERE label GROUP BY 1)")
def a24_positive_groups(spark, d):
    own = training.ranking_rows(tpch.stays(spark, d), ranking._catalog(spark, d), tpch.labels(spark, d))
    return own.groupBy("group_id").agg(F.count_if("label").alias("n")).where("n > 0").agg(F.count("*").alias("groups"), F.sum("n").alias("positives"))
