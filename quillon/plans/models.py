"""Queries: samples, vocabularies, audits, mappings, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import exprs
from quillon.operators import boosting, contract, fusion, learning, mappings, metrics, ranker
from quillon.sources.scratch import stash

from . import graphs, ranking, records, tpch
from .registry import query
from .tpch import BASE, K, SEED, TOP_N, read, with_sql


@query(with_sql(*BASE, "c AS (SELECT condition, count(*) FILTER (WHERE label) AS p, count(*) FILTER (WHERE NOT label) AS n FROM pcm WHERE split = 'train' GROUP BY 1)") + f"""SELECT group_id, candidate, label FROM pcm JOIN c USING (condition) WHERE split = 'train' AND
    (label OR (p > 0 AND CAST(CAST('0x' || substr(md5('{SEED}|' || group_id || '|' || candidate), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967295.0::DOUBLE < least(1, 0.5::DOUBLE * p / n)))""")
def d18_hash_sample(spark, d):
    return learning.sampled_rows(ranking.rows(spark, d).where("split = 'train'"), SEED, 0.5).select("group_id", "candidate", "label")


@query(with_sql(*BASE) + """SELECT group_id, candidate, label FROM (SELECT *, sum(label::INT) OVER (PARTITION BY group_id) AS p, row_number() OVER (PARTITION BY group_id, label ORDER BY md5('3|' || group_id || '|' || candidate), candidate) AS at_ FROM pcm WHERE split = 'train') WHERE p > 0 AND (label OR at_ <= greatest(2, p))""")
def w13_negative_cap(spark, d):
    return learning.capped_negatives(ranking.rows(spark, d).where("split = 'train'"), 3, 1, 2).select("group_id", "candidate", "label")


@query("""SELECT DISTINCT table_name, column_name, CASE WHEN data_type = 'VARCHAR' THEN 'categorical' ELSE 'numeric' END AS kind FROM duckdb_columns() WHERE table_name IN ('part', 'customer', 'documents')
    AND column_name NOT IN ('source', 'split', 'stay_id', 'patient_id', 'group_id', 'label', 'label_events', 'candidate') AND column_name NOT LIKE 'label\\_%' ESCAPE '\\' AND column_name NOT LIKE 'o\\_%' ESCAPE '\\'
    AND (data_type = 'VARCHAR' OR data_type IN ('DOUBLE', 'FLOAT', 'INTEGER', 'BIGINT', 'SMALLINT', 'TINYINT', 'BOOLEAN') OR data_type LIKE 'DECIMAL%')""")
def d37_feature_spec(spark, d):
    out = []
    for table in ("part", "customer", "documents"):
        spec = learning.feature_spec(read(spark, d, table))
        out += [(table, c, "numeric") for c in spec.numeric] + [(table, c, "categorical") for c in spec.categorical]
    return spark.createDataFrame(out, "table_name string, column_name string, kind string")


@query("SELECT quantile_cont(p_size, 0.5) AS p_size, quantile_cont(p_retailprice, 0.5) AS p_retailprice FROM part")
def d38_medians(spark, d):
    fills = learning.medians(read(spark, d, "part"), learning.FeatureSpec(["p_size", "p_retailprice"]))
    return spark.createDataFrame([(fills["p_size"], fills["p_retailprice"])], "p_size double, p_retailprice double")


@query(with_sql(*BASE, graphs.CONTEXT_SQL, "o AS (SELECT * FROM pcm WHERE split = 'train')", "s AS (SELECT * FROM ctx WHERE stay_id IN (SELECT stay_id FROM o))", "v AS (SELECT 'condition' AS vocabulary, condition AS token FROM o UNION SELECT 'candidate', candidate FROM o UNION SELECT 'context', event_type || '|' || token FROM s UNION SELECT 'event_type', event_type FROM s)") + "SELECT vocabulary, token, row_number() OVER (PARTITION BY vocabulary ORDER BY token) - 1 AS token_index FROM v")
def d43_vocabulary(spark, d):
    return contract.vocabularies(ranking.rows(spark, d), graphs.context(spark, d))


@query(with_sql(tpch.STAYS_SQL, "m AS (SELECT DISTINCT patient_id, CASE WHEN patient_id % 10 = 0 THEN 'test' ELSE split END AS s FROM stays WHERE patient_id % 7 > 0)") + "SELECT count(*) AS row_count, count(*) FILTER (WHERE split = s) AS aligned, count(*) FILTER (WHERE split <> s) AS misaligned, count(*) FILTER (WHERE s IS NULL) AS unknown FROM stays LEFT JOIN m USING (patient_id)")
def a33_split_alignment(spark, d):
    own = tpch.stays(spark, d)
    manifest = own.where("patient_id % 7 > 0").withColumn("split", F.when(F.col("patient_id") % 10 == 0, "test").otherwise(F.col("split")))
    return contract.split_alignment(own, manifest)


@query(with_sql(records.EPISODES) + "SELECT (SELECT count(*) FROM e WHERE hours > 72) AS events_after_prediction, (SELECT count(*) FROM e WHERE hours IS NULL) AS events_without_time, (SELECT count(*) FROM e WHERE token = 'purchase' AND (hours IS NULL OR hours <= 72 OR hours > 144)) AS labels_outside_window")
def a34_leakage_audit(spark, d):
    e = records.episodes(spark, d)
    return contract.leakage_audit(e, e.where("token = 'purchase'").withColumn("first_hours", F.col("hours")), 72.0, 144.0)


@query("""SELECT DISTINCT table_name, CAST(column_index - 1 AS BIGINT) AS position, column_name, CASE WHEN column_name LIKE 'label%' THEN 'label' WHEN column_name IN ('source', 'split') THEN 'partition' WHEN regexp_matches(column_name, '(^|_)(id|uid|uids|key)$') THEN 'identifier'
    WHEN column_name LIKE '%\\_version' ESCAPE '\\' THEN 'provenance' WHEN regexp_matches(column_name, '(^|_)(text|note|name|raw|code|codes)($|_)|(^|_)(expire|death|mortality|outcome|discharge)($|_)|(^|_)(time|date|timestamp)$') THEN 'excluded' ELSE 'feature' END AS role
    FROM duckdb_columns() WHERE table_name IN ('nation', 'documents', 'events', 'labels')""")
def d44_data_dictionary(spark, d):
    return contract.data_dictionary({t: read(spark, d, t) for t in ("nation", "documents", "events", "labels")}).drop("column_type")


@query("SELECT p_brand, p_type, count(*) AS row_count FROM part GROUP BY 1, 2")
def d54_code_inventory(spark, d):
    return mappings.code_inventory(read(spark, d, "part"), ["p_brand", "p_type"])


_TEXTS = "replace(replace(p_name, 'red', 'septic'), 'blue', 'infection')"


@query(f"SELECT p_partkey, nullif(regexp_replace(lower(trim({_TEXTS})), '[^a-z0-9]+', '_', 'g'), '') AS token, list_has_any(string_split({_TEXTS}, ' '), ['septic', 'infection']) AS infection FROM part")
def d56_sepsis_text(spark, d):
    text = F.replace(F.replace("p_name", F.lit("red"), F.lit("septic")), F.lit("blue"), F.lit("infection"))
    return read(spark, d, "part").select("p_partkey", mappings.infection_token(text).alias("t")).select("p_partkey", "t.*")


@query("SELECT concept, name AS label FROM (SELECT p_brand AS concept, p_name AS name, row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_type WHEN 'SMALL' THEN 1 ELSE 2 END, p_name) AS rn FROM part WHERE p_type IN ('SMALL', 'ECONOMY')) WHERE rn = 1")
def d57_concept_labels(spark, d):
    names = read(spark, d, "part").select(F.col("p_brand").alias("concept"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"))
    return mappings.concept_labels(names, ["SMALL", "ECONOMY"])


@query("""SELECT code, concept, class, CASE WHEN concept IS NULL THEN 'unmapped' ELSE 'reference' END AS method FROM (SELECT lpad(CAST(p_partkey * 7919 AS VARCHAR), 10, '1') AS code, p_partkey FROM part) c
    LEFT JOIN (SELECT lpad(CAST(p_partkey * 7919 AS VARCHAR), 10, '1') AS code, p_brand AS concept, CASE WHEN p_size > 20 THEN p_type END AS class FROM part WHERE p_partkey % 3 > 0) m USING (code)""")
def d49_code_mapping(spark, d):
    part = read(spark, d, "part").withColumn("code", F.lpad((F.col("p_partkey") * 7919).cast("string"), 10, "1"))
    known = part.where("p_partkey % 3 > 0")
    eleven = F.concat(F.substring("code", 1, 5), F.lit("0"), F.substring("code", 6, 10))
    concepts = known.select(eleven.alias("code"), F.concat_ws("/", "p_brand", "code").alias("concept"))
    classes = known.select(F.concat_ws("/", "p_brand", "code").alias("concept"), F.when(F.col("p_size") > 20, F.col("p_type")).alias("class"))
    return mappings.code_mapping(part, concepts, classes).withColumn("concept", F.substring_index("concept", "/", 1))


@query("""SELECT p_partkey, coalesce(a.v, b.v, c.v) AS concept, CASE WHEN a.v IS NOT NULL THEN 'list' WHEN b.v IS NOT NULL THEN 'group' WHEN c.v IS NOT NULL THEN 'name' END AS matched_by FROM part
    LEFT JOIN (SELECT p_size AS k, min(p_type) AS v FROM part WHERE p_size < 10 GROUP BY 1) a ON a.k = p_size LEFT JOIN (SELECT p_brand AS k, min(p_type) AS v FROM part WHERE p_brand < 'Brand#15' GROUP BY 1) b ON b.k = p_brand LEFT JOIN (SELECT p_name AS k, min(p_type) AS v FROM part WHERE p_size > 47 GROUP BY 1) c ON c.k = p_name""")
def d50_name_mapping(spark, d):
    part = read(spark, d, "part").withColumns({"concept": F.col("p_type"), "list_code": F.col("p_size").cast("string"), "group_code": F.col("p_brand")})
    drugs = part.select("p_partkey", "list_code", "group_code", F.concat(F.upper("p_name"), F.lit(" 5 MG tab")).alias("name"))
    own = mappings.name_mapping(drugs, part.where("p_size < 10").select("list_code", "concept"), part.where("p_brand < 'Brand#15'").select("group_code", "concept"), part.where("p_size > 47").select(F.col("p_name").alias("name"), "concept"))
    return own.select("p_partkey", "concept", "matched_by")


@query("SELECT category, CASE WHEN category <= 'Brand#1' AND category >= 'A' THEN 'first' END AS chapter FROM (SELECT DISTINCT substr(upper(trim(p_brand || p_type)), 1, 3) AS category FROM part)")
def s23_chapter_ranges(spark, d):
    ranges = spark.createDataFrame([("A", "Brand#1", "first"), ("X", "Z", "last")], "low string, high string, chapter string")
    return mappings.chapter_rows(read(spark, d, "part").select(F.concat("p_brand", "p_type").alias("code")), ranges)


@query("""WITH f AS (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 11, '0') AS c FROM part) SELECT p_partkey, form FROM f, (SELECT p_partkey AS k, unnest(list_distinct([c, substr(c, 2), CASE WHEN substr(c, 6, 1) = '0' THEN substr(c, 1, 5) || substr(c, 7) END, CASE WHEN substr(c, 10, 1) = '0' THEN substr(c, 1, 9) || substr(c, 11) END])) AS form FROM f) WHERE k = p_partkey AND form IS NOT NULL""")
def f17_code_variants(spark, d):
    return read(spark, d, "part").select("p_partkey", F.explode(exprs.code_variants(F.lpad(F.col("p_partkey").cast("string"), 11, "0"))).alias("form"))


@query()
def d39_d41_model_metrics(spark, d):
    """A linear model and trees fitted on sampled training rows, scored and measured on validation rows. Features follow from
    the condition and the candidate, so rows that are alike in these are one before they have any."""
    rows, featured = graphs.featured(spark, d)
    alike = learning.alike_rows(learning.sampled_rows(rows.where("split = 'train'"), SEED), learning.FeatureSpec(["candidate_rank"], ["condition", "candidate"]))
    train = stash(featured(alike), "train")
    prep = learning.Preprocessor.fit(train)
    models = {"linear": learning.fit_linear(train, prep), "trees": learning.fit_trees(train, prep)}
    return metrics.ranking_metrics(learning.model_scores(featured(rows.where("split = 'validation'")), prep, models), K)


@query()
def d42_ranker_metrics(spark, d):
    """Boosted ranking trees fitted on the training groups, measured on validation groups; tests hold the trees against
    plain ones."""
    rows = stash(graphs.features(spark, d), "features")
    names = ["candidate_rank", "pair_support", "pair_support_share", "candidate_condition_medication_support", "candidate_medication_medication_degree"]
    train = learning.ranking_frame(rows.where("split = 'train'"), names)
    model = ranker.fit_ranker(train, names, rounds=10)
    own = rows.where("split = 'validation'").select(*metrics.SCORED, F.lit("ranker").alias("baseline"), model.score().alias("score"))
    return metrics.ranking_metrics(own, K)


#: Folds of patients, and their seed.
FOLDS, FOLD_SEED = 3, 7
#: Features that the twin can bin as the engine does: their cuts are given.
PLAIN_FEATURES = {"candidate_rank": [float(c) for c in range(1, TOP_N)], "is_building": [0.0], "is_machinery": [0.0]}
PLAIN = boosting.Settings(rounds=2, depth=1, rate=0.5)


def _train_rows(spark, d):
    return stash(ranking.rows(spark, d).where("split = 'train'").withColumns({f"is_{n}": (F.col("condition") == f"cond:{n}").cast("int") for n in ("building", "machinery")}), "train")


def _round_sql(n: int, before: str) -> str:
    """Round n of the twin: of each run the split of the best gain over the rows of the other folds, then all rows' scores."""
    return f"""g{n} AS (SELECT run, f, cut, x <= cut AS low, y - 1 / (1 + exp(-s)) AS g, (1 / (1 + exp(-s))) * (1 - 1 / (1 + exp(-s))) AS h FROM {before} JOIN x USING (group_id, candidate) JOIN cuts USING (f) WHERE fold <> run),
    t{n} AS (SELECT run, f, cut, coalesce(sum(g) FILTER (WHERE low), 0) AS lg, coalesce(sum(h) FILTER (WHERE low), 0) AS lh, sum(g) AS ag, sum(h) AS ah FROM g{n} GROUP BY 1, 2, 3),
    b{n} AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY round(lg ** 2 / (lh + 1) + (ag - lg) ** 2 / (ah - lh + 1) - ag ** 2 / (ah + 1), 9) DESC, f, cut) AS nth FROM t{n} WHERE lh >= 1 AND ah - lh >= 1),
    s{n} AS MATERIALIZED (SELECT r.group_id, r.candidate, fold, run, y, s + {PLAIN.rate}::DOUBLE * CASE WHEN x <= cut THEN lg / (lh + 1) ELSE (ag - lg) / (ah - lh + 1) END AS s FROM {before} r JOIN b{n} USING (run) JOIN x ON x.group_id = r.group_id AND x.candidate = r.candidate AND x.f = b{n}.f WHERE nth = 1)"""


_PLAIN_SQL = (
    f"o AS MATERIALIZED (SELECT group_id, candidate, label::INT AS y, CAST(CAST('0x' || substr(md5('{FOLD_SEED}|' || patient_id), 1, 8) AS UBIGINT) % {FOLDS} AS BIGINT) AS fold, candidate_rank, condition FROM pcm WHERE split = 'train')",
    "x AS MATERIALIZED (SELECT group_id, candidate, 0 AS f, CAST(candidate_rank AS DOUBLE) AS x FROM o UNION ALL SELECT group_id, candidate, 1, (condition = 'cond:building')::INT FROM o UNION ALL SELECT group_id, candidate, 2, (condition = 'cond:machinery')::INT FROM o)",
    f"cuts AS (SELECT 0 AS f, CAST(i AS DOUBLE) AS cut FROM range(1, {TOP_N}) r(i) UNION ALL VALUES (1, 0.0::DOUBLE), (2, 0.0::DOUBLE))",
    f"s0 AS MATERIALIZED (SELECT group_id, candidate, fold, run, y, 0.0::DOUBLE AS s FROM o, range({FOLDS}) v(run))",
    _round_sql(1, "s0"),
    _round_sql(2, "s1"),
)


@query(with_sql(*BASE, *_PLAIN_SQL) + "SELECT group_id, candidate, fold, round(1 / (1 + exp(-s)), 6) AS score FROM s2 WHERE fold = run")
def d32_out_of_fold(spark, d):
    """Rows scored by boosted stumps of the other patients' rows, all folds grown in the same jobs."""
    own, _ = boosting.out_of_fold(_train_rows(spark, d), list(PLAIN_FEATURES), PLAIN, FOLDS, FOLD_SEED, cuts=list(PLAIN_FEATURES.values()))
    return own.select("group_id", "candidate", F.col("fold").cast("long").alias("fold"), F.round("score", 6).alias("score"))


GRAPH_FEATURES = ["candidate_rank", *graphs._FEATURES]
RANKER = boosting.Settings("ndcg", rounds=40, depth=4, rate=0.1, least_weight=1.0, rows=0.8, columns=0.8, patience=5, k=10)
REFERENCE = boosting.Settings("logistic", rounds=20, depth=4, rows=0.8, columns=0.8)


def _graph_rows(spark, d, split="train"):
    return stash(graphs.alike_features(spark, d, split, FOLD_SEED, FOLDS), "features")


@query()
def d42_early_stopping(spark, d):
    """Of each fold's ranking trees: how many were grown, how many are kept, and the NDCG of the patients left out with none
    of them and with these; tests hold the trees and where they stop against plain ones."""
    _, boosters = boosting.out_of_fold(_graph_rows(spark, d), GRAPH_FEATURES, RANKER, FOLDS, FOLD_SEED)
    out = [(k, len(b.held_out) - 1, len(b.trees), round(b.held_out[0], 6), round(b.held_out[len(b.trees)], 6)) for k, b in enumerate(boosters) if b.held_out]
    return spark.createDataFrame(out, "fold int, grown int, kept int, ndcg_without double, ndcg double")


def _both_scores(rows, features, settings):
    """rows with the out-of-fold scores of two models, the second scoring what the first has scored: a join would be a
    broadcast of all rows through the driver, as Spark takes their size from files that are far smaller."""
    other, _ = boosting.out_of_fold(rows, features, settings[0], FOLDS, FOLD_SEED, name="other_score")
    both, _ = boosting.out_of_fold(other, features, settings[1], FOLDS, FOLD_SEED, fit_on=rows, name="reference_score")
    return both.where("group_id is not null and candidate is not null").select(*fusion.KEY, "candidate_rank", "label", "reference_score", "other_score", *[c for c in rows.columns if c == learning.ALIKE])


@query()
def d34_out_of_fold_weights(spark, d):
    """The metrics of every weight between a ranker's and a reference's out-of-fold scores, and which weight is chosen."""
    rows = _graph_rows(spark, d)
    return fusion.marked_weight(fusion.rank_grid(_both_scores(rows, GRAPH_FEATURES, (RANKER, REFERENCE)), 10))


@query()
def d40_boosted_trees(spark, d):
    """200 trees of depth 6 on sampled training rows, measured on validation rows; tests hold the trees against plain ones."""
    rows = stash(graphs.features(spark, d), "features")
    train = learning.sampled_rows(rows.where("split = 'train'"), SEED).select("group_id", F.col("label").cast("int").alias("target"), F.lit(0).alias("place"), *GRAPH_FEATURES)
    boosters = boosting.fit(train, GRAPH_FEATURES, boosting.Settings(rows=0.8, columns=0.8))
    own = boosting.score(rows.where("split = 'validation'").select(*metrics.SCORED, *[c for c in GRAPH_FEATURES if c not in metrics.SCORED]), boosters, probability=True)
    return metrics.ranking_metrics(own.select(*metrics.SCORED, "score", F.lit("trees").alias("baseline")), K)


@query("""WITH p AS (SELECT p_partkey, p_name, p_brand, p_type, p_size, lpad(CAST(p_partkey AS VARCHAR), 11, '0') AS code, list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z]+', ' ', 'g')), ' '), lambda w: w <> '')) AS has FROM part),
    known AS (SELECT code AS form, 'c' || p_partkey AS concept FROM p WHERE p_size % 3 = 0), forms AS (SELECT code, unnest([code, substr(code, 2), CASE WHEN substr(code, 6, 1) = '0' THEN substr(code, 1, 5) || substr(code, 7) END, CASE WHEN substr(code, 10, 1) = '0' THEN substr(code, 1, 9) || substr(code, 11) END]) AS form, unnest(range(4)) AS at_ FROM p),
    by_code AS (SELECT code, arg_min(k, a) AS concept FROM (SELECT code, at_ AS a, min(concept) AS k FROM forms JOIN (SELECT form, concept FROM known UNION ALL SELECT substr(form, 2), 'd' || concept FROM known WHERE CAST(form AS BIGINT) % 2 = 0) USING (form) GROUP BY 1, 2) GROUP BY 1),
    refs AS (SELECT DISTINCT p_brand AS concept, has AS of_ FROM p WHERE p_size > 44), miss AS (SELECT code, has FROM p ANTI JOIN by_code USING (code)),
    near AS (SELECT code, concept, max(len(of_)) AS shared FROM miss JOIN refs ON list_has_all(has, of_) GROUP BY 1, 2), named AS (SELECT n.code, concept, shared, len(has) AS n FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY shared DESC, concept) AS rn FROM near) n JOIN miss USING (code) WHERE rn = 1),
    m AS (SELECT p.code, p_name, coalesce(b.concept, d.concept) AS concept, CASE WHEN b.concept IS NOT NULL THEN 'code' WHEN d.shared = d.n THEN 'same' WHEN d.shared IS NOT NULL THEN 'part' END AS how FROM p LEFT JOIN by_code b USING (code) LEFT JOIN named d USING (code)),
    cls AS (SELECT concept, min(class) AS class, count(DISTINCT class) AS n FROM (SELECT 'c' || p_partkey AS concept, p_type AS class FROM p WHERE p_partkey % 4 = 0 UNION ALL SELECT 'c' || p_partkey, p_brand FROM p WHERE p_partkey % 8 = 0 UNION ALL SELECT p_brand, p_type FROM p) GROUP BY 1),
    j AS (SELECT m.*, CASE WHEN m.concept LIKE 'c%' THEN p.p_brand END AS ingredient, a.class AS own, a.n AS own_n, CASE WHEN m.concept LIKE 'c%' THEN i.class END AS of_part, i.n AS part_n FROM m JOIN p USING (code) LEFT JOIN cls a ON a.concept = m.concept LEFT JOIN cls i ON i.concept = p.p_brand)
    SELECT code, p_name AS name, concept, ingredient, substr(upper(coalesce(own, of_part)), 1, 4) AS class, CASE WHEN how IS NOT NULL THEN CASE WHEN how = 'code' THEN 'code' ELSE 'name' END || CASE WHEN own IS NOT NULL THEN ';class' WHEN of_part IS NOT NULL THEN ';class(ingredient)' ELSE '' END END AS source,
      CASE WHEN how IS NULL THEN 'unmapped' WHEN how = 'part' THEN 'low' WHEN how = 'same' OR coalesce(own_n, CASE WHEN of_part IS NOT NULL THEN part_n END) > 1 OR coalesce(own, of_part) IS NULL THEN 'medium' ELSE 'high' END AS confidence,
      CASE WHEN how IS NULL THEN 'unmapped_code_to_concept' WHEN coalesce(own, of_part) IS NOT NULL THEN 'mapped_concept_class' ELSE 'mapped_concept_missing_class' END AS status FROM j""")
def d53_graded_codes(spark, d):
    """Codes by their forms, else by the words of their names; classes by concept, else by ingredient."""
    part = read(spark, d, "part").withColumn("code", F.lpad(F.col("p_partkey").cast("string"), 11, "0"))
    own = F.concat(F.lit("c"), "p_partkey")
    known = part.where("p_size % 3 = 0").select("code", own.alias("concept"))
    ten = known.where("cast(code as bigint) % 2 = 0").select(F.expr("substring(code, 2)").alias("code"), F.concat(F.lit("d"), "concept").alias("concept"))
    classes = part.where("p_partkey % 4 = 0").select(own.alias("concept"), F.col("p_type").alias("class")).union(part.where("p_partkey % 8 = 0").select(own, "p_brand")).union(part.select("p_brand", "p_type"))
    ingredients = part.select(own.alias("concept"), F.col("p_brand").alias("ingredient"), F.col("p_brand").alias("ingredient_concept"))
    return mappings.graded_codes(part.select("code", F.col("p_name").alias("name")), known.union(ten), classes, ingredients, part.where("p_size > 44").select(F.col("p_brand").alias("concept"), F.col("p_name").alias("name")))
