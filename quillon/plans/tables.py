"""Queries: text normal forms, lookups, de-duplication, profiles, extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import exprs
from quillon.operators import profile, relational
from quillon.sources import files

from . import tpch
from .registry import query
from .tpch import STAYS_SQL, read, with_sql


@query("""SELECT p_partkey, nullif(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '') AS token, nullif(regexp_replace(lower(trim(p_type)), '[^a-z0-9]', '', 'g'), '') AS code,
    nullif(regexp_replace(lower(trim('  ' || p_brand || '   x ')), '\\s+', ' ', 'g'), '') AS unit FROM part""")
def p01_p03_normal_forms(spark, d):
    own = read(spark, d, "part")
    return own.select("p_partkey", exprs.text_token(F.col("p_name")).alias("token"), exprs.code_key(F.col("p_type")).alias("code"), exprs.unit_text(F.concat(F.lit("  "), "p_brand", F.lit("   x "))).alias("unit"))


@query("""SELECT o_orderstatus, count(*) AS orders, count(*) FILTER (WHERE NOT coalesce(lower(trim(o_orderstatus)) IN ('yes', 'y', 'true', '1', 'f'), FALSE)) AS kept,
    count(*) FILTER (WHERE coalesce(trim(o_orderpriority) <> '', FALSE)) AS filled FROM orders GROUP BY 1""")
def p04_p05_flags(spark, d):
    status = F.col("o_orderstatus")
    gone = F.coalesce(exprs.says_true(status) | (F.lower(F.trim(status)) == "f"), F.lit(False))
    return read(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.count_if(~gone).alias("kept"), F.count_if(exprs.nonblank(F.col("o_orderpriority"))).alias("filled"))


@query("""SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN nullif(trim(p_brand), '') END, nullif(trim(p_type), '')) AS token_a, coalesce(nullif(trim(p_type), ''), nullif(trim(p_brand), '')) AS token_b,
    nullif(substr(upper(trim(p_type)), 1, 4), '') AS class_key, coalesce('rxnorm:' || CASE WHEN p_size % 2 = 0 THEN nullif(trim(p_brand), '') END, 'atc:' || nullif(substr(upper(trim(p_type)), 1, 4), '')) AS candidate FROM part""")
def p06_p10_tokens(spark, d):
    brand, type_, maker = F.col("p_brand"), F.col("p_type"), F.col("p_type")
    return read(spark, d, "part").select("p_partkey", exprs.first_of(F.when(F.col("p_size") % 3 == 0, brand), type_).alias("token_a"), exprs.first_of(type_, brand).alias("token_b"), exprs.class_key(maker).alias("class_key"), exprs.candidate_token(F.when(F.col("p_size") % 2 == 0, brand), maker).alias("candidate"))


@query("""SELECT event_id, round(coalesce(CASE WHEN user_id % 3 = 0 THEN value END / 60.0::DOUBLE, date_diff('second', TIMESTAMP '2024-01-01', ts) / 3600.0::DOUBLE), 9) AS hours FROM events""")
def p12_p13_event_hours(spark, d):
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    offset = F.when(F.col("user_id") % 3 == 0, F.col("value")).cast("string")
    hours = exprs.event_hours(F.lit("dev"), offset, F.col("ts"), start)
    return read(spark, d, "events").select("event_id", F.round(hours, 9).alias("hours"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'high' WHEN o_totalprice > 50000 THEN 'middle' WHEN o_orderpriority LIKE '1%' THEN 'urgent' ELSE 'low' END AS tier, 'v1' AS extraction_version FROM orders""")
def p20_p21_first_match(spark, d):
    price = F.col("o_totalprice")
    tier = exprs.first_match([(price > 150000, F.lit("high")), (price > 50000, F.lit("middle")), (F.col("o_orderpriority").like("1%"), F.lit("urgent"))], F.lit("low"))
    return exprs.with_provenance(read(spark, d, "orders").select("o_orderkey", tier.alias("tier")), extraction_version="v1")


@query("SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2")
def w02_deduplicate(spark, d):
    return relational.deduplicate(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])


@query("""SELECT l_returnflag, CAST(sum(n) AS BIGINT) AS input_rows, count(*) AS distinct_rows, CAST(sum(n) - count(*) AS BIGINT) AS excess_rows FROM (SELECT l_returnflag, l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1""")
def a05_dedup_summary(spark, d):
    return relational.deduplication_summary(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_returnflag")


_PREFIXES = "(VALUES ('Brand', 'b'), ('Brand#1', 'b1'), ('Brand#2', 'b2'), ('Brand#12', 'b12'), ('Brand#12', 'a12'), ('x', 'x'))"


@query(f"""SELECT p_partkey, p_brand, (SELECT v FROM {_PREFIXES} t(k, v) WHERE starts_with(p_brand, k) ORDER BY length(k) DESC, v LIMIT 1) AS token FROM part""")
def j05_longest_prefix(spark, d):
    rows = [("Brand", "b"), ("Brand#1", "b1"), ("Brand#2", "b2"), ("Brand#12", "b12"), ("Brand#12", "a12"), ("x", "x"), (None, "n"), ("", "e")]
    table = spark.createDataFrame(rows, "prefix string, token string")
    return relational.longest_prefix(read(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", table, "prefix", "token")


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END AS p, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS s FROM orders),
    n AS (SELECT p, s, count(*) AS n FROM o GROUP BY 1, 2) SELECT o_orderkey, n FROM o JOIN n ON o.p IS NOT DISTINCT FROM n.p AND o.s IS NOT DISTINCT FROM n.s""")
def j06_null_safe(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderpriority")).alias("p"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")).alias("s"))
    return relational.null_safe_join(o, o.groupBy("p", "s").agg(F.count("*").alias("n")), ["p", "s"]).select("o_orderkey", "n")


@query("""SELECT p_partkey, coalesce(a.v, b.v, c.v) AS code, CASE WHEN a.v IS NOT NULL THEN 'exact' WHEN b.v IS NOT NULL THEN 'brand' WHEN c.v IS NOT NULL THEN 'maker' END AS matched_by FROM part
    LEFT JOIN (SELECT p_brand AS k1, p_size AS k2, min(p_type) AS v FROM part WHERE p_size < 5 GROUP BY 1, 2) a ON a.k1 = p_brand AND a.k2 = p_size
    LEFT JOIN (SELECT p_brand AS k, min(p_type) AS v FROM part WHERE p_brand < 'Brand#3' GROUP BY 1) b ON b.k = p_brand LEFT JOIN (SELECT p_type AS k, min(p_type) AS v FROM part WHERE p_type < 'M' GROUP BY 1) c ON c.k = p_type""")
def j07_tiered_lookup(spark, d):
    part = read(spark, d, "part")
    t = part.withColumn("code", F.col("p_type"))
    tiers = [("exact", ["p_brand", "p_size"], t.where("p_size < 5")), ("brand", ["p_brand"], t.where("p_brand < 'Brand#3'")), ("maker", ["p_type"], t.where("p_type < 'M'"))]
    return relational.tiered_lookup(part, tiers, "code").select("p_partkey", "code", "matched_by")


@query("SELECT p_partkey, coalesce(CASE WHEN p_size < 10 THEN p_type END, m.v) AS code, CASE WHEN p_size < 10 THEN 'own' WHEN m.v IS NOT NULL THEN 'brand' ELSE 'none' END AS method FROM part LEFT JOIN (SELECT p_brand AS k, min(p_type) AS v FROM part WHERE p_size > 40 AND p_brand > 'Brand#2' GROUP BY 1) m ON m.k = p_brand")
def j23_fill_unmapped(spark, d):
    part = read(spark, d, "part")
    facts = part.select("p_partkey", "p_brand", F.when(F.col("p_size") < 10, F.col("p_type")).alias("code"), F.when(F.col("p_size") < 10, "own").otherwise("none").alias("method"))
    mapping = part.where("p_size > 40 and p_brand > 'Brand#2'").select("p_brand", F.col("p_type").alias("code"))
    return relational.fill_unmapped(facts, mapping, "p_brand", "code", "brand").select("p_partkey", "code", "method")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR)) AS rn FROM orders) WHERE rn = 1")
def w01_first_stay(spark, d):
    order = [F.col("o_orderdate").asc_nulls_last(), F.col("o_orderkey").cast("string").asc_nulls_last()]
    return relational.first_per_key(read(spark, d, "orders"), ["o_custkey"], order).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT c_mktsegment, c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY (c_acctbal > 0) DESC, c_name, c_custkey) AS rn FROM customer) WHERE rn = 1")
def w04_best_mapping(spark, d):
    order = [(F.col("c_acctbal") > 0).desc(), F.col("c_name").asc_nulls_last(), F.col("c_custkey").asc_nulls_last()]
    return relational.first_per_key(read(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], order).select("c_mktsegment", "c_nationkey", "c_custkey")


@query("SELECT CAST(c_custkey AS BIGINT) AS key, c_name AS name, 'customer' AS kind, CAST(NULL AS VARCHAR) AS extra FROM customer UNION ALL BY NAME SELECT s_name AS name, CAST(s_suppkey AS BIGINT) AS key, 'supplier' AS kind, CAST(s_nationkey AS VARCHAR) AS extra FROM supplier")
def u01_union_by_name(spark, d):
    a = read(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("key"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"))
    b = read(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").cast("long").alias("key"), F.lit("supplier").alias("kind"), F.col("s_nationkey").cast("string").alias("extra"))
    return relational.union_by_name([a, b], missing=True)


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def u03_union_distinct(spark, d):
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).union(read(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT p_brand AS key, 'old' AS kind FROM (SELECT DISTINCT p_brand FROM part WHERE p_size < 3) UNION ALL SELECT min(upper(p_brand)), 'new' FROM part WHERE lower(p_brand) NOT IN (SELECT lower(p_brand) FROM part WHERE p_size < 3) GROUP BY p_brand")
def u07_append_unseen(spark, d):
    part = read(spark, d, "part")
    old = part.where("p_size < 3").select(F.col("p_brand").alias("key"), F.lit("old").alias("kind")).distinct()
    return relational.append_unseen(old, part.select(F.upper("p_brand").alias("key"), F.lit("new").alias("kind")), ["key"])


@query("SELECT 'p_size' AS column_name, count(*) AS row_count, count(*) FILTER (WHERE p_size IS NULL) AS blank, count(DISTINCT p_size) AS \"distinct\", 0::BIGINT AS failed, CAST(min(p_size) AS DOUBLE) AS least, CAST(max(p_size) AS DOUBLE) AS largest, round(avg(p_size), 6) AS mean, count(*) FILTER (WHERE p_size > 40 OR p_size < 2) AS outside FROM part UNION ALL SELECT 'p_brand', count(*), count(*) FILTER (WHERE trim(p_brand) = ''), count(DISTINCT p_brand), count(*), NULL, NULL, NULL, 0 FROM part")
def a01_profile(spark, d):
    specs = [profile.ColumnSpec("p_size", "number", 2, 40), profile.ColumnSpec("p_brand", "number")]
    return profile.profile_columns(read(spark, d, "part"), specs, approximate=False)


@query("SELECT count(*) FILTER (WHERE n > 1) AS duplicate_groups, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS duplicate_rows, CAST(coalesce(sum(n - 1) FILTER (WHERE n > 1), 0) AS BIGINT) AS excess_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def a02_duplicate_keys(spark, d):
    return profile.duplicate_keys(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT count(*) AS row_count, count(*) FILTER (WHERE o_custkey IS NULL) AS null_keys, count(*) FILTER (WHERE o_custkey IS NOT NULL AND k IS NULL) AS orphans FROM orders LEFT JOIN (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0) ON o_custkey = k")
def j13_foreign_key(spark, d):
    return profile.foreign_key(read(spark, d, "orders"), "o_custkey", read(spark, d, "customer").where("c_acctbal > 0"), "c_custkey")


@query("SELECT * FROM (VALUES (0::BIGINT, 'n_nationkey'), (1, 'n_name'), (2, 'n_regionkey')) t(position, column_name)")
def s07_schema_columns(spark, d):
    return profile.schema_rows(read(spark, d, "nation")).select("position", "column_name").where("position < 3")


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 7")
def s05_bounded_scan(spark, d):
    return files.bounded(read(spark, d, "nation").orderBy("n_nationkey"), ["n_nationkey", "n_name"], 7)


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 5")
def k08_slice(spark, d):
    return relational.slice_rows(read(spark, d, "nation").select("n_nationkey", "n_name"), [F.col("n_nationkey")], 6, 10)


@query(with_sql(STAYS_SQL) + "SELECT stay_id, l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN (SELECT DISTINCT stay_id FROM stays WHERE source = 'dev') ON CAST(l_orderkey AS VARCHAR) = CAST(stay_id AS VARCHAR) WHERE l_returnflag IN ('R', 'A')")
def j02_cohort_extract(spark, d):
    cohort = tpch.stays(spark, d).where("source = 'dev'")
    return relational.cohort_extract(read(spark, d, "lineitem"), cohort, {"l_orderkey": "stay_id"}, ["l_orderkey", "l_linenumber", "l_quantity"], F.col("l_returnflag").isin("R", "A"))


@query("SELECT a.k AS l_suppkey_group, a.b AS a, b.b AS b, count(*) AS n FROM (SELECT DISTINCT l_suppkey % 20 AS k, l_discount AS b FROM lineitem) a JOIN (SELECT DISTINCT l_suppkey % 20 AS k, l_discount AS b FROM lineitem) b ON a.k = b.k AND a.b < b.b GROUP BY 1, 2, 3")
def j16_unordered_pairs(spark, d):
    own = read(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("l_suppkey_group"), "l_discount")
    return relational.unordered_pairs(own, "l_suppkey_group", "l_discount").groupBy("l_suppkey_group", "a", "b").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, n, total FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) USING (o_custkey)")
def j22_one_to_one(spark, d):
    o = read(spark, d, "orders")
    return relational.one_to_one(o.groupBy("o_custkey").agg(F.count("*").alias("n")), o.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total")), ["o_custkey"])
