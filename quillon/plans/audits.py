"""Queries: inventories, gzip states, locks, gates, readiness, column contracts."""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import functions as F

from quillon.operators import contract, lock, reports
from quillon.sources import inventory
from quillon.sources.scratch import fresh_path, stash

from . import ranking, records, tpch
from .registry import query
from .tpch import BASE, read, with_sql

#: Files of a nation's customers, by the nation's number modulo 5.
WHOLE, MEMBERS, TRUNCATED, CORRUPT, PLAIN = range(5)
_NEVER = 7
_HEAD = "custkey,segment\n"


def _packed(batches):
    """Bodies as the files that they are to be."""
    for batch in batches:
        out = []
        for kind, body in zip(batch.column("kind").to_pylist(), batch.column("body").to_pylist(), strict=True):
            raw, whole = body.encode(), gzip.compress(body.encode(), mtime=0)
            out.append({WHOLE: whole, MEMBERS: gzip.compress(_HEAD.encode(), mtime=0) + gzip.compress(raw[len(_HEAD) :], mtime=0), TRUNCATED: whole[:-5], CORRUPT: whole[:-8] + bytes([whole[-8] ^ 1]) + whole[-7:], PLAIN: raw}[kind])
        yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(out, pa.binary())], ["name", "content"])


def _named(nations):
    kind = F.col("n_nationkey") % 5
    return nations.withColumns({"kind": kind.cast("int"), "source": F.concat(F.lit("r"), "n_regionkey"), "file": F.concat(F.lit("n"), "n_nationkey", F.when(kind == PLAIN, ".csv").otherwise(".csv.gz"))})


def _stored(spark, d):
    """The files of all nations but one, and a list of checksums; and what is expected."""
    root = fresh_path(spark, "store")
    nations = _named(read(spark, d, "nation"))
    lines = read(spark, d, "customer").withColumn("line", F.concat("c_custkey", F.lit(","), "c_mktsegment", F.lit("\n")))
    bodies = lines.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "line"))), lambda x: x["line"]), "").alias("body"))
    rows = bodies.join(nations, "n_nationkey").where(F.col("n_nationkey") != _NEVER).select(F.concat("source", F.lit("/"), "file").alias("name"), "kind", F.concat(F.lit(_HEAD), "body").alias("body"))
    sums = spark.createDataFrame([("r0/SHA256SUMS.txt", PLAIN, "none\n")], "name string, kind int, body string")
    inventory.put_files(rows.union(sums).mapInArrow(_packed, "name string, content binary"), root).write.format("noop").mode("overwrite").save()
    expected = nations.select("source", F.col("file").alias("name")).union(spark.createDataFrame([("r9", "gone.csv")], "source string, name string"))
    return inventory.files_below(spark, root), expected


_FILES_SQL = f"""f AS (SELECT 'r' || n_regionkey AS source, n_nationkey, 'n' || n_nationkey || CASE WHEN n_nationkey % 5 = {PLAIN} THEN '.csv' ELSE '.csv.gz' END AS name, n_nationkey <> {_NEVER} AND n_nationkey IN (SELECT c_nationkey FROM customer) AS there FROM nation)"""


@query(f"""WITH {_FILES_SQL}, e AS (SELECT source, name, there FROM f UNION ALL SELECT 'r9', 'gone.csv', FALSE)
    SELECT source, source <> 'r9' AS present, count(*) FILTER (WHERE there) + (source = 'r0')::BIGINT AS file_count, count(*) AS expected_file_count, coalesce(list(name ORDER BY name) FILTER (WHERE NOT there), []) AS missing, source = 'r0' AS has_checksums FROM e GROUP BY source""")
def s12_source_inventory(spark, d):
    files, expected = _stored(spark, d)
    return inventory.source_inventory(files, expected).drop("total_bytes")


@query(f"WITH {_FILES_SQL} SELECT source || '/' || name AS name, CASE WHEN name LIKE '%.gz' THEN '.csv.gz' ELSE '.csv' END AS suffix, ['custkey', 'segment'] AS header FROM f WHERE there AND n_nationkey % 5 NOT IN ({TRUNCATED}, {CORRUPT}) UNION ALL SELECT 'r0/SHA256SUMS.txt', '.txt', NULL")
def s12_described_files(spark, d):
    files, _ = _stored(spark, d)
    number = F.regexp_extract("name", r"/n([0-9]+)\.", 1)
    sound = files.where((number == "") | ~(F.coalesce(number.try_cast("int"), F.lit(0)) % 5).isin(TRUNCATED, CORRUPT))
    return inventory.described_files(sound).select("name", "suffix", "header")


@query(f"""WITH {_FILES_SQL}, b AS (SELECT c_nationkey, {len(_HEAD)} + CAST(sum(octet_length(encode(c_custkey || ',' || c_mktsegment || chr(10)))) AS BIGINT) AS n FROM customer GROUP BY 1)
    SELECT source || '/' || name AS name, CASE WHEN NOT there THEN 'missing' ELSE ['ok', 'ok', 'truncated', 'corrupt', 'not_gzip'][1 + n_nationkey % 5] END AS state,
      CASE WHEN there AND n_nationkey % 5 < 2 THEN 1 + n_nationkey % 5 END AS members, CASE WHEN there AND n_nationkey % 5 < 2 THEN n END AS inflated_bytes FROM f LEFT JOIN b ON c_nationkey = n_nationkey
    UNION ALL SELECT 'r0/SHA256SUMS.txt', 'not_gzip', NULL, NULL""")
def s16_gzip_states(spark, d):
    """Whole, many-membered, truncated, corrupt, plain and missing files."""
    files, expected = _stored(spark, d)
    named = expected.where("source <> 'r9'").select(F.concat("source", F.lit("/"), "name").alias("name"))
    out = inventory.gzip_states(files.select("path", "name").join(named, "name", "full"))
    sound = F.col("state") == "ok"
    return out.select("name", "state", F.when(sound, F.col("members")).alias("members"), F.when(sound, F.col("inflated_bytes")).alias("inflated_bytes"))


@query(f"""WITH {_FILES_SQL} SELECT 'state' AS "column", CASE WHEN NOT there THEN 'missing' ELSE ['ok', 'ok', 'truncated', 'corrupt', 'not_gzip'][1 + n_nationkey % 5] END AS value, count(*) AS files FROM f GROUP BY 2
    UNION ALL SELECT 'members', CASE WHEN there AND n_nationkey % 5 < 2 THEN CAST(1 + n_nationkey % 5 AS VARCHAR) END, count(*) FROM f GROUP BY 2""")
def a35_state_counts(spark, d):
    files, expected = _stored(spark, d)
    named = expected.where("source <> 'r9'").select(F.concat("source", F.lit("/"), "name").alias("name"))
    states = inventory.gzip_states(named.join(files.select("path", "name"), "name", "left").select("path", "name"))
    return reports.status_counts(states.withColumn("members", F.when(F.col("state") == "ok", F.col("members"))), ["state", "members"])


#: Partitions of the locked orders: one row of CHANGED is another, REWRITTEN has the same rows in other files, GONE none.
BUCKETS, CHANGED, REWRITTEN, GONE = 8, 3, 5, 6


def _orders(spark, d):
    return read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", (F.col("o_orderkey") % BUCKETS).alias("bucket"))


def _locked(spark, d):
    """A lock on orders and customers, and where they are, after one partition each was changed, rewritten and emptied."""
    roots = {n: fresh_path(spark, n) for n in ("orders", "customers")}
    own = _orders(spark, d)
    own.write.partitionBy("bucket").parquet(roots["orders"])
    read(spark, d, "customer").write.parquet(roots["customers"])
    leaves = stash(lock.lock_leaves(spark, roots), "lock")
    least = own.where(F.col("bucket") == CHANGED).agg(F.min("o_orderkey")).first()[0]
    for bucket, price in ((CHANGED, F.when(F.col("o_orderkey") == least, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))), (REWRITTEN, F.col("o_totalprice"))):
        own.where(F.col("bucket") == bucket).withColumn("o_totalprice", price).drop("bucket").repartition(2).write.mode("overwrite").parquet(f"{roots['orders']}/bucket={bucket}")
    own.limit(0).drop("bucket").write.mode("overwrite").parquet(f"{roots['orders']}/bucket={GONE}")
    return leaves, roots


@query(f"""WITH o AS (SELECT o_orderkey % {BUCKETS} AS b, count(*) AS n FROM orders GROUP BY 1)
    SELECT 'orders' AS "table", 'bucket=' || b AS part, n AS expected_rows, CASE WHEN b = {GONE} THEN 0 ELSE n END AS found_rows, b IN ({CHANGED}, {REWRITTEN}, {GONE}) AS reread, b NOT IN ({CHANGED}, {GONE}) AS passed FROM o
    UNION ALL SELECT 'customers', '', count(*), count(*), FALSE, TRUE FROM customer""")
def d46_changed_partitions(spark, d):
    """Which partitions of locked tables differ; only files that the listing shows to be others are read again."""
    leaves, roots = _locked(spark, d)
    out = lock.differing_parts(lock.verify_lock(spark, leaves, roots))
    return out.select("table", "part", "expected_rows", "found_rows", (F.col("reread") > 0).alias("reread"), "passed")


@query(with_sql(*BASE, records.EPISODES, "m AS (SELECT DISTINCT patient_id, split AS s FROM stays)") + f"""SELECT 'table:orders' AS "check", '0' AS expected, CAST(count(DISTINCT o_orderkey % {BUCKETS}) FILTER (WHERE o_orderkey % {BUCKETS} IN ({CHANGED}, {GONE})) AS VARCHAR) AS found, count(*) FILTER (WHERE o_orderkey % {BUCKETS} IN ({CHANGED}, {GONE})) = 0 AS passed FROM orders
    UNION ALL SELECT 'table:customers', '0', '0', TRUE UNION ALL SELECT 'audit:row_count', '> 0', CAST(count(*) AS VARCHAR), count(*) > 0 FROM pcm UNION ALL SELECT 'audit:repeated_keys', '0', '0', TRUE UNION ALL SELECT 'audit:misaligned_patients', '0', '0', TRUE
    UNION ALL SELECT 'audit:unknown_patients', '0', '0', TRUE UNION ALL SELECT 'audit:events_after_prediction', '0', CAST(count(*) FILTER (WHERE hours > 72) AS VARCHAR), count(*) FILTER (WHERE hours > 72) = 0 FROM e UNION ALL SELECT 'audit:events_without_time', '0', CAST(count(*) FILTER (WHERE hours IS NULL) AS VARCHAR), count(*) FILTER (WHERE hours IS NULL) = 0 FROM e
    UNION ALL SELECT 'audit:labels_outside_window', '0', CAST(count(*) FILTER (WHERE token = 'purchase' AND (hours IS NULL OR hours <= 72 OR hours > 144)) AS VARCHAR), count(*) FILTER (WHERE token = 'purchase' AND (hours IS NULL OR hours <= 72 OR hours > 144)) = 0 FROM e
    UNION ALL VALUES ('version:labels', 'v1', 'v1', TRUE), ('version:mapping', 'v3', 'v4', FALSE)""")
def d46_lock_checks(spark, d):
    """A lock's tables, audits and versions against what is there now."""
    leaves, roots = _locked(spark, d)
    e = records.episodes(spark, d)
    audits = contract.contract_checks(ranking.rows(spark, d), tpch.stays(spark, d).select("patient_id", "split"), e, e.where("token = 'purchase'").withColumn("first_hours", F.col("hours")), 72.0, 144.0)
    return lock.lock_checks(lock.verify_lock(spark, leaves, roots), audits, {"labels": "v1", "mapping": "v4"}, {"labels": "v1", "mapping": "v3"})


@query("SELECT * FROM (VALUES ('contract_lock', FALSE), ('table:missing', FALSE)) t(\"check\", passed) UNION ALL SELECT 'table:orders', count(*) > 0 FROM orders UNION ALL SELECT 'table:customers', count(*) > 0 FROM customer")
def d64_preflight(spark, d):
    leaves, roots = _locked(spark, d)
    checks = lock.lock_checks(lock.verify_lock(spark, leaves, roots), spark.createDataFrame([], "check string, value long, passed boolean"), {}, {})
    return lock.preflight_checks(checks, lock.lock_roots(leaves), ["orders", "customers", "missing"])


@query(with_sql(*BASE) + """SELECT source, split, CASE WHEN p > 0 THEN 'positive' ELSE 'zero_positive' END AS kind, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(p) AS BIGINT) AS positives
    FROM (SELECT source, split, group_id, count(*) AS n, count(*) FILTER (WHERE label) AS p FROM pcm GROUP BY 1, 2, 3) GROUP BY 1, 2, 3""")
def a31_group_coverage(spark, d):
    return reports.group_coverage(ranking.rows(spark, d), ["source", "split"])


def _gates(spark, d, enforce=True):
    """A brand is a table; its types are what quality says of it, its sizes what integrity does."""
    part = read(spark, d, "part")
    quality = part.where("p_size > 5").select(F.col("p_brand").alias("table_name"), F.when(F.col("p_size") > 6, "completed").otherwise("blocked").alias("status"))
    whole = part.where("p_size <= 45").select(F.col("p_brand").alias("table_name"), F.when(F.col("p_size") % 37 == 0, "checksum_mismatch").otherwise("verified").alias("status"))
    return reports.table_gates(part.select(F.col("p_brand").alias("table_name")), quality, whole, enforce)


_GATES_SQL = """q AS (SELECT p_brand, min(CASE WHEN p_size > 6 THEN 'completed' ELSE 'blocked' END) AS quality FROM part WHERE p_size > 5 GROUP BY 1), i AS (SELECT p_brand, min(CASE WHEN p_size % 37 = 0 THEN 'checksum_mismatch' ELSE 'verified' END) AS integrity FROM part WHERE p_size <= 45 GROUP BY 1),
    g AS (SELECT p_brand AS table_name, coalesce(quality, 'missing') AS quality, coalesce(integrity, 'missing') AS integrity FROM (SELECT DISTINCT p_brand FROM part) LEFT JOIN q USING (p_brand) LEFT JOIN i USING (p_brand)),
    gates AS (SELECT *, quality IN ('completed', 'passed') AND integrity IN ('verified', 'passed') AS ready, CASE WHEN quality NOT IN ('completed', 'passed') THEN 'blocked_by_quality:' || quality WHEN integrity NOT IN ('verified', 'passed') THEN 'blocked_by_integrity:' || integrity ELSE 'passed' END AS reason FROM g)"""


@query(f"WITH {_GATES_SQL} SELECT * FROM gates")
def d47_table_gates(spark, d):
    return _gates(spark, d)


@query(f"""WITH {_GATES_SQL}, n AS (SELECT DISTINCT p_type AS domain, p_brand AS table_name FROM part UNION ALL SELECT 'none', NULL UNION ALL SELECT 'other', 'unknown')
    SELECT domain, count(table_name) AS tables, count(*) FILTER (WHERE ready) AS passed, CASE WHEN count(table_name) > 0 AND count(*) FILTER (WHERE ready) = count(table_name) THEN 'ready' WHEN count(*) FILTER (WHERE ready) > 0 THEN 'partial' ELSE 'blocked' END AS status FROM n LEFT JOIN gates USING (table_name) GROUP BY 1""")
def d60_domain_readiness(spark, d):
    needs = read(spark, d, "part").select(F.col("p_type").alias("domain"), F.col("p_brand").alias("table_name")).distinct()
    odd = spark.createDataFrame([("none", None), ("other", "unknown")], "domain string, table_name string")
    return reports.domain_readiness(needs.union(odd), _gates(spark, d))


@query(with_sql(*BASE, "m AS (SELECT source, count(DISTINCT group_id) FILTER (WHERE label) AS n FROM pcm GROUP BY 1)") + "SELECT 'blocked' AS claim, list_sort(list_concat(['sensitivity:missing'], CASE WHEN (SELECT count(*) FROM m WHERE source = 'external') = 0 THEN ['external:missing'] WHEN (SELECT n FROM m WHERE source = 'external') = 0 THEN ['external:no_positive_groups'] ELSE [] END)) AS faults")
def d45_claim_gate(spark, d):
    per = ranking.rows(spark, d).where("label").groupBy("source").agg(F.count_distinct("group_id").alias("positive_groups"))
    return reports.claim_gate(per.select(F.col("source").alias("name"), F.lit("completed").alias("status"), "positive_groups"), ["external", "sensitivity"])


_ALLOWED = ["p_partkey", "p_size", "p_retailprice", "p_name", "p_type"]


@query("SELECT p_size, p_retailprice, p_type FROM part")
def p26_projection(spark, d):
    part = read(spark, d, "part").withColumns({"label_events": F.lit(1), "patient_id": F.col("p_partkey")})
    asked = reports.column_decisions(part, [*_ALLOWED, "patient_id", "label_events"], [c for c in part.columns if c not in ("p_partkey", "p_name", "p_mfgr")])
    return reports.projected(part, asked)


@query("""SELECT DISTINCT column_name, CASE WHEN column_name IN ('source', 'split') THEN 'partition' WHEN regexp_matches(column_name, '(^|_)(id|uid|uids|key)$') THEN 'identifier' WHEN regexp_matches(column_name, '(^|_)(text|note|name|raw|code|codes)($|_)|(^|_)(time|date|timestamp)$') THEN 'excluded' ELSE 'feature' END AS role,
      CASE WHEN regexp_matches(column_name, '(^|_)(id|uid|uids|key)$|(^|_)(text|note|name|raw|code|codes)($|_)|(^|_)(time|date|timestamp)$') THEN 'refused_unsafe' WHEN column_name IN ('n_chars', 'lang') OR data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'projected' ELSE 'refused_not_listed' END AS decision FROM duckdb_columns() WHERE table_name = 'documents'
    UNION ALL SELECT 'gone', 'feature', 'absent'""")
def p28_column_decisions(spark, d):
    docs = read(spark, d, "documents")
    return reports.column_decisions(docs, ["lang", "text"], [*docs.columns, "gone"], dynamic=True)
