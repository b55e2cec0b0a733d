"""Queries of the file layer: tables are written as files of a kind to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import extract, profile
from quillon.sources import files
from quillon.sources.scratch import fresh_path

from .registry import query
from .tpch import read


def _lines(df, *columns):
    """A table of one text column, a line for each row, in a fresh folder."""
    path = fresh_path(df.sparkSession, "lines")
    df.select(F.concat(*columns).alias("value")).write.text(path)
    return path


def _csv(df, **options):
    path = fresh_path(df.sparkSession, "csv")
    df.write.options(header=True, escape='"', **options).csv(path)
    return path


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment || ', \"' || c_custkey || '\"' END AS c_mktsegment, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def s01_csv_scan(spark, d):
    own = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 > 0, F.concat("c_mktsegment", F.lit(', "'), "c_custkey", F.lit('"'))).alias("c_mktsegment"), "c_nationkey")
    return files.csv_text(spark, _csv(own), own.columns)


@query("SELECT s_suppkey, s_nationkey FROM supplier UNION ALL SELECT s_suppkey, s_nationkey FROM supplier")
def s03_parquet_paths(spark, d):
    return files.parquet(spark, f"{d}/supplier.parquet", f"{d}/supplier.parquet").select("s_suppkey", "s_nationkey")


@query("SELECT unnest(['c_custkey', 'c_name', 'since']) AS column_name, unnest([CASE WHEN max(c_custkey) < 2147483648 THEN 'int' ELSE 'bigint' END, 'string', 'date']) AS column_type, unnest(range(3)) AS position FROM customer")
def s06_inferred_types(spark, d):
    own = read(spark, d, "customer").select("c_custkey", F.concat(F.lit("customer "), "c_custkey").alias("c_name"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("c_nationkey").cast("int")).alias("since"))
    return profile.schema_rows(spark.createDataFrame([], files.inferred_schema(spark, _csv(own))))


@query("SELECT CASE WHEN n_regionkey < 3 THEN 'plain' ELSE 'packed' END AS kind, ['n_nationkey', 'n, \"name\"'] AS header, count(DISTINCT n_regionkey) AS files FROM nation GROUP BY 1")
def s04_s12_headers(spark, d):
    root = fresh_path(spark, "inventory")
    own = read(spark, d, "nation").select("n_regionkey", "n_nationkey", F.col("n_name").alias('n, "name"'))
    for kind, part, codec in (("plain", "n_regionkey < 3", "none"), ("packed", "n_regionkey >= 3", "gzip")):
        own.where(part).repartition(1).write.partitionBy("n_regionkey").options(header=True, escape='"', compression=codec).csv(f"{root}/{kind}")
    found = files.file_headers(files.listed_files(spark, root).where("name not like '%SUCCESS%' and name not like '%.crc'"))
    return found.groupBy(F.substring_index("name", "/", 1).alias("kind"), "header").agg(F.count("*").alias("files"))


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus <> 'O'")
def s08_s09_atomic_writes(spark, d):
    """The second write takes the first one's place."""
    path, own = fresh_path(spark, "table"), read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    files.write_atomic(own, path)
    n = files.write_atomic(own.where("o_orderstatus <> 'O'"), path, ["o_orderstatus"])
    return files.parquet(spark, path).where(F.lit(n) > 0).select(*own.columns)


@query("SELECT n_nationkey, n_name FROM nation WHERE FALSE")
def s10_empty(spark, d):
    return files.empty(spark, read(spark, d, "nation").select("n_nationkey", "n_name").schema)


@query("""WITH f AS (SELECT r_regionkey, string_agg(n_name || chr(10), '' ORDER BY n_nationkey) AS body FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
    SELECT 'r=' || r_regionkey AS folder, CAST(octet_length(encode(body)) AS BIGINT) AS length, sha256(body) AS sha256, 'not_gzip' AS gzip_state, CASE WHEN r_regionkey = 1 THEN 'verified' WHEN r_regionkey = 2 THEN 'checksum_mismatch' ELSE 'not_listed' END AS status FROM f
    UNION ALL SELECT 'gone.txt', NULL, NULL, NULL, 'missing_file'""")
def s14_s16_integrity(spark, d):
    root = fresh_path(spark, "checked")
    own = read(spark, d, "nation").select(F.col("n_regionkey").alias("r"), "n_nationkey", F.col("n_name").alias("value"))
    own.repartition(1).sortWithinPartitions("r", "n_nationkey").select("r", "value").write.partitionBy("r").text(root)
    found = files.integrity(spark, root, {}).where("name like '%.txt'")
    known = {r.name.split("/")[0]: (r.name, r.sha256) for r in found.select("name", "sha256").collect()}  # five files
    manifest = files.checksums(f"{known['r=1'][1].upper()}  ./{known['r=1'][0]}\n{'0' * 64} *{known['r=2'][0]}\n{'1' * 64}  gone.txt\n")
    out = files.integrity(spark, root, manifest).where("name like '%.txt'")
    return out.select(F.substring_index("name", "/", 1).alias("folder"), "length", "sha256", "gzip_state", "status")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS code, CAST(s_nationkey AS VARCHAR) AS concept, CAST(NULL AS VARCHAR) AS other FROM supplier")
def s17_flexible_table(spark, d):
    own = read(spark, d, "supplier").select(F.col("s_suppkey").alias("NDC"), F.col("s_nationkey").alias("RxCUI"), F.lit("x").alias("rest"))
    return files.flexible_table(spark, _csv(own, sep=";"), {"code": ["ndc"], "concept": ["rxcui", "cui"], "other": ["none"]})


@query("SELECT CAST(p_partkey AS VARCHAR) AS concept, CASE WHEN p_size % 2 = 0 THEN 'NA' ELSE '' END AS suppressed, p_name AS name FROM part")
def s18_rrf(spark, d):
    flag = F.when(F.col("p_size") % 2 == 0, "NA").otherwise("")
    return files.rrf(spark, _lines(read(spark, d, "part"), F.col("p_partkey").cast("string"), F.lit("|"), flag, F.lit("|"), "p_name", F.lit("|")), ["concept", "suppressed", "name"])


@query("SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name AS concept FROM nation")
def s19_dict_literal(spark, d):
    rows = read(spark, d, "nation").select("n_nationkey", "n_name").collect()  # 25 rows
    return files.dict_literal(spark, str({r.n_nationkey: r.n_name for r in rows}), "code", "concept")


@query("""SELECT 'C' || p_partkey AS code, CASE WHEN p_size % 3 > 0 THEN p_brand ELSE p_type END AS category FROM part WHERE p_size % 3 > 0 OR p_size % 2 = 0""")
def s20_category_csv(spark, d):
    c, none = F.col("p_size"), F.lit(" ")
    first, second = F.when(c % 3 > 0, F.concat(F.lit('"'), "p_brand", F.lit('"'))).otherwise(none), F.when(c % 2 == 0, F.col("p_type")).otherwise(none)
    own = read(spark, d, "part").select(F.concat(F.lit("C"), "p_partkey").alias("CODE"), first.alias("DEFAULT"), second.alias("FIRST"))
    path = fresh_path(spark, "csv")
    own.write.options(header=True, quote="'", quoteAll=True).csv(path)
    return files.category_csv(spark, path)


@query("SELECT CAST(p_partkey AS VARCHAR) AS code, CAST(p_size % 7 AS VARCHAR) AS category, p_name AS label FROM part WHERE p_size % 7 > 0 AND p_size % 5 > 0")
def s21_single_level_csv(spark, d):
    size = F.when(F.col("p_size") % 5 > 0, (F.col("p_size") % 7).cast("string")).otherwise("")
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit(" '"))
    own = read(spark, d, "part").select(F.concat(quoted(F.col("p_partkey").cast("string")), F.lit(","), quoted(size), F.lit(","), quoted(F.col("p_name"))).alias("value"))
    head = spark.createDataFrame([("Labels and codes",), ("'ICD','CAT','LABEL'",)], "value string")
    return files.single_level_csv(spark, _lines(head.union(own), "value"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS source_code, 'T' || p_size AS target_code, p_size % 2 = 0 AS approximate FROM part WHERE p_size % 9 > 0")
def s22_crosswalk(spark, d):
    bit = lambda c: F.when(c, "1").otherwise("0")
    size = F.col("p_size")
    own = read(spark, d, "part")
    return files.crosswalk_text(spark, _lines(own, F.lit("  "), F.col("p_partkey").cast("string"), F.lit("   T"), size.cast("string"), F.lit(" "), bit(size % 2 == 0), bit(size % 9 == 0), F.lit("000")))


@query("""SELECT * FROM (VALUES ('lineitem', 'completed', NULL), ('part', 'skipped', 'blocked_by_quality:missing'), ('region', 'failed', 'missing_columns:r_none')) t("table", status, reason)
    JOIN (SELECT 'lineitem' AS "table", (SELECT count(*) FROM lineitem JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey WHERE l_quantity > 10) AS rows UNION ALL SELECT 'part', NULL UNION ALL SELECT 'region', NULL) USING ("table")""")
def d65_extracts(spark, d):
    keys = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("stay_id"), F.col("o_orderkey").cast("string").alias("order"))
    specs = [extract.ExtractSpec("lineitem", ["l_quantity"], {"l_orderkey": "order"}, F.col("l_quantity") > 10), extract.ExtractSpec("part", ["p_name"], {"p_partkey": "order"}), extract.ExtractSpec("region", ["r_name"], {"r_regionkey": "order"}, required=["r_none"])]
    passed = {"lineitem": "passed", "region": "passed"}
    out = extract.build_extracts({t: read(spark, d, t) for t in ("lineitem", "part", "region")}, keys, specs, fresh_path(spark, "extracts"), passed, passed, "v1")
    rows = [(r["table"], r["status"], None if r["status"] == "completed" else r["reason"], r["rows"]) for r in out]
    return spark.createDataFrame(rows, "table string, status string, reason string, rows long")
