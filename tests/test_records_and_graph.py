from __future__ import annotations

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from quillon.functions import exprs
from quillon.operators import cohort, contract, extract, features, graph, harmonize, mappings, profile, relational, subgraphs
from quillon.sources import files


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}")


@pytest.mark.parametrize(("text", "token", "code", "unit"), [("  A41.9 x ", "a41_9_x", "a419x", "a41.9 x"), ("__", "_", None, "__"), ("", None, None, None), (None, None, None, None), (" mg \t dL", "mg_dl", "mgdl", "mg dl")])
def test_normal_forms(spark, text, token, code, unit):
    x = F.col("x")
    assert tuple(one(spark, text).select(exprs.text_token(x), exprs.code_key(x), exprs.unit_text(x)).first()) == (token, code, unit)


@pytest.mark.parametrize(("text", "value"), [("12.5", 12.5), (" 3 ", 3.0), ("12d", None), ("1e3", 1000.0), (".", None), ("x", None), (None, None), ("-.5", -0.5)])
def test_numbers(spark, text, value):
    assert one(spark, text).select(exprs.number(F.col("x"))).first()[0] == value


def test_event_hours_branches(spark):
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    rows = [("dev", "90", None, 1.5), ("external", None, "120", 2.0), ("dev", None, "2024-01-01 03:00:00", 3.0), ("dev", None, "x", None), ("external", None, "x", None)]
    df = spark.createDataFrame(rows, "source string, o string, t string, want double")
    assert df.where(~exprs.event_hours(F.col("source"), F.col("o"), F.col("t"), start).eqNullSafe(F.col("want"))).count() == 0


def test_candidate_tokens_and_suffixes(spark):
    df = spark.createDataFrame([("11", "c07ab02"), (" ", "c07ab02"), (None, " "), ("5", None)], "c string, k string")
    assert [r[0] for r in df.select(exprs.candidate_token(F.col("c"), F.col("k"))).collect()] == ["rxnorm:11", "atc:C07A", None, "rxnorm:5"]
    assert [r[0] for r in df.select(exprs.candidate_token(F.col("c"), F.col("k"), "class_or_code")).collect()] == ["atc:C07A", "atc:C07A", None, "rxnorm:5"]
    with pytest.raises(ValueError):
        exprs.candidate_token(F.col("c"), F.col("k"), "other")
    names = exprs.column_suffixes(["a b", "a-b", "c"])
    assert names["c"] == "c" and len(set(names.values())) == 3


def test_drug_names_and_code_variants(spark):
    assert one(spark, "Metoprolol 25 MG Tablet").select(exprs.drug_name(F.col("x"))).first()[0] == "metoprolol"
    assert set(one(spark, "00093-0150-01").select(exprs.code_variants(F.col("x"))).first()[0]) == {"00093015001", "0093015001", "0009315001", "0009301501"}
    got = one(spark, "0009301501").select(exprs.code_variants(F.col("x"))).first()[0]
    assert got[0] == "0009301501" and all(len(v) == 11 for v in got[1:])


def test_adult_first_stays_of_two_sources(spark):
    stays = spark.createDataFrame([(1, 10, 300, "2020-01-02", None), (1, 10, 301, "2020-01-03", None), (2, 11, 302, "2020-01-01", None), (3, 12, 303, "2020-01-01", None)], "patient_id long, admission_id long, stay_id long, start string, end string")
    patients = spark.createDataFrame([(1, 40), (2, 17), (3, 18)], "patient_id long, anchor_age int")
    admissions = spark.createDataFrame([(10, 1), (11, 2), (12, 3)], "admission_id long, patient_id long")
    other = spark.createDataFrame([("7", 1, 400, "> 89", 90.0), (" ", 1, 402, "55", 10.0), ("9", 2, 403, "x", 1.0), ("9", 2, 404, "17", 1.0)], "patient_id string, admission_id long, stay_id long, age string, end_offset double")
    a, b = cohort.dated_stays(stays, patients, admissions, "a"), cohort.offset_stays(other, "b")
    rows = {r.stay_uid: r for r in cohort.cohort(a, b).collect()}
    assert set(rows) == {"a:300", "a:303", "b:400", "b:402"} and rows["b:400"].age_years == 90.0 and rows["b:400"].age_topcoded and rows["b:402"].patient_uid == "b:unitstay:402"
    assert cohort.dated_stays(stays, patients, admissions, "a", first_only=False).count() == 3
    assert tuple(cohort.dated_attrition(stays, patients, admissions).first()) == (4, 3, 2, 1)
    assert tuple(cohort.offset_attrition(other).first()) == (4, 1, 1, 2)


def test_extraction_fans_out_to_each_stay(spark):
    source = spark.createDataFrame([(" 1 ", "x", 5), ("2", "x", 6), (None, "x", 5), ("9", "x", 5)], "patient string, v string, item int")
    own = spark.createDataFrame([(100, "1"), (101, "1"), (102, "2"), (103, None)], "stay_id long, patient_id string")
    out = relational.cohort_extract(source, own, {"patient": "patient_id"}, ["v"], F.col("item") == 5)
    assert sorted(r.stay_id for r in out.collect()) == [100, 101]


def test_dedup_prefix_and_unseen(spark):
    df = spark.createDataFrame([(None, 1, "b"), (None, 1, "a"), (2, None, "c")], "k long, j long, v string")
    assert sorted(((r.k, r.j, r.v) for r in relational.deduplicate(df, ["k", "j"]).collect()), key=repr) == [(2, None, "c"), (None, 1, "a")]
    codes = spark.createDataFrame([("a419",), ("b",), (None,)], "code string")
    table = spark.createDataFrame([("a", "1"), ("a41", "2"), ("a41", "0"), ("a4199", "3")], "prefix string, token string")
    assert {r.code: r.token for r in relational.longest_prefix(codes, "code", table, "prefix", "token").collect()} == {"a419": "0", "b": None, None: None}
    assert {r.token for r in relational.longest_prefix(codes, "code", table.limit(0), "prefix", "token").collect()} == {None}
    old, new = spark.createDataFrame([(" A ", "old")], "k string, v string"), spark.createDataFrame([("a", "new"), ("b", "y"), ("B", "x")], "k string, v string")
    assert sorted(tuple(r) for r in relational.append_unseen(old, new, ["k"]).collect()) == [(" A ", "old"), ("B", "x")]
    with pytest.raises(Exception, match="repeats"):
        relational.one_to_one(old.union(old), old.withColumnRenamed("v", "w"), ["k"]).collect()
    with pytest.raises(ValueError):
        relational.union_by_name([])


def test_rollup_tiers_and_missing_maps(spark):
    rows = [(1, "A41.9", "icd10", None), (2, "038.9", "icd9", None), (3, "0389", "mixed", None), (4, "Z99", "icd10", "x"), (5, "Q12", "icd10", "Sepsis NOS"), (6, "Q12", "icd10", None), (7, None, None, "only text"), (8, " ", None, None), (9, "Z99", "mixed", None)]
    facts = spark.createDataFrame(rows, "id long, code string, version string, text string")
    maps = {
        "fine": spark.createDataFrame([("a419", "SEP")], "code string, category string"),
        "coarse": spark.createDataFrame([("0389", "2")], "code string, category string"),
        "chapter": spark.createDataFrame([("icd10", "z99", "21")], "version string, category3 string, chapter string"),
        "text": spark.createDataFrame([("sepsis_nos", "cond:sepsis")], "text string, token string"),
        "project_code": spark.createDataFrame([("q12", "p:eye")], "code string, token string"),
        "project_prefix": spark.createDataFrame([("a4", "p:sepsis"), ("a", "p:a")], "prefix string, token string"),
    }
    got = {r.id: (r.token, r.status, r.confidence, r.project_token) for r in harmonize.condition_rollup(facts, maps).collect()}
    assert got[1] == ("ccsr:SEP", "mapped_ccsr", "exact", "p:sepsis") and got[2][0] == got[3][0] == "ccs:2" and got[4][:2] == ("icd10chap:21", "mapped_chapter")
    assert got[5] == ("cond:sepsis", "mapped_text_to_condition", "curated_text", "p:eye") and got[6][:3] == ("icd10cat:q12", "source_native_code", "fallback_native")
    assert got[7] == (None, "source_native_text", None, None) and got[8][1] == "unmapped_condition" and got[9][0] == "icdcat:z99"
    bare = {r.id: r.status for r in harmonize.condition_rollup(facts, {}).collect()}
    assert bare[1] == "source_native_code" and len(bare) == 9
    walk = maps | {"crosswalk": spark.createDataFrame([("999", "a419", True)], "source_code string, target_code string, approximate boolean")}
    row = harmonize.condition_rollup(spark.createDataFrame([(1, "99.9", "icd9", None)], facts.schema), walk).first()
    assert (row.token, row.status, row.confidence) == ("ccsr:SEP", "mapped_icd_crosswalk", "approximate")


def test_window_features_at_their_borders(spark):
    rows = [(1, 1, "lab", 1.5, 0.0), (1, 2, "lab", 2.0, 24.0), (1, 3, "lab", 9.0, 24.1), (1, 4, "lab", None, 12.0), (1, 5, "hr", 80.0, 3.0), (1, 6, "hr", 1.0, None), (1, 7, "lab", 9.0, -1.0)]
    events = spark.createDataFrame(rows, "stay_id long, event_id long, token string, value double, hours double")
    got = {r.token: r for r in features.token_statistics(events).collect()}
    lab = got["lab"]
    assert (lab["count"], lab["first"], lab["last"], lab.delta, lab.hours_since_last, lab.missing) == (3, 1.5, 2.0, 0.5, 0.0, 0) and lab.slope == pytest.approx(0.5 / 24)
    assert got["hr"].slope is None and got["hr"]["count"] == 1
    wide = features.wide_features(spark.createDataFrame([(1,), (2,)], "stay_id long"), features.token_statistics(events), ["lab", "spo2"], "x", ("count", "missing", "mean")).orderBy("stay_id").collect()
    assert (wide[0].x_lab_count, wide[0].x_spo2_missing, wide[1].x_lab_count, wide[1].x_lab_missing, wide[1].x_lab_mean) == (3, 1, 0, 1, None)
    sequence = features.event_sequence(events.withColumn("event_type", F.when(F.col("token") == "hr", "medication").otherwise("lab")))
    assert [(r.event_id, r.position) for r in sequence.orderBy("position").collect()] == [(1, 1), (4, 2), (2, 3)]


def graph_inputs(spark):
    rows = [("dev", "train", 1, "1|c", "c", "a", 1, True), ("dev", "train", 1, "1|c", "c", "b", 2, True), ("dev", "train", 2, "2|c", "c", "a", 1, True), ("dev", "validation", 3, "3|c", "c", "z", 3, True), ("external", "external", 4, "4|e", "e", "a", 1, False)]
    pcm = spark.createDataFrame(rows, "source string, split string, stay_id long, group_id string, condition string, candidate string, candidate_rank long, label boolean")
    context = spark.createDataFrame([(1, "lab", "lactate", 24.0), (1, "lab", "late", 25.0), (2, "vital", "hr", 1.0), (2, "note", "n", 1.0), (3, "lab", "lactate", 2.0), (3, "lab", "only_validation", 1.0), (4, "lab", "lactate", 1.0)], "stay_id long, event_type string, token string, hours double")
    return pcm, context


def test_graph_is_fitted_on_training_rows(spark):
    pcm, context = graph_inputs(spark)
    edges = graph.graph_edges(pcm, context)
    got = {(r.src_id, r.dst_id): r.support for r in edges.collect()}
    assert got == {("c", "a"): 2, ("c", "b"): 1, ("c", "lactate"): 1, ("c", "hr"): 1, ("a", "b"): 1}
    assert graph.component_summary(edges) == {"components": 1, "largest": 5, "nodes": 5}
    assert graph.component_summary(edges.limit(0)) == {"components": 0, "largest": 0, "nodes": 0}
    assert graph.graph_gate(0, 0, 0, True)["status"] == "blocked" and graph.graph_gate(5, 2, 5, True)["status"] == "passed"
    cold = {r.split: (r.pair_rows, r.cold_start_rate) for r in graph.coverage(pcm, edges).collect()}
    assert cold == {"train": (3, 0.0), "validation": (0, 1.0), "external": (0, 0.0)}


def test_subgraphs_with_cold_and_foreign_nodes(spark):
    pcm, context = graph_inputs(spark)
    edges = graph.graph_edges(pcm, context)
    nodes = subgraphs.subgraph_nodes(pcm, context, edges)
    by = {}
    for r in nodes.orderBy("node_index").collect():
        by.setdefault(r.group_id, []).append((r.node_index, r.role, r.id, r.cold_start))
    assert by["3|c"] == [(0, "query_condition", "c", False), (1, "candidate", "z", True), (2, "context", "lactate", False)]
    assert by["4|e"] == [(0, "query_condition", "e", True), (1, "candidate", "a", False)]
    own = subgraphs.subgraph_edges(nodes, edges)
    assert {(r.group_id, r.src_id, r.dst_id) for r in own.collect()} == {("1|c", "c", "a"), ("1|c", "c", "b"), ("1|c", "c", "lactate"), ("1|c", "a", "b"), ("2|c", "c", "a"), ("2|c", "c", "hr"), ("3|c", "c", "lactate")}
    index = {r.group_id: (r.nodes, r.edges, r.candidates, r.positives, r.cold_nodes) for r in subgraphs.subgraph_index(nodes, own, subgraphs.subgraph_candidates(pcm, nodes)).collect()}
    assert index["4|e"] == (2, 0, 1, 0, 1) and index["1|c"] == (4, 4, 2, 2, 0)


def test_graph_features_below_the_support_are_zero(spark):
    pcm, context = graph_inputs(spark)
    out = {(r.group_id, r.candidate): r for r in graph.graph_features(pcm, graph.graph_edges(pcm, context), 2).collect()}
    assert out["1|c", "a"].pair_support == 2 and out["1|c", "b"].pair_support == 0 and out["1|c", "b"].pair_in_graph == 0 and out["4|e", "a"].condition_in_graph == 0


def test_profile_counts(spark):
    df = spark.createDataFrame([("1", "2020-01-01"), ("x", "bad"), ("999", " "), (None, None)], "n string, t string")
    out = {r.column_name: r for r in profile.profile_columns(df, [profile.ColumnSpec("n", "number", 0, 100), profile.ColumnSpec("t", "timestamp")]).collect()}
    assert (out["n"].blank, out["n"].failed, out["n"].outside, out["n"].largest) == (1, 1, 1, 999.0) and (out["t"].blank, out["t"].failed) == (2, 1)
    issues = {(f["column"], f["issue"]) for f in profile.quality_findings([r.asDict() for r in out.values()])}
    assert issues == {("n", "parse_failures"), ("n", "out_of_bounds"), ("t", "high_null_rate"), ("t", "parse_failures")}
    assert tuple(profile.duplicate_keys(spark.createDataFrame([(1,), (1,), (1,), (2,)], "k int"), ["k"]).first()) == (1, 3, 2)
    assert profile.domain_readiness({"a": True, "b": False}, {"x": ["a"], "y": ["a", "b"], "z": ["b"]}) == {"x": "ready", "y": "partial", "z": "blocked"}
    assert profile.table_gate("a", {"a": "completed"}, {})[1] == "blocked_by_integrity:missing" and profile.table_gate("a", {}, {}, False)[0]


def test_versions_agree_or_fail(spark):
    a, b = one(spark, "v1").withColumnRenamed("x", "version"), one(spark, "v2").withColumnRenamed("x", "version")
    assert profile.one_version([a, a, spark.range(1)], "version") == "v1" and profile.one_version([spark.range(1)], "version", fallback="v0") == "v0"
    for bad in ([a, b], [a]):
        with pytest.raises(ValueError):
            profile.one_version(bad, "version", declared="v9")


def test_contract_lock_and_columns(spark):
    df = spark.createDataFrame([(1, "t", 1.0, True, 2.0)], "patient_id long, raw_text string, lactate_mean double, label boolean, hospital_expire_flag double")
    assert contract.approved_columns(df, ["lactate_mean", "raw_text"], dynamic=True) == ["lactate_mean"]
    with pytest.raises(ValueError):
        contract.checked_columns(df, ["patient_id"], dynamic=True)
    assert [contract.column_role(c) for c in df.columns] == ["identifier", "excluded", "feature", "label", "excluded"]
    events = spark.createDataFrame([(1.0,), (25.0,)], "hours double")
    labels = spark.createDataFrame([(25.0,)], "first_hours double")
    good = contract.contract_lock({"f": df}, {"feature": "1"}, {"leakage": contract.leakage_audit(events.where("hours < 24"), labels, 24, 48)})
    assert good["status"] == "passed" and contract.contract_lock({"f": df.repartition(2)}, {"feature": "1"}, {}, good)["differs"] == []
    changed = contract.contract_lock({"f": df.withColumn("lactate_mean", F.lit(2.0))}, {"feature": "1"}, {}, good)
    assert "contract_digest_mismatch" in changed["differs"] and changed["status"] == "failed" and contract.preflight(changed, ["f", "g"]) == ["contract_lock_not_passed", "missing_or_empty:g"]
    leaky = contract.contract_lock({}, {}, {"event_temporal_leakage": contract.leakage_audit(events, labels, 24, 48)})
    assert leaky["faults"] == ["event_temporal_leakage:events_after_prediction=1"]
    assert contract.external_readiness({"status": "completed", "positive_groups": 3}, None)["claim"] == "blocked"


def test_mappings_by_list_group_and_name(spark):
    drugs = spark.createDataFrame([("1", None, "x"), (" ", "g", "x"), (None, None, "Aspirin 81 mg tab"), (None, None, "unknown")], "list_code string, group_code string, name string")
    by = lambda c, k: spark.createDataFrame([(k, f"rx:{k}")], f"{c} string, concept string")
    out = mappings.name_mapping(drugs, by("list_code", "1"), by("group_code", "g"), by("name", "ASPIRIN"))
    assert [(r.concept, r.matched_by) for r in out.collect()] == [("rx:1", "list"), ("rx:g", "group"), ("rx:ASPIRIN", "name"), (None, None)]
    codes = spark.createDataFrame([("00093-0150-01", "a"), ("5", "b")], "code string, name string")
    graded = mappings.graded_mapping(codes, [("local", "high", spark.createDataFrame([("0093015001", "9")], "code string, concept string")), ("old", "low", spark.createDataFrame([("5", "1"), ("00093015001", "2")], "code string, concept string"))])
    assert {r.name: (r.concept, r.confidence) for r in graded.collect()} == {"a": ("9", "high"), "b": ("1", "low")}
    existing = spark.createDataFrame([("5", "77", None)], "code string, concept string, class string")
    own = mappings.code_mapping(codes, spark.createDataFrame([("0093015001", "9")], "code string, concept string"), spark.createDataFrame([("9", "C07A")], "concept string, class string"), existing)
    assert {r.code: (r.concept, r["class"], r.method) for r in own.collect()} == {"00093-0150-01": ("9", "C07A", "reference"), "5": ("77", None, "existing")}


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "a").mkdir()
    with gzip.open(tmp_path / "a" / "t.csv.gz", "wt") as f:
        f.write("id,name\n1,x\n2,\n")
    (tmp_path / "a" / "empty.csv").write_text("")
    (tmp_path / "a" / "cut.csv.gz").write_bytes((tmp_path / "a" / "t.csv.gz").read_bytes()[:-9])
    path = str(tmp_path / "a" / "t.csv.gz")
    assert files.header_of(path) == ("id", "name") and files.header_of(tmp_path / "a" / "empty.csv") == () and files.header_of("x.parquet") is None
    table = files.csv_text(spark, path)
    assert table.dtypes == [("id", "string"), ("name", "string")] and table.count() == 2 and dict((f.name, f.dataType.simpleString()) for f in files.inferred_schema(spark, path))["id"] == "int"
    with pytest.raises(ValueError):
        files.bounded(table, [], 5)
    with pytest.raises(ValueError):
        files.inside(tmp_path, "../x")
    out = str(tmp_path / "out")
    assert files.write_atomic(table, out) == 2 and files.write_atomic(table.limit(1), out) == 1 and files.parquet(spark, out).count() == 1
    with pytest.raises(Exception):
        files.write_atomic(table.withColumn("id", F.raise_error(F.lit("stop")).cast("string")), out)
    assert files.parquet(spark, out).count() == 1 and not [p for p in tmp_path.iterdir() if p.name.startswith(".out")]
    assert files.gzip_state(path)[0] == "ok" and files.gzip_state(tmp_path / "a" / "cut.csv.gz")[0] == "truncated" and files.gzip_state(tmp_path / "a" / "empty.csv")[0] in ("ok", "corrupt", "truncated")
    digest = hashlib.sha256((tmp_path / "a" / "t.csv.gz").read_bytes()).hexdigest()
    manifest = files.checksums(f"{digest}  t.csv.gz\n{'0' * 64} *empty.csv\n{'1' * 64}  gone.csv\n")
    got = {r.name: (r.status, r.gzip_state) for r in files.integrity(spark, str(tmp_path / "a"), manifest).collect()}
    assert got == {"t.csv.gz": ("verified", "ok"), "empty.csv": ("checksum_mismatch", "not_gzip"), "gone.csv": ("missing_file", None), "cut.csv.gz": ("not_listed", "truncated")}
    inventory = files.inventory(tmp_path, {"a": ["t.csv.gz", "gone.csv"], "b": ["x"]})
    assert inventory[0]["missing"] == ["gone.csv"] and inventory[1]["missing"] == ["x"]
    assert files.needs_limit("big", 1, ["big"]) and files.needs_limit("x", 200 << 20) and not files.needs_limit("x", 5) and files.empty(spark, "a int").count() == 0


def test_reference_lists(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    assert [tuple(r) for r in files.rrf(spark, put("x.rrf", "1|NA||a|\n2|b|c|d|\n"), ["id", "x", "y", "z"]).collect()] == [("1", "NA", "", "a"), ("2", "b", "c", "d")]
    flexible = files.flexible_table(spark, put("f.txt", "NDC;RxCUI\n1;2\n"), {"code": ["ndc"], "concept": ["rxcui"], "other": ["none"]})
    assert tuple(flexible.first()) == ("1", "2", None)
    assert sorted(tuple(r) for r in files.dict_literal(spark, "{'1': 'a', 2: 'b'}", "k", "v").collect()) == [("1", "a"), ("2", "b")]
    assert [tuple(r) for r in files.category_csv(spark, put("c.csv", "'CODE','DEFAULT','CAT1'\n'A419','\"\"\"SEP\"\"\"','X'\n'B1',' ','Y'\n'C1',' ',' '\n")).collect()] == [("A419", "SEP"), ("B1", "Y")]
    assert [tuple(r) for r in files.single_level_csv(spark, put("s.csv", "a note\n'ICD','CAT','LABEL'\n'0389 ','2','Septicemia'\n'1','0','none'\n'2','','none'\n")).collect()] == [("0389", "2", "Septicemia")]
    assert [tuple(r) for r in files.crosswalk_text(spark, put("g.txt", "0389  A419  10000\n0390  NoDx  11000\n\n0391 B1 00000\n")).collect()] == [("0389", "A419", True), ("0391", "B1", False)]
    chapters = mappings.chapter_rows(spark.createDataFrame([("a41.9",), ("C5",), ("Z99",)], "code string"), spark.createDataFrame([("A00", "B99", "1"), ("C00", "D49", "2")], "low string, high string, chapter string"))
    assert {r.category: r.chapter for r in chapters.collect()} == {"A41": "1", "C5": "2", "Z99": None}


def test_extracts_go_by_gates_headers_and_rows(spark, tmp_path):
    own = spark.createDataFrame([(100, "1"), (101, "2")], "stay_id long, patient_id string")
    good = spark.createDataFrame([("1", "x", 5), ("9", "x", 5), ("2", "y", 6)], "patient string, v string, item int")
    bad = good.withColumn("v", F.when(F.col("item") > 0, F.raise_error(F.lit("stop"))).cast("string"))
    spec = lambda t, **k: extract.ExtractSpec(t, ["v"], {"patient": "patient_id"}, **k)
    specs = [spec("a", row_filter=F.col("item") == 5), spec("blocked"), spec("gone"), spec("narrow", required=["w"]), spec("bad")]
    state = {t: "passed" for t in ("a", "gone", "narrow", "bad")}
    out = extract.build_extracts({"a": good, "narrow": good, "bad": bad, "blocked": good}, own, specs, str(tmp_path), state, state, "v1")
    assert [(r["table"], r["status"], r["rows"]) for r in out] == [("a", "completed", 1), ("blocked", "skipped", None), ("gone", "skipped", None), ("narrow", "failed", None), ("bad", "failed", None)]
    assert out[1]["reason"] == "blocked_by_quality:missing" and out[3]["reason"] == "missing_columns:w"
    row = files.parquet(spark, str(tmp_path / "a")).first()
    assert (row.stay_id, row.v, row.extraction_version) == (100, "x", "v1") and not (tmp_path / "bad").exists()


def test_subgraphs_of_groups_in_rows_move_nothing(spark):
    """A group's nodes, edges and candidates come from its own row, and equal those of the tables."""
    from quillon.operators import subgraphs

    member = "array<struct<candidate:string,candidate_rank:long,label:boolean>>"
    groups = spark.createDataFrame([("dev", "train", 1, "1|a", "a", [("x", 1, True), ("y", 2, False)], [("lab", "l"), ("vital", "v")]), ("dev", "train", 2, "2|b", "b", [("y", 1, True)], None)], f"source string, split string, stay_id long, group_id string, condition string, members {member}, seen array<struct<type:string,id:string>>")
    edges = spark.createDataFrame([("condition", "a", "lab", "l", "condition_lab", 2), ("condition", "a", "medication", "x", "condition_medication", 3), ("medication", "x", "medication", "y", "medication_medication", 4)], "src_type string, src_id string, dst_type string, dst_id string, relation string, support long")
    own = subgraphs.group_nodes(groups, edges)
    rows, context = groups.selectExpr("source", "split", "stay_id", "group_id", "condition", "inline(members)"), groups.selectExpr("stay_id", "0D as hours", "inline(seen)").withColumnsRenamed({"type": "event_type", "id": "token"})
    nodes = subgraphs.subgraph_nodes(rows, context, edges).cache()
    same = lambda a, b: sorted(map(repr, map(tuple, a.select(*b.columns).collect()))) == sorted(map(repr, map(tuple, b.collect())))
    assert same(subgraphs.node_rows(own, edges), nodes) and nodes.count() == 6
    met, listed = subgraphs.edge_rows(own, edges), subgraphs.candidate_rows(own, edges)
    assert same(met, subgraphs.subgraph_edges(nodes, edges)) and same(listed, subgraphs.subgraph_candidates(rows, nodes))
    assert same(subgraphs.index_rows(own, edges), subgraphs.subgraph_index(nodes, met, listed))
