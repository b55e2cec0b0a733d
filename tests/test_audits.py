from __future__ import annotations

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import lock, reports
from quillon.sources import inventory
from quillon.sources.scratch import fresh_path, stash


def chunks(raw, size):
    return (raw[k : k + size] for k in range(0, len(raw), size))


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_gzip_members_of_any_stream(size):
    rng = random.Random(1)
    bodies = [b"", b"x", rng.randbytes(5000), b"a" * 300_000]
    for n in (1, 2, 4):
        own = [rng.choice(bodies) for _ in range(n)]
        raw = b"".join(gzip.compress(b, mtime=0) for b in own)
        total = sum(map(len, own))
        assert inventory.gzip_members(chunks(raw, size)) == ("ok", n, total)
        assert inventory.gzip_members(chunks(raw + b"\0" * 9, size)) == ("ok", n, total)
        assert inventory.gzip_members(chunks(raw[:-3], size))[0] == "truncated"
        assert inventory.gzip_members(chunks(raw + b"rest of it", size))[0] == "corrupt"
        assert inventory.gzip_members(chunks(raw[:-8] + bytes([raw[-8] ^ 1]) + raw[-7:], size))[0] == "corrupt"
    assert inventory.gzip_members(chunks(b"", size)) == ("truncated", 0, 0)
    assert inventory.gzip_members(chunks(b"no gzip at all", size))[0] == "corrupt"


def test_files_are_put_listed_and_described(spark):
    root = fresh_path(spark, "put")
    rows = spark.createDataFrame([("a/x.csv", b"k,v\n1,2\n"), ("a/deep/er/y.csv.gz", gzip.compress(b"p\n")), ("b/z.bin", None), ("b/empty one.csv", b""), (None, b"x")], "name string, content binary")
    put = {r.name: r.length for r in inventory.put_files(rows, root).collect()}
    listed = {r.name: r.length for r in inventory.files_below(spark, root).collect()}
    assert put == listed and listed["b/z.bin"] == 0 and len(listed) == 4
    files = stash(inventory.files_below(spark, root), "files")
    got = {r.name: (r.suffix, r.header) for r in inventory.described_files(files).collect()}
    assert got == {"a/x.csv": (".csv", ["k", "v"]), "a/deep/er/y.csv.gz": (".csv.gz", ["p"]), "b/z.bin": (".bin", None), "b/empty one.csv": (".csv", [])}
    expected = spark.createDataFrame([("a", "x.csv"), ("a", "deep/er/y.csv.gz"), ("a", "none"), ("c", "q"), (None, "r")], "source string, name string")
    own = {r.source: (r.present, r.file_count, r.expected_file_count, r.missing) for r in inventory.source_inventory(files, expected).collect()}
    assert own == {"a": (True, 2, 3, ["none"]), "b": (True, 2, 0, []), "c": (False, 0, 1, ["q"])}
    states = inventory.gzip_states(spark.createDataFrame([(None, "gone.gz"), (f"{root}/no.gz", "no.gz"), (None, "plain")], "path string, name string"))
    assert {r.name: r.state for r in states.collect()} == {"gone.gz": "missing", "no.gz": "missing", "plain": "not_gzip"}


def test_lock_sees_one_changed_value_and_no_more(spark):
    root, other = fresh_path(spark, "t"), fresh_path(spark, "u")
    df = spark.range(100).select("id", (F.col("id") * 2).alias("v"), (F.col("id") % 4).alias("part"))
    df.write.partitionBy("part").parquet(root)
    df.limit(5).write.parquet(other)
    leaves = stash(lock.lock_leaves(spark, {"t": root, "u": other}), "lock")
    roots = {r.table: (r.rows, r.digest) for r in lock.lock_roots(leaves).collect()}
    assert roots["t"][0] == 100 and roots["u"][0] == 5 and roots[None][0] == 105 and len({d for _, d in roots.values()}) == 3
    assert {r.table: r.digest for r in lock.lock_roots(leaves, {"v": "2"}).collect()}[None] != roots[None][1]
    now = lock.verify_lock(spark, leaves, {"t": root, "u": other})
    assert {(r.status, r.reread) for r in now.collect()} == {("unchanged", False)}
    assert {(r.status, r.reread) for r in lock.verify_lock(spark, leaves, {"t": root, "u": other}, False).collect()} == {("unchanged", True)}
    df.where("part = 2").select("id", F.when(F.col("id") == 50, 0).otherwise(F.col("v")).alias("v")).write.mode("overwrite").parquet(f"{root}/part=2")
    df.where("part = 1").drop("part").orderBy(F.desc("id")).write.mode("overwrite").parquet(f"{root}/part=1")
    now = stash(lock.verify_lock(spark, leaves, {"t": root}), "verified")
    parts = {(r.table, r.part): r.passed for r in lock.differing_parts(now).collect()}
    assert parts == {("t", "part=0"): True, ("t", "part=1"): True, ("t", "part=2"): False, ("t", "part=3"): True, ("u", ""): False}
    assert {r.part for r in now.where("reread").collect()} == {"part=1", "part=2"}
    checks = lock.lock_checks(now, spark.createDataFrame([("n", 0, True)], "check string, value long, passed boolean"), {"a": "1"}, {"a": "1", "b": "2"})
    got = {r.check: r.passed for r in checks.collect()}
    assert got == {"table:t": False, "table:u": False, "audit:n": True, "version:a": True, "version:b": False}
    ready = {r.check: r.passed for r in lock.preflight_checks(checks, lock.lock_roots(leaves), ["t"]).collect()}
    assert ready == {"contract_lock": False, "table:t": True}
    assert not lock.preflight_checks(checks.limit(0), lock.lock_roots(leaves), []).first().passed


def test_lock_of_rows_that_swap_values_differs(spark):
    a, b = fresh_path(spark, "a"), fresh_path(spark, "b")
    spark.createDataFrame([(1, 2), (3, 4)], "x int, y int").coalesce(1).write.parquet(a)
    spark.createDataFrame([(1, 4), (3, 2)], "x int, y int").coalesce(1).write.parquet(b)
    one, two = (lock.lock_leaves(spark, {"t": p}).where("rows > 0").select("rows", "a", "b").first() for p in (a, b))
    assert one.rows == two.rows and (one.a, one.b) != (two.a, two.b)


def test_reports_of_empty_and_odd_tables(spark):
    none = spark.createDataFrame([], "table_name string, status string")
    tables = spark.createDataFrame([("a",), ("a",), (None,)], "table_name string")
    assert {(r.table_name, r.ready, r.reason) for r in reports.table_gates(tables, none, none).collect()} == {("a", False, "blocked_by_quality:missing"), (None, False, "blocked_by_quality:missing")}
    assert {r.reason for r in reports.table_gates(tables, none, none, False).collect()} == {"not_enforced"}
    assert reports.status_counts(none, ["status"]).count() == 0
    manifests = spark.createDataFrame([("p", "completed", 3), ("s", None, None)], "name string, status string, positive_groups long")
    gate = reports.claim_gate(manifests, ["p", "s", "x"]).first()
    assert (gate.claim, gate.faults) == ("blocked", ["s:unknown", "x:missing"])
    assert reports.claim_gate(manifests.limit(1), ["p"]).first().claim == "allowed"
    df = spark.createDataFrame([(1, "x", 2.0, 3)], "patient_id int, note string, age double, label int")
    got = {r.column_name: (r.role, r.decision) for r in reports.column_decisions(df, ["note", "label", "patient_id"], dynamic=True).collect()}
    assert got == {"patient_id": ("identifier", "refused_unsafe"), "note": ("excluded", "refused_unsafe"), "age": ("feature", "projected"), "label": ("label", "refused_unsafe")}
    assert reports.projected(df, reports.column_decisions(df, ["age"])).columns == ["age"]


def test_lists_of_local_paths_are_names_below_their_root(spark):
    root = fresh_path(spark, "deep")
    inventory.put_files(spark.createDataFrame([("x/deep/y.txt", b"1")], "name string, content binary"), root).collect()
    assert [os.path.basename(r.name) for r in inventory.files_below(spark, root).collect()] == ["y.txt"]
    assert [r.name for r in inventory.files_below(spark, root + "/").collect()] == ["x/deep/y.txt"]
