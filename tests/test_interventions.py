from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillon.operators import harmonize, interventions

EVENTS = "stay string, start double, `end` double"


def covered(rows):
    """The spans of each stay, by marking every half unit."""
    out = {}
    for stay in {r[0] for r in rows}:
        own = sorted((s, max(s, s if e is None else e)) for k, s, e in rows if k == stay and s is not None)
        spans = []
        for s, e in own:
            if spans and s <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], e), spans[-1][2] + 1)
            else:
                spans.append((s, e, 1))
        if spans:
            out[stay] = spans
    return out


def test_covered_spans_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice(("a", "b", "c", None)), rng.choice((None, float(rng.randrange(40)))), rng.choice((None, float(rng.randrange(50))))) for _ in range(400)]
    rows += [("d", 1.0, 2.0), ("d", 2.0, 3.0), ("d", 3.5, 3.0), ("e", None, 4.0)]
    spans = interventions.covered_spans(spark.createDataFrame(rows, EVENTS), ["stay"])
    got = {}
    for r in spans.collect():
        got.setdefault(r.stay, []).append((r.start, r["end"], r.events))
    assert {k: sorted(v) for k, v in got.items()} == covered(rows)
    assert got["d"] == [(1.0, 3.0, 2), (3.5, 3.5, 1)] or sorted(got["d"]) == [(1.0, 3.0, 2), (3.5, 3.5, 1)]
    hours = {r.stay: (r.hours, r.spans) for r in interventions.covered_hours(spans, ["stay"], 2.5).collect()}
    assert hours["d"] == (1.5, 2)
    assert interventions.covered_spans(spark.createDataFrame([], EVENTS), ["stay"]).count() == 0


def test_rows_of_odd_values(spark):
    items = spark.createDataFrame([("s", "e", None, None, None, None, None, None, "x", None), ("s", "f", "2024-01-01 00:00:00", "no time", " 7 ", None, None, "on", "1.5", "")], "stay_id string, event_id string, start string, end string, item string, category string, description string, state string, value string, unit string")
    got = {r.event_id: r for r in interventions.item_rows(items, spark.createDataFrame([(7, "Zeta"), (7, "Alpha beta"), (None, "x")], "item int, label string")).collect()}
    assert (got["e"].token, got["e"].status, got["e"].value_numeric) == (None, "unmapped_source_concept", None)
    assert (got["f"].text, got["f"].token, got["f"].value_numeric, got["f"].end_time, got["f"].normalized_unit) == ("Alpha beta", "alpha_beta", 1.5, None, None) and got["f"].start_time is not None
    codes = spark.createDataFrame([("s", 1, None, None, None)], "stay_id string, sequence int, time timestamp, code string, version string")
    row = interventions.procedure_rows(codes).first()
    assert (row.token, row.code_type) == ("icd:procedure:", "ICD")
    flags = spark.createDataFrame([("s", 1, "0", None), ("s", 2, " ", "high")], "stay_id string, event_id int, a string, b string")
    assert sorted((r.event_id, r.token, r.value_text, r.value_numeric) for r in interventions.column_rows(flags, ["a", "b"]).collect()) == [("1", "a", "0", 0.0), ("2", "b", "high", None)]
    assert interventions.intervention_rows(interventions.item_rows(items), interventions.procedure_rows(codes)).count() == 3


def test_fields_come_from_one_mapping_row(spark):
    facts = spark.createDataFrame([(1, "A1", "icd10", None), (2, "B2", "icd9", "Some text"), (3, None, "icd9", "some  TEXT"), (4, None, None, None)], "id int, code string, version string, text string")
    fine = spark.createDataFrame([("a1", "F2", "second"), ("a1", "F1", None), ("a1", "F1", "first"), (None, "F0", "none")], "code string, category string, name string")
    text = spark.createDataFrame([("some_text", "cond:x")], "text string, token string")
    got = {r.id: (r.token, r.system, r.mapped_code, r.mapped_name, r.mapped_by) for r in harmonize.condition_rollup(facts, {"fine": fine, "text": text}).collect()}
    assert got == {1: ("ccsr:F1", "CCSR", "F1", "first", "fine"), 2: ("cond:x", "TEXT_CONDITION", "cond:x", None, "text"), 3: ("cond:x", "TEXT_CONDITION", "cond:x", None, "text"), 4: (None,) * 5}
    assert harmonize.condition_rollup(facts.where(F.lit(False)), {"fine": fine}).count() == 0


def test_names_share_words_as_brute_force_says(spark):
    from quillon.operators import mappings

    rng = random.Random(5)
    words = "alpha beta gamma delta tab mg oral zeta".split()
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 5)))
    drugs, refs = [(f"d{k}", name()) for k in range(60)] + [("none", None)], [(f"c{k % 20}", name() + " 5") for k in range(50)] + [(None, "alpha"), ("cx", None)]
    got = {(r.drug, r.concept): (r.shared, r.grade) for r in mappings.name_candidates(spark.createDataFrame(drugs, "drug string, name string"), spark.createDataFrame(refs, "concept string, name string")).collect()}
    plain = lambda n: {w for w in (n or "").split() if w not in ("tab", "mg", "oral", "5")}
    want = {}
    for d, n in drugs:
        for c, m in refs:
            if c and plain(m) and plain(m) <= plain(n):
                own = (len(plain(m)), "same" if plain(m) == plain(n) else "part")
                want[d, c] = max(want.get((d, c), own), own)
    assert got == want and len(want) > 50


def test_codes_without_anything_are_unmapped(spark):
    from quillon.operators import mappings

    make = spark.createDataFrame
    codes = make([("00001234567", "x"), ("00001234567", "a"), (" ", "y"), (None, "z")], "code string, name string")
    none = make([], "code string, concept string"), make([], "concept string, class string")
    assert [(r.code, r.name, r.concept, r.confidence, r.status) for r in mappings.graded_codes(codes, *none).collect()] == [("00001234567", "a", None, "unmapped", "unmapped_code_to_concept")]
