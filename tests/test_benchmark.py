"""Benchmark cases, scenarios and the gate, with planted predictions."""

import pytest

from tidemark.operators import benchmark as B

CASE = "case_id string, media_kind string, split string, tolerance_ms bigint, source_start bigint, source_end bigint, target_start bigint, same_media boolean"
ANCHOR = "case_id string, source_ms bigint, target_ms bigint"
GOLD = "case_id string, kind string, index int, source_start bigint, source_end bigint, target_start bigint, target_end bigint"
SPAN = "map_id string, span_index int, kind string, source_start bigint, source_end bigint, target_start bigint, target_end bigint"


def frames(spark, cases, anchors, gold, predicted, spans):
    return [spark.createDataFrame(rows, schema) for rows, schema in ((cases, CASE), (anchors, ANCHOR), (gold, GOLD), ([(p,) for p in predicted], "case_id string"), (spans, SPAN))]


@pytest.fixture(scope="module")
def small(spark):
    cases = [("exact", "real", "frozen-test", 500, 0, 10_000, 0, False), ("off", "real", "development", 500, 0, 10_000, 100, False), ("broken", "synthetic", "development", 500, 0, 10_000, 0, False), ("missing", "real", "development", 500, 0, 10_000, 0, True), ("wide", "real", "development", 500, 0, 3_000_000, 0, False)]
    anchors = [("exact", 1000, 1000), ("exact", 8000, 7000), ("off", 1000, 1150), ("off", 5000, 5100), ("broken", 100, 100), ("missing", 5, 5), ("wide", 0, 0), ("wide", 100, 110)]
    gold = [("exact", "sourceOnly", 0, 4000, 5000, 4000, 4000), ("off", "targetOnly", 0, 5000, 5000, 5100, 5600), ("off", "ambiguous", 0, 9000, 9500, 9700, 9900), ("broken", "sourceOnly", 0, 1, 2, 1, 1)]
    spans = [("exact", 0, "matched", 0, 4000, 0, 4000), ("exact", 1, "sourceOnly", 4000, 5000, 4000, 4000), ("exact", 2, "matched", 5000, 10_000, 4000, 9000)]
    spans += [("off", 0, "matched", 0, 5300, 100, 5400), ("off", 1, "targetOnly", 5300, 5300, 5400, 5900), ("off", 2, "ambiguous", 5300, 7000, 5900, 7000), ("off", 3, "matched", 7000, 9000, 7000, 9000)]
    spans += [("broken", 0, "matched", 0, 5000, 0, 5000), ("broken", 1, "matched", 4000, 9000, 5000, 9000)]
    return frames(spark, cases, anchors, gold, ["exact", "off", "broken", "stranger", "wide"], spans)


def test_case_results(spark, small):
    results, errors = B.case_results(*small)
    got = {r["case_id"]: r.asDict() for r in results.collect()}
    pick = lambda name, *keys: tuple(got[name][k] for k in keys)
    assert pick("exact", "missing", "faults", "mapped", "unmapped", "tp", "fp", "fn", "covered_ms", "ambiguous_ms", "matched_ms") == (False, 0, 2, 0, 1, 0, 0, 10_000, 0, 9000)
    assert pick("off", "faults", "mapped", "unmapped", "tp", "fp", "fn", "tp_targetOnly", "fn_ambiguous", "covered_ms", "ambiguous_ms") == (0, 2, 0, 1, 1, 1, 1, 1, 9000, 1700)
    assert pick("broken", "faults", "backwards", "mapped", "unmapped", "fn") == (1, 1, 0, 1, 1)
    assert pick("missing", "missing", "faults", "unmapped") == (True, 1, 1)
    assert pick("wide", "missing", "faults", "mapped", "unmapped", "covered_ms") == (False, 0, 0, 2, 0)
    shown = sorted((r["case_id"], r["what"], r["error_ms"]) for r in errors.collect())
    assert [x for x in shown if x[1] == "anchor"] == [("exact", "anchor", 0), ("exact", "anchor", 0), ("off", "anchor", 0), ("off", "anchor", 50)]
    assert [x[2] for x in shown if x[:2] == ("exact", "boundary")] == [0, 0, 0]
    assert sorted(x[2] for x in shown if x[:2] == ("off", "boundary")) == sorted([300, 300, 300, 9000 - 5300, 9700 - 5900, 9500 - 7000, 9900 - 7000])


def test_scenarios(small):
    cases, anchors, gold, *_ = small
    got = {}
    for r in B.scenarios(cases, anchors, gold).collect():
        got.setdefault(r["case_id"], set()).add(r["scenario"])
    assert got == {"exact": {"source-only"}, "off": {"target-only", "ambiguous", "multi-edit", "global-offset"}, "broken": {"source-only"}, "wide": {"long-reference", "time-stretch"}}


def test_summaries(spark, small):
    results, errors = B.case_results(*small)
    groups = spark.createDataFrame([("all", c) for c in ("exact", "off", "broken", "missing", "wide")] + [("one", "exact")], "group string, case_id string")
    got = {r["group"]: r for r in B.summaries(results, errors, groups).collect()}
    assert (got["all"]["cases"], got["all"]["missing"], got["all"]["faults"], got["all"]["mapped"], got["all"]["unmapped"]) == (5, 1, 2, 4, 4)
    assert (got["all"]["tp"], got["all"]["fp"], got["all"]["fn"]) == (2, 1, 2) and abs(got["all"]["f1"] - 4 / 7) < 1e-12
    assert (got["one"]["anchor_p95"], got["one"]["anchor_most"], got["one"]["cover"], got["one"]["least_cover"], got["one"]["f1_targetOnly"]) == (0, 0, 1, 1, 1)
    assert got["all"]["anchor_most"] == 50 and got["all"]["least_cover"] == 0


def test_gate(spark, small, monkeypatch):
    cases, anchors, gold, predicted, spans = small
    results, errors = B.case_results(*small)
    told = B.scenarios(cases, anchors, gold)
    few = B.gate(cases, told, results, errors, predicted)
    assert B.gate_status(few).first()["status"] == "insufficient-data" and {r["part"] for r in few.collect()} == {"data"}
    for name, value in (("LEAST_REAL", 1), ("LEAST_LONG", 1), ("LEAST_EDITS", 1), ("LEAST_FROZEN", 0.2), ("LEAST_EACH", 0)):
        monkeypatch.setattr(B, name, value)
    checks = {r["check_id"]: (r["passed"], r["actual"]) for r in B.gate(cases, told, results, errors, predicted).filter("part = 'quality'").collect()}
    assert checks["all-real-predictions-present"] == (False, 1) and checks["no-unexpected-predictions"] == (False, 1) and checks["monotonic-time-map"] == (True, 0)
    assert checks["anchor-max"] == (True, 50) and not checks["edit-f1"][0] and checks["edit-class:sourceOnly"] == (True, 1) and not checks["long-reference-mapping-coverage"][0]
    only = cases.filter("case_id = 'exact'").unionByName(spark.createDataFrame([("long", "real", "frozen-test", 500, 0, 3_000_000, 0, True)], CASE))
    fine = [only, *frames(spark, [], [("exact", 1000, 1000), ("long", 7, 7)], [("exact", "sourceOnly", 0, 4000, 5000, 4000, 4000)], ["exact", "long"], [r for r in map(tuple, spans.collect()) if r[0] == "exact"] + [("long", 0, "matched", 0, 3_000_000, 0, 3_000_000)])[1:]]
    results, errors = B.case_results(*fine)
    assert tuple(B.gate_status(B.gate(only, B.scenarios(*fine[:3]), results, errors, fine[3])).first()) == ("pass", [])
