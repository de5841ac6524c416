"""Edit alignment against a plain three-state table, planted cuts, and the way back."""

import random

import numpy as np
import pytest

from tidemark.operators import editpath as E

FAR = 10**15
SCHEMA = "pair_id int, side string, at_ms bigint, values array<double>, scale double, offset_ms double"


def plain(at, a, bt, b, scale, offset, rules):
    """The least total over the whole table, cell by cell."""
    near = E.costs_of(a, b)
    n, m = len(a), len(b)
    t = [[[FAR] * 3 for _ in range(m + 1)] for _ in range(n + 1)]
    t[0][0][0] = 0
    for j in range(1, m + 1):
        if rules.whole:
            t[0][j][2] = rules.open + rules.extend * (j - 1)
        else:
            t[0][j][0] = 0
    for i in range(1, n + 1):
        t[i][0][1] = rules.open + rules.extend * (i - 1)
        for j in range(1, m + 1):
            if abs(bt[j - 1] - scale * at[i - 1] - offset) > rules.band_ms:
                continue
            t[i][j][0] = min(t[i - 1][j - 1]) + int(near[i - 1, j - 1])
            t[i][j][1] = min(t[i - 1][j][0] + rules.open, t[i - 1][j][1] + rules.extend, t[i - 1][j][2] + rules.open)
            t[i][j][2] = min(t[i][j - 1][0] + rules.open, t[i][j - 1][1] + rules.open, t[i][j - 1][2] + rules.extend)
    best = min(min(t[n][j]) for j in ([m] if rules.whole else range(m + 1)))
    return best if best < FAR else None


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("band", [150, 400, 5000])
def test_totals_against_a_plain_table(whole, band):
    rng = np.random.default_rng(band)
    for n, m in [(1, 1), (1, 6), (7, 2), (9, 9), (14, 10), (5, 16)]:
        a, b = rng.normal(size=(n, 3)), rng.normal(size=(m, 3))
        a[n // 2] = 0
        at, bt = 100 * np.arange(n), np.cumsum(rng.integers(50, 150, m))
        rules = E.EditRules(band_ms=band, whole=whole)
        for scale, offset in [(1.0, 0.0), (1.1, -130.0)]:
            total, steps, fault = E.align(at, a, bt, b, scale, offset, rules)
            want = plain(at, a, bt, b, scale, offset, rules)
            assert total == want and (fault == "band") == (want is None)
            if total is None:
                continue
            assert steps[0][1] == 0 and steps[-1][2] == 100 * n if n > 1 else True
            for x, y in zip(steps, steps[1:]):
                assert x[2] == y[1] and x[4] == y[3]
            if whole:
                paid = sum(x[5] for x in steps if x[0] in ("sourceOnly", "targetOnly"))
                opened = sum(x[0] != y[0] for x, y in zip([("none",), *steps], steps) if y[0] in ("sourceOnly", "targetOnly"))
                near = E.costs_of(a, b)
                matched = sum(int(near[list(at).index(x[1]), list(bt).index(x[3])]) for x in steps if x[0] in ("matched", "ambiguous"))
                assert paid + opened * (rules.open - rules.extend) + matched == total


def frames(pair, source, target, hop=100, offset=0.0):
    return [(pair, s, k * hop, v, 1.0, offset) for s, side in (("source", source), ("target", target)) for k, v in enumerate(side)]


def test_planted_cuts(spark):
    rng = random.Random(1)
    whole = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(90)]
    more = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(10)]
    rows = frames(1, whole, whole[:30] + whole[42:]) + frames(2, whole[:30] + whole[42:], whole) + frames(3, whole, whole[:40] + more + whole[50:]) + frames(4, whole, whole)
    rows += frames(5, whole, []) + frames(6, whole[:3], whole[:3], offset=1e6)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    spans = {}
    for r in E.edit_spans(df, rules=E.EditRules(band_ms=3000)).orderBy("pair_id", "span_index").collect():
        spans.setdefault(r["pair_id"], []).append(tuple(r)[2:7])
    assert spans[1] == [("matched", 0, 3000, 0, 3000), ("sourceOnly", 3000, 4200, 3000, 3000), ("matched", 4200, 9000, 3000, 7800)]
    assert spans[2] == [("matched", 0, 3000, 0, 3000), ("targetOnly", 3000, 3000, 3000, 4200), ("matched", 3000, 7800, 4200, 9000)]
    assert [x[0] for x in spans[3]] == ["matched", "ambiguous", "matched"] and spans[3][1][1:3] == (4000, 5000)
    assert spans[4] == [("matched", 0, 9000, 0, 9000)] and set(spans) == {1, 2, 3, 4}
    faults = {r["pair_id"]: r["fault"] for r in E.edit_steps(df, rules=E.EditRules(most_cells=500)).select("pair_id", "fault").distinct().collect()}
    assert faults == {1: "cells", 2: "cells", 3: "cells", 4: "cells", 5: "empty", 6: "band"}


def test_way_back_confirms_or_demotes(spark):
    rng = random.Random(2)
    whole = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(60)]
    df = spark.createDataFrame(frames(1, whole, whole[:20] + whole[30:]) + frames(2, whole, whole), SCHEMA)
    out = E.two_way_spans(df, rules=E.EditRules(band_ms=3000)).orderBy("pair_id", "span_index").collect()
    assert [(r["pair_id"], r["kind"], r["demoted"]) for r in out] == [(1, "matched", False), (1, "sourceOnly", False), (1, "matched", False), (2, "matched", False)]
    # Whole alignments are the same both ways; from end to inner part they are not: the target's extra frames go
    # unpaid one way and must be paid for the other.
    b = whole[:20] + [[rng.gauss(0, 1) for _ in range(8)] for _ in range(3)] + whole[20:]
    half = E.two_way_spans(spark.createDataFrame(frames(3, whole, b), SCHEMA), rules=E.EditRules(band_ms=3000)).collect()
    assert {r["kind"] for r in half} == {"matched", "targetOnly"} and not any(r["demoted"] for r in half)


def test_demotion_rules(spark, monkeypatch):
    """Of one-sided spans without a counterpart half as long on the way back."""
    there = spark.createDataFrame([(1, 0, "matched", 0, 500, 0, 500, 5), (1, 1, "sourceOnly", 500, 700, 500, 500, 2), (1, 2, "matched", 700, 900, 500, 700, 2), (1, 3, "targetOnly", 900, 900, 700, 1000, 3), (1, 4, "sourceOnly", 900, 1300, 1000, 1000, 4)], "pair_id int, span_index bigint, kind string, source_start bigint, source_end bigint, target_start bigint, target_end bigint, steps bigint")
    back = [(1, 0, "matched", 0, 500, 0, 500, 5), (1, 1, "targetOnly", 500, 500, 520, 620, 1), (1, 2, "ambiguous", 850, 1000, 900, 900, 1), (1, 3, "targetOnly", 1000, 1000, 900, 1090, 2), (1, 4, "matched", 1000, 2000, 1090, 2000, 9)]

    def result(extra):
        made = iter([there, spark.createDataFrame(back + extra, there.schema)])
        monkeypatch.setattr(E, "edit_spans", lambda *a: next(made))
        df = spark.createDataFrame(frames(1, [[1.0]], [[1.0]]), SCHEMA)
        return [(r["kind"], r["demoted"]) for r in E.two_way_spans(df).orderBy("span_index").collect()]

    assert result([]) == [("matched", False), ("sourceOnly", False), ("matched", False), ("targetOnly", False), ("ambiguous", True)]
    unsure = [(1, 5, "ambiguous", 2000, 3000, 2000, 3000, 9)]
    assert [x[1] for x in result(unsure)] == [False] * 5


def test_opposite_gaps_collapse(spark):
    kinds = ["matched", "sourceOnly", "targetOnly", "sourceOnly", "matched", "sourceOnly", "sourceOnly", "ambiguous", "targetOnly"]
    rows, s, t = [], 0, 0
    for k, kind in enumerate(kinds):
        ds, dt = (0 if kind == "targetOnly" else 10), (0 if kind == "sourceOnly" else 10)
        rows.append((1, k, kind, s, s + ds, t, t + dt, 60))
        s, t = s + ds, t + dt
    df = spark.createDataFrame(rows, "pair_id int, step bigint, kind string, source_start bigint, source_end bigint, target_start bigint, target_end bigint, cost bigint")
    out = E.collapse_gaps(df).orderBy("step").collect()
    assert [r["kind"] for r in out] == ["matched", "ambiguous", "matched", "sourceOnly", "sourceOnly", "ambiguous", "targetOnly"]
    assert tuple(out[1])[2:] == ("ambiguous", 10, 30, 10, 20, 180)
    assert [r["kind"] for r in E.merge_steps(E.collapse_gaps(df)).orderBy("span_index").collect()] == ["matched", "ambiguous", "matched", "sourceOnly", "ambiguous", "targetOnly"]
