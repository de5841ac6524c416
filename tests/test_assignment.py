"""Event matching and combinations of hypotheses against enumeration."""

import itertools
import random

import numpy as np
import pytest

from tidemark.operators import assignment as A

EVENT = "case_id int, kind string, index int, source_start bigint, source_end bigint, target_start bigint, target_end bigint"
HYPOTHESIS = "group_id int, id string, worth double, source string, target string, source_start bigint, source_end bigint, target_start bigint, target_end bigint, alternative string, source_order double, target_order double, blocked boolean"


@pytest.mark.parametrize("seed", range(12))
def test_cheapest_matching_against_enumeration(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 6, 2)
    cost = np.where(rng.random((n, m)) < 0.6, rng.integers(0, 30, (n, m)).astype(float), np.inf)
    best = (0, 0.0)
    for size in range(1, min(n, m) + 1):
        for rows in itertools.combinations(range(n), size):
            for columns in itertools.permutations(range(m), size):
                total = sum(cost[r, c] for r, c in zip(rows, columns, strict=True))
                if np.isfinite(total):
                    best = min(best, (-size, total))
    pairs = A.cheapest_matching(cost)
    assert len({r for r, _ in pairs}) == len({c for _, c in pairs}) == len(pairs)
    assert (-len(pairs), sum(cost[p] for p in pairs)) == best


def events(rng, case, n):
    out = []
    for k in range(n):
        s, t = rng.randrange(0, 4000, 50), rng.randrange(0, 4000, 50)
        kind = rng.choice(["sourceOnly", "targetOnly"])
        out.append((case, kind, k, s, s + (rng.randrange(50, 500, 50) if kind == "sourceOnly" else 0), t, t + (rng.randrange(50, 500, 50) if kind == "targetOnly" else 0)))
    return out


def errors(a, b):
    out = [abs(a[3] - b[3]), abs(a[5] - b[5])]
    out += [abs(a[4] - b[4])] if a[4] != a[3] or b[4] != b[3] else []
    return out + ([abs(a[6] - b[6])] if a[6] != a[5] or b[6] != b[5] else [])


def test_events_against_enumeration(spark):
    rng = random.Random(3)
    gold = [e for case in range(25) for e in events(rng, case, rng.randint(0, 5))]
    predicted = [e for case in range(25) for e in events(rng, case, rng.randint(0, 5))]
    # Chains in which the nearest pair must be given up for a second one.
    gold += [(99, "sourceOnly", 0, 0, 100, 0, 0), (99, "sourceOnly", 1, 600, 700, 0, 0)]
    predicted += [(99, "sourceOnly", 0, 550, 650, 0, 0), (99, "sourceOnly", 1, 1300, 1400, 0, 0)]
    g, p = spark.createDataFrame(gold, EVENT), spark.createDataFrame(predicted, EVENT)
    matches = A.match_events(g, p, ["case_id", "kind"], 800)
    got = {}
    for r in matches.collect():
        got.setdefault((r["case_id"], r["kind"]), []).append(r)
    counts = {(r["case_id"], r["kind"]): (r["tp"], r["fp"], r["fn"]) for r in A.event_counts(g, p, matches, ["case_id", "kind"]).collect()}
    for key in {(e[0], e[1]) for e in gold + predicted}:
        a, b = ([e for e in side if (e[0], e[1]) == key] for side in (gold, predicted))
        best = (0, 0)
        for size in range(1, min(len(a), len(b)) + 1):
            for rows in itertools.combinations(a, size):
                for columns in itertools.permutations(b, size):
                    met = [errors(x, y) for x, y in zip(rows, columns, strict=True)]
                    if all(max(e) <= 800 for e in met):
                        best = min(best, (-size, sum(16 * max(e) + sum(e) for e in met)))
        mine = got.get(key, [])
        within = [r for r in mine if r["within"]]
        assert (-len(within), sum(16 * r["worst_ms"] + r["sum_ms"] for r in within)) == best
        assert len(mine) == min(len(a), len(b)) and len({r["gold_index"] for r in mine}) == len(mine) == len({r["predicted_index"] for r in mine})
        for r in mine:
            e = errors(next(x for x in a if x[2] == r["gold_index"]), next(x for x in b if x[2] == r["predicted_index"]))
            assert (max(e), sum(e)) == (r["worst_ms"], r["sum_ms"])
        assert counts[key] == (-best[0], len(b) + best[0], len(a) + best[0])
    assert counts[99, "sourceOnly"] == (2, 0, 0)


def hypotheses(rng, group, n):
    out = []
    for k in range(n):
        s, t = rng.randrange(0, 3000, 100), rng.randrange(0, 3000, 100)
        order = lambda: rng.choice([None, 1.0, 2.0, 3.0])
        out.append((group, f"h{k}", round(rng.uniform(-0.1, 1), 3), rng.choice("ab"), rng.choice("xy"), s, s + rng.randrange(200, 1500, 50), t, t + rng.randrange(200, 1500, 50), rng.choice([None, None, "g1", "g2"]), order(), order(), rng.random() < 0.1))
    return out


def enumerated(rows, rules):
    rows = sorted((r for r in rows if not r[12]), key=lambda r: (-r[2], r[1]))

    def excluded(a, b):
        over = lambda i: min(a[i + 1], b[i + 1]) - max(a[i], b[i]) > rules.overlap_ms
        return (a[9] is not None and a[9] == b[9]) or (a[3] == b[3] and over(5)) or (a[4] == b[4] and over(7))

    def inverted(a, b):
        sign = lambda x: (x > 0) - (x < 0)
        one = a[3] == b[3] and None not in (a[11], b[11]) and sign(a[5] - b[5]) * sign(a[11] - b[11]) < 0
        return one or (a[4] == b[4] and None not in (a[10], b[10]) and sign(a[7] - b[7]) * sign(a[10] - b[10]) < 0)

    all_ = []
    for size in range(len(rows) + 1):
        for chosen in itertools.combinations(rows, size):
            score, fine = 0.0, True
            for k, x in enumerate(chosen):
                gain = x[2] - sum(inverted(x, y) for y in chosen[:k]) * rules.inversion
                fine &= gain > 0 and not any(excluded(x, y) for y in chosen[:k])
                score += gain
            if fine:
                all_.append((-round(score, 9), sorted(x[1] for x in chosen)))
    best = min(all_)
    others = [x for x in all_ if set(x[1]) - set(best[1])]
    return best, min(others) if others else None


def test_combinations_against_enumeration(spark):
    rng = random.Random(4)
    rows = [h for g in range(30) for h in hypotheses(rng, g, rng.randint(1, 9))]
    for rules in (A.ChoiceRules(), A.ChoiceRules(exact_up_to=1, beam=4096)):
        out = {}
        for r in A.choose(spark.createDataFrame(rows, HYPOTHESIS), rules=rules).collect():
            out.setdefault(r["group_id"], []).append(r)
        for g, mine in out.items():
            own = [r for r in rows if r[0] == g]
            best, second = enumerated(own, rules)
            assert sorted(r["id"] for r in mine if r["selected"]) == best[1] and abs(mine[0]["score"] + best[0]) < 1e-6
            assert sorted(r["id"] for r in mine if r["runner_up"]) == (second[1] if second else [])
            assert (mine[0]["runner_up_score"] is None) == (second is None) and (second is None or abs(mine[0]["runner_up_score"] + second[0]) < 1e-6)
            assert mine[0]["exact"] == (sum(not r[12] for r in own) <= rules.exact_up_to)
            for r in mine:
                blocked = next(x[12] for x in own if x[1] == r["id"])
                assert (r["reason"] is None) == r["selected"] and (r["reason"] == "blocked") == blocked
                assert bool(r["conflicts"]) == (r["reason"] in ("samePairAlternative", "sourceOverlap", "targetOverlap")) and set(r["conflicts"]) <= set(best[1])


def test_ambiguous_combinations(spark):
    near = [(1, "a", 0.80, "s", "t", 0, 1000, 0, 1000, None, None, None, False), (1, "b", 0.79, "s", "t", 0, 1000, 0, 1000, None, None, None, False)]
    clear = [(2, *near[0][1:]), (2, "b", 0.30, *near[1][3:])]
    alone = [(3, *near[0][1:]), (4, "z", -0.5, *near[0][3:])]
    out = {(r["group_id"], r["id"]): r for r in A.choose(spark.createDataFrame(near + clear + alone, HYPOTHESIS)).collect()}
    assert out[1, "a"]["ambiguous"] and out[1, "b"]["reason"] == "sourceOverlap" and list(out[1, "b"]["conflicts"]) == ["a"]
    assert not out[2, "a"]["ambiguous"] and out[2, "a"]["margin"] > 0.6
    assert out[3, "a"]["margin"] == 1 and out[3, "a"]["runner_up_score"] is None and not out[3, "a"]["ambiguous"]
    assert out[4, "z"]["margin"] is None and out[4, "z"]["score"] == 0 and out[4, "z"]["reason"] == "notInBestCombination"


def test_matchings_of_one_shape_are_those_found_one_by_one():
    rng = np.random.default_rng(5)
    for n, m in ((2, 2), (3, 2), (4, 3), (6, 4)):
        cost = np.where(rng.random((200, n, m)) < 0.7, rng.integers(0, 40, (200, n, m)), A.FAR)
        column, one = A._unique_matchings(cost)
        assert one.any() and not one.all()
        for k in np.flatnonzero(one):
            assert [(i, j) for i, j in enumerate(column[k].tolist()) if j >= 0] == A.cheapest_matching(np.where(cost[k] < A.FAR, cost[k], np.inf))


def test_large_cases_are_matched_stretch_by_stretch(spark, monkeypatch):
    rng = random.Random(11)
    gold, predicted = ([(case, "sourceOnly", k, s, s + 50, s % 700, s % 700) for case in range(4) for k, s in enumerate(rng.sample(range(0, 60_000, 50), 60))] for _ in range(2))
    g, p = spark.createDataFrame(gold, EVENT), spark.createDataFrame(predicted, EVENT)
    whole = sorted(map(tuple, A.match_events(g, p, ["case_id", "kind"], 300).collect()))
    assert {r[-1] for r in whole} == {True, False}
    monkeypatch.setattr(A, "ROWS_TOGETHER", 10)
    monkeypatch.setattr(A, "ROWS_HELD", 20)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, A.match_events(g, p, ["case_id", "kind"], 300).collect())) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_relations_of_hypotheses_pair_by_pair_and_by_tables():
    rng = random.Random(8)
    names = [f.split()[0] for f in HYPOTHESIS.split(", ")]
    for n in (1, 5, 20):
        rows = {c: list(x) for c, x in zip(names, zip(*hypotheses(rng, 0, n), strict=True), strict=True)}
        plain, broad = A._Choices._plain(rows, 250), A._Choices._broad(rows, 250)
        for a, b in zip(plain, broad, strict=True):
            assert a == [x & ~(1 << k) for k, x in enumerate(b)]
