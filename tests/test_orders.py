"""Positions and sums along an order, families by stars, and rules at their edges."""

import random

from pyspark.sql import functions as F

from tidemark.operators import intervals, measures, merging, ordering, review, timemap


def test_positions_and_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b"]) if k % 3 else "a", rng.randrange(50), k, rng.randrange(9)) for k in range(900)]
    df = spark.createDataFrame(rows, "k string, v int, id int, pos int").repartition(6)
    got = {r["id"]: r["_p"] for r in ordering.numbered(df, ["k"], F.desc("v"), "id", pos="_p").collect()}
    sums = {r["id"]: r["total"] for r in ordering.running(df, ["k"], F.desc("v"), "id", value="pos", total="total").collect()}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in own] == list(range(len(own)))
        assert [sums[r[2]] for r in own] == [sum(x[3] for x in own[: k + 1]) for k in range(len(own))]
    assert [r["pos"] for r in ordering.numbered(df.select("id"), [], "id").orderBy("id").collect()] == list(range(900))
    assert ordering.numbered(df.limit(0), ["k"], "v", pos="_p").collect() == []


def test_ranks_beside_an_outlier(spark):
    values = [*range(5000), 10**12]
    df = spark.createDataFrame([("k", float(v)) for v in values], "k string, v double").repartition(4)
    n = F.col("n")
    got = measures.values_at_ranks(df, ["k"], "v", {"p50": measures.upper_index(0.5, n), "p99": measures.upper_index(0.99, n), "most": measures.upper_index(1.0, n)}).first()
    assert (got["n"], got["p50"], got["p99"], got["most"]) == (5001, 2500.0, 4950.0, 1e12)


def test_families_by_stars(spark):
    rng = random.Random(2)
    rows = [(k, k + 1) for k in range(0, 400) if k % 50] + [(1000, 1000)] + [(5000 + rng.randrange(60), 5000 + rng.randrange(60)) for _ in range(80)]
    got = {r["id"]: r["family"] for r in review.whole_families(spark.createDataFrame(rows, "a int, b int").repartition(5)).collect()}
    want = {r["id"]: r["family"] for r in review.families(spark.createDataFrame(rows, "a bigint, b bigint")).collect()}
    assert got == want and got[1000] == 1000 and got[49] == 1


def test_worst_window_of_few_rows(spark):
    rows = [(1, 0, 5)] + [(2, 0, 5), (2, 900, 50), (2, 1000, 7)] + [(3, 100 * k, k) for k in range(6)] + [(4, 0, 1), (4, 10, 3), (4, 10, 9), (4, 500_000, 2)]
    got = {r["k"]: r["w"] for r in measures.worst_window_p95(spark.createDataFrame(rows, "k int, t bigint, v bigint"), ["k"], "t", "v", 150, 3, "w").collect()}

    def plain(own):
        own, worst = sorted(own), []
        for start in {p for t, _ in own for p in (t - 150, t + 1)}:
            active = [i for i, (t, _) in enumerate(own) if start <= t <= start + 150]
            if not active:
                continue
            if len(active) >= 3:
                worst.append(sorted(own[i][1] for i in active)[-(-(len(active) - 1) * 95 // 100)])
                continue
            i = active[0]
            near = [(abs(own[i][0] - own[j][0]), -own[j][1]) for j in (i - 1, i + 1) if 0 <= j < len(own)]
            worst.append(max(own[i][1], -min(near)[1]) if near else own[i][1])
        return max(worst)

    assert got == {k: plain([r[1:] for r in rows if r[0] == k]) for k in (1, 2, 3, 4)}


def test_broken_measures_block(spark):
    good = dict(probability=0.999, coverage=0.95, unique_coverage=0.9, p50=10.0, p95=50.0, p99=90.0, boundary=20.0, margin=0.5, anchors=40, regions=3)
    cases = {"fine": {}, "negative": {"p50": -1.0}, "fraction": {"boundary": 1.5}, "nan": {"coverage": float("nan")}, "infinite": {"p99": float("inf")}, "share": {"probability": 1.01}, "order": {"p50": 60.0}, "regions": {"regions": 4}, "anchors": {"anchors": -1}, "missing": {"p99": None}}
    rows = [(name, *{**good, **change}.values()) for name, change in cases.items()]
    df = spark.createDataFrame(rows, "name string, probability double, coverage double, unique_coverage double, p50 double, p95 double, p99 double, boundary double, margin double, anchors int, regions int")
    flags = {c: F.lit(True) for c in ("measured", "audio", "visual", "manual")}
    got = {r["name"]: r["level"] for r in df.select("name", measures.quality_level({**{c: F.col(c) for c in good}, **flags}).alias("level")).collect()}
    assert got == {name: "verified" if name == "fine" else "review" if name == "missing" else "blocked" for name in cases}


def test_legacy_issues(spark):
    maps = spark.createDataFrame([("ok", 0, 100, 5), ("neg", 0, 100, 5), ("out", 0, 100, 5), ("bad", 100, 100, 5), ("none", 0, 10, 0)], "map_id string, source_start bigint, source_end bigint, target_start bigint")
    rules = [("ok", 50, 10, 0), ("ok", 20, 0, 1), ("neg", 10, 0, 0), ("neg", 60, 0, 1), ("neg", 30, 5, 2), ("neg", 30, -1, 3), ("neg", 30, -2, 4), ("out", 101, 1, 0), ("out", 10, 0, 1), ("out", None, 1, 2), ("bad", 100, 1, 0)]
    df = spark.createDataFrame(rules, "map_id string, at bigint, gap bigint, rule int")
    got = {r["map_id"]: (r["status"], [tuple(i) for i in r["issues"]]) for r in timemap.legacy_migration(maps, df).collect()}
    assert got == {"ok": ("migrated", [("zeroGapIgnored", 1)]), "neg": ("blocked", [("zeroGapIgnored", 0), ("negativeGap", 3)]), "out": ("blocked", [("invalidRule", 2), ("invalidRule", 0)]), "bad": ("blocked", [("invalidInput", None)]), "none": ("migrated", [])}


def test_gaps_of_whole_ranges(spark):
    rows = spark.createDataFrame([("a", 10, 20), ("a", 15, 30), ("a", 40, 50), ("b", -5, 3), ("b", 90, 200)], "k string, s bigint, e bigint")
    whole = spark.createDataFrame([("a", 0, 60), ("b", 0, 100), ("c", 0, 9), ("d", 5, 5)], "k string, begin bigint, finish bigint")
    got = sorted(tuple(r) for r in intervals.interval_gaps(rows, ["k"], "s", "e", whole).collect())
    assert got == [("a", 0, 10), ("a", 30, 40), ("a", 50, 60), ("b", 3, 90), ("c", 0, 9)]
    bands = intervals.coverage_bands(spark.createDataFrame([("a", 0, 10), ("a", 10, 20), ("a", 5, 20)], "k string, s bigint, e bigint"), ["k"], "s", "e")
    assert sorted(tuple(r) for r in bands.collect()) == [("a", 0, 5, 1), ("a", 5, 20, 2)]


def test_clusters_keep_the_original_order(spark):
    hits = spark.createDataFrame([("a", 5, 2, "later", 1, ["y"]), ("a", 5, 1, "first", 3, ["x", "y"]), ("a", 9, 0, "last", 9, ["z"]), ("a", 200, 3, "alone", 1, ["x"])], "k string, t bigint, i int, text string, w int, l array<string>")
    rows = merging.cluster_details(hits, ["k"], "t", "i", "text", "w", "l", 100, 2, 2)
    assert [tuple(r) for r in rows.collect()] == [("a", 0, 3, 13, 5, 9, 5, "high", "x|y|z", "first|later")]
    marks = spark.createDataFrame([("a", 20_005)], "k string, m bigint")
    assert [r["applied"] for r in merging.cluster_applied(rows, marks, ["k"], "middle_ms", "m", 20_000).collect()] == [True]
    assert [r["applied"] for r in merging.cluster_applied(rows, marks, ["k"], "middle_ms", "m", 19_999).collect()] == [False]
