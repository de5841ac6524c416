"""Small fixtures for scans, exports, time maps, alignment and streams."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import names as names_of
from tidemark.functions import rules
from tidemark.operators import alignment, intervals, lookup, matching, timemap
from tidemark.sources import comments
from tidemark.streaming import playback

XML = """<?xml version="1.0" encoding="UTF-8"?>
<i><chatid>1</chatid>
<d p="7.25,1,18,65280,1650000001,0,u1,11">one</d>
<d p="x,5,18">two &amp; more</d>
<d>three</d>
<d p="9.0004,4,30,255,1650000002,0,u2,12"> </d>
<d p="12,5,30,255,1650000003,0,u2,13"></d>
</i>"""


def test_xml_keeps_every_row_and_warns(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    rows = comments.read_comment_xml(spark, str(tmp_path / "a.xml")).orderBy("original_index").collect()
    assert [r["source_time_ms"] for r in rows] == [7250, 0, 0, 9000, 12000]
    assert [list(r["warnings"]) for r in rows] == [[], ["short_p", "bad_time"], ["missing_p", "short_p", "bad_time"], ["empty_text"], ["empty_text"]]
    assert rows[1]["text"] == "two & more" and rows[0]["mode"] == 1


def test_xml_round_trip(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    items = comments.read_comment_xml(spark, str(tmp_path / "a.xml")).withColumn("target", F.lit("t1")).withColumn("final_ms", F.col("source_time_ms") - 1)
    out = str(tmp_path / "out")
    comments.write_comment_xml(items, out)
    back = comments.read_comment_xml(spark, f"{out}/target=t1").orderBy("original_index").collect()
    assert [r["source_time_ms"] for r in back] == [0, 0, 7249, 8999, 11999]
    assert all(len(r["raw_p_fields"]) == 8 for r in back)
    read = comments.read_comment_xml(spark, f"{out}/target=t1")
    assert comments.round_trip_faults(items, read).count() == 0
    assert comments.round_trip_faults(items, read.filter("source_time_ms > 0")).count() == 2


def test_equal_files_are_read_once(spark, tmp_path):
    for name in ("a.xml", "b.xml"):
        (tmp_path / name).write_text(XML)
    (tmp_path / "c.xml").write_text(XML.replace("one", "other"))
    assert comments.read_comment_files(spark, str(tmp_path)).count() == 10
    with pytest.raises(ValueError, match="beyond"):
        comments.read_comment_files(spark, str(tmp_path), most_items=4)


def test_cut_points_and_anchors_of_texts(spark):
    df = spark.createDataFrame([("1:30，90\n2:00;x, 1:30,", "1:00 -> 2:00\nbad\n10 => 20\n# 1 -> 2\n1 -> 2 -> 3\n0:07，0:08\n0:07→0:08"), (None, None), ("", " \n")], "c string, a string")
    rows = df.select(comments.parse_cut_points(F.col("c")).alias("c"), comments.cut_point_faults(F.col("c")).alias("cf"), comments.parse_anchors(F.col("a")).alias("a"), comments.anchor_faults(F.col("a")).alias("af")).collect()
    assert list(rows[0]["c"]) == [90_000, 90_000, 120_000, 5_400_000] and list(rows[0]["cf"]) == ["x"]
    assert [tuple(x) for x in rows[0]["a"]] == [(7000, 8000, "manual-anchor-5"), (7000, 8000, "manual-anchor-6"), (60000, 120000, "manual-anchor-1")]
    assert [tuple(x)[:2] for x in rows[0]["af"]] == [(2, "parts"), (3, "time"), (4, "parts")]
    assert all(list(r[k]) == [] for r in rows[1:] for k in ("c", "cf", "a", "af"))


def test_times_of_rule_texts(spark):
    wanted = {
        "45": 2_700_000, "49.5": 2_970_000, "90:00": 5_400_000, "1:75": None, "1:60:00": None, "1:59:59.9994": 7_199_999, "45分钟": 2_700_000, "45 MIN": 2_700_000, "3m": 180_000, "1.5分": 90_000,
        "-1:00": None, "1:-2": None, "1::5": 3_605_000, ":30": 30_000, "1:2:3:4": None, "a:1": None, "45h": None, "": None, "\u3000 7 ": 420_000, "0x10:1": 961_000, "1e1:0": 600_000, "51:20.123": 3_080_123,
    }
    got = spark.createDataFrame([(t,) for t in wanted], "t string").select("t", rules.rule_time(F.col("t")).alias("ms"), rules.anchor_time(F.col("t")).alias("anchor")).collect()
    assert {r["t"]: r["ms"] for r in got} == wanted
    assert {r["t"]: r["anchor"] for r in got} == {t: ms if ":" in t else None for t, ms in wanted.items()}


def test_numbers_of_texts(spark):
    wanted = {"1": 1, " -7.9 ": -7, "1e3": 1000, "1d": None, "2f": None, "0x10": 16, "0b101": 5, "0o17": 15, "": None, "  ": None, "Infinity": None, "NaN": None, "1_0": None, "+.5": 0, "5.": 5, ".": None, "-0x10": None, "1e400": None, "2L": None}
    got = spark.createDataFrame([(t,) for t in wanted], "t string").select("t", rules.whole_number(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in got} == wanted
    got = spark.createDataFrame([(t,) for t in ("9", "1.5", "abc", "", "-1", None)], "t string").select(rules.minutes_input(F.col("t"))).collect()
    assert [r[0] for r in got] == [540_000, 90_000, None, None, None, None]


def test_durations_of_texts(spark):
    text = "S01E02 51:20.123\r\n\n第2季第13集：45分钟\nE7=49.5\n第3话 1:00:00\n10\nnothing\nx 0:00\nfinale, 3 min"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(rules.durations(F.col("t")).alias("d")).collect()
    assert [tuple(x)[0:1] + tuple(x)[2:] for x in got[0]["d"]] == [(1, 1, 2, 3_080_123), (2, 2, 13, 2_700_000), (3, None, 7, 2_970_000), (4, None, 3, 3_600_000), (5, None, 5, 600_000), (6, None, None, None), (7, None, None, None), (8, None, 8, 180_000)]
    assert got[1]["d"] == []


def test_time_map_projection(spark):
    spans = spark.createDataFrame(
        [("m", 0, "matched", 0, 1000, 0, 1000), ("m", 1, "targetOnly", 1000, 1000, 1000, 1500), ("m", 2, "matched", 1000, 2000, 1500, 2750), ("m", 3, "sourceOnly", 2000, 2400, 2750, 2750), ("m", 4, "ambiguous", 2400, 2400, 2750, 2900), ("m", 5, "matched", 2400, 4000, 2900, 4300)],
        timemap.SPAN_SCHEMA,
    )
    points = spark.createDataFrame([("m", t) for t in (-1, 0, 999, 1000, 1001, 1999, 2100, 2400, 2401, 4000)], "map_id string, t_ms bigint")
    got = {r["t_ms"]: (r["status"], r["target_ms"]) for r in timemap.project(points, spans, width=700).collect()}
    assert got == {
        -1: ("unmapped", None), 0: ("mapped", 0), 999: ("mapped", 999), 1000: ("mapped", 1500), 1001: ("mapped", 1501), 1999: ("mapped", 2749),
        2100: ("sourceOnly", None), 2400: ("ambiguous", None), 2401: ("mapped", 2901), 4000: ("unmapped", None),
    }
    assert timemap.validate(spans).count() == 0
    cut = timemap.split_at(spans, spark.createDataFrame([("m", 500), ("m", 1500)], "map_id string, at bigint"))
    assert cut.count() == 8 and timemap.validate(cut).count() == 0


def test_as_of_takes_the_row_at_the_same_time(spark):
    a = spark.createDataFrame([(1, 5), (1, 9), (2, 1)], "k int, t bigint")
    b = spark.createDataFrame([(1, 5, 50), (1, 7, 70)], "k int, t bigint, v int")
    got = sorted((r["k"], r["t"], r["last_v"]) for r in intervals.nearest_before(a, b, ["k"], "t", "v").collect())
    assert got == [(1, 5, 50), (1, 9, 70), (2, 1, None)]


def test_edit_alignment_finds_the_cut(spark):
    rng = random.Random(1)
    whole = [[rng.random() for _ in range(4)] for _ in range(60)]
    target = whole[:20] + whole[32:]
    rows = [(1, "source", k, v) for k, v in enumerate(whole)] + [(1, "target", k, v) for k, v in enumerate(target)]
    df = spark.createDataFrame(rows, "pair_id int, side string, position int, values array<double>")
    spans = alignment.edit_alignment(df, gap=0.2).orderBy("span_index").collect()
    assert [(s["kind"], s["source_start"], s["source_end"]) for s in spans] == [("matched", 0, 20), ("sourceOnly", 20, 32), ("matched", 32, 60)]


def test_assignment_is_best(spark):
    rng = random.Random(2)
    rows = [(g, s, t, round(rng.random(), 3)) for g in range(6) for s in range(4) for t in range(5)]
    df = spark.createDataFrame(rows, "group_id int, source int, target int, score double")
    got = alignment.assign(df).groupBy("group_id").agg(F.sum("score").alias("total")).collect()
    for r in got:
        w = {(s, t): v for g, s, t, v in rows if g == r["group_id"]}
        best = max(sum(w[s, t] for s, t in enumerate(p)) for p in itertools.permutations(range(5), 4))
        assert abs(best - r["total"]) < 1e-9


def test_best_path_prefers_order(spark):
    rows = [("c", 0, 0, 0.9, 100, 200), ("c", 0, 1, 0.8, 0, 50), ("c", 1, 0, 0.9, 60, 90), ("c", 2, 0, 0.5, 10, 20), ("c", 2, 1, 0.4, 95, 120)]
    df = spark.createDataFrame(rows, "chain_id string, part int, candidate int, score double, target_start bigint, target_end bigint")
    got = alignment.best_path(df).orderBy("part").collect()
    assert [r["candidate"] for r in got] == [1, 0, 1] and abs(got[0]["total"] - 2.1) < 1e-9


def test_boundary_offset(spark):
    rng = random.Random(3)
    x = [rng.random() for _ in range(200)]
    df = spark.createDataFrame([(1, x[10:150], x[3:143])], "key int, source array<double>, target array<double>")
    r = alignment.boundary_offset(df).first()
    assert r["lag"] == -7 and r["correlation"] > 0.99 and r["lead"] > 0.3


def test_increasing_path(spark):
    df = spark.createDataFrame([(1, s, t) for s, t in [(1, 5), (2, 1), (3, 2), (4, 9), (5, 3)]], "k int, s bigint, t bigint")
    assert [r["t"] for r in matching.increasing_path(df, "k", "s", "t").orderBy("step").collect()] == [1, 2, 3]


def test_coverage_stream(spark, tmp_path):
    src = spark.createDataFrame([(1, 0), (1, 1000), (1, 9000), (1, 9500), (2, 5)], "user_id bigint, t_ms bigint")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = playback.coverage_stream(stream).writeStream.format("memory").queryName("covered").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {r["user_id"]: (r["credited_ms"], r["sessions"]) for r in spark.table("covered").collect()}
    assert got[1] == (1500, 2) and got[2] == (0, 1)


def test_ordered_names(spark):
    names = ["03 - 第十二集.xml", "1.2 title.mp4", "12.mkv", "S01E02-E04.xml", "5-7.xml", "nothing here.xml", "7. 第二季第一百零三集 P2.xml"]
    rows = spark.createDataFrame(list(enumerate(names)), "k bigint, n string")
    got = [tuple(r["i"]) for r in rows.select("k", names_of.ordered_identity(F.col("n"), F.col("k")).alias("i")).orderBy("k").collect()]
    assert got == [
        (None, 12, 12, None, "episode", "moderate", 3, False),
        (None, 1, 1, 2, "episodePart", "strong", 2, False),
        (None, 12, 12, None, "episode", "moderate", 3, False),
        (1, 2, 4, None, "seasonEpisodeRange", "strong", 4, False),
        (None, 7, 7, None, "episode", "moderate", 5, False),
        (None, 6, 6, None, "importOrderFallback", "fallback", 6, True),
        (2, 103, 103, 2, "episodePart", "strong", 7, False),
    ]


def test_axis_and_blocks(spark):
    df = spark.createDataFrame([(0, 100), (0, 10_000_000), (50, 40)], "a bigint, b bigint")
    steps = [r[0] for r in df.select(lookup.axis_step(F.greatest(F.lit(1), F.col("b") - F.col("a")), F.lit(950))).collect()]
    assert steps == [10, 1_800_000, 1]


def test_first_of_rows_in_a_tie_does_not_depend_on_their_places(spark):
    from tidemark.operators import edits

    rows = [(1, 7, 2, 30.0), (1, 7, 2, 10.0), (1, 7, 2, 20.0), (1, 8, 1, 1.0)]
    for order in (rows, rows[::-1]):
        got = edits.first_by(spark.createDataFrame(order, "p long, o long, n int, q double").coalesce(1), ["p"], ["o", "n"]).collect()
        assert [tuple(r) for r in got] == [(1, 7, 2, 10.0)]


def test_union_length_is_dealt_by_its_rows(spark, monkeypatch):
    from tidemark.operators import merging

    rows = spark.createDataFrame([(k % 5, 10 * k, 10 * k + 60) for k in range(40)], "p long, s long, e long")
    monkeypatch.setattr(merging, "ROWS_EACH", 4)
    out = merging.union_length(rows, ["p"], "s", "e", "n", counted=True)
    assert "10), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert {(r["p"], r["n"]) for r in out.collect()} == {(k, 50 * 7 + 60) for k in range(5)}


def test_fingerprints_of_large_buckets_meet_in_blocks(spark, monkeypatch):
    from tidemark.operators import matching

    monkeypatch.setattr(matching, "BLOCK", 3)
    monkeypatch.setattr(matching, "SLAB", 2)
    monkeypatch.setattr(matching, "CANDIDATES", 2)
    monkeypatch.setattr(matching, "PAIRS_EACH", 10)
    made = [[0.01, 0.02, 0.03, 0.04, (k * 37 % 23) / 20] for k in range(20)] + [[0.5, 0.02, 0.03, 0.04, k / 9] for k in range(3)]
    odd = [None, [0.01, 0.02], [0.01, 0.02], [0.01, 0.02, 0.03, 0.04, None], [0.01, 0.02, 0.03, 0.04, float("nan")], [0.01, 0.02, 0.03, 0.04]]
    rows = spark.createDataFrame(list(enumerate(made + odd)), "id long, v array<float>")
    got = [tuple(r) for r in matching.fingerprint_pairs(rows, "id", "v", 0.125, 0.15).collect()]
    near = lambda x, y: (sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) / 5) ** 0.5
    want = {(a, b) for b, y in enumerate(made) for a, x in enumerate(made[:b]) if x[0] == y[0] and near(x, y) <= 0.15}
    assert len(got) == len(set(got)) and {(a, b) for a, b, _ in got} == want
    assert all(abs(d - near(made[a], made[b])) < 1e-5 for a, b, d in got)


def test_ranks_of_many_keys_and_of_few(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tidemark.operators import measures

    rng = random.Random(6)
    values = {k: [rng.choice([0.0, 1e9, rng.random(), rng.randrange(50)]) for _ in range(rng.choice([1, 3, 40, 400]))] for k in range(30)}
    rows = spark.createDataFrame([(k, float(v)) for k, x in values.items() for v in x], "k long, v double")
    places = {"p50": measures.upper_index(0.5, F.col("n")), "most": F.col("n") - 1}
    for sent in (measures.KEYS_SENT, 0):
        monkeypatch.setattr(measures, "KEYS_SENT", sent)
        monkeypatch.setattr(measures, "ROWS_EACH", 1_000)
        got = {tuple(r) for r in measures.values_at_ranks(rows, ["k"], "v", places).collect()}
        assert got == {(k, len(x), sorted(x)[-(-(len(x) - 1) // 2)], max(x)) for k, x in values.items()}
