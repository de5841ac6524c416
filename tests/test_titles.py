"""Hint rules and clusters, urgency of reviews, titles, episodes and links."""

from pyspark.sql import functions as F

from tidemark.functions import titles as T
from tidemark.operators import hints, review


def test_rules_and_clusters(spark):
    rules = hints.keyword_rules("cut，Gone cut; a.b|(x)")
    assert [r.label for r in rules] == ["cut", "Gone", "a.b", "(x)"] and rules[0].weight == 2
    assert hints.search_plan("60", "2") == (60_000, 2, ()) and hints.search_plan(" 0.5 ", "1.5") == (500, None, ("hits",)) and hints.search_plan("x", "") == (None, None, ("window", "hits"))
    texts = ["这里删了吗", "被剪掉了", "nothing", "跳了一段，没了", "和谐", "CUT here", "axb", "a.b (X)"]
    items = spark.createDataFrame([("f", k, 1000 * k, t) for k, t in enumerate(texts)] + [("g", k, 500, "删了") for k in range(3)], "asset_id string, original_index int, at_ms bigint, text string")
    rows = hints.suspected_cuts(items, window_ms=10_000).collect()
    assert [(r["asset_id"], r["hits"], r["score"], r["keywords"], r["level"]) for r in rows] == [("f", 4, 13, "删了|剪了|跳了|没了|和谐", "high"), ("g", 3, 9, "删了", "medium")]
    assert rows[0]["samples"] == "这里删了吗|被剪掉了|跳了一段，没了" and rows[0]["middle_ms"] == 3000
    own = hints.suspected_cuts(items, rules, 10_000).collect()
    assert [(r["asset_id"], r["hits"], r["score"], r["keywords"]) for r in own] == [("f", 2, 6, "cut|a.b|(x)")]
    assert hints.suspected_cuts(items, (), 10_000).collect() == []


def test_urgency_of_reviews(spark):
    schema = "subject string, at int, record_id string, decision string, precision string, tolerance_ms bigint, source_start bigint, source_end bigint, target_start bigint, target_end bigint, difference_risk double, ambiguous double, visual_ambiguous double, margin double, model_risk double"
    rows = [("a", 1, "a1", "matched", "rough", 0, 0, 10, 0, 10, None, None, None, None, None), ("a", 2, "a2", "ambiguous", "rough", 500, 0, 5000, 0, 10, 0.5, 2.0, -1.0, 0.25, 0.7), ("b", 1, "b1", "unresolved", "playbackChecked", None, 0, 1, 0, 1, float("nan"), None, None, None, None), ("c", 1, "c1", "matched", "frameAccurate", None, 0, 1, 0, 1, 1.0, 1.0, 1.0, 0.0, 1.0), ("d", 1, "d1", "matched", "frameAccurate", None, 0, 1, 0, 1, None, None, None, None, None)]
    states = spark.createDataFrame([("a2", "conflict"), ("c1", "gold")], "record_id string, state string")
    got = {r["record_id"]: tuple(r)[1:] for r in review.active_review(spark.createDataFrame(rows, schema), states, ["subject"], ["at"]).collect()}
    assert got == {"a2": (100 + 55 + 35 + 22 + 4 + 15 + 20 + 0 + 9 + 21, "critical", 1, True, 4990), "b1": (38.0, "normal", 0, False, 0), "c1": (0.0, "gold", 0, False, 0), "d1": (0.0, "normal", 0, False, 0)}


def test_titles(spark):
    names = {"Ｓｈｏｗ:A?  B.mkv": "show a b", "a.b.c": "a.b", "x.": "x.", "  ": "", "Tab\there": "tab here", None: None}
    got = spark.createDataFrame([(n,) for n in names], "t string").select("t", T.normalized_title(F.col("t")).alias("k"), T.library_title(F.col("t")).alias("l")).collect()
    assert {r["t"]: r["k"] for r in got} == names
    assert {r["t"]: r["l"] for r in got}["Ｓｈｏｗ:A?  B.mkv"] == "showabmkv"
    keys = spark.createDataFrame([("Show", 2020, "tv", 1, 3), ("Show", 2020, "tv", 2, 3), ("Film.mkv", 1999, "movie", 1, None), ("Show", 2020, "tv", 1, None), ("Show", 1800, "tv", 1, 1), (" ", 2020, "tv", 1, 1), ("Show", 2020, "tv", 0, 1)], "t string, y int, k string, s int, e int")
    assert [r[0] for r in keys.select(T.resource_key(*map(F.col, "tykse"))).collect()] == ["show|2020|tv|3", "show|2020|tv|s2|3", "film|1999|movie|all", None, None, None, None]
    import hashlib

    assert keys.select(T.work_key(F.col("t"), F.col("k"), F.col("y"))).first()[0] == "title-" + hashlib.sha256(b"tv:show:2020").hexdigest()[:48]


def test_episodes_and_links(spark):
    wanted = {"Show.S02E07.mkv": (2, 7), "xS02E07": (None, None), "S1 - e12": (1, 12), "第 3 季 第4集": (3, 4), "S05 special": (5, None), "第12话": (None, 12), "plain": (None, None), "S2E12345": (None, None)}
    got = spark.createDataFrame([(n,) for n in wanted], "n string").select("n", T.library_episode(F.col("n")).alias("e")).collect()
    assert {r["n"]: tuple(r["e"]) for r in got} == wanted
    sha, base, v2 = "a" * 40, "ABCDEFGH234567ABCDEFGH234567ABCD", "1220" + "0f" * 32
    links = {sha: f"magnet:?xt=urn:btih:{sha}", f" {base} ": f"magnet:?xt=urn:btih:{base}", f"MAGNET:?dn=x&xt=urn:btih:{sha}&tr=y": f"magnet:?dn=x&xt=urn:btih:{sha}&tr=y", f"magnet:?xt=urn:btmh:{v2}": f"magnet:?xt=urn:btmh:{v2}", "12345": None, f"http://a/?xt=urn:btih:{sha}": None, "magnet:?xt=urn:btih:abc": None, f"magnet:?xt=urn:btih:{sha}" + "&tr=" + "x" * 17_000: None}
    got = spark.createDataFrame([(n,) for n in links], "n string").select("n", T.magnet(F.col("n")).alias("m")).collect()
    assert {r["n"]: r["m"] for r in got} == links
