"""Accepting, revoking and reconciling matches, and their evidence in moved ranges."""

from tidemark.operators import candidates as C

CANDIDATE = "candidate_id string, source_media string, target_media string, source_start bigint, source_end bigint, target_start bigint, target_end bigint, state string, map_id string, blocked boolean"
SEGMENT = "segment_id string, kind string, asset_id string, source_media string, target_media string, map_id string, source_start bigint, source_end bigint, target_start bigint"
MAP = "map_id string, candidate_id string, state string, revision int, level string"


def world(spark):
    one = lambda name, **change: tuple({**dict(candidate_id=name, source_media="s", target_media="t", source_start=0, source_end=100, target_start=0, target_end=100, state="pending", map_id=None, blocked=False), **change}.values())
    candidates = [
        one("new"), one("again", state="accepted", map_id="again:confirmed:2", source_start=200, source_end=300), one("lost", state="accepted", map_id="gone"), one("no", state="rejected"), one("media", target_media="x"), one("range", source_end=0), one("stopped", blocked=True), one("mapped"),
        one("over", source_start=250, source_end=280), one("twin-a", source_start=400, source_end=500), one("twin-b", source_start=450, source_end=600), one("free", source_start=450, source_end=600, target_media="t2"), one("two", source_start=700, source_end=800), one("clash", source_start=900, source_end=950),
    ]
    segments = [("again:segment:a", "content", "a", "s", "t", "again:confirmed:2", 200, 300, 0), ("skip", "ignored", "a", "s", None, None, 150, 190, None), ("clash:segment:a", "content", "a", "s", "t", "other", 900, 950, 0)]
    maps = [("again:confirmed:2", "again", "confirmed", 2, "review"), ("m", "mapped", "candidate", 1, "blocked"), ("again:confirmed:1", "again", "confirmed", 1, "review"), ("new:old", "new", "superseded", 7, "review")]
    tables = [(candidates, CANDIDATE), (segments, SEGMENT), (maps, MAP), ([("a", "s"), ("b", "s"), ("c", "other")], "asset_id string, source_media string"), ([("a",), ("b",), ("c",), ("d",)], "asset_id string"), ([("s", C.SOURCE_ROLE), ("t", C.TARGET_ROLE), ("t2", C.TARGET_ROLE), ("x", "other")], "media_id string, role string")]
    return [spark.createDataFrame(rows, schema) for rows, schema in tables]


def test_acceptances(spark):
    candidates, segments, maps, bindings, assets, media = world(spark)
    names = [r["candidate_id"] for r in candidates.collect()]
    asked = [(n, " a ") for n in names] + [("new", "b"), ("new", "a"), ("two", "b"), ("two", "c"), ("nobody", "a"), ("free", "b"), ("again", "b")]
    out = C.acceptances(spark.createDataFrame(asked, "candidate_id string, asset_id string"), candidates, segments, maps, bindings, assets, media)
    got = {(r["candidate_id"], r["asset_id"]): (r["reason"], r["map_id"], r["new"]) for r in out.collect()}
    assert got["new", "a"] == got["new", "b"] == (None, "new:confirmed:1", True)
    assert got["again", "a"] == (None, "again:confirmed:2", False) and got["again", "b"] == (None, "again:confirmed:2", True)
    reasons = {k[0]: v[0] for k, v in got.items()}
    assert reasons == {"new": None, "again": None, "lost": "noMap", "no": "rejected", "media": "media", "range": "range", "stopped": "blocked", "mapped": "blocked", "over": "overlap", "twin-a": None, "twin-b": "overlap", "free": None, "two": "otherSource", "clash": "taken", "nobody": "unknown"}
    assert got["two", "b"] == ("otherSource", None, False)
    added = {tuple(r) for r in C.accepted_segments(out, candidates).collect()}
    assert ("new:segment:b", "content", "b", "s", "t", "new:confirmed:1", 0, 100, 0) in added and len(added) == 6
    more = C.acceptances(spark.createDataFrame([("new", "d"), ("twin-a", "zz")], "candidate_id string, asset_id string"), candidates, segments, maps, bindings, assets, media)
    assert {r["candidate_id"]: r["reason"] for r in more.collect()} == {"new": "notBound", "twin-a": "noAsset"}


def test_revocations(spark):
    one = lambda name, state, map_: (name, "s", "t", 0, 1, 0, 1, state, map_, False)
    candidates = spark.createDataFrame([one("fine", "accepted", "m1"), one("pending", "pending", None), one("foreign", "accepted", "m2"), one("shared", "accepted", "m3"), one("partner", "accepted", "m3"), one("torn", "accepted", "m4"), one("draft", "accepted", "m5")], CANDIDATE)
    maps = spark.createDataFrame([("m1", "fine", "confirmed", 1, ""), ("m2", "x", "confirmed", 1, ""), ("m3", "shared", "confirmed", 1, ""), ("m4", "torn", "confirmed", 1, ""), ("m5", "draft", "candidate", 1, "")], MAP)
    segments = spark.createDataFrame([("fine:segment:a", "content", "a", "s", "t", "m1", 0, 1, 0), ("orphan", "content", "b", "s", "t", "m1", 0, 1, 0), ("else", "content", "b", "s", "t", None, 0, 1, 0)], SEGMENT)
    applied = spark.createDataFrame([("fine", "fine:segment:a"), ("torn", "missing")], "candidate_id string, segment_id string")
    out = C.revocations(candidates.select("candidate_id").union(spark.createDataFrame([("none",)], "x string")), candidates, segments, maps, applied)
    assert {r["candidate_id"]: r["reason"] for r in out.collect()} == {"fine": None, "pending": "notAccepted", "foreign": "map", "shared": "shared", "partner": "map", "torn": "segment", "draft": "map", "none": "unknown"}
    assert [r["segment_id"] for r in C.without_revoked(segments, out).collect()] == ["else"]


def test_reconciled(spark):
    one = lambda name, state, map_="m", source="s", blocked=False: (name, source, "t", 0, 1, 0, 1, state, map_, blocked)
    candidates = spark.createDataFrame([one("kept", "accepted"), one("cut", "accepted"), one("bad", "accepted", blocked=True), one("no", "rejected"), one("gone", "pending", source="nowhere"), one("bare", "pending", source="s2"), one("fresh", "blocked", None)], CANDIDATE)
    segments = spark.createDataFrame([("kept:segment:a", "content", "a", "s", "t", "m", 0, 1, 0), ("cut:segment:a", "content", "a", "s", "t", "other", 0, 1, 0), ("bad:segment:b", "content", "b", "s", "t", "m", 0, 1, 0), ("no:segment:a", "content", "a", "s", "t", "m", 0, 1, 0)], SEGMENT)
    bindings = spark.createDataFrame([("a", "s"), ("b", "s2"), ("c", "s2")], "asset_id string, source_media string")
    assets = spark.createDataFrame([("a",)], "asset_id string")
    media = spark.createDataFrame([("s", "r"), ("s2", "r"), ("t", "r")], "media_id string, role string")
    applied = spark.createDataFrame([("kept", "kept:segment:a"), ("kept", "cut:segment:a"), ("cut", "cut:segment:a"), ("bad", "bad:segment:b"), ("no", "no:segment:a")], "candidate_id string, segment_id string")
    out, left = C.reconciled(candidates, segments, bindings, assets, media, applied)
    assert {r["candidate_id"]: (r["state"], r["map_id"]) for r in out.collect()} == {"kept": ("accepted", "m"), "cut": ("pending", None), "bad": ("blocked", None), "no": ("rejected", None), "bare": ("blocked", None), "fresh": ("pending", None)}
    assert [tuple(r) for r in left.collect()] == [("kept", "kept:segment:a")]


def test_moved_and_clipped_evidence(spark):
    anchors = spark.createDataFrame([("c", 0, 10), ("c", 50, 60), ("c", 99, 200), ("d", 5, 5)], "candidate_id string, source_ms bigint, target_ms bigint")
    samples = spark.createDataFrame([("c", "source", 0, 40, 7, 7), ("c", "target", 150, 260, None, None)], "candidate_id string, axis string, start_ms bigint, end_ms bigint, counterpart_ms bigint, offset_ms bigint")
    cuts = spark.createDataFrame([("c", 50, 5, 500), ("c", 20, None, None), ("c", 150, 1, 2)], "candidate_id string, at_ms bigint, range_start bigint, range_end bigint")
    ranges = spark.createDataFrame([("c", 10, 100, 20, 201)], "candidate_id string, source_start bigint, source_end bigint, target_start bigint, target_end bigint")
    inside, kept, part, removed = C.clipped(anchors.filter("candidate_id = 'c'"), cuts, samples, ranges)
    assert sorted(tuple(r)[1:] for r in inside.collect()) == [(50, 60), (99, 200)]
    assert sorted((tuple(r)[1:] for r in kept.collect()), key=str) == [(20, None, None), (50, 10, 100)]
    assert sorted(tuple(r)[1:4] for r in part.collect()) == [("source", 10, 40), ("target", 150, 201)]
    assert [tuple(r) for r in removed.collect()] == [("c", 2)]
    moves = spark.createDataFrame([("c", 0, 100, 5, 105, 0, 100, 7, 108)], "candidate_id string, a bigint, b bigint, x bigint, y bigint, e bigint, f bigint, g bigint, h bigint").select("candidate_id", C.shift_of(*map(C.F.col, "abxy")).alias("source_shift"), C.shift_of(*map(C.F.col, "efgh")).alias("target_shift"))
    assert tuple(moves.first())[1:] == (5, 0)
    assert sorted(tuple(r)[1:] for r in C.moved_anchors(anchors, moves).collect()) == [(5, 5), (5, 10), (55, 60), (104, 200)]
    assert sorted((tuple(r)[1:] for r in C.moved_samples(samples, moves).collect()), key=str) == [("source", 5, 45, 7, 2), ("target", 150, 260, None, None)]
    near = C.anchors_applied(anchors, spark.createDataFrame([("c", 3, 12), ("c", 60, 60)], "candidate_id string, source_ms bigint, target_ms bigint"), "candidate_id", 4)
    assert {(r["candidate_id"], r["source_ms"]): r["applied"] for r in near.collect()} == {("c", 0): True, ("c", 50): False, ("c", 99): False, ("d", 5): False}
