"""Every reason that blocks a segment, and items in several segments."""

from tidemark.operators import projection as P

SEGMENT = "segment_id string, kind string, asset_id string, source_media string, target_media string, map_id string, source_start bigint, source_end bigint, target_start bigint"
MAP = "map_id string, state string, source_media string, target_media string, source_start bigint, source_end bigint, target_start bigint, target_end bigint, level string, identity_ok boolean"
SPAN = "map_id string, span_index int, kind string, source_start bigint, source_end bigint, target_start bigint, target_end bigint, level string, decision string"


def tables(spark, cases):
    """One asset per case; a case changes what would be usable."""
    segments, maps, spans, assets, bindings, media = [], [], [], [], [], [("src", P.SOURCE_ROLE, None), ("src2", P.SOURCE_ROLE, None), ("dst", P.TARGET_ROLE, 10_000), ("odd", "other", None)]
    for name, change in cases.items():
        own = [(name, 0, "matched", 0, 1000, 0, 1100, "verified", None), (name, 1, "ambiguous", 1000, 1500, 1100, 1600, "verified", "replacement")]
        segment = dict(segment_id=name, kind="content", asset_id=name, source_media="src", target_media="dst", map_id=name, source_start=0, source_end=1500, target_start=None)
        map_ = dict(map_id=name, state="confirmed", source_media="src", target_media="dst", source_start=0, source_end=1500, target_start=0, target_end=1600, level="verified", identity_ok=True)
        segment |= change.get("segment", {})
        map_ |= change.get("map", {})
        segments.append(tuple(segment.values()))
        maps += [] if change.get("no_map") else [tuple(map_.values())]
        spans += change.get("spans", own)
        assets += [] if change.get("no_asset") else [(name,)]
        bindings += [] if change.get("bound", "src") is None else [(name, change.get("bound", "src"))]
    made = [spark.createDataFrame(rows, schema) for rows, schema in ((segments, SEGMENT), (assets, "asset_id string"), (maps, MAP), (spans, SPAN), (bindings, "asset_id string, source_media string"), (media, "media_id string, role string, duration_ms bigint"))]
    return made


def spans_of(name, *changes):
    own = [[name, 0, "matched", 0, 1000, 0, 1100, "verified", None], [name, 1, "ambiguous", 1000, 1500, 1100, 1600, "verified", "replacement"]]
    for k, at, value in changes:
        own[k][at] = value
    return [tuple(x) for x in own]


def test_every_blocker(spark):
    cases = {
        None: {}, "noAsset": {"no_asset": True}, "noSource": {"segment": {"source_media": "odd"}}, "notBound": {"bound": None}, "otherSource": {"bound": "src2"}, "noTarget": {"segment": {"target_media": None}}, "targetRole": {"segment": {"target_media": "odd"}}, "noMap": {"segment": {"map_id": None}},
        "missing": {"no_map": True}, "unconfirmed": {"map": {"state": "candidate"}}, "mismatch": {"map": {"source_end": 1400}}, "invalid": {"spans": spans_of("invalid", (1, 3, 1100))}, "noEvidence": {"spans": spans_of("noEvidence", (1, 7, None))}, "spanBlocked": {"spans": spans_of("spanBlocked", (0, 7, "blocked"))},
        "spanLegacy": {"spans": spans_of("spanLegacy", (0, 7, "legacy-unverified"))}, "edges": {"map": {"target_end": 1700}}, "ambiguous": {"spans": spans_of("ambiguous", (1, 8, None))}, "review": {"map": {"level": "review"}}, "blocked": {"map": {"level": "blocked"}}, "legacy": {"map": {"level": "legacy-unverified"}},
        "identity": {"map": {"identity_ok": False}},
    }
    cases = {name or "fine": change for name, change in cases.items()}
    segments, assets, maps, spans, bindings, media = tables(spark, cases)
    got = {r["segment_id"]: r["blocker"] for r in P.segment_blockers(segments, assets, maps, spans, bindings, media).collect()}
    assert got == {name: None if name == "fine" else name for name in cases}


def test_conflicts(spark):
    row = lambda name, kind, target, a, b, source="src": (name, kind, "x", source, target, None, a, b, None)
    segments = spark.createDataFrame([row("a", "content", "t1", 0, 100), row("b", "content", "t2", 50, 150), row("c", "content", "t1", 90, 200), row("d", "ignored", None, 150, 160), row("e", "content", "t1", 200, 300), row("f", "ignored", None, 0, 300, "other")], SEGMENT)
    assert {tuple(r) for r in P.segment_conflicts(segments).collect()} == {("a", "c"), ("c", "d")}


def test_items_of_several_segments(spark):
    segments = spark.createDataFrame([("s1", "content", "x", "src", "t1", "m1", 0, 1000, 0), ("s2", "content", "x", "src", "t2", "m2", 500, 1500, 0), ("s3", "ignored", "x", "src", None, None, 2000, 3000, None), ("s4", "content", "x", "src", "t1", "m1", 0, 9000, 0)], SEGMENT)
    blockers = spark.createDataFrame([("s1", "content", None), ("s2", "content", None), ("s3", "ignored", None), ("s4", "content", "mismatch")], "segment_id string, kind string, blocker string")
    spans = [("m1", 0, "matched", 0, 600, 0, 1200, "v", None), ("m1", 1, "sourceOnly", 600, 900, 1200, 1200, "v", None), ("m1", 2, "ambiguous", 900, 900, 1200, 1300, "v", "replacement"), ("m1", 3, "ambiguous", 900, 1000, 1300, 1400, "v", None), ("m2", 0, "matched", 500, 700, 0, 200, "v", None), ("m2", 1, "sourceOnly", 700, 1500, 200, 200, "v", None)]
    items = [("x", i, i, t, i != 3) for i, t in enumerate([0, 550, 650, 100, 800, 900, 950, 1200, 1700, 2000, 2999, 3000])] + [("y", 0, 0, 100, True)]
    out = P.project_items(segments, blockers, spark.createDataFrame(items, "asset_id string, item_id bigint, original_index bigint, at_ms bigint, enabled boolean"), spark.createDataFrame(spans, SPAN), spark.createDataFrame([(0,)], "item_id bigint"), spark.createDataFrame([(1, -2000)], "item_id bigint, adjustment_ms bigint"))
    got = {(r["asset_id"], r["item_id"]): r["outcome"] for r in out.outcomes.collect()}
    assert got == {("x", 0): "mapped", ("x", 1): "mapped", ("x", 2): "mapped", ("x", 3): "mapped", ("x", 4): "sourceOnly", ("x", 5): "sourceOnly", ("x", 6): "sourceOnly", ("x", 7): "sourceOnly", ("x", 8): "unexpected", ("x", 9): "ignored", ("x", 10): "ignored", ("x", 11): "unexpected", ("y", 0): "unexpected"}
    entries = {(r["segment_id"], r["item_id"]): (r["final_ms"], r["enabled"]) for r in out.entries.collect()}
    assert entries == {("s1", 0): (0, False), ("s1", 1): (1100 - 2000, True), ("s2", 1): (50 - 2000, True), ("s2", 2): (150, True), ("s1", 3): (200, False)}
    media = spark.createDataFrame([("t1", "r", 500), ("t2", "r", 100)], "media_id string, role string, duration_ms bigint")
    groups = {r["target_media"]: tuple(r)[1:] for r in P.target_groups(out.entries, media).collect()}
    assert groups == {"t1": (1, 2, 1, 0, -900, -900), "t2": (2, 0, 1, 1, -1950, 150)}
    assert [(r["target_media"], r["item_id"], r["place"]) for r in P.in_order(out.entries).orderBy("target_media", "place").collect()] == [("t1", 1, 1), ("t2", 1, 1), ("t2", 2, 2)]
