"""Piecewise time maps: contiguous spans on a source and a target axis.

Kinds: ``matched`` spans map by interpolation, ``sourceOnly`` ones exist only on the source axis, ``targetOnly`` ones
only on the target axis (source length 0), ``ambiguous`` ones map nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.intervals import point_in_interval_join

SPAN_SCHEMA = "map_id string, span_index int, kind string, source_start bigint, source_end bigint, target_start bigint, target_end bigint"


def interpolate(t: Column, s0: Column, s1: Column, t0: Column, t1: Column) -> Column:
    """Target time of ``t``: integer arithmetic, rounded half up, and inside the half-open target range."""
    ds, dt = (s1 - s0).cast("decimal(38,0)"), (t1 - t0).cast("decimal(38,0)")
    half_up = F.floor((2 * (t - s0).cast("decimal(38,0)") * dt + ds) / (2 * ds)).cast("long")
    return F.least(t1 - 1, t0 + half_up)


def lookup_spans(spans: DataFrame, by: list[str]) -> DataFrame:
    """``spans`` with ``lo`` and ``hi``, the source times [lo, hi) that each answers for; no two of a map overlap.

    An ambiguous span without length on the source answers for its own millisecond, and the span that begins there
    for one less; other spans without length answer for none.
    """
    w = W.partitionBy(*by, "source_start")
    point = (F.col("source_end") == F.col("source_start")) & (F.col("kind") == "ambiguous")
    rows = spans.withColumns({"_point": point, "_met": F.max(point).over(w), "_n": F.row_number().over(W.partitionBy(*by, "source_start", "source_end", "kind").orderBy("span_index"))})
    rows = rows.filter((F.col("source_end") > F.col("source_start")) | (F.col("_point") & (F.col("_n") == 1)))
    lo = F.when(~F.col("_point") & F.col("_met"), F.col("source_start") + 1).otherwise(F.col("source_start"))
    return rows.withColumns({"lo": lo, "hi": F.when(F.col("_point"), F.col("source_start") + 1).otherwise(F.col("source_end"))}).filter("lo < hi").drop("_point", "_met", "_n")


def status_and_target(at: Column) -> dict[str, Column]:
    """``status`` and ``target_ms`` of a time beside the span that answers for it, if any."""
    kind = F.col("kind")
    status = F.when(kind == "matched", "mapped").when(kind.isNull(), "unmapped").otherwise(kind)
    target = F.when(kind == "matched", interpolate(at, F.col("source_start"), F.col("source_end"), F.col("target_start"), F.col("target_end")))
    return {"status": status, "target_ms": target}


def project(events: DataFrame, spans: DataFrame, map_id: str = "map_id", at: str = "t_ms", width: int = 86_400_000) -> DataFrame:
    """``events`` with ``status`` and ``target_ms``; times outside all spans are ``unmapped``.

    A zero-length ambiguous span wins over the span that starts at its place.  Few spans are broadcast, after they were
    counted, so events of a frequent map stay where they are.
    """
    answers = lookup_spans(spans, ["map_id"]).select(F.col("map_id").alias(map_id), "kind", "source_start", "source_end", "target_start", "target_end", "lo", "hi")
    found = point_in_interval_join(events, answers, [map_id], at, "lo", "hi", width, "left", counted=True)
    return found.withColumns(status_and_target(F.col(at))).drop("kind", "source_start", "source_end", "target_start", "target_end", "lo", "hi")


def validate(spans: DataFrame) -> DataFrame:
    """(map_id, span_index, issue) by nine codes.

    A span with an invalid number has only that issue, one that ends before it begins only ``invalidRange``; spans are
    compared with the one before where both have valid coordinates.
    """
    w = W.partitionBy("map_id").orderBy("span_index")
    axes = ["source_start", "source_end", "target_start", "target_end"]
    good = F.lit(True)
    for c in axes:
        good = good & F.coalesce(F.col(c) >= 0, F.lit(False))
    ds, dt = F.col("source_end") - F.col("source_start"), F.col("target_end") - F.col("target_start")
    ranged = F.coalesce(good & (ds >= 0) & (dt >= 0), F.lit(False))
    shape = (
        F.when(F.col("kind") == "matched", (ds > 0) & (dt > 0))
        .when(F.col("kind") == "sourceOnly", (ds > 0) & (dt == 0))
        .when(F.col("kind") == "targetOnly", (ds == 0) & (dt > 0))
        .when(F.col("kind") == "ambiguous", (ds > 0) | (dt > 0))
        .otherwise(False)
    )
    own = (
        F.when(~good, "invalidMilliseconds")
        .when(~ranged, "invalidRange")
        .when(~shape & (F.col("kind") == "ambiguous"), "emptyAmbiguousSpan")
        .when(~shape, "invalidKindShape")
    )
    before = {c: F.lag(c).over(w) for c in axes}
    lagged = spans.withColumns({"_fit": ranged, **{f"_{c}": v for c, v in before.items()}}).withColumn("_both", F.col("_fit") & F.coalesce(F.lag("_fit").over(w), F.lit(False)))
    two = F.col("_both")
    checks = [
        own,
        F.when(two & ((F.col("source_start") < F.col("_source_start")) | (F.col("target_start") < F.col("_target_start"))), F.lit("outOfOrder")),
        *[
            F.when(two & (F.col(f"{axis}_start") < F.col(f"_{axis}_end")), F.lit(f"{axis}Overlap")).when(two & (F.col(f"{axis}_start") > F.col(f"_{axis}_end")), F.lit(f"{axis}Discontinuity"))
            for axis in ("source", "target")
        ],
    ]
    return lagged.select("map_id", "span_index", F.explode(F.array_compact(F.array(*checks))).alias("issue"))


def inverse(spans: DataFrame) -> DataFrame:
    """The map from target to source."""
    kind = F.when(F.col("kind") == "sourceOnly", "targetOnly").when(F.col("kind") == "targetOnly", "sourceOnly").otherwise(F.col("kind"))
    return spans.select("map_id", "span_index", kind.alias("kind"), F.col("target_start").alias("source_start"), F.col("target_end").alias("source_end"), F.col("source_start").alias("target_start"), F.col("source_end").alias("target_end"))


def split_at(spans: DataFrame, cuts: DataFrame) -> DataFrame:
    """Spans cut at the source times of ``cuts`` (map_id, at); the target cut is the interpolated time."""
    per_map = cuts.groupBy("map_id").agg(F.array_sort(F.collect_set("at")).alias("_cuts"))
    s0, s1, t0, t1 = (F.col(c) for c in ("source_start", "source_end", "target_start", "target_end"))
    inner = F.filter(F.coalesce("_cuts", F.array().cast("array<bigint>")), lambda c: (c > s0) & (c < s1) & (F.col("kind") == "matched"))
    bounds = F.concat(F.array(s0), inner, F.array(s1))
    parts = F.transform(F.sequence(F.lit(0), F.size(bounds) - 2), lambda k: F.struct(F.get(bounds, k).alias("a"), F.get(bounds, k + 1).alias("b")))

    def inner_place(x: Column) -> Column:
        return interpolate(x, s0, s1, t0, t1)

    cut = spans.join(per_map, "map_id", "left").withColumn("_part", F.explode(parts))
    begin = F.when(F.col("_part.a") == s0, t0).otherwise(inner_place(F.col("_part.a")))
    end = F.when(F.col("_part.b") == s1, t1).otherwise(inner_place(F.col("_part.b")))

    w = W.partitionBy("map_id").orderBy("span_index", "_part.a")
    made = cut.select("map_id", (F.row_number().over(w) - 1).cast("int").alias("n"), "kind", F.col("_part.a").alias("a"), F.col("_part.b").alias("b"), begin.alias("c"), end.alias("d"))
    return made.toDF("map_id", "span_index", "kind", "source_start", "source_end", "target_start", "target_end")


def span_counterpart(at: Column, axis: str) -> tuple[Column, Column]:
    """(status, position) of the place ``at`` of one axis on the other one, for the span that a row describes.

    Places outside the span are moved into it; an ambiguous span leads to the other side's beginning, and a side that
    does not exist is ``unavailable``.
    """
    other = "target" if axis == "source" else "source"
    a0, a1, b0, b1 = F.col(f"{axis}_start"), F.col(f"{axis}_end"), F.col(f"{other}_start"), F.col(f"{other}_end")
    inside = F.greatest(a0, F.least(a1 - 1, at))
    kind = F.col("kind")
    status = F.when(b1 <= b0, "unavailable").when(kind == "ambiguous", "independent").when((kind == "matched") & (a1 > a0), "mapped").otherwise("unavailable")
    return status, F.when(status == "mapped", interpolate(inside, a0, a1, b0, b1)).when(status == "independent", b0)


def legacy_spans(maps: DataFrame, rules: DataFrame) -> DataFrame:
    """Spans of maps that were kept as a range and a list of gaps.

    ``maps`` is (map_id, source_start, source_end, target_start), ``rules`` (map_id, at, gap, rule).  A positive gap
    becomes a target-only span; gaps of one place add up; where the first negative one stands, the rest of the range is
    ambiguous, as its two borders are not known.  Maps with a rule outside their range have no spans.
    """
    ranged = rules.join(maps, "map_id")
    bad = ranged.filter((F.col("at") < F.col("source_start")) | (F.col("at") > F.col("source_end")) | F.col("at").isNull() | F.col("gap").isNull()).select("map_id").distinct()
    good = maps.join(bad, "map_id", "left_anti")
    places = rules.groupBy("map_id", "at").agg(F.sum(F.greatest("gap", F.lit(0))).alias("gap"), F.bool_or(F.col("gap") < 0).alias("stop"))
    w = W.partitionBy("map_id").orderBy("at")
    places = places.withColumn("stopped", F.max(F.col("stop").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1))).filter("coalesce(stopped, 0) = 0")
    marks = good.join(places, "map_id", "left").withColumn("at", F.coalesce("at", F.col("source_end"))).withColumn("gap", F.coalesce("gap", F.lit(0))).withColumn("stop", F.coalesce("stop", F.lit(False)))
    before = F.coalesce(F.sum("gap").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    marks = marks.withColumns({"from_ms": F.coalesce(F.lag("at").over(w), F.col("source_start")), "shift": F.col("target_start") - F.col("source_start") + before, "last": F.lead("at").over(w).isNull()})
    at, shift, end = F.col("at"), F.col("shift"), F.col("source_end")

    def span(kind: str, a: Column, b: Column, c: Column, e: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), a.cast("long").alias("source_start"), b.cast("long").alias("source_end"), c.cast("long").alias("target_start"), e.cast("long").alias("target_end"))

    after = shift + F.col("gap")
    parts = F.array(
        F.when(at > F.col("from_ms"), span("matched", F.col("from_ms"), at, F.col("from_ms") + shift, at + shift)),
        F.when(~F.col("stop") & (F.col("gap") > 0), span("targetOnly", at, at, at + shift, at + after)),
        F.when(F.col("stop") & (at < end), span("ambiguous", at, end, at + shift, at + shift)),
        F.when(F.col("last") & ~F.col("stop") & (at < end), span("matched", at, end, at + after, end + after)),
    )
    made = marks.select("map_id", "at", F.posexplode(F.array_compact(parts)).alias("part", "s"))
    place = F.row_number().over(W.partitionBy("map_id").orderBy("at", "part")) - 1
    return made.select("map_id", place.cast("int").alias("span_index"), "s.*")


def legacy_migration(maps: DataFrame, rules: DataFrame) -> DataFrame:
    """(map_id, status, issues): whether ``legacy_spans`` could carry a map over, and what was wrong with it.

    A map is ``blocked`` by an invalid range (invalidInput), by rules that are null or outside it (invalidRule, one for
    each) and by the first negative gap (negativeGap); else it is ``migrated``.  Gaps of 0 are told (zeroGapIgnored),
    before a negative gap only.  ``issues`` is (code, rule) in order of place and rule.
    """
    numbers = [F.col(c) for c in ("source_start", "source_end", "target_start")]
    ranged = F.lit(True)
    for c in numbers:
        ranged = ranged & F.coalesce(c >= 0, F.lit(False))
    known = maps.withColumn("_ranged", ranged & F.coalesce(F.col("source_end") > F.col("source_start"), F.lit(False)))
    outside = F.col("at").isNull() | F.col("gap").isNull() | (F.col("at") < F.greatest(F.col("source_start"), F.lit(0))) | (F.col("at") > F.col("source_end"))
    rows = rules.join(known.select("map_id", "source_start", "source_end", "_ranged"), "map_id").filter("_ranged").withColumn("_out", outside)
    per = rows.groupBy("map_id").agg(F.bool_or("_out").alias("_bad"), F.min(F.when(F.col("gap") < 0, F.struct("at", "rule"))).alias("_stop"))
    rows = rows.join(per, "map_id")
    code = (
        F.when(F.col("_out"), "invalidRule")
        .when(~F.col("_bad") & (F.col("gap") == 0) & (F.col("_stop").isNull() | (F.col("at") < F.col("_stop.at"))), "zeroGapIgnored")
        .when(~F.col("_bad") & (F.col("at") == F.col("_stop.at")) & (F.col("rule") == F.col("_stop.rule")), "negativeGap")
    )
    told = rows.withColumn("code", code).filter("code IS NOT NULL").groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("at", "rule", "code"))).alias("_told"))
    found = known.select("map_id", "_ranged").join(per, "map_id", "left").join(told, "map_id", "left")
    issue = "array<struct<code:string,rule:int>>"
    listed = F.transform(F.coalesce("_told", F.array().cast("array<struct<at:bigint,rule:int,code:string>>")), lambda i: F.struct(i["code"].alias("code"), i["rule"].cast("int").alias("rule")))
    blocked = ~F.col("_ranged") | F.coalesce(F.col("_bad"), F.lit(False)) | F.col("_stop").isNotNull()
    first = F.array(F.struct(F.lit("invalidInput").alias("code"), F.lit(None).cast("int").alias("rule")))
    return found.select("map_id", F.when(blocked, "blocked").otherwise("migrated").alias("status"), F.when(F.col("_ranged"), listed.cast(issue)).otherwise(first.cast(issue)).alias("issues"))


def merge_spans(spans: DataFrame, chosen: DataFrame) -> DataFrame:
    """Spans with the ``chosen`` ones (map_id, span_index) joined to the next one, where both are of one kind."""
    w = W.partitionBy("map_id").orderBy("span_index")
    marked = spans.join(chosen.select("map_id", "span_index").distinct().withColumn("_chosen", F.lit(True)), ["map_id", "span_index"], "left")
    joined = F.coalesce(F.lag("_chosen").over(w) & (F.lag("kind").over(w) == F.col("kind")), F.lit(False))
    runs = marked.withColumn("_new", (~joined).cast("int")).withColumn("_run", F.sum("_new").over(w))
    merged = runs.groupBy("map_id", "_run").agg(
        F.min("kind").alias("kind"), *[F.min_by(c, "span_index").alias(c) for c in ("source_start", "target_start")], *[F.max_by(c, "span_index").alias(c) for c in ("source_end", "target_end")]
    )
    return merged.select("map_id", (F.col("_run") - 1).cast("int").alias("span_index"), "kind", "source_start", "source_end", "target_start", "target_end")


def edit_spans(spans: DataFrame, patches: DataFrame) -> DataFrame:
    """Spans with new kinds and borders from ``patches``, and their neighbours' borders moved along.

    ``patches`` has a span's columns, with at most one patch among any three neighbours.
    """
    w = W.partitionBy("map_id").orderBy("span_index")
    axes = ["source_start", "source_end", "target_start", "target_end"]
    p = patches.select("map_id", "span_index", F.struct("kind", *axes).alias("_p"))
    m = spans.join(p, ["map_id", "span_index"], "left").withColumns({"_before": F.lag("_p").over(w), "_after": F.lead("_p").over(w)})

    def border(axis: str, own: str, neighbour: str, theirs: str) -> Column:
        return F.coalesce(F.col(f"_p.{axis}_{own}"), F.col(f"{neighbour}.{axis}_{theirs}"), F.col(f"{axis}_{own}")).alias(f"{axis}_{own}")

    return m.select(
        "map_id", "span_index", F.coalesce("_p.kind", "kind").alias("kind"), border("source", "start", "_before", "end"), border("source", "end", "_after", "start"), border("target", "start", "_before", "end"), border("target", "end", "_after", "start")
    )


def resolve_gap(spans: DataFrame, gaps: DataFrame) -> DataFrame:
    """Spans in which a one-sided part is set apart: matched, the part, matched; empty ends are left out.

    ``gaps`` is (map_id, span_index, a, b, c, d): the part's range on the source and on the target axis, of which one
    is empty; parts that do not lie inside their span change nothing.
    """
    m = spans.join(gaps, ["map_id", "span_index"], "left")
    s0, s1, t0, t1 = (F.col(c) for c in ("source_start", "source_end", "target_start", "target_end"))
    a, b, c, e = (F.col(x) for x in "abcd")
    fits = F.coalesce((a >= s0) & (b <= s1) & (c >= t0) & (e <= t1) & (((a == b) & (c < e)) | ((a < b) & (c == e))), F.lit(False))

    def span(kind: Column, x: Column, y: Column, u: Column, v: Column) -> Column:
        return F.struct(kind.alias("kind"), x.alias("source_start"), y.alias("source_end"), u.alias("target_start"), v.alias("target_end"))

    side = F.when(a == b, "targetOnly").otherwise("sourceOnly")
    left = F.when((a > s0) | (c > t0), span(F.lit("matched"), s0, a, t0, c))
    right = F.when((b < s1) | (e < t1), span(F.lit("matched"), b, s1, e, t1))
    parts = F.when(fits, F.array_compact(F.array(left, span(side, a, b, c, e), right))).otherwise(F.array(span(F.col("kind"), s0, s1, t0, t1)))
    made = m.select("map_id", F.col("span_index").alias("_at"), F.posexplode(parts).alias("_part", "s"))
    place = F.row_number().over(W.partitionBy("map_id").orderBy("_at", "_part")) - 1
    return made.select("map_id", place.cast("int").alias("span_index"), "s.*")
