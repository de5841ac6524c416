"""Predicted time maps against annotated ones: measures per case, per scenario and over all, and a gate.

``cases`` is (case_id, media_kind, split, tolerance_ms, source_start, source_end, target_start, same_media), ``anchors``
(case_id, source_ms, target_ms), ``gold`` the annotated one-sided and ambiguous spans (case_id, kind, index, and the
four borders), ``predicted`` (case_id) the cases that have a prediction, and ``spans`` the predicted maps
(timemap.SPAN_SCHEMA, map_id being the case).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import assignment, timemap
from tidemark.operators.measures import nearest_index, values_at_ranks
from tidemark.operators.merging import union_length
from tidemark.session import cut

KINDS = ("sourceOnly", "targetOnly", "ambiguous")
#: Issues of a map that mean it runs backwards (fixed values).
BACKWARDS = ("outOfOrder", "sourceOverlap", "targetOverlap")
#: Length from which a reference is a long one (fixed value).
LONG_MS = 45 * 60 * 1000
#: What the gate asks of the data: real cases, long ones, annotated edits, share of frozen cases, cases of each of the
#: scenarios below (fixed values).
LEAST_REAL, LEAST_LONG, LEAST_EDITS, LEAST_FROZEN, LEAST_EACH = 150, 30, 500, 0.3, 1
REQUIRED = ("global-offset", "time-stretch", "source-only", "target-only", "ambiguous", "multi-audio", "long-reference", "visual-fallback", "repeated-content")


def scenarios(cases: DataFrame, anchors: DataFrame, gold: DataFrame) -> DataFrame:
    """(case_id, scenario): what can be told from the annotation itself.

    Kinds of its edits, several of them, an offset at the start, a stretch without edits, a long reference; a case
    with none of these whose two media differ is another coding of one.
    """
    edits = gold.groupBy("case_id").agg(F.count(F.lit(1)).alias("edits"), *[F.bool_or(F.col("kind") == k).alias(k) for k in KINDS])
    ends = anchors.groupBy("case_id").agg(F.min(F.struct("source_ms", "target_ms")).alias("a"), F.max(F.struct("source_ms", "target_ms")).alias("b"))
    rows = cases.join(edits, "case_id", "left").join(ends, "case_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    n = F.coalesce("edits", F.lit(0))
    stretch = (n == 0) & (F.col("b.source_ms") > F.col("a.source_ms")) & (F.col("b.target_ms") - F.col("a.target_ms") != F.col("b.source_ms") - F.col("a.source_ms"))
    told = F.array_compact(F.array(
        F.when(yes(F.col("sourceOnly")), "source-only"), F.when(yes(F.col("targetOnly")), "target-only"), F.when(yes(F.col("ambiguous")), "ambiguous"), F.when(n > 1, "multi-edit"),
        F.when((F.col("source_start") != F.col("target_start")) | yes(F.col("a.source_ms") != F.col("a.target_ms")), "global-offset"), F.when(yes(stretch), "time-stretch"), F.when(F.col("source_end") - F.col("source_start") >= LONG_MS, "long-reference"),
    ))
    other = F.when((F.size(told) == 0) & ~F.col("same_media"), F.array(F.lit("codec-variant"))).otherwise(told)
    return rows.select("case_id", F.explode(other).alias("scenario"))


def case_results(cases: DataFrame, anchors: DataFrame, gold: DataFrame, predicted: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Measures of every case, and its errors (case_id, what 'anchor' or 'boundary', error_ms).

    Anchors of a case whose map is missing or broken are unmapped.  Edits meet as ``assignment.match_events`` has it;
    one that is only met beyond the tolerance is missed and false at once, and its boundaries are errors all the same.
    """
    spans = spans.withColumnRenamed("map_id", "case_id")
    issues = timemap.validate(spans.withColumnRenamed("case_id", "map_id")).groupBy(F.col("map_id").alias("case_id")).agg(F.count(F.lit(1)).alias("issues"), F.count_if(F.col("issue").isin(*BACKWARDS)).alias("backwards"))
    state = cases.select("case_id").join(predicted.select("case_id", F.lit(True).alias("_there")).distinct(), "case_id", "left").join(issues, "case_id", "left")
    missing = F.col("_there").isNull()
    state = cut(state.select("case_id", missing.alias("missing"), F.when(missing, 1).otherwise(F.coalesce("issues", F.lit(0))).cast("long").alias("faults"), F.coalesce("backwards", F.lit(0)).alias("backwards")))

    sound = spans.join(state.filter("faults = 0"), "case_id", "left_semi").withColumnRenamed("case_id", "map_id")
    asked = anchors.select(F.col("case_id").alias("map_id"), "source_ms", F.col("target_ms").alias("wanted_ms"))
    placed = timemap.project(asked, sound, "map_id", "source_ms")
    mapped = placed.withColumn("error_ms", F.when(F.col("status") == "mapped", F.abs(F.col("target_ms") - F.col("wanted_ms"))))
    anchor_counts = mapped.groupBy(F.col("map_id").alias("case_id")).agg(F.count("error_ms").alias("mapped"), F.count_if(F.col("error_ms").isNull()).alias("unmapped"))

    limit = cases.select("case_id", "tolerance_ms")
    events = spans.filter(F.col("kind").isin(*KINDS)).join(limit, "case_id").withColumnRenamed("span_index", "index")
    known = gold.join(limit, "case_id").withColumn("index", F.col("index").cast(events.schema["index"].dataType))
    by = ["case_id", "kind"]
    columns = [*by, "index", *assignment.SPAN, "tolerance_ms"]
    matches = cut(assignment.match_events(known.select(*columns), events.select(*columns), by, "tolerance_ms"))
    counts = assignment.event_counts(known, events, matches, by)
    edits = counts.groupBy("case_id").agg(*[F.sum(F.when((F.col("kind") == k) if k else F.lit(True), F.col(c))).alias(f"{c}_{k}" if k else c) for k in ("", *KINDS) for c in ("tp", "fp", "fn")])
    sides = [known.select(*by, F.col("index").alias("gold_index"), *[F.col(c).alias(f"g_{c}") for c in assignment.SPAN]), events.select(*by, F.col("index").alias("predicted_index"), *[F.col(c).alias(f"p_{c}") for c in assignment.SPAN])]
    pairs = matches.join(sides[0], [*by, "gold_index"]).join(sides[1], [*by, "predicted_index"])

    def ends(axis: str) -> Column:
        long = (F.col(f"g_{axis}_end") != F.col(f"g_{axis}_start")) | (F.col(f"p_{axis}_end") != F.col(f"p_{axis}_start"))
        return F.when(long, F.abs(F.col(f"g_{axis}_end") - F.col(f"p_{axis}_end")))

    starts = [F.abs(F.col(f"g_{a}_start") - F.col(f"p_{a}_start")) for a in ("source", "target")]
    borders = pairs.select("case_id", F.explode(F.array_compact(F.array(*starts, ends("source"), ends("target")))).alias("error_ms"))
    errors = mapped.filter("error_ms IS NOT NULL").select(F.col("map_id").alias("case_id"), F.lit("anchor").alias("what"), "error_ms").unionByName(borders.select("case_id", F.lit("boundary").alias("what"), "error_ms"))

    def covered(rows: DataFrame, out: str) -> DataFrame:
        held = rows.join(cases.select("case_id", F.col("source_start").alias("_a"), F.col("source_end").alias("_b")), "case_id")
        inner = held.select("case_id", F.greatest("source_start", "_a").alias("s"), F.least("source_end", "_b").alias("e")).filter("s < e")
        return union_length(inner, ["case_id"], "s", "e", out)

    out = cases.select("case_id", "media_kind", "split", (F.col("source_end") - F.col("source_start")).alias("source_ms")).join(state, "case_id")
    for part in (anchor_counts, edits, covered(spans, "covered_ms"), covered(spans.filter("kind = 'ambiguous'"), "ambiguous_ms"), covered(spans.filter("kind = 'matched'"), "matched_ms")):
        out = out.join(part, "case_id", "left")
    return out.na.fill(0), errors


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a) / F.col(b))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    """With nothing predicted and nothing there all is right."""
    return F.when(tp + fp + fn == 0, F.lit(1.0)).otherwise(2 * tp / (2 * tp + fp + fn))


def summaries(results: DataFrame, errors: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for every group: ``groups`` is (group, case_id), and a case may be in several."""
    sums = ["faults", "backwards", "mapped", "unmapped", "source_ms", "covered_ms", "ambiguous_ms", *[f"{c}{k}" for k in ("", *(f"_{k}" for k in KINDS)) for c in ("tp", "fp", "fn")]]
    rows = results.join(groups, "case_id")
    out = rows.groupBy("group").agg(F.count(F.lit(1)).alias("cases"), F.count_if("missing").alias("missing"), F.min(_ratio("covered_ms", "source_ms")).alias("least_cover"), F.max(_ratio("ambiguous_ms", "source_ms")).alias("most_ambiguous"), *[F.sum(c).alias(c) for c in sums])
    n = F.col("n")
    ranks = values_at_ranks(errors.join(groups, "case_id").select("group", "what", F.col("error_ms").cast("double").alias("error_ms")), ["group", "what"], "error_ms", {"p50": nearest_index(0.5, n), "p95": nearest_index(0.95, n), "most": n - 1})
    for what in ("anchor", "boundary"):
        out = out.join(ranks.filter(F.col("what") == what).select("group", *[F.col(c).alias(f"{what}_{c}") for c in ("p50", "p95", "most")]), "group", "left")
    scores = {f"f1{k}": _f1(F.col(f"tp{k}"), F.col(f"fp{k}"), F.col(f"fn{k}")) for k in ("", *(f"_{k}" for k in KINDS))}
    return out.withColumns({"cover": _ratio("covered_ms", "source_ms"), "ambiguous": _ratio("ambiguous_ms", "source_ms"), **scores})


def gate(cases: DataFrame, told: DataFrame, results: DataFrame, errors: DataFrame, predicted: DataFrame) -> DataFrame:
    """(part, check_id, passed, actual): what the real cases must fulfil; parts ``data`` and ``quality``.

    Without enough data nothing is said about quality.  ``gate_status`` sums the checks up.
    """
    real = cases.filter("media_kind = 'real'").select("case_id", "split")
    of_real = told.join(real, "case_id", "left_semi")
    counts = of_real.groupBy("scenario").agg(F.count_distinct("case_id").alias("n"))
    spark = cases.sparkSession
    wanted = spark.createDataFrame([(s,) for s in REQUIRED], "scenario string").join(counts, "scenario", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    edits = results.filter("media_kind = 'real'").agg(F.coalesce(F.sum(F.col("tp") + F.col("fn")), F.lit(0)).alias("edits"))
    size = real.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "frozen-test").alias("frozen"))

    def check(name: Column | str, passed: Column, actual: Column) -> Column:
        return F.struct((F.lit(name) if isinstance(name, str) else name).alias("check_id"), F.coalesce(passed, F.lit(False)).alias("passed"), actual.cast("double").alias("actual"))

    share = F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.col("frozen") / F.col("n"))
    base = size.crossJoin(edits).select(F.explode(F.array(check("real-relations", F.col("n") >= LEAST_REAL, F.col("n")), check("gold-edit-events", F.col("edits") >= LEAST_EDITS, F.col("edits")), check("frozen-test-ratio", share >= LEAST_FROZEN, share))).alias("c"))
    long = wanted.filter("scenario = 'long-reference'").select(check("long-reference-relations", F.col("n") >= LEAST_LONG, F.col("n")).alias("c"))
    each = wanted.select(check(F.concat(F.lit("scenario:"), F.col("scenario")), F.col("n") >= LEAST_EACH, F.col("n")).alias("c"))
    data = cut(base.union(long).union(each).select(F.lit("data").alias("part"), "c.*"))
    if data.filter("NOT passed").limit(1).count():
        return data

    groups = real.select(F.lit("real").alias("group"), "case_id").union(of_real.filter("scenario = 'long-reference'").select(F.lit("long").alias("group"), "case_id"))
    shown = cut(summaries(results, errors, groups))
    extra = predicted.select("case_id").distinct().join(cases, "case_id", "left_anti").agg(F.count(F.lit(1)).alias("extra"))
    whole = shown.filter("group = 'real'").crossJoin(extra).crossJoin(shown.filter("group = 'long'").select(F.col("cover").alias("long_cover")))
    c = F.col
    checks = [
        check("all-real-predictions-present", c("missing") == 0, c("missing")), check("no-unexpected-predictions", c("extra") == 0, c("extra")), check("valid-time-map-structure", c("faults") == 0, c("faults")), check("monotonic-time-map", c("backwards") == 0, c("backwards")),
        check("all-gold-anchors-mapped", c("unmapped") == 0, c("unmapped")), check("mapping-coverage", c("cover") >= 0.98, c("cover")), check("per-relation-mapping-coverage", c("least_cover") >= 0.95, c("least_cover")), check("long-reference-mapping-coverage", c("long_cover") >= 0.98, c("long_cover")),
        check("ambiguous-ratio", c("ambiguous") <= 0.05, c("ambiguous")), check("per-relation-ambiguous-ratio", c("most_ambiguous") <= 0.25, c("most_ambiguous")), check("anchor-p95", c("anchor_p95") <= 200, c("anchor_p95")), check("anchor-max", c("anchor_most") <= 500, c("anchor_most")),
        check("boundary-p95", c("boundary_p95") <= 250, c("boundary_p95")), check("edit-f1", c("f1") >= 0.97, c("f1")), *[check(f"edit-class:{k}", c(f"f1_{k}") >= 0.95, c(f"f1_{k}")) for k in KINDS],
    ]
    return data.union(whole.select(F.explode(F.array(*checks)).alias("c")).select(F.lit("quality").alias("part"), "c.*"))


def gate_status(checks: DataFrame) -> DataFrame:
    """(status, failed): insufficient-data, fail or pass, and the checks that failed."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("check_id"))))
    data = F.coalesce(F.bool_or((F.col("part") == "data") & ~F.col("passed")), F.lit(False))
    return checks.agg(F.when(data, "insufficient-data").when(F.size(failed) > 0, "fail").otherwise("pass").alias("status"), failed.alias("failed"))
