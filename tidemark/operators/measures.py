"""Exact ranks, residual statistics, classification metrics, quality levels and risk bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ordering import numbered, running
from tidemark.session import cut

#: Ranges into which a key's values are divided before ranks are looked up.
RANGES = 1024
#: Values of a part, on average, of keys that have fewer than fill RANGES parts, keys that are sent to all tasks, and
#: rows that a task sorts, on average, where keys are more.
PART_ROWS, KEYS_SENT, ROWS_EACH = 16, 500_000, 500_000


def upper_index(q: float, n: Column) -> Column:
    """Place, from 0, of the value at ceil((n - 1) * q)."""
    return F.ceil((n - 1) * F.lit(q)).cast("long")


def nearest_index(q: float, n: Column) -> Column:
    """Place, from 0, of the value at rank ceil(n * q)."""
    return F.greatest(F.ceil(n * F.lit(q)) - 1, F.lit(0)).cast("long")


def values_at_ranks(rows: DataFrame, by: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """(by, n, names of ``places``): per key the values that stand at the given places of its sorted values.

    ``places`` are columns over n, the number of the key's values.  A key's values are counted in up to RANGES equal parts
    of its range first, a few values each; then only the parts that hold a wanted place are counted value by value, and the counts are
    added up over ranges of values, so that it does not matter if one outlier puts all else into one part.  No step
    gathers or sorts all rows of a key.
    """
    rows = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    ends = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    ends = cut(ends.withColumn("_parts", F.least(F.ceil(F.col("n") / PART_ROWS), F.lit(RANGES))))
    keys, total = ends.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    few = keys <= KEYS_SENT
    if not few:
        rows = rows.repartition(-(-total // ROWS_EACH), *by)
    wanted = ends.select(*by, "n", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), p.alias("place")) for k, p in places.items()])).alias("_w")).select(*by, "n", "_w.*")
    width = (F.col("_b") - F.col("_a")).cast("double")
    part = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_a")).cast("double") / width * F.col("_parts")), F.col("_parts") - 1)).otherwise(F.lit(0)).cast("int")
    parted = rows.join(F.broadcast(ends.drop("n")) if few else ends.drop("n"), by).select(*by, "_v", part.alias("_part"))
    sums = parted.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    sums = sums.withColumn("_before", F.sum("_n").over(W.partitionBy(*by).orderBy("_part")) - F.col("_n"))
    inside = (F.col("place") >= F.col("_before")) & (F.col("place") < F.col("_before") + F.col("_n"))
    found = cut(wanted.join(sums, by).filter(inside).select(*by, "n", "name", "_part", (F.col("place") - F.col("_before")).alias("_within")))
    needed = found.groupBy(*by).agg(F.collect_set("_part").alias("_needed"))
    fine = parted.join(F.broadcast(needed) if few else needed, by).filter(F.array_contains("_needed", F.col("_part"))).groupBy(*by, "_part", "_v").agg(F.count(F.lit(1)).alias("_m"))
    fine = running(fine, [*by, "_part"], "_v", value="_m", total="_upto")
    picked = found.join(fine, [*by, "_part"]).filter("_upto > _within").groupBy(*by, "n", "name").agg(F.min("_v").alias("_v"))
    return picked.groupBy(*by, "n").agg(*[F.max(F.when(F.col("name") == k, F.col("_v"))).alias(k) for k in places])


def largest_hole(rows: DataFrame, by: list[str], at: str, begin: Column, end: Column, out: str) -> DataFrame:
    """Per key the longest time without a row, from ``begin`` to the first and from the last to ``end`` included."""
    gap = F.col(at) - F.lag(at).over(W.partitionBy(*by).orderBy(at))
    per = rows.select(*by, at, gap.alias("_gap"), begin.alias("_begin"), end.alias("_end")).groupBy(*by)
    inner = per.agg(F.max("_gap").alias("_gap"), F.min(at).alias("_first"), F.max(at).alias("_last"), F.min("_begin").alias("_begin"), F.max("_end").alias("_end"))
    return inner.select(*by, F.greatest(F.coalesce("_gap", F.lit(0)), F.col("_first") - F.col("_begin"), F.col("_end") - F.col("_last"), F.lit(0)).cast("long").alias(out))


def worst_window_p95(rows: DataFrame, by: list[str], at: str, value: str, width: int, least: int, out: str) -> DataFrame:
    """Per key the largest local 95th percentile of any closed window of ``width`` that holds a row.

    As a window slides, its rows change where one enters, at the window's end, and where one has just left; these are
    the windows looked at.  One of at least ``least`` rows counts with the value at place ceil((n - 1) * 0.95).  A
    smaller one counts with its first row's value or, if larger, that of the row nearest to it (of two as near the
    larger), whether inside the window or not; keys of few rows are thus not missing.
    """
    order = [at, value]
    w = W.partitionBy(*by).orderBy(*order)
    gap_before, gap_after = F.col(at) - F.lag(at).over(w), F.lead(at).over(w) - F.col(at)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    near = F.when(gap_before.isNull() | (gap_after < gap_before), after).when(gap_after.isNull() | (gap_before < gap_after), before).otherwise(F.greatest(before, after))
    alone = F.greatest(F.col(value), F.coalesce(near, F.col(value)))
    seen = rows.select(*by, at, value, alone.alias("_alone"))
    span = W.partitionBy(*by).orderBy(at)
    entering, leaving = span.rangeBetween(-width, 0), span.rangeBetween(1, width)
    sides = []
    for edge in (entering, leaving):
        first = F.min(F.struct(at, value, "_alone")).over(edge)
        sides.append(F.struct(F.count(F.lit(1)).over(edge).alias("n"), first["_alone"].alias("alone"), F.collect_list(value).over(edge).alias("v")))
    both = seen.select(*by, F.array(*sides).alias("_w")).select(*by, F.explode("_w").alias("_w")).filter("_w.n > 0")
    place = F.ceil((F.col("_w.n") - 1) * 95 / 100).cast("int")
    local = F.when(F.col("_w.n") >= least, F.get(F.array_sort("_w.v"), place)).otherwise(F.col("_w.alone"))
    return both.groupBy(*by).agg(F.max(local).alias(out))


def classification(counts: DataFrame, tp: str = "tp", fp: str = "fp", fn: str = "fn") -> DataFrame:
    """``counts`` with precision_, recall_ and f1.

    Where nothing was predicted, precision is 1 if nothing was there, else 0; where nothing was there, recall is 1 if
    nothing was predicted, else 0; f1 is 0 where both are.
    """

    def share(over: Column, other: Column) -> Column:
        return F.when(over == 0, F.when(other == 0, 1.0).otherwise(0.0)).otherwise(F.col(tp) / over)

    p, r = share(F.col(tp) + F.col(fp), F.col(fn)), share(F.col(tp) + F.col(fn), F.col(fp))
    made = counts.withColumns({"_p": p, "_r": r})
    f1 = F.when(F.col("_p") + F.col("_r") == 0, 0.0).otherwise(2 * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r")))
    return made.withColumns({"precision_": F.round("_p", 6), "recall_": F.round("_r", 6), "f1": F.round(f1, 6)}).drop("_p", "_r")


def rollup(cases: DataFrame, scenarios: str) -> DataFrame:
    """Summed metrics per scenario of an array column, and for all cases under ``overall``; a case counts in each."""
    each = cases.select(F.explode(F.array_union(F.col(scenarios), F.array(F.lit("overall")))).alias("scenario"), "tp", "fp", "fn")
    summed = each.groupBy("scenario").agg(F.count(F.lit(1)).alias("cases"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return classification(summed)


def logistic_risk(features: list[Column], median: list[float], mean: list[float], scale: list[float], weights: list[float], intercept: float) -> Column:
    """1 - sigmoid of a linear model over imputed and scaled features."""
    z = F.lit(intercept)
    for x, m, a, s, w in zip(features, median, mean, scale, weights, strict=True):
        z = z + (F.coalesce(x, F.lit(m)) - F.lit(a)) / F.lit(s) * F.lit(w)
    p = F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))
    return 1 - p


#: Lower ends of the risk bands (fixed values).
BANDS = (("high", 0.75), ("medium", 0.5), ("low", 0.0))


def risk_bands(rows: DataFrame, risk: str, duration: str) -> DataFrame:
    """(band, measured, median, p90) of the durations of every band; bands without any are listed with 0."""
    band = F.lit(None).cast("string")
    for name, low in reversed(BANDS):
        band = F.when(F.col(risk).between(low, 1.0), F.lit(name)).otherwise(band)
    measured = rows.filter(F.col(duration).isNotNull() & F.col(risk).isNotNull()).select(band.alias("band"), duration)
    n = F.col("n")
    ranks = values_at_ranks(measured, ["band"], duration, {"median_ms": nearest_index(0.5, n), "p90_ms": nearest_index(0.9, n)})
    every = rows.sparkSession.createDataFrame([(b,) for b, _ in BANDS], "band string")
    return every.join(ranks, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("measured"), "median_ms", "p90_ms")


def lift_at(rows: DataFrame, risk: str, key: str, error: Column, judged: Column, fractions: list[float], parts: int = 512) -> DataFrame:
    """Per share of the rows with the highest risk: how many are judged, how many errors they hold, and the lift.

    Places in the ranking come from counts per range of risk and a row number inside the few ranges in which a share
    ends, so no task ranks all rows.
    """
    base = rows.select(F.col(risk).alias("_risk"), F.col(key).alias("_key"), error.cast("int").alias("_error"), judged.cast("int").alias("_judged"))
    base = base.withColumn("_part", F.least(F.floor((1 - F.col("_risk")) * parts), F.lit(parts - 1)).cast("int"))
    w = W.orderBy("_part")
    sums = base.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum("_judged").alias("_j"), F.sum(F.col("_judged") * F.col("_error")).alias("_e"))
    before = sums.withColumns({f"{c}0": F.sum(c).over(w) - F.col(c) for c in ("_n", "_j", "_e")})
    total = sums.agg(F.sum("_n").alias("rows"), F.sum("_j").alias("judged"), F.sum("_e").alias("errors"))
    wanted = total.select("*", F.explode(F.array(*[F.lit(f) for f in fractions])).alias("fraction")).withColumn("reviewed", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("rows") * F.col("fraction"))))
    ends = wanted.join(before, (F.col("reviewed") > F.col("_n0")) & (F.col("reviewed") <= F.col("_n0") + F.col("_n")))
    placed = numbered(base.join(ends.select("_part").distinct(), "_part"), ["_part"], F.desc("_risk"), "_key", pos="_place").withColumn("_place", F.col("_place") + 1)
    inner = ends.join(placed.select(F.col("_part").alias("_p"), "_place", "_judged", "_error"), (F.col("_part") == F.col("_p")) & (F.col("_place") <= F.col("reviewed") - F.col("_n0")))
    got = inner.groupBy("fraction", "reviewed", "rows", "judged", "errors", "_j0", "_e0").agg(F.sum("_judged").alias("_j1"), F.sum(F.col("_judged") * F.col("_error")).alias("_e1"))
    seen, caught = F.col("_j0") + F.col("_j1"), F.col("_e0") + F.col("_e1")
    rate = F.nullif(F.col("errors"), F.lit(0)) / F.nullif(F.col("judged"), F.lit(0))
    found = caught / F.nullif(seen, F.lit(0))
    return got.select(
        "fraction", "reviewed", seen.alias("evaluated"), caught.alias("captured"), F.round(caught / F.nullif(F.col("errors"), F.lit(0)), 6).alias("capture_rate"), F.round(found, 6).alias("error_yield"), F.round(F.round(found, 6) / F.round(rate, 6), 6).alias("lift")
    )


#: Time regions in which a map's anchors may lie (fixed value).
MOST_REGIONS = 3


def quality_level(c: dict[str, Column]) -> Column:
    """``blocked``, ``review`` or ``verified`` by the thresholds of a time map's measures (fixed values).

    ``c`` holds probability, coverage, unique_coverage, p50, p95, p99, boundary, margin, anchors, regions, and the
    conditions measured, audio, visual and manual; measures may be null.  Shares outside 0 to 1, times that are
    negative, broken, no whole milliseconds or smaller than a lower percentile, and counts out of range block.
    """
    wrong = F.lit(False)
    for name in ("probability", "coverage", "unique_coverage", "margin"):
        x = c[name].cast("double")
        wrong = wrong | F.coalesce(F.isnan(x) | (x < 0) | (x > 1), F.lit(False))
    for name in ("p50", "p95", "p99", "boundary"):
        x = c[name].cast("double")
        wrong = wrong | F.coalesce(F.isnan(x) | (x < 0) | (x == float("inf")) | (x != F.floor(x)), F.lit(False))
    wrong = wrong | F.coalesce(c["anchors"] < 0, F.lit(False)) | F.coalesce(~c["regions"].between(0, MOST_REGIONS), F.lit(False))
    for lower, upper in (("p50", "p95"), ("p95", "p99")):
        wrong = wrong | F.coalesce(c[lower] > c[upper], F.lit(False))
    primary = c["audio"] | c["visual"] | c["manual"]
    blocked = [c["coverage"] < 0.2, c["p95"] > 2000, c["boundary"] > 5000, c["margin"] < 0.02]
    complete = F.lit(True)
    for name in ("probability", "coverage", "p50", "p95", "p99", "boundary", "margin"):
        complete = complete & c[name].isNotNull()
    bad = F.lit(False)
    for rule in blocked:
        bad = bad | F.coalesce(rule, F.lit(False))
    fine = (
        (c["probability"] >= 0.995) & (c["coverage"] >= 0.9) & (c["p95"] <= 100) & (c["p99"] <= 500) & (c["boundary"] <= 250) & (c["margin"] >= 0.25)
        & (c["anchors"] >= 30) & (c["regions"] >= 3) & F.coalesce(c["unique_coverage"] >= 0.8, F.lit(False))
    )
    independent = c["manual"] | (c["audio"] & c["visual"])
    return F.when(wrong | ~primary | bad, "blocked").when(complete & c["measured"] & independent & fine, "verified").otherwise("review")


def reconciled_level(declared: Column, assessed: Column) -> Column:
    """A declared level, lowered to what the measures allow and never raised."""
    return F.when(declared.isin("legacy-unverified", "blocked"), declared).when(declared == "review", F.when(assessed == "blocked", assessed).otherwise(declared)).otherwise(assessed)
